"""Spelling variants of words, found by anagram keys.

The key of a word is the sum of its letters' values, a letter's value being the fifth power of its code point, so
words of the same letters have the same key whatever their order.  A letter added changes the key by its value, one
removed by the negative of it, and one exchanged by the difference of two.  Instead of trying all such
changes, every word is listed under its own key and under its key less each of its letters: a word whose key plus a
letter is another's meets it there (addition, removal), and two words whose keys differ by an exchange meet under what
is left of both.  Words that meet are verified for letter order by their edit distance.

An edit leaves the first or the last half of what is left alone, so a place in the list is named by key, length and
one of the two halves.  Words that meet have the same letters but one and half of their order in common, so a
place holds few words, however large the vocabulary is.

Every word's ``form`` is the near word with the most occurrences, if those are ``factor`` times its own, and ``root`` is
the end of the chain of forms, found by doubling: counts grow by the factor from form to form, so there is no
cycle and a handful of rounds suffices.

Defined results: a null text has no words; a null id counts as empty text in the hash of a run; rows that repeat count each
time; case is that of A-Z alone, so other capitals are letters of their own; of near words that are equal in
count the smallest in code-point order is the form; words without near words have none and are their own root; a
run of any length is a word; an empty table gives an empty result; other columns of the table play no part.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, materialise

LEAST_LETTERS, LEAST_COUNT, FACTOR = 6, 5, 5
#: One run in so many is misspelt, by leaving out a letter.
MISSPELT = 199
#: Keys are kept below this bound; letters up to U+00FF have values below it.
BOUND = 1 << 42


def _lowered(word: Column) -> Column:
    """A-Z in lower case; ``lower`` would change other capitals too."""
    return F.when(word.rlike("[^\\x00-\\x7F]"), F.translate(word, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(word))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, misspelt: int = MISSPELT) -> DataFrame:
    """(word, n): runs of letters of all texts, some of them misspelt by rule, with their numbers of occurrences.

    Of a run whose hash (crc32 of id, colon and run) is divisible by ``misspelt`` the letter at hash modulo length is left out.
    """
    run = F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_letters},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("_id"), run.alias("_run")).select("_id", _lowered(F.col("_run")).alias("_run"))
    hashed = runs.select("_run", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")).alias("_h"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    short = F.concat(F.col("_run").substr(F.lit(1), at), F.col("_run").substr(at + 2, F.length("_run")))
    words = hashed.select(F.when(F.col("_h") % misspelt == 0, short).otherwise(F.col("_run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter((F.col("n") >= least_count) & (F.length("word") >= least_letters))


def letter_value(letter: Column) -> Column:
    """The fifth power of a letter's code point, below BOUND."""
    c = F.ascii(letter).cast("long")
    return ((c * c * c % BOUND) * c % BOUND) * c % BOUND


def _places(words: DataFrame) -> DataFrame:
    """(_place, word, n, whole): each word where its own key stands, and where its key less each of its letters does."""
    letters = F.filter(F.split("word", ""), lambda x: x != "")
    known = words.select("word", "n", F.length("word").alias("_length"), F.transform(letters, letter_value).alias("_values"))
    known = known.withColumn("_key", F.aggregate("_values", F.lit(0).cast("long"), lambda a, v: (a + v) % BOUND))

    def halves(key: Column, left: Column) -> Column:
        half = F.floor(left / 2).cast("int")
        first, last = F.col("word").substr(F.lit(1), half), F.right("word", left - half)
        return F.array(F.xxhash64(F.lit(0), left, key, first), F.xxhash64(F.lit(1), left, key, last))

    less = F.flatten(F.transform(F.array_distinct("_values"), lambda v: halves((F.col("_key") - v + BOUND) % BOUND, F.col("_length") - 1)))
    whole = halves(F.col("_key"), F.col("_length"))
    places = F.concat(F.transform(whole, lambda p: F.struct(p.alias("place"), F.lit(True).alias("whole"))), F.transform(less, lambda p: F.struct(p.alias("place"), F.lit(False).alias("whole"))))
    return known.select("word", "n", F.explode(places).alias("p")).select(F.col("p.place").alias("_place"), "word", "n", F.col("p.whole").alias("whole"))


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (a, a_n, b, b_n), a before b, of words (word, n) that differ by one code point added, removed or exchanged."""
    listed = materialise(_places(words), "anagram-places")
    shared = listed.groupBy("_place").agg(F.count("*").alias("k"), F.min("whole").alias("all_whole")).filter("k > 1 and not all_whole").select("_place")
    listed = listed.join(shared, "_place", "left_semi")
    a = listed.select("_place", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("whole").alias("a_whole"))
    b = listed.select("_place", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("whole").alias("b_whole"))
    met = a.join(b, (a["_place"] == b["_place"]) & (F.col("a") < F.col("b")) & ~(F.col("a_whole") & F.col("b_whole")) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form; the way to the root is doubled in every round."""
    table = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "word-roots")
    while not table.filter("open").isEmpty():
        above = table.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        met = join_by_key(table, above, ["root"], "left", row_bytes=F.octet_length("root") + F.octet_length("_next") + 16)
        table = materialise(met.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("open")), "word-roots")
    return table.select("word", "root")


def group_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for a vocabulary (word, n) of different words."""
    words = materialise(words.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    pairs = near_words(words)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("s")).select("s.*")
    found = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best"))
    judged = words.join(found, "word", "left").withColumn("_form_n", -F.col("_best.less"))
    good = F.col("_form_n") >= factor * F.col("n")
    judged = materialise(judged.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("_best.near")).alias("form"), F.when(good, F.col("_form_n")).alias("form_n")), "word-forms")
    roots = _roots(judged.filter("form is not null").select("word", "form"))
    return judged.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
