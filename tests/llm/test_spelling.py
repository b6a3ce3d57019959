"""Spelling variants against a comparison of all words, and odd input."""

import random
import zlib
from collections import Counter

import regex
from codeloom.llm import spelling
from pyspark.sql import functions as F


def brute_words(rows, misspelt=spelling.MISSPELT, least_letters=6, least_count=5):
    found = Counter()
    for doc_id, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % misspelt == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_letters and n >= least_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_group(words, factor=5):
    forms, out = {}, []
    for w, n in words.items():
        around = sorted((-words[v], v) for v in words if v != w and near(v, w))
        best = around[0][1] if around and -around[0][0] >= factor * n else None
        forms[w] = best
        out.append((w, n, len(around), best, words[best] if best else None))

    def root(w):
        return root(forms[w]) if forms[w] else w

    return sorted((*row, root(row[0])) for row in out) if out else []


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: r[0])


def test_words_are_those_of_a_plain_count(spark):
    dice = random.Random(1)
    parts = ["an", "ther", "ét", "ÉT", "ION", "ß", "×", "ou"]
    rows = [(i % 40 or None, " ".join("".join(dice.choices(parts, k=3)) for _ in range(200)) + "Āabcdefg-1" if i % 9 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for misspelt in (199, 3):
        found = {r.word: r.n for r in spelling.vocabulary(docs, misspelt=misspelt).collect()}
        assert found == brute_words(rows, misspelt) and found


def test_groups_equal_those_of_all_pairs(spark):
    dice = random.Random(2)
    words = {"".join(dice.choices("abéc", k=dice.randint(6, 8))): dice.choice([5, 6, 30, 31, 160, 900]) for _ in range(700)}
    # Anagrams that are no near words, words near in several ways, chains of forms, and letters beyond the usual ones.
    words |= {"abcdef": 9, "fedcba": 9, "aaaaaaa": 5, "aaaaaa": 25, "aaaaaaaa": 5, "\U0001f600bbbbb": 5, "\U0001f601bbbbb": 50, "x" * 5000: 7, "x" * 4999 + "y": 70}
    table = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("form", F.lit("clash"))
    found = order(spelling.group_variants(table).select("word", "n", "n_near", "form", "form_n", "root").collect())
    assert found == brute_group(words)
    assert any(r[5] != r[3] for r in found if r[3])


def test_ties_take_the_first_word(spark):
    words = {"aaaaab": 50, "aaaaac": 50, "aaaaad": 10, "aaaaae": 51}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {r.word: r.form for r in spelling.group_variants(table.filter("n <= 50")).collect()} == {"aaaaab": None, "aaaaac": None, "aaaaad": "aaaaab"}


def test_empty_tables_and_long_runs(spark):
    none = spark.createDataFrame([], "doc_id long, text string, word string")
    assert spelling.group_variants(spelling.vocabulary(none)).count() == 0
    long = spark.createDataFrame([(1, ("q" * 200_000 + " ") * 6)], "doc_id long, text string")
    (row,) = spelling.group_variants(spelling.vocabulary(long)).collect()
    assert (len(row.word), row.n, row.n_near, row.root == row.word) == (200_000, 6, 0, True)
