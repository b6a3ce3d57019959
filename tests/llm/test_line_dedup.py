import random

from codeloom.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs):
    """Texts after dedup by comparing every line with every earlier one."""
    order = sorted({(i is None, i or 0, i, t) for i, t in docs if t is not None}, key=lambda d: d[:2])
    seen, out = [], {}
    for _, _, i, text in order:
        kept = []
        for line in text.split("\n"):
            w = [x for x in line.replace("\t", " ").split(" ") if x]
            if len(w) >= 3:
                if any(w == v or (len(w) >= 5 and len(v) >= 5 and distance(w, v) <= 1) for v in seen):
                    seen.append(w)
                    continue
                seen.append(w)
            kept.append(line)
        out[(i, text)] = "\n".join(kept)
    return out


def check(spark, docs):
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs)
    want = brute(docs)
    expect = sorted(((i, want.get((i, t), t)) for i, t in docs), key=repr)
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == expect


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(2, 12))] for _ in range(40)]
    docs = []
    for i in range(60):
        out = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(pool))
            kind = rng.randint(0, 4)
            at = rng.randrange(len(line))
            if kind == 1:
                line[at] = rng.choice(vocabulary)
            elif kind == 2:
                del line[at]
            elif kind == 3:
                line.insert(at, rng.choice(vocabulary))
            out.append(" ".join(line))
        docs.append((i, "\n".join(out)))
    check(spark, docs)


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(700))
    check(spark, [(1, None), (2, ""), (3, "\n\n"), (4, "a b c d e"), (5, "a b c d"), (6, "a b c d e\na b c d f\na b c d e f"), (6, "a b c d e\na b c d f\na b c d e f"), (None, "a  b\tc d e"), (7, long), (8, long + " y"), (9, long.replace("x350 ", ""))])


def test_empty_table_and_clashing_names(spark):
    empty = line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.columns == ["doc_id", "text", "lines_removed"] and empty.count() == 0
    rows = line_dedup.dedup_lines(spark.createDataFrame([(1, "one two three", 9, "k")], "doc_id long, text string, lines_removed long, `odd name` string")).collect()
    assert rows[0].lines_removed == 0 and rows[0]["odd name"] == "k"


def test_many_near_copies_of_one_line(spark):
    docs = [(i, f"a b c d e f{i} g h") for i in range(400)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert [r.doc_id for r in got.filter("text != ''").collect()] == [0]
