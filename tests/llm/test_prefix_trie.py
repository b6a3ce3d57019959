"""The prefix trie against one that is built turn by turn, and odd input."""

import hashlib
import random
import zlib
from collections import defaultdict

from codeloom.llm import prefix_trie
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    made = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = said.get(c - c % 5, [])[:h] + said[c][h:]
    members, children, sums = defaultdict(list), defaultdict(set), {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                children[tuple(ts[: d - 1])].add(tuple(ts[:d]))
    out = []
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below = [sums[c] for c in children[node]]
        sums[node] = (saved + sum(s for s, _ in below), sum(n for _, n in below) or 1)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(made[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), sums[node][1], sums[node][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(spark, rows, schema=SCHEMA):
    table = spark.createDataFrame(rows, schema)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(*prefix_trie.rebuild(prefix_trie.number_turns(table))).collect()), key=lambda r: r[:2])


def test_nodes_equal_those_of_a_plain_trie(spark):
    dice = random.Random(3)
    rows = []
    for c in range(0, 400, 1):
        if dice.random() < 0.2:
            continue
        for turn in range(dice.choice([1, 2, 3, 5, 12, 30])):
            rows.append((c, dice.choice([turn, turn, None, 0]), dice.choice(["user", None, "assistant"]), dice.choice(["a", "éb", None, ""])))
    rows += rows[:50] + [(None, 0, "user", "nobody's")]
    dice.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_one_conversation_may_hold_most_turns(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", 3)
    rows = [(c, turn, "user", "same") for c in (0, 10, 11, 15) for turn in range(0, 700 - c)] + [(100 + c, turn, "user", "hi") for c in range(300) for turn in range(c % 3)]
    assert found(spark, rows) == brute(rows)


def test_chains_hang_on_chains(spark):
    # Each conversation leaves the one before a turn later, so the tree of chains is as high as it can be.
    rows = [(5 * c, turn, "u", "x" if turn < c else f"own {c}") for c in range(40) for turn in range(c + 2)]
    assert found(spark, rows) == brute(rows)


def test_turnless_conversations_and_empty_tables(spark):
    rows = [(1, 0, "u", "t"), (2, 0, "u", "t"), (7, 0, "u", "t"), (9, 0, "u", "t")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "u", "t")]) == []


def test_columns_of_the_same_names_play_no_part(spark):
    rows = [(c, t, "user", f"{c % 2} {t}") for c in range(12) for t in range(4)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit(1)).withColumn("h1", F.lit("x")).withColumn("_at", F.lit(2)).withColumn("depth", F.lit(3))
    got = prefix_trie.prefix_trie(*prefix_trie.rebuild(prefix_trie.number_turns(table)))
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == brute(rows)


def test_a_very_long_text_is_counted_in_bytes(spark):
    rows = [(c, 0, "user", "é" * 500_000) for c in (20, 25, 30)]
    (root, node) = found(spark, rows)
    assert (root[6], node[6]) == (2_000_000, 2_000_000) if node[3] == 3 else found(spark, rows) == brute(rows)
