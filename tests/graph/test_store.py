"""The graph store against plain replacement of rows, restarts of its stream, and what a change writes."""

import os
import random
import tempfile

import pytest
from codeloom import schema
from codeloom.streaming import changes
from codeloom.streaming.store import GraphStore
from pyspark.errors import StreamingQueryException


def node(id_, path):
    return (id_, id_, "function", "ts", path, "/", 1, 2, True, 0)


def tables(spark, files, edges):
    nodes = [node(i, p) for p, ids in files.items() for i in ids]
    return spark.createDataFrame(nodes, schema.NODES), spark.createDataFrame([(a, b, "CALLS", 1) for a, b in edges], schema.EDGES)


def state(nodes, edges):
    return sorted((r.path, r.id) for r in nodes.collect()), sorted((r.source_id, r.target_id) for r in edges.collect())


def replaced(files, edges, path, ids, new_edges):
    """One file after another by plain means: its own edges go, edges to ids that are no more go."""
    owner = {i: p for p, held in files.items() for i in held}
    files = {p: held for p, held in files.items() if p != path} | ({path: ids} if ids else {})
    now = {i for held in files.values() for i in held}
    kept = [e for e in edges if owner.get(e[0]) != path] + [e for e in new_edges if e[0] in ids]
    return files, sorted(e for e in kept if e[1] in now or e[1].startswith(schema.STUB))


def test_changes_equal_plain_replacement(spark):
    dice = random.Random(8)
    ids = {f"f{k}": [f"f{k}:{n}" for n in range(3)] for k in range(6)}
    every = [i for held in ids.values() for i in held]
    edges = sorted({(dice.choice(every), dice.choice([*every, schema.STUB + "x"])) for _ in range(40)})
    files, store = dict(ids), GraphStore(spark, tempfile.mkdtemp(), 4)
    store.create(*tables(spark, files, edges))
    for version in range(1, 6):
        path = dice.choice(list(ids))
        held = dice.sample(ids[path], dice.choice([0, 1, 2, 3]))
        made = sorted({(dice.choice(ids[path]), dice.choice([*every, "nowhere", schema.STUB + "y"])) for _ in range(4)})
        files, edges = replaced(files, edges, path, held, made)
        new_nodes, new_edges = tables(spark, {path: held} if held else {}, made)
        assert store.apply(version, spark.createDataFrame([(path,)], "path string"), new_nodes, new_edges)
        assert not store.apply(version, spark.createDataFrame([("f0",)], "path string"), *tables(spark, {}, []))
        if version == 3:
            store.compact()
            store.clean()
    found = state(store.nodes(), store.edges())
    assert found == (sorted((p, i) for p, held in files.items() for i in held), edges)
    assert [b for _, b in store.commits()] == [True, False, False] and store.latest() == 5


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_bytes_written_follow_the_change(spark):
    folder = tempfile.mkdtemp()
    files = {f"file{k}": [f"file{k}:{n}" for n in range(40)] for k in range(100)}
    edges = [(f"file{k}:{n}", f"file{(k * 7 + n) % 100}:{n}") for k in range(100) for n in range(40)]
    store = GraphStore(spark, folder, 4)
    store.create(*tables(spark, files, edges))
    store.apply(1, spark.createDataFrame([("file3",)], "path string"), *tables(spark, {"file3": ["file3:0"]}, [("file3:0", "file4:1")]))
    base, change = (sum(size(f"{folder}/{kind}/version={v}") for kind in ("nodes", "edges", "gone", "lost")) for v in (1, 2))
    assert change < base / 8


def test_a_stream_that_starts_again_goes_on_with_its_graph(spark):
    files, edges = {"a": ["a1"], "b": ["b1"], "c": ["c1"]}, [("c1", "a1"), ("c1", "b1"), ("a1", "c1")]
    graph = tables(spark, files, edges)
    folder, checkpoint = tempfile.mkdtemp(), tempfile.mkdtemp() + "/checkpoint"
    none = tables(spark, {}, [])

    def run(*events, read=lambda paths: none):
        if events:
            spark.createDataFrame(list(events), "path string, event_type string").coalesce(1).write.mode("append").parquet(folder)
        return state(*changes.follow(spark.readStream.schema("path string, event_type string").parquet(folder), *graph, read, checkpoint))

    assert run(("a", "delete")) == ([("b", "b1"), ("c", "c1")], [("c1", "b1")])
    assert run(("b", "delete")) == ([("c", "c1")], [])
    assert run() == ([("c", "c1")], [])

    def broken(paths):
        raise RuntimeError("the files can't be read")

    with pytest.raises(StreamingQueryException):
        run(("a", "create"), read=broken)
    assert run(read=lambda paths: tables(spark, {"a": ["a1", "a2"]}, [("a2", "c1"), ("a1", "b1")])) == ([("a", "a1"), ("a", "a2"), ("c", "c1")], [("a2", "c1")])


def test_incoming_edges_of_a_changed_file_stay(spark):
    graph = tables(spark, {"a": ["a1", "a2"], "b": ["b1"]}, [("b1", "a1"), ("b1", "a2"), ("a1", "b1")])
    folder = tempfile.mkdtemp()
    spark.createDataFrame([("a", "change")], "path string, event_type string").write.mode("append").parquet(folder)
    stream = spark.readStream.schema("path string, event_type string").parquet(folder)
    got = state(*changes.follow(stream, *graph, lambda paths: tables(spark, {"a": ["a1"]}, []), tempfile.mkdtemp() + "/checkpoint"))
    assert got == ([("a", "a1"), ("b", "b1")], [("b1", "a1")])
