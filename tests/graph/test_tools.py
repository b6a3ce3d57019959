import subprocess

import pytest
from codeloom.functions import text as T
from codeloom.operators import cycles, graphs, relational, traverse
from codeloom.plans import tools
from codeloom.sources import configs, definitions, git
from codeloom.workspace import Workspace
from pyspark.sql import functions as F


def test_versions_of_files_in_a_repository(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "a.ts").write_text("export const a = 1;\n")
    (tmp_path / "gone.py").write_text("x = 1\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    (tmp_path / "a.ts").write_text("export const a = 2;\n")
    (tmp_path / "new.rs").write_text("fn f() {}\n")
    (tmp_path / "gone.py").unlink()
    run("add", "-A")
    run("commit", "-qm", "two")
    changed = {(r.path, r.status) for r in git.changed_files(spark, str(tmp_path), "HEAD~1").collect()}
    assert changed == {("a.ts", "M"), ("gone.py", "D"), ("new.rs", "A")}
    older = git.files_at(spark, str(tmp_path), "HEAD~1", ["a.ts", "new.rs", "gone.py"])
    assert {(r.path, r.text, r.lang) for r in older.collect()} == {("a.ts", "export const a = 1;\n", "typescript"), ("gone.py", "x = 1\n", "python")}
    with pytest.raises(ValueError):
        git.changed_files(spark, str(tmp_path), "nowhere")


def test_a_workspace_is_refreshed_as_if_scanned_anew(spark, tmp_path):
    texts = {"a.ts": "import { help } from '@lib/b';\nexport function main() {\n  help();\n}\n", "lib/b.ts": "export function help() {\n  return 1;\n}\n", "lib/c.ts": "export function other() {\n  return 1;\n}\n", "tsconfig.json": '{"compilerOptions": {"paths": {"@lib/*": ["./lib/*"]}}}'}
    write = lambda path, text: ((tmp_path / path).parent.mkdir(exist_ok=True), (tmp_path / path).write_text(text))
    for path, text in texts.items():
        write(path, text)
    w, root = Workspace.scan(spark, str(tmp_path)), str(tmp_path)
    assert [(r.source_path, r.target_path) for r in w.file_edges.collect()] == [(f"{root}/a.ts", f"{root}/lib/b.ts")]
    assert [r.target_id for r in w.edges.collect()] == [f"{root}/lib/b.ts:help"]
    write("lib/b.ts", "export function helped() {\n  return main();\n}\n")
    write("lib/d.ts", "export function help() {\n  return 10;\n}\n")
    (tmp_path / "lib/c.ts").unlink()
    fresh = Workspace.scan(spark, str(tmp_path))
    now = w.refresh(fresh.files)
    for table in ("nodes", "edges", "file_edges", "imports", "files"):
        columns = [c for c in getattr(fresh, table).columns if c != "indexed_at"]
        rows = lambda x: sorted(map(str, getattr(x, table).select(*columns).collect()))  # noqa: B023, E731
        assert rows(now) == rows(fresh), table


def test_script_blocks_are_the_code_of_components(spark):
    files = spark.createDataFrame([("/w/C.vue", "<template>\nfunction no() {}\n</template>\n<script>\nexport function yes() {\n  return 1;\n}\n</script>", "vue")], "path string, text string, lang string")
    nodes, _ = definitions.extract(files)
    assert [(r.name, r.start_line, r.end_line) for r in nodes.collect()] == [("yes", 2, 4)]


def test_configuration_files_that_refer_to_each_other():
    texts = {"/r/tsconfig.json": '{"extends": "./other.json", "compilerOptions": {"paths": {"a": ["x.ts"]}}}', "/r/other.json": '{"extends": "./tsconfig.json", "compilerOptions": {"paths": {"b/*": ["y/*"], "none": []}}}', "/r/package.json": "[1]", "/r/go.mod": "// none\n"}
    assert configs.aliases(texts) == [("/r", "a", "/r/x.ts"), ("/r", "b", "/r/y")] and configs.go_modules(texts) == {}


def test_components_of_long_and_nested_rings(spark):
    ring = lambda *n: [(str(a), str(b)) for a, b in zip(n, (*n[1:], n[0]), strict=True)]
    pairs = ring(*range(100, 140)) + ring(1, 2) + ring(5, 6, 7) + [("100", "1"), ("2", "5"), ("7", "300"), ("300", "301"), ("9", "9")]
    edges = spark.createDataFrame(pairs, "source_id string, target_id string")
    got = {}
    for r in cycles.components(edges).collect():
        got.setdefault(r.component, set()).add(r.id)
    assert got == {"139": {str(n) for n in range(100, 140)}, "2": {"1", "2"}, "7": {"5", "6", "7"}}
    assert cycles.components(edges.limit(0)).count() == 0


def test_walks_of_any_depth(spark):
    chain = spark.createDataFrame([(f"{a:03}", f"{a + 1:03}") for a in range(30)], "source_id string, target_id string")
    root = spark.createDataFrame([("000",)], "id string")
    assert traverse.reach(chain, root, None).nodes.agg(F.max("depth")).first()[0] == 30
    near, edges = traverse.connected(chain, spark.createDataFrame([("015",)], "id string"))
    assert (near.count(), edges.count()) == (31, 30)
    got = {r.id: (r.dependents, r.partial) for r in traverse.review_impact(chain, chain.select(F.col("target_id").alias("id")), 3).collect()}
    assert (got["001"], got["003"], got["030"]) == ((1, False), (3, True), (3, True))


def test_communities_of_cliques_and_lone_nodes(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefz"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f")], "source_id string, target_id string")
    assert {r.id: r.community for r in relational.communities(nodes, edges).collect()} == {"a": 1, "b": 1, "c": 1, "d": 2, "e": 2, "f": 2, "z": 0}


def test_communities_by_cliques_and_by_labels(spark):
    """Cliques are told without labels, also beside other components; edges given twice or both ways change no result."""
    from unittest import mock

    clique = lambda names: [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    table = lambda pairs: spark.createDataFrame(pairs, "source_id string, target_id string")
    nodes = spark.createDataFrame([(x,) for x in "abcdefghijklmnopqrstuvwz"], "id string")
    cliques = clique("abcd") + clique("gef") + [("i", "h")]
    with mock.patch.object(relational, "label_communities", side_effect=AssertionError("labels were propagated")):
        got = {r.id: r.community for r in relational.communities(nodes, table([*cliques, ("a", "a"), ("z", "z")])).collect()}
    want = dict.fromkeys("abcd", 1) | dict.fromkeys("efg", 2) | dict.fromkeys("hi", 3)
    assert got == {x: want.get(x, 0) for x in "abcdefghijklmnopqrstuvwz"}
    # A clique but for one edge, a star and a square, and cliques with edges given again.
    others = [e for e in clique("jklm") if e != ("j", "m")] + [("n", "o"), ("n", "p"), ("n", "q")] + [("r", "s"), ("s", "t"), ("t", "u"), ("u", "r")]
    edges = table([*cliques, *others, ("a", "b"), ("f", "e"), ("h", "i"), *clique("vw")])
    labels = {r.id: r.community for r in relational.label_communities(edges).collect()}
    least = {c: min(i for i in labels if labels[i] == c) for c in labels.values()}
    number = {c: k for k, c in enumerate(sorted(least, key=least.get), 1)}
    got = {r.id: r.community for r in relational.communities(nodes, edges).collect()}
    assert got == {x: number[labels[x]] if x in labels else 0 for x in "abcdefghijklmnopqrstuvwz"}
    assert relational.communities(nodes, edges.limit(0)).filter("community != 0").count() == 0


def test_branches_of_code(spark):
    code = ["if (a) {} else if (b) {} else {}", "for (;;) { x ? 1 : 2 }", "a?.b ?? c", "f(x?: number, y?)", "switch (a) { case 1: default: }", "export default f", "do {} while (a)"]
    rows = spark.createDataFrame([(c,) for c in code], "c string").select(T.complexity(F.col("c"))).collect()
    assert [r[0] for r in rows] == [4, 2, 0, 0, 2, 0, 1]


def test_reverse_index_of_another_root(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 1)], "source_path string, target_path string, line int")
    graphs.save_reverse_index(edges, "/w", str(tmp_path))
    assert graphs.load_reverse_index(spark, "/w", str(tmp_path), edges.schema).collect() == edges.collect()
    with pytest.raises(ValueError):
        graphs.load_reverse_index(spark, "/elsewhere", str(tmp_path), edges.schema)


def test_written_trees_give_their_rows(spark):
    assert {(r.path, r.module, r.target_path) for r in tools.x14_config_aliases(spark, "").collect()} == {r for r in tools._BY_ALIAS if r[2]}
    assert {(r.path, r.name, r.complexity) for r in tools.o10_complex_functions(spark, "").collect()} == {("/ws/a.ts", "forked", 5), ("/ws/b.ts", "chosen", 6), ("/ws/C.vue", "inside", 2)}
