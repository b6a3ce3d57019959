import pytest
from codeloom.sources import signatures
from codeloom.workspace import Workspace

TEXTS = {
    "a.ts": "import { help } from './lib/b';\nimport { gone } from './lib/c';\nexport function main(x: number, y?: string) {\n  help(x);\n}\n",
    "lib/b.ts": "import { again } from './c';\nexport function help(n: number) {\n  again();\n}\n",
    "lib/c.ts": "import { help } from './b';\nexport function again() {\n  help(1);\n}\nexport function lonely() {\n}\n",
    "lib/b.test.ts": "// nothing yet\n",
    "node_modules/x.ts": "export function never() {}\n",
    "readme.md": "text",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TEXTS.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root), Workspace.scan(spark, str(root))


def test_files(spark, tree, tmp_path):
    root, w = tree
    rel = lambda rows, c: {r[c][len(root) + 1 :] for r in rows.collect()}
    assert rel(w.files, "path") == {"a.ts", "lib/b.ts", "lib/c.ts", "lib/b.test.ts"}
    assert rel(w.analyze_dependencies(f"{root}/a.ts"), "target_path") == {"lib/b.ts", "lib/c.ts"}
    assert rel(w.find_referencing_files(f"{root}/lib/b.ts"), "source_path") == {"a.ts", "lib/c.ts"}
    assert [r.module for r in w.parse_imports(f"{root}/a.ts").collect()] == ["./lib/b", "./lib/c"]
    assert rel(w.resolve_module_path(f"{root}/a.ts", "./lib/c"), "target_path") == {"lib/c.ts"}
    assert rel(w.verify_dependency_usage(f"{root}/a.ts").filter("not used"), "target_path") == {"lib/c.ts"}
    nodes, edges = w.crawl_dependency_graph(f"{root}/a.ts")
    assert {(r.id[len(root) + 1 :], r.depth) for r in nodes.collect()} == {("a.ts", 0), ("lib/b.ts", 1), ("lib/c.ts", 1)}
    assert edges.filter("is_cyclic").count() == 2 and edges.count() == 4
    assert w.expand_node(f"{root}/a.ts", nodes).count() == 0
    assert {r.size for r in w.circular_dependencies().collect()} == {2}
    w.save(str(tmp_path / "index"))
    again = Workspace.load(spark, str(tmp_path / "index"))
    left = again.invalidate_files([f"{root}/lib/c.ts"])
    assert again.edges.count() == 3 and left.edges.count() == 1 and left.file_edges.count() == 1
    status = again.get_index_status(w.files.filter("path not like '%c.ts'")).first()
    assert (status.indexed_files, status.references, status.missing, status.is_valid) == (3, 4, 1, False)


def test_symbols(tree):
    root, w = tree
    main, helping, again = f"{root}/a.ts:main", f"{root}/lib/b.ts:help", f"{root}/lib/c.ts:again"
    assert {r.source_symbol_id for r in w.get_symbol_callers(helping).collect()} == {main, again}
    assert {r.id: r.depth for r in w.trace_function_execution(main).nodes.collect()} == {main: 0, helping: 1, again: 2}
    impact = w.get_impact_analysis(again).first()
    assert (impact.direct, impact.transitive, impact.level) == (1, 1, "low")
    assert {r.id for r in w.find_unused_symbols(f"{root}/lib/c.ts").collect()} == {f"{root}/lib/c.ts:lonely"}
    assert {(r.path[len(root) + 1 :], r.percent) for r in w.scan_dead_code().collect()} == {("a.ts", 100), ("lib/b.ts", 0), ("lib/c.ts", 50)}
    assert {(r.source_id, r.depth, r.direction) for r in w.query_call_graph(helping, "both", 1).collect()} == {(helping, 1, "callees"), (main, 1, "callers"), (again, 1, "callers")}
    assert w.edges.filter("is_cyclic").count() == 2
    near, between = w.query_natural_language("who calls help?", 1)
    assert {(r.id, r.score) for r in near.collect()} == {(helping, 1), (main, 0), (again, 0)} and between.count() == 3
    one = w.generate_codemap(f"{root}/lib/c.ts").first()
    assert (one.exports, one.dependents, one.cyclic_edges) == (["again", "lonely"], 1, 1)
    calls, rings = w.analyze_file_logic(f"{root}/a.ts")
    assert calls.count() == 0 and rings.count() == 0 and w.get_symbol_graph(f"{root}/a.ts")[0].first().category == "function"


def test_changes(spark, tree, tmp_path):
    root, w = tree
    older = spark.createDataFrame([(f"{root}/lib/b.ts", "export function help(n: string, m: number) {}", "typescript"), (f"{root}/a.ts", TEXTS["a.ts"], "typescript")], "path string, text string, lang string")
    assert {(r.subject, r.change) for r in w.analyze_breaking_changes(older).collect()} == {("n", "parameter-type-changed"), ("m", "parameter-removed")}
    got = [(r.name, r.breaking, r.dependents, r.cyclic, r.unused, r.tested, r.score, r.risk) for r in w.review_pr(older).collect()]
    assert got == [("help", 2, 3, True, False, True, 100, "critical"), ("main", 0, 0, False, True, False, 20, "medium")]
    assert "## Callers" in {r.path: r.article for r in w.generate_wiki(str(tmp_path / "wiki")).collect()}[f"{root}/lib/b.ts"]
    assert spark.read.parquet(str(tmp_path / "wiki")).count() == 3


def test_signatures(spark):
    files = spark.createDataFrame([("p.py", "def f(self, a, b: dict[str, int] = None, *rest):  # x\n  pass\n", "python"), ("r.rs", "fn g(&self, mut n: Vec<u8>, k: &str) {}", "rust"), ("n.ts", None, "typescript")], "path string, text string, lang string")
    got = {(r.file_path, r.name, r.position, r.param, r.type, r.is_optional) for r in signatures.signatures(files, "old").collect()}
    assert got == {("p.py", "f", 0, "a", "", False), ("p.py", "f", 1, "b", "dict[str, int]", True), ("p.py", "f", 2, "rest", "", True), ("r.rs", "g", 0, "n", "Vec<u8>", False), ("r.rs", "g", 1, "k", "&str", False)}
