"""Every tool of a workspace as a query over one written source tree; the SQL of each is the list of its rows.

The tree is indexed once in a session and kept in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational, reports, symbols
from ..storage import shared_folder
from ..workspace import Workspace
from .queries import example

_A = "import { help } from './b';\nimport { type Only } from './types';\nimport { unusedThing } from './c';\nexport function main() {\n  help();\n  second();\n}\nfunction second() {\n  main();\n}\n"
_B = "import { main } from './a';\nexport function help(x: number) {\n  return main();\n}\nexport function lonely() {\n  return 1;\n}\n"
_C = "export const unusedThing = (x) => {\n  return x;\n};\n"
_D = "import { help } from './b';\nexport function checks() {\n  help(1);\n}\n"
_M = "import os\ndef top():\n    return inner()\ndef inner():\n    return 1\n"
_TREE = [("/t/a.ts", _A, "typescript", 11, 1), ("/t/b.ts", _B, "typescript", 12, 2), ("/t/c.ts", _C, "typescript", 13, 3), ("/t/b.test.ts", _D, "typescript", 14, 4), ("/t/m.py", _M, "python", 15, 5)]
_OLDER = [("/t/b.ts", "export function help(x: string, y: number) {\n  return 1;\n}\n", "typescript")]
_INDEX: dict[str, Workspace] = {}


def _workspace(spark) -> Workspace:
    name = spark.sparkContext.applicationId
    if name not in _INDEX:
        _INDEX[name] = Workspace.of("/t", spark.createDataFrame(_TREE, "path string, text string, lang string, mtime_ms long, size long"))
    return _INDEX[name]


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _said(value) -> str:
    if isinstance(value, list):
        return "[" + ", ".join(map(_said, value)) + "]"
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def _rows(columns: str, *rows) -> str:
    """SQL of these rows, with the columns as ``name TYPE``."""
    pairs = [c.split() for c in columns.split(", ")]
    values = ", ".join("(" + ", ".join(map(_said, row)) + ")" for row in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in pairs)} FROM (VALUES {values}) AS t({', '.join(n for n, _ in pairs)})"


@example(_rows("module VARCHAR, type VARCHAR, line INTEGER", ("./b", "import", 1), ("./c", "import", 3)))
def tool_parse_imports(spark, sf_dir):
    return _workspace(spark).parse_imports("/t/a.ts").select("module", "type", "line")


@example(_rows("target_path VARCHAR, module VARCHAR, line INTEGER", ("/t/b.ts", "./b", 1), ("/t/c.ts", "./c", 3)))
def tool_analyze_dependencies(spark, sf_dir):
    return _workspace(spark).analyze_dependencies("/t/a.ts").select("target_path", "module", "line")


@example(_rows("source_path VARCHAR", ("/t/a.ts",), ("/t/b.test.ts",)))
def tool_find_referencing_files(spark, sf_dir):
    return _workspace(spark).find_referencing_files("/t/b.ts").select("source_path")


@example(_rows("path VARCHAR, module VARCHAR, target_path VARCHAR", ("/t/a.ts", "./b", "/t/b.ts")))
def tool_resolve_module_path(spark, sf_dir):
    return _workspace(spark).resolve_module_path("/t/a.ts", "./b")


@example(_rows("source_path VARCHAR, target_path VARCHAR, used BOOLEAN", ("/t/a.ts", "/t/b.ts", True), ("/t/a.ts", "/t/c.ts", False), ("/t/b.ts", "/t/a.ts", True), ("/t/b.test.ts", "/t/b.ts", True)))
def tool_verify_dependency_usage(spark, sf_dir):
    return _workspace(spark).verify_dependency_usage().select("source_path", "target_path", "used")


@example(_rows("id VARCHAR, depth INTEGER", ("/t/b.test.ts", 0), ("/t/b.ts", 1), ("/t/a.ts", 2), ("/t/c.ts", 3)))
def tool_crawl_dependency_graph(spark, sf_dir):
    return _workspace(spark).crawl_dependency_graph("/t/b.test.ts", 3)[0].select("id", "depth")


@example(_rows("id VARCHAR", ("/t/b.ts",), ("/t/c.ts",)))
def tool_expand_node(spark, sf_dir):
    return _workspace(spark).expand_node("/t/b.ts", _ids(spark, "/t/a.ts")).select("id")


@example(_rows("cycle VARCHAR[], size INTEGER", (["/t/a.ts", "/t/b.ts", "/t/a.ts"], 2)))
def tool_circular_dependencies(spark, sf_dir):
    return _workspace(spark).circular_dependencies()


@example(_rows("relative VARCHAR, extension VARCHAR, dependencies BIGINT, dependents BIGINT", ("a.ts", "ts", 2, 1), ("b.ts", "ts", 1, 2), ("c.ts", "ts", 0, 1), ("b.test.ts", "ts", 1, 0), ("m.py", "py", 0, 0)))
def tool_architecture(spark, sf_dir):
    return _workspace(spark).architecture().select("relative", "extension", "dependencies", "dependents")


@example(_rows("id VARCHAR, category VARCHAR, start_line INTEGER, end_line INTEGER", ("/t/a.ts:main", "function", 4, 7), ("/t/a.ts:second", "function", 8, 10)))
def tool_get_symbol_graph(spark, sf_dir):
    return _workspace(spark).get_symbol_graph("/t/a.ts")[0].select("id", "category", "start_line", "end_line")


@example(_rows("source_symbol_id VARCHAR, source_file VARCHAR", ("/t/a.ts:main", "/t/a.ts"), ("/t/b.test.ts:checks", "/t/b.test.ts")))
def tool_get_symbol_dependents(spark, sf_dir):
    return _workspace(spark).get_symbol_dependents("/t/b.ts:help").select("source_symbol_id", "source_file")


@example(_rows("source_symbol_id VARCHAR, is_type_only BOOLEAN", ("/t/a.ts:second", False), ("/t/b.ts:help", False)))
def tool_get_symbol_callers(spark, sf_dir):
    return _workspace(spark).get_symbol_callers("/t/a.ts:main", "runtime").select("source_symbol_id", "is_type_only")


@example(_rows("id VARCHAR, depth INTEGER", ("/t/b.test.ts:checks", 0), ("/t/b.ts:help", 1), ("/t/a.ts:main", 2), ("/t/a.ts:second", 3)))
def tool_trace_function_execution(spark, sf_dir):
    return _workspace(spark).trace_function_execution("/t/b.test.ts:checks").nodes


@example(_rows("direct BIGINT, transitive BIGINT, total BIGINT, runtime BIGINT, type_only BIGINT, level VARCHAR, partial BOOLEAN", (2, 1, 3, 2, 0, "low", False)))
def tool_get_impact_analysis(spark, sf_dir):
    return _workspace(spark).get_impact_analysis("/t/b.ts:help", 2)


@example(_rows("id VARCHAR", ("/t/b.ts:lonely",)))
def tool_find_unused_symbols(spark, sf_dir):
    return _workspace(spark).find_unused_symbols("/t/b.ts").select("id")


@example(_rows("path VARCHAR, exported BIGINT, unused BIGINT, percent INTEGER", ("/t/a.ts", 1, 0, 0), ("/t/b.ts", 2, 1, 50), ("/t/c.ts", 1, 1, 100), ("/t/b.test.ts", 1, 1, 100), ("/t/m.py", 2, 2, 100)))
def tool_scan_dead_code(spark, sf_dir):
    return _workspace(spark).scan_dead_code()


@example(_rows("source_id VARCHAR, target_id VARCHAR, call_order INTEGER", ("/t/a.ts:main", "/t/a.ts:second", 1), ("/t/a.ts:second", "/t/a.ts:main", 1)))
def tool_analyze_file_logic(spark, sf_dir):
    return _workspace(spark).analyze_file_logic("/t/a.ts")[0].select("source_id", "target_id", "call_order")


@example(_rows("component VARCHAR, size BIGINT, kind VARCHAR", ("/t/a.ts:second", 2, "mutual")))
def tool_file_cycles(spark, sf_dir):
    return _workspace(spark).analyze_file_logic("/t/a.ts")[1]


@example(_rows("source_id VARCHAR, target_id VARCHAR, depth INTEGER, direction VARCHAR, is_cyclic BOOLEAN", ("/t/a.ts:main", "/t/b.ts:help", 1, "callees", True), ("/t/a.ts:main", "/t/a.ts:second", 1, "callees", True), ("/t/a.ts:second", "/t/a.ts:main", 1, "callers", True), ("/t/b.ts:help", "/t/a.ts:main", 1, "callers", True)))
def tool_query_call_graph(spark, sf_dir):
    return _workspace(spark).query_call_graph("/t/a.ts:main", "both", 1).select("source_id", "target_id", "depth", "direction", "is_cyclic")


@example(_rows("source_id VARCHAR, target_id VARCHAR, direction VARCHAR", ("/t/b.ts:help", "/t/a.ts:main", "outgoing"), ("/t/a.ts:main", "/t/b.ts:help", "incoming"), ("/t/b.test.ts:checks", "/t/b.ts:help", "incoming")))
def tool_neighbourhood(spark, sf_dir):
    return _workspace(spark).neighbourhood("/t/b.ts:help", 1)[1].select("source_id", "target_id", "direction")


@example(_rows("exports VARCHAR[], dependencies VARCHAR[], dependents BIGINT, cyclic_edges BIGINT", (["help", "lonely"], ["/t/a.ts"], 2, 1)))
def tool_generate_codemap(spark, sf_dir):
    return _workspace(spark).generate_codemap("/t/b.ts").select("exports", "dependencies", "dependents", "cyclic_edges")


@example(_rows("id VARCHAR, depth INTEGER, score BIGINT", ("/t/b.ts:help", 0, 1), ("/t/a.ts:main", 1, 0), ("/t/b.test.ts:checks", 1, 0)))
def tool_query_natural_language(spark, sf_dir):
    return _workspace(spark).query_natural_language("who calls help?", 1)[0].select("id", "depth", "score")


@example(_rows("path VARCHAR, score INTEGER", ("/t/a.ts", 100), ("/t/b.ts", 67), ("/t/c.ts", 0), ("/t/b.test.ts", 0), ("/t/m.py", 33)))
def tool_generate_wiki(spark, sf_dir):
    return _workspace(spark).generate_wiki(shared_folder(spark, "wiki")).select("path", "score")


@example(_rows("subject VARCHAR, change VARCHAR, breaking BOOLEAN", ("x", "parameter-type-changed", True), ("y", "parameter-removed", True)))
def tool_analyze_breaking_changes(spark, sf_dir):
    return _workspace(spark).analyze_breaking_changes(spark.createDataFrame(_OLDER, "path string, text string, lang string")).select("subject", "change", "breaking")


@example(_rows("name VARCHAR, breaking BIGINT, dependents BIGINT, cyclic BOOLEAN, unused BOOLEAN, tested BOOLEAN, partial BOOLEAN, score INTEGER, risk VARCHAR", ("help", 2, 4, True, False, True, False, 100, "critical"), ("lonely", 0, 0, False, True, True, False, 10, "low")))
def tool_review_pr(spark, sf_dir):
    found = _workspace(spark).review_pr(spark.createDataFrame(_OLDER, "path string, text string, lang string"))
    return found.select("name", "breaking", "dependents", "cyclic", "unused", "tested", "partial", "score", "risk")


@example(_rows("indexed_files BIGINT, targets BIGINT, references_ BIGINT, files BIGINT, missing BIGINT, stale BIGINT, is_valid BOOLEAN", (3, 3, 4, 5, 1, 1, False)))
def tool_get_index_status(spark, sf_dir):
    now = spark.createDataFrame([(p, m + (p == "/t/c.ts"), s) for p, _, _, m, s in _TREE[:4]], "path string, mtime_ms long, size long")
    return _workspace(spark).get_index_status(now).withColumnRenamed("references", "references_").select("indexed_files", "targets", "references_", "files", "missing", "stale", "is_valid")


@example(_rows("id VARCHAR", ("/t/a.ts:main",), ("/t/a.ts:second",), ("/t/c.ts:unusedThing",), ("/t/b.test.ts:checks",), ("/t/m.py:top",), ("/t/m.py:inner",)))
def tool_invalidate_files(spark, sf_dir):
    return _workspace(spark).invalidate_files(["/t/b.ts"]).nodes.select("id")


@example(_rows("source_id VARCHAR, target_id VARCHAR, type_relation VARCHAR, source_line INTEGER, is_cyclic BOOLEAN", ("/t/a.ts:main", "/t/b.ts:help", "CALLS", 5, True), ("/t/a.ts:main", "/t/a.ts:second", "CALLS", 6, True), ("/t/a.ts:second", "/t/a.ts:main", "CALLS", 9, True), ("/t/b.ts:help", "/t/a.ts:main", "CALLS", 3, True), ("/t/b.test.ts:checks", "/t/b.ts:help", "CALLS", 3, False), ("/t/m.py:top", "/t/m.py:inner", "CALLS", 3, False)))
def tool_saved_and_loaded_index(spark, sf_dir):
    folder = shared_folder(spark, "index")
    _workspace(spark).save(folder)
    return Workspace.load(spark, folder).edges.select("source_id", "target_id", "type_relation", "source_line", "is_cyclic")


@example(_rows("id VARCHAR, start_line INTEGER", ("/t/a.ts:second", 8)))
def p1_symbol_lookup(spark, sf_dir):
    return symbols.lookup(_workspace(spark).nodes, "/t/a.ts", "second").select("id", "start_line")


@example(_rows("diagram VARCHAR", ("flowchart TD\n  _t_a_ts[\"/t/a.ts (100)\"]\n  _t_b_ts[\"/t/b.ts (67)\"]\n  _t_m_py[\"/t/m.py (33)\"]\n  _t_a_ts --> _t_b_ts\n  _t_b_ts --> _t_a_ts",)))
def k8_architecture_diagram(spark, sf_dir):
    w = _workspace(spark)
    return reports.architecture_diagram(reports.articles(w.nodes, w.edges).filter("score > 0"), w.file_edges)


@example(_rows("diagram VARCHAR", ("flowchart LR\n  _t_a_ts --> _t_b_ts\n  _t_b_test_ts --> _t_b_ts",)))
def k8_caller_diagram(spark, sf_dir):
    return reports.caller_diagram(_workspace(spark).file_edges, "/t/b.ts")


@example(_rows("page VARCHAR", ("# Index\n\n## Top hubs\n\n- [/t/a.ts](articles/_t_a.ts.md) (100)\n- [/t/b.ts](articles/_t_b.ts.md) (67)\n\n## Files\n\n- [/t/a.ts](articles/_t_a.ts.md)\n- [/t/b.test.ts](articles/_t_b.test.ts.md)\n- [/t/b.ts](articles/_t_b.ts.md)\n- [/t/c.ts](articles/_t_c.ts.md)\n- [/t/m.py](articles/_t_m.py.md)\n",)))
def k7_index_page(spark, sf_dir):
    w = _workspace(spark)
    return reports.index_page(reports.articles(w.nodes, w.edges), 2)


@example(_rows("report VARCHAR", ("# Graph\n\n3 nodes, 2 edges\n\n- /t/a.ts\n- /t/b.ts\n- ...\n\n- /t/a.ts -> /t/b.ts\n- ...\n",)))
def k4_markdown_report(spark, sf_dir):
    w = _workspace(spark)
    nodes = w.files.filter("path in ('/t/a.ts', '/t/b.ts', '/t/c.ts')").select("path")
    return reports.graph_report(nodes, w.file_edges.filter("source_path = '/t/a.ts'"), "Graph", 2, 1)


@example(_rows("parent VARCHAR, id VARCHAR, place INTEGER", ("/s", "/s:Zoo", 1), ("/s", "/s:alpha", 2), ("/s", "/s:beta", 3), ("/s:Zoo", "/s:feed", 1), ("/s:Zoo", "/s:open", 2)))
def g38_member_tree(spark, sf_dir):
    rows = [("/s:beta", "beta", "function", None), ("/s:alpha", "alpha", "variable", None), ("/s:Zoo", "Zoo", "class", None), ("/s:open", "open", "method", "/s:Zoo"), ("/s:feed", "feed", "method", "/s:Zoo")]
    return symbols.member_tree(spark.createDataFrame([(*r, "/s") for r in rows], "id string, name string, kind string, parent_symbol_id string, file_path string"))


@example(_rows("source_id VARCHAR, target_id VARCHAR", ("/t/a.ts:main", "/t/a.ts:second"), ("/t/a.ts:second", "/t/a.ts:main")))
def o8_edges_within_budget(spark, sf_dir):
    """The first symbols whose names fit a budget, and the calls between them."""
    w = _workspace(spark)
    return relational.subgraph_within_budget(w.nodes, w.edges, F.length("name"), 12, ["path", "start_line"], 10)[1].select("source_id", "target_id")
