"""Definitions and calls of source files: the nodes and edges of a call graph.

Strings and comments are blanked out, a file becomes a table of lines with the depth of their braces, and
definitions, their ends and the names they call are found by patterns, windows and joins over those lines.
Python goes by its ast module instead.  A file of at most 5 MB bounds every group.

Nodes have the id ``path:name``; of several definitions of one name in a file, the first counts.  A call
through an object (``obj.name()``) is left out, unless the object is the one that the method belongs to.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import complexity
from ..schema import STUB
from ..storage import written
from .imports import script

#: Language, type, whether exported (a pattern of the line, or "" for always), definition with the name first.
RULES = (
    ("typescript", "function", r"^\s*export\b", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"),
    ("typescript", "function", r"^\s*export\b", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"),
    ("typescript", "class", r"^\s*export\b", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("typescript", "interface", r"^\s*export\b", r"^\s*(?:export\s+)?(?:declare\s+)?interface\s+(\w+)"),
    ("typescript", "type", r"^\s*export\b", r"^\s*(?:export\s+)?(?:declare\s+)?type\s+(\w+)[^=]*="),
    ("typescript", "variable", r"^\s*export\b", r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=(?!.*=>)"),
    ("typescript", "variable", r"^\s*export\b", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)"),
    ("typescript", "method", "", r"^\s+(?:(?:public|private|protected|static|async|override|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|with\b)(\w+)\s*(?:<[^>]*>)?\([^)]*\)\s*(?::[^{;]+)?\{"),
    ("rust", "function", r"^\s*pub\b", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"),
    ("rust", "class", r"^\s*pub\b", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:struct|enum|union)\s+(\w+)"),
    ("rust", "interface", r"^\s*pub\b", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?trait\s+(\w+)"),
    ("rust", "type", r"^\s*pub\b", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?type\s+(\w+)"),
    ("rust", "variable", r"^\s*pub\b", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:const|static)\s+(?:mut\s+)?(\w+)\s*:"),
    ("go", "function", r"^func\s+[A-Z]", r"^func\s+(\w+)"),
    ("go", "method", r"^func\s*\([^)]*\)\s*[A-Z]", r"^func\s*\([^)]*\)\s*(\w+)"),
    ("go", "class", r"^type\s+[A-Z]", r"^type\s+(\w+)\s+struct\b"),
    ("go", "interface", r"^type\s+[A-Z]", r"^type\s+(\w+)\s+interface\b"),
    ("java", "class", r"\bpublic\b", r"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|enum|record)\s+(\w+)"),
    ("java", "interface", r"\bpublic\b", r"^\s*(?:(?:public|private|protected|static)\s+)*@?interface\s+(\w+)"),
    ("java", "method", r"\bpublic\b", r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+(?:<[^>]+>\s*)?(?:[\w<>\[\], .?]+\s+)?(\w+)\s*\([^)]*\)?\s*(?:throws\s+[\w, .]+)?[{;]?\s*$"),
    ("csharp", "class", r"\bpublic\b", r"^\s*(?:(?:public|private|protected|internal|static|sealed|abstract|partial)\s+)*(?:class|struct|enum|record)\s+(\w+)"),
    ("csharp", "interface", r"\bpublic\b", r"^\s*(?:(?:public|private|protected|internal|partial)\s+)*interface\s+(\w+)"),
    ("csharp", "method", r"\bpublic\b", r"^\s*(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed)\s+)+(?:[\w<>\[\], .?]+\s+)?(\w+)\s*\([^)]*\)?\s*(?:=>.*|\{.*)?;?\s*$"),
)
#: Words before a bracket that are no calls.
KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "function", "fn", "func", "match", "new", "typeof", "super", "await", "else", "in", "sizeof", "nameof", "using", "lock", "when", "import", "require", "constructor")
#: Relation and, by language, the pattern of the names that a class builds on.
PARENTS = (
    ("typescript", "INHERITS", r"\b(?:class|interface)\s+\w+(?:<[^>]*>)?\s+extends\s+([\w.]+(?:\s*,\s*[\w.]+)*)"),
    ("typescript", "IMPLEMENTS", r"\bimplements\s+([\w.]+(?:\s*,\s*[\w.]+)*)"),
    ("java", "INHERITS", r"\b(?:class|interface)\s+\w+(?:<[^>]*>)?\s+extends\s+([\w.]+(?:\s*,\s*[\w.]+)*)"),
    ("java", "IMPLEMENTS", r"\bimplements\s+([\w.]+(?:\s*,\s*[\w.]+)*)"),
    ("csharp", "INHERITS", r"\b(?:class|interface|struct|record)\s+\w+(?:<[^>]*>)?\s*:\s*([\w.]+(?:\s*,\s*[\w.]+)*)"),
)
_FAMILY = {"javascript": "typescript", "vue": "typescript", "svelte": "typescript"}
_TOKENS = r"""(?s:/\*.*?(?:\*/|\z))|//[^\n]*+|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|`[^`\\]*+(?:\\.[^`\\]*+)*+`"""
_QUOTED = r"""|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"""
NODE_COLUMNS = ("id", "name", "type", "lang", "path", "folder", "start_line", "end_line", "is_exported")


def blank(text: Column, single_quotes: bool = True) -> Column:
    """The text without comments and the insides of strings; line numbers stay.

    Rust's single quotes also begin lifetimes, so they are left alone there.
    """
    pattern = _TOKENS + (_QUOTED if single_quotes else r"|'(?:[^'\\\n]|\\.)'")
    hits, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    kept = F.transform(hits, lambda h: F.concat(F.when(F.startswith(h, F.lit("/")), "").otherwise("''"), F.regexp_replace(h, r"[^\n]", "")))
    return F.array_join(F.zip_with(between, F.concat(kept, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def lines(files: DataFrame) -> DataFrame:
    """(path, lang, line, code, depth, after) of files in brace languages; depth counts open braces before and after a line."""
    family = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in _FAMILY.items() for x in p]), "lang"), "lang")
    # Of single-file components only the script blocks are code; their lines count from the first block.
    own = F.when(F.col("lang").isin("vue", "svelte"), script(F.col("text"))).otherwise(F.coalesce("text", F.lit("")))
    source = files.select("path", family.alias("lang"), own.alias("text")).filter(F.col("lang").isin(*sorted({r[0] for r in RULES})))
    code = F.when(F.col("lang") == "rust", blank(F.col("text"), False)).otherwise(blank(F.col("text")))
    each = source.select("path", "lang", F.posexplode(F.split(code, "\n")).alias("_at", "code")).select("path", "lang", (F.col("_at") + 1).alias("line"), "code")
    of = lambda c: F.length("code") - F.length(F.replace("code", F.lit(c), F.lit("")))
    after = F.sum(of("{") - of("}")).over(W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    return each.withColumn("after", after.cast("int")).withColumn("depth", (F.col("after") - of("{") + of("}")).cast("int"))


def _found(each: DataFrame) -> DataFrame:
    """(path, lang, line, name, type, is_exported, depth, after): the first rule that a line meets gives its definition."""
    hits = [
        F.when((F.col("lang") == lang) & F.col("code").rlike(pattern), F.struct(F.regexp_extract("code", pattern, 1).alias("name"), F.lit(kind).alias("type"), F.col("code").rlike(shown).alias("is_exported") if shown else F.lit(True).alias("is_exported")))
        for lang, kind, shown, pattern in RULES
    ]
    one = each.withColumn("d", F.coalesce(*hits)).filter("d is not null and d.name != ''")
    return one.select("path", "lang", "line", "d.name", "d.type", "d.is_exported", "depth", "after")


def _ends(defs: DataFrame, each: DataFrame) -> DataFrame:
    """defs with end_line: the next line of the file that returns to the depth of the definition."""
    closing = each.filter((F.instr("code", "}") > 0)).select("path", F.col("after").alias("level"), F.col("line").alias("at"), F.col("line").alias("close"), F.lit(None).cast("string").alias("name"))
    begun = defs.select("path", F.col("depth").alias("level"), F.col("line").alias("at"), F.lit(None).cast("int").alias("close"), "name")
    nearest = F.min("close").over(W.partitionBy("path", "level").orderBy("at").rangeBetween(0, W.unboundedFollowing))
    ends = closing.unionByName(begun).withColumn("_end", nearest).filter("name is not null").select("path", F.col("at").alias("line"), "name", "_end")
    last = each.select("path", F.col("line").alias("_l"), F.col("code").alias("_c"))
    alone = F.col("depth") == F.col("after")
    joined = defs.join(ends, ["path", "line", "name"], "left")
    # A definition whose line opens no brace ends there, unless its brace stands on the next line.
    following = last.select("path", (F.col("_l") - 1).alias("line"), F.col("_c").rlike(r"^\s*\{").alias("_next"))
    joined = joined.join(following, ["path", "line"], "left")
    end = F.when(alone & ~F.coalesce("_next", F.lit(False)), F.col("line")).otherwise(F.coalesce("_end", "line"))
    return joined.withColumn("end_line", end.cast("int")).drop("_end", "_next")


def _python(path: str, text: str) -> Iterator[tuple]:
    """Definitions as ("def", name, type, line, end, public) and names used as ("CALLS" or "INHERITS", name, line, own)."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    open_nodes = [(tree, False)]
    while open_nodes:
        node, in_class = open_nodes.pop()
        for child in ast.iter_child_nodes(node):
            inside = isinstance(child, ast.ClassDef)
            if inside or isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "class" if inside else "method" if in_class else "function"
                yield path, "def", child.name, kind, child.lineno, child.end_lineno, not child.name.startswith("_"), False
                yield from ((path, "INHERITS", b.id, None, child.lineno, None, None, False) for b in getattr(child, "bases", ()) if isinstance(b, ast.Name))
            elif isinstance(child, ast.Call):
                f = child.func
                if isinstance(f, ast.Name):
                    yield path, "CALLS", f.id, None, child.lineno, None, None, False
                elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in ("self", "cls"):
                    yield path, "CALLS", f.attr, None, child.lineno, None, None, True
            open_nodes.append((child, inside))


def _python_rows(files: DataFrame) -> DataFrame:
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
    names = ["path", "what", "name", "type", "line", "end_line", "is_exported", "own"]

    def run(batches):
        for batch in batches:
            rows = [r for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in _python(p, t or "")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return files.filter("lang = 'python'").select("path", "text").mapInArrow(run, "path string, what string, name string, type string, line int, end_line int, is_exported boolean, own boolean")


def _used(each: DataFrame, defs: DataFrame) -> DataFrame:
    """(path, what, name, line, own) of the calls and parents on lines, the names that lines define apart."""
    call = r"(?<![\w.])((?:(?:this|self)\.)?[A-Za-z_]\w*)\s*(?:::<[^>]*>)?\("
    calls = each.select("path", "line", F.explode(F.regexp_extract_all("code", F.lit(call), F.lit(1))).alias("said"))
    bare = F.regexp_replace("said", r"^(?:this|self)\.", "")
    calls = calls.select("path", F.lit("CALLS").alias("what"), bare.alias("name"), "line", (bare != F.col("said")).alias("own")).filter(~F.col("name").isin(*KEYWORDS))
    calls = calls.join(defs.select("path", "line", "name"), ["path", "line", "name"], "left_anti").select("path", "what", "name", "line", "own")
    for lang, relation, pattern in PARENTS:
        named = each.filter((F.col("lang") == lang) & F.col("code").rlike(pattern)).select("path", "line", F.explode(F.split(F.regexp_extract("code", pattern, 1), r"\s*,\s*")).alias("name"))
        calls = calls.unionByName(named.select("path", F.lit(relation).alias("what"), F.element_at(F.split("name", r"\."), -1).alias("name"), "line", F.lit(False).alias("own")))
    rust = r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+(\w+)"
    made = each.filter((F.col("lang") == "rust") & F.col("code").rlike(rust)).select("path", F.regexp_extract("code", rust, 2).alias("on"), F.element_at(F.split(F.regexp_extract("code", rust, 1), "::"), -1).alias("name"))
    place = defs.filter("type in ('class', 'interface')").groupBy("path", F.col("name").alias("on")).agg(F.min("line").alias("line"))
    made = made.join(place, ["path", "on"]).select("path", F.lit("IMPLEMENTS").alias("what"), "name", "line", F.lit(False).alias("own"))
    return calls.unionByName(made)


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of files (path, text, lang).

    A name leads to its definition in the same file, else to a stub that resolve_stubs can match to other
    files; calls of own methods never leave the file.  What no definition surrounds has no edge.
    """
    each = written(lines(files), "lines")
    found = written(_found(each), "definitions")
    py = written(_python_rows(files), "python-names")
    braces = _ends(found, each).select("path", "lang", "name", "type", F.col("line").cast("int").alias("start_line"), "end_line", "is_exported")
    python = py.filter("what = 'def'").select("path", F.lit("python").alias("lang"), "name", "type", F.col("line").alias("start_line"), "end_line", "is_exported")
    every = braces.unionByName(python)
    first = every.groupBy("path", "name").agg(F.min(F.struct("start_line", "end_line", "type", "lang", "is_exported")).alias("d"))
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    nodes = first.select(F.concat("path", F.lit(":"), "name").alias("id"), "name", "d.type", "d.lang", "path", folder.alias("folder"), "d.start_line", "d.end_line", "d.is_exported")

    said = _used(each, found).unionByName(py.filter("what != 'def'").select("path", "what", "name", "line", "own"))
    around = every.select("path", F.col("name").alias("_in"), "start_line", "end_line")
    inside = said.join(around, "path").filter((F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("end_line")))
    owner = inside.groupBy("path", "what", "name", "line", "own").agg(F.max_by("_in", F.struct("start_line", F.negative("end_line"))).alias("_in"))
    known = nodes.select("path", "name", F.col("id").alias("_target"))
    joined = owner.join(known, ["path", "name"], "left").filter("_target is not null or not own")
    edges = joined.groupBy(
        F.concat("path", F.lit(":"), "_in").alias("source_id"), F.coalesce("_target", F.concat(F.lit(STUB), "name")).alias("target_id"), F.col("what").alias("type_relation")
    ).agg(F.min("line").cast("int").alias("source_line"))
    return nodes, edges


def function_complexity(files: DataFrame) -> DataFrame:
    """(path, name, complexity) of the exported functions in brace languages: the branches on their lines.

    The lines of one function, which the 5 MB limit of a file bounds, are added up.
    """
    each = written(lines(files), "lines")
    found = _ends(written(_found(each), "definitions"), each).filter("is_exported and type in ('function', 'method')")
    own = found.groupBy("path", "name").agg(F.min(F.struct("line", "end_line")).alias("d")).select("path", "name", F.col("d.line").alias("_from"), F.col("d.end_line").alias("_to"))
    inside = own.join(each.select("path", "line", "code"), "path").filter((F.col("_from") <= F.col("line")) & (F.col("line") <= F.col("_to")))
    return inside.groupBy("path", "name").agg(F.sum(complexity(F.col("code"))).cast("int").alias("complexity"))


def resolve_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with stubs replaced by the best definition of their name in the same language, where there is one."""
    from ..operators.relational import resolve_stubs

    source = nodes.select(F.col("id").alias("source_id"), F.col("path").alias("source_path"), "lang")
    stub = F.startswith("target_id", F.lit(STUB))
    named = edges.filter(stub).join(source, "source_id").withColumn("name", F.expr(f"substring(target_id, {len(STUB) + 1})"))
    with_time = nodes if "indexed_at" in nodes.columns else nodes.withColumn("indexed_at", F.lit(0).cast("long"))
    best = resolve_stubs(named.select("source_path", "lang", "name").distinct(), with_time)
    solved = named.join(best, ["source_path", "lang", "name"], "left").withColumn("target_id", F.coalesce("id", "target_id")).select(*edges.columns)
    both = edges.filter(~stub).unionByName(solved)
    return both.groupBy("source_id", "target_id", "type_relation").agg(F.min("source_line").alias("source_line"))
