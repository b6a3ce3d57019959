"""Imports of source files, by pattern for most languages and by the ast module for Python.

One row for each import: path, module, type, line (from 1).
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Language, kind, pattern with the module as its first group.
PATTERNS = (
    ("typescript", "import", r"""(?m)^[ \t]*import\s+(?!type\b)(?!\{\s*type\s+[\w$]+(?:\s+as\s+[\w$]+)?(?:\s*,\s*type\s+[\w$]+(?:\s+as\s+[\w$]+)?)*\s*,?\s*\}\s+from\b)(?:[\w*{}\s,$]+\s+from\s+)?["']([^"'\n]+)["']"""),
    ("typescript", "export", r"""(?m)^[ \t]*export\s+(?!type\b)(?!\{\s*type\s+[\w$]+(?:\s+as\s+[\w$]+)?(?:\s*,\s*type\s+[\w$]+(?:\s+as\s+[\w$]+)?)*\s*,?\s*\}\s+from\b)[\w*{}\s,$]+\s+from\s+["']([^"'\n]+)["']"""),
    ("typescript", "require", r"""\brequire\(\s*["']([^"'\n]+)["']\s*\)"""),
    ("typescript", "dynamic", r"""\bimport\(\s*["'`]([^"'`\n]+)["'`]\s*\)"""),
    ("graphql", "import", r"""(?m)^#\s*import\s+["']([^"'\n]+)["']"""),
    ("go", "import", r"""(?m)^[ \t]*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"[ \t]*$"""),
    ("java", "import", r"(?m)^[ \t]*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"),
    ("csharp", "import", r"(?m)^[ \t]*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;"),
    ("rust", "import", r"(?m)^[ \t]*(?:pub(?:\([a-z]+\))?\s+)?use\s+([\w:]+)"),
    ("rust", "module", r"(?m)^[ \t]*(?:pub(?:\([a-z]+\))?\s+)?mod\s+(\w+)\s*;"),
)
_SAME_AS = {"javascript": "typescript", "vue": "typescript", "svelte": "typescript"}
SCHEMA = "path string, module string, type string, line int"


def script(text: Column) -> Column:
    """The script blocks of a single-file component, joined by new lines."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"(?is)<script[^>]*>(.*?)</script\s*[^>]*>"), F.lit(1)), "\n")


def _lines(text: Column, pattern: str) -> Column:
    """(module, line) of all matches: the texts between matches and the matches alternate."""
    hits, names = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    feeds = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    between = F.transform(F.slice(F.split(text, pattern), F.lit(1), F.size(hits)), feeds)
    inner = F.transform(hits, feeds)
    before = lambda i: F.aggregate(F.slice(between, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice(inner, F.lit(1), i), F.lit(0), lambda a, x: a + x)
    lead = F.transform(hits, lambda h: feeds(F.regexp_extract(h, r"^(\s*)", 1)))
    return F.transform(names, lambda m, i: F.struct(m.alias("module"), (before(i) + F.element_at(lead, i + 1) + 1).cast("int").alias("line")))


def by_pattern(files: DataFrame) -> DataFrame:
    """Imports of files (path, text, lang) other than Python, all in column expressions."""
    family = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in _SAME_AS.items() for x in p]), "lang"), "lang")
    text = F.when(F.col("lang").isin("vue", "svelte"), script(F.col("text"))).otherwise(F.coalesce("text", F.lit("")))
    source = files.select("path", family.alias("family"), text.alias("text"))
    parts = [source.filter(F.col("family") == lang).select("path", F.lit(kind).alias("type"), F.explode(_lines(F.col("text"), pattern)).alias("m")) for lang, kind, pattern in PATTERNS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("path", "m.module", "type", "m.line")


def _python(text: str) -> Iterator[tuple[str, str, int]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            yield from ((a.name, "import", node.lineno) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield "." * node.level + (node.module or ""), "import", node.lineno


def python_imports(files: DataFrame) -> DataFrame:
    """Imports of Python files (path, text); a file that doesn't parse has none."""

    def run(batches):
        for batch in batches:
            rows = [(p, *found) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for found in _python(t or "")]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)], ["path", "module", "type", "line"])

    return files.select("path", "text").mapInArrow(run, SCHEMA)


def imports(files: DataFrame) -> DataFrame:
    """Imports of files in any known language."""
    return by_pattern(files).unionByName(python_imports(files.filter("lang = 'python'")))
