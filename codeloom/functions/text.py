"""Column expressions for paths, identifiers and sizes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extension to language.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "rs": "rust", "vue": "vue", "svelte": "svelte", "gql": "graphql", "graphql": "graphql", "cs": "csharp", "csproj": "csharp", "go": "go", "java": "java",
}
#: Directories that are not scanned.
IGNORED_DIRS = ("node_modules", ".git", "dist", "build", "out", "coverage", ".next", ".nuxt", "__pycache__", ".venv", "venv", "target")
#: Manifests that are listed beside source files.
MANIFESTS = ("toml",)


def normalize_path(path: Column) -> Column:
    """Forward slashes, none doubled or last, drive letter in lower case."""
    slashed = F.regexp_replace(path, r"[\\/]+", "/")
    lower = F.when(slashed.rlike("^[A-Z]:"), F.concat(F.lower(F.substring(slashed, 1, 1)), slashed.substr(F.lit(2), F.length(slashed)))).otherwise(slashed)
    return F.when(F.length(lower) > 1, F.regexp_replace(lower, "/$", "")).otherwise(lower)


def relative_path(path: Column, root: str) -> Column:
    """The path below root; a path outside is unchanged."""
    inside = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(inside)), path.substr(F.lit(len(inside) + 1), F.length(path))).otherwise(path)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def call_graph_language(path: Column) -> Column:
    """The language whose rules make the call graph of a file; null where there are none."""
    lang = language(path)
    return F.when(lang.isin("vue", "svelte"), "typescript").when(~lang.isin("graphql", "unknown"), lang)


def parser_language(path: Column) -> Column:
    """The parser that a file goes to; manifests go to Rust's, the module forms .mts and .cts to none."""
    ext, lang = extension(path), language(path)
    script = lang.isin("typescript", "javascript", "vue", "svelte", "graphql") & ~ext.isin("mts", "cts")
    return F.when(script, "typescript").when(ext.isin(*MANIFESTS), "rust").when(lang.isin("python", "rust", "csharp", "go", "java"), lang).otherwise("unknown")


def is_ignored(path: Column) -> Column:
    """Whether a folder of the path is on the ignored list or hidden."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(folders, lambda d: d.isin(*IGNORED_DIRS) | (d.startswith(".") & (F.length(d) > 1)))


def identifier_tokens(name: Column) -> Column:
    """Lower-cased words of an identifier, of more than one character."""
    spaced = F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[_\-./ ]+", " ")), " "), lambda t: F.length(t) > 1)


def shared_leading_dirs(a: Column, b: Column) -> Column:
    """How many leading folders two paths have in common."""
    x, y = F.split(a, "/"), F.split(b, "/")
    n = F.least(F.size(x), F.size(y)) - 1
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.element_at(x, i) != F.element_at(y, i))
    return F.when(n < 1, 0).otherwise(F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, n)).cast("int")


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def risk(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 50, "high").when(score >= 20, "medium").otherwise("low")


def review_score(breaking: Column, dependents: Column, cyclic: Column, unused: Column, no_test: Column, partial: Column) -> Column:
    flags = reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0) for c, w in ((cyclic, 20), (unused, 10), (no_test, 10), (partial, 10))])
    return F.least(F.lit(100), 50 * breaking + 5 * dependents + flags).cast("int")


def is_external(path: Column) -> Column:
    """Whether an import target is a package and no file: no source extension, no path, unless below node_modules."""
    known = path.rlike(rf"\.({'|'.join(e for e in (*LANGUAGES, *MANIFESTS) if e not in ('mts', 'cts'))})$")
    local = path.rlike(r"^(\.|/|[A-Za-z]:)")
    inside = path.rlike(r"[/\\]") & ~F.contains(path, F.lit("node_modules"))
    return F.coalesce((path != "") & ~known & ~local & ~inside, F.lit(False))


#: Beginnings and ends of relative paths that documentation leaves out unless told otherwise.
EXCLUDED_BEGINNINGS = ("tests/", "test/", "__tests__/", "dist/", "out/", "build/", "node_modules/", ".git/", ".claude/", ".github/", "graphify-out/")
EXCLUDED_ENDS = (".test.ts", ".spec.ts", ".test.js", ".spec.js", ".test.tsx", ".spec.tsx", ".d.ts", ".min.js")


def _meets(relative: Column, pattern: str) -> Column:
    """A folder with its slash is a beginning, ``**/x`` an end or a part after a slash, anything else is contained."""
    plain = re.sub(r"/\*\*$", "/", pattern).replace("**/", "").replace("*", "")
    if pattern.endswith(("/**", "/")):
        return F.startswith(relative, F.lit(plain))
    if pattern.startswith("**/"):
        return F.endswith(relative, F.lit(pattern[3:])) | F.contains(relative, F.lit("/" + pattern[3:]))
    return F.contains(relative, F.lit(plain))


def in_scope(relative: Column, scope: str | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a relative path is below ``scope`` and not excluded; without ``exclude`` the usual parts are left out."""
    inside = F.lit(True)
    if scope:
        folder = scope.replace("\\", "/").rstrip("/")
        inside = F.startswith(relative, F.lit(folder + "/")) | (relative == folder)
    if exclude is None:
        out = [F.startswith(relative, F.lit(b)) for b in EXCLUDED_BEGINNINGS] + [F.endswith(relative, F.lit(e)) for e in EXCLUDED_ENDS]
    else:
        out = [_meets(relative, p) for p in exclude]
    return inside & ~reduce(Column.__or__, out, F.lit(False))


def split_symbol_id(symbol: Column) -> Column:
    """(file_path, symbol_name) of an id at its last colon; null where either side of it is missing."""
    name = F.substring_index(symbol, ":", -1)
    path = symbol.substr(F.lit(1), F.length(symbol) - F.length(name) - 1)
    return F.when(F.contains(symbol, F.lit(":")) & (name != ""), F.struct(path.alias("file_path"), name.alias("symbol_name")))


def file_of(path_or_id: Column) -> Column:
    """The file of a symbol id, which is cut at the last colon behind a source extension; a path stays as it is."""
    cut = F.regexp_extract(path_or_id, r"(?i)^(.+\.(?:ts|tsx|js|jsx|mjs|cjs|py|pyi|rs|vue|svelte|gql|graphql)):.+$", 1)
    return F.when(cut != "", cut).otherwise(path_or_id)


def symbol_ref(ref: Column, root: str) -> Column:
    """(file_path, symbol_name) of ``file#Symbol``, below root; null for empty parts and for files outside of root."""
    at = F.instr(ref, "#")
    raw = F.when(at > 0, ref.substr(F.lit(1), at - 1)).otherwise(ref)
    name = F.when(at > 0, ref.substr(at + 1, F.length(ref)))
    full = collapsed(F.when(F.startswith(raw, F.lit("/")), raw).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), raw)))
    inside = F.startswith(full, F.lit(root.rstrip("/") + "/")) | (full == root.rstrip("/"))
    good = (F.trim(raw) != "") & (name.isNull() | (F.trim(name) != "")) & inside
    return F.when(good, F.struct(full.alias("file_path"), name.alias("symbol_name")))


def collapsed(path: Column) -> Column:
    """The path without ``.`` and with ``..`` taken back."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def lsp_kind(kind: Column) -> Column:
    """The number of a kind of symbol in the language server protocol; 13, a variable, for any other."""
    #: Fixed values.
    numbers = {"function": 12, "method": 12, "class": 5, "variable": 13, "property": 13, "interface": 11}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in numbers.items() for x in p]), F.lower(kind)), F.lit(13))


def kind_of_lsp(number: Column) -> Column:
    """function, class or variable for a kind's number."""
    #: Fixed values.
    return F.when(number.isin(12, 6, 9), "function").when(number.isin(5, 11, 10, 2), "class").otherwise("variable")


#: Fixed values, in order: what the name of a callback's container holds, and how the callback is called then.
CALLBACKS = (
    ("map", "map callback"), ("filter", "filter predicate"), ("reduce", "reduce callback"), ("foreach", "forEach callback"), ("find", "find predicate"), ("some", "predicate callback"), ("every", "predicate callback"), ("sort", "sort comparator"),
    ("onclick", "onClick handler"), ("onsubmit", "onSubmit handler"), ("onchange", "onChange handler"), ("onload", "onLoad handler"), ("on[a-z]+", None),
    ("then", "then callback"), ("catch", "catch handler"), ("finally", "finally callback"), ("settimeout", "setTimeout callback"), ("setinterval", "setInterval callback"), ("requestanimationframe", "animation frame callback"),
    ("callback", "callback function"), ("handler", "handler function"),
)


def callback_name(name: Column, container: Column) -> Column:
    """What to call an anonymous function by the name around it; null if it has a name, or none of CALLBACKS is met."""
    around = F.lower(F.coalesce(container, F.lit("")))
    options = [F.when(around.rlike(part), F.concat(around, F.lit(" handler")) if said is None else F.lit(said)) for part, said in CALLBACKS]
    return F.when(F.lower(name).rlike("anonymous|arrow|<function>"), F.coalesce(*options))


def storage_key(root: Column) -> Column:
    """Twelve hex digits that name the storage of a workspace."""
    return F.substring(F.sha2(root.cast("binary"), 256), 1, 12)


def complexity(code: Column) -> Column:
    """Branches of code without comments and strings: if, else, case, default, for, while, catch, finally and ``?``.

    ``do`` counts by its ``while``; optional marks, ``?.`` and ``??`` are no branches.
    """
    branch = r"\b(?:if|else|for|while|catch|finally)\b|\bcase\b|\bdefault\s*:|(?<![?])\?(?![.?:,);=\]])"
    return F.size(F.regexp_extract_all(code, F.lit(branch), F.lit(0)))
