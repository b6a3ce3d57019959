"""From imported modules to files: candidates with ranks for every language, then the first that exists.

``imports`` has path, module, lang; ``files`` has path.  Every rule gives (path, module, candidate, rank);
the candidates of all languages meet the files in one equi-join.  Modules that begin with another package's
name give no row.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import collapsed

#: What may follow a module's path, in order.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".gql", ".graphql")
#: Added to the rank of files found by the last name alone.
LAST = 1 << 24
#: Packages that come with the language or are never part of a source tree.
JAVA = ("java", "javax", "sun", r"com\.sun", r"org\.w3c", r"org\.xml", r"org\.ietf", r"org\.omg", "jdk", "javafx")
CSHARP = ("System", "Microsoft", "Newtonsoft", "NUnit", "Xunit", "MSTest", "AutoMapper", "FluentValidation", "MediatR", "Serilog")
SCRIPTS = ("typescript", "javascript", "vue", "svelte", "graphql")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def _options(base: Column, endings: tuple[str, ...]) -> Column:
    return F.array(*[F.concat(base, F.lit(e)) for e in endings])


def _script(imports: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Relative modules, and modules below an alias: ``@app/*`` to a folder, or a whole name to a file or folder."""
    relative = F.when(F.startswith("module", F.lit(".")), collapsed(F.concat(parent(F.col("path")), F.lit("/"), "module"))).when(F.startswith("module", F.lit("/")), F.col("module"))
    base = relative
    for name, target in sorted(aliases.items(), key=lambda a: -len(a[0])):
        if name.endswith("*"):
            head, place = name[:-1], target.removesuffix("*").rstrip("/")
            hit, to = F.startswith("module", F.lit(head)), F.concat(F.lit(place + "/"), F.expr(f"substring(module, {len(head) + 1})"))
        else:
            hit, to = F.col("module") == name, F.lit(target)
        base = F.coalesce(base, F.when(hit, collapsed(to)))
    stem = F.regexp_replace(base, r"\.js$", "")
    endings = ("", *EXTENSIONS, *[f"/index{e}" for e in EXTENSIONS])
    options = F.concat(_options(base, endings), _options(stem, EXTENSIONS[:2]))
    return imports.filter(F.col("lang").isin(*SCRIPTS)).withColumn("c", options)


def _aliased(imports: DataFrame, scoped: DataFrame) -> DataFrame:
    """Modules that are, or begin with, an alias (scope, alias, target) whose scope the file is in: innermost scope first, then longest alias."""
    parts = F.split("module", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    tried = imports.filter(F.col("lang").isin(*SCRIPTS)).select("path", "module", F.explode(heads).alias("alias")).join(scoped, "alias").filter(F.startswith("path", F.concat(F.regexp_replace("scope", "/$", ""), F.lit("/"))))
    order = F.row_number().over(W.partitionBy("path", "module").orderBy(F.desc(F.length("scope")), F.desc(F.length("alias")), "target"))
    base = F.concat("target", F.col("module").substr(F.length("alias") + 1, F.length("module")))
    endings = ("", *EXTENSIONS, *[f"/src/index{e}" for e in EXTENSIONS], *[f"/index{e}" for e in EXTENSIONS])
    stem = F.regexp_replace("_base", r"\.js$", "")
    placed = tried.withColumn("_order", order).withColumn("_base", base).select("path", "module", "_order", F.posexplode(F.concat(_options(F.col("_base"), endings), _options(stem, EXTENSIONS[:2]))).alias("rank", "target_path"))
    return placed.select("path", "module", (1000 * F.col("_order") + F.col("rank")).alias("rank"), "target_path")


def _python(imports: DataFrame, roots: tuple[str, ...]) -> DataFrame:
    """Leading dots climb from the file's folder; other names start at its folder or at a root."""
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.concat(parent(F.col("path")), F.lit("/"), F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), rest)
    bases = F.when(dots > 0, F.array(collapsed(up))).otherwise(F.array(collapsed(F.concat(parent(F.col("path")), F.lit("/"), rest)), *[collapsed(F.concat(F.lit(r + "/"), rest)) for r in roots]))
    options = F.flatten(F.transform(bases, lambda b: _options(b, (".py", ".pyi", "/__init__.py"))))
    return imports.filter("lang = 'python'").withColumn("c", options)


def _rust(imports: DataFrame, roots: tuple[str, ...]) -> DataFrame:
    """``mod x`` beside the file or below its module's folder; use paths from crate, self or super, shortened by one name at a time."""
    name, folder = F.regexp_extract("path", r"([^/]+)\.rs$", 1), parent(F.col("path"))
    own = F.when(name.isin("mod", "lib", "main"), folder).otherwise(F.concat(folder, F.lit("/"), name))
    above = F.regexp_extract("module", r"^((?:super(?:::|$))*)", 1)
    climbed = collapsed(F.concat(own, F.regexp_replace(above, r"super(::|$)", "/..")))
    parts = F.filter(F.split("module", "::"), lambda p: p != "")
    below = F.filter(F.split(F.regexp_replace("module", r"^(?:super(?:::|$))+", ""), "::"), lambda p: p != "")
    first, rest = F.element_at(parts, 1), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    tails = lambda start, names: F.transform(F.sequence(F.size(names), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.concat(F.array(start), F.slice(names, F.lit(1), n)), "/"))
    ups = F.when(first == "crate", F.flatten(F.array(*[tails(F.lit(r), rest) for r in roots]) if roots else F.array().cast("array<array<string>>")))
    bases = ups.when(first == "self", tails(own, rest)).when(first == "super", tails(climbed, below)).when(F.size(parts) == 1, F.array(F.concat(own, F.lit("/"), first)))
    options = F.flatten(F.transform(bases, lambda b: _options(b, (".rs", "/mod.rs", "/lib.rs", "/main.rs"))))
    return imports.filter("lang = 'rust'").withColumn("c", options)


def _whole_name(imports: DataFrame, files: DataFrame, lang: str, extension: str, suffix: Column) -> DataFrame:
    """The files whose path ends in the module's: a join on every ending of the path."""
    parts = F.split(F.regexp_replace("path", r"\.\w+$", ""), "/")
    n = F.size(parts)
    endings = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "/"))
    known = files.filter(F.endswith("path", F.lit(extension))).select(F.col("path").alias("target_path"), F.explode(endings).alias("_end"))
    wanted = imports.filter(F.col("lang") == lang).withColumn("_end", suffix).filter("_end != ''")
    return wanted.join(known, "_end").select("path", "module", "target_path", F.length("target_path").alias("rank"))


def _last_name(imports: DataFrame, files: DataFrame, lang: str, extension: str, place: Column, own: tuple[str, ...]) -> DataFrame:
    """Where no file has the whole name: the shortest path whose ``place`` is the module's last name.

    Modules of the language's own packages are left out, as are wildcards.
    """
    some = files.filter(F.endswith("path", F.lit(extension))).select(F.col("path").alias("target_path"), F.regexp_extract(place, r"([^/]+)$", 1).alias("_last"), F.length(place).alias("_size"), place.alias("_place"))
    first = some.groupBy("_last").agg(F.min(F.struct("_size", "_place", "target_path")).alias("f"))
    wanted = imports.filter(F.col("lang") == lang).filter(F.col("module").rlike(r"^[^./]+(\.[^./]+)*\.[^./*]+$") & ~F.col("module").rlike(rf"^({'|'.join(own)})(\.|$)"))
    found = wanted.withColumn("_last", F.regexp_extract("module", r"([^.]+)$", 1)).join(first, "_last")
    return found.select("path", "module", F.col("f.target_path").alias("target_path"), (F.length("f.target_path") + LAST).alias("rank"))


def _folder_name(imports: DataFrame, files: DataFrame, lang: str, extension: str, folder: Column, skip: str | None = None) -> DataFrame:
    """The first file by name of the folder that an import names."""
    some = files.filter(F.endswith("path", F.lit(extension)))
    some = some if skip is None else some.filter(~F.endswith("path", F.lit(skip)))
    first = some.groupBy(parent(F.col("path")).alias("_folder")).agg(F.min("path").alias("target_path"))
    return imports.filter(F.col("lang") == lang).withColumn("_folder", folder).join(first, "_folder").select("path", "module", "target_path", F.lit(0).alias("rank"))


def resolve(imports: DataFrame, files: DataFrame, roots: tuple[str, ...] = (), aliases: Mapping[str, str] | None = None, go_modules: Mapping[str, str] | None = None, scoped: DataFrame | None = None) -> DataFrame:
    """(path, module, target_path) of the imports that lead to one of files.

    ``roots`` are source roots for Python and Rust, ``aliases`` path aliases of script languages, ``scoped`` those
    that hold in one folder (configs.alias_table), ``go_modules`` module prefixes with their folders.  Ties go to the shorter and then the smaller path.
    """
    files = files.select("path").distinct()
    imports = imports.select("path", "module", "lang").distinct()
    tried = reduce(DataFrame.unionByName, [d.select("path", "module", F.posexplode("c").alias("rank", "target_path")) for d in (_script(imports, aliases or {}), _python(imports, roots), _rust(imports, roots))])
    if scoped is not None:
        tried = tried.unionByName(_aliased(imports, scoped))
    found = tried.join(files.toDF("target_path"), "target_path").select("path", "module", "target_path", "rank")
    go = F.lit(None).cast("string")
    for prefix, folder in sorted((go_modules or {}).items(), key=lambda m: len(m[0])):
        inside = (F.col("module") == prefix) | F.startswith("module", F.lit(prefix + "/"))
        go = F.when(inside, F.concat(F.lit(folder.rstrip("/")), F.expr(f"substring(module, {len(prefix) + 1})"))).otherwise(go)
    found = found.unionByName(_folder_name(imports, files, "go", ".go", go, "_test.go"))
    named = F.replace("module", F.lit("."), F.lit("/"))
    found = found.unionByName(_whole_name(imports, files, "java", ".java", F.when(F.endswith("module", F.lit(".*")), "").otherwise(named)))
    found = found.unionByName(_whole_name(imports, files, "csharp", ".cs", named))
    found = found.unionByName(_last_name(imports, files, "java", ".java", F.regexp_replace("path", r"\.java$", ""), JAVA))
    found = found.unionByName(_last_name(imports, files, "csharp", ".cs", parent(F.col("path")), CSHARP))
    best = found.groupBy("path", "module").agg(F.min(F.struct("rank", "target_path")).alias("b"))
    return best.select("path", "module", "b.target_path")


def file_edges(imports: DataFrame, files: DataFrame, **options) -> DataFrame:
    """Edges between files (source_path, target_path, type, line, module), for imports (path, module, type, line, lang).

    A module that a file imports repeatedly gives one edge, by its first line.
    """
    target = resolve(imports, files, **options)
    first = imports.groupBy("path", "module").agg(F.min(F.struct("line", "type")).alias("i"))
    return first.join(target, ["path", "module"]).select(F.col("path").alias("source_path"), "target_path", "i.type", "i.line", "module")
