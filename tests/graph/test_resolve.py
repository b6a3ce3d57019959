from codeloom.sources import resolve
from codeloom.streaming import usage
from pyspark.sql import functions as F

PATHS = ["/w/a.ts", "/w/lib/b.ts", "/w/lib/index.ts", "/w/src/app/x.tsx", "/w/esm.ts", "/w/p/m.py", "/w/p/__init__.py", "/w/q.py", "/w/src/main.rs", "/w/src/net.rs", "/w/src/net/tcp.rs", "/w/src/io/mod.rs", "/g/pkg/a.go", "/g/pkg/a_test.go", "/g/pkg/b.go", "/j/com/x/Y.java", "/j/other/com/x/Y.java", "/c/App/Core.cs"]


def test_modules_by_language(spark):
    wanted = [
        ("/w/a.ts", "./lib/b", "typescript", "/w/lib/b.ts"), ("/w/a.ts", "./lib", "typescript", "/w/lib/index.ts"), ("/w/lib/b.ts", "../a", "typescript", "/w/a.ts"), ("/w/a.ts", "@app/x", "typescript", "/w/src/app/x.tsx"),
        ("/w/a.ts", "./esm.js", "typescript", "/w/esm.ts"), ("/w/a.ts", "react", "typescript", None), ("/w/a.ts", "./gone", "typescript", None), ("/w/p/m.py", "..q", "python", "/w/q.py"), ("/w/p/m.py", ".", "python", "/w/p/__init__.py"),
        ("/w/q.py", "p.m", "python", "/w/p/m.py"), ("/w/p/m.py", "q", "python", "/w/q.py"), ("/w/q.py", "os", "python", None), ("/w/src/main.rs", "net", "rust", "/w/src/net.rs"), ("/w/src/net.rs", "tcp", "rust", "/w/src/net/tcp.rs"),
        ("/w/src/net/tcp.rs", "crate::io::Read", "rust", "/w/src/io/mod.rs"), ("/w/src/net/tcp.rs", "super::super::x", "rust", "/w/src/main.rs"), ("/w/src/net/tcp.rs", "super::udp", "rust", "/w/src/net.rs"), ("/w/src/main.rs", "std::io", "rust", None), ("/g/m.go", "ex.com/g/pkg", "go", "/g/pkg/a.go"), ("/g/m.go", "fmt", "go", None),
        ("/j/Z.java", "com.x.Y", "java", "/j/com/x/Y.java"), ("/j/Z.java", "com.x.*", "java", None), ("/c/P.cs", "App.Core", "csharp", "/c/App/Core.cs"), ("/c/P.cs", "System", "csharp", None),
    ]
    imports = spark.createDataFrame([w[:3] for w in wanted], "path string, module string, lang string")
    files = spark.createDataFrame([(p,) for p in PATHS], "path string")
    options = {"roots": ("/w", "/w/src"), "aliases": {"@app/*": "/w/src/app/*"}, "go_modules": {"ex.com/g": "/g"}}
    got = {(r.path, r.module): r.target_path for r in resolve.resolve(imports, files, **options).collect()}
    assert got == {w[:2]: w[3] for w in wanted if w[3]}
    placed = imports.withColumns({"type": F.lit("import"), "line": F.lit(3)})
    edges = resolve.file_edges(placed.unionByName(placed.withColumn("line", F.lit(1))), files, **options).collect()
    assert len(edges) == len(got) and {e.line for e in edges} == {1}
    assert resolve.resolve(imports.limit(0), files, **options).count() == 0


def test_java_and_csharp_names_of_any_depth_and_the_last_name(spark):
    deep = [f"p{i}" for i in range(12)]
    paths = ["/r/" + "/".join(deep) + "/Deep.java", "/r/other/Deep.java", "/r/" + "/".join(deep) + "/Deep.cs", "/r/odd/Svc.java", "/r/odd/far/Svc.java", "/r/App/Services/B.cs", "/r/App/Services/A.cs", "/r/java/List.java"]
    wanted = [
        (".".join([*deep, "Deep"]), "java", paths[0]), (".".join([*deep, "Deep"]), "csharp", paths[2]), ("com.acme.Svc", "java", "/r/odd/Svc.java"), ("com.acme.*", "java", None), ("java.util.List", "java", None),
        ("My.App.Services", "csharp", "/r/App/Services/A.cs"), ("System.Services", "csharp", None), ("com.acme.Gone", "java", None),
    ]
    imports = spark.createDataFrame([(f"/r/{lang}", module, lang) for module, lang, _ in wanted], "path string, module string, lang string")
    got = {(r.path, r.module): r.target_path for r in resolve.resolve(imports, spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {(f"/r/{lang}", module): to for module, lang, to in wanted if to}


def test_usage_cache_stream(spark, tmp_path):
    at = lambda day, hour: f"2024-01-0{day} {hour:02d}:00:00"
    rows = [("a", "b", 1, None, at(1, 0)), ("a", "b", 1, True, at(1, 1)), ("a", "b", 1, None, at(1, 2)), ("a", "b", 2, None, at(1, 3)), ("a", "b", 2, None, at(1, 4)), ("c", "d", 7, False, at(1, 0)), ("c", "d", 7, None, at(1, 23)), ("c", "d", 7, None, at(2, 2))]
    df = spark.createDataFrame(rows, "source_path string, target_path string, mtime_ms long, used boolean, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = usage.cached(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("usage").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = [(r.source_path, r.used, r.outcome) for r in spark.table("usage").orderBy("source_path", "ts").collect()]
    assert got == [("a", None, "absent"), ("a", True, "stored"), ("a", True, "hit"), ("a", None, "changed"), ("a", None, "absent"), ("c", False, "stored"), ("c", False, "hit"), ("c", None, "expired")]
