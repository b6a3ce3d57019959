"""Changes found by folder digests against a comparison of all files, and how much was looked at."""

import random

from codeloom.sources import rollup

SCHEMA = "path string, mtime_ms long, size long"


def test_changes_are_found_by_looking_at_few(spark):
    dice = random.Random(10)
    then = {f"src/{a}/{b}/f{n}.ts": (n, n) for a in "abcdefgh" for b in "pqrstuvw" for n in range(6)} | {"top.ts": (1, 1), "/abs/x.ts": (2, 2)}
    now = dict(then)
    for path in dice.sample(sorted(then), 3):
        now[path] = (99, 1)
    del now["src/a/p/f0.ts"]
    now |= {"src/new/deep/er/f.ts": (1, 1), "top2.ts": (1, 1)}
    want = {p: "new" if p not in then else "gone" if p not in now else "changed" for p in {*now, *then} if now.get(p) != then.get(p)}
    tables = [spark.createDataFrame([(p, *v) for p, v in files.items()], SCHEMA) for files in (now, then)]
    found, looked = rollup.stale_below(*tables, rollup.rollup(tables[1]))
    assert {r.path: r.status for r in found.collect()} == want
    assert looked < len(then) / 2
    same, looked = rollup.stale_below(tables[1], tables[1])
    assert same.count() == 0 and looked == 1
    none = tables[0].limit(0)
    assert rollup.stale_below(none, none)[0].count() == 0
    assert rollup.stale_below(none, tables[1])[0].filter("status = 'gone'").count() == len(then)
