"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations alone.

The j-th block of a source with target weight w may not start before slot floor((j - 1) / w), its release, and must be
placed before slot ceil(j / w), its deadline.  Earliest deadline first over the released blocks keeps each source
within less than one block of w times the slots so far, at every slot.  Weights are whole units of 2 ** -40 of their sum,
and windows are exact integer arithmetic on them; nothing is rounded to a period.

Segments.  The line of slots is cut at every ``Q``-th one, and the segments are scheduled independently of each other, each by
a fold over its slots.  That needs to be known for each cut: how many blocks of every source lie before it.  A source has floor
or ceil of its exact share there; who gets the ceil is chosen among the blocks whose windows cross the cut, in the order of
deadlines, as long as the slots before the cut can still hold the chosen ones together with all blocks due by
then (for every m, the blocks released in the last m slots are at most m, and all blocks are as many as slots).  Both the blocks before and those after
the cut then fit their windows, so a schedule within them exists and earliest deadline first finds it.  Nothing runs from
segment to segment, so the schedule is made in parallel however long it is.  Q is a power of two, at
least ``PERIOD``, of more than two windows of the lightest source that has ``LIGHT`` of the whole or more.

Lighter sources.  A single one takes part with windows cut to their last Q slots.  Several are pooled, at most ``POOL``
to a pool; the pool is a source of their joint weight, and its blocks are dealt to them by the same method.  A pooled source is
within less than one block plus its share of the pool of its target.  Pools keep folds short, as a step costs all sources in it.

Blocks are ``block_docs`` documents that follow each other in a pseudo-random order within their source.
That order comes from hashes of whole rows: a source's rows are counted in equal ranges of the hash, and only rows of one
range are ever ranked together, so a source that holds most of the corpus is spread like any other.  The slots of a range's
blocks come to it as one array, by the same key as its rows, so texts are moved once.

Defined results: every row is kept.  A null source is a source of its own, named by null.  Sources beyond
their last block leave their slots empty, so slots stay true to the weights as long as a source lasts;
``slot`` and ``in_block`` order the mixture.  Weights of null, zero or less, and sources without a weight, count as the
smallest weight that is given, those below a unit as one unit.  Repeated rows are rows of their own; texts of any length only
travel.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fields, materialise, packed, without

PERIOD = 1024
BLOCK_DOCS = 4
HASH_BITS = 12
#: Units of all weights together, as a power of two; the least share that is no light source; members of a pool.
UNIT_BITS, LIGHT, POOL = 40, 1 / 512, 128
ADDED = ("mix_weight", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_in_block")


def tempered_weights(docs: DataFrame, power: float = 0.5, source_col: str = "source") -> DataFrame:
    """(source, weight) with weights proportional to a power of the number of rows."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight"))


def units(weights: DataFrame) -> DataFrame:
    """weights with ``units``, whole numbers in proportion to the column weight."""
    every = W.partitionBy(F.lit(1))
    given = F.when(F.col("weight") > 0, F.col("weight").cast("double"))
    clean = weights.withColumn("_clean", F.coalesce(given, F.min(given).over(every), F.lit(1.0)))
    share = F.col("_clean") / F.sum("_clean").over(every)
    return clean.withColumn("units", F.greatest(F.round(share * (1 << UNIT_BITS)), F.lit(1.0)).cast("long")).drop("_clean")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _wide(a: Column) -> Column:
    return a.cast("decimal(19,0)")


def release(j: Column, units: Column, total: Column) -> Column:
    """The first slot in which block j may be placed."""
    return _div(_wide(j - 1) * _wide(total), _wide(units))


def deadline(j: Column, units: Column, total: Column) -> Column:
    """The slot before which block j must be placed."""
    return _div(_wide(j) * _wide(total) + _wide(units) - 1, _wide(units))


def _cut(sources: Column, at: Column, total: Column) -> Column:
    """For every source its share up to the slot ``at`` in whole blocks and the rest in units."""

    def share(s: Column) -> Column:
        done = _div(_wide(s["units"]) * _wide(at), _wide(total))
        return F.transform(F.array(done), lambda b: F.struct(s["i"].alias("i"), s["units"].alias("units"), s["blocks"].alias("blocks"), b.alias("whole"), (_wide(s["units"]) * _wide(at) - _wide(b) * _wide(total)).cast("long").alias("rest")))[0]

    return F.transform(sources, share)


def _before_cuts(cuts: DataFrame, length: int) -> DataFrame:
    """cuts (k, total, state) with ``before``, the blocks of every source before the cut."""
    # Blocks whose windows cross the cut: slots back to the release and ahead to the deadline.
    ahead = lambda s: _div(F.col("total") - s["rest"] + s["units"] - 1, s["units"])
    back = lambda s: F.least(_div(s["rest"] + s["units"] - 1, s["units"]), length - ahead(s))
    crossing = F.filter(F.transform("state", lambda s: F.struct(F.when(s["rest"] > 0, ahead(s)).alias("ahead"), s["i"].alias("i"), back(s).alias("back"))), lambda c: c["ahead"].isNotNull() & (c["back"] > 0))
    cuts = cuts.withColumn("crossing", F.array_sort(crossing))
    most = F.coalesce(F.array_max(F.transform("crossing", lambda c: c["back"])), F.lit(0).cast("long"))
    due = lambda m: F.aggregate("state", F.lit(0).cast("long"), lambda a, s: a + F.when(s["units"] * m >= s["rest"], _div(s["units"] * m - s["rest"], F.col("total"))).otherwise(0))
    # All slots before the cut together have room for the sum of the rests.
    rests = _div(F.aggregate("state", F.lit(0).cast("decimal(38,0)"), lambda a, s: (a + s["rest"]).cast("decimal(38,0)")), _wide(F.col("total")))
    room = F.when(most > 0, F.concat(F.transform(F.sequence(F.lit(1).cast("long"), most), lambda m: m - due(m)), F.array(rests))).otherwise(F.array().cast("array<long>"))
    cuts = cuts.withColumn("room", room)

    def choose(state: Column, c: Column) -> Column:
        taken = F.struct(F.transform(state["room"], lambda x, m: F.when(m + 1 >= c["back"], x - 1).otherwise(x)).alias("room"), F.concat(state["chosen"], F.array(c["i"])).alias("chosen"))
        return F.when(F.array_min(F.slice(state["room"], c["back"].cast("int"), F.size(state["room"]))) >= 1, taken).otherwise(state)

    start = F.struct("room", F.array().cast("array<int>").alias("chosen"))
    cuts = cuts.withColumn("chosen", F.aggregate("crossing", start, choose, lambda s: s["chosen"]))
    return cuts.withColumn("before", F.transform("state", lambda s: s["whole"] + F.array_contains(F.col("chosen"), s["i"]).cast("long"))).select("k", "total", "state", "before")


def _segments(sources: DataFrame) -> DataFrame:
    """(_name, block, slot) of every block of sources (_name, units, blocks), one row a source."""
    n, total, lightest, span = sources.agg(F.count("*"), F.sum("units"), F.min(F.when(F.col("units") >= LIGHT * F.lit(1 << UNIT_BITS), F.col("units"))), F.max(F.col("blocks") / F.col("units"))).first()
    length = 1 << math.ceil(math.log2(max(PERIOD, 2 * total / lightest + 4 if lightest else 0)))
    cuts = sources.sparkSession.range(0, math.ceil(span * total / length) + 2).withColumnRenamed("id", "k")
    named = sources.agg(F.array_sort(F.collect_list(F.struct("_name", "units", "blocks"))).alias("s"), F.sum("units").alias("total"))
    named = named.select("total", F.transform("s", lambda s, i: F.struct(i.alias("i"), s["_name"].alias("name"), s["units"].alias("units"), s["blocks"].alias("blocks"))).alias("s"))
    # One row meets all cuts.
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = cuts.repartition(tasks).join(F.broadcast(named), F.lit(True)).select("k", "total", _cut(F.col("s"), F.col("k") * length, F.col("total")).alias("state"))
    placed = materialise(_before_cuts(state, length), "mixture-cuts")
    after = placed.select((F.col("k") - 1).alias("k"), F.col("before").alias("after"))
    segments = placed.join(after, "k")

    def window(j: Column, s: Column) -> Column:
        begin = (j - 1 - s["whole"]) * F.col("total") - s["rest"]
        return F.struct(s["i"].alias("i"), s["units"].alias("units"), s["whole"].alias("whole"), s["rest"].alias("rest"), s["last"].alias("last"), j.alias("j"), F.when(begin > 0, _div(begin, s["units"])).otherwise(0).alias("release"), F.least(_div(begin + F.col("total") + s["units"] - 1, s["units"]), F.lit(length)).alias("deadline"))

    live = F.transform(F.arrays_zip("state", "before", "after"), lambda z: F.struct(z["state"]["i"].alias("i"), z["state"]["units"].alias("units"), z["state"]["whole"].alias("whole"), z["state"]["rest"].alias("rest"), F.least(z["after"], z["state"]["blocks"]).alias("last"), z["before"].alias("before")))
    segments = segments.select("k", "total", F.filter(live, lambda s: s["before"] < s["last"]).alias("live")).filter(F.size("live") > 0)
    start = F.struct(F.transform("live", lambda s: window(s["before"] + 1, s)).alias("next"), F.array().cast("array<struct<i:int,j:bigint>>").alias("chosen"))

    def step(state: Column, slot: Column) -> Column:
        bids = F.transform(state["next"], lambda s: F.when((s["release"] <= slot) & (s["j"] <= s["last"]), F.struct(s["deadline"], s["i"], s["j"])))

        # The array of one element makes the choice a variable, which is not searched again for every source.
        def place(best: Column) -> Column:
            moved = F.transform(state["next"], lambda s: F.when(s["i"] == best["i"], window(s["j"] + 1, s)).otherwise(s))
            return F.struct(moved.alias("next"), F.concat(state["chosen"], F.array(F.struct(best["i"].alias("i"), best["j"].alias("j")))).alias("chosen"))

        return F.transform(F.array(F.array_min(bids)), place)[0]

    slots = F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))
    chosen = segments.repartition(tasks).select("k", F.posexplode(F.aggregate(slots, start, step, lambda s: s["chosen"])).alias("slot", "c")).filter("c.i is not null")
    names = named.select(F.explode("s").alias("s")).select("s.i", F.col("s.name").alias("_name"))
    return chosen.select(F.col("c.i").alias("i"), F.col("c.j").alias("block"), (F.col("k") * length + F.col("slot")).alias("slot")).join(F.broadcast(names) if n <= 100_000 else names, "i").select("_name", "block", "slot")


def schedule(sources: DataFrame) -> DataFrame:
    """(_name, block, slot) of all blocks of sources (_name, units, blocks); blocks count from 1, slots from 0."""
    total = F.sum("units").over(W.partitionBy(F.lit(1)))
    light = (F.col("units") < LIGHT * total).alias("_light")
    known = materialise(sources.select("_name", "units", "blocks", light), "sources")
    if known.filter("_light").limit(2).count() < 2:
        return materialise(_segments(known), "schedule")
    rank = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.col("units").desc(), "_name"))
    pooled = known.filter("_light").select("_name", "units", "blocks", F.concat(F.lit("pool"), F.floor((rank - 1) / POOL)).alias("_pool"))
    pools = [r["_pool"] for r in pooled.select("_pool").distinct().collect()]
    inner = None
    for pool in pools:
        part = schedule(pooled.filter(F.col("_pool") == pool).drop("_pool")).select("_name", "block", F.lit(pool).alias("_pool"), F.col("slot").alias("_at"))
        inner = part if inner is None else inner.unionByName(part)
    held = inner.groupBy("_pool").agg((F.max("_at") + 1).alias("blocks"))
    whole = pooled.groupBy("_pool").agg(F.sum("units").alias("units")).join(held, "_pool").select(F.col("_pool").alias("_name"), "units", "blocks")
    outer = schedule(known.filter("not _light").select("_name", "units", "blocks").unionByName(whole))
    mine = outer.join(whole.select("_name"), "_name", "left_semi").select(F.col("_name").alias("_pool"), (F.col("block") - 1).alias("_at"), "slot")
    return materialise(outer.join(whole.select("_name"), "_name", "left_anti").unionByName(inner.join(mine, ["_pool", "_at"]).select("_name", "block", "slot")), "schedule")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, block_docs: int = BLOCK_DOCS, source_col: str = "source", hash_bits: int = HASH_BITS) -> DataFrame:
    """docs with its place in the mixture, in the columns ADDED.

    ``weights`` has (source, weight); without it the square roots of the sources' row counts are used.
    """
    docs = without(docs, *ADDED)
    source = F.col(f"`{source_col}`")
    # A name that is never null, by which rows are windowed and joined alike.
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    present = docs.groupBy(name(source).alias("_name")).agg(F.count("*").alias("_rows"))
    given = weights.select("source", "weight") if weights is not None else tempered_weights(docs.select(source.alias("source")))
    given = given.groupBy(name(F.col("source")).alias("_name")).agg(F.max("weight").alias("weight"))
    wanted = units(present.join(given, "_name", "left")).select("_name", "units", F.ceil(F.col("_rows") / block_docs).alias("blocks"))
    wanted = materialise(wanted, "source-weights")
    total = wanted.agg(F.sum("units")).first()[0]
    if total is None:
        plan = docs.sparkSession.createDataFrame([], "_name string, block long, slot long")
    else:
        plan = schedule(wanted)

    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind] or [F.lit(0)]
    rows = packed(docs, name(source).alias("_name"), F.xxhash64(*hashed).alias("_h"), F.xxhash64(F.lit(1), *hashed).alias("_h2"))
    rows = rows.withColumn("_range", F.shiftright("_h", 64 - hash_bits).cast("int"))
    counts = rows.groupBy("_name", "_range").agg(F.count("*").alias("_c"))
    sofar = F.sum("_c").over(W.partitionBy("_name").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    before = counts.withColumn("_before", F.coalesce(sofar, F.lit(0)))
    first, last = F.floor(F.col("_before") / block_docs), F.floor((F.col("_before") + F.col("_c") - 1) / block_docs)
    needed = before.select("_name", "_range", "_before", F.explode(F.sequence(first + 1, last + 1)).alias("block"))
    slots = needed.join(plan, ["_name", "block"]).groupBy("_name", "_range").agg(F.first("_before").alias("_before"), F.array_sort(F.collect_list(F.struct("block", "slot"))).alias("_slots"))
    slots = slots.join(F.broadcast(wanted.select("_name", "units")) if wanted.count() <= 100_000 else wanted.select("_name", "units"), "_name")
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy("_name", "_range").orderBy("_h", "_h2")))
    index = F.col("_before") + F.col("_rank") - 1
    placed = ranked.join(slots, ["_name", "_range"]).select("_row", "units", "_slots", F.floor(index / block_docs).alias("_block"), (index % block_docs).cast("int").alias("_in_block"))
    j, all_units = F.col("_block") + 1, F.lit(total).cast("long")
    here = F.element_at("_slots", (j - F.col("_slots")[0]["block"] + 1).cast("int"))
    return placed.select(
        *fields(docs),
        (F.col("units") / all_units).alias("mix_weight"),
        j.alias("mix_block"),
        release(j, F.col("units"), all_units).alias("mix_release"),
        deadline(j, F.col("units"), all_units).alias("mix_deadline"),
        here["slot"].alias("mix_slot"),
        F.col("_in_block").alias("mix_in_block"),
    )
