"""The trie of conversation prefixes: which turns conversations share, and what storing them once saves.

A node is a different sequence of the first d turns of some conversation.  It is named by its *owner*, the smallest
id of the conversations that start with it, and its depth d.

* Prefix digests.  Every turn is hashed with its place; the digest of a prefix is the exclusive or of its turns' hashes, 128
  bits, so digests are running aggregates.  The minimum of the ids under each digest is the owner of the node.
* First owned depth.  The owner of a node owns every node below it on its own conversation, so the depths that a
  conversation owns are an end piece of it.  Where the piece begins is found by binary search: each round asks, for all
  conversations that are still open in one batch, who owns their prefix of the middle depth.
* Chains.  What a conversation owns is a chain of nodes, hung on the node one turn above its first.  Chains form the
  tree.  Savings and leaves of a chain are its own and those of all chains below; they are summed bottom-up in
  rounds that double the distance, so a tree of chains of height k takes log k rounds.  Sums within a chain are
  running ones, from its end.

Nothing is gathered by conversation: running aggregates go by blocks of ``BLOCK`` turns and then over the blocks, and turns are
numbered by a range sort, so that one conversation may hold most turns.  A hot prefix meets its digest's minimum in
``join_by_key``.  The ids that end at one node are hashed in pieces of ``PIECE`` ids that stream through a worker.

Defined results: turns are ordered by turn number, null first, then by role and text; a null role or text is
empty; rows that repeat are turns of their own; rows without a conversation id belong to none and are passed over; other
columns play no part; an empty table gives an empty result, any conversation at all a root.  A turn's hash is made
where it is read, so a very long text costs one pass and is not moved again after the sort.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_by_key, materialise, small

BLOCK, PIECE_BITS = 1024, 12
#: Conversations share the first turns of the first of so many, at most HEADS - 1 of them.
GROUP, HEADS = 5, 9
_NONE = hashlib.sha256(b"").hexdigest()


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def number_turns(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, place, bytes, h1, h2): turns numbered from 1 within their conversation, with two hashes of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), role.alias("_role"), text.alias("_text"))
    order = ["conv_id", F.col("_turn").asc_nulls_first(), "_role", "_text"]
    ranged = turns.repartitionByRange(_tasks(turns), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    rows = ranged.select("conv_id", F.shiftright(at, 33).alias("_part"), at.alias("_at"), F.octet_length("_text").cast("long").alias("bytes"), F.xxhash64("_role", "_text").alias("h1"), F.xxhash64(F.lit(1), "_role", "_text").alias("h2"))
    rows = materialise(rows, "sorted-turns")
    # Of a conversation a part holds a run of rows, so a row's place is that in the run after the runs of earlier parts.
    runs = rows.groupBy("conv_id", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("conv_id", "_part", (before - F.col("_first") + 1).alias("_shift"))
    placed = rows.join(runs, ["conv_id", "_part"]).select("conv_id", (F.col("_at") + F.col("_shift")).alias("place"), "bytes", "h1", "h2")
    return materialise(placed, "numbered-turns")


def _shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its group."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns and (conv_id, length) of conversations that start with turns of the first one of their group.

    Conversation c takes its first h turns from conversation c - c % GROUP, and then has its own turns after its first h.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    base = own.select(F.col("conv_id").alias("_base"), F.least("own", F.lit(HEADS - 1).cast("long")).alias("_held"))
    convs = own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("_h", _shared_turns(F.col("conv_id"))).join(base, "_base", "left")
    head = F.least("_h", F.coalesce("_held", F.lit(0).cast("long")))
    convs = convs.select("conv_id", "own", "_base", "_h", head.alias("_head"), (head + F.greatest(F.col("own") - F.col("_h"), F.lit(0).cast("long"))).alias("length"))
    convs = materialise(convs, "conversations")
    taken = turns.filter(F.col("place") < HEADS).withColumnRenamed("conv_id", "_base").join(convs.select("conv_id", "_base", "_h"), "_base").filter("place <= _h")
    rest = turns.filter(F.col("place") > _shared_turns(F.col("conv_id")))
    rest = join_by_key(rest, convs.select("conv_id", "_h", "_head"), ["conv_id"], copies=convs.select("conv_id", F.col("own").alias("n")), row_bytes=24)
    columns = ["conv_id", "place", "bytes", "h1", "h2"]
    rest = rest.withColumn("place", F.col("_head") + F.col("place") - F.col("_h"))
    return taken.select(*columns).unionByName(rest.select(*columns)), convs.select("conv_id", "length")


def _running(rows: DataFrame, order: str, ahead: bool, sums: dict[str, tuple]) -> DataFrame:
    """rows with running aggregates by conversation: name -> (aggregate, how two of them add up, column, nothing).

    Those of a block are made in the block, and are added to that of all blocks before (or, if ``ahead``, after) it.
    """
    block = F.floor(F.col(order) / BLOCK).alias("_block")
    rows = rows.withColumn("_block", block)
    sort = (lambda c: F.col(c).desc()) if ahead else F.col
    whole = rows.groupBy("conv_id", "_block").agg(*[f(column).alias(f"_{name}") for name, (f, _, column, _) in sums.items()])
    over = W.partitionBy("conv_id").orderBy(sort("_block")).rowsBetween(W.unboundedPreceding, -1)
    whole = whole.select("conv_id", "_block", *[F.coalesce(f(f"_{name}").over(over), F.lit(zero)).alias(f"_{name}") for name, (f, _, _, zero) in sums.items()])
    within = W.partitionBy("conv_id", "_block").orderBy(sort(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    for name, (f, _, column, _) in sums.items():
        rows = rows.withColumn(f"_own_{name}", f(column).over(within))
    joined = rows.join(whole, ["conv_id", "_block"])
    return joined.withColumns({name: add(F.col(f"_own_{name}"), F.col(f"_{name}")) for name, (_, add, _, _) in sums.items()}).drop("_block", *[f"_{name}" for name in sums], *[f"_own_{name}" for name in sums])


_DIGEST = ["depth", "d1", "d2"]


def _owners(asked: DataFrame, prefixes: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv_id, owner): who owns the prefix of each asked (conv_id, depth)."""
    digests = materialise(prefixes.select("conv_id", *_DIGEST).join(small(asked, 8 << 20, 16), ["conv_id", "depth"]), "asked-digests")
    least = minima.select(*_DIGEST, "owner")
    if digests.count() <= 100_000:
        return least.join(F.broadcast(digests), _DIGEST).select("conv_id", "owner")
    return join_by_key(digests, least, _DIGEST, copies=minima.select(*_DIGEST, "n"), row_bytes=32).select("conv_id", "owner")


def first_owned(convs: DataFrame, prefixes: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv_id, length, first): the least depth from 1 on that a conversation owns, one more than its length if there is none."""
    state = convs.select("conv_id", "length", F.lit(1).cast("long").alias("lo"), (F.col("length") + 1).alias("hi"))
    done = state.filter("lo = hi")
    state = materialise(state.filter("lo < hi"), "search")
    while not state.isEmpty():
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
        told = _owners(state.select("conv_id", middle.alias("depth")), prefixes, minima)
        mine = F.col("owner") == F.col("conv_id")
        moved = state.join(told, "conv_id").select("conv_id", "length", F.when(mine, F.col("lo")).otherwise(middle + 1).alias("lo"), F.when(mine, middle).otherwise(F.col("hi")).alias("hi"))
        moved = materialise(moved, "search")
        done, state = done.unionByName(moved.filter("lo = hi")), moved.filter("lo < hi")
    return materialise(done.select("conv_id", "length", F.col("lo").alias("first")), "first-owned")


def _summed_upwards(chains: DataFrame) -> DataFrame:
    """(conv_id, saved, leaves) of chains (conv_id, up, saved, leaves) with those of all chains below added."""
    table = materialise(chains, "chain-sums")
    while not (linked := table.filter("up is not null")).isEmpty():
        below = materialise(linked.groupBy("up").agg(F.count("*").alias("n"), F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves")), "chains-below")
        above = table.select(F.col("conv_id").alias("up"), F.col("up").alias("_next"))
        moved = join_by_key(linked.select("conv_id", "up"), above, ["up"], copies=below.select("up", "n"), row_bytes=16).select("conv_id", "_next")
        table = table.join(below.withColumnRenamed("up", "conv_id"), "conv_id", "left").join(moved, "conv_id", "left")
        table = table.select("conv_id", F.col("_next").alias("up"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0).cast("long"))).alias(c) for c in ("saved", "leaves")])
        table = materialise(table, "chain-sums")
    return table.select("conv_id", "saved", "leaves")


def _ends(convs: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the nodes (_end, length) at which conversations end."""
    numbered = convs.repartitionByRange(_tasks(convs), "conv_id").sortWithinPartitions("conv_id").withColumn("_piece", F.shiftright(F.monotonically_increasing_id(), PIECE_BITS))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = materialise(materialise(numbered, "end-pieces").groupBy("_end", "length", "_piece").agg(listed.alias("_ids")), "ending-ids")
    several = pieces.groupBy("_end", "length").agg(F.count("*").alias("k"), F.min("_ids").alias("_ids"))
    several = materialise(several.select("_end", "length", "k", F.when(F.col("k") == 1, F.sha2("_ids", 256)).alias("ends_sha256")), "end-digests")
    one = several.filter("k = 1").select("_end", "length", "ends_sha256")
    long = pieces.join(small(several.filter("k > 1").select("_end", "length"), 8 << 20, 16), ["_end", "length"], "left_semi")
    long = long.repartition("_end", "length").sortWithinPartitions("_end", "length", "_piece").select("_end", "length", "_ids")

    def run(batches):
        key, state = None, None
        for batch in batches:
            for end, length, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (end, length) != key:
                    if key is not None:
                        yield row(key, state)
                    key, state = (end, length), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if key is not None:
            yield row(key, state)

    def row(key, state):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], ["_end", "length", "ends_sha256"])

    return one.unionByName(long.mapInArrow(run, "_end long, length long, ends_sha256 string")).select(F.col("_end").alias("conv_id"), F.col("length").alias("depth"), "ends_sha256")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of numbered turns (conv_id, place, bytes, h1, h2) of conversations (conv_id, length).

    Per node: conv_id (owner), depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens of its subtree (for each
    node the bytes of its last text, once for every conversation but one) and ends_sha256, the hash of the ids that end there.
    """
    zero = F.lit(0).cast("long")
    xor = (F.bit_xor, Column.bitwiseXOR)
    keyed = turns.select("conv_id", F.col("place").alias("depth"), "bytes", F.xxhash64("place", "h1").alias("_x1"), F.xxhash64(F.lit(1), "place", "h2").alias("_x2"))
    prefixes = _running(keyed, "depth", False, {"d1": (*xor, "_x1", 0), "d2": (*xor, "_x2", 0)})
    prefixes = materialise(prefixes.select("conv_id", "depth", "d1", "d2", "bytes"), "prefixes")
    minima = materialise(prefixes.groupBy(*_DIGEST).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n"), F.max("bytes").alias("bytes")), "prefix-minima")

    convs = materialise(convs, "conversation-lengths")
    n_convs, root = convs.agg(F.count("*"), F.min("conv_id")).first()
    found = first_owned(convs, prefixes, minima)
    # One turn above its first: the parent of a chain, and the last node of a conversation that owns none.
    above = _owners(found.filter("first > 1").select("conv_id", (F.col("first") - 1).alias("depth")), prefixes, minima)
    known = found.join(above, "conv_id", "left").select("conv_id", "length", "first", F.when(F.col("first") > 1, F.col("owner")).otherwise(F.lit(root)).alias("up"))
    is_root = F.col("conv_id") == F.lit(root)
    known = materialise(known.select("conv_id", "length", F.when(is_root, zero).otherwise(F.col("first")).alias("first"), F.when(~is_root, F.col("up")).alias("up")), "chains")
    chains = known.filter("first <= length or up is null")

    nodes = minima.select(F.col("owner").alias("conv_id"), "depth", F.col("n").alias("n_convs"), ((F.col("n") - 1) * F.col("bytes")).alias("_saves"))
    if n_convs:
        nodes = nodes.unionByName(convs.sparkSession.createDataFrame([(root, 0, n_convs, 0)], "conv_id long, depth long, n_convs long, _saves long"))
    hung = chains.filter("up is not null").select("conv_id", F.col("up").alias("_up"), (F.col("first") - 1).alias("_at"))
    taken = hung.select(F.col("_up").alias("conv_id"), F.col("_at").alias("length")).distinct().withColumn("_taken", F.lit(True))
    sums = nodes.groupBy("conv_id").agg(F.sum("_saves").alias("saved"))
    sums = chains.join(taken, ["conv_id", "length"], "left").join(sums, "conv_id").select("conv_id", "up", "saved", F.when(F.col("_taken"), zero).otherwise(zero + 1).alias("leaves"))
    totals = _summed_upwards(sums)
    below = hung.join(totals, "conv_id").groupBy(F.col("_up").alias("conv_id"), F.col("_at").alias("depth"))
    below = materialise(below.agg(F.count("*").alias("_chains"), F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves")), "hung-chains")

    sizes = known.select("conv_id", (F.col("length") + 1).alias("n"))
    nodes = join_by_key(nodes, chains.select("conv_id", "first", "length", "up"), ["conv_id"], copies=sizes, row_bytes=32).join(below, ["conv_id", "depth"], "left")
    more = F.col("depth") < F.col("length")
    children = more.cast("long") + F.coalesce("_chains", zero)
    nodes = nodes.select(
        "conv_id", "depth", "n_convs", children.alias("n_children"),
        F.when(F.col("depth") == F.col("first"), F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        (F.col("_saves") + F.coalesce("_saved", zero)).alias("_s"), ((children == 0).cast("long") + F.coalesce("_leaves", zero)).alias("_l"),
    )
    add = (F.sum, Column.__add__)
    nodes = _running(nodes, "depth", True, {"saved_tokens": (*add, "_s", 0), "n_leaves": (*add, "_l", 0)})
    owner = F.when((F.col("first") <= F.col("length")) | F.col("up").isNull(), F.col("conv_id")).otherwise(F.col("up"))
    ends = _ends(known.select("conv_id", "length", owner.alias("_end")))
    out = nodes.join(ends, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))
