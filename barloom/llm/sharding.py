"""Sharding by balanced label propagation, in DataFrame functions.

Documents with equal texts are linked.  Every group starts with one hashed label
(the labels of a clique agree after one free round), shards that got too much
give some back, and then in each round linked documents move to the shard where most of their
neighbours are and which still has room.  Documents of one group are
interchangeable, so the state is the table of (group, shard, documents) and
moves are numbers of documents: a group of any size costs at most one row a
shard.  Quotas are dealt to hash buckets of groups, so no task ranks all moves
into a shard.  Documents without neighbours fill the shards up at the end, which
makes the counts even to one: the law is `rows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dense_rank, store

ROUNDS = 8
MOVES_PER_BUCKET = 20_000
ROWS_PER_CHUNK = 2_000
MOST_CHUNKS = 4_096


def _pick(bounds: Column, rank: Column) -> Column:
    """Shard of a rank in an array of (end, shard), ordered by end: its first element that ends beyond the rank."""
    return F.get(F.filter(bounds, lambda b: b["end"] > rank), 0)["shard"]


def propagate(state: DataFrame, shards: int, capacity: int) -> DataFrame:
    """(key, shard, n) after label propagation; no shard gets more than `capacity` linked documents.

    `state` has one row a group.  A start above the capacity is first cut back;
    the surplus has shard null and looks for room next to its neighbours.
    """
    state = store(_cut_back(state, capacity), "op2-state")
    for _ in range(ROUNDS):
        load = {r.shard: r.n for r in state.where("shard is not null").groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
        room = {s: capacity - load.get(s, 0) for s in range(shards)}
        if not any(room.values()):
            break
        table = F.array(*[F.lit(room[s]) for s in range(shards)])
        free = F.when(F.col("shard").isNotNull(), F.get(table, F.col("shard"))).otherwise(0)
        open_to = state.withColumn("free", free)
        target = open_to.where("free > 0").groupBy("key").agg(F.max_by("shard", F.struct("n", -F.col("shard"))).alias("target"), F.max("n").alias("there"))
        roomy = F.array_sort(F.array(*[F.struct((-F.lit(room[s])).alias("less"), F.lit(s).alias("shard")) for s in range(shards)]))
        spread = F.get(roomy, F.pmod(F.xxhash64("key"), F.lit(max(1, sum(v > 0 for v in room.values())))).cast("int"))["shard"]  # for groups without a member in an open shard
        moves = state.join(target, "key", "left").withColumn("aim", F.coalesce("target", spread)).withColumn("there", F.coalesce("there", F.lit(0)))
        # towards more neighbours only; equal numbers move to the smaller shard, so two halves never swap
        wants = F.col("shard").isNull() | ((F.col("shard") != F.col("aim")) & ((F.col("n") < F.col("there")) | ((F.col("n") == F.col("there")) & (F.col("shard") > F.col("aim")))))
        wanted = store(moves.where(wants).select("key", "shard", "n", "aim", "there"), "op2-moves")
        total = wanted.count()
        if not total:
            break
        buckets = -(-total // MOVES_PER_BUCKET)
        share = F.get(table, F.col("aim")) / buckets
        queue = Window.partitionBy("aim", "bucket").orderBy(F.desc("there"), "n", "key", "shard").rowsBetween(Window.unboundedPreceding, -1)
        dealt = wanted.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(buckets))).withColumn("before", F.coalesce(F.sum("n").over(queue), F.lit(0)))
        moved = dealt.withColumn("moved", F.greatest(F.lit(0), F.least("n", F.floor(share) - F.col("before"))).cast("long")).where("moved > 0")
        moved = store(moved.select("key", "shard", "aim", "moved"), "op2-moved")
        if not moved.limit(1).count():
            break
        changes = state.select("key", "shard", "n").unionByName(moved.select("key", "shard", (-F.col("moved")).alias("n"))).unionByName(moved.select("key", F.col("aim").alias("shard"), F.col("moved").alias("n")))
        state = store(changes.groupBy("key", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "op2-state")
    return state


def _cut_back(state: DataFrame, capacity: int) -> DataFrame:
    """Take what a shard holds above its capacity out of it (shard null), from its largest groups first.

    Each hash bucket of groups gives up its share of the surplus.
    """
    buckets = max(1, -(-state.count() // MOVES_PER_BUCKET))
    dealt = state.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(buckets)))
    parts = dealt.groupBy("shard", "bucket").agg(F.sum("n").alias("part"))
    load = parts.groupBy("shard").agg(F.sum("part").alias("held"))
    share = F.when(F.col("held") <= capacity, F.col("part")).otherwise(F.floor(F.col("part") * capacity / F.col("held")))
    allowed = parts.join(load, "shard").select("shard", "bucket", share.cast("long").alias("allowed"))
    queue = Window.partitionBy("shard", "bucket").orderBy("n", "key").rowsBetween(Window.unboundedPreceding, -1)
    cut = dealt.withColumn("before", F.coalesce(F.sum("n").over(queue), F.lit(0))).join(allowed, ["shard", "bucket"])
    cut = cut.withColumn("kept", F.greatest(F.lit(0), F.least("n", F.col("allowed") - F.col("before"))).cast("long"))
    stay = cut.select("key", "shard", F.col("kept").alias("n"))
    out = cut.select("key", F.lit(None).cast("int").alias("shard"), (F.col("n") - F.col("kept")).alias("n"))
    return stay.unionByName(out).where("n > 0")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of `docs` (doc_id, text).

    Counts of shards differ by one at most; slots are gapless from 0 within a
    shard, by hash chunk and doc_id.  A null text has size 16, crc32 of the
    empty text and no neighbours.  Repeated rows are rows of their own.  An
    empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.md5(F.col("text").cast("binary"))).alias("key"),
    )
    rows = store(raw.withColumn("line", F.monotonically_increasing_id()), "op2-rows")
    n = rows.count()
    chunks = min(MOST_CHUNKS, max(1, n // ROWS_PER_CHUNK))
    chunk = F.pmod(F.xxhash64("line", "doc_id"), F.lit(chunks)).cast("int")
    floor, rest = divmod(n, shards)

    groups = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    state = store(groups.select("key", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "n"), "op2-labels")
    final = propagate(state, shards, floor)
    # what found no room joins the fillers
    placed = final.where("shard is not null")
    along = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    bounds = placed.withColumn("end", F.sum("n").over(along)).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("bounds"))  # at most one element a shard
    bounds = store(bounds, "op2-bounds")
    columns = ["doc_id", "size", "text_crc32", "line", "chunk"]
    # ranked inside (group, chunk) before the join on the group, so that a giant group stays spread
    keyed = dense_rank(rows.where("key is not null").withColumn("chunk", chunk), ["key"], "chunk", ["line"], "rank")
    named = keyed.join(bounds, "key", "left").withColumn("shard", _pick(F.col("bounds"), F.col("rank"))).select(*columns, "shard")
    bare = rows.where("key is null").withColumn("chunk", chunk).select(*columns, F.lit(None).cast("int").alias("shard"))
    grouped = store(named.unionByName(bare), "op2-grouped")
    loads = {r.shard: r.n for r in grouped.where("shard is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends, total = [], 0
    for s in range(shards):
        total += floor + (s < rest) - loads.get(s, 0)
        ends.append(F.struct(F.lit(total).cast("long").alias("end"), F.lit(s).alias("shard")))
    fillers = grouped.where("shard is null").select(*columns).withColumn("all", F.lit(0))
    filled = dense_rank(fillers, ["all"], "chunk", ["line"], "rank").withColumn("shard", _pick(F.array(*ends), F.col("rank"))).select(*columns, "shard")
    every = store(grouped.where("shard is not null").select(*columns, "shard").unionByName(filled), "op2-placed")
    slots = dense_rank(every, ["shard"], "chunk", ["doc_id", "line"], "slot")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
