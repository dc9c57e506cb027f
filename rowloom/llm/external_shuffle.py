"""Sharding (6): a two-pass external shuffle, native DataFrame operations only.

Method: the first pass scatters records uniformly into memory-sized buckets by a
seeded hash; the second shuffles each bucket (``shuffle`` draws a Fisher-Yates
permutation) and writes it.  Shuffled buckets stand one after another; the resulting
order is dealt to the shards in turn, so that shard row counts differ by one at most
(law ``rows``).  Bucket start offsets come from a cumulated table of bucket counts.

The number of buckets follows from the total size, so a bucket has a bounded size at
any scale; hot sources or copies spread over all buckets, as the hash covers id and
text.  Rows that are equal in both are counted first: each set of them becomes one row and its count,
which is dealt out again in numbered pieces, so that equal rows too spread over all buckets and
every piece of work stays the same when it is done again.  A seeded ``shuffle`` depends
on partition and row order; both are fixed here
(explicit partitions by bucket, sorted buckets, sorted records), so that a lost
executor's tasks give the same permutation again.

Defined cases: null or empty text has no bytes and crc32 of the empty string; null ids
are ordinary values; exactly repeated rows are separate records, each with its own
slot; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm._shared import discard, if_small, load, stored

SEED = 20240613
BUCKET_BYTES = 4 << 20
#: Least number of buckets (small inputs should use more than a few tasks), and most tasks of
#: the second pass; beyond, a task takes several buckets, one after another.
MIN_BUCKETS, MAX_TASKS = 24, 50_000
#: Equal rows that one task deals out.
PIECE = 1000


def _numbered(rows: DataFrame, tasks: int) -> DataFrame:
    """rows: doc_id, text, size.  Adds ``nth``: 0, and a number for each of several equal rows."""
    key = rows.select("doc_id", F.xxhash64("text").alias("th"))
    again = key.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    again = stored(again.select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th")), "repeated")
    if again.isEmpty():
        discard(again)
        return rows.withColumn("nth", F.lit(0).cast("long"))
    on = rows["doc_id"].eqNullSafe(again["r_id"]) & (F.xxhash64("text") == again["r_th"])
    once = rows.join(if_small(again), on, "left_anti").withColumn("nth", F.lit(0).cast("long"))
    sets = rows.join(if_small(again), on, "left_semi").groupBy("doc_id", "text", "size").agg(F.count(F.lit(1)).alias("m"))
    pieces = sets.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / PIECE)))).repartition(tasks, "doc_id", F.xxhash64("text"), "piece")
    first = F.col("piece") * PIECE
    nth = F.explode(F.sequence(first, F.least(first + PIECE, F.col("m")) - 1))
    return once.unionByName(pieces.select("doc_id", "text", "size", nth.alias("nth")))


def external_shuffle(
    docs: DataFrame,
    n_shards: int = 40,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    min_buckets: int = MIN_BUCKETS,
) -> DataFrame:
    """doc_id, text, size, shard, slot: the records in seeded random order, dealt to shards."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), (F.octet_length(body) + 16).cast("long").alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    n = max(min_buckets, math.ceil(total / bucket_bytes))
    tasks = min(n, MAX_TASKS)
    place = F.xxhash64(F.lit(seed), "doc_id", "text", F.nullif("nth", F.lit(0)))
    placed = _numbered(rows, tasks).withColumn("bucket", F.pmod(place, F.lit(n)).cast("int")).drop("nth")

    counts = stored(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket-counts")
    # starts of groups of about sqrt(n) buckets, then of the buckets in each
    many = math.isqrt(n) + 1
    grouped = counts.withColumn("g", F.floor(F.col("bucket") / many).cast("int"))
    heads = stored(grouped.groupBy("g").agg(F.sum("n").alias("t")), "bucket-groups")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = heads.select(F.col("g").alias("h"), F.coalesce(F.sum("t").over(before(Window.orderBy("g"))), F.lit(0)).alias("top"))
    inner = F.coalesce(F.sum("n").over(before(Window.partitionBy("g").orderBy("bucket"))), F.lit(0))
    starts = grouped.select("g", F.col("bucket").alias("b"), inner.alias("inner"))
    offsets = stored(starts.join(tops, starts["g"] == tops["h"]).select("b", (F.col("top") + F.col("inner")).alias("start")), "bucket-starts")
    discard(counts, heads)

    scattered = placed.repartition(tasks, "bucket").groupBy("bucket").agg(F.collect_list(F.struct("doc_id", "text", "size")).alias("records"))
    ordered = scattered.sortWithinPartitions("bucket").withColumn("records", F.array_sort("records"))
    shuffled = ordered.select("bucket", F.shuffle("records", F.lit(seed)).alias("records"))
    dealt = shuffled.join(if_small(offsets), shuffled["bucket"] == offsets["b"])
    flat = dealt.select("start", F.posexplode("records").alias("at", "r")).withColumn("place", F.col("start") + F.col("at"))
    return flat.select(
        "r.doc_id",
        "r.text",
        "r.size",
        (F.col("place") % n_shards).cast("int").alias("shard"),
        F.floor(F.col("place") / n_shards).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, **options) -> None:
    """Write the shards: one folder for each under ``path``, records in slot order."""
    out = external_shuffle(docs, n_shards, **options)
    out.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = external_shuffle(load(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op6_external_shuffle": op6_external_shuffle}
SQL: dict[str, str] = {}
