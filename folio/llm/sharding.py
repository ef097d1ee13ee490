"""Sharding by a Feistel permutation of global row numbers.

Rows get numbers 0..n-1 in the order of (doc_id, hash of the text); a keyed Feistel network over a mixed-radix domain
a * b >= n with cycle walking permutes them; position p goes to shard p % shards, slot p // shards. Sizes of shards are at
most one row apart, slots have no gaps, and (seed, n, row number) alone give a row's place, so any worker can compute it.
Only DataFrame functions run; only (doc_id, size, checksum, hash) are shuffled, never texts.

Defined results: null doc_id sorts first; null text has size 1 and the checksum of no bytes; rows alike in doc_id and text
are interchangeable; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import cut, table

ROUNDS = 6
MAX_WALK = 64


def domain(n: int) -> tuple[int, int]:
    """a * b >= n with few numbers too many."""
    a = max(1, isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _network(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the Feistel network over 0..a*b-1: each half is shifted in turn by a keyed hash of the other."""

    def step(s: Column, r: Column) -> Column:  # two half rounds keep the halves in their radix
        left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], r, F.lit(seed)), F.lit(a)), F.lit(a)).cast("long")
        right = F.pmod(s["r"] + F.pmod(F.xxhash64(left, r, F.lit(seed + 1)), F.lit(b)), F.lit(b)).cast("long")
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.pmod(x, F.lit(a)).cast("long").alias("l"), ((x - F.pmod(x, F.lit(a))) / F.lit(a)).cast("long").alias("r"))
    rounds = F.array(*[F.lit(i).cast("long") for i in range(ROUNDS)])
    return F.aggregate(rounds, start, step, lambda s: s["l"] + s["r"] * F.lit(a))


def permuted(x: Column, n: int, seed: int) -> Column:
    """Where the permutation puts number x of 0..n-1. A walk passes only through numbers n..a*b-1; one longer than
    MAX_WALK, which small n can't have and large n practically never, raises an error instead of a wrong place."""
    a, b = domain(n)
    first = _network(x, a, b, seed)
    walks = min(a * b - n + 1, MAX_WALK)
    if a * b == n:
        return first
    walked = lambda p: F.aggregate(F.array(*[F.lit(0)] * walks), p, lambda v, _: F.when(v < n, v).otherwise(_network(v, a, b, seed)))
    far = walked(first)
    return F.when(first < n, first).otherwise(F.when(far < n, far).otherwise(F.raise_error(F.lit("the walk is too long; take another seed")).cast("long")))


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Adds row_number long, 0..n-1 in the given order, without a single-task sort; n.

    Range partitions are sorted and written once, so their bounds can't differ between the count and the use."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())  # deals rows that are alike over several partitions
    keys = [*[F.col(c).asc_nulls_first() for c in order], F.col("_tie").asc()]
    placed = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    placed = cut(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))  # a row for each partition
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", "_rows", before.alias("_start"))
    n = starts.agg(F.sum("_rows")).first()[0] or 0
    return placed.join(F.broadcast(starts.drop("_rows")), "_part").withColumn("row_number", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"), n


def shard(docs: DataFrame, shards: int = 16, seed: int = 20240607) -> DataFrame:
    """doc_id, size, text_crc32, row_number, position, shard, slot for every row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_h"))
    rows, n = numbered(slim, ["doc_id", "_h", "size", "text_crc32"])
    rows = rows.withColumn("position", permuted(F.col("row_number"), max(n, 1), seed))
    return rows.select("doc_id", "size", "text_crc32", "row_number", "position", (F.col("position") % shards).cast("int").alias("shard"), F.expr(f"position div {shards}").alias("slot"))


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
