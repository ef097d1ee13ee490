"""What to evict from a history that has a count and a byte limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.islands import running_sums

HISTORY_CAP = 50


def record_bytes(size: Column, side: Column) -> Column:
    return F.coalesce(size, F.lit(0)) + F.coalesce(side, F.lit(0))


def chapters_bytes(chapters: Column) -> Column:
    """Estimate from array<struct<title, blocks array<struct<text>>>>: two bytes a UTF-16 unit and some for each item."""
    from folio.functions.js import utf16_length

    blocks = lambda c: F.aggregate(c["blocks"], F.lit(0), lambda a, b: a + utf16_length(b["text"]) + 8)
    return F.coalesce(F.aggregate(chapters, F.lit(0), lambda a, c: a + utf16_length(c["title"]) + 16 + blocks(c)) * 2, F.lit(0))


def byte_budget(quota: Column, cap: int = 512 << 20, share: float = 0.8) -> Column:
    return F.least(F.floor(quota * share), F.lit(cap))


def prune_victims(records: DataFrame, by: list[str], created: str, id_: str, size: Column, count_cap: int = HISTORY_CAP, budget: float = float("inf"), incoming_bytes: int = 0, incoming_count: int = 0, keep_at_least: int = 0) -> DataFrame:
    """records that go, with ord: oldest first until what stays fits both limits. A hot key is many tasks; see running_sums."""
    seen = running_sums(records.withColumn("_b", size), {"ord": F.lit(1), "_s": F.col("_b")}, by, [created, id_])
    left = F.col("ord_all") - (F.col("ord") - 1) + incoming_count
    over = (left > count_cap) | (F.col("_s_all") - (F.col("_s") - F.coalesce("_b", F.lit(0))) + incoming_bytes > F.lit(budget))
    return seen.where(over & (F.col("ord") <= F.col("ord_all") - keep_at_least)).drop("_b", "ord_all", "_s", "_s_all").withColumn("ord", F.col("ord").cast("int"))


def free_space(records: DataFrame, by: list[str], created: str, id_: str, size: Column, wanted: int) -> DataFrame:
    """The oldest records that together free `wanted` bytes at least. A hot key is many tasks; see running_sums."""
    seen = running_sums(records.withColumn("_b", size), {"_s": F.col("_b")}, by, [created, id_])
    return seen.where(F.col("_s") - F.coalesce("_b", F.lit(0)) < wanted).drop("_b", "_s", "_s_all")


def expired(rows: DataFrame, saved_at: str, now: Column, days: int = 30) -> DataFrame:
    return rows.where(F.col(saved_at).isNull() | (F.col(saved_at) < now - F.expr(f"interval {days} days")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in their place; nulls in new keep the old value."""
    columns = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns]
    return old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*columns)
