"""Reading order of listings, inferred from dates and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_votes(posts: DataFrame, by: str, position: str, value: str) -> DataFrame:
    """by, up, down: rising and falling steps between consecutive known values."""
    w = Window.partitionBy(by).orderBy(position)
    steps = posts.where(F.col(value).isNotNull()).withColumn("_p", F.lag(value).over(w))
    return steps.groupBy(by).agg(F.count_if(F.col(value) > F.col("_p")).alias("up"), F.count_if(F.col(value) < F.col("_p")).alias("down"))


def vote(up: Column, down: Column) -> Column:
    """True: newest first; false: oldest first; null: too few or too mixed steps."""
    return F.when(up + down < 2, F.lit(None)).when(down > 2 * up, F.lit(True)).when(up > 2 * down, F.lit(False))


def newest_first(posts: DataFrame, by: str, position: str, date: str, number: str) -> DataFrame:
    """by, newest_first: dates decide, then numbers; else false."""
    d, n = (step_votes(posts, by, position, c).select(by, vote(F.col("up"), F.col("down")).alias(name)) for c, name in ((date, "_d"), (number, "_n")))
    return posts.select(by).distinct().join(d, by, "left").join(n, by, "left").select(by, F.coalesce("_d", "_n", F.lit(False)).alias("newest_first"))


def keep_neighbours(posts: DataFrame, by: str, position: str, key: str, tie: str | None = None) -> DataFrame:
    """posts with pos, 0.. within by: sorted by key, each without one right after the last before it that has one."""
    w = Window.partitionBy(by).orderBy(position)
    own = F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("k"), (F.coalesce(F.col(tie), F.lit(0)) if tie else F.lit(0)).alias("t"), F.col(position).alias("p")))
    held = posts.withColumn("_pred", F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    order = Window.partitionBy(by).orderBy(F.col("_pred").isNotNull(), "_pred.k", "_pred.t", "_pred.p", position)
    return held.withColumn("pos", F.row_number().over(order) - 1).drop("_pred")


def oldest_first(posts: DataFrame, by: str = "list_id", position: str = "position", date: str = "date", number: str = "number", order: str = "order") -> DataFrame:
    """posts with pos, their reading order, by the rule that their list's `order` and its shares of dates and numbers choose."""
    shares = posts.groupBy(by).agg(F.count("*").alias("_n"), F.count(date).alias("_dated"), F.count(number).alias("_numbered"), F.first(order).alias("_order"))
    rule = shares.join(newest_first(posts, by, position, date, number), by)
    kept = F.col("_order").isin("collection-asc", "collection-desc", "collection")
    by_date = ~kept & (F.col("_dated") >= 2) & (F.col("_dated") >= 0.8 * F.col("_n"))
    by_number = ~kept & ~by_date & (F.col("_numbered") >= 2) & (F.col("_numbered") >= 0.9 * F.col("_n"))
    back = (F.col("_order") == "collection-desc") | ((F.col("_order") == "collection") & F.col("newest_first")) | (F.col("_order") == "newest-first")
    rule = rule.select(by, F.when(by_date, "date").when(by_number, "number").otherwise("base").alias("_rule"), F.coalesce(back, F.lit(False)).alias("_back"))
    base = posts.join(rule, by).withColumn("_base", F.when(F.col("_back"), -F.col(position)).otherwise(F.col(position)))
    base = base.withColumn("_key", F.when(F.col("_rule") == "date", F.col(date).cast("double")).when(F.col("_rule") == "number", F.col(number).cast("double")).otherwise(F.col("_base").cast("double")))
    base = base.withColumn("_tie", F.when(F.col("_rule") == "date", F.coalesce(F.col(number), F.lit(0))).otherwise(0))
    return keep_neighbours(base, by, "_base", "_key", "_tie").drop("_rule", "_back", "_base", "_key", "_tie")
