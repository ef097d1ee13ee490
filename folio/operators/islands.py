"""Gap-and-island operators: consecutive rows that belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.runtime import written


def islands(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """df with the number, from 1, of the run that each row is in; `starts` (which may use lag over the same window, made
    by the caller) says where one begins. One sort by (by, order)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def joined_text(text: Column, order: Column, separator: str = " ") -> Column:
    """Aggregate: texts in order with a separator between."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator)


def longest_run(df: DataFrame, by: list[str], order: str, flag: Column) -> DataFrame:
    """by, first, last, size of the longest run of rows with the flag; the earliest of equal ones. Groups without are absent."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.coalesce(F.lag(F.col("_flag")).over(w), F.lit(False)) != F.col("_flag")
    runs = islands(df.withColumn("_flag", flag).withColumn("_starts", change), by, [order], F.col("_starts"), "_run").where("_flag")
    each = runs.groupBy(*by, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("size"))
    best = F.max_by(F.struct("first", "last", "size"), F.struct("size", -F.col("first")))
    return each.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def number_ranges(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """by, ranges: the numbers as text, runs as first–last; a repeated number begins a new range."""
    w = Window.partitionBy(*by).orderBy(number)
    step = df.withColumn("_starts", F.coalesce(F.lag(number).over(w) + 1 != F.col(number), F.lit(True)))
    runs = islands(step, by, [number], F.col("_starts"), "_run").groupBy(*by, "_run").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string")))
    return runs.groupBy(*by).agg(joined_text(text, F.col("_run"), ", ").alias("ranges"))


def running_sums(rows: DataFrame, sums: dict[str, Column], by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """rows with, for each name of sums, the column's sum over the key's rows up to each, and `<name>_all`, over all of them.

    In two levels: rows are dealt into ranges of (by, order), which the sort orders of the columns decide alone, so a hot key
    is as many tasks as it has ranges; sums run within ranges, and over the ranges' totals, of which a key has `parts` at
    most. The ranges are written, so that a lost task finds them as they were. Rows alike in (by, order) are in one range and
    count in any order among themselves. Null counts as 0."""
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = rows.withColumns({f"_v{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())})
    dealt = written(named.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy(*by, "_part").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))])
    key = Window.partitionBy(*by)
    earlier = key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))], *[F.sum(f"_t{i}").over(key).alias(f"_a{i}") for i in range(len(sums))])
    here = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.select("*", *[F.sum(f"_v{i}").over(here).alias(f"_h{i}") for i in range(len(sums))])
    on = [inside[c].eqNullSafe(before[c]) for c in (*by, "_part")]
    made = inside.join(before, on) if by else inside.join(before, "_part")
    return made.select(*[inside[c] for c in rows.columns], *[(F.col(f"_b{i}") + F.col(f"_h{i}")).alias(name) for i, name in enumerate(sums)], *[F.col(f"_a{i}").alias(f"{name}_all") for i, name in enumerate(sums)])


def running_sum(rows: DataFrame, value: str, by: list[str], order: str, parts: int | None = None) -> DataFrame:
    """rows with `running`: the sum of value over rows up to each, by any order. See running_sums."""
    return running_sums(rows, {"running": F.col(value)}, by, [order], parts).drop("running_all")
