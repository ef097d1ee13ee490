"""Ordered look-ups and set operations of listings and histories. Spark chooses how to join; no side is broadcast by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import js


def lookup(ids: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """All ids, with details where there are any."""
    return ids.join(details, key, "left")


def rename(rows: DataFrame, titles: DataFrame, key: str, column: str) -> DataFrame:
    """rows with new titles; a blank or missing one keeps the old."""
    new = titles.select(key, F.nullif(js.trim(F.col(column)), F.lit("")).alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def selected_or_all(rows: DataFrame, selection: DataFrame, key: str) -> DataFrame:
    """The selected rows; all if none is selected."""
    some = selection.agg(F.count("*").alias("_n"))
    chosen = selection.select(key).distinct().withColumn("_in", F.lit(True))
    return rows.join(chosen, key, "left").crossJoin(F.broadcast(some)).where(F.col("_in") | (F.col("_n") == 0)).drop("_in", "_n")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Rank filters are applied before rows are shuffled, so hot keys send few rows."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_n(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """rows with rank, the first n of each group in the order given."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
