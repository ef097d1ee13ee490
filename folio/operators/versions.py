"""A library that is written in whole versions: outputs and their texts side by side, and one pointer to the version that
counts. A write that fails anywhere leaves the version before as it was."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.library import delete_outputs, split_records, upsert_outputs
from folio.operators.retention import HISTORY_CAP, free_space, prune_victims, record_bytes
from folio.runtime import dropped, hadoop_path

POINTER = "_current"


class NoSpace(Exception):
    """What a store raises when a version doesn't fit."""


class Library:
    """The tables of outputs (id, created_at, size, ..., has_chapters, chapters_size) and texts (id, chapters) under a folder."""

    def __init__(self, spark: SparkSession, path: str, save: Callable[[DataFrame, str], None] | None = None) -> None:
        """save: how a table is written; it may raise NoSpace."""
        self.spark, self.path = spark, path.rstrip("/")
        self.save = save or (lambda df, to: df.write.parquet(to))

    def version(self) -> int:
        """The number of the version that counts; 0 before the first."""
        at, fs = hadoop_path(self.spark, f"{self.path}/{POINTER}")
        if not fs.exists(at):
            return 0
        stream = fs.open(at)
        try:
            said = bytes(stream.readNBytes(1000)).decode()
        finally:
            stream.close()
        return int(json.loads(said)["version"])

    def read(self) -> tuple[DataFrame, DataFrame]:
        v = self.version()
        if not v:
            raise ValueError("the library has no version yet")
        return tuple(self.spark.read.parquet(f"{self.path}/v{v}/{t}") for t in ("outputs", "texts"))

    def _point(self, version: int) -> None:
        new, fs = hadoop_path(self.spark, f"{self.path}/{POINTER}.{version}")
        out = fs.create(new, True)
        try:
            out.write(bytearray(json.dumps({"version": version}).encode()))
        finally:
            out.close()
        at, _ = hadoop_path(self.spark, f"{self.path}/{POINTER}")
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = rename
        context.rename(new, at, options)

    def write(self, outputs: DataFrame, texts: DataFrame) -> int:
        """Both tables as a new version, which counts from then on."""
        version = self.version() + 1
        folder = f"{self.path}/v{version}"
        dropped(self.spark, folder)  # what a writer that failed has left
        try:
            self.save(outputs, f"{folder}/outputs")
            self.save(texts, f"{folder}/texts")
        except BaseException:
            dropped(self.spark, folder)
            raise
        self._point(version)
        return version

    def put(self, records: DataFrame, count_cap: int = HISTORY_CAP, budget: float = float("inf"), quota_message: str = "There is no space left for this book.") -> int:
        """The library with records(id, created_at, size, ..., chapters) put in, as a new version.

        The oldest others go before, until all fit; if the write finds no space, as many of the oldest go as the records
        need, and it is tried once more; then the whole history is held to its limits again. Each of these reads the tables
        of the version before, so that nothing is lost if one fails."""
        new, _ = split_records(records)
        size = record_bytes(F.col("size"), F.col("chapters_size"))
        coming = new.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
        if not self.version():
            outputs, texts = new.limit(0), records.select("id", "chapters").limit(0)
        else:
            outputs, texts = self.read()
        others = outputs.join(new.select("id"), "id", "left_anti")
        victims = prune_victims(others, [], "created_at", "id", size, count_cap, budget, int(coming["b"]), int(coming["n"]))
        outputs, texts = delete_outputs(outputs, texts, victims)
        try:
            return self._put(outputs, texts, records, size, count_cap, budget)
        except NoSpace:
            rest = outputs.join(new.select("id"), "id", "left_anti")
            outputs, texts = delete_outputs(outputs, texts, free_space(rest, [], "created_at", "id", size, int(coming["b"])))
            try:
                return self._put(outputs, texts, records, size, count_cap, budget)
            except NoSpace as e:
                raise NoSpace(quota_message) from e

    def _put(self, outputs: DataFrame, texts: DataFrame, records: DataFrame, size: Column, count_cap: int, budget: float) -> int:
        outputs, texts = upsert_outputs(outputs, texts, records)
        return self.write(*delete_outputs(outputs, texts, prune_victims(outputs, [], "created_at", "id", size, count_cap, budget)))
