"""Making the package available to executors that don't have it installed, and tables that outlive them."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()
_local: list[str] = []


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="folio-"), "folio_sources.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    context.addPyFile(path)


def deal_unions_again(spark: SparkSession) -> None:
    """Spark 4.1 takes a union of tables that are dealt by a key as dealt by it, and leaves out the exchange behind it; but adaptive
    execution coalesces each table's partitions by its own sizes, so rows of one key end up in several tasks. Without this
    setting a window, an aggregate or a repartition behind a union can be wrong."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def scratch(spark: SparkSession) -> str:
    """A new folder's name under spark.checkpoint.dir, which all executors share. Only a local session may leave that unset:
    on a cluster each executor would write to its own disk."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="folio-"))
            atexit.register(shutil.rmtree, _local[0], True)
        base = "file://" + _local[0]
    return f"{base.rstrip('/')}/folio-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """path as the file systems that Spark knows name it, and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dropped(spark: SparkSession, path: str) -> None:
    try:
        p, fs = hadoop_path(spark, path)
        fs.delete(p, True)
    except Exception:  # noqa: BLE001  the session may be over; a leftover scratch folder is harmless
        pass


TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, compression: str | None = None, tidy: bool = False) -> DataFrame:
    """df as a table in the shared folder: what is used more than once is made once, survives lost executors, and has no
    lineage. The table goes with the application. tidy: shuffle files of the writing go when it is done, not when the driver
    happens to collect its garbage."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(TIDY, None)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if tidy:
            spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    atexit.register(dropped, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch, column: str, most: int = 1 << 20) -> Iterator:
    """An Arrow batch in parts of about `most` bytes of a column, a row at least: what Python makes of a batch of many long
    texts is many times as large as they are."""
    import pyarrow.compute as pc

    first = size = 0
    for at, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
        if at > first and size + n > most:
            yield batch.slice(first, at - first)
            first, size = at, 0
        size += n
    if first < batch.num_rows:
        yield batch.slice(first)


def spread(df: DataFrame) -> DataFrame:
    """df, whose rows are small but dear to work on, as a table in the shared folder of two files a core: Spark reads a table of one
    file or row group in one task. It is written since filters are pushed through an exchange, with all that they compute."""
    return written(df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism))


def shipped(query):
    """query(spark, sf_dir) that ships the package first, and whose unions are dealt again."""

    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        deal_unions_again(spark)
        return query(spark, sf_dir)

    return run
