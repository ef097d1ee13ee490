"""Scans of many files that say how far they are and can be stopped.

Files are scanned in groups, one Spark job a group, whose rows are a part of the output as soon as the job is done. A job's
tag names the scan, so that any thread, or another session of the application, can stop it; what is done stays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folio.runtime import hadoop_path
from folio.sources.files import parse_files, read_files, text_pages

EVERY = 10


@dataclass
class Progress:
    done: int
    total: int
    name: str  # of the last file that is done, or of the first
    failures: int
    pages: int


class Cancelled(Exception):
    """A scan was stopped; its output has the groups that were done."""


def milestone(done: int, total: int, every: int = EVERY) -> bool:
    """Whether to say something at done of total files: each `every` of them, but neither at the start nor at the end."""
    return 0 < done < total and done % every == 0


def scan(spark: SparkSession, paths: list[str], out: str, tag: str, parse: Callable[[bytes], list] = text_pages, on_progress: Callable[[Progress], None] | None = None, every: int = EVERY) -> DataFrame:
    """The rows of parse_files of all paths, written under `out` in groups of `every` files; on_progress is told before the
    first and after each group, with counters that the job itself has observed. stop(spark, tag) ends it: the group that
    runs is given up, and Cancelled is raised. What on_progress raises ends it too, between groups.

    A group that is there already is not scanned again, so a stopped scan goes on where it was."""
    if not paths:
        raise ValueError("Add at least one file to convert.")
    tell = on_progress or (lambda p: None)
    name = lambda i: paths[i].rsplit("/", 1)[-1]
    failures = pages = 0
    tell(Progress(0, len(paths), name(0), 0, 0))
    for first in range(0, len(paths), every):
        some = paths[first : first + every]
        to = f"{out.rstrip('/')}/first={first}"
        if not _there(spark, f"{to}/_SUCCESS"):
            seen = Observation()
            rows = parse_files(read_files(spark, some).withColumn("position", F.col("position") + first), parse)
            counted = rows.observe(seen, F.count("error").alias("failures"), F.coalesce(F.sum(F.size("pages")), F.lit(0)).alias("pages"))
            context = spark.sparkContext
            context.addJobTag(tag)
            context.setInterruptOnCancel(True)
            try:
                counted.write.mode("overwrite").parquet(to)
            except Exception as e:
                if "cancel" in str(e).lower():
                    raise Cancelled(f"{tag}: {first} of {len(paths)} files were done") from e
                raise
            finally:
                context.removeJobTag(tag)
                context.setInterruptOnCancel(False)
            failures += seen.get["failures"]
            pages += max(0, seen.get["pages"])
        last = min(first + every, len(paths))
        tell(Progress(last, len(paths), name(last - 1), failures, pages))
    return finished(spark, out)


def _there(spark: SparkSession, path: str) -> bool:
    at, fs = hadoop_path(spark, path)
    return fs.exists(at)


def stop(spark: SparkSession, tag: str) -> None:
    """Ends the running jobs of a scan, whichever thread started it."""
    spark.sparkContext.cancelJobsWithTag(tag)


def finished(spark: SparkSession, out: str) -> DataFrame:
    """The rows of the groups that are done."""
    at, fs = hadoop_path(spark, out)
    groups = [s.getPath().toString() for s in fs.listStatus(at)] if fs.exists(at) else []
    done = [g for g in groups if _there(spark, f"{g}/_SUCCESS")]
    if not done:
        return spark.createDataFrame([], "position int, name string, error string, pages array<array<struct<text:string,x:double,y:double,height:double>>>")
    return spark.read.parquet(*done)
