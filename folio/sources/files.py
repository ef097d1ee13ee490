"""Scans of many files with a pluggable parser: a bad file never stops the others, and a file without text stays a chapter.

A parser turns a file's bytes into pages, each a list of (text, x, y, height). What it raises is kept as the file's error.
`parse_files` gives a row for each file; write that table where files are large, and derive all else from it."""

from __future__ import annotations

import codecs
import itertools
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import js
from folio.functions.text import brief_list, without_extension
from folio.runtime import hadoop_path

#: Bytes of files that are parsed into one batch.
TOGETHER = 1 << 20
FRAGMENT = "struct<text:string,x:double,y:double,height:double>"


def text_pages(content: bytes) -> list[list[tuple[str, float, float, float]]]:
    """Pages of a plain text: form feeds part pages, each line that isn't blank is a fragment, from the top down."""
    if b"\x00" in content:
        raise ValueError("not a text file")
    pages = content.decode("utf-8").split("\f")
    return [[(line, 0.0, -12.0 * i, 10.0) for i, line in enumerate(p.split("\n")) if line.strip()] for p in pages]


def text_stream(pieces: Callable[[], Iterator[bytes]]) -> tuple[int, Iterator[tuple[int, int, tuple]]]:
    """text_pages of a file that pieces() reads from its start: the number of pages, and (page_no from 1, ord, fragment). It is
    read once to check and count, and again for its fragments, so memory holds a piece and a line, however large a page is."""
    decoder, pages, at, null, wrong = codecs.getincrementaldecoder("utf-8"), 1, 0, False, None
    one = decoder()
    for piece, last in itertools.chain(((p, False) for p in pieces()), [(b"", True)]):
        null |= b"\x00" in piece
        pages += piece.count(b"\f")
        before = at - len(one.getstate()[0])
        try:
            if wrong is None:
                one.decode(piece, last)
        except UnicodeDecodeError as e:
            a, b = before + e.start, before + e.end - 1
            wrong = "'utf-8' codec can't decode " + (f"byte 0x{e.object[e.start]:02x} in position {a}" if a == b else f"bytes in position {a}-{b}") + f": {e.reason}"
        at += len(piece)
    if null or wrong:
        raise ValueError("not a text file" if null else wrong)

    def found() -> Iterator[tuple[int, int, tuple]]:
        two, rest, page, i, k = decoder(), "", 1, 0, 0
        for piece in itertools.chain(pieces(), [b"\n"]):
            *parts, rest = re.split("([\n\f])", rest + two.decode(piece))
            for line, end in zip(parts[::2], parts[1::2], strict=True):
                if line.strip():
                    yield page, k, (line, 0.0, -12.0 * i, 10.0)
                    k += 1
                page, i, k = (page + 1, 0, 0) if end == "\f" else (page, i + 1, k)

    return pages, found()


text_pages.stream = text_stream  # how the file source reads what need not be held as a whole


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """position, path, name, content of files, in the order of the paths given, each known by its whole path. A file that
    isn't there has no content. A path given twice is two files."""
    if not paths:
        raise ValueError("Add at least one file to convert.")
    whole, there = [], []
    for p in paths:
        at, fs = hadoop_path(spark, p)
        whole.append(fs.makeQualified(at).toString())
        if fs.exists(at):
            there.append(whole[-1])
    places = spark.createDataFrame([(i, w, w.rsplit("/", 1)[-1]) for i, w in enumerate(whole)], "position int, path string, name string")
    if not there:
        return places.withColumn("content", F.lit(None).cast("binary"))
    plain = [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in sorted({*there})]  # names are no patterns
    found = spark.read.format("binaryFile").load(plain).select("path", "content")
    return places.join(found, "path", "left").select("position", "path", "name", "content")


def parse_files(files: DataFrame, parse: Callable[[bytes], list] = text_pages) -> DataFrame:
    """files(position, name, content) -> position, name, error, pages (null with an error). Missing content is an error too."""
    import pyarrow as pa

    fragment = pa.struct([("text", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("height", pa.float64())])
    kind = files.schema["position"].dataType.simpleString()

    def one(content: bytes | None) -> tuple[str | None, list | None]:
        try:
            if content is None:
                raise ValueError("file not found")
            return None, [[dict(zip(("text", "x", "y", "height"), f, strict=True)) for f in page] for page in parse(content)]
        except Exception as e:  # noqa: BLE001  whatever a parser raises is that file's error
            return str(e) or type(e).__name__, None

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # a large file by itself, small ones together
                done, size, first = [], 0, at
                while at < batch.num_rows and (not done or size < TOGETHER):
                    content = batch.column("content")[at].as_py()
                    done.append(one(content))
                    size += len(content or b"") + 1
                    at += 1
                rows = batch.slice(first, at - first)
                errors, pages = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays([rows.column("position"), rows.column("name"), pa.array(errors, pa.string()), pa.array(pages, pa.list_(pa.list_(fragment)))], names=["position", "name", "error", "pages"])

    return files.select("position", "name", "content").mapInArrow(run, f"position {kind}, name string, error string, pages array<array<{FRAGMENT}>>")


def fragments(parsed: DataFrame) -> DataFrame:
    """position, page_no from 1, ord, text, x, y, height of all good files."""
    pages = parsed.where("error is null").select("position", F.posexplode("pages").alias("p", "page"))
    return pages.select("position", (F.col("p") + 1).alias("page_no"), F.posexplode("page").alias("ord", "f")).select("position", "page_no", "ord", "f.*")


def failures(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select("position", "name", "error")


def chapters(parsed: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """A chapter for each good file, in their order, with or without text: position, title, pages, fragments, empty.

    titles(position, title) name chapters by position; a blank or missing one leaves the file's name without its ending."""
    good = parsed.where("error is null").select("position", "name", F.size("pages").alias("pages"), F.aggregate("pages", F.lit(0), lambda a, p: a + F.size(p)).alias("fragments"))
    if titles is None:
        title = without_extension(F.col("name"))
    else:
        good = good.join(titles.select("position", js.trim(F.col("title")).alias("_t")), "position", "left")
        title = F.coalesce(F.nullif("_t", F.lit("")), without_extension(F.col("name")))
    return good.select("position", title.alias("title"), "pages", "fragments", (F.col("fragments") == 0).alias("empty"))


def counters(parsed: DataFrame) -> DataFrame:
    """One row: files, failures, pages, chapters without text."""
    blank = F.aggregate("pages", F.lit(0), lambda a, p: a + F.size(p)) == 0
    return parsed.agg(F.count("*").alias("files"), F.count("error").alias("failures"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.size("pages"))), F.lit(0)).alias("pages"), F.count_if(F.col("error").isNull() & blank).alias("empty"))


def readable(parsed: DataFrame) -> DataFrame:
    """parsed, after a check on the driver that one file at least could be read; the error names the first five that couldn't."""
    if parsed.where("error is null").limit(1).count():
        return parsed
    why = [f"{r['name']}: {r['error']}" for r in failures(parsed).orderBy("position").limit(5).collect()]
    raise ValueError("None of the files could be read." + (f" ({'; '.join(why)})" if why else ""))


def joined_pages(parsed: DataFrame) -> DataFrame:
    """position, page_no and `page`, its number from 1 among the pages of all good files in their order. Pages before a
    file are summed within ranges of positions and over ranges, so no task sees all files."""
    from folio.operators.islands import running_sum

    files = parsed.where("error is null").select("position", F.size("pages").cast("long").alias("n"))
    before = running_sum(files, "n", [], "position").select("position", (F.col("running") - F.col("n")).alias("_before"), "n")
    numbered = before.where("n > 0").select("position", "_before", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("page_no"))
    return numbered.select("position", F.col("page_no").cast("int").alias("page_no"), (F.col("_before") + F.col("page_no")).alias("page"))


def milestone(done: Column, every: int = 10) -> Column:
    """Whether the done-th file ends a group of `every`."""
    return (done > 0) & (done % every == 0)


def brief_failures(failed: DataFrame) -> DataFrame:
    """One row: the names of what failed, five and how many more."""
    return failed.agg(brief_list(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"])).alias("names"))
