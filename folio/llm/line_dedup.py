"""Line dedup with content-defined chunks of lines.

A rolling hash over the hashes of the last two lines chooses where chunks of lines end, so inserted or deleted lines move
only the boundaries beside them. A line of LONG_WORDS words or more is a chunk by itself. A chunk of two lines or more,
or of LONG_WORDS words or more, that stands in more than one place of the whole table is removed everywhere but at its
first place, by (doc_id, line). Chunks meet by their bytes; only contents that
occur more than `hot` times find the first place of all salts by their SHA-256.

Chunks miss passages that their boundaries cut elsewhere. `dedup_runs` therefore also removes each run of lines of LONG_WORDS
words or more in all that stands at an earlier place, wherever boundaries fall. Such a run is the union of the shortest runs
of LONG_WORDS words from each of its lines on and back from each of its lines (`short_runs`). Where these end depends on their
own lines only, so they meet by one join, without chains of neighbours. They count as equal by a 128-bit BLAKE2b digest.
The earliest place is kept, and so is what overlaps with it; lines without a word at the ends of a run stay.

All chunks go through one shuffle by content and one back to their documents. Contents that occur more than `hot` times
(counted by hash beforehand with partial sums; at most MAX_HOT by that bound) are spread over SALTS tasks by doc_id, and
their first places are found by a partial minimum.

Defined results: null text counts as empty; a text is split at \\n only, and what is kept is joined with \\n;
chunks without a word are never removed; null doc_id comes last; of rows alike in doc_id and text one is first; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import table, text_bytes

DIVISOR = 4
LONG_WORDS = 50
HOT = 1000
MAX_HOT = 4096
SALTS = 64
_MASK = (1 << 64) - 1


def split_chunks(text: bytes, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> list[tuple[int, int, int, bytes]]:
    """(first line, lines, words, bytes) of the chunks of a text."""
    import xxhash

    out, start, at, before, words = [], 0, 0, 0, 0
    lines = text.split(b"\n")
    begin = 0  # byte where the chunk begins
    for i, line in enumerate(lines):
        n = len(line.split())
        if n >= long_words and i > start:
            out.append((start, i - start, words, text[begin : at - 1]))
            start, begin, words = i, at, 0
        h = xxhash.xxh3_64_intdigest(line)
        rolled = (before * 0x9E3779B97F4A7C15 + h) & _MASK
        rolled = ((rolled ^ (rolled >> 29)) * 0xBF58476D1CE4E5B9 & _MASK) >> 32
        before = h
        words += n
        at += len(line) + 1
        if n >= long_words or rolled % divisor == 0 or i + 1 == len(lines):
            out.append((start, i + 1 - start, words, text[begin : at - 1]))
            start, begin, words = i + 1, at, 0
    return out


def numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")


def chunks(docs: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """_row, of (hash of the text), doc_id, first_line, n_lines, removable, chunk for each chunk of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = text_bytes(batch.column("text"))
                made = [split_chunks(x, divisor, long_words) for x in texts]
                of = pa.array([xxhash.xxh3_64_intdigest(x) for x in texts], pa.uint64()).view(pa.int64())
                parent = pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]))
                flat = [c for m in made for c in m]
                removable = [w > 0 and (n > 1 or w >= long_words) for _, n, w, _ in flat]
                first, lines = (np.array([c[i] for c in flat], np.int32) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column("_row").take(parent), of.take(parent), batch.column("doc_id").take(parent), pa.array(first), pa.array(lines), pa.array(removable, pa.bool_()), pa.array([c[3] for c in flat], pa.binary()).cast("string")], names=["_row", "of", "doc_id", "first_line", "n_lines", "removable", "chunk"])

    rows = numbered(docs)
    return rows.mapInArrow(run, f"_row long, of long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, first_line int, n_lines int, removable boolean, chunk string")


def chunk_hashes(docs: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """h, what xxhash64 gives in Spark, of each removable chunk of docs(doc_id, text), without the chunks themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            found = [xxhash.xxh64_intdigest(c, 42) for x in text_bytes(batch.column("text")) for _, n, w, c in split_chunks(x, divisor, long_words) if w > 0 and (n > 1 or w >= long_words)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.uint64()).view(pa.int64())], names=["h"])

    return docs.select("text").mapInArrow(run, "h long")


def short_runs(text: bytes, long_words: int = LONG_WORDS) -> list[tuple[int, int, bytes]]:
    """(first line, lines, digest) of the shortest runs of two lines or more that have long_words words, forward from each
    line with a word and back from each. Runs of one line are chunks."""
    lines = text.split(b"\n")
    words = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
    sums, at = np.zeros(len(lines) + 1, np.int64), np.zeros(len(lines) + 1, np.int64)
    np.cumsum(words, out=sums[1:])
    if len(lines) < 2 or sums[-1] < long_words:
        return []
    np.cumsum([len(x) + 1 for x in lines], out=at[1:])
    own = np.flatnonzero(words)
    ends, starts = np.searchsorted(sums, sums[own] + long_words), np.searchsorted(sums, sums[own + 1] - long_words, "right") - 1
    spans = {*zip(own.tolist(), ends.tolist()), *zip(starts.tolist(), (own + 1).tolist())}
    return [(a, b - a, blake2b(text[at[a] : at[b] - 1], digest_size=16).digest()) for a, b in sorted(spans) if a >= 0 and b <= len(lines) and b - a > 1]


def repeated_runs(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """_row, of (hash of the text), runs (first_line, n_lines) of each row of docs(_row, doc_id, text) with short runs that
    also stand at an earlier place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = text_bytes(batch.column("text"))
                made = [short_runs(x, long_words) for x in texts]
                parent = pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]))
                flat = [c for m in made for c in m]
                of = pa.array([xxhash.xxh3_64_intdigest(x) for x in texts], pa.uint64()).view(pa.int64())
                first, lines = (pa.array([c[i] for c in flat], pa.int32()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column("_row").take(parent), batch.column("doc_id").take(parent), of.take(parent), first, lines, pa.array([c[2] for c in flat], pa.binary())], names=["_row", "doc_id", "of", "first_line", "n_lines", "digest"])

    spans = docs.mapInArrow(run, f"_row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, of long, first_line int, n_lines int, digest binary").where("_row is not null and digest is not null").repartition("digest")
    # Both sides use all columns and have the filters that joins add, so that they are one exchange and texts are read once
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_row").alias("r"), F.col("first_line").alias("l"), F.col("n_lines").alias("k"), F.col("of").alias("o"))
    firsts = spans.groupBy("digest").agg(F.min(place).alias("a"), F.count("*").alias("m")).where("m > 1").drop("m")
    overlaps = (F.col("a.r") == F.col("_row")) & F.col("a.d").eqNullSafe(F.col("doc_id")) & (F.col("first_line") < F.col("a.l") + F.col("n_lines"))
    return spans.join(firsts, "digest").where(~overlaps).groupBy("_row").agg(F.first("of").alias("of"), F.sort_array(F.collect_list(F.struct("first_line", "n_lines"))).alias("runs"))


def _without(first: np.ndarray, lines: np.ndarray, kept: np.ndarray, texts: list[str | None], runs: list[dict]) -> tuple[list[tuple[int, int]], str]:
    """Removed spans of lines, as long as can be, and the text that is left of the chunks of a row."""
    ends = first + lines
    edge = np.zeros(int(ends[-1]) + 1, np.int32)  # +1 where something removed begins, -1 behind it
    edge[first[~kept]] += 1
    np.subtract.at(edge, ends[~kept], 1)
    for x in runs:
        edge[x["first_line"]] += 1
        edge[x["first_line"] + x["n_lines"]] -= 1
    gone = np.cumsum(edge) > 0
    edges = np.flatnonzero(np.diff(gone, prepend=False))
    before = np.concatenate([[0], np.cumsum(gone)])
    own = before[ends] - before[first]
    left = []
    for i in np.flatnonzero(kept & (own < lines)).tolist():
        if own[i]:
            left.append("\n".join(x for x, g in zip(texts[i].split("\n"), gone[first[i] : ends[i]]) if not g))
        else:
            left.append(texts[i])
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist())), "\n".join(left)


def _pieces(docs: DataFrame, divisor: int, long_words: int, hot: int) -> DataFrame:
    """_row, of, doc_id and p, the chunks in their order (first_line, n_lines, kept, chunk if kept), for every row."""
    parts = chunks(docs, divisor, long_words)
    h = F.xxhash64("chunk")
    often = chunk_hashes(docs, divisor, long_words).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    hashes = [r["h"] for r in often.orderBy(F.desc("n"), "h").limit(MAX_HOT).collect()]
    is_hot = F.col("removable") & h.isin(hashes) if hashes else F.lit(False)
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("first_line").alias("l"))
    salt = F.when(~F.col("removable"), F.xxhash64("_row", "first_line")).when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    here = Window.partitionBy("chunk", "_salt").orderBy(F.col("doc_id").asc_nulls_last(), "_row", "first_line")
    kept = (F.row_number().over(here) == 1) | ~F.col("removable")
    named = parts.withColumn("_salt", salt).withColumn("_kept", kept)
    if hashes:
        firsts = parts.where(is_hot).groupBy("chunk").agg(F.min(place).alias("_first")).select(F.sha2("chunk", 256).alias("_sha"), "_first")
        named = named.withColumn("_sha", F.when(is_hot, F.sha2("chunk", 256))).join(F.broadcast(firsts), "_sha", "left")
        named = named.withColumn("_kept", F.col("_kept") & (F.col("_first").isNull() | (F.col("_first") == place))).drop("_sha", "_first")
    piece = F.struct("first_line", "n_lines", F.col("_kept").alias("kept"), F.when(F.col("_kept"), F.col("chunk")).alias("chunk"))
    return named.groupBy("_row").agg(F.first("of").alias("of"), F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(piece)).alias("p"))


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS, hot: int = HOT) -> DataFrame:
    """doc_id, n_lines, n_chunks, removed_lines, removed (spans of lines, the last one included), text for every row."""
    whole = _pieces(docs, divisor, long_words, hot)
    gone = F.filter("p", lambda x: ~x["kept"])
    return whole.select(
        "doc_id",
        F.aggregate("p", F.lit(0), lambda a, x: a + x["n_lines"]).alias("n_lines"),
        F.size("p").alias("n_chunks"),
        F.aggregate(gone, F.lit(0), lambda a, x: a + x["n_lines"]).alias("removed_lines"),
        F.transform(gone, lambda x: F.struct(x["first_line"].alias("first"), (x["first_line"] + x["n_lines"] - 1).alias("last"))).alias("removed"),
        F.array_join(F.transform(F.filter("p", lambda x: x["kept"]), lambda x: x["chunk"]), "\n").alias("text"),
    )


def dedup_runs(docs: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS, hot: int = HOT) -> DataFrame:
    """The columns of dedup_lines, without repeated chunks and without repeated runs of long_words words; removed spans are as
    long as can be."""
    whole = _pieces(docs, divisor, long_words, hot)
    found = repeated_runs(numbered(docs), long_words).withColumnRenamed("of", "seen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        kind = pa.struct([("first", pa.int32()), ("last", pa.int32())])
        for all_rows in batches:
            for at in range(0, all_rows.num_rows, 100):
                batch = all_rows.slice(at, 100)
                of, seen = batch.column("of"), batch.column("seen")
                if pc.any(pc.not_equal(of, seen)).as_py():
                    raise RuntimeError("The table's rows came in another order when they were read again")
                p = batch.column("p")
                bounds, flat = p.offsets.to_numpy() - p.offsets[0].as_py(), p.flatten()
                first, lines, kept = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("first_line", "n_lines", "kept"))
                total = np.concatenate([[0], np.cumsum(lines)])[bounds]
                lost = np.concatenate([[0], np.cumsum(~kept)])[bounds]
                # Rows that lose nothing are joined as they are; a chunk that is not kept is null, and so is its row
                whole_texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat.field("chunk")), "\n")
                hit = (np.diff(lost) > 0) | batch.column("runs").is_valid().to_numpy(zero_copy_only=False)
                removed_lines, counts, removed, texts = np.zeros(len(hit), np.int32), np.zeros(len(hit) + 1, np.int32), [], []
                for i in np.flatnonzero(hit).tolist():
                    a, b = int(bounds[i]), int(bounds[i + 1])
                    spans, left = _without(first[a:b], lines[a:b], kept[a:b], flat.field("chunk").slice(a, b - a).to_pylist(), batch.column("runs")[i].as_py() or [])
                    removed_lines[i], counts[i + 1] = sum(y - x + 1 for x, y in spans), len(spans)
                    removed += spans
                    texts.append(left)
                spans = pa.StructArray.from_arrays([pa.array([x[k] for x in removed], pa.int32()) for k in (0, 1)], fields=list(kind))
                columns = [pa.array(np.diff(total).astype(np.int32)), pa.array(np.diff(bounds).astype(np.int32)), pa.array(removed_lines), pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), spans)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pc.replace_with_mask(whole_texts, pa.array(hit), pa.array(texts, pa.string()))], names=["doc_id", "n_lines", "n_chunks", "removed_lines", "removed", "text"])

    kind = whole.schema["doc_id"].dataType.simpleString()
    joined = whole.join(found, "_row", "left").select("doc_id", "of", "seen", "p", "runs")
    return joined.mapInArrow(run, f"doc_id {kind}, n_lines int, n_chunks int, removed_lines int, removed array<struct<first: int, last: int>>, text string")


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_runs(table(spark, sf_dir, "documents"))
    return out.withColumns({"n_chars": F.char_length("text"), "text_sha256": F.sha2("text", 256)}).drop("text")
