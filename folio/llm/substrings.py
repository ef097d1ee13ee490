"""Substring dedup: words in passages of WINDOW words that stand anywhere else go, by a compacted De Bruijn graph.

The edges of the graph are the windows of WINDOW words, its nodes the runs of a word less; of the edges, those matter that
occur twice or more.

1. Documents are put into chunks of CHUNK_BYTES of text, or one longer document, once (`chunked`); a chunk is a row, whose
   texts are compressed as one, since they go through two exchanges.
2. Each window names the smallest hash of its runs of SEED words, mixed again: smallest hashes are small, and buckets are ranges.
   Equal windows name the same one, so only windows whose seed occurs twice can be repeated (`seeds`, `repeated`); the others
   send no edge.
3. Edges meet in buckets by their hash, one entry a chunk however often it has them, with the hash of the word that always
   follows and the one that always precedes, or 0 where that differs or the document ends (`edges`). What a bucket tells of
   an edge, whether it is repeated and has one successor and one predecessor only, is joined back to the chunks (`degrees`).
4. Neighbouring edges of a document that have only each other as successor and predecessor are one path: it doesn't branch
   anywhere in the corpus, so all its occurrences have all its edges, and it is one row of its first edge, its length and
   the source coordinates (`spans`).
5. Occurrences of a path are joined by the words that they cover. A path whose words stand in two places or more is verified.
   Hashes of different windows that are equal would leave an occurrence without a partner; the windows of such occurrences
   are compared word by word with all windows of the same hash, and the chunks concerned are done again (`corrections`).

A seed or an edge is sent once by a chunk, so a passage of a third of all documents is at most as many entries of a bucket as
there are chunks; buckets are as many as keep them at BUCKET_BYTES on average, those of edges by the share of seeds that are
repeated. Tasks hold one chunk or one bucket.

Defined results: null text has no words; texts of fewer than WINDOW words lose none; overlapping occurrences in one document
count as two places; rows of equal doc_id are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import Words, cut, mix, release, sub_batches, table, text_bytes

WINDOW = 35
SEED = 12
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
HASH_BYTES = 1 << 19
PACK_LEVEL = 6
_BASE = 0x9E3779B97F4A7C15
_AS_IS = np.arange(256, dtype=np.uint8)
REPEATED, ONE_NEXT, ONE_PREVIOUS = np.uint8(1), np.uint8(2), np.uint8(4)


def packed(texts: list[bytes]) -> bytes:
    raw = b"".join([np.array([len(texts), *map(len, texts)], np.int64).tobytes(), *texts])
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", PACK_LEVEL).compress(raw, asbytes=True)


def unpacked(pack: bytes) -> list[bytes]:
    raw = pa.decompress(memoryview(pack)[8:], int.from_bytes(pack[:8], "little"), "zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(raw, np.int64, n + 1) * (np.arange(n + 1) > 0))
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def chunked(docs: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    """chunk, doc_ids, texts (packed): docs(doc_id, text) in rows of `most` bytes, written once so that they stay as they are."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        texts: list[bytes] = []
        size, id_type = 0, None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part + seq]), pa.array([ids], pa.list_(id_type)), pa.array([packed(texts)], pa.binary())], names=["chunk", "doc_ids", "texts"])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += len(text) + 16
                if size >= most:
                    yield flush()
                    seq, ids, texts, size = seq + 1, [], [], 0
        if ids:
            yield flush()

    return cut(docs.select("doc_id", "text").mapInArrow(run, f"chunk long, doc_ids array<{kind}>, texts binary"))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of each run of k of h, from those of runs of 1, 2, 4, ..."""
    out, have, power, size = None, 0, h, 1
    while k:
        if k & 1:
            times = np.uint64(pow(_BASE, size, 1 << 64))
            out = power if out is None else out[: len(power) - have] * times + power[have:]
            have += size
        k >>= 1
        if k:
            power = power[: max(0, len(power) - size)] * np.uint64(pow(_BASE, size, 1 << 64)) + power[size:]
            size *= 2
    return mix(out)


def least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours in x."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[: max(0, len(x) - size)], x[size:])
        size *= 2
    return np.minimum(x[: max(0, len(x) - n + size)], x[n - size :])


class Windows:
    """The windows of a chunk: at: their first words among all of the chunk; doc: the document of each word; bounds: where the
    words of each document begin."""

    def __init__(self, texts: list[bytes], window: int, seed: int, mask: int) -> None:
        self.texts = texts
        hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        # Hashing takes some fifty times the bytes that it is given
        for a, b in sub_batches(np.fromiter(map(len, texts), np.int64, len(texts)), HASH_BYTES):
            words = Words(texts[a:b], letters=_AS_IS)
            hashes.append(words.hashes)
            counts.append(np.diff(words.bounds))
        self.hashes, counts = np.concatenate(hashes), np.concatenate(counts)
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.size = window
        i = np.arange(max(0, len(self.doc) - window + 1))
        self.at = i[self.doc[i] == self.doc[i + window - 1]]
        self.seed, self.mask = seed, np.uint64(mask)

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all runs of seed words, and the one that each window names."""
        if not len(self.at):
            return (np.empty(0, np.uint64),) * 2
        runs = run_hashes(self.hashes, self.seed)
        return mix(runs), mix(least(runs, self.size - self.seed + 1)[self.at])

    def edges(self, some: np.ndarray) -> np.ndarray:
        """Hashes of windows that begin at the words `some`."""
        return run_hashes(self.hashes, self.size)[some] & self.mask if len(some) else np.empty(0, np.uint64)

    def beside(self, some: np.ndarray, step: int) -> np.ndarray:
        """A hash of the word after (step 1) or before (step -1) each window, 0 where its document ends."""
        at = some + (self.size if step > 0 else -1)
        inside = np.clip(at, 0, len(self.doc) - 1)
        same = (at == inside) & (self.doc[inside] == self.doc[some])
        return np.where(same, (self.hashes[inside] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))


def buckets_of(values: np.ndarray, n: int) -> np.ndarray:
    """Ascending with values, so that what buckets return is in the order of the values."""
    return ((values >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def grouped(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.empty(0, np.int64)


def _sent(chunk: int, n: int, values: np.ndarray, *columns: np.ndarray) -> dict[str, list]:
    """A row for each bucket with a part of values (ascending) and of what belongs to them."""
    bucket = buckets_of(values, n)
    first = grouped(bucket)
    ends = np.r_[first[1:], len(values)] if len(first) else first
    rows = {"bucket": bucket[first].tolist(), "chunk": [chunk] * len(first), "hashes": [values[a:b].tobytes() for a, b in zip(first, ends, strict=True)]}
    return rows | {f"x{i}": [c[a:b].tobytes() for a, b in zip(first, ends, strict=True)] for i, c in enumerate(columns)}


def _schema(n: int) -> pa.Schema:
    return pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), *[(f"x{i}", pa.binary()) for i in range(n)]])


def seeds(chunks: DataFrame, n: int, window: int, seed: int) -> DataFrame:
    """bucket, chunk, hashes, x0: the seeds that a chunk's windows name, and whether it has them twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, texts in zip(batch.column("chunk").to_pylist(), batch.column("texts"), strict=True):
                w = Windows(unpacked(texts.as_py()), window, seed, 0)
                runs, named = w.seeds()
                every, counts = np.unique(runs, return_counts=True)
                own = np.unique(named)
                twice = counts[np.searchsorted(every, own)] > 1
                yield pa.RecordBatch.from_pydict(_sent(chunk, n, own, twice), _schema(1))
                release()

    return chunks.select("chunk", "texts").mapInArrow(run, "bucket long, chunk long, hashes binary, x0 binary")


def repeated(sent: DataFrame) -> DataFrame:
    """chunk, bucket, flags: a byte for each hash of sent(bucket, chunk, hashes, x0): 1 if it is sent twice or x0 says so."""

    def run(rows: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
        twice = np.concatenate([np.frombuffer(x, np.uint8) for x in rows.column("x0").to_pylist()])
        _, inverse, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        return _told(rows, hashes, ((counts[inverse] > 1) | (twice > 0)).astype(np.uint8))

    return sent.groupBy("bucket").applyInArrow(run, _TOLD)


_TOLD = "chunk long, bucket long, flags binary, wrong array<long>"


def _told(rows: pa.Table, hashes: list[np.ndarray], flags: np.ndarray) -> pa.Table:
    ends = np.cumsum([len(x) for x in hashes])
    parts = [flags[b - len(x) : b].tobytes() for x, b in zip(hashes, ends, strict=True)]
    release()
    return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "flags": pa.array(parts, pa.binary()), "wrong": pa.nulls(len(parts), pa.list_(pa.int64()))})


def _flags(told: pa.Table) -> np.ndarray:
    told = told.filter(pc.greater_equal(told.column("bucket"), 0)).sort_by("bucket")
    return np.frombuffer(b"".join(told.column("flags").to_pylist()), np.uint8)


def _wrong(told: pa.Table) -> np.ndarray:
    """First words of windows that are no repetition though their hashes are."""
    rows = [x for x in told.column("wrong").to_pylist() if x]
    return np.array([i for x in rows for i in x], np.int64)


def _candidates(w: Windows, flags: np.ndarray) -> np.ndarray:
    """First words of the windows whose seed is repeated; flags are those of the chunk's seeds."""
    _, named = w.seeds()
    own, inverse = np.unique(named, return_inverse=True)
    assert len(own) == len(flags), "the chunk's seeds have changed"
    return w.at[flags[inverse] > 0] if len(own) else w.at


def edges(chunks: DataFrame, told: DataFrame, n: int, window: int, seed: int, mask: int) -> DataFrame:
    """bucket, chunk, hashes, x0 to x2: a chunk's distinct edges that can be repeated, whether it has them twice, and the
    hashes of the words that always follow and precede."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _schema(3).empty_table()
        w = Windows(unpacked(left.column("texts")[0].as_py()), window, seed, mask)
        some = _candidates(w, _flags(right))
        values = w.edges(some)
        order = np.argsort(values, kind="stable")
        first = grouped(values[order])
        counts = np.diff(np.r_[first, len(values)])
        beside = []
        for step in (1, -1):
            x = w.beside(some, step)[order]
            low, high = (f.reduceat(x, first) if len(x) else x for f in (np.minimum, np.maximum))
            beside.append(np.where(low == high, low, np.uint32(0)))
        out = pa.Table.from_pydict(_sent(left.column("chunk")[0].as_py(), n, values[order][first], counts > 1, *beside), _schema(3))
        release()
        return out

    return chunks.select("chunk", "texts").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, "bucket long, chunk long, hashes binary, x0 binary, x1 binary, x2 binary")


def degrees(sent: DataFrame) -> DataFrame:
    """chunk, bucket, flags: of each edge sent, REPEATED, and then ONE_NEXT and ONE_PREVIOUS if that holds in all chunks."""

    def run(rows: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
        twice, after, before = (np.concatenate([np.frombuffer(x, t) for x in rows.column(c).to_pylist()]) for c, t in (("x0", np.uint8), ("x1", np.uint32), ("x2", np.uint32)))
        values = np.concatenate(hashes)
        order = np.argsort(values, kind="stable")
        first = grouped(values[order])
        counts = np.add.reduceat(twice[order].astype(np.int64) + 1, first)
        flags = np.where(counts > 1, REPEATED, np.uint8(0))
        for x, bit in ((after[order], ONE_NEXT), (before[order], ONE_PREVIOUS)):
            low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
            flags |= np.where((counts > 1) & (low == high) & (low > 0), bit, np.uint8(0))
        out = np.empty(len(values), np.uint8)
        out[order] = np.repeat(flags, np.diff(np.r_[first, len(values)]))
        return _told(rows, hashes, out)

    return sent.groupBy("bucket").applyInArrow(run, _TOLD)


def _paths(w: Windows, seen: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first words, the numbers of windows and the first edges of the chunk's paths, and all its repeated windows; seen:
    first words of the windows that sent an edge."""
    values = w.edges(seen)
    own, inverse = np.unique(values, return_inverse=True)
    assert len(own) == len(flags), "the chunk's edges have changed"
    flag = flags[inverse] if len(own) else np.empty(0, np.uint8)
    hold = flag & REPEATED > 0
    at, values, flag = seen[hold], values[hold], flag[hold]
    if not len(at):
        return at, at, values, at
    linked = (np.diff(at) == 1) & (w.doc[at[1:]] == w.doc[at[:-1]]) & (flag[:-1] & ONE_NEXT > 0) & (flag[1:] & ONE_PREVIOUS > 0)
    first = np.flatnonzero(np.r_[True, ~linked])
    return at[first], np.diff(np.r_[first, len(at)]), values[first], at


_SPANS = "chunk long, first long, windows int, words binary, places array<long>, doc_id {}, n_words long, n_removed long, kept_sha256 string"


def spans(chunks: DataFrame, seeds_told: DataFrame, edges_told: DataFrame, window: int, seed: int, mask: int) -> DataFrame:
    """Rows of paths, whose `first` (edge) isn't null: their number of windows, the words that they cover and the first words
    of their occurrences in the chunk; and rows of documents, without the words of windows that are repeated by hash and not
    listed as wrong."""
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: [] for c in names}).cast(pa.schema([(c, t) for c, t in zip(names, [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)]))
        chunk = left.column("chunk")[0].as_py()
        w = Windows(unpacked(left.column("texts")[0].as_py()), window, seed, mask)
        of_edges = pc.equal(right.column("kind"), "edge")
        seen = _candidates(w, _flags(right.filter(pc.invert(of_edges))))
        starts, lengths, firsts, at = _paths(w, seen, _flags(right.filter(of_edges)))
        gone = np.zeros(len(w.doc) + 1, np.int64)
        at = np.setdiff1d(at, _wrong(right))
        np.add.at(gone, at, 1)
        np.add.at(gone, np.minimum(at + window, len(w.doc)), -1)
        gone = np.cumsum(gone[:-1]) > 0
        found: dict[tuple, list[int]] = defaultdict(list)
        docs: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": []}
        path_of = np.searchsorted(starts, w.bounds)
        for i, text in enumerate(w.texts):
            words = text.split()
            a, b = int(w.bounds[i]), int(w.bounds[i + 1])
            lost = gone[a:b]
            kept = b" ".join([x for x, y in zip(words, lost.tolist(), strict=True) if not y] if lost.any() else words)
            docs["n_words"].append(b - a)
            docs["n_removed"].append(int(lost.sum()))
            docs["kept_sha256"].append(sha256(kept).hexdigest())
            for p in range(path_of[i], path_of[i + 1]):
                s, n = int(starts[p]), int(lengths[p])
                found[int(firsts[p].view(np.int64)), n, b" ".join(words[s - a : s - a + n + window - 1])].append(s)
        paths, n = list(found), len(w.texts)
        columns = {
            "chunk": pa.array([chunk] * (len(paths) + n), pa.int64()),
            "first": pa.array([*(x[0] for x in paths), *[None] * n], pa.int64()),
            "windows": pa.array([*(x[1] for x in paths), *[None] * n], pa.int32()),
            "words": pa.array([*(x[2] for x in paths), *[None] * n], pa.binary()),
            "places": pa.array([*found.values(), *[None] * n], pa.list_(pa.int64())),
        }
        none = len(paths)
        ids = left.column("doc_ids")[0].values
        columns["doc_id"] = pa.concat_arrays([pa.nulls(none, ids.type), ids])
        columns |= {c: pa.concat_arrays([pa.nulls(none, t), pa.array(docs[c], t)]) for c, t in (("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()))}
        out = pa.table(columns)
        release()
        return out

    names = ["chunk", "first", "windows", "words", "places", "doc_id", "n_words", "n_removed", "kept_sha256"]
    told = seeds_told.withColumn("kind", F.lit("seed")).unionByName(edges_told.withColumn("kind", F.lit("edge")))
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, _SPANS.format(kind))


def corrections(paths: DataFrame, window: int, mask: int) -> DataFrame | None:
    """chunk, wrong: windows of paths that stand nowhere else although another window has their hash; None if there are none."""
    sums = paths.groupBy("first", "windows", "words").agg(F.sum(F.size("places")).alias("n"))
    alone = cut(sums.where("n < 2").select("first", "windows", "words"))
    if alone.isEmpty():
        return None

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, places in zip(batch.column("chunk").to_pylist(), batch.column("words").to_pylist(), batch.column("places").to_pylist(), strict=True):
                w = Windows([words], window, 1, mask)
                hashes = w.edges(w.at).view(np.int64).tolist()
                own = words.split()
                spelled = [b" ".join(own[i : i + window]) for i in range(len(hashes))]
                for p in places:
                    yield pa.RecordBatch.from_pydict({"chunk": [chunk] * len(own[window - 1 :]), "place": [p + i for i in range(len(hashes))], "edge": hashes, "spelled": pa.array(spelled, pa.binary())})

    schema = "chunk long, place long, edge long, spelled binary"
    doubtful = alone.selectExpr("0L chunk", "words", "array(0L) places").mapInArrow(windows, schema).select("edge").distinct()
    among = cut(paths.select("chunk", "words", "places").mapInArrow(windows, schema).join(doubtful, "edge", "left_semi"))
    single = among.groupBy("edge", "spelled").count().where("count = 1")
    return cut(among.join(single, ["edge", "spelled"], "left_semi").groupBy("chunk").agg(F.collect_list("place").alias("wrong")))


def edge_buckets(seeds_told: DataFrame, text_size: int) -> int:
    """Buckets for edges: an edge takes 17 bytes, and of the words, of some 6 bytes, as many begin one as seeds are repeated."""
    seen = seeds_told.agg(F.expr("sum(length(replace(hex(flags), '0', '')))").alias("twice"), F.sum(F.length("flags")).alias("all")).first()
    return max(1, -(-text_size * 17 * (seen["twice"] or 0) // (6 * BUCKET_BYTES * (seen["all"] or 1))))


def dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, chunk_bytes: int = CHUNK_BYTES, mask: int = (1 << 64) - 1) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs(doc_id, text). mask: bits of a window's hash that are used."""
    seed = min(seed, window)
    chunks = chunked(docs, chunk_bytes)
    size = chunks.count() * chunk_bytes
    # On average a seed is named by a tenth of the words, of some 6 bytes, and takes 9
    seeds_told = cut(repeated(seeds(chunks, max(1, size // (6 * BUCKET_BYTES)), window, seed)))
    edges_told = cut(degrees(edges(chunks, seeds_told, edge_buckets(seeds_told, size), window, seed, mask)))
    made = cut(spans(chunks, seeds_told, edges_told, window, seed, mask))
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    wrong = corrections(made.where("first is not null"), window, mask)
    if wrong is None:
        return made.where("first is null").select(columns)
    some = chunks.join(wrong.select("chunk"), "chunk", "left_semi")
    told = edges_told.unionByName(wrong.selectExpr("chunk", "-1L bucket", "cast(null as binary) flags", "wrong"))
    again = spans(some, seeds_told.join(wrong.select("chunk"), "chunk", "left_semi"), told.join(wrong.select("chunk"), "chunk", "left_semi"), window, seed, mask)
    right = made.where("first is null").join(wrong.select("chunk"), "chunk", "left_anti")
    return right.select(columns).unionByName(again.where("first is null").select(columns))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, w[i] AS word, i, CASE WHEN i + 34 <= len(w) THEN array_to_string(list_slice(w, i, i + 34), ' ') END AS k FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c AS (SELECT r, i, word, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 THEN 1 ELSE 0 END AS rep FROM p),
g AS (SELECT r, i, word, max(rep) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
a AS (SELECT r, sum(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM g GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(a.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a ON a.r = d.r
"""
