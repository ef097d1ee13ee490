"""Token-ID output: files of ids coded by the adaptive context-mixing range coder, and their reader.

Documents are dealt into ranges of ascending doc_id and encoded there; a segment holds whole documents (about
SEGMENT_IDS ids) and stands alone: magic, number of documents, lengths and doc_ids, a checksum of all this, then blocks of
BLOCK_IDS ids, each with its own model, its length, the crc32 of its ids and its coded words. Segments are rows of a Parquet
dataset (part, seq, segment), which any store that Spark writes can hold; a lost reader or writer task is run again alone.

Readers check every checksum and raise an error at the first that fails. Where a document begins among all ids follows
from the sums of parts and segments, of which there is a row each.

Defined results: null text counts as empty and has the end id only; null doc_id comes first; rows alike in doc_id are in
the order of their texts' hashes; an empty table writes no segments; other columns are ignored; doc_id must be an integer.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm import range_codec
from folio.llm.common import released, shared_dir, table

MAGIC = b"FOLIOID1"
SEGMENT_IDS = 1 << 21
END_ID = 2
#: Places in the table of leaves met before, and leaves looked up at once
SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
LEAVES = 500_000
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_NULL = -(1 << 63)


def pack(doc_ids: list[int | None], lengths: list[int], blocks: list[tuple[int, bytes]], sums: list[int]) -> bytes:
    head = MAGIC + struct.pack("<II", len(doc_ids), len(blocks))
    head += np.array([_NULL if d is None else d for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<i8").tobytes()
    parts = [head, struct.pack("<I", zlib.crc32(head))]
    for (n, words), crc in zip(blocks, sums, strict=True):
        parts += [struct.pack("<III", n, crc, len(words)), words]
    return b"".join(parts)


def unpack(segment: bytes) -> tuple[list[int | None], np.ndarray, list[tuple[int, bytes]], list[int]]:
    if segment[:8] != MAGIC:
        raise ValueError("not a token segment")
    docs, count = struct.unpack_from("<II", segment, 8)
    at = 16 + 16 * docs
    if zlib.crc32(segment[:at]) != struct.unpack_from("<I", segment, at)[0]:
        raise ValueError("damaged directory of a token segment")
    ids, lengths = np.frombuffer(segment, "<i8", docs, 16), np.frombuffer(segment, "<i8", docs, 16 + 8 * docs)
    at += 4
    blocks, sums = [], []
    for _ in range(count):
        n, crc, size = struct.unpack_from("<III", segment, at)
        blocks.append((n, segment[at + 12 : at + 12 + size]))
        sums.append(crc)
        at += 12 + size
    return [None if d == _NULL else int(d) for d in ids], lengths, blocks, sums


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of bytes, pairs of classes between which the splitting pattern cuts, and last two bytes (big-endian) of
    characters outside ASCII that are, or may be, white space."""
    kind = np.zeros(256, np.uint8)  # bytes that say nothing by themselves
    kind[list(b"\t\n\x0b\x0c\r ")] = SPACES
    kind[[*range(65, 91), *range(97, 123)]] = LETTERS
    kind[48:58] = DIGITS
    kind[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = SIGNS
    kind[39] = APOSTROPHE
    kind[128:] = WIDE
    cut = np.zeros((7, 7), bool)
    cut[LETTERS:, SPACES] = True
    cut[LETTERS, [DIGITS, SIGNS, APOSTROPHE]] = cut[DIGITS, [LETTERS, SIGNS, APOSTROPHE]] = cut[SIGNS, [LETTERS, DIGITS]] = True
    wide = np.zeros(1 << 16, bool)
    wide[[0xC285, 0xC2A0, 0x9A80, *range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF, 0x819F]] = True
    return kind, cut.ravel(), wide


SPACES, LETTERS, DIGITS, SIGNS, APOSTROPHE, WIDE = range(1, 7)
KIND, CUT, WIDE_SPACE = _classes()
#: What the pattern takes as one piece: a run of one kind and at most one space before it
PIECE = re.compile(rb" ?(?:[A-Za-z]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)").fullmatch
WORD = re.compile(" ?[^\\W\\d_]+").fullmatch


class Known:
    """Ids of leaves of at most 15 bytes, found by their bytes and length as two numbers: a table of open addresses with
    SLOTS places, at most half of them taken."""

    def __init__(self) -> None:
        self.one, self.two = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.place = np.full(SLOTS, -1, np.int32)
        self.count = 0
        self.ids, self.starts = np.zeros(1 << 20, np.uint16), np.zeros(SLOTS // 2 + 1, np.int32)

    @staticmethod
    def slots(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        h = (one ^ (two * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Places of keys, or -1."""
        slot = self.slots(one, two)
        found = self.place.take(slot, mode="wrap")
        left = np.flatnonzero((found >= 0) & ((self.one.take(slot, mode="wrap") != one) | (self.two.take(slot, mode="wrap") != two)))
        slot, one, two = slot[left], one[left], two[left]
        while len(left):
            slot = (slot + 1) & (SLOTS - 1)
            found[left] = place = self.place[slot]
            on = np.flatnonzero((place >= 0) & ((self.one[slot] != one) | (self.two[slot] != two)))
            left, slot, one, two = left[on], slot[on], one[on], two[on]
        return found

    def add(self, one: np.ndarray, two: np.ndarray, ids: list[bytes]) -> None:
        """Keys that differ and aren't there yet."""
        flat = np.frombuffer(b"".join(ids), np.uint16)
        first, n = int(self.starts[self.count]), len(ids)
        if first + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[:first], np.zeros(first + 2 * len(flat), np.uint16)])
        self.ids[first : first + len(flat)] = flat
        self.starts[self.count + 1 : self.count + n + 1] = first + (np.fromiter(map(len, ids), np.int64, n) >> 1).cumsum()
        slot, left = self.slots(one, two), np.arange(n)
        while len(left):
            own = slot[left]
            free = self.place[own] < 0
            self.place[own[free]] = self.count + left[free]
            won = self.place[own] == self.count + left
            self.one[own[won]], self.two[own[won]] = one[left[won]], two[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
        self.count += n


class LeafEncoder:
    """Ids of texts by a byte-level vocabulary of the tokenizers library. Its splitting pattern always cuts between a
    non-space and a space, and between runs of ASCII letters, digits and signs (but for apostrophes, which begin
    contractions), so each leaf between such cuts is encoded by itself, and leaves met before come from a table of bounded
    size, which begins anew when it is full. A leaf that is one piece of the pattern goes to the library's BPE model as it is."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Known()
        #: The byte-level alphabet: printable characters stand for themselves, others for those from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.alphabet = {b: b if b in plain else next(other) for b in range(256)}
        self.space = chr(self.alphabet[32])

    def leaf(self, leaf: bytes) -> bytes:
        if PIECE(leaf):
            mapped = self.space + leaf[1:].decode() if leaf[0] == 32 else leaf.decode()
        else:
            text = leaf.decode()
            # letters before U+0250 are the same in all versions of Unicode in use
            if not (len(text) < len(leaf) and WORD(text) and max(text) < "\u0250"):
                return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids if text else []).tobytes()
            mapped = leaf.decode("latin-1").translate(self.alphabet)
        return array("H", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def leaves(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where leaves of texts begin."""
        kind = KIND[data]
        starts = np.zeros(len(data) + 1, bool)
        starts[1:-1] = CUT[kind[:-1] * np.uint8(7) + kind[1:]]
        wide = np.flatnonzero((kind[:-1] == WIDE) & starts[1:-1]) + 1
        starts[wide] = ~WIDE_SPACE[data[wide - 2].astype(np.uint16) << 8 | data[wide - 1]]
        starts[offsets] = True
        return np.flatnonzero(starts[:-1])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an array of texts, each with the end id behind it, and how many each text has; null is empty."""
        texts = texts.fill_null("").cast(pa.large_binary())
        rare = np.zeros(len(texts), bool)
        for content in self.added:  # these may have rules of their own about what stands around
            rare |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(rare[1:] != rare[:-1]) + 1).tolist(), len(texts)]
        made = [(self.whole if rare[a] else self.plain)(texts.slice(a, b - a)) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]
        return np.concatenate([np.zeros(0, np.uint16), *(x for x, _ in made)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in made)])

    def whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [[*self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, END_ID] for t in texts.to_pylist()]
        return np.array([i for own in ids for i in own], np.uint16), np.array([len(own) for own in ids])

    def plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        if first == last:
            return np.full(len(texts), END_ID, np.uint16), np.ones(len(texts), np.int64)
        raw = texts.buffers()[2].slice(first, last - first).to_pybytes() + bytes(16)
        offsets = offsets - first
        starts = self.leaves(np.frombuffer(raw, np.uint8, last - first), offsets)
        ends = np.append(starts[1:], last - first)
        flat, sizes = [], []
        for i in range(0, len(starts), LEAVES):
            own, n = self.parts(raw, starts[i : i + LEAVES], ends[i : i + LEAVES])
            flat.append(own)
            sizes.append(n)
        before = np.concatenate([[0], np.concatenate(sizes).cumsum()])[np.searchsorted(starts, offsets)]
        lengths = np.diff(before) + 1
        out = np.full(int(before[-1]) + len(lengths), END_ID, np.uint16)
        own = np.ones(len(out), bool)
        own[lengths.cumsum() - 1] = False
        out[own] = np.concatenate(flat)
        return out, lengths

    def parts(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of leaves, at most LEAVES of them, and how many each has."""
        eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        sizes = ends - starts
        long = np.flatnonzero(sizes > 15)
        sizes[long] = 0  # these are put in afterwards
        one = eight[starts] & LOW_BYTES[np.minimum(sizes, 8)]
        two = eight[starts + 8 - 8 * (sizes <= 8)] & LOW_BYTES[np.maximum(sizes - 8, 0)] | sizes.astype(np.uint64) << np.uint64(56)
        found = self.known.find(one, two)
        for again in (True, False):
            missing = np.flatnonzero(found < 0)
            new: dict[bytes, int] = {}
            for i, a, n in zip(missing.tolist(), starts[missing].tolist(), sizes[missing].tolist(), strict=True):
                new.setdefault(raw[a : a + n], i)
            if again and self.known.count + len(new) > SLOTS // 2:
                self.known = Known()
                found[:] = -1
                continue
            at = np.fromiter(new.values(), np.int64, len(new))
            self.known.add(one[at], two[at], [self.leaf(x) for x in new])
            found[missing] = self.known.find(one[missing], two[missing])
            break
        begin = self.known.starts[found].astype(np.int64)
        count = self.known.starts[found + 1] - begin
        ids = self.known.ids
        if len(long):
            own = [self.leaf(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            count[long] = np.fromiter(map(len, own), np.int64, len(own)) >> 1
            used = int(self.known.starts[self.known.count])
            ids = np.concatenate([ids[:used], np.frombuffer(b"".join(own), np.uint16)])
            begin[long] = used + count[long].cumsum() - count[long]
        total = count.cumsum()
        return ids.take(np.repeat(begin - total + count, count) + np.arange(total[-1]), mode="wrap"), count


#: By vocabulary: a worker's tasks share what they have met
_encoders: dict[str, LeafEncoder] = {}


def encoder_of(vocabulary: str) -> LeafEncoder:
    if vocabulary not in _encoders:
        _encoders.clear()
        _encoders[vocabulary] = LeafEncoder(vocabulary)
    return _encoders[vocabulary]


def write(docs: DataFrame, vocabulary: str, path: str) -> None:
    """Writes the ids of docs(doc_id, text) by the tokenizer file `vocabulary` as segments into the folder `path`."""
    with open(vocabulary, encoding="utf-8") as f:
        spelled = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_of(spelled)
        doc_ids, lengths, ids, size, seq = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, lengths, ids, size, seq
            flat = np.concatenate(ids)
            sums = [zlib.crc32(b) for b in range_codec.cuts(flat.astype("<u2"))]
            segment = pack(doc_ids, lengths, range_codec.encode_ids(flat), sums)
            doc_ids, lengths, ids, size, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([seq - 1], pa.int32()), pa.array([segment], pa.binary())], names=["seq", "segment"])

        for batch in released(batches):
            flat, counts = encoder(batch.column("text"))
            own, ends, a = batch.column("doc_id").to_pylist(), counts.cumsum(), 0
            while a < len(own):
                before = int(ends[a - 1]) if a else 0
                b = int(np.searchsorted(ends, before + SEGMENT_IDS - size, "right"))  # those that still fit
                if b == a and size:
                    yield flush()
                    continue
                b = max(b, a + 1)
                doc_ids += own[a:b]
                lengths += counts[a:b].tolist()
                ids.append(flat[before : int(ends[b - 1])])
                size, a = size + len(ids[-1]), b
        if doc_ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    segments = ranged.select("doc_id", "text").mapInArrow(run, "seq int, segment binary")
    segments.select(F.spark_partition_id().alias("part"), "seq", "segment").write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, at (place in the segment), doc_id, before (ids before it in the segment), ids (with the end id), for every
    document in the files; blocks that don't have their checksum raise an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, lengths, blocks, sums = unpack(batch.column("segment")[k].as_py())
                own = range_codec.decode_ids(blocks)
                if any(zlib.crc32(b.astype("<u2")) != c for b, c in zip(own, sums, strict=True)):
                    raise ValueError("damaged block of a token segment")
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                values = pa.array(np.concatenate(own).astype(np.int32))
                n = len(ids)
                part, seq = (pa.array([batch.column(c)[k].as_py()] * n, pa.int32()) for c in ("part", "seq"))
                yield pa.RecordBatch.from_arrays([part, seq, pa.array(np.arange(n, dtype=np.int32)), pa.array(ids, pa.int64()), pa.array(offsets[:-1].astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)], names=["part", "seq", "at", "doc_id", "before", "ids"])

    rows = spark.read.schema("part int, seq int, segment binary").parquet(path)
    return rows.mapInArrow(run, "part int, seq int, at int, doc_id long, before long, ids array<int>")


def with_checksum(rows: DataFrame) -> DataFrame:
    """rows of read() with n_tokens and ids_crc32, of the ids as little-endian unsigned 32-bit integers, in place of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "seq", "doc_id", "before")), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], names=["part", "seq", "doc_id", "before", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "part int, seq int, doc_id long, before long, n_tokens long, ids_crc32 long")


def with_starts(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from rows with part, seq, before: a segment's start is the sum of those before
    it, parts first (a row each), then segments within their part."""
    sizes = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("part", before.alias("part_start"))
    segments = sizes.select("part", "seq", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("in_part")).join(F.broadcast(starts), "part")
    found = rows.join(segments, ["part", "seq"])
    return found.select("doc_id", (F.col("part_start") + F.col("in_part") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op8_context_mixing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from folio.llm.common import cut

    path = shared_dir(spark)
    write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return with_starts(cut(with_checksum(read(spark, path))))
