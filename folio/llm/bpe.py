"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is an element of a monoid: its leaves (a run of white space and the run of other characters after it) with their
token ids. `encode_text` halves a text down to blocks and joins neighbours. A cut between a non-space and a space is
stable whatever stands around it: no match of the pattern goes over it, and none before it looks beyond it. A join grows
its window from the cut to the nearest stable cut on each side, splits only the window again, and keeps all else.
Each piece (one match of the pattern) of each leaf is halved in turn, down to PIECE_BYTES bytes. A join re-encodes a window of tokens
that grows until both tokens at its rims are compatible with their outer neighbours, that is, the pair encodes to itself;
an encoding in which every adjacent pair is compatible is the encoding of the whole, so tokens outside can't change.
Nodes met before (short runs of bytes, leaves) come from caches of bounded size. No library encodes anything here.
Decoding concatenates the bytes of the ids up the tree, which for whole columns is one gather.

Defined results: null text counts as empty and has no ids; ids outside the vocabulary raise an error when decoded; other
columns are passed through by encode() and decode() if no name clashes with the new column, which else is replaced.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import released, table

BLOCK_CHARS = 8192
PIECE_BYTES = 4
CACHED = 300_000
CACHED_BYTES = 16

#: White space as the pattern's \s has it (Unicode White_Space).
WS = "\t-\r \x85\xa0  -     　"
LEAVES = re.compile(f"[{WS}]*[^{WS}]+|[{WS}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Cache(dict):
    """The last `most` to 2 * `most` entries: when full, it becomes the older half, where entries are still found."""

    def __init__(self, most: int = CACHED) -> None:
        super().__init__()
        self.most, self.older = most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value


class TreeEncoder:
    """Encodes texts by the ranks of one vocabulary and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, block_chars: int = BLOCK_CHARS, piece_bytes: int = PIECE_BYTES) -> None:
        import regex

        self.ranks, self.bytes_of = ranks, {v: k for k, v in ranks.items()}
        self.none = max(ranks.values(), default=0) + 1
        self.block_chars, self.piece_bytes = block_chars, piece_bytes
        spelled = pattern.replace(r"[^\s", f"[^{WS}").replace(r"\s", f"[{WS}]").replace(r"\S", f"[^{WS}]")
        self.pieces = regex.compile(spelled)
        self.cache, self.nodes, self.pairs, self.windows = Cache(), Cache(), Cache(CACHED // 2), Cache(CACHED // 2)

    # Runs of bytes

    def _short(self, b: bytes) -> tuple[int, ...]:
        """Merges of the lowest rank first, leftmost first."""
        get, none = self.ranks.get, self.none
        parts = [b[i : i + 1] for i in range(len(b))]
        pairs = [get(x + y, none) for x, y in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) != none:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], none)
        return tuple([self.ranks[p] for p in parts])

    def _compatible(self, x: int, y: int) -> bool:
        known = self.pairs[x, y]
        if known is None:
            known = self._window((x, y)) == (x, y)
            self.pairs.put((x, y), known)
        return known

    def _window(self, tokens: tuple[int, ...]) -> tuple[int, ...]:
        found = self.windows[tokens]
        if found is None:
            found = self._short(b"".join([self.bytes_of[t] for t in tokens]))
            if len(tokens) <= 4:
                self.windows.put(tokens, found)
        return found

    def join_tokens(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        if not a or not b or self._compatible(a[-1], b[0]):
            return a + b
        i = j = 1
        while True:
            window = self._window(a[len(a) - i :] + b[:j])
            left = i == len(a) or self._compatible(a[-i - 1], window[0])
            right = j == len(b) or self._compatible(window[-1], b[j])
            if left and right:
                return a[: len(a) - i] + window + b[j:]
            i, j = i if left else min(2 * i, len(a)), j if right else min(2 * j, len(b))

    def encode_bytes(self, b: bytes) -> tuple[int, ...]:
        if len(b) > CACHED_BYTES:
            m = len(b) // 2
            return self.join_tokens(self.encode_bytes(b[:m]), self.encode_bytes(b[m:]))
        found = self.nodes[b]
        if found is None:
            m = len(b) // 2
            found = self._short(b) if len(b) <= self.piece_bytes else self.join_tokens(self.encode_bytes(b[:m]), self.encode_bytes(b[m:]))
            self.nodes.put(b, found)
        return found

    def encode_piece(self, b: bytes) -> tuple[int, ...]:
        """One match of the pattern; one that is a token as a whole is that token."""
        own = self.ranks.get(b)
        return self.encode_bytes(b) if own is None else (own,)

    # Texts

    def _leaf(self, s: str) -> bytes:
        out = array("i", [t for p in self.pieces.findall(s) for t in self.encode_piece(p.encode())]).tobytes()
        if len(s) <= CACHED_BYTES:
            self.cache.put(s, out)
        return out

    def leaves(self, s: str) -> list[str]:
        return LEAVES.findall(s)

    def join(self, a: list[str], b: list[str]) -> list[str]:
        """Leaves of two neighbours together: all but the last of a and the first of b are stable."""
        if not a or not b:
            return a + b
        if WHITE(b[0][0]) and not WHITE(a[-1][-1]):
            return a + b
        return a[:-1] + self.leaves(a[-1] + b[0]) + b[1:]

    def segment(self, s: str) -> list[str]:
        if len(s) <= self.block_chars:
            return self.leaves(s)
        m = len(s) // 2
        return self.join(self.segment(s[:m]), self.segment(s[m:]))

    def encode_text(self, s: str) -> bytes:
        """Ids as little-endian int32."""
        leaves = self.segment(s)
        cache, leaf = self.cache, self._leaf
        return b"".join([cache[x] or leaf(x) for x in leaves])


WHITE = re.compile(f"[{WS}]").match


def _with(df: DataFrame, column: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name.lower() != column.lower()] + [T.StructField(column, kind)])


def _put(batch: pa.RecordBatch, column: str, values: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n.lower() != column.lower()]
    return pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], values], names=[*[batch.schema.names[i] for i in keep], column])


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with out array<int>, the ids of df's text. vocabulary: path of a rank file, read once on the driver."""
    ranks = read_ranks(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TreeEncoder(ranks, pattern)
        for whole in released(batches):
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                blobs = [tree.encode_text(s or "") for s in batch.column(text).to_pylist()]
                offsets = np.zeros(len(blobs) + 1, np.int32)
                np.cumsum([len(b) // 4 for b in blobs], out=offsets[1:])
                ids = pa.array(np.frombuffer(b"".join(blobs), np.int32))
                yield _put(batch, out, pa.ListArray.from_arrays(pa.array(offsets), ids))

    return df.mapInArrow(run, _with(df, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with out binary, the bytes of df's ids; null ids give null."""
    ranks = read_ranks(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            words[v] = k
        vocab = pa.array(words, pa.binary())
        for whole in released(batches):
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                lists = batch.column(ids)
                gathered = pc.take(vocab, lists.flatten())
                ends = np.frombuffer(gathered.buffers()[1], np.int32)[: len(gathered) + 1] if len(gathered) else np.zeros(1, np.int32)
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                offsets = np.zeros(len(lists) + 1, np.int64)
                np.cumsum(lengths, out=offsets[1:])
                data = gathered.buffers()[2] if len(gathered) else pa.py_buffer(b"")
                made = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends[offsets].astype(np.int32)), data])
                yield _put(batch, out, pc.if_else(pc.is_valid(lists), made, pa.scalar(None, pa.binary())))

    return df.mapInArrow(run, _with(df, out, T.BinaryType()))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decode(coded, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
