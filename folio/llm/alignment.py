"""Alignment of two tokenizers: minimal groups of tokens that cover the same bytes, and how many documents link two ids.

The tokens of a text by a byte-level vocabulary (A) and by a piece model (B) are the two sides of a graph; two tokens are
linked if their byte ranges overlap. Union-find over the links gives the connected components, which are the minimal groups
(`components`); a component's members, in order, are its group, and its links are the token pairs that are counted.

Byte-level vocabularies never join a non-space with the white space behind it, nor a letter with the punctuation behind it, and
the piece model only with what some of its pieces has there (looked up when it is loaded). Texts are cut before all other
white space, and between words of Latin letters and other punctuation, into leaves, whose groups follow from the leaf alone.
Leaves that a chunk has twice are kept in a cache of CACHED. If a piece joins a word with the space behind it, a text is one leaf.

Documents are taken in chunks of CHUNK_BYTES of text (or one longer document). A chunk is written as a row for each
document (its leaves by number, its digest and sizes) and rows of its distinct pairs of ids with the number of documents
that hold each. Pairs are summed over chunks by Spark, the highest count of each A id is joined to them, and both go back
to the chunks that asked, one row a chunk and pair, so that a frequent pair is at most as many rows as there are chunks.

Defined results: a text that is null, empty, or that either tokenizer doesn't give back byte by byte behind one space has
no tokens: zeros and the digest ''; equal rows and null doc_id are kept as they are and all count as documents; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.bpe import WS
from folio.llm.common import cut, release, table

CHUNK_BYTES = 8 << 20
CACHED = 400_000
LONGEST_CACHED = 48
ENCODED = 1 << 16
_ESCAPED = "▁"
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_PUNCTUATION = ".,;:!?"
_DUMMY = " a"


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over links (a[i], b[i]), both in ascending order and without gaps from 0: each component's smallest a, for
    every a and for every b. Roots are joined by the smaller one, and paths are halved, until nothing changes."""
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first_a, first_b = (np.flatnonzero(np.r_[True, np.diff(x) != 0]) for x in (a, b))
    root = np.arange(a[-1] + 1)
    while True:
        of_b = np.minimum.reduceat(root[a], first_b)
        new = np.minimum.reduceat(of_b[b], first_a)
        new = new[new]
        if np.array_equal(new, root):
            return root, of_b
        root = new


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary spells bytes: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Found:
    """What is known of some leaves: spelled: their groups; sizes: the numbers of A and B tokens, of groups and of links; codes:
    the links of one leaf behind those of the last, as a * width + b; bad: tokens that don't give back the leaf's bytes."""

    def __init__(self) -> None:
        self.spelled: list[bytes] = []
        self.sizes, self.codes, self.bad = np.zeros((0, 4), np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, other: Found) -> None:
        self.spelled += other.spelled
        self.sizes, self.codes, self.bad = (np.concatenate([a, b]) for a, b in ((self.sizes, other.sizes), (self.codes, other.codes), (self.bad, other.bad)))

    def take(self, at: np.ndarray) -> Found:
        out = Found()
        out.spelled = [self.spelled[i] for i in at.tolist()]
        out.sizes, out.bad = self.sizes[at], self.bad[at]
        ends = np.cumsum(self.sizes[:, 3])
        out.codes = self.codes[ranges(ends[at] - out.sizes[:, 3], out.sizes[:, 3])]
        return out


class Aligner:
    """Groups and links of leaves by the tokenizers A (a JSON file's contents) and B (a piece model's bytes)."""

    def __init__(self, a_json: str, b_model: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = _byte_letters()
        spelled = self.a.get_vocab()
        a_bytes = [b""] * (max(spelled.values()) + 1)
        for word, i in spelled.items():
            a_bytes[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_ESCAPED, " ").encode() for i, p in enumerate(pieces)]
        self.bytes = a_bytes, b_bytes
        self.sizes = tuple(np.array([len(x) for x in side], np.int64) for side in self.bytes)
        self.width = len(b_bytes)
        pieces = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        # White space that some piece has behind something else, a carriage return for one, begins no leaf
        joins = re.compile(f"[^{WS}{_ESCAPED}]([{WS}{_ESCAPED}])|{_ESCAPED}([{WS}])").findall
        joined = {c for p in pieces for pair in joins(p) for c in pair if c}
        marks = set(_PUNCTUATION) - {p[m.end() - 1] for p in pieces for m in re.finditer(f"[{_LATIN}][{_PUNCTUATION}]", p)}
        self.cuts = _ESCAPED not in joined and all(len(x) == 1 for x in self._encoded([_DUMMY]))
        more = f"(?:[{re.escape(''.join(sorted(joined)))}][{WS}]*[^{WS}]*)*" if joined else ""
        word = f"[{WS}]*[{_LATIN}]+(?=[{re.escape(''.join(sorted(marks)))}])|" if marks else ""
        self.leaf = re.compile(f"{word}[{WS}]*[^{WS}]+{more}|[{WS}]+")
        # What can be put behind any other leaf, and before it a leaf that ends in a letter, without a change to either
        self.alone = re.compile(f"[{WS}]\\Z|{_ESCAPED}").search
        self.blank = re.compile(f"[{WS}]").match
        # Fixed-width spellings: an id with the mark behind it
        self.spelled = [np.array([b"%d" % i + mark for i in range(n)], "S8") for n, marks in ((len(a_bytes), (b",", b"|")), (len(b_bytes), (b",", b";"))) for mark in marks]
        self.cache = Found()
        self.number: dict[str, int] = {}

    def leaves(self, text: str) -> list[str]:
        """Leaves of a space and text."""
        return self.leaf.findall(" " + text) if self.cuts else [" " + text]

    def _encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a space, which the piece model puts there itself."""
        return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([x[1:] for x in texts], num_threads=1)

    def _single(self, leaves: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of leaves, each encoded by itself, behind a word; whole texts as they are."""
        if not self.cuts:
            return self._encoded(leaves)
        return tuple([ids[1:] for ids in side] for side in self._encoded([_DUMMY + x for x in leaves]))

    def align(self, leaves: list[str]) -> Found:
        """What is found of leaves. They are encoded together, as one text each ENCODED bytes, where that is the same."""
        apart = [bool(self.alone(x)) for x in leaves] if self.cuts else [True] * len(leaves)
        together = [i for i, x in enumerate(apart) if not x]
        found = self._aligned([leaves[i] for i in together]) if together else Found()
        if found is None:  # the piece model changes some of them
            apart, together, found = [True] * len(leaves), [], Found()
        single = [i for i, x in enumerate(apart) if x]
        if single:
            some = [leaves[i] for i in single]
            sides = self._single(some)
            raw = [x.encode() for x in some]
            same = [all(b"".join(map(side.__getitem__, ids)) == x for side, ids in zip(self.bytes, both, strict=True)) for x, both in zip(raw, zip(*sides, strict=True), strict=True)]
            good = [i for i, ok in enumerate(same) if ok]
            flat = [np.array([t for i in good for t in side[i]], np.int64) for side in sides]
            found.add(self._grouped(flat, np.array([len(raw[i]) for i in good], np.int64), np.array(same)))
        order = np.empty(len(leaves), np.int64)
        order[together + single] = np.arange(len(leaves))
        return found.take(order)

    def _aligned(self, leaves: list[str]) -> Found | None:
        """Leaves that are encoded in common texts; None if these don't come back as they are."""
        texts, parts, size, sizes, kept = [], [_DUMMY], 0, [len(_DUMMY)], [False]
        for x in leaves:
            if size >= ENCODED:
                texts.append("".join(parts))
                parts, size = [_DUMMY], 0
                sizes.append(len(_DUMMY))
                kept.append(False)
            elif not self.blank(x):
                parts.append(_DUMMY)
                sizes.append(len(_DUMMY))
                kept.append(False)
            parts.append(x)
            n = len(x.encode())
            size += n
            sizes.append(n)
            kept.append(True)
        texts.append("".join(parts))
        sides = [[t for ids in side for t in ids] for side in self._encoded(texts)]
        whole = "".join(texts).encode()
        if any(b"".join(map(own.__getitem__, ids)) != whole for own, ids in zip(self.bytes, sides, strict=True)):
            return None
        found = self._grouped([np.array(x, np.int64) for x in sides], np.array(sizes, np.int64), np.ones(len(sizes), bool))
        return found.take(np.flatnonzero(kept))

    def _grouped(self, sides: list[np.ndarray], sizes: np.ndarray, good: np.ndarray) -> Found:
        """Groups and links of leaves, of which the good ones have `sizes` bytes and these ids of A and B."""
        out = Found()
        if not len(sizes):
            out.bad, out.sizes, out.spelled = ~good, np.zeros((len(good), 4), np.int64), [b""] * len(good)
            return out
        ends = [np.cumsum(self.sizes[k][ids]) for k, ids in enumerate(sides)]
        cuts = np.union1d(*ends)  # between two cuts, one A and one B token overlap
        at = [np.searchsorted(e, cuts) for e in ends]
        roots, of_b = components(*at)
        n_a, n_b = map(len, sides)
        last_a, last_b = (np.r_[np.diff(x) != 0, True] for x in (roots, of_b))
        place_a = np.arange(n_a) + np.searchsorted(of_b, roots, "left")
        place_b = np.arange(n_b) + np.searchsorted(roots, of_b, "right")
        text = np.empty(n_a + n_b, "S8")
        for place, ids, last, (plain, end) in ((place_a, sides[0], last_a, self.spelled[:2]), (place_b, sides[1], last_b, self.spelled[2:])):
            text[place] = np.where(last, end[ids], plain[ids])
        whole = text.tobytes().replace(b"\0", b"")
        letters = np.cumsum(np.char.str_len(text))
        leaf_ends = np.cumsum(sizes)
        end_a, end_b = (np.searchsorted(e, leaf_ends) + 1 for e in ends)
        end_l = np.searchsorted(cuts, leaf_ends) + 1
        stops = letters[end_a + end_b - 1]
        parts = [whole[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
        counts = np.diff(np.stack([end_a, end_b, np.cumsum(last_a)[end_a - 1], end_l], 1), axis=0, prepend=np.zeros((1, 4), np.int64))
        out.codes = sides[0][at[0]] * self.width + sides[1][at[1]]
        out.bad, out.sizes, out.spelled = ~good, np.zeros((len(good), 4), np.int64), [b""] * len(good)
        out.sizes[good] = counts
        for i, x in zip(np.flatnonzero(good).tolist(), parts, strict=True):
            out.spelled[i] = x
        return out

    def find(self, leaves: list[str], often: np.ndarray) -> Found:
        """What is known of leaves; those that are `often` there are kept."""
        known = np.fromiter(map(self.number.get, leaves, repeat(-1)), np.int64, len(leaves))
        missing = np.flatnonzero(known < 0)
        new = self.align([leaves[i] for i in missing.tolist()])
        found = self.cache.take(known[known >= 0])
        found.add(new)
        order = np.empty(len(leaves), np.int64)
        order[np.r_[np.flatnonzero(known >= 0), missing]] = np.arange(len(leaves))
        kept = [i for i in np.flatnonzero(often[missing]).tolist() if len(leaves[missing[i]]) <= LONGEST_CACHED][: CACHED - len(self.number)]
        if kept:
            self.number.update(zip((leaves[missing[i]] for i in kept), range(len(self.number), len(self.number) + len(kept)), strict=True))
            self.cache.add(new.take(np.array(kept)))
        return found.take(order)


_aligners: dict[int, Aligner] = {}


def _aligner(a_json: str, b_model: bytes) -> Aligner:
    """One a worker, so that its cache serves all tasks of the worker."""
    key = hash((a_json, b_model))
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(a_json, b_model)
    return _aligners[key]


class _Chunk:
    """Documents whose leaves are numbered together."""

    def __init__(self, aligner: Aligner) -> None:
        self.aligner, self.docs, self.size = aligner, [], 0
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__

    def add(self, doc_id, text: str | None) -> None:
        leaves = self.aligner.leaves(text) if text else []
        self.docs.append((doc_id, np.fromiter(map(self.number.__getitem__, leaves), np.int32, len(leaves))))
        self.size += len(text or "") + 16

    def rows(self, chunk: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """A row for each document, and the chunk's pairs with the number of its documents that hold each."""
        counts = np.bincount(np.concatenate([x for _, x in self.docs]), minlength=len(self.number))
        found = self.aligner.find(list(self.number), counts > 1)
        bad, spelled, sizes, flat = found.bad, found.spelled, found.sizes, found.codes
        codes, place = np.unique(flat, return_inverse=True)
        starts = np.r_[0, np.cumsum(sizes[:, 3])]
        docs_of = np.zeros(len(codes), np.int64)
        rows = []
        links = None
        for doc_id, own in self.docs:
            if not len(own) or bad[own].any():
                rows.append((chunk, doc_id, 0, 0, 0, 0, "", b""))
                continue
            leaf = np.unique(own)
            links = ranges(starts[leaf], sizes[leaf, 3])
            docs_of[np.unique(place[links])] += 1
            digest = sha256(b"".join(map(spelled.__getitem__, own.tolist()))[:-1]).hexdigest()
            rows.append((chunk, doc_id, *sizes[own].sum(0).tolist(), digest, own.tobytes()))
        held = docs_of > 0
        keep = np.cumsum(held) - 1
        # Links of each leaf by the place of their pair among those that documents hold; leaves of no valid document have none
        lengths = np.where(held[place], 1, 0) if len(place) else np.empty(0, np.int64)
        per_leaf = np.add.reduceat(np.r_[lengths, 0], starts[:-1]) * (sizes[:, 3] > 0) if len(sizes) else np.empty(0, np.int64)
        rows.append((chunk, None, -1, len(sizes), 0, 0, "", per_leaf.astype(np.int32).tobytes() + keep[place][lengths > 0].astype(np.int32).tobytes()))
        return rows, codes[held], docs_of[held]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., starts[1], ...: lengths[i] numbers from starts[i] on."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


_COLUMNS = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "leaves"]


def aligned(docs: DataFrame, a_file: str, b_file: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of documents; a row a chunk with n_a = -1, n_b leaves and their links; and rows of pairs, whose `code` isn't null."""
    with open(a_file, encoding="utf-8") as f:
        a_json = f.read()
    with open(b_file, "rb") as f:
        b_model = f.read()
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = _aligner(a_json, b_model)
        part, seq = TaskContext.get().partitionId() << 32, 0
        chunk = _Chunk(aligner)

        def flush() -> Iterator[pa.RecordBatch]:
            rows, codes, docs_of = chunk.rows(part + seq)
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], names=names)
            for at in range(0, len(codes), 100_000):
                some = slice(at, at + 100_000)
                n = len(codes[some])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part + seq)), *(pa.nulls(n, t) for t in types[1:]), pa.array(codes[some]), pa.array(docs_of[some])], names=names)
            release()

        types, names = None, [*_COLUMNS, "code", "docs"]
        for batch in batches:
            types = types or [pa.int64(), batch.schema.field("doc_id").type, *[pa.int64()] * 4, pa.string(), pa.binary()]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                chunk.add(doc_id, text)
                if chunk.size >= chunk_bytes:
                    yield from flush()
                    seq += 1
                    chunk = _Chunk(aligner)
        if chunk.docs:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, f"chunk long, doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, leaves binary, code long, docs long")


def align(docs: DataFrame, a_file: str, b_file: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs(doc_id, text); a_file is a
    byte-level vocabulary of the tokenizers library, b_file a piece model."""
    made = cut(aligned(docs, a_file, b_file, chunk_bytes))
    counts, asked = pair_counts(made, b_file)
    lookup = asked.join(counts, "code").select(F.col("chunk").alias("to"), "code", "count", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("code")
        count, best = (right.column(c).to_numpy() for c in ("count", "best"))
        is_chunk = np.array(left.column("n_a").to_pylist()) < 0
        docs_of = left.filter(pa.array(~is_chunk))
        blob = np.frombuffer(left.filter(pa.array(is_chunk)).column("leaves")[0].as_py(), np.int32)
        own = [np.frombuffer(x, np.int32) for x in docs_of.column("leaves").to_pylist()]
        # The blob has the number of links of each leaf, then the links
        n = left.filter(pa.array(is_chunk)).column("n_b")[0].as_py()
        lengths, place = blob[:n].astype(np.int64), blob[n:]
        ends = np.cumsum(lengths)
        sums = [np.r_[0, np.cumsum(x[place])] for x in (count, best.astype(np.int64))]
        per_leaf = [s[ends] - s[ends - lengths] for s in sums] if n else [np.empty(0, np.int64)] * 2
        total = [pa.array([int(p[x].sum()) for x in own], pa.int64()) for p in per_leaf]
        return pa.table({"doc_id": docs_of.column("doc_id"), **{c: docs_of.column(c) for c in ("n_a", "n_b", "n_groups", "n_links")}, "n_best": total[1], "count_sum": total[0], "groups_sha256": docs_of.column("groups_sha256")})

    rows = made.where("code is null").drop("code", "docs")
    return rows.groupBy("chunk").cogroup(lookup.groupBy("to")).applyInArrow(finish, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def pair_counts(made: DataFrame, b_file: str) -> tuple[DataFrame, DataFrame]:
    """code, count (documents that hold the pair) and best (no pair of its A id has more); and the pairs of each chunk."""
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size()
    asked = made.where("code is not null").select("chunk", "code", "docs")
    counts = cut(asked.groupBy("code").agg(F.sum("docs").alias("count")).withColumn("a", F.expr(f"code div {width}")))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(top, "a").select("code", "count", (F.col("count") == F.col("top")).alias("best")), asked.drop("docs")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
