"""Joins documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by a token-group matrix.

1. `describe` reads each text once: size of its set, a 128-bit digest of the set, band keys, and tokens that many
   documents share. Documents with equal sets have one representative.
2. Similar documents are partitioned into groups: representatives with a band key in common are compared with the first
   of them, and what is linked to each other makes a group.
3. The token-group matrix has a row for each token and group that has it. Of two similar sets of x <= y tokens at least
   16/18 x and 0.8 y tokens are in common. So in any order that is the same for all sets the first token in common is among
   the first x - ceil(16 x / 18) + 1 of the one and the first y - ceil(0.8 y) + 1 of the other: only these go into the
   matrix and ask it. The order puts tokens that many documents share last; they are found by rounds over the matrix
   itself, and what is in that list decides speed only, never results. Tokens of one group alone fall away.
4. A document is a candidate for each other group of sets no larger than itself that has one of these tokens, if what is left behind that
   token's place in both is enough for a similar pair. Groups are held in blocks of BLOCK members with
   the union of their tokens as a bitmap; a block is opened for a query only if the union leaves enough of the query's tokens
   for a similar pair. Only then its members' sets are sent, and those of fitting size are compared exactly. Between groups no links are lost. Components need no more: within a group
   only links with the first of a band are made.
5. Components of all links.

Sets are hashed anew where they are needed, for reading 8 bytes a shingle back costs more than hashing 6 bytes a word.

`similar_pairs` has all links: each group's blocks are opened for its own members too, under the same bound. They are given
as pairs of representatives with the membership of documents; `link_counts` counts them for each document from both, without
pairs of copies. A document whose rows have different sets represents itself only.

Defined results: null text counts as without words; sets without tokens are linked with nothing; rows of one doc_id are one
document with the links of each; null doc_id has component_id null; an empty table gives an empty result; other columns
are ignored. Tokens are compared by 64-bit hashes of words and shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import Words, cut, mix, release, released, shingle_hashes, sub_batches, table, text_bytes
from folio.llm.components import components

SHINGLE = 5
PERCENT = 80
BINS = 16
BLOCK = 64
OFTEN = 16
WIDE = 16
ROUNDS = 3
FEW = 4
SHARED = 4
MOST_OFTEN = 2_000_000
FLUSH = 1_000_000
BROADCAST_BYTES = 32 << 20
QUERIES = 128


def needed(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of n shares with any set that is similar to it."""
    return -(-percent * n // 100)


def first_asking(n: int) -> int:
    """How many first tokens of a set of n can be the first in common with a similar set that is no larger."""
    return n - needed(n) + 1


def first_held(n: int, percent: int = PERCENT) -> int:
    """The same with a similar set that is no smaller."""
    return n + (-2 * percent * n // (100 + percent)) + 1


def similar(shared: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def token_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(texts)
    all_of_k = shingle_hashes(w.hashes, k)
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        own = all_of_k[a : b - k + 1] if b - a >= k else shingle_hashes(w.hashes[a:b], b - a) if b > a else all_of_k[:0]
        own = np.sort(own)
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out


_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(60)).astype(np.uint64)


def band_keys(s: np.ndarray) -> np.ndarray:
    """Keys of BINS / 2 bands of two minima each; the minima are those of BINS equal parts of the range of hashes, an
    empty part taking the next one's."""
    at = np.searchsorted(s, _EDGES) % len(s)
    least = s[at]
    pairs = least.reshape(-1, 2)
    return mix(pairs[:, 0] * np.uint64(0x9E3779B97F4A7C15) + pairs[:, 1] + np.arange(BINS // 2, dtype=np.uint64))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in released(batches):
        texts = text_bytes(batch.column("text"))
        for a, b in sub_batches(np.fromiter(map(len, texts), np.int64, len(texts)), 1 << 20):
            yield batch.slice(a, b - a), token_sets(texts[a:b])


def describe(docs: DataFrame) -> DataFrame:
    """For each row doc_id, n, d1, d2, keys; further rows with token, times, for tokens often met in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kind = [], 0, None
        names = ["doc_id", "n", "d1", "d2", "keys", "token", "times"]

        def often() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint64)
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
            times = np.diff(np.append(at, len(h)))
            many = times >= 3
            tokens, times = h[at[many]].view(np.int64), times[many]
            gone = lambda t: pa.nulls(len(tokens), t)
            return pa.RecordBatch.from_arrays([gone(kind), gone(pa.int64()), gone(pa.int64()), gone(pa.int64()), gone(pa.list_(pa.int64())), pa.array(tokens), pa.array(times.astype(np.int64))], names=names)

        for batch, sets in _texts(batches):
            kind = batch.column("doc_id").type
            d1, d2 = (np.array([mix(s ^ np.uint64(c)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
            keys = [band_keys(s).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets]
            offsets = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(k) for k in keys], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
            n = pa.array(np.array([len(s) for s in sets], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.array(d1), pa.array(d2), lists, pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.int64())], names=names)
            held += sets
            size += sum(map(len, sets))
            if size >= FLUSH:
                yield often()
                held, size = [], 0
        if size:
            yield often()

    slim = docs.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n long, d1 long, d2 long, keys array<long>, token long, times long")


def token_counts(docs: DataFrame) -> DataFrame:
    """token, times: how many of docs have a token, in parts that are to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(times.astype(np.int64))], names=["token", "times"])

        for _, sets in _texts(batches):
            held += sets
            size += sum(map(len, sets))
            if size >= FLUSH:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    return docs.select("text").where("text is not null").mapInArrow(run, "token long, times long")


class Often:
    """Tokens that many documents share, with how many: they come last in the order of tokens, the most shared last of all."""

    def __init__(self) -> None:
        self.tokens, self.times = np.empty(0, np.uint64), np.empty(0, np.int64)

    def with_more(self, tokens: np.ndarray, times: np.ndarray) -> Often:
        out = Often()
        out.tokens, at = np.unique(np.concatenate([self.tokens, tokens]), return_index=True)
        out.times = np.concatenate([self.times, times])[at]
        return out

    def has(self, s: np.ndarray) -> np.ndarray:
        return self.tokens[self.places(s)] == s if len(self.tokens) else np.zeros(len(s), bool)

    def places(self, s: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)


def prefix_of(s: np.ndarray, often: Often) -> np.ndarray:
    """The first tokens of a set in the order of all sets."""
    p = first_asking(len(s))
    hot = often.has(s)
    if not hot[:p].any():
        return s[:p]
    late = s[hot]
    return np.concatenate([s[~hot], late[np.lexsort((late, often.times[often.places(late)]))]])[:p]


def prefixes(docs: DataFrame, often: Often) -> DataFrame:
    """doc_id, n, held (how many of the tokens go into the matrix), tokens (that ask it, in their order) of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _texts(batches):
            first = [prefix_of(s, often) if len(s) else s for s in sets]
            offsets = np.zeros(len(first) + 1, np.int32)
            np.cumsum([len(f) for f in first], out=offsets[1:])
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*first, np.empty(0, np.uint64)]).view(np.int64)))
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([first_held(x) for x in n], pa.int32()), tokens], names=["doc_id", "n", "held", "tokens"])

    slim = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n long, held int, tokens array<long>")


def _small(rows: DataFrame) -> DataFrame:
    """rows to be sent to all executors while they have at most BROADCAST_BYTES there, else to be joined by shuffle."""
    sizes = [F.octet_length(F.col(c).cast("string")) for c in rows.columns]
    held = rows.agg(F.sum(sum(sizes, F.lit(24)))).first()[0] or 0
    return F.broadcast(rows) if held <= BROADCAST_BYTES else rows


class OpenBlock:
    """Sets of one block of a group, with their union."""

    def __init__(self) -> None:
        self.ids: list = []
        self.sets: list[np.ndarray] = []
        self.union: np.ndarray | None = None

    def add(self, doc_id, s: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.sets.append(s)
        self.union = None

    def _unite(self) -> None:
        """The union of the sets, and for each token of it a bit for each set that has it."""
        self.union, of_token = np.unique(np.concatenate(self.sets), return_inverse=True)
        self.masks = np.zeros((len(self.union), -(-len(self.sets) // 8)), np.uint8)
        at = 0
        for i, s in enumerate(self.sets):
            self.masks[of_token[at : at + len(s)], i // 8] |= np.uint8(1 << i % 8)
            at += len(s)

    @staticmethod
    def shared(q: np.ndarray, s: np.ndarray) -> int:
        at = np.searchsorted(s, q)
        at[at == len(s)] = 0
        return int(np.count_nonzero(s[at] == q)) if len(s) else 0

    def links(self, doc_id, q: np.ndarray) -> list:
        if len(self.sets) > 1:
            if self.union is None:
                self._unite()
            at = np.searchsorted(self.union, q)
            at[at == len(self.union)] = 0
            at = at[self.union[at] == q] if len(self.union) else at[:0]
            if len(at) < needed(len(q)):
                return []
            shared = np.unpackbits(self.masks[at], axis=1, count=len(self.sets), bitorder="little").sum(0, dtype=np.int64).tolist()
            return [i for i, s, n in zip(self.ids, self.sets, shared, strict=True) if i != doc_id and needed(len(q)) <= len(s) and needed(len(s)) <= len(q) and similar(n, len(q), len(s))]
        return [i for i, s in zip(self.ids, self.sets, strict=True) if i != doc_id and needed(len(q)) <= len(s) and needed(len(s)) <= len(q) and similar(self.shared(q, s), len(q), len(s))]


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each token of a set, by its last bits, in 4 to 8 bits a token (a power of two of them), packed."""
    size = 1 << max(6, (4 * len(s) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set in `size` bytes, a power of two."""
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0) if len(bits) > size else bits


class BlockBound:
    """The union of the tokens of a block's sets as a bitmap, and the smallest size of a set."""

    def __init__(self) -> None:
        self.union: np.ndarray | None = None
        self.least = 0

    def add(self, n: int, bits: np.ndarray) -> None:
        if self.union is None:
            self.union, self.least = bits, n
            return
        size = min(len(bits), len(self.union))
        self.union, self.least = folded(self.union, size) | folded(bits, size), min(self.least, n)

    def may_link(self, n: int, bits: np.ndarray) -> bool:
        """False only if no set of the block can be similar: each bit of a query that the union lacks is a token it lacks."""
        if self.union is None or not n:
            return False
        size = min(len(bits), len(self.union))
        lacks = int(np.bitwise_count(folded(bits, size) & ~folded(self.union, size)).sum())
        return (100 + PERCENT) * (n - lacks) >= PERCENT * (n + max(self.least, needed(n)))


def open_blocks(docs: DataFrame, queries: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) of queries(doc_id, block) with the members(doc_id, block) of the same block.

    First the bitmaps of queries and members meet, half a byte to a byte a token: the block's union bounds the overlap. Sets
    go only to blocks that are opened, with the queries that opened them. Only texts of documents in either are read on."""
    # A block that very many documents ask for is held once for each QUERIES of them
    parts = cut(queries.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")))
    held = members.join(parts, "block").select("doc_id", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    asking = queries.join(parts, "block").select("doc_id", "block", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    roles = cut(held.unionByName(asking).distinct().select("doc_id", F.concat_ws("/", F.col("block").cast("string"), F.col("part").cast("string")).alias("block"), "role"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = "doc_id " + kind

    def texts_of(roles: DataFrame) -> DataFrame:
        return docs.select("doc_id", "text").join(_small(cut(roles.select("doc_id").distinct())), "doc_id")

    def by_block(rows: DataFrame, roles: DataFrame) -> DataFrame:
        return rows.join(roles, "doc_id").repartition("block").sortWithinPartitions("block", "role").select("block", "role", *rows.columns)

    def bitmaps_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _texts(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "n", "bits"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, union = None, BlockBound()
        for batch in released(batches):
            opened = []
            for own, role, n, bits in zip(*(batch.column(c).to_pylist() for c in ("block", "role", "n", "bits")), strict=True):
                if own != block:
                    block, union = own, BlockBound()
                bits = np.frombuffer(bits, np.uint8)
                if role == 0:
                    union.add(n, bits)
                opened.append(role == 1 and union.may_link(n, bits))
            yield batch.select(["doc_id", "block"]).filter(pa.array(opened, pa.bool_()))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _texts(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "tokens"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, opened = None, OpenBlock()
        for batch in released(batches):
            a, b = [], []
            for i in range(batch.num_rows):
                own, role, doc_id = batch.column("block")[i].as_py(), batch.column("role")[i].as_py(), batch.column("doc_id")[i].as_py()
                s = np.frombuffer(batch.column("tokens")[i].as_py(), np.uint64)
                if own != block:
                    block, opened = own, OpenBlock()
                if role == 0:
                    opened.add(doc_id, s)
                else:
                    found = opened.links(doc_id, s)
                    a += [doc_id] * len(found)
                    b += found
            yield pa.RecordBatch.from_arrays([pa.array(a, batch.column("doc_id").type), pa.array(b, batch.column("doc_id").type)], names=["a", "b"])

    maps = texts_of(roles).mapInArrow(bitmaps_of, f"{id_type}, n long, bits binary")
    opening = cut(by_block(maps, roles).mapInArrow(bound, f"{id_type}, block string").distinct())
    opened = cut(opening.select("block").distinct())
    roles = cut(opening.withColumn("role", F.lit(1)).unionByName(roles.where("role = 0").join(opened, "block", "left_semi")))
    sets = texts_of(roles).mapInArrow(sets_of, f"{id_type}, tokens binary")
    return by_block(sets, roles).select("block", "role", "doc_id", "tokens").mapInArrow(compare, f"a {kind}, b {kind}")


def _collected(rows: DataFrame, count: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and their counts, MOST_OFTEN at most, those of the largest counts. The list decides speed only."""
    top = cut(rows.orderBy(F.desc(count), "token").limit(MOST_OFTEN).select("token", count)).toArrow()
    tokens, times = (top[c].combine_chunks().to_numpy(zero_copy_only=False).copy() for c in ("token", count))
    del top
    release()
    return tokens.view(np.uint64), times


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n) of every row, and links (a, b) that connect all similar documents: within a group of equal or similar
    ones with the first of them, between groups all that there are."""
    rows, copies, made = _links(docs, False)
    return rows, copies.unionByName(made)


def _links(docs: DataFrame, within: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n) of every row, links of copies with their representatives, and links of representatives: all between
    groups, and within a group all if `within`, else those with the first of a band."""
    told = cut(describe(docs))
    rows = told.where("n is not null").select("doc_id", "n", "d1", "d2", "keys")
    shared = told.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= OFTEN)
    often = Often().with_more(*_collected(shared, "times"))

    full, equal = rows.where("n > 0 and doc_id is not null"), ["d1", "d2", "n"]
    if within:  # a document of several sets is not the same as those that have one of them
        several = full.groupBy("doc_id").agg((F.countDistinct(*equal) > 1).alias("several")).where("several")
        full = full.join(cut(several), "doc_id", "left").withColumn("own", F.when(F.col("several"), F.col("doc_id").cast("string")).otherwise("")).drop("several")
        equal.append("own")
    nodes = cut(full.groupBy(*equal).agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")))
    copies = full.join(nodes.select(*equal, F.col("doc_id").alias("b")), equal).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")

    # Groups: each document against the first of its band
    keyed = cut(nodes.select("doc_id", F.posexplode("keys").alias("band", "key")))
    bands = cut(keyed.groupBy("band", "key").agg(F.min("doc_id").alias("block"), F.count("*").alias("m")).where("m > 1").drop("m"))
    stars = cut(keyed.join(bands, ["band", "key"]).where("doc_id <> block").select("doc_id", "block").distinct())
    firsts = stars.select(F.col("block").alias("doc_id"), "block").distinct()
    near = cut(open_blocks(docs, stars, firsts))
    groups = components(near)
    group_of = cut(nodes.select("doc_id", "n").join(groups.withColumnRenamed("v", "doc_id"), "doc_id", "left").select("doc_id", "n", F.coalesce("c", "doc_id").alias("g")))

    # The matrix: tokens of two groups at least, one of which holds the token
    of = _small(group_of.select("doc_id", "g").distinct())
    first = cut(prefixes(docs, often).join(of, "doc_id"))
    for done in range(1, ROUNDS + 1):
        place = first.select("doc_id", "g", "n", "held", F.posexplode("tokens").alias("at", "token"))
        place = place.select("token", "g", "doc_id", "n", (F.col("n") - F.col("at")).alias("rest"), (F.col("at") < F.col("held")).alias("holds"))
        met = cut(place.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.max("holds").alias("holds")).where("lo <> hi and holds").select("token"))
        matrix = cut(place.join(_small(met), "token").distinct())
        columns = matrix.where("holds").groupBy("token", "g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"))
        columns = cut(columns.withColumnsRenamed({"g": "other", "rest": "other_rest"}))
        asking = matrix.groupBy("token").agg(F.count("*").alias("asking"))
        met_rows = F.col("asking").cast("double") * F.col("holding")
        wide = columns.groupBy("token").agg(F.count("*").alias("holding")).join(asking, "token").where(met_rows > WIDE)
        wide = cut(wide.select("token", met_rows.cast("long").alias("times")))
        heavy = wide.agg(F.sum("times")).first()[0] or 0
        if done == ROUNDS or done > 1 and heavy <= FEW * matrix.count():  # what meets at other tokens is linear
            break
        # Documents with such tokens mostly share many more that aren't among the first yet: all of theirs are counted
        changed = _small(cut(matrix.join(_small(wide.select("token")), "token", "left_semi").select("doc_id").distinct()))
        shared = token_counts(docs.select("doc_id", "text").join(changed, "doc_id", "left_semi")).groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= SHARED)
        tokens, times = _collected(shared, "times")
        new = ~often.has(tokens)
        if not new.any():
            break
        often = often.with_more(tokens[new], times[new])
        first = cut(prefixes(docs, often).join(of, "doc_id"))
    n = F.col("n")
    overlap = F.ceil(PERCENT * (n + F.greatest("least", F.ceil(PERCENT * n / 100))) / (100 + PERCENT) - 1e-6)
    fits = (F.col("other") != F.col("g")) & (F.col("least") <= n) & (PERCENT * n <= 100 * F.col("most")) & (F.least("rest", "other_rest") >= overlap)
    asked = cut(matrix.join(columns, "token").where(fits).select("doc_id", F.col("other").alias("g")).distinct())
    if within:
        asked = asked.unionByName(group_of.join(group_of.groupBy("g").agg(F.count("*").alias("m")).where("m > 1"), "g").select("doc_id", "g").distinct())

    # Members of asked groups, in blocks
    sizes = group_of.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).join(asked.select("g").distinct(), "g")
    sizes = cut(sizes)
    block = lambda part: F.struct(F.col("g"), part.cast("long").alias("part"))
    members = group_of.join(sizes, "g").select("doc_id", block(F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).alias("block"))
    queries = asked.join(sizes, "g").select("doc_id", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part")).select("doc_id", block(F.col("part")).alias("block"))
    text_block = lambda df: df.withColumn("block", F.concat_ws(":", "block.g", "block.part"))
    across = open_blocks(docs, text_block(queries), text_block(members))
    return rows.select("doc_id", "n"), copies, near.unionByName(across)


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text)."""
    rows, edges = links(docs)
    found = components(edges).withColumnRenamed("v", "doc_id")
    return rows.join(found, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def similar_pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n) of every row; the representative of each document that has tokens; all pairs (a < b) of similar ones
    among the representatives. Documents of one representative are similar too."""
    rows, copies, made = _links(docs, True)
    copies = copies.select(F.col("a").alias("doc_id"), F.col("b").alias("representative")).distinct()
    ids = rows.where("n > 0 and doc_id is not null").select("doc_id").distinct()
    members = ids.join(copies, "doc_id", "left").select("doc_id", F.coalesce("representative", "doc_id").alias("representative"))
    return rows, cut(members), cut(made.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def link_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other documents that are similar) for every row of docs(doc_id, text)."""
    rows, members, pairs = similar_pairs(docs)
    found = components(members.select(F.col("doc_id").alias("a"), F.col("representative").alias("b")).unionByName(pairs)).withColumnRenamed("v", "doc_id")
    sizes = cut(members.groupBy("representative").agg(F.count("*").alias("size")))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beyond = both.join(sizes.withColumnRenamed("representative", "b"), "b").groupBy(F.col("a").alias("representative")).agg(F.sum("size").alias("beyond"))
    n_links = F.col("size") - 1 + F.coalesce("beyond", F.lit(0))
    counts = members.join(sizes.join(beyond, "representative", "left").select("representative", n_links.alias("n_links")), "representative").drop("representative")
    out = rows.join(found, "doc_id", "left").join(counts, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that have the smallest doc_id of their component, or none, with all their columns."""
    stay = join_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(stay, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(docs.columns)


def op2_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


def op2_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' ')))) AS s
  FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(v, c) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT b, c FROM r JOIN both_ways ON v = a WHERE c < b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(c) AS component_id FROM r GROUP BY v) m ON m.v = d.doc_id
"""

LINKS_SQL = (
    SQL.replace("m.component_id\nFROM", "m.component_id, coalesce(k.n_links, 0) AS n_links\nFROM")
    + "LEFT JOIN (SELECT a, count(DISTINCT b) AS n_links FROM both_ways GROUP BY a) k ON k.a = d.doc_id\n"
)
