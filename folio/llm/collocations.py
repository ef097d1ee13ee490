"""Phrase collocations: phrases of two to LONGEST words that stand together more often than their parts suggest.

1. Texts are lower-cased in A-Z and split into pieces, whose words are joined by one space; identical pieces of a language
   become one row with a multiplicity (`pieces`).
2. N-grams of pieces, weighted by multiplicity, are summed within a group of pieces, whose words are numbers there, so that
   strings are made for distinct n-grams only. They are shuffled into hash buckets, each of which DuckDB counts under a
   memory limit, out of core where that doesn't suffice (`counted`). Its spill files belong to one task, which removes
   them, like those of Spark's own sorts; nothing else reads them.
3. A phrase is as frequent as `least` only if both its parts without the last and without the first word are. A bitmap of the
   frequent n-grams' hashes, of MAX_BITS at most, therefore goes to the tasks that make the next longer ones. What it lets
   through wrongly is counted and then dropped, so its size has no effect on results.
4. Candidates ask for their parts' frequencies: a row for each part goes to where the part's count is, by a join, and comes
   back to its phrase (`scored`). All parts of a candidate are as frequent as it is, so all of them are there.
5. Candidates inside longer ones of nearly their frequency go, and the first of each language are ranked, in two steps: the
   first of each of SALTS parts, then the first of those.

Phrases are compared by their bytes, sums are 64-bit integers, and scores are computed with decimals of 38 digits.

Defined results: null text counts as empty, null lang as `und`; a text without a word adds nothing; repeated rows count as
often as they are there; an empty table gives no rows; other columns and doc_id are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import LOWER, Words, cut, mix, release, table

LEAST = 30
LONGEST = 4
COVERED = 80
TOP = 2000
SALTS = 64
#: Bytes of text that a task combines at once.
COMBINED = 8 << 20
#: Bits for each frequent n-gram, and the most of all: 32 MB.
BITS_EACH, MAX_BITS = 16, 1 << 28
SEGMENT = 1 << 20
BUCKET_MEMORY = "192MB"

_ENDS = np.zeros(256, bool)  # of pieces
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_IN_WORD = ~_ENDS
_IN_WORD[list(b" \t")] = False


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings data[starts[i]:ends[i]]."""
    sizes = ends - starts
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data[at]))


def whole(column: pa.ChunkedArray | pa.Array, kind: pa.DataType) -> pa.Array:
    column = column.cast(kind)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def lines(strings: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings with a line feed behind each, and their sizes without it; null is empty."""
    ended = pc.binary_join_element_wise(pc.fill_null(whole(strings, pa.large_binary()), b""), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    data = np.frombuffer(ended.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(ended) else np.empty(0, np.uint8)
    return data, np.diff(offsets) - 1


def numbered(langs: pa.ChunkedArray | pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct languages of a column, and the number of each row's."""
    coded = whole(langs, pa.string()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def combined(strings: pa.Array, langs: np.ndarray, weights: np.ndarray, n_langs: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Sums of weights by language and string."""
    coded = strings.dictionary_encode()
    key = coded.indices.to_numpy().astype(np.int64) * n_langs + langs
    order, first = alike(key)
    found = key[order[first]]
    return found % n_langs, coded.dictionary.take(pa.array(found // n_langs)), np.add.reduceat(weights[order], first) if len(key) else weights


def alike(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of whole numbers that aren't negative in their order, and where each distinct number begins there."""
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = (len(key) - 1).bit_length()
    if int(key.max()).bit_length() + bits > 64:
        order = np.argsort(key, kind="stable")
        key = key[order]
    else:  # sorted with their places below them, which is faster
        packed = key.astype(np.uint64) << np.uint64(bits)
        packed |= np.arange(len(key), dtype=np.uint64)
        packed.sort()
        order = (packed & np.uint64((1 << bits) - 1)).view(np.int64)
        key = packed >> np.uint64(bits)
    return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def piece_strings(texts: pa.ChunkedArray | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces with a word of some texts, and the text of each."""
    raw, sizes = lines(texts)
    b = LOWER[raw]
    word = np.zeros(len(b) + 1, np.int8)
    word[1:] = _IN_WORD[b]
    edge = np.flatnonzero(np.diff(word))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return pa.array([], pa.large_string()), np.empty(0, np.int64)
    piece = np.cumsum(_ENDS[b], dtype=np.int32 if len(b) < 1 << 31 else np.int64)[starts]
    last = np.r_[np.diff(piece) != 0, True]
    kept = word[1:].astype(bool)
    kept[ends] = ~last  # a space behind each word but the last
    b[ends] = 32
    stops = np.cumsum(ends - starts + ~last)[last]
    made = pa.LargeStringArray.from_buffers(len(stops), pa.py_buffer(np.r_[0, stops]), pa.py_buffer(b[kept]))
    return made, np.searchsorted(np.cumsum(sizes + 1), starts[last], "right")


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece, n: how often each piece is in docs(lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in gathered(batches, "text"):
            names, langs = numbered(group.column("lang"))
            strings, of = piece_strings(group.column("text"))
            yield from batched(names, *combined(strings, langs[of], np.ones(len(of), np.int64), len(names)), "piece")

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text is not null")
    return cut(rows.mapInArrow(run, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")))


def gathered(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """batches together until `column` has COMBINED bytes; what a group needed is given back before the next."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= COMBINED:
            yield pa.Table.from_batches(held)
            held, size = [], 0
            release()
    if held:
        yield pa.Table.from_batches(held)


def batched(names: list[str], langs: np.ndarray, strings: pa.Array, sums: np.ndarray, column: str, most: int = 50_000) -> Iterator[pa.RecordBatch]:
    lang = pa.array(names, pa.string()).take(pa.array(langs)) if len(langs) else pa.array([], pa.string())
    for at in range(0, len(sums), most):
        yield pa.RecordBatch.from_arrays([lang.slice(at, most), strings.slice(at, most).cast("string"), pa.array(sums[at : at + most])], names=["lang", column, "n"])


class Grams:
    """N-grams of pieces whose words are joined by one space; words are numbers, and only distinct ones are hashed."""

    def __init__(self, pieces: pa.ChunkedArray | pa.Array, langs: np.ndarray, seeds: np.ndarray) -> None:
        """langs: the number of each piece's language; seeds: the hash of each language."""
        self.data, _ = lines(pieces)
        split = pc.split_pattern(whole(pieces, pa.large_string()), " ")
        counts = pc.list_value_length(split).to_numpy()
        words = split.flatten()
        sizes = pc.binary_length(words).to_numpy()
        self.ends = np.cumsum(sizes + 1) - 1  # in data, where one byte is behind each word
        self.starts = self.ends - sizes
        coded = words.dictionary_encode()
        self.word = coded.indices.to_numpy()
        self.n_words = len(coded.dictionary)
        self.hash = Words(lines(coded.dictionary)).hashes
        self.bounds = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=self.bounds[1:])
        self.piece = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        self.langs, self.seeds = langs, seeds

    def at(self, n: int) -> np.ndarray:
        """The first words of all n-grams that lie within a piece."""
        last = max(0, len(self.piece) - n + 1)
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1 :])

    def hashes(self, i: np.ndarray, n: int) -> np.ndarray:
        out = self.seeds[self.langs[self.piece[i]]]
        for k in range(n):
            out = mix(out + self.hash[self.word[i + k]])
        return out

    def combined(self, i: np.ndarray, n: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One first word of each distinct n-gram of a language among those at i, and the sums of weights, one for each piece."""
        key = self.langs[self.piece[i]]
        for k in range(n):
            if k:  # the first k words and the language become one number below len(i)
                first = np.zeros(len(i), np.int64)
                first[begin] = 1
                key = np.empty(len(i), np.int64)
                key[order] = first.cumsum() - 1
            key = key * self.n_words + self.word[i + k]
            order, begin = alike(key)
        return i[order[begin]], np.add.reduceat(weights[self.piece[i[order]]], begin) if len(i) else np.empty(0, np.int64)

    def strings(self, i: np.ndarray, n: int) -> pa.Array:
        return spans(self.data, self.starts[i], self.ends[i + n - 1])


def seed(lang: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(lang)


def lookup(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes are in the bitmap, whose size is a power of two."""
    at = (hashes >> np.uint64(64 - (len(bits) * 8 - 1).bit_length())).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap(frequent: DataFrame, n: int) -> np.ndarray:
    """A bitmap of the hashes of the n-grams in frequent(lang, gram), made in segments by as many tasks."""
    size = min(MAX_BITS, max(SEGMENT, 1 << (BITS_EACH * frequent.count()).bit_length()))
    shift = 64 - (size - 1).bit_length()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, langs = numbered(batch.column("lang"))
            grams = Grams(batch.column("gram"), langs, np.array([seed(x) for x in names], np.uint64))
            at = (grams.hashes(grams.bounds[:-1], n) >> np.uint64(shift)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // SEGMENT), pa.array(at % SEGMENT)], names=["segment", "place"])

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        bits = np.zeros(SEGMENT, np.uint8)
        bits[rows.column("place").to_numpy()] = 1
        return pa.table({"segment": [key[0]], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    made = frequent.mapInArrow(places, "segment long, place long").distinct().groupBy("segment").applyInArrow(packed, "segment long, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for row in made.collect():  # MAX_BITS / 8 bytes at most
        at = row["segment"] * SEGMENT // 8
        out[at : at + SEGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def found_in(group: pa.Table, n: int, bits: np.ndarray | None, most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """lang, gram, n: the distinct n-grams of group(lang, piece, n), with strings made for `most` at once."""
    names, langs = numbered(group.column("lang"))
    made = Grams(group.column("piece"), langs, np.array([seed(x) for x in names], np.uint64))
    i = made.at(n)
    if bits is not None:
        known = np.zeros(len(made.piece) + 1, bool)
        shorter = made.at(n - 1)
        known[shorter] = lookup(bits, made.hashes(shorter, n - 1))
        i = i[known[i] & known[i + 1]]
    i, sums = made.combined(i, n, group.column("n").to_numpy())
    for at in range(0, len(i), most):
        some = i[at : at + most]
        yield from batched(names, langs[made.piece[some]], made.strings(some, n), sums[at : at + most], "gram", most)


def grams(rows: DataFrame, n: int, bits: np.ndarray | None) -> DataFrame:
    """lang, gram, n: weighted n-grams of pieces, summed within each task; bits: frequent n-grams that are a word shorter."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in gathered(batches, "piece"):
            yield from found_in(group, n, shared.value)

    return rows.mapInArrow(run, "lang string, gram string, n long")


def counted(parts: DataFrame, least: int) -> DataFrame:
    """lang, gram, n: the sums of parts(lang, gram, n) of `least` or more, each hash bucket counted by DuckDB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        groups = gathered(batches, "gram")
        first = next(groups, None)
        if first is None:
            return
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(":memory:", config={"threads": 1, "memory_limit": BUCKET_MEMORY, "temp_directory": spill, "preserve_insertion_order": False}) as con:
            con.execute("CREATE TABLE parts (lang VARCHAR, gram VARCHAR, n BIGINT)")
            for group in chain([first], groups):
                con.register("batch", group)
                con.execute("INSERT INTO parts SELECT lang, gram, n FROM batch")
                con.unregister("batch")
            sums = con.sql(f"SELECT lang, gram, CAST(sum(n) AS BIGINT) AS n FROM parts GROUP BY lang, gram HAVING sum(n) >= {int(least)}")
            for found in sums.to_arrow_reader(50_000):
                yield found.cast(pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]))
        release()

    return cut(parts.repartition("lang", "gram").mapInArrow(run, "lang string, gram string, n long"))


def frequencies(rows: DataFrame, least: int = LEAST, longest: int = LONGEST) -> list[DataFrame]:
    """Of each length from 1 to longest: lang, gram, n of all n-grams of pieces that occur `least` times or more."""
    found = [counted(grams(rows, 1, None), least)]
    for n in range(2, longest + 1):
        found.append(counted(grams(rows, n, bitmap(found[-1], n - 1)), least))
    return found


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of candidates(lang, phrase, a), by counts(lang, gram, n) of all of their parts."""
    w = F.split("phrase", " ")
    part = lambda k: F.array(F.struct(F.lit(0).alias("side"), F.array_join(F.slice("_w", 1, k), " ").alias("gram")), F.struct(F.lit(1).alias("side"), F.array_join(F.slice("_w", k + 1, F.size("_w") - k), " ").alias("gram")))
    cuts = candidates.withColumn("_w", w).select("lang", "phrase", "a", "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)).alias("k"))
    asked = cuts.select("lang", "phrase", "a", "k", F.explode(part(F.col("k"))).alias("_p")).select("lang", "phrase", "a", "k", "_p.side", "_p.gram")
    told = asked.join(counts, ["lang", "gram"]).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r"))
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r)")
    best = told.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_b"))
    return best.select("lang", "phrase", "a", "_b.l", "_b.r", F.col("_b.score").cast("long").alias("score"))


def contained(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """lang, phrase of candidates(lang, phrase, a, words) that lie inside a longer one of `covered` percent of their count."""
    longer = candidates.where("words > 2").withColumn("_w", F.split("phrase", " "))
    inner = F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> array_join(slice(_w, i, n), ' '))))")
    inside = longer.select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("_f")).groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    return candidates.join(inside, ["lang", "phrase"]).where(F.expr(f"100 * cast(_f as decimal(20, 0)) >= {covered} * cast(a as decimal(20, 0))")).select("lang", "phrase")


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each lang of rows(lang, phrase, a, score), with their rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top).drop("_salt")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `top` phrases of each language of docs(lang, text)."""
    rows = pieces(docs)
    totals = rows.groupBy("lang").agg(F.sum(F.expr("n * (1 + char_length(piece) - char_length(replace(piece, ' ', '')))")).alias("n"))
    counts = frequencies(rows, least, longest)
    candidates = None
    for words, found in enumerate(counts[1:], 2):
        one = found.select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), F.lit(words).alias("words"))
        candidates = candidates.unionByName(one) if candidates else one
    parts = counts[0]
    for found in counts[1:-1]:
        parts = parts.unionByName(found)
    left = scored(candidates.drop("words"), parts).join(contained(candidates, covered), ["lang", "phrase"], "left_anti")
    return ranked(left, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, CASE WHEN s = '' THEN []::VARCHAR[] ELSE string_split(s, ' ') END AS w FROM (SELECT lang, trim(regexp_replace(piece, '[\x20\x09]+', ' ', 'g'), ' ') AS s FROM p)),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, len, array_to_string(list_slice(w, i, i + len - 1), ' ') AS gram
  FROM (SELECT lang, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS len) WHERE len(w) >= len)),
f AS (SELECT lang, len, gram, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, gram AS phrase, n AS a, len, string_split(gram, ' ') AS w FROM f WHERE len > 1),
k AS (SELECT lang, phrase, a, len, w, unnest(range(1, len)) AS k FROM c),
s AS (
  SELECT k.lang, phrase, a, k, x.n AS l, y.n AS r, 2000000::HUGEINT * a // (x.n + y.n) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.gram = array_to_string(list_slice(w, 1, k), ' ')
  JOIN f y ON y.lang = k.lang AND y.gram = array_to_string(list_slice(w, k + 1, k.len), ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, array_to_string(list_slice(w, j, j + m - 1), ' ') AS phrase, max(a) AS a
  FROM (SELECT *, unnest(range(1, len - m + 2)) AS j FROM (SELECT *, unnest(range(2, len)) AS m FROM c)) GROUP BY ALL),
o AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, CAST(score AS BIGINT) AS score
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.a IS NULL OR 100::HUGEINT * i.a < 80::HUGEINT * b.a)
SELECT o.lang, rank, phrase, a, l, r, t.n, score FROM o JOIN t ON t.lang = o.lang WHERE rank <= 2000
"""
