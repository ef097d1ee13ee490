"""Language-model scoring by a hierarchical Pitman-Yor model of words.

Restaurants: one for each word of the corpus as the word before, one for the start of a text, and the root, which all of
them share as their parent; the root's base is uniform over the vocabulary and one unknown word. So the restaurants grow
with the corpus. Seats are sampled by Gibbs: the tables of one dish in one restaurant are drawn given all others (exactly,
by generalised Stirling numbers, up to EXACT customers, then customer by customer in batches of a STEP-th of those seated,
each with the chance of a new table in its middle), and each table is a customer of the parent. Predictive probabilities are averaged over SAMPLES sweeps after BURN.

Nothing of the vocabulary's size goes to the driver or to all executors. Texts are dealt into chunks. Each chunk sends its
distinct (word, word before) pairs with their training counts to the part that owns the word's hash, so that a dish with
all its restaurants is in one place. Pairs of frequent words (at most FREQUENT, each a FREQUENT-th of all tokens or more)
are dealt over all parts by the word before, and their sums go through the driver. A part estimates other parts' tables
from its own while it samples: in proportion to the numbers of distinct pairs for frequent words, to the number of parts
for others. It then sends its tables of each restaurant to the part that owns the word before, which sums them for all
chunks that have that word, so each sample's probabilities sum to one under the tables of all parts. A part draws with
other random numbers, and with those estimates, so scores change a little with the number of parts. Counts of words,
pairs and vocabulary cover all training texts. Messages number at most the distinct words of all chunks.

Defined results: null text counts as empty and has the end token only; without training texts all scores are 0; rows are
scored one by one, repeated ones too; other columns are ignored. Words are told apart by 64-bit hashes, restaurants by
the first 40 bits of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import Words, cut, mix, release, remainder, sub_batches, table, text_bytes

FREQUENT = 20_000
CHUNK_BYTES = 6 << 20
CHUNK_TOKENS = 1_500_000
PART_BYTES = 8 << 20
PACK_BYTES = 24 << 20
BURN = 2
SAMPLES = 3
EXACT = 30
STEP = 16
STRENGTH = 1.0
END = np.uint64(0x0E0D0C0B0A090807)
START = np.uint64(0x1E1D1C1B1A191817)
#: A word's restaurant is known by its hash without these low bits
SHORT = np.uint64(24)


def places(ordered: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in an ordered array that isn't empty, or -1."""
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return np.where(ordered[at] == x, at, -1)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique(x, return_inverse=True) for whole numbers that aren't negative. Numbers that leave room are sorted with
    their places below them, which is several times as fast as sorting the places; of others, only the distinct ones are."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    bits = (len(x) - 1).bit_length()
    if int(x.max()).bit_length() + bits <= 64:
        packed = x.astype(np.uint64) << np.uint64(bits)
        packed |= np.arange(len(x), dtype=np.uint64)
        packed.sort()
        place = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
        packed >>= np.uint64(bits)
        new = np.concatenate([[True], packed[1:] != packed[:-1]])
        inverse = np.empty(len(x), np.int64)
        inverse[place] = new.cumsum() - 1
        return packed[new].astype(x.dtype), inverse
    coded = pa.array(x).dictionary_encode()
    values = coded.dictionary.to_numpy()
    order = np.argsort(values)
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    return values[order], rank[coded.indices.to_numpy()]


def token_arrays(texts: list[bytes]) -> list[np.ndarray]:
    """Words and the end of each text."""
    w = Words(texts)
    return [np.append(w.hashes[a:b], END) for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)]


class Pairs:
    """Distinct (word, word before) pairs of some texts, by part and word; `of_token` are their places in the order of tokens.

    A group is the pairs of one word in one part; only frequent words have several. The start's place is after all words.
    """

    def __init__(self, docs: list[np.ndarray], learn: list[bool], hot: np.ndarray, parts: int) -> None:
        self.lengths = np.array([len(d) for d in docs])
        self.words, of_word = distinct(np.concatenate(docs))
        n = len(self.words)
        before = np.concatenate([[n], of_word[:-1]])
        before[np.cumsum(self.lengths)[:-1]] = n
        keys, of_token = distinct(of_word * (n + 1) + before)
        word, ctx = keys // (n + 1), keys % (n + 1)
        codes = np.append(self.words, START) >> SHORT
        part = part_of(self.words, parts)[word]
        spread = (places(hot, self.words) >= 0)[word]
        part[spread] = part_of(mix(self.words[word[spread]] ^ mix(codes[ctx[spread]])), parts)
        order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")  # the short ones by radix
        self.word, self.ctx, self.part = word[order], ctx[order], part[order]
        self.code_of = codes
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of_token = place[of_token]
        taught = np.repeat(np.array(learn, float), self.lengths)
        self.counts = np.bincount(self.of_token, taught, len(keys)).astype(np.uint32)
        new = (self.word[1:] != self.word[:-1]) | (self.part[1:] != self.part[:-1])
        self.groups = np.flatnonzero(np.concatenate([[True], new]))

    def by_part(self, hot: np.ndarray) -> Iterator[tuple[int, int, int, bytes, bytes]]:
        """(part, groups, pairs, words of groups, counts and words before)."""
        codes, hot_ctx = self.code_of[self.ctx], places(hot >> SHORT, self.code_of)[self.ctx]
        own = self.part[self.groups]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ends = np.append(self.groups, len(self.part))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True):
            c, d = ends[a], ends[b]
            each = np.diff(ends[a : b + 1]).astype(np.uint32)
            yield int(own[a]), b - a, int(d - c), squeeze(self.words[self.word[self.groups[a:b]]].tobytes()), squeeze(planes(self.counts[c:d]) + planes(each) + short(codes[c:d], hot_ctx[c:d]))


def part_of(words: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of hashes."""
    return (((words >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def planes(x: np.ndarray, width: int = 4) -> bytes:
    """The low bytes of whole numbers, all first ones first, which compresses well."""
    b = np.array(x, np.uint64, order="C").ravel().view(np.uint8).reshape(-1, 8)
    return b"".join(b[:, i].tobytes() for i in range(width))


def from_planes(b: bytes, n: int, at: int = 0, width: int = 4) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    for i in range(width):
        out[:, i] = np.frombuffer(b, np.uint8, n, at + i * n)
    return out.view(np.uint64).ravel()


def short(codes: np.ndarray, at: np.ndarray) -> bytes:
    """Words before: the place of frequent ones, and five bytes of others, whose place is -1."""
    return planes(at + 1, 2) + planes(codes[at < 0], 5)


def from_short(b: bytes, n: int, at: int, hot: np.ndarray) -> np.ndarray:
    out = from_planes(b, n, at, 2).astype(np.int64) - 1
    codes = (hot >> SHORT)[out]
    codes[out < 0] = from_planes(b, int((out < 0).sum()), at + 2 * n, 5)
    return codes


def squeeze(b: bytes) -> bytes:
    return len(b).to_bytes(8, "little") + pa.compress(b, "zstd", asbytes=True)


def unsqueeze(b: bytes) -> bytes:
    return pa.decompress(memoryview(b)[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)


def unpack(nw: int, ne: int, words: bytes, pairs: bytes, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, counts of pairs, pairs of each word, words before."""
    pairs = unsqueeze(pairs)
    return np.frombuffer(unsqueeze(words), np.uint64), from_planes(pairs, ne), from_planes(pairs, nw, 4 * ne).astype(np.int64), from_short(pairs, ne, 4 * (ne + nw), hot)


def log_stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logs of generalised Stirling numbers S_d(c, t): ways to seat c customers at t tables."""
    s = np.zeros((most + 1, most + 1))
    s[1, 1] = 1
    for c in range(1, most):
        t = np.arange(1, c + 2)
        s[c + 1, t] = s[c, t - 1] + np.maximum(c - d * t, 0) * s[c, t]
    with np.errstate(divide="ignore"):
        return np.log(s)


def sample_tables(c: np.ndarray, a: np.ndarray, d: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers; a: (strength + d * all tables) * the parent's probability of the dish."""
    t = np.minimum(c, 1)
    several = np.flatnonzero(c > 1)  # most dishes have one customer, and so one table
    first = np.minimum(c[several], EXACT)
    order = np.argsort(first, kind="stable")
    cuts = np.searchsorted(first[order], np.arange(EXACT + 2))
    order = several[order]
    log_a = np.log(np.maximum(a[order], 1e-300))
    for n in range(2, EXACT + 1):
        for i in range(cuts[n], cuts[n + 1], 200_000):
            end = min(i + 200_000, cuts[n + 1])
            weights = stirling[n, 1 : n + 1] + log_a[i:end, None] * np.arange(1, n + 1)
            weights = np.exp(weights - weights.max(1, keepdims=True)).cumsum(1)
            t[order[i:end]] = 1 + (rng.random(end - i)[:, None] * weights[:, -1:] > weights[:, :-1]).sum(1)
    left = np.flatnonzero(c > EXACT)
    own_c, own_a, own_t, seated = c[left], a[left], t[left], EXACT  # all that are left have as many seated
    soonest = own_c.min() if len(left) else seated
    while len(left):
        batch = max(seated // STEP, 1)
        some = batch if seated + batch < soonest else np.minimum(batch, own_c - seated)
        known, half = np.maximum(seated - d * own_t, 1e-300), (some - 1) / 2
        new = own_a / (known + own_a)
        new = own_a / (known + half * (1 - d * new) + own_a)
        own_t += rng.binomial(some, np.minimum(new, 1.0))
        seated += batch
        if seated < soonest:
            continue
        done = own_c <= seated
        t[left[done]] = own_t[done]
        left, own_c, own_a, own_t = left[~done], own_c[~done], own_a[~done], own_t[~done]
        soonest = own_c.min() if len(left) else seated
    return t


class Part:
    """All pairs of one part, over all chunks."""

    def __init__(self, chunks: list[tuple[int, int, bytes, bytes]], hot: np.ndarray, parts: int) -> None:
        read = [unpack(*c, hot) for c in chunks]
        self.parts = parts
        self.sizes = [(len(r[0]), len(r[1])) for r in read]
        self.words, of_word = distinct(np.concatenate([r[0] for r in read]))
        self.codes, of_code = distinct(np.concatenate([r[3] for r in read]))
        keys = np.repeat(of_word, np.concatenate([r[2] for r in read])) * len(self.codes) + of_code
        merged, of_pair = distinct(keys)
        self.chunk_words, self.chunk_pairs = of_word.astype(np.int32), of_pair.astype(np.int32)
        self.word, self.ctx = merged // len(self.codes), merged % len(self.codes)
        self.c = np.bincount(of_pair, np.concatenate([r[1] for r in read]), len(merged)).astype(np.int64)
        self.counts = np.bincount(self.word, self.c, len(self.words)).astype(np.int64)
        seen = self.c > 0
        self.types = np.bincount(self.word[seen], minlength=len(self.words))
        self.followers = np.bincount(self.ctx[seen], minlength=len(self.codes))
        self.hot_words, self.hot_ctx = places(hot, self.words), places(hot >> SHORT, self.codes)
        self.cold = self.hot_words < 0

    def of_hot(self, n: int, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.bincount(at[at >= 0], values[at >= 0], n)

    def sums(self, n: int) -> dict[str, np.ndarray]:
        """Sizes, and customers, distinct pairs as word and as word before of the n frequent words."""
        once = [float((x == k).sum()) for x in (self.c, self.types[self.cold]) for k in (1, 2)]
        return {
            "sizes": np.array([self.counts[self.cold].sum(), (self.counts[self.cold] > 0).sum(), *once]),
            "counts": self.of_hot(n, self.counts, self.hot_words),
            "types": self.of_hot(n, self.types, self.hot_words),
            "followers": self.of_hot(n, self.followers, self.hot_ctx),
        }

    def samples(self, hyper: Hyper, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(tables of pairs, of words before, and own customers and tables of words in the root) after each sweep."""
        rng = np.random.default_rng(seed)
        d0, d1 = hyper.d
        more_words = np.where(self.cold, 1.0, hyper.types[self.hot_words] / np.maximum(self.types, 1))
        more_ctx = hyper.followers[self.hot_ctx] / np.maximum(self.followers, 1)
        base = lambda r: (STRENGTH + d0 * r) / (hyper.vocabulary + 1)
        t, tr = np.minimum(self.c, 1), None
        for sweep in range(BURN + SAMPLES):
            if sweep:
                root = np.maximum(all_words - d0 * tr, 0) + base(all_root)
                root /= STRENGTH + self.parts * t.sum()
                t = sample_tables(self.c, (STRENGTH + d1 * all_ctx)[self.ctx] * root[self.word], d1, hyper.stirling[1], rng)
            tables = np.bincount(self.ctx, t, len(self.codes))
            all_ctx = np.where(self.hot_ctx >= 0, tables * more_ctx, np.minimum(tables, 1) + self.parts * np.maximum(tables - 1, 0))
            own = np.bincount(self.word, t, len(self.words))
            all_words = np.rint(own * more_words).astype(np.int64)
            tr = sample_tables(all_words, np.full(len(own), base(all_root)), d0, hyper.stirling[0], rng) if sweep else np.minimum(all_words, 1)
            all_root = self.parts * tr[self.cold].sum() + tr[~self.cold].sum()
            if sweep >= BURN:
                yield t, tables, own, tr

    def seated(self, hyper: Hyper, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(customers of pairs, and their tables in all samples; customers and tables of words in the root, sample by sample)."""
        tables, root = np.zeros(len(self.c), np.int64), []
        for t, _, own, tr in self.samples(hyper, seed):
            tables += t
            root += [own, tr]
        return np.array([self.c, tables]), np.array(root)


class Hyper:
    """What all parts share: discounts of the root and of words, sizes, and customers and distinct pairs of frequent words."""

    def __init__(self, hot: np.ndarray, sums: dict[str, np.ndarray]) -> None:
        n = len(hot)
        sizes, self.counts, self.types, self.followers = (sums.get(k, np.zeros(m)) for k, m in (("sizes", 6), ("counts", n), ("types", n), ("followers", n)))
        self.tokens, self.vocabulary = int(sizes[0] + self.counts.sum()), int(sizes[1] + (self.counts > 0).sum())
        discount = lambda once, twice: float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95))
        self.d = (discount(sizes[4], sizes[5]), discount(sizes[2], sizes[3]))
        self.stirling = [log_stirling(d) for d in self.d]
        #: As words before: each start has an end
        self.customers = self.counts.copy()
        self.customers[places(hot, np.array([START]))] = self.counts[places(hot, np.array([END]))]


class Totals:
    """Tables of all parts after each sweep: of the root, and of frequent words, whose tables in the root are drawn here."""

    def __init__(self, hyper: Hyper, sums: dict[str, np.ndarray], n: int) -> None:
        of = lambda name, s, m: sums.get(f"{name}{s}", np.zeros(m))
        rng, d0 = np.random.default_rng(0), hyper.d[0]
        self.hot_tables = np.array([of("before", s, n) for s in range(SAMPLES)])
        self.hot_root, self.base, self.customers = np.zeros((SAMPLES, n)), np.zeros(SAMPLES), np.zeros(SAMPLES)
        for s in range(SAMPLES):
            cr, (customers, tables) = of("root", s, n).astype(np.int64), of("all", s, 2)
            tr = sample_tables(cr, np.full(n, (STRENGTH + d0 * tables) / (hyper.vocabulary + 1)), d0, hyper.stirling[0], rng)
            self.hot_root[s] = np.maximum(cr - d0 * tr, 0)
            self.base[s], self.customers[s] = (STRENGTH + d0 * (tables + tr.sum())) / (hyper.vocabulary + 1), customers


def predictive(pairs: Pairs, hot: np.ndarray, hyper: Hyper, totals: Totals, counts, root, tables, seats) -> tuple[np.ndarray, np.ndarray]:
    """(training counts of words, mean probabilities of pairs), from the answers to groups (counts, root, tables) and pairs (seats)."""
    n = len(pairs.words)
    known, customers, x, before = np.zeros(n, np.int64), np.zeros(n + 1), np.zeros((SAMPLES, n)), np.zeros((SAMPLES, n + 1))
    of_group = pairs.word[pairs.groups]
    known[of_group], x[:, of_group], before[:, of_group] = counts, root[::2] - hyper.d[0] * root[1::2], tables
    customers[:n] = known
    codes = places(hot, np.append(pairs.words, START))
    frequent = np.flatnonzero(codes >= 0)
    before[:, frequent], customers[frequent] = totals.hot_tables[:, codes[frequent]], hyper.customers[codes[frequent]]
    frequent = frequent[:-1]
    known[frequent], x[:, frequent] = hyper.counts[codes[frequent]], totals.hot_root[:, codes[frequent]]
    p = seats[0] - hyper.d[1] / SAMPLES * seats[1]
    for s in range(SAMPLES):
        word = (x[s] + totals.base[s]) / (STRENGTH + totals.customers[s])
        p += (STRENGTH + hyper.d[1] * before[s])[pairs.ctx] * word[pairs.word] / SAMPLES
    return known, p / (STRENGTH + customers[pairs.ctx])


def frequent_words(docs: DataFrame) -> np.ndarray:
    """Hashes of the words (and the end and the start) that are counted at least once in FREQUENT tokens. Runs of texts leave
    out what is rarer than that within them, so every word that is twice as frequent is found, and no more than FREQUENT are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for a, b in sub_batches(np.array([len(x) for x in texts]), 2 << 20):
                hashes = Words(texts[a:b]).hashes
                words, n = np.unique(hashes, return_counts=True)
                many = n >= max(1, len(hashes) // FREQUENT)
                words, n = np.append(words[many], START), np.append(n[many], len(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    rows = docs.select("text").where("text is not null").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = cut(rows)
    start = int(START.astype(np.int64))
    total = (rows.where(F.col("word") == start).first() or [0, 0])[1]
    found = rows.where((F.col("word") != start) & (F.col("n") * FREQUENT >= max(total, 1))).select("word").collect()  # at most FREQUENT
    return np.unique(np.append(np.array([r[0] for r in found], np.int64).view(np.uint64), [START, END]))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, doc_id, h, learn, text) to compressed packs of rows of one chunk."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().sort_by("chunk")
        chunk = rows["chunk"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        packs = []
        for a, b in zip(cuts, [*cuts[1:], len(chunk)], strict=True):
            sink = pa.BufferOutputStream()
            part = rows.slice(a, b - a).drop_columns(["chunk"]).combine_chunks()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=7))) as w:
                w.write_table(part)
            packs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(chunk[cuts]), pa.array(packs, pa.binary())], names=["chunk", "pack"])

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            held.append(part)
            size += int(pc.sum(pc.binary_length(part.column("text"))).as_py() or 0) + 40 * part.num_rows
            if size > PACK_BYTES:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _chunks(batches: Iterator[pa.RecordBatch], hot: np.ndarray, parts: int, on_answer=None) -> Iterator[tuple]:
    """(chunk, sub, ids, Pairs) for packs sorted by chunk; a chunk of very many tokens goes in several subs, cut by its rows
    alone, which are in one order however they were packed. Answers of a chunk come before its packs, to on_answer."""

    def whole(chunk: int, packs: list[bytes]) -> Iterator[tuple]:
        rows = pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in packs]).combine_chunks().sort_by([("doc_id", "ascending"), ("h", "ascending")])
        texts = text_bytes(rows["text"].combine_chunks())
        ids, learn = rows["doc_id"].to_pylist(), rows["learn"].to_pylist()
        sub, first, size, docs = 0, 0, 0, []
        for a, b in sub_batches(np.array([len(x) for x in texts]), 1 << 20):
            for tokens in token_arrays(texts[a:b]):
                if docs and size + len(tokens) > CHUNK_TOKENS:
                    at = first + len(docs)
                    yield chunk, sub, ids[first:at], Pairs(docs, learn[first:at], hot, parts)
                    sub, first, size, docs = sub + 1, at, 0, []
                docs.append(tokens)
                size += len(tokens)
        yield chunk, sub, ids[first:], Pairs(docs, learn[first:], hot, parts)

    chunk, packs = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            own, pack = batch.column("chunk")[i].as_py(), batch.column("pack")[i].as_py()
            if packs and own != chunk:
                yield from whole(chunk, packs)
                packs = []
                release()
            chunk = own
            if pack is None:
                on_answer(*(batch.column(c)[i].as_py() for c in ("sub", "kind", "nw", "ne", "answer")))
            else:
                packs.append(pack)
    if packs:
        yield from whole(chunk, packs)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of docs(doc_id, text, learn);
    learn (boolean): the row teaches the model."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    bytes_all = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_chunks, parts = max(1, -(-bytes_all // CHUNK_BYTES)), max(1, -(-bytes_all // PART_BYTES))
    hot = frequent_words(docs.where("learn"))
    h = F.xxhash64("doc_id", "text")
    rows = docs.select(F.pmod(h, F.lit(n_chunks)).alias("chunk"), "doc_id", h.alias("h"), F.coalesce("learn", F.lit(False)).alias("learn"), "text")
    dealt = rows.mapInArrow(_pack, "chunk long, pack binary")
    in_order = lambda df, *by: df.repartition(n_chunks, "chunk").sortWithinPartitions("chunk", *by)
    of_part = lambda df, *by: df.repartition(parts, "part").sortWithinPartitions("part", *by)
    names = ("chunk", "sub", "nw", "ne", "words", "pairs")
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, sub, _, pairs in _chunks(batches, hot, parts):
            part, *columns = zip(*((p, chunk, sub, *row) for p, *row in pairs.by_part(hot)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["part", *names])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each part, which no reader can split."""
        part, held = None, []
        made = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([[x[i] for x in held]], pa.list_(t)) for i, t in enumerate(types))], names=["part", *names])
        for batch in batches:
            for own, *row in zip(*(batch.column(c).to_pylist() for c in ("part", *names)), strict=True):
                if held and own != part:
                    yield made()
                    held = []
                part = own
                held.append(row)
        if held:
            yield made()

    asked = in_order(dealt).mapInArrow(ask, "part int, chunk long, sub int, nw int, ne int, words binary, pairs binary")
    state = cut(of_part(asked, "chunk", "sub").mapInArrow(together, "part int, chunk array<long>, sub array<int>, nw array<int>, ne array<int>, words array<binary>, pairs array<binary>"))

    def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int]], Part]]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, chunk, sub, *rest = (batch.column(c)[i].as_py() for c in ("part", *names))
                yield part, list(zip(chunk, sub, strict=True)), Part(list(zip(*rest, strict=True)), hot, parts)
                release()

    def numbers(name: str, values: np.ndarray) -> tuple[list, ...]:
        at = np.flatnonzero(values)
        return [name] * len(at), at.astype(np.int32), values[at].astype(float)

    def summed(rows: DataFrame) -> dict[str, np.ndarray]:
        rows = rows.groupBy("name", "i").agg(F.sum("x").alias("x")).collect()  # a few for each frequent word
        out: dict[str, np.ndarray] = {}
        for r in rows:
            out.setdefault(r["name"], np.zeros({"sizes": 6, "all": 2}.get(r["name"].rstrip("0123456789"), len(hot))))[r["i"]] = r["x"]
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, part in by_part(batches):
            for name, values in part.sums(len(hot)).items():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in numbers(name, values)], schema=pa.schema([("name", pa.string()), ("i", pa.int32()), ("x", pa.float64())]))

    hyper = Hyper(hot, summed(state.mapInArrow(count, "name string, i int, x double")))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums for the driver, and tables of words before for the parts that own these."""
        fields = pa.schema([("name", pa.string()), ("i", pa.int32()), ("x", pa.float64()), ("part", pa.int32()), ("n", pa.int32()), ("tables", pa.binary())])
        for p, _, part in by_part(batches):
            drawn = []
            for s, (t, tables, own, tr) in enumerate(part.samples(hyper, p)):
                drawn.append(tables.astype(np.uint32))
                sums = {"before": part.of_hot(len(hot), tables, part.hot_ctx), "root": part.of_hot(len(hot), own, part.hot_words), "all": np.array([t.sum(), tr[part.cold].sum()])}
                for name, values in sums.items():
                    columns = numbers(f"{name}{s}", values)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), *(pa.nulls(len(columns[0]), fields.field(i).type) for i in (3, 4, 5))], schema=fields)
            at = np.flatnonzero((part.hot_ctx < 0) & (part.followers > 0))
            codes, drawn = part.codes[at], np.array(drawn)[:, at]
            owner = part_of(codes << SHORT, parts)
            first = np.flatnonzero(np.concatenate([[len(at) > 0], owner[1:] != owner[:-1]]))
            ends = [*first[1:].tolist(), len(at)]
            blobs = [squeeze(planes(codes[a:b], 5) + planes(drawn[:, a:b])) for a, b in zip(first.tolist(), ends, strict=False)]
            sizes = np.diff(np.append(first, len(at))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(first), fields.field(i).type) for i in range(3)), pa.array(owner[first].astype(np.int32)), pa.array(sizes), pa.array(blobs, pa.binary())], schema=fields)

    swept = cut(state.mapInArrow(sweep, "name string, i int, x double, part int, n int, tables binary"))
    totals = Totals(hyper, summed(swept.where("name is not null").select("name", "i", "x")), len(hot))
    answer_schema = "part int, chunk long, sub int, kind int, nw int, ne int, answer binary"

    def answers_of(part: int, kind: int, rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), *columns[:2], pa.array([kind] * len(rows), pa.int32()), *columns[2:]], names=["part", "chunk", "sub", "kind", "nw", "ne", "answer"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, keys, part in by_part(batches):
            seats, root = part.seated(hyper, p)
            at_word = at_pair = 0
            for (chunk, sub), (nw, ne) in zip(keys, part.sizes, strict=True):
                words, own = part.chunk_words[at_word : at_word + nw], part.chunk_pairs[at_pair : at_pair + ne]
                at_word, at_pair = at_word + nw, at_pair + ne
                yield answers_of(p, 0, [(chunk, sub, nw, ne, squeeze(planes(part.counts[words], 8) + planes(root[:, words]) + planes(seats[:, own])))])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tables of the words that chunks ask for, from those of all parts, which come first."""
        part, codes, drawn, whole = None, [], [], None
        for batch in batches:
            for i in range(batch.num_rows):
                own, n, blob = (batch.column(c)[i].as_py() for c in ("part", "n", "tables"))
                if own != part:
                    part, codes, drawn, whole = own, [], [], None
                if blob is not None:
                    blob = unsqueeze(blob)
                    codes.append(from_planes(blob, n, 0, 5))
                    drawn.append(from_planes(blob, SAMPLES * n, 5 * n).reshape(SAMPLES, n))
                    continue
                if whole is None:
                    keys, at = np.unique(np.concatenate([*codes, np.zeros(1, np.uint64)]), return_inverse=True)
                    all_drawn = np.concatenate([*drawn, np.zeros((SAMPLES, 1))], axis=1)
                    whole = keys, np.array([np.bincount(at, x, len(keys)) for x in all_drawn])
                for chunk, sub, words in zip(*(batch.column(c)[i].as_py() for c in ("chunk", "sub", "words")), strict=True):
                    words = np.frombuffer(unsqueeze(words), np.uint64) >> SHORT
                    found = places(whole[0], words)
                    yield answers_of(part, 1, [(chunk, sub, len(words), 0, squeeze(planes(np.where(found >= 0, whole[1][:, found], 0))))])

    asking = state.select("part", "chunk", "sub", "words").unionByName(swept.where("name is null").select("part", "n", "tables"), allowMissingColumns=True)
    added = of_part(asking, F.col("tables").isNull()).mapInArrow(add_up, answer_schema)
    met = state.mapInArrow(answer, answer_schema).unionByName(added).unionByName(dealt, allowMissingColumns=True)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, tuple[list, ...]] = {}

        def keep(sub, kind, nw, ne, blob) -> None:
            blob = unsqueeze(blob)
            counts, root, tables, seats = got.setdefault(sub, ([], [], [], []))
            if kind:
                tables.append(from_planes(blob, SAMPLES * nw).reshape(SAMPLES, nw))
            else:
                counts.append(from_planes(blob, nw, 0, 8).view(np.int64))
                root.append(from_planes(blob, 2 * SAMPLES * nw, 8 * nw).reshape(2 * SAMPLES, nw))
                seats.append(from_planes(blob, 2 * ne, (8 + 8 * SAMPLES) * nw).reshape(2, ne))

        for _, sub, ids, pairs in _chunks(batches, hot, parts, keep):
            counts, root, tables, seats = got.pop(sub)
            counts, p = predictive(pairs, hot, hyper, totals, np.concatenate(counts), np.concatenate(root, 1), np.concatenate(tables, 1), np.concatenate(seats, 1))
            known = counts[pairs.word[pairs.of_token]]
            at = np.concatenate([[0], np.cumsum(pairs.lengths)[:-1]])
            base = np.log10((known + 1) / (hyper.tokens + hyper.vocabulary + 1.0))
            total = lambda x: np.add.reduceat(x, at)
            scores = total(np.log10(p)[pairs.of_token]) if hyper.tokens else np.zeros(len(at))
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(pairs.lengths.astype(np.int64)), pa.array(total((known > 0).astype(np.int64))), pa.array(np.full(len(ids), hyper.tokens)), pa.array(total(base)), pa.array(scores), pa.array(10 ** (-scores / pairs.lengths))], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    first = F.col("pack").isNotNull()  # answers come first, by part
    rows = in_order(met.select("chunk", "sub", "part", "kind", "nw", "ne", "answer", "pack"), first, "sub", "part", "kind")
    return rows.mapInArrow(finish, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 7) != 2).alias("learn"))
    return score(docs).withColumn("held_out", remainder(F.col("doc_id"), 7) == 2)
