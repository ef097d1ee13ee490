"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words (letters, A-Z as a-z) and beginnings of words of PREFIX bytes, so that unseen endings of a known stem count.
A text's vector has all its terms, those that no example has too: (1 + ln count) * idf * weight, of unit length. idf comes
from the examples. The weight, between FAINT and 1, grows with how surely a term goes with label 1 among the examples
(chi-square and odds ratio): no term is left out, but where a text has such terms they say who its neighbours are.

Examples lie in an inverted index in blocks of BLOCK: for each term its postings by block, with the largest weight of each
block; postings of frequent terms are held as rows of a matrix. A query opens its FIRST best blocks, then each block whose
upper bound can beat its k-th best so far: so the neighbours are exact. Votes weigh 1 / (1.05 - cosine); copies
(plain cosine of COPY or more) share one vote and one count in the statistics, each being kept. Isotonic regression over the
votes on each example, its copies left out, makes the score the share of label 1. The nearest three are returned as evidence.

Examples are at most `max_examples` labelled documents, those of the smallest hash; this bound is a parameter of the
classifier. Every text is scored whole.

Defined results: texts without a term, null and empty ones among them, and texts that share no term with an example get the
share of label 1 among examples without terms, or among all; without labels all scores are 0; of several labels of a document the
largest counts, null ones don't, nor do labels without doc_id; of several texts of a document the first by order counts; cosines that
agree to six places are ties, which go to the smaller doc_id; doc_id may have any type; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import IS_LETTER, Words, cut, release, released, remainder, sub_batches, table, text_bytes

MAX_EXAMPLES = 2000
NEIGHBOURS = 15
FIRST = 2
CALM = 10
BLOCK = 64
PREFIX = 5
FAINT = 0.05
COPY = 0.9
DENSE_TERMS = 2048
DENSE_SHARE = 25
THRESHOLD = 0.3
_DOC = 10  # bits of a text's number within a batch of texts, in the place of a term hash's last bits


def text_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, term, count) for the distinct terms of up to 1024 texts, by term and text."""
    w = Words(texts, IS_LETTER)
    long = np.flatnonzero(w.ends - w.starts > PREFIX)
    of_word = np.searchsorted(w.bounds, np.arange(len(w.hashes)), "right") - 1
    keys = np.concatenate([w.hashes, w.prefixes(long, PREFIX)])
    keys = (keys >> np.uint64(_DOC) << np.uint64(_DOC)) | np.concatenate([of_word, of_word[long]]).astype(np.uint64)
    keys, counts = np.unique(keys, return_counts=True)
    return (keys & np.uint64((1 << _DOC) - 1)).astype(np.int64), keys >> np.uint64(_DOC), counts


def text_batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of at most 128 texts and about 1 MB."""
    sizes = np.array([len(x) for x in texts], np.int64)
    return sub_batches(np.maximum(sizes, 1 << 13), 1 << 20)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + lengths[0] - 1, then those of the next."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


class BlockMaxIndex:
    """Vectors of examples by term, in blocks, with the largest weight of each term in each block."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int, block: int = BLOCK, dense_terms: int = DENSE_TERMS, rank: np.ndarray | None = None) -> None:
        """rank: the order of the examples among ties."""
        self.n, self.block, self.blocks = n_docs, block, max(1, -(-n_docs // block))
        self.rank = np.zeros(self.blocks * block, np.int64)
        self.rank[:n_docs] = np.arange(n_docs) if rank is None else rank
        df = np.bincount(term, minlength=n_terms)
        often = np.argsort(-df, kind="stable")[:dense_terms]
        often = often[df[often] * DENSE_SHARE > n_docs]
        self.row = np.full(n_terms, -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.blocks * block), np.float32)
        at = self.row[term] >= 0
        self.dense[self.row[term[at]], doc[at]] = weight[at]
        self.dense_most = self.dense.reshape(len(often), self.blocks, block).max(2) if len(often) else np.zeros((0, self.blocks), np.float32)
        doc, term, weight = doc[~at], term[~at], weight[~at].astype(np.float32)
        order = np.lexsort((doc, term))
        self.ids, term, self.weights = doc[order].astype(np.int32), term[order], weight[order]
        key = term * self.blocks + self.ids // block
        self.pair_start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        self.pair_size = np.diff(np.append(self.pair_start, len(key)))
        self.pair_block = self.ids[self.pair_start] // block
        self.pair_most = np.maximum.reduceat(self.weights, self.pair_start) if len(key) else self.weights
        self.first_pair = np.searchsorted(term[self.pair_start], np.arange(n_terms + 1))

    def nearest(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, without: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k examples of the largest cosine above 0 for each of n queries, exactly; -1 and 0
        where there are fewer. without: examples that are left out, for each query."""
        q = np.zeros((n, len(self.dense)), np.float32)
        row = self.row[term]
        q[doc[row >= 0], row[row >= 0]] = weight[row >= 0]
        doc, term, weight = doc[row < 0], term[row < 0], weight[row < 0].astype(np.float32)
        pairs = self.first_pair[term + 1] - self.first_pair[term]
        pair, pair_doc, pair_weight = ranges(self.first_pair[term], pairs), np.repeat(doc, pairs), np.repeat(weight, pairs)
        own = pair_doc * self.blocks + self.pair_block[pair]
        bounds = q @ self.dense_most + np.bincount(own, pair_weight * self.pair_most[pair], n * self.blocks).reshape(n, self.blocks)
        width = self.blocks * self.block
        scores, opened = np.zeros((n, width)), np.zeros((n, self.blocks), bool)
        k = min(k, width)
        for wave in range(2):
            if wave == 0:
                want = np.zeros_like(opened)
                best = np.argpartition(-bounds, min(FIRST, self.blocks) - 1, axis=1)[:, :FIRST]
                want[np.arange(n)[:, None], best] = True
            else:
                least = np.partition(scores, width - k, axis=1)[:, width - k] - 3e-6
                want = ~opened & (bounds >= least[:, None])
            want &= bounds > 0
            for b in np.flatnonzero(want.any(0)).tolist():
                at, cols = np.flatnonzero(want[:, b]), slice(b * self.block, (b + 1) * self.block)
                scores[at, cols] = q[at] @ self.dense[:, cols]
            use = want[pair_doc, self.pair_block[pair]]
            sizes = self.pair_size[pair[use]]
            posting = ranges(self.pair_start[pair[use]], sizes)
            at = np.repeat(pair_doc[use], sizes) * width + self.ids[posting]
            scores += np.bincount(at, np.repeat(pair_weight[use], sizes) * self.weights[posting], n * width).reshape(n, width)
            for i, left_out in enumerate(without or []):
                scores[i, left_out] = 0
            opened |= want
        keys = np.rint(scores * 1e6).astype(np.int64) * width + (width - 1 - self.rank)
        top = np.argpartition(keys, width - k, axis=1)[:, width - k :]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(keys, top, 1), axis=1), 1)
        cosines = np.take_along_axis(scores, top, 1)
        return np.where(cosines > 0.5e-6, top, -1), np.where(cosines > 0.5e-6, cosines, 0.0)


class Isotonic:
    """The non-decreasing function of votes with the least weighted squares from labels; at both ends of
    a pool its value is drawn to the vote there as by CALM more rows, and between ends it is interpolated."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []  # smallest x, sums of y and of weights, largest x
        for a, b, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
            pools.append([a, w * b, w, a])
            while len(pools) > 1 and (pools[-2][3] == pools[-1][0] or pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
                last = pools.pop()
                pools[-1] = [pools[-1][0], pools[-1][1] + last[1], pools[-1][2] + last[2], last[3]]
        ends = np.array([(p[i], (p[1] + CALM * p[i]) / (p[2] + CALM)) for p in pools for i in (0, 3)])
        self.votes, self.values = ends[:, 0], np.maximum.accumulate(ends[:, 1])

    def __call__(self, votes: np.ndarray) -> np.ndarray:
        return np.interp(votes, self.votes, self.values)


def _alike(doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, labels: np.ndarray) -> np.ndarray:
    """An order of examples that puts those of one label and alike vectors side by side, for tight bounds: by label, then by
    the sign and size of the leading directions of a random projection, drawn out by a few power steps."""
    rng = np.random.default_rng(0)
    n_terms = int(term.max()) + 1 if len(term) else 1
    x = rng.standard_normal((n, 4))
    for _ in range(6):
        y = np.stack([np.bincount(term, weight * x[doc, j], n_terms) for j in range(4)], 1)
        x = np.stack([np.bincount(doc, weight * y[term, j], n) for j in range(4)], 1)
        x, _ = np.linalg.qr(x) if n >= 4 else (x, None)
    signs = (x[:, 1:] > np.median(x[:, 1:], axis=0)) @ (1 << np.arange(x.shape[1] - 1))
    return np.lexsort((x[:, min(1, x.shape[1] - 1)], signs, labels))


class ToxicityModel:
    """From examples: ids, labels (0 or 1), and (doc, term, count) of their terms."""

    def __init__(self, ids: list, labels: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        n = len(ids)
        has = np.bincount(doc, minlength=n) > 0
        self.prior = float(labels.mean()) if n else 0.0
        self.empty = float(labels[~has].mean()) if (~has).any() else self.prior
        self.hashes, of = np.unique(term, return_inverse=True)
        df = np.bincount(of, minlength=len(self.hashes))
        idf = np.log((1 + n) / (1 + df)) + 1
        plain = (1 + np.log(count)) * idf[of]
        norms = np.sqrt(np.bincount(doc, plain**2, n))
        order = _alike(doc, of, plain / np.maximum(norms[doc], 1e-12), n, labels) if n else np.empty(0, np.int64)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        by_id = np.argsort(np.argsort(np.array([ids[i] for i in order], object))) if n else order
        self.ids, self.labels = [ids[i] for i in order], labels[order].astype(float)
        doc = place[doc]
        order = np.lexsort((of, doc))
        doc, of, count, plain = doc[order], of[order], count[order], plain[order]
        norms = np.sqrt(np.bincount(doc, plain**2, n))
        copies = self._copies(doc, of, plain / norms[doc], n) if n else []
        self.share = np.array([1 / max(1, len(c)) for c in copies])
        self.weight = idf * self._weights(doc, of, n) if n else idf
        self.new_weight = (np.log(1 + n) + 1) * FAINT
        x = (1 + np.log(count)) * self.weight[of]
        x /= np.sqrt(np.bincount(doc, x**2, n))[doc]
        self.index = BlockMaxIndex(doc, of, x, n, len(self.hashes), rank=by_id)
        votes = np.full(n, self.prior)
        bounds = np.searchsorted(doc, np.arange(n + 1))
        for a in range(0, n, 128):
            b, own = min(n, a + 128), slice(bounds[a], bounds[min(n, a + 128)])
            near = self.index.nearest(doc[own] - a, of[own], x[own], b - a, NEIGHBOURS, [np.append(c, a + i) for i, c in enumerate(copies[a:b])])
            votes[a:b] = self.votes(*near)
        told = np.bincount(doc, minlength=n) > 0
        self.calibrated = Isotonic(votes[told], self.labels[told], self.share[told]) if told.any() else lambda v: v

    @staticmethod
    def _copies(doc: np.ndarray, of: np.ndarray, x: np.ndarray, n: int) -> list[np.ndarray]:
        """For each example those of plain cosine COPY or more, itself included; 64 of them at most, which bounds its share
        from below."""
        index = BlockMaxIndex(doc, of, x, n, int(of.max()) + 1 if len(of) else 1)
        bounds = np.searchsorted(doc, np.arange(n + 1))
        out: list[np.ndarray] = []
        for a in range(0, n, 128):
            b, own = min(n, a + 128), slice(bounds[a], bounds[min(n, a + 128)])
            near, cosines = index.nearest(doc[own] - a, of[own], x[own], b - a, 64)
            out += [ids[c >= COPY] for ids, c in zip(near, cosines, strict=True)]
        return out

    def _weights(self, doc: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Of each term, FAINT to 1: copies together count once."""
        share = self.share
        seen = np.bincount(of, share[doc], len(self.hashes))
        toxic = np.bincount(of, (share * self.labels)[doc], len(self.hashes))
        total, bad = share.sum(), (share * self.labels).sum()
        if not 0 < bad < total:
            return np.full(len(self.hashes), FAINT)
        a, b, c, d = toxic, seen - toxic, bad - toxic, total - seen - bad + toxic  # label 1 and 0 with the term, then without
        chi2 = total * (a * d - b * c) ** 2 / np.maximum(bad * (total - bad) * seen * (total - seen), 1e-9)
        odds = (a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))
        sure = np.clip((chi2 - 15) / 30, 0, 1) * np.clip(np.log(odds / 4) / np.log(4), 0, 1) * (seen >= 3)
        return FAINT + (1 - FAINT) * sure

    def votes(self, near: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        w = np.where(near >= 0, self.share[near] / (1.05 - np.minimum(cosines, 1.0)), 0.0)
        return ((w * self.labels[near]).sum(1) + self.prior) / (w.sum(1) + 1)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, and numbers and cosines of the nearest examples, of up to 1024 texts."""
        n = len(texts)
        if not self.ids:
            return np.zeros(n), np.full((n, 1), -1), np.zeros((n, 1))
        doc, term, count = text_terms(texts)
        at = np.minimum(np.searchsorted(self.hashes, term), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == term if len(self.hashes) else np.zeros(len(term), bool)
        x = (1 + np.log(count)) * np.where(known, self.weight[at], self.new_weight) if len(self.hashes) else np.zeros(0)
        x /= np.sqrt(np.bincount(doc, x**2, n))[doc] if len(x) else 1.0
        near, cosines = self.index.nearest(doc[known], at[known], x[known], n, NEIGHBOURS)
        return np.where(near[:, 0] >= 0, self.calibrated(self.votes(near, cosines)), self.empty), near, cosines


def train(labelled: DataFrame, max_examples: int = MAX_EXAMPLES) -> ToxicityModel:
    """From labelled(doc_id, text, toxic)."""
    known = labelled.where("doc_id is not null and toxic is not null")
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    sample = known.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            texts = text_bytes(batch.column("text"))
            for a, b in text_batches(texts):
                doc, term, count = text_terms(texts[a:b])
                order = np.lexsort((term, doc))
                offsets = np.searchsorted(doc[order], np.arange(b - a + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[order].astype(np.int64))) for x in (term, count)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("toxic").slice(a, b - a).cast("int32"), *lists], names=["doc_id", "toxic", "terms", "counts"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    found = cut(sample.mapInArrow(terms, f"doc_id {kind}, toxic int, terms array<long>, counts array<long>")).orderBy("doc_id").toArrow()  # max_examples at most
    ids = found["doc_id"].to_pylist()
    labels = np.array([int(x == 1) for x in found["toxic"].to_pylist()])
    lists = found["terms"].combine_chunks()
    doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False)) if ids else np.empty(0, np.int64)
    flat = lambda c: found[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    model = ToxicityModel(ids, labels, doc, flat("terms").view(np.uint64), flat("counts"))
    del found, lists, doc
    release()
    return model


def score(docs: DataFrame, model: ToxicityModel, column: str = "text") -> DataFrame:
    """doc_id, score, predicted and the three nearest examples (doc_id, label, cosine) of every row of docs(doc_id, text)."""
    from pyspark.sql.pandas.types import to_arrow_type

    field = docs.schema["doc_id"].dataType
    near_type = pa.list_(pa.struct([("doc_id", to_arrow_type(field)), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            texts = text_bytes(batch.column(column))
            for a, b in text_batches(texts):
                scores, near, cosines = model.score(texts[a:b])
                shown = [[{"doc_id": model.ids[i], "label": int(model.labels[i]), "cosine": s} for i, s in zip(n, c, strict=True) if i >= 0] for n, c in zip(near[:, :3].tolist(), cosines[:, :3].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(shown, near_type)], names=["doc_id", "score", "predicted", "nearest"])

    kind = field.simpleString()
    return docs.select("doc_id", column).mapInArrow(run, f"doc_id {kind}, score double, predicted int, nearest array<struct<doc_id:{kind},label:int,cosine:double>>")


def keep_clean(docs: DataFrame, model: ToxicityModel, column: str = "text") -> DataFrame:
    """The rows of docs with a score under THRESHOLD, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            texts = text_bytes(batch.column(column))
            for a, b in text_batches(texts):
                yield batch.slice(a, b - a).filter(pa.array(model.score(texts[a:b])[0] < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def train_from_tables(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> ToxicityModel:
    """The examples are chosen among the labels first, of the three quarters that may be learnt from, so that few texts are joined."""
    learn = labels.where((remainder(F.col("doc_id"), 4) != 2) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = learn.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    return train(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), max_examples)


def op4_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_from_tables(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
