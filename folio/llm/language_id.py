"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes: how often each byte followed each context of 0 to ORDER bytes. A byte
seen after the longest known context costs -log2(c / (t + d)) bits (c: its count there, t: all counts, d: distinct
bytes); one not seen costs the escape -log2(d / (t + d)) and is then looked for after the next shorter context, down to
equal odds for all 256 bytes. Statistics are frozen after training, so the exact code length of a text is a sum over its runs of ORDER + 1
bytes. `PpmModel` keeps the nodes of all languages' trees together: for each run of k + 1 bytes its whole cost in
each language, escapes included, and for each context its escape in each language, in hashed tables. A run that no language has costs the
escape of its context and what its end costs one order below. The language with the shortest code wins; the score is
its share of the probability.

Training takes at most `train_docs` labelled documents of each language, those of the smallest hash, whole texts; this
bound is a parameter of the classifier, and with the number of languages it bounds the tables. A-Z count as a-z. Every
text is scored whole.

Defined results: `und` with score 0 for null texts, texts without a letter, and if there is nothing to learn from;
documents with null lang teach nothing; equal codes go to the first language by name; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import LOWER, mix, released, remainder, sub_batches, table, text_bytes

TRAIN_DOCS = 4000
ORDER = 4
_PAD = b"\n" * ORDER
_ASCII_LETTER = re.compile(b"[A-Za-z]").search


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each after ORDER newlines, and where each begins (its newlines included)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + ORDER for x in texts], out=at[1:])
    return LOWER[np.frombuffer(_PAD + _PAD.join(texts), np.uint8)], at


def _runs(b: np.ndarray) -> np.ndarray:
    """For each byte from the ORDER-th on, it and the ORDER before it as one integer."""
    out = np.zeros(len(b) - ORDER, np.int64)
    for i in range(ORDER + 1):
        out = (out << 8) | b[i : len(b) - ORDER + i]
    return out


def count_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ORDER + 1 bytes of some texts (a context and the byte after it), and their counts."""
    b, at = _joined(texts)
    inside = np.ones(len(b), bool)
    for i in range(ORDER):
        inside[at[:-1] + i] = False  # the padding itself isn't coded
    return np.unique(_runs(b)[inside[ORDER:]], return_counts=True)


class Places:
    """Places of distinct keys: each key has a slot of its own in the first table where its hash meets none before it."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.tables: list[np.ndarray] = []
        left = np.arange(len(keys))
        while len(left):
            slots = np.full(1 << (4 * len(left) - 1).bit_length(), -1, np.int32)
            at = self._slots(keys[left], len(self.tables), len(slots))
            slots[at[::-1]] = left[::-1]
            self.tables.append(slots)
            left = left[slots[at] != left]

    @staticmethod
    def _slots(keys: np.ndarray, table: int, size: int) -> np.ndarray:
        return (mix(keys.view(np.uint64) + np.uint64(table << 48)) & np.uint64(size - 1)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """-1 for keys that aren't there."""
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for table, slots in enumerate(self.tables):
            found = slots[self._slots(keys[left], table, len(slots))]
            hit = (found >= 0) & (self.keys[found] == keys[left])
            out[left[hit]] = found[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


class PpmModel:
    """Code lengths in bits, in each of `languages`."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.languages = sorted(grams)
        self.orders: list[tuple[Places, np.ndarray, Places, np.ndarray]] = []
        for k in range(ORDER + 1):
            trees = []
            for name in self.languages:
                keys, counts = grams[name]
                runs, of = np.unique(keys & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
                times = np.bincount(of, counts, len(runs))
                contexts, of = np.unique(runs >> 8, return_inverse=True)
                trees.append((runs, times, contexts, np.bincount(of, times), np.bincount(of), of))
            none = np.empty(0, np.int64)
            all_runs, all_contexts = (np.unique(np.concatenate([none, *[t[i] for t in trees]])) for i in (0, 2))
            escapes = np.zeros((len(all_contexts), len(trees)), np.float32)
            for j, (_, _, contexts, total, distinct, _) in enumerate(trees):
                escapes[np.searchsorted(all_contexts, contexts), j] = -np.log2(distinct / (total + distinct))
            costs = escapes[np.searchsorted(all_contexts, all_runs >> 8)] + self._costs(all_runs & ((1 << 8 * k) - 1), k - 1)
            for j, (runs, times, _, total, distinct, of) in enumerate(trees):
                costs[np.searchsorted(all_runs, runs), j] = -np.log2(times / (total + distinct)[of])
            self.orders.append((Places(all_runs), costs.astype(np.float32), Places(all_contexts), escapes))

    def _costs(self, runs: np.ndarray, k: int) -> np.ndarray:
        """Costs of the last byte of runs of k + 1 bytes, a column for each language."""
        if k < 0:
            return np.full((len(runs), len(self.languages)), 8.0, np.float32)
        places, costs, contexts, escapes = self.orders[k]
        at = places(runs)
        if not len(costs):
            return self._costs(runs & ((1 << 8 * k) - 1), k - 1)
        out = costs[at]
        missing = np.flatnonzero(at < 0)
        if len(missing):
            keys = runs[missing]
            known = contexts(keys >> 8)
            out[missing] = np.where(known[:, None] >= 0, escapes[known], 0) + self._costs(keys & ((1 << 8 * k) - 1), k - 1)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        b, at = _joined(texts)
        costs = self._costs(_runs(b), ORDER)
        costs = np.concatenate([costs, np.zeros((ORDER + 1, costs.shape[1]), np.float32)])
        for i in range(ORDER):
            costs[np.maximum(at[1:-1] - ORDER + i, 0)] = 0  # bytes of the next text's padding
        return np.add.reduceat(costs, at[:-1], axis=0, dtype=np.float64)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, share of the probability and bits a byte of each text."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        bits = self.code_lengths(texts)
        best = bits.argmin(1)
        least = bits[np.arange(len(texts)), best]
        share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        known = np.array([has_letter(x) for x in texts], bool)
        names = [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
        return names, np.where(known, share, 0.0), np.where(known, least / np.maximum([len(x) for x in texts], 1), 0.0)


def train(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> PpmModel:
    """From labelled(doc_id, text, lang): at most train_docs documents of each language."""
    keyed = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("_h"))
    # Hashes are counted by their first 16 bits, so that only those about the last one taken are ranked in one task
    part = F.shiftright("_h", 48)
    hashes = keyed.select("lang", "_h").distinct()
    counts = hashes.groupBy("lang", part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("lang").orderBy("_part")) - F.col("_n")
    last = counts.withColumn("_before", before).where(F.col("_before") < train_docs).groupBy("lang").agg(F.max("_part").alias("_last"))
    near = hashes.join(F.broadcast(last), "lang").where(part <= F.col("_last")).select("lang", "_h")
    order = Window.partitionBy("lang").orderBy("_h")
    chosen = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= train_docs).drop("_n")
    texts = keyed.join(F.broadcast(chosen), ["lang", "_h"]).groupBy("lang", "_h").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = np.array(batch.column("lang").to_pylist(), object), text_bytes(batch.column("text"))
            for lang in sorted(set(langs)):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for a, b in sub_batches(np.array([len(x) for x in own]), 1 << 21):
                    keys, counts = count_grams(own[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    rows = texts.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return PpmModel({str(k): (g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.int64)) for k, g in rows.groupby("lang")})


def identify(docs: DataFrame, model: PpmModel) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            texts = text_bytes(batch.column("text"))
            for a, b in sub_batches(np.array([len(x) for x in texts]), 1 << 20):
                names, share, bits = model.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(names, pa.string()), pa.array(share), pa.array(bits)], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, bits_per_byte double")


def op1_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(remainder(F.col("doc_id"), 4) != 2))
    return identify(docs, model).withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
