"""Benchmark decontamination by size-partitioned MinHash containment search.

Finds the test items whose distinct five-word shingles (A-Z lower-cased, words split at white space) lie in a document to
80 percent or more, however long the document is. Items are partitioned by size. An item's MinHash sketch is the set of
its s smallest shingle hashes, where s follows from the largest size u of its partition: s = u - ceil(0.8 u) + 1. An item
of u shingles that a document contains to 80 percent misses at most u - ceil(0.8 u) of them there, so at least one of the
sketch is present: no containment is lost. Documents look up each of their shingles among the sketches; candidates are
verified by exact containment over the words themselves.

Items go through in blocks of about `items_per_block`, each block's result being written before the next block is read, so that
what the driver and the executors hold has a bound; each block scans the documents once, and no document is shuffled.

Defined results: an item of fewer than five words is one shingle, its whole sequence, sought as a run of words; items or
texts without words, and null ones, are in no pair; each row of either table counts by itself, so repeated rows repeat
pairs; null ids stay null; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import Words, cut, shingle_hashes, sub_batches, table, text_bytes

SHINGLE = 5
PERCENT = 80
ITEMS_PER_BLOCK = 20_000


def word_list(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingles(words: list[bytes], k: int) -> set[bytes]:
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def needed(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


class ContainmentIndex:
    """Sketches of items, by the length of their shingles and their size."""

    def __init__(self, items: list[tuple[object, bytes]], k: int = SHINGLE, percent: int = PERCENT) -> None:
        self.percent = percent
        self.items: list[tuple[object, int, frozenset[bytes]]] = []
        owners: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = word_list(text)
            if not words:
                continue
            length = min(k, len(words))
            own = frozenset(shingles(words, length))
            number = len(self.items)
            self.items.append((item_id, length, own))
            largest = (1 << len(own).bit_length()) - 1  # of the partition of this size
            sketch = np.unique(shingle_hashes(Words([text]).hashes, length))[: largest - needed(largest, percent) + 1]
            for h in sketch.tolist():
                owners[length][h].append(number)
        self.sketches = {n: (np.array(sorted(o), np.uint64), [o[h] for h in sorted(o)]) for n, o in owners.items()}
        self.filters = {}
        for n, (keys, _) in self.sketches.items():
            self.filters[n] = np.zeros(1 << 20, bool)
            self.filters[n][(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def candidates(self, texts: list[bytes]) -> dict[int, set[int]]:
        """For numbers of texts, the items one of whose sketched shingles they have."""
        found: dict[int, set[int]] = defaultdict(set)
        w = Words(texts)
        for n, (keys, owners) in self.sketches.items():
            h = shingle_hashes(w.hashes, n)
            at = np.flatnonzero(self.filters[n][(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            key = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            hit = keys[key] == h[at]
            at, key = at[hit], key[hit]
            text = np.searchsorted(w.bounds, at, "right") - 1
            whole = at + n <= w.bounds[text + 1]
            for t, o in zip(text[whole].tolist(), key[whole].tolist(), strict=True):
                found[t].update(owners[o])
        return found

    def search(self, texts: list[bytes]) -> list[tuple[int, object, int, int]]:
        """(number of the text, item id, shared shingles, shingles of the item) for each contained item."""
        out = []
        for t, items in sorted(self.candidates(texts).items()):
            words, sets = word_list(texts[t]), {}
            for i in sorted(items):
                item_id, n, own = self.items[i]
                if n not in sets:
                    sets[n] = shingles(words, n)
                shared = len(own & sets[n])
                if 100 * shared >= self.percent * len(own):
                    out.append((t, item_id, shared, len(own)))
        return out


def _blocks(items: DataFrame, items_per_block: int) -> int:
    return max(1, -(-items.count() // items_per_block))


def _indexes(items: DataFrame, items_per_block: int) -> Iterator[ContainmentIndex]:
    """Of about items_per_block items each."""
    items = items.select("item_id", "text")
    blocks = _blocks(items, items_per_block)
    numbered = items.withColumn("_b", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        rows = numbered.where(F.col("_b") == b).select("item_id", "text").collect()  # one block of items
        yield ContainmentIndex([(r["item_id"], (r["text"] or "").encode()) for r in rows])


def contained_items(docs: DataFrame, items: DataFrame, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment for each item of items(item_id, text) that a document has."""
    slim, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    kinds = [df.schema[0].dataType.simpleString() for df in (slim, items)]
    item_kind = items.schema[0].dataType

    def search(index: ContainmentIndex) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_type

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = to_arrow_type(item_kind)
            for batch in batches:
                texts = text_bytes(batch.column("text"))
                for a, b in sub_batches(np.array([len(x) for x in texts]), 1 << 20):
                    found = index.search(texts[a:b])
                    ids = batch.column("doc_id").take(pa.array([a + f[0] for f in found], pa.int64()))
                    shared, size = (np.array([f[i] for f in found], np.int64) for i in (2, 3))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([f[1] for f in found], kind), pa.array(shared), pa.array(size), pa.array(shared / np.maximum(size, 1))], names=["doc_id", "item_id", "shared", "item_shingles", "containment"])

        return slim.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, shared long, item_shingles long, containment double")

    if _blocks(items, items_per_block) == 1:
        return search(next(_indexes(items, items_per_block)))
    return reduce(DataFrame.unionByName, [cut(search(index)) for index in _indexes(items, items_per_block)])


def keep_uncontaminated(docs: DataFrame, items: DataFrame, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """The rows of docs that have none of the items, with all their columns."""

    def without(docs: DataFrame, index: ContainmentIndex) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = text_bytes(batch.column("text"))
                for a, b in sub_batches(np.array([len(x) for x in texts]), 1 << 20):
                    clean = np.ones(b - a, bool)
                    clean[[f[0] for f in index.search(texts[a:b])]] = False
                    yield batch.slice(a, b - a).filter(pa.array(clean))

        return docs.mapInArrow(run, docs.schema)

    if _blocks(items, items_per_block) == 1:
        return without(docs, next(_indexes(items, items_per_block)))
    for index in _indexes(items, items_per_block):
        docs = cut(without(docs, index))
    return docs


def op9_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
_SHINGLES = "unnest(list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))))"

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT doc_id, {_SHINGLES} AS s FROM d WHERE len(w) > 0),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, {_SHINGLES} AS s FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS item_shingles FROM s GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, item_shingles, count(*) / item_shingles AS containment
FROM ds JOIN s USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, item_shingles HAVING 100 * count(*) >= 80 * item_shingles
"""
