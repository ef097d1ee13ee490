"""Substring dedup against a dictionary of all windows, and against the SQL."""

import random
import re
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from folio.llm import substrings as S
from folio.llm.substrings import dedup, least, op12_substring_dedup, run_hashes


def brute(rows, window):
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in docs for i in range(len(w) - window + 1))
    out = []
    for d, w in docs:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((d, len(w), len(gone), sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def texts(seed):
    random.seed(seed)
    word = lambda: random.choice(["a", "b", "c", "A", "é", "x y", "日本", "w1", "w2", "w3", "w4", "w5"])
    passages = [[word() for _ in range(random.randint(3, 40))] for _ in range(12)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(random.randint(0, 5)):
            w += random.choice(passages) if random.random() < 0.5 else [word() for _ in range(random.randint(0, 25))]
        rows.append((i, random.choice([" ", "\n", " \t ", "\r\n"]).join(w)))
    rows += [(500, None), (501, ""), (502, " \n "), (503, "a " * 400), (504, "a b " * 300), (505, "a b c " * 9), (None, rows[7][1]), (7, rows[7][1]), (506, " ".join(passages[0])), (507, " ".join(passages[0]))]
    return rows


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("chunk", T.StringType()), T.StructField("n_words", T.IntegerType())])


@pytest.mark.parametrize(("window", "seed", "chunk_bytes", "mask"), [(5, 2, 300, (1 << 64) - 1), (8, 12, 1 << 20, (1 << 64) - 1), (35, 12, 2000, (1 << 64) - 1), (5, 3, 500, 0xFFF), (6, 3, 5000, 0xF), (5, 2, 900, 0)])
def test_against_brute_force(spark, window, seed, chunk_bytes, mask):
    rows = texts(window)
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, dedup(docs, window, seed, chunk_bytes, mask).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert got == brute(rows, window)


def test_empty_table(spark):
    assert dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_entry_a_chunk_for_a_passage_of_all_documents(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(200).selectExpr("id doc_id", f"concat('own', id, ' {passage}') text").coalesce(1)
    chunks = S.chunked(docs, 5000)
    told = S.repeated(S.seeds(chunks, 1, 35, 12))
    sent = S.edges(chunks, told, 1, 35, 12, (1 << 64) - 1).collect()
    assert len(sent) == chunks.count() > 5
    assert max(len(r["hashes"]) // 8 for r in sent) <= 26 + 200 // len(sent) * 2
    assert {r["n_removed"] for r in dedup(docs, chunk_bytes=5000).collect()} == {60}


def test_paths_are_rows_not_windows(spark):
    passage = " ".join(f"w{i}" for i in range(500))
    docs = spark.createDataFrame([(i, f"o{i} {passage} p{i}") for i in range(4)], "doc_id long, text string").coalesce(1)
    chunks = S.chunked(docs)
    told = S.repeated(S.seeds(chunks, 1, 35, 12))
    rows = S.spans(chunks, told, S.degrees(S.edges(chunks, told, 1, 35, 12, (1 << 64) - 1)), 35, 12, (1 << 64) - 1).where("first is not null").collect()
    assert sorted(r["windows"] for r in rows) == [466] and rows[0]["words"].decode() == passage
    assert sum(len(r["places"]) for r in rows) == 4


def test_hashes_and_minima():
    h = np.random.default_rng(1).integers(0, 1 << 63, 200).astype(np.uint64)
    for k in (1, 2, 3, 12, 35, 64, 200):
        made = run_hashes(h, k)
        assert len(made) == 200 - k + 1 and len({*made.tolist()}) == len(made)
        assert (run_hashes(np.r_[h, h], k)[200:] == made).all()
        assert (least(h, k) == [h[i : i + k].min() for i in range(200 - k + 1)]).all()


def test_buckets_are_even(spark):
    """Smallest hashes are small, but no bucket gets more seeds than another; those of edges follow what is repeated."""
    alone = spark.range(30).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(1, 900), i -> md5(concat(id, 'x', i)))) text").coalesce(1)
    sent = S.seeds(S.chunked(alone, 50_000), 16, 35, 12)
    sizes = Counter()
    for r in sent.collect():
        sizes[r["bucket"]] += len(r["hashes"]) // 8
    assert len(sizes) == 16 and max(sizes.values()) < 1.5 * sum(sizes.values()) / 16
    told = S.repeated(sent)
    assert S.edge_buckets(told, 100 * S.BUCKET_BYTES) == 1
    again = S.repeated(S.seeds(S.chunked(alone.union(alone), 50_000), 16, 35, 12))
    assert S.edge_buckets(again, 100 * S.BUCKET_BYTES) == 284


def test_packed_texts_come_back():
    for texts in ([], [b""], [b"", "é \n".encode(), b"", b"x" * 1000]):
        assert S.unpacked(S.packed(texts)) == texts


def test_whole_table_against_sql(spark):
    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
    con.execute(S.SQL)
    assert sorted(map(tuple, op12_substring_dedup(spark, path).collect())) == sorted(con.fetchall())
