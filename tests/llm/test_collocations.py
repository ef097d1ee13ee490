"""Collocations against a count of all phrases, one by one, and against the SQL."""

import random
import re
import tracemalloc
from collections import Counter
from decimal import Decimal

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from folio.llm import collocations as C
from folio.llm.collocations import collocations, op11_collocations, scored

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, covered, top):
    f = Counter()
    total = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            total["und" if lang is None else lang] += len(w)
            for n in range(1, 5):
                f.update(("und" if lang is None else lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    c = {x: n for x, n in f.items() if len(x[1]) > 1 and n >= least}
    dropped = set()
    for (lang, p), n in c.items():
        dropped |= {(lang, p[i : i + m]) for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * n >= covered * f[lang, p[i : i + m]]}
    out = []
    for lang in sorted(total):
        best = []
        for (of, p), a in c.items():
            if of == lang and (lang, p) not in dropped:
                score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return out


@pytest.mark.parametrize(("least", "top", "combined"), [(2, 50, 200), (3, 10_000, 1 << 20)])
def test_against_brute_force(spark, monkeypatch, least, top, combined):
    monkeypatch.setattr(C, "COMBINED", combined)
    random.seed(least)
    words = ["the", "of", "THE", "a", "b", "c", "d", "é", "É", "x y", "n't", "日本", " ", "z", "q\u0085q"]
    rows = [(random.choice(["en", "fr", None, "und", ""]), "".join(random.choice(words) + random.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!"]) for _ in range(random.randint(0, 60)))) for _ in range(120)]
    rows += [("en", None), (None, None), ("en", ""), ("de", " .,\t"), ("en", "a b c d " * 400)] + [("en", "One line, again and again.")] * 40
    docs = spark.createDataFrame([(lang, text, 1, "x", 2) for lang, text in rows], T.StructType([T.StructField("lang", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("piece", T.StringType()), T.StructField("rank", T.IntegerType())])).repartition(3)
    assert sorted(map(tuple, collocations(docs, least, 4, 80, top).collect())) == brute(rows, least, 80, top)


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_sums_beyond_64_bits(spark):
    big = 9 * 10**18
    candidates = spark.createDataFrame([("en", "a b", big), ("en", "a b c", big // 3)], "lang string, phrase string, a long")
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big + 7), ("en", "c", big // 2), ("en", "a b", big), ("en", "b c", big // 2)], "lang string, gram string, n long")
    got = {r["phrase"]: (r["score"], r["l"], r["r"]) for r in scored(candidates, counts).collect()}
    assert got["a b"] == (2000000 * big // (2 * big + 7), big, big + 7)
    assert got["a b c"] == (min(int(Decimal(2000000) * (big // 3) // (big + big // 2)), 2000000 * (big // 3) // (big + big // 2)), big, big // 2)


def test_a_bucket_larger_than_its_memory(spark, monkeypatch):
    monkeypatch.setattr(C, "BUCKET_MEMORY", "24MB")
    rows = spark.range(600_000).selectExpr("'en' lang", "concat('a rather long word number ', id % 300000) gram", "id % 2 + 1 n").coalesce(1)
    got = C.counted(rows, 2)
    assert got.selectExpr("count(*)", "sum(n)", "min(n)", "max(n)").first()[:] == (300_000, 900_000, 2, 4)


def test_whole_table_against_sql(spark):
    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
    con.execute(C.SQL)
    assert sorted(map(tuple, op11_collocations(spark, path).collect())) == sorted(con.fetchall())


@pytest.mark.parametrize("n", [1, 2, 4])
def test_a_group_takes_little_memory(n):
    """Strings are made for distinct n-grams, some at a time, and not for every place at once."""
    random.seed(n)
    vocabulary = [f"word{i}" for i in range(20_000)]
    text = [" ".join(random.choices(vocabulary, k=12)) for _ in range(40_000)]
    group = pa.table({"lang": ["en", "fr"] * 20_000, "piece": text, "n": pa.array([3] * 40_000)})
    want = Counter()
    for lang, piece in zip(["en", "fr"] * 20_000, text, strict=True):
        w = piece.split(" ")
        want.update((lang, " ".join(w[i : i + n])) for i in range(13 - n))
    list(C.found_in(group.slice(0, 10), n, None))
    tracemalloc.start()
    got, most = {}, 0
    for batch in C.found_in(group, n, None if n == 1 else C.np.full(1 << 17, 255, C.np.uint8)):
        most = max(most, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True))
        assert not got.keys() & {r[:2] for r in rows}
        got |= {r[:2]: r[2] for r in rows}
        tracemalloc.start()
    tracemalloc.stop()
    assert got == {k: 3 * v for k, v in want.items()}
    assert most < 16 * sum(map(len, text))
