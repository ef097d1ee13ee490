import random
from collections import defaultdict

import duckdb
import pytest

from folio.llm import jaccard_join


def shingles(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def near_copies():
    """Groups of near copies with exact copies of some, and documents of several rows."""
    rnd = random.Random(2)
    texts = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(150)]
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    rows += [(200 + i, texts[i * 7]) for i in range(14)]
    return [*rows, (300, texts[0]), (300, texts[30]), (301, texts[30]), (302, ""), (303, None), (None, texts[0])]


@pytest.mark.parametrize("block", [64, 7])
def test_link_counts(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies()
    sets = defaultdict(list)
    for doc_id, text in rows:
        if doc_id is not None:
            sets[doc_id].append(shingles(text))
    want = {d: sum(any(similar(a, b) for a in own for b in sets[e]) for e in sets if e != d) for d, own in sets.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.link_counts(df).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["n_links"] for r in got if r["doc_id"] is not None} == want
    kept = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in jaccard_join.join_components(df).collect())
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in got) == kept


def test_link_counts_sql(spark):
    rows = [r for r in near_copies() if r[0] not in (None, 300)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = jaccard_join.link_counts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(jaccard_join.LINKS_SQL).fetchall())
