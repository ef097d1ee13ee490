import random

from folio.llm import line_dedup


def brute(rows, long_words=line_dedup.LONG_WORDS):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        kept = []
        for _, n, w, b in line_dedup.split_chunks((text or "").encode(), long_words=long_words):
            if w and (n > 1 or w >= long_words):
                if b in seen:
                    continue
                seen.add(b)
            kept.append(b.decode())
        out[doc_id] = "\n".join(kept)
    return out


def corpus():
    rnd = random.Random(5)
    lines = [" ".join(rnd.choices("abcdefgh", k=rnd.randrange(0, 12))) for _ in range(60)]
    long = " ".join(f"w{i}" for i in range(60))
    shared = lines[:12]
    rows = []
    for i in range(80):
        own = [f"{i} {x}" for x in rnd.choices(lines, k=rnd.randrange(0, 6))]
        rows.append((i, "\n".join([*own, *(shared if i % 3 else []), *([long] if i % 4 == 0 else []), *own[:2]])))
    return [*rows, (100, None), (101, ""), (102, "\n\n\n"), (103, "é " * 30000), (None, "\n".join(shared))]


def test_brute_force(spark):
    rows = corpus()
    for hot in (1000, 2):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, hot=hot).collect()}
        assert got == brute(rows)


def test_chunks_cover_the_text():
    for _, text in corpus():
        b = (text or "").encode()
        parts = line_dedup.split_chunks(b)
        assert b"\n".join(p[3] for p in parts) == b
        assert sum(p[1] for p in parts) == b.count(b"\n") + 1


def test_shift_resistant():
    body = [f"line {i} of the passage" for i in range(40)]
    a, b = ("\n".join([*head, *body]).encode() for head in (["x"], ["y", "z", "q"]))
    one, two = ({p[3] for p in line_dedup.split_chunks(t)} for t in (a, b))
    assert len(one & two) >= len(one) - 2


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, chunk int, _row int")
    assert line_dedup.dedup_lines(empty).count() == 0
    text = "\n".join(f"line {i}" for i in range(30))
    twice = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    n = sorted(r["removed_lines"] for r in line_dedup.dedup_lines(twice).collect())
    assert n[0] == 0 and n[1] > 20


def brute_runs(rows, words=line_dedup.LONG_WORDS):
    """All runs of lines that begin and end with a word, have enough words and stand, without overlap, at an earlier place."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    docs = [(text or "").split("\n") for _, text in rows]
    gone, first = [set() for _ in docs], {}
    for d, lines in enumerate(docs):
        for a in range(len(lines)):
            for b in range(a + 1, len(lines)):
                run = tuple(lines[a : b + 1])
                if run[0].split() and run[-1].split() and sum(len(x.split()) for x in run) >= words:
                    at = first.setdefault(run, (d, a))
                    if at[0] < d or at[1] + len(run) <= a:
                        gone[d].update(range(a, b + 1))
    return {doc_id: g for (doc_id, _), g in zip(rows, gone)}


def spans_of(df):
    return {r["doc_id"]: {i for x in r["removed"] for i in range(x["first"], x["last"] + 1)} for r in line_dedup.dedup_runs(df).collect()}


def test_planted_passages(spark):
    rnd = random.Random(7)
    own = lambda n: [" ".join(rnd.choice("mnopqrst") + str(rnd.randrange(10**6)) for _ in range(9)) for _ in range(n)]
    passages = [[" ".join(f"p{p}l{i}w{j}" for j in range(54 // n + 1)) for i in range(n)] for p in range(30) for n in (2 + p % 5,)]
    rows, planted = [], {}
    for p, passage in enumerate(passages):
        for copy in range(3):
            before = own(rnd.randrange(1, 6))
            rows.append((3 * p + copy, "\n".join([*before, *passage, *own(3)])))
            planted[3 * p + copy] = set(range(len(before), len(before) + len(passage))) if copy else set()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in line_dedup.dedup_runs(df).collect()}
    assert {d: {i for x in r["removed"] for i in range(x["first"], x["last"] + 1)} for d, r in got.items()} == planted
    for doc_id, text in rows:
        lines = text.split("\n")
        assert got[doc_id]["text"] == "\n".join(x for i, x in enumerate(lines) if i not in planted[doc_id])
        assert (got[doc_id]["n_lines"], got[doc_id]["removed_lines"]) == (len(lines), len(planted[doc_id]))


def test_runs_against_brute_force(spark):
    rnd = random.Random(11)
    pool = [" ".join(rnd.choices("abcdefgh", k=rnd.randrange(0, 30))) for _ in range(12)]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randrange(0, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "\n".join(["same ten words " * 3] * 40)), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    chunked = {r["doc_id"]: {i for x in r["removed"] for i in range(x["first"], x["last"] + 1)} for r in line_dedup.dedup_lines(df).collect()}
    want = brute_runs(rows)
    assert spans_of(df) == {d: want[d] | chunked[d] for d in want}
    assert any(want[d] - chunked[d] for d in want)


def test_texts_are_read_once_for_runs(spark):
    """The runs and their first places are one exchange."""
    found = line_dedup.dedup_runs(spark.createDataFrame(corpus(), "doc_id long, text string"))
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_chunk_hashes_are_sparks(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    want = line_dedup.chunks(df).where("removable").select(F.xxhash64("chunk").alias("h"))
    got = line_dedup.chunk_hashes(df)
    assert sorted(r["h"] for r in got.collect()) == sorted(r["h"] for r in want.collect()) != []
