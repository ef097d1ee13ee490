"""Each operator against a brute-force version, an exact round trip or held-out accuracy, with nulls, empty and long texts,
ties, repeated rows, empty tables and other columns whose names clash."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import bpe, decontamination, exact_dedup, jaccard_join, language_id, language_model, range_codec, sharding, token_files, toxicity
from folio.llm.common import shared_dir
from folio.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
P = pytest.importorskip("public_tokenizers")


def corpus(n=120, seed=3):
    """Random texts with copies, near copies, shared passages and odd rows."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdeghiklmnorst", k=rnd.randrange(1, 9))) for _ in range(400)]
    passage = " ".join(rnd.choices(words, k=60))
    texts = []
    for i in range(n):
        kind = rnd.random()
        if texts and kind < 0.2:
            texts.append(rnd.choice(texts))
        elif texts and kind < 0.45:
            w = rnd.choice(texts).split()
            for _ in range(rnd.randrange(1, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            texts.append(" ".join(w))
        else:
            body = rnd.choices(words, k=rnd.choice([1, 3, 4, 5, 8, 40, 120]))
            if kind > 0.8:
                body += passage.split()
            texts.append(" ".join(body).capitalize())
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    odd = [None, "", " \n\t", "x", "X", " x", "é ü 漢 🙂", "a b\x1cc\x85d e f", "long " * 30_000, "y" * 50_000]
    return rows + [(n + i, t, None, None, None) for i, t in enumerate(odd)] + [(0, rows[0][1], "en", "s", 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def split(text):
    return (text or "").encode().lower().split()


# Sharding


def test_sharding(spark):
    rows = [*corpus(), (None, "n", None, None, None), (None, None, None, None, None)]
    got = sharding.shard(frame(spark, rows), 16).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shard(frame(spark, rows).repartition(7), 16).collect()
    key = lambda r: (r["row_number"], r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert [r["row_number"] for r in sorted(got, key=lambda r: r["row_number"])] == list(range(len(rows)))
    assert sharding.shard(frame(spark, rows).where("false")).count() == 0
    clash = frame(spark, rows).withColumnsRenamed({"lang": "_tie", "source": "shard", "n_chars": "slot"})
    assert Counter((r["shard"], r["slot"]) for r in sharding.shard(clash, 16).collect()) == Counter((r["shard"], r["slot"]) for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 99, 100, 101, 997])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    p = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 7)).collect()]
    assert sorted(p) == list(range(n))
    if n > 90:
        assert p != list(range(n)) and sum(abs(a - b) == 1 for a, b in zip(p, p[1:], strict=False)) < n / 5


# BPE


@pytest.fixture(scope="module")
def encoders():
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.TreeEncoder(ranks, P.PATTERN), bpe.TreeEncoder(ranks, P.PATTERN, block_chars=3, piece_bytes=2)


TEXTS = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "é", "'s", "'", "'ll", "1", "22", "\x1c", "\x85", " ", "　", "...", "ing", "漢", "🙂", "er", "nth", "ß", "_", "<|endoftext|>"]), max_size=60).map("".join) | st.text(max_size=40)


@settings(max_examples=400, deadline=None)
@given(text=TEXTS)
def test_tree_encoding(encoders, text):
    library, *trees = encoders
    for tree in trees:
        assert np.frombuffer(tree.encode_text(text), np.int32).tolist() == library.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(a=st.binary(max_size=60), b=st.binary(max_size=60))
def test_joined_tokens(encoders, a, b):
    tree = encoders[2]
    assert tree.join_tokens(tree._short(a), tree._short(b)) == tree._short(a + b)


def test_no_library_encodes(encoders, monkeypatch):
    """Ids come from the tree alone, and are those of the library on whole documents."""
    monkeypatch.setitem(__import__("sys").modules, "tiktoken", None)
    tree = bpe.TreeEncoder(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    tree.cache.most = tree.nodes.most = tree.pairs.most = 50
    joins = []
    own = tree.join_tokens
    tree.join_tokens = lambda a, b: joins.append(1) or own(a, b)
    for _, t, *_ in corpus(60):
        assert np.frombuffer(tree.encode_text(t or ""), np.int32).tolist() == encoders[0].encode_ordinary(t or "")
    assert len(joins) > 1000


def test_bpe_round_trip(spark, encoders):
    rows = corpus(40)
    df = frame(spark, rows).withColumnRenamed("lang", "IDS")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.decode(bpe.encode(df, path, P.PATTERN), path).collect()
    want = Counter((d, tuple(encoders[0].encode_ordinary(t or ""))) for d, t, *_ in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in got) == Counter((d, (t or "").encode()) for d, t, *_ in rows)


# Exact dedup


@pytest.mark.parametrize(("size", "hot"), [(4096, 1000), (7, 1000), (3, 2)])
def test_exact_dedup(spark, size, hot):
    rows = [(d, t[:600] if t else t, *x) for d, t, *x in corpus(60)] + [(500, "a b c", *[None] * 3), (501, "abc", *[None] * 3), (None, " abc", *[None] * 3)]
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[norm(t)].append((-len(t or ""), d is None, d or 0, d))
    want = {k: (min(v)[3], len(v)) for k, v in groups.items()}
    got = exact_dedup.dedup(frame(spark, rows), size=size, hot=hot).collect()
    texts = Counter((d, want[norm(t)]) for d, t, *_ in rows)
    assert Counter((r["doc_id"], (r["keep_id"], r["group_size"])) for r in got) == texts
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    clash = frame(spark, rows).withColumnRenamed("lang", "_row")
    stay = exact_dedup.keep_one(clash)
    assert stay.count() == len(groups) and stay.columns == clash.columns
    assert exact_dedup.dedup(frame(spark, rows).where("false")).count() == 0


# Components and the n-gram join


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(200, 260)] + [(rnd.randrange(300, 340), rnd.randrange(300, 340)) for _ in range(25)] + [(None, 1), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["v"]: r["c"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in list(parent) if v in got} and set(got) == {x for a, b in edges if a is not None and a != b for x in (a, b)}


def brute_components(rows):
    sets, ids = defaultdict(list), {}
    for d, t, *_ in rows:
        w = split(t)
        k = min(5, len(w))
        sets[d].append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
        ids[d] = d

    def find(x):
        while ids[x] != x:
            x = ids[x]
        return x

    flat = [(d, s) for d, ss in sets.items() for s in ss if s and d is not None]
    for i, (a, s) in enumerate(flat):
        for b, u in flat[:i]:
            if 100 * len(s & u) >= 80 * len(s | u):
                x, y = find(a), find(b)
                ids[max(x, y)] = min(x, y)
    return {d: (sorted(map(len, sets[d])), find(d)) for d in sets}


@pytest.mark.parametrize(("often", "wide", "block"), [(16, 8, 64), (3, 1, 2)])
def test_jaccard_join(spark, monkeypatch, often, wide, block):
    for name, value in (("OFTEN", often), ("WIDE", wide), ("BLOCK", block), ("QUERIES", block)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = [*corpus(110, seed=9), (None, "a b c d e f", None, None, None)]
    got = defaultdict(list)
    for r in jaccard_join.join_components(frame(spark, rows)).collect():
        got[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    want = brute_components(rows)
    assert {d: (sorted(n for n, _ in v), v[0][1]) for d, v in got.items()} == want
    assert len({c for _, c in want.values()}) < len(want) - 10  # there are links


def test_jaccard_join_empty(spark):
    assert jaccard_join.join_components(frame(spark, corpus(3)).where("false")).count() == 0


# Decontamination


@pytest.mark.parametrize("per_block", [20_000, 3])
def test_decontamination(spark, per_block):
    rnd = random.Random(4)
    rows = corpus(60)
    texts = [t for _, t, *_ in rows if t]
    items = [(i, " ".join(rnd.choice(texts).split()[:k])) for i, k in enumerate([0, 1, 2, 4, 5, 6, 20, 60, 60, 60, 30] * 2)]
    items += [(90, None), (None, "x"), (91, "X"), (91, "X")]
    items = [(i, t) for i, t in items if t is None or len(t) < 5000]

    def contained(text, item):
        w, v = split(text), split(item)
        k = min(5, len(v))
        if not v:
            return False
        own = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
        return 100 * len(own & {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) >= 80 * len(own)

    want = Counter((d, i) for d, t, *_ in rows for i, x in items if contained(t, x))
    df = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    got = decontamination.contained_items(frame(spark, rows), df, per_block)
    assert Counter((r["doc_id"], r["item_id"]) for r in got.collect()) == want and len(want) > 20
    left = decontamination.keep_uncontaminated(frame(spark, rows), df, per_block)
    assert left.count() == sum(not any(contained(t, x) for _, x in items) for _, t, *_ in rows) and left.columns == frame(spark, rows).columns
    assert decontamination.contained_items(frame(spark, rows), df.where("false")).count() == 0


# Language identification


def test_languages_whose_texts_are_empty(spark):
    rows = [(1, "hello there you", "en"), (2, "", "fr"), (3, None, "de"), (4, "", "de"), (5, " 12 !", "pt"), (6, None, "sv"), (7, "bonjour à tous", "fr"), (8, "x", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for one in (df, df.coalesce(1), df.where("doc_id in (2, 4)")):
        got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, language_id.train(one)).collect()}
        assert len(got) == 8 and {got[i] for i in (2, 3, 4, 5, 6)} == {"und"}
    model = language_id.train(df)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, model).collect()}
    assert got[1] == "en" and got[7] == "fr"


def test_language_id(spark):
    rnd = random.Random(8)
    sounds = {"aa": ["ka", "to", "ri", "shi"], "bb": ["sch", "ung", "eit", "die"], "cc": ["que", "eau", "oi", "ent"]}
    make = lambda lang, k: " ".join("".join(rnd.choices(sounds[lang], k=rnd.randrange(1, 4))) for _ in range(k))
    rows = [(i, make(lang, rnd.randrange(2, 40)), lang, None, None) for i, lang in enumerate(rnd.choices(list(sounds), k=300))]
    odd = [(900, None, "aa", None, None), (901, "", None, None, None), (902, "12 34 !?", "bb", None, None), (903, "漢字", None, None, None), (904, "ka" * 60_000, None, None, None)]
    df = frame(spark, rows + odd)
    model = language_id.train(df.where("doc_id % 4 <> 2"))
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert len(got) == 305 and all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (900, 901, 902))
    assert got[903]["lang_pred"] in sounds and got[904]["lang_pred"] == "aa"
    held = [r for r in rows if r[0] % 4 == 2]
    assert sum(got[d]["lang_pred"] == lang for d, _, lang, *_ in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    clash = df.unionAll(df).selectExpr("cast(doc_id as string) doc_id", "text", "lang", "source as lang_pred", "n_chars as score", "doc_id as _h")
    again = language_id.identify(clash, language_id.train(clash.where("doc_id % 4 <> 2"))).collect()
    assert len(again) == 610 and {r["doc_id"]: r["lang_pred"] for r in again} == {str(d): r["lang_pred"] for d, r in got.items()}
    none = language_id.train(df.where("false"))
    assert {r["lang_pred"] for r in language_id.identify(df, none).collect()} == {"und"}


def test_ppm_code_lengths():
    """The table against escapes spelt out symbol by symbol."""
    texts = [b"abracadabra", b"banana band", b"cab"]
    model = language_id.PpmModel({"x": language_id.count_grams(texts)})
    n = language_id.ORDER
    trees = [defaultdict(Counter) for _ in range(n + 1)]
    for t in texts:
        padded = b"\n" * n + t
        for i in range(n, len(padded)):
            for k in range(n + 1):
                trees[k][padded[i - k : i]][padded[i]] += 1

    def cost(before, s, k=n):
        if k < 0:
            return 1 / 256
        seen = trees[k][before[len(before) - k :]]
        total, distinct = sum(seen.values()), len(seen)
        if not total:
            return cost(before, s, k - 1)
        return seen[s] / (total + distinct) if seen[s] else distinct / (total + distinct) * cost(before, s, k - 1)

    other = language_id.PpmModel({"x": language_id.count_grams(texts), "a": language_id.count_grams([b"zebra", b"abba"])})
    for t in [b"abba", b"band cab", b"zzz", b"", b"a", b"banana"]:
        padded = b"\n" * n + t
        want = -sum(np.log2(cost(padded[:i], padded[i])) for i in range(n, len(padded)))
        assert model.code_lengths([b"ab", t, b"c"])[1, 0] == pytest.approx(want, rel=1e-5)
        assert other.code_lengths([b"ab", t, b"c"])[1, 1] == pytest.approx(want, rel=1e-5)


def test_places():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    places = language_id.Places(keys)
    assert (places(keys) == np.arange(len(keys))).all() and (places(keys[:-1] + 1)[keys[:-1] + 1 != keys[1:]] == -1).all()
    assert (language_id.Places(keys[:0])(keys) == -1).all()


# Toxicity


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 9), st.sampled_from([0, 3, 50]))
def test_block_max_is_exact(seed, k, dense):
    rng = np.random.default_rng(seed)

    def vectors(n):
        x = rng.integers(1, 4, (n, 20)) * (rng.random((n, 20)) < 0.2)
        x[np.arange(n), rng.integers(0, 20, n)] = 1
        return x / np.sqrt((x * x).sum(1))[:, None]

    examples, queries = vectors(60), vectors(5)
    flat = lambda x: (*np.nonzero(x), x[np.nonzero(x)])
    index = toxicity.BlockMaxIndex(*flat(examples), 60, 20, block=8, dense_terms=dense)
    near, cosines = index.nearest(*flat(queries), 5, k)
    for ids, found, exact in zip(near, cosines, queries @ examples.T, strict=True):
        want = np.lexsort((np.arange(60), -np.rint(exact * 1e6)))[:k]
        want = want[exact[want] > 0]
        assert found[: len(want)] == pytest.approx(exact[want], abs=2e-6) and (ids[len(want) :] == -1).all()
        assert exact[ids[: len(want)]] == pytest.approx(exact[want], abs=2e-6)


def test_scores_by_brute_force(spark):
    """Neighbours and scores against cosines of all examples spelt out in dictionaries."""
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 9))) for _ in range(150)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 40)) + ["badword"] * (i % 5 == 0))) for i in range(200)]
    labels = [(i, int(i % 5 == 0)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(df.join(spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id"))

    def vector(text):
        doc, term, count = toxicity.text_terms([text.encode()])
        weight = dict(zip(model.hashes.tolist(), model.weight.tolist(), strict=True))
        v = {t: (1 + np.log(c)) * weight.get(t, model.new_weight) for t, c in zip(term.tolist(), count.tolist(), strict=True)}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {i: vector(t) for i, t in rows}
    share = dict(zip(model.ids, model.share.tolist(), strict=True))
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    for i, _ in rows:
        cosines = sorted(((-round(sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()), 6), j) for j, _ in labels))[: toxicity.NEIGHBOURS]
        w = [share[j] / (1.05 + s) for s, j in cosines]
        vote = (sum(a for a, (_, j) in zip(w, cosines, strict=True) if j % 5 == 0) + model.prior) / (sum(w) + 1)
        assert got[i]["score"] == pytest.approx(float(model.calibrated(np.array([vote]))[0]), abs=5e-3)  # neighbours that tie to six places may change
        assert [n["cosine"] for n in got[i]["nearest"]] == pytest.approx([-s for s, _ in cosines[:3]], abs=3e-6)
    assert len({r["score"] for r in got.values()}) > 50


def test_toxicity(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        toxic = rnd.random() < 0.2
        body = rnd.choices(words, k=rnd.randrange(20, 60)) + [rnd.choice(["zzbad", "zznasty"]) + rnd.choice("abcdef")] * toxic
        rnd.shuffle(body)
        rows.append((i, " ".join(body), None, None, None))
        labels.append((i, int(toxic)))
    odd = [(2000, None, None, None, None), (2001, "", None, None, None), (2002, "zzbadq " * 20_000, None, None, None)]
    labels += [(2000, None), (None, 1), (5000, 1), (0, labels[0][1])]
    df, labs = frame(spark, rows + odd), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train_from_tables(df, labs)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held = [(d, y) for d, y in labels[:900] if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum(got[d]["predicted"] == y for d, y in held) >= 0.98 * len(held)
    assert got[2002]["predicted"] == 1 and got[2002]["nearest"][0]["label"] == 1 and got[2000]["score"] == got[2001]["score"] < 0.3
    assert toxicity.keep_clean(df, model).count() == sum(r["predicted"] == 0 for r in got.values())
    clash = df.selectExpr("cast(doc_id as string) doc_id", "text", "lang as toxic", "source as score", "n_chars as nearest").unionAll(df.selectExpr("cast(doc_id as string)", "text", "lang", "source", "n_chars"))
    named = toxicity.score(clash, toxicity.train_from_tables(df.selectExpr("cast(doc_id as string) doc_id", "text"), labs.selectExpr("cast(doc_id as string) doc_id", "toxic"))).collect()
    assert len(named) == 2 * len(got) and {r["doc_id"]: r["predicted"] for r in named}["2002"] == 1
    none = toxicity.train_from_tables(df, labs.where("false"))
    assert {r["score"] for r in toxicity.score(df, none).collect()} == {0.0}


# Language model


def test_language_model(spark):
    rows = corpus(80)
    learn = {d: d % 7 != 2 for d, *_ in rows}
    df = spark.createDataFrame([(d, t, learn[d], 1) for d, t, *_ in rows], "doc_id long, text string, learn boolean, chunk int").repartition(3)
    got = language_model.score(df).collect()
    counts = Counter()
    for d, t, *_ in rows:
        if learn[d]:
            counts.update([*split(t), None])
    n, v = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for d, t, *_ in rows:
        tokens = [*split(t), None]
        want[d].append((len(tokens), sum(counts[w] > 0 for w in tokens), sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)))
    assert len(got) == len(rows)
    for r in got:
        assert r["train_tokens"] == n
        assert any((r["n_tokens"], r["n_known"]) == x[:2] and r["base_score"] == pytest.approx(x[2]) for x in want[r["doc_id"]])
    own = [r for r in got if not learn[r["doc_id"]]]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)
    nothing = language_model.score(df.withColumn("learn", df["learn"] & False)).collect()
    assert {r["score"] for r in nothing} == {0.0} and language_model.score(df.where("false")).count() == 0


@pytest.mark.parametrize("parts", [1, 2])
def test_predictive_sums_to_one(parts):
    """After every word the words of the vocabulary and an unknown one have all the probability."""
    lm, rng = language_model, np.random.default_rng(1)
    vocabulary = np.unique(rng.integers(1, 2**63, 40).astype(np.uint64) * np.uint64(2))
    end, unknown = np.array([lm.END]), np.array([3], np.uint64)
    hot = np.unique(np.concatenate([vocabulary[[4, 9]], end, [lm.START]]))
    docs = [np.append(rng.choice(vocabulary, 300, p=np.r_[0.3, np.full(len(vocabulary) - 1, 0.7 / (len(vocabulary) - 1))]), end) for _ in range(4)]
    words, known = np.concatenate([vocabulary, end, unknown]), np.append(vocabulary, unknown)
    every = [np.array([u, w]) for u in known for w in words] + [np.array([w]) for w in words]
    asked = [lm.Pairs(docs, [True] * 4, hot, parts), lm.Pairs(every, [False] * len(every), hot, parts)]
    rows = [{p: row for p, *row in pairs.by_part(hot)} for pairs in asked]
    made = [lm.Part([r[p] for r in rows if p in r], hot, parts) for p in range(parts)]
    add = lambda many: {k: sum(m[k] for m in many) for k in many[0]}
    hyper = lm.Hyper(hot, add([p.sums(len(hot)) for p in made]))
    assert hyper.vocabulary == len(vocabulary) + 1 and hyper.tokens == sum(map(len, docs))
    sums, drawn = [], []
    for seed, part in enumerate(made):
        own = {}
        for s, (t, tables, root, tr) in enumerate(part.samples(hyper, seed)):
            own |= {f"before{s}": part.of_hot(len(hot), tables, part.hot_ctx), f"root{s}": part.of_hot(len(hot), root, part.hot_words), f"all{s}": np.array([t.sum(), tr[part.cold].sum()])}
            drawn += [(c, s, n) for c, n in zip(part.codes, tables, strict=True)]
        sums.append(own)
    totals = lm.Totals(hyper, add(sums), len(hot))
    pairs, counts, root, tables, seats = asked[1], [], [], [], []
    for seed, part in enumerate(made):
        own_seats, own_root = part.seated(hyper, seed)
        nw, ne = part.sizes[-1]
        chunk_words, chunk_pairs = part.chunk_words[-nw:], part.chunk_pairs[-ne:]
        counts.append(part.counts[chunk_words])
        root.append(own_root[:, chunk_words])
        seats.append(own_seats[:, chunk_pairs])
        found = defaultdict(float)
        for c, s, n in drawn:
            found[c, s] += n
        tables.append(np.array([[found[w >> lm.SHORT, s] for w in part.words[chunk_words]] for s in range(lm.SAMPLES)]))
    _, p = lm.predictive(pairs, hot, hyper, totals, np.concatenate(counts), np.concatenate(root, 1), np.concatenate(tables, 1), np.concatenate(seats, 1))
    after = np.flatnonzero(np.isin(np.append(pairs.words, lm.START), np.append(known, lm.START)))
    assert np.bincount(pairs.ctx, p, len(pairs.words) + 1)[after] == pytest.approx(np.ones(len(after)), rel=1e-5)


def test_stirling_and_tables():
    s, d = np.exp(language_model.log_stirling(0.5, 6)), 0.5
    assert s[2, 1] == pytest.approx(1 - d) and s[3, 2] == pytest.approx((1 - d) + (2 - 2 * d)) and s[4, 4] == pytest.approx(1)
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 5, 30, 31, 5000])
    t = language_model.sample_tables(c, np.full(len(c), 0.5), 0.5, language_model.log_stirling(0.5), rng)
    assert t[0] == 0 and t[1] == 1 and (t[1:] >= 1).all() and (t <= c).all()


# Token files


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65535) | st.integers(0, 3), max_size=400), st.integers(1, 90), st.integers(1, 9))
def test_range_codec(ids, block, lanes):
    z = np.array(ids, np.uint16)
    blocks = range_codec.encode_ids(z, block, lanes)
    assert np.array_equal(np.concatenate([*range_codec.decode_ids(blocks, lanes), z[:0]]), z)
    assert [n for n, _ in blocks] == [len(z[i : i + block]) for i in range(0, len(z), block)]


def test_codec_compresses_and_detects_damage():
    z = np.array([1, 2, 3, 4, 5, 6, 7, 8] * 500, np.uint16)
    blocks = range_codec.encode_ids(z)
    assert sum(len(b) for _, b in blocks) < len(z) // 4
    segment = token_files.pack([5, None], [3000, 1000], blocks, [zlib.crc32(z.tobytes())])
    assert token_files.unpack(segment)[0] == [5, None]
    with pytest.raises(ValueError, match="damaged directory"):
        token_files.unpack(segment[:30] + b"\x07" + segment[31:])


def test_damaged_block(spark):
    """One changed byte in a block's words is found when the files are read."""
    rows = [(i, f"word {i} and more of it " * 40, None, None, None) for i in range(20)]
    path, broken = shared_dir(spark), shared_dir(spark)
    token_files.write(frame(spark, rows), P.path("byte_bpe_50k.json"), path)
    segments = spark.read.parquet(path).collect()
    whole = bytes(segments[0]["segment"])
    bad = whole[:-9] + bytes([whole[-9] ^ 0x55]) + whole[-8:]
    spark.createDataFrame([(r["part"], r["seq"], bad if r is segments[0] else bytes(r["segment"])) for r in segments], "part int, seq int, segment binary").write.parquet(broken)
    with pytest.raises(Exception, match="damaged block"):
        token_files.read(spark, broken).collect()
    assert token_files.read(spark, path).count() == 20


def test_repeated_doc_ids(spark):
    """Rows of one doc_id each stand in the files, in an order that their texts fix; other columns may clash."""
    rows = [(5, "a b"), (5, "a b"), (5, "c"), (None, None), (None, "x"), (1, "")]
    df = spark.createDataFrame([(d, t, i, "s") for i, (d, t) in enumerate(rows)], "doc_id long, text string, seq int, segment string").repartition(3)
    starts = []
    for _ in range(2):
        path = shared_dir(spark)
        token_files.write(df, P.path("byte_bpe_50k.json"), path)
        got = token_files.with_starts(token_files.with_checksum(token_files.read(spark, path))).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
        ordered = sorted(got, key=lambda r: r["start"])
        assert [r["doc_id"] for r in ordered] == [None, None, 1, 5, 5, 5]
        assert [r["start"] for r in ordered] == np.cumsum([0, *[r["n_tokens"] for r in ordered]])[:-1].tolist()
        starts.append([(r["start"], r["ids_crc32"]) for r in ordered])
    assert starts[0] == starts[1]


def test_token_files(spark):
    from tokenizers import Tokenizer

    rows = [(d, t[:3000] if t else t, *x) for d, t, *x in corpus(60) if d] + [(700, "a <|endoftext|> b", *[None] * 3), (None, "null id", *[None] * 3)]
    path, file = shared_dir(spark), P.path("byte_bpe_50k.json")
    token_files.write(frame(spark, rows), file, path)
    tokenizer, start, want = Tokenizer.from_file(file), 0, {}
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = token_files.with_starts(token_files.with_checksum(token_files.read(spark, path))).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    empty = shared_dir(spark)
    token_files.write(frame(spark, rows).where("false"), file, empty)
    assert token_files.read(spark, empty).count() == 0
