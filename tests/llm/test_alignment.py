"""The alignment of two tokenizers against whole texts, tokens and groups taken one by one."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import types as T
from tokenizers import Tokenizer

from folio.llm.alignment import _byte_letters, align, components, op13_token_alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def spans(libraries, text):
    """(id, start, end) of both sides, or None."""
    a, b = libraries
    letters = _byte_letters()
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()))
    out = []
    for side in (left, right):
        if b"".join(x for _, x in side) != (" " + text).encode():
            return None
        at, row = 0, []
        for i, x in side:
            row.append((i, at, at + len(x)))
            at += len(x)
        out.append(row)
    return out


def brute(libraries, rows):
    docs, holds = [], defaultdict(set)
    for n, (doc_id, text) in enumerate(rows):
        both = spans(libraries, text) if text else None
        links, groups = [], []
        if both:
            left, right = both
            links = [(x[0], y[0]) for x in left for y in right if x[1] < y[2] and y[1] < x[2]] if len(left) * len(right) < 10**6 else None
            if links is None:  # long texts: two pointers
                links, j = [], 0
                for x in left:
                    while right[j][2] <= x[1]:
                        j += 1
                    k = j
                    while k < len(right) and right[k][1] < x[2]:
                        links.append((x[0], right[k][0]))
                        k += 1
            common, at = sorted({x[2] for x in left} & {y[2] for y in right}), 0
            i = j = 0
            for end in common:
                g = ([], [])
                while i < len(left) and left[i][2] <= end:
                    g[0].append(left[i][0])
                    i += 1
                while j < len(right) and right[j][2] <= end:
                    g[1].append(right[j][0])
                    j += 1
                groups.append(g)
                at = end
        for p in links:
            holds[p].add(n)
        docs.append((doc_id, both, links, groups))
    count = {p: len(x) for p, x in holds.items()}
    best = Counter()
    for (a, _), c in count.items():
        best[a] = max(best[a], c)
    out = []
    for doc_id, both, links, groups in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n = [len(x) for x in both] if both else [0, 0]
        out.append((doc_id, *n, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha256(text.encode()).hexdigest() if both else ""))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


@pytest.mark.parametrize("chunk_bytes", [40, 1 << 20])
def test_against_brute_force(spark, libraries, chunk_bytes):
    random.seed(3)
    odd = ["", None, " ", "   ", "\n", "\n\n a", "a▁b", "▁", "<s> </s>", "<|endoftext|> it's <|endoftext|>x", "ﬁn ½ Ａ é é", "naïve  café\t\tx", "日本語のテキスト　です", "🌟🌟 👩‍👩‍👧", "\x00\x01 a\x7f", " a  b c", "a" * 3000, " " * 40 + "x", "1234567890 12,345.67", "don't  DON'T we'll", "\r\n\r\n x \n", "it is", "it is", "Ünïcödé ÀÉ"]
    letters = list("ab  \n\t.,'é日 ▁  🌟1-") + ["the ", " of", "tion", "er", "\n\n", "  "]
    odd += ["".join(random.choices([x for x in letters if x != "▁" or random.random() < 0.2], k=random.randint(1, 40))) for _ in range(300)]
    rows = [*enumerate(odd), (5, "it is"), (None, "it is"), (None, None)]
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_a", T.IntegerType()), T.StructField("chunk", T.StringType())])).repartition(3)
    got = sorted(map(tuple, align(docs, A, B, chunk_bytes).collect()), key=key)
    assert got == sorted(brute(libraries, rows), key=key)


def test_whole_table(spark, libraries):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, op13_token_alignment(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(brute(libraries, rows))


def test_empty_table(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_components_are_the_groups_between_common_ends():
    random.seed(1)
    for _ in range(300):
        n = random.randint(1, 60)
        ends = [sorted({n, *random.sample(range(1, n + 1), random.randint(1, n))}) for _ in "ab"]
        cuts = np.union1d(*ends)
        roots, of_b = components(*(np.searchsorted(e, cuts) for e in ends))
        common = sorted({*ends[0]} & {*ends[1]})
        assert [common.index(next(c for c in common if c >= e)) for e in ends[0]] == np.unique(roots, return_inverse=True)[1].tolist()
        assert [common.index(next(c for c in common if c >= e)) for e in ends[1]] == np.unique(of_b, return_inverse=True)[1].tolist()


def test_a_long_chain_is_one_component():
    a, b = np.arange(100_001) // 2, (np.arange(100_001) + 1) // 2
    roots, of_b = components(a, b)
    assert not roots.any() and not of_b.any()
