"""What op8's codec and encoder do once for many ids, and that their results stay those of the library."""

from __future__ import annotations

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import range_codec, token_files


@pytest.fixture(scope="module")
def encoder():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return token_files.LeafEncoder(f.read())


def test_lanes_share_steps(monkeypatch):
    """65,536 ids take 256 steps of array operations in each direction, with one model for all lanes."""
    steps, predict = [], range_codec.Model.predict
    monkeypatch.setattr(range_codec.Model, "predict", lambda self, n: steps.append(n) or predict(self, n))
    ids = (np.random.default_rng(0).zipf(1.2, 1 << 16) % 60_000).astype(np.uint16)
    blocks = range_codec.encode_ids(ids)
    assert len(steps) <= 256
    assert np.array_equal(np.concatenate(range_codec.decode_ids(blocks)), ids) and len(steps) <= 512


@pytest.mark.parametrize("ids", [np.arange(65536), np.arange(65536)[::-1] * 3 % 65536, np.zeros(5000, int), np.zeros(0, int)])
def test_codec_of_all_ids(ids):
    """More ids than the frequencies have room for, and one id alone."""
    z = np.concatenate([ids, ids]).astype(np.uint16)
    assert np.array_equal(np.concatenate([*range_codec.decode_ids(range_codec.encode_ids(z)), z[:0]]), z)


def test_leaves_are_encoded_once(encoder, monkeypatch):
    """A leaf met in a batch before does not go to the library again, with or without a sign behind it."""
    asked, leaf = [], encoder.leaf
    monkeypatch.setattr(encoder, "leaf", lambda b: asked.append(b) or leaf(b))
    encoder(pa.array([" zyxo gnarp, zyxo", None]))
    first = len(asked)
    encoder(pa.array(["", " gnarp zyxo, gnarp."]))
    assert asked[first:] == [b"."]


odd = st.sampled_from([*"ab'sStT .,!09\n\t\r\x0b\x1c\x85\xa0   　’é²ªß٣Ⅷ́漢😀_-\"(\x00\x7f​ʼɐΩ", "'ll", "'re", "<|endoftext|>", "  ", "a" * 20])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.lists(odd, max_size=14).map("".join), max_size=8))
def test_ids_are_the_librarys(encoder, texts):
    ids, lengths = encoder(pa.array(texts, pa.string()))
    want = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, token_files.END_ID] for t in texts]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_full_table_begins_anew(monkeypatch):
    """With room for few leaves results stay the same."""
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spelled = f.read()
    for name, value in (("SLOT_BITS", 6), ("SLOTS", 64), ("LEAVES", 30)):
        monkeypatch.setattr(token_files, name, value)
    small = token_files.LeafEncoder(spelled)
    texts = [" ".join(f"w{'abcdefgh'[k % 8]}{'xyz'[k % 3]}{'o' * (k % 5)}, " for k in range(i, i + 90)) for i in range(6)]
    ids, _ = small(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in [*small.tokenizer.encode(t, add_special_tokens=False).ids, token_files.END_ID]]
