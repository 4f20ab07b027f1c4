import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from terralens.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t\x1c\x85 'sEéñ1234中ー٣"))))
def test_as_the_library(text):
    (joined, ids), = CODEC.encode([text])
    assert ids.tolist() == LIB.encode_ordinary(text)
    assert joined == ",".join(map(str, ids.tolist()))
    assert CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000 + "é" * 999, " " * 700 + "x", "\n" * 333, "0123456789" * 400])
def test_long_pieces(text):
    (_, ids), = CODEC.encode([text])
    assert ids.tolist() == LIB.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.sampled_from(["ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "éèêaz", "中文字的一", " \t", "=-"]), st.integers(1000, 9000))
def test_random_long_pieces(seed, letters, n):
    text = "".join(np.random.RandomState(seed).choice(list(letters), n))
    assert CODEC.encode_pieces([text])[0].tolist() == LIB._encode_single_piece(text)


def test_a_piece_of_megabytes():
    text = "".join(np.random.RandomState(5).choice(list("etaoinshrdlu"), 1 << 20)) + "x" * (1 << 20)
    (_, ids), = CODEC.encode([text])
    assert CODEC.decode(ids) == text.encode() and len(ids) < len(text)


def test_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    got = bpe.encode_documents(spark.read.parquet(path), bpe.read_ranks(PATH), P.PATTERN, with_digests=True).collect()
    t = pq.read_table(path, columns=["doc_id", "text"])
    want = {}
    for d, text in zip(*(c.to_pylist() for c in t.columns), strict=True):
        ids = LIB.encode_ordinary(text or "")
        want[d] = (ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert {r.doc_id: (r.ids, r.ids_sha256, r.decoded_sha256) for r in got} == want
    assert all(r.n_tokens == len(r.ids) and bytes(r.decoded) for r in got if r.n_tokens)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (3, "the " * 40000, "c")]
    got = sorted(bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids string"), bpe.read_ranks(PATH), P.PATTERN).collect())
    assert [r.n_tokens for r in got[:3]] == [0, 0, 0] and bytes(got[3].decoded).decode() == rows[3][1]
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), bpe.read_ranks(PATH), P.PATTERN).count() == 0


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    c = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)
    for text in ("one two three four five", "six seven", "one nine ten eleven"):
        (_, ids), = c.encode([text])
        assert np.array_equal(ids, LIB.encode_ordinary(text))


@pytest.mark.parametrize("n", [511, 512, 513, 1023, 1024, 1025])
def test_where_single_merges_end_and_rounds_begin(n, monkeypatch):
    """Both ways of merging give the library's ids on either side of the length at which they change."""
    for letters in ("ab", "aeinrst", "étà"):
        text = "".join(np.random.RandomState(n).choice(list(letters), n))
        while len(text.encode()) > n:
            text = text[:-1]
        want = LIB._encode_single_piece(text)
        assert CODEC.encode_pieces([text])[0].tolist() == want
        monkeypatch.setattr(bpe, "LONG", 1 << 20)
        assert CODEC.encode_pieces([text])[0].tolist() == want
        monkeypatch.setattr(bpe, "LONG", 1)
        assert CODEC.encode_pieces([text])[0].tolist() == want
        monkeypatch.undo()
