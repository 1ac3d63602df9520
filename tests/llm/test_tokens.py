"""Byte-level BPE against tiktoken, and packing against whole-text tokenisation."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumiset.llm import byte_bpe, packing

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBpe(byte_bpe.serialise_model(byte_bpe.read_ranks(RANKS)), P.PATTERN)


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_encodes_as_tiktoken_and_back(coder, plain, text):
    ids = coder.encode(text)
    assert ids.tolist() == plain.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def test_documents(spark, hard_docs, plain):
    rows = byte_bpe.encode_digests(hard_docs, RANKS, P.PATTERN).collect()
    want = Counter()
    for r in hard_docs.select("doc_id", "text").collect():
        ids = plain.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == want


def test_encode_then_decode(spark, documents):
    coded = byte_bpe.encode_documents(documents.limit(20), RANKS, P.PATTERN)
    back = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode_ids(coded, RANKS, P.PATTERN).collect()}
    assert back == {r.doc_id: (r.text or "").encode() for r in documents.limit(20).collect()}


def test_no_documents(no_docs):
    assert byte_bpe.encode_digests(no_docs, RANKS, P.PATTERN).count() == 0


WORDS = P.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_word_ids_are_the_tokenizers(text):
    global _CODER, _PLAIN
    if "_CODER" not in globals():
        _CODER, _PLAIN = packing.WordBpe(WORDS), Tokenizer.from_file(WORDS)
    assert np.frombuffer(_CODER.encode(text), "<u4").tolist() == _PLAIN.encode(text, add_special_tokens=False).ids


def check_packed(rows, docs, window=packing.WINDOW):
    t = Tokenizer.from_file(WORDS)
    want, got, fill = Counter(), Counter(), {}
    for r in docs:
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for i in range(0, len(ids), window):
            want[r.doc_id, i, len(ids[i : i + window]), zlib.crc32(ids[i : i + window].tobytes()), len(ids)] += 1
    for r in rows:
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    assert sorted(fill) == list(range(len(fill)))
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return sum(n for *_, n in (x for p in fill.values() for x in p)), len(fill)


def test_packing(hard_docs, documents):
    for docs in (hard_docs, documents):
        pieces = packing.cut_lineage(packing.cut_documents(docs, WORDS))
        tokens, windows = check_packed(packing.pack(pieces).collect(), docs.select("doc_id", "text").collect())
        assert windows <= -(-tokens // packing.WINDOW) + 2


def test_packing_nothing(no_docs):
    assert packing.pack(packing.cut_documents(no_docs, WORDS)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=12))
def test_best_fill_is_the_best(lengths):
    counts = np.bincount(lengths, minlength=31)
    best, longest = 0, max(lengths)
    sums = {longest}
    rest = sorted(lengths)[:-1]
    for n in rest:
        sums |= {s + n for s in sums if s + n <= 30}
    best = max(sums)
    used = packing.best_fill(counts, 30)
    assert sum(n * k for n, k in used.items()) == best
    assert all(k <= counts[n] for n, k in used.items())
