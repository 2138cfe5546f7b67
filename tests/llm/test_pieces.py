"""Encoding and decoding against the sentencepiece library, id by id."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from keyspan.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def encoded(texts):
    got = pieces.encode_texts(pieces.model_at(PATH), texts, {})
    return [np.frombuffer(x, "<u4").tolist() for x in got]


ODD = ["", " ", "  ", "a  b", " lead", "trail  ", "x\ny\t z", "ﬁ Ⅷ é é", "▁x▁▁y", "日本　語", "\x00a", "<s> a </s>", "<0x0A>", "😀 👩‍👩‍👧", "a b"]
LONG = ["=" * 5000, " " * 3000 + "x", "aaaa" * 900, "\n" * 2500, "ab" * 1500 + " " + "é" * 2100, "word " * 20000]


def test_ids_as_the_library(library):
    assert encoded(ODD + LONG) == library.encode(ODD + LONG)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab cdetn  ▁éßあ😀\n\t01-=_AB."), max_size=80))
def test_any_text(text):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = encoded([text])[0]
    assert ids == model.encode(text)
    assert pieces.model_at(PATH).decode(np.array(ids, "<u4")) == model.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400) | st.integers(0, 31999), max_size=12))
def test_decoding_any_ids(ids):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert pieces.model_at(PATH).decode(np.array(ids, "<u4")) == model.decode(ids)


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in pieces.digests(pieces.encode_decode(docs, PATH)).collect()}
    for r in docs.collect():
        ids = library.encode(r.text, add_bos=True, add_eos=True)
        mine = got[r.doc_id]
        assert mine.n_tokens == len(ids)
        assert mine.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert mine.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a", 5), (4, "same", 5), (4, "same", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r.doc_id or 0, r.decoded, len(r.ids) // 4) for r in pieces.encode_decode(frame, PATH).collect())
    assert got == [(0, "a", 3), (1, "", 2), (2, "", 2), (4, "same", 3), (4, "same", 3)]
    assert pieces.encode_decode(frame.limit(0), PATH).count() == 0


def test_word_cache_starts_again(monkeypatch, library):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 3)
    words, model = {}, pieces.model_at(PATH)
    for text in ("one two three four", "five six", "one seven"):
        got = pieces.encode_texts(model, [text], words)[0]
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text)
