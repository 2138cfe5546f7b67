"""Katz backoff against dictionaries, normalisation, and odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from keyspan.llm import katz


def brute(rows):
    """The same model from plain dictionaries: {doc row: (n_tokens, n_known, base, score)}, and P(w | h)."""
    texts = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t in rows]
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", t) + [None] for t in texts]
    train = [zlib.crc32(str("" if i is None else i).encode()) % katz.FOLDS != 0 for i, _ in rows]
    c1, c2, texts_seen = Counter(), Counter(), 0
    for words, use in zip(tokens, train):
        if use:
            texts_seen += 1
            c1.update(words)
            c2.update(zip(["<s>", *words[:-1]], words))
    total = sum(c1.values())

    def times(counter):
        out = np.zeros(katz.TRUSTED + 3)
        for c in counter.values():
            out[min(c, katz.TRUSTED + 2)] += 1
        return out

    d1, d2 = katz.discounts(times(c1)), katz.discounts(times(c2))

    def keep(c, d):
        return d[c] * c if c <= katz.TRUSTED else c - katz.SLIVER

    left = 1 - sum(keep(c, d1) for c in c1.values()) / total if total else 1.0

    def p1(w):
        return keep(c1[w], d1) / total if w in c1 else left

    after = {}
    for h, w in c2:
        after.setdefault(h, []).append(w)
    ch = {h: sum(c2[h, w] for w in ws) for h, ws in after.items()}
    weight = {
        h: (1 - sum(keep(c2[h, w], d2) for w in ws) / ch[h]) / (1 - sum(p1(w) for w in ws)) for h, ws in after.items()
    }

    def p2(h, w):
        if (h, w) in c2:
            return keep(c2[h, w], d2) / ch[h]
        return weight.get(h, 1.0) * p1(w)

    out = []
    for words in tokens:
        base = sum(math.log10((c1[w] + 0.1) / (total + 0.1 * (len(c1) + 1))) for w in words)
        score = sum(math.log10(p2(h, w)) for h, w in zip(["<s>", *words[:-1]], words))
        out.append((len(words), sum(w in c1 for w in words), base, score))
    return out, train, total, p2, list(c1), list(after)


def same(got, rows):
    want, train, total, *_ = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    mine = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    theirs = sorted(((i, not t, n, k, total, b, s) for (i, _), t, (n, k, b, s) in zip(rows, train, want)), key=key)
    assert [r[:5] for r in mine] == [r[:5] for r in theirs]
    assert np.allclose([r[5:] for r in mine], [r[5:] for r in theirs], rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]


def test_scores_as_from_dictionaries(spark, documents):
    frame = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    same(katz.score_texts(frame).collect(), documents)


def test_many_chunks_and_spread_histories(spark, documents, monkeypatch):
    """Small chunks, and one word that a third of all tokens follow."""
    rows = [(i, " ".join(f"the {w}" for w in (t or "").split()[:60])) for i, t in documents]
    monkeypatch.setattr(katz, "CHUNK_CHARS", 5_000)
    same(katz.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_sums_to_one(documents):
    *_, p2, words, histories = brute(documents)
    for h in [*histories[:40], "never seen"]:
        assert math.isclose(sum(p2(h, w) for w in words) + p2(h, "unknown word"), 1.0, rel_tol=1e-9)


def test_better_than_unigrams_on_held_out_texts(spark, documents):
    rows = [r for r in katz.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a A a"), (4, "a A a"), (None, "b"), (6, "x " * 3000), (7, None)]
    frame = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, words string, train int")
    same(katz.score_texts(frame).collect(), rows)


def test_empty_table(spark):
    assert katz.score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_without_training_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % katz.FOLDS == 0][:3]
    got = katz.score_texts(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert [(r.n_known, r.train_tokens, r.score) for r in got] == [(0, 0, 0.0)] * 3
