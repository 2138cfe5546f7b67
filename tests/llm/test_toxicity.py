"""Toxicity: marginals against a plain forward-backward, the gradient's aim, and held-out accuracy."""

import zlib

import numpy as np
import pytest

from keyspan.llm import toxicity as tox
from keyspan.llm.queries import op4_toxicity


def plain_marginals(unary, steps):
    forward, a = [], np.array([1.0, 0.0])
    for u in unary:
        a = (a @ steps) * np.array([1, np.exp(u)])
        a /= a.sum()
        forward.append(a)
    out, b = [0.0] * len(unary), np.ones(2)
    for k in range(len(unary) - 1, -1, -1):
        both = forward[k] * b
        out[k] = both[1] / both.sum()
        b = steps @ (np.array([1, np.exp(unary[k])]) * b)
        b /= b.sum()
    return out


def test_marginals():
    rng = np.random.default_rng(0)
    lengths = np.array([0, 1, 5, 64, 65, 200, 0, 130, 1000])
    unary, steps = rng.normal(0, 3, lengths.sum()), np.array([[0.9, 0.1], [0.4, 0.6]])
    got, at = tox.marginals(unary, lengths, steps), 0
    for n in lengths:
        assert np.allclose(got[at : at + n], plain_marginals(unary[at : at + n], steps), atol=1e-12)
        at += n
    assert len(tox.marginals(np.empty(0), np.zeros(3, int), steps)) == 0


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    clean = [f"word{i}" for i in range(300)] + ["pation", "stung"]
    bad = ["stupid", "pathetic"] * 10 + [f"vequ{a}{b}" for a in "aeiou" for b in "nrst"]
    texts, labels = [], []
    for i in range(n):
        words, label = list(rng.choice(clean, rng.integers(5, 200))), int(i % 4 == 0)
        for _ in range(label * rng.integers(1, 4)):
            words.insert(rng.integers(len(words)), str(rng.choice(bad)) + ("," if rng.random() < 0.3 else ""))
        texts.append(" ".join(words))
        labels.append(label)
    return texts, labels


@pytest.fixture(scope="module")
def field():
    texts, labels = corpus(900, 1)
    return tox.fit(texts, labels, [1.0] * len(texts))


def scores(field, texts):
    p, lengths, _ = tox.token_marginals(field, tox.Unary(field), texts)
    return tox._sigmoid(tox.aggregate(p, lengths) @ field.curve)


def test_learns_words_and_beginnings(field):
    texts, labels = corpus(400, 2)
    assert ((scores(field, texts) >= 0.5) == np.array(labels)).mean() > 0.97
    assert scores(field, ["a vequxyz here"])[0] > 3 * scores(field, ["a word7 here"])[0]
    assert scores(field, ["stupid, vequan word5"])[0] > 0.5 > scores(field, ["pation stung word5"])[0]
    assert 0 <= scores(field, [""])[0] < 0.5


def test_copies_are_no_evidence():
    """One odd text that is labelled toxic and copied often does not make its words toxic."""
    texts, labels = corpus(600, 3)
    odd = "harmless but rare words " + " ".join(f"odd{i}" for i in range(40)) + " stupid"
    marked = tox.markers([t.split() for t in texts + [odd] * 60], np.array(labels + [1] * 60))
    assert any(f in marked for f in tox.features("stupid")) and not any(f in marked for f in tox.features("odd7"))


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1, 1]])
def test_one_label_only(labels):
    field = tox.fit(["a b"] * len(labels), labels, [1.0] * len(labels))
    assert 0 <= scores(field, ["x"])[0] <= 1


def test_spans_and_odd_rows(spark, field):
    rows = [(1, None), (2, ""), (3, "é  word1\nstupid, word2"), (None, "stupid pathetic"), (5, "word1 " * 40_000 + "stupid pathetic"), (3, "word1"), (3, "word1")]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = tox.toxic_spans(frame, field).collect()
    assert sorted((r.doc_id or 0, [(s.start, s.end) for s in r.spans]) for r in got) == [
        (0, [(0, 6), (7, 15)]), (1, []), (2, []), (3, []), (3, []), (3, [(9, 16)]), (5, [(240_000, 240_006), (240_007, 240_015)]),
    ]
    assert all(0 <= r.score <= 1 for r in got)
    assert tox.toxic_spans(frame.limit(0), field).count() == 0
    kept = tox.clean_documents(frame, field)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == [(1, ""), (2, ""), (3, "word1"), (3, "word1")]


def test_training_reads_no_held_out_label(spark):
    docs = [(i, f"text {i} " + ("stupid " if i % 3 == 0 else "fine ")) for i in range(200)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(200)] + [(None, 1, 1), (3, 1, None), (500, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % tox.FOLDS == 0]
    flipped = [(i, q, 1 - t if i in held else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (tox.train(frame, spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert a.weights == b.weights and (a.curve == b.curve).all()
    assert tox.train(frame.limit(0), spark.createDataFrame([], schema)).weights == {}


def test_held_out_accuracy(spark):
    directory = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{directory}/labels.parquet").collect()}
    rows = [r for r in op4_toxicity(spark, directory).collect() if r.doc_id in truth and r.held_out]
    assert len(rows) > 500
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.97
    assert np.mean([r.predicted for r in rows if truth[r.doc_id]]) > 0.9
