"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from keyspan.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, rank int, score string, block long"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    split = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(1 for _, c in split if c), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item_id, text in items:
        asked, scored = Counter(terms(text)), []
        for doc_id, c in split:
            n, score = sum(c.values()), 0
            for t, times in asked.items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + (25 * n * n_docs) // total
                    score += times * w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0 and doc_id is not None:
                scored.append((-score, doc_id))
        out += [(item_id, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=lambda r: (r[0] is not None, *r[:1], *r[1:]) if r[0] is not None else (False, 0, *r[1:]))


def found(spark, docs, items, k=20, parts=3):
    a = spark.createDataFrame([(*d, 0, "x", 1) for d in docs], SCHEMA).repartition(parts)
    b = spark.createDataFrame([(*i, 0, "x", 1) for i in items], SCHEMA.replace("doc_id", "item_id"))
    rows = [tuple(r) for r in ranked.search(a, b, k).collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, *r[:1], *r[1:]) if r[0] is not None else (False, 0, *r[1:]))


def corpus(n, seed=0):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Ünter", "日本", "x1"]
    weight = [1 / (i + 1) for i in range(len(words))]
    docs = [(i * 3, " ".join(rnd.choices(words, weight, k=rnd.choice([1, 5, 40, 200])))) for i in range(n)]
    items = [(i, " ".join(rnd.choices(words, weight, k=rnd.choice([1, 3, 12])))) for i in range(30)]
    return docs, items


@pytest.mark.parametrize(("postings", "stretch", "short"), [(300, 16, 1 / 16), (10_000, 64, 0.0), (10_000, 2048, 1.0)])
def test_equal_to_scoring_all(spark, monkeypatch, postings, stretch, short):
    """Many small blocks and stretches, only long lists, and only short ones."""
    monkeypatch.setattr(ranked, "POSTINGS", postings)
    monkeypatch.setattr(ranked, "STRETCH", stretch)
    monkeypatch.setattr(ranked, "SHORT", short)
    monkeypatch.setattr(ranked, "QUERY_TERMS", 25)
    monkeypatch.setattr(ranked, "RUN", 5000)
    docs, items = corpus(600)
    assert found(spark, docs, items, 7) == brute(docs, items, 7)


def test_odd_rows(spark):
    docs = [(5, "a b"), (3, "a b"), (3, "a b"), (1, None), (2, ""), (4, "-- !"), (None, "a a a"), (8, "B\x7fb c"), (9, "c " * 50_000), (10, "d" * 300_000)]
    items = [(1, "a"), (1, "a A b b"), (None, "c"), (2, None), (3, "!"), (4, "zzz"), (5, "d" * 300_000)]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, []) == [] and found(spark, [], items) == []
    assert found(spark, [(1, None), (2, "?")], items) == []


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, "same words here") for i in range(300, 0, -1)] + [(1000 + i, f"other {i}") for i in range(300)]
    assert found(spark, docs, [(7, "same same words")], 5) == brute(docs, [(7, "same same words")], 5)


def test_documents_of_long_lists_alone_are_skipped():
    """With a rare term and a frequent one, documents that only have the frequent one are not brought."""
    rng = np.random.default_rng(0)
    n = 20_000
    lists = ranked.Lists.__new__(ranked.Lists)
    rare, often = np.sort(rng.choice(n, 60, replace=False)), np.sort(rng.choice(n, 15_000, replace=False))
    lists.n = n
    lists.doc = np.concatenate([rare, often])
    lists.part = np.concatenate([np.full(60, 1_000), rng.integers(1, 100, 15_000)])
    lists.start, lists.stop, lists.most = np.array([0, 60]), np.array([60, 15_060]), np.array([1_000, 99])
    doc, score = ranked.best_of_block(lists, np.array([0, 1]), np.array([50, 1]), 20)
    exact = np.zeros(n, np.int64)
    exact[rare] += 50 * 1_000
    exact[often] += lists.part[60:]
    order = np.lexsort((np.arange(n), -exact))[:20]
    best = np.lexsort((doc, -score))[:20]
    assert doc[best].tolist() == order.tolist() and score[best].tolist() == exact[order].tolist()
    assert len(doc) < 60
