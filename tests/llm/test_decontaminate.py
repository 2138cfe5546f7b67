"""Benchmark passages against an edit distance over every place."""

import random

import numpy as np
import pytest

from keyspan.llm import decontaminate as dec


def occurs(passage, text):
    """Least edits with which the passage occurs anywhere in the text."""
    cost = np.zeros(len(text) + 1, np.int64)
    letters = np.array([ord(c) for c in text])
    place = np.arange(len(text) + 1)
    for c in passage:
        new = np.append(cost[0] + 1, np.minimum(cost[1:] + 1, cost[:-1] + (letters != ord(c))))
        cost = np.minimum.accumulate(new - place) + place
    return int(cost.min())


def plain(text):
    return "".join(chr(p) for p in dec.normal(text)[0])


def brute(docs, items):
    out = set()
    for item_id, text in items:
        text = plain((text or "").strip())
        if item_id is None or len(text) < dec.LEAST:
            continue
        step, size = dec.PASSAGE // 2, dec.PASSAGE
        starts = range(0, max(1, len(text) - step), step)
        for s in starts:
            part = text[s : s + size] if s + size < len(text) else text[max(0, len(text) - size) :]
            edits = min(int(len(part) * dec.RATE), (len(part) - dec.Q) // dec.Q)
            out |= {(i, item_id) for i, t in docs if t and i is not None and occurs(part, plain(t)) <= edits}
    return out


def edited(rnd, text, edits):
    s = list(text)
    for _ in range(edits):
        p, kind = rnd.randrange(len(s)), rnd.randrange(3)
        if kind == 0:
            s[p] = rnd.choice("abcxyz ")
        elif kind == 1:
            del s[p]
        else:
            s.insert(p, rnd.choice("abcxyz "))
    return "".join(s)


def words(rnd, n):
    return " ".join(rnd.choice(["the", "of", "and", "tion", "er", "ing", "ent"]) + rnd.choice(["an", "re", "th", "on", "st"]) * rnd.randint(0, 2) for _ in range(n))


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(11)
    items = [(i, words(rnd, rnd.choice([5, 12, 30, 60]))) for i in range(12)] + [(100, "short"), (101, None), (102, ""), (None, words(rnd, 20))]
    docs = []
    for d in range(60):
        text = words(rnd, rnd.randint(0, 150))
        if d % 2:
            item = items[rnd.randrange(12)][1]
            part = item if rnd.random() < 0.6 else item[rnd.randrange(len(item)) :]
            part = edited(rnd, part, int(len(part) * rnd.choice([0, 0.03, 0.07, 0.12])))
            text = text + rnd.choice([" ", "\n\t ", ""]) + (part.upper() if rnd.random() < 0.3 else part) + " " + words(rnd, rnd.randint(0, 40))
        docs.append((d, text))
    docs += [(1000, None), (1001, ""), (1002, items[0][1] * 40), (1003, words(rnd, 30_000) + items[2][1])]
    return docs, items


def found(spark, docs, items):
    frame = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, item_id int, start int")
    return dec.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()


def test_as_every_place(spark, case):
    docs, items = case
    small = [(d, t) for d, t in docs if not t or len(t) < 20_000]
    got = found(spark, docs, items)
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id != 1003} == brute(small, items)
    assert any(r.doc_id == 1003 and r.item_id == 2 for r in got)
    assert len(brute(small, items)) > 15


def test_excerpts_at_every_offset(spark):
    """A verbatim excerpt of 80 characters is found wherever it begins, and an item without an id counts."""
    rnd = random.Random(3)
    item, short = words(rnd, 90), words(rnd, 60)[:150]
    docs = [(at, item[at : at + 80]) for at in range(0, len(item) - 80)] + [(1000 + at, short[at : at + 112]) for at in range(38)]
    docs = [(d, "zq vw " * 9 + t + " jx kp" * 9) for d, t in docs if t == t.strip()]
    assert {r.doc_id for r in found(spark, docs, [(1, item), (None, short)])} == {d for d, _ in docs}
    nameless = spark.createDataFrame([(None, short)], "item_id long, text string")
    frame = spark.createDataFrame([(1, "zq " + short), (2, "jx kp " * 9)], "doc_id long, text string")
    assert [r.doc_id for r in dec.clean_documents(frame, nameless).collect()] == [2]


def test_places(spark, case):
    _, items = case
    text = "é" * 30 + "  " + items[3][1] + " tail of the text"
    row = found(spark, [(1, text)], [items[3]])[0]
    assert abs(row.start - 32) <= 2 and abs(row.end - 32 - len(items[3][1])) <= 2 and row.edits == 0


def test_benchmark_in_blocks(spark, case, monkeypatch):
    """Whole rows are equal for any number of blocks, with an item of several texts and two items without an id."""
    docs, items = case
    items = [*items, (3, items[5][1]), (3, items[3][1][:90]), (None, items[7][1]), (200, items[4][1])]
    docs = [*docs, (2000, items[3][1] + " and " + items[5][1] + " so " + items[7][1])]
    want = sorted(tuple(r) for r in found(spark, docs, items) if r.item_id is not None)
    nameless = sorted(tuple(r) for r in found(spark, docs, items) if r.item_id is None)
    assert len({r[:2] for r in want}) == len(want) and any(r[0] == 2000 for r in nameless)
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    clean = sorted(r.doc_id for r in dec.clean_documents(frame, bench).collect())
    for chars in (500, 2000):
        monkeypatch.setattr(dec, "BLOCK_CHARS", chars)
        got = found(spark, docs, items)
        assert sorted(tuple(r) for r in got if r.item_id is not None) == want
        assert sorted(tuple(r) for r in got if r.item_id is None) == nameless
        assert sorted(r.doc_id for r in dec.clean_documents(frame, bench).collect()) == clean


def test_templates_are_searched_once_and_in_slices(monkeypatch):
    """Items that begin alike against a text that is full of their beginning."""
    rnd = random.Random(21)
    template = "which of the following statements about the subject named below is the right one: "
    items = [(i, template + words(rnd, 12)) for i in range(200)]
    text = (template + "none. ") * 60 + items[7][1] + " " + template
    bench = dec.Benchmark(items)
    assert sum(len(o) for o in bench.owners) > 1.3 * len(bench.points)
    whole = sorted(dec._found(bench, [text, words(rnd, 50)]))
    monkeypatch.setattr(dec, "HITS", 1000)
    assert sorted(dec._found(bench, [text, words(rnd, 50)])) == whole
    assert {o for _, p, *_ in whole for o in bench.owners[p]} == set(range(200)) and {i for i, *_ in whole} == {0}


def test_clean_documents(spark, case):
    docs, items = case
    frame = spark.createDataFrame([(*d, "s") for d in [*docs, (None, items[3][1]), (None, None)]], "doc_id long, text string, source string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    dirty = {r.doc_id for r in found(spark, docs, items)}
    kept = dec.clean_documents(frame, bench)
    assert kept.columns == frame.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(d for d, _ in docs if d not in dirty)
    assert [r.text for r in rows if r.doc_id is None] == [None]


def test_empty_tables_and_repeats(spark, case):
    docs, items = case
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    twice = found(spark, [(1, items[3][1]), (1, items[3][1])], [items[3], items[3]])
    assert [(r.doc_id, r.item_id) for r in twice] == [(1, 3), (1, 3)]


def test_all_whole_items_in_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    whole = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id) for r in found(spark, [(d.doc_id, d.text) for d in docs], [(i.item_id, i.text) for i in items])}
    assert whole and whole <= got
