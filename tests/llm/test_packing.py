"""Shards by vector bin packing: whole results, near equal sums, groups that stay whole."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyspan.llm import packing

SCHEMA = "doc_id long, text string, shard int, size string, digest long"


def packed(spark, rows, parts=3, **options):
    frame = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA).repartition(parts)
    return [r.asDict() for r in packing.pack(frame, **options).collect()]


def check(rows, out, shards=16):
    """Every row once with its size and checksum, slots without gaps; returns (bytes, tokens, rows) by shard."""
    measure = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    assert Counter(measure) == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < shards for s in slots)
    sums = np.zeros((shards, 2))
    for r in out:
        sums[r["shard"]] += (r["size"], 1)
    return sums


def texts(n, seed=0):
    rnd = random.Random(seed)
    return [(i, f"{i} " + "word " * int(rnd.lognormvariate(3.5, 1))) for i in range(n)]


@pytest.mark.parametrize(("large", "cell"), [(256, 2000), (8, 400)])
def test_sums_are_near_equal(spark, monkeypatch, large, cell):
    monkeypatch.setattr(packing, "LARGE", large)
    monkeypatch.setattr(packing, "CELL", cell)
    rows = texts(4000)
    out = packed(spark, rows)
    sums = check(rows, out)
    assert (sums.max(axis=0) / sums.mean(axis=0) < [1.01, 1.3]).all() and (sums.min(axis=0) / sums.mean(axis=0) > [0.99, 0.8]).all()


def test_hot_groups_are_split_and_others_are_whole(spark):
    rows = texts(1500) + [(5000 + i, "the same text again and again") for i in range(1500)] + [(9000 + i, None if i % 2 else "") for i in range(900)]
    rows += [(20_000 + i, f"copy {i % 40}") for i in range(400)]
    out = packed(spark, rows)
    sums = check(rows, out)
    assert sums[:, 0].max() / sums[:, 0].mean() < 1.01 and sums[:, 0].min() / sums[:, 0].mean() > 0.99
    by_text = defaultdict(set)
    texts_of = dict(rows)
    for r in out:
        by_text[texts_of[r["doc_id"]] or ""].add(r["shard"])
    assert {t for t, s in by_text.items() if len(s) > 1} <= {"", "the same text again and again"}


def test_shards_follow_the_content(spark):
    rows = texts(500)
    first = {r["doc_id"]: r["shard"] for r in packed(spark, rows)}
    assert first == {r["doc_id"]: r["shard"] for r in packed(spark, rows[::-1], 5)}


def test_placing_equals_a_plain_loop(spark):
    """One cell, no large group: a loop over all groups, largest first, gives the same shards."""
    rows = [(i, "ab " * (i % 37 + 1) + str(i)) for i in range(1500)]
    out = {r["doc_id"]: r["shard"] for r in packed(spark, rows, shards=2)}
    measure = {i: np.array([len(t.encode()) + 1, len(t.split()), 1.0]) for i, t in rows}
    capacity = sum(measure.values()) / 2
    left = np.tile(capacity, (2, 1))

    large = {i for i, d in measure.items() if (d > capacity / packing.LARGE).any()}
    order = sorted(measure, key=lambda i: (i not in large, -measure[i][0], hashlib.md5(rows[i][1].encode()).digest()))
    for i in order:
        fits = [s for s in range(2) if (left[s] / capacity >= measure[i] / capacity).all()] or [s for s in range(2) if left[s][0] >= measure[i][0]]
        best = max(fits, key=lambda s: (left[s] / capacity) @ (measure[i] / capacity)) if fits else int(left[:, 0].argmax())
        left[best] -= measure[i]
        assert out[i] == best or abs((left[0] - left[1]) @ (1 / capacity)) < 1e-2


def test_work_tables_have_as_many_files_as_their_rows_need(spark, monkeypatch):
    """Not one for each shuffle partition: a small table in 40 of them leaves one file, or one for each 400 rows."""
    from keyspan.session import work_dir

    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    monkeypatch.setattr(packing, "LARGE", 8)
    monkeypatch.setattr(packing, "CELL", 200)
    rows = texts(1800)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        shards = []
        for size, most in ((20_000, 1), (400, 6)):
            monkeypatch.setattr(packing, "FILE_ROWS", size, raising=False)
            here = Path(work_dir(spark).removeprefix("file:"))
            before = set(here.glob("keyspan/*/packing-*"))
            out = packed(spark, rows)
            check(rows, out)
            shards.append({r["doc_id"]: r["shard"] for r in out})
            files = defaultdict(int)
            for p in set(here.glob("keyspan/*/packing-*")) - before:
                name = p.name.rsplit("-", 1)[0]
                files[name] = max(files[name], len(list(p.glob("part-*"))))
            assert set(files) == {"packing-rows", "packing-groups", "packing-cells", "packing-slots"}
            assert all(n <= most for name, n in files.items() if name != "packing-rows"), files
        assert shards[0] == shards[1]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_words_are_runs_of_anything_but_white_space(spark):
    odd = ["", " ", "\n \r\n", "a", " a", "a ", "\ta b\x0b\x0cc \r\n", "a\u00a0b\u2003c d", "\U0001f600 \U0001f600x\n\n", "\x1c \x00 \x85", "$1 \\w\n", "a\n" * 5000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", packing.words(F.col("t")).alias("n"), F.regexp_count("t", F.lit(r"[^\x20\x09-\x0D]+")).alias("m"))
    want = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in enumerate(odd)}
    assert {r["i"]: r["n"] for r in got.collect()} == {r["i"]: r["m"] for r in got.collect()} == want
    assert dict(got.dtypes)["n"] == "bigint"


def test_odd_tables(spark):
    assert packed(spark, []) == []
    for rows in ([(1, None)], [(None, "a"), (None, "a"), (3, "a")], [(1, "x" * 500_000), (2, ""), (2, "")]):
        check(rows, packed(spark, rows))
    kept = packed(spark, [(1, "a"), (2, "b")], keep=("doc_id", "digest", "text"))
    assert sorted((r["doc_id"], r["digest"], r["text"]) for r in kept) == [(1, 1, "a"), (2, 1, "b")]
    with pytest.raises(ValueError, match="shard"):
        packed(spark, [(1, "a")], keep=("shard",))


def test_a_demand_goes_where_the_dot_product_is_highest():
    residual = np.array([[0.5, 0.5, 0.1], [0.2, 0.2, 0.9], [0.05, 0.9, 0.9]])
    assert packing.choose(residual, np.array([0.1, 0.1, 0.01])) == (0, True)
    assert packing.choose(residual, np.array([0.01, 0.01, 0.2])) == (2, True)
    assert packing.choose(residual, np.array([0.6, 0.0, 0.0])) == (0, False)
    left = np.ones((2, 3))
    pieces = packing.place_large([(b"a", np.array([1.5, 0.3, 0.2]), 30), (b"b", np.array([0.4, 0.1, 0.1]), 2)], left)
    assert sum(n for _, n in pieces[b"a"]) == 30 and len(pieces[b"a"]) == 2 and sum(n for _, n in pieces[b"b"]) == 2
    assert abs(left[0] - left[1]).max() < 0.15
