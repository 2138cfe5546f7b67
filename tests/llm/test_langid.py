"""Language filters: membership, false positives, votes against sets, held-out accuracy."""

import re
import zlib

import numpy as np
import pytest

from keyspan.llm import langid
from keyspan.llm.queries import op7_language_id


def plain_grams(text, n):
    """n-grams of the words between their blanks; one that holds a blank inside is none."""
    lines = [re.sub(r"[^\w]|[\d_]", " ", line) for line in text.lower().split("\n")]
    out = []
    for line in lines:
        clean = re.sub(" +", " ", f" {line} ")
        parts = [clean[i : i + n] for i in range(len(clean) - n + 1)]
        out += [p for p in parts if " " not in p[1:-1] and not p[0] == " " == p[-1]]
    return out


def number(gram):
    return int(langid.grams(np.array([ord(c) for c in gram], np.uint32), len(gram))[0])


@pytest.mark.parametrize("n", [2, 3, 4])
def test_grams(n):
    text = "Ab c!! d\n\n é-ßx 12 tEst"
    points, _ = langid.letters([text])
    got = langid.grams(points, n)[langid.usable(points, n)]
    assert sorted(set(got.tolist())) == sorted({number(g) for g in plain_grams(text, n)})


def test_filters_hold_all_members_and_few_others():
    rng = np.random.default_rng(1)
    members = {f"l{i:02}": rng.integers(0, 2**62, 3000, dtype=np.uint64) for i in range(70)}
    filters = langid.build(members)
    other = rng.integers(0, 2**62, 20_000, dtype=np.uint64)
    assert len(filters.slots) == 2
    for i, name in enumerate(filters.languages):
        bit = np.uint64(1) << np.uint64(i % 64)
        assert (filters.masks(members[name], i // 64) & bit).all()
        false = ((filters.masks(other, i // 64) & bit) > 0).mean()
        assert abs(false - filters.chance[i]) < 0.003 + filters.chance[i]


@pytest.fixture(scope="module")
def filters():
    texts = {"aa": "banana bandana cabana", "bb": "xylo phone xenon oxen"}
    out = {}
    for name, text in texts.items():
        points, _ = langid.letters([text])
        out[name] = np.concatenate([np.unique(langid.grams(points, n)[langid.usable(points, n)]) for n in langid.LENGTHS])
    return langid.build(out)


def test_votes_are_counts_of_members(filters):
    texts = ["banana", "xenon banana banana", "", "12 !!", "zzz"]
    got, total = langid.votes(filters, texts)
    assert total[2] == total[3] == 0 and got[0, 0] > got[0, 1] and got[1, 0] > got[1, 1] > 0 and got[4].max() < 1
    alone = [langid.votes(filters, [t]) for t in texts]
    assert np.allclose(got, np.concatenate([a for a, _ in alone])) and np.allclose(total, np.concatenate([t for _, t in alone]))


def test_odd_rows(spark, filters):
    rows = [(1, None), (2, ""), (3, "123 --"), (4, "Xylo\nphone"), (None, "banana"), (6, "banana " * 50_000), (4, "İstanbul ban"), (7, "zzz")]
    frame = spark.createDataFrame([(*r, "q", 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in langid.languages(frame, filters).collect())
    assert [g[:2] for g in got] == [(0, "aa"), (1, "und"), (2, "und"), (3, "und"), (4, "aa"), (4, "bb"), (6, "aa"), (7, "aa")]
    assert all(0 <= s <= 1 for *_, s in got) and got[-1][2] == 0 and got[1][2] == 0
    assert langid.languages(frame.limit(0), filters).count() == 0


def test_without_languages(spark):
    frame = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    got = langid.languages(frame, langid.train(frame)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2


def test_training_reads_no_held_out_row(spark):
    rows = [(i, "banana bandana" if i % 2 else "xylo phone", "aa" if i % 2 else "bb") for i in range(100)]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % langid.FOLDS == 0}
    other = [(i, "qqqq wwww", "cc") if i in held else (i, t, name) for i, t, name in rows]
    a, b = (langid.train(spark.createDataFrame(x, "doc_id long, text string, lang string")) for x in (rows, other))
    assert a.languages == b.languages and (a.slots == b.slots).all()


def test_held_out_accuracy(spark):
    directory = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{directory}/documents.parquet").collect()}
    rows = [r for r in op7_language_id(spark, directory).collect() if r.held_out and truth[r.doc_id]]
    assert len(rows) > 100 and np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.98


def test_training_over_many_lang_values_takes_the_least_hashes_of_each(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(langid, "SAMPLE", 3)
    i = F.col("id")
    docs = spark.range(4000).select(
        i.alias("doc_id"), F.when(i % 4 != 0, "common").otherwise(F.concat(F.lit("l"), i % 500)).alias("lang"),
        F.concat(F.lit("word"), F.translate(i.cast("string"), "0123456789", "abcdefghij")).alias("text"),
    )
    kept, write = [], langid.materialize
    monkeypatch.setattr(langid, "materialize", lambda df, label: kept.append((label, write(df, label))) or kept[-1][1])
    filters = langid.train(docs)
    known = docs.where(langid.fold(F.col("doc_id"), langid.FOLDS) != 0)
    assert filters.languages == sorted(r[0] for r in known.select("lang").distinct().collect()) and len(filters.languages) > 100
    want = {}
    for r in known.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).collect():
        want.setdefault(r["lang"], []).append((r["h"], r["doc_id"]))
    got = {(r["lang"], r["doc_id"]) for r in dict(kept)["langid-sample"].collect()}
    assert got == {(lang, d) for lang, rows in want.items() for _, d in sorted(rows)[:3]}
