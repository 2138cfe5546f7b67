"""Merkle manifests against a tree that is built in memory."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from keyspan.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx long, h string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """All levels, the leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def siblings(levels, i):
    """[(sibling or None, the node is the right one)] from the leaf up."""
    out = []
    for level in levels[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, i % 2 == 1))
        i //= 2
    return out


def brute(rows):
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append(row)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang, held in langs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in held])
    top = tree([trees[lang][-1][0] for lang in order]) if order else []
    out = []
    for at, lang in enumerate(order):
        for i, row in enumerate(langs[lang]):
            path = siblings(trees[lang], i) + siblings(top, at)
            shown = row
            if row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                shown = (*row[:3], row[3] + 1, row[4])
            h = leaf(shown)
            for other, right in path:
                h = sha((other or "") + h if right else h + (other or ""))
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[lang][-1][0], root, sha("".join(o or "" for o, _ in path)), h, h == root))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def found(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in merkle.tampered_proofs(frame).collect()), key=key)


def table(sizes, seed=0):
    rnd = random.Random(seed)
    ids = rnd.sample(range(10**6), sum(sizes.values()))
    return [
        (ids.pop(), rnd.choice(["web", None, "ä"]), lang, rnd.choice([None, 5, -3]), rnd.choice(["", None, "né\n", "a" * 50]))
        for lang, n in sizes.items() for _ in range(n)
    ]


@pytest.mark.parametrize("step", [2, 8])
def test_proofs_equal_a_tree_in_memory(spark, monkeypatch, step):
    """Groups of many sizes, among them powers of two and their neighbours, over several stored levels."""
    monkeypatch.setattr(merkle, "STEP", step)
    rows = table({"en": 33, "de": 16, None: 1, "fr": 5, "": 2, "zz": 17, "é": 4, "Z": 3})
    assert found(spark, rows) == sorted(brute(rows), key=key)


def test_repeated_rows_and_ids_null_ids_and_empty_tables(spark):
    rows = [(1, "a", "en", 1, "x")] * 5 + [(1, "b", "en", 1, "x"), (None, "a", "en", 2, "y"), (None, None, None, None, None), (7, "a", "de", None, "z")]
    assert found(spark, rows) == sorted(brute(rows), key=key)
    assert found(spark, []) == []
    assert found(spark, [(3, None, None, 0, "")]) == sorted(brute([(3, None, None, 0, "")]), key=key)


def test_proofs_of_some_leaves_read_their_subtrees_only(spark, monkeypatch):
    monkeypatch.setattr(merkle, "STEP", 2)
    rows = table({"en": 100, "de": 9})
    manifest = merkle.build(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA))
    every = {(r["tree"], r["idx"]): r for r in manifest.proofs().collect()}
    assert len(every) == 109
    wanted = spark.createDataFrame([("en", 63), ("en", 0), ("de", 8), ("de", 100)], "tree string, idx long")
    some = manifest.proofs(wanted).collect()
    assert {(r["tree"], r["idx"]) for r in some} == {("en", 63), ("en", 0), ("de", 8)}
    assert all(r == every[r["tree"], r["idx"]] for r in some)
    # Levels 0, 2, 4 and 6 are stored for 100 leaves, and the root; the levels between them are not.
    sizes = [spark.read.parquet(f"{manifest.path}/groups/level={k}").where("tree = 'en'").count() for k in (0, 2, 4, 6, 8)]
    assert sizes == [100, 25, 7, 2, 1]


def test_a_manifest_is_reopened_and_not_overwritten(spark, place):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in table({"en": 10})], SCHEMA)
    path = place()
    made = merkle.build(docs, path)
    assert merkle.Manifest(spark, path).root() == made.root() == merkle.build(docs.repartition(5)).root()
    changed = docs.withColumn("text", F.lit("other"))
    assert merkle.build(changed).root() != made.root()
    with pytest.raises(ValueError, match="exists"):
        merkle.build(docs, path)
