"""Reply trees against a plain walk, and templates that read back."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyspan.llm import chat

SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def brute(rows, top):
    """{(tree, branch): [(role, text)]} by walking up from each leaf."""
    nodes = {}
    for tree, node, parent, role, text, score in rows:
        if node is not None:
            new = (parent is not None, parent or 0, role or "", text or "", score is not None, score or 0.0)
            nodes[tree, node] = min(nodes.get((tree, node), new), new)
    up = {k: (k[0], m[1]) if m[0] and (k[0], m[1]) in nodes and m[1] != k[1] else None for k, m in nodes.items()}
    leaves, out = {}, {}
    for k in nodes:
        if k in up.values():
            continue
        path, at = [], k
        while at is not None and at not in path:
            path.append(at)
            at = up[at]
        if at is None:
            leaves.setdefault(k[0], []).append((-sum(nodes[p][5] for p in path), -len(path), k[1], path[::-1]))
    for tree, found in leaves.items():
        for i, (*_, path) in enumerate(sorted(found)[:top]):
            out[tree, i + 1] = [(nodes[p][2], nodes[p][3]) for p in path]
    return out


def formatted(spark, rows, top=1):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit(1)).withColumn("pos", F.lit("x"))
    return chat.read_back(chat.format_trees(frame, top)).collect()


def check(spark, rows, top):
    got = formatted(spark, rows, top)
    want = brute(rows, top)
    assert {(r.tree, r.branch): [(t.role, t.text) for t in r.turns] for r in got} == want
    for r in got:
        assert r.learned == "".join(x for role, x in want[r.tree, r.branch] if role == "assistant")
        for span, text in zip(r.loss, [x for role, x in want[r.tree, r.branch] if role == "assistant"], strict=True):
            assert r.formatted[span.start : span.end].replace("\\", "") == text.replace("\\", "")


def test_random_trees(spark):
    rnd = random.Random(3)
    rows = []
    for tree in range(12):
        for node in range(rnd.randint(1, 25)):
            parent = None if node == 0 else rnd.randint(max(0, node - 6), node - 1)
            rows.append((tree, node, parent, rnd.choice(["user", "assistant", "system"]), f"t{node}", float(rnd.randint(0, 5))))
    check(spark, rows, 3)


def test_a_long_chain_takes_few_rounds(spark):
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", str(i), 0.0) for i in range(300)]
    check(spark, rows, 1)


def test_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\/s>", "[\\\\INST]", "<<SYS>>a<</SYS>>", "<", "[", "\\", "a\n</s>\n", "", " x ", "<s><s>", "[INST", "[s>", "é😀</s>"]
    rows = [(i, 2 * j + k, 2 * j + k - 1, role, t, 0.0) for i, t in enumerate(texts) for j in (0, 1) for k, role in enumerate(("user", "assistant"))]
    rows += [(100, 0, None, "</s>\nodd <</SYS>>role", "[INST]", 0.0), (100, 1, 0, "user", "x", 0.0)]
    got = formatted(spark, rows)
    check(spark, rows, 1)
    for r in got:
        for control in ("<s>", "[INST]", "[/INST]"):
            assert r.formatted.count(control) <= (1 if control == "<s>" else 2)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("<>/[]\\sINTYSé "), max_size=25), min_size=1, max_size=8))
def test_any_text_reads_back(spark, texts):
    check(spark, [(0, i, i - 1, "user" if i % 2 == 0 else "assistant", t, 0.0) for i, t in enumerate(texts)], 1)


def test_odd_rows(spark):
    rows = [
        (None, 1, None, None, None, None), (None, 2, 1, "assistant", "a", 1.0), (1, 1, 99, "user", "lost parent", 0.0),
        (1, 1, 99, "user", "lost parent", 0.0), (2, 1, 2, "user", "cycle", 0.0), (2, 2, 1, "user", "cycle", 0.0),
        (2, 3, 2, "user", "below", 0.0), (3, None, 1, "user", "no id", 0.0), (4, 1, 1, "user", "own parent", 0.0),
        (5, 1, None, "user", "", 0.0), (5, 2, 1, "assistant", "x" * 200_000, 0.0), (5, 3, 1, "assistant", "tie", 0.0),
    ]
    got = {(r.tree, r.branch): [(t.role, t.text) for t in r.turns] for r in formatted(spark, rows, 2)}
    assert got == brute(rows, 2)
    assert (2, 1) not in got and (3, 1) not in got


def test_empty_table(spark):
    assert formatted(spark, []) == []


def test_plan_has_no_python(spark, capsys):
    frame = spark.createDataFrame([(1, 1, None, "user", "a", 0.0)], SCHEMA)
    chat.read_back(chat.format_trees(frame)).explain()
    assert not any(word in capsys.readouterr().out for word in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("top", [1, 2])
def test_ranks(spark, top):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 2, "user", "more", 0.5)]
    check(spark, rows, top)
