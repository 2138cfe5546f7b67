"""The LSH-forest join against all pairs."""

import random

import pytest

from keyspan.llm import neardup


def words_of(text):
    return (text or "").encode().lower().split()


def grams(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """[(doc_id, class_id, n_links)] from all pairs of rows."""
    sets = [grams(t) if i is not None else set() for i, t in rows]
    links = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a].append(b)
                links[b].append(a)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a, bs in enumerate(links):
            low = min([label[a], *(label[b] for b in bs)])
            changed |= low != label[a]
            label[a] = low
    least = {}
    for a, (i, _) in enumerate(rows):
        least[label[a]] = i if i is None else min(i, least.get(label[a], i))
    return sorted(((i, least[label[a]], len(links[a])) for a, (i, _) in enumerate(rows)), key=str)


def found(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, node string, n int").repartition(3)
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in neardup.jaccard_classes(frame).collect()), key=str)


def near_copies(rnd, count, edits, size=120):
    base = [f"w{rnd.randrange(5000)}" for _ in range(size)]
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(rnd.randint(0, edits)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_groups_of_copies(spark):
    rnd = random.Random(1)
    texts = [t for _ in range(12) for t in near_copies(rnd, rnd.randint(1, 9), 4, rnd.choice([8, 60, 200]))]
    texts += ["same text again and again here"] * 40 + [t.upper() for t in texts[:5]]
    texts += [" ".join(f"u{rnd.randrange(10**6)}" for _ in range(80)) for _ in range(60)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    assert found(spark, rows) == brute(rows)


def test_a_group_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = list(enumerate(near_copies(random.Random(2), 90, 3)))
    assert found(spark, rows) == brute(rows)


def test_prefixes_are_shortened_until_the_target():
    """Links close to the threshold need shorter prefixes, whatever the table holds."""
    depths = [neardup._depth(t) for t in (0.95, 0.9, 0.8, 0.75)]
    assert depths == sorted(depths, reverse=True) and depths[0] == neardup.DEPTH and depths[-1] < neardup._depth(0.95)
    for threshold, depth in zip((0.95, 0.9, 0.8, 0.75), depths):
        assert neardup._recall(depth, threshold) >= neardup.TARGET
        assert depth == neardup.DEPTH or neardup._recall(depth + 1, threshold) < neardup.TARGET


def test_ids_that_repeat_under_other_texts(spark):
    """Near copies whose ids also stand on texts of their own, and one id on a third of the rows."""
    rnd = random.Random(11)
    rows = [(k, t) for k in range(20) for t in near_copies(rnd, 2, 4, 80)]
    rows += [(k % 20, " ".join(f"v{rnd.randrange(10**6)}" for _ in range(60))) for k in range(60)]
    rows += [(3, " ".join(f"z{rnd.randrange(10**6)}" for _ in range(40))) for _ in range(60)]
    rnd.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_a_shared_footer_makes_no_component(spark, monkeypatch):
    """Pages that share a fifth of their words are candidates of each other, and none is a link."""
    rnd = random.Random(12)
    footer = " ".join(f"foot{k}" for k in range(40))
    rows = [(i, " ".join(f"b{rnd.randrange(10**6)}" for _ in range(rnd.randint(60, 90))) + " " + footer) for i in range(1500)]
    sizes = []
    made = neardup.components
    monkeypatch.setattr(neardup, "components", lambda edges, label: sizes.append(edges.count()) or made(edges, label))
    assert {(i, c, n) for i, c, n in found(spark, rows)} == {(i, i, 0) for i, _ in rows}
    assert sizes[0] <= 5


def test_a_large_group_does_not_decide_for_small_ones(spark):
    """245,000 easy links of one group, and 500 pairs at a similarity of exactly 0.8."""
    rnd = random.Random(7)
    texts = near_copies(rnd, 700, 1, 60)
    for _ in range(500):
        words = [f"p{rnd.randrange(10**7)}" for _ in range(49)]
        texts += [" ".join(words), " ".join(words[:-5] + [f"q{rnd.randrange(10**7)}" for _ in range(5)])]
    links = {i: n for i, _, n in found(spark, list(enumerate(texts)))}
    assert [i for i in range(700, 1700) if links[i] != 1] == []
    assert neardup._recall(neardup._depth(neardup.THRESHOLD), neardup.THRESHOLD) >= neardup.TARGET


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one two three"), (7, "one two three"),
        (None, "one two three"), (8, "a " * 50_000), (9, "a " * 40_000), (10, "é ü ß ñ ç 1"), (11, "é ü ß ñ ç 1"), (12, "%"),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, "")]) == [(1, 1, 0)]


def test_one_of_each(spark):
    rows = [(3, "a b c d e f", "x"), (1, "a b c d e f", "y"), (5, "other words that are not the same", "z"), (6, None, None), (7, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = neardup.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 6, 7]


def test_one_of_each_keeps_one_row_of_each_class_and_no_text_is_lost(spark):
    """An id on several texts, equal rows with one id, and columns with names of the operator's own."""
    rnd = random.Random(13)
    pair = near_copies(rnd, 2, 2, 300)
    rows = [(1, pair[0], 0, "a"), (2, pair[1], 0, "b"), (2, "a text of its own under the same id", 0, "c")]
    rows += [(4, "the very same row twice over here", 0, "d")] * 2 + [(None, "without an id", 0, "e")] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, row int, node string").repartition(3)
    kept = neardup.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(r.node for r in kept.collect()) == ["a", "c", "d", "e", "e"]
    assert neardup.one_of_each(frame.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 4, 5, 6, 30])
def test_shingles_and_exact_similarity(n):
    texts = [" ".join(f"w{i}" for i in range(n)), "", "w0 w1", " ".join(f"w{i % 3}" for i in range(n))]
    hashes, counts = neardup.shingles(texts)
    assert [len(s) for s in neardup.distinct_sets(hashes, counts)] == [len(grams(t)) for t in texts]
