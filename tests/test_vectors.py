import numpy as np
import pytest
from pyspark.sql import functions as F

from keyspan.functions import vectors
from keyspan.model import KeyspanError
from keyspan.operators import knn as nn
from keyspan.operators import nearest, vector_cells

# Golden scores: metric, left, right, score.
GOLDEN = [
    ("cosine", [1, 0], [1, 0], 1.0), ("cosine", [1, 0], [-1, 0], 0.0), ("cosine", [1, 0], [0, 1], 0.5),
    ("cosine", [0, 0], [1, 1], 0.5), ("dot_product", [3, 4], [3, 4], 13.0), ("dot_product", [3, 4], [1, 0], 2.0),
    ("euclidean", [0, 0], [3, 4], 1 / 26), ("euclidean", [1, 2], [1, 2], 1.0),
]


@pytest.mark.parametrize("metric,left,right,score", GOLDEN)
def test_golden_scores(spark, metric, left, right, score):
    df = spark.createDataFrame([([float(x) for x in left], [float(x) for x in right])], "a array<float>, b array<float>")
    row = df.select(vectors.similarity("a", "b", metric), vectors.score_against("a", right, metric)).first()
    assert row[0] == pytest.approx(score, abs=1e-12) and row[1] == pytest.approx(score, abs=1e-12)


def test_null_vectors_score_null(spark):
    df = spark.createDataFrame([([1.0], None), (None, [1.0]), ([2.0], [2.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.similarity("a", "b", "dot_product")).collect()]
    assert got == [None, None, 2.5]


@pytest.mark.parametrize("a,b", [([1.0, 2.0], [1.0]), ([], []), ([1.0, None], [1.0, 2.0])])
def test_bad_vectors_are_errors(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="dimension|null element"):
        df.select(vectors.similarity("a", "b", "cosine")).collect()


def test_query_checks():
    for bad in (None, [], [1.0, None]):
        with pytest.raises(KeyspanError):
            vectors.check_vector(bad)
    assert nn.check_k(0) == 10 and nn.check_k(-3) == 10 and nn.check_k(10_000) == 10_000
    with pytest.raises(KeyspanError):
        nn.check_k(10_001)
    with pytest.raises(KeyspanError):
        vectors.check_metric("manhattan")


@pytest.mark.parametrize("n", [1, 63, 64, 65, 100, 1536])
def test_downsample(spark, n):
    values = [float(i) for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<float>")
    got = df.select(vectors.downsample(F.col("v"))).first()[0]
    want = values if n <= 64 else [values[min(n - 1, (i * n + n // 2) // 64)] for i in range(64)]
    assert got == want


def test_parse_vectors(spark):
    texts = ["[1, 2.5,3]", "1 2 3", " 1,2\n3 ", "[1,x,3]", "", None, "[]", "1,2", "1,Infinity,2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = {r["i"]: r for r in vectors.parse_vectors(df, "t", 3).collect()}
    assert rows[0]["vector"] == [1.0, 2.5, 3.0] and rows[1]["vector"] == [1.0, 2.0, 3.0] == rows[2]["vector"]
    assert rows[3]["vector_error"] == "element 2 is not a finite number: x"
    assert rows[4]["vector_error"] == rows[5]["vector_error"] == "nothing to read"
    assert rows[6]["vector_error"] == "a vector without elements"
    assert rows[7]["vector_error"] == "2 elements instead of 3"
    assert rows[8]["vector_error"] == "element 2 is not a finite number: Infinity"


def test_vector_round_trip_is_exact(spark, place):
    rng = np.random.default_rng(1)
    vecs = rng.standard_normal((5, 1536)).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "i int, v array<float>")
    path = place()
    df.write.parquet(path)
    back = np.array([r["v"] for r in spark.read.parquet(path).orderBy("i").collect()], dtype="float32")
    assert (back == vecs).all()
    text = df.select("i", vectors.vector_text(F.col("v")).alias("t"))
    parsed = vectors.parse_vectors(text, "t", 1536).orderBy("i").collect()
    assert (np.array([r["vector"] for r in parsed], dtype="float32") == vecs).all()


def cloud(spark, n=400, dims=16, seed=42, copies=120):
    """Random vectors of which many are copies of one, so ties are common."""
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, dims)).astype("float32")
    m[:copies] = m[0]
    rows = [(i, f"k{i:04d}", int(i % 5), [float(x) for x in v]) for i, v in enumerate(m)]
    return m.astype("float64"), spark.createDataFrame(rows, "id bigint, name string, cat int, v array<float>").repartition(5)


def brute(m, q, metric):
    dot = m @ q
    if metric == "dot_product":
        return (1 + dot) / 2
    if metric == "euclidean":
        return 1 / (1 + ((m - q) ** 2).sum(axis=1))
    return (1 + dot / (np.linalg.norm(m, axis=1) * np.linalg.norm(q))) / 2


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_knn_is_exact(spark, metric):
    m, df = cloud(spark)
    scores = brute(m, m[7], metric)
    want = sorted(range(len(m)), key=lambda i: (-round(scores[i], 9), i))[:200]
    got = nn.knn(df, "v", list(m[200]), 200, metric, key=["id"], select=["id"])
    scores = brute(m, m[200], metric)
    best = sorted(scores, reverse=True)[:200]
    assert np.allclose(sorted((r[f"{metric}_score"] for r in got.collect()), reverse=True), best)
    assert len(want) == 200


def test_hybrid_filters_before_ranking(spark):
    m, df = cloud(spark)
    got = nn.knn(df, "v", list(m[3]), 10, key=["id"], where=[("cat", "=", 2)], select=["id", "cat"], include_vector=True)
    rows = got.collect()
    assert len(rows) == 10 and all(r["cat"] == 2 for r in rows) and got.columns == ["id", "cat", "v", "cosine_score"]


def test_projection_rules(spark):
    m, df = cloud(spark, 20)
    assert nn.knn(df, "v", list(m[0]), 3).columns == ["id", "name", "cat", "v", "cosine_score"]
    assert nn.knn(df, "v", list(m[0]), 3, select=["id"]).columns == ["id", "cosine_score"]
    assert nn.knn(df, "v", list(m[0]), 3, select=["id"], scores=["euclidean"]).columns == ["id", "euclidean_score"]


def test_warnings():
    said = nn.knn_warnings("cosine", ["cosine", "euclidean"], [("cat", "=", 1)], [], True, 1536, 10)
    assert len(said) == 3 and "15360" in said[2]
    assert nn.knn_warnings("cosine", ["cosine"], [("cat", "=", 1)], ["cat"], True, 256) == []


@pytest.mark.parametrize("key", ["id", "name"])
@pytest.mark.parametrize("metric", vectors.METRICS)
@pytest.mark.parametrize("grid", [False, True])
def test_knn_join_matches_brute_force_with_ties(spark, key, metric, grid):
    m, df = cloud(spark, 260, 8, copies=100)
    queries = df.where("id in (0, 150, 151, 200)").select(F.col(key).alias("q"), "v")
    limits = {"query_bytes": 100, "cell_bytes": 3000} if grid else {}
    got = nn.knn_join(queries, df.select(key, "v"), "v", 7, "q", key, metric, **limits).collect()
    assert len(got) == 4 * 7
    found = {}
    for r in got:
        found.setdefault(r["q"], {})[r["rank"]] = (r[key], r["score"])
    label = (lambda i: i) if key == "id" else (lambda i: f"k{i:04d}")
    for i in (0, 150, 151, 200):
        scores = brute(m, m[i], metric)
        want = sorted(range(len(m)), key=lambda j: (-scores[j], j))[:7]
        mine = [found[label(i)][rank] for rank in range(1, 8)]
        assert np.allclose([s for _, s in mine], [scores[j] for j in want])
        if i == 0:
            # All hundred copies tie; the smallest keys are kept.
            if metric != "dot_product":
                assert [k for k, _ in mine] == [label(j) for j in range(7)]


def test_similar_to_row(spark):
    m, df = cloud(spark)
    got = nn.similar_to_row(df, {"id": 333}, "v", 5, select=["id"]).collect()
    assert got[0]["id"] == 333
    with pytest.raises(KeyspanError):
        nn.similar_to_row(df, {"id": -1}, "v")


def test_ann_finds_the_nearest_with_probes(spark):
    m, df = cloud(spark, 600, 32, copies=1)
    index = nn.build_ann_index(df, "v", 32, tables=8, bits=6)
    exact = nn.knn(df, "v", list(m[50]), 10, key=["id"])
    near = nn.ann(index, "v", list(m[50]), 10, 8, 6, key=["id"], probes=1)
    wide = nn.ann(index, "v", list(m[50]), 10, 8, 6, key=["id"], probes=6)
    recall = nn.ann_recall(exact, near, ["id"]).first()
    assert recall["expected"] == 10 and recall["recall"] >= 0.5
    assert nn.ann_recall(exact, wide, ["id"]).first()["recall"] == 1.0


def test_profile(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0, None])], "id int, v array<float>")
    rows = {r["id"]: r for r in vectors.vector_profile(df, "v", ["id"]).collect()}
    assert rows[1]["magnitude"] == 5.0 and rows[2]["is_zero"] and not rows[1]["is_zero"]
    assert rows[3]["null_elements"] == 1 and rows[3]["dimensions"] == 2


def test_stored_index_reads_the_visited_folders(spark, place):
    m, df = cloud(spark)
    path, query = place(), [float(x) for x in m[7]]
    nn.write_ann_index(df, "v", 16, path, 4, 3)
    stored = nn.ann_stored(spark, path, "v", query, 10, 4, 3, key=["id"])
    direct = nn.ann(nn.build_ann_index(df, "v", 16, 4, 3), "v", query, 10, 4, 3, key=["id"])
    assert [r["id"] for r in stored.collect()] == [r["id"] for r in direct.collect()]
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(" in plan and "_bucket" in plan


def test_large_k_bounds_the_queries_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(nn, "HELD_RESULTS", 50)
    m, df = cloud(spark, n=60, copies=5)
    few = nn.knn_join(df.select("id", "v"), df.select("id", "v"), "v", 10, "id", "id")
    monkeypatch.setattr(nn, "HELD_RESULTS", 10**6)
    many = nn.knn_join(df.select("id", "v"), df.select("id", "v"), "v", 10, "id", "id")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def clusters(spark, n=1200, groups=12, dims=8, hot=400):
    """Points around centres; a third of the rows are one vector."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 10, (groups, dims))
    m = (centres[rng.integers(0, groups, n)] + rng.normal(0, 0.3, (n, dims))).astype("float32")
    m[:hot] = m[0]
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, v array<float>")


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_cells_find_the_nearest_and_compare_few_pairs(spark, place, metric):
    m, df = clusters(spark)
    index = vector_cells.write_vector_cells(df, "v", place(), ["id"], metric, cells=24)
    asked = df.where("id % 60 = 0 OR id = 1199")
    pairs = []
    got = index.knn_join(asked, "v", 5, "id", report=pairs).collect()
    wanted = {}
    for q in sorted(r["id"] for r in asked.select("id").collect()):
        scores = brute(m, m[q], metric)
        wanted[q] = sorted(range(len(m)), key=lambda j: (-scores[j], j))[:5]
        mine = sorted((r["rank"], r["neighbor_id"], r["score"]) for r in got if r["id"] == q)
        assert np.allclose([s for _, _, s in mine], [scores[j] for j in wanted[q]])
    if metric == "euclidean":
        assert sum(pairs) < 0.6 * len(m) * asked.count()
        single = index.knn([float(x) for x in m[700]], 5, select=["id"]).collect()
        scores = brute(m, m[700], metric)
        assert np.allclose([r["euclidean_score"] for r in single], sorted(scores, reverse=True)[:5])
        assert len(index.visited([float(x) for x in m[700]], 5)) < len(index.count)


def test_cells_reach_a_recall_where_vectors_lie_evenly(spark, place):
    m, df = cloud(spark, 3000, 24, copies=1)
    path = place()
    vector_cells.write_vector_cells(df, "v", path, ["id"], sample=1500)
    index = vector_cells.VectorCells(spark, path)
    asked = df.where("id % 20 = 0").select("id", "v")
    pairs = []
    near = index.knn_join(asked, "v", 10, "id", recall=0.9, report=pairs)
    exact = nn.knn_join(asked, df.select("id", "v"), "v", 10, "id", "id")
    assert nn.ann_recall(exact, near, ["id", "neighbor_id"]).first()["recall"] >= 0.9
    assert sum(pairs) < 0.8 * 3000 * 150 and index.probes(0.9) < len(index.count)


def test_cells_with_predicates_and_odd_tables(spark, place):
    m, df = cloud(spark, 400, 8, copies=1)
    index = vector_cells.write_vector_cells(df, "v", place(), ["id"], cells=9)
    query = [float(x) for x in m[3]]
    for where in ([("cat", "=", 2)], [("id", "<", 7)], [("id", "<", 0)]):
        want = nn.knn(df, "v", query, 10, key=["id"], where=where, select=["id"]).collect()
        assert index.knn(query, 10, where=where, select=["id"]).collect() == want
    one = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (1, [0.0, 0.0])], "id bigint, v array<float>")
    index = vector_cells.write_vector_cells(one, "v", place(), ["id"])
    assert [r["id"] for r in index.knn([1.0, 0.0], 5, select=["id"]).collect()] == [1, 1]
    assert index.knn_join(one.where("id = 2"), "v", 5, "id").count() == 0
    with pytest.raises(KeyspanError):
        vector_cells.write_vector_cells(one.where("id = 2"), "v", place(), ["id"])
    with pytest.raises(KeyspanError):
        vector_cells.VectorCells(spark, place())


def joined(rows, key="id"):
    return sorted((r[0], r["rank"], r[1], round(r["score"], 9)) for r in rows.collect())


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_many_queries_are_spread_and_few_pairs_are_ranked(spark, monkeypatch, metric):
    m, df = cloud(spark, 700, 8, copies=90)
    want = joined(nn.knn_join(df, df.select("id", "v"), "v", 6, "id", "id", metric))
    monkeypatch.setattr(nn, "MANY_QUERIES", 100)
    got = nn.knn_join(df, df.coalesce(1).select("id", "v"), "v", 6, "id", "id", metric)
    assert joined(got) == want and len(want) == 700 * 6
    # One file or not, the scoring is done by many tasks.
    assert "RoundRobinPartitioning" in got._jdf.queryExecution().executedPlan().toString()


def test_few_of_all_pairs_are_scored_exactly(monkeypatch):
    import pyarrow as pa

    m = np.random.default_rng(3).standard_normal((3000, 16)).astype("float32")
    m[:1500] = m[0]
    column, scored, score = pa.array(list(m), pa.list_(pa.float32())), [], nearest.Nearest._score
    monkeypatch.setattr(nearest.Nearest, "_score", lambda self, of, *rest: scored.append(len(of)) or score(self, of, *rest))
    for block in (1 << 30, 40):
        scored.clear()
        held, place = nearest.Vectors(column, 16, "cosine"), np.arange(3000)[::-1]
        kept = nearest.without_copies(held.given, place, 5)
        of, row, got = nearest.Nearest(column, 16, 5, "cosine", block=block).add(held.take(kept), place[kept])
        assert len(kept) == 1505 and len(of) == 15_000 and sum(scored) < 0.05 * 3000 * 3000
        # Of the copies those with the least places, which are the last rows here.
        assert kept[row[of == 7]].tolist() == [1499, 1498, 1497, 1496, 1495] and len(set(got[of == 7])) == 1


def test_cells_of_a_grid_are_not_sent_one_by_one(spark, monkeypatch):
    m, df = cloud(spark, 300, 8, copies=40)
    sent, group = [], type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *c: sent.append(self.count()) or group(self, *c))
    got = nn.knn_join(df, df.select("id", "v"), "v", 4, "id", "id", query_bytes=100, cell_bytes=100)
    assert sum(sent) <= 2 * 300 * nn.PARTS
    monkeypatch.undo()
    assert joined(got) == joined(nn.knn_join(df, df.select("id", "v"), "v", 4, "id", "id"))


def test_what_a_grid_sends_grows_as_the_table(spark, monkeypatch):
    frame, ranked, sent = type(spark.range(0)), nn._ranked, []
    group = frame.groupBy
    monkeypatch.setattr(frame, "groupBy", lambda self, *c: sent.append(self.count()) or group(self, *c))
    monkeypatch.setattr(nn, "_ranked", lambda part, *rest: sent.append(part.count()) or ranked(part, *rest))
    for n in (200, 800):
        df = cloud(spark, n, 8, copies=1)[1].select("id", "v")
        nn.knn_join(df, df, "v", 4, "id", "id", query_bytes=100, cell_bytes=480)
    # Queries, rows and pairs found: four times the table, four times of each, while there are sixteen times the cells.
    assert len(sent) == 6 and sum(sent[3:]) < 4.5 * sum(sent[:3])


def test_repeated_and_null_keys_and_odd_vectors_in_both_ways(spark):
    rows = [(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [0.0, 0.0]), (2, [1.0, 0.0]), (9, None), (8, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    small = nn.knn_join(df, df, "v", 2, "id", "id").collect()
    grid = nn.knn_join(df, df, "v", 2, "id", "id", query_bytes=1, cell_bytes=1).collect()
    assert sorted(map(str, small)) == sorted(map(str, grid)) and len(small) == 2 * 4
    assert {r["neighbor_id"] for r in small if r["id"] == 2} == {None, 2}


def test_a_join_sends_queries_to_stripes_and_not_to_each_cell(spark, place, monkeypatch):
    m, df = cloud(spark, 600, 24, copies=1)
    index = vector_cells.write_vector_cells(df, "v", place(), ["id"], cells=100)
    sent, group = [], type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *c: (len(c) == 3 and sent.append(self.count())) or group(self, *c))
    got = index.knn_join(df, "v", 5, "id")
    # Two looks; in each a query goes to a stripe once, and a row to the parts of the queries.
    assert len(sent) == 4 and sum(sent) <= 2 * 600 * (2 * nn.PARTS + 1)
    monkeypatch.undo()
    assert joined(got) == joined(nn.knn_join(df, df.select("id", "v"), "v", 5, "id", "id"))


def test_distances_from_centroids_are_held_for_a_slice_of_vectors(monkeypatch):
    m, away, held = np.random.default_rng(2).standard_normal((5000, 8)), vector_cells._distances, []
    monkeypatch.setattr(vector_cells, "_distances", lambda a, b: held.append(len(a)) or away(a, b))
    centroids = vector_cells.fit_centroids(m, 70)
    vector_cells._needed(m, centroids)
    cell, far = vector_cells._closest(m, centroids)
    assert max(held) <= vector_cells.SLICE < 5000
    assert (cell == away(m, centroids).argmin(axis=1)).all() and np.allclose(far, away(m, centroids).min(axis=1))
