"""A vector index of cells around learned centroids: exact or approximate top-k that reads the cells that matter.

Centroids are fitted on a bounded sample. Each row lies in the folder of its nearest centroid, and a cell knows the
largest distance of its rows from the centroid (its radius). By the triangle inequality no row of a cell is nearer to
a query than the centroid's distance less the radius, so cells that cannot hold one of the k nearest are not read. With
a target recall, only so many of a query's nearest cells are read as queries of the sample needed for it; where
vectors lie evenly in many dimensions that reads far less than the proof, which then excludes hardly any cell.

Distances are euclidean in a space where they order rows as the metric does: unit vectors for cosine, and vectors with
one more component, which gives all of them one length, for dot products.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyspan.functions.vectors import check_metric, check_vector, score_name
from keyspan.model import KeyspanError
from keyspan.operators import nearest
from keyspan.operators.knn import HELD_RESULTS, PARTS, TASK_BYTES, check_k, knn
from keyspan.session import materialize, path_exists, read_text, write_text

#: Rows of the sample on which centroids are fitted and recall is measured; cells at most; queries measured.
SAMPLE, MAX_CELLS, MEASURED = 20_000, 1024, 200
#: Rounds of the fit, and neighbours of a measured query.
ROUNDS, NEIGHBOURS = 12, 10
#: A first look reads the nearest cells that hold so many times k rows together.
FIRST = 4
#: Vectors whose distances from all centroids are held at a time, and pairs from which on a stripe's queries are dealt to several tasks.
SLICE, TASK_PAIRS = 1024, 200_000_000


def _space(m, metric: str, top: float):
    """Vectors (rows of a matrix) where euclidean distance orders them as the metric does."""
    import numpy as np

    if metric == "cosine":
        size = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)
    if metric == "dot_product":
        rest = np.sqrt(np.maximum(top * top - (m * m).sum(axis=1), 0))
        return np.hstack([m, rest[:, None]])
    return m


def _query_space(q, metric: str):
    """Queries in the same space; the added component of a dot product is 0."""
    import numpy as np

    return np.hstack([q, np.zeros((len(q), 1))]) if metric == "dot_product" else _space(q, metric, 0.0)


def _distances(a, b):
    import numpy as np

    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _closest(points, centroids):
    """The nearest centroid of each point and its distance."""
    import numpy as np

    cell, far = np.empty(len(points), np.int64), np.empty(len(points))
    for at in range(0, len(points), SLICE):
        away = _distances(points[at : at + SLICE], centroids)
        own = away.argmin(axis=1)
        cell[at : at + SLICE], far[at : at + SLICE] = own, away[np.arange(len(own)), own]
    return cell, far


def _bits(marks):
    """The bytes of packed bits of equal length, a row for each value."""
    import numpy as np

    return np.frombuffer(b"".join(marks.to_pylist()), np.uint8).reshape(len(marks), -1)


def _matrix(column, dims: int):
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    if flat.null_count or len(flat) != len(column) * dims:
        raise ValueError(f"every vector needs {dims} elements, none of them null")
    return flat.to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), dims)


def fit_centroids(points, cells: int):
    """Lloyd rounds from evenly drawn points; an empty cell moves to the point that is farthest from its centroid."""
    import numpy as np

    rng = np.random.default_rng(7)
    centroids = points[rng.choice(len(points), min(cells, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        own, away = _closest(points, centroids)
        count = np.bincount(own, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, own, points)
        full = count > 0
        centroids[full] = total[full] / count[full, None]
        far = np.argsort(-away)[: int((~full).sum())]
        centroids[~full] = points[far]
    return centroids


def _needed(points, centroids):
    """For each neighbour of measured queries, how many of the query's nearest cells hold it; in order."""
    import numpy as np

    queries = points[:: max(1, len(points) // MEASURED)][:MEASURED]
    away = _distances(queries, points)
    k = min(NEIGHBOURS + 1, len(points))
    near = np.argpartition(away, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(away, near, axis=1), axis=1), axis=1)[:, 1:]
    cell = _closest(points, centroids)[0]
    place = np.argsort(np.argsort(_distances(queries, centroids), axis=1), axis=1)
    return np.sort(np.take_along_axis(place, cell[near], axis=1).ravel()) + 1


def _reach(metric: str, top: float, score: float, square: float) -> float:
    """The distance of a row with this score from a query whose components' squares sum up to ``square``, a little more."""
    if metric == "cosine":
        away = 4 - 4 * score
    elif metric == "euclidean":
        away = 1 / score - 1
    else:
        away = square + top**2 - 2 * (2 * score - 1)
    return math.sqrt(max(0.0, away)) * (1 + 1e-9) + 1e-7


class VectorCells:
    """A written index: ``rows`` in folders ``_cell=n``, and ``cells`` (cell, centroid, radius, rows)."""

    def __init__(self, spark: SparkSession, path: str):
        import numpy as np

        held = read_text(spark, f"{path}/_index.json")
        if held is None:
            raise KeyspanError(f"{path} is no vector index")
        told = json.loads(held)
        self.spark, self.path = spark, path
        self.vec, self.key, self.metric, self.dims = told["vec"], told["key"], told["metric"], told["dims"]
        self.top, self.needed = told["top"], told["needed"]
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # at most MAX_CELLS rows
        self.centroids = np.array([c["centroid"] for c in cells]).reshape(len(cells), -1)
        self.radius, self.count = np.array([c["radius"] for c in cells]), np.array([c["rows"] for c in cells])

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def probes(self, recall: float | None) -> int:
        """How many of a query's nearest cells reach a recall on the measured queries; all without a target.

        The sample is thinner than the table, so its neighbours are farther away and need no fewer cells. A quarter of
        what the target leaves is kept as a margin, as the measured queries are not the ones to come.
        """
        if recall is None or recall >= 1 or not self.needed:
            return len(self.count)
        return self.needed[min(len(self.needed) - 1, math.ceil((1 + 3 * recall) / 4 * len(self.needed)))]

    def visited(self, query, k: int, recall: float | None = None, where: list[tuple] = ()) -> list[int]:
        """The cells a search reads: the first look's, and those of the nearest that may hold a row as near as its k-th best."""
        import numpy as np

        q = np.array([check_vector(query)])
        away = _distances(_query_space(q, self.metric), self.centroids)[0]
        order = np.argsort(away)[: self.probes(recall)]
        first = order[: int(np.searchsorted(np.cumsum(self.count[order]), FIRST * k)) + 1].tolist()
        seen = knn(self._of(first), self.vec, query, k, self.metric, where=list(where), select=self.key)
        scores = [r[0] for r in seen.select(score_name(self.metric)).collect()]
        if len(scores) < k:
            return sorted(order.tolist())
        reach = _reach(self.metric, self.top, min(scores), float((q * q).sum()))
        return sorted({*first, *order[(away - self.radius)[order] <= reach].tolist()})

    def _of(self, cells: list[int]) -> DataFrame:
        return self.rows().where(F.col("_cell").isin(cells)).drop("_cell", "_away")

    def knn(self, query, k: int | None = None, recall: float | None = None, where: list[tuple] = (), select=None) -> DataFrame:
        """The k nearest rows with their score; exact without a target recall. Other cells' folders are not read."""
        k = check_k(k)
        return knn(self._of(self.visited(query, k, recall, where)), self.vec, query, k, self.metric, key=self.key, where=list(where), select=select)

    def knn_join(self, queries: DataFrame, query_vec: str, k: int, query_key: str, recall: float | None = None, report: list | None = None) -> DataFrame:
        """(query key, row key, score, rank) for a table of queries: each meets only the cells that may hold a neighbour.

        The first look goes to the nearest cells; its k-th score bounds the cells of the second. Cells lie in stripes of bounded
        size, and a query is sent once to each stripe that has a cell it reads. ``report`` gets the number of pairs that are compared.
        """
        k, key = check_k(k), self.key[0]
        if len(self.key) != 1:
            raise KeyspanError("a join needs an index with one key column")
        asked = queries.where(F.col(query_vec).isNotNull()).select(
            F.monotonically_increasing_id().alias("_q"), F.col(query_key).alias("_asked"), F.col(query_vec).alias("_qvec")
        )
        asked = materialize(asked, "cells-asked")
        metric, dims, radius, probes = self.metric, self.dims, self.radius, self.probes(recall)
        count, centroids, top, marked = self.count, self.centroids, self.top, self._marked()

        def slices(batches):
            """Some queries at a time: the batch, its vectors, their distances from the centroids and the cells they may visit, nearest first."""
            import numpy as np

            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    m = _matrix(batch.column("_qvec"), dims)
                    away = _distances(_query_space(m, metric), centroids)
                    yield batch, m, away, np.argsort(away, axis=1)[:, :probes]

        def near(batches):
            import numpy as np

            for batch, _, away, order in slices(batches):
                reads = np.zeros(away.shape, bool)
                np.put_along_axis(reads, order, np.cumsum(count[order], axis=1) - count[order] < FIRST * k, axis=1)
                yield marked(batch, reads)

        def rest(batches):
            import numpy as np

            for batch, m, away, order in slices(batches):
                scores, square = batch.column("score").to_pylist(), (m**2).sum(axis=1).tolist()
                far = np.array([np.inf if s is None else _reach(metric, top, s, q) for s, q in zip(scores, square)])
                reads = np.zeros(away.shape, bool)
                np.put_along_axis(reads, order, True, axis=1)
                reads &= away - radius <= far[:, None]
                seen = np.unpackbits(_bits(batch.column("_cells")), axis=1, count=len(count)).astype(bool)
                yield marked(batch, reads & ~seen)

        vector = asked.schema["_qvec"].dataType.simpleString()
        schema = f"_q long, _qvec {vector}, score double, _cells binary, _stripes array<int>, _pairs array<long>"
        named = asked.select("_q", "_qvec", F.lit(None).cast("double").alias("score")).mapInArrow(near, schema)
        named = materialize(named, "cells-first")
        first = materialize(self._met(named, k, key, report), "cells-first-found")
        ranks = Window.partitionBy("_qid").orderBy(F.desc("score"))
        bound = first.withColumn("_r", F.row_number().over(ranks)).where(F.col("_r") == k).select(F.col("_qid").alias("_q"), "score")
        second = named.select("_q", "_qvec", "_cells").join(bound, "_q", "left").mapInArrow(rest, schema)
        found = first.unionByName(self._met(materialize(second, "cells-second"), k, key, report))
        window = Window.partitionBy("_qid").orderBy(F.desc("score"), "_cid")
        best = found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
        out_key = key if key != query_key else f"neighbor_{key}"
        joined = best.join(asked.select(F.col("_q").alias("_qid"), "_asked"), "_qid")
        return joined.select(F.col("_asked").alias(query_key), F.col("_cid").alias(out_key), "score", "rank")

    def _stripes(self):
        """Cells in order, put together to about ``PARTS`` stripes, or more where these would not fit a task: the stripe of each cell."""
        import numpy as np

        most = max(1, TASK_BYTES // (4 * self.dims + 16))
        size = min(most, -(-int(self.count.sum()) // PARTS))
        out, stripe, held = [], 0, 0
        for n in self.count.tolist():
            if held and held + n > size:
                stripe, held = stripe + 1, 0
            out.append(stripe)
            held += n
        return np.array(out, np.int32)

    def _marked(self):
        """Makes of queries and a matrix of the cells they read the rows that ``_met`` takes."""
        import numpy as np

        count, stripes = self.count, self._stripes()
        starts = np.flatnonzero(np.append(True, stripes[1:] != stripes[:-1]))

        def marked(batch, reads):
            import pyarrow as pa

            reads = reads & (count > 0)
            pairs = np.add.reduceat(reads * count, starts, axis=1)
            of, stripe = np.nonzero(pairs)
            ends = pa.array(np.searchsorted(of, np.arange(len(reads) + 1)).astype("int32"))
            lists = [pa.ListArray.from_arrays(ends, pa.array(stripe.astype("int32"))), pa.ListArray.from_arrays(ends, pa.array(pairs[of, stripe]))]
            cells = pa.array([row.tobytes() for row in np.packbits(reads, axis=1)], pa.binary())
            columns = [batch.column("_q"), batch.column("_qvec"), batch.column("score"), cells, *lists]
            return pa.RecordBatch.from_arrays(columns, names=["_q", "_qvec", "score", "_cells", "_stripes", "_pairs"])

        return marked

    def _met(self, asked: DataFrame, k: int, key: str, report: list | None) -> DataFrame:
        """The k best rows of each stripe for the queries that read cells of it (``_cells`` has a bit for each cell), among those
        that reach the query's ``score``, if it has one.

        A task meets a part of a stripe's queries and a part of its rows, cell by cell.
        """
        each = asked.select("_q", "_qvec", "score", "_cells", F.explode(F.arrays_zip("_stripes", "_pairs")).alias("_s"))
        each = each.select("*", F.col("_s._stripes").alias("_stripe"), F.col("_s._pairs").alias("_compared")).drop("_s")
        metric, dims, stripes = self.metric, self.dims, self._stripes()
        per = max(1, TASK_BYTES // (4 * dims + 16))
        fit = max(1, min(per, HELD_RESULTS // k))
        sizes = each.groupBy("_stripe").agg(F.count("*").alias("_n"), F.sum("_compared").alias("_compared"))
        sizes = materialize(sizes, "cells-sizes")
        if report is not None:
            report.append(sizes.agg(F.sum("_compared")).first()[0] or 0)
        held = self.spark.createDataFrame(
            [(i, int(s), int(self.count[stripes == s].sum())) for i, s in enumerate(stripes)], "_cell int, _stripe int, _rows long"
        )
        dealt = F.least(F.lit(PARTS), F.ceil(F.col("_compared") / F.lit(TASK_PAIRS)))
        sizes = sizes.join(held.groupBy("_stripe").agg(F.max("_rows").alias("_rows")), "_stripe").select(
            "_stripe", F.greatest(F.ceil(F.col("_n") / fit), dealt).cast("long").alias("_bs"), F.ceil(F.col("_rows") / per).cast("long").alias("_cs")
        )

        def blocks(n: str):
            return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

        left = each.join(F.broadcast(sizes), "_stripe").select(
            F.col("_q").alias("_qid"), "_qvec", "score", "_cells", "_stripe", F.pmod(F.xxhash64("_q"), "_bs").alias("_b"), blocks("_cs").alias("_c")
        )
        rows = self.rows().select(F.col(key).alias("_cid"), F.col(self.vec).alias("_cvec"), "_cell")
        rows = rows.join(F.broadcast(held.select("_cell", "_stripe").join(sizes, "_stripe")), "_cell")
        right = rows.select("_cid", "_cvec", "_cell", "_stripe", F.pmod(F.xxhash64("_cid", "_cvec"), "_cs").alias("_c"), blocks("_bs").alias("_b"))

        def part(query_table, row_table):
            import numpy as np

            row_ids, found = row_table["_cid"], [nearest.NOTHING]
            if query_table.num_rows and row_table.num_rows:
                place, held = nearest.places(row_ids), nearest.Vectors(row_table["_cvec"], dims, metric)
                score = query_table["score"].fill_null(-np.inf).to_numpy()
                asking = nearest.Nearest(query_table["_qvec"], dims, k, metric, np.where(np.isnan(score), np.inf, score))
                reads, cell = _bits(query_table["_cells"]), row_table["_cell"].to_numpy()
                order = np.argsort(cell, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                    own = own[nearest.without_copies(held.given[own], place[own], k)]
                    at, bit = divmod(int(cell[own[0]]), 8)
                    readers = np.flatnonzero(reads[:, at] >> (7 - bit) & 1)
                    of, row, score = asking.add(held.take(own), place[own], readers)
                    found.append((of, own[row], score))
            of, row, score = [np.concatenate(x) for x in zip(*found)]
            # Later cells may have shown that what earlier ones gave is not wanted.
            kept = np.flatnonzero(~(score < asking.least[of])) if len(of) else of
            return nearest.found_table(query_table["_qid"], row_ids, (of[kept], row[kept], score[kept]))

        schema = f"_qid long, _cid {right.schema['_cid'].dataType.simpleString()}, score double"
        keys = ["_stripe", "_b", "_c"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(part, schema)


def write_vector_cells(
    df: DataFrame, vec: str, path: str, key: list[str], metric: str = "cosine", cells: int | None = None, sample: int = SAMPLE
) -> VectorCells:
    """Write an index of ``df`` to a new path. ``cells`` is the number of centroids, by default the root of the number of
    rows up to ``MAX_CELLS``. ``sample`` rows, chosen by a hash of the key, are fitted in the driver; all rows are indexed."""
    import numpy as np

    spark, metric = df.sparkSession, check_metric(metric)
    if path_exists(spark, path):
        raise KeyspanError(f"{path} exists")
    rows = df.where(F.col(vec).isNotNull())
    n = rows.count()
    drawn = rows.select(vec, F.xxhash64(*key).alias("_h")).orderBy("_h").limit(sample).select(vec).toArrow()
    if not drawn.num_rows:
        raise KeyspanError("an index needs at least one vector")
    dims = len(drawn.column(0)[0].as_py())
    points = _matrix(drawn.column(0), dims)
    square = F.aggregate(F.col(vec), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top = math.sqrt(rows.agg(F.max(square)).first()[0] or 0.0) if metric == "dot_product" else 0.0
    points = _space(points, metric, top)
    wanted = cells or min(MAX_CELLS, max(1, round(math.sqrt(n))))
    centroids = fit_centroids(points, max(1, min(wanted, MAX_CELLS)))

    def placed(batches):
        import pyarrow as pa

        for batch in batches:
            near, away = _closest(_space(_matrix(batch.column(vec), dims), metric, top), centroids)
            # A little longer, as distances are rounded.
            own = away * (1 + 1e-9) + 1e-7
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near.astype("int32")), pa.array(own)], names=[*batch.schema.names, "_cell", "_away"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _cell int, _away double"
    # A crowded cell is split over tasks and files.
    rows.mapInArrow(placed, schema).hint("rebalance", "_cell").write.partitionBy("_cell").parquet(f"{path}/rows")
    held = spark.read.parquet(f"{path}/rows").groupBy("_cell").agg(F.max("_away").alias("radius"), F.count("*").alias("rows"))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    joined = table.join(held, F.col("cell") == F.col("_cell"), "left")
    known = joined.select("cell", "centroid", F.coalesce("radius", F.lit(-1e300)).alias("radius"), F.coalesce("rows", F.lit(0)).alias("rows"))
    known = known.orderBy("cell").collect()
    spark.createDataFrame(known, "cell int, centroid array<double>, radius double, rows long").write.parquet(f"{path}/cells")
    needed = _needed(points, centroids)
    told = {"vec": vec, "key": list(key), "metric": metric, "dims": dims, "top": top, "needed": needed.tolist()}
    write_text(spark, f"{path}/_index.json", json.dumps(told))
    return VectorCells(spark, path)
