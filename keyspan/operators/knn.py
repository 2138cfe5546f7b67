"""Nearest neighbours: exact top-k, hybrid search, batch kNN join and a bucketed approximation.

A row is scored where it is read. Each task keeps only its best k, so what is shuffled is k rows
per task (per query), never the scores of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyspan.functions.vectors import check_metric, check_vector, score_against, score_name
from keyspan.model import KeyspanError
from keyspan.operators import nearest
from keyspan.operators.views import apply_predicates, lookup

# The limits of k, and the dimension above which projecting a vector is reported.
#: Results that a task of a batch join holds at most: queries times k.
HELD_RESULTS = 4_000_000
DEFAULT_K = 10
MAX_K = 10_000
LARGE_VECTOR = 256

# Query vectors are sent to every task up to this size; larger sets go through the grid join.
QUERY_BYTES = 32 * 1024 * 1024
CELL_BYTES = 64 * 1024 * 1024
# Vectors of each side that a task of the grid join holds, and the parts each side is dealt into at least.
TASK_BYTES = 32 * 1024 * 1024
PARTS = 8
# For more queries than this, scoring a row takes far longer than sending it, so rows are dealt out evenly.
MANY_QUERIES = 4096


def check_k(k: int | None) -> int:
    if k is None or k <= 0:
        return DEFAULT_K
    if k > MAX_K:
        raise KeyspanError(f"k must be at most {MAX_K}, got {k}")
    return k


def knn(
    df: DataFrame,
    vec: str,
    query,
    k: int = DEFAULT_K,
    metric: str = "cosine",
    key: list[str] = (),
    where: list[tuple] = (),
    scores: list[str] | None = None,
    select: list[str] | None = None,
    include_vector: bool = False,
    text_options: dict | None = None,
) -> DataFrame:
    """The ``k`` rows most similar to ``query`` among those that meet all predicates.

    Predicates run before the scoring. ``scores`` names the metrics to return as columns (default:
    the ranking one). Naming columns in ``select`` leaves the vector out unless ``include_vector``.
    ``key`` breaks ties.
    """
    k, metric = check_k(k), check_metric(metric)
    query = check_vector(query)
    shown = [check_metric(m) for m in (scores if scores is not None else [metric])]
    columns = list(select) if select else df.columns
    if select and include_vector and vec not in columns:
        columns.append(vec)
    found = apply_predicates(df, list(where), text_options).where(F.col(vec).isNotNull())
    extra = [m for m in shown if m != metric]
    carried = list(dict.fromkeys([*columns, *key, *([vec] if extra else [])]))
    ranked = found.select(*carried, score_against(vec, query, metric).alias("_score"))
    best = ranked.orderBy(F.desc("_score"), *key).limit(k)
    outputs = [F.col(c) for c in columns]
    for m in shown:
        value = F.col("_score") if m == metric else score_against(vec, query, m)
        outputs.append(value.alias(score_name(m)))
    return best.select(*outputs)


def knn_warnings(
    metric: str,
    scores: list[str],
    where: list[tuple] = (),
    indexed: list[str] | None = None,
    include_vector: bool = False,
    dimensions: int = 0,
    k: int = DEFAULT_K,
) -> list[str]:
    """What is questionable about a vector query, before it runs."""
    out = []
    for m in scores:
        if check_metric(m) != check_metric(metric):
            out.append(f"{score_name(m)} differs from the ranking metric {metric}: score and rank may disagree")
    for column, _, _ in where if indexed is not None else ():
        if column not in indexed:
            out.append(f"predicate column {column} is not indexed")
    if include_vector and dimensions > LARGE_VECTOR:
        out.append(f"projecting the vector returns {dimensions * check_k(k)} floats")
    return out


def similar_to_row(df: DataFrame, key: dict, vec: str, k: int = DEFAULT_K, metric: str = "cosine", **options) -> DataFrame:
    """Rows similar to the row named by its complete key."""
    rows = lookup(df, list(key), key).select(vec).limit(2).collect()
    if len(rows) != 1:
        raise KeyspanError(f"{len(rows) or 'no'} rows have the key {key}")
    return knn(df, vec, rows[0][0], k, metric, key=options.pop("tie", list(key)), **options)


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    vec: str,
    k: int,
    query_key: str,
    corpus_key: str,
    metric: str = "cosine",
    query_bytes: int = QUERY_BYTES,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """For every query row the ``k`` most similar corpus rows: query_key, corpus_key, score, rank.

    Up to ``query_bytes`` the query vectors travel to the tasks that scan the corpus, which is shuffled
    only to spread the work of many queries. A larger set is met part by part: both sides are dealt into
    parts that fit a task, which compares them by cells of at most ``cell_bytes``. Both ways keep k per
    query and task before the last ranking.
    """
    k, metric = check_k(k), check_metric(metric)
    spark = corpus.sparkSession
    first = queries.where(F.col(vec).isNotNull()).select(F.size(vec)).limit(1).collect()
    if not first:
        return _ranked(
            spark.createDataFrame([], _join_schema(queries, corpus, query_key, corpus_key)),
            query_key, corpus_key, k,
        )
    dims = first[0][0]
    # A task holds k results of each query it is asked, so their number is bounded as well.
    fit = max(1, min(query_bytes // (4 * dims + 16), HELD_RESULTS // k))
    asked = queries.where(F.col(vec).isNotNull()).select(
        F.col(query_key).alias("_qid"), F.col(vec).alias("_qvec")
    )
    rows = corpus.where(F.col(vec).isNotNull()).select(F.col(corpus_key).alias("_cid"), F.col(vec).alias("_cvec"))
    schema = _join_schema(queries, corpus, query_key, corpus_key)
    # Reads at most one row more than fits, so a large query set never reaches the driver.
    held = asked.limit(fit + 1).toArrow()
    if held.num_rows <= fit:
        if held.num_rows > MANY_QUERIES:
            rows = rows.repartition(max(PARTS, 2 * spark.sparkContext.defaultParallelism))
        local = _best_per_batch(held, k, metric, dims)
        part = rows.mapInArrow(local, schema)
    else:
        part = _grid(asked, rows, k, metric, dims, cell_bytes, schema)
    return _ranked(part, query_key, corpus_key, k)


def _join_schema(queries: DataFrame, corpus: DataFrame, query_key: str, corpus_key: str) -> str:
    q, c = queries.schema[query_key].dataType.simpleString(), corpus.schema[corpus_key].dataType.simpleString()
    return f"_qid {q}, _cid {c}, score double"


def _ranked(part: DataFrame, query_key: str, corpus_key: str, k: int) -> DataFrame:
    window = Window.partitionBy("_qid").orderBy(F.desc("score"), "_cid")
    ranked = part.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    out_key = corpus_key if corpus_key != query_key else f"neighbor_{corpus_key}"
    return ranked.select(F.col("_qid").alias(query_key), F.col("_cid").alias(out_key), "score", "rank")


def _grid(asked: DataFrame, rows: DataFrame, k: int, metric: str, dims: int, cell_bytes: int, schema: str) -> DataFrame:
    """Both sides are dealt into ``PARTS`` parts, or more where these would not fit a task. A task meets one part of each, cell
    by cell of at most ``cell_bytes`` of vectors; so a row is sent ``PARTS`` times, however small the cells are."""
    per_cell, per_task = max(1, cell_bytes // (4 * dims + 16)), max(1, TASK_BYTES // (4 * dims + 16))
    blocks = max(PARTS, -(-asked.count() // max(1, min(per_task, HELD_RESULTS // k))))
    chunks = max(PARTS, -(-rows.count() // per_task))
    left = asked.withColumn("_b", F.pmod(F.xxhash64("_qid", "_qvec"), F.lit(blocks))).withColumn(
        "_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint")))
    )
    right = rows.withColumn("_c", F.pmod(F.xxhash64("_cid", "_cvec"), F.lit(chunks))).withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    )

    def part(query_table, row_table):
        row_ids, found = row_table["_cid"], nearest.NOTHING
        if query_table.num_rows and row_table.num_rows:
            place, held = nearest.places(row_ids), nearest.Vectors(row_table["_cvec"], dims, metric)
            kept = nearest.without_copies(held.given, place, k)
            row_ids = row_ids.take(kept)
            found = nearest.Nearest(query_table["_qvec"], dims, k, metric, block=per_cell).add(held.take(kept), place[kept])
        return nearest.found_table(query_table["_qid"], row_ids, found)

    return left.groupBy("_b", "_c").cogroup(right.groupBy("_b", "_c")).applyInArrow(part, schema)


def _best_per_batch(held, k: int, metric: str, dims: int):
    """Scorer of corpus batches against a table of queries that keeps the best ``k`` per query."""

    def run(batches):
        if not held.num_rows:
            return
        asking = nearest.Nearest(held["_qvec"], dims, k, metric)
        for table in nearest.tables(batches):
            rows, place = nearest.Vectors(table["_cvec"], dims, metric), nearest.places(table["_cid"])
            yield from nearest.found_batches(held["_qid"], table["_cid"], asking.add(rows, place))

    return run


# --- approximate search -----------------------------------------------------------------------


def plane_signs(dims: int, tables: int, bits: int) -> list[list[int]]:
    """Signs of the hyperplanes, ``tables * bits`` rows of ``dims`` entries, from a fixed rule.

    Plane m, element i: +1 if ``((i+1)*(m+1)*7919 + (i+1)^2*104729 + (m+1)^2*31*(i+3)) mod 65521``
    is odd, else -1. A rule instead of a seed lets another engine build the same index.
    """
    return [
        [
            1 if (((i + 1) * (m + 1) * 7919 + (i + 1) ** 2 * 104729 + (m + 1) ** 2 * 31 * (i + 3)) % 65521) % 2 else -1
            for i in range(dims)
        ]
        for m in range(tables * bits)
    ]


def vector_buckets(vec: Column | str, dims: int, tables: int, bits: int) -> Column:
    """Bucket numbers of a vector, one per table: the signs of its products with the planes."""
    signs = plane_signs(dims, tables, bits)

    @F.arrow_udf("array<int>")
    def buckets(vectors):
        import numpy as np
        import pyarrow as pa

        planes = np.array(signs, dtype="float64").T
        held = vectors.drop_null()
        m = held.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(held), dims)
        sides = (m @ planes > 0).astype("int64").reshape(len(held), tables, bits)
        numbers = sides @ (1 << np.arange(bits))
        known = vectors.is_valid().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(known * tables)]).astype("int32")
        return pa.ListArray.from_arrays(
            pa.array(ends), pa.array(numbers.reshape(-1).astype("int32")), mask=pa.array(~known)
        )

    return buckets(vec)


def build_ann_index(df: DataFrame, vec: str, dims: int, tables: int = 8, bits: int = 6) -> DataFrame:
    """The table with one bucket column per hash table (``bucket_0`` ..). A search of it reads every row's bucket
    numbers, as a row may match in any table; ``write_ann_index`` makes one that a search reads in part."""
    hashed = df.withColumn("_buckets", vector_buckets(vec, dims, tables, bits))
    return hashed.withColumns({f"bucket_{t}": F.col("_buckets")[t] for t in range(tables)}).drop("_buckets")


def ann(
    index: DataFrame,
    vec: str,
    query,
    k: int = DEFAULT_K,
    tables: int = 8,
    bits: int = 6,
    metric: str = "cosine",
    key: list[str] = (),
    probes: int = 0,
    where: list[tuple] = (),
) -> DataFrame:
    """Approximate top-k: rows that share a bucket with the query in any table, ranked exactly.

    ``probes`` also visits buckets that differ in up to that many bits. No candidate is dropped: a
    crowded bucket is scanned by many tasks like any filter result.
    """
    query = check_vector(query)
    hit = F.lit(False)
    for t, visited in enumerate(_visited(query, tables, bits, probes)):
        hit = hit | F.col(f"bucket_{t}").isin(visited)
    columns = [c for c in index.columns if not c.startswith("bucket_")]
    return knn(index.where(hit), vec, query, k, metric, key=key, where=where, select=None).select(
        *columns, score_name(metric)
    )


def write_ann_index(df: DataFrame, vec: str, dims: int, path: str, tables: int = 8, bits: int = 6) -> None:
    """An index in folders ``_table=t/_bucket=b``: each row once per hash table, so a search reads the folders it visits only.

    It takes ``tables`` times the space of the rows. A bucket with very many rows is split over tasks and files.
    """
    numbers = vector_buckets(vec, dims, tables, bits)
    spread = df.where(F.col(vec).isNotNull()).select("*", F.posexplode(numbers).alias("_table", "_bucket"))
    spread.hint("rebalance", "_table", "_bucket").write.partitionBy("_table", "_bucket").parquet(path)


def ann_stored(
    spark: SparkSession, path: str, vec: str, query, k: int = DEFAULT_K, tables: int = 8, bits: int = 6,
    metric: str = "cosine", key: list[str] = (), probes: int = 0, where: list[tuple] = (),
) -> DataFrame:
    """``ann`` over a written index: only the folders of the visited buckets are read. ``key`` names a row, which may
    be found in several tables."""
    if not key:
        raise KeyspanError("a stored index needs the key of its rows")
    query = check_vector(query)
    hit = F.lit(False)
    for table, visited in enumerate(_visited(query, tables, bits, probes)):
        hit = hit | ((F.col("_table") == table) & F.col("_bucket").isin(visited))
    found = spark.read.parquet(path).where(hit).drop("_table", "_bucket").dropDuplicates(list(key))
    return knn(found, vec, query, k, metric, key=key, where=where, select=None)


def _visited(query, tables: int, bits: int, probes: int) -> list[list[int]]:
    """The buckets of each table that a query looks into."""
    sides = [1 if sum(s * x for s, x in zip(row, query)) > 0 else 0 for row in plane_signs(len(query), tables, bits)]
    own = [sum(side << b for b, side in enumerate(sides[t * bits : (t + 1) * bits])) for t in range(tables)]
    return [[n for n in range(1 << bits) if bin(n ^ number).count("1") <= probes] for number in own]


def ann_recall(exact: DataFrame, approximate: DataFrame, key: list[str]) -> DataFrame:
    """Share of the exact neighbours that the approximation found. Both sides are top-k results."""
    found = exact.select(*key).join(approximate.select(*key), key, "left_semi")
    total = exact.select(F.count(F.lit(1))).scalar()
    return found.agg(F.count(F.lit(1)).alias("found")).select(
        "found", total.alias("expected"), (F.col("found") / total).alias("recall")
    )
