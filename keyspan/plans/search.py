"""Filters, views, paging and vector search."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from keyspan.functions import vectors
from keyspan.operators import knn as nn
from keyspan.operators import vector_cells, views
from keyspan.plans.registry import query
from keyspan.session import work_path

DIMS = 64
# The search vector of the top-k queries is that of row 0, looked up by its key.
Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
D = "::DOUBLE[]"
COSINE = f"(1 + list_cosine_similarity(embedding{D}, {Q}{D})) / 2"
DOT = f"(1 + list_inner_product(embedding{D}, {Q}{D})) / 2"
EUCLID = f"1 / (1 + list_distance(embedding{D}, {Q}{D}) ** 2)"


def _row_vector(t, vec_id: int = 0) -> list[float]:
    return views.lookup(t.embeddings, ["vec_id"], {"vec_id": vec_id}).select("embedding").first()[0]


@query(
    "predicates",
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_totalprice >= 100000 AND o_totalprice < 300000 AND o_orderstatus = 'F' AND o_custkey > 100
      AND o_orderdate <= TIMESTAMP '1999-06-30'
    """,
)
def predicates(t):
    found = views.apply_predicates(
        t.orders,
        [("o_totalprice", ">=", 100000.0), ("o_totalprice", "<", 300000.0), ("o_orderstatus", "=", "F"),
         ("o_custkey", ">", 100), ("o_orderdate", "<=", dt.datetime(1999, 6, 30))],
    )
    return views.project(found, ["o_orderkey", "o_custkey", "o_totalprice"])


@query(
    "predicates_in",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_totalprice > 200000",
)
def predicates_in(t):
    found = views.apply_predicates(
        t.orders, [("o_orderpriority", "IN", ["1-URGENT", "5-LOW"]), ("o_totalprice", ">", 200000.0)]
    )
    return found.select("o_orderkey", "o_orderpriority")


@query(
    "predicates_long_list",
    "SELECT event_id, user_id FROM events WHERE value IN (SELECT range::DOUBLE / 100 FROM range(12000))",
)
def predicates_long_list(t):
    # Every amount in cents up to 120, too many for a plain filter; every hundredth is a whole number.
    listed = [cents // 100 if cents % 100 == 0 else cents / 100 for cents in range(12000)]
    found = views.apply_predicates(t.events, [("value", "IN", listed)])
    return found.select("event_id", "user_id")


@query(
    "contains_value",
    "SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')",
)
def contains_value(t):
    parts = t.part.withColumn("words", F.split("p_name", " "))
    return views.apply_predicates(parts, [("words", "CONTAINS", "ring")]).select("p_partkey", "p_name")


@query(
    "contains_map",
    """
    SELECT event_id FROM events
    WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) = 69 AND json_extract_string(props, '$.k') IS NOT NULL
    """,
)
def contains_map(t):
    held = t.events.withColumn("m", F.from_json("props", "map<string,int>"))
    return views.apply_predicates(held, [("m", "CONTAINS", 69), ("m", "CONTAINS KEY", "k")]).select("event_id")


@query(
    "contains_word",
    r"""
    SELECT doc_id, lang FROM documents
    WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+'), 'the')
    """,
)
def contains_word(t):
    return views.apply_predicates(t.documents, [("text", ":", "The")]).select("doc_id", "lang")


@query(
    "contains_word_folded",
    r"""
    SELECT doc_id FROM documents
    WHERE list_contains(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{M}\p{N}_]+'), 'etion')
    """,
)
def contains_word_folded(t):
    return views.apply_predicates(t.documents, [("text", ":", "Étion")], {"ascii": True}).select("doc_id")


@query("like_match", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%00_7%'")
def like_match(t):
    return views.apply_predicates(t.customer, [("c_name", "LIKE", "%00_7%")]).select("c_custkey", "c_name")


@query(
    "lookup_keys",
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE (o_custkey, o_orderkey) IN (SELECT s_suppkey, l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
    """,
)
def lookup_keys(t):
    wanted = t.lineitem.select(F.col("l_suppkey").alias("o_custkey"), F.col("l_orderkey").alias("o_orderkey"))
    found = views.lookup(t.orders, ["o_custkey", "o_orderkey"], wanted)
    return found.select("o_orderkey", "o_custkey", "o_totalprice")


@query("lookup_row", "SELECT * FROM conversations WHERE conv_id = 7 AND turn = 1")
def lookup_row(t):
    return views.lookup(t.conversations, ["conv_id", "turn"], {"conv_id": 7, "turn": 1})


@query(
    "search_all",
    r"""
    SELECT c_custkey, c_name, c_mktsegment FROM customer
    WHERE lower(c_custkey::VARCHAR) LIKE '%18%' OR lower(c_name) LIKE '%18%' OR lower(c_nationkey::VARCHAR) LIKE '%18%'
       OR regexp_replace(c_acctbal::VARCHAR, '\.0$', '') LIKE '%18%' OR lower(c_mktsegment) LIKE '%18%'
    """,
)
def search_all(t):
    return views.search(t.customer, " 18 ").select("c_custkey", "c_name", "c_mktsegment")


@query(
    "filter_columns",
    r"""
    SELECT c_custkey FROM customer WHERE lower(c_mktsegment) LIKE '%build%'
      AND regexp_replace(c_acctbal::VARCHAR, '\.0$', '') LIKE '%7%'
    """,
)
def filter_columns(t):
    return views.filter_columns(t.customer, {"c_mktsegment": " Build", "c_acctbal": "7", "c_name": " "}).select("c_custkey")


@query(
    "sorted_first_rows",
    "SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal DESC NULLS FIRST, s_suppkey) AS place FROM supplier",
)
def sorted_first_rows(t):
    return views.sorted_places(t.supplier, "s_acctbal", "desc", tie=["s_suppkey"]).select("s_suppkey", "s_acctbal", "place")


@query(
    "natural_sort",
    r"""
    SELECT p_partkey, p_brand, row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '#(\d+)', 1) AS INTEGER), p_partkey) AS place
    FROM part
    """,
)
def natural_sort(t):
    return views.sorted_places(t.part, "p_brand", "asc", tie=["p_partkey"]).select("p_partkey", "p_brand", "place")


@query(
    "sort_number_text",
    """
    SELECT c_custkey, row_number() OVER (ORDER BY CAST(c_acctbal * 100 - 300000 AS BIGINT) DESC, c_custkey) AS place FROM customer
    """,
)
def sort_number_text(t):
    # A decimal with up to 41 digits and a sign, kept as text; every third one is written with an exponent.
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint") - 300000
    text = F.concat(cents.cast("string"), F.lit("000000000000000000000000000000000.50"))
    short = F.concat(cents.cast("string"), F.lit(".0000000000000000000000000000000005E+33"))
    written = F.when(F.col("c_custkey") % 3 == 0, short).otherwise(text)
    shown = t.customer.withColumn("big", F.when(cents == 0, F.lit("5e-1")).otherwise(written))
    return views.sorted_places(shown, "big", "desc", numeric_text=True, tie=["c_custkey"]).select("c_custkey", "place")


@query(
    "per_partition_limit",
    """
    SELECT user_id, event_id, ts FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3
    """,
)
def per_partition_limit(t):
    kept = views.per_partition_limit(t.events, ["user_id"], ["ts desc", "event_id desc"], 3)
    return kept.select("user_id", "event_id", "ts")


@query(
    "per_partition_limit_large",
    """
    SELECT l_linestatus, l_orderkey, l_partkey, l_suppkey FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) <= 2500
    """,
)
def per_partition_limit_large(t):
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    kept = views.per_partition_limit(t.lineitem, ["l_linestatus"], order, 2500)
    return kept.select("l_linestatus", "l_orderkey", "l_partkey", "l_suppkey")


@query(
    "page_numbers",
    """
    SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 500 + 1)::BIGINT AS page
    FROM orders
    """,
)
def page_numbers(t):
    return views.paginate(t.orders, ["o_orderdate", "o_orderkey"], 500).select("o_orderkey", "page")


@query("page_3", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500 OFFSET 1000")
def page_3(t):
    return views.Pages(t.orders, ["o_orderdate", "o_orderkey"], 500).page(3)


@query(
    "one_page",
    """
    SELECT l_returnflag, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    ORDER BY l_returnflag DESC, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 500 OFFSET 2500
    """,
)
def one_page(t):
    # Three values fill the first column, so the page is found by the second and the third one.
    order = ["l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    named = t.lineitem.select(*order)
    return views.one_page(named, ["l_returnflag desc", *order[1:]], 6, 500, enough=2000)


@query(
    "page_backwards",
    "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 100 OFFSET 300",
)
def page_backwards(t):
    pages = views.Pages(t.events, ["ts desc", "event_id"], 100)
    pages.page(5)
    return pages.page(4).select("event_id", "user_id")


@query(
    "cluster_sort",
    """
    SELECT user_id, ts, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS before FROM events
    """,
)
def cluster_sort(t):
    # The row before each one, as it lies in the files: the order itself is compared.
    path = work_path(t.spark, "clustered")
    views.cluster_sort(t.events, ["user_id"], ["ts desc", "event_id"]).write.parquet(path)
    stored = t.spark.read.parquet(path).select("*", "_metadata.file_name", "_metadata.row_index")
    lies = views.Window.partitionBy("user_id").orderBy("file_name", "row_index")
    return stored.select("user_id", "ts", "event_id", F.lag("event_id").over(lies).alias("before"))


@query(
    "result_view",
    """
    SELECT c_custkey, c_name, c_mktsegment FROM customer
    WHERE (c_custkey::VARCHAR LIKE '%1%' OR c_name LIKE '%1%' OR c_nationkey::VARCHAR LIKE '%1%'
           OR lower(c_mktsegment) LIKE '%1%' OR regexp_replace(c_acctbal::VARCHAR, '[.]0$', '') LIKE '%1%')
      AND lower(c_mktsegment) LIKE '%mach%'
    """,
)
def result_view(t):
    shown = views.result_view(t.customer, "1", {"c_mktsegment": "mach"}, ("c_name", "desc"), tie=["c_custkey"])
    return shown.select("c_custkey", "c_name", "c_mktsegment")


# --- vectors --------------------------------------------------------------------------------------


@query(
    "cosine_scores",
    f"SELECT vec_id, round({COSINE}, 6) AS cosine_score FROM embeddings",
)
def cosine_scores(t):
    score = vectors.score_against("embedding", _row_vector(t), "cosine")
    return t.embeddings.select("vec_id", F.round(score, 6).alias("cosine_score"))


@query(
    "compare_vectors",
    f"""
    SELECT a.vec_id,
           round((1 + list_cosine_similarity(a.embedding{D}, b.embedding{D})) / 2, 6) AS cosine_score,
           round((1 + list_inner_product(a.embedding{D}, b.embedding{D})) / 2, 6) AS dot_product_score,
           round(1 / (1 + list_distance(a.embedding{D}, b.embedding{D}) ** 2), 6) AS euclidean_score,
           round(sqrt(list_inner_product(a.embedding{D}, a.embedding{D})), 6) AS left_magnitude,
           round(sqrt(list_inner_product(b.embedding{D}, b.embedding{D})), 6) AS right_magnitude
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
    """,
)
def compare_vectors(t):
    left = t.embeddings.select("vec_id", F.col("embedding").alias("left"))
    right = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("right"))
    made = vectors.compare_vectors(left.join(right, "vec_id"), "left", "right")
    names = ["cosine_score", "dot_product_score", "euclidean_score", "left_magnitude", "right_magnitude"]
    return made.select("vec_id", *[F.round(n, 6).alias(n) for n in names])


@query(
    "vector_profile",
    f"""
    SELECT vec_id, len(embedding)::INTEGER AS dimensions,
           round(sqrt(list_inner_product(embedding{D}, embedding{D})), 6) AS magnitude,
           0::INTEGER AS null_elements, false AS is_zero
    FROM embeddings
    """,
)
def vector_profile(t):
    made = vectors.vector_profile(t.embeddings, "embedding", ["vec_id"])
    return made.withColumn("magnitude", F.round("magnitude", 6))


@query(
    "vector_table_profile",
    f"""
    SELECT count(*) AS rows, 0::BIGINT AS missing, min(len(embedding))::INTEGER AS min_dimensions,
           max(len(embedding))::INTEGER AS max_dimensions, 0::BIGINT AS with_nulls, 0::BIGINT AS zero_vectors,
           round(min(sqrt(list_inner_product(embedding{D}, embedding{D}))), 6) AS min_magnitude,
           round(max(sqrt(list_inner_product(embedding{D}, embedding{D}))), 6) AS max_magnitude
    FROM embeddings
    """,
)
def vector_table_profile(t):
    made = vectors.vector_table_profile(t.embeddings, "embedding")
    return made.withColumns({c: F.round(c, 6) for c in ("min_magnitude", "max_magnitude")})


@query(
    "downsample_vectors",
    """
    SELECT vec_id, CAST(to_json(list_transform(range(16),
        lambda i: round(embedding[least(len(embedding) - 1, (i * len(embedding) + len(embedding) // 2) // 16) + 1]::DOUBLE * 1e6)::BIGINT))
        AS VARCHAR) AS sampled
    FROM embeddings
    """,
)
def downsample_vectors(t):
    sampled = F.transform(vectors.downsample(F.col("embedding"), 16), lambda x: F.round(x.cast("double") * 1e6).cast("bigint"))
    return t.embeddings.select("vec_id", F.to_json(sampled).alias("sampled"))


@query(
    "parse_vector_text",
    """
    SELECT vec_id, label, len(embedding)::INTEGER AS dimensions,
           CASE WHEN label = 3 THEN 'element 65 is not a finite number: x'
                WHEN label = 4 THEN '65 elements instead of 64' END AS vector_error,
           label NOT IN (3, 4) AS same
    FROM embeddings
    """,
)
def parse_vector_text(t):
    text = vectors.vector_text(F.col("embedding"))
    broken = (
        F.when(F.col("label") == 3, F.replace(text, F.lit("]"), F.lit(", x]")))
        .when(F.col("label") == 4, F.replace(text, F.lit("]"), F.lit(" 1.5")))
        .when(F.col("label") == 5, F.regexp_replace(text, r"[\[,\]]", " "))
        .otherwise(text)
    )
    parsed = vectors.parse_vectors(t.embeddings.withColumn("text", broken), "text", DIMS)
    same = F.coalesce(F.col("vector") == F.col("embedding"), F.lit(False))
    return parsed.select(
        "vec_id", "label", F.size("embedding").alias("dimensions"), "vector_error", same.alias("same")
    )


@query(
    "knn_10",
    f"SELECT vec_id, label, round({COSINE}, 6) AS cosine_score FROM embeddings ORDER BY {COSINE} DESC, vec_id LIMIT 10",
)
def knn_10(t):
    found = nn.knn(t.embeddings, "embedding", _row_vector(t), 10, key=["vec_id"], select=["vec_id", "label"])
    return found.withColumn("cosine_score", F.round("cosine_score", 6))


@query(
    "knn_all_scores",
    f"""
    SELECT vec_id, round({DOT}, 6) AS dot_product_score, round({COSINE}, 6) AS cosine_score,
           round({EUCLID}, 6) AS euclidean_score
    FROM embeddings ORDER BY {EUCLID} DESC, vec_id LIMIT 25
    """,
)
def knn_all_scores(t):
    found = nn.knn(
        t.embeddings, "embedding", _row_vector(t), 25, "euclidean", key=["vec_id"],
        scores=["dot_product", "cosine", "euclidean"], select=["vec_id"],
    )
    return found.select("vec_id", *[F.round(c, 6).alias(c) for c in found.columns if c != "vec_id"])


@query(
    "knn_dot_product",
    f"SELECT vec_id, round({DOT}, 6) AS dot_product_score FROM embeddings ORDER BY {DOT} DESC, vec_id LIMIT 10",
)
def knn_dot_product(t):
    found = nn.knn(t.embeddings, "embedding", _row_vector(t), 0, "dot_product", key=["vec_id"], select=["vec_id"])
    return found.withColumn("dot_product_score", F.round("dot_product_score", 6))


@query(
    "hybrid_knn",
    f"""
    SELECT vec_id, label, round({COSINE}, 6) AS cosine_score FROM embeddings
    WHERE label IN (1, 2, 7) AND label <= 5 ORDER BY {COSINE} DESC, vec_id LIMIT 10
    """,
)
def hybrid_knn(t):
    found = nn.knn(
        t.embeddings, "embedding", _row_vector(t), 10, key=["vec_id"], select=["vec_id", "label"],
        where=[("label", "IN", [1, 2, 7]), ("label", "<=", 5)],
    )
    return found.withColumn("cosine_score", F.round("cosine_score", 6))


@query(
    "similar_to_row",
    f"""
    WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 17)
    SELECT vec_id, round((1 + list_cosine_similarity(embedding{D}, e{D})) / 2, 6) AS cosine_score
    FROM embeddings, q ORDER BY (1 + list_cosine_similarity(embedding{D}, e{D})) / 2 DESC, vec_id LIMIT 12
    """,
)
def similar_to_row(t):
    found = nn.similar_to_row(t.embeddings, {"vec_id": 17}, "embedding", 12, select=["vec_id"])
    return found.withColumn("cosine_score", F.round("cosine_score", 6))


JOIN_SQL = f"""
    WITH s AS (SELECT a.vec_id, b.vec_id AS neighbor_vec_id,
                      (1 + list_cosine_similarity(a.embedding{D}, b.embedding{D})) / 2 AS score
               FROM embeddings a, embeddings b)
    SELECT vec_id, neighbor_vec_id, round(score, 6) AS score,
           row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_vec_id)::INTEGER AS rank
    FROM s QUALIFY rank <= 5
"""


@query("knn_join_5", JOIN_SQL)
def knn_join_5(t):
    made = nn.knn_join(t.embeddings, t.embeddings, "embedding", 5, "vec_id", "vec_id")
    return made.withColumn("score", F.round("score", 6))


@query("knn_join_grid", JOIN_SQL)
def knn_join_grid(t):
    # Limits small enough that the tables of every scale take the block-by-block way.
    made = nn.knn_join(
        t.embeddings, t.embeddings, "embedding", 5, "vec_id", "vec_id", query_bytes=16_000, cell_bytes=64_000
    )
    return made.withColumn("score", F.round("score", 6))


_SIGN = "CASE WHEN ((i+1)*(m+1)*7919 + (i+1)*(i+1)*104729 + (m+1)*(m+1)*31*(i+3)) % 65521 % 2 = 1 THEN 1.0 ELSE -1.0 END"
ANN_TABLES, ANN_BITS = 6, 5
_PLANES = f"""
    planes AS (SELECT m, list({_SIGN} ORDER BY i) AS p
               FROM (SELECT range AS m FROM range({ANN_TABLES * ANN_BITS})), (SELECT range AS i FROM range({DIMS})) GROUP BY m),
    sides AS (SELECT vec_id, m // {ANN_BITS} AS tab, m % {ANN_BITS} AS b,
                     CASE WHEN list_inner_product(embedding{D}, p{D}) > 0 THEN 1 ELSE 0 END AS side
              FROM embeddings, planes),
    buckets AS (SELECT vec_id, tab, sum(side * (1 << b))::INTEGER AS bucket FROM sides GROUP BY 1, 2)
"""
_CANDIDATES = """
    hits AS (SELECT DISTINCT c.vec_id FROM buckets c JOIN buckets q ON c.tab = q.tab AND c.bucket = q.bucket
             WHERE q.vec_id = 0)
"""


@query(
    "ann_buckets",
    f"""
    WITH {_PLANES}
    SELECT vec_id, tab::INTEGER AS tab, bucket FROM buckets
    """,
)
def ann_buckets(t):
    index = nn.build_ann_index(t.embeddings, "embedding", DIMS, ANN_TABLES, ANN_BITS)
    numbers = F.array(*[F.col(f"bucket_{i}") for i in range(ANN_TABLES)])
    return index.select("vec_id", F.posexplode(numbers).alias("tab", "bucket"))


@query(
    "ann_10",
    f"""
    WITH {_PLANES}, {_CANDIDATES}
    SELECT vec_id, round({COSINE}, 6) AS cosine_score FROM embeddings WHERE vec_id IN (SELECT vec_id FROM hits)
    ORDER BY {COSINE} DESC, vec_id LIMIT 10
    """,
)
def ann_10(t):
    index = nn.build_ann_index(t.embeddings, "embedding", DIMS, ANN_TABLES, ANN_BITS)
    found = nn.ann(index, "embedding", _row_vector(t), 10, ANN_TABLES, ANN_BITS, key=["vec_id"])
    return found.select("vec_id", F.round("cosine_score", 6).alias("cosine_score"))


@query(
    "ann_stored_10",
    f"""
    WITH {_PLANES}, {_CANDIDATES}
    SELECT vec_id, round({COSINE}, 6) AS cosine_score FROM embeddings WHERE vec_id IN (SELECT vec_id FROM hits)
    ORDER BY {COSINE} DESC, vec_id LIMIT 10
    """,
)
def ann_stored_10(t):
    path = work_path(t.spark, "ann")
    nn.write_ann_index(t.embeddings, "embedding", DIMS, path, ANN_TABLES, ANN_BITS)
    found = nn.ann_stored(t.spark, path, "embedding", _row_vector(t), 10, ANN_TABLES, ANN_BITS, key=["vec_id"])
    return found.select("vec_id", F.round("cosine_score", 6).alias("cosine_score"))


@query(
    "ann_recall",
    f"""
    WITH {_PLANES}, {_CANDIDATES},
    exact AS (SELECT vec_id FROM embeddings ORDER BY {COSINE} DESC, vec_id LIMIT 10),
    near AS (SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT vec_id FROM hits)
             ORDER BY {COSINE} DESC, vec_id LIMIT 10)
    SELECT count(*) AS found, 10::BIGINT AS expected, count(*) / 10.0::DOUBLE AS recall
    FROM exact WHERE vec_id IN (SELECT vec_id FROM near)
    """,
)
def ann_recall(t):
    index = nn.build_ann_index(t.embeddings, "embedding", DIMS, ANN_TABLES, ANN_BITS)
    vector = _row_vector(t)
    near = nn.ann(index, "embedding", vector, 10, ANN_TABLES, ANN_BITS, key=["vec_id"])
    exact = nn.knn(t.embeddings, "embedding", vector, 10, key=["vec_id"])
    return nn.ann_recall(exact, near, ["vec_id"])


def _cells(t, metric: str = "cosine"):
    return vector_cells.write_vector_cells(t.embeddings, "embedding", work_path(t.spark, "cells"), ["vec_id"], metric)


@query(
    "vector_cells_knn_10",
    f"SELECT vec_id, round({COSINE}, 6) AS cosine_score FROM embeddings ORDER BY {COSINE} DESC, vec_id LIMIT 10",
)
def vector_cells_knn_10(t):
    found = _cells(t).knn(_row_vector(t), 10, select=["vec_id"])
    return found.withColumn("cosine_score", F.round("cosine_score", 6))


@query("vector_cells_join_5", JOIN_SQL)
def vector_cells_join_5(t):
    return _cells(t).knn_join(t.embeddings, "embedding", 5, "vec_id").withColumn("score", F.round("score", 6))


@query(
    "vector_cells_recall",
    """
    SELECT count(*) AS queries, 10 * count(*) AS expected, true AS recall_reached, true AS read_in_part
    FROM embeddings WHERE vec_id % 20 = 0
    """,
)
def vector_cells_recall(t):
    """Recall at 0.9 over every row whose id 20 divides, against the exact join; a search reads a part of the cells."""
    asked = t.embeddings.where("vec_id % 20 = 0").select("vec_id", "embedding")
    index = _cells(t)
    near = index.knn_join(asked, "embedding", 10, "vec_id", recall=0.9)
    exact = nn.knn_join(asked, t.embeddings, "embedding", 10, "vec_id", "vec_id")
    told = nn.ann_recall(exact, near, ["vec_id", "neighbor_vec_id"])
    part = index.probes(0.9) < len(index.count)
    return told.select(
        F.lit(asked.count()).cast("long").alias("queries"), "expected", (F.col("recall") >= 0.9).alias("recall_reached"),
        F.lit(part).alias("read_in_part"),
    )


@query(
    "in_list_of_dates",
    """
    SELECT o_orderkey, o_orderdate::DATE AS day FROM orders
    WHERE o_orderdate::DATE IN (SELECT DATE '1970-01-01' + (3 * range)::INTEGER FROM range(12000))
    """,
)
def in_list_of_dates(t):
    listed = [str(dt.date(1970, 1, 1) + dt.timedelta(days=3 * i)) for i in range(12_000)]
    days = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return views.apply_predicates(days, [("day", "IN", listed)])


@query(
    "in_list_of_decimals",
    """
    SELECT o_orderkey FROM orders
    WHERE round(o_totalprice)::DECIMAL(12, 1) IN (SELECT (7 * range)::DECIMAL(12, 1) FROM range(80000))
    """,
)
def in_list_of_decimals(t):
    rounded = t.orders.withColumn("price", F.round("o_totalprice").cast("decimal(12,1)"))
    listed = [7 * i if i % 2 else 7.0 * i for i in range(80_000)] + [0.25, "no number", None]
    return views.apply_predicates(rounded, [("price", "IN", listed)]).select("o_orderkey")
