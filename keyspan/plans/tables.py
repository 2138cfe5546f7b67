"""Table-level jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyspan.model import TableSpec
from keyspan.operators import tables
from keyspan.plans.registry import query
from keyspan.session import work_path


@query("duplicate_table", "SELECT * FROM orders WHERE o_orderdate > DATE '1997-01-01'")
def duplicate_table(t):
    return tables.duplicate_table(
        t.spark, f"{t.directory}/orders.parquet", work_path(t.spark, "copy"), where="o_orderdate > date'1997-01-01'"
    )


@query(
    "copy_tables",
    """
    SELECT 'orders' AS "table", count(*) AS rows_read, count(*) AS rows_copied, NULL::VARCHAR AS warning FROM orders
    UNION ALL SELECT 'customer', count(*), count(*), NULL FROM customer
    UNION ALL SELECT 'part', count(*), count(*), NULL FROM part
    """,
)
def copy_tables(t):
    return tables.copy_tables(
        t.spark, t.directory, work_path(t.spark, "copies"), ["orders", "customer", "part"],
        verify_keys={"orders": ["o_orderkey"]},
    )


@query(
    "copy_tables_twice",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0 END AS o_totalprice FROM orders",
)
def copy_tables_twice(t):
    # The copy holds other prices first; a second copy of half the table replaces the rows with its keys.
    source, place = work_path(t.spark, "source"), work_path(t.spark, "copies")
    prices = t.orders.select("o_orderkey", "o_totalprice")
    tables.replace_table(prices.withColumn("o_totalprice", F.lit(0.0)), f"{place}/orders")
    prices.where("o_orderkey % 2 = 0").write.parquet(f"{source}/orders")
    tables.copy_tables(t.spark, source, place, ["orders"], keys={"orders": ["o_orderkey"]})
    return t.spark.read.parquet(f"{place}/orders")


@query(
    "truncate_table",
    "SELECT count(*) AS rows_before, 0::BIGINT AS rows_after, 's_suppkey, s_name, s_nationkey, s_acctbal' AS columns FROM supplier",
)
def truncate_table(t):
    place = work_path(t.spark, "table")
    tables.replace_table(t.supplier, place)
    before = t.spark.read.parquet(place).count()
    after = tables.truncate_table(t.spark, place)
    return after.agg(F.count(F.lit(1)).alias("rows_after")).select(
        F.lit(before).cast("bigint").alias("rows_before"), "rows_after", F.lit(", ".join(after.columns)).alias("columns")
    )


@query("replace_table", "SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders")
def replace_table(t):
    place = work_path(t.spark, "table")
    tables.replace_table(t.orders.select("o_orderkey", "o_totalprice"), place)
    doubled = t.spark.read.parquet(place).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    tables.replace_table(doubled, place)
    return t.spark.read.parquet(place)


@query(
    "build_view",
    "SELECT event_type, event_id, user_id, value FROM (SELECT nullif(event_type, 'error') AS event_type, event_id, user_id, value FROM events) WHERE event_type IS NOT NULL AND event_id IS NOT NULL",
)
def build_view(t):
    base = t.events.withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type")))
    return tables.build_view(
        base, TableSpec(("event_type",), ("event_id desc",)), ["user_id", "value"], clustered=True
    )


@query("build_view_filtered", "SELECT * FROM customer WHERE c_acctbal > 5000")
def build_view_filtered(t):
    return tables.build_view(t.customer, TableSpec(("c_mktsegment",), ("c_custkey",)), where="c_acctbal > 5000")


@query(
    "alter_table",
    """
    SELECT p_partkey, p_name AS name, p_brand, p_size::BIGINT AS p_size, p_retailprice, NULL::VARCHAR AS note FROM part
    """,
)
def alter_table(t):
    return tables.alter_table(
        t.part,
        [("add", "note", "string"), ("drop", "p_type"), ("rename", "p_name", "name"), ("type", "p_size", "bigint")],
    )


@query(
    "check_keys",
    """
    SELECT count(*) AS rows, 0::BIGINT AS incomplete_keys, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_keys,
           (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS repeated_keys
    FROM lineitem
    """,
)
def check_keys(t):
    return tables.check_keys(t.lineitem, TableSpec(("l_orderkey",), ("l_linenumber",)))


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(t):
    return tables.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "suggest_keys",
    """
    WITH p AS (SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS d FROM conversations GROUP BY 1)
    SELECT 'conv_id' AS partition_key, 'turn' AS clustering_key, bool_and(n = d) AS key_is_unique, count(*) AS partitions,
           max(n)::BIGINT AS largest_partition, round(max(n) * 100.0 / sum(n), 6)::DOUBLE AS largest_percent FROM p
    """,
)
def suggest_keys(t):
    made = tables.suggest_keys(t.conversations, ["conv_id", "turn"])
    return made.withColumn("largest_percent", F.round("largest_percent", 6))


def _changed_parts(t):
    kept = t.part.where(F.col("p_type") != "PROMO")
    moved = F.when(F.col("p_brand") == "Brand#7", F.col("p_partkey") + 10_000_000).otherwise(F.col("p_partkey"))
    size = F.when(F.col("p_name").startswith("red"), F.lit(None).cast("int")).otherwise(F.col("p_size"))
    return kept.select(moved.alias("p_partkey"), "p_name", "p_brand", "p_type", size.alias("p_size"), "p_retailprice")


CHANGED = """
    b AS (SELECT CASE WHEN p_brand = 'Brand#7' THEN p_partkey + 10000000 ELSE p_partkey END AS p_partkey, p_name, p_brand,
                 p_type, CASE WHEN p_name NOT LIKE 'red%' THEN p_size END AS p_size, p_retailprice
          FROM part WHERE p_type <> 'PROMO'),
    j AS (SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey,
                 CASE WHEN b.p_partkey IS NULL THEN 'missing' WHEN a.p_partkey IS NULL THEN 'extra'
                      WHEN (a.p_name, a.p_brand, a.p_type, a.p_size, a.p_retailprice)
                           IS DISTINCT FROM (b.p_name, b.p_brand, b.p_type, b.p_size, b.p_retailprice) THEN 'changed' END AS status,
                 CASE WHEN a.p_partkey IS NOT NULL THEN 1 END::BIGINT AS left_rows,
                 CASE WHEN b.p_partkey IS NOT NULL THEN 1 END::BIGINT AS right_rows
          FROM part a FULL OUTER JOIN b ON a.p_partkey = b.p_partkey)
"""


@query("reconcile", f"WITH {CHANGED} SELECT * FROM j WHERE status IS NOT NULL")
def reconcile(t):
    return tables.reconcile(t.part, _changed_parts(t), ["p_partkey"])


@query(
    "reconcile_summary",
    f"""
    WITH {CHANGED} SELECT count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'extra') AS extra,
    count(*) FILTER (WHERE status = 'changed') AS changed FROM j
    """,
)
def reconcile_summary(t):
    return tables.reconcile_summary(t.part, _changed_parts(t), ["p_partkey"])


@query(
    "reconcile_repeated_keys",
    """
    WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (WHERE l_quantity > 40) AS gone FROM lineitem GROUP BY 1, 2)
    SELECT (SELECT count(*) FROM k WHERE n > 1 AND gone > 0 AND gone < n) > 0 AS repeated_keys_differ,
           (SELECT count(*) FROM k WHERE gone = n) > 0 AS whole_keys_missing
    """,
)
def reconcile_repeated_keys(t):
    # Some rows of repeated keys are taken away, so both kinds of difference are there to be found.
    left = t.lineitem.orderBy("l_shipdate", "l_extendedprice").where("l_quantity <= 40")
    key = ["l_orderkey", "l_linenumber"]
    same = tables.reconcile_summary(t.lineitem, t.lineitem.orderBy("l_shipdate"), key).first()
    if any(same):
        raise AssertionError(f"a table differs from itself: {same}")
    return tables.reconcile_summary(t.lineitem, left, key).select(
        (F.col("missing") + F.col("changed") > 0).alias("repeated_keys_differ"), (F.col("missing") > 0).alias("whole_keys_missing")
    )
