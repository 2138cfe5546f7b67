"""Counts, ranges, skew and keyed aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyspan.functions.tokens import MAX_TOKEN, MIN_TOKEN
from keyspan.model import TableSpec
from keyspan.operators import buckets, stats
from keyspan.operators.views import in_range
from keyspan.plans.registry import query
from keyspan.session import work_path

EVENTS = TableSpec(("user_id",), ("ts", "event_id"))
CONVERSATIONS = TableSpec(("conv_id",), ("turn",))


@query("count_global", "SELECT 'global' AS section, count(*) AS rows FROM lineitem")
def count_global(t):
    return stats.count_stats(t.lineitem, ["l_orderkey"], ["global"]).select("section", "rows")


@query(
    "count_by_key_range",
    """
    WITH b AS (SELECT min(o_orderkey) lo, max(o_orderkey) hi FROM orders),
    c AS (SELECT least(15, floor((o_orderkey - lo) * 16 / (hi - lo + 1)))::BIGINT AS split_id, count(*) AS n
          FROM orders, b GROUP BY 1)
    SELECT r.range AS split_id, coalesce(n, 0)::BIGINT AS rows,
           round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM orders), 6)::DOUBLE AS percent
    FROM range(16) r LEFT JOIN c ON c.split_id = r.range
    """,
)
def count_by_key_range(t):
    return stats.width_range_counts(t.orders, "o_orderkey", 16).withColumn("percent", F.round("percent", 6))


def _nations(t):
    """A table that places 25 ranges: the range of a nation's number belongs to its region."""
    return t.nation.select(F.col("n_nationkey").alias("split_id"), F.col("n_regionkey").alias("owner"))


@query(
    "replica_counts",
    """
    WITH b AS (SELECT min(o_orderkey) lo, max(o_orderkey) hi FROM orders),
    c AS (SELECT least(24, floor((o_orderkey - lo) * 25 / (hi - lo + 1)))::BIGINT AS split_id, count(*) AS n
          FROM orders, b GROUP BY 1)
    SELECT n_regionkey AS owner, sum(coalesce(n, 0))::BIGINT AS rows,
           round(100.0 * sum(coalesce(n, 0)) / (SELECT count(*) FROM orders), 6)::DOUBLE AS percent
    FROM nation LEFT JOIN c ON split_id = n_nationkey GROUP BY 1
    """,
)
def replica_counts(t):
    ranges = stats.width_range_counts(t.orders, "o_orderkey", 25)
    return stats.replica_counts(ranges, _nations(t)).withColumn("percent", F.round("percent", 6))


@query(
    "replica_conservation",
    """
    WITH b AS (SELECT min(l_orderkey) lo, max(l_orderkey) hi FROM lineitem),
    c AS (SELECT least(24, floor((l_orderkey - lo) * 25 / (hi - lo + 1)))::BIGINT AS split_id, count(*) AS n
          FROM lineitem, b GROUP BY 1)
    SELECT (SELECT count(*) FROM lineitem) AS rows, sum(coalesce(n, 0))::BIGINT AS replicated, count(DISTINCT s_suppkey) AS owners
    FROM supplier LEFT JOIN c ON split_id = s_nationkey
    """,
)
def replica_conservation(t):
    # A range is held by all suppliers of its nation.
    owners = t.supplier.select(F.col("s_nationkey").alias("split_id"), F.col("s_suppkey").alias("owner"))
    ranges = stats.width_range_counts(t.lineitem, "l_orderkey", 25)
    total = ranges.select(F.sum("rows")).scalar()
    return stats.replica_counts(ranges, owners).agg(
        F.sum("rows").alias("replicated"), F.count(F.lit(1)).alias("owners")
    ).select(total.alias("rows"), "replicated", "owners")


@query("token_range_total", "SELECT 128::BIGINT AS splits, count(*) AS rows, 100.0::DOUBLE AS percent FROM lineitem")
def token_range_total(t):
    ranges = stats.range_counts(t.lineitem, ["l_orderkey"], 128)
    return ranges.agg(
        F.count(F.lit(1)).alias("splits"), F.sum("rows").alias("rows"), F.round(F.sum("percent"), 6).alias("percent")
    )


@query(
    "token_range_counts",
    "SELECT l_orderkey, 1::BIGINT AS ranges, count(*) AS rows, true AS counted FROM lineitem GROUP BY 1",
)
def token_range_counts(t):
    # A key's token has no SQL, but each key lies in one range, and a range counts the rows of its keys.
    counts = stats.range_counts(t.lineitem, ["l_orderkey"], 128).select("split_id", F.col("rows").alias("in_range"))
    scanned = stats.split_scan(t.lineitem.select("l_orderkey"), ["l_orderkey"], 128).join(counts, "split_id")
    by_key = scanned.groupBy("l_orderkey", "split_id", "in_range").agg(F.count(F.lit(1)).alias("n"))
    whole = by_key.groupBy("split_id", "in_range").agg(F.sum("n").alias("in_keys"))
    told = by_key.join(whole, ["split_id", "in_range"])
    return told.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("ranges"), F.sum("n").alias("rows"), F.bool_and(F.col("in_range") == F.col("in_keys")).alias("counted")
    )


@query(
    "split_audit",
    """
    SELECT 64::BIGINT AS splits, count(*) AS rows_in_splits, 0::BIGINT AS gaps, 0::BIGINT AS stray_splits,
           count(*) AS rows_in_table, 0::BIGINT AS keys_in_many_splits FROM events
    """,
)
def split_audit(t):
    return stats.audit_summary(t.events, ["user_id"], 64, per_key=True)


@query(
    "tile_conservation",
    "SELECT count(*) AS rows, 0::BIGINT AS outside FROM orders",
)
def tile_conservation(t):
    tiles = stats.key_tiles(t.orders, ["o_orderkey"], 16)
    # A tile begins after the one before it has ended.
    ended = tiles.select((F.col("tile") + 1).alias("tile"), F.col("hi").alias("ended"))
    return tiles.join(ended, "tile", "left").agg(
        F.sum("rows").alias("rows"), F.count(F.when(F.col("lo") <= F.col("ended"), 1)).alias("outside")
    )


@query("ring_ranges_cover", "SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys FROM orders")
def ring_ranges_cover(t):
    thirds = [MIN_TOKEN, -(2**62) - 7, 2**61 + 3, MAX_TOKEN]
    parts = [in_range(t.orders, ["o_orderkey"], lo, hi) for lo, hi in zip(thirds, thirds[1:])]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderkey").alias("keys"))


@query(
    "partition_counts",
    "SELECT l_orderkey, CAST(l_orderkey AS VARCHAR) AS partition_key, count(*) AS rows FROM lineitem GROUP BY 1",
)
def partition_counts(t):
    return stats.partition_counts(t.lineitem, ["l_orderkey"])


@query(
    "partition_counts_composite",
    """
    SELECT user_id, event_type, '(' || user_id || ', ' || event_type || ')' AS partition_key, count(*) AS rows
    FROM events GROUP BY 1, 2
    """,
)
def partition_counts_composite(t):
    return stats.partition_counts(t.events, ["user_id", "event_type"])


@query(
    "largest_partitions",
    """
    SELECT user_id, CAST(user_id AS VARCHAR) AS partition_key, count(*) AS rows,
           round(100.0 * count(*) / (SELECT count(*) FROM events), 6)::DOUBLE AS percent
    FROM events GROUP BY 1 ORDER BY rows DESC, user_id LIMIT 10
    """,
)
def largest_partitions(t):
    return stats.largest_partitions(t.events, ["user_id"], 10).withColumn("percent", F.round("percent", 6))


@query("partition_count", "SELECT count(DISTINCT l_orderkey) AS partitions FROM lineitem")
def partition_count(t):
    return stats.partition_count(t.lineitem, ["l_orderkey"])


@query(
    "partition_count_approximate",
    "SELECT count(DISTINCT l_orderkey) AS exact, true AS within_5_percent FROM lineitem",
)
def partition_count_approximate(t):
    near = stats.partition_count(t.lineitem, ["l_orderkey"], approximate=True).scalar()
    return stats.partition_count(t.lineitem, ["l_orderkey"]).select(
        F.col("partitions").alias("exact"),
        (F.abs(near - F.col("partitions")) <= F.col("partitions") * 0.05).alias("within_5_percent"),
    )


@query(
    "busiest_detail",
    """
    SELECT user_id, count(*) AS rows, (SELECT count(DISTINCT user_id) FROM events) AS reported,
           (SELECT count(DISTINCT user_id) FROM events) > 50 AS truncated
    FROM events GROUP BY 1 ORDER BY rows DESC, user_id LIMIT 50
    """,
)
def busiest_detail(t):
    counts = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))
    return stats.cap_detail(counts, 50, "rows", ["user_id"])


@query(
    "count_report",
    """
    WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
    top AS (SELECT * FROM c ORDER BY n DESC, user_id LIMIT 10)
    SELECT 'global' AS section, 'total' AS item, sum(n)::BIGINT AS rows, 100.0::DOUBLE AS percent FROM c
    UNION ALL SELECT 'partitions', CAST(user_id AS VARCHAR), n,
           round(100.0 * n / (SELECT sum(n) FROM c), 6)::DOUBLE FROM top
    """,
)
def count_report(t):
    report = stats.count_stats(t.events, ["user_id"], ["global", "biggest-partitions", "nonsense"], top=10)
    return report.select("section", "item", "rows", F.round("percent", 6).alias("percent"))


@query("total_from_ranges", "SELECT count(*) AS rows FROM orders")
def total_from_ranges(t):
    report = stats.count_stats(t.orders, ["o_custkey"], ["ranges", "hosts"], 25, owners=_nations(t))
    return stats.total_rows(report)


@query(
    "table_statistics",
    """
    WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
    SELECT 'orders' AS identity, 'global' AS section, 'total' AS item, sum(n)::BIGINT AS rows,
           1::BIGINT AS reported, false AS truncated FROM c
    UNION ALL SELECT 'orders', 'partition_count', 'total', count(*), 1, false FROM c
    UNION ALL SELECT * FROM (SELECT 'orders', 'partitions', CAST(o_custkey AS VARCHAR), n, 10, false
                             FROM c ORDER BY n DESC, o_custkey LIMIT 10)
    """,
)
def table_statistics(t):
    snapshot = stats.table_statistics(t.orders, ["o_custkey"], "orders", splits=32)
    return snapshot.where(F.col("section") != "ranges").select(
        "identity", "section", "item", "rows", "reported", "truncated"
    )


@query(
    "stored_statistics",
    """
    WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
    SELECT 'events' AS identity, 'global' AS section, 'total' AS item, sum(n)::BIGINT AS rows, 1::BIGINT AS reported FROM c
    UNION ALL SELECT 'events', 'partition_count', 'total', count(*), 1 FROM c
    UNION ALL SELECT * FROM (SELECT 'events', 'partitions', CAST(user_id AS VARCHAR), n, 10 FROM c ORDER BY n DESC, user_id LIMIT 10)
    """,
)
def stored_statistics(t):
    # Three loads; after each only the buckets that it rewrote are counted again.
    spark, path = t.spark, work_path(t.spark, "counted")
    loads = [t.events.where("event_type = 'view'"), t.events.where("event_type = 'click'"), t.events.where("event_type NOT IN ('view', 'click')")]
    buckets.write_buckets(loads[0], path, EVENTS, 8)
    for more in loads[1:]:
        buckets.refresh_counts(spark, path, EVENTS)
        buckets.upsert_buckets(spark, path, more, EVENTS)
    told = buckets.stored_statistics(spark, path, EVENTS, "events", splits=32)
    return told.where("section <> 'ranges'").select("identity", "section", "item", "rows", "reported")


@query(
    "aggregate_by_key",
    """
    SELECT user_id, count(*) AS rows, min(value) AS low, max(value) AS high, round(sum(value), 4) AS total,
           round(avg(value), 6) AS mean
    FROM events GROUP BY 1
    """,
)
def aggregate_by_key(t):
    made = stats.aggregate_by_key(
        t.events, EVENTS, ["user_id"],
        {"rows": ("count", "*"), "low": ("min", "value"), "high": ("max", "value"),
         "total": ("sum", "value"), "mean": ("avg", "value")},
    )
    return made.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query(
    "aggregate_whole_table",
    "SELECT count(*) AS rows, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders",
)
def aggregate_whole_table(t):
    spec = TableSpec(("o_custkey",), ("o_orderkey",))
    return stats.aggregate_by_key(
        t.orders, spec, [], {"rows": ("count", "*"), "low": ("min", "o_totalprice"), "high": ("max", "o_totalprice")}
    )


@query("distinct_keys", "SELECT DISTINCT conv_id FROM conversations")
def distinct_keys(t):
    return stats.distinct_keys(t.conversations, ["conv_id"])


@query(
    "write_fanout",
    """
    SELECT l_suppkey, count(*) AS statements, greatest(count(DISTINCT l_orderkey), 1) AS partitions,
           count(DISTINCT l_orderkey) > 1 AS spans_partitions FROM lineitem GROUP BY 1
    """,
)
def write_fanout(t):
    return stats.write_fanout(t.lineitem, ["l_orderkey"], "l_suppkey")


@query(
    "write_fanout_unknown",
    """
    SELECT l_suppkey, count(*) AS statements,
           greatest(count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_orderkey END)
                    + count(*) FILTER (WHERE l_returnflag = 'R'), 1)::BIGINT AS partitions,
           (count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_orderkey END)
            + count(*) FILTER (WHERE l_returnflag = 'R')) > 1 AS spans_partitions
    FROM lineitem GROUP BY 1
    """,
)
def write_fanout_unknown(t):
    writes = t.lineitem.withColumn("l_orderkey", F.when(F.col("l_returnflag") != "R", F.col("l_orderkey")))
    return stats.write_fanout(writes, ["l_orderkey"], "l_suppkey")
