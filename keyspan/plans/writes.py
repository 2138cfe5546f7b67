"""Keyed writes. Changes are derived from whole tables: events become changes to customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyspan.model import TableSpec
from keyspan.operators import buckets, cells, tables, writes
from keyspan.plans.registry import query
from keyspan.session import work_path

CUSTOMER = TableSpec(("c_custkey",))
ORDERS = TableSpec(("o_custkey",), ("o_orderkey",))

# Every event is a change to the customer with ten times its user number, so a few customers take
# all changes and those beyond the table are new. A view writes the segment, a purchase the balance,
# a click both, a signup the nation, an error nulls the balance.
CHANGES = """
    changes AS (
      SELECT user_id * 10 AS c_custkey, event_type AS c_mktsegment,
             CASE WHEN event_type <> 'error' THEN value END AS c_acctbal,
             (event_id % 25)::INTEGER AS c_nationkey, epoch_us(ts) AS ts, event_id AS seq,
             CASE event_type WHEN 'view' THEN ['c_mktsegment'] WHEN 'purchase' THEN ['c_acctbal']
                  WHEN 'click' THEN ['c_mktsegment', 'c_acctbal'] WHEN 'signup' THEN ['c_nationkey']
                  ELSE ['c_acctbal'] END AS set_cols
      FROM events)
"""


def _micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def _changes(t):
    kind = F.col("event_type")
    return t.events.select(
        (F.col("user_id") * 10).alias("c_custkey"),
        kind.alias("c_mktsegment"),
        F.when(kind != "error", F.col("value")).alias("c_acctbal"),
        (F.col("event_id") % 25).cast("int").alias("c_nationkey"),
        _micros("ts").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(kind == "view", F.array(F.lit("c_mktsegment")))
        .when(kind == "purchase", F.array(F.lit("c_acctbal")))
        .when(kind == "click", F.array(F.lit("c_mktsegment"), F.lit("c_acctbal")))
        .when(kind == "signup", F.array(F.lit("c_nationkey")))
        .otherwise(F.array(F.lit("c_acctbal")))
        .alias("set_cols"),
    )


def _winner(column: str, where: str) -> str:
    return (
        f"arg_max_null({column}, seq) FILTER (WHERE {where}) AS {column}, "
        f"coalesce(bool_or({where}), false) AS set_{column}"
    )


def _merged(set_test: str) -> str:
    names = ("c_nationkey", "c_acctbal", "c_mktsegment")
    winners = ", ".join(_winner(c, set_test.format(c=c)) for c in names)
    picked = ", ".join(f"CASE WHEN set_{c} THEN w.{c} ELSE b.{c} END AS {c}" for c in names)
    return f"""
    w AS (SELECT c_custkey, {winners} FROM changes GROUP BY 1)
    SELECT coalesce(b.c_custkey, w.c_custkey) AS c_custkey, b.c_name, {picked}
    FROM customer b FULL OUTER JOIN w ON b.c_custkey = w.c_custkey
    """


@query("upsert_cells", f"WITH {CHANGES}, {_merged("list_contains(set_cols, '{c}')")}")
def upsert_cells(t):
    return writes.upsert(t.customer, _changes(t), CUSTOMER, ts="ts", seq="seq", set_cols="set_cols")


@query("upsert_null_to_unset", f"WITH {CHANGES}, {_merged("list_contains(set_cols, '{c}') AND {c} IS NOT NULL")}")
def upsert_null_to_unset(t):
    return writes.upsert(
        t.customer, _changes(t), CUSTOMER, ts="ts", seq="seq", set_cols="set_cols", null_to_unset=True
    )


@query("upsert_rows", f"WITH {CHANGES}, {_merged('true')}")
def upsert_rows(t):
    return writes.upsert(t.customer, _changes(t).drop("set_cols"), CUSTOMER, ts="ts", seq="seq")


@query(
    "upsert_orders",
    """
    WITH w AS (SELECT l_orderkey + l_suppkey AS k, max({'p': l_extendedprice, 's': l_linestatus}) AS r,
                      max(l_shipdate) AS latest
               FROM lineitem
               GROUP BY 1, l_shipdate QUALIFY row_number() OVER (PARTITION BY l_orderkey + l_suppkey ORDER BY l_shipdate DESC) = 1)
    SELECT coalesce(o_orderkey, k) AS o_orderkey, o_custkey,
           CASE WHEN k IS NULL OR latest < o_orderdate THEN o_orderstatus ELSE r.s END AS o_orderstatus,
           CASE WHEN k IS NULL OR latest < o_orderdate THEN o_totalprice ELSE r.p END AS o_totalprice,
           greatest(o_orderdate, latest) AS o_orderdate, o_orderpriority
    FROM orders FULL OUTER JOIN w ON o_orderkey = k
    """,
)
def upsert_orders(t):
    # Shipments as later versions of orders; an order written after its shipments keeps its row.
    changes = t.lineitem.select(
        (F.col("l_orderkey") + F.col("l_suppkey")).alias("O_ORDERKEY"),
        F.col("l_extendedprice").alias("o_totalprice"),
        F.col("l_linestatus").alias("o_orderstatus"),
        F.col("l_shipdate").alias("shipped"),
        F.struct(F.col("l_extendedprice"), F.col("l_linestatus")).alias("seq"),
    )
    spec = TableSpec(("o_orderkey",))
    return writes.upsert(t.orders, changes, spec, ts="shipped", seq="seq", base_ts="o_orderdate")


@query(
    "partial_update",
    """
    WITH w AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS seg FROM orders GROUP BY 1)
    SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, c_nationkey, c_acctbal,
           coalesce(seg, c_mktsegment) AS c_mktsegment
    FROM customer FULL OUTER JOIN w ON c_custkey = o_custkey
    """,
)
def partial_update(t):
    changes = t.orders.select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"),
        F.col("o_orderkey").alias("seq"), "o_totalprice",
    )
    return writes.update(t.customer, changes, CUSTOMER, ["C_MKTSEGMENT"], seq="seq")


@query(
    "delete_rows",
    "SELECT * FROM orders WHERE (o_custkey, o_orderkey) NOT IN (SELECT l_suppkey, l_orderkey FROM lineitem)",
)
def delete_rows(t):
    gone = t.lineitem.select(F.col("l_suppkey").alias("o_custkey"), F.col("l_orderkey").alias("o_orderkey"))
    return writes.delete_rows(t.orders, gone, ORDERS)


@query(
    "delete_cells",
    """
    SELECT c_custkey, c_name, c_nationkey,
           CASE WHEN c_custkey IN (SELECT user_id FROM events) THEN NULL ELSE c_acctbal END AS c_acctbal,
           CASE WHEN c_custkey IN (SELECT user_id FROM events) THEN NULL ELSE c_mktsegment END AS c_mktsegment
    FROM customer
    """,
)
def delete_cells(t):
    named = t.events.select(F.col("user_id").alias("c_custkey"))
    return writes.delete_cells(t.customer, named, CUSTOMER, ["c_acctbal", "c_mktsegment"])


SUPPLIER = TableSpec(("s_suppkey",))
# Customers are offered as suppliers; the first suppliers exist already.
OFFERS = "offers AS (SELECT c_custkey AS s_suppkey, c_name AS s_name, c_nationkey AS s_nationkey, c_acctbal AS s_acctbal FROM customer)"


def _offers(t):
    return t.customer.select(
        F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"),
        F.col("c_nationkey").alias("s_nationkey"), F.col("c_acctbal").alias("s_acctbal"),
    )


@query(
    "conditional_insert",
    f"WITH {OFFERS} SELECT * FROM supplier UNION ALL SELECT * FROM offers WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)",
)
def conditional_insert(t):
    return writes.conditional_upsert(t.supplier, _offers(t), SUPPLIER, "not_exists")[0]


@query(
    "conditional_insert_outcome",
    f"""
    WITH {OFFERS}
    SELECT o.s_suppkey, s.s_suppkey IS NULL AS applied, s.s_name AS current_name, s.s_acctbal AS current_balance
    FROM offers o LEFT JOIN supplier s ON s.s_suppkey = o.s_suppkey
    """,
)
def conditional_insert_outcome(t):
    outcome = writes.conditional_upsert(t.supplier, _offers(t), SUPPLIER, "not_exists")[1]
    return outcome.select(
        "s_suppkey", "applied", F.col("current.s_name").alias("current_name"),
        F.col("current.s_acctbal").alias("current_balance"),
    )


@query(
    "conditional_repeated_insert",
    """
    SELECT user_id, event_id, event_id = min(event_id) OVER (PARTITION BY user_id) AS applied,
           CASE WHEN event_id <> min(event_id) OVER (PARTITION BY user_id)
                THEN first(event_type) OVER (PARTITION BY user_id ORDER BY event_id) END AS current_type
    FROM events
    """,
)
def conditional_repeated_insert(t):
    spec = TableSpec(("user_id",))
    empty = t.events.select("user_id", "event_type").where(F.lit(False))
    changes = t.events.select("user_id", "event_type", "event_id")
    outcome = writes.conditional_upsert(empty, changes, spec, "not_exists", seq="event_id")[1]
    return outcome.select("user_id", "event_id", "applied", F.col("current.event_type").alias("current_type"))


@query(
    "conditional_exists",
    f"""
    WITH {OFFERS}
    SELECT s.s_suppkey, coalesce(o.s_name, s.s_name) AS s_name, coalesce(o.s_nationkey, s.s_nationkey) AS s_nationkey,
           coalesce(o.s_acctbal, s.s_acctbal) AS s_acctbal
    FROM supplier s LEFT JOIN offers o USING (s_suppkey)
    """,
)
def conditional_exists(t):
    return writes.conditional_upsert(t.supplier, _offers(t), SUPPLIER, "exists")[0]


@query(
    "conditional_if",
    f"""
    WITH {OFFERS}
    SELECT o.s_suppkey, coalesce(s.s_acctbal > 4000 AND s.s_nationkey <> 15, false) AS applied,
           CASE WHEN NOT coalesce(s.s_acctbal > 4000 AND s.s_nationkey <> 15, false) THEN s.s_acctbal END AS current_balance
    FROM offers o LEFT JOIN supplier s USING (s_suppkey)
    """,
)
def conditional_if(t):
    condition = "IF row.s_acctbal > 4000 AND row.s_nationkey <> 15"
    outcome = writes.conditional_upsert(t.supplier, _offers(t), SUPPLIER, condition)[1]
    return outcome.select("s_suppkey", "applied", F.col("current.s_acctbal").alias("current_balance"))


@query(
    "ttl_expire",
    """
    SELECT event_id FROM events
    WHERE CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'view' THEN NULL
               ELSE (event_id % 1000) * 3600 END IS NULL
       OR CASE WHEN event_type = 'error' THEN 0 ELSE (event_id % 1000) * 3600 END <= 0
       OR ts + to_seconds((event_id % 1000) * 3600) > TIMESTAMP '2024-01-20 12:00:00'
    """,
)
def ttl_expire(t):
    ttl = F.when(F.col("event_type") == "error", 0).when(
        F.col("event_type") != "view", (F.col("event_id") % 1000) * 3600
    )
    moment = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return writes.expire(t.events.withColumn("ttl", ttl), "ts", "ttl", moment).select("event_id")


@query(
    "ttl_table_default",
    "SELECT event_id FROM events WHERE ts + INTERVAL 864000 SECOND > TIMESTAMP '2024-01-20 12:00:00'",
)
def ttl_table_default(t):
    moment = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return writes.expire(t.events, "ts", 864000, moment).select("event_id")


@query(
    "counter_totals",
    """
    SELECT user_id, event_type, sum(round(value * 100)::BIGINT)::BIGINT AS cents, count(*)::BIGINT AS hits
    FROM events GROUP BY 1, 2
    """,
)
def counter_totals(t):
    deltas = t.events.select(
        "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.lit(1).cast("bigint").alias("hits"),
    )
    return writes.counter_totals(deltas, ["user_id", "event_type"], ["cents", "hits"])


@query(
    "apply_counters",
    """
    WITH base AS (SELECT o_custkey AS k, count(*)::BIGINT AS n FROM orders GROUP BY 1),
    d AS (SELECT user_id * 7 AS k, count(*)::BIGINT AS n FROM events GROUP BY 1)
    SELECT coalesce(b.k, d.k) AS k, (coalesce(b.n, 0) + coalesce(d.n, 0))::BIGINT AS n
    FROM base b FULL OUTER JOIN d ON b.k = d.k
    """,
)
def apply_counters(t):
    base = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    deltas = t.events.select((F.col("user_id") * 7).alias("k"), F.lit(1).cast("bigint").alias("n"), "event_id")
    # Every increment arrives twice and counts once.
    return writes.apply_counters(base, deltas.unionByName(deltas), ["k"], ["n"], delta_id="event_id")


@query(
    "batch_plan",
    """
    SELECT o_custkey, o_orderkey,
           ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 2)::BIGINT AS batch
    FROM orders
    """,
)
def batch_plan(t):
    return writes.plan_batches(t.orders.select("o_custkey", "o_orderkey"), ORDERS, 2)


@query(
    "batch_plan_hot",
    """
    SELECT event_type, event_id, ((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 32)::BIGINT AS batch
    FROM events
    """,
)
def batch_plan_hot(t):
    # Five keys hold all events, so every key lies in several ranges.
    spec = TableSpec(("event_type",), ("event_id",))
    return writes.plan_batches(t.events.select("event_type", "event_id"), spec)


@query(
    "attach_static",
    """
    SELECT c_custkey, c_nationkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
    """,
)
def attach_static(t):
    statics = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    made = writes.attach_static(t.customer, statics, ["c_nationkey"])
    return made.select("c_custkey", "c_nationkey", "n_name", "n_regionkey")


@query(
    "static_values",
    """
    SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM events GROUP BY 1
    """,
)
def static_values(t):
    spec = TableSpec(("user_id",), ("ts",), static=("event_type", "value"))
    return writes.static_values(t.events, spec, "ts")


# The same changes as mixed cell operations: errors delete the balance cell, signups the whole row.
CELL_CHANGES = """
    changes AS (
      SELECT user_id * 10 AS c_custkey, event_type, value, event_id AS seq, epoch_us(ts) AS ts FROM events),
    gone AS (SELECT c_custkey, max(ts) AS gone FROM changes WHERE event_type = 'signup' GROUP BY 1),
    seg AS (SELECT c_custkey, max(ts) AS at, arg_max(event_type, ts) AS v, arg_max(seq % 3 * 86400, ts) AS life FROM changes
            WHERE event_type IN ('view', 'click') GROUP BY 1),
    bal AS (SELECT c_custkey, max(ts) AS at, arg_max_null(CASE WHEN event_type <> 'error' THEN value END, ts) AS v,
                   arg_max(seq % 3 * 86400, ts) AS life
            FROM changes WHERE event_type IN ('purchase', 'click', 'error') GROUP BY 1),
    row_at AS (SELECT c_custkey, max(ts) AS at FROM changes WHERE event_type = 'purchase' GROUP BY 1),
    keys AS (SELECT c_custkey FROM customer UNION SELECT c_custkey FROM changes),
    merged AS (
      SELECT k.c_custkey, gone, seg.at + seg.life * 1000000 AS seg_until, seg.life AS seg_life,
             bal.at + bal.life * 1000000 AS bal_until, bal.life AS bal_life,
             CASE WHEN gone IS NULL THEN c_name END AS c_name,
             CASE WHEN gone IS NULL THEN c_nationkey END AS c_nationkey,
             CASE WHEN seg.at IS NOT NULL THEN CASE WHEN gone IS NULL OR seg.at > gone THEN seg.v END
                  WHEN gone IS NULL THEN c_mktsegment END AS c_mktsegment,
             CASE WHEN bal.at IS NOT NULL THEN CASE WHEN gone IS NULL OR bal.at > gone THEN bal.v END
                  WHEN gone IS NULL THEN c_acctbal END AS c_acctbal,
             CASE WHEN seg.at IS NOT NULL THEN CASE WHEN gone IS NULL OR seg.at > gone THEN seg.at END
                  WHEN gone IS NULL AND c.c_custkey IS NOT NULL THEN 1000 END AS seg_at,
             CASE WHEN greatest(row_at.at, CASE WHEN c.c_custkey IS NOT NULL THEN 1000 END) > coalesce(gone, 0)
                  THEN greatest(row_at.at, CASE WHEN c.c_custkey IS NOT NULL THEN 1000 END) END AS marker
      FROM keys k LEFT JOIN customer c USING (c_custkey) LEFT JOIN gone USING (c_custkey)
           LEFT JOIN seg USING (c_custkey) LEFT JOIN bal USING (c_custkey) LEFT JOIN row_at USING (c_custkey))
"""


def _cell_table(t):
    kind = F.col("event_type")
    changes = t.events.select(
        (F.col("user_id") * 10).alias("c_custkey"), kind.alias("c_mktsegment"), F.col("value").alias("c_acctbal"),
        F.when(kind == "signup", "delete_row").when(kind == "error", "delete_cells").when(kind == "purchase", "insert")
        .otherwise("update").alias("op"),
        _micros("ts").alias("ts"), F.col("event_id").alias("seq"),
        F.when(kind == "view", F.array(F.lit("c_mktsegment")))
        .when(kind == "click", F.array(F.lit("c_mktsegment"), F.lit("c_acctbal")))
        .otherwise(F.array(F.lit("c_acctbal"))).alias("set_cols"),
        (F.col("event_id") % 3 * 86400).alias("life"),
    )
    base = cells.to_cells(t.customer, CUSTOMER, 1000)
    return cells.merge_cells(base, changes, CUSTOMER, ttl="life")


@query(
    "merge_cells",
    f"""
    WITH {CELL_CHANGES}
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM merged
    WHERE marker IS NOT NULL OR c_name IS NOT NULL OR c_nationkey IS NOT NULL OR c_acctbal IS NOT NULL
       OR c_mktsegment IS NOT NULL
    """,
)
def merge_cells(t):
    return cells.live_rows(_cell_table(t), CUSTOMER)


@query(
    "cell_write_times",
    f"WITH {CELL_CHANGES} SELECT c_custkey, CASE WHEN c_mktsegment IS NOT NULL THEN seg_at END AS writetime_c_mktsegment FROM merged",
)
def cell_write_times(t):
    return cells.cell_meta(_cell_table(t), CUSTOMER, ["c_mktsegment"]).drop("ttl_c_mktsegment")


@query(
    "cell_lifetimes",
    f"""
    WITH {CELL_CHANGES},
    lived AS (SELECT c_custkey, c_name, c_nationkey, marker,
                     CASE WHEN bal_life > 0 AND bal_until <= 1705795200000000 THEN NULL ELSE c_acctbal END AS c_acctbal,
                     CASE WHEN seg_life > 0 AND seg_until <= 1705795200000000 THEN NULL ELSE c_mktsegment END AS c_mktsegment
              FROM merged)
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM lived
    WHERE marker IS NOT NULL OR c_name IS NOT NULL OR c_nationkey IS NOT NULL OR c_acctbal IS NOT NULL
       OR c_mktsegment IS NOT NULL
    """,
)
def cell_lifetimes(t):
    moment = 1704067200000000 + 20 * 86_400_000_000
    return cells.live_rows(_cell_table(t), CUSTOMER, as_of=moment)


@query("upsert_buckets", f"WITH {CHANGES}, {_merged("list_contains(set_cols, '{c}')")}")
def upsert_buckets(t):
    place = work_path(t.spark, "buckets")
    buckets.write_buckets(t.customer, place, CUSTOMER, 16)
    buckets.upsert_buckets(t.spark, place, _changes(t), CUSTOMER, ts="ts", seq="seq", set_cols="set_cols")
    return buckets.read_buckets(t.spark, place)


@query(
    "lookup_bucket",
    "SELECT event_id, user_id, event_type FROM events WHERE user_id = 41",
)
def lookup_bucket(t):
    place, spec = work_path(t.spark, "buckets"), TableSpec(("user_id",), ("ts", "event_id"))
    buckets.write_buckets(t.events, place, spec, 32)
    return buckets.lookup_partition(t.spark, place, spec, {"user_id": 41}).select("event_id", "user_id", "event_type")


# --- map columns ------------------------------------------------------------------------------------

# Each event writes a map of its properties on its user; the map is shown as its sorted entries.
_MAPS = """
    e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS moment,
                 '[' || event_type || '=' || value || ',id=' || event_id || ']' AS props FROM events),
    old AS (SELECT user_id, event_id, props FROM e WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
"""


def _with_map(t):
    entries = F.create_map(
        F.col("event_type"), F.col("value").cast("string"), F.lit("id"), F.col("event_id").cast("string")
    )
    return t.events.select("user_id", "event_id", entries.alias("props"), _micros("ts").alias("at"))


def _oldest(t):
    third = _with_map(t).where("event_id % 3 = 0")
    return third.groupBy("user_id").agg(F.min_by(F.struct("event_id", "props"), "event_id").alias("r")).select("user_id", "r.*")


def _shown(df):
    shown = F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    # "id" sorts among the event types, so the entries are put in the order of the SQL.
    last = F.filter(shown, lambda x: x.startswith("id="))
    first = F.filter(shown, lambda x: ~x.startswith("id="))
    return df.withColumn("props", F.concat(F.lit("["), F.array_join(F.concat(first, last), ","), F.lit("]")))


USERS = TableSpec(("user_id",))
_LATEST = "latest AS (SELECT user_id, arg_max(event_id, (moment, event_id)) AS event_id, arg_max(props, (moment, event_id)) AS props FROM e GROUP BY 1)"


@query("upsert_maps", f"WITH {_MAPS}, {_LATEST} SELECT user_id, event_id, props FROM latest")
def upsert_maps(t):
    changes = _with_map(t).withColumn("seq", F.col("event_id"))
    return _shown(writes.upsert(_oldest(t), changes, USERS, ts="at", seq="seq", null_to_unset=True))


@query(
    "insert_maps_if_absent",
    f"""
    WITH {_MAPS}, firsts AS (SELECT user_id, arg_min(event_id, event_id) AS event_id, arg_min(props, event_id) AS props FROM e GROUP BY 1)
    SELECT user_id, event_id, props FROM old
    UNION ALL SELECT user_id, event_id, props FROM firsts WHERE user_id NOT IN (SELECT user_id FROM old)
    """,
)
def insert_maps_if_absent(t):
    changes = _with_map(t).withColumn("seq", F.col("event_id")).drop("at")
    return _shown(writes.conditional_upsert(_oldest(t), changes, USERS, "not_exists", "seq")[0])


@query("static_maps", f"WITH {_MAPS}, {_LATEST} SELECT user_id, props FROM latest")
def static_maps(t):
    # Times repeat; the identifier inside the map's structure of the write time decides.
    rows = _with_map(t).withColumn("at", F.struct("at", "event_id"))
    spec = TableSpec(("user_id",), ("event_id",), static=("props",))
    return _shown(writes.static_values(rows, spec, "at"))


# --- statements -----------------------------------------------------------------------------------


@query(
    "insert_statements",
    """
    SELECT conv_id, turn, 'INSERT INTO app.conversations (conv_id, turn, role, text) VALUES (' || conv_id || ', ' || turn
           || ', ''' || role || ''', ''' || replace(text, '''', '''''') || ''') USING TTL 3600 AND TIMESTAMP 5;' AS statement
    FROM conversations
    """,
)
def insert_statements(t):
    spec = TableSpec(("conv_id",), ("turn",))
    return tables.generate_statements(t.conversations, "app.conversations", "INSERT", spec, ttl=3600, timestamp=5)


@query(
    "update_statements",
    """
    SELECT c_custkey, 'UPDATE app.customer SET c_mktsegment = ''' || c_mktsegment || ''', c_nationkey = ' || c_nationkey
           || ' WHERE c_custkey = ' || c_custkey || ' IF EXISTS;' AS statement FROM customer
    """,
)
def update_statements(t):
    return tables.generate_statements(
        t.customer, "app.customer", "UPDATE", CUSTOMER, ["c_mktsegment", "c_nationkey"], ttl=-1, conditions=True
    )


@query(
    "delete_statements",
    """
    SELECT o_custkey, o_orderkey, 'DELETE FROM app.orders USING TIMESTAMP 9 WHERE o_custkey = ' || o_custkey
           || ' AND o_orderkey = ' || o_orderkey || ';' AS statement FROM orders
    """,
)
def delete_statements(t):
    return tables.generate_statements(t.orders, "app.orders", "DELETE", ORDERS, timestamp=9)


@query(
    "batch_statements",
    r"""
    WITH s AS (SELECT o_custkey, o_orderkey, 'DELETE FROM app.orders WHERE o_custkey = ' || o_custkey || ' AND o_orderkey = '
                      || o_orderkey || ';' AS statement,
                      (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 8 AS batch FROM orders)
    SELECT o_custkey, batch::BIGINT AS batch, 'BEGIN BATCH' || chr(10) || '  '
           || string_agg(statement, chr(10) || '  ' ORDER BY o_orderkey) || chr(10) || 'APPLY BATCH;' AS statement
    FROM s GROUP BY 1, 2
    """,
)
def batch_statements(t):
    texts = tables.generate_statements(t.orders, "app.orders", "DELETE", ORDERS)
    return tables.batch_statements(writes.plan_batches(texts, ORDERS, 8), ORDERS)
