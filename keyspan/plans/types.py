"""Typed import, inference, rendering, time functions, mapping and user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyspan.functions.builtins import register_builtins
from keyspan.functions.parsing import parse, timeuuid_ts
from keyspan.functions.rendering import render_text, row_json
from keyspan.functions.udfs import Aggregate, apply_aggregate, register_function
from keyspan.model import Codec, TableSpec
from keyspan.plans.registry import query
from keyspan.sources import imports
from keyspan.sources.files import query_scan

EVENT_TYPES = {"event_id": "bigint", "user_id": "int", "value": "double", "happened": "timestamp", "kind": "text"}


def _event_texts(t):
    """Events as text with values broken where the event type says so."""
    kind = F.col("event_type")
    return t.events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(kind == "signup", F.concat(F.col("user_id").cast("string"), F.lit(".5")))
        .otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"))).alias("user_id"),
        F.when(kind == "error", "oops").when(kind != "view", F.col("value").cast("string")).alias("value"),
        F.when(kind == "click", "2024-13-77T00:00:00Z")
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("happened"),
        kind.alias("kind"),
    )


@query(
    "typed_import_rows",
    """
    SELECT event_id, user_id::INTEGER AS user_id, CASE WHEN event_type <> 'view' THEN value END AS value,
           epoch_us(ts) AS happened, event_type AS kind
    FROM events WHERE event_type IN ('view', 'purchase')
    """,
)
def typed_import_rows(t):
    good, _ = imports.typed_import(_event_texts(t), EVENT_TYPES, row_id="event_id")
    return good.withColumn("happened", F.unix_micros("happened"))


@query(
    "typed_import_errors",
    """
    SELECT event_id::VARCHAR AS row, 'value' AS field, 'oops' AS value, 'Cannot read ''oops'' as double' AS message
    FROM events WHERE event_type = 'error'
    UNION ALL SELECT event_id::VARCHAR, 'user_id', user_id || '.5', 'Cannot read ''' || user_id || '.5'' as int'
    FROM events WHERE event_type = 'signup'
    UNION ALL SELECT event_id::VARCHAR, 'happened', '2024-13-77T00:00:00Z',
              'Cannot read ''2024-13-77T00:00:00Z'' as timestamp' FROM events WHERE event_type = 'click'
    """,
)
def typed_import_errors(t):
    return imports.typed_import(_event_texts(t), EVENT_TYPES, row_id="event_id")[1]


@query(
    "codec_options",
    """
    SELECT event_id, event_type = 'purchase' AS flag,
           CASE WHEN event_type = 'view' THEN NULL ELSE (event_id * 1000003)::BIGINT END AS big,
           (floor(value) + CASE WHEN value - floor(value) >= 0.5 THEN 1 ELSE 0 END)::INTEGER AS near,
           epoch_us(ts) // 1000000 * 1000000 + 3600000000 AS at, strftime(ts, '%Y-%m-%d') AS day
    FROM events WHERE event_type <> 'click'
    """,
)
def codec_options(t):
    codec = Codec(
        boolean_strings=("ja:nein",), format_numbers=True, rounding="HALF_UP", unit="SECONDS",
        epoch="1970-01-01T01:00:00Z", null_strings=("NULL", "-"), date="dd.MM.yyyy",
    )
    kind = F.col("event_type")
    text = t.events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(kind == "purchase", "JA").when(kind == "click", "maybe").otherwise(" nein").alias("flag"),
        F.when(kind == "view", "NULL").otherwise(F.format_number(F.col("event_id") * 1000003, 0)).alias("big"),
        F.format_number("value", 2).alias("near"),
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("at"),
        F.date_format("ts", "dd.MM.yyyy").alias("day"),
    )
    good, _ = imports.typed_import(
        text, {"event_id": "bigint", "flag": "boolean", "big": "bigint", "near": "int", "at": "timestamp", "day": "date"}, codec
    )
    return good.withColumns({"at": F.unix_micros("at"), "day": F.col("day").cast("string")})


@query(
    "blob_and_uuid_import",
    """
    SELECT event_id, upper(hex(event_type)) AS raw, lower(md5(event_type)) AS id, event_type <> 'click' AS ok
    FROM events
    """,
)
def blob_and_uuid_import(t):
    kind = F.col("event_type")
    digest = F.md5("event_type")
    dashed = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    text = t.events.select(
        "event_id",
        F.when(kind == "view", F.base64(kind.cast("binary"))).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(kind)))).alias("raw"),
        F.upper(dashed).alias("id"),
        F.when(kind == "click", "10.0.0.256").otherwise("10.0.0.25").alias("address"),
    )
    return text.select(
        "event_id",
        F.hex(parse(F.col("raw"), "blob")).alias("raw"),
        F.replace(parse(F.col("id"), "uuid"), F.lit("-"), F.lit("")).alias("id"),
        parse(F.col("address"), "inet").isNotNull().alias("ok"),
    )


@query(
    "collection_import",
    """
    SELECT p_partkey, to_json(list_sort(list_distinct(string_split(p_name, ' '))))::VARCHAR AS words,
           p_size AS size, p_brand AS brand
    FROM part
    """,
)
def collection_import(t):
    words = F.split("p_name", " ")
    text = t.part.select(
        "p_partkey",
        F.to_json(F.concat(words, words)).alias("words"),
        F.to_json(F.create_map("p_brand", "p_size")).alias("sizes"),
        F.to_json(F.array(F.col("p_brand"), F.col("p_size").cast("string"))).alias("pair"),
    )
    pair = parse(F.col("pair"), "tuple<text, int>")
    return text.select(
        "p_partkey",
        F.to_json(parse(F.col("words"), "set<text>")).alias("words"),
        F.element_at(F.map_values(parse(F.col("sizes"), "map<text, int>")), 1).alias("size"),
        F.when(pair["_2"] == F.element_at(F.map_values(parse(F.col("sizes"), "map<text,int>")), 1), pair["_1"]).alias("brand"),
    )


@query(
    "time_and_duration_import",
    """
    SELECT event_id, (epoch_us(ts) % 86400000000 * 1000)::BIGINT AS at,
           (event_id % 14)::INTEGER AS months, (event_id % 9)::INTEGER AS days, (user_id * 1000000)::BIGINT AS nanos
    FROM events
    """,
)
def time_and_duration_import(t):
    texts = t.events.select(
        "event_id",
        F.date_format("ts", "HH:mm:ss.SSSSSS").alias("at"),
        F.when(F.col("event_type") == "view", F.concat(
            F.lit("P"), (F.col("event_id") % 14).cast("string"), F.lit("M"), (F.col("event_id") % 9).cast("string"),
            F.lit("DT"), F.format_string("%.3f", F.col("user_id") / 1000), F.lit("S"),
        )).otherwise(F.concat(
            (F.col("event_id") % 14).cast("string"), F.lit("mo"), (F.col("event_id") % 9).cast("string"), F.lit("d"),
            F.col("user_id").cast("string"), F.lit("ms"),
        )).alias("span"),
    )
    span = parse(F.col("span"), "duration")
    return texts.select(
        "event_id", parse(F.col("at"), "time").alias("at"), span["months"].alias("months"),
        span["days"].alias("days"), span["nanos"].alias("nanos"),
    )


@query(
    "infer_schema",
    """
    SELECT * FROM (VALUES ('event_id', 0::INTEGER, 'int', false), ('user_id', 1, 'double', false), ('value', 2, 'text', true),
                          ('happened', 3, 'text', false), ('kind', 4, 'text', false), ('clean_value', 5, 'double', false),
                          ('clean_time', 6, 'timestamp', false), ('large', 7, 'bigint', false), ('day', 8, 'date', false))
           v(field, index, inferred_type, nullable), (SELECT count(*) AS present FROM events)
    WHERE present > 0
    """,
)
def infer_schema(t):
    more = t.events.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("value").cast("string").alias("clean_value"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("clean_time"),
        (F.col("event_id") + 5_000_000_000).cast("string").alias("large"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )
    found = imports.infer_schema(_event_texts(t).join(more, "event_id"))
    total = t.events.select(F.count(F.lit(1))).scalar()
    return found.select("field", "index", "inferred_type", "nullable", total.alias("present"))


@query(
    "sniff_nulls",
    r"""
    SELECT 'a' AS field, CASE WHEN bool_or(event_type = 'view') THEN 'NULL,\N' ELSE '' END AS words FROM events
    UNION ALL SELECT 'b', CASE WHEN bool_or(event_type = 'error') THEN 'n/a' ELSE '' END FROM events
    UNION ALL SELECT 'c', CASE WHEN count(*) = 0 THEN 'none' ELSE '' END FROM events
    """,
)
def sniff_nulls(t):
    kind = F.col("event_type")
    text = t.events.select(
        F.when(kind == "view", "NULL").when(kind == "click", " \\N").otherwise(kind).alias("a"),
        F.when(kind == "error", "n/a ").otherwise(kind).alias("b"),
        kind.alias("c"),
    )
    return imports.sniff_nulls(text).select("field", F.array_join("words", ",").alias("words"))


@query(
    "timeuuid_time",
    """
    SELECT event_id, CASE WHEN event_type <> 'error' THEN epoch_us(ts) // 1000 END AS millis FROM events
    """,
)
def timeuuid_time(t):
    return t.events.select("event_id", F.unix_millis(timeuuid_ts(_timeuuid())).alias("millis"))


def _timeuuid():
    """A version 1 uuid made from each event's time; errors get version 4."""
    ticks = F.unix_micros(F.col("ts").cast("timestamp")) * 10 + F.lit(122192928000000000)
    word = F.lpad(F.lower(F.hex(ticks)), 15, "0")
    version = F.when(F.col("event_type") == "error", "4").otherwise("1")
    return F.concat(
        F.substring(word, 8, 8), F.lit("-"), F.substring(word, 4, 4), F.lit("-"), version, F.substring(word, 1, 3),
        F.lit("-8aaa-0123456789ab"),
    )


@query(
    "time_functions",
    """
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) // 1000 AS millis FROM events
    """,
)
def time_functions(t):
    register_builtins(t.spark)
    return query_scan(
        t.spark,
        """
        SELECT event_id, CAST(todate(CAST(ts AS STRING)) AS STRING) AS day, tounixtimestamp(CAST(ts AS STRING)) AS millis
        FROM events
        """,
        {"events": t.events},
    )


@query(
    "sql_builtins",
    """
    SELECT event_id, CASE WHEN event_type <> 'error' THEN epoch_us(ts) // 1000 END AS uuid_millis,
           CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d') END AS uuid_day,
           strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) // 1000 AS millis
    FROM events
    """,
)
def sql_builtins(t):
    register_builtins(t.spark)
    shown = t.events.select("event_id", _timeuuid().alias("id"), F.col("ts").cast("timestamp").alias("at"))
    return query_scan(
        t.spark,
        """
        SELECT event_id, unixtimestampof(id) AS uuid_millis, CAST(todate(id) AS STRING) AS uuid_day,
               CAST(todate(at) AS STRING) AS day, tounixtimestamp(at) AS millis FROM keyspan_timed
        """,
        {"keyspan_timed": shown},
    )


@query(
    "sql_similarity",
    """
    SELECT a.vec_id, round((1 + list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2, 6) AS score
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
    """,
)
def sql_similarity(t):
    register_builtins(t.spark)
    return query_scan(
        t.spark,
        """
        SELECT a.vec_id, round(similarity_cosine(a.embedding, b.embedding), 6) AS score
        FROM keyspan_vectors a JOIN keyspan_vectors b ON b.vec_id = a.vec_id + 1
        """,
        {"keyspan_vectors": t.embeddings},
    )


@query(
    "map_fields",
    "SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance FROM customer",
)
def map_fields(t):
    return imports.map_fields(t.customer, "0=id, c_mktsegment=segment, c_acctbal=balance", ["id", "segment", "balance"])


@query("map_fields_by_name", "SELECT o_orderkey AS O_ORDERKEY, o_totalprice FROM orders")
def map_fields_by_name(t):
    target = ["O_ORDERKEY", "o_totalprice", "comment"]
    return imports.map_fields(t.orders, None, target, allow_missing=True)


@query(
    "import_preview_errors",
    """
    SELECT event_id::VARCHAR AS row, 'total' AS field, 'oops' AS value, 'Cannot read ''oops'' as decimal(10,2)' AS message
    FROM events WHERE event_type = 'error'
    """,
)
def import_preview_errors(t):
    preview = imports.preview_import(
        _event_texts(t), {"event": "bigint", "total": "decimal(10,2)", "extra": "text"}, TableSpec(("event",)),
        mapping="event_id=event, value=total", row_id="event_id",
    )
    return preview.errors


@query(
    "codec_truncate",
    """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN 2147483647 WHEN 1 THEN -2147483648 WHEN 2 THEN event_id END::INTEGER AS number FROM events
    """,
)
def codec_truncate(t):
    # Only readable numbers are bounded; words, NaN and fractions stay unread.
    number = F.col("event_id") % 5
    text = (
        F.when(number == 0, F.concat(F.lit("99999999999"), F.repeat(F.lit("9"), (F.col("event_id") % 40).cast("int"))))
        .when(number == 1, F.concat(F.lit("-3000000"), F.col("event_id"))).when(number == 2, F.col("event_id").cast("string"))
        .when(number == 3, F.when(F.col("event_id") % 2 == 0, "abc").otherwise("NaN")).otherwise("1.9")
    )
    text = F.when(number == 1, F.concat(F.lit("-30000000000"), F.col("event_id"))).otherwise(text)
    return t.events.select("event_id", parse(text, "int", Codec(overflow="TRUNCATE")).alias("number"))


@query(
    "import_rejects_nested",
    """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'd' WHEN 2 THEN 'i' END AS failed FROM events
    """,
)
def import_rejects_nested(t):
    # A repeated map key, a decimal that would lose digits, an address that is none, and good rows.
    number = F.col("event_id") % 4
    texts = t.events.select(
        "event_id",
        F.when(number == 0, '{"1":"a","01":"b"}').otherwise('{"1":"a","2":"b"}').alias("m"),
        F.when(number == 1, "1.2345678901234").otherwise("1.2300000000000").alias("d"),
        F.when(number == 2, F.when(F.col("event_id") % 8 == 2, "1::2::3").otherwise(":::")).otherwise("::ffff:1.2.3.4").alias("i"),
    )
    kinds = {"m": "map<int,text>", "d": "decimal", "i": "inet"}
    failed = [F.when(parse(F.col(c), kind).isNull(), F.lit(c)) for c, kind in kinds.items()]
    return texts.select("event_id", F.nullif(F.concat_ws(",", *failed), F.lit("")).alias("failed"))


@query("import_preview_rows", "SELECT count(*) AS rows FROM events")
def import_preview_rows(t):
    return imports.preview_import(_event_texts(t), {"kind": "text"}, TableSpec(("kind",))).rows


@query(
    "flat_text",
    f"""
    SELECT vec_id::VARCHAR AS vec_id, label::VARCHAR AS label,
           '0x' || lower(hex('v' || vec_id)) AS raw, '{{"label":' || label || ',"id":' || vec_id || '}}' AS pair,
           '["' || label || '",null]' AS list
    FROM embeddings
    """,
)
def flat_text(t):
    shown = t.embeddings.select(
        "vec_id", "label",
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).cast("binary").alias("raw"),
        F.struct("label", F.col("vec_id").alias("id")).alias("pair"),
        F.array(F.col("label").cast("string"), F.lit(None).cast("string")).alias("list"),
    )
    return render_text(shown)


@query(
    "row_as_json",
    """
    SELECT c_custkey, '{"c_custkey":"' || c_custkey || '","c_nationkey":' || c_nationkey || ',"gone":null}' AS json
    FROM customer
    """,
)
def row_as_json(t):
    shown = t.customer.select("c_custkey", "c_nationkey", F.lit(None).cast("string").alias("gone"))
    return shown.select("c_custkey", row_json(shown).alias("json"))


@query(
    "user_function",
    """
    SELECT event_id, CASE WHEN event_type <> 'error' THEN (value * 2 + user_id)::DOUBLE END AS strict_result,
           CASE WHEN event_type = 'error' THEN -1.0 ELSE value END::DOUBLE AS called_result
    FROM events
    """,
)
def user_function(t):
    register_function(t.spark, "keyspan_twice", lambda v, u: v * 2 + u, "double", "RETURNS NULL ON NULL INPUT")
    register_function(t.spark, "keyspan_or", lambda v: -1.0 if v is None else v, "double")
    t.events.withColumn("v", F.when(F.col("event_type") != "error", F.col("value"))).createOrReplaceTempView("keyspan_events")
    return t.spark.sql(
        "SELECT event_id, keyspan_twice(v, user_id) AS strict_result, keyspan_or(v) AS called_result FROM keyspan_events"
    )


AVERAGE = Aggregate(
    sfunc=lambda s, v: {"n": s["n"] + 1, "total": s["total"] + round(v * 100)},
    init={"n": 0, "total": 0},
    merge=lambda a, b: {"n": a["n"] + b["n"], "total": a["total"] + b["total"]},
    state_type="struct<n:bigint,total:bigint>",
    final=lambda s: s["total"] / s["n"] if s["n"] else None,
    return_type="double",
)


@query(
    "user_aggregate",
    "SELECT user_id, round(sum(round(value * 100)::BIGINT) / count(*), 6)::DOUBLE AS mean_cents FROM events GROUP BY 1",
)
def user_aggregate(t):
    made = apply_aggregate(t.events, ["user_id"], ["value"], AVERAGE, "mean_cents", open_groups=50)
    return made.withColumn("mean_cents", F.round("mean_cents", 6))


@query(
    "user_aggregate_whole",
    "SELECT round(sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / count(*), 4) AS mean_cents FROM orders",
)
def user_aggregate_whole(t):
    made = apply_aggregate(t.orders, [], ["o_totalprice"], AVERAGE, "mean_cents")
    return made.withColumn("mean_cents", F.round("mean_cents", 4))
