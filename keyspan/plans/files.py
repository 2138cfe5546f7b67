"""Sources and sinks: every format is written from a whole table and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyspan.functions.rendering import render_wire
from keyspan.model import TableSpec
from keyspan.operators.buckets import read_buckets
from keyspan.plans.registry import query
from keyspan.session import work_path
from keyspan.sources import exports, files, imports

ORDER_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "text", "o_totalprice": "double",
    "o_orderdate": "timestamp", "o_orderpriority": "text",
}


@query(
    "query_scan",
    """
    SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation
    ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name
    """,
)
def query_scan(t):
    return files.query_scan(
        t.spark,
        """
        SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
        FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > :floor GROUP BY n_name
        """,
        {"customer": t.customer, "nation": t.nation},
        {"floor": 0},
    )


@query("parquet_pattern", "SELECT n_nationkey, n_name FROM nation")
def parquet_pattern(t):
    return files.read_parquet(t.spark, t.directory, pattern="nat*.parquet", recursive=True).select("n_nationkey", "n_name")


@query("window_records", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 5000 OFFSET 100")
def window_records(t):
    return files.window_records(t.events, 100, 5000).select("event_id", "user_id")


@query("csv_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_round_trip(t):
    path = work_path(t.spark, "csv")
    exports.export(t.documents, path, "csv", header=True, max_records_per_file=200)
    back = files.read_csv(t.spark, path)
    good, _ = imports.typed_import(
        back, {"doc_id": "bigint", "text": "text", "lang": "text", "source": "text", "n_chars": "bigint"}
    )
    return good


@query("csv_rolled_by_bytes", "SELECT doc_id, text, lang, source, n_chars, 0::BIGINT AS files_too_long FROM documents")
def csv_rolled_by_bytes(t):
    # Files end before the row that would pass the limit; one longer than it holds a single row.
    path, limit = work_path(t.spark, "csv"), 200_000
    exports.export(t.documents, path, "csv", header=True, max_file_bytes=limit)
    good, _ = imports.typed_import(
        files.read_csv(t.spark, path),
        {"doc_id": "bigint", "text": "text", "lang": "text", "source": "text", "n_chars": "bigint"},
    )
    sizes = t.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("length")
    longest = t.documents.agg(F.max(F.octet_length("text"))).first()[0] or 0
    over = sizes.where(F.col("length") > max(limit, 2 * longest + 200)).count()
    return good.withColumn("files_too_long", F.lit(over).cast("bigint"))


@query(
    "jsonl_lines",
    """
    SELECT '{"event_id":' || event_id || ',"half":' || event_id || '.5,"raw":"0x' || lower(hex(event_type)) || '","kind":'
           || CASE WHEN event_type = 'error' THEN 'null' ELSE '"' || event_type || '"' END || '}' AS value
    FROM events
    """,
)
def jsonl_lines(t):
    # The lines as they are in the files: 64-bit numbers are numbers, blobs are 0x and hex.
    path = work_path(t.spark, "jsonl")
    shown = t.events.select(
        "event_id", (F.col("event_id") + F.lit(0.5).cast("decimal(2,1)")).alias("half"),
        F.col("event_type").cast("binary").alias("raw"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"),
    )
    exports.export(shown, path, "jsonl")
    return t.spark.read.text(path)


@query("json_documents", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def json_documents(t):
    # Array documents of 100 rows, each one file that is read whole.
    path = work_path(t.spark, "json")
    exports.export(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), path, "json", max_records_per_file=100)
    return t.spark.read.schema("o_orderkey bigint, o_custkey bigint, o_totalprice double").option("multiLine", True).json(path)


@query("csv_null_marker", "SELECT event_id, nullif(event_type, 'error') AS event_type FROM events")
def csv_null_marker(t):
    path = work_path(t.spark, "csv")
    shown = t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"))
    exports.export(shown, path, "csv", header=False, delimiter="|", null_string="\\N", compression="gzip")
    back = files.read_csv(
        t.spark, path, header=False, columns=["event_id", "event_type"], delimiter="|", null_value="\\N"
    )
    return imports.typed_import(back, {"event_id": "bigint", "event_type": "text"})[0]


@query("jsonl_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(t):
    path = work_path(t.spark, "jsonl")
    exports.export(t.conversations, path, "jsonl")
    back = files.read_json(t.spark, path, as_text=True)
    return imports.typed_import(back, {"conv_id": "bigint", "turn": "bigint", "role": "text", "text": "text"})[0]


@query("json_array_round_trip", "SELECT page_id, url, html FROM pages")
def json_array_round_trip(t):
    path = work_path(t.spark, "json")
    exports.export(t.pages, path, "json", pretty=True)
    back = files.read_json(t.spark, path, mode="SINGLE_DOCUMENT", as_text=True)
    return imports.typed_import(back, {"page_id": "bigint", "url": "text", "html": "text"})[0]


@query("parquet_round_trip", "SELECT * FROM orders")
def parquet_round_trip(t):
    path = work_path(t.spark, "parquet")
    exports.export(t.orders, path, "parquet", split_keys=["o_custkey"], splits=32)
    return files.read_parquet(t.spark, path)


@query("xml_round_trip", "SELECT page_id, url, html FROM pages")
def xml_round_trip(t):
    path = work_path(t.spark, "xml")
    exports.export(t.pages, path, "xml", root="pages", row="page")
    back = exports.read_back(t.spark, path, "xml", row="page", schema=t.pages.schema)
    texts = back.select(*[F.col(f"{c}.`{exports.XML_TEXT}`").alias(c) for c in back.columns])
    return texts.withColumn("page_id", F.col("page_id").cast("bigint"))


@query("xml_nulls", "SELECT event_id, nullif(event_type, 'error') AS kind FROM events")
def xml_nulls(t):
    path = work_path(t.spark, "xml")
    shown = t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"))
    exports.export(shown, path, "xml")
    back = exports.read_back(t.spark, path, "xml", schema=shown.schema)
    kind = F.when(F.col(f"kind.`{exports.XML_NULL}`").isNull(), F.col(f"kind.`{exports.XML_TEXT}`"))
    return back.select(F.col(f"event_id.`{exports.XML_TEXT}`").cast("bigint").alias("event_id"), kind.alias("kind"))


@query(
    "export_report",
    """
    SELECT * FROM (SELECT 'csv' AS format UNION ALL SELECT 'jsonl' UNION ALL SELECT 'json' UNION ALL SELECT 'parquet'
                   UNION ALL SELECT 'xml') f, (SELECT count(*) AS rows FROM orders) o
    """,
)
def export_report(t):
    reports = [exports.export(t.orders, work_path(t.spark, fmt), fmt) for fmt in exports.FORMATS]
    return t.spark.createDataFrame([(r.format, r.rows) for r in reports], "format string, rows bigint")


@query(
    "export_query",
    "SELECT o_custkey, count(*)::VARCHAR AS orders FROM orders GROUP BY 1",
)
def export_query(t):
    path = work_path(t.spark, "query")
    exports.export_query(
        t.spark, "SELECT o_custkey, count(*) AS orders FROM exported GROUP BY o_custkey", path, "csv",
        views={"exported": t.orders},
    )
    return files.read_csv(t.spark, path).withColumn("o_custkey", F.col("o_custkey").cast("bigint"))


@query("export_query_capped", "SELECT least(count(*), 700) AS rows FROM lineitem")
def export_query_capped(t):
    report = exports.export_query(
        t.spark, "SELECT * FROM exported", work_path(t.spark, "query"), "jsonl", max_rows=700, views={"exported": t.lineitem}
    )
    return t.spark.createDataFrame([(report.rows,)], "rows bigint")


@query("dump_and_restore", "SELECT * FROM conversations")
def dump_and_restore(t):
    place, target = work_path(t.spark, "dump"), work_path(t.spark, "restore")
    exports.dump({"conversations": t.conversations, "region": t.region}, place)
    exports.restore(t.spark, place, target, ["conversations", "region"])
    return t.spark.read.parquet(f"{target}/conversations")


@query(
    "bulk_load",
    """
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus,
           o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'
    """,
)
def bulk_load(t):
    # Prices of one priority are broken; they are rejected and the other rows loaded.
    path, target = work_path(t.spark, "in"), work_path(t.spark, "table")
    broken = t.orders.withColumns(
        {
            "o_totalprice": F.when(F.col("o_orderpriority") == "5-LOW", "n/a").otherwise(F.col("o_totalprice").cast("string")),
            "o_orderstatus": F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
        }
    )
    exports.export(broken, path, "csv", verify=False)
    spec = TableSpec(("o_custkey",), ("o_orderkey",))
    types = {k: v for k, v in ORDER_TYPES.items() if k != "o_orderdate"}
    imports.load(files.read_csv(t.spark, path), target, types, spec, max_errors="60%")
    return read_buckets(t.spark, target)


@query(
    "bulk_load_new_table",
    "SELECT p_partkey AS id, p_name AS name, p_size AS size, p_retailprice AS price FROM part",
)
def bulk_load_new_table(t):
    # No types are given: the table takes those of the texts.
    path, target = work_path(t.spark, "in"), work_path(t.spark, "table")
    exports.export(t.part, path, "csv", verify=False)
    mapping = "p_partkey=id, p_name=name, p_size=size, p_retailprice=price"
    imports.load(files.read_csv(t.spark, path), target, None, TableSpec(("id",)), mapping)
    return read_buckets(t.spark, target).withColumn("id", F.col("id").cast("bigint"))


@query(
    "bulk_load_report",
    """
    SELECT step, status, read, loaded, rejected FROM (
      SELECT 1 AS step, 'DRY_RUN' AS status, count(*) AS read, 0 AS loaded, count(*) FILTER (WHERE l_returnflag = 'R') AS rejected FROM lineitem
      UNION ALL SELECT 2, 'ABORTED', count(*), 0, count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem
      UNION ALL SELECT 3, 'WITH_REJECTS', count(*), count(*) FILTER (WHERE l_returnflag <> 'R'), count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem)
    """,
)
def bulk_load_report(t):
    source = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("ok"), F.col("l_linenumber").cast("string").alias("ln"),
        F.when(F.col("l_returnflag") == "R", "broken").otherwise(F.col("l_quantity").cast("string")).alias("qty"),
    )
    spec = TableSpec(("order_key",), ("line",))
    types = {"order_key": "bigint", "line": "int", "quantity": "double"}
    mapping = "ok=order_key, ln=line, qty=quantity"
    target = work_path(t.spark, "table")
    runs = [
        imports.load(source, target, types, spec, mapping, dry_run=True, max_errors=-1),
        imports.load(source, target, types, spec, mapping, max_errors="1%"),
        imports.load(source, target, types, spec, mapping, max_errors=-1),
    ]
    rows = [(i + 1, r.status, r.read, r.loaded, r.rejected) for i, r in enumerate(runs)]
    return t.spark.createDataFrame(rows, "step int, status string, read bigint, loaded bigint, rejected bigint")


@query(
    "bulk_load_rejects",
    """
    SELECT event_id::VARCHAR || 'x' AS value, 'event_id' AS field,
           'Cannot read ''' || event_id || 'x'' as bigint' AS message FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'much', 'value', 'Cannot read ''much'' as double' FROM events WHERE event_type IN ('error', 'view')
    """,
)
def bulk_load_rejects(t):
    kind = F.col("event_type")
    source = t.events.select(
        F.concat(F.col("event_id").cast("string"), F.when(kind == "error", "x").otherwise("")).alias("event_id"),
        F.when(kind.isin("error", "view"), "much").otherwise(F.col("value").cast("string")).alias("value"),
        "event_type",
    )
    report = imports.load(
        source, work_path(t.spark, "table"), {"event_id": "bigint", "value": "double", "event_type": "text"},
        TableSpec(("event_id",)), max_errors="60%",
    )
    return imports.rejected(t.spark, report).select("field", "value", "message")


@query("wire_rendering", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_totalprice FROM orders")
def wire_rendering(t):
    return render_wire(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"))
