import glob
import gzip
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from keyspan.functions.udfs import Aggregate, apply_aggregate, make_function, register_function
from keyspan.operators.buckets import read_buckets
from keyspan.model import KeyspanError, TableSpec
from keyspan.sources import exports, files
from keyspan.streaming import streams

ROWS = [(1, "Ann", "a,b"), (2, 'Q "x"', "two\nlines"), (3, None, ""), (4, " pad ", "#4\r")]
DDL = "id int, name string, note string"


def read(path, suffix="*"):
    return [open(p, newline="").read() for p in sorted(glob.glob(f"{path}/part-{suffix}"))]


def one(spark):
    return spark.createDataFrame(ROWS, DDL).coalesce(1)


def test_csv_quotes_only_where_needed(spark, place):
    path = place()
    assert exports.export(one(spark), path, "csv").rows == 4
    text = read(path)[0]
    assert text == 'id,name,note\n1,Ann,"a,b"\n2,"Q ""x""","two\nlines"\n3,,\n4, pad ,"#4\r"\n'


def test_csv_options(spark, place):
    path = place()
    exports.export(one(spark), path, "csv", columns=["name", "id"], header=False, delimiter=";", null_string="NULL")
    assert read(path)[0] == 'Ann;1\n"Q ""x""";2\nNULL;3\n pad ;4\n'


def test_json_lines_keep_order_and_nulls(spark, place):
    path = place()
    exports.export(one(spark), path, "jsonl", columns=["name", "id"])
    assert read(path)[0].splitlines()[2] == '{"name":null,"id":3}'
    empty = place()
    assert exports.export(one(spark).where("id > 9"), empty, "jsonl").rows == 0
    assert "".join(read(empty)) == ""


@pytest.mark.parametrize("pretty", [False, True])
def test_every_part_is_one_json_array(spark, place, pretty):
    path = place()
    df = spark.range(1000).select("id", F.lit("é\"x").alias("t")).repartition(3)
    assert exports.export(df, path, "json", pretty=pretty).rows == 1000
    parts = [json.loads(t) for t in read(path)]
    assert sum(len(p) for p in parts) == 1000 and all(isinstance(p, list) for p in parts)
    empty = place()
    exports.export(df.where("id < 0"), empty, "json")
    assert all(json.loads(t) == [] for t in read(empty))


def test_parquet_keeps_types(spark, place):
    path = place()
    df = spark.createDataFrame([(1, "a", 1.5, True, b"\x00", [1.0], None)], "id bigint, n string, s double, ok boolean, b binary, v array<float>, x int")
    exports.export(df, path, "parquet")
    back = spark.read.parquet(path)
    assert back.schema == df.schema and back.collect() == df.collect()
    assert all(".snappy." in p for p in glob.glob(f"{path}/part-*"))


def test_xml_nulls_names_and_escapes(spark, place):
    path = place()
    df = spark.createDataFrame([(1, None, "a<b>&\"'", [1])], "`1st` int, `a b` string, t string, l array<int>").coalesce(1)
    exports.export(df, path, "xml", root="data set", row="entry")
    root = ET.fromstring(read(path)[0])
    assert root.tag == "data_set"
    row = root.find("entry")
    assert row.find("_1st").text == "1" and row.find("a_b").attrib == {"null": "true"} and row.find("a_b").text is None
    assert row.find("t").text == "a<b>&\"'" and row.find("l").text == "[1]"


def test_element_names():
    assert [exports.element_name(c) for c in ("ok", "a.b", ".a", "9x", "", "x y", "-d", "é")] == [
        "ok", "a.b", "_.a", "_9x", "_", "x_y", "_-d", "é"
    ]


def test_equal_element_names_are_numbered(spark, place):
    path = place()
    df = spark.createDataFrame([(1, 2, 3, None)], "`a b` int, a_b int, `A-b` int, `A:B` int").coalesce(1)
    report = exports.export(df, path, "xml")
    row = ET.fromstring(read(path)[0]).find("row")
    assert [(c.tag, c.text) for c in row] == [("a_b", "1"), ("a_b_2", "2"), ("A-b", "3"), ("A_B_3", None)]
    assert len(report.warnings) == 3


def test_nothing_is_written_when_arguments_are_refused(spark, place):
    for fmt, keys in (("csv", ["id"]), ("xml", ["id"]), ("parquet", ["nope"])):
        path = place()
        with pytest.raises(KeyspanError):
            exports.export(one(spark), path, fmt, split_keys=keys)
        assert not glob.glob(f"{path}*")


@pytest.mark.parametrize("pretty", [False, True])
def test_json_documents_roll(spark, place, pretty):
    path = place()
    report = exports.export(spark.range(25).coalesce(1), path, "json", pretty=pretty, max_records_per_file=10)
    found = [json.loads(text) for text in read(path)]
    assert report.rows == 25 and sorted(len(d) for d in found) == [5, 10, 10]
    assert sorted(r["id"] for d in found for r in d) == list(range(25))


def test_json_in_the_export_form(spark, place):
    path = place()
    exports.export(spark.sql("SELECT 5000000000 AS a, unhex('0AFF') AS b").coalesce(1), path, "jsonl")
    assert read(path) == ['{"a":5000000000,"b":"0x0aff"}\n']


def test_compression_and_rolling(spark, place):
    path = place()
    exports.export(spark.range(100).coalesce(1), path, "csv", compression="gzip", max_records_per_file=30)
    parts = glob.glob(f"{path}/part-*.csv.gz")
    assert len(parts) == 4 and sum(len(gzip.open(p).read().splitlines()) - 1 for p in parts) == 100


@pytest.mark.parametrize("fmt", exports.FORMATS)
def test_every_format_writes_the_same_number_of_rows(spark, place, fmt):
    hot = spark.range(2000).select(F.lit("HOT").alias("k"), "id", F.lit("x\ny").alias("t"))
    cold = spark.range(200).select((F.col("id") % 50).cast("string").alias("k"), "id", F.lit(None).cast("string").alias("t"))
    df = hot.unionByName(cold)
    report = exports.export(df, place(), fmt, split_keys=["k"] if fmt in ("parquet", "jsonl", "json") else None, splits=16)
    assert report.rows == 2200 and report.splits in (0, 16)


def test_a_lost_file_is_noticed(spark, place, monkeypatch):
    real = exports.read_back
    monkeypatch.setattr(exports, "read_back", lambda *a, **k: real(*a, **k).where(F.col("id") != 3))
    with pytest.raises(KeyspanError, match="4 rows were read but 3"):
        exports.export(one(spark), place(), "parquet")


def test_unknown_format_and_column(spark, place):
    with pytest.raises(KeyspanError):
        exports.export(one(spark), place(), "xlsx")
    with pytest.raises(KeyspanError):
        exports.export(one(spark), place(), "csv", columns=["nope"])


def test_query_export_cap(spark, place):
    views = {"src": spark.range(50)}
    assert exports.export_query(spark, "SELECT * FROM src", place(), "csv", views=views).rows == 50
    assert exports.export_query(spark, "SELECT * FROM src", place(), "csv", 7, views=views).rows == 7


def test_dump_and_restore(spark, place):
    df = one(spark)
    folder, target = place("dump"), place("target")
    report = exports.dump({"t": df, "u": spark.range(3)}, folder).collect()
    assert {(r["table"], r["rows"]) for r in report} == {("t", 4), ("u", 3)}
    exports.restore(spark, folder, target, ["t", "u"])
    back = spark.read.parquet(f"{target}/t")
    assert back.schema == df.schema and sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    with pytest.raises(KeyspanError, match="exists"):
        exports.restore(spark, folder, target, ["t"])
    exports.restore(spark, folder, target, ["t"], mode="SCHEMA_ONLY", drop_existing=True)
    assert spark.read.parquet(f"{target}/t").count() == 0
    schema_only = place("schema")
    assert exports.dump({"t": df}, schema_only, "SCHEMA_ONLY").first()["rows"] is None


# --- user functions -------------------------------------------------------------------------------


def test_functions_and_null_handling(spark):
    df = spark.createDataFrame([(1, 2), (None, 3)], "a int, b int")
    strict = make_function(lambda a, b: a + b, "int", "RETURNS NULL ON NULL INPUT")
    called = make_function(lambda a, b: -1 if a is None else a + b, "int")
    assert [tuple(r) for r in df.select(strict("a", "b"), called("a", "b")).collect()] == [(3, 3), (None, -1)]
    register_function(spark, "plus_one", lambda a: a + 1, "int", "RETURNS NULL ON NULL INPUT")
    assert spark.sql("SELECT plus_one(4), plus_one(CAST(NULL AS INT))").first() == (5, None)
    with pytest.raises(KeyspanError):
        make_function(len, "int", "SOMETIMES")


def test_aggregate_folds_a_hot_key_in_many_tasks(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), "id").repartition(8)
    total = Aggregate(lambda s, v: s + v, 0, lambda a, b: a + b, "bigint", final=lambda s: -s, return_type="bigint")
    got = {r["k"]: r["r"] for r in apply_aggregate(df, ["k"], ["id"], total, "r", open_groups=40).collect()}
    want = {r["k"]: -r["s"] for r in df.groupBy("k").agg(F.sum("id").alias("s")).collect()}
    assert got == want
    assert apply_aggregate(df, [], ["id"], total, "r").first()["r"] == -sum(range(20_000))


# --- streams --------------------------------------------------------------------------------------


def collect_updates(df, place):
    out = []
    query = (
        df.writeStream.outputMode("update").foreachBatch(lambda b, n: out.append(b.collect()))
        .option("checkpointLocation", place("checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return out


def file_stream(spark, place, batches, ddl):
    folder = place("stream")
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(folder)
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(folder)


def test_stream_totals(spark, place):
    source = file_stream(spark, place, [[("a", 1), ("b", 2)], [("a", 5)]], "k string, n bigint")
    updates = collect_updates(streams.stream_counters(source, ["k"], ["n"]), place)
    assert {tuple(r) for r in updates[-1]} <= {("a", 6), ("b", 2)} and {r["k"]: r["n"] for b in updates for r in b} == {"a": 6, "b": 2}


def test_stream_latest_ignores_older_rows_and_forgets(spark, place):
    ddl = "k string, at timestamp, v int"
    import datetime as dt

    t = lambda minute: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute)
    batches = [[("a", t(10), 1), ("a", t(20), 2)], [("a", t(15), 9), ("b", t(21), 3)], [("c", t(600), 4)], [("c", t(601), 5)]]
    source = file_stream(spark, place, batches, ddl)
    updates = [r for b in collect_updates(streams.stream_latest(source, ["k"], "at", 3600, "1 hour"), place) for r in b]
    assert [(r["k"], r["v"]) for r in updates] == [("a", 2), ("b", 3), ("c", 4), ("c", 5)]


def test_latest_by_arrival_decides_ties_by_row_and_ignores_rows_without_a_time(spark, place):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    ddl = "k string, at timestamp, v int, m map<string,int>"
    rows = [("a", t, 1, {"x": 1}), ("a", t, 2, None), ("a", None, 9, None), (None, t, 4, None), (None, t + dt.timedelta(days=900), 5, None)]
    seen = []
    # Time of arrival passes without data, so a run to the end must not wait for batches without any.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        for batches in ([rows], [rows[1:], rows[:1]]):
            source = file_stream(spark, place, batches, ddl)
            out = collect_updates(streams.stream_latest(source, ["k"], "at", 3600, lifetime="arrival"), place)
            seen.append({r["k"]: (r["v"], r["at"]) for b in out for r in b})
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert all(s == seen[0] for s in seen) and seen[0][None][0] == 5 and seen[0]["a"][0] in (1, 2)
    with pytest.raises(KeyspanError):
        streams.stream_latest(source, ["k"], "at", 3600, lifetime="never")


def test_a_task_passes_on_one_row_per_key(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    key = np.where(rng.random(50_000) < 0.33, -1, rng.integers(0, 3000, 50_000))
    table = pa.table({"k": key, streams._AT: rng.integers(0, 1000, 50_000), streams._TIE: rng.integers(0, 9, 50_000), "v": np.arange(50_000)})
    frame = table.to_pandas().sort_values([streams._AT, streams._TIE])
    want = frame.groupby("k")[[streams._AT, streams._TIE]].last().sort_index()
    for limit, hot in ((1 << 25, 1), (40_000, 50)):
        monkeypatch.setattr(streams, "HELD_BYTES", limit)
        got = pa.Table.from_batches(streams._latest_of_task(iter(table.to_batches(1000)), ["k"])).to_pandas()
        assert (got["k"] == -1).sum() <= hot
        top = got.sort_values([streams._AT, streams._TIE]).groupby("k")[[streams._AT, streams._TIE]].last().sort_index()
        assert top.equals(want)


def test_stream_load_keeps_rejects_and_resumes(spark, place):
    incoming, target, checkpoint = place("in"), place("table"), place("checkpoint")
    types = {"id": "int", "v": "double"}
    reports = []
    run = lambda: streams.stream_load(
        spark, incoming, target, types, TableSpec("id"), checkpoint, reports=reports
    ).start().awaitTermination()
    spark.createDataFrame([("1", "1.5"), ("2", "x")], "id string, v string").coalesce(1).write.csv(incoming, header=True)
    run()
    spark.createDataFrame([("1", "2.5"), ("3", "3")], "id string, v string").coalesce(1).write.mode("append").csv(incoming, header=True)
    run()
    assert sorted(tuple(r) for r in read_buckets(spark, target).collect()) == [(1, 2.5), (3, 3.0)]
    assert [r.status for r in reports] == ["WITH_REJECTS", "SUCCESS"]


def test_stream_windows(spark, place):
    import datetime as dt

    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    source = file_stream(spark, place, [[("a", t(1)), ("a", t(2)), ("a", t(11))], [("a", t(3))]], "k string, at timestamp")
    updates = collect_updates(streams.stream_partition_counts(source, ["k"], "at", "10 minutes", "30 minutes"), place)
    last = {(r["window_start"].minute, r["k"]): r["rows"] for b in updates for r in b}
    assert last == {(0, "a"): 3, (10, "a"): 1}


def test_sources_read_what_sinks_write(spark, place):
    path = place()
    exports.export(one(spark), path, "csv")
    assert files.read_csv(spark, path, empty_value="").count() == 4


def test_single_column_csv_keeps_empty_rows(spark, place):
    path = place()
    df = spark.createDataFrame([("a",), (None,), ("",), ("#x",)], "t string").coalesce(1)
    assert exports.export(df, path, "csv").rows == 4
    assert read(path)[0] == 't\na\n""\n""\n#x\n'
    assert files.read_csv(spark, path).count() == 4


def test_hash_sign_is_no_comment(spark, place):
    path = place()
    df = spark.createDataFrame([("#a", "x"), ("b\\", "#")], "t string, u string").coalesce(1)
    exports.export(df, path, "csv", header=False)
    assert read(path)[0] == "#a,x\nb\\,#\n"
    assert {tuple(r) for r in files.read_csv(spark, path, header=False).collect()} == {("#a", "x"), ("b\\", "#")}


def test_files_roll_at_about_the_asked_size(spark, place):
    path = place()
    df = spark.range(2000).select(F.lit("x" * 89).alias("t")).coalesce(1)
    exports.export(df, path, "jsonl", max_file_bytes=20_000)
    sizes = [len(t) for t in read(path)]
    assert len(sizes) == 10 and max(sizes) <= 22_000


@pytest.mark.parametrize("fmt", ["csv", "jsonl", "json"])
def test_files_end_before_the_row_that_would_pass_the_limit(spark, place, fmt):
    i = F.col("id")
    texts = F.when(i % 50 == 0, None).when(i % 50 == 1, "").when(i % 50 == 2, 'a,"b"\nc\r').when(i % 50 == 3, "\u00e9" * 40)
    df = spark.range(3000).select(
        "id", texts.otherwise(F.repeat(F.lit("x"), F.when(i > 2500, 400).otherwise(9).cast("int"))).alias("t, u")
    ).coalesce(1)
    plain, rolled = place(), place()
    exports.export(df, plain, fmt)
    assert exports.export(df, rolled, fmt, max_file_bytes=20_000).rows == 3000
    sizes = [len(t.encode()) for t in read(rolled)]
    assert max(sizes) <= 20_000 and sorted(sizes)[1] >= 18_000 and len(sizes) > 10
    if fmt == "json":
        docs = [json.loads(t) for t in read(rolled)]
        assert sorted((r for d in docs for r in d), key=lambda r: r["id"]) == json.loads(read(plain)[0])
    else:
        head = read(plain)[0].split("\n", 1)[0] + "\n" if fmt == "csv" else ""
        body = sorted(t.removeprefix(head) for t in read(rolled))
        assert sorted("".join(body)) == sorted(read(plain)[0].removeprefix(head))
        assert all(t.removeprefix(head) in read(plain)[0] and t.startswith(head) for t in read(rolled))


@pytest.mark.parametrize("fmt", ["csv", "jsonl", "json"])
def test_rows_longer_than_a_file_and_no_rows_at_all(spark, place, fmt):
    df = spark.range(5).select("id", F.repeat(F.lit("y"), 500).alias("t")).coalesce(1)
    path = place()
    assert exports.export(df, path, fmt, max_file_bytes=100).rows == 5 and len(read(path)) == 5
    path = place()
    assert exports.export(df.limit(0), path, fmt, max_file_bytes=100).rows == 0
