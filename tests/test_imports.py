import csv
import datetime as dt
import os
import random
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keyspan.functions.parsing import parse, spark_type, timeuuid_ts
from keyspan.model import Codec, KeyspanError, MissingKeyError, TableSpec
from keyspan.operators.buckets import read_buckets
from keyspan.sources import files, imports


def value(spark, text, kind, codec=Codec()):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(parse(F.col("t"), kind, codec).alias("v")).first()["v"]


UTC = dt.datetime(2024, 2, 29, 12, 30, 15)
GOOD = [
    ("int", " 42 ", 42), ("int", "+7", 7), ("bigint", "9223372036854775807", 2**63 - 1), ("tinyint", "-128", -128),
    ("varint", "0" * 3 + "9" * 39, "9" * 39), ("varint", "-0012", "-12"), ("decimal(10,2)", "12.34", Decimal("12.34")),
    ("double", "1e3", 1000.0), ("boolean", "yes", True), ("boolean", "F", False), ("boolean", "0", False), ("boolean", "1.0", True),
    ("timestamp", "2024-02-29T12:30:15Z", UTC), ("timestamp", "1709209815000", UTC), ("date", "2024-02-29", dt.date(2024, 2, 29)),
    ("time", "23:59:59.123456789", 86399123456789), ("time", "01:02", 3720 * 10**9),
    ("uuid", "8F2B1C6E-2A55-4F47-9F2A-4C1C3F0D9A11", "8f2b1c6e-2a55-4f47-9f2a-4c1c3f0d9a11"),
    ("inet", "127.0.0.1", "127.0.0.1"), ("inet", "::1", "::1"), ("blob", "0xCAFE", b"\xca\xfe"), ("blob", "aGk=", b"hi"),
    ("duration", "1y2mo3w4d5h6m7s8ms9us10ns", (14, 25, 18367008009010)), ("duration", "P1Y2M3DT4H5M6.5S", (14, 3, 14706500000000)),
    ("duration", "-2mo3s", (-2, 0, -3 * 10**9)), ("duration", "PT36H", (0, 0, 129600 * 10**9)),
    ("list<int>", "[1,2,2]", [1, 2, 2]), ("set<text>", '["b","a","b"]', ["a", "b"]), ("map<text,int>", '{"a":1}', {"a": 1}),
    ("tuple<text,int>", '["x",3]', ("x", 3)), ("vector<float,2>", "[0.5,1]", [0.5, 1.0]), ("frozen<list<text>>", '["q"]', ["q"]),
    ("list<tuple<text,int>>", '[["x",1],["y",null]]', [("x", 1), ("y", None)]), ("list<int>", "[]", []), ("list<int>", "[1,null]", [1, None]),
    ("map<int,text>", '[{"key":1,"value":"a"}]', {1: "a"}), ("map<int,text>", '{"2":"b"}', {2: "b"}), ("set<int>", "[3,1,3]", [1, 3]),
    ("udt<street:text, geo:tuple<double,double>>", '{"street":"S","geo":[1.5,2]}', ("S", (1.5, 2.0))),
    ("udt<a:int,b:list<blob>>", '{"b":["0x01"]}', (None, [b"\x01"])), ("map<text,list<int>>", '{"a":[1]}', {"a": [1]}),
    ("text", "  kept ", "  kept "), ("ascii", "abc", "abc"),
]
BAD = [
    ("int", "1.5"), ("int", "2147483648"), ("tinyint", "200"), ("int", ""), ("double", "abc"), ("boolean", "maybe"),
    ("timestamp", "yesterday"), ("date", "2024-02-30"), ("date", "2024-2-3"), ("time", "24:00"), ("uuid", "8f2b1c6e"),
    ("timeuuid", "8f2b1c6e-2a55-4f47-9f2a-4c1c3f0d9a11"), ("inet", "256.1.1.1"), ("blob", "0xABC"), ("duration", "soon"),
    ("duration", "P"), ("list<int>", "1,2"), ("vector<float,2>", "[1,2,3]"), ("vector<float,2>", "[1,null]"), ("varint", "1.0"), ("ascii", "ä"),
    ("list<int>", '[1,"x"]'), ("tuple<int,int>", "[1,2,3]"), ("tuple<int,int>", '["x",2]'), ("map<int,text>", '{"x":"b"}'),
    ("udt<a:int>", "[1]"), ("udt<a:int>", '{"a":"x"}'), ("list<uuid>", '["no"]'), ("map<text,int>", '{"a":"x"}'),
]


@pytest.mark.parametrize("kind,text,want", GOOD)
def test_values_are_read(spark, kind, text, want):
    got = value(spark, text, kind)
    assert (tuple(got) if isinstance(want, tuple) else bytes(got) if isinstance(want, bytes) else got) == want


@pytest.mark.parametrize("kind,text", BAD)
def test_other_texts_give_null(spark, kind, text):
    assert value(spark, text, kind) is None


def test_codec_options(spark):
    assert value(spark, "1,234,567", "int", Codec(format_numbers=True)) == 1234567
    assert value(spark, "12,34", "int", Codec(format_numbers=True)) is None
    rounded = {m: [value(spark, t, "int", Codec(rounding=m)) for t in ("2.5", "-2.5", "2.4", "3")] for m in (
        "UNNECESSARY", "FLOOR", "CEILING", "UP", "DOWN", "HALF_UP", "HALF_DOWN", "HALF_EVEN")}
    assert rounded == {
        "UNNECESSARY": [None, None, None, 3], "FLOOR": [2, -3, 2, 3], "CEILING": [3, -2, 3, 3], "UP": [3, -3, 3, 3],
        "DOWN": [2, -2, 2, 3], "HALF_UP": [3, -3, 2, 3], "HALF_DOWN": [2, -2, 2, 3], "HALF_EVEN": [2, -2, 2, 3],
    }
    assert value(spark, "300", "tinyint", Codec(overflow="TRUNCATE")) == 127
    assert value(spark, "-300", "tinyint", Codec(overflow="TRUNCATE")) == -128
    assert value(spark, "on", "boolean", Codec(boolean_strings=("on:off",))) is True
    assert value(spark, "ff", "blob", Codec(binary="HEX")) == b"\xff"
    assert value(spark, "29/02/2024 12:30:15", "timestamp", Codec(timestamp="dd/MM/yyyy HH:mm:ss")) == UTC
    assert value(spark, "2", "timestamp", Codec(unit="DAYS", epoch="2024-01-01T00:00:00Z")) == dt.datetime(2024, 1, 3)
    assert value(spark, "2024-02-29T13:30:15", "timestamp", Codec(time_zone="Europe/Berlin")) == UTC
    assert value(spark, "2024-02-29T12:30:15Z", "timestamp", Codec(time_zone="Europe/Berlin")) == UTC
    assert value(spark, "12h30", "time", Codec(time="HH'h'mm")) == (12 * 60 + 30) * 60 * 10**9
    assert value(spark, "N/A", "int", Codec(null_strings=("N/A",))) is None


def test_types():
    assert spark_type("map<text, frozen<list<tuple<int, text>>>>") == "map<string,array<struct<_1:int,_2:string>>>"
    assert spark_type("vector<float, 1536>") == "array<float>"
    with pytest.raises(KeyspanError):
        spark_type("geometry")


def test_timeuuid(spark):
    made = [uuid.uuid1() for _ in range(5)]
    df = spark.createDataFrame([(str(u),) for u in made] + [(str(uuid.uuid4()),), (None,), ("x",)], "u string")
    got = [r[0] for r in df.select(F.unix_millis(timeuuid_ts(F.col("u")))).collect()]
    assert got == [(u.time - 122192928000000000) // 10000 for u in made] + [None, None, None]


def test_failed_cells_become_error_rows_and_nulls_do_not(spark):
    df = spark.createDataFrame([("1", "2024-01-01", "a"), ("x", "bad", None), (None, None, "N/A")], "n string, d string, t string")
    good, errors = imports.typed_import(df, {"n": "int", "d": "date", "t": "text"}, Codec(null_strings=("N/A",)))
    assert [tuple(r) for r in good.collect()] == [(1, dt.date(2024, 1, 1), "a"), (None, None, None)]
    rows = {(r["field"], r["value"], r["message"]) for r in errors.collect()}
    assert rows == {("n", "x", "Cannot read 'x' as int"), ("d", "bad", "Cannot read 'bad' as date")}


def test_texts_are_parsed_once(spark, place):
    path = place()
    spark.createDataFrame([("1",)], "n string").write.parquet(path)
    good, _ = imports.typed_import(spark.read.parquet(path), {"n": "int"})
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert plan.count("try_cast") == 1


def test_mapping(spark):
    df = spark.createDataFrame([("1", "m", "z")], "user_id string, mail string, legacy string")
    assert imports.parse_mapping("user_id=user_id, mail = email,, =x, y=") == {"user_id": "user_id", "mail": "email"}
    assert imports.mapping_text({"a": "x", "": "q"}) == "a=x"
    got = imports.map_fields(df, "0=id, mail=email", ["email", "id"])
    assert got.columns == ["email", "id"] and tuple(got.first()) == ("m", "1")
    with pytest.raises(KeyspanError, match="without a column"):
        imports.map_fields(df, None, ["user_id"], allow_extra=False)
    with pytest.raises(KeyspanError, match="without a source"):
        imports.map_fields(df, None, ["user_id", "phone"])
    assert imports.map_fields(df, None, ["USER_ID", "phone"], allow_missing=True).columns == ["USER_ID"]
    for bad in ("nope=id", "mail=nope", "mail=id, legacy=id"):
        with pytest.raises(KeyspanError):
            imports.map_fields(df, bad, ["id"], allow_missing=True)


def test_preview(spark):
    df = spark.createDataFrame([("1", "a@x", "q"), ("zz", "b@x", "r")], "user_id string, mail string, old string")
    preview = imports.preview_import(
        df, {"user_id": "int", "email": "text", "at": "timestamp"}, TableSpec("user_id", "at"), "user_id=user_id, mail=email"
    )
    assert preview.unmapped_fields == ["old"] and preview.missing_key_columns == ["at"]
    assert [tuple(r) for r in preview.sample_rows.collect()] == [(1, "a@x")]
    assert preview.errors.first()["field"] == "user_id" and preview.rows.first()["rows"] == 2
    kinds = {r["field"]: r["inferred_type"] for r in preview.fields.collect()}
    assert kinds == {"user_id": "text", "mail": "text", "old": "text"}


def test_inference(spark):
    df = spark.createDataFrame(
        [("1", "1", "1.5", "true", "", "9" * 30, "2024-01-01", None, "8f2b1c6e-2a55-4f47-9f2a-4c1c3f0d9a11"),
         ("-2", "3000000000", "2", "FALSE", "2024-01-01 10:00", "1", "2024-12-31", None, "8f2b1c6e-2a55-4f47-9f2a-4c1c3f0d9a12")],
        "a string, b string, c string, d string, e string, f string, g string, h string, i string",
    )
    rows = imports.infer_schema(df).orderBy("index").collect()
    assert [r["inferred_type"] for r in rows] == ["int", "bigint", "double", "boolean", "timestamp", "varint", "date", "text", "uuid"]
    assert [r["nullable"] for r in rows] == [False, False, False, False, True, False, False, True, False]


def test_null_words(spark):
    df = spark.createDataFrame([("NULL", "x"), (" n/a ", "y"), ("\\N", None)], "a string, b string")
    assert {r["field"]: r["words"] for r in imports.sniff_nulls(df).collect()} == {"a": ["NULL", "n/a", "\\N"], "b": []}


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", newline="") as out:
        out.write(text)


def test_csv_source(spark, place):
    folder = place("csv")
    write(folder, "a.csv", 'id,name\n1,"Doe, ""J"""\n2,"two\nlines"\n3\n')
    write(folder, "b.txt", "id,name\n9,no\n")
    rows = files.read_csv(spark, folder, pattern="*.csv").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", 'Doe, "J"'), ("2", "two\nlines"), ("3", None)]
    folder = place("pos")
    write(folder, "x.csv", "# note\n 1 ;'a;b';NA\n2;;z\n")
    df = files.read_csv(spark, folder, header=False, delimiter=";", quote="'", comment="#", null_value="NA", trim_leading=True, trim_trailing=True)
    assert df.columns == ["0", "1", "2"]
    assert sorted(tuple(r) for r in df.collect()) == [("1", "a;b", None), ("2", None, "z")]


def test_many_files_and_url_list(spark, place):
    folder = place("many")
    write(os.path.join(folder, "x"), "1.csv", "k\n1\n")
    write(os.path.join(folder, "y"), "2.csv", "k\n2\n")
    assert files.read_csv(spark, folder, recursive=True).count() == 2
    write(folder, "list.urls", f"# list\n{folder}/x/1.csv\n\n{folder}/y/2.csv\n")
    assert files.read_csv(spark, url_file=f"{folder}/list.urls").count() == 2


def test_json_source(spark, place):
    folder = place("json")
    write(folder, "lines.json", '{"a":1,"b":"x"}\n{"a":2}\n')
    assert files.read_json(spark, folder, as_text=True).orderBy("a").first()["a"] == "1"
    folder = place("doc")
    write(folder, "doc.json", '[\n {"a":1},\n {"a":2}\n]')
    assert files.read_json(spark, folder, mode="SINGLE_DOCUMENT").count() == 2
    with pytest.raises(KeyspanError):
        files.read_json(spark, folder, mode="ROWS")


def test_records_are_skipped_per_file(spark, place):
    folder = place("parts")
    spark.range(0, 1000, 1, 3).write.option("maxRecordsPerFile", 200).parquet(folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = spark.read.parquet(folder)
        whole = df.select("id", F.col("_metadata.file_path").alias("f")).collect()
        by_file = {}
        for r in whole:
            by_file.setdefault(r["f"], []).append(r["id"])
        want = sorted(i for ids in by_file.values() for i in sorted(ids)[10:60])
        assert sorted(r["id"] for r in files.window_records(df, 10, 50).collect()) == want
        assert files.window_records(df, 0, -1).count() == 1000
        assert files.window_records(df, 0, 0).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_records_of_a_file_read_in_blocks(spark, place):
    folder = place("lines")
    write(folder, "big.csv", "".join(f"{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        df = files.read_csv(spark, folder, header=False, columns=["n"], multiline=False)
        assert df.select("_metadata.file_block_start").distinct().count() > 3
        kept = [int(r["n"]) for r in files.window_records(df, 1200, 2500).collect()]
        assert sorted(kept) == list(range(1200, 3700))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


SPEC = TableSpec("id")
TYPES = {"id": "int", "email": "text", "age": "int"}


def test_load_upserts_and_later_records_win(spark, place):
    target = place("table")
    first = spark.createDataFrame([("1", "a", "5"), ("2", "b", "6")], "id string, email string, age string")
    report = imports.load(first, target, TYPES, SPEC)
    assert (report.status, report.read, report.loaded, report.rejected) == ("SUCCESS", 2, 2, 0)
    second = spark.createDataFrame([("2", None, "7"), ("3", "x", None), ("3", "c", None)], "id string, email string, age string").coalesce(1)
    imports.load(second, target, TYPES, SPEC)
    assert sorted(tuple(r) for r in read_buckets(spark, target).collect()) == [(1, "a", 5), (2, "b", 7), (3, "c", None)]
    imports.load(second.limit(1), target, TYPES, SPEC, null_to_unset=False)
    assert (2, None, 7) in {tuple(r) for r in read_buckets(spark, target).collect()}


def test_load_budget(spark, place):
    target = place("table")
    df = spark.createDataFrame([(str(i) if i % 4 else "bad", "m", "1") for i in range(1, 21)], "id string, email string, age string")
    assert imports.load(df, target, TYPES, SPEC, max_errors=4).status == "ABORTED"
    assert imports.load(df, target, TYPES, SPEC, max_errors="24%").status == "ABORTED"
    assert not os.path.exists(target)
    dry = imports.load(df, target, TYPES, SPEC, max_errors=5, dry_run=True)
    assert dry.status == "DRY_RUN" and dry.rejected == 5 and not os.path.exists(target)
    done = imports.load(df, target, TYPES, SPEC, max_errors="25%")
    assert done.status == "WITH_REJECTS" and done.loaded == 15 and read_buckets(spark, target).count() == 15
    assert imports.rejected(spark, done).select("field", "value").distinct().first() == ("id", "bad")


def test_record_without_key_is_rejected(spark, place):
    df = spark.createDataFrame([(None, "m", "1"), ("1", "n", "2")], "id string, email string, age string")
    report = imports.load(df, place("table"), TYPES, SPEC)
    assert (report.loaded, report.rejected) == (1, 1)
    assert imports.rejected(spark, report).first()["message"] == "the key is incomplete"
    with pytest.raises(MissingKeyError):
        imports.load(df.drop("id"), place("other"), TYPES, SPEC, allow_missing=True)


def test_load_of_nothing_makes_an_empty_table(spark, place):
    target = place("table")
    df = spark.createDataFrame([], "id string, email string, age string")
    report = imports.load(df, target, TYPES, SPEC)
    assert (report.status, report.read) == ("SUCCESS", 0)
    table = read_buckets(spark, target)
    assert table.count() == 0 and table.columns == ["id", "email", "age"]


def test_load_with_inferred_types(spark, place):
    target = place("table")
    df = spark.createDataFrame([("1", "x", "2024-01-01"), ("2", "y", "2024-01-02")], "id string, name string, day string")
    imports.load(df, target, None, TableSpec("key"), "0=key, day=day")
    assert dict(read_buckets(spark, target).dtypes) == {"key": "int", "day": "date"}


def test_staging_folder_keeps_rejects(spark, place):
    target, staging = place("table"), place("staging")
    df = spark.createDataFrame([("1", "m", "x")], "id string, email string, age string")
    report = imports.load(df, target, TYPES, SPEC, staging=staging)
    assert report.rejects_path.startswith(staging) and report.status == "WITH_REJECTS"


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        ("decimal", ["1.2345678901", "1e3", "12", "0.50000000000000", "1.5E-9", "-0", "100000000000"], ["1.23456789012", "1e-11", "x", ""]),
        ("decimal(4,1)", ["99.9", "1.0000", "1.25e1", "120"], ["1.25", "12345", "1e-2"]),
        ("double", ["1", "1.", ".5", "-1e3", "NaN", "Infinity"], ["1d", "1f", "0x1p3", "1e"]),
        ("inet", ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1::8", "10.0.0.1"], [":::", "1::2::3", "12345::", "1:2:3:4:5:6:7", "256.1.1.1", "1:2:3:4:5:6:7:8:9"]),
        ("map<int,text>", ['{"1":"a","2":"b"}', "{}"], ['{"1":"a","01":"b"}', '{"x":"a"}']),
    ],
)
def test_texts_that_are_kept_and_texts_that_are_refused(spark, kind, good, bad):
    df = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad], "t string, ok boolean")
    rows = df.select("t", "ok", parse(F.col("t"), kind).isNotNull().alias("read")).collect()
    assert [(r["t"], r["read"]) for r in rows] == [(r["t"], r["ok"]) for r in rows]


def test_truncation_bounds_numbers_only(spark):
    texts = {"abc": None, "NaN": None, "1.9": None, "99999999999": 2**31 - 1, "-" + "9" * 60: -(2**31), "7": 7, "": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["n"] for r in df.select("t", parse(F.col("t"), "int", Codec(overflow="TRUNCATE")).alias("n")).collect()}
    assert got == texts


def test_leading_zeros_are_text(spark):
    df = spark.createDataFrame([("00123", "0", "2024-01-01", "0.5"), ("00456", "12", "0024-02-01", "1")], "zip string, n string, d string, x string")
    assert imports.inferred_types(df) == {"zip": "text", "n": "int", "d": "date", "x": "double"}


def test_preview_shows_samples(spark):
    df = spark.createDataFrame([("1", " x "), ("2", ""), ("3", None), ("4", "y")], "id string, t string").coalesce(1)
    preview = imports.preview_import(df, {"id": "int", "t": "text"}, SPEC, n=4)
    assert {r["field"]: r["samples"] for r in preview.fields.collect()} == {"id": ["1", "2", "3"], "t": ["x", "y"]}
    assert preview.rows.first()[0] == 4 and preview.missing_key_columns == [] and preview.mapping == {"id": "id", "t": "t"}


@pytest.mark.parametrize("size", [64, 300, 1 << 20])
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_split_csv_equals_whole_files(spark, place, size, ending):
    """Fields with line breaks, quotes and delimiters, cut at every place by small blocks."""
    rnd, folder = random.Random(3), place("csv")
    os.makedirs(folder)
    for n in range(3):
        rows = [["id", "text", "more"]]
        for i in range(120):
            text = "".join(rnd.choice(["a", "bc ", '"', ",", "\n", "\r\n", "é", ""]) for _ in range(rnd.choice([0, 2, 9, 60])))
            rows.append([str(i), text, rnd.choice(["", "x", "1\n2\n3"])])
        with open(f"{folder}/f{n}.csv", "w", newline="") as file:
            csv.writer(file, lineterminator=ending).writerows(rows)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for header in (True, False):
            whole = files.read_csv(spark, folder, header=header)
            split = files.read_csv(spark, folder, header=header, split=True)
            assert split.columns == whole.columns
            got, want = sorted(map(str, split.collect())), sorted(map(str, whole.collect()))
            assert got == want and len(got) >= 360
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_split_csv_of_one_file_in_many_tasks(spark, place):
    path = place("csv")
    rows = spark.range(60_000).select("id", F.concat(F.lit("a line\nanother, "), F.repeat(F.lit("x"), 100)).alias("t"))
    rows.coalesce(1).write.csv(path, header=True, escape='"')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
        got = files.read_csv(spark, path, split=True)
        assert got.rdd.getNumPartitions() >= 8
        assert got.where("t LIKE 'a line\nanother, x%' AND length(t) = 116").count() == got.count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(KeyspanError):
        files.read_csv(spark, path, split=True, comment="#")
