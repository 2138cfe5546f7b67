import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from keyspan.functions.rendering import grid_text, render_text, render_wire, row_json
from keyspan.model import KeyspanError, MissingKeyError
from keyspan.operators import first_rows, views
from keyspan.operators.order_statistics import rows_around


def rendered(spark, ddl, value):
    df = spark.createDataFrame([(value,)], f"c {ddl}")
    return df.select(grid_text(F.col("c"), df.schema["c"].dataType)).first()[0]


@pytest.mark.parametrize(
    "ddl,value,text",
    [
        ("string", None, "null"), ("int", 5, "5"), ("double", 5.0, "5"), ("double", 0.1, "0.1"),
        ("double", 12345678.0, "12345678"), ("double", 123456789.25, "123456789.25"), ("double", 1e21, "1e+21"),
        ("double", 1.5e-7, "1.5e-7"), ("double", 0.00001, "0.00001"), ("double", -0.0, "0"), ("double", -2500000000.0, "-2500000000"),
        ("float", 0.1, "0.1"), ("boolean", True, "true"), ("binary", b"\x01\xff", "0x01ff"), ("array<int>", [1, None], "[1, null]"),
        ("map<string,int>", {"a": 1}, "{a: 1}"), ("struct<a:int,b:string>", (1, None), "{a: 1, b: null}"),
        ("array<array<string>>", [["x"], []], "[[x], []]"), ("struct<_1:int,_2:string>", (1, "a"), "[1, a]"),
        ("struct<a:int,b:string>", None, "null"),
    ],
)
def test_grid_text(spark, ddl, value, text):
    assert rendered(spark, ddl, value) == text


def test_search_null_finds_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [r["a"] for r in views.search(df, "NULL").collect()] == [1]
    assert views.search(df, "  ").count() == 2


def test_flat_text_keeps_null_and_nested_json(spark):
    df = spark.createDataFrame(
        [(None, b"\xca\xfe", [1, None], {"k": 1.5}, ("x", None))],
        "a string, b binary, c array<int>, d map<string,double>, e struct<p:string,q:int>",
    )
    row = render_text(df).first()
    assert tuple(row) == (None, "0xcafe", "[1,null]", '{"k":1.5}', '{"p":"x","q":null}')


def test_wire_text(spark):
    df = spark.createDataFrame(
        [(2**60, Decimal("1.50"), b"hi", {1: "a"}, 7)], "a bigint, b decimal(10,2), c binary, d map<int,string>, e int"
    )
    assert df.select(row_json(df)).first()[0] == (
        '{"a":"1152921504606846976","b":"1.50","c":"aGk=","d":[{"key":1,"value":"a"}],"e":7}'
    )
    assert render_wire(df).schema["d"].dataType.simpleString() == "array<struct<key:int,value:string>>"


def test_natural_sort(spark):
    names = ["file10", "file9", "File9", "file010b", "a", None, "10", "9", "file99999999999999999999999"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "n string, i int")
    got = [r["n"] for r in views.sort_view(df, "n", tie=["i"]).collect()]
    assert got == ["9", "10", "a", "file9", "File9", "file10", "file010b", "file99999999999999999999999", None]
    assert views.sort_view(df, "n", "desc").first()["n"] is None


def test_big_numbers_sort_by_their_whole_value(spark):
    texts = ["1.2", "1.9", "-1.2", "-1.9", "0", "-0.0", "00012", "9" * 45, "-" + "9" * 45, "1" + "0" * 45, "1.25", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in views.sort_view(df, "t", numeric_text=True).collect()]
    values = [Decimal(t) for t in got[:-1]]
    assert got[-1] is None and values == sorted(values)


def test_predicates(spark):
    df = spark.createDataFrame(
        [(1, ["a", "b"], {"x": 1}, "Grüne Äpfel"), (2, ["c"], {"y": 2}, "apple-pie"), (3, None, None, None)],
        "id int, tags array<string>, m map<string,int>, body string",
    )
    ids = lambda *p, **o: sorted(r["id"] for r in views.apply_predicates(df, list(p), **o).collect())
    assert ids(("tags", "CONTAINS", "a")) == [1]
    assert ids(("m", "CONTAINS", 2)) == [2]
    assert ids(("m", "CONTAINS KEY", "x")) == [1]
    assert ids(("body", ":", "PIE")) == [2]
    assert ids(("body", ":", "PIE"), text_options={"case_sensitive": True}) == []
    assert ids(("body", ":", "apfel"), text_options={"ascii": True}) == [1]
    assert ids(("body", ":", "äpfel"), text_options={"normalize": True}) == [1]
    assert ids(("id", "IN", [1, 3]), ("id", ">", 1)) == [3]
    with pytest.raises(KeyspanError):
        ids(("id", "IN", 3))
    with pytest.raises(KeyspanError):
        ids(("id", "!=", 3))


def test_projection(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert views.project(df, ["b", "a"]).columns == ["b", "a"]
    assert views.project(df, []).columns == ["a", "b"]
    with pytest.raises(KeyspanError):
        views.project(df, ["zz"])


def test_lookup_names_missing_key_columns(spark):
    df = spark.createDataFrame([(1, 2, "x")], "a int, b int, v string")
    with pytest.raises(MissingKeyError) as error:
        views.lookup(df, ["a", "b"], {"a": 1})
    assert error.value.missing == ["b"]


def test_filters_reach_the_parquet_reader(spark, place):
    path = place()
    spark.range(10).select("id", F.col("id").alias("v")).write.parquet(path)
    found = views.apply_predicates(spark.read.parquet(path), [("id", ">=", 3), ("id", "IN", [4, 5])]).select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,3)" in plan and "In(id, [4,5])" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_every_row_on_exactly_one_page(spark):
    n = 10_500
    rng = random.Random(1)
    rows = [(rng.choice([0, 0, 0, 1, 2, 3]), i) for i in range(n)]
    df = spark.createDataFrame(rows, "bucket int, seq int").repartition(7)
    pages = views.Pages(df, ["bucket", "seq"], 500)
    assert pages.rows == n and pages.pages == 21
    whole = pages.frame()
    assert whole.count() == n and whole.select("bucket", "seq").distinct().count() == n
    expected = [tuple(r) for r in sorted(rows)]
    for number in (1, 7, 21):
        shown = [(r["bucket"], r["seq"]) for r in pages.page(number).orderBy("bucket", "seq").collect()]
        assert shown == expected[(number - 1) * 500 : number * 500]
        assert whole.where(F.col("page") == number).count() == len(shown)
    before = {tuple(r) for r in pages.page(6).collect()}
    pages.page(7).collect()
    assert {tuple(r) for r in pages.page(6).collect()} == before


def test_page_size_limits(spark):
    df = spark.range(3)
    for size in (0, 10_001):
        with pytest.raises(KeyspanError):
            views.Pages(df, ["id"], size)


@pytest.fixture
def many_tasks(spark):
    """Small test data would otherwise be put into one task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_value_spreads_over_partitions(spark, many_tasks):
    df = spark.range(20_000).select(F.lit(1).alias("same"), "id")
    pages = views.Pages(df, ["same", "id"], 1000)
    assert len(pages.offsets) > 1 and max(n for _, _, n in pages.offsets) < 15_000


def test_partition_limit_uses_the_group_limit_and_a_large_one_is_cut_twice(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    small = views.per_partition_limit(df, ["k"], ["id desc"], 2)
    assert "WindowGroupLimit" in small._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in small.collect()) == [4995, 4997, 4998, 4999]
    large = views.per_partition_limit(df, ["k"], ["id"], 1500)
    assert large.count() == 1500 + 1500
    assert large.where("k = 1").agg(F.max("id")).first()[0] == 4497


_ORDERS = [
    ["whole", "id"], ["whole desc", "id desc"], ["number", "id"], ["number desc", "id"], ["word", "id"], ["word desc", "id"],
    ["same", "day desc", "id"], ["flag", "small desc", "time", "id"], ["local desc", "id"], ["amount desc", "id"], ["same", "id"],
]


@pytest.fixture(scope="module")
def mixed_order(spark):
    """A key with most of the rows, a null key, nulls, ties, extremes and values that need more than 53 bits."""
    i = F.col("id")
    null = lambda c, every: F.when(i % every != 0, c)
    df = spark.range(6000).select(
        F.when(i % 5 < 3, "HOT").when(i % 5 == 3, None).otherwise(F.concat(F.lit("k"), i % 40)).alias("k"), "id",
        null(F.when(i % 3 == 0, F.lit(2**62) + i % 50).otherwise((i * 7919) % 1000 - 500), 11).alias("whole"),
        null(F.when(i % 97 == 0, F.lit(float("nan"))).when(i % 89 == 0, F.lit(float("-inf")))
             .when(i % 83 == 0, F.lit(1.7e308)).otherwise(F.pow(F.lit(1.5), (i % 300).cast("double"))), 13).alias("number"),
        null(F.concat(F.lit("prefix" * 2), (i * 31 % 700).cast("string")), 17).alias("word"), F.lit(1).alias("same"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 9).cast("int")).alias("day"), (i % 2 == 0).alias("flag"),
        (i % 7).cast("tinyint").alias("small"), F.timestamp_micros(i * 1_000_003 % 999_983).alias("time"),
        null(F.timestamp_micros((i * 61 % 500 - 250) * 123_456_789).cast("timestamp_ntz"), 19).alias("local"),
        (i % 1000 / 7).cast("decimal(20,6)").alias("amount"),
    )
    df.cache()
    yield df
    df.unpersist()


@pytest.mark.parametrize("order", _ORDERS, ids=lambda o: "-".join(o).replace(" ", "_"))
def test_cuts_of_hot_partitions_hold_their_first_rows(spark, mixed_order, order):
    n = 20
    found = first_rows.cuts(mixed_order, ["k"], order, n)
    assert {r["k"] for r in found.collect()} == {"HOT", None}
    left = first_rows.before_cut(mixed_order, found, ["k"], order)
    assert left.columns == mixed_order.columns
    window = Window.partitionBy("k").orderBy(*views.order_columns(order))
    first = lambda df: {tuple(r) for r in df.withColumn("n", F.row_number().over(window)).where(f"n <= {n}").select("k", "id", "n").collect()}
    assert first(left) == first(mixed_order)
    hot = left.where("k = 'HOT'").count()
    assert hot == found.where("k = 'HOT'").first()["_kept"]
    if not order[0].startswith(("word", "number")):  # those codes do not tell all values apart
        assert n <= hot <= first_rows.ENOUGH * n


def test_no_cut_without_hot_partitions_or_numbers(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), "id", F.array("id").alias("a"))
    assert first_rows.cuts(df, ["k"], ["id"], 50) is None and first_rows.codes(df, ["a", "id"]) == []
    assert first_rows.cuts(df.limit(0), ["k"], ["id"], 5) is None
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "3")
    try:
        assert views.per_partition_limit(df, ["k"], ["a", "id"], 4).count() == 8
        plain = {r["id"] for r in views.per_partition_limit(df, ["k"], ["id desc"], 4).collect()}
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert plain == set(range(92, 100))


def test_cluster_sort_keeps_order_and_spreads_a_hot_partition(spark, many_tasks):
    df = spark.range(8000).select(F.lit("HOT").alias("k"), (F.col("id") * 7919 % 8000).alias("ts"))
    laid = views.cluster_sort(df, ["k"], ["ts desc"])
    sizes = laid.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1
    got = [r["ts"] for r in laid.collect()]
    assert got == sorted(got, reverse=True)


def test_result_view_order(spark):
    df = spark.createDataFrame([("u1", "10"), ("u2", "9"), ("u3", None), ("v4", "11")], "user string, logins string")
    shown = views.result_view(df, "u", {"user": "u"}, ("logins", "desc"), numeric_text=True)
    assert [r["user"] for r in shown.collect()] == ["u3", "u1", "u2"]
    up = views.result_view(df, None, {}, ("logins", "asc"), numeric_text=True)
    assert [r["user"] for r in up.collect()] == ["u2", "u1", "v4", "u3"]


def test_word_match_equals_the_list_of_words(spark):
    texts = ["the cat", "The-cat", "cathedral cat_1", "x\ncat.", "concat", "", None, "Çat cat2 CAT"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for word in ("cat", "CAT", "cat_1", "the cat", "", "çat", "c.t"):
        both = df.select(
            F.coalesce(views.has_word(F.col("t"), word), F.lit(False)),
            F.coalesce(F.array_contains(views.words(F.col("t")), word.lower()), F.lit(False)),
        ).collect()
        assert all(a == b for a, b in both), word


def test_tuples_are_json_arrays_at_any_depth(spark):
    df = spark.createDataFrame(
        [(("a\"", 1, None), [(2.5, True)], {"k": ("x", 7)}, (3, ("y", 2**60)), None, 5, "t")],
        "t struct<_1:string,_2:int,_3:int>, l array<struct<_1:double,_2:boolean>>, m map<string,struct<_1:string,_2:int>>, "
        "u struct<n:int,p:struct<_1:string,_2:bigint>>, gone struct<_1:int>, i int, s string",
    )
    flat = render_text(df).first()
    assert tuple(flat)[:5] == ('["a\\"",1,null]', "[[2.5,true]]", '{"k":["x",7]}', '{"n":3,"p":["y",1152921504606846976]}', None)
    line = df.select(row_json(df)).first()[0]
    assert line == (
        '{"t":["a\\"",1,null],"l":[[2.5,true]],"m":{"k":["x",7]},"u":{"n":3,"p":["y","1152921504606846976"]},'
        '"gone":null,"i":5,"s":"t"}'
    )


def test_stored_pages_are_reopened(spark, place):
    path = place()
    df = spark.range(95).select((F.col("id") * 7 % 95).alias("n"))
    first = views.Pages(df, ["n"], 10, path)
    again = views.Pages.open(spark, path, 30)
    assert again.pages == 4 and again.columns == ["n"] and first.pages == 10
    assert [r["n"] for r in again.page(2).orderBy("n").collect()] == list(range(30, 60))


def test_numbers_as_text_with_exponents(spark):
    texts = ["1E-7", "5", "1E+3", "200", "-1e2", "-99.5", "0", "0e9", "2.00e2", "-1E-9", "12345678901234567890123.1", "1.2e22", None, "0.00000009"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["t"] for r in views.sorted_places(df, "t", numeric_text=True, tie=["i"]).orderBy("place").collect()]
    assert got == ["-1e2", "-99.5", "-1E-9", "0", "0e9", "0.00000009", "1E-7", "5", "200", "2.00e2", "1E+3", "1.2e22", "12345678901234567890123.1", None]


@pytest.mark.parametrize("count", [40, 12_000])
def test_whole_numbers_find_doubles_in_lists_of_any_length(spark, count):
    df = spark.createDataFrame([(1.0,), (2.5,), (39.0,), (None,)], "v double")
    assert sorted(r["v"] for r in views.apply_predicates(df, [("v", "IN", [*range(count), 2.5, None])]).collect()) == [1.0, 2.5, 39.0]
    ints = spark.range(5)
    assert sorted(r["id"] for r in views.apply_predicates(ints, [("id", "IN", [1.0, 2.5, 2**70, *range(4, count)])]).collect()) == [1, 4]


def test_a_word_is_folded_like_the_text(spark):
    df = spark.createDataFrame([("Création du monde",), ("creation",), ("recreation",)], "t string")
    for word in ("création", "CREATION", "Creátion"):
        assert views.apply_predicates(df, [("t", ":", word)], {"ascii": True}).count() == 2


@pytest.mark.parametrize("n", [50, 12_000])
def test_lists_of_any_type_on_both_ways(spark, n):
    df = spark.range(300).selectExpr(
        "id", "date_add(DATE'2020-01-01', CAST(id AS INT)) AS d", "CAST(id AS DECIMAL(12,2)) / 4 AS x", "CAST(id AS STRING) AS s",
        "CAST(date_add(DATE'2020-01-01', CAST(id AS INT)) AS TIMESTAMP) AS t", "CAST(id AS DECIMAL(12,2)) AS p", "CAST(id AS TINYINT) AS b",
    )
    days = [(dt.date(2020, 1, 1) + dt.timedelta(days=2 * i)).isoformat() for i in range(n)]
    count = len({d for d in days} & {(dt.date(2020, 1, 1) + dt.timedelta(days=i)).isoformat() for i in range(300)})
    filler = ["no value", None, float("nan"), "1e400"]
    assert views.apply_predicates(df, [("d", "IN", days + filler)]).count() == count
    assert views.apply_predicates(df, [("t", "IN", [dt.date.fromisoformat(d) for d in days])]).count() == count
    assert views.apply_predicates(df, [("p", "IN", [2 * i for i in range(n)] + [1.005, *filler])]).count() == count
    assert views.apply_predicates(df, [("p", "IN", [float(2 * i) for i in range(n)])]).count() == count
    assert views.apply_predicates(df, [("id", "IN", [str(2 * i) for i in range(n)] + filler)]).count() == count
    assert views.apply_predicates(df, [("s", "IN", [2 * i for i in range(n)])]).count() == count


def _page_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice([7, 7, 7, None, rng.randint(-50, 50)]), rng.choice(["a", "b", None]), rng.choice([0.5, None, float("nan"), rng.random()]), i) for i in range(30_000)]
    return spark.createDataFrame(rows, "whole int, word string, part double, id int").repartition(6)


@pytest.mark.parametrize("order", [["id desc"], ["whole desc", "word", "id"], ["part", "id"], ["word desc", "whole", "id desc"]])
def test_one_page_is_the_page_of_the_sorted_table(spark, order):
    df = _page_rows(spark).persist()
    want = [r["id"] for r in df.orderBy(*views.order_columns(order)).select("id").collect()]
    for number in (1, 173, 300, 301):
        got = views.one_page(df, order, number, 100, enough=1000)
        assert sorted(r["id"] for r in got.collect()) == sorted(want[(number - 1) * 100 : number * 100]), (order, number)
    df.unpersist()


def test_one_page_keeps_few_rows_beside_a_hot_value(spark):
    df = _page_rows(spark).persist()
    # Most rows hold 7: their place is told by the next column.
    near, skipped = rows_around(df, ["whole", "id"], 20_000, 20_100, 1000)
    assert near.count() <= 1000 and skipped <= 20_000 and near.select("whole").distinct().count() == 1
    whole, none = rows_around(df, [F.col("id")], 20_000, 20_100, 1000)
    assert none == 0 and whole.count() == 30_000
    assert views.one_page(df.where("id < 0"), ["id"], 1, 100).count() == 0
    with pytest.raises(KeyspanError):
        views.one_page(df, ["id"], 0)
    df.unpersist()


def test_sort_keys_are_columns_before_the_sort(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["10", "9", "1e1", None, "-3", "0009"])], "i int, t string")
    for number in (True, False):
        plan = views.sort_view(df, "t", "desc", numeric_text=number, tie=["i"])._jdf.queryExecution().sparkPlan().toString()
        sorts = [line for line in plan.splitlines() if "Sort [" in line]
        # An expression in a sort is evaluated for each comparison.
        assert sorts and not any(name in line for line in sorts for name in ("regexp", "struct", "transform"))
    places = views.sorted_places(df, "t", "desc", numeric_text=True, tie=["i"])
    assert [r["i"] for r in places.orderBy("place").collect()] == [3, 0, 2, 1, 5, 4] and places.columns == ["i", "t", "place"]
