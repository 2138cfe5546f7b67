import random

import pytest
from pyspark.sql import functions as F

from keyspan.functions.tokens import MAX_TOKEN, MIN_TOKEN, split_of, split_ranges, splits_per_range, token
from keyspan.model import KeyspanError, TableSpec
from keyspan.operators import stats
from keyspan.operators.views import in_range


def skewed(spark, hot: int, cold: int, each: int):
    """One key with ``hot`` rows and ``cold`` keys with ``each`` rows."""
    hots = spark.range(hot).select(F.lit("HOT").alias("sensor"), F.col("id").alias("at"))
    colds = spark.range(cold * each).select(
        F.concat(F.lit("s"), (F.col("id") % cold).cast("string")).alias("sensor"), F.col("id").alias("at")
    )
    return hots.unionByName(colds)


@pytest.mark.parametrize("splits", [1, 2, 3, 7, 64, 1000, 9999])
def test_even_splits_tile_the_ring(spark, splits):
    rows = [(int(r["range_start"]), int(r["range_end"])) for r in split_ranges(spark, splits).orderBy("split_id").collect()]
    assert rows[0][0] == MIN_TOKEN and rows[-1][1] == MAX_TOKEN
    assert all(a[1] == b[0] for a, b in zip(rows, rows[1:]))
    assert all(lo < hi for lo, hi in rows)


@pytest.mark.parametrize("splits", [2, 3, 64, 1000])
def test_split_number_agrees_with_its_range(spark, splits):
    bounds = split_ranges(spark, splits).select(
        "split_id", F.col("range_start").cast("bigint").alias("lo"), F.col("range_end").cast("bigint").alias("hi")
    )
    edges = bounds.select("split_id", F.explode(F.array(F.when(F.col("split_id") > 0, F.col("lo") + 1).otherwise(F.col("lo")), "hi")).alias("t"))
    assert edges.where(split_of(F.col("t"), splits) != F.col("split_id")).count() == 0


def test_splits_per_range():
    assert splits_per_range(4, 3) == 1
    assert splits_per_range(4, 4) == 1
    assert splits_per_range(3, 10) == 4
    assert splits_per_range(16) == 625


def test_tiles_of_the_key_cover_every_row_once(spark):
    df = skewed(spark, 20_000, 500, 4)
    tiles = stats.key_tiles(df, ["sensor"], 8).orderBy("tile").collect()
    assert sum(t["rows"] for t in tiles) == 22_000 and sum(t["keys"] for t in tiles) == 501 and len(tiles) > 4
    assert all(a["hi"] < b["lo"] for a, b in zip(tiles, tiles[1:]))


def test_in_range_wraps_around(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    inside, outside = in_range(df, ["k"], -5, 10**18), in_range(df, ["k"], 10**18, -5)
    assert inside.count() + outside.count() == 2000
    assert in_range(df, ["k"], 7, 7).count() == 2000


def test_skewed_count_finds_the_hot_key(spark):
    df = skewed(spark, 20_000, 500, 4)
    report = stats.count_stats(df, ["sensor"], ["global", "ranges", "partitions"], splits=32, top=3).collect()
    by = lambda s: [r for r in report if r["section"] == s]
    assert by("global")[0]["rows"] == 22_000
    assert sum(r["rows"] for r in by("ranges")) == 22_000 and len(by("ranges")) == 32
    assert [(r["item"], r["rows"]) for r in by("partitions")][0] == ("HOT", 20_000)
    assert len(by("partitions")) == 3


@pytest.mark.parametrize("seed", range(6))
def test_counts_are_conserved(spark, seed):
    rng = random.Random(seed)
    splits, owners, rf = rng.randint(1, 64), rng.randint(3, 12), 3
    placed = [(s, (s + i) % owners) for s in range(splits) for i in range(rf)]
    held = spark.createDataFrame(placed, "split_id int, owner int")
    df = skewed(spark, rng.choice([0, 10_000]), rng.randint(1, 200), rng.randint(1, 20))
    n = df.count()
    ranges = stats.range_counts(df, ["sensor"], splits)
    hosts = stats.replica_counts(ranges, held)
    assert ranges.agg(F.sum("rows")).first()[0] == n
    assert hosts.agg(F.sum("rows")).first()[0] == n * rf
    assert abs(ranges.agg(F.sum("percent")).first()[0] - 100) < 1e-6
    report = stats.count_stats(df, ["sensor"], ["ranges"], splits)
    assert stats.total_rows(report).first()[0] == n


def test_modes():
    assert stats.normalise_modes([]) == ["global"]
    assert stats.normalise_modes(["nonsense"]) == ["global"]
    assert stats.normalise_modes(["Ranges", "biggest-partitions", "partitions"]) == ["ranges", "partitions"]
    with pytest.raises(KeyspanError):
        stats.normalise_modes(["partitions"], has_clustering=False)


def test_empty_table_has_zero_total_and_zero_ranges(spark):
    df = spark.createDataFrame([], "k int")
    assert stats.count_stats(df, ["k"], ["global"]).first()["rows"] == 0
    ranges = stats.range_counts(df, ["k"], 4).collect()
    assert [r["rows"] for r in ranges] == [0] * 4 and all(r["percent"] == 0.0 for r in ranges)


def test_partition_text(spark):
    df = spark.createDataFrame([(1, None), (1, "a")], "a int, b string")
    keys = {r["partition_key"] for r in stats.partition_counts(df, ["a", "b"]).collect()}
    assert keys == {"(1, null)", "(1, a)"}


def test_audit_finds_a_row_in_the_wrong_split(spark):
    df = stats.split_scan(spark.range(1000).withColumnRenamed("id", "k"), ["k"], 8)
    assert stats.audit_summary(df, ["k"], 8).first()["stray_splits"] == 0
    moved = df.withColumn("split_id", F.when(F.col("k") == 17, (F.col("split_id") + 1) % 8).otherwise(F.col("split_id")))
    assert stats.audit_summary(moved, ["k"], 8).first()["stray_splits"] == 1


def test_detail_is_capped_and_says_so(spark):
    df = spark.range(600).select("id", (F.col("id") % 7).alias("rows"))
    cut = stats.cap_detail(df, 500, "rows", ["id"])
    first = cut.first()
    assert cut.count() == 500 and first["reported"] == 600 and first["truncated"]


def test_group_by_needs_a_key_prefix(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, v int")
    spec = TableSpec("a", "b")
    assert stats.aggregate_by_key(df, spec, ["a"], {"n": ("count", "*")}).first()["n"] == 1
    with pytest.raises(KeyspanError):
        stats.aggregate_by_key(df, spec, ["b"], {"n": ("count", "*")})


def test_grouped_counts_are_computed_once(spark, place):
    path = place()
    skewed(spark, 100, 10, 2).write.parquet(path)
    df = spark.read.parquet(path)
    report = stats.table_statistics(df, ["sensor"], "t", splits=4)
    report.collect()
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    final = plan.split("Initial Plan")[0]
    assert "ReusedExchange" in final


def test_hot_key_counts_are_partial_before_the_shuffle(spark):
    plan = stats.partition_counts(skewed(spark, 10, 2, 2), ["sensor"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_token_is_repeatable(spark):
    df = spark.createDataFrame([("a", 1)], "x string, y int")
    assert df.select(token("x", "y")).first() == df.select(token("x", "y")).first()
