import os

import pytest
from pyspark.sql import functions as F

from keyspan.model import KeyspanError, TableSpec
from keyspan.operators import buckets, stats, tables, writes
from keyspan.sources import imports
from keyspan.streaming import streams

SPEC = TableSpec("k", "id")


def base(spark):
    return spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("k"), "id",
        F.lit("old").alias("v"),
    )


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_touched_buckets_are_rewritten(spark, place):
    path = place("table")
    buckets.write_buckets(base(spark), path, SPEC, 16)
    before = files_of(path)
    changes = spark.createDataFrame([("k1", 1, "new"), ("k1", 9999, "add")], "k string, id bigint, v string")
    touched = buckets.upsert_buckets(spark, path, changes, SPEC)
    kept = {f for f in before if f"_bucket={touched[0]}/" not in f}
    assert len(touched) == 1 and kept <= files_of(path) and not (before - kept) & files_of(path)
    want = writes.upsert(base(spark), changes, SPEC)
    got = buckets.read_buckets(spark, path)
    assert got.count() == 2001 and tables.reconcile(got, want, SPEC.key).count() == 0
    assert buckets.upsert_buckets(spark, path, changes.where("id < 0"), SPEC) == []


def test_lookup_reads_one_bucket(spark, place):
    path = place("table")
    buckets.write_buckets(base(spark), path, SPEC, 16)
    rows = buckets.lookup_partition(spark, path, SPEC, {"k": "HOT"})
    assert rows.count() == 667
    assert "PartitionFilters: [isnotnull(_bucket" in rows._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(KeyspanError):
        buckets.lookup_partition(spark, path, SPEC, {})
    with pytest.raises(KeyspanError):
        buckets.write_buckets(base(spark), path, SPEC, 16)


@pytest.mark.parametrize("other", [8, 24, 32])
def test_another_number_of_buckets_is_refused(spark, place, other):
    path = place("table")
    buckets.write_buckets(base(spark), path, SPEC, 16)
    changes = spark.range(700).select(F.concat(F.lit("k"), F.col("id") % 40).alias("k"), "id", F.lit("new").alias("v"))
    with pytest.raises(KeyspanError, match="16 buckets"):
        buckets.upsert_buckets(spark, path, changes, SPEC, other)
    with pytest.raises(KeyspanError, match="laid out by"):
        buckets.upsert_buckets(spark, path, changes, TableSpec("id", "k"))
    texts = changes.select([F.col(c).cast("string").alias(c) for c in ("k", "id", "v")])
    with pytest.raises(KeyspanError, match="16 buckets"):
        imports.load(texts, path, {"k": "text", "id": "bigint", "v": "text"}, SPEC, buckets=other)
    assert tables.reconcile(buckets.read_buckets(spark, path), base(spark), SPEC.key).count() == 0
    buckets.upsert_buckets(spark, path, changes, SPEC, 16)
    want = writes.upsert(base(spark), changes, SPEC)
    assert tables.reconcile(buckets.read_buckets(spark, path), want, SPEC.key).count() == 0


def test_plain_tables_stay_plain(spark, place):
    path, types = place("plain"), {"k": "text", "id": "bigint", "v": "text"}
    texts = base(spark).select([F.col(c).cast("string").alias(c) for c in ("k", "id", "v")])
    imports.load(texts, path, types, SPEC, buckets=0)
    imports.load(texts.withColumn("v", F.lit("new")), path, types, SPEC)
    assert spark.read.parquet(path).where("v = 'new'").count() == 2000
    with pytest.raises(KeyspanError):
        imports.load(texts, path, types, SPEC, buckets=4)
    with pytest.raises(KeyspanError):
        buckets.lookup_partition(spark, path, SPEC, {"k": "HOT"})


def test_loads_into_buckets(spark, place):
    path = place("table")
    types = {"k": "text", "id": "bigint", "v": "text"}
    texts = base(spark).select([F.col(c).cast("string").alias(c) for c in ("k", "id", "v")])
    assert imports.load(texts, path, types, SPEC, buckets=8).status == "SUCCESS"
    more = texts.where("id < 10").withColumn("v", F.lit("newer"))
    imports.load(more, path, types, SPEC, buckets=8)
    got = buckets.read_buckets(spark, path)
    assert got.count() == 2000 and got.where("v = 'newer'").count() == 10


@pytest.mark.parametrize("number", [0, None, 4])
def test_counter_loads_add_up(spark, place, number):
    path, spec = place("counters"), TableSpec("k", counter=True)
    texts = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "5")], "k string, n string")
    for _ in range(2):
        imports.load(texts, path, {"k": "text", "n": "counter"}, spec, buckets=number)
    table = buckets.read_buckets(spark, path)
    assert {tuple(r) for r in table.select("k", "n").collect()} == {("a", 6), ("b", 10)}


def test_streams_refuse_counters(spark, place):
    with pytest.raises(KeyspanError):
        streams.stream_load(spark, place(), place(), {"k": "text"}, TableSpec("k", counter=True), place())


def test_stream_into_buckets(spark, place):
    incoming, path = place("in"), place("table")
    spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string").write.csv(incoming, header=True)
    streams.stream_load(
        spark, incoming, path, {"id": "int", "v": "text"}, TableSpec("id"), place("checkpoint"), buckets=4, files_per_batch=1
    ).start().awaitTermination()
    assert {tuple(r) for r in buckets.read_buckets(spark, path).collect()} == {(1, "a"), (2, "b")}


def test_buckets_grow_with_the_table(spark, place):
    """A hundredfold growth in steps; then a small load rewrites a small part, and all rows are those of a plain upsert."""
    path, spec = place("table"), TableSpec("k", "id")

    def rows(n):
        return spark.range(n).select(F.concat(F.lit("k"), F.col("id") % 997).alias("k"), "id", F.lit("old").alias("v"))

    buckets.write_buckets(rows(600), path, spec, 2, bucket_rows=200)
    numbers = [buckets.layout(spark, path)["buckets"]]
    for n in (1500, 9000, 60_000):
        buckets.upsert_buckets(spark, path, rows(n), spec)
        numbers.append(buckets.layout(spark, path)["buckets"])
    assert numbers == [3, 8, 45, 300]
    held = buckets.layout(spark, path)
    assert held["unclean"] == [] and sum(held["rows"].values()) == 60_000
    before = {f: os.path.getsize(f) for f in files_of(path)}
    changes = spark.range(1000).select(F.concat(F.lit("k"), F.col("id") % 4).alias("k"), (F.col("id") + 59_500).alias("id"), F.lit("new").alias("v"))
    assert len(buckets.upsert_buckets(spark, path, changes, spec)) <= 4
    kept = sum(size for f, size in before.items() if os.path.exists(f))
    assert kept > 0.95 * sum(before.values())
    got = buckets.read_buckets(spark, path)
    assert tables.reconcile(got, writes.upsert(rows(60_000), changes, spec), spec.key).count() == 0
    some = buckets.lookup_partition(spark, path, spec, {"k": "k5"})
    assert some.count() == got.where("k = 'k5'").count() > 50


@pytest.mark.parametrize("dies", [1, 2])
def test_a_split_that_dies_is_finished_by_the_next_write(spark, place, monkeypatch, dies):
    path, spec = place("table"), TableSpec("k")
    rows = spark.range(4000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    buckets.write_buckets(rows.where("k < 900"), path, spec, 3, bucket_rows=300)
    calls, told = [], buckets._told

    def failing(*args):
        calls.append(1)
        if len(calls) == dies + 1:  # after the rows are in: before or after the new folders are let in
            raise RuntimeError("gone")
        told(*args)

    monkeypatch.setattr(buckets, "_told", failing)
    with pytest.raises(RuntimeError):
        buckets.upsert_buckets(spark, path, rows, spec)
    monkeypatch.setattr(buckets, "_told", told)
    assert tables.reconcile(buckets.read_buckets(spark, path), rows, spec.key).count() == 0
    assert buckets.lookup_partition(spark, path, spec, {"k": 3999}).count() == 1
    change = rows.where("k = 5").withColumn("v", F.lit("new"))
    buckets.upsert_buckets(spark, path, change, spec)
    held = buckets.layout(spark, path)
    assert held["buckets"] == 14 and held["unclean"] == [] and sum(held["rows"].values()) == 4000
    assert tables.reconcile(buckets.read_buckets(spark, path), writes.upsert(rows, change, spec), spec.key).count() == 0


def test_deletes_in_place(spark, place):
    path = place("table")
    buckets.write_buckets(base(spark), path, SPEC, 16)
    gone = base(spark).where("k = 'k1'").select("k", "id")
    assert len(buckets.delete_from_buckets(spark, path, gone, SPEC)) == 1
    want = writes.delete_rows(base(spark), gone, SPEC)
    assert tables.reconcile(buckets.read_buckets(spark, path), want, SPEC.key).count() == 0
    cells_of = base(spark).where("id < 9").select("k", "id")
    buckets.delete_from_buckets(spark, path, cells_of, SPEC, ["v"])
    got = buckets.read_buckets(spark, path)
    assert got.where("v IS NULL").count() == 9 - gone.where("id < 9").count()
    buckets.delete_from_buckets(spark, path, base(spark).select("k", "id"), SPEC)
    assert buckets.read_buckets(spark, path).count() == 0 and sum(buckets.layout(spark, path)["rows"].values()) == 0
    buckets.upsert_buckets(spark, path, base(spark), SPEC)
    assert buckets.read_buckets(spark, path).count() == 2000


def _figures(df):
    return sorted((r["section"], r["item"], r["rows"], r["reported"], round(r["percent"] or 0, 6)) for r in df.collect())


def test_stored_statistics_recount_only_buckets_that_changed(spark, place):
    path = place("table")
    buckets.write_buckets(base(spark), path, SPEC, 8)
    assert len(buckets.refresh_counts(spark, path, SPEC)) == 8 and buckets.refresh_counts(spark, path, SPEC) == []
    for number, key in enumerate(["k1", "fresh", "HOT"]):
        changes = spark.createDataFrame([(key, 5000 + number, "new"), (key, 6000 + number, "new")], "k string, id bigint, v string")
        touched = buckets.upsert_buckets(spark, path, changes, SPEC)
        assert buckets.refresh_counts(spark, path, SPEC) == touched and len(touched) == 1
    table = buckets.read_buckets(spark, path)
    want = stats.table_statistics(table, ["k"], "t", 16, 5)
    assert _figures(buckets.stored_statistics(spark, path, SPEC, "t", splits=16, top=5)) == _figures(want)
    # Reading the table does not see the counts, and a bucket without rows leaves none behind.
    assert table.columns == ["k", "id", "v"] and table.count() == 2006
    buckets.delete_from_buckets(spark, path, table.select("k", "id"), SPEC)
    empty = buckets.stored_statistics(spark, path, SPEC, "t", splits=16, top=5)
    assert empty.where("section = 'global'").first()["rows"] == 0 and empty.where("section = 'partitions'").count() == 0


def test_stored_statistics_follow_growing_buckets(spark, place):
    path = place("table")
    buckets.write_buckets(base(spark), path, SPEC, 2, bucket_rows=400)
    buckets.refresh_counts(spark, path, SPEC)
    more = spark.range(3000).select(F.concat(F.lit("m"), F.col("id") % 70).alias("k"), "id", F.lit("new").alias("v"))
    buckets.upsert_buckets(spark, path, more, SPEC)
    assert buckets.layout(spark, path)["buckets"] > 6
    want = stats.table_statistics(buckets.read_buckets(spark, path), ["k"], "t", 16, 200)
    assert _figures(buckets.stored_statistics(spark, path, SPEC, "t", splits=16, top=200)) == _figures(want)
