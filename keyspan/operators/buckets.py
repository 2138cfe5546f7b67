"""Keyed tables laid out in bucket folders, so that a write rewrites only the buckets it touches.

A row's bucket is a hash of its partition key. Such a table is plain Parquet partitioned by
``_bucket``; a lookup by partition key reads one folder, and a small change set leaves most of a
large table as it is on disk. What the table is made of is kept in a file of the table, because a
write that counted otherwise would replace folders it has not read.

The number of buckets grows with the rows by linear hashing: buckets are split one after the other,
in order, each into itself and one new folder, so that a table that grows by a tenth rewrites a
tenth of its folders. A split first writes the new folders, which no reader looks into yet, then
the layout file, which lets them in, and then takes the moved rows out of the old folders, which
readers leave out by their hash until that is done. A split that dies in between is finished or
begun again by the next write.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.model import KeyspanError, TableSpec
from keyspan.operators.stats import table_statistics
from keyspan.operators.writes import apply_counters, delete_cells, delete_rows, upsert
from keyspan.session import delete_path, file_names, path_exists, read_text, write_text

BUCKET = "_bucket"
LAYOUT = "_layout.json"  # readers of Parquet skip names that begin with an underscore
COUNTS, COUNTED = "_counts", "_counted.json"
ROWS = "_rows"  # rows of a key in the counts

#: Rows of a bucket, about, above which buckets are split.
BUCKET_ROWS = 1_000_000


def doubled(buckets: int, first: int) -> int:
    """The largest first * 2**k up to ``buckets``: all buckets below it were split equally often."""
    while first * 2 <= buckets:
        first *= 2
    return first


def bucket_of(spec: TableSpec, buckets: int, first: int | None = None) -> Column:
    """The bucket of a row in a table that began with ``first`` buckets and has ``buckets`` now."""
    token = F.xxhash64(*spec.partition_key)
    whole = doubled(buckets, first or buckets)
    fine, coarse = F.pmod(token, F.lit(2 * whole)), F.pmod(token, F.lit(whole))
    return (coarse if whole == buckets else F.when(fine < buckets, fine).otherwise(coarse)).cast("int")


def source_of(bucket: int, buckets: int, first: int) -> int:
    """The bucket, of ``buckets``, whose rows a later bucket gets."""
    while bucket >= buckets:
        bucket -= doubled(bucket, first)
    return bucket


def layout(spark: SparkSession, path: str) -> dict | None:
    """What a bucketed table says of itself: ``buckets`` and ``partition_key``. None for any other path."""
    text = read_text(spark, f"{path}/{LAYOUT}")
    return None if text is None else json.loads(text)


def _held(spark: SparkSession, path: str, spec: TableSpec, asked: int | None = None) -> dict:
    """The table's layout; another number of buckets or key than the table's is refused."""
    held = layout(spark, path)
    if held is None:
        raise KeyspanError(f"{path} is not a bucketed table")
    if [k.lower() for k in spec.partition_key] != [k.lower() for k in held["partition_key"]]:
        raise KeyspanError(f"{path} is laid out by {', '.join(held['partition_key'])}, not {', '.join(spec.partition_key)}")
    held = {"first": held["buckets"], "bucket_rows": 0, "rows": {}, "unclean": []} | held
    if asked is not None and asked not in (held["first"], held["buckets"]):
        raise KeyspanError(f"{path} has {held['buckets']} buckets, not {asked}")
    return held


def _placed(df: DataFrame, spec: TableSpec, held: dict) -> DataFrame:
    return df.withColumn(BUCKET, bucket_of(spec, held["buckets"], held["first"]))


def _write(placed: DataFrame, path: str) -> None:
    # Rebalancing gathers the rows of a bucket, and splits a bucket that is too large for one task.
    (
        placed.hint("rebalance", BUCKET).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    )


def _counts(spark: SparkSession, path: str, held: dict, buckets: list[int]) -> dict[str, int]:
    """Rows of some buckets, from the footers of their files; empty ones are left out."""
    rows = _stored(spark, path, held).where(F.col(BUCKET).isin(buckets)).groupBy(BUCKET).agg(F.count("*").alias("n"))
    return {str(r[BUCKET]): r["n"] for r in rows.collect()}


def write_buckets(df: DataFrame, path: str, spec: TableSpec, buckets: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Write a new bucketed table; a path that exists is refused.

    It begins with ``buckets`` buckets, or more where the rows need them, and gets more as it grows beyond ``bucket_rows``
    rows for each (0: it never does).
    """
    spark = df.sparkSession
    if path_exists(spark, path):
        raise KeyspanError(f"{path} exists")
    if buckets < 1:
        raise KeyspanError("a table needs at least one bucket")
    held = {
        "buckets": buckets, "first": buckets, "bucket_rows": bucket_rows, "unclean": [], "rows": {},
        "partition_key": list(spec.partition_key), "schema": df.schema.jsonValue(),
    }
    _write(_placed(df, spec, held), path)
    held["rows"] = _counts(spark, path, held, list(range(buckets)))
    _told(spark, path, held)
    _grow(spark, path, spec, held)
    return read_buckets(spark, path)


def _told(spark: SparkSession, path: str, held: dict) -> None:
    write_text(spark, f"{path}/{LAYOUT}", json.dumps(held))


def _stored(spark: SparkSession, path: str, held: dict) -> DataFrame:
    """All stored rows with their folder's number. Types are kept with the table, so one without a row has them too."""
    schema = T.StructType.fromJson(held["schema"])
    return spark.read.schema(schema.add(BUCKET, T.IntegerType())).parquet(path)


def _with_bucket(spark: SparkSession, path: str, held: dict) -> DataFrame:
    """The table's rows with their bucket: folders beyond its buckets are not read, and rows that a split has moved are left out."""
    rows = _stored(spark, path, held)
    if "first" in held:
        rows = rows.where(F.col(BUCKET) < held["buckets"])
    if held.get("unclean"):
        spec = TableSpec(tuple(held["partition_key"]))
        moved = F.col(BUCKET).isin(held["unclean"]) & (bucket_of(spec, held["buckets"], held["first"]) != F.col(BUCKET))
        rows = rows.where(~moved)
    return rows


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table, bucketed or not."""
    held = layout(spark, path)
    return _with_bucket(spark, path, held).drop(BUCKET) if held else spark.read.parquet(path)


def _digests(spark: SparkSession, path: str, held: dict) -> dict[str, str]:
    """For each bucket a digest of the names of its files. Names are never used twice, so it tells whether a bucket was rewritten."""
    files: dict[str, list[str]] = {}
    for file in _stored(spark, path, held).inputFiles():
        folder, name = file.rsplit("/", 2)[1:]
        if folder.startswith(f"{BUCKET}="):
            files.setdefault(folder.split("=")[1], []).append(name)
    made = {}
    for bucket, names in files.items():
        if int(bucket) < held["buckets"]:
            made[bucket] = hashlib.sha256("/".join(sorted(names)).encode()).hexdigest()
    return made


def refresh_counts(spark: SparkSession, path: str, spec: TableSpec) -> list[int]:
    """Bring the stored rows per partition key up to date; returns the buckets that were counted again.

    Only buckets whose files are others than when they were last counted are read, whoever rewrote them.
    A run that dies leaves counts that the next one makes again.
    """
    held = _held(spark, path, spec)
    text = read_text(spark, f"{path}/{COUNTED}")
    known, now = json.loads(text) if text else {}, _digests(spark, path, held)
    # A split that is not cleaned up changes what a bucket holds without changing its files.
    unclean = {str(b) for b in held["unclean"]}
    stale = sorted(int(b) for b in now if b in unclean or known.get(b) != now[b])
    gone = [b for b in known if b not in now]
    for bucket in gone:
        delete_path(spark, f"{path}/{COUNTS}/{BUCKET}={bucket}")
    if stale:
        for bucket in stale:  # a bucket may be left without a row of its own
            if path_exists(spark, f"{path}/{COUNTS}/{BUCKET}={bucket}"):
                delete_path(spark, f"{path}/{COUNTS}/{BUCKET}={bucket}")
        rows = _with_bucket(spark, path, held).where(F.col(BUCKET).isin(stale))
        counts = rows.groupBy(BUCKET, *spec.partition_key).agg(F.count(F.lit(1)).alias(ROWS))
        _write(counts, f"{path}/{COUNTS}")
    if stale or gone or text is None:
        write_text(spark, f"{path}/{COUNTED}", json.dumps({b: d for b, d in now.items() if b not in unclean}))
    return stale


def stored_statistics(spark: SparkSession, path: str, spec: TableSpec, identity: str, **options) -> DataFrame:
    """``stats.table_statistics`` of a bucketed table from its stored counts: one row per partition key is read, after
    the buckets that have changed since were counted again. Options are those of ``table_statistics``."""
    refresh_counts(spark, path, spec)
    held = _held(spark, path, spec)
    kept = T.StructType.fromJson(held["schema"])
    by_name = {f.name.lower(): f for f in kept}
    keys = [T.StructField(k, by_name[k.lower()].dataType) for k in spec.partition_key]
    schema = T.StructType([*keys, T.StructField(ROWS, T.LongType()), T.StructField(BUCKET, T.IntegerType())])
    if path_exists(spark, f"{path}/{COUNTS}"):
        counts = spark.read.schema(schema).parquet(f"{path}/{COUNTS}").drop(BUCKET)
    else:
        counts = spark.createDataFrame([], schema).drop(BUCKET)
    return table_statistics(counts, list(spec.partition_key), identity, weight=ROWS, **options)


def lookup_partition(spark: SparkSession, path: str, spec: TableSpec, key: dict) -> DataFrame:
    """The rows of one partition; only its bucket is read."""
    missing = [k for k in spec.partition_key if k not in key]
    if missing:
        raise KeyspanError("the partition key is incomplete; missing " + ", ".join(missing))
    held = _held(spark, path, spec)
    table = _with_bucket(spark, path, held)
    named = spark.range(1).select(
        *[F.lit(key[k]).cast(table.schema[k].dataType).alias(k) for k in spec.partition_key]
    )
    number = _placed(named, spec, held).select(BUCKET).first()[0]
    rows = table.where(F.col(BUCKET) == number)
    for k in spec.partition_key:
        rows = rows.where(F.col(k) == F.lit(key[k]))
    return rows.drop(BUCKET)


def upsert_buckets(
    spark: SparkSession, path: str, changes: DataFrame, spec: TableSpec, buckets: int | None = None, **options
) -> list[int]:
    """Upsert into a bucketed table in place; returns the buckets that were rewritten.

    Only touched buckets are read and written. Spark writes them beside the table and moves each in
    when the job commits; a job that fails before leaves the table as it was. A counter table adds
    its increments instead. The table knows its buckets; naming another number is refused. Where the
    table has grown beyond its rows per bucket, some buckets are split afterwards.
    """
    return _rewritten(
        spark, path, changes, spec, buckets,
        lambda base: (
            apply_counters(base, changes, spec.key, [c for c in base.columns if c not in spec.key and c in changes.columns], options.get("delta_id"))
            if spec.counter else upsert(base, changes, spec, **options)
        ),
    )


def delete_from_buckets(spark: SparkSession, path: str, keys: DataFrame, spec: TableSpec, columns: list[str] | None = None) -> list[int]:
    """Delete the rows named by complete keys, or only their cells in ``columns``, in place; returns the buckets that were
    rewritten. Buckets are never joined again."""
    change = (lambda base: delete_cells(base, keys, spec, columns)) if columns else (lambda base: delete_rows(base, keys, spec))
    return _rewritten(spark, path, keys, spec, None, change)


def _rewritten(spark: SparkSession, path: str, named: DataFrame, spec: TableSpec, buckets: int | None, change) -> list[int]:
    """Rewrite the buckets that the rows of ``named`` belong to as ``change`` makes them of their rows."""
    spec.require_key(named.columns)
    held = _cleaned(spark, path, spec, _held(spark, path, spec, buckets))
    # At most one row per bucket.
    touched = sorted(r[0] for r in _placed(named, spec, held).select(BUCKET).distinct().collect())
    if not touched:
        return []
    base = _with_bucket(spark, path, held).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    _replaced(spark, path, _placed(change(base), spec, held), held, touched)
    _told(spark, path, held)
    _grow(spark, path, spec, held)
    return touched


def _replaced(spark: SparkSession, path: str, placed: DataFrame, held: dict, touched: list[int]) -> None:
    """Write buckets anew and count their rows. One without a row left is not written, so its old files are removed."""
    before = {bucket: file_names(spark, f"{path}/{BUCKET}={bucket}") for bucket in touched}
    _write(placed, path)
    for bucket, files in before.items():
        if files and file_names(spark, f"{path}/{BUCKET}={bucket}") == files:
            delete_path(spark, f"{path}/{BUCKET}={bucket}")
    counted = _counts(spark, path, held, touched)
    for bucket in touched:
        held["rows"].pop(str(bucket), None)
    held["rows"] |= counted


def _grow(spark: SparkSession, path: str, spec: TableSpec, held: dict) -> None:
    """Split buckets, in order, until there is one for each ``bucket_rows`` rows."""
    rows = sum(held["rows"].values())
    wanted = -(-rows // held["bucket_rows"]) if held["bucket_rows"] else 0
    if wanted <= held["buckets"]:
        return
    new = list(range(held["buckets"], wanted))
    for bucket in new:  # left by a split that died before it was told
        if path_exists(spark, f"{path}/{BUCKET}={bucket}"):
            delete_path(spark, f"{path}/{BUCKET}={bucket}")
    sources = sorted({source_of(b, held["buckets"], held["first"]) for b in new})
    rows_of = _with_bucket(spark, path, held).where(F.col(BUCKET).isin(sources)).drop(BUCKET)
    grown = held | {"buckets": wanted, "unclean": sources}
    _write(_placed(rows_of, spec, grown).where(F.col(BUCKET) >= held["buckets"]), path)
    grown["rows"] = held["rows"] | _counts(spark, path, grown, new)
    _told(spark, path, grown)
    held.update(_cleaned(spark, path, spec, grown))


def _cleaned(spark: SparkSession, path: str, spec: TableSpec, held: dict) -> dict:
    """Take the rows that a split has moved out of the folders they came from."""
    sources = held["unclean"]
    if sources:
        stay = _with_bucket(spark, path, held).where(F.col(BUCKET).isin(sources)).drop(BUCKET)
        _replaced(spark, path, _placed(stay, spec, held), held, sources)
        held = held | {"unclean": []}
        _told(spark, path, held)
    return held
