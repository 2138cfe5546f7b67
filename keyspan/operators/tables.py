"""Whole-table jobs: copy, view, column changes, key checks, comparison, statements, replacement."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.functions.parsing import declared_type
from keyspan.functions.rendering import blob_text, is_tuple, timestamp_text
from keyspan.model import KeyspanError, TableSpec
from keyspan.operators.views import order_columns
from keyspan.session import materialize, path_exists, rename_path

#: A differing range of keys is cut into 2 ** FAN_BITS by the next level of digests, up to RANGES ranges, until at most
#: FEW_ROWS rows lie in differing ones.
FAN_BITS, RANGES, FEW_ROWS = 12, 2**20, 1_000_000


def build_view(
    base: DataFrame,
    key: TableSpec,
    select: list[str] | None = None,
    where: str | Column | None = None,
    clustered: bool = False,
) -> DataFrame:
    """A derived table: columns (none named means all), filter, new key.

    Without a filter, rows whose new key is incomplete are left out. ``clustered`` lays the rows
    out by partition key and clustering order, ready to be written.
    """
    if where is None:
        keep = F.lit(True)
        for k in key.key:
            keep = keep & F.col(k).isNotNull()
    else:
        keep = F.expr(where) if isinstance(where, str) else where
    out = base.where(keep)
    if select:
        out = out.select(*dict.fromkeys([*key.key, *select]))
    if clustered:
        order = [F.col(k) for k in key.partition_key] + order_columns(list(key.clustering))
        out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    return out


def alter_table(df: DataFrame, changes: list[tuple]) -> DataFrame:
    """Column changes in order: ``("add", name, type)``, ``("drop", name)``,
    ``("rename", old, new)``, ``("type", name, type)``. One projection, no shuffle."""
    for change in changes:
        kind, name = change[0], change[1]
        if kind == "add":
            if name in df.columns:
                raise KeyspanError(f"column {name} exists")
            df = df.withColumn(name, F.lit(None).cast(change[2]))
            continue
        if name not in df.columns:
            raise KeyspanError(f"no column {name}")
        if kind == "drop":
            df = df.drop(name)
        elif kind == "rename":
            df = df.withColumnRenamed(name, change[2])
        elif kind == "type":
            df = df.withColumn(name, F.col(f"`{name}`").cast(change[2]))
        else:
            raise KeyspanError(f"unknown change {kind}")
    return df


def check_projection(columns: list[str], spec: TableSpec) -> dict:
    """Can rows of a result with these columns be edited: is the full key among them?"""
    have = {c.lower() for c in columns}
    missing = [] if "*" in columns else [k for k in spec.key if k.lower() not in have]
    suggested = [*spec.key, *[c for c in columns if c != "*" and c not in spec.key]]
    return {"editable": not missing, "primary_key": spec.key, "missing": missing, "select": suggested}


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def check_keys(df: DataFrame, spec: TableSpec) -> DataFrame:
    """One row: rows, rows with an incomplete key, distinct keys, keys found more than once."""
    spec.require_key(df.columns)
    incomplete = F.lit(False)
    for k in spec.key:
        incomplete = incomplete | F.col(k).isNull()
    counted = df.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(incomplete, F.col("n"))), F.lit(0)).alias("incomplete_keys"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count(F.when(F.col("n") > 1, 1)).alias("repeated_keys"),
    )


def suggest_columns(df: DataFrame, source_key: list[str]) -> DataFrame:
    """Column proposal for a table made from another source: name, source type, declared type,
    nullable and the place in the source's key. It describes the schema; no row is read."""
    rows = [
        (
            f.name, f.dataType.simpleString(), declared_type(f.dataType), f.nullable and f.name not in source_key,
            source_key.index(f.name) + 1 if f.name in source_key else None,
        )
        for f in df.schema
    ]
    schema = "name string, source_type string, suggested_type string, nullable boolean, key_position int"
    return df.sparkSession.createDataFrame(rows, schema)


def suggest_keys(df: DataFrame, source_key: list[str]) -> DataFrame:
    """Key proposal from a source table's primary key, with the facts to judge it.

    The first key column becomes the partition key, the others cluster it. One row: the proposal,
    whether the whole key is unique, partitions, the largest one and its share.
    """
    if not source_key:
        raise KeyspanError("the source table has no primary key")
    first, rest = source_key[0], list(source_key[1:])
    by_key = df.groupBy(*source_key).agg(F.count(F.lit(1)).alias("n"))
    per_partition = by_key.groupBy(first).agg(
        F.sum("n").alias("rows"), F.max("n").alias("most")
    )
    return per_partition.agg(
        F.lit(first).alias("partition_key"),
        F.lit(", ".join(rest)).alias("clustering_key"),
        (F.max("most") == 1).alias("key_is_unique"),
        F.count(F.lit(1)).alias("partitions"),
        F.max("rows").alias("largest_partition"),
        (F.max("rows") * 100.0 / F.sum("rows")).alias("largest_percent"),
    )


def _row_hashes(df: DataFrame, columns: list[str]) -> list[Column]:
    """Two hashes of a row; null flags keep a null apart from a value that hashes alike."""

    def value(c: str) -> Column:
        if isinstance(df.schema[c].dataType, T.MapType):
            return F.array_sort(F.map_entries(F.col(f"`{c}`")))
        return F.col(f"`{c}`")

    flags = F.concat(F.lit(""), *[F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in columns])
    values = [value(c) for c in columns]
    return [F.xxhash64(flags, *values), F.xxhash64(F.lit(7919), *values, flags)]


def _pieces(value: Column) -> list[Column]:
    """A 64-bit hash as three numbers small enough to be summed over trillions of rows."""
    mask = F.lit(2**22 - 1)
    return [
        F.shiftrightunsigned(value, 44).bitwiseAND(mask),
        F.shiftrightunsigned(value, 22).bitwiseAND(mask),
        value.bitwiseAND(mask),
    ]


def _range_digests(df: DataFrame, keys: list[str], compared: list[str], bits: int, side: str) -> DataFrame:
    """For each range of key hashes, told by the first ``bits`` of them, the rows and a sum of their hashes."""
    one, two = _row_hashes(df, [*keys, *compared])
    place = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), 64 - bits)
    lost = reduce(Column.__or__, [F.col(f"`{k}`").isNull() for k in keys])
    hashed = df.select(place.alias("_range"), one.alias("_one"), two.alias("_two"), lost.alias("_lost"))
    pieces = [F.sum(p) for p in (*_pieces(F.col("_one")), *_pieces(F.col("_two")))]
    return hashed.groupBy("_range").agg(
        F.count(F.lit(1)).alias(f"{side}_rows"), F.array(*pieces).alias(f"{side}_digest"), F.max("_lost").alias(f"{side}_lost")
    )


def _inside(df: DataFrame, keys: list[str], ranges: DataFrame, bits: int) -> DataFrame:
    place = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), 64 - bits)
    # At most RANGES numbers.
    return df.join(F.broadcast(ranges), place == F.col("_range"), "left_semi")


def differing_ranges(
    a: DataFrame, b: DataFrame, keys: list[str], compared: list[str], fan_bits: int = FAN_BITS, few_rows: int = FEW_ROWS
) -> tuple[DataFrame, int, int]:
    """Ranges of key hashes in which two tables differ, by a tree of digests from its root down.

    A level gives each range of the level above that differs ``2 ** fan_bits`` ranges of its own; the next one is made while
    more than ``few_rows`` rows lie in differing ranges and it has at most ``RANGES`` ranges. Only digests are
    shuffled: at most one row per range and task. Returns the ranges (``_range``), how many there are, and the
    bits that tell them.
    """
    bits, left, right = 0, a, b
    while True:
        bits += fan_bits
        both = _range_digests(left, keys, compared, bits, "left").join(
            _range_digests(right, keys, compared, bits, "right"), "_range", "full_outer"
        )
        same = F.col("left_rows").eqNullSafe(F.col("right_rows")) & F.col("left_digest").eqNullSafe(F.col("right_digest"))
        # Rows whose key holds a null stand in no pair, so their ranges differ always.
        same = same & ~F.col("left_lost") & ~F.col("right_lost")
        rows = F.coalesce("left_rows", F.lit(0)) + F.coalesce("right_rows", F.lit(0))
        found = materialize(both.where(~F.coalesce(same, F.lit(False))).select("_range", rows.alias("_rows")), "ranges")
        count, held = found.agg(F.count(F.lit(1)), F.sum("_rows")).first()
        ranges = found.select("_range")
        if not count or held <= few_rows or count << fan_bits > RANGES or bits + fan_bits > 63:
            return ranges, count, bits
        left, right = _inside(a, keys, ranges, bits), _inside(b, keys, ranges, bits)


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Keys that differ between two tables: ``status`` is missing, extra or changed.

    Digests of key ranges are compared first (a job), and only rows of ranges that differ go on: equal tables shuffle
    digests alone. Then each side is reduced to one row per key (row count and a sum of row hashes, so repeated
    keys and the order of rows do not matter); the join reuses that partitioning. Only keys and hashes are
    shuffled, not the rows. Keys with a null differ from all others; keys of unlike types are joined without digests.
    """
    compared = columns if columns is not None else [c for c in a.columns if c not in keys]
    missing = [c for c in compared if c not in b.columns]
    if missing:
        raise KeyspanError("columns only on one side: " + ", ".join(missing))
    if [a.schema[k].dataType for k in keys] == [b.schema[k].dataType for k in keys]:
        ranges, count, bits = differing_ranges(a, b, keys, compared)
        a, b = (_inside(df, keys, ranges, bits) if count else df.limit(0) for df in (a, b))

    marks = [f"_{h}{i}" for h in (1, 2) for i in range(3)]

    def digest(df: DataFrame, side: str) -> DataFrame:
        one, two = _row_hashes(df, compared)
        hashed = df.select(*keys, one.alias("_one"), two.alias("_two"))
        pieces = [*_pieces(F.col("_one")), *_pieces(F.col("_two"))]
        return hashed.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"{side}_rows"), *[F.sum(p).alias(f"{side}{m}") for p, m in zip(pieces, marks)]
        )

    joined = digest(a, "left").join(digest(b, "right"), keys, "full_outer")
    same = F.col("left_rows") == F.col("right_rows")
    for m in marks:
        same = same & (F.col(f"left{m}") == F.col(f"right{m}"))
    status = (
        F.when(F.col("right_rows").isNull(), "missing")
        .when(F.col("left_rows").isNull(), "extra")
        .when(~same, "changed")
    )
    return joined.select(*keys, status.alias("status"), "left_rows", "right_rows").where(F.col("status").isNotNull())


def reconcile_summary(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """How many keys are missing, extra and changed: one row."""
    found = reconcile(a, b, keys, columns)
    return found.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("missing", "extra", "changed")])


def duplicate_table(
    spark: SparkSession, src: str, dst: str, where: str | None = None, copy_data: bool = True
) -> DataFrame:
    """Copy a Parquet table to a new path, filtered or only its schema; returns the copy."""
    table = spark.read.parquet(src)
    if not copy_data:
        table = table.where(F.lit(False))
    elif where:
        table = table.where(where)
    table.write.mode("errorifexists").parquet(dst)
    return spark.read.parquet(dst)


def copy_tables(
    spark: SparkSession, src: str, dst: str, tables: list[str], truncate: bool = False, verify_keys: dict | None = None,
    copy_data: bool = True, keys: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Copy Parquet tables from one folder to another: table, rows read, rows in copy, warning.

    The loop is over table names; each copy is a Spark write whose rows are counted on the way and
    again in the result. A target with rows is replaced with ``truncate``; with ``keys`` of the table its rows
    with the same key are replaced and the others stay; otherwise it is refused. ``verify_keys`` also compares contents of the tables it names by key.
    Without ``copy_data`` only the (empty) tables are made.
    """
    from pyspark.sql import Observation

    report = []
    for name in tables:
        seen = Observation(f"copy-{uuid.uuid4().hex}")
        source = spark.read.parquet(f"{src}/{name}.parquet" if path_exists(spark, f"{src}/{name}.parquet") else f"{src}/{name}")
        source = source if copy_data else source.where(F.lit(False))
        target = f"{dst}/{name}"
        watched = source.observe(seen, F.count(F.lit(1)).alias("rows"))
        old = spark.read.parquet(target) if not truncate and path_exists(spark, target) else None
        kept = 0
        if old is None or old.isEmpty():
            watched.write.mode("overwrite").parquet(target)
        elif keys and name in keys:
            others = old.join(source.select(*keys[name]).distinct(), keys[name], "left_anti")
            kept = others.count()
            replace_table(others.unionByName(watched), target)
        else:
            raise KeyspanError(f"{target} has rows; name the table's key or truncate it")
        copied = spark.read.parquet(target).count() - kept
        read = seen.get["rows"]
        warning = None if copied == read else f"{read} rows read but {copied} written"
        if warning is None and verify_keys and name in verify_keys:
            diff = reconcile_summary(source, spark.read.parquet(target), verify_keys[name]).first()
            if any(diff):
                warning = f"contents differ: {diff.asDict()}"
        report.append((name, read, copied, warning))
    return spark.createDataFrame(report, "table string, rows_read bigint, rows_copied bigint, warning string")


def replace_table(df: DataFrame, path: str, keep_old: bool = False) -> str | None:
    """Write ``df`` beside the table at ``path``, then swap the folders by two renames.

    ``df`` may read from ``path`` itself. If the write fails the table is untouched; if the job dies
    between the renames the old version is beside it as ``<path>.old-...``. With ``keep_old`` it
    stays there and its path is returned.
    """
    from keyspan.session import delete_path

    spark = df.sparkSession
    tag = uuid.uuid4().hex
    fresh, old = f"{path}.next-{tag}", f"{path}.old-{tag}"
    df.write.parquet(fresh)
    if path_exists(spark, path):
        rename_path(spark, path, old)
    else:
        old = None
    rename_path(spark, fresh, path)
    if old and not keep_old:
        delete_path(spark, old)
        old = None
    return old


def truncate_table(spark: SparkSession, path: str) -> DataFrame:
    """Empty a table, keep its schema."""
    empty = spark.read.parquet(path).where(F.lit(False))
    replace_table(empty, path)
    return spark.read.parquet(path)


# --- statements ---------------------------------------------------------------------------------


def identifier(name: str) -> str:
    """A name as it must be written: quoted unless lower case letters, digits and underscores."""
    import re

    if re.fullmatch(r"[a-z][a-z0-9_]*", name):
        return name
    return '"' + name.replace('"', '""') + '"'


def literal(c: Column, dtype: T.DataType, kind: str | None = None) -> Column:
    """A value as statement text. ``kind`` marks text that is written bare (uuid, varint, ...)."""
    if kind and kind.startswith("set<") and isinstance(dtype, T.ArrayType):
        return _collection(c, dtype.elementType, "{", "}", kind[4:-1])
    if kind in ("uuid", "timeuuid", "varint", "decimal"):
        body = c.cast("string")
    elif isinstance(dtype, T.StringType):
        body = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    elif isinstance(dtype, T.BinaryType):
        body = blob_text(c)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        body = F.concat(F.lit("'"), timestamp_text(c), F.lit("'"))
    elif isinstance(dtype, T.DateType):
        body = F.concat(F.lit("'"), c.cast("string"), F.lit("'"))
    elif isinstance(dtype, T.ArrayType):
        return _collection(c, dtype.elementType, "[", "]")
    elif isinstance(dtype, T.MapType):
        pairs = F.transform(
            F.map_entries(c),
            lambda e: F.concat(literal(e["key"], dtype.keyType), F.lit(": "), literal(e["value"], dtype.valueType)),
        )
        body = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    elif isinstance(dtype, T.StructType):
        tuple_like = is_tuple(dtype)
        parts = [
            F.concat(F.lit("" if tuple_like else identifier(f.name) + ": "), literal(c[f.name], f.dataType))
            for f in dtype.fields
        ]
        inner = F.concat_ws(", ", *parts)
        body = F.concat(F.lit("(" if tuple_like else "{"), inner, F.lit(")" if tuple_like else "}"))
    else:
        body = c.cast("string")
    return F.coalesce(body, F.lit("null"))


def _collection(c: Column, element: T.DataType, left: str, right: str, kind: str | None = None) -> Column:
    items = F.transform(c, lambda x: literal(x, element, kind))
    return F.coalesce(F.concat(F.lit(left), F.array_join(items, ", "), F.lit(right)), F.lit("null"))


def batch_statements(planned: DataFrame, spec: TableSpec) -> DataFrame:
    """One batch text per planned batch, from rows with ``statement`` and ``batch``. A batch is
    bounded by the plan, so collecting its statements is too."""
    listed = F.array_sort(F.collect_list(F.struct(*spec.clustering_names, "statement")))
    body = F.array_join(F.transform(listed, lambda r: r["statement"]), "\n  ")
    text = F.concat(F.lit("BEGIN BATCH\n  "), body, F.lit("\nAPPLY BATCH;"))
    return planned.groupBy(*spec.partition_key, "batch").agg(text.alias("statement"))


def generate_statements(
    df: DataFrame,
    table: str,
    kind: str,
    spec: TableSpec,
    columns: list[str] | None = None,
    ttl: int | None = None,
    timestamp: int | None = None,
    conditions: bool = False,
    kinds: dict[str, str] | None = None,
    set_cols: str | None = None,
) -> DataFrame:
    """One INSERT, UPDATE or DELETE text per row in column ``statement``, beside the key.

    ``columns`` restricts what is written; with ``set_cols`` a row writes only the columns it lists.
    """
    kind = kind.upper()
    kinds = kinds or {}
    spec.require_key(df.columns)
    chosen = [c for c in (columns or df.columns) if c in df.columns and c != set_cols]
    text = {c: literal(F.col(f"`{c}`"), df.schema[c].dataType, kinds.get(c)) for c in dict.fromkeys([*chosen, *spec.key])}
    parts = ([f"TTL {ttl}"] if ttl and ttl > 0 and kind != "DELETE" else []) + (
        [f"TIMESTAMP {timestamp}"] if timestamp is not None else []
    )
    using = " USING " + " AND ".join(parts) if parts else ""
    where = F.concat_ws(" AND ", *[F.concat(F.lit(f"{identifier(k)} = "), text[k]) for k in spec.key])

    def written(c: str, value: Column) -> Column:
        if set_cols is None or c in spec.key:
            return value
        return F.when(F.array_contains(set_cols, F.lit(c)), value)

    if kind == "INSERT":
        spec.require_key(chosen)
        names = F.concat_ws(", ", *[written(c, F.lit(identifier(c))) for c in chosen])
        values = F.concat_ws(", ", *[written(c, text[c]) for c in chosen])
        tail = (" IF NOT EXISTS" if conditions else "") + using
        statement = F.concat(
            F.lit(f"INSERT INTO {table} ("), names, F.lit(") VALUES ("), values, F.lit(")" + tail + ";")
        )
    elif kind == "UPDATE":
        changed = [c for c in chosen if c not in spec.key]
        if not changed:
            raise KeyspanError("an update needs at least one column outside the key")
        sets = F.concat_ws(", ", *[written(c, F.concat(F.lit(f"{identifier(c)} = "), text[c])) for c in changed])
        tail = " IF EXISTS" if conditions else ""
        statement = F.concat(F.lit(f"UPDATE {table}{using} SET "), sets, F.lit(" WHERE "), where, F.lit(tail + ";"))
    elif kind == "DELETE":
        tail = " IF EXISTS" if conditions else ""
        statement = F.concat(F.lit(f"DELETE FROM {table}{using} WHERE "), where, F.lit(tail + ";"))
    else:
        raise KeyspanError(f"unknown statement kind {kind}")
    return df.select(*spec.key, statement.alias("statement"))
