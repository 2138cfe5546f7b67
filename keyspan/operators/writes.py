"""Keyed writes: upsert, partial update, delete, conditions, expiry, counters, batches.

Changes are reduced to one row per key first (map-side partial aggregation, so one key may own most
of the changes). The base table is then joined, never aggregated or windowed: with a small change
set Spark broadcasts it and the base is not shuffled at all. New rows are found by an inner join on
the key columns alone, which reads only those columns of the base. A base that already holds a
key twice keeps both rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.model import KeyspanError, TableSpec
from keyspan.session import materialize

BATCH_STATEMENTS = 32


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_holds_map(f.dataType) for f in dtype)
    return isinstance(dtype, T.MapType) or isinstance(dtype, T.ArrayType) and _holds_map(dtype.elementType)


def orderable(value: Column, dtype: T.DataType) -> Column:
    """A value that Spark can compare and sort: maps, at any depth, become their sorted entries."""
    if not _holds_map(dtype):
        return value
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(orderable(e["key"], dtype.keyType).alias("k"), orderable(e["value"], dtype.valueType).alias("v")),
        )
        return F.array_sort(entries)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: orderable(x, dtype.elementType))
    fields = [orderable(value[f.name], f.dataType).alias(f.name) for f in dtype]
    return F.when(value.isNotNull(), F.struct(*fields))


def _ordered(df: DataFrame, names) -> list[Column]:
    return [orderable(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in names]


def nullable(dtype: T.DataType) -> T.DataType:
    """The type with nulls allowed inside; a cast to fewer nulls is refused whatever the values are."""
    if isinstance(dtype, T.MapType):
        return T.MapType(nullable(dtype.keyType), nullable(dtype.valueType), True)
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(nullable(dtype.elementType), True)
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in dtype])
    return dtype


def _named(df: DataFrame, names) -> list[str]:
    """Column names as the table spells them; matching ignores case."""
    actual = {c.lower(): c for c in df.columns}
    return [actual[n.lower()] for n in names if n.lower() in actual]


def align_names(changes: DataFrame, base: DataFrame) -> DataFrame:
    """Rename change columns to the spelling of the table they are meant for."""
    spelled = {c.lower(): c for c in base.columns}
    return changes.select([F.col(f"`{c}`").alias(spelled.get(c.lower(), c)) for c in changes.columns])


def set_columns(names: list[str], null_to_unset: bool) -> Column:
    """Array of the columns a change writes. With ``null_to_unset`` a null is not written."""
    listed = [F.when(F.col(n).isNotNull() if null_to_unset else F.lit(True), F.lit(n)) for n in names]
    return F.array_compact(F.array(*listed))


def winning_changes(
    changes: DataFrame,
    spec: TableSpec,
    columns: list[str],
    ts: str | None = None,
    seq: str | None = None,
    set_cols: str | None = None,
    null_to_unset: bool = False,
) -> DataFrame:
    """One row per key: the key, a value and a set flag (``_set_<c>``) per column, ``_ts``.

    The latest change that writes a column decides it, null included. Equal times are decided by
    ``seq``, then by the value itself.
    """

    def is_set(c: str) -> Column:
        written = F.array_contains(set_cols, F.lit(c)) if set_cols else F.lit(True)
        return written & F.col(c).isNotNull() if null_to_unset else written

    order = [F.col(x) for x in (ts, seq) if x]
    made = []
    if set_cols or null_to_unset:
        for c in columns:
            place = F.struct(*order, *_ordered(changes, [c]))
            made.append(F.max_by(F.when(is_set(c), F.col(c)), F.when(is_set(c), place)).alias(c))
            made.append(F.coalesce(F.bool_or(is_set(c)), F.lit(False)).alias(f"_set_{c}"))
    elif columns:
        row = F.struct(*[F.col(c) for c in columns])
        made.append(F.max_by(row, F.struct(*order, *_ordered(changes, columns))).alias("_row"))
    if ts:
        made.append(F.max(ts).alias("_ts"))
    if not made:
        made.append(F.lit(True).alias("_hit"))
    reduced = changes.groupBy(*spec.key).agg(*made)
    if not (set_cols or null_to_unset) and columns:
        reduced = reduced.select(
            *spec.key,
            *[F.col(f"_row.{c}").alias(c) for c in columns],
            *[F.lit(True).alias(f"_set_{c}") for c in columns],
            *(["_ts"] if ts else []),
        )
    return reduced


def _fits_broadcast(written: DataFrame) -> bool:
    """Whether the files of a written table are within Spark's broadcast limit."""
    execution = written._jdf.queryExecution()
    limit = written.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(execution.optimizedPlan().stats().sizeInBytes())) <= limit


def with_delta(base: DataFrame, delta: DataFrame, key: list[str], stage: bool = True) -> DataFrame:
    """Every base row and every delta-only row, side by side: base columns, delta columns prefixed
    ``d_``, and the flags ``_in_base`` and ``d__hit``.

    The result is that of a full outer join. The delta is written to the work folder first, and the size
    of its files decides the plan, not the rows: one that Spark can broadcast is joined as a left join plus
    the unmatched delta rows, which leaves the base where it is; a larger one in a full outer join, which
    reads and shuffles the base once. Without ``stage`` nothing runs before the result is asked for.
    """
    if stage:
        delta = materialize(delta, "delta")
    renamed = delta.select(*[F.col(f"`{c}`").alias(f"d_{c}") for c in delta.columns], F.lit(True).alias("d__hit"))
    keys = [f"d_{k}" for k in key]
    on = [F.col(f"`{k}`") == F.col(f"`d_{k}`") for k in key]
    if stage and not _fits_broadcast(delta):
        both = base.withColumn("_in_base", F.lit(True)).join(renamed, on, "full_outer")
        return both.withColumn("_in_base", F.coalesce("_in_base", F.lit(False)))
    joined = base.withColumn("_in_base", F.lit(True)).join(renamed, on, "left")
    known = base.select(*key).join(renamed.select(*keys), on).select(*keys)
    fresh = renamed.join(known, keys, "left_anti")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema]
    added = fresh.select(*empty, F.lit(False).alias("_in_base"), *renamed.columns)
    return joined.unionByName(added)


def merge_rows(
    base: DataFrame, delta: DataFrame, key: list[str], update: dict[str, Column], insert: dict[str, Column],
    stage: bool = True,
) -> DataFrame:
    """``base`` with ``delta`` (one row per key) applied.

    ``update`` gives new values of matched rows, ``insert`` those of rows only the delta has; both
    see the columns of ``with_delta``.
    """
    out = []
    for c in base.columns:
        dtype = nullable(base.schema[c].dataType)
        added = insert.get(c, F.lit(None)).cast(dtype)
        kept = F.col(f"`{c}`").cast(dtype)
        if c in update:
            # The table keeps its types; a value that does not fit is an error.
            kept = F.when(F.col("d__hit"), update[c].cast(dtype)).otherwise(kept)
        out.append(F.when(F.col("_in_base"), kept).otherwise(added).alias(c))
    return with_delta(base, delta, key, stage).select(out)


def upsert(
    base: DataFrame,
    changes: DataFrame,
    spec: TableSpec,
    ts: str | None = None,
    seq: str | None = None,
    set_cols: str | None = None,
    null_to_unset: bool = False,
    base_ts: str | None = None,
    stage: bool = True,
) -> DataFrame:
    """Insert or update rows by full key and return the new table.

    ``ts``/``seq`` order the changes of a key, ``set_cols`` names an array column with the columns
    each change writes (all of them without it). With ``base_ts`` a change older than the row's own
    write time loses, and the column is moved forward.
    """
    changes = align_names(changes, base)
    spec.require_key(changes.columns)
    reserved = {x for x in (ts, seq, set_cols) if x}
    columns = [c for c in base.columns if c in changes.columns and c not in spec.key and c not in reserved]
    if base_ts and not ts:
        raise KeyspanError("base_ts needs the write time of the changes")
    delta = winning_changes(changes, spec, columns, ts, seq, set_cols, null_to_unset)
    newer = F.col("d__ts") >= F.col(f"`{base_ts}`") if base_ts else F.lit(True)
    newer = F.coalesce(newer, F.lit(True))
    update = {
        c: F.when(F.col(f"`d__set_{c}`") & newer, F.col(f"`d_{c}`").cast(nullable(base.schema[c].dataType)))
        .otherwise(F.col(f"`{c}`").cast(nullable(base.schema[c].dataType)))
        for c in columns
    }
    insert = {**{k: F.col(f"`d_{k}`") for k in spec.key}, **{c: F.col(f"`d_{c}`") for c in columns}}
    if base_ts:
        update[base_ts] = F.greatest(F.col(f"`{base_ts}`"), F.col("d__ts"))
        insert[base_ts] = F.col("d__ts")
    return merge_rows(base, delta, spec.key, update, insert, stage)


def update(base: DataFrame, changes: DataFrame, spec: TableSpec, columns: list[str], **options) -> DataFrame:
    """Set only the named columns. Like an insert it creates a row that is not there yet."""
    spec.refuse_key(columns)
    if not columns:
        raise KeyspanError("an update needs at least one column to set")
    spec.require_key(changes.columns)
    changes = align_names(changes, base)
    reserved = [options[x] for x in ("ts", "seq", "set_cols") if options.get(x)]
    keep = list(dict.fromkeys([*spec.key, *_named(base, columns), *reserved]))
    return upsert(base, changes.select(*keep), spec, **options)


def delete_rows(base: DataFrame, keys: DataFrame, spec: TableSpec) -> DataFrame:
    """The table without the rows named by full key."""
    spec.require_key(keys.columns)
    return base.join(align_names(keys, base).select(*spec.key), spec.key, "left_anti")


def delete_cells(base: DataFrame, keys: DataFrame, spec: TableSpec, columns: list[str]) -> DataFrame:
    """Null out the named cells of the rows named by full key."""
    spec.refuse_key(columns)
    spec.require_key(keys.columns)
    named = align_names(keys, base).select(*spec.key).distinct().withColumn("_hit", F.lit(True))
    joined = base.join(named, spec.key, "left")
    gone = set(_named(base, columns))
    return joined.select(
        [
            F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(f"`{c}`")).cast(base.schema[c].dataType).alias(c)
            if c in gone
            else F.col(f"`{c}`")
            for c in base.columns
        ]
    )


def current_rows(base: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """The base rows that have one of the keys. The small side is the one Spark may broadcast."""
    return base.join(keys.select(*key), key, "left_semi")


def conditional_upsert(
    base: DataFrame,
    changes: DataFrame,
    spec: TableSpec,
    condition: str = "not_exists",
    seq: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Write under a condition; returns the new table and one outcome row per change.

    ``condition`` is ``not_exists``, ``exists`` or a SQL condition that names the current row's
    columns as ``row.<column>``. The outcome holds the key, ``applied`` and, where it failed, the
    ``current`` row. Changes of one key under ``not_exists`` are tried in ``seq`` order: the first
    is applied. The other conditions look at the row as it was before the whole set of changes.
    """
    changes = align_names(changes, base)
    spec.require_key(changes.columns)
    key = spec.key
    columns = [c for c in base.columns if c in changes.columns and c not in key]
    found = current_rows(base, changes, key).select(
        *key,
        F.struct(*[F.col(f"`{c}`").cast(nullable(base.schema[c].dataType)).alias(c) for c in base.columns]).alias("current"),
        F.lit(True).alias("_found"),
    )
    joined = changes.join(found, key, "left")
    exists = F.coalesce(F.col("_found"), F.lit(False))
    if condition == "not_exists":
        place = F.struct(*([F.col(seq).alias("_seq")] if seq else []), *_ordered(changes, columns), F.lit(0).alias("_end"))
        values = F.struct(*[F.col(f"`{c}`") for c in columns], F.lit(0).alias("_end"))
        first = changes.groupBy(*key).agg(F.min(place).alias("_place"), F.min_by(values, place).alias("_first"))
        # Identical first changes are one write: a repeated request.
        joined = joined.join(first, key).withColumn("applied", ~exists & place.eqNullSafe(F.col("_place"))).drop("_place")
        # Written once: both results read what the changes met, neither looks it up again.
        joined = materialize(joined, "conditional")
        seen = F.when(exists, F.col("current")).otherwise(_inserted_row(base, key, columns))
        current = F.when(~F.col("applied"), seen)
        table_changes = joined.where("applied").select(*key, *columns)
    else:
        if condition == "exists":
            ok = exists
        else:
            text = condition.strip()
            text = text[3:] if text.upper().startswith("IF ") else text
            ok = exists & F.coalesce(_over_current(text), F.lit(False))
        joined = materialize(joined.withColumn("applied", ok), "conditional")
        current = F.when(~F.col("applied"), F.col("current"))
        table_changes = joined.where("applied").select(*changes.columns)
    outcome = joined.select(*key, *([seq] if seq else []), "applied", current.alias("current"))
    # Not staged again: who asks only for the outcome does not pay for the table.
    table = upsert(base, table_changes, spec, seq=seq if seq in table_changes.columns else None, stage=False)
    return table, outcome


def _inserted_row(base: DataFrame, key: list[str], columns: list[str]) -> Column:
    fields = []
    for c in base.columns:
        dtype = base.schema[c].dataType
        value = F.col(f"`{c}`") if c in key else F.col("_first")[c] if c in columns else F.lit(None)
        fields.append(value.cast(nullable(dtype)).alias(c))
    return F.struct(*fields)


def _over_current(condition: str) -> Column:
    """A condition on the current row, whatever the changes call their columns: the condition runs
    as a lambda body whose argument is the current row, so its names must read ``row.<column>``."""
    return F.expr(f"element_at(transform(array(current), row -> ({condition})), 1)")


def expire(df: DataFrame, written_at: str, ttl, as_of) -> DataFrame:
    """Rows still alive at ``as_of``: ``written_at`` plus ``ttl`` seconds is later.

    ``ttl`` is a column name or a number (the table default); only positive values expire.
    """
    seconds = F.col(ttl) if isinstance(ttl, str) else F.lit(ttl)
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
    lives = F.col(written_at) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")) > moment
    return df.where(seconds.isNull() | (seconds <= 0) | lives)


def apply_counters(
    base: DataFrame, deltas: DataFrame, keys: list[str], counters: list[str], delta_id: str | None = None
) -> DataFrame:
    """Add increments to counter columns; unknown keys start at zero.

    With ``delta_id`` a replayed increment counts once. Increments are summed map-side before the
    join, so a key with most of the traffic is one row per task.
    """
    if delta_id:
        deltas = deltas.dropDuplicates([delta_id])
    sums = deltas.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])
    update = {
        c: F.when(F.col(f"`d_{c}`").isNull(), F.col(f"`{c}`")).otherwise(
            F.coalesce(F.col(f"`{c}`"), F.lit(0)) + F.col(f"`d_{c}`")
        )
        for c in counters
    }
    insert = {c: F.col(f"`d_{c}`") for c in [*keys, *counters]}
    return merge_rows(base, sums, keys, update, insert)


def counter_totals(deltas: DataFrame, keys: list[str], counters: list[str], delta_id: str | None = None) -> DataFrame:
    """Totals from increments alone."""
    if delta_id:
        deltas = deltas.dropDuplicates([delta_id])
    return deltas.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def plan_batches(
    changes: DataFrame, spec: TableSpec, max_statements: int | None = None, by: list[str] | None = None
) -> DataFrame:
    """Add ``batch``: rows of one partition key in clustering order, at most ``max_statements`` per batch.

    ``by`` groups by other columns instead, such as the owners of a split (replica sets).

    A counter table gets one statement per batch; a table without a clustering key is not batched
    (``batch`` is null). Rows are dealt out by ranges of key and order, so a partition key with a third of
    all rows is numbered by many tasks: within a range, plus what earlier ranges hold of the same key.
    """
    if not spec.clustering and by is None:
        return changes.withColumn("batch", F.lit(None).cast("bigint"))
    limit = 1 if spec.counter else (max_statements or BATCH_STATEMENTS)
    pk = by or list(spec.partition_key)
    order = spec.clustering_names if by is None else spec.key
    dealt = changes.repartitionByRange(*dict.fromkeys([*pk, *order])).withColumn("_range", F.spark_partition_id())
    # Written out: the bounds of the ranges are sampled, and both passes must see the same ones.
    dealt = materialize(dealt, "batches")
    before = Window.partitionBy(*pk).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*pk, "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*pk, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    starts = starts.select(*[F.col(k).alias(f"_{k}") for k in pk], F.col("_range").alias("__range"), "_before")
    same = F.col("_range") == F.col("__range")
    for k in pk:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    place = F.row_number().over(Window.partitionBy(*pk, "_range").orderBy(*order))
    numbered = dealt.withColumn("_place", place).join(starts, same)
    batch = F.floor((F.col("_before") + F.col("_place") - 1) / limit).cast("bigint")
    return numbered.select(*changes.columns, batch.alias("batch"))


def attach_static(rows: DataFrame, statics: DataFrame, partition_key: list[str]) -> DataFrame:
    """Show the static columns of each partition on all of its rows."""
    return rows.join(statics, partition_key, "left")


def static_values(rows: DataFrame, spec: TableSpec, ts: str) -> DataFrame:
    """The static columns of each partition: per column the latest value written on any row."""
    made = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("_ts"), *_ordered(rows, [c])))).alias(c)
        for c in spec.static
    ]
    return rows.groupBy(*spec.partition_key).agg(*made)
