"""Counts, key ranges and skew statistics.

Everything is one grouped count with map-side partial sums; a partition key that holds a third of
the table arrives at the reducer as one partial row per task. Shares, rankings and totals are
derived from the grouped result, not from the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyspan.functions.rendering import key_text
from keyspan.functions.tokens import split_of, split_ranges, token
from keyspan.model import KeyspanError, TableSpec
from keyspan.session import materialize

# Report sections, their order and the cap of a detail section.
MODES = ("global", "hosts", "ranges", "partitions")
DETAIL_CAP = 500

STATS_SCHEMA = "section string, item string, range_start string, range_end string, rows bigint, percent double"


def normalise_modes(modes, has_clustering: bool = True) -> list[str]:
    """Known modes once each in request order; none left means ``global``."""
    out: list[str] = []
    for mode in modes or ():
        name = (mode or "").strip().lower()
        name = "partitions" if name == "biggest-partitions" else name
        if name in MODES and name not in out:
            out.append(name)
    if "partitions" in out and not has_clustering:
        raise KeyspanError("the partitions mode needs a clustering column: every partition is one row")
    return out or ["global"]


def split_scan(df: DataFrame, keys: list[str], splits: int) -> DataFrame:
    """Add ``split_id``: the even token range of each row's partition key. No shuffle."""
    return df.withColumn("split_id", split_of(token(*keys), splits))


def partition_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per partition key: the key columns, ``partition_key`` as text, ``rows``."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(*keys, key_text(keys).alias("partition_key"), "rows")


def largest_partitions(df: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The ``n`` largest partitions, largest first, with their share of the table."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.select(F.sum("rows")).scalar()
    top = counts.orderBy(F.desc("rows"), *keys).limit(n)
    return top.select(
        *keys,
        key_text(keys).alias("partition_key"),
        "rows",
        (F.lit(100.0) * F.col("rows") / total).alias("percent"),
    )


def partition_count(df: DataFrame, keys: list[str], approximate: bool = False, error: float = 0.01) -> DataFrame:
    """Number of partitions, exact unless ``approximate`` (then with a relative standard ``error``)."""
    key = F.struct(*keys)
    counted = F.approx_count_distinct(F.xxhash64(*keys), error) if approximate else F.count_distinct(key)
    return df.agg(counted.alias("partitions"))


def distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def key_tiles(df: DataFrame, keys: list[str], tiles: int) -> DataFrame:
    """Ranges of the key itself, of about equally many keys: tile, keys, rows, lo, hi. Empty tiles have no row.

    Rows are counted per key before keys are dealt to ranges, so a hot key is one row. The tiles are written, because
    bounds are sampled and another run may choose others.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    ranged = counts.repartitionByRange(tiles, *keys).withColumn("tile", F.spark_partition_id())
    key = F.struct(*keys)
    found = ranged.groupBy("tile").agg(
        F.count(F.lit(1)).alias("keys"), F.sum("_rows").alias("rows"), F.min(key).alias("lo"), F.max(key).alias("hi")
    )
    return materialize(found, "key-tiles")


def rows_per_range(counts: DataFrame, splits: int) -> DataFrame:
    """``(split_id, rows)`` grouped counts joined to the table of splits: empty ranges show 0."""
    ranges = split_ranges(counts.sparkSession, splits)
    filled = ranges.join(counts, "split_id", "left").select(
        "split_id", "range_start", "range_end", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows")
    )
    return _with_percent(filled)


def range_counts(df: DataFrame, keys: list[str], splits: int) -> DataFrame:
    """Rows per token range: split_id, range_start, range_end, rows, percent."""
    counts = split_scan(df.select(*keys), keys, splits).groupBy("split_id").agg(
        F.count(F.lit(1)).alias("rows")
    )
    return rows_per_range(counts, splits)


def width_range_counts(df: DataFrame, column: str, splits: int) -> DataFrame:
    """Rows per equal-width range of one integer key, between its smallest and largest value."""
    bounds = df.select(
        F.struct(F.min(column).cast("bigint").alias("lo"), F.max(column).cast("bigint").alias("hi"))
    ).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    value = F.col(column).cast("bigint")
    split = F.least(
        F.lit(splits - 1).cast("bigint"),
        F.floor((value - lo).cast("decimal(20,0)") * splits / (hi - lo + 1)).cast("bigint"),
    )
    counts = df.select(split.alias("split_id")).groupBy("split_id").agg(F.count(F.lit(1)).alias("rows"))
    every = df.sparkSession.range(0, splits, 1, 1).withColumnRenamed("id", "split_id")
    filled = every.join(counts, "split_id", "left").select(
        "split_id", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows")
    )
    return _with_percent(filled)


def replica_counts(ranges: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows per owner from rows per range and a table of (split_id, owner): a range counts for each of its owners."""
    total = ranges.select(F.sum("rows")).scalar()
    return (
        ranges.select("split_id", "rows")
        .join(owners, "split_id")
        .groupBy("owner")
        .agg(F.sum("rows").alias("rows"))
        .select("owner", "rows", (F.lit(100.0) * F.col("rows") / total).alias("percent"))
    )


def count_stats(
    df: DataFrame,
    keys: list[str],
    modes=("global",),
    splits: int = 64,
    top: int = 10,
    owners: DataFrame | None = None,
    has_clustering: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """The statistics report: one row per figure with ``section``, ``item``, range, rows, percent.

    Only the asked sections are computed. ``global`` and ``ranges`` need no grouping by key; with
    ``partitions`` every section reads the same grouped count, so the table is scanned once.
    A row of ``df`` stands for as many rows as its column ``weight`` says, if one is named.
    """
    wanted = normalise_modes(modes, has_clustering)
    if "hosts" in wanted and owners is None:
        raise KeyspanError("the hosts mode needs the owners of each split")
    spark = df.sparkSession
    narrow = df.select(*keys, *_named(weight))
    split = split_of(token(*keys), splits).alias("split_id")
    counted = _counted(weight).alias("rows")
    by_key = narrow.groupBy(*keys).agg(counted) if "partitions" in wanted else None
    if by_key is not None:
        by_split = by_key.groupBy(split).agg(F.sum("rows").alias("rows"))
    else:
        by_split = narrow.groupBy(split).agg(counted)
    ranges = rows_per_range(by_split, splits)
    none = F.lit(None).cast("string")
    parts = []
    for mode in wanted:
        if mode == "global":
            source = (
                by_split.agg(F.coalesce(F.sum("rows"), F.lit(0).cast("bigint")).alias("rows"))
                if len(wanted) > 1
                else narrow.agg(F.coalesce(counted, F.lit(0)).alias("rows"))
            )
            parts.append(
                source.select(
                    F.lit("global").alias("section"), F.lit("total").alias("item"),
                    none.alias("range_start"), none.alias("range_end"), "rows", F.lit(100.0).alias("percent"),
                )
            )
        elif mode == "ranges":
            parts.append(
                ranges.select(
                    F.lit("ranges").alias("section"), F.col("split_id").cast("string").alias("item"),
                    "range_start", "range_end", "rows", "percent",
                )
            )
        elif mode == "hosts":
            parts.append(
                replica_counts(ranges, owners).select(
                    F.lit("hosts").alias("section"), F.col("owner").cast("string").alias("item"),
                    none.alias("range_start"), none.alias("range_end"), "rows", "percent",
                )
            )
        else:
            total = by_split.select(F.sum("rows")).scalar()
            parts.append(
                by_key.orderBy(F.desc("rows"), *keys).limit(top).select(
                    F.lit("partitions").alias("section"), key_text(keys).alias("item"),
                    none.alias("range_start"), none.alias("range_end"), "rows",
                    (F.lit(100.0) * F.col("rows") / total).alias("percent"),
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _named(weight: str | None) -> list[str]:
    return [weight] if weight else []


def _counted(weight: str | None) -> Column:
    return F.sum(weight) if weight else F.count(F.lit(1))


def total_rows(stats: DataFrame) -> DataFrame:
    """The total of a report: the global figure, else the sum of the ranges, else of the hosts."""

    def section_sum(name: str) -> Column:
        return F.sum(F.when(F.col("section") == name, F.col("rows")))

    return stats.agg(
        F.coalesce(section_sum("global"), section_sum("ranges"), section_sum("hosts"), F.lit(0)).alias("rows")
    )


def cap_detail(df: DataFrame, n: int = DETAIL_CAP, by: str | None = "rows", tie: list[str] = ()) -> DataFrame:
    """A detail section cut to ``n`` rows for display, busiest first, saying how many there were."""
    reported = df.select(F.count(F.lit(1))).scalar()
    order = [F.desc(by)] if by else []
    cut = df.orderBy(*order, *tie).limit(n) if order or tie else df.limit(n)
    return cut.withColumns({"reported": reported, "truncated": reported > F.lit(n)})


def table_statistics(
    df: DataFrame,
    keys: list[str],
    identity: str,
    splits: int = 64,
    top: int = 10,
    owners: DataFrame | None = None,
    computed_at: Column | None = None,
    detail_cap: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """A statistics snapshot ready to be stored: the report plus identity, partition count and time.

    Every range is kept. With ``detail_cap`` sections are cut for display; the figures ``reported`` and
    ``truncated`` say so, and the total and the partition count are always those of the whole table.
    """
    modes = ["global", "ranges", "partitions"] + (["hosts"] if owners is not None else [])
    report = count_stats(df, keys, modes, splits, top, owners, weight=weight)
    by_key = df.select(*keys, *_named(weight)).groupBy(*keys).agg(_counted(weight).alias("rows"))
    none = F.lit(None).cast("string")
    # Counting the rows column, not only the keys, lets Spark reuse the shuffle of the report.
    partitions = by_key.agg(F.count(F.when(F.col("rows") > 0, 1)).alias("rows")).select(
        F.lit("partition_count").alias("section"), F.lit("total").alias("item"),
        none.alias("range_start"), none.alias("range_end"), "rows", F.lit(None).cast("double").alias("percent"),
    )
    whole = report.unionByName(partitions)
    section = Window.partitionBy("section")
    ranked = whole.withColumns(
        {
            "reported": F.count(F.lit(1)).over(section),
            "rank": F.row_number().over(section.orderBy(F.desc("rows"), "item")),
        }
    )
    if detail_cap is not None:
        ranked = ranked.where(F.col("rank") <= detail_cap)
    return ranked.select(
        F.lit(identity).alias("identity"),
        "section", "rank", "item", "range_start", "range_end", "rows", "percent", "reported",
        (F.col("reported") > F.lit(detail_cap) if detail_cap is not None else F.lit(False)).alias("truncated"),
        (F.current_timestamp() if computed_at is None else computed_at).alias("computed_at"),
    )


# The built-in aggregates.
AGGREGATES = {"count": F.count, "min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg}


def aggregate_by_key(df: DataFrame, spec: TableSpec, by: list[str], aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    """Built-in aggregates grouped by a prefix of the primary key (or over the whole table).

    ``aggregates`` maps an output name to ``(function, column)``; ``("count", "*")`` counts rows.
    """
    if list(by) != spec.key[: len(by)]:
        raise KeyspanError("GROUP BY takes the key columns from the left, in order: " + ", ".join(spec.key))
    made = []
    for name, (function, column) in aggregates.items():
        if function not in AGGREGATES:
            raise KeyspanError(f"unknown aggregate {function}")
        argument = F.lit(1) if column == "*" else F.col(column)
        made.append(AGGREGATES[function](argument).alias(name))
    return df.groupBy(*by).agg(*made)


def write_fanout(changes: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """Partitions each batch of writes touches; a write whose key is unknown counts on its own."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    grouped = changes.groupBy(batch).agg(
        F.count(F.lit(1)).alias("statements"),
        F.count_distinct(F.when(known, F.struct(*keys))).alias("known"),
        F.count(F.when(~known, 1)).alias("unknown"),
    )
    partitions = F.greatest(F.col("known") + F.col("unknown"), F.lit(1).cast("bigint"))
    return grouped.select(
        batch, "statements", partitions.alias("partitions"), (partitions > 1).alias("spans_partitions")
    )


def audit_splits(df: DataFrame, keys: list[str], splits: int) -> DataFrame:
    """Prove that the splits tile the table: one row per split with its range, its rows, whether
    the range starts where the one before ended, and whether all its tokens lie inside the range.

    A table that carries ``split_id`` already (an export by split) is audited by that column.
    """
    spark = df.sparkSession
    scanned = df if "split_id" in df.columns else split_scan(df.select(*keys), keys, splits)
    per_split = scanned.select("split_id", token(*keys).alias("token")).groupBy("split_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("token").alias("lo"), F.max("token").alias("hi")
    )
    ranges = (
        split_ranges(spark, splits)
        .withColumn("start", F.col("range_start").cast("bigint"))
        .withColumn("end", F.col("range_end").cast("bigint"))
    )
    # A split is joined to its neighbours by their numbers.
    ends = ranges.select((F.col("split_id") + 1).alias("split_id"), F.col("end").alias("ended"))
    starts = ranges.select((F.col("split_id") - 1).alias("split_id"), F.col("start").alias("next"))
    ranges = ranges.join(ends, "split_id", "left").join(starts, "split_id", "left").withColumn(
        "expected", F.coalesce("ended", F.expr("-9223372036854775807L - 1L"))
    )
    at_end = F.col("next").isNotNull() | (F.col("end") == F.lit(2**63 - 1))
    above = (F.col("lo") > F.col("start")) | (F.col("split_id") == 0)
    return ranges.join(per_split, "split_id", "left").select(
        "split_id",
        "range_start",
        "range_end",
        F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"),
        ((F.col("start") == F.col("expected")) & at_end).alias("contiguous"),
        F.coalesce(above & (F.col("hi") <= F.col("end")), F.lit(True)).alias("inside"),
    )


def audit_summary(df: DataFrame, keys: list[str], splits: int, per_key: bool = False) -> DataFrame:
    """One row: splits, rows in splits, rows in the table, gaps, splits with stray rows.

    ``per_key`` adds the number of keys found in more than one split. It groups by key; without
    stray splits the answer is zero, so the cheaper check is the default.
    """
    audit = audit_splits(df, keys, splits)
    figures = {"rows_in_table": df.select(F.count(F.lit(1))).scalar()}
    if per_key:
        scanned = df if "split_id" in df.columns else split_scan(df.select(*keys), keys, splits)
        figures["keys_in_many_splits"] = (
            scanned.groupBy(*keys)
            .agg(F.min("split_id").alias("lo"), F.max("split_id").alias("hi"))
            .select(F.count(F.when(F.col("lo") != F.col("hi"), 1)))
            .scalar()
        )
    return audit.agg(
        F.count(F.lit(1)).alias("splits"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_in_splits"),
        F.count(F.when(~F.col("contiguous"), 1)).alias("gaps"),
        F.count(F.when(~F.col("inside"), 1)).alias("stray_splits"),
    ).withColumns(figures)


def _with_percent(counts: DataFrame) -> DataFrame:
    """Share of each row in the total of a small grouped result."""
    total = counts.select(F.sum("rows")).scalar()
    return counts.withColumn(
        "percent", F.when(total == 0, F.lit(0.0)).otherwise(F.lit(100.0) * F.col("rows") / total)
    )
