"""The first rows of each partition where partitions may be very large.

Where a partition has many times the rows asked for, the place of its last wanted row is found by rounds of
histograms over the order columns, which shuffle counts only; then a filter leaves about the wanted rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.session import materialize

BINS = 1024
#: Partitions above this many times the limit get a cut; it stops once at most twice the limit is left.
HOT, ENOUGH = 8, 2
#: Cuts are found for at most this many partitions; any other has a smaller share of those rows than one in this many.
HOT_KEYS = 50_000
ROUNDS = 8
_EDGE = 8e307  # stands for null, and bounds every other code


def _long_of(value: Column, kind: T.DataType) -> Column | None:
    """A whole number in the order of the values, one for each."""
    if isinstance(kind, T.LongType):
        return value
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        minutes = F.unix_date(F.to_date(value)).cast("bigint") * 1440 + F.hour(value) * 60 + F.minute(value)
        return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("bigint")
    return None


def codes(df: DataFrame, order: list) -> list[Column]:
    """Numbers whose order is that of the leading order columns; the last one may be equal for values that differ.

    Columns are named as in ``order_columns``; the list ends before a column expression or a type without a number.
    """
    out: list[Column] = []
    for item in [order] if isinstance(order, (str, Column)) else order:
        if isinstance(item, Column):
            return out
        name, _, direction = item.partition(" ")
        value, kind = F.col(name), df.select(name).schema[0].dataType
        sign = -1 if direction.strip().lower() == "desc" else 1
        exact, whole = True, _long_of(value, kind)
        if whole is not None:
            parts = [F.shiftright(whole, 32), whole.bitwiseAND(F.lit(2**32 - 1))]
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            parts = [value]
        elif isinstance(kind, T.BooleanType):
            parts = [value.cast("int")]
        elif isinstance(kind, T.DateType):
            parts = [F.unix_date(value)]
        elif isinstance(kind, T.NumericType):
            number = value.cast("double")
            # NaN sorts above all other numbers.
            parts = [F.least(F.lit(_EDGE / 2), F.greatest(F.lit(-_EDGE / 2), F.when(F.isnan(number), _EDGE).otherwise(number)))]
            exact = False
        elif isinstance(kind, T.StringType):
            start = F.rpad(F.substring(value.cast("binary"), 1, 6), 6, F.lit(b"\0"))
            parts, exact = [F.conv(F.hex(start), 16, 10)], False
        else:
            return out
        # Nulls come first in ascending order and last in descending order.
        out += [F.coalesce(p.cast("double") * sign, F.lit(-_EDGE * sign)) for p in parts]
        if not exact:
            return out
    return out


def _round(coded: DataFrame, open_keys: DataFrame, keys: list[str], level: int, n: int) -> DataFrame:
    """For each open key the bin of its n-th row: its bounds, the rows before it and the rows up to its end."""
    state = [c for c in open_keys.columns if c not in keys]
    renamed = open_keys.select(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)], *state)
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    code, low, high = F.col(f"_code{level}"), F.col("_low"), F.col("_high")
    rows = coded.join(renamed, reduce(Column.__and__, same)).where(code.between(low, high))
    for i in range(level):
        rows = rows.where(F.col(f"_code{i}") == F.col(f"_cut{i}"))
    place = F.when(low == high, 0).otherwise(F.floor((code - low) / (high - low) * BINS)).cast("int")
    cuts = [f"_cut{i}" for i in range(level)]
    bins = (
        rows.withColumn("_bin", F.least(place, F.lit(BINS - 1)))
        .groupBy(*[f"`{k}`" for k in keys], *cuts, "_before", "_bin")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(code).alias("_low"), F.max(code).alias("_high"))
    )
    upto = F.sum("_n").over(Window.partitionBy(*[f"`{k}`" for k in keys]).orderBy("_bin"))
    ended = bins.withColumn("_kept", F.col("_before") + upto).where(F.col("_kept") >= n)
    first = F.row_number().over(Window.partitionBy(*[f"`{k}`" for k in keys]).orderBy("_bin"))
    found = ended.withColumn("_first", first).where("_first = 1").withColumn("_before", F.col("_kept") - F.col("_n"))
    return found.select(*[f"`{k}`" for k in keys], *cuts, "_before", "_low", "_high", "_kept")


def cuts(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame | None:
    """For partitions of more than ``HOT * n`` rows the codes of a row at or soon after their n-th one.

    Columns: the keys, ``_cut0``, .. (null where the codes before it suffice), ``_kept`` rows up to the cut. None
    where no partition is that large or the order begins with no number. Each round reads keys and codes of
    the table and shuffles at most ``BINS`` rows per key and task; the driver sees whether a key is open.
    """
    parts = codes(df, order)
    if not parts:
        return None
    quoted = [f"`{k}`" for k in keys]
    coded = df.select(*quoted, *[p.alias(f"_code{i}") for i, p in enumerate(parts)])
    sizes = coded.groupBy(*quoted).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_code0").alias("_low"), F.max("_code0").alias("_high")
    )
    large = materialize(sizes.where(F.col("_n") > HOT * n), "large-keys")
    rows = large.agg(F.sum("_n")).first()[0]
    if rows is None:
        return None
    waiting = large.where(F.col("_n") > rows // HOT_KEYS).select(*quoted, F.lit(0).cast("bigint").alias("_before"), "_low", "_high")
    closed = []
    for level in range(len(parts)):
        last = level == len(parts) - 1
        tied = []
        for number in range(ROUNDS):
            found = materialize(_round(coded, waiting, keys, level, n), "cuts")
            one = F.col("_low") == F.col("_high")
            small = F.col("_kept") <= ENOUGH * n
            give_up = F.lit(number == ROUNDS - 1)
            done = found.where(small | (one & F.lit(last)) | (give_up & ~one)).withColumn(f"_cut{level}", F.col("_high"))
            nulls = [F.lit(None).cast("double").alias(f"_cut{i}") for i in range(level + 1, len(parts))]
            closed.append(done.select(*quoted, *[f"_cut{i}" for i in range(level + 1)], *nulls, "_kept"))
            if not last:
                edge = [F.lit(-_EDGE).alias("_low"), F.lit(_EDGE).alias("_high")]
                equal = found.where(~small & one).withColumn(f"_cut{level}", F.col("_high"))
                tied.append(equal.select(*quoted, *[f"_cut{i}" for i in range(level + 1)], "_before", *edge))
            waiting = found.where(~small & ~one).drop("_kept")
            if number < ROUNDS - 1 and waiting.isEmpty():
                break
        if last:
            break
        waiting = reduce(DataFrame.unionByName, tied)
        if waiting.isEmpty():
            break
    return materialize(reduce(DataFrame.unionByName, closed), "cuts")


def before_cut(df: DataFrame, found: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The rows up to the cuts, and all rows of partitions without one; a join with a table of at most ``HOT_KEYS`` rows."""
    parts = codes(df, order)
    renamed = found.select(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)], *[f"_cut{i}" for i in range(len(parts))])
    coded = df.select("*", *[p.alias(f"_code{i}") for i, p in enumerate(parts)])
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    keep = F.lit(True)
    for i in reversed(range(len(parts))):
        cut, code = F.col(f"_cut{i}"), F.col(f"_code{i}")
        keep = cut.isNull() | (code < cut) | ((code == cut) & keep)
    kept = coded.join(renamed, reduce(Column.__and__, same), "left").where(keep)
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
