"""Filters, search, type-aware sorting, limits per partition and stable paging."""

from __future__ import annotations

import datetime as dt
import unicodedata
from decimal import Context, Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.functions.rendering import grid_text
from keyspan.functions.tokens import in_range as token_in_range
from keyspan.functions.tokens import token
from keyspan.model import KeyspanError, MissingKeyError
from keyspan.operators.first_rows import before_cut, codes, cuts
from keyspan.operators.order_statistics import rows_around
from keyspan.session import work_path

# Page size limits, and the longest IN list kept as a plain filter.
DEFAULT_PAGE = 500
MAX_PAGE = 10_000
#: ``one_page`` sorts once at most this many rows are left around the page.
SORTED_ROWS = 100_000
IN_LIST_LIMIT = 10_000


def project(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """The asked columns in the asked order; none asked means all; an unknown one is an error."""
    if not columns:
        return df
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise KeyspanError("unknown columns: " + ", ".join(unknown))
    return df.select(*[F.col(f"`{c}`") for c in columns])


# Fixed value: what a word is made of.
_WORD = r"\p{L}\p{M}\p{N}_"


def _analysed(text: Column, case_sensitive: bool, normalize: bool, ascii: bool) -> Column:
    if normalize or ascii:
        text = _unicode_folded(ascii)(text)
    return text if case_sensitive else F.lower(text)


def words(text: Column, case_sensitive: bool = False, normalize: bool = False, ascii: bool = False) -> Column:
    """The words of a text as an array: runs of letters, marks, digits and underscores."""
    split = F.split(_analysed(text, case_sensitive, normalize, ascii), f"[^{_WORD}]+")
    return F.filter(split, lambda w: w != "")


def has_word(text: Column, word: str, case_sensitive: bool = False, normalize: bool = False, ascii: bool = False) -> Column:
    """Is the word among ``words(text)``? Most texts fail the plain search and are not analysed."""
    # The word is folded like the text.
    if normalize or ascii:
        word = unicodedata.normalize("NFKD" if ascii else "NFC", word)
    if ascii:
        word = "".join(ch for ch in word if not "\u0300" <= ch <= "\u036f")
    wanted = word if case_sensitive else word.lower()
    if not wanted or not all(ch == "_" or unicodedata.category(ch)[0] in "LMN" for ch in wanted):
        return F.lit(False) & text.isNotNull()
    analysed = _analysed(text, case_sensitive, normalize, ascii)
    alone = f"(?<![{_WORD}])" + wanted + f"(?![{_WORD}])"
    return F.contains(analysed, F.lit(wanted)) & analysed.rlike(alone)


def _unicode_folded(ascii: bool):
    """Unicode composition has no built-in function; Arrow batches carry the text to pandas."""

    @F.pandas_udf("string")
    def fold(texts):
        out = texts.str.normalize("NFKD" if ascii else "NFC")
        return out.str.replace(r"[̀-ͯ]", "", regex=True) if ascii else out

    return fold


def _listed(values, dtype: T.DataType) -> list:
    """The values of a list as the column's type has them, text included; those no value of the column can equal are left out."""
    out = [_as_type(v, dtype) for v in values if v is not None]
    return [v for v in out if v is not None]


def _as_type(value, dtype: T.DataType):
    """A value as the column's type has it, None if no value of the column equals it."""
    try:
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return float(value)
        if isinstance(dtype, (T.IntegralType, T.DecimalType)):
            number = value if isinstance(value, Decimal) else Decimal(str(value).strip())
            if not number.is_finite():
                return None
            scale = dtype.scale if isinstance(dtype, T.DecimalType) else 0
            digits = dtype.precision if isinstance(dtype, T.DecimalType) else 19
            whole = number.scaleb(scale, _WIDE)
            if whole != whole.to_integral_value() or abs(whole) >= 10**digits:
                return None
            if isinstance(dtype, T.DecimalType):
                return Decimal(int(whole)).scaleb(-scale, _WIDE)
            bits = {"tinyint": 7, "smallint": 15, "int": 31}.get(dtype.simpleString(), 63)
            return int(whole) if -(2**bits) <= whole < 2**bits else None
        if isinstance(dtype, T.DateType):
            if isinstance(value, str):
                value = dt.datetime.fromisoformat(value.strip())
            if isinstance(value, dt.datetime):
                return value.date() if value.time() == dt.time() and value.tzinfo is None else None
            return value if isinstance(value, dt.date) else None
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            if isinstance(value, str):
                value = dt.datetime.fromisoformat(value.strip())
            return value if isinstance(value, dt.datetime) else dt.datetime.combine(value, dt.time())
        if isinstance(dtype, T.StringType):
            return value if isinstance(value, str) else str(value)
    except (ValueError, TypeError, ArithmeticError):
        return None
    return value


# Digits enough for any decimal column.
_WIDE = Context(prec=200)


def predicate(df: DataFrame, column: str, op: str, value, text_options: dict | None = None) -> Column:
    """One condition of a predicate list."""
    c = F.col(column)
    dtype = df.schema[column].dataType
    op = op.upper()
    if op == "=":
        return c == F.lit(value)
    if op == "<":
        return c < F.lit(value)
    if op == "<=":
        return c <= F.lit(value)
    if op == ">":
        return c > F.lit(value)
    if op == ">=":
        return c >= F.lit(value)
    if op == "IN":
        if not isinstance(value, (list, tuple)):
            raise KeyspanError("IN needs a list")
        return c.isin(_listed(value, dtype))
    if op == "CONTAINS":
        held = F.map_values(c) if isinstance(dtype, T.MapType) else c
        return F.array_contains(held, F.lit(value))
    if op == "CONTAINS KEY":
        return F.map_contains_key(c, F.lit(value))
    if op == ":":
        return has_word(c, value, **(text_options or {}))
    if op == "LIKE":
        return c.like(value)
    raise KeyspanError(f"unknown operator {op}")


def apply_predicates(df: DataFrame, predicates: list[tuple], text_options: dict | None = None) -> DataFrame:
    """Rows that meet all ``(column, operator, value)`` conditions.

    Comparisons and short IN lists stay plain filters, so they reach the Parquet reader. A long IN
    list becomes a semi join whose strategy Spark picks from the size of the list.
    """
    out = df
    for column, op, value in predicates:
        long_list = op.upper() == "IN" and isinstance(value, (list, tuple)) and len(value) > IN_LIST_LIMIT
        if long_list:
            field = T.StructType([T.StructField(column, df.schema[column].dataType)])
            listed = df.sparkSession.createDataFrame([(v,) for v in _listed(value, df.schema[column].dataType)], field)
            out = out.join(listed, column, "left_semi")
        else:
            out = out.where(predicate(out, column, op, value, text_options))
    return out


def in_range(df: DataFrame, keys: list[str], start: int, end: int) -> DataFrame:
    """Rows whose key token lies in ``(start, end]``."""
    return df.where(token_in_range(token(*keys), start, end))


def lookup(df: DataFrame, key_columns: list[str], keys) -> DataFrame:
    """Rows named by their complete key: a dict for one row, a DataFrame of keys for many."""
    given = keys if isinstance(keys, dict) else keys.columns
    missing = [k for k in key_columns if k not in given]
    if missing:
        raise MissingKeyError(missing)
    if isinstance(keys, dict):
        for k in key_columns:
            df = df.where(F.col(k) == F.lit(keys[k]))
        return df
    return df.join(keys.select(*key_columns), key_columns, "left_semi")


def search(df: DataFrame, needle: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with the text in any rendered cell, ignoring case. A null cell renders as ``null``."""
    wanted = needle.strip().lower()
    if not wanted:
        return df
    hit = F.lit(False)
    for field in df.schema:
        if columns is None or field.name in columns:
            cell = grid_text(F.col(f"`{field.name}`"), field.dataType)
            hit = hit | F.contains(F.lower(cell), F.lit(wanted))
    return df.where(hit)


def filter_columns(df: DataFrame, terms: dict[str, str]) -> DataFrame:
    """Rows whose rendered cells contain the term of their column, for all columns named."""
    for name, term in terms.items():
        wanted = term.strip().lower()
        if wanted:
            cell = grid_text(F.col(f"`{name}`"), df.schema[name].dataType)
            df = df.where(F.contains(F.lower(cell), F.lit(wanted)))
    return df


def natural_key(text: Column) -> Column:
    """Sort key of a text in which digit runs compare as numbers of any length."""

    def part(chunk: Column) -> Column:
        digits = F.regexp_replace(chunk, r"^0+(?=\d)", "")
        return F.when(
            chunk.rlike(r"^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)
        ).otherwise(chunk)

    chunks = F.regexp_extract_all(text, F.lit(r"[0-9]+|[^0-9]+"), 0)
    return F.collate(F.array_join(F.transform(chunks, part), ""), "UNICODE")


def number_key(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the sort key of a number kept as text, for any number of digits, with or without an exponent. Compares the whole
    number: its sign, the place of its first digit, its digits, in columns ``<name>_sign``, ``<name>_place``, ``<name>_digits``.

    Each part is a column, so the next one does not work it out again at each mention.
    """
    mantissa, c = r"^\s*[+-]?([0-9]*)\.?([0-9]*)", lambda part: F.col(f"{name}_{part}")
    exponent = F.regexp_extract(c("text"), r"[0-9.][eE]([+-]?[0-9]+)\s*$", 1).try_cast("bigint")
    parts = [
        {"text": text},
        {
            "whole": F.regexp_extract(c("text"), mantissa, 1), "fraction": F.regexp_extract(c("text"), mantissa, 2),
            "exponent": F.coalesce(exponent, F.lit(0)), "negative": c("text").rlike(r"^\s*-"),
        },
        {"joined": F.concat(c("whole"), c("fraction"))},
        {"significant": F.ltrim(c("joined"), F.lit("0"))},
        {"digits": F.rtrim(c("significant"), F.lit("0")), "first": F.length(c("whole")) - (F.length(c("joined")) - F.length(c("significant"))) + c("exponent")},
    ]
    out = df
    for step in parts:
        out = out.withColumns({f"{name}_{part}": value for part, value in step.items()})
    zero, flipped = c("digits") == "", F.concat(F.translate(c("digits"), "0123456789", "9876543210"), F.lit("~"))
    return out.select(
        *[F.col(f"`{x}`") for x in df.columns],
        F.when(c("text").isNotNull(), F.when(zero, 0).when(c("negative"), -1).otherwise(1)).alias(f"{name}_sign"),
        F.when(zero, 0).when(c("negative"), -c("first")).otherwise(c("first")).alias(f"{name}_place"),
        F.when(c("negative") & ~zero, flipped).otherwise(c("digits")).alias(f"{name}_digits"),
    )


# Types that Spark sorts as they are shown.
_ORDERED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def sort_key(df: DataFrame, column: str) -> Column:
    dtype = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(dtype, _ORDERED):
        return c
    text = c if isinstance(dtype, T.StringType) else F.when(c.isNotNull(), grid_text(c, dtype))
    return natural_key(text)


def sort_view(
    df: DataFrame, column: str, direction: str = "asc", numeric_text: bool = False, tie: list[str] | None = None
) -> DataFrame:
    """Type-aware order. Nulls come last ascending and first descending.

    A tie-break is always added (the named columns, else a hash of the row), so equal values get a
    repeatable order and Spark's range partitioner can spread one frequent value over many tasks.
    """
    keyed, columns, made = _keyed(df, column, direction, numeric_text, tie)
    return keyed.orderBy(*columns).drop(*made)


def sorted_places(
    df: DataFrame, column: str, direction: str = "asc", numeric_text: bool = False, tie: list[str] | None = None
) -> DataFrame:
    """Every row with its ``place`` (from 1) in the order of ``sort_view``."""
    keyed, columns, made = _keyed(df, column, direction, numeric_text, tie)
    return Pages(keyed, columns, without=made).places()


def _keyed(
    df: DataFrame, column: str, direction: str, numeric_text: bool, tie: list[str] | None
) -> tuple[DataFrame, list[Column], list[str]]:
    """The table with its sort key in columns of their own, the order, and the names of those columns.

    A sort evaluates an expression each time it compares two rows; a column is made once for each row.
    """
    if numeric_text and not isinstance(df.schema[column].dataType, _ORDERED):
        held, made = number_key(df, F.col(f"`{column}`"), "_key"), ["_key_sign", "_key_place", "_key_digits"]
    else:
        held, made = df.withColumn("_key", sort_key(df, column)), ["_key"]
    ordered = [F.col(c).asc_nulls_last() if direction == "asc" else F.col(c).desc_nulls_first() for c in made]
    if tie:
        return held, [*ordered, *[F.col(t) for t in tie]], made
    held = held.withColumn("_tie", _tie_break(df))
    return held, [*ordered, F.col("_tie")], [*made, "_tie"]


def _tie_break(df: DataFrame) -> Column:
    return F.xxhash64(*[f"`{f.name}`" for f in df.schema if not isinstance(f.dataType, T.MapType)])


def cluster_sort(df: DataFrame, partition_key: list[str], order: list) -> DataFrame:
    """Rows of each partition in clustering order.

    Range partitioning on key and order keeps a partition in consecutive tasks, in order, and lets
    a very large one span several.
    """
    columns = [F.col(k) for k in partition_key] + order_columns(order)
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def order_columns(order: list) -> list[Column]:
    """``"ts desc"`` / ``"id"`` / Column as sort columns."""
    out = []
    for item in [order] if isinstance(order, (str, Column)) else order:
        if isinstance(item, Column):
            out.append(item)
        else:
            name, _, direction = item.partition(" ")
            out.append(F.col(name).desc() if direction.strip().lower() == "desc" else F.col(name).asc())
    return out


def per_partition_limit(df: DataFrame, partition_key: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each partition in clustering order.

    Up to the optimizer's group limit Spark cuts every map task's rows to ``n`` per key before the
    shuffle. Above it the place of the n-th row of large partitions is found first (see
    ``first_rows``, which runs jobs), so that about ``n`` rows of each are shuffled. Where the order begins with no
    number, time or text, a first cut per key and slice is done instead.
    """
    columns = order_columns(order)
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit and codes(df, order):
        found = cuts(df, partition_key, order, n)
        if found is not None:
            df = before_cut(df, found, partition_key, order)
    elif n > limit:
        slices = [F.pmod(F.xxhash64(*[f"`{c}`" for c in _hashable(df)]), F.lit(64)).alias("_slice")]
        df = df.withColumn("_slice", slices[0])
        part = Window.partitionBy(*partition_key, "_slice").orderBy(*columns)
        df = df.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n).drop("_rn", "_slice")
    window = Window.partitionBy(*partition_key).orderBy(*columns)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]


class Pages:
    """Stable pages of a table: every row on exactly one page, pages in ``order``.

    ``order`` must end in a unique column. The rows are range-partitioned, sorted and written once
    to ``path`` (else the work folder) with their position in their partition; a count per partition then gives
    each its offset. No task sees more than its own range, and the write fixes the sampled bounds.
    Columns ``without`` which the pages shall be are only sorted by.
    """

    def __init__(self, df: DataFrame, order: list, size: int = DEFAULT_PAGE, path: str | None = None, without: list[str] = ()):
        columns = order_columns(order)
        ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
        numbered = ranged.withColumn("_id", F.monotonically_increasing_id()).withColumns(
            {"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit(2**33 - 1))}
        )
        path = path or work_path(df.sparkSession, "pages")
        numbered.drop("_id", *without).write.parquet(path)
        self._open(df.sparkSession, path, size)

    @classmethod
    def open(cls, spark: SparkSession, path: str, size: int = DEFAULT_PAGE) -> Pages:
        """The pages stored at ``path`` by an earlier call, of any size, without sorting the table again."""
        self = cls.__new__(cls)
        self._open(spark, path, size)
        return self

    def _open(self, spark: SparkSession, path: str, size: int) -> None:
        if not 0 < size <= MAX_PAGE:
            raise KeyspanError(f"the page size must be between 1 and {MAX_PAGE}")
        self.size, self.path = size, path
        self.stored = spark.read.parquet(path)
        self.columns = [c for c in self.stored.columns if c not in ("_part", "_at")]
        # One row per task of the write: as long as the partition count, whatever the data.
        counted = self.stored.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part")
        self.offsets: list[tuple[int, int, int]] = []
        total = 0
        for row in counted.collect():
            self.offsets.append((row["_part"], total, row["n"]))
            total += row["n"]
        self.rows = total
        self.pages = -(-total // size)

    def frame(self) -> DataFrame:
        """The whole table with ``page`` (from 1)."""
        spark = self.stored.sparkSession
        offsets = spark.createDataFrame([o[:2] for o in self.offsets], "_part bigint, _offset bigint")
        position = F.col("_offset") + F.col("_at")
        numbered = self.stored.join(offsets, "_part")
        return numbered.select(*self.columns, (F.floor(position / self.size) + 1).cast("bigint").alias("page"))

    def places(self) -> DataFrame:
        """The whole table with ``place`` (from 1), the number of a row in the order."""
        offsets = self.stored.sparkSession.createDataFrame([o[:2] for o in self.offsets], "_part bigint, _offset bigint")
        return self.stored.join(offsets, "_part").select(*self.columns, (F.col("_offset") + F.col("_at") + 1).alias("place"))

    def page(self, number: int) -> DataFrame:
        """One page. The filter is on stored columns, so all other partitions are skipped."""
        return self.between((number - 1) * self.size, number * self.size)

    def between(self, lo: int, hi: int) -> DataFrame:
        """The rows at the places lo .. hi - 1, from 0."""
        hit = F.lit(False)
        for part, offset, n in self.offsets:
            if offset < hi and offset + n > lo:
                at = F.col("_at")
                hit = hit | ((F.col("_part") == part) & (at >= lo - offset) & (at < hi - offset))
        return self.stored.where(hit).select(*self.columns)


def paginate(df: DataFrame, order: list, size: int = DEFAULT_PAGE) -> DataFrame:
    """Add ``page``, see ``Pages``."""
    return Pages(df, order, size).frame()


def one_page(df: DataFrame, order: list, number: int, size: int = DEFAULT_PAGE, enough: int = SORTED_ROWS) -> DataFrame:
    """One page of ``Pages`` without sorting the table: only rows near the page are written and sorted.

    ``order`` must end in a unique column. Where the order begins with no number, time or text, this is ``Pages``.
    The order columns are read once for a sketch (once more for each further column a hot value makes necessary) and the table
    once to write about two thousandths of it, which is narrowed again while it holds more than ``enough`` rows.
    """
    if not 0 < size <= MAX_PAGE:
        raise KeyspanError(f"the page size must be between 1 and {MAX_PAGE}")
    if number < 1:
        raise KeyspanError("pages count from 1")
    lo, hi = (number - 1) * size, number * size
    near, skipped = rows_around(df, order, lo, hi, max(enough, 4 * size))
    return Pages(near, order, size).between(lo - skipped, hi - skipped)


def limit_rows(df: DataFrame, n: int) -> DataFrame:
    """A row cap; a negative one means no cap."""
    return df if n < 0 else df.limit(n)


def result_view(
    df: DataFrame,
    search_text: str | None = None,
    filters: dict[str, str] | None = None,
    sort: tuple[str, str] | None = None,
    numeric_text: bool = False,
    tie: list[str] | None = None,
) -> DataFrame:
    """Search, then column filters, then sort."""
    if search_text and search_text.strip():
        df = search(df, search_text)
    if filters:
        df = filter_columns(df, filters)
    if sort:
        df = sort_view(df, sort[0], sort[1], numeric_text, tie)
    return df
