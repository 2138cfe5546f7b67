"""Typed import: mapping, conversion with kept rejects, preview, and bulk load with an error budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.functions.parsing import clean, parse
from keyspan.model import Codec, KeyspanError, LoadReport, TableSpec
from keyspan.operators.buckets import layout, read_buckets, upsert_buckets, write_buckets
from keyspan.operators.tables import replace_table
from keyspan.operators.writes import apply_counters, upsert
from keyspan.session import path_exists, work_path

# Words that may stand for null, in the order they are reported.
NULL_WORDS = ("NULL", "null", "N/A", "n/a", "NA", "\\N", "NONE", "None", "nil")

# Types tried by the inference, narrowest first.
INFERRED = ("boolean", "int", "bigint", "varint", "double", "timestamp", "date", "uuid", "text")

MAX_ERRORS = 100


def parse_mapping(text: str) -> dict[str, str]:
    """``a=x, b=y`` as a dict from field to column; incomplete pairs are skipped."""
    out = {}
    for pair in text.split(","):
        field, eq, column = pair.partition("=")
        if eq and field.strip() and column.strip():
            out[field.strip()] = column.strip()
    return out


def mapping_text(mapping: dict[str, str]) -> str:
    return ", ".join(f"{f.strip()}={c.strip()}" for f, c in mapping.items() if f.strip() and c.strip())


def infer_mapping(fields: list[str], target: list[str]) -> dict[str, str]:
    """Fields matched to columns of the same name, ignoring case."""
    columns = {c.lower(): c for c in target}
    return {f: columns[f.lower()] for f in fields if f.lower() in columns}


def map_fields(
    df: DataFrame,
    mapping: dict[str, str] | str | None,
    target: list[str],
    allow_extra: bool = True,
    allow_missing: bool = False,
) -> DataFrame:
    """Source fields renamed to target columns, in target order.

    The mapping is inferred by name when none is given; ``0=x`` addresses a field by position.
    Unmapped source fields are dropped or refused (``allow_extra``); target columns without a field
    are refused or left out (``allow_missing``).
    """
    if isinstance(mapping, str):
        mapping = parse_mapping(mapping)
    if mapping is None:
        mapping = infer_mapping(df.columns, target)
    resolved = {}
    for field, column in mapping.items():
        name = df.columns[int(field)] if field not in df.columns and field.isdigit() and int(field) < len(df.columns) else field
        if name not in df.columns:
            raise KeyspanError(f"the mapping names field {field}, which the source does not have")
        if column not in target:
            raise KeyspanError(f"the mapping names column {column}, which the table does not have")
        if column in resolved:
            raise KeyspanError(f"column {column} is mapped twice")
        resolved[column] = name
    extra = [f for f in df.columns if f not in resolved.values()]
    if extra and not allow_extra:
        raise KeyspanError("source fields without a column: " + ", ".join(extra))
    missing = [c for c in target if c not in resolved]
    if missing and not allow_missing:
        raise KeyspanError("columns without a source field: " + ", ".join(missing))
    return df.select([F.col(f"`{resolved[c]}`").alias(c) for c in target if c in resolved])


def convert(df: DataFrame, schema: dict[str, str], codec: Codec = Codec(), carry: list[str] = ()) -> DataFrame:
    """Text columns to declared types, plus ``_errors``: (field, value, message) of each failure.

    A failure is a text that is not null but gives no value. The source text is tested, so a real
    null is no failure.
    """
    kept = [F.col(f"`{c}`") for c in carry if c not in schema]
    # Projections in steps, so that a text is cleaned once and parsed once.
    texts = df.select(
        *kept, *[F.col(f"`{n}`").cast("string").alias(f"_raw_{n}") for n in schema],
    ).withColumns({f"_text_{n}": clean(F.col(f"`_raw_{n}`"), codec) for n in schema})
    typed = texts.withColumns({n: parse(F.col(f"`_text_{n}`"), t, codec) for n, t in schema.items()})
    errors = []
    for name, declared in schema.items():
        raw = F.col(f"`_raw_{name}`")
        failed = F.col(f"`_text_{name}`").isNotNull() & F.col(f"`{name}`").isNull()
        errors.append(
            F.when(
                failed,
                F.struct(
                    F.lit(name).alias("field"),
                    raw.alias("value"),
                    F.concat(F.lit("Cannot read '"), raw, F.lit(f"' as {declared}")).alias("message"),
                ),
            )
        )
    found = F.array_compact(F.array(*errors))
    # A generator of one row. Without it a filter on the errors would be pushed below the parsing,
    # and every text would be parsed once for the filter and once more for the value.
    row = F.struct(*[F.col(f"`{n}`") for n in schema], found.alias("_errors"))
    return typed.select(*kept, F.inline(F.array(row)))


def error_rows(converted: DataFrame, row_id: str) -> DataFrame:
    """One row per failed cell: row, field, value, message."""
    return converted.where(F.size("_errors") > 0).select(
        F.col(row_id).alias("row"), F.explode("_errors").alias("e")
    ).select("row", "e.field", "e.value", "e.message")


def typed_import(
    df: DataFrame, schema: dict[str, str], codec: Codec = Codec(), row_id: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Typed rows and the errors of the others.

    ``row_id`` names the column that identifies a record in error rows; without it a number that
    grows in file order is used.
    """
    number = F.col(f"`{row_id}`") if row_id else F.monotonically_increasing_id()
    converted = convert(df.withColumn("_row", number), schema, codec, carry=["_row"])
    good = converted.where(F.size("_errors") == 0).select(*[F.col(f"`{n}`") for n in schema])
    return good, error_rows(converted, "_row")


def infer_schema(df: DataFrame, sample: float | None = None, seed: int = 42) -> DataFrame:
    """The narrowest type that fits every non-blank text of each column.

    Every text is put into its narrowest class; one aggregate then counts the classes of all
    columns at once: field, index, inferred_type, nullable, values. With ``sample`` only that share
    of the rows is looked at.
    """
    looked = df if sample is None else df.sample(sample, seed)
    cells = _cells(looked, df.columns)
    # A class is one bit; the classes that occur in a column are the union of its bits.
    classed = cells.select("index", _text_class(F.col("text")).alias("bit"))
    seen = classed.groupBy("index").agg(
        F.count(F.lit(1)).alias("rows"), F.count("bit").alias("values"), F.coalesce(F.bit_or("bit"), F.lit(0)).alias("bits")
    )
    kind = F.lit("text")
    for t in reversed(INFERRED[:-1]):
        held = sum(_BIT[x] for x in (t, *_WIDENS.get(t, ())))
        fits = F.col("bits").bitwiseAND(F.lit(~held)) == 0
        kind = F.when((F.col("values") > 0) & fits, F.lit(t)).otherwise(kind)
    every = _fields(df).join(seen, "index", "left")
    return every.select(
        "field", "index", F.coalesce(kind, F.lit("text")).alias("inferred_type"),
        F.coalesce(F.col("values") < F.col("rows"), F.lit(True)).alias("nullable"),
        F.coalesce("values", F.lit(0)).alias("values"),
    )


def inferred_types(df: DataFrame, mapping: dict[str, str] | str | None = None) -> dict[str, str]:
    """Inferred type of every (mapped) column, as ``load`` and ``typed_import`` take them."""
    if isinstance(mapping, str):
        mapping = parse_mapping(mapping)
    named = df.columns
    found = {r["field"]: r["inferred_type"] for r in infer_schema(df).collect()}
    if mapping is None:
        return {c: found[c] for c in named}
    place = lambda f: named[int(f)] if f not in found and f.isdigit() else f
    return {column: found[place(field)] for field, column in mapping.items()}


def _samples(df: DataFrame, n: int, most: int = 3) -> DataFrame:
    """(index, samples): the first texts of each column, from ``n`` rows."""
    cells = _cells(df.limit(n).withColumn("_at", F.monotonically_increasing_id()), df.columns, ["_at"])
    held = cells.where("text <> ''").groupBy("index").agg(F.array_sort(F.collect_list(F.struct("_at", "text"))).alias("all"))
    return held.select("index", F.slice(F.col("all.text"), 1, most).alias("samples"))


def _fields(df: DataFrame) -> DataFrame:
    rows = [(i, c) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "index int, field string")


def _cells(df: DataFrame, names: list[str], carry: list[str] = ()) -> DataFrame:
    """One row per cell: the column's number and its trimmed text. What is done to a text is then
    compiled once, however wide the table."""
    cells = [F.struct(F.lit(i).alias("index"), F.col(f"`{c}`").cast("string").alias("raw")) for i, c in enumerate(names)]
    return df.select(*carry, F.inline(F.array(*cells))).select(*carry, "index", F.trim("raw").alias("text"))


# The narrower classes that a type also holds, and the bit of each class.
_WIDENS = {"bigint": ("int",), "varint": ("int", "bigint"), "double": ("int", "bigint", "varint")}
_BIT = {name: 1 << i for i, name in enumerate(INFERRED)}


def _text_class(text: Column) -> Column:
    """The bit of the narrowest type a trimmed text reads as; null for a blank one."""
    # A failed cast costs far more than a comparison, so an int is told from its bigint value.
    whole = text.try_cast("bigint")
    size = (
        F.when(whole.between(-(2**31), 2**31 - 1), _BIT["int"]).when(whole.isNotNull(), _BIT["bigint"]).otherwise(_BIT["varint"])
    )
    return (
        F.when(text.isNull() | (text == ""), F.lit(None).cast("int"))
        # A leading zero is part of a code, which a number would lose.
        .when(text.rlike(r"^[+-]?0\d"), F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull(), _BIT["date"]).otherwise(_BIT["text"]))
        .when(text.rlike(r"^[+-]?\d+$"), size)
        .when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), _BIT["double"])
        .when(F.lower(text).isin("true", "false"), _BIT["boolean"])
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull(), _BIT["date"])
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}") & text.try_cast("timestamp").isNotNull(), _BIT["timestamp"])
        .when(parse(text, "uuid").isNotNull(), _BIT["uuid"])
        .otherwise(_BIT["text"])
    )


def sniff_nulls(df: DataFrame, columns: list[str] | None = None, sample: float | None = None) -> DataFrame:
    """Null words that occur in each column: field, words. One aggregate of flags per column."""
    named = df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df
    looked = named if sample is None else named.sample(sample, 42)
    words = F.array(*[F.lit(w) for w in NULL_WORDS])
    place = F.array_position(words, F.col("text")).cast("int")
    bit = F.when(F.col("place") > 0, F.expr("shiftleft(1, place - 1)"))
    flagged = _cells(looked, named.columns).select("index", place.alias("place")).select("index", bit.alias("bit"))
    seen = flagged.groupBy("index").agg(F.coalesce(F.bit_or("bit"), F.lit(0)).alias("bits"))
    found = [F.when(F.col("bits").bitwiseAND(F.lit(1 << j)) != 0, F.lit(w)) for j, w in enumerate(NULL_WORDS)]
    bits = F.coalesce(F.col("bits"), F.lit(0)).alias("bits")
    return _fields(named).join(seen, "index", "left").select("field", "index", bits).orderBy("index").select(
        "field", F.array_compact(F.array(*found)).alias("words")
    )


#: Bucket folders of a new table.
BUCKETS = 32


@dataclass
class ImportPreview:
    """What an import would do. Nothing is written."""

    fields: DataFrame
    mapping: dict[str, str]
    unmapped_fields: list[str]
    missing_key_columns: list[str]
    sample_rows: DataFrame
    errors: DataFrame
    rows: DataFrame


def preview_import(
    source: DataFrame,
    target: dict[str, str],
    spec: TableSpec,
    mapping: dict[str, str] | str | None = None,
    codec: Codec = Codec(),
    n: int = 20,
    row_id: str | None = None,
) -> ImportPreview:
    """Field types with sample values, proposed mapping, the first ``n`` converted rows, and the conversion errors
    and the number of rows of the whole source. Samples are the first three non-blank texts of the first ``n`` rows."""
    if isinstance(mapping, str):
        mapping = parse_mapping(mapping)
    chosen = mapping if mapping is not None else infer_mapping(source.columns, list(target))
    mapped = [target_column for target_column in target if target_column in chosen.values()]
    number = F.col(f"`{row_id}`") if row_id else F.monotonically_increasing_id()
    renamed = source.select(number.alias("_row"), *[F.col(f"`{f}`").alias(c) for f, c in chosen.items()])
    converted = convert(renamed, {c: target[c] for c in mapped}, codec, carry=["_row"])
    return ImportPreview(
        fields=infer_schema(source).join(_samples(source, n), "index", "left"),
        mapping=chosen,
        unmapped_fields=[f for f in source.columns if f not in chosen and f != row_id],
        missing_key_columns=[k for k in spec.key if k not in chosen.values()],
        sample_rows=converted.where(F.size("_errors") == 0).select(*mapped).limit(n),
        errors=error_rows(converted, "_row"),
        rows=source.agg(F.count(F.lit(1)).alias("rows")),
    )


def load(
    source: DataFrame,
    target: str,
    schema: dict[str, str] | None,
    spec: TableSpec,
    mapping: dict[str, str] | str | None = None,
    codec: Codec = Codec(),
    null_to_unset: bool = True,
    allow_extra: bool = True,
    allow_missing: bool = False,
    max_errors: int | str = MAX_ERRORS,
    dry_run: bool = False,
    ts: str | None = None,
    seq: str | None = None,
    staging: str | None = None,
    buckets: int | None = None,
) -> LoadReport:
    """Read, map, convert, check and upsert into the keyed Parquet table at ``target``.

    The converted rows are staged once; rejects are counted on the staged table, so the budget
    (``100`` rows or ``"5%"``, -1 for none) is known before anything is committed, and the text is
    parsed once. Within the budget the good rows are applied and the rejects stay in their own
    table; beyond it the target is left alone. ``seq`` orders records of one key; without ``ts`` or
    ``seq`` the later record of a file wins. ``staging`` is a folder for the converted rows and the
    rejects; without it they are in the work folder. Without ``schema`` the table is made from the
    types that the source's texts have. A new table is laid out in ``buckets`` bucket folders (0:
    none), and a later load rewrites only the buckets it has rows for; a table that is there keeps its layout,
    and naming another number of buckets is refused. ``operators.buckets.read_buckets`` reads either kind.
    """
    spark = source.sparkSession
    if schema is None:
        schema = inferred_types(source, mapping)
    mapped = map_fields(source, mapping, list(schema), allow_extra, allow_missing)
    spec.require_key(mapped.columns)
    held = {c: t for c, t in schema.items() if c in mapped.columns}
    numbered = mapped.withColumn("_seq", F.monotonically_increasing_id())
    converted = convert(numbered, held, codec, carry=["_seq"])
    no_key = F.lit(False)
    for k in spec.key:
        no_key = no_key | F.col(k).isNull()
    keyless = F.struct(
        F.lit(", ".join(spec.key)).alias("field"), F.lit(None).cast("string").alias("value"),
        F.lit("the key is incomplete").alias("message"),
    )
    converted = converted.withColumn(
        "_errors",
        F.when((F.size("_errors") == 0) & no_key, F.array(keyless)).otherwise(F.col("_errors")),
    )
    staged_path = staging or work_path(spark, "load")
    # Rejects go to a folder of their own, so the commit never reads them.
    converted.withColumn("_rejected", F.size("_errors") > 0).write.partitionBy("_rejected").parquet(staged_path)
    staged = spark.read.schema(converted.schema.add("_rejected", "boolean")).parquet(staged_path)
    sizes = {r["_rejected"]: r["n"] for r in staged.groupBy("_rejected").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = sizes.get(False, 0), sizes.get(True, 0)
    rejects = f"{staged_path}/_rejected=true" if bad else None
    if _over_budget(bad, good + bad, max_errors):
        return LoadReport("ABORTED", good + bad, 0, bad, rejects)
    if dry_run:
        return LoadReport("DRY_RUN", good + bad, 0, bad, rejects)
    changes = staged.where(~F.col("_rejected")).drop("_rejected", "_errors")
    base = (
        read_buckets(spark, target)
        if path_exists(spark, target)
        else changes.drop("_seq").where(F.lit(False))
    )
    options = {"ts": ts, "seq": seq or "_seq", "null_to_unset": null_to_unset}
    there = path_exists(spark, target)
    if there and layout(spark, target):
        upsert_buckets(spark, target, changes, spec, buckets, **({} if spec.counter else options))
    elif there and buckets:
        raise KeyspanError(f"{target} is a table without buckets")
    elif there or buckets == 0:
        replace_table(_applied(base, changes, spec, options), target)
    else:
        write_buckets(_applied(base, changes, spec, options), target, spec, buckets or BUCKETS)
    return LoadReport("WITH_REJECTS" if bad else "SUCCESS", good + bad, good, bad, rejects, target)


def _applied(base: DataFrame, changes: DataFrame, spec: TableSpec, options: dict) -> DataFrame:
    """Changes on a table: counters add up, other columns are replaced."""
    if spec.counter:
        return apply_counters(base, changes, spec.key, [c for c in base.columns if c not in spec.key])
    return upsert(base, changes, spec, **options)


def _over_budget(bad: int, total: int, budget: int | str) -> bool:
    if isinstance(budget, str) and budget.strip().endswith("%"):
        return total > 0 and bad * 100.0 / total > float(budget.strip()[:-1])
    return int(budget) >= 0 and bad > int(budget)


def rejected(spark: SparkSession, report: LoadReport) -> DataFrame:
    """The rejected records of a load: one row per failed cell."""
    if report.rejects_path is None:
        return spark.createDataFrame([], "row bigint, field string, value string, message string")
    return error_rows(spark.read.parquet(report.rejects_path), "_seq")
