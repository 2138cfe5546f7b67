"""Export in five formats with an audit of the rows written, query export, dump and restore.

Every task writes its own files; there is no single writer. The target is any folder URI the
cluster's Hadoop filesystems know.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.functions.rendering import flat_text, render_text, row_json
from keyspan.model import ExportReport, KeyspanError
from keyspan.operators.stats import split_scan
from keyspan.operators.views import limit_rows, project
from keyspan.session import path_exists
from keyspan.sources.files import csv_records

FORMATS = ("csv", "jsonl", "json", "parquet", "xml")
ROW_GROUP_BYTES = 128 * 1024 * 1024
#: Records that make a file which is rolled by its bytes; a task holds one of them at a time.
PIECES = 8

# Neither mark can begin an element name, so a column is never taken for an attribute.
XML_NULL, XML_TEXT = "@null", "#text"
XML_OPTIONS = {"attributePrefix": "@", "valueTag": XML_TEXT, "ignoreSurroundingSpaces": "false"}


def export(
    df: DataFrame,
    path: str,
    fmt: str,
    columns: list[str] | None = None,
    header: bool = True,
    delimiter: str = ",",
    null_string: str = "",
    pretty: bool = False,
    root: str = "rows",
    row: str = "row",
    compression: str | None = None,
    max_records_per_file: int = 0,
    max_file_bytes: int = 0,
    row_group_bytes: int = ROW_GROUP_BYTES,
    split_keys: list[str] | None = None,
    splits: int = 64,
    mode: str = "errorifexists",
    verify: bool = True,
) -> ExportReport:
    """Write ``df`` and prove that what was written is what was read.

    The rows are counted while they pass to the writer; with ``verify`` the files are read back and
    must hold as many. With ``split_keys`` the counts of every key range are compared as well (the
    formats that keep those columns' values: Parquet and JSON). A difference is an error.

    With ``max_file_bytes`` CSV and JSON files end before the row that would take them beyond it, counted in the
    bytes that are written (before compression); only a row longer than that makes a longer file. Parquet and XML
    roll by rows, as many as the mean length of all rows as text allows, at the cost of a pass over the table.
    """
    fmt = fmt.lower()
    # Everything that can be refused is refused before a file is written.
    if fmt not in FORMATS:
        raise KeyspanError(f"unknown format {fmt}; use one of {', '.join(FORMATS)}")
    if split_keys and fmt not in ("parquet", "json", "jsonl"):
        raise KeyspanError("a split audit needs a format that keeps the key values")
    spark = df.sparkSession
    out = project(df, columns)
    if split_keys and not set(split_keys) <= set(out.columns):
        raise KeyspanError("a split audit needs its keys among the exported columns")
    seen = Observation(f"export-{uuid.uuid4().hex}")
    watched = out.observe(seen, F.count(F.lit(1)).alias("rows"))
    warnings: list[str] = []
    rolled = max_file_bytes if fmt in ("csv", "jsonl", "json") and not max_records_per_file else 0
    if max_file_bytes and not rolled and not max_records_per_file:
        mean = out.agg(F.avg(F.octet_length(row_json(out, wire=False)))).first()[0]
        max_records_per_file = max(1, int(max_file_bytes / mean)) if mean else 0
    options = {"maxRecordsPerFile": max_records_per_file}
    if compression:
        options["compression"] = compression
    if fmt == "csv":
        # A line without any character would not be read as a record, so the only field of a row is
        # written as a quoted empty one.
        empty = '""' if len(out.columns) == 1 else ""
        if not null_string:
            warnings.append("null and empty text look alike; set null_string to tell them apart")
        if rolled:
            texts = render_text(watched)
            first = csv_header(out.columns, delimiter) if header else None
            line = csv_line(texts, delimiter, null_string or empty, empty)
            _write_rolled(texts.select(line), path, mode, options, rolled, first)
        else:
            render_text(watched).write.mode(mode).options(
                header=header, sep=delimiter, nullValue=null_string or empty, emptyValue=empty, quote='"', escape='"',
                ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n",
                # The writer would quote a first field that begins with its comment mark, by default "#".
                comment="\x01", **options,
            ).csv(path)
    elif rolled:
        lines = watched.select(row_json(watched, wire=False, pretty=pretty and fmt == "json").alias("value"))
        _write_rolled(lines, path, mode, options, rolled, array=fmt == "json")
    elif fmt == "jsonl":
        watched.select(row_json(watched, wire=False).alias("value")).write.mode(mode).options(**options).text(path)
    elif fmt == "json":
        lines = watched.select(row_json(watched, wire=False, pretty=pretty).alias("value"))
        # A document of n rows has n + 1 lines, so files that roll by lines end where documents do.
        options["maxRecordsPerFile"] = max_records_per_file + 1 if max_records_per_file else 0
        documents = _array_documents(max_records_per_file)
        lines.mapInArrow(documents, "value string").write.mode(mode).options(**options).text(path)
    elif fmt == "parquet":
        watched.write.mode(mode).options(**{"compression": "snappy", **options, "parquet.block.size": row_group_bytes}).parquet(path)
    else:
        renamed = [f"{c} is written as {e}" for c, e in zip(out.columns, element_names(out.columns)) if c != e]
        warnings += renamed
        xml_ready(watched).write.mode(mode).options(
            rootTag=element_name(root), rowTag=element_name(row), **XML_OPTIONS, **options
        ).format("xml").save(path)
    rows = seen.get["rows"]
    report = ExportReport(rows, 0, path, fmt, warnings)
    if verify:
        written = read_back(spark, path, fmt, header, delimiter, row, out.schema, bool(split_keys), pretty)
        found = written.count()
        if found != rows:
            raise KeyspanError(f"{rows} rows were read but {found} were written to {path}")
        if split_keys:
            report.splits = _check_splits(out, written, split_keys, splits, fmt)
    return report


def _check_splits(source: DataFrame, written: DataFrame, keys: list[str], splits: int, fmt: str) -> int:
    typed = written.select([F.col(k).cast(source.schema[k].dataType).alias(k) for k in keys])

    def per_split(df: DataFrame, name: str) -> DataFrame:
        return split_scan(df.select(*keys), keys, splits).groupBy("split_id").agg(F.count(F.lit(1)).alias(name))

    both = per_split(source, "a").join(per_split(typed, "b"), "split_id", "full_outer")
    bad = both.where(~F.col("a").eqNullSafe(F.col("b"))).count()
    if bad:
        raise KeyspanError(f"{bad} of {splits} splits differ between source and export")
    return splits


def read_back(
    spark: SparkSession, path: str, fmt: str, header: bool = True, delimiter: str = ",", row: str = "row",
    schema: T.StructType | None = None, values: bool = True, pretty: bool = False,
) -> DataFrame:
    """The exported rows, for the audit. With the schema at hand no pass over the files infers one.

    For a count, CSV is cut into records without parsing them, by many tasks where a file is large.
    JSON is read as lines, which splits large files: a row of an array document begins with the
    bracket or comma before it, and no other line does. Only values of indented documents need the
    files to be read whole.
    """
    reader = spark.read
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "jsonl" and not values:
        return reader.text(path).where("value <> ''")
    if fmt == "csv" and not values:
        return csv_records(reader.text(path, lineSep="\n"), header=header)
    if fmt == "json" and schema is not None and not (values and pretty):
        lines = reader.text(path).where(F.startswith("value", F.lit("[{")) | F.startswith("value", F.lit(",{")))
        if not values:
            return lines
        texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
        return lines.select(F.from_json(F.expr("substr(value, 2)"), texts).alias("r")).select("r.*")
    if fmt == "xml":
        if schema is not None:
            cell = T.StructType([T.StructField(XML_TEXT, T.StringType()), T.StructField(XML_NULL, T.StringType())])
            reader = reader.schema(T.StructType([T.StructField(e, cell) for e in element_names(schema.names)]))
        return reader.format("xml").options(rowTag=element_name(row), **XML_OPTIONS).load(path)
    if schema is not None:
        reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema]))
    if fmt == "csv":
        return reader.options(
            header=header, sep=delimiter, quote='"', escape='"', multiLine=True,
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        ).csv(path)
    return reader.option("multiLine", str(fmt == "json").lower()).json(path)


def csv_line(texts: DataFrame, delimiter: str, null: str, empty: str) -> Column:
    """One CSV record of text columns, written as Spark's writer does: quotes only where they are needed."""

    def field(name: str) -> Column:
        text = F.col("`" + name.replace("`", "``") + "`")
        needs = reduce(Column.__or__, [F.contains(text, F.lit(mark)) for mark in (delimiter, '"', "\n", "\r")])
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.isNull(), F.lit(null)).when(text == "", F.lit(empty)).when(needs, quoted).otherwise(text)

    return F.concat_ws(delimiter, *[field(c) for c in texts.columns]).alias("value")


def csv_header(names: list[str], delimiter: str) -> str:
    marks = (delimiter, '"', "\n", "\r")
    return delimiter.join('"' + n.replace('"', '""') + '"' if any(m in n for m in marks) else n for n in names)


def _write_rolled(
    lines: DataFrame, path: str, mode: str, options: dict, limit: int, header: str | None = None, array: bool = False
) -> None:
    """Write lines of text to files of at most ``limit`` bytes: a file is ``PIECES`` records, each of many lines."""
    pieces = lines.mapInArrow(_rolled(limit, header, array), "value string")
    pieces.write.mode(mode).options(**{**options, "maxRecordsPerFile": PIECES}).text(path)


def _rolled(limit: int, header: str | None, array: bool):
    """Join the lines of a task to ``PIECES`` texts a file, by their running bytes.

    A piece ends once the file has reached its share of the limit, the last one where the next line would pass the limit.
    A file with fewer lines than pieces ends in blank lines, which readers skip.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        room = limit - (2 if array else 0)  # the line that closes an array
        held: list[str] = []  # lines of the open piece
        size, rows, done = 0, 0, 0  # of the open file: bytes, rows, pieces passed on

        def begin() -> None:
            nonlocal size
            if header is not None:
                held.append(header)
                size = len(header.encode()) + 1

        def end(padded: bool):
            nonlocal size, rows, done
            if array:
                held.append("]" if rows else "[]")
            out = ["\n".join(held)] + ([""] * (PIECES - done - 1) if padded else [])
            held.clear()
            size = rows = done = 0
            return pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

        any_row = False
        for batch in batches:
            values = batch.column(0)
            upto = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64) + 1 + array)
            at = 0
            while at < len(values):
                any_row = True
                before = int(upto[at - 1]) if at else 0
                if not rows and not held:
                    begin()
                fits = int(np.searchsorted(upto, before + room - size, "right"))
                if fits <= at and rows:
                    yield end(padded=True)
                    continue
                share = len(values) + 1
                if done < PIECES - 1:
                    share = int(np.searchsorted(upto, before + (done + 1) * room / PIECES - size, "left")) + 1
                stop = min(max(fits, at + 1), max(share, at + 1), len(values))
                part = values.slice(at, stop - at).to_pylist()
                held += [("," if rows or i else "[") + text for i, text in enumerate(part)] if array else part
                size, rows, at = size + int(upto[stop - 1]) - before, rows + len(part), stop
                if done < PIECES - 1 and size >= (done + 1) * room / PIECES:
                    yield pa.RecordBatch.from_arrays([pa.array(["\n".join(held)], pa.string())], names=["value"])
                    held.clear()
                    done += 1
        if held or array and (rows or not any_row):
            yield end(padded=False)
        elif not any_row and header is not None and TaskContext.get().partitionId() == 0:
            begin()
            yield end(padded=False)

    return run


def _array_documents(rows: int):
    """Turn the JSON rows of one task into the lines of array documents of at most ``rows`` rows (0: one document)."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held, any_row = 0, False  # rows of the document that is open
        for batch in batches:
            values = batch.column(0)
            at = 0
            while at < len(values):
                part = values.slice(at, min(len(values) - at, rows - held) if rows else len(values) - at)
                marks = pa.array(["," if held or i else "[" for i in range(len(part))])
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(marks, part, "")], names=["value"])
                held, at, any_row = held + len(part), at + len(part), True
                if held == rows:
                    yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])
                    held = 0
        if held or not any_row:
            yield pa.RecordBatch.from_arrays([pa.array(["]" if held else "[]"])], names=["value"])

    return run


# The Name production of XML 1.0 without the colon, which would be a prefix.
_NAME_START = (
    "A-Z_a-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02FF\u0370-\u037D\u037F-\u1FFF\u200C-\u200D\u2070-\u218F"
    "\u2C00-\u2FEF\u3001-\uD7FF\uF900-\uFDCF\uFDF0-\uFFFD\U00010000-\U000EFFFF"
)
_NAME = _NAME_START + "\\-.0-9\u00B7\u0300-\u036F\u203F-\u2040"


def element_name(column: str) -> str:
    """A name that XML allows for an element: what it does not allow is an underscore, and one leads a name that
    begins with a digit, a dot or a hyphen."""
    name = re.sub(f"[^{_NAME}]", "_", column)
    return name if re.match(f"[{_NAME_START}]", name) else f"_{name}"


def element_names(columns: list[str]) -> list[str]:
    """A name for each column; those that would be the same but for case get a number."""
    taken: set[str] = set()
    out = []
    for column in columns:
        first = name = element_name(column)
        number = 1
        while name.lower() in taken:
            number += 1
            name = f"{first}_{number}"
        taken.add(name.lower())
        out.append(name)
    return out


# Characters that XML 1.0 cannot hold in any form.
_NOT_XML = r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def xml_ready(df: DataFrame) -> DataFrame:
    """Every column as an element with text, or with the attribute ``null="true"``."""
    out = []
    for f, name in zip(df.schema, element_names(df.columns)):
        text = F.regexp_replace(flat_text(F.col(f"`{f.name}`"), f.dataType), _NOT_XML, "�")
        out.append(
            F.struct(F.when(text.isNull(), F.lit("true")).alias(XML_NULL), text.alias(XML_TEXT)).alias(name)
        )
    return df.select(*out)


def export_query(
    spark: SparkSession, sql: str, path: str, fmt: str, max_rows: int = -1, views: dict[str, DataFrame] | None = None, **options
) -> ExportReport:
    """Export the result of a query; ``max_rows`` caps it, -1 for no cap."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return export(limit_rows(spark.sql(sql), max_rows), path, fmt, **options)


# --- dump and restore -----------------------------------------------------------------------------

MODES = ("SCHEMA_ONLY", "DATA_ONLY", "SCHEMA_AND_DATA")


def dump(
    tables: dict[str, DataFrame], directory: str, mode: str = "SCHEMA_AND_DATA", compression: str = "gzip"
) -> DataFrame:
    """Tables as a folder tree: ``schema/<table>`` holds the schema as JSON, ``data/<table>`` the
    rows. Returns table, rows (null where no data was dumped) and warnings."""
    if mode not in MODES:
        raise KeyspanError(f"unknown dump mode {mode}")
    report = []
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        if mode != "DATA_ONLY":
            line = spark.createDataFrame([(json.dumps(df.schema.jsonValue()),)], "value string")
            line.coalesce(1).write.text(f"{directory}/schema/{name}")
        rows, warning = None, None
        if mode != "SCHEMA_ONLY":
            written = export(df, f"{directory}/data/{name}", "parquet", compression=compression)
            rows, warning = written.rows, "; ".join(written.warnings) or None
            if rows == 0:
                warning = "the table has no rows"
        report.append((name, rows, warning))
    if spark is None:
        raise KeyspanError("no tables to dump")
    return spark.createDataFrame(report, "table string, rows bigint, warning string")


def restore(
    spark: SparkSession,
    directory: str,
    target: str,
    tables: list[str],
    mode: str = "SCHEMA_AND_DATA",
    drop_existing: bool = False,
) -> DataFrame:
    """Replay a dump into another folder; existing tables are refused unless ``drop_existing``."""
    report = []
    for name in tables:
        place = f"{target}/{name}"
        if path_exists(spark, place) and not drop_existing:
            raise KeyspanError(f"{place} exists")
        if mode == "DATA_ONLY":
            data = spark.read.parquet(f"{directory}/data/{name}")
        else:
            text = "".join(r[0] for r in spark.read.text(f"{directory}/schema/{name}").collect())
            schema = T.StructType.fromJson(json.loads(text))
            has_data = mode != "SCHEMA_ONLY" and path_exists(spark, f"{directory}/data/{name}")
            data = (
                spark.read.schema(schema).parquet(f"{directory}/data/{name}")
                if has_data
                else spark.createDataFrame([], schema)
            )
        rows = export(data, place, "parquet", mode="overwrite").rows
        report.append((name, rows))
    return spark.createDataFrame(report, "table string, rows bigint")
