"""File and query sources. Text formats are read as text; ``typed_import`` gives them types."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyspan.model import KeyspanError
from keyspan.session import materialize

def _paths(spark: SparkSession, path, url_file: str | None) -> list[str]:
    """The paths to read: one, several, or those listed in a text file, one per line."""
    if url_file:
        lines = spark.read.text(url_file).where((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
        return [r[0].strip() for r in lines.collect()]
    return [path] if isinstance(path, str) else list(path)


def _file_options(reader, pattern: str | None, recursive: bool):
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.option("recursiveFileLookup", str(bool(recursive)).lower())


def read_csv(
    spark: SparkSession,
    path=None,
    header: bool = True,
    columns: list[str] | None = None,
    delimiter: str = ",",
    quote: str = '"',
    escape: str = '"',
    comment: str | None = None,
    encoding: str = "UTF-8",
    null_value: str | None = None,
    empty_value: str | None = None,
    trim_leading: bool = False,
    trim_trailing: bool = False,
    max_columns: int | None = None,
    max_chars: int | None = None,
    multiline: bool = True,
    pattern: str | None = None,
    recursive: bool = False,
    url_file: str | None = None,
    split: bool = False,
) -> DataFrame:
    """CSV as text columns. Short rows are padded with nulls; an empty field that is not quoted is
    null, ``empty_value`` says what a quoted empty one is.

    A quoted field may span lines (``multiline``), which keeps one file in one task; files known to
    hold one record per line can turn it off and are then split. Files of many tasks with fields that span
    lines are read with ``split`` (see ``csv_records``); it takes quotes only around fields and doubled
    inside them, and no comments. Without a header the columns are named by position unless ``columns`` names them.
    """
    reader = spark.read.format("csv").options(
        header=header, sep=delimiter, quote=quote, escape=escape, encoding=encoding, multiLine=multiline,
        ignoreLeadingWhiteSpace=trim_leading, ignoreTrailingWhiteSpace=trim_trailing, inferSchema=False,
        enforceSchema=True, mode="PERMISSIVE",
    )
    if comment:
        reader = reader.option("comment", comment)
    reader = reader.option("nullValue", "" if null_value is None else null_value)
    reader = reader.option("emptyValue", "" if empty_value is None else empty_value)
    if max_columns:
        reader = reader.option("maxColumns", max_columns)
    if max_chars:
        reader = reader.option("maxCharsPerColumn", max_chars)
    reader = _file_options(reader, pattern, recursive)
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    paths = _paths(spark, path, url_file)
    df = reader.load(paths)
    if split:
        if comment or quote != escape or len(quote) != 1 or encoding.upper().replace("-", "") != "UTF8":
            raise KeyspanError("split files need UTF-8, one quote character that is doubled inside fields, and no comments")
        options = {
            "sep": delimiter, "quote": quote, "escape": escape, "multiLine": "true", "ignoreLeadingWhiteSpace": str(trim_leading).lower(),
            "ignoreTrailingWhiteSpace": str(trim_trailing).lower(), "nullValue": null_value or "", "emptyValue": empty_value or "",
            **({"maxColumns": str(max_columns)} if max_columns else {}), **({"maxCharsPerColumn": str(max_chars)} if max_chars else {}),
        }
        lines = _file_options(spark.read.format("text").option("lineSep", "\n"), pattern, recursive).load(paths)
        records = csv_records(lines, quote, header)
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in df.columns)
        df = records.select(F.from_csv("value", F.lit(schema), options).alias("r")).select("r.*")
    if not header and not columns:
        df = df.toDF(*[str(i) for i in range(len(df.columns))])
    return df


def csv_records(lines: DataFrame, quote: str = '"', header: bool = False) -> DataFrame:
    """(value): CSV records from the lines of files, each of which many tasks may read.

    A record ends at a line end before which the quotes are even in number. Whether a block of a file begins inside a
    quoted field is the parity of all quotes before it: one sum for each block, and a running sum over a file's blocks.
    With that each task cuts its own block into records. Those that go over the end of a block are put together from the
    pieces, one or two for each block. Blank records are left out, and with ``header`` the first record of each file.
    """
    spark = lines.sparkSession
    placed = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    sums = placed.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = sums.withColumn("inside", F.coalesce(F.sum("odd").over(before) % 2, F.lit(0))).where("inside = 1")
    # Blocks that begin inside a field: at most one for each block's size of input, in most files none.
    inside = {(r["file"], r["block"]) for r in opened.select("file", "block").collect()}

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        key, held, kind, first = None, [], 0, False
        out: list[tuple] = []

        def closed() -> None:
            """The piece that is open at the end of a block."""
            if held:
                out.append((key[0], key[1], kind, False, "\n".join(held)))
                held.clear()

        def flushed():
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["file", "block", "kind", "first", "value"])
            out.clear()

        for batch in batches:
            files, blocks = batch.column("file"), batch.column("block")
            code = np.append(True, (blocks.to_numpy()[1:] != blocks.to_numpy()[:-1]))
            code[1:] |= pc.not_equal(files.slice(1), files.slice(0, len(files) - 1)).to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(code).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                own = (files[a].as_py(), blocks[a].as_py())
                if own != key:
                    closed()
                    key, first = own, own[1] == 0
                    kind = 2 if own in inside else 0
                    open_now = own in inside
                part = batch.column("value").slice(a, b - a)
                odd = pc.count_substring(part, quote).to_numpy(zero_copy_only=False) % 2
                after = (np.cumsum(odd) + open_now) % 2
                start = np.append(int(open_now), after[:-1])
                plain = (start == 0) & (after == 0)
                at = 0
                if first and plain[0]:
                    out.append((key[0], key[1], 0, True, part[0].as_py()))
                    first, at, plain[0] = False, 1, False
                for i in np.flatnonzero(~plain[at:]).tolist():
                    i += at
                    if start[i] == 0:
                        kind = 1
                    held.append(part[i].as_py())
                    if after[i] == 0:
                        out.append((key[0], key[1], 2 if kind == 2 else 0, first, "\n".join(held)))
                        held.clear()
                        first, kind = False, 0
                open_now = bool(after[-1])
                yield from flushed()
                whole = part.filter(pa.array(plain))
                n = len(whole)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(np.zeros(n, np.int32)),
                     pa.array(np.zeros(n, bool)), whole], names=["file", "block", "kind", "first", "value"],
                )
        closed()
        yield from flushed()

    pieces = placed.mapInArrow(cut, "file string, block long, kind int, first boolean, value string")
    records = pieces.where("kind = 0")
    if header:
        records = records.where("NOT first")
    records = records.select("value")
    if inside or _unclosed(sums):
        parts = pieces.where("kind > 0")
        begun = Window.partitionBy("file").orderBy("block", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
        parts = parts.withColumn("record", F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(begun))
        texts = F.array_sort(F.collect_list(F.struct("block", (-F.col("kind")).alias("kind"), "value")))
        value = F.array_join(F.transform(texts, lambda p: p["value"]), "\n").alias("value")
        joined = parts.groupBy("file", "record").agg(value, F.max("first").alias("first"))
        records = records.unionByName((joined.where("NOT first") if header else joined).select("value"))
    # Where records end with both characters, line ends inside fields are read as one, as Spark reads whole files.
    text = F.col("value")
    both = F.replace(F.substring(text, F.lit(1), F.length(text) - 1), F.lit("\r\n"), F.lit("\n"))
    records = records.select(F.when(text.endswith("\r"), both).otherwise(text).alias("value"))
    return records.where(F.trim("value") != "")


def _unclosed(sums: DataFrame) -> bool:
    """Does some file hold an odd number of quotes?"""
    return not sums.groupBy("file").agg((F.sum("odd") % 2).alias("odd")).where("odd = 1").isEmpty()


def read_json(
    spark: SparkSession, path=None, mode: str = "MULTI_DOCUMENT", schema: str | None = None,
    encoding: str | None = None, pattern: str | None = None, recursive: bool = False, url_file: str | None = None,
    as_text: bool = False,
) -> DataFrame:
    """JSON documents: one per line, or ``SINGLE_DOCUMENT`` for one array per file.

    ``as_text`` keeps every scalar as text for ``typed_import``.
    """
    if mode not in ("MULTI_DOCUMENT", "SINGLE_DOCUMENT"):
        raise KeyspanError(f"unknown JSON mode {mode}")
    reader = spark.read.format("json").option("multiLine", str(mode == "SINGLE_DOCUMENT").lower())
    if as_text:
        reader = reader.option("primitivesAsString", "true")
    if encoding:
        reader = reader.option("encoding", encoding)
    if schema:
        reader = reader.schema(schema)
    return _file_options(reader, pattern, recursive).load(_paths(spark, path, url_file))


def read_parquet(
    spark: SparkSession, path=None, pattern: str | None = None, recursive: bool = False, url_file: str | None = None
) -> DataFrame:
    return _file_options(spark.read.format("parquet"), pattern, recursive).load(_paths(spark, path, url_file))


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str | None = None,
    query: str | None = None,
    partition_on: str | None = None,
    bounds: tuple | None = None,
    partitions: int = 32,
    fetch_size: int = 5000,
    properties: dict | None = None,
) -> DataFrame:
    """A table or query of another database; with ``partition_on`` read in parallel ranges.

    Without ``bounds`` they are asked for first (one aggregate row). Needs the vendor's driver jar.
    """
    if (table is None) == (query is None):
        raise KeyspanError("name a table or a query, not both")
    source = table if table is not None else f"({query}) q"
    base = {"url": url, "fetchsize": fetch_size, **(properties or {})}
    reader = spark.read.format("jdbc").options(**base)
    if partition_on is None:
        return reader.option("dbtable", source).load()
    if bounds is None:
        asked = f"(SELECT MIN({partition_on}) lo, MAX({partition_on}) hi FROM {source}) b"
        bounds = tuple(spark.read.format("jdbc").options(**base).option("dbtable", asked).load().first())
    lo, hi = bounds
    if lo is None:
        return reader.option("dbtable", source).load()
    return reader.options(
        dbtable=source, partitionColumn=partition_on, lowerBound=lo, upperBound=hi, numPartitions=partitions
    ).load()


def query_scan(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None, args: dict | None = None) -> DataFrame:
    """A user's SELECT over named DataFrames; Spark plans it as it plans any query."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def window_records(df: DataFrame, skip: int = 0, limit: int = -1) -> DataFrame:
    """Per file: leave out the first ``skip`` records and stop after ``limit`` (-1: no stop).

    ``df`` is a fresh scan of files. Parquet knows the number of each record. In text formats it is
    the record's place in its block plus the records of the blocks before it; block sizes come from
    one count, a row per input split, so nothing of the data is shuffled or ordered.
    """
    if skip <= 0 and limit < 0:
        return df
    columns = [F.col(f"`{c}`") for c in df.columns]
    try:
        numbered, number = df, F.col("_metadata.row_index")
        df.select(number)
    except AnalysisException:
        numbered, number = _numbered_by_block(df), F.col("_number")
    kept = number >= skip
    if limit >= 0:
        kept = kept & (number < skip + limit)
    return numbered.where(kept).select(*columns)


def _numbered_by_block(df: DataFrame) -> DataFrame:
    at = F.monotonically_increasing_id()
    located = df.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), at.alias("_id")
    ).withColumn("_task", F.shiftright("_id", 33))
    place = ["_file", "_block", "_task"]
    blocks = located.groupBy(*place).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # Written out: its true size decides whether it is broadcast, and the scan is then not shuffled.
    offsets = materialize(
        blocks.select(*place, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "blocks"
    )
    number = F.col("_id") - F.col("_first") + F.col("_before")
    moved = F.raise_error(F.lit("the files were split differently between the two passes"))
    return located.join(offsets, place, "left").withColumn(
        "_number", F.when(F.col("_first").isNull(), moved.cast("bigint")).otherwise(number)
    )
