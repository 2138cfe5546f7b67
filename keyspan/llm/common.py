"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of one Arrow batch are worked on in runs of about so many characters, so that a task's memory
#: follows this number and the longest single text, not the number of rows in a batch.
RUN_CHARS = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``. A null id counts as empty text (fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): only the two columns that are used, so other columns can have any name. Null texts are empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def runs(batch: pa.RecordBatch, text: str = "text", chars: int = RUN_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with about ``chars`` characters each (at least one row), with their texts as a list."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > chars:
            part = batch.slice(start, i - start)
            yield part, part.column(text).to_pylist()
            start, total = i, 0
        total += size
    if len(sizes) > start:
        part = batch.slice(start)
        yield part, part.column(text).to_pylist()


def map_runs(df: DataFrame, fn: Callable[[pa.RecordBatch, list[str]], dict], schema: str, chars: int = RUN_CHARS) -> DataFrame:
    """``fn`` on each run of texts; it returns columns of the same rows, without those of the input it repeats."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in runs(batch, chars=chars):
                columns = fn(part, texts)
                yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(work, schema)


def keep_rows(docs: DataFrame, keep: Callable[[list[str]], Iterable[bool]], text_col: str = "text", chars: int = RUN_CHARS) -> DataFrame:
    """The rows of ``docs`` whose text (null: empty) ``keep`` says to keep, with all their columns as they are."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in runs(batch, text_col, chars):
                yield part.filter(pa.array(list(keep([t or "" for t in texts])), pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
