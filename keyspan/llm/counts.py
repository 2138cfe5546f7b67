"""Operator 8: token counts from an exact histogram of encoded lengths."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyspan.llm.common import map_runs, texts_of
from keyspan.session import materialize

#: Lengths are summed in blocks of so many, so that no window holds more lengths than that.
BLOCK = 4096


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): the length of each whole text in tokens of a byte-level vocabulary; 0 for null and empty texts."""

    def work(part: pa.RecordBatch, texts: list[str]) -> dict:
        coded = _encoder(ranks_path, pattern).encode_ordinary_batch(texts, num_threads=1)
        return {"doc_id": part.column("doc_id"), "n_tokens": pa.array([len(x) for x in coded], pa.int64())}

    return map_runs(texts_of(docs, id_col, text_col), work, "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """(n_tokens, n_docs). Summed in the tasks first, so a very common length is one row per task."""
    return counted.where("n_tokens IS NOT NULL").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def length_sums(hist: DataFrame) -> DataFrame:
    """For every length that occurs, read as a context limit: what fits and what is cut.

    Columns: n_tokens (the limit), n_docs (of exactly that length), docs_over, tokens_over (longer documents and
    their tokens, by suffix sums), docs_total, tokens_total, truncated_total (tokens left if every document is cut at
    the limit), quantile (share of documents that fit; the limit is the smallest length with that share).

    A length's suffix sum is the sum inside its block plus the sums of later blocks. Blocks are at most the
    longest length / 4096, a bounded number however many documents there are. No rows for an empty table.
    """
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(after), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(after), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(every).alias("docs_total"),
        F.sum("block_tokens").over(every).alias("tokens_total"),
    )
    longer = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    sums = hist.select(
        "block", "n_tokens", "n_docs",
        F.coalesce(F.sum("n_docs").over(longer), F.lit(0)).alias("near_docs"),
        F.coalesce(F.sum("tokens").over(longer), F.lit(0)).alias("near_tokens"),
    ).join(blocks, "block")
    over, tokens = F.col("near_docs") + F.col("later_docs"), F.col("near_tokens") + F.col("later_tokens")
    return sums.select(
        "n_tokens", "n_docs", over.alias("docs_over"), tokens.alias("tokens_over"), "docs_total", "tokens_total",
        (F.col("tokens_total") - tokens + F.col("n_tokens") * over).alias("truncated_total"),
        ((F.col("docs_total") - over) / F.col("docs_total")).alias("quantile"),
    )


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """(docs_over, tokens_kept) for any context limit, from the sums: one row, none for an empty table."""
    fits = sums.where(F.col("n_tokens") <= limit).agg(
        F.max_by(F.struct("docs_over", "truncated_total", "n_tokens"), "n_tokens").alias("f"), F.lit(1).alias("one")
    )
    all_ = sums.agg(F.max("docs_total").alias("docs_total")).where("docs_total IS NOT NULL")
    over = F.coalesce("f.docs_over", "docs_total")
    kept = F.coalesce(F.col("f.truncated_total") + (limit - F.col("f.n_tokens")) * F.col("f.docs_over"), limit * F.col("docs_total"))
    return all_.withColumn("one", F.lit(1)).join(fits, "one").select(over.alias("docs_over"), kept.alias("tokens_kept"))


def at_quantile(sums: DataFrame, share: float) -> DataFrame:
    """(n_tokens): the smallest length that at least ``share`` of the documents do not exceed."""
    return sums.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Lengths, histogram and sums of all documents. The histogram is written once, as two passes read it."""
    return length_sums(materialize(histogram(lengths(docs, ranks_path, pattern)), "lengths"))
