"""Key tokens: a signed 64-bit hash of the partition key and the ranges that cut its ring.

A range is ``(start, end]``. The lowest token is the open start of the first range and belongs to
it, so the ranges cover every token exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.model import KeyspanError

MIN_TOKEN = -(2**63)
MAX_TOKEN = 2**63 - 1
_HALF = 2**31
_WORD = 2**32


def token(*keys: str) -> Column:
    """Token of a key. Deterministic, so a retried task computes the same value."""
    return F.xxhash64(*[F.col(k) for k in keys])


def split_of(tok: Column, splits: int) -> Column:
    """Number of the even split that holds a token: plain integer arithmetic, no lookup."""
    if not 0 < splits < _HALF:
        raise KeyspanError("splits must be between 1 and 2**31 - 1")
    upper = F.shiftright(tok, 32) + F.lit(_HALF)
    return F.shiftright(upper * F.lit(splits).cast("bigint"), 32).cast("int")


def split_ranges(spark: SparkSession, splits: int) -> DataFrame:
    """The even splits as rows ``(split_id, range_start, range_end)``; tokens are text."""
    def first_token(i: str) -> str:
        return f"((({i}) * {_WORD}L + {splits - 1}L) div {splits}L - {_HALF}L) * {_WORD}L"

    start = f"if(id = 0, {MIN_TOKEN + 1}L - 1L, {first_token('id')} - 1L)"
    end = f"if(id = {splits - 1}, {MAX_TOKEN}L, {first_token(f'least(id + 1, {splits - 1})')} - 1L)"
    return spark.range(0, splits, 1, 1).select(
        F.col("id").cast("int").alias("split_id"),
        F.expr(start).cast("string").alias("range_start"),
        F.expr(end).cast("string").alias("range_end"),
    )


def in_range(tok: Column, start: int, end: int) -> Column:
    """``start < token <= end``; a range whose end is not after its start wraps around the ring."""
    above, below = tok > F.lit(start), tok <= F.lit(end)
    if start == MIN_TOKEN:
        above = F.lit(True)
    return (above & below) if start < end else (above | below)


def splits_per_range(ranges: int, target: int = 10_000) -> int:
    """How often each given range is cut so that about ``target`` splits result."""
    if ranges <= 0 or target <= ranges:
        return 1
    return -(-target // ranges)
