"""Incremental load, running counters, latest row per key with expiry, windowed partition sizes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from keyspan.model import Codec, KeyspanError, TableSpec
from keyspan.sources.imports import MAX_ERRORS, load

#: Bytes of reduced rows that a task of ``stream_latest`` holds at once.
HELD_BYTES = 32 * 1024 * 1024
_AT, _TIE = "_latest_at", "_latest_tie"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

def stream_load(
    spark: SparkSession,
    directory: str,
    target: str,
    schema: dict[str, str],
    spec: TableSpec,
    checkpoint: str,
    fmt: str = "csv",
    codec: Codec = Codec(),
    max_errors: int | str = MAX_ERRORS,
    header: bool = True,
    files_per_batch: int | None = None,
    reports: list | None = None,
    buckets: int | None = None,
    multiline: bool = True,
    delimiter: str = ",",
    null_value: str = "",
) -> DataStreamWriter:
    """Load files as they arrive into a keyed table; start the returned writer.

    Each micro-batch is one ``load``: rejects are kept, and a batch beyond its error budget fails
    the query instead of being skipped. A batch that is run again after a failure upserts the same
    rows, so the table ends up the same; increments of a counter table would count twice and are
    refused. A batch rewrites only the buckets it has rows for (see ``load``). CSV files known to hold one record
    per line are split over tasks with ``multiline`` off; ``null_value`` is the text of a null.
    """
    if spec.counter:
        raise KeyspanError("a replayed batch would count increments twice; use stream_counters")
    text = ", ".join(f"`{c}` string" for c in schema)
    reader = spark.readStream.format(fmt).schema(text)
    if fmt == "csv":
        reader = reader.options(header=header, quote='"', escape='"', multiLine=multiline, sep=delimiter, nullValue=null_value)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def apply(batch: DataFrame, number: int) -> None:
        report = load(batch, target, schema, spec, codec=codec, max_errors=max_errors, buckets=buckets)
        if reports is not None:
            reports.append(report)
        if report.status == "ABORTED":
            raise RuntimeError(f"batch {number}: {report.rejected} of {report.read} records rejected")

    return (
        reader.load(directory)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )


def stream_counters(deltas: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Running totals per key; write in update mode. State is one row per key."""
    return deltas.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def stream_partition_counts(
    df: DataFrame, keys: list[str], event_time: str, window: str = "1 hour", delay: str = "10 minutes", slide: str | None = None
) -> DataFrame:
    """Rows per partition key and event-time window; late rows beyond ``delay`` are not counted."""
    span = F.window(event_time, window, slide) if slide else F.window(event_time, window)
    return (
        df.withWatermark(event_time, delay)
        .groupBy(span.alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "rows")
    )


def stream_latest(
    changes: DataFrame, keys: list[str], event_time: str, ttl_seconds: int, delay: str = "10 minutes", lifetime: str = "event"
) -> DataFrame:
    """The latest row per key, forgotten ``ttl_seconds`` after its time; write in update mode.

    A row is emitted whenever it becomes the latest of its key; one that is older than the row held, or
    expired on arrival, is ignored, as is one without a time. Equal times are decided by a hash of the row, so a replay
    gives the same result. With ``lifetime="event"`` a key expires when the watermark passes the row's time plus its
    lifetime (a timer of the state); with ``"arrival"`` the state itself forgets the row that long after it was stored.
    Spark then runs batches without data for ever, so ``availableNow`` ends only with
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off.

    Every task first reduces its rows to one per key, so a hot key is one row per task in the shuffle. State per key is a
    single row, kept in RocksDB: the session's state store provider is set to it, for queries started from now on.
    """
    if lifetime not in ("event", "arrival"):
        raise KeyspanError("a lifetime counts from event or arrival")
    conf = changes.sparkSession.conf
    if conf.get(_PROVIDER, None) != _ROCKSDB:
        conf.set(_PROVIDER, _ROCKSDB)
    names = changes.columns
    hashable = [F.col(f"`{f.name}`") for f in changes.schema if not isinstance(f.dataType, T.MapType)]
    at = F.unix_micros(F.col(f"`{event_time}`").cast("timestamp"))
    ranked = changes.where(F.col(f"`{event_time}`").isNotNull()).select(
        *[F.col(f"`{c}`") for c in names], at.alias(_AT), F.xxhash64(*hashable).alias(_TIE)
    )
    reduced = ranked.mapInArrow(partial(_latest_of_task, keys=keys), ranked.schema)
    kept = (
        reduced.withWatermark(event_time, delay)
        .groupBy(*keys)
        .transformWithState(
            _Latest(names, reduced.schema, ttl_seconds, lifetime == "event"), changes.schema, "update",
            "eventTime" if lifetime == "event" else "processingTime",
        )
    )
    return kept


def _latest_of_task(batches: Iterator, keys: list[str]) -> Iterator:
    """One row per key of what a task reads; where its keys pass ``HELD_BYTES``, they are passed on and it begins anew."""
    import pyarrow as pa

    held, waiting, grown = [], 0, 0
    for batch in batches:
        held.append(_latest_of(pa.Table.from_batches([batch]), keys))
        waiting += held[-1].nbytes
        # Reduced again whenever the waiting rows have doubled, so the work stays in proportion.
        if waiting > max(2 * grown, HELD_BYTES // 4):
            held = [_latest_of(pa.concat_tables(held), keys)]
            waiting = grown = held[0].nbytes
            if grown > HELD_BYTES:
                yield from held[0].to_batches()
                held, waiting, grown = [], 0, 0
    if held:
        yield from _latest_of(pa.concat_tables(held), keys).to_batches()


def _latest_of(table, keys: list[str]):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    order = pc.sort_indices(table, sort_keys=[(_AT, "descending"), (_TIE, "descending")])
    # Only the keys are sorted and grouped; rows that lose are never moved.
    ids = pa.table([table.column(k).take(order) for k in keys] + [np.arange(len(table))], names=[f"k{i}" for i in range(len(keys))] + ["i"])
    first = ids.group_by([f"k{i}" for i in range(len(keys))]).aggregate([("i", "min")]).column("i_min")
    return table.take(order.take(first))


class _Latest(StatefulProcessor):
    """Holds the latest row of a key with its time and tie-break."""

    def __init__(self, names: list[str], schema: T.StructType, ttl_seconds: int, by_event: bool):
        self.names, self.schema, self.ttl, self.by_event = names, schema, ttl_seconds * 1000, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("latest", self.schema, None if self.by_event else self.ttl)

    def expiry(self, at: int) -> int:
        return at // 1000 + self.ttl

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        best = max(rows, key=lambda r: (r[_AT], r[_TIE]))
        if self.by_event and self.expiry(best[_AT]) <= timerValues.getCurrentWatermarkInMs():
            return
        held = self.held.get()
        if held is not None:
            # State values come back as a row in the order of the schema.
            was = held[len(self.names)], held[len(self.names) + 1]
            if (best[_AT], best[_TIE]) <= was:
                return
            if self.by_event:
                self.handle.deleteTimer(self.expiry(was[0]))
        self.held.update(tuple(best))
        if self.by_event:
            self.handle.registerTimer(self.expiry(best[_AT]))
        yield Row(*self.names)(*[best[n] for n in self.names])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass
