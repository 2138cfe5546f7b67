"""Streaming forms, run over the given tables with ``availableNow`` and read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyspan.model import TableSpec
from keyspan.operators.buckets import read_buckets
from keyspan.plans.registry import query
from keyspan.session import work_path
from keyspan.sources import exports
from keyspan.streaming import streams

def _stream(t, name: str):
    """A table as a file stream."""
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.directory)


def _run_updates(t, result, keys: list[str]):
    """Run to the end; every batch's updates are appended with their batch number and the latest
    update of each key is the result."""
    out = work_path(t.spark, "updates")

    def append(batch, number):
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(out)

    (
        result.writeStream.outputMode("update").foreachBatch(append)
        .option("checkpointLocation", work_path(t.spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    )
    updates = t.spark.read.parquet(out)
    values = [c for c in updates.columns if c not in (*keys, "_batch")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v"))
    return last.select(*keys, *[f"v.{c}" for c in values])


@query(
    "stream_counters",
    "SELECT user_id, sum(round(value * 100)::BIGINT)::BIGINT AS cents, count(*)::BIGINT AS hits FROM events GROUP BY 1",
)
def stream_counters(t):
    deltas = _stream(t, "events").select(
        "user_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.lit(1).cast("bigint").alias("hits")
    )
    return _run_updates(t, streams.stream_counters(deltas, ["user_id"], ["cents", "hits"]), ["user_id"])


@query(
    "stream_partition_counts",
    """
    SELECT user_id, epoch_us(time_bucket(INTERVAL '1 day', ts)) AS window_start, count(*) AS rows FROM events GROUP BY 1, 2
    """,
)
def stream_partition_counts(t):
    timed = _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = streams.stream_partition_counts(timed, ["user_id"], "ts", "1 day", "1 hour")
    done = _run_updates(t, counted, ["window_start", "window_end", "user_id"])
    return done.select("user_id", F.unix_micros("window_start").alias("window_start"), "rows")


@query(
    "stream_latest",
    """
    SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type, max(epoch_us(ts)) AS ts
    FROM events GROUP BY 1
    """,
)
def stream_latest(t):
    changes = _stream(t, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    latest = _run_updates(t, streams.stream_latest(changes, ["user_id"], "ts", 7 * 86400), ["user_id"])
    return latest.withColumn("ts", F.unix_micros("ts"))


@query(
    "stream_load",
    "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY'",
)
def stream_load(t):
    incoming, target = work_path(t.spark, "incoming"), work_path(t.spark, "table")
    shown = t.customer.select(
        "c_custkey", "c_name",
        F.when(F.col("c_mktsegment") == "MACHINERY", "?").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
        "c_mktsegment",
    )
    exports.export(shown.repartition(4, "c_custkey"), incoming, "csv", verify=False)
    writer = streams.stream_load(
        t.spark, incoming, target,
        {"c_custkey": "bigint", "c_name": "text", "c_acctbal": "double", "c_mktsegment": "text"},
        TableSpec(("c_custkey",)), work_path(t.spark, "checkpoint"), max_errors="50%", files_per_batch=2,
    )
    writer.start().awaitTermination()
    return read_buckets(t.spark, target)
