"""User functions and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from keyspan.model import KeyspanError

NULL_HANDLING = ("CALLED ON NULL INPUT", "RETURNS NULL ON NULL INPUT")


def make_function(fn: Callable, return_type: str, null_handling: str = NULL_HANDLING[0]) -> Callable[..., Column]:
    """A scalar function for columns, moved in Arrow batches.

    Under RETURNS NULL ON NULL INPUT the function never sees a null argument.
    """
    if null_handling not in NULL_HANDLING:
        raise KeyspanError(f"null handling must be one of {', '.join(NULL_HANDLING)}")
    strict = null_handling == NULL_HANDLING[1]

    def call(*args):
        if strict and any(a is None for a in args):
            return None
        return fn(*args)

    return F.udf(call, return_type, useArrow=True)


def register_function(
    spark: SparkSession, name: str, fn: Callable, return_type: str, null_handling: str = NULL_HANDLING[0]
) -> Callable[..., Column]:
    """Make a scalar function callable by name in SQL; returns it for DataFrame use."""
    made = make_function(fn, return_type, null_handling)
    spark.udf.register(name, made)
    return made


@dataclass(frozen=True)
class Aggregate:
    """A user aggregate: state function, initial state, merge of two states, final function.

    ``merge`` is what lets a group be folded by many tasks; without it one task would have to see
    every row of the largest group.
    """

    sfunc: Callable[..., Any]
    init: Any
    merge: Callable[[Any, Any], Any]
    state_type: str
    final: Callable[[Any], Any] | None = None
    return_type: str | None = None


def apply_aggregate(df: DataFrame, keys: list[str], arguments: list[str], aggregate: Aggregate, out: str = "result", open_groups: int = 100_000) -> DataFrame:
    """One row per key with the aggregate's result.

    Each task folds its rows into one state per key it meets and passes the states on when it holds
    ``open_groups`` of them. Only states are shuffled; a hot key sends a few per task. The states of
    a key are then merged and finished.
    """
    sfunc, init, merge, final = aggregate.sfunc, aggregate.init, aggregate.merge, aggregate.final
    width = len(keys)
    named = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    state_schema = StructType.fromDDL(", ".join([*named, f"_state {aggregate.state_type}"]))
    result_type = aggregate.return_type or aggregate.state_type
    result_schema = StructType.fromDDL(", ".join([*named, f"`{out}` {result_type}"]))
    state_arrow, result_arrow = to_arrow_schema(state_schema), to_arrow_schema(result_schema)

    def fold(batches):
        import copy

        import pyarrow as pa

        states: dict = {}

        def flush():
            columns = [*([list(c) for c in zip(*states)] if width else []), list(states.values())]
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, state_arrow)]
            return pa.RecordBatch.from_arrays(arrays, schema=state_arrow)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                key = row[:width]
                state = states[key] if key in states else copy.deepcopy(init)
                states[key] = sfunc(state, *row[width:])
            if len(states) > open_groups:
                yield flush()
                states.clear()
        if states:
            yield flush()

    def finish(key, batches):
        import pyarrow as pa

        state, seen = None, False
        for batch in batches:
            for item in batch.column(width).to_pylist():
                state, seen = (merge(state, item), True) if seen else (item, True)
        value = final(state) if final else state
        columns = [*[[k.as_py()] for k in key[:width]], [value]]
        arrays = [pa.array(c, type=f.type) for c, f in zip(columns, result_arrow)]
        yield pa.RecordBatch.from_arrays(arrays, schema=result_arrow)

    # Spark tells from the types that the states of a key come batch by batch.
    finish.__annotations__ = {
        "key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]
    }
    partial = df.select(*keys, *arguments).mapInArrow(fold, state_schema)
    if not keys:
        partial = partial.withColumn("_all", F.lit(0))
    return partial.groupBy(*(keys or ["_all"])).applyInArrow(finish, result_schema)
