"""The built-in functions of the query language under their own names, for use in Spark SQL.

``count``, ``min``, ``max``, ``sum``, ``avg``, ``now`` and ``uuid`` are Spark's own; the token of a key
is ``xxhash64``; write time and lifetime of cells are columns of ``cell_meta``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from keyspan.functions.vectors import METRICS, similarity_function

_BARE = "replace(v, '-', '')"
_TICKS = f"conv(concat(substr({_BARE}, 14, 3), substr({_BARE}, 9, 4), substr({_BARE}, 1, 8)), 16, 10)"
_UUID_TIME = (
    f"CASE WHEN regexp_like({_BARE}, '^[0-9a-fA-F]{{12}}1[0-9a-fA-F]{{19}}$') THEN "
    f"timestamp_millis(CAST((CAST({_TICKS} AS DECIMAL(20, 0)) - 122192928000000000BD) div 10000 AS BIGINT)) END"
)
# Where a function takes a timeuuid or a time, the text of either is understood.
_MOMENT = f"coalesce({_UUID_TIME}, try_cast(v AS TIMESTAMP))"

_FUNCTIONS = {
    "dateof": ("TIMESTAMP", _UUID_TIME),
    "unixtimestampof": ("BIGINT", f"unix_millis({_UUID_TIME})"),
    "todate": ("DATE", f"to_date({_MOMENT})"),
    "totimestamp": ("TIMESTAMP", _MOMENT),
    "tounixtimestamp": ("BIGINT", f"unix_millis({_MOMENT})"),
}


def register_builtins(spark: SparkSession) -> list[str]:
    """Define the functions in the session and return their names.

    The time functions are SQL functions, which Spark inlines into the plan; the similarities move
    their vectors in Arrow batches.
    """
    for name, (kind, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS {kind} RETURN {body}")
    made = list(_FUNCTIONS)
    for metric in METRICS:
        spark.udf.register(f"similarity_{metric}", similarity_function(metric))
        made.append(f"similarity_{metric}")
    return made
