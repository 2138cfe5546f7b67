"""Tables that keep the write time and lifetime of every cell.

Such a table has, beside its columns, ``_ts`` (struct of write times in microseconds, one field per
non-key column), ``_ttl`` (struct of lifetimes in seconds) and ``_row_ts``, the time of the latest
insert, which keeps a row alive that has no cells. A cell with a time but no value is a deletion
that still beats older writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.model import TableSpec
from keyspan.operators.writes import orderable, with_delta

OPERATIONS = ("insert", "update", "delete_cells", "delete_row")


def to_cells(df: DataFrame, spec: TableSpec, ts: int | str | Column, ttl: int | str | None = None) -> DataFrame:
    """Give every non-null cell of a plain table the same write time."""
    columns = [c for c in df.columns if c not in spec.key]
    at = F.col(ts) if isinstance(ts, str) else ts if isinstance(ts, Column) else F.lit(ts)
    life = F.col(ttl) if isinstance(ttl, str) else F.lit(ttl)
    at, life = at.cast("bigint"), F.when(life.cast("int") > 0, life.cast("int"))
    return df.select(
        *df.columns,
        F.struct(*[F.when(F.col(c).isNotNull(), at).alias(c) for c in columns]).alias("_ts"),
        F.struct(*[F.when(F.col(c).isNotNull(), life).alias(c) for c in columns]).alias("_ttl"),
        at.alias("_row_ts"),
        F.lit(None).cast("bigint").alias("_gone_ts"),
    )


def merge_cells(
    base: DataFrame, changes: DataFrame, spec: TableSpec, op: str = "op", ts: str = "ts",
    seq: str = "seq", set_cols: str = "set_cols", ttl: str | None = None,
) -> DataFrame:
    """Apply a mixed set of changes cell by cell; the latest write of each cell wins.

    A change is an ``insert`` or ``update`` of the columns in ``set_cols``, ``delete_cells`` of
    them, or ``delete_row``. A row deletion at time t removes cells written at or before t and
    loses to later ones. Changes win against equal times in the base; among themselves ``seq``
    decides, then the larger value. The result keeps deleted rows (see ``live_rows``), so late changes still lose.
    """
    spec.require_key(changes.columns)
    columns = [c for c in base.columns if c not in spec.key and not c.startswith("_")]
    writes = F.col(op).isin("insert", "update")
    life = F.when(F.col(ttl) > 0, F.col(ttl).cast("int")) if ttl else F.lit(None).cast("int")
    made = []
    for c in columns:
        touched = F.col(op).isin("insert", "update", "delete_cells") & F.array_contains(set_cols, F.lit(c))
        value = F.when(writes, F.col(c)) if c in changes.columns else F.lit(None)
        cell = F.struct(
            F.col(ts).cast("bigint").alias("at"), F.col(seq).cast("bigint").alias("seq"),
            value.cast(base.schema[c].dataType).alias("value"),
            F.when(writes & value.isNotNull(), life).alias("life"),
        )
        # Equal times and sequence numbers: the larger value, as in an upsert.
        order = F.struct(cell["at"], cell["seq"], orderable(cell["value"], base.schema[c].dataType).alias("value"), cell["life"])
        made.append(F.max_by(cell, F.when(touched, order)).alias(c))
    made.append(F.max(F.when(F.col(op) == "insert", F.col(ts).cast("bigint"))).alias("_row_ts"))
    made.append(F.max(F.when(F.col(op) == "delete_row", F.col(ts).cast("bigint"))).alias("_gone_ts"))
    delta = changes.groupBy(*spec.key).agg(*made)
    joined = with_delta(base, delta, spec.key)
    gone = F.greatest("_gone_ts", "d__gone_ts")
    out = [F.when(F.col("_in_base"), F.col(k)).otherwise(F.col(f"d_{k}")).alias(k) for k in spec.key]
    values, times, lives = [], [], []
    for c in columns:
        new = F.col(f"d_{c}")
        taken = new["at"].isNotNull() & (F.col(f"_ts.{c}").isNull() | (new["at"] >= F.col(f"_ts.{c}")))
        at = F.when(taken, new["at"]).otherwise(F.col(f"_ts.{c}"))
        kept = gone.isNull() | (at > gone)
        values.append(F.when(kept, F.when(taken, new["value"]).otherwise(F.col(c))).alias(c))
        times.append(F.when(kept, at).alias(c))
        lives.append(F.when(kept, F.when(taken, new["life"]).otherwise(F.col(f"_ttl.{c}"))).alias(c))
    row_ts = F.greatest("_row_ts", "d__row_ts")
    return joined.select(
        *out, *values, F.struct(*times).alias("_ts"), F.struct(*lives).alias("_ttl"),
        F.when(gone.isNull() | (row_ts > gone), row_ts).alias("_row_ts"), gone.alias("_gone_ts"),
    )


def live_rows(table: DataFrame, spec: TableSpec, as_of: int | None = None) -> DataFrame:
    """The readable table: expired cells are null, rows without marker and cells are left out.

    ``as_of`` is in microseconds.
    """
    columns = [c for c in table.columns if c not in spec.key and not c.startswith("_")]
    shown = []
    for c in columns:
        dead = F.lit(False)
        if as_of is not None:
            dead = F.coalesce(F.col(f"_ts.{c}") + F.col(f"_ttl.{c}").cast("bigint") * 1_000_000 <= as_of, F.lit(False))
        shown.append(F.when(~dead, F.col(c)).alias(c))
    rows = table.select(*spec.key, *shown, "_row_ts")
    alive = F.col("_row_ts").isNotNull()
    for c in columns:
        alive = alive | F.col(c).isNotNull()
    return rows.where(alive).drop("_row_ts")


def cell_meta(table: DataFrame, spec: TableSpec, columns: list[str]) -> DataFrame:
    """Write time and lifetime of cells: ``writetime_<c>`` and ``ttl_<c>`` beside the key."""
    spec.refuse_key(columns)
    made = []
    for c in columns:
        present = F.col(c).isNotNull()
        made.append(F.when(present, F.col(f"_ts.{c}")).alias(f"writetime_{c}"))
        made.append(F.when(present, F.col(f"_ttl.{c}")).alias(f"ttl_{c}"))
    return table.select(*spec.key, *made)
