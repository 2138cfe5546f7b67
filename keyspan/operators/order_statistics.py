"""Rows by their place in an order, without sorting the table.

A quantile sketch of the order's codes gives two bounds between which the wanted places surely lie. The next pass
keeps the rows between them and counts those before the lower one, so that places stay known. That is repeated
on what was kept, two thousandths or so, until it is small enough to be sorted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from keyspan.operators.first_rows import codes
from keyspan.session import work_path

#: Relative rank error of the sketch is one in this many.
ACCURACY = 10_000
GRID = 2_000
#: A value that takes this many steps of the grid is looked into by the next column.
HOT_STEPS = 4


@dataclass
class _Edge:
    """One end of the wanted places: the codes found so far and the place inside the rows that share them."""

    upper: bool
    place: int  # from 0, among the rows whose leading codes are ``codes``
    codes: list[float] = field(default_factory=list)
    strict: bool = False  # the rows with exactly these codes are not wanted
    done: bool = False

    def inside(self) -> Column:
        return _all([F.col(f"_code{i}") == F.lit(c) for i, c in enumerate(self.codes)])

    def before(self) -> Column:
        """Rows that come before all rows with the codes."""
        return self._beyond(lambda code, cut: code < cut)

    def wanted(self) -> Column:
        """Rows on the wanted side of the edge."""
        if not self.codes:
            return F.lit(True)
        beyond = self._beyond((lambda code, cut: code < cut) if self.upper else (lambda code, cut: code > cut))
        return beyond if self.strict else beyond | self.inside()

    def _beyond(self, compare) -> Column:
        out = F.lit(False)
        for i in reversed(range(len(self.codes))):
            code, cut = F.col(f"_code{i}"), F.lit(self.codes[i])
            out = compare(code, cut) | ((code == cut) & out)
        return out

    def bound(self, rows: int, grid: list[float]) -> None:
        """Choose the next code from the grid of the rows that share the codes so far."""
        slack = GRID * 2 / ACCURACY + 1
        step = self.place * GRID / rows
        at = int(-(-(step + slack) // 1)) if self.upper else int((step - slack) // 1)
        if not 0 <= at <= GRID:  # the first or the last rows: no bound is needed within these codes
            self.done = True
            return
        self.codes.append(grid[at])
        self.done = grid.count(grid[at]) < HOT_STEPS

    def enter(self, before: int, rows: int) -> None:
        """Go into the rows with the last chosen code, if the place is among them."""
        if before <= self.place < before + rows:
            self.place -= before
        else:
            self.strict = self.done = True


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def _edges(coded: DataFrame, levels: int, lo: int, hi: int, rows: int, grid: list[float]) -> tuple[_Edge, _Edge]:
    """Bounds around the places lo .. hi - 1. One pass for each order column that a hot value makes necessary."""
    edges = (_Edge(False, lo), _Edge(True, hi - 1))
    for edge in edges:
        edge.bound(rows, grid)
    for level in range(1, levels):
        waiting = [e for e in edges if not e.done]
        if not waiting:
            break
        asked = []
        for e in waiting:
            # Places count from the first row with the codes before the last one.
            group = _all([F.col(f"_code{i}") == F.lit(c) for i, c in enumerate(e.codes[:-1])])
            last = F.col(f"_code{level - 1}")
            asked.append(F.struct(
                F.count(F.when(group & (last < F.lit(e.codes[-1])), 1)), F.count(F.when(e.inside(), 1)),
                _sketch(F.when(e.inside(), F.col(f"_code{level}"))),
            ))
        for e, (before, n, steps) in zip(waiting, coded.agg(*asked).first()):
            e.enter(before, n)
            if not e.done:
                e.bound(n, steps)
    return edges


def _sketch(code: Column) -> Column:
    return F.percentile_approx(code, [i / GRID for i in range(GRID + 1)], ACCURACY)


def rows_around(df: DataFrame, order: list, lo: int, hi: int, enough: int) -> tuple[DataFrame, int]:
    """Some rows of ``df`` among which are those at the places lo .. hi - 1 (from 0), and the places before the first of them.

    Narrows until at most ``enough`` rows are left, or until a pass no longer halves them: where the rows asked for are many,
    or where an order column of inexact code (text, fractions) repeats one code. Each time a sketch reads the order columns, and
    a second pass writes the rows between the bounds to the work folder. ``df`` must give the same rows whenever it is read.
    """
    parts = codes(df, order)
    if not parts:
        return df, 0
    spark, names, skipped, before = df.sparkSession, df.columns, 0, None
    while True:
        coded = df.select("*", *[p.alias(f"_code{i}") for i, p in enumerate(parts)])
        rows, grid = coded.agg(F.count(F.lit(1)), _sketch(F.col("_code0"))).first()
        if lo - skipped >= rows:
            return df.where(F.lit(False)), skipped
        if rows <= enough or (before is not None and rows * 2 > before):
            return df, skipped
        edges = _edges(coded, len(parts), lo - skipped, min(hi - skipped, rows), rows, grid)
        if not edges[0].codes and not edges[1].codes:
            return df, skipped
        # Rows that come before the lower edge are counted while the others are written, so the table is not read once more.
        passed = Observation()
        path = work_path(spark, "around")
        counted = coded.observe(passed, F.count(F.when(~edges[0].wanted(), 1)).alias("n"))
        kept = counted.where(edges[0].wanted() & edges[1].wanted()).select(*[F.col(f"`{c}`") for c in names])
        kept.write.parquet(path)
        skipped += passed.get["n"]
        df, before = spark.read.schema(kept.schema).parquet(path), rows
