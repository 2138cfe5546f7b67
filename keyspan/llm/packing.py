"""Operator 11: shards of near equal bytes, tokens and rows, by vector bin packing.

Documents with equal texts are a group. A shard's capacity is the same share of all bytes, all tokens and all rows;
its residual is what groups placed so far have left of it. A group goes, among the shards with room for it, to the one
where the dot product of its demand with the residual is highest, both as shares of a capacity. Larger groups go first.

Four levels:

1. Groups above 1 / LARGE of a capacity in any dimension; there are at most 3 * shards * LARGE of them, whatever the
   table holds, and the driver places them one by one. A very large one that fits nowhere is split by rows.
2. Groups that are large for a cell, 3. all others but one in LAST, 4. these. They are dealt to cells by hash, and a cell
   places its groups on its own share of the residuals. What the cells of one level leave uneven, the next one fills up.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.session import materialize

SHARDS = 16
#: The driver places groups above this part of a shard's capacity.
LARGE = 256
#: A group up to this part of a shard's capacity is never split.
WHOLE = 8
#: Groups of a cell, about; a group is large for its cell above 1 / SPREAD of a shard's part of it.
CELL, SPREAD = 2000, 8
#: One in so many of the small groups is placed last.
LAST = 16
#: Rows of a file of a work table, about: tables that follow a shuffle get as many tasks and files as their rows need.
FILE_ROWS = 20_000
DIMENSIONS = ("bytes", "tokens", "rows")


def words(text: Column) -> Column:
    """The default count of tokens: runs of anything but ASCII white space.

    Each becomes one letter, together with the white space before it: counting matches would make an object of each word.
    """
    ended = F.rtrim(text, F.lit(" \t\n\v\f\r"))
    return F.length(F.regexp_replace(ended, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "w")).cast("long")


def choose(residual: np.ndarray, demand: np.ndarray) -> tuple[int, bool]:
    """The shard for a demand, and whether it has room for all of it.

    Without room in all dimensions, a shard with room for the bytes; without one, that with most bytes left.
    """
    room = residual >= demand - 1e-12
    fits = room.all(axis=1)
    whole = bool(fits.any())
    if not whole:
        fits = room[:, 0]
    if fits.any():
        return int(np.where(fits, residual @ demand, -np.inf).argmax()), whole
    return int(residual[:, 0].argmax()), False


def place_large(groups: list[tuple[bytes, np.ndarray, int]], residual: np.ndarray) -> dict[bytes, list[tuple[int, int]]]:
    """[(shard, rows)] of each group (digest, demand, rows), larger ones first; ``residual`` is reduced.

    A group above 1 / WHOLE of a capacity that has no room in any shard is split into pieces of that demand, each placed
    like a group; what is left when no shard has room for a row goes to all of them evenly. Groups of such a demand go
    first, by their largest dimension; then the others by bytes, so that small texts even out the bytes.
    """
    out = {}

    def order(group: tuple[bytes, np.ndarray, int]) -> tuple:
        digest, demand, _ = group
        return (0, -demand.max(), digest) if demand.max() > 1 / WHOLE else (1, -demand[0], digest)

    for digest, demand, rows in sorted(groups, key=order):
        pieces, left, one = {}, rows, demand / rows
        used = one > 0
        while left:
            shard, whole = choose(residual, one * left)
            n = left
            if not whole and (one * left).max() > 1 / WHOLE:
                share = np.floor((residual[:, used] / one[used]).min(axis=1) + 1e-9)
                if share.max() < 1:
                    for s in range(len(residual)):
                        n = left // len(residual) + (s < left % len(residual))
                        pieces[s] = pieces.get(s, 0) + n
                        residual[s] -= one * n
                    break
                shard = int(np.where(share >= 1, residual @ one, -np.inf).argmax())
                n = int(min(left, share[shard], max(1, 1 / WHOLE / one.max())))
            pieces[shard] = pieces.get(shard, 0) + n
            residual[shard] -= one * n
            left -= n
        out[digest] = [(s, n) for s, n in pieces.items() if n]
    return out


def _cells(groups: DataFrame, cells: int, capacity: np.ndarray, residual: np.ndarray, remaining: np.ndarray) -> DataFrame:
    """(digest, shard, bytes, tokens, rows) of groups placed cell by cell."""
    shards = len(residual)
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = F.pmod(F.xxhash64("digest"), F.lit(cells))
    dealt = groups.withColumn("cell", cell).repartition(parts, "cell").sortWithinPartitions("cell", F.desc("bytes"), "digest")
    dealt = dealt.coalesce(_files(cells * CELL))  # a cell's groups stay side by side

    def placed(cell: int, demand: np.ndarray) -> np.ndarray:
        # A shard's part of a cell: its part of what is still to be placed. Cells begin at different shards.
        own = demand.sum(axis=0) * residual / remaining / capacity
        turn = np.roll(np.arange(shards), cell % shards)
        own, out = own[turn], np.empty(len(demand), np.int32)
        for i, d in enumerate(demand / capacity):
            out[i], _ = choose(own, d)
            own[out[i]] -= d
        return turn[out].astype(np.int32)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            demand = np.stack([rows.column(d).to_numpy() for d in DIMENSIONS], axis=1).astype(float)
            shard = placed(rows.column("cell")[0].as_py(), demand)
            yield from rows.select(["digest", *DIMENSIONS]).append_column("shard", pa.array(shard)).to_batches()

        for batch in batches:
            own = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:]):
                if held and b > a and held[-1].column("cell")[0].as_py() != own[a]:
                    yield from flushed()
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from flushed()

    return dealt.mapInArrow(work, "digest binary, bytes long, tokens long, rows long, shard int")


def _files(rows: int) -> int:
    return max(1, -(-rows // FILE_ROWS))


def _sums(groups: DataFrame) -> np.ndarray:
    row = groups.agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).first()
    return np.array([row[d] or 0 for d in DIMENSIONS], float)


def _with_place(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])


def _split_rows(rows: DataFrame, pieces: dict[bytes, list[tuple[int, int]]]) -> DataFrame:
    """``rows`` of the groups that are split, with their shard: as many of each group to a shard as its piece says."""
    spark = rows.sparkSession
    ends = [(d, [(int(e), s) for e, (s, _) in zip(np.cumsum([n for _, n in p]), p)]) for d, p in pieces.items()]
    table = F.broadcast(spark.createDataFrame(ends, "digest binary, ends array<struct<upto:long,shard:int>>"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            at = []
            for digest in batch.column("digest").to_pylist():
                at.append(seen.get(digest, 0))
                seen[digest] = at[-1] + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(at, pa.int64())],
                names=[*batch.schema.names, "part", "at"],
            )

    mine = rows.join(table.select("digest"), "digest", "left_semi")
    numbered = materialize(mine.mapInArrow(work, _with_place(mine)), "packing-split")
    before = Window.partitionBy("digest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = numbered.groupBy("digest", "part").agg(F.count("*").alias("n"))
    offsets = counted.select("digest", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("at")
    shard = F.filter("ends", lambda e: e["upto"] > place)[0]["shard"]
    return numbered.join(offsets, ["digest", "part"]).join(table, "digest").withColumn("shard", shard).select(*rows.columns, "shard")


def _slots(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``: their place in their shard, without gaps. Each task numbers its own; one count for each task and
    shard says what earlier tasks hold."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            seen = np.pad(seen, (0, max(0, int(shard.max(initial=-1)) + 1 - len(seen))))
            order = np.argsort(shard, kind="stable")
            count = np.bincount(shard, minlength=len(seen))
            at = np.empty(len(shard), np.int64)
            at[order] = np.arange(len(shard)) - np.repeat(np.cumsum(count) - count, count)
            at += seen[shard]
            seen = seen + count
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(shard), part, np.int32)), pa.array(at)], names=[*batch.schema.names, "part", "at"]
            )

    numbered = materialize(rows.mapInArrow(work, _with_place(rows)), "packing-slots")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = numbered.groupBy("shard", "part").agg(F.count("*").alias("n"))
    offsets = counted.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    joined = numbered.join(F.broadcast(offsets), ["shard", "part"])
    return joined.withColumn("slot", F.col("before") + F.col("at")).drop("before", "at", "part")


def pack(
    docs: DataFrame, shards: int = SHARDS, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", tokens: Column | None = None
) -> DataFrame:
    """``keep`` columns, size, text_crc32, shard and slot of every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 1, ``text_crc32`` its unsigned CRC-32; a null text counts as empty and is in
    one group with empty ones. ``tokens`` (default: words) counts a text's tokens. Rows of one text share a shard unless
    they take more than an eighth of a shard and none has room for all of them; repeated rows and ids are rows of their own. ``slot`` numbers a shard's
    rows from 0 without gaps. The shard of a text depends on the table's content only, the slots on its layout too.
    An empty table gives no rows. Columns that are not kept are not read; kept ones may have any name but those added.

    Texts are read once, to be measured; what is shuffled are groups (once) and rows without their texts.
    """
    clash = sorted({c.lower() for c in keep} & {"size", "text_crc32", "shard", "slot"})
    if clash:
        raise ValueError("columns would be there twice: " + ", ".join(clash))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    measured = docs.select(
        F.struct(*[docs[c] for c in keep]).alias("row"), (F.octet_length(text) + 1).cast("long").alias("bytes"),
        F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        (words(text) if tokens is None else tokens.cast("long")).alias("tokens"),
    )
    rows = materialize(measured, "packing-rows")
    groups = rows.groupBy("digest").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    files = _files(rows.count())
    groups = materialize(groups.coalesce(files), "packing-groups")
    total = _sums(groups)
    capacity = np.maximum(total / shards, 1e-9)
    residual = np.tile(capacity, (shards, 1))

    def above(part: float) -> Column:
        over = [F.col(d) > F.lit(float(c * part)) for d, c in zip(DIMENSIONS, capacity)]
        return over[0] | over[1] | over[2]

    # At most 3 * shards * LARGE rows: no more groups can hold that part of a capacity.
    large = [(bytes(r["digest"]), np.array([r[d] for d in DIMENSIONS], float), r["rows"]) for r in groups.where(above(1 / LARGE)).collect()]
    shares = np.ones_like(residual)
    pieces = place_large([(digest, demand / capacity, n) for digest, demand, n in large], shares)
    residual = shares * capacity
    remaining = np.maximum(total - sum((d for _, d, _ in large), np.zeros(3)), 1e-9)
    rest = groups.where(~above(1 / LARGE))
    count = rest.count()
    cells = max(1, -(-count // CELL))
    placed = None
    middle, last = above(1 / SPREAD / cells), F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(LAST)) == 0
    for level, n in ((middle, cells), (~middle & ~last, cells), (~middle & last, -(-cells // LAST))):
        found = _cells(rest.where(level), n, capacity, residual, remaining)
        found = materialize(found, "packing-cells")
        placed = found if placed is None else placed.unionByName(found)
        for r in found.groupBy("shard").agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).collect():  # one row per shard
            residual[r["shard"]] -= [r[d] for d in DIMENSIONS]
            remaining = np.maximum(remaining - [r[d] for d in DIMENSIONS], 1e-9)
    spark = docs.sparkSession
    named = [(d, p[0][0] if len(p) == 1 else -1) for d, p in pieces.items()]
    big = F.broadcast(spark.createDataFrame(named, "digest binary, shard int"))
    whole = rows.join(big.where("shard >= 0"), "digest").select(*rows.columns, "shard")
    small = rows.join(big.select("digest"), "digest", "left_anti").join(placed.select("digest", "shard"), "digest")
    out = whole.unionByName(small.select(*rows.columns, "shard"))
    if any(len(p) > 1 for p in pieces.values()):
        out = out.unionByName(_split_rows(rows, {d: p for d, p in pieces.items() if len(p) > 1}))
    return _slots(out.select("row", "bytes", "crc", "shard").coalesce(files)).select(
        *[F.col("row")[c].alias(c) for c in keep], F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), "shard", "slot"
    )
