"""Operator 12: a Merkle manifest of a table that stores every few levels only and recomputes the others.

A leaf is a digest of a row. The leaves of one group (a language) are ordered, and while there are several nodes every
two neighbours become the digest of both; a last one without a neighbour becomes the digest of itself. The roots of
the groups, ordered by group, make the table's root in the same way.

Of a group's levels only 0, STEP, 2 * STEP and so on are written, and the node that remains. A stored node and the
2 ** STEP stored nodes below it span an aligned subtree that is small whatever the table holds. A proof is read off by
making the nodes inside such a subtree again from the stored ones below, keeping each one's siblings, and dropping the
rest; the siblings above come from the subtree of the next stored level.

All of it is DataFrame functions. No task holds more than a subtree: leaves are numbered by ranges of (group, order),
so that a group with a third of the rows is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyspan.session import materialize, path_exists, read_text, work_path, write_text

#: Levels from one stored level to the next: a subtree has at most 2 ** STEP stored nodes at its bottom.
STEP = 8
#: Columns of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What stands above a tree's root.
NOTHING = "CAST(array() AS array<struct<h:string,left:boolean>>)"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value in a leaf: ``-`` for null, else the number of its UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: list[Column]) -> Column:
    return sha(F.concat(*[field(c) for c in columns]))


def _numbered(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``idx``, their place in their group (from 0) by ``order``; nulls come first.

    Rows are dealt by ranges of group and order and written with their place in their part; one count per part and
    group says what earlier parts hold of the same group.
    """
    by = [F.asc_nulls_first(c) for c in (group, *order)]
    at = F.monotonically_increasing_id()
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", at)
    stored = materialize(sorted_rows.withColumn("_part", F.shiftright("_at", 33)), label)
    counted = stored.groupBy("_part", F.col(group).alias("_group")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offsets = offsets.select(F.col("_part").alias("_p"), "_group", (F.col("_before") - F.col("_first")).alias("_shift"))
    same = (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group"))
    return stored.join(offsets, same).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_p", "_group", "_shift")


def _steps(n: Column) -> Column:
    """Levels above ``n`` neighbours up to one node, at most STEP."""
    steps = F.lit(STEP)
    for s in range(STEP - 1, -1, -1):
        steps = F.when(n <= 2**s, s).otherwise(steps)
    return steps


def _counting(n: Column) -> Column:
    """0 .. n - 1 as an array, also for n = 0."""
    return F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), 1, n)


def _paired(level: Column) -> Column:
    """The level above: digests of every two neighbours."""
    half = F.ceil(F.size(level) / 2).cast("int")
    other = lambda i: F.coalesce(F.get(level, i * 2 + 1), F.lit(""))
    return F.transform(F.sequence(F.lit(0), half - 1), lambda i: sha(F.concat(F.get(level, i * 2), other(i))))


def _levels(bottom: Column, steps: Column) -> Column:
    """All levels of a subtree, the bottom first."""
    above = lambda made, _: F.concat(made, F.array(_paired(F.element_at(made, -1))))
    return F.aggregate(_counting(steps), F.array(bottom), above)


def _blocks(nodes: DataFrame, sizes: DataFrame, extra: list[str]) -> DataFrame:
    """(tree, block, members, steps): the aligned subtrees above stored ``nodes`` (tree, idx, h); sizes: (tree, n)."""
    members = F.sort_array(F.collect_list(F.struct("idx", "h", *extra))).alias("members")
    rows = nodes.groupBy("tree", F.shiftright("idx", STEP).alias("block")).agg(members)
    n = sizes.select(F.col("tree").alias("_tree"), F.col("n"))
    return rows.join(n, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree").withColumn("steps", _steps(F.col("n"))).drop("n")


def _above(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """The next stored level: one node for each aligned subtree."""
    bottom = F.transform("members", lambda m: m["h"])
    blocks = _blocks(nodes, sizes, []).withColumn("made", _levels(bottom, F.col("steps")))
    return blocks.select("tree", F.col("block").alias("idx"), F.element_at("made", -1)[0].alias("h"))


def _sibling(made: Column, i: Column, d: Column) -> Column:
    """The sibling at level d of the node over bottom node i (h null: it has none), and whether it stands left."""
    at = F.call_function("shiftright", i, d)
    return F.struct(F.get(F.get(made, d), at.bitwiseXOR(F.lit(1))).alias("h"), (at % 2 == 1).alias("left"))


def _paths(nodes: DataFrame, sizes: DataFrame, upper: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(tree, idx, h, further columns, path): the siblings of each stored node up to the top. ``upper`` (tree, idx, path)
    has those above its subtree."""
    extra = [c for c in nodes.columns if c not in ("tree", "idx", "h")]
    if wanted is not None:
        keys = wanted.select(F.col("tree").alias("_tree"), F.shiftright("idx", STEP).alias("_block")).distinct()
        over = F.col("tree").eqNullSafe(F.col("_tree")) & (F.shiftright("idx", STEP) == F.col("_block"))
        nodes = nodes.join(keys, over, "left_semi")
    blocks = _blocks(nodes, sizes, extra)
    made = _levels(F.transform("members", lambda m: m["h"]), F.col("steps"))

    def paths(levels: Column) -> Column:
        path = lambda i: F.transform(_counting(F.col("steps")), lambda d: _sibling(levels, i, d))
        return F.transform(_counting(F.size("members")), path)

    # As the variable of a lambda, the levels are made once for a subtree; as a column they would be put in for each use.
    blocks = blocks.withColumn("paths", F.transform(F.array(made), paths)[0])
    up = upper.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("path").alias("rest"))
    blocks = blocks.join(up, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_idx"))).drop("_tree", "_idx")
    each = F.explode(F.arrays_zip("members", "paths")).alias("each")
    rows = blocks.select("tree", "rest", each)
    found = rows.select("tree", "each.members.*", F.concat("each.paths", "rest").alias("path"))
    if wanted is None:
        return found
    only = wanted.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"))
    return found.join(only, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("idx") == F.col("_idx")), "left_semi")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings make."""

    def up(h: Column, s: Column) -> Column:
        other = F.coalesce(s["h"], F.lit(""))
        return sha(F.when(s["left"], F.concat(other, h)).otherwise(F.concat(h, other)))

    return F.aggregate(path, leaf, up)


class Manifest:
    """A written manifest: folders ``groups/level=0``, ``groups/level=8``, .. of stored nodes (tree, idx, h), ``sizes=..``
    with each tree's number of nodes there, ``roots``, the tree over them below ``top``, and ``root``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def leaves(self) -> DataFrame:
        return self._read("groups/level=0")

    def roots(self) -> DataFrame:
        """(tree, n, subroot, idx): each group's size, root and place among the roots."""
        return self._read("roots")

    def root(self) -> str | None:
        """The table's root; None for a table without rows."""
        found = self._read("root").first()
        return found["h"] if found else None

    def proofs(self, wanted: DataFrame | None = None) -> DataFrame:
        """(tree, idx, further columns, h, subroot, path): each leaf's siblings from its own level to the table's root.

        ``wanted``: (tree, idx) of the leaves that are asked for; only the subtrees over them are made again. A path's
        element is (h, left): the digest, null where a node had no neighbour, and the side it stands on.
        """
        tops = self._walked("top", None, None).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("idx"), "path")
        found = self.roots().select(F.col("tree").alias("_t"), "subroot")
        paths = self._walked("groups", tops, wanted)
        return paths.join(found, F.col("tree").eqNullSafe(F.col("_t"))).drop("_t")

    def _walked(self, name: str, tops: DataFrame | None, wanted: DataFrame | None) -> DataFrame:
        """The paths of level 0 of the trees below ``name``, made from the top level down. ``tops``: the paths of the trees' roots."""
        levels = int(read_text(self.spark, f"{self.path}/{name}/_levels"))
        asked = [wanted]
        for _ in range(1, levels):
            below = asked[-1]
            asked.append(None if below is None else below.select("tree", F.shiftright("idx", STEP).alias("idx")).distinct())
        done = None
        for k in reversed(range(levels)):
            nodes, sizes = self._read(f"{name}/level={k * STEP}"), self._read(f"{name}/sizes={k * STEP}")
            if k:
                sizes = sizes.where("n > 1")  # others ended below
            ending = sizes.where(F.col("n") <= 2**STEP).select(F.col("tree").alias("_t"))
            if tops is None:
                upper = ending.select(F.col("_t").alias("tree"), F.lit(0).cast("long").alias("idx"), F.expr(NOTHING).alias("path"))
            else:
                upper = tops.join(ending, F.col("tree").eqNullSafe(F.col("_t")), "left_semi")
            if done is not None:
                upper = upper.unionByName(done.select("tree", "idx", "path"))
            done = _paths(nodes, sizes, upper, asked[k])
        return done


def _write_levels(spark: SparkSession, path: str, leaves: DataFrame) -> DataFrame:
    """Write level 0, then every STEP-th level, until each tree has one node; (tree, n, h): each tree's size and root."""
    leaves.write.parquet(f"{path}/level=0")
    k, roots, first = 0, None, None
    while True:
        nodes = spark.read.parquet(f"{path}/level={k * STEP}")
        nodes.groupBy("tree").agg((F.max("idx") + 1).alias("n")).write.parquet(f"{path}/sizes={k * STEP}")
        sizes = spark.read.parquet(f"{path}/sizes={k * STEP}")
        first = sizes if first is None else first
        one = sizes.where("n = 1").select(F.col("tree").alias("_t"))
        single = nodes.join(one, F.col("tree").eqNullSafe(F.col("_t")), "left_semi").select("tree", "h")
        roots = single if roots is None else roots.unionByName(single)
        more = sizes.where("n > 1")
        if more.isEmpty():
            break
        k += 1
        _above(nodes, more).write.parquet(f"{path}/level={k * STEP}")
    write_text(spark, f"{path}/_levels", str(max(1, k)))
    return first.select(F.col("tree").alias("_t"), "n").join(roots, F.col("tree").eqNullSafe(F.col("_t"))).drop("_t")


def build(
    docs: DataFrame, path: str | None = None, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS,
    keep: Callable[[list[Column]], dict[str, Column]] | None = None,
) -> Manifest:
    """Write the manifest of ``docs`` to ``path`` (else the shared work folder); a path that exists is refused.

    Leaves of a group ascend by ``order``, null first, rows with the same by their digests, so the order of the rows in
    the table does not matter and repeated rows are leaves of their own. A null group is a group, the first one. Null and
    empty values differ in a leaf. A table without rows has no root. Columns other than ``fields`` are not read;
    ``keep`` makes further columns of a leaf's row from the fields' columns.
    """
    spark = docs.sparkSession
    path = path or work_path(spark, "merkle")
    if path_exists(spark, path):
        raise ValueError(f"{path} exists")
    columns = [docs[f] for f in fields]
    extra = keep(columns) if keep else {}
    leaves = docs.select(
        docs[group].cast("string").alias("tree"), docs[order].alias("key"), leaf_of(columns).alias("h"),
        *[c.alias(name) for name, c in extra.items()],
    )
    leaves = materialize(leaves, "merkle-leaves")  # texts are read and hashed once, not again for the bounds of ranges
    numbered = _numbered(leaves, "tree", ["key", "h"], "merkle-order")
    roots = _write_levels(spark, f"{path}/groups", numbered)
    named = roots.select(F.lit("").alias("all"), F.col("tree").alias("name"), "n", "h")
    named = _numbered(named, "all", ["name"], "merkle-roots")
    named.select(F.col("name").alias("tree"), "n", F.col("h").alias("subroot"), "idx").write.parquet(f"{path}/roots")
    held = spark.read.parquet(f"{path}/roots")
    top = held.select(F.lit("").alias("tree"), "idx", F.col("subroot").alias("h"), F.col("tree").alias("name"))
    _write_levels(spark, f"{path}/top", top).select("h").write.parquet(f"{path}/root")
    return Manifest(spark, path)


def proof_digest(path: Column) -> Column:
    return sha(F.array_join(F.transform(path, lambda s: s["h"]), ""))


def tampered_proofs(docs: DataFrame, divisor: int = 7) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, by a new manifest.

    Rows for which ``divisor`` divides the CRC-32 of the decimal id are checked as if 1 had been added to their
    n_chars (null stays null), so they fail; rows without an id are not tampered with.
    """

    def changed(columns: list[Column]) -> dict[str, Column]:
        doc_id, source, lang, size, text = columns
        hit = (F.crc32(doc_id.cast("string").cast("binary")) % divisor == 0) & size.isNotNull()
        return {"shown": F.when(hit, leaf_of([doc_id, source, lang, size + 1, text]))}

    manifest = build(docs, keep=changed)
    root = F.lit(manifest.root()).cast("string")
    proofs = manifest.proofs().withColumn("folded_root", folded(F.coalesce("shown", "h"), F.col("path")))
    return proofs.select(
        F.col("key").alias("doc_id"), F.col("h").alias("leaf"), "subroot", root.alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"),
    )
