"""Operator 1: joins of texts by the Jaccard similarity of their word n-grams, with an LSH forest.

Every text gets one MinHash signature for each tree of the forest. A tree is the sorted list of its signatures: texts
that share a prefix of d values stand next to each other, and the neighbours' common prefixes are the trie. Sorting
is by range, so a prefix shared by very many texts is split over tasks.

p(s) is the chance that two texts of similarity s share a prefix in some tree. Prefixes are shortened, from the full
depth on, until p at the threshold itself reaches the target, whatever the table holds: links that are easy to find
say nothing of those that are not.

Texts that share a prefix of this length in a tree are candidates. Candidates are compared by a byte of each value of
their signatures, and only those that agree often enough to be a link join a component, so that a footer on a million
pages, which makes many candidates and no link, makes no component. All pairs inside a component are compared by their
exact sets of n-grams.

Texts with equal sets of n-grams are one node from the start, so copies cost nothing. A row is told by its number, not
by its id, which may stand on other texts too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import map_runs, texts_of
from keyspan.llm.common import runs as runs_of
from keyspan.llm.graph import _forest, components, few_files
from keyspan.llm.words import mix, word_hashes
from keyspan.session import materialize

WORDS, THRESHOLD = 5, 0.8
#: With 18 trees, prefixes of 4 values reach the target at the threshold: 1 - (1 - 0.8 ** 4) ** 18 = 0.999924.
TREES, DEPTH, SHALLOWEST = 18, 6, 3
#: Chance that a link of the least similarity must have to be found.
TARGET = 0.9999
#: Pairs whose signatures agree in less than this share of their values are not verified. With 108 values, a pair at
#: the threshold stays below it with a chance of about 1e-8.
AGREE = 0.58
#: Nodes of a block; larger components are compared block by block.
BLOCK = 512
RUN = 1_000_000
FILTER_BITS = 1 << 23


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of word n-grams, how many each text has), repeats included.

    Words are runs of anything but ASCII white space, with A-Z in lower case. A text with fewer words than ``words``
    has one n-gram of all of them; a text without words has none.
    """
    word, count = word_hashes(texts)
    first = np.cumsum(count) - count
    n = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    left = np.repeat(np.minimum(count, words), n)
    out = np.zeros(len(at), np.uint64)
    for k in range(words):
        here = at + k
        inside = k < left
        out = out * np.uint64(0x100000001B3) + np.where(inside, word[np.where(inside, here, 0)] if len(word) else 0, np.uint64(0))
    return mix(out), n


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values (texts x TREES * DEPTH) of 32 bits; texts without n-grams get zeros."""
    out = np.zeros((len(counts), TREES * DEPTH), np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        for k, seed in enumerate(_seeds(TREES * DEPTH)):
            out[full, k] = np.minimum.reduceat(((hashes * seed) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def distinct_sets(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(counts)
    return [np.unique(hashes[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]


def node_of(shingle_set: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingle_set.tobytes(), digest_size=8).digest(), "little", signed=True)


def _described(docs: DataFrame) -> DataFrame:
    """(doc_id, row, node, n, sig): the n-gram set's 64-bit digest, its size, and its signature (null without n-grams)."""

    def work(part: pa.RecordBatch, texts: list[str]) -> dict:
        node, size, sig = [], [], []
        for i in range(0, max(1, len(texts)), 1000):
            hashes, counts = shingles(texts[i : i + 1000])
            sets = distinct_sets(hashes, counts)
            values = signatures(hashes, counts).astype(">u4")
            node += [node_of(s) if len(s) else None for s in sets]
            size += [len(s) for s in sets]
            sig += [values[j].tobytes() if len(s) else None for j, s in enumerate(sets)]
        return {
            "doc_id": part.column("doc_id"), "row": part.column("row"), "node": pa.array(node, pa.int64()),
            "n": pa.array(size, pa.int32()), "sig": pa.array(sig, pa.binary()),
        }

    return map_runs(docs, work, "doc_id long, row long, node long, n int, sig binary", RUN)


def _runs(nodes: DataFrame, depth: int) -> DataFrame:
    """(run, node): the nodes that share a prefix of ``depth`` values with another one in some tree. A run is a digest of
    the tree and the prefix."""
    spark = nodes.sparkSession

    def labels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, 4 * DEPTH)
            yield pa.RecordBatch.from_pydict(
                {
                    "tree": np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows),
                    "label": pa.array([x.tobytes() for x in values], pa.binary()),
                    "node": np.repeat(batch.column("node").to_numpy(), TREES),
                }
            )

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a sorted part that a neighbour shares the prefix with. The first and the last of a batch come out
        too, as their neighbours may stand in another one; runs of one are dropped later."""
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u4").reshape(-1, DEPTH)[:, :depth]
            run = batch.column("tree").to_numpy().astype(np.uint64)
            for k in range(depth):
                run = mix(run * np.uint64(0x9E3779B97F4A7C15) + values[:, k].astype(np.uint64))
            same = np.concatenate([[True], run[1:] == run[:-1], [True]])
            keep = same[1:] | same[:-1]
            yield pa.RecordBatch.from_pydict({"run": run[keep].view(np.int64), "node": batch.column("node").to_numpy()[keep]})

    exploded = nodes.select("node", "sig").mapInArrow(labels, "tree int, label binary, node long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = exploded.repartitionByRange(parts, "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    return materialize(ordered.mapInArrow(walk, "run long, node long"), "forest")


def _spread(members: DataFrame, group: str) -> DataFrame:
    """``members`` (group, node, blocks, ..) once for each cell (group, i, j), i <= j, that their block (``mine``) meets another in."""
    mine = F.pmod(F.xxhash64("node"), "blocks")
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    pairs = F.transform(
        every, lambda b: F.struct(F.least(b, mine).cast("int").alias("i"), F.greatest(b, mine).cast("int").alias("j"))
    )
    spread = members.withColumn("mine", mine.cast("int")).withColumn("pair", F.explode(pairs))
    return spread.select(group, "pair.i", "pair.j", *[c for c in spread.columns if c not in (group, "pair", "blocks")])


def _by_cell(rows: DataFrame, group: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, F.xxhash64(group, "i", "j"))
    return dealt.sortWithinPartitions(group, "i", "j", "node")


def _cells(batches: Iterable[pa.RecordBatch], group: str) -> Iterator[tuple[int, int, list[dict]]]:
    """(i, j, rows) of each cell of rows in the order of ``_by_cell``."""
    key, held = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            for row in batch.slice(at, 512).to_pylist():
                own = (row[group], row["i"], row["j"])
                if own != key:
                    if held:
                        yield key[1], key[2], held
                    key, held = own, []
                if not held or held[-1]["node"] != row["node"]:  # a text that is there twice counts in mult
                    held.append(row)
    if held:
        yield key[1], key[2], held


def _sides(held: list[dict], i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the nodes of both blocks, and the pairs to leave out: each is compared once."""
    block = np.array([r["mine"] for r in held])
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    return a, b, ~np.triu(np.ones((len(a), len(b)), bool), 1) if i == j else np.zeros((len(a), len(b)), bool)


def _agreeing(sig_a: np.ndarray, sig_b: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that agree in enough values to be links."""
    agree = np.zeros(skip.shape, np.int16)
    for k in range(sig_a.shape[1]):
        agree += sig_a[:, k][:, None] == sig_b[:, k][None, :]
    return np.nonzero((agree >= AGREE * sig_a.shape[1]) & ~skip)


def _likely_edges(runs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, v): a forest over the candidates that agree in enough values, and whose sizes allow a link."""
    sized = runs.groupBy("run").agg(F.count("*").alias("size")).where("size > 1")
    sized = sized.select("run", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks"))
    members = runs.join(sized, "run").join(nodes.select("node", "n", "sig"), "node")

    def low_bytes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Values that differ agree in their lowest byte in one case of 256, which only lets more pairs pass.
        at = np.arange(3, 4 * TREES * DEPTH, 4)
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, 4 * TREES * DEPTH)[:, at]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["run", "blocks", "node", "n"]).columns, pa.array([x.tobytes() for x in sig], pa.binary())],
                names=["run", "blocks", "node", "n", "sig"],
            )

    members = members.select("run", "blocks", "node", "n", "sig").mapInArrow(
        low_bytes, "run long, blocks long, node long, n int, sig binary"
    )
    rows = _by_cell(_spread(members, "run"), "run")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for i, j, held in _cells(batches, "run"):
            sig = np.frombuffer(b"".join(r["sig"] for r in held), np.uint8).reshape(len(held), -1)
            n, node = np.array([r["n"] for r in held]), np.array([r["node"] for r in held], np.int64)
            a, b, skip = _sides(held, i, j)
            least, most = np.minimum(n[a][:, None], n[b][None, :]), np.maximum(n[a][:, None], n[b][None, :])
            x, y = _agreeing(sig[a], sig[b], skip | (least < threshold * most - 1e-9))
            if len(x):
                out += zip(*(e.tolist() for e in _forest(node[a[x]], node[b[y]])))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_pydict({"u": [u for u, _ in out], "v": [v for _, v in out]})
                out = []
        if out:
            yield pa.RecordBatch.from_pydict({"u": [u for u, _ in out], "v": [v for _, v in out]})

    return materialize(rows.mapInArrow(work, "u long, v long"), "likely")


def _links(sig_a, sets_a, sig_b, sets_b, skip: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of the pairs of two blocks that reach the threshold, without those in ``skip``."""
    i, j = _agreeing(sig_a, sig_b, skip)
    if not len(i):
        return i, j, np.empty(0)
    # Groups of texts that may be alike; their sets are compared as one product of 0/1 matrices.
    label = np.arange(len(sets_a) + len(sets_b))
    u, v = _forest(i, j + len(sets_a))
    label[u] = v
    group = label[i]
    shared = np.zeros(len(i))
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    for pairs in np.split(order, cuts):
        a, inv_a = np.unique(i[pairs], return_inverse=True)
        b, inv_b = np.unique(j[pairs], return_inverse=True)
        if len(pairs) <= 4:
            for p in pairs.tolist():
                shared[p] = len(np.intersect1d(sets_a[i[p]], sets_b[j[p]], assume_unique=True))
            continue
        left = np.concatenate([sets_a[x] for x in a])
        right = np.concatenate([sets_b[x] for x in b])
        names = np.intersect1d(left, right)
        row_a = np.repeat(np.arange(len(a)), [len(sets_a[x]) for x in a])
        row_b = np.repeat(np.arange(len(b)), [len(sets_b[x]) for x in b])
        at_a, at_b = np.searchsorted(names, left), np.searchsorted(names, right)
        in_a, in_b = _hit(names, at_a, left), _hit(names, at_b, right)
        row_a, at_a, row_b, at_b = row_a[in_a], at_a[in_a], row_b[in_b], at_b[in_b]
        product = np.zeros((len(a), len(b)), np.float32)
        for c in range(0, len(names), 2048):
            x, y = np.zeros((len(a), 2048), np.float32), np.zeros((len(b), 2048), np.float32)
            part = (at_a >= c) & (at_a < c + 2048)
            x[row_a[part], at_a[part] - c] = 1
            part = (at_b >= c) & (at_b < c + 2048)
            y[row_b[part], at_b[part] - c] = 1
            product += x @ y.T
        shared[pairs] = product[inv_a, inv_b]
    size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    similarity = shared / (size_a[i] + size_b[j] - shared)
    ok = shared * (1 + threshold) >= threshold * (size_a[i] + size_b[j]) - 1e-9
    return i[ok], j[ok], similarity[ok]


def _hit(names: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    return names[np.minimum(at, len(names) - 1)] == values if len(names) else np.zeros(len(values), bool)


def _verified(docs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Links inside components: rows (kind, a, b).

    ``members`` has node, rep (a document's id), mult, comp, blocks. kind 0: node a has links to b documents more; kind 1:
    a and b are in one class.
    """
    rows = _texts(docs, members.select("rep")).join(_spread(members.drop("rep"), "comp"), "node")
    rows = _by_cell(rows.select("comp", "i", "j", "mine", "node", "mult", "text"), "comp")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for i, j, held in _cells(batches, "comp"):
            hashes, counts = [], []
            for at in range(0, len(held), 500):
                h, c = shingles([r["text"] for r in held[at : at + 500]])
                hashes.append(h)
                counts.append(c)
            hashes, counts = np.concatenate(hashes), np.concatenate(counts)
            sig, sets = signatures(hashes, counts), distinct_sets(hashes, counts)
            node, mult = (np.array([r[x] for r in held], np.int64) for x in ("node", "mult"))
            a, b, skip = _sides(held, i, j)
            x, y, _ = _links(sig[a], [sets[k] for k in a], sig[b], [sets[k] for k in b], skip, threshold)
            x, y = a[x], b[y]
            if not len(x):
                continue
            links = np.bincount(x, weights=mult[y], minlength=len(held)) + np.bincount(y, weights=mult[x], minlength=len(held))
            out += [(0, int(node[k]), int(links[k])) for k in np.flatnonzero(links)]
            out += [(1, int(p), int(q)) for p, q in zip(*_forest(node[x], node[y]))]
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return rows.mapInArrow(work, "kind int, a long, b long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of ``docs`` with most of the rows left out whose id is not wanted, each node once per task.

    An id may stand on other texts than the wanted one, so the node is made from the text again. A bit set of fixed
    size (``FILTER_BITS``, 1 MiB) goes to the executors, whatever the number of ids; if there are so many that it fills
    up, it lets all rows pass and the join after it sorts them out.
    """
    spark = docs.sparkSession
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = wanted.select(F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS)).alias("s"))
    words = words.selectExpr("CAST(s DIV 64 AS INT) AS w", "shiftleft(1L, CAST(s % 64 AS INT)) AS bit")
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for part in words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bits[part["w"]] = part["bits"]
    sent = spark.sparkContext.broadcast(np.packbits(np.unpackbits(bits.view(np.uint8), bitorder="little")).tobytes())

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = np.unpackbits(np.frombuffer(sent.value, np.uint8)).view(bool), set()
        for batch in batches:
            some = batch.filter(pa.array(known[batch.column("slot").to_numpy()]))
            for part, texts in runs_of(some, chars=RUN):
                sets = distinct_sets(*shingles(texts))
                node = [node_of(s) if len(s) else None for s in sets]
                new = [n is not None and n not in seen and not seen.add(n) for n in node]
                yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "text": part.column("text")}).filter(pa.array(new))

    rows = docs.where("doc_id IS NOT NULL").select("text", slot.alias("slot"))
    return rows.mapInArrow(work, "node long, text string")


def _batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    kind, a, b = zip(*rows)
    return pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _recall(depth: int, threshold: float) -> float:
    """The chance that a link at the threshold shares a prefix of ``depth`` values in some tree."""
    return 1 - (1 - threshold**depth) ** TREES


def _depth(threshold: float) -> int:
    """The longest prefix at which a link at the threshold itself is found with the target's chance."""
    for depth in range(DEPTH, SHALLOWEST, -1):
        if _recall(depth, threshold) >= TARGET:
            return depth
    return SHALLOWEST


def _classes(texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, node) of ``texts`` (doc_id, row, text) that have an id, and their nodes: (node, class_id, first,
    n_links). ``first`` is the number of the class's first row, by id and number."""
    described = materialize(_described(texts.where("doc_id IS NOT NULL")), "signatures")
    first = F.min(F.struct("doc_id", "row", "n", "sig")).alias("first")
    nodes = described.where("node IS NOT NULL").groupBy("node").agg(first, F.count("*").alias("mult"))
    nodes = materialize(nodes.select("node", F.col("first.doc_id").alias("rep"), "first.row", "first.n", "first.sig", "mult"), "nodes")
    comps = components(_likely_edges(_runs(nodes, _depth(threshold)), nodes, threshold), "likely-components")
    size = comps.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    members = few_files(comps.join(nodes.select("node", "rep", "mult"), "node").join(size, "comp"), "members")
    links = materialize(_verified(texts, members, threshold), "links")
    classes = components(links.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")), "link-components")
    least = classes.join(nodes.select("node", "rep", "row"), "node").groupBy("comp").agg(F.min(F.struct("rep", "row")).alias("least"))
    counted = links.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    linked = classes.join(least, "comp").join(counted, "node", "left").select("node", "least", "links")
    known = nodes.join(linked, "node", "left").select(
        "node", F.coalesce("least.rep", "rep").alias("class_id"), F.coalesce("least.row", "row").alias("first"),
        (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
    )
    return described.select("doc_id", "row", "node"), known


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links): one row per document.

    Two documents are linked if the Jaccard similarity of their sets of five-word n-grams is ``threshold`` or more
    (n-grams are compared by 64-bit hashes). ``n_links`` counts the other documents linked to this one, copies
    included; ``class_id`` is the least doc_id among those that links connect, directly or through others.

    Texts without a word (null, empty) and rows without an id are linked with nothing; class_id is then doc_id.
    Texts of fewer than five words have one n-gram of all of them. Rows that repeat an id are documents of their own,
    whether their texts are equal or not. An empty table gives no rows; other columns are not read.

    Number of links is exact within the forest's recall: two texts at a similarity of 0.8 miss each other in one case
    of 13,000, at 0.85 in one of 580,000. Thresholds below 0.73 miss the target at the shortest prefix, 3 values.

    Candidates, and then members of a component, meet in blocks of bounded size, so a group of n texts that are alike but
    not equal takes n * n / 2 comparisons inside tasks and n / BLOCK copies of its texts; no pair is ever a row.
    """
    texts = texts_of(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    described, known = _classes(texts, threshold)
    alone = described.where("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    unnamed = texts.where("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    named = described.join(known, "node").select("doc_id", "class_id", "n_links")
    return named.unionByName(alone).unionByName(unnamed)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, one of each class: that with the least id, and of several with this id one.

    Rows without a word or an id are a class each and stay. The table is written once, with the number of each row.
    """
    number = "row"
    while number in docs.columns:
        number += "_"
    stored = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    texts = stored.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col(number).alias("row"),
    )
    described, known = _classes(texts, threshold)
    extra = described.join(known, "node").where(F.col("row") != F.col("first")).select(F.col("row").alias(number))
    return stored.join(extra, number, "left_anti").select(*docs.columns)
