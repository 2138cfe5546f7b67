"""Operator 2: benchmark passages inside documents, by the q-gram lemma and banded alignment.

A passage of n characters that occurs with at most e edits shares at least n - q + 1 - q * e of its q-grams with the
place where it occurs, and all of them lie within e neighbouring diagonals (place in the document minus place in the
passage). So documents are scanned for q-grams of the benchmark; stretches in which too few occur for any passage
are left at once; in the others, shared q-grams are counted per passage in overlapping bands of diagonals, and the
bands that reach the bound are verified by an edit distance that is computed inside the band only.

Equal passages of many items (a template) are searched once. Case and the kind and amount of white space do not count. An item is searched in passages of ``PASSAGE`` and of
``LONG`` characters that overlap by half; a shorter item is one passage. A verbatim excerpt of 1.5 * PASSAGE - 1 = 80
characters (13 words) or more holds a whole short passage wherever it begins; the long ones bear edits that lie close
together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import keep_rows, runs, texts_of
from keyspan.session import materialize

Q = 10
#: Edits allowed per character of a passage.
RATE = 0.08
PASSAGE, LONG = 54, 160
#: Items with fewer characters are no evidence of anything and are not searched.
LEAST = 20
#: Characters of benchmark text that are sent to the executors at once. A larger benchmark is searched in blocks.
BLOCK_CHARS = 8_000_000
#: Characters of documents that are worked on at once, and shared q-grams that are counted at once.
RUN, HITS = 1_000_000, 2_000_000
BITS = 22
_FOLD: list[np.ndarray] = []


def folded(points: np.ndarray) -> np.ndarray:
    """Code points in lower case, white space as blanks."""
    if not _FOLD:
        table = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            low = chr(i).lower()
            table[i] = 32 if chr(i).isspace() else ord(low) if len(low) == 1 else i
        _FOLD.append(table)
    return _FOLD[0][points]


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points with runs of blanks once, the place of each in the text)."""
    points = folded(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32))
    blank = points == 32
    keep = ~blank | np.append(True, ~blank[:-1])[: len(blank)]
    return points[keep], np.flatnonzero(keep)


def qgrams(points: np.ndarray) -> np.ndarray:
    """A 64-bit number for the q-gram at each place, by doubling its length."""
    if len(points) < Q:
        return np.empty(0, np.uint64)
    hashed = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    size, parts, at, left = 1, None, 0, Q
    base = np.uint64(0x100000001B3)
    while left:
        if left & 1:
            part = hashed[at : len(points) - Q + 1 + at]
            parts = part if parts is None else parts * pow_of(base, size) + part
            at += size
        left >>= 1
        if left:
            hashed = hashed[:-size] * pow_of(base, size) + hashed[size:]
            size *= 2
    return parts ^ (parts >> np.uint64(31))


def pow_of(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)


class Benchmark:
    """Different passages of some items, the items each belongs to, and the places of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids: list[int | None] = []
        self.points: list[np.ndarray] = []
        self.owners: list[list[int]] = []
        places: dict[bytes, int] = {}
        for item_id, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
            points, _ = normal(text.strip())
            if len(points) < LEAST:
                continue
            self.ids.append(item_id)
            for size in (PASSAGE, LONG) if len(points) > PASSAGE else (PASSAGE,):
                for start in range(0, max(1, len(points) - size // 2), size // 2):
                    whole = start + size < len(points)
                    part = points[start : start + size] if whole else points[max(0, len(points) - size) :]
                    at = places.setdefault(part.tobytes(), len(self.points))
                    if at == len(self.points):
                        self.points.append(part)
                        self.owners.append([])
                    if not self.owners[at] or self.owners[at][-1] != len(self.ids) - 1:
                        self.owners[at].append(len(self.ids) - 1)
        self.size = np.array([len(p) for p in self.points], np.int64)
        # The bound must be at least 1; short passages allow fewer edits.
        self.edits = np.minimum((self.size * RATE).astype(np.int64), (self.size - Q) // Q)
        self.bound = self.size - Q + 1 - Q * self.edits
        grams = [qgrams(p) for p in self.points]
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[_slot(self.grams)] = True

    def find(self, points: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(passage, start, end, edits) of verified occurrences in folded code points; ``doc`` numbers each one's document."""
        if not len(self.size) or len(points) < Q:
            return []
        grams = qgrams(points)
        hit = self.seen[_slot(grams)]
        # Stretches: windows as long as the longest occurrence that hold enough known q-grams for the least bound.
        span = int((self.size + self.edits).max())
        total = np.concatenate([[0], np.cumsum(hit)])
        n = len(grams)
        enough = np.flatnonzero(total[np.minimum(np.arange(n) + span, n)] - total[:n] >= int(self.bound.min()))
        if not len(enough):
            return []
        cover = np.zeros(n + 1, np.int32)
        np.add.at(cover, enough, 1)
        np.add.at(cover, np.minimum(enough + span, n), -1)
        at = np.flatnonzero(hit & (np.cumsum(cover)[:-1] > 0))
        slot = np.searchsorted(self.grams, grams[at])
        real = (slot < len(self.grams)) & (self.grams[np.minimum(slot, len(self.grams) - 1)] == grams[at])
        at, slot = at[real], slot[real]
        passage, band = self._bands(at, slot)
        return self.verify(points, doc, passage, band * (self.edits[passage] + 1) - LONG)

    def _bands(self, at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, band) of the bands of diagonals that reach the bound, from q-grams at places ``at``, in slices.

        Bands are twice as wide as their distance, which is above e: each set of e + 1 diagonals lies within one.
        """
        times = self.count[slot]
        part = np.cumsum(times) // HITS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(at)]
        held, counts, found = np.empty(0, np.int64), np.empty(0, np.int64), []
        for a, b in zip(cuts, cuts[1:]):
            own, spots, n = slot[a:b], at[a:b], times[a:b]
            which = np.repeat(np.arange(len(spots)), n)
            entry = self.first[own][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            passage = self.owner[entry]
            band = (spots[which] - self.place[entry] + LONG) // (self.edits[passage] + 1)
            key = passage * (1 << 40) + band
            new, shared = np.unique(np.concatenate([key, key - 1]), return_counts=True)
            held, where = np.unique(np.concatenate([held, new]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, shared]), len(held)).astype(np.int64)
            # Bands that lie before what comes next are complete.
            passage, band = held >> 40, held & ((1 << 40) - 1)
            done = (band + 3) * (self.edits[passage] + 1) + LONG < at[b] if b < len(at) else np.ones(len(held), bool)
            found.append(held[done & (counts >= self.bound[passage])])
            held, counts = held[~done], counts[~done]
        key = np.concatenate(found) if found else held
        return key >> 40, key & ((1 << 40) - 1)

    def verify(self, points: np.ndarray, doc: np.ndarray, passage: np.ndarray, low: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Banded alignment of many passages at once, each from diagonal ``low``; those within their edits."""
        out = []
        order = np.argsort(self.size[passage], kind="stable")  # passages of one size are aligned together
        passage, low = passage[order], low[order]
        for i in range(0, len(passage), 512):
            out += self._aligned(points, doc, passage[i : i + 512], low[i : i + 512])
        return out

    def _aligned(self, points, doc, passage, low):
        size, edits = self.size[passage], self.edits[passage]
        width = int((4 * edits + 4).max())
        base = low - edits
        text = np.zeros((len(passage), int(size.max())), np.uint32)
        for r, p in enumerate(passage.tolist()):
            text[r, : size[r]] = self.points[p]
        offset = np.arange(width)

        def run(anchor: np.ndarray | None, backward: bool) -> tuple[np.ndarray, np.ndarray]:
            """Least edits and the offset at which the passage ends (backward: starts). ``anchor``: the offset to begin at."""
            cost = np.zeros((len(passage), width), np.int32)
            if anchor is not None:
                cost += np.abs(offset - anchor[:, None]).astype(np.int32)
            done, where = np.full(len(passage), 10**6), np.zeros(len(passage), np.int64)
            for k in range(int(size.max())):
                i = size - 1 - k if backward else np.full(len(passage), k)
                # Forward, offset o of row k is document place base + k + o; backward, the same place seen from the end.
                spot = base[:, None] + i[:, None] + offset
                char = points[np.clip(spot, 0, len(points) - 1)]
                own = text[np.arange(len(passage)), np.maximum(i, 0)][:, None]
                outside = (spot < 0) | (spot >= len(points))
                replace = cost + ((char != own) | outside)
                skip = np.full_like(cost, 10**6)
                if backward:
                    skip[:, 1:] = cost[:, :-1] + 1
                    best = np.minimum(replace, skip)
                    best = (np.minimum.accumulate((best + offset)[:, ::-1], axis=1)[:, ::-1] - offset).astype(np.int32)
                else:
                    skip[:, :-1] = cost[:, 1:] + 1
                    best = np.minimum(replace, skip)
                    best = (np.minimum.accumulate(best - offset, axis=1) + offset).astype(np.int32)
                cost = best
                last = size == k + 1
                if last.any():
                    done[last], where[last] = cost[last].min(axis=1), cost[last].argmin(axis=1)
            return done, where

        least, end = run(None, False)
        good = least <= edits
        if not good.any():
            return []
        _, start = run(end, True)
        out = []
        for r in np.flatnonzero(good).tolist():
            a, b = int(base[r] + start[r]), int(base[r] + size[r] + end[r])
            a, b = max(0, a), min(len(points), b)
            if b > a and doc[a] == doc[b - 1]:
                out.append((int(passage[r]), a, b, int(least[r])))
        return out


def _found(bench: Benchmark, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """(number of the text, passage, start, end, edits) of each passage in each text."""
    parts = [normal(t) for t in texts]
    gap = np.zeros(Q + LONG, np.uint32)  # no passage reaches over it
    points = np.concatenate([x for p, _ in parts for x in (p, gap)])
    sizes = np.array([len(p) for p, _ in parts])
    starts = np.cumsum(sizes + len(gap)) - sizes - len(gap)
    doc = np.repeat(np.arange(len(texts)), sizes + len(gap))
    merged: dict[tuple[int, int], tuple[int, int, int]] = {}
    for passage, a, b, edits in bench.find(points, doc):
        i = int(doc[a])
        place = parts[i][1]
        a, b = a - starts[i], min(b - starts[i], sizes[i])
        if b > a:
            span = (int(place[a]), int(place[b - 1]) + 1, edits)
            old = merged.get((i, passage), span)
            merged[i, passage] = (min(old[0], span[0]), max(old[1], span[1]), min(old[2], edits))
    for (i, passage), (a, b, edits) in merged.items():
        yield i, passage, a, b, edits


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, passages, edits): each document and benchmark item with a passage of it inside.

    ``start`` and ``end`` are code points around all that was found of the item; ``passages`` counts its different
    passages, ``edits`` is the least number of edits of one. Documents without a find have no row.

    Documents are not shuffled, finds are. The benchmark goes to the executors in blocks of about ``BLOCK_CHARS``
    characters, made and released one after the other; each block is a pass over the documents, and the result is the
    same for any number of blocks. Null texts hold
    nothing; null and empty items and those of fewer than ``LEAST`` characters are not searched; items without an id are
    searched and share a row per document; repeated items and documents each give their rows; empty
    tables give no rows; other columns are not read. Texts are scanned whole, very long ones included.
    """
    rows = texts_of(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    items, blocks = _items(benchmark)
    if blocks > 1:
        rows = materialize(rows, "decontamination-rows")  # one number for a row in all passes
    out = None
    for n in range(blocks):
        sent = _sent(items, blocks, n)

        def work(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(sent.value)
            for batch in batches:
                for part, texts in runs(batch, chars=RUN):
                    found = [(i, bench.ids[o], p, a, b, e) for i, p, a, b, e in _found(bench, texts) for o in bench.owners[p]]
                    columns = list(zip(*found)) or [()] * 6
                    at = pa.array(columns[0], pa.int64())
                    yield pa.RecordBatch.from_pydict(
                        {
                            "row": part.column("row").take(at), "doc_id": part.column("doc_id").take(at),
                            "item_id": pa.array(columns[1], pa.int64()),
                            "passage": pa.array([hash_of(bench.points[p]) for p in columns[2]], pa.int64()),
                            "start": pa.array(columns[3], pa.int64()), "end": pa.array(columns[4], pa.int64()),
                            "edits": pa.array(columns[5], pa.int32()),
                        }
                    )

        schema = "row long, doc_id long, item_id long, passage long, start long, end long, edits int"
        part = rows.mapInArrow(work, schema)
        if blocks > 1:  # one block of the benchmark is held at a time
            part = materialize(part, "decontamination-found")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    merged = out.groupBy("row", "doc_id", "item_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.size(F.collect_set("passage")).alias("passages"),
        F.min("edits").alias("edits"),
    )
    return merged.drop("row")


def hash_of(points: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(points.tobytes(), digest_size=8).digest(), "little", signed=True)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no passage of the benchmark. Same rules as ``contaminated``."""
    items, blocks = _items(benchmark)
    for n in range(blocks):
        sent = _sent(items, blocks, n)

        def keep(texts: list[str], sent=sent) -> np.ndarray:
            out = np.ones(len(texts), bool)
            out[[found[0] for found in _found(_opened(sent), texts)]] = False
            return out

        docs = keep_rows(docs, keep, text_col, RUN)
        if blocks > 1:
            docs = materialize(docs, "decontamination-clean")
            sent.destroy()
    return docs


_OPEN: list[tuple[Broadcast, Benchmark]] = []


def _opened(sent: Broadcast) -> Benchmark:
    """The benchmark of a broadcast block, kept while the worker works on it."""
    if not _OPEN or _OPEN[0][0] is not sent:
        _OPEN[:] = [(sent, Benchmark(sent.value))]
    return _OPEN[0][1]


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """Different (item_id, text) with a text, and the number of blocks of about ``BLOCK_CHARS`` characters they make, at least 1."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("text IS NOT NULL").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return items, max(1, -(-chars // BLOCK_CHARS))


def _sent(items: DataFrame, blocks: int, n: int) -> Broadcast:
    """Block ``n`` of the items, sent to the executors."""
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return items.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in items.where(place == n).collect()])
