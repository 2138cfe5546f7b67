"""The k best rows of each of many queries, block by block; runs inside tasks.

Blocks of queries and rows are multiplied as matrices. What lies below a query's k-th best score so far by more than the
rounding error of the product is dropped; the few pairs left are scored one by one in double precision. So a score does
not depend on the block a pair is met in, and equal vectors have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Products held at a time, rows of a block at most where queries are many, pairs scored exactly at a time.
PRODUCTS, ROWS, PAIRS = 1 << 20, 2048, 1 << 13
#: Rows that are read before they meet the queries.
CHUNK = 16_384
#: No pairs.
NOTHING = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class Vectors:
    """Vectors of one side: as given, their lengths, and the form that is multiplied (for cosine unit vectors in single precision)."""

    def __init__(self, column, dims: int, metric: str):
        column = _one(column)
        flat = column.flatten()
        if flat.null_count or len(flat) != len(column) * dims:
            raise ValueError(f"every vector needs {dims} elements, none of them null")
        self.given = flat.to_numpy(zero_copy_only=False).reshape(len(column), dims)
        self.size = np.empty(len(column))
        self.near = np.empty(self.given.shape, "float32" if metric == "cosine" else "float64")
        for at in range(0, len(column), ROWS):
            m = self.given[at : at + ROWS].astype("float64")
            size = np.sqrt((m * m).sum(axis=1))
            if metric == "cosine":
                m = np.divide(m, size[:, None], out=np.zeros_like(m), where=size[:, None] != 0)
            self.near[at : at + ROWS], self.size[at : at + ROWS] = m, size

    def __len__(self) -> int:
        return len(self.given)

    def take(self, rows: np.ndarray) -> Vectors:
        """Some of the vectors."""
        out = object.__new__(Vectors)
        out.given, out.size, out.near = self.given[rows], self.size[rows], self.near[rows]
        return out


def places(ids) -> np.ndarray:
    """The place of each id in ascending order, nulls first."""
    order = pc.sort_indices(_one(ids), null_placement="at_start").to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def without_copies(vectors: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The rows that have fewer than k equal vectors before them: no others can be among the k best of a query."""
    same = np.zeros(len(vectors), np.int64)
    if vectors.size:
        whole = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
        same = np.unique(whole, return_inverse=True)[1].ravel()
    order = np.lexsort((place, same))
    return np.sort(order[_first(same[order], k)])


def _first(groups: np.ndarray, k: int) -> np.ndarray:
    """Which of sorted group numbers are among the first k of their group."""
    if not len(groups):
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.append(starts, len(groups)))) < k


class Nearest:
    """The queries of a task with the k best scores known of each; rows are added part by part.

    ``known`` holds for each query a score that k rows met elsewhere reach (or minus infinity). ``block`` bounds the vectors
    of either side that are multiplied at a time.
    """

    def __init__(self, queries, dims: int, k: int, metric: str, known: np.ndarray | None = None, block: int = 1 << 30):
        self.q, self.dims, self.k, self.metric, self.block = Vectors(queries, dims, metric), dims, k, metric, block
        self.top = np.full((len(self.q), k), -np.inf)
        if known is not None:
            self.top[:] = known[:, None]
        self.least = self.top[:, 0].copy()

    def add(self, rows: Vectors, place: np.ndarray, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score): for each query, or each of those asked, the rows that may be among its k best, at most k; ties by place."""
        asked = np.arange(len(self.q)) if asked is None else asked
        wide = max(1, min(self.block, max(ROWS, PRODUCTS // max(1, len(asked)))))
        high = max(1, min(self.block, PRODUCTS // wide))
        out = [NOTHING]
        with np.errstate(all="ignore"):
            for at in range(0, len(asked), high):
                out.append(self._block(rows, place, asked[at : at + high], wide))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _block(self, rows: Vectors, place: np.ndarray, mine: np.ndarray, wide: int):
        k, found, waiting = self.k, [], 0
        near, size = self.q.near[mine], self.q.size[mine]
        longest = rows.size.max(initial=0.0)
        for at in range(0, len(rows), wide):
            products = near @ rows.near[at : at + wide].T
            if self.metric == "euclidean":
                products = 2 * products - (size * size)[:, None] - (rows.size[at : at + wide] ** 2)[None, :]
            least, slack = self._value(self.least[mine]), self._slack(size, longest)
            opened = np.flatnonzero(np.isneginf(least))
            if len(opened) and products.shape[1] >= k:
                least[opened] = np.partition(products[opened], -k, axis=1)[:, -k] - slack[opened]
            low = np.where(np.isfinite(least), least - slack - 2**-49 * (1 + np.abs(least)), least).astype(products.dtype)
            low = np.nextafter(low, np.array(-np.inf, low.dtype))
            # Written so that what is no number stays: it counts as the highest score.
            hits = np.flatnonzero(~(products < low[:, None]))
            for part in range(0, len(hits), PAIRS):
                of, row = np.divmod(hits[part : part + PAIRS], products.shape[1])
                pairs = self._best(mine[of], row + at, self._score(mine[of], rows, row + at), place)
                if len(pairs[0]):
                    found.append(pairs)
                    waiting += len(pairs[0])
                if waiting > 4 * k * len(mine) + PAIRS:
                    found = [self._best(*[np.concatenate(x) for x in zip(*found)], place, known=True)]
                    waiting = len(found[0][0])
        if not found:
            return NOTHING
        return self._best(*[np.concatenate(x) for x in zip(*found)], place, known=True)

    def _value(self, score: np.ndarray) -> np.ndarray:
        """What the product of a pair with this score would be."""
        if self.metric == "euclidean":
            return np.where(score > 0, 1 - 1 / score, -np.inf)
        return 2 * score - 1

    def _slack(self, size: np.ndarray, longest: float) -> np.ndarray:
        """More than the rounding error of the products of these queries with rows up to a length."""
        if self.metric == "cosine":
            return np.full(len(size), (self.dims + 8) * 2.0**-23)
        if self.metric == "dot_product":
            return (self.dims + 8) * 2.0**-51 * size * longest
        return (self.dims + 8) * 2.0**-50 * (size + longest) ** 2

    def _score(self, of: np.ndarray, rows: Vectors, row: np.ndarray) -> np.ndarray:
        a, b = self.q.given[of].astype("float64"), rows.given[row].astype("float64")
        if self.metric == "euclidean":
            a -= b
            return 1.0 / (1.0 + np.einsum("ij,ij->i", a, a))
        dot = np.einsum("ij,ij->i", a, b)
        if self.metric == "dot_product":
            return (1.0 + dot) / 2.0
        size = self.q.size[of] * rows.size[row]
        return (1.0 + np.divide(dot, size, out=np.zeros_like(dot), where=size != 0)) / 2.0

    def _best(self, of, row, score, place, known: bool = False):
        """The k best of these pairs for each query; unless known before, they raise the least score that is still wanted."""
        rank = np.where(np.isnan(score), np.inf, score)
        keep = rank >= self.least[of]
        of, row, score, rank = of[keep], row[keep], score[keep], rank[keep]
        order = np.lexsort((place[row], -rank, of))
        order = order[_first(of[order], self.k)]
        of, row, score, rank = of[order], row[order], score[order], rank[order]
        if len(of) and not known:
            new = np.append(True, of[1:] != of[:-1])
            starts = np.flatnonzero(new)
            queries = of[starts]
            merged = np.full((len(queries), 2 * self.k), -np.inf)
            merged[:, : self.k] = self.top[queries]
            merged[np.cumsum(new) - 1, self.k + np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))] = rank
            merged.partition(self.k, axis=1)
            self.top[queries], self.least[queries] = merged[:, self.k :], merged[:, self.k]
        return of, row, score


def tables(batches: Iterable[pa.RecordBatch], rows: int = CHUNK) -> Iterator[pa.Table]:
    """Batches put together, or cut, to so many rows."""
    waiting, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            waiting.append(batch.slice(at, rows))
            n += waiting[-1].num_rows
            if n >= rows:
                yield pa.Table.from_batches(waiting)
                waiting, n = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def found_table(query_ids, row_ids, found) -> pa.Table:
    """``found_batches`` as one table, which may be empty."""
    schema = pa.schema([("_qid", query_ids.type), ("_cid", row_ids.type), ("score", pa.float64())])
    return pa.Table.from_batches(found_batches(query_ids, row_ids, found), schema)


def found_batches(query_ids, row_ids, found) -> Iterator[pa.RecordBatch]:
    """Batches (_qid, _cid, score) of what ``Nearest.add`` found."""
    query_ids, row_ids, (of, row, score) = _one(query_ids), _one(row_ids), found
    for at in range(0, len(of), 50_000):
        cut = slice(at, at + 50_000)
        yield pa.RecordBatch.from_arrays(
            [query_ids.take(pa.array(of[cut])), row_ids.take(pa.array(row[cut])), pa.array(score[cut])], names=["_qid", "_cid", "score"]
        )
