"""Operator 13: ranked lexical search, accumulators of short lists first, then document at a time over long lists.

Documents are indexed in blocks: the terms of a block and, for each, its documents in ascending order with their term
frequencies. A block of queries meets a block of the index in one task. For each query, the posting lists that are
short in this block are summed term at a time into accumulators (document, sum). Sorted by document, these are one
more list, whose bound is the largest sum. It and the long lists are then read document at a time: lists whose bounds
together stay below the score that a document must reach are not read by themselves, only looked up for documents
that the other lists bring, and only while these can still reach it.

Scores are integers, so results are exact. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyspan.llm.common import runs, texts_of
from keyspan.llm.words import differences, pack, small, unpack, word_hashes
from keyspan.session import materialize

TOP = 20
#: A block of the index ends after so many postings, a block of queries after so many different terms (or one row more).
POSTINGS, QUERY_TERMS = 1_000_000, 20_000
#: Characters of texts that are split into terms at once.
RUN = 1_000_000
#: A list is short if it has at most this share of a block's documents.
SHORT = 1 / 16
#: Documents that are read at a time before the score to reach is taken anew.
STRETCH = 2048
#: Bytes that are no part of a term: ASCII but for letters and digits.
_OUTSIDE = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def term_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term in order, number of terms of each text): runs of ASCII letters, digits and all beyond ASCII."""
    return word_hashes(texts, _OUTSIDE)


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, number of the text, frequency) of each different term of each text, and the number of terms of each text."""
    term, count = term_hashes(texts)
    of = np.repeat(np.arange(len(texts)), count)
    order = np.lexsort((term, of))
    term, of = term[order], of[order]
    new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (of[1:] != of[:-1]))) if len(term) else np.empty(0, int)
    return term[new], of[new], np.diff(np.append(new, len(term))), count


def index(docs: DataFrame) -> DataFrame:
    """Blocks (with_terms, n_terms, vocabulary, ids, postings) made in the tasks that read the texts, without a shuffle.

    ``vocabulary`` holds the block's terms and their document counts, ``postings`` the length of each term's list, its
    documents (numbers in the block, ascending) and frequencies, ``ids`` each document's id and number of terms.
    """

    def block(ids: list, sizes: list, parts: list) -> pa.RecordBatch:
        size, names = np.concatenate(sizes), pa.chunked_array(ids)
        term, doc, tf = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.empty(0, int)
        counts = lists = np.diff(np.append(first, len(term)))
        if names.null_count:  # rows without an id count, but cannot be named in a result
            named = names.is_valid().to_numpy()[doc]
            lists = np.add.reduceat(named, first, dtype=np.int64) if len(term) else counts
            doc, tf = doc[named], tf[named]
        return pa.RecordBatch.from_pydict(
            {
                "with_terms": pa.array([int((size > 0).sum())], pa.int64()), "n_terms": pa.array([int(size.sum())], pa.int64()),
                "vocabulary": pa.array([pack(differences(term[first]), small(counts))], pa.binary()),
                "ids": pa.array([pack(names.fill_null(0).to_numpy(), size.astype(np.int64))], pa.binary()),
                "postings": pa.array([pack(small(lists), small(doc), small(tf))], pa.binary()),
            }
        )

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, parts, docs_held, held = [], [], [], 0, 0
        for batch in batches:
            for part, texts in runs(batch, chars=RUN):
                term, of, tf, count = _counted(texts)
                ids.append(part.column("doc_id"))
                sizes.append(count)
                parts.append((term, (of + docs_held).astype(np.uint32), tf.astype(np.uint32)))
                docs_held += len(count)
                held += len(term)
                if held >= POSTINGS:
                    yield block(ids, sizes, parts)
                    ids, sizes, parts, docs_held, held = [], [], [], 0, 0
        if docs_held:
            yield block(ids, sizes, parts)

    return docs.mapInArrow(work, "with_terms long, n_terms long, vocabulary binary, ids binary, postings binary")


def query_blocks(items: DataFrame) -> DataFrame:
    """Blocks of queries (block, item_ids, terms, lists): the different terms of a block in order, and for each query the
    places of its terms among them and their frequencies."""

    def block(number: int, ids: list, parts: list) -> pa.RecordBatch:
        terms, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sizes = np.array([len(p[0]) for p in parts], np.int64)
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([number], pa.int64()), "item_ids": pa.array([ids], pa.list_(pa.int64())),
                "terms": pa.array([terms.view(np.int64)], pa.list_(pa.int64())),
                "lists": pa.array([pack(sizes, place.astype(np.int32), np.concatenate([p[1] for p in parts]))], pa.binary()),
            }
        )

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, parts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for part, texts in runs(batch, chars=RUN):
                term, of, tf, _ = _counted(texts)
                cuts = np.searchsorted(of, np.arange(len(texts) + 1))
                for i, item_id in enumerate(part.column("doc_id").to_pylist()):
                    a, b = cuts[i], cuts[i + 1]
                    ids.append(item_id)
                    parts.append((term[a:b], tf[a:b].astype(np.int64)))
                    held += b - a
                    if held >= QUERY_TERMS:
                        yield block(number, ids, parts)
                        number, ids, parts, held = number + 1, [], [], 0
        if ids:
            yield block(number, ids, parts)

    return items.mapInArrow(work, "block long, item_ids array<long>, terms array<long>, lists binary")


def _shared(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``known`` (ascending) and in ``wanted`` of the terms that both have."""
    at = np.searchsorted(known, wanted)
    hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == wanted) if len(known) else np.empty(0, int)
    return at[hit], hit


def _document_counts(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """(term, df) of the terms that some query has; each task sums over its blocks first."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                known, counts = unpack(r["vocabulary"])
                known = np.cumsum(known, dtype=np.uint64)
                at, _ = _shared(known, np.array(r["terms"], np.int64).view(np.uint64))
                terms, place = np.unique(np.concatenate([terms, known[at]]), return_inverse=True)
                total = np.bincount(place, np.concatenate([total, counts[at]]), len(terms)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"term": terms.view(np.int64), "df": total})

    # Each term once, in blocks of bounded size, so that no block of the index is counted twice for a term.
    vocabulary = asked.select(F.explode("terms").alias("term")).distinct()
    slots = F.pmod(F.xxhash64("term"), F.ceil(F.lit(vocabulary.count()) / QUERY_TERMS + 1).cast("long"))
    wanted = vocabulary.groupBy(slots.alias("slot")).agg(F.sort_array(F.collect_list("term")).alias("terms"))
    met = blocks.select("vocabulary").crossJoin(materialize(wanted.select("terms"), "search-vocabulary"))
    return met.mapInArrow(work, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _weighted(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """Query blocks with ``dfs``, the document counts of their terms in order (0: in no document)."""
    each = asked.select("block", F.posexplode("terms").alias("at", "term")).join(counts, "term", "left")
    found = each.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("df", F.lit(0)).alias("df")))).alias("dfs"))
    return asked.join(found.select("block", F.transform("dfs", lambda x: x["df"]).alias("dfs")), "block", "left")


class Lists:
    """The posting lists of one block of the index for the terms of one block of queries, with scores instead of frequencies."""

    def __init__(self, row: dict, wanted: np.ndarray, docs: int, total: int):
        known = np.cumsum(unpack(row["vocabulary"])[0], dtype=np.uint64)
        sizes, doc, tf = unpack(row["postings"])
        sizes = sizes.astype(np.int64)
        self.ids, n = unpack(row["ids"])
        self.n = len(n)
        at, term = _shared(known, wanted)
        at, term = at[sizes[at] > 0], term[sizes[at] > 0]
        first = (np.cumsum(sizes) - sizes)[at]
        size = sizes[at]
        self.stop = np.cumsum(size)
        self.start = self.stop - size
        entry = np.arange(int(size.sum())) - np.repeat(self.start, size) + np.repeat(first, size)
        self.doc, tf = doc[entry].astype(np.int64), tf[entry].astype(np.int64)
        m = 100 - 25 + (25 * n * docs) // max(1, total)
        self.part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[self.doc])
        self.most = np.maximum.reduceat(self.part, self.start) if len(size) else np.empty(0, np.int64)
        #: Place among these lists of each asked term, -1 if the block does not have it.
        self.of = np.full(len(wanted), -1)
        self.of[term] = np.arange(len(at))


def accumulated(lists: Lists, which: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time over some lists: (documents, summed scores), by document."""
    held = np.zeros(lists.n, np.int64)
    for i, w in zip(which.tolist(), weight.tolist()):
        at = slice(lists.start[i], lists.stop[i])
        held[lists.doc[at]] += w * lists.part[at]
    docs = np.flatnonzero(held)
    return docs, held[docs]


def best_of_block(lists: Lists, which: np.ndarray, weight: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best of one query's terms, with all ties of the last, that score ``least`` or more.

    ``which`` and ``weight`` are the query's lists and the weights of their terms, repeats of a term multiplied in.
    """
    size = lists.stop[which] - lists.start[which]
    short = size <= max(1, lists.n * SHORT)
    acc_doc, acc_score = accumulated(lists, which[short], weight[short])
    if len(acc_score) >= k:
        least = max(least, int(np.partition(acc_score, len(acc_score) - k)[len(acc_score) - k]))
    # All lists as (documents, scores, bound), the accumulators among them, by ascending bound.
    readers = [(acc_doc, acc_score, int(acc_score.max(initial=0)))]
    for i, w in zip(which[~short].tolist(), weight[~short].tolist()):
        at = slice(lists.start[i], lists.stop[i])
        readers.append((lists.doc[at], w * lists.part[at], w * int(lists.most[i])))
    readers.sort(key=lambda r: r[2])
    reach = np.cumsum([r[2] for r in readers])
    found_doc, found_score = np.empty(0, np.int64), np.empty(0, np.int64)
    for low in range(0, lists.n, STRETCH):
        # Lists below ``lead`` cannot bring a document to the score by themselves.
        lead = int(np.searchsorted(reach, least))
        if lead == len(readers):
            break
        held = np.zeros(min(STRETCH, lists.n - low), np.int64)
        for doc, score, _ in readers[lead:]:
            a, b = np.searchsorted(doc, (low, low + STRETCH))
            held[doc[a:b] - low] += score[a:b]
        rest = int(reach[lead - 1]) if lead else 0
        docs = np.flatnonzero((held > 0) & (held >= least - rest))
        score = held[docs]
        docs = docs + low
        for i in range(lead - 1, -1, -1):
            if not len(docs):
                break
            doc, own, _ = readers[i]
            at = np.searchsorted(doc, docs)
            at[at == len(doc)] = 0
            score = score + np.where(doc[at] == docs, own[at], 0) if len(doc) else score
            keep = score >= least - (int(reach[i - 1]) if i else 0)
            docs, score = docs[keep], score[keep]
        keep = score >= least
        found_doc, found_score = np.append(found_doc, docs[keep]), np.append(found_score, score[keep])
        if len(found_score) >= k:
            least = max(least, int(np.partition(found_score, len(found_score) - k)[len(found_score) - k]))
            keep = found_score >= least
            found_doc, found_score = found_doc[keep], found_score[keep]
    return found_doc, found_score


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``k`` documents with the highest scores above 0, fewer if there are
    no more; ties go to the smaller doc_id.

    A term's weight is floor(1000 * ln((2N + 2) / (2 df + 1))) and its score in a document of n terms
    weight * (10**9 tf div (1000 tf + 12 m)), m = 75 + 25 n N div L, for each time it stands in the item.

    Null and empty texts have no terms and no results, and do not count in N. Documents without an id are never results but
    count in N, L and df. Documents and items that repeat are documents and items of their own. Empty tables give no
    rows; other columns are not read. Texts are indexed whole, a very long one alone in its block.

    The query set meets the index block by block; a task keeps k rows (and ties) per query and block, and the scores
    that later blocks of the same task must reach.
    """
    blocks = materialize(index(texts_of(docs, id_col, text_col)), "search-index")
    sums = blocks.agg(F.sum("with_terms").alias("n"), F.sum("n_terms").alias("l")).first()
    n, total = sums["n"] or 0, sums["l"] or 0
    asked = materialize(query_blocks(texts_of(items, item_col, text_col)), "search-queries")
    asked = materialize(_weighted(asked, _document_counts(blocks, asked)), "search-weights")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, query = -1, None
        reached: dict[tuple[int, int], int] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["block"] != block:
                    block, reached = r["block"], {}
                    wanted = np.array(r["terms"], np.int64).view(np.uint64)
                    weight = weights(np.array(r["dfs"] or [], np.int64), n)
                    sizes, place, times = unpack(r["lists"])
                    query = np.split(place, np.cumsum(sizes)[:-1]), np.split(times, np.cumsum(sizes)[:-1])
                lists = Lists(r, wanted, n, total)
                out = []
                for q, (place, times) in enumerate(zip(*query)):
                    which, w = lists.of[place], weight[place] * times
                    some = (which >= 0) & (w > 0)
                    if not some.any():
                        continue
                    doc, score = best_of_block(lists, which[some], w[some], k, reached.get(q, 1))
                    order = np.lexsort((lists.ids[doc], -score))[:k]
                    doc, score = doc[order], score[order]
                    if len(score) == k:
                        reached[q] = max(reached.get(q, 1), int(score[-1]))
                    out.append((np.full(len(doc), q), lists.ids[doc], score))
                if out:
                    of, ids, score = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": np.full(len(of), block), "place": of.astype(np.int32),
                            "item_id": pa.array(r["item_ids"], pa.int64()).take(pa.array(of)), "doc_id": ids, "score": score,
                        }
                    )

    met = blocks.select("vocabulary", "ids", "postings").crossJoin(asked)
    found = met.mapInArrow(work, "block long, place int, item_id long, doc_id long, score long")
    best = Window.partitionBy("block", "place").orderBy(F.desc("score"), F.asc("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
