"""Operator 6: language-model scores by Katz backoff over words.

Bigram counts are discounted by Good-Turing estimates; what they leave goes to the unigrams a history was not seen with,
by a weight that makes the probabilities after each history sum to 1 exactly:

    P(w | h) = d(c) * c(h, w) / c(h)            if c(h, w) > 0
             = a(h) * P(w)                      if only the history is known
             = P(w)                             if the history is unknown
    a(h)     = (1 - sum of the first line) / (1 - sum of P(w) over the same words)
    P(w)     = d(c) * c(w) / N, and what is left for unknown words, as one event.

Nothing is a row per token. Documents are kept in chunks, and all that moves are packed arrays: a chunk asks the
partition of each of its words for the word's number and count, then the partition of each of its bigrams for the
bigram's count and, where that is 0, for the history's weight. Answers come in the order of the questions. The
model is a table with one part per partition: unigram answers, bigram counts, weights. A history with very many
followers is spread over partitions by its followers; its few sums are added up on the driver.

Words are compared by 64-bit hashes. Parameters: counts above ``TRUSTED`` lose only ``SLIVER`` of a count, so that
every history leaves some mass.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import fold, runs, texts_of
from keyspan.llm.words import differences, mix, pack, small, unpack, word_hashes
from keyspan.session import delete_path, materialize, work_path

FOLDS = 10
TRUSTED, SLIVER = 5, 0.01
#: Characters of a chunk. A chunk is worked on at once, so this bounds a task's memory.
CHUNK_CHARS = 6_000_000
END = np.uint64(0x9E6C63D0676A9A99)  # stands for the end of a text; as unlikely to be a word's hash as any number
ROW = "chunk long, kind int, part int, data binary"
STREAM, WORDS_ASKED, WORDS_TOLD, WORD_SUMS, BIGRAMS_TOLD, MODEL, BIGRAM_SUMS, WEIGHTS_TOLD = range(8)


def _row(chunk: int, kind: int, part: int, *arrays: np.ndarray) -> tuple[int, int, int, bytes]:
    return chunk, kind, part, pack(*arrays)


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["chunk", "kind", "part", "data"])


# -- discounts ------------------------------------------------------------------------------------------------


def discounts(times: np.ndarray) -> np.ndarray:
    """d(r) for r = 0..TRUSTED, and at TRUSTED + 1 nothing: ``times[r]`` is how many n-grams were seen r times.

    Katz's discounts d = (r* / r - A) / (1 - A) with r* = (r + 1) n(r + 1) / n(r) and A = (k + 1) n(k + 1) / n(1), for
    the largest k up to TRUSTED that gives values inside 0..1. If none does (small or odd corpora), absolute
    discounting by n1 / (n1 + 2 n2) of a count, kept within 0.1 and 0.9.
    """
    out = np.array([(max(r, 1) - SLIVER) / max(r, 1) for r in range(TRUSTED + 1)])
    n = times.astype(float)
    for k in range(TRUSTED, 0, -1):
        if (n[1 : k + 2] <= 0).any():
            continue
        r = np.arange(1, k + 1)
        a = (k + 1) * n[k + 1] / n[1]
        d = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if a < 1 else np.zeros(k)
        if (d > 0).all() and (d < 1).all():
            out[1 : k + 1] = d
            return out
    d = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]) if n[1] else 0.1))
    out[1:] = (np.arange(1, TRUSTED + 1) - d) / np.arange(1, TRUSTED + 1)
    return out


def kept(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    counts = counts.astype(np.int64)
    return np.where(counts <= TRUSTED, d[np.minimum(counts, TRUSTED)] * counts, counts - SLIVER)


def _times(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts.astype(np.int64), TRUSTED + 2), minlength=TRUSTED + 3)[: TRUSTED + 3]


class Unigrams:
    """Sums over all training tokens, and probabilities from counts."""

    def __init__(self, total: int, distinct: int, times: np.ndarray):
        self.total, self.distinct, self.d = total, distinct, discounts(times)
        seen = (np.arange(1, TRUSTED + 1) * self.d[1:] * times[1 : TRUSTED + 1]).sum()
        above = total - (np.arange(1, TRUSTED + 1) * times[1 : TRUSTED + 1]).sum()
        seen += above - SLIVER * (distinct - times[1 : TRUSTED + 1].sum())
        self.unknown = (total - seen) / total if total else 1.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, kept(counts, self.d) / max(1, self.total), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


# -- chunks ---------------------------------------------------------------------------------------------------


def _chunked(docs: DataFrame, parts: int) -> DataFrame:
    """Chunks of documents as packed streams of word numbers, and the questions about their words."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in runs(batch, chars=CHUNK_CHARS):
                hashes, count = word_hashes(texts)
                at = np.cumsum(count)
                tokens = np.insert(hashes, at, END)
                length = count + 1
                train = np.repeat(part.column("train").to_numpy(zero_copy_only=False), length)
                words, local = np.unique(tokens, return_inverse=True)
                seen = np.bincount(local[train], minlength=len(words))
                owner = ((words >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                ids = part.column("doc_id")
                valid = ids.is_valid().to_numpy(zero_copy_only=False)
                rows = [
                    _row(
                        number, STREAM, -1, ids.fill_null(0).to_numpy(zero_copy_only=False), valid,
                        part.column("train").to_numpy(zero_copy_only=False), small(length), small(local), np.array([len(words)]),
                    )
                ]
                cuts = np.searchsorted(owner, np.arange(parts + 1, dtype=np.uint64))
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    a, b = cuts[p], cuts[p + 1]
                    rows.append(_row(number, WORDS_ASKED, p, differences(words[a:b]), small(seen[a:b])))
                yield _batch(rows)
                number += 1

    return docs.mapInArrow(work, ROW)


def _answer_words(table: pa.Table, parts: int) -> pa.Table:
    """Numbers (frequent words first) and counts of one partition's words, for each chunk that asks."""
    part = table.column("part")[0].as_py()
    chunks = table.column("chunk").to_pylist()
    asked = [unpack(x) for x in table.column("data").to_pylist()]
    hashes = [np.cumsum(a, dtype=np.uint64) for a, _ in asked]
    words, place = np.unique(np.concatenate(hashes), return_inverse=True)
    count = np.bincount(place, weights=np.concatenate([c for _, c in asked]).astype(float), minlength=len(words)).astype(np.int64)
    order = np.lexsort((words, -count))
    number = np.empty(len(words), np.int64)
    number[order] = np.arange(len(words)) * parts + part + 1  # 0 is the start of a text, or an unknown word
    number[count == 0] = 0
    if len(words) and int(number.max()) >= 2**32:
        raise ValueError("more than 2**32 different words")
    rows, at = [], 0
    for chunk, own in zip(chunks, hashes):
        slot = place[at : at + len(own)]
        at += len(own)
        rows.append(_row(chunk, WORDS_TOLD, part, number[slot].astype(np.uint32), small(count[slot])))
    end = int(count[words == END].sum())
    rows.append(_row(-1, WORD_SUMS, part, np.append(_times(count[count > 0]), [count.sum(), (count > 0).sum(), end])))
    return pa.Table.from_batches([_batch(rows)])


class Chunk:
    """A chunk with its words' numbers and counts, and its different bigrams in the order of partition and key."""

    def __init__(self, stream: list[np.ndarray], told: list[tuple[int, list[np.ndarray]]], total: int, texts: int, parts: int):
        self.doc_id, self.valid, self.train, length, local, _ = stream
        self.length = length.astype(np.int64)
        told = sorted(told, key=lambda x: x[0])
        number = np.concatenate([a for _, (a, _) in told]).astype(np.uint64)
        count = np.concatenate([c for _, (_, c) in told]).astype(np.int64)
        self.number, self.count = number[local], count[local]
        start = np.cumsum(self.length) - self.length
        self.history = np.append(0, self.number[:-1]).astype(np.uint64)
        self.history_count = np.append(0, self.count[:-1])
        self.history[start], self.history_count[start] = 0, texts
        # Bigrams with a known history; a history that is the start of a text has number 0 and a count.
        self.asked = np.flatnonzero(self.history_count > 0)
        key = (self.history[self.asked] << np.uint64(32)) | self.number[self.asked]
        keys, first, place = np.unique(key, return_index=True, return_inverse=True)
        h_count = self.history_count[self.asked][first]
        # Histories above this count are spread over partitions by their followers.
        spread = 1 + (h_count * 2 * parts // max(1, total)).astype(np.uint64)
        salt = mix(keys & np.uint64(0xFFFFFFFF)) % spread
        part = (mix((keys >> np.uint64(32)) + (salt << np.uint64(40))) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((keys, part))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.keys, self.part, self.place = keys[order], part[order], back[place]
        self.heavy = (spread > 1)[order]
        self.word_count = self.count[self.asked][first][order]
        self.cuts = np.searchsorted(self.part, np.arange(parts + 1))

    def slices(self) -> Iterator[tuple[int, slice]]:
        for p in np.flatnonzero(np.diff(self.cuts)).tolist():
            yield p, slice(self.cuts[p], self.cuts[p + 1])


def _needed(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Histories whose weight is needed: those of bigrams without a count."""
    return np.unique(keys[counts == 0] >> np.uint64(32))


def _ask_bigrams(chunk: int, own: Chunk) -> list[tuple[int, int, int, bytes]]:
    times = np.bincount(own.place[np.repeat(own.train, own.length)[own.asked]], minlength=len(own.keys))
    rows = []
    for p, s in own.slices():
        heavy = np.unique(own.keys[s][own.heavy[s]] >> np.uint64(32))
        rows.append(_row(chunk, BIGRAMS_TOLD, p, differences(own.keys[s]), small(times[s]), small(own.word_count[s]), heavy))
    return rows


def _answer_bigrams(table: pa.Table) -> pa.Table:
    """Counts of one partition's bigrams for each chunk; the partition's part of the model; its sums."""
    part = table.column("part")[0].as_py()
    chunks = table.column("chunk").to_pylist()
    asked = [unpack(x) for x in table.column("data").to_pylist()]
    slices = [np.cumsum(a[0], dtype=np.uint64) for a in asked]
    keys, first, place = np.unique(np.concatenate(slices), return_index=True, return_inverse=True)
    count = np.bincount(place, weights=np.concatenate([a[1] for a in asked]).astype(float), minlength=len(keys)).astype(np.int64)
    word_count = np.concatenate([a[2] for a in asked]).astype(np.int64)[first]
    rows, at, needed = [], 0, []
    for chunk, own in zip(chunks, slices):
        got = count[place[at : at + len(own)]]
        at += len(own)
        rows.append(_row(chunk, BIGRAMS_TOLD, part, small(got)))
        needed.append(_needed(own, got))
    seen = count > 0
    keys, count, word_count = keys[seen], count[seen], word_count[seen]
    heavy = np.unique(np.concatenate([a[3] for a in asked]))
    rows.append(
        _row(
            -1, MODEL, part, differences(keys), small(count), small(word_count), heavy, np.array(chunks, np.int64),
            np.array([len(x) for x in needed], np.int64), np.concatenate([differences(x) for x in needed]),
        )
    )
    rows.append(_row(-1, BIGRAM_SUMS, part, _times(count)))
    return pa.Table.from_batches([_batch(rows)])


def _sums(keys: np.ndarray, count: np.ndarray, word_count: np.ndarray, unigrams: Unigrams, d: np.ndarray):
    """(histories, c(h), discounted mass of their bigrams times c(h), sum of the unigram probabilities of their words)."""
    history, first = np.unique(keys >> np.uint64(32), return_index=True)
    if not len(history):
        return history, np.empty(0), np.empty(0), np.empty(0)
    values = (count.astype(float), kept(count, d), unigrams.probability(word_count))
    return history, *(np.add.reduceat(v, first) for v in values)


def _model_part(data: bytes):
    keys, count, word_count, heavy, chunks, sizes, needed = unpack(data)
    return np.cumsum(keys, dtype=np.uint64), count.astype(np.int64), word_count.astype(np.int64), heavy, chunks, sizes, needed


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    The model learns from documents outside fold 0 of crc32(doc_id as text) modulo 10. Tokens are words (A-Z in lower
    case) and one end; ``n_known`` counts those with a count, ``train_tokens`` all training tokens. ``base_score`` is the
    sum of add-0.1 unigram log10 probabilities, ``score`` that of the model.

    Null texts count as empty and have one token, the end. A null id is held out. Repeated rows all count. Without
    training rows every token is unknown and has probability 1. An empty table gives no rows; other columns are
    not read. A partition holds the different words and bigrams of all chunks divided by the number of shuffle partitions.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts_of(docs, id_col, text_col).withColumn("train", fold(F.col("doc_id"), FOLDS) != 0)
    # Bucketed by chunk, so that both passes that join answers to the chunks leave them where they are.
    name, path = f"katz_{uuid.uuid4().hex}", work_path(spark, "katz-chunks")
    writer = _chunked(rows, parts).write.format("parquet").option("path", path)
    writer.partitionBy("kind").bucketBy(parts, "chunk").saveAsTable(name)
    try:
        chunks = spark.table(name)
        streams = chunks.where(F.col("kind") == STREAM).select("chunk", "data")
        asked = chunks.where(F.col("kind") == WORDS_ASKED).select("chunk", "kind", "part", "data")
        words = materialize(asked.groupBy("part").applyInArrow(lambda t: _answer_words(t, parts), ROW), "katz-words")
        sums = [unpack(r[0])[0] for r in words.where(F.col("kind") == WORD_SUMS).select("data").collect()]
        total = np.sum(sums, axis=0).astype(np.int64) if sums else np.zeros(TRUSTED + 6, np.int64)
        unigrams = Unigrams(int(total[-3]), int(total[-2]), total[: TRUSTED + 3])
        texts, tokens = int(total[-1]), unigrams.total
        told = words.where(F.col("kind") == WORDS_TOLD)

        def opened(left: pa.Table, right: pa.Table) -> tuple[int, Chunk, list[dict]]:
            stream = unpack(left.column("data")[0].as_py())
            answers = right.to_pylist()
            told_words = [(r["part"], unpack(r["data"])) for r in answers if r["kind"] == WORDS_TOLD]
            return left.column("chunk")[0].as_py(), Chunk(stream, told_words, tokens, texts, parts), answers

        def ask(left: pa.Table, right: pa.Table) -> pa.Table:
            chunk, own, _ = opened(left, right)
            return pa.Table.from_batches([_batch(_ask_bigrams(chunk, own))])

        questions = streams.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(ask, ROW)
        bigrams = materialize(questions.groupBy("part").applyInArrow(_answer_bigrams, ROW), "katz-bigrams")
        counted = [unpack(r[0])[0] for r in bigrams.where(F.col("kind") == BIGRAM_SUMS).select("data").collect()]
        d = discounts(np.sum(counted, axis=0) if counted else np.zeros(TRUSTED + 3))
        model = bigrams.where(F.col("kind") == MODEL).select("part", "data")

        def heavy_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    keys, count, word_count, heavy, *_ = _model_part(data)
                    mine = np.isin(keys >> np.uint64(32), heavy)
                    h, *values = _sums(keys[mine], count[mine], word_count[mine], unigrams, d)
                    yield pa.RecordBatch.from_pydict({"h": h.astype(np.int64), "c": values[0], "m": values[1], "p": values[2]})

        # At most 2 * parts histories can have the share of all tokens that makes them spread.
        spread = model.mapInArrow(heavy_sums, "h long, c double, m double, p double").groupBy("h")
        heavy = {r[0]: (r[1], r[2], r[3]) for r in spread.agg(F.sum("c"), F.sum("m"), F.sum("p")).collect()}

        def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist()):
                    keys, count, word_count, _, asking, sizes, needed = _model_part(data)
                    history, c, m, p = _sums(keys, count, word_count, unigrams, d)
                    for i, h in enumerate(history.tolist()):
                        if heavy and h in heavy:
                            c[i], m[i], p[i] = heavy[h]
                    weight = (1 - m / np.maximum(c, 1)) / (1 - p)
                    out, at = [], 0
                    for chunk, n in zip(asking.tolist(), sizes.tolist()):
                        want = np.cumsum(needed[at : at + n], dtype=np.uint64)
                        at += n
                        out.append(_row(chunk, WEIGHTS_TOLD, part, _weights(want, history, weight, heavy)))
                    yield _batch(out)

        weights = model.mapInArrow(weigh, ROW)
        answers = told.unionByName(bigrams.where(F.col("kind") == BIGRAMS_TOLD)).unionByName(weights)

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            _, own, told_rows = opened(left, right)
            got = {
                kind: {r["part"]: unpack(r["data"])[0] for r in told_rows if r["kind"] == kind}
                for kind in (BIGRAMS_TOLD, WEIGHTS_TOLD)
            }
            count, weight = np.zeros(len(own.keys), np.int64), np.ones(len(own.keys))
            for p, s in own.slices():
                count[s] = got[BIGRAMS_TOLD][p]
                missing = np.flatnonzero(count[s] == 0)
                history = own.keys[s][missing] >> np.uint64(32)
                weight[s.start + missing] = got[WEIGHTS_TOLD][p][np.searchsorted(np.unique(history), history)]
            unigram = unigrams.probability(own.count)
            value = np.log10(unigram)
            c = count[own.place]
            here = np.where(
                c > 0, kept(np.maximum(c, 1), d) / own.history_count[own.asked], weight[own.place] * unigram[own.asked]
            )
            value[own.asked] = np.log10(here)
            start = np.cumsum(own.length) - own.length
            columns = {
                "doc_id": pa.array(own.doc_id, pa.int64(), mask=~own.valid), "held_out": ~own.train, "n_tokens": own.length,
                "n_known": np.add.reduceat((own.count > 0).astype(np.int64), start), "train_tokens": np.full(len(start), tokens),
                "base_score": np.add.reduceat(unigrams.base(own.count), start), "score": np.add.reduceat(value, start),
            }
            return pa.table(columns)

        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return materialize(streams.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema), "katz-scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(spark, path)


def _weights(want: np.ndarray, history: np.ndarray, weight: np.ndarray, heavy: dict) -> np.ndarray:
    """Weights of the wanted histories. One that is not in this part is a spread one: its other followers are elsewhere."""
    slot = np.searchsorted(history, want)
    out = np.ones(len(want))
    inside = np.flatnonzero(slot < len(history))
    hit = inside[history[slot[inside]] == want[inside]]
    out[hit] = weight[slot[hit]]
    missing = np.ones(len(want), bool)
    missing[hit] = False
    for i in np.flatnonzero(missing).tolist():
        c, m, p = heavy[int(want[i])]
        out[i] = (1 - m / c) / (1 - p)
    return out
