"""Operator 7: the language of a text from bit-sliced n-gram filters.

Each language has a Bloom filter of its frequent character n-grams. The filters share one array: slot j holds a bit
mask of the languages whose filter has bit j set, so that the AND of an n-gram's slots gives at once every language
that contains it. A text's votes are population counts per language over all its n-grams, corrected for the share
that the filter would let through by chance; the language with the most corrected votes wins.

An n-gram is in a language if its share of the language's n-grams is at least ``SHARE``. A filter therefore has at
most 1 / SHARE members per length however large the corpus is, and a language does not fill up with chance finds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import fold, map_runs, texts_of
from keyspan.operators.views import per_partition_limit
from keyspan.session import materialize

FOLDS = 5
#: Training documents per language at most: those with the least hash of their id.
SAMPLE = 2000
#: Lengths of n-grams, over lower-case letters with one blank between words.
LENGTHS = (2, 3, 4)
SHARE = 5e-5
#: Slots per member (of the fullest filter) and hash functions.
SLOTS, HASHES = 16, 4
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-case, 32 for whatever is no letter, runs of it once; and the text of each.

    Each text has a blank before and after it, so that no n-gram but a blank one joins two texts.
    """
    joined = "\n".join(texts).lower()  # lower() can change a length, so the ends are found after it
    if joined.count("\n") != len(texts) - 1:
        joined = "\n".join(t.replace("\n", " ") for t in texts).lower()
    points = np.frombuffer(("\n" + joined + "\n").encode("utf-32-le", "replace"), np.uint32)
    ends = points == 10
    owner = np.cumsum(ends) - 1
    alpha = _letter_table()[points]
    points = np.where(alpha, points, np.uint32(32)).astype(np.uint32)
    keep = alpha | ends | np.append(False, alpha[:-1])
    return points[keep], owner[keep]


_TABLE: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _TABLE[0]


def grams(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number for the n-gram at each place (places whose n-gram would pass the end are left out)."""
    out = np.full(max(0, len(points) - n + 1), n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x100000001B3) + points[k : len(points) - n + 1 + k]
        out ^= out >> np.uint64(29)
    return out


def usable(points: np.ndarray, n: int) -> np.ndarray:
    """Whether the n-gram at each place has a letter and lies within one word and its blanks (a blank inside only at its ends)."""
    blank = points == 32
    inner = np.zeros(max(0, len(points) - n + 1), bool)
    for k in range(1, n - 1):
        inner |= blank[k : len(points) - n + 1 + k]
    return ~inner & ~(blank[: len(inner)] & blank[n - 1 : n - 1 + len(inner)])


@dataclass
class Filters:
    """Languages, their slots (one mask row per 64 languages), and the chance of a false hit for each."""

    languages: list[str]
    slots: np.ndarray
    chance: np.ndarray

    def masks(self, hashed: np.ndarray, plane: int) -> np.ndarray:
        size = np.uint64(self.slots.shape[1])
        out = None
        for seed in _SEEDS[:HASHES]:
            got = self.slots[plane][((hashed * seed) >> np.uint64(20)) % size]
            out = got if out is None else out & got
        return out


def build(members: dict[str, np.ndarray]) -> Filters:
    """Filters from each language's n-gram numbers."""
    languages = sorted(members)
    fullest = max((len(m) for m in members.values()), default=0)
    size = 1 << max(10, (fullest * SLOTS - 1).bit_length())
    slots = np.zeros((max(1, -(-len(languages) // 64)), size), np.uint64)
    for i, name in enumerate(languages):
        for seed in _SEEDS[:HASHES]:
            at = ((members[name].astype(np.uint64) * seed) >> np.uint64(20)) % np.uint64(size)
            slots[i // 64, at] |= np.uint64(1) << np.uint64(i % 64)
    fill = [float(((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(languages))]
    return Filters(languages, slots, np.array(fill) ** HASHES)


def votes(filters: Filters, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(corrected votes of each text for each language, number of n-grams of each text)."""
    points, owner = letters(texts)
    counts, total = np.zeros((len(texts), len(filters.languages))), np.zeros(len(texts))
    for n in LENGTHS:
        ok = usable(points, n)
        hashed, of = grams(points, n)[ok], owner[: len(ok)][ok]
        # A text's first n-gram begins at the blank before it, its last ends at the blank that opens the next text.
        total += np.bincount(of, minlength=len(texts))[: len(texts)]
        for plane in range(len(filters.slots)):
            masks = filters.masks(hashed, plane)
            for i in range(plane * 64, min(len(filters.languages), plane * 64 + 64)):
                hit = (masks >> np.uint64(i % 64)) & np.uint64(1)
                counts[:, i] += np.bincount(of, weights=hit, minlength=len(texts))[: len(texts)]
    corrected = (counts - total[:, None] * filters.chance) / np.maximum(1e-9, 1 - filters.chance)
    return np.maximum(corrected, 0.0), total


def train(docs: DataFrame) -> Filters:
    """Filters from documents outside fold 0 that have a language: at most ``SAMPLE`` per language.

    Ids are chosen first, then the n-grams of their whole texts are counted in tasks and summed by Spark; only
    n-grams that reach ``SHARE``, a bounded number, come to the driver.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    known = known.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(fold(F.col("doc_id"), FOLDS) != 0).distinct()
    known = materialize(known.withColumn("place", F.xxhash64("doc_id")), "langid-known")
    if known.isEmpty():
        return build({})
    # One plan for any number of languages; the cut of a language with very many documents is found by counts.
    chosen = per_partition_limit(known, ["lang"], ["place", "doc_id"], SAMPLE).drop("place")
    # Written, so that Spark sees its size: it is broadcast where that is small, whatever the number of languages.
    chosen = materialize(chosen, "langid-sample")

    def count(part: pa.RecordBatch, texts: list[str]) -> dict:
        langs = np.array(part.column("lang").to_pylist(), object)
        out: list[tuple[str, int, np.ndarray, np.ndarray]] = []
        for name in sorted(set(langs)):
            points, _ = letters([t for t, lang in zip(texts, langs) if lang == name])
            for n in LENGTHS:
                got, times = np.unique(grams(points, n)[usable(points, n)], return_counts=True)
                out.append((name, n, got, times))
        return {
            "lang": [name for name, _, got, _ in out for _ in range(len(got))],
            "n": pa.array(np.concatenate([np.full(len(got), n, np.int32) for _, n, got, _ in out]), pa.int32()),
            "gram": pa.array(np.concatenate([got.astype(np.int64) for *_, got, _ in out]), pa.int64()),
            "times": pa.array(np.concatenate([times for *_, times in out]).astype(np.int64), pa.int64()),
        }

    texts = texts_of(docs).join(chosen, "doc_id").select("lang", "text")
    counted = map_runs(texts, count, "lang string, n int, gram long, times long")
    counted = counted.groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    totals = counted.groupBy("lang", "n").agg(F.sum("times").alias("total"))
    frequent = counted.join(F.broadcast(totals), ["lang", "n"]).where(F.col("times") >= F.col("total") * SHARE)
    rows = frequent.select("lang", "gram").toPandas()
    return build({name: part["gram"].to_numpy() for name, part in rows.groupby("lang")})


def languages(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the language of each whole text, ``und`` if the text is null or has no letter.

    The score is the winner's share of the n-grams, times half of 1 + its lead over the second; 0 for ``und``. Ties go to
    the name that sorts first. A text with letters but no known n-gram gets the first name and score 0; without any
    training row all texts are ``und``. One pass without a shuffle; repeated rows stay; an empty table gives no rows;
    other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def work(part: pa.RecordBatch, texts: list[str]) -> dict:
        model = sent.value
        names = np.array([*model.languages, "und"], object)
        if not model.languages:
            return {"doc_id": part.column("doc_id"), "lang_pred": ["und"] * len(texts), "score": np.zeros(len(texts))}
        got, total = votes(model, texts)
        best = got.argmax(axis=1)
        top = got[np.arange(len(texts)), best]
        rest = got.copy()
        rest[np.arange(len(texts)), best] = 0.0
        lead = np.where(top > 0, (top - rest.max(axis=1)) / np.maximum(top, 1e-9), 0.0)
        score = np.where(total > 0, np.clip(top / np.maximum(total, 1), 0, 1) * (0.5 + 0.5 * lead), 0.0)
        return {"doc_id": part.column("doc_id"), "lang_pred": names[np.where(total > 0, best, len(names) - 1)].tolist(), "score": score}

    return map_runs(texts_of(docs, id_col, text_col), work, "doc_id long, lang_pred string, score double")
