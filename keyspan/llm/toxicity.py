"""Operator 4: toxicity by a linear-chain conditional random field over the tokens of a text.

Labels exist for whole documents only, so the training tokens get theirs from features (a word, its first
letters, its last ones) that a likelihood-ratio test finds far more often in toxic documents than in others.
The field has two states per token. Forward-backward marginals tell how likely each token is part of toxic
language; their sum, maximum and share make the document's score through a logistic curve fitted to the labels,
and the likely tokens are the offending offsets.

The fit uses a sample with a stated bound (``SAMPLE``); scoring covers all documents and all of each text.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass
from dataclasses import field as dataclass_field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import fold, keep_rows, map_runs, texts_of

#: Labelled documents used for fitting: (not toxic, toxic) at most, those with the least hash of their id.
SAMPLE = (3000, 2000)
#: Chains (of ``WIDTH`` tokens) used for the field: so many with a toxic token, and so many without, at most.
CHAINS = 4000
WIDTH = 64
FOLDS = 5
#: A worker keeps the weights of so many different words at most; then it starts again with none.
CACHED_WORDS = 150_000
WORD = re.compile(r"\S+")
STRIP = re.compile(r"^\W+|\W+$")


def features(token: str) -> list[str]:
    """What the model sees of a token: the word without outer punctuation, its beginnings and its end."""
    word = STRIP.sub("", token).lower()
    if not word:
        return []
    return ["w" + word] + [f"p{word[:k]}" for k in (3, 4, 5) if len(word) > k] + ([f"s{word[-4:]}"] if len(word) > 4 else [])


@dataclass
class Field:
    """A fitted model: feature weights, transitions between (clean, toxic), and the document's curve."""

    weights: dict[str, float]
    bias: float
    steps: np.ndarray
    curve: np.ndarray
    name: str = dataclass_field(default_factory=lambda: uuid.uuid4().hex)

    def unary(self, token: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(token))


class Unary(dict):
    """Token to score, computed when first met."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[token] = self.field.unary(token)
        return value


def _rows(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat values as rows of WIDTH that start anew for each document: (matrix, valid, document of row, place in it)."""
    count = -(-lengths // WIDTH)
    doc = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    valid = (nth * WIDTH)[:, None] + np.arange(WIDTH) < lengths[doc][:, None]
    matrix = np.zeros(valid.shape)
    matrix[valid] = values
    return matrix, valid, doc, nth


def marginals(unary: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """P(toxic) of each token: forward-backward over each document's whole chain, after a clean token at its start.

    Rows of a document are joined exactly: first each row's product of transfer matrices, then the messages
    that enter every row, then the messages inside all rows at once.
    """
    if not len(unary):
        return np.empty(0)
    u, valid, doc, nth = _rows(np.clip(unary, -30, 30), lengths)
    gain = np.exp(u)
    (t00, t01), (t10, t11) = steps
    r = len(u)
    p = np.zeros((r, 2, 2))
    p[:, 0, 0] = p[:, 1, 1] = 1.0
    for k in range(WIDTH):
        on, g = valid[:, k], gain[:, k]
        new = np.empty_like(p)
        new[:, :, 0] = p[:, :, 0] * t00 + p[:, :, 1] * t10
        new[:, :, 1] = (p[:, :, 0] * t01 + p[:, :, 1] * t11) * g[:, None]
        new /= new.sum(axis=(1, 2), keepdims=True)
        p[on] = new[on]
    come, back = np.empty((r, 2)), np.empty((r, 2))
    come[nth == 0], back[:] = (1.0, 0.0), (0.5, 0.5)
    by_place = np.argsort(nth, kind="stable")
    ends = np.cumsum(np.bincount(nth))
    for k in range(1, len(ends)):
        rows = by_place[ends[k - 1] : ends[k]]
        v = np.einsum("ri,rij->rj", come[rows - 1], p[rows - 1])
        come[rows] = v / v.sum(axis=1, keepdims=True)
    for k in range(len(ends) - 1, 0, -1):
        rows = by_place[ends[k - 1] : ends[k]]
        v = np.einsum("rij,rj->ri", p[rows], back[rows])
        back[rows - 1] = v / v.sum(axis=1, keepdims=True)
    forward = np.empty((WIDTH, r))
    a0, a1 = come[:, 0].copy(), come[:, 1].copy()
    for k in range(WIDTH):
        n0, n1 = a0 * t00 + a1 * t10, (a0 * t01 + a1 * t11) * gain[:, k]
        total = n0 + n1
        a0, a1 = np.where(valid[:, k], n0 / total, a0), np.where(valid[:, k], n1 / total, a1)
        forward[k] = a1
    out = np.empty((r, WIDTH))
    b0, b1 = back[:, 0].copy(), back[:, 1].copy()
    for k in range(WIDTH - 1, -1, -1):
        f1 = forward[k]
        high, low = f1 * b1, (1 - f1) * b0
        out[:, k] = high / (high + low)
        n0, n1 = t00 * b0 + t01 * gain[:, k] * b1, t10 * b0 + t11 * gain[:, k] * b1
        total = n0 + n1
        b0, b1 = np.where(valid[:, k], n0 / total, b0), np.where(valid[:, k], n1 / total, b1)
    return out[valid]


def token_marginals(field: Field, cache: Unary, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    tokens = [t.split() for t in texts]
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    unary = np.fromiter((cache[w] for t in tokens for w in t), np.float64, int(lengths.sum()))
    return marginals(unary, lengths, field.steps), lengths, tokens


def aggregate(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: 1, log of 1 + the marginals of its likely toxic tokens, the largest marginal, their share of
    all tokens. Only likely tokens are summed, so length alone moves nothing. Empty: 1, 0, 0, 0."""
    out = np.zeros((len(lengths), 4))
    out[:, 0] = 1
    full = lengths > 0
    if full.any():
        starts = (np.cumsum(lengths) - lengths)[full]
        total = np.add.reduceat(np.where(p >= 0.5, p, 0.0), starts)
        out[full, 1], out[full, 2], out[full, 3] = np.log1p(total), np.maximum.reduceat(p, starts), total / lengths[full]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


# -- fitting --------------------------------------------------------------------------------------------------


def _apart(docs: list[list[str]]) -> list[int]:
    """Documents that are not near copies of an earlier one (4 of 16 minimum hashes of their runs of three words agree),
    so that a group of copies counts once when evidence is weighed."""
    rng = np.random.default_rng(4)
    mix = rng.integers(1, 2**62, 16, dtype=np.uint64) | np.uint64(1)
    seen: dict[tuple[int, int], list[int]] = {}
    kept = []
    for i, tokens in enumerate(docs):
        words = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in tokens], np.uint64)
        n = max(1, len(words) - 2)
        runs = words[:n] + sum(words[k : k + n] * np.uint64(2654435761**k) for k in (1, 2) if len(words) > 2)
        least = ((runs[:, None] * mix) >> np.uint64(20)).min(axis=0).tolist() if len(words) else [0] * 16
        agree = Counter(d for key in enumerate(least) for d in seen.get(key, ()))
        if agree and max(agree.values()) >= 4:
            continue
        kept.append(i)
        for key in enumerate(least):
            seen.setdefault(key, []).append(i)
    return kept


def _g_squared(k1: int, n1: int, k0: int, n0: int) -> float:
    """Likelihood ratio of one rate against two; 0 unless the first rate is five times the second."""

    def likelihood(k: int, n: int) -> float:
        return (k * np.log(k / n) if k else 0.0) + ((n - k) * np.log(1 - k / n) if k < n else 0.0)

    if not k1 or k1 * n0 < 5 * k0 * n1:
        return 0.0
    return 2 * (likelihood(k1, n1) + likelihood(k0, n0) - likelihood(k1 + k0, n1 + n0))


def markers(docs: list[list[str]], labels: np.ndarray) -> set[str]:
    """Features found far more often in toxic documents than in others.

    The likelihood ratio must be one that no feature tested would be expected to reach by chance. The purest
    features come first, and a later one is judged by the tokens that no earlier one explains: the first letters of
    an insult do not mark the harmless words that begin alike.
    """
    kept = _apart(docs)
    total = [int((labels[kept] == y).sum()) for y in (0, 1)]
    where: dict[str, tuple[list[int], list[int]]] = {}
    for i in kept:
        for w in set(docs[i]):
            where.setdefault(w, ([], []))[int(labels[i])].append(i)
    counts = [Counter(), Counter()]
    for i in kept:
        counts[int(labels[i])].update({f for w in set(docs[i]) for f in features(w)})
    least = 5 + 2 * np.log(max(2, len(counts[0].keys() | counts[1].keys())))
    judged = {f: _g_squared(k, total[1], counts[0][f], total[0]) for f, k in counts[1].items()}
    likely = [f for f, g in judged.items() if g >= least]
    words_of: dict[str, list[str]] = {f: [] for f in likely}
    for w in where:
        for f in features(w):
            if f in words_of:
                words_of[f].append(w)
    likely.sort(key=lambda f: (counts[0][f] * total[1] / (counts[1][f] * max(1, total[0])), -judged[f], f))
    found: set[str] = set()
    for f in likely:
        rest = [w for w in words_of[f] if not found.intersection(features(w))]
        hit = [len({i for w in rest for i in where[w][y]}) for y in (0, 1)]
        if _g_squared(hit[1], total[1], hit[0], total[0]) >= least:
            found.add(f)
    return found


def fit_field(docs: list[list[str]], marked: set[str], rounds: int = 60) -> tuple[dict[str, float], float, np.ndarray]:
    """Conditional maximum likelihood with a Gaussian prior, by full gradients with Adagrad steps."""
    toxic = {w: any(f in marked for f in features(w)) for w in {w for t in docs for w in t}}
    chains = [t[i : i + WIDTH] for t in docs for i in range(0, len(t), WIDTH)]
    hot = [c for c in chains if any(toxic[w] for w in c)]
    cold = [c for c in chains if not any(toxic[w] for w in c)]
    chosen = [c for part in (hot, cold) for c in part[:: max(1, -(-len(part) // CHAINS))]]
    if not hot:
        return {}, -5.0, np.array([[0.9, 0.1], [0.9, 0.1]])
    words = sorted({w for c in chosen for w in c})
    number = {w: i for i, w in enumerate(words)}
    known = Counter(f for c in chosen for w in set(c) for f in features(w))
    names = sorted(f for f, n in known.items() if n >= 3)
    index = {f: i + 1 for i, f in enumerate(names)}
    table = np.zeros((len(words), 5), np.int64)
    for i, w in enumerate(words):
        got = [index[f] for f in features(w) if f in index][:5]
        table[i, : len(got)] = got
    r = len(chosen)
    lengths = np.array([len(c) for c in chosen])
    at = np.zeros((r, WIDTH), np.int64)
    valid = np.arange(WIDTH) < lengths[:, None]
    at[valid] = [number[w] for c in chosen for w in c]
    gold = np.array([toxic[w] for w in words], float)[at] * valid
    before = np.concatenate([np.zeros((r, 1)), gold[:, :-1]], axis=1)
    seen = np.array([[((before == i) & (gold == j) & valid).sum() for j in (0, 1)] for i in (0, 1)], float)
    weights, bias, moves = np.zeros(len(names) + 1), -2.0, np.zeros((2, 2))
    past_w, past_b, past_m = np.full(len(weights), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    total = valid.sum()
    for _ in range(rounds):
        score = bias + weights[table].sum(axis=1)
        gain = np.exp(np.clip(score, -30, 30))[at]
        steps = np.exp(moves)
        f = np.empty((WIDTH + 1, 2, r))
        f[0] = [[1.0], [0.0]]
        for k in range(WIDTH):
            new = np.stack([f[k, 0] * steps[0, 0] + f[k, 1] * steps[1, 0], (f[k, 0] * steps[0, 1] + f[k, 1] * steps[1, 1]) * gain[:, k]])
            f[k + 1] = np.where(valid[:, k], new / new.sum(axis=0), f[k])
        b = np.full((2, r), 0.5)
        expected, pair = np.zeros((r, WIDTH)), np.zeros((2, 2))
        for k in range(WIDTH - 1, -1, -1):
            on = valid[:, k]
            out = np.stack([b[0], gain[:, k] * b[1]])
            joint = f[k][:, None, :] * steps[:, :, None] * out[None, :, :]
            joint *= on / joint.sum(axis=(0, 1))
            pair += joint.sum(axis=2)
            expected[:, k] = joint[:, 1].sum(axis=0)
            new = np.stack([steps[0, 0] * out[0] + steps[0, 1] * out[1], steps[1, 0] * out[0] + steps[1, 1] * out[1]])
            b = np.where(on, new / new.sum(axis=0), b)
        off = np.bincount(at[valid], weights=(gold - expected)[valid], minlength=len(words))
        grad_w = np.bincount(table.ravel(), weights=np.repeat(off, 5), minlength=len(weights)) - 0.05 * weights
        grad_w[0] = 0.0
        grad_b, grad_m = off.sum(), seen - pair - 0.05 * moves
        past_w, past_b, past_m = past_w + grad_w**2, past_b + grad_b**2, past_m + grad_m**2
        weights += 0.5 * grad_w / np.sqrt(past_w)
        bias += 0.5 * grad_b / np.sqrt(past_b)
        moves += 0.5 * grad_m / np.sqrt(past_m)
        if abs(gold - expected).sum() < 1e-4 * total:
            break
    return {f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 1e-3}, float(bias), np.exp(moves)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression with a small prior, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (weight * (y - p)) - 0.1 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], labels: list[int], weights: list[float]) -> Field:
    """A model from labelled texts; without both labels, one whose every score is the share of toxic rows."""
    y, tokens = np.array(labels, int), [t.split() for t in texts]
    if len(set(labels)) < 2:
        rate = float(np.mean(y)) if len(y) else 0.0
        base = np.log((rate + 1e-3) / (1 - rate + 1e-3))
        return Field({}, -5.0, np.array([[0.9, 0.1], [0.9, 0.1]]), np.array([base, 0, 0, 0]))
    known, bias, steps = fit_field(tokens, markers(tokens, y))
    field = Field(known, bias, steps, np.zeros(4))
    cache, x = Unary(field), []
    for i in range(0, len(texts), 500):
        p, lengths, _ = token_marginals(field, cache, texts[i : i + 500])
        x.append(aggregate(p, lengths))
    field.curve = fit_curve(np.concatenate(x), y.astype(float), np.array(weights))
    return field


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Fit on labelled documents outside fold 0. The sample's ids are chosen first; only its texts reach the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where((F.col("toxic").isin(0, 1)) & (fold(F.col("doc_id"), FOLDS) != 0))
    counts = dict(known.groupBy("toxic").count().collect())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.where(F.col("toxic") == label).orderBy(*order).limit(most) for label, most in enumerate(SAMPLE)]
    chosen = parts[0].unionByName(parts[1])
    rows = texts_of(docs).join(F.broadcast(chosen), "doc_id").toPandas().drop_duplicates().sort_values(["doc_id", "text"])
    taken = rows["toxic"].value_counts()
    weight = [counts[y] / taken[y] for y in rows["toxic"]]
    return fit(rows["text"].tolist(), rows["toxic"].tolist(), weight)


def toxic_spans(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans): the document's score in 0 to 1, and the offending tokens with their marginals.

    ``spans`` holds (start, end, p) in code points for tokens whose marginal is 0.5 or more. One pass without a
    shuffle; the model is a few thousand weights. Null and empty texts get the score of a text without toxic tokens
    and no spans; repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def work(part: pa.RecordBatch, texts: list[str]) -> dict:
        model = sent.value
        cache = _cache_of(model)
        p, lengths, _ = token_marginals(model, cache, texts)
        scores = _sigmoid(aggregate(p, lengths) @ model.curve)
        spans, at = [], 0
        for text, n in zip(texts, lengths.tolist()):
            own = p[at : at + n]
            at += n
            hit = set(np.flatnonzero(own >= 0.5).tolist())
            found = enumerate(WORD.finditer(text)) if hit else ()
            spans.append([{"start": m.start(), "end": m.end(), "p": float(own[i])} for i, m in found if i in hit])
        kind = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64(), "p": pa.float64()}))
        return {"doc_id": part.column("doc_id"), "score": scores, "spans": pa.array(spans, kind)}

    schema = "doc_id long, score double, spans array<struct<start:long,end:long,p:double>>"
    return map_runs(texts_of(docs, id_col, text_col), work, schema)


def clean_documents(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below 0.5. Same rules as ``toxic_spans``."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def keep(texts: list[str]) -> np.ndarray:
        p, lengths, _ = token_marginals(sent.value, _cache_of(sent.value), texts)
        return _sigmoid(aggregate(p, lengths) @ sent.value.curve) < 0.5

    return keep_rows(docs, keep, text_col)


_CACHES: dict[str, Unary] = {}


def _cache_of(field: Field) -> Unary:
    """The worker's cache for a model, kept from task to task."""
    if field.name not in _CACHES:
        _CACHES.clear()
        _CACHES[field.name] = Unary(field)
    return _CACHES[field.name]
