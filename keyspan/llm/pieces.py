"""Operator 3: encoding and decoding with a SentencePiece BPE model, by vectorised merge rounds.

A text becomes segments that no vocabulary piece can cross. The segments of many texts lie in one flat
array of symbols. Each round finds the best pair of every segment (a segmented minimum over pair ranks),
merges it everywhere at once, closes the gaps, and drops the segments in which no pair is left.

The order of merges is that of the library: the best score first, the leftmost on ties, one at a time. All
places of a segment's best pair are merged in one round only where that provably gives the same result:
the merged piece has a rank of its own and no longer piece that it starts or ends ranks before it.
Otherwise the round merges the leftmost place.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import map_runs, texts_of

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Segments above so many symbols (a run of thousands of equal signs) are merged one pair at a time from a heap:
#: the same merges in the same order, in n log n steps instead of n rounds.
LONG_SEGMENT = 2_000
#: A worker keeps the ids of words up to so many characters, and of so many words at most; then it starts again with
#: none. Longer words are rarely met again; they are encoded once per run of texts.
CACHED_LENGTH, CACHED_WORDS = 14, 150_000


class PieceModel:
    """Tables of one model for encoding and decoding. Built once per Python worker."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = proto.ModelProto.SentencePiece
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("needs a BPE model that leaves the text as it is")
        if not spec.add_dummy_prefix or not spec.escape_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("needs a model with a leading space mark and byte fallback")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("pieces defined by users and unused pieces are not supported")
        pieces = [p.piece for p in model.pieces]
        normal = [i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.begin, self.end = len(pieces), processor.bos_id(), processor.eos_id()
        byte_ids = [i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE]
        self.byte_id = {int(pieces[i][1:-1], 16): i for i in byte_ids}
        self.ascii_id = np.array([self.byte_id[b] for b in range(128)], np.int32)
        self.is_byte = np.zeros(self.size, bool)
        self.is_byte[byte_ids] = True

        found = {pieces[i]: i for i in normal}
        if any(SPACE in p.lstrip(SPACE) for p in found) or any(c not in found for c in set("".join(found))):
            raise ValueError("needs pieces with the space mark in front only, and every character as a piece")
        scores = sorted({model.pieces[i].score for i in normal}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        self.rank = np.full(self.size, NONE, np.int32)
        for i in normal:
            self.rank[i] = place[model.pieces[i].score]

        # Characters: a dense number each; 0 is every character outside the vocabulary.
        chars = sorted(c for c in found if len(c) == 1)
        self.char_no = np.zeros(0x110000, np.int32)
        self.char_no[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.char_id = np.array([0] + [found[c] for c in chars], np.int32)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        pairs: dict[int, int] = {}
        shared = np.bincount(self.rank[normal], minlength=len(scores)) > 1
        self.at_once = np.ones(self.size, bool)
        for piece, i in found.items():
            numbers = self.char_no[[ord(c) for c in piece]]
            self.joined[numbers[:-1], numbers[1:]] = True
            self.at_once[i] &= not shared[self.rank[i]]
            for cut in range(1, len(piece)):
                left, right = found.get(piece[:cut]), found.get(piece[cut:])
                for half in (left, right):
                    if half is not None and self.rank[i] <= self.rank[half]:
                        self.at_once[half] = False
                if left is not None and right is not None:
                    pairs[left * self.size + right] = i
        self.pairs = pairs
        self._hash(pairs)

        # Decoding: the bytes of each id.
        self.bytes_of = [b""] * self.size
        for i in normal:
            self.bytes_of[i] = pieces[i].replace(SPACE, " ").encode()
        for value, i in self.byte_id.items():
            self.bytes_of[i] = bytes([value])
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN}
        self.unknown_text = model.trainer_spec.unk_surface.encode()

    def _hash(self, pairs: dict[int, int]) -> None:
        """Open addressing over the valid pairs, at a load of about a tenth."""
        self.bits = max(8, (len(pairs) * 10).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        for key, slot, value in zip(keys.tolist(), self._slot(keys).tolist(), pairs.values()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.values[slot] = key, value

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        keys = left.astype(np.int64) * self.size + right
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    # -- encoding ---------------------------------------------------------------------------------

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """Ids (little-endian, four bytes each) of segments, whose spaces are already space marks."""
        if not segments:
            return []
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        numbers = self.char_no[points]
        # A character outside the vocabulary becomes its byte, or waits as a number beyond the ids; neither ever merges.
        foreign = np.where(points < 128, self.ascii_id[np.minimum(points, 127)], self.size + points.astype(np.int64)).astype(np.int32)
        symbols = np.where(numbers == 0, foreign, self.char_id[numbers])
        # Cut where no piece holds both characters: no merge can cross that place.
        first = np.zeros(len(points) + 1, bool)
        starts = np.cumsum(lengths) - lengths
        first[starts] = True
        first[1:-1] |= ~self.joined[numbers[:-1], numbers[1:]]
        first[-1] = True
        at = np.flatnonzero(first[:-1])
        ids, owner = self._merge(symbols, at, np.diff(np.append(at, len(points))))
        words = (np.searchsorted(starts, at, "right") - 1)[owner]
        ends = np.cumsum(np.bincount(words, minlength=len(segments))).tolist()
        flat = ids.astype("<u4").tobytes()
        out = [flat[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends)]
        for word in np.unique(words[ids >= self.size]).tolist():
            spelled: list[int] = []
            for i in ids[ends[word - 1] if word else 0 : ends[word]].tolist():
                spelled.extend([i] if i < self.size else (self.byte_id[b] for b in chr(i - self.size).encode("utf-8", "replace")))
            out[word] = np.array(spelled, "<u4").tobytes()
        return out

    def _merge(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over flat symbols. Returns the symbols left and the number of each one's segment."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        names = np.arange(len(starts))
        long = np.flatnonzero(lengths > LONG_SEGMENT)
        for i in long.tolist():
            got = self._heap(symbols[starts[i] : starts[i] + lengths[i]].tolist())
            done.append((np.array(got, np.int32), np.full(len(got), i)))
        keep = lengths <= LONG_SEGMENT
        if len(long):
            symbols = symbols[np.repeat(keep, lengths)]
            names, lengths = names[keep], lengths[keep]
        owner = np.repeat(np.arange(len(names)), lengths)
        value = np.full(len(symbols), -1, np.int32)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        value[inner] = self.merged(symbols[inner], symbols[inner + 1])
        while len(symbols):
            rank = np.where(value >= 0, self.rank[value], NONE)
            starts = np.cumsum(lengths) - lengths
            best = np.minimum.reduceat(rank, starts)
            over = best == NONE
            if over.any():
                gone = np.repeat(over, lengths)
                done.append((symbols[gone], np.repeat(names[over], lengths[over])))
                symbols, value, rank = symbols[~gone], value[~gone], rank[~gone]
                names, lengths, best = names[~over], lengths[~over], best[~over]
                if not len(symbols):
                    break
                starts = np.cumsum(lengths) - lengths
            owner = np.repeat(np.arange(len(names)), lengths)
            hits = np.flatnonzero(rank == best[owner])
            word = owner[hits]
            leading = np.append(True, word[1:] != word[:-1])
            # Of overlapping places (a a a), every second one counts, from the left.
            joint = np.append(True, hits[1:] != hits[:-1] + 1)
            place = np.arange(len(hits))
            since = place - np.maximum.accumulate(np.where(joint, place, 0))
            hits = hits[leading | (self.at_once[value[hits]] & (since % 2 == 0))]
            symbols = symbols.copy()
            symbols[hits] = value[hits]
            left = np.ones(len(symbols), bool)
            left[hits + 1] = False
            lengths = lengths - np.bincount(owner[hits], minlength=len(lengths))
            moved = hits - np.arange(len(hits))
            symbols, value, owner = symbols[left], value[left], owner[left]
            near = np.zeros(len(symbols) + 1, bool)
            near[moved] = near[moved - 1] = True  # -1 is the extra place at the end
            fresh = np.flatnonzero(near[:-1])
            value[fresh] = -1
            fresh = fresh[fresh + 1 < len(symbols)]
            fresh = fresh[owner[fresh] == owner[fresh + 1]]
            value[fresh] = self.merged(symbols[fresh], symbols[fresh + 1])
        if not done:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        ids, part = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(part, kind="stable")
        return ids[order], part[order]

    def _heap(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (piece := self.pairs.get(symbols[i] * self.size + symbols[j])) is not None:
                heapq.heappush(heap, (int(self.rank[piece]), i, symbols[i], symbols[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if symbols[i] == a else n
            if j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = self.pairs[a * self.size + b], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s in symbols if s >= 0]

    # -- decoding ---------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library's decode() gives it."""
        listed = ids.tolist()
        if self.unknown.intersection(listed):
            joined = b"".join(self.unknown_text if i in self.unknown else self.bytes_of[i] for i in listed)
        else:
            joined = b"".join(map(self.bytes_of.__getitem__, listed))
        shown = next((i for i in listed if self.bytes_of[i] or i in self.unknown), None)
        if shown is not None and not self.is_byte[shown] and self.bytes_of[shown][:1] == b" ":
            joined = joined[1:]
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return _with_marks(joined)


def _with_marks(data: bytes) -> str:
    """UTF-8 in which each byte that is part of no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as error:
            out.append(data[at : at + error.start].decode() + "�")
            at += error.start + 1
    return "".join(out)


@lru_cache(maxsize=2)
def model_at(path: str) -> PieceModel:
    return PieceModel(path)


_WORDS: dict[str, dict[str, bytes]] = {}


def encode_texts(model: PieceModel, texts: list[str], words: dict[str, bytes]) -> list[bytes]:
    """Ids of whole texts, without begin and end. ``words`` keeps the ids of segments already seen.

    A segment is a run of spaces and the word after it. The key of a word after one space (or at the
    start, where the model puts one) is the word; other segments have their spaces in the key.
    """
    split: list[list[str]] = []
    for text in texts:
        text = text.replace(SPACE, " ")
        if not text:
            split.append([])
        elif "  " not in text and text[0] != " " and text[-1] != " ":
            split.append(text.split(" "))
        else:
            found = re.findall(r" *[^ ]+| +", " " + text)
            split.append([s[1:] if s[0] == " " and len(s) > 1 and s[1] != " " else s for s in found])
    if len(words) > CACHED_WORDS:
        words.clear()
    new = list(set().union(*split) - words.keys())
    for at in range(0, len(new), 200_000):
        part = new[at : at + 200_000]
        marked = [k.replace(" ", SPACE) if k[0] == " " else SPACE + k for k in part]
        words.update(zip(part, model.encode_segments(marked)))
    out = [b"".join(map(words.__getitem__, s)) for s in split]
    for word in new:
        if len(word) > CACHED_LENGTH:
            del words[word]
    return out


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, with begin and end ids, and decode the ids again: (doc_id, ids, decoded).

    ``ids`` is binary: little-endian unsigned 32-bit integers. One pass without a shuffle; ``model_path``
    is a file that every executor has. Null texts count as empty: they give the begin and end ids and an
    empty decoded text. Repeated rows stay as they are, an empty table gives no rows, and columns other
    than the two named are not read.
    """

    def work(part: pa.RecordBatch, texts: list[str]) -> dict:
        model = model_at(model_path)
        begin, end = (np.array([i], "<u4").tobytes() for i in (model.begin, model.end))
        ids = [begin + x + end for x in encode_texts(model, texts, _WORDS.setdefault(model_path, {}))]
        return {
            "doc_id": part.column("doc_id"),
            "ids": pa.array(ids, pa.binary()),
            "decoded": pa.array([model.decode(np.frombuffer(x, "<u4")) for x in ids], pa.string()),
        }

    return map_runs(texts_of(docs, id_col, text_col), work, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Lengths and SHA-256 digests of what ``encode_decode`` returns."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
