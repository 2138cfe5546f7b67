"""Operator 9: secrets in texts and in the layers encoded inside them.

A worklist holds layers of a document: the text itself, then what its URL escapes, Unicode escapes, base64 runs
and compressed bytes decode to, and so on until no new layer appears. Every layer is scanned with the same
patterns; each character of a layer knows the part of the document that it came from, so a find in a deep
layer is reported as a span of the document. Layers seen before (cycles included) are not opened again.

Compressed bytes are inflated in steps. A long layer is scanned piece by piece, each ending after a character that no
pattern and no code runs over, so that nothing is missed between two pieces and nothing long is held whole.
"""

from __future__ import annotations

import binascii
import bz2
import codecs
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import map_runs, runs, texts_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
#: A run of base64, over single line breaks, also where they are written as escapes; it may begin anew after each break and each slash.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])([A-Za-z0-9+/]{16,}+(?:[ \t]*(?:\r\n?|\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9+/]++)*+|[A-Za-z0-9+/]++(?:[ \t]*(?:\r\n?|\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9+/]++)++)={0,2}")
BASE64_URL = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{16,}+(?:[ \t]*(?:\r\n?|\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9_-]++)*+|[A-Za-z0-9_-]++(?:[ \t]*(?:\r\n?|\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9_-]++)++)={0,2}")
BREAK = re.compile(r"(?:[ \t\r\n]|(?:\\r)?\\n)+")
START = re.compile(r"(?:[ \t\r\n]|(?:\\r)?\\n)+|/")
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
#: Characters of base64 that a run has at least, and the bytes they hold.
LEAST, LEAST_BYTES = 16, 12
#: Characters of a piece of a long layer (more where no place to cut comes), and bytes that are decompressed in one step.
PIECE, STEP = 1 << 20, 1 << 20
#: Characters that no pattern and no code goes over.
CUT = re.compile(r"[^A-Za-z0-9+/_.=\"':%\\&#; \t\r\n-]")
#: How a compressed stream begins. Those of zlib are read without their checksums, which may be wrong.
GZIP, ZLIB, BZIP, XZ, ZSTD = b"\x1f\x8b\x08", (b"x\x01", b"x^", b"x\x9c", b"x\xda"), b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd"
#: Layers of compression directly inside one another that are opened, so that a stream that holds itself ends.
NESTED = 16

Span = tuple[int, int, int]


def scan(text: str) -> list[Span]:
    """(start, kind number, end) of each find: leftmost, not overlapping within a kind, short values left out."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A text with, for each character, the span of the document it stands for (None: the document itself)."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def maps(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            at = np.arange(len(self.text), dtype=np.int64)
            return at, at + 1
        return self.starts, self.ends

    def replaced(self, parts: list[tuple[int, int, str]]) -> Layer:
        """This layer with the given pieces (start, end, new text) put in place."""
        texts, starts, ends, at = [], [], [], 0
        own_start, own_end = self.maps()
        for a, b, new in [*parts, (len(self.text), len(self.text), "")]:
            texts += [self.text[at:a], new]
            starts.append(own_start[at:a])
            ends.append(own_end[at:a])
            if new:
                low, high = self.place(a, b)
                starts.append(np.full(len(new), low))
                ends.append(np.full(len(new), high))
            at = b
        return Layer("".join(texts), np.concatenate(starts), np.concatenate(ends))

    def region(self, start: int, end: int, text: str) -> Layer:
        low, high = self.place(start, end)
        return Layer(text, np.broadcast_to(np.int64(low), len(text)), np.broadcast_to(np.int64(high), len(text)))


def _member(data: bytes) -> tuple[object, int] | None:
    """What reads the stream that ``data`` begins with, and the bytes before its body. None: it is no known stream."""
    if data.startswith(GZIP) and len(data) > 10:
        flags, at = data[3], 10
        if flags & 4:
            at += 2 + int.from_bytes(data[at : at + 2], "little")
        for bit in (8, 16):
            if flags & bit:
                at = data.find(b"\0", at) + 1 or len(data)
        return zlib.decompressobj(-15), at + (2 if flags & 2 else 0)
    if data.startswith(ZLIB):
        return zlib.decompressobj(-15), 2
    if data.startswith(BZIP):
        return bz2.BZ2Decompressor(), 0
    if data.startswith(XZ):
        return lzma.LZMADecompressor(), 0
    if data.startswith(ZSTD):
        return zstandard.ZstdDecompressor().decompressobj(), 0
    return None


def inflated(data: bytes, raw: bool = False) -> Iterator[bytes]:
    """What all members of a compressed stream hold, in steps. Where one breaks, what came out before stands.

    ``raw``: bytes without a known beginning are read as a deflate stream.
    """
    while True:
        found = _member(data) or ((zlib.decompressobj(-15), 0) if raw else None)
        if found is None:
            return
        stream, at = found
        kind, raw = type(stream).__module__, False
        data = memoryview(data)[at:]
        # A few bytes of zstd may hold very many, and it gives them all at once.
        width = 256 if kind not in ("zlib", "bz2", "lzma", "_bz2", "_lzma") else 1 << 16
        at = 0
        try:
            while not stream.eof and at < len(data):
                part = data[at : at + width]
                at += len(part)
                if kind == "zlib":
                    while part and not stream.eof:
                        yield stream.decompress(part, STEP)
                        part = stream.unconsumed_tail
                elif width == 256:
                    yield stream.decompress(bytes(part))
                else:
                    yield stream.decompress(part, STEP)
                    while not stream.eof and not stream.needs_input:
                        yield stream.decompress(b"", STEP)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError, zstandard.ZstdError):
            return
        if not stream.eof:
            return
        rest = bytes(stream.unused_data) + bytes(data[at:])
        if kind == "zlib":  # after the checksum and its length, or zeros that fill up a block
            rest = rest[8:] if rest[8:].lstrip(b"\0").startswith(GZIP) else rest[4:]
        data = rest.lstrip(b"\0")


def compressed(data: bytes) -> bool:
    return data.startswith((GZIP, *ZLIB, BZIP, XZ, ZSTD))


def coding(data: bytes) -> str:
    """The encoding that bytes seem to have: UTF-8, or UTF-16 where they begin with its mark or every second one is 0."""
    if data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "utf-16"
    head = data[:64]
    if len(head) >= 8 and b"\0" in head:
        if not any(head[1::2]):
            return "utf-16-le"
        if not any(head[0::2]):
            return "utf-16-be"
    return "utf-8"


def pieces(parts: Iterable[bytes]) -> Iterator[str]:
    """The text that bytes hold, in pieces; it ends where they are no text, and a beginning that is none gives nothing."""
    decoder, held = None, ""
    for part in parts:
        if not part:
            continue
        if decoder is None:
            decoder = codecs.getincrementaldecoder(coding(part))()
        try:
            new = decoder.decode(part)
        except UnicodeDecodeError:
            return
        if CONTROL.search(new):
            return
        held += new
        if len(held) > PIECE:
            for at in range(len(held), len(held) - PIECE // 2, -256):  # the last place where the text can be cut
                if places := [m.end() for m in CUT.finditer(held, at - 256, at)]:
                    yield held[: places[-1]]
                    held = held[places[-1] :]
                    break
    if held:
        yield held


def readable(data: bytes) -> str | None:
    """The text that bytes hold, or None if they are not text."""
    try:
        text = data.decode(coding(data))
    except UnicodeDecodeError:
        return None
    return text if text and not CONTROL.search(text) else None


def unpacked(data: bytes) -> Iterator[str]:
    """The text inside compressed bytes, however often they are compressed, in pieces."""
    stream, raw = data, not compressed(data)
    for _ in range(NESTED):
        parts = inflated(stream, raw)
        first = next((p for p in parts if p), b"")
        if not compressed(first):
            if raw and len(first) < LEAST_BYTES:
                return
            yield from pieces(itertools.chain([first], parts))
            return
        # A stream inside a stream is held whole; it is smaller than what it holds.
        stream, raw = first + b"".join(parts), False


def beginning(data: bytes) -> str:
    """The longest text that bytes begin with."""
    try:
        text = data.decode()
    except UnicodeDecodeError as error:
        text = data[: error.start].decode()
    stop = CONTROL.search(text)
    return text[: stop.start()] if stop else text


def decoded(run: str) -> bytes:
    run = run[: len(run) - (len(run) % 4 == 1)]
    return binascii.a2b_base64(run + "=" * (-len(run) % 4))


def base64_in(text: str, pattern: re.Pattern, table: dict | None) -> Iterator[tuple[int, int, bytes, str]]:
    """(start, end, bytes, their text as far as it goes) of base64 from each place where a run may begin.

    A run goes on over line breaks and slashes for as long as it reads as text; a compressed one is given whole, as
    its stream knows its end.
    """
    for m in pattern.finditer(text):
        raw = m[1]
        if len(raw) < LEAST:
            continue
        if table and "-" not in raw and "_" not in raw:
            continue
        # Characters of the run without its breaks, and the place of each in the text.
        breaks = [(b.start(), b.end()) for b in BREAK.finditer(raw)]
        chars = BREAK.sub("", raw) if breaks else raw
        if len(chars) < LEAST:
            continue
        place = np.arange(m.start(), m.end(1))
        if breaks:
            keep = np.ones(len(raw), bool)
            for a, b in breaks:
                keep[a:b] = False
            place = place[keep]
        begins = np.array([0, *(b.end() for b in START.finditer(raw))]) + m.start()
        run = chars.translate(table) if table else chars
        reach = {}
        for at in np.unique(np.searchsorted(place, begins)).tolist():
            # From the same place in a group of four up to where an earlier start has read, it is the same text.
            if len(run) - at < LEAST or at < reach.get(at % 4, 0):
                continue
            size = 24
            while True:
                data = decoded(run[at : at + size])
                new = beginning(data)
                read = len(new.encode())
                if size >= len(run) - at or read < len(data) - 3:
                    break
                size *= 4
            if compressed(data) or coding(data) != "utf-8" or (at == 0 and read < LEAST_BYTES):
                data = decoded(run[at:])
                yield int(place[at]), m.end(), data, new if read >= LEAST_BYTES else ""
            elif read >= LEAST_BYTES:
                last = len(run) if read == len(data) else at + -(-read * 4 // 3)
                reach[at % 4] = last
                yield int(place[at]), m.end() if last == len(run) else int(place[last - 1]) + 1, b"", new


def _escaped(m: re.Match) -> str | None:
    code = m[0]
    try:
        if code[:2] == "\\x":
            return readable(bytes.fromhex(code.replace("\\x", "")))
        if code[:2] == "\\u":
            points = [int(x, 16) for x in code.split("\\u")[1:]]
            return b"".join(p.to_bytes(2, "big") for p in points).decode("utf-16-be")
        if code[:2] == "\\U":
            number = int(code[2:], 16)
        else:
            number = int(code[3:-1], 16) if code[2] in "xX" else int(code[2:-1])
        return chr(number).encode().decode()
    except (ValueError, OverflowError):
        return None


def opened(layer: Layer) -> Iterator[Layer]:
    """The layers directly below one, made one at a time."""
    text = layer.text
    bytes_in: list[tuple[int, int, bytes]] = []
    if "%" in text:
        parts = []
        for m in URL.finditer(text):
            data = bytes.fromhex(m[0].replace("%", ""))
            if (new := readable(data)) is not None:
                parts.append((m.start(), m.end(), new))
            else:
                bytes_in.append((m.start(), m.end(), data))
        if parts:
            yield layer.replaced(parts)
    if "\\" in text or "&#" in text:
        parts = []
        for m in UNICODE.finditer(text):
            if (new := _escaped(m)) is not None:
                parts.append((m.start(), m.end(), new))
            elif m[0].startswith("\\x"):
                bytes_in.append((m.start(), m.end(), bytes.fromhex(m[0].replace("\\x", ""))))
        if parts:
            yield layer.replaced(parts)
    for pattern, table in ((BASE64, None), (BASE64_URL, str.maketrans("-_", "+/"))):
        for a, b, data, new in base64_in(text, pattern, table):
            if new:
                yield layer.region(a, b, new)
            if data and (not new or readable(data) is None):
                bytes_in.append((a, b, data))
    for a, b, data in bytes_in:
        if (new := readable(data)) is not None:
            yield layer.region(a, b, new)
        else:
            for new in unpacked(data):
                yield layer.region(a, b, new)


def find_secrets(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, found in the text itself) of all finds in order."""
    base = set(scan(text))
    found = set(base)
    seen = {hashlib.sha256(text.encode("utf-8", "replace")).digest()}
    work = [opened(Layer(text))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        # A layer is the same if its text is and if it stands for the same place.
        key = layer.text.encode("utf-8", "replace") + b"%d:%d" % layer.place(0, len(layer.text))
        digest = hashlib.sha256(key).digest()
        if digest not in seen:
            seen.add(digest)
            for start, kind, end in scan(layer.text):
                low, high = layer.place(start, end)
                found.add((low, kind, high))
            work.append(opened(layer))
    return [(*span, span in base) for span in sorted(found)]


def redacted(text: str, spans: list[tuple[int, int, int, bool]], mark: str) -> str:
    """The text with each stretch that spans cover put as ``mark``."""
    out, reach = [], 0
    for start, _, end, _ in spans:
        if start >= reach:
            out += [text[reach:start], mark]
        reach = max(reach, end)
    return "".join(out) + text[reach:]


def secret_spans(docs: DataFrame, mark: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: (doc_id, spans), and with ``mark`` the text without them as ``clean``.

    ``spans`` holds (kind, start, end, base) in code points, end exclusive, ordered by start, kind (assign, access,
    hex) and end; ``base`` tells finds in the text itself from those in decoded layers. ``clean`` is null where
    nothing was found. Layers are read whole, however long.

    One pass without a shuffle. Null texts count as empty and have no spans; repeated rows stay as they are; an
    empty table gives no rows; other columns are not read. Bytes that decode to no text are no layer.
    """

    def work(part: pa.RecordBatch, texts: list[str]) -> dict:
        got = [find_secrets(t) for t in texts]
        spans = [[{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in found] for found in got]
        kind = pa.list_(pa.struct({"kind": pa.string(), "start": pa.int64(), "end": pa.int64(), "base": pa.bool_()}))
        out = {"doc_id": part.column("doc_id"), "spans": pa.array(spans, kind)}
        if mark is not None:
            clean = [redacted(t, found, mark) if found else None for t, found in zip(texts, got)]
            out["clean"] = pa.array(clean, pa.string())
        return out

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
    return map_runs(texts_of(docs, id_col, text_col), work, schema + (", clean string" if mark is not None else ""))


def redacted_documents(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with each stretch of secrets put as ``mark``, and its size in ``size_col`` if there is such a column.

    Rows without a find, null texts among them, stay as they are.
    """
    at = docs.columns.index(text_col)
    size = docs.columns.index(size_col) if size_col in docs.columns else None

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in runs(batch, text_col):
                found = [find_secrets(t) if t else [] for t in texts]
                if any(found):
                    columns = part.columns
                    columns[at] = pa.array([redacted(t, f, mark) if f else t for t, f in zip(texts, found)], columns[at].type)
                    if size is not None:
                        old = columns[size].to_pylist()
                        new = [len(t) if f else n for t, f, n in zip(columns[at].to_pylist(), found, old)]
                        columns[size] = pa.array(new, columns[size].type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    return docs.mapInArrow(work, docs.schema)


def digests(spans: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""

    def joined(part):
        return F.array_join(F.transform(part, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    digest = F.sha2(joined(base).cast("binary"), 256).alias("base_sha256")
    return spans.select("doc_id", *counts, digest, joined(F.col("spans")).alias("spans"))
