"""Hashes of the words of many texts at once, and arrays packed for shuffles."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2_000_000)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        steps = [np.append(np.uint64(1), np.full(size - 1, x, np.uint64)) for x in (_ODD, inverse)]
        _POWERS[:] = [np.cumprod(s, dtype=np.uint64) for s in steps]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_hashes(texts: list[str], outside: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word in order, number of words of each text).

    Words are runs of anything but ASCII white space, with A-Z in lower case; ``outside`` tells for each byte whether
    it is no part of a word (line feed must be). A word's hash is a polynomial in its bytes, read from one running sum
    over all texts, and mixed.
    """
    data = [t.encode("utf-8", "replace").lower() for t in texts]
    flat = np.frombuffer(b"\n" + b"\n".join(data) + b"\n", np.uint8)
    power, inverse = _powers(len(flat) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[flat] * power[: len(flat)], dtype=np.uint64)])
    blank = outside[flat]
    edge = np.flatnonzero(blank[:-1] != blank[1:]) + 1
    start, end = edge[0::2], edge[1::2]
    word = mix((total[end] - total[start]) * inverse[start])
    starts = np.cumsum([1] + [len(d) + 1 for d in data])
    return word, np.diff(np.searchsorted(start, starts))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one value: byte planes, compressed. Sorted integers are best given as differences."""
    import zstandard

    out = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
        kind = a.dtype.str.encode().ljust(4)
        body = zstandard.ZstdCompressor(level=1).compress(planes)
        out += [kind, len(a).to_bytes(8, "little"), len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    out, at = [], 2
    for _ in range(int.from_bytes(data[:2], "little")):
        kind = np.dtype(data[at : at + 4].decode().strip())
        n, size = (int.from_bytes(data[at + k : at + k + 8], "little") for k in (4, 12))
        planes = zstandard.ZstdDecompressor().decompress(data[at + 20 : at + 20 + size], max_output_size=max(1, n * kind.itemsize))
        out.append(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n) if n else np.empty(0, kind))
        at += 20 + size
    return out


def differences(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def small(a: np.ndarray) -> np.ndarray:
    """Counts in the least unsigned type that holds them."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 2**32 else np.uint64)
