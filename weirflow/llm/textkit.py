"""Vectorised text primitives shared by the corpus operators.

A *word* is a maximal run of ASCII letters, digits or non-ASCII characters of
the lower-cased text; everything else separates words. The same words come out
of SQL as ``regexp_extract_all(lower(text), WORD_RE)``.

All functions work on Arrow string arrays through their byte buffers, in slices
of bounded size, so that a worker's memory follows the slice and the longest
single text but not the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE_BYTES = 1 << 19


def _return_memory() -> None:
    """Large arrays go back to the system when freed: workers live on between tasks, beside a JVM that needs the room."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD, fixed
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


_return_memory()

_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _r in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz"):
    _WORD[list(_r)] = True

_UPPER = np.zeros(256, bool)
_UPPER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_pow = _inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, SLICE_BYTES + (1 << 17))
        _pow = np.concatenate([np.ones(1, np.uint64), np.full(n, _P)]).cumprod(dtype=np.uint64)
        _inv = np.concatenate([np.ones(1, np.uint64), np.full(n, _P_INV)]).cumprod(dtype=np.uint64)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    arr = pc.fill_null(arr, "") if arr.null_count else arr
    if pa.types.is_string(arr.type) or pa.types.is_binary(arr.type):
        kind = np.int32
    else:
        kind = np.int64
    _, off, data = arr.buffers()
    if len(arr) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that a slice holds about ``most`` bytes of text, or one row."""
    for b in batches:
        if b.num_rows == 0:
            continue
        n = pc.binary_length(b.column(b.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(n + 8)
        at = 0
        while at < b.num_rows:
            base = end[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(end, base + most, "right")))
            yield b.slice(at, to - at)
            at = to


def span_hash(raw: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives the 64-bit hash of each span (start, end) of the bytes."""
    pw, inv = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * pw[: len(raw)], dtype=np.uint64, out=sums[1:])
    return lambda start, end: mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))


class Words:
    """Words of a slice of texts: ``doc`` row of each, byte span, ``first`` word
    index of each row (length rows + 1) and 64-bit ``hash`` of each word."""

    def __init__(self, arr: pa.Array, hashed: bool = True, any_case: bool = False):
        """any_case: the same words, as spans of the text as it is and not of its lower-cased form."""
        arr = pc.fill_null(arr, "") if arr.null_count else arr
        self.raw, self.off = buffers(arr if any_case else pc.utf8_lower(arr))
        raw, off = self.raw, self.off
        n = len(raw)
        isw = (_WORD | _UPPER if any_case else _WORD)[raw]
        before = np.zeros(n + 1, bool)
        before[1:] = isw
        before[off] = False  # a word never spans two texts
        after = np.zeros(n + 1, bool)
        after[:n] = isw
        after[off] = False
        self.start = np.flatnonzero(isw & ~before[:n])
        self.end = np.flatnonzero(isw & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, off)
        if hashed:
            self._hashed = span_hash(raw)
            self.hash = self._hashed(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._hashed(start, end)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def ngram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n-1 entries run past the end and are to be dropped."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * _Q + h[k : k + m]
    return mix(out)


def pieces(bucket: np.ndarray, n: int, **cols: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows grouped by bucket, each group packed column after column into one binary value.

    One wide row for each bucket instead of a narrow row for each element keeps
    row-by-row conversion out of the shuffle."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    edge = np.flatnonzero(np.diff(b)) + 1
    lo = np.concatenate([[0], edge]) if len(b) else []
    hi = np.concatenate([edge, [len(b)]]) if len(b) else []
    cols = {k: v[order] for k, v in cols.items()}
    for x, y in zip(lo, hi):
        yield int(b[x]), np.int64(y - x).tobytes() + b"".join(v[x:y].tobytes() for v in cols.values())


def unpack(payloads: list[bytes], dtypes: list) -> list[np.ndarray]:
    """The columns of ``pieces``, concatenated over payloads."""
    parts: list[list[np.ndarray]] = [[] for _ in dtypes]
    for p in payloads:
        n, at = int(np.frombuffer(p, np.int64, 1)[0]), 8
        for k, d in enumerate(dtypes):
            parts[k].append(np.frombuffer(p, d, n, at))
            at += n * np.dtype(d).itemsize
    return [np.concatenate(x) if x else np.zeros(0, d) for x, d in zip(parts, dtypes)]
