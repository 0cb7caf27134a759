"""Vectorised text kernels shared by the corpus operators.

Texts arrive as Arrow batches, are joined into one byte buffer and cut into
words with NumPy; nothing here loops over words.  A word is a maximal run of
bytes other than 0x20 and 0x09-0x0D, so byte positions and code points agree
on word boundaries.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 19
_BITS = 14
_BLOCK = 1 << _BITS

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CONT = np.zeros(256, bool)
_CONT[0x80:0xC0] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if n <= 2 * PIECE_BYTES:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits (constants of the public SplitMix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of a list of byte strings.

    buf: all texts, each followed by one newline; first: start of each text
    (one more entry than texts); start, end: each word's bytes; doc: each
    word's text.  lower folds A-Z only.  keep marks the bytes that belong to
    words, all but blanks unless given.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, keep: np.ndarray | None = None):
        joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.buf = _LOWER[joined] if lower else joined
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        inside = ~_SPACE[self.buf] if keep is None else keep[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.first, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.count)])  # each text's first word

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each byte range (of the words, if none are given)."""
        start, end = (self.start, self.end) if start is None else (start, end)
        n = len(self.buf)
        total = np.zeros(n + 1, np.uint64)
        near, far = _powers(_BASE, _BLOCK), _powers(pow(_BASE, _BLOCK, 1 << 64), (n >> _BITS) + 1)
        for i in range(0, n, _BLOCK):  # blocks stay in the cache
            part = self.buf[i : i + _BLOCK].astype(np.uint64)
            part += np.uint64(1)
            part *= near[: len(part)]
            part *= far[i >> _BITS : (i >> _BITS) + 1]
            part[:1] += total[i : i + 1]
            np.cumsum(part, out=total[i + 1 : i + 1 + len(part)])
        near, far = _powers(_INV, _BLOCK), _powers(pow(_INV, _BLOCK, 1 << 64), (n >> _BITS) + 1)
        back = near[start & (_BLOCK - 1)] * far[start >> _BITS]
        return mix((total[end] - total[start]) * back + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def per_doc(self, marks: np.ndarray) -> np.ndarray:
        """Sums of a byte-wise array for each text."""
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def points(self) -> np.ndarray:
        """Which bytes start a code point."""
        return ~_CONT[self.buf]


def grams(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows within each text, and each one's first word."""
    count = np.diff(at)
    windows = np.maximum(count - n + 1, 0)
    first = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    out = h[first].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + h[first + k])
    return out, first


def repeated(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which (doc, key) occur twice or more, and which follow an equal one."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    both = mix(keys + mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


_P = [np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges of one buffer, after the published algorithm."""
    p1, p2, p3, p4, p5 = _P
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    w8 = np.ndarray(len(buf) + 1, "<u8", pad, strides=(1,))
    w4 = np.ndarray(len(buf) + 1, "<u4", pad, strides=(1,))
    seed64 = np.uint64(seed)
    size = (end - start).astype(np.int64)
    pos = start.astype(np.int64).copy()
    h = np.full(len(start), seed64 + p5, np.uint64)
    with np.errstate(over="ignore"):
        rnd = lambda acc, x: _rotl(acc + x * p2, 31) * p1
        long = np.flatnonzero(size >= 32)
        if len(long):
            lanes = [np.full(len(long), x, np.uint64) for x in (seed64 + p1 + p2, seed64 + p2, seed64, seed64 - p1)]
            stripes, at, live = size[long] // 32, pos[long], np.arange(len(long))
            for k in range(int(stripes.max())):
                live = live[stripes[live] > k]
                for j in range(4):
                    lanes[j][live] = rnd(lanes[j][live], w8[at[live] + 32 * k + 8 * j])
            acc = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
            for lane in lanes:
                acc = (acc ^ rnd(np.uint64(0), lane)) * p1 + p4
            h[long] = acc
            pos[long] += 32 * stripes
        h += size.astype(np.uint64)
        left = end - pos
        for k in range(3):
            go = np.flatnonzero(left >= 8 * (k + 1))
            if not len(go):
                break
            h[go] = _rotl(h[go] ^ rnd(np.uint64(0), w8[pos[go] + 8 * k]), 27) * p1 + p4
        pos += left // 8 * 8
        go = np.flatnonzero(end - pos >= 4)
        if len(go):
            h[go] = _rotl(h[go] ^ (w4[pos[go]].astype(np.uint64) * p1), 23) * p2 + p3
            pos[go] += 4
        for k in range(3):
            go = np.flatnonzero(end - pos > k)
            if not len(go):
                break
            h[go] = _rotl(h[go] ^ (buf[pos[go] + k].astype(np.uint64) * p5), 11) * p1
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        h ^= h >> np.uint64(32)
    return h


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about `limit` bytes of text, with the texts (null: empty).
    After the last one memory is given back."""
    for batch in batches:
        column = batch.column(text)
        size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin, rows = 0, batch.num_rows
        while begin < rows:
            before = size[begin - 1] if begin else 0
            end = min(rows, max(begin + 1, int(np.searchsorted(size, before + limit, "right"))))
            part = batch.slice(begin, end - begin)
            yield part, [t or b"" for t in column.slice(begin, end - begin).cast(pa.binary()).to_pylist()]
            begin = end
        batch = column = part = None
    release()


def release() -> None:
    """Give freed memory back: workers wait for further tasks beside the stages
    of the JVM and would hold the batches of their last one."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def over_texts(make: Callable[[pa.RecordBatch, list[bytes]], dict], schema: pa.Schema, text: str = "text") -> Callable:
    """A mapInArrow function: make gives the output columns of a piece as a dict.
    A column doc_id has the type that it has in the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text):
            columns = make(batch, texts)
            arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for f in schema for c in [columns[f.name]]]
            at = schema.get_field_index("doc_id")
            yield pa.RecordBatch.from_arrays(arrays, schema=schema if at < 0 else schema.set(at, batch.schema.field("doc_id")))

    return run


def lists(values: np.ndarray | pa.Array, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the number for each row."""
    flat = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), flat)
