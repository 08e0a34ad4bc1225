"""Word and window hashes of many texts at once, for tasks that see Arrow batches.

Words are runs of bytes outside [\\x20\\x09-\\x0D]. A word's hash is a polynomial
of its bytes modulo 2**64, taken from running sums, so it does not depend on
where the word stands; windows of words are hashed by a linear combination of
word hashes, mixed. Work goes over slices of a bounded number of words, so
memory follows the batch, not the longest text times a factor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)

_RNG = np.random.default_rng(20240607)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WINDOW = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at once.
SLICE = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE, 1 << int(n).bit_length())
    if size not in _POWERS:
        if size > SLICE:
            return tuple(np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, _INVERSE))
        _POWERS[size] = tuple(np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, _INVERSE))
    return _POWERS[size]


class Words:
    """The words of a batch: ``hash`` of each, ``start`` and ``end`` bytes in
    ``data``, and ``doc``: where each text's words begin (one more entry than texts)."""

    def __init__(self, texts: pa.Array):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        buffers, n, off = texts.buffers(), len(texts), texts.offset
        bounds = np.frombuffer(buffers[1], np.int64)[off:off + n + 1]
        first = int(bounds[0]) if n else 0
        raw = np.frombuffer(buffers[2], np.uint8) if n and buffers[2] is not None else np.zeros(0, np.uint8)
        self.data = raw[first:int(bounds[-1])] if n else raw[:0]
        bounds = bounds - first
        size = len(self.data)
        if not size:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash, self.doc = np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
            return
        inside = ~_SPACE[self.data]
        cut = np.zeros(size + 1, bool)
        cut[bounds] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | cut[1:size]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | cut[1:size]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(self.start, bounds)
        self.hash = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(self.start):
            a = int(self.start[at])
            to = max(at + 1, int(np.searchsorted(self.end, a + SLICE, "right")))
            b = int(self.end[to - 1])
            power, inverse = _powers(b - a)
            sums = np.empty(b - a + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_TABLE[self.data[a:b]] * power[:b - a], out=sums[1:])
            s, e = self.start[at:to] - a, self.end[at:to] - a
            self.hash[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
            at = to

    def counts(self) -> np.ndarray:
        return np.diff(self.doc)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window of ``width`` words that starts at each word, and
        whether it lies inside its text."""
        n = len(self.hash)
        out = np.zeros(n, np.uint64)
        for k in range(min(width, n)):
            out[:n - k] += self.hash[k:] * _WINDOW[k]
        whole = np.zeros(n, bool)
        if n:
            last = np.repeat(self.doc[1:], self.counts())
            whole = np.arange(n) + width <= last
        return mix(out), whole

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of all texts in a row, and where each text's begin. A
        text of fewer words than ``width`` has one shingle of all its words."""
        hashes, whole = self.windows(width)
        counts = self.counts()
        short = np.flatnonzero((counts > 0) & (counts < width))
        for d in short:
            a, b = self.doc[d], self.doc[d + 1]
            hashes[a] = mix(np.array([(self.hash[a:b] * _WINDOW[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))[0]
            whole[a] = True
        per = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
        return hashes[whole], np.concatenate([[0], np.cumsum(per)]).astype(np.int64)


def multipliers(k: int) -> np.ndarray:
    """Odd factors of the ``k`` MinHash functions."""
    return np.random.default_rng(7).integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1)


def minhash(hashes: np.ndarray, starts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """uint32 matrix (segments, functions): the least value of each function in
    each segment; segments must not be empty."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), len(factors)), np.uint32)
    for j, f in enumerate(factors):
        out[:, j] = np.minimum.reduceat(low * f, starts) if len(starts) else 0
    return out


def slices(batch: pa.RecordBatch, column: int, size: int = 4 << 20):
    """``batch`` in runs of rows with about ``size`` bytes of text each."""
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at, n = np.cumsum(lengths), 0, len(lengths)
    while at < n:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, to - at)
        at = to
