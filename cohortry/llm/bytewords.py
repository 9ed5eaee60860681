"""Words and rolling hashes of whole Arrow text batches, on bytes and without a loop over rows.

Hashes are polynomial modulo 2**64 over random byte codes, finished by a mixing step. Word hashes depend on the bytes of the word alone,
so they agree between tasks and machines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240229)
CODES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets between them; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(texts) else (data[:0], np.zeros(1, np.int64))


def slices(batches, text: str, limit: int = 1 << 21):
    """Cut record batches into runs of rows whose texts hold at most ``limit`` bytes together, or one longer text."""
    for batch in batches:
        sizes = batch.column(text).cast(pa.large_binary())
        ends = np.cumsum(np.nan_to_num(np.asarray(pa.compute.binary_length(sizes).fill_null(0)))) if batch.num_rows else np.zeros(0, np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


class Rolling:
    """Hash of any byte range of a buffer in constant time."""

    def __init__(self, data: np.ndarray, codes: np.ndarray = CODES, base: np.uint64 = BASE, inverse: np.uint64 = INVERSE):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes[data] * powers(base, n)[:n], out=self.sums[1:])
        self.back = powers(inverse, n)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of [start, end)."""
        return mix(self.raw(start, end) ^ (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words before it (n + 1 values)."""
    n = len(data)
    inside = ~separators[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= separators[data[:-1]] | cut[1:n]
        last[:-1] &= separators[data[1:]] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers starts[i] … starts[i] + counts[i] − 1, one run after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    begins = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(begins - starts, counts)
