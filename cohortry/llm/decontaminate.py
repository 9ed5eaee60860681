"""Benchmark passages in documents, by SimHash of item-sized windows and exact weighted shingle similarity.

Every item has a window class: the largest of a geometric row of sizes up to ``PART`` of its words. All windows of that size of the item
are fingerprinted (64 votes of its words' hashes); documents are fingerprinted for each size in use at every ``stride``-th word. An
unchanged run of half an item thus holds a document window that equals an item window; windows with small changes stay near it. The
fingerprints are cut in four blocks of 16 bits: two that differ in at most three bits agree in a block, so tables by block give all
fingerprints within that radius. Each hit aligns the item with a stretch of the document as long as the item and a quarter around. The
share of the item's 5-word shingles found there, weighted by their bytes, is its similarity; 0.8 or more is reported.

Words are runs of ASCII letters (case folded) and digits and of all bytes beyond ASCII. Items shorter than five words must stand whole.
Null or wordless items are never found and null texts hold none. Rows with equal or null ids are reported each. The benchmark is read in
passes of at most about ``PASS_BYTES`` of text, which bounds what a task holds; documents are scanned whole in each pass.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import LOWER, NOT_WORD, Rolling, mix, ranges, slices, text_bytes, word_spans
from .store import pick

PART = 0.4
RADIUS = 3
WIDTH = 5
THRESHOLD = 0.8
PASS_BYTES = 16 << 20
SLICE = 1 << 19


def size_classes(longest: int) -> list[int]:
    sizes = [1]
    while sizes[-1] < longest:
        sizes.append(max(sizes[-1] + 1, int(sizes[-1] * 1.25)))
    return sizes


def stride(size: int) -> int:
    return max(1, size // 4)


class Words:
    """Hashes of the words of a run of texts, their shingles and window fingerprints."""

    def __init__(self, texts: pa.Array, longest: int = 1 << 16):
        data, offsets = text_bytes(texts)
        data = LOWER[data]
        starts, ends, self.before = word_spans(data, offsets, NOT_WORD)
        self.words = Rolling(data).of(starts, ends)
        self.bytes = ends - starts
        bits = np.unpackbits(self.words.view(np.uint8).reshape(-1, 8), axis=1) if len(starts) else np.zeros((0, 64), np.uint8)
        # Running votes, several to a 64-bit number. They may carry into each other; the difference over a window is that of whole
        # numbers, so it holds the window's votes side by side, none of them above the window's size.
        self.kind = np.uint8 if longest < 1 << 8 else np.uint16 if longest < 1 << 16 else np.uint32
        votes = bits.astype(self.kind, copy=False).view(np.uint64)
        self.votes = np.zeros((len(starts) + 1, votes.shape[1]), np.uint64)
        np.cumsum(votes, axis=0, out=self.votes[1:])

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and bytes of the shingle that starts at each word, across text borders too."""
        n = max(0, len(self.words) - width + 1)
        hashes, size = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        for k in range(width):
            hashes = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + self.words[k : n + k] + np.uint64(k + 1))
            size += self.bytes[k : n + k]
        return hashes, size

    def windows(self, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and fingerprint of every ``step``-th window of the texts."""
        counts = np.maximum(0, (np.diff(self.before) - size) // step + 1)
        counts[np.diff(self.before) < size] = 0
        text = np.repeat(np.arange(len(counts)), counts)
        first = self.before[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
        ones = (self.votes[first + size] - self.votes[first]).view(self.kind)
        prints = np.packbits(ones > size // 2, axis=1).view(np.uint64).ravel() if len(first) else np.zeros(0, np.uint64)
        return text, first, prints


class Index:
    """Fingerprints of the items by size class, with a table for each 16-bit block, and the items' weighted shingles."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        self.n_words = np.diff(words.before)
        self.items = []
        for i, n in enumerate(self.n_words):
            width, at = min(WIDTH, max(1, n)), words.before[i]
            hashes, size = Words(texts.slice(i, 1)).shingles(width)
            self.items.append((width, hashes, size))
        longest = int(self.n_words.max(initial=0))
        classes = np.array(size_classes(max(1, longest)))
        of = np.searchsorted(classes, np.maximum(1, self.n_words * PART), "right") - 1
        self.classes = {}
        text_list = np.arange(len(self.n_words))
        for c in np.unique(of[self.n_words > 0]):
            size = int(classes[c])
            text, first, prints = words.windows(size, 1)
            mine = (of == c)[text]
            text, first, prints = text_list[text[mine]], first[mine], prints[mine]
            offset = first - words.before[:-1][text]
            tables = []
            for b in range(4):
                block = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                cuts = np.searchsorted(block[order], np.arange((1 << 16) + 1))
                tables.append((order, cuts, cuts[1:] > cuts[:-1]))
            self.classes[size] = (text, offset, prints, tables)

    def hits(self, words: Words):
        """(text, item, first word of the aligned item) of all windows within the radius."""
        found = []
        for size, (item, offset, prints, tables) in self.classes.items():
            text, first, own = words.windows(size, stride(size))
            blocks = own.astype("<u8").view("<u2").reshape(-1, 4)
            for b, (order, cuts, used) in enumerate(tables):
                some = np.flatnonzero(used[blocks[:, b]])
                block = blocks[some, b].astype(np.int64)
                counts = cuts[block + 1] - cuts[block]
                window = np.repeat(some, counts)
                entry = order[ranges(cuts[block], counts)]
                near = np.bitwise_count(own[window] ^ prints[entry]) <= RADIUS
                window, entry = window[near], entry[near]
                found.append(np.stack([text[window], item[entry], first[window] - offset[entry]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def verified(self, texts: pa.Array):
        """Best place of each found item of each text: text, item, first word in the text, similarity, number of places."""
        words = Words(texts, max(self.classes, default=1))
        cache: dict[int, np.ndarray] = {}
        best: dict[tuple[int, int], list] = {}
        for text, item, start in self.hits(words).tolist():
            width, hashes, size = self.items[item]
            n, low, high = int(self.n_words[item]), int(words.before[text]), int(words.before[text + 1])
            around = n // 4
            a, z = max(low, start - around), min(high, start + n + around)
            if z - a < width:
                continue
            if width not in cache:
                cache[width] = words.shingles(width)[0]
            there = np.isin(hashes, cache[width][a : z - width + 1])
            similarity = float(size[there].sum() / max(1, size.sum()))
            if similarity >= THRESHOLD:
                old = best.get((text, item))
                if old is None:
                    best[text, item] = [max(low, start) - low, similarity, 1]
                else:
                    old[2] += start - low > old[0] + n // 2
                    if similarity > old[1]:
                        old[:2] = [max(low, start) - low, similarity]
        return [(t, i, *v) for (t, i), v in sorted(best.items())]


_INDEXES: dict[str, Index] = {}


def _index(token: str, texts) -> Index:
    """One index per worker process and pass."""
    if token not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[token] = Index(pa.array(texts.value, pa.string()))
    return _INDEXES[token]


def passes(items: DataFrame, item_col: str, item_text_col: str):
    """The benchmark in shares of at most about ``PASS_BYTES``: (broadcast ids, broadcast texts, name of the share)."""
    context = items.sparkSession.sparkContext
    bench = pick(items, item=item_col, text=item_text_col).where("item is not null and text is not null")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // PASS_BYTES))
    for k in range(n):
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).orderBy("item", "text").collect()
        yield context.broadcast([r["item"] for r in part]), context.broadcast([r["text"] for r in part]), uuid.uuid4().hex


def leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """One row per document row and benchmark item in it: id, item, similarity, first word, words of the item."""
    rows, out = pick(docs, id=id_col, text=text_col), None
    kind, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType
    for names, texts, token in passes(items, item_col, item_text_col):

        def run(batches, names=names, texts=texts, token=token):
            index = _index(token, texts)
            for batch in slices(batches, "text", SLICE):
                found = index.verified(batch.column("text"))
                ids = batch.column("id").take(pa.array([f[0] for f in found], pa.int64()))
                item = pa.array([names.value[f[1]] for f in found], ARROW.get(item_type.typeName()))
                numbers = [pa.array([f[2] for f in found], pa.int64()), pa.array([int(index.n_words[f[1]]) for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([ids, item, pa.array([f[3] for f in found], pa.float64()), *numbers], names=["id", "item", "similarity", "first_word", "n_words"])

        one = rows.mapInArrow(run, f"id {kind}, item {item_type.simpleString()}, similarity double, first_word long, n_words long")
        out = one if out is None else out.union(one)
    return out


def clean(docs: DataFrame, text_col: str, items: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """The rows, with all their columns, that hold no benchmark item."""
    for _, texts, token in passes(items, item_col, item_text_col):

        def run(batches, texts=texts, token=token):
            index = _index(token, texts)
            for batch in slices(batches, text_col, SLICE):
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in index.verified(batch.column(text_col))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


ARROW = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "short": pa.int16()}
