"""Alignment of the tokens that two tokenizers give for the same text, and corpus-wide counts of the id pairs that end together.

Both sides are read as byte ranges of the text with one space before it: side A is a byte-level vocabulary, side B a piece vocabulary with
byte fallback (which puts that space there itself). In each batch, ``pandas.merge_asof`` keyed by document finds for each token start the
other side's covering token, in both directions; the union of both are all overlaps. Overlapping tokens whose ranges end together are
*links*; their ends cut both sides into groups.

Side A's ids come from a merger with the vocabulary's own ranks and word pattern, which is several times as fast as its library; texts with
signs outside Latin scripts go to the library itself. Long texts are cut into segments at blanks between visible signs, where both sides
cut too (no piece holds a blank after another sign), so memory does not grow with them unless they have no such blank.

A text that is null or empty, or that one side does not give back byte for byte (a normalised sign), has no tokens: zeros and an empty
digest. Rows with equal or null ids count each by itself. Strings of special tokens are plain text. Columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import slices
from .store import pick, saved, small_batches
from .wordpieces import byte_letters

#: Characters of a segment, and of the segments that are aligned together.
SEGMENT, TOGETHER = 1 << 18, 1 << 19
CUT = regex.compile("(?<=[!-~]) (?=[!-~])")
#: Signs whose classes are the same in every version of the character tables.
PLAIN = regex.compile("[\t\n\r -~¡-ɏ]*")
#: Fixed value: the word pattern of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"
#: Pairs up to which the table of counts is sent to every machine (17 bytes each); beyond it the counts are joined by shuffle.
SENT_PAIRS = 2_000_000


class Side:
    """``encode(segment)`` gives the packed 32-bit ids of a segment that begins with a space, or None; ``sizes`` the bytes of each id."""

    raw: list[bytes]
    sizes: np.ndarray

    def packed(self, ids: list[int], text: str) -> bytes | None:
        """The ids, if their bytes joined are the text."""
        return np.array(ids, "<u4").tobytes() if b"".join(map(self.raw.__getitem__, ids)) == text.encode() else None


class ByteLevel(Side):
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        letters = byte_letters()
        ids = {bytes(letters[c] for c in piece): i for piece, i in self.library.get_vocab(with_added_tokens=False).items()}
        self.raw = sorted(ids, key=ids.get)
        self.sizes = np.array(list(map(len, self.raw)))
        self.merger = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ids, special_tokens={})

    def encode(self, segment: str) -> bytes | None:
        if PLAIN.fullmatch(segment):
            return np.array(self.merger.encode_ordinary(segment), "<u4").tobytes()  # merged bytes are the text's
        return self.packed(self.library.encode(segment, add_special_tokens=False).ids, segment)


class Pieces(Side):
    def __init__(self, path: str):
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.raw = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array(list(map(len, self.raw)))

    def encode(self, segment: str) -> bytes | None:
        return self.packed(self.library.encode(segment[1:], num_threads=1), segment)


@lru_cache(maxsize=4)
def side(kind: type, path: str) -> Side:
    return kind(path)


def segments(text: str):
    """The text with a space before it, cut before blanks that both sides cut at."""
    text, at = " " + text, 0
    while len(text) - at > SEGMENT:
        cut = CUT.search(text, at + SEGMENT)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def overlaps(a_start: np.ndarray, a_doc: np.ndarray, b_start: np.ndarray, b_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (a, b) of all overlapping tokens; starts run on over the documents, so both sides are sorted by them."""
    left = pd.DataFrame({"at": a_start, "doc": a_doc, "a": np.arange(len(a_start))})
    right = pd.DataFrame({"at": b_start, "doc": b_doc, "b": np.arange(len(b_start))})
    forth = pd.merge_asof(left, right, on="at", by="doc")
    back = pd.merge_asof(right, left, on="at", by="doc")
    b, a = back["b"].to_numpy(), back["a"].to_numpy()
    new = b_start != a_start[a]  # tokens that start together are found both ways
    return np.concatenate([forth["a"].to_numpy(), a[new]]), np.concatenate([forth["b"].to_numpy(), b[new]])


@lru_cache(maxsize=2)
def decimals(n: int) -> np.ndarray:
    """Decimal ids followed by each of the marks, for all ids below n."""
    return np.array([b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(n)], object)


def align(a: list[bytes], b: list[bytes], a_side: Side, b_side: Side) -> dict[str, np.ndarray | list]:
    """Counts, group text, links (id pairs) and overlaps of documents given by their packed ids."""
    n = len(a)
    a_ids, b_ids = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (a, b))
    a_counts, b_counts = (np.array([len(x) // 4 for x in y], np.int64) for y in (a, b))
    a_doc, b_doc = np.repeat(np.arange(n), a_counts), np.repeat(np.arange(n), b_counts)
    a_end, b_end = np.cumsum(a_side.sizes[a_ids]), np.cumsum(b_side.sizes[b_ids])
    over_a, over_b = overlaps(a_end - a_side.sizes[a_ids], a_doc, b_end - b_side.sizes[b_ids], b_doc)
    together = a_end[over_a] == b_end[over_b]
    link_a, link_b = over_a[together], over_b[together]
    order = np.argsort(link_a, kind="stable")
    link_a, link_b = link_a[order], link_b[order]
    cuts = a_end[link_a]
    # place of each token in the text of the groups: A's tokens of a group, then B's
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    a_size, b_size = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
    before = np.cumsum(a_size + b_size) - a_size - b_size
    width = max(len(a_side.sizes), len(b_side.sizes))
    a_mark, b_mark = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
    a_mark[link_a], b_mark[link_b] = 1, 2
    shown, table = np.empty(len(a_ids) + len(b_ids), object), decimals(width)
    shown[np.arange(len(a_ids)) - (np.cumsum(a_size) - a_size)[a_group] + before[a_group]] = table[a_ids + width * a_mark]
    shown[np.arange(len(b_ids)) - (np.cumsum(b_size) - b_size)[b_group] + (before + a_size)[b_group]] = table[b_ids + width * b_mark]
    ends, tokens = np.cumsum(a_counts + b_counts), a_counts + b_counts
    texts = [b"".join(shown[e - k : e].tolist()) for e, k in zip(ends.tolist(), tokens.tolist(), strict=True)]
    links = np.bincount(a_doc[link_a], minlength=n)
    return {
        "n_a": a_counts, "n_b": b_counts, "n_links": links, "groups": texts, "pairs": a_ids[link_a] * len(b_side.sizes) + b_ids[link_b],
        "overlaps": (over_a, over_b, a_doc[over_a]), "ends": (a_end, b_end),
    }


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """One row per document: row, id, n_a, n_b, n_groups, n_links, groups_sha256, n_overlaps, pairs (A id times the size of B's vocabulary plus B id, per link)."""
    rows = pick(docs, id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())
    small = len(side(ByteLevel, a_path).sizes) * len(side(Pieces, b_path).sizes) < 1 << 31

    def run(batches):
        a_side, b_side = side(ByteLevel, a_path), side(Pieces, b_path)
        for batch in slices(batches, "text", 1 << 20):
            n = batch.num_rows
            sums, lost = np.zeros((n, 4), np.int64), np.zeros(n, bool)
            digests, pairs = [None] * n, [[] for _ in range(n)]
            waiting, size = [], 0

            def settle():
                owner, coded = [w[0] for w in waiting], [w[1:] for w in waiting]
                waiting.clear()
                if not owner:
                    return
                found = align(*map(list, zip(*coded, strict=True)), a_side, b_side)
                over = np.bincount(found["overlaps"][2], minlength=len(owner))
                cuts = np.cumsum(found["n_links"])
                for k, i in enumerate(owner):
                    sums[i] += (found["n_a"][k], found["n_b"][k], found["n_links"][k], over[k])
                    text = found["groups"][k]
                    if digests[i] is None:
                        digests[i] = hashlib.sha256()
                    else:
                        digests[i].update(b";")
                    digests[i].update(text[:-1])  # without the mark after the last group
                    pairs[i].append(found["pairs"][cuts[k] - found["n_links"][k] : cuts[k]])

            for i, text in enumerate(batch.column("text").to_pylist()):
                for part in segments(text) if text else ():
                    a, b = a_side.encode(part), b_side.encode(part)
                    if a is None or b is None:
                        lost[i] = True
                        break
                    waiting.append((i, a, b))
                    size += len(part)
                    if size > TOGETHER:
                        settle()
                        size = 0
            settle()
            sums[lost] = 0
            listed = [np.concatenate(p) if p and not gone else np.zeros(0, np.int64) for p, gone in zip(pairs, lost, strict=True)]
            offsets = np.append(0, np.cumsum([len(p) for p in listed])).astype(np.int32)
            out = {c: batch.column(c) for c in ("row", "id")}
            out |= {"n_a": sums[:, 0], "n_b": sums[:, 1], "n_groups": sums[:, 2], "n_links": sums[:, 2], "n_overlaps": sums[:, 3]}
            out["groups_sha256"] = ["" if gone or d is None else d.hexdigest() for d, gone in zip(digests, lost, strict=True)]
            out["pairs"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(listed), pa.int32() if small else pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_overlaps"))
    return rows.mapInArrow(run, f"row long, id {kind}, {counts}, groups_sha256 string, pairs array<{'int' if small else 'long'}>")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n): occurrences of each linked id pair in all documents, combined in each task first."""

    def run(batches):
        values, counts, fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merged():
            every = np.concatenate([values, *fresh])
            ones = np.concatenate([counts, np.ones(len(every) - len(values), np.int64)])
            kinds, place = np.unique(every, return_inverse=True)
            return kinds, np.bincount(place, ones, len(kinds)).astype(np.int64)

        for batch in batches:
            fresh.append(batch.column("pairs").flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            if sum(map(len, fresh)) > 2_000_000:
                values, counts = merged()
                fresh.clear()
                if len(values) > 4_000_000:  # bounded memory: the shuffle adds the rest
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["pair", "n"])
                    values = counts = np.zeros(0, np.int64)
        values, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["pair", "n"])

    return found.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_sums(found: DataFrame, ranked: DataFrame, sent: int = SENT_PAIRS) -> DataFrame:
    """The rows of ``found`` with n_best and count_sum; ``ranked``: (pair, n, best). Up to ``sent`` pairs are broadcast, more are joined."""
    keep = [c for c in found.columns if c != "pairs"]
    if ranked.count() > sent:
        links = found.select("row", F.explode("pairs").alias("pair")).groupBy("row", "pair").agg(F.count(F.lit(1)).alias("k"))
        links = links.join(ranked, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k"))).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
        return found.select(*keep).join(links, "row", "left").na.fill(0, ["n_best", "count_sum"])
    table = ranked.toArrow().sort_by("pair")
    shared = found.sparkSession.sparkContext.broadcast((table["pair"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy()))

    def run(batches):
        pairs, n, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            sizes = np.asarray(pa.compute.list_value_length(lists))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.searchsorted(pairs, lists.flatten().to_numpy(zero_copy_only=False))
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row, best[at].astype(np.int64))
            np.add.at(sums[1], row, n[at])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(sums[0]), pa.array(sums[1])], names=[*keep, "n_best", "count_sum"])

    schema = ", ".join(f"`{c}` {dict(found.dtypes)[c]}" for c in keep)
    return found.mapInArrow(run, f"{schema}, n_best long, count_sum long")


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, sent: int = SENT_PAIRS) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, n_best, count_sum."""
    with small_batches(docs.sparkSession):
        found = saved(aligned(docs, a_path, b_path, id_col, text_col), "aligned")
        counts = saved(pair_counts(found), "pairs")
    counts = counts.withColumn("b", F.col("pair") % len(side(Pieces, b_path).sizes))
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    ranked = counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    return link_sums(found, saved(ranked, "ranked"), sent).drop("row")
