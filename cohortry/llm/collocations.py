"""The best collocations of each language, by best-first branch-and-bound growth.

A phrase's score is 1,000,000 a² / (l r) for its occurrences a and those of the two parts of its lowest-scoring cut. Growing a phrase by a
word can only lower its count, so a prefix of two words bounds every phrase grown from it: a ≤ f(w1 w2) and f(w2 w3) ≥ a give
a² / (f(w1) f(w2 w3)) ≤ f(w1 w2) / f(w1). Words that are rarer than ``least`` bound their phrases away altogether.

1. Words are counted, then pairs of frequent words. Each frequent pair has its exact score and the bound of its growth.
2. The frontier is expanded best first, each language for itself: all pairs whose bound reaches a threshold grow to the right, and all pairs
   whose own score does also to the left, which tells whether a longer phrase covers them. One pass over the texts counts all phrases
   that the new part of the frontier grows into, and no others.
3. A language is settled when as many phrases survive above its threshold as are wanted: nothing left unexpanded can reach it. Else the
   threshold falls, to the score of a pair ``MORE`` times further down, in the end to zero.

Words stand for themselves by 64-bit hashes while they are counted. Should two words of a language share one, the count starts again with
other hashes, so results are exact. Counts are combined in each task before the shuffle, by (language, words), so a language or a phrase
that fills the table is no hot group. The map side sees the frontier as a hashed bitmap of fixed size: what passes by chance is counted
exactly too, and harmless. Products are decimals of 38 digits.

Null texts are empty, null languages are ``und``. Texts may be of any length; a phrase never crosses a piece. Ties in score are ordered by
count, then by the phrase's bytes. Repeated rows count once each. Without rows there are none.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import LOWER, Rolling, mix, ranges, slices, text_bytes, word_spans
from .store import pick, saved, small_batches

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
SEPARATOR = BREAK.copy()
SEPARATOR[[9, 32]] = True
#: Bytes of text that are worked on at once, and keys that a task gathers before it sends them on.
SLICE, GATHERED = 1 << 20, 600_000
ROWS = 1 << 15
#: Size of the hashed bitmaps as a power of two (32 million bits are 4 MB).
FILTER_BITS = 25
#: A page of the engine's bitmap functions.
PAGE = 32768
MORE = 4
SCALE = 1_000_000


def codes(seed: int) -> np.ndarray:
    return np.random.default_rng(9000 + seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """Hashes of a batch's words, their languages, and which neighbours stand in one piece."""

    def __init__(self, batch: pa.RecordBatch, seed: int, mask: int):
        data, offsets = text_bytes(batch.column("text"))
        self.data = LOWER[data]
        self.starts, self.ends, before = word_spans(self.data, offsets, SEPARATOR)
        self.hashes = Rolling(self.data, codes(seed)).of(self.starts, self.ends) & np.uint64(mask)
        coded = batch.column("lang").dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
        self.lang = coded.indices.to_numpy(zero_copy_only=False)[text] if len(text) else np.zeros(0, np.int32)
        piece = np.cumsum(BREAK[self.data])[self.starts] + text if len(text) else text
        self.joined = piece[1:] == piece[:-1]  # word i and word i + 1

    def strings(self, at: np.ndarray) -> pa.Array:
        sizes = self.ends[at] - self.starts[at]
        raw = self.data[ranges(self.starts[at], sizes)]
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(raw)).cast(pa.string())


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + np.uint64(1)))


def combined(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Equal keys added up, and the place of the first of each. Keys that only share the mixed sort key stay apart."""
    key = reduce(pair_key, [c.astype(np.uint64) for c in columns])
    order = np.argsort(key, kind="stable")
    columns, n = [c[order] for c in columns], n[order]
    fresh = np.ones(len(n), bool)
    if len(n):
        fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(fresh)
    return [c[at] for c in columns], np.add.reduceat(n, at) if len(at) else n, order[at]


def vocabulary(docs: DataFrame, seed: int, mask: int) -> DataFrame:
    """(lang, h, word, n) of all words."""

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            words = Words(batch, seed, mask)
            other = Rolling(words.data, codes(5000 + seed)).of(words.starts, words.ends)  # tells words of equal hash apart
            (lang, h, _), n, first = combined([words.lang, words.hashes, other], np.ones(len(other), np.int64))
            names = pa.array(words.langs, pa.string()).take(pa.array(lang.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([names, pa.array(h.view(np.int64)), words.strings(first), pa.array(n)], names=["lang", "h", "word", "n"])

    return docs.mapInArrow(run, "lang string, h long, word string, n long").groupBy("lang", "h", "word").agg(F.sum("n").alias("n"))


def grown(docs: DataFrame, size: int, seed: int, mask: int, frequent, right=None, left=None) -> DataFrame:
    """(lang, h1, …, n) of phrases of ``size`` frequent words; three words only where the first two lie in ``right`` or the last two in ``left``."""
    names = [f"h{k + 1}" for k in range(size)]

    def run(batches):
        known: dict[str, int] = {}
        parts: list[tuple] = []

        def gathered():
            return combined([np.concatenate(c) for c in zip(*[p[0] for p in parts], strict=True)], np.concatenate([p[1] for p in parts]))

        def out(columns, n, _):
            langs = pa.array(list(known), pa.string())
            for at in range(0, len(n), ROWS):  # what the engine takes over at once
                lang, *keys = [c[at : at + ROWS] for c in columns]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang.astype(np.int32))), *[pa.array(c.view(np.int64)) for c in keys], pa.array(n[at : at + ROWS])], names=["lang", *names, "n"])

        for batch in slices(batches, "text", SLICE):
            words = Words(batch, seed, mask)
            h = words.hashes
            often = hit(frequent.value, mix(h))
            pair = words.joined & often[1:] & often[:-1]
            at = np.flatnonzero(pair)
            if size == 3:
                at = at[:-1][at[1:] == at[:-1] + 1]
                first = pair_key(h[at], h[at + 1])
                last = pair_key(h[at + 1], h[at + 2])
                at = at[hit(right.value, first) | hit(left.value, last)]
            if not len(at):
                continue
            own = np.array([known.setdefault(x, len(known)) for x in words.langs], np.int64)
            parts.append(combined([own[words.lang[at]], *[h[at + k] for k in range(size)]], np.ones(len(at), np.int64)))
            if sum(len(p[1]) for p in parts) > GATHERED:
                parts[:] = [gathered()]
                if len(parts[0][1]) > GATHERED // 2:
                    yield from out(*parts.pop())
        if parts:
            yield from out(*gathered())

    schema = "lang string, " + ", ".join(f"{c} long" for c in names) + ", n long"
    return docs.mapInArrow(run, schema).groupBy("lang", *names).agg(F.sum("n").alias("n"))


def hit(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap(rows: DataFrame, columns: list[str], bits: int = FILTER_BITS):
    """Broadcast bitmap of fixed size with the bits of all rows' hashed keys set. Pages are built by the engine and only they reach the driver."""

    def run(batches):
        for batch in batches:
            keys = [batch.column(c).to_numpy().view(np.uint64) for c in columns]
            key = pair_key(*keys) if len(keys) == 2 else mix(keys[0])
            yield pa.RecordBatch.from_arrays([pa.array((key & np.uint64((1 << bits) - 1)).astype(np.int64) + 1)], names=["at"])

    pages = rows.select(*columns).mapInArrow(run, "at long").groupBy(F.bitmap_bucket_number("at").alias("page"))
    out = np.zeros(max(1 << bits, PAGE) // 8, np.uint8)
    for r in pages.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map")).toLocalIterator():
        at = (r["page"] - 1) * PAGE // 8
        out[at : at + PAGE // 8] = np.frombuffer(bytes(r["map"]), np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out[: (1 << bits) // 8])


def ratio(a: Column, b: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(SCALE a b / (l r)) as long, in 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top, bottom = (wide(a) * wide(b)) * F.lit(SCALE).cast("decimal(7,0)"), wide(l) * wide(r)
    rest = top % bottom  # the difference is a multiple, so the quotient is exact
    return ((top - rest) / bottom).cast("long")


def threshold(scored: DataFrame, k: int) -> DataFrame:
    """(lang, t): the k-th best score of each language, 0 with fewer. Languages hold at most SCALE + 1 different scores."""
    counts = scored.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("k"))
    down = counts.withColumn("k", F.sum("k").over(Window.partitionBy("lang").orderBy(F.desc("score"))))
    return down.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("k") >= k, F.col("score"))), F.lit(0)).alias("t"))


def pairs(docs: DataFrame, words: DataFrame, seed: int, mask: int, frequent, least: int) -> DataFrame:
    """Frequent pairs: lang, h1, h2, a, l, r, score, bound."""
    count = lambda h, n: words.select("lang", F.col("h").alias(h), F.col("n").alias(n))
    found = grown(docs, 2, seed, mask, frequent).where(F.col("n") >= least).withColumnRenamed("n", "a")
    found = found.join(count("h1", "l"), ["lang", "h1"]).join(count("h2", "r"), ["lang", "h2"])
    one = F.lit(1)
    return found.select("lang", "h1", "h2", "a", "l", "r", ratio(F.col("a"), F.col("a"), F.col("l"), F.col("r")).alias("score"), ratio(F.col("a"), one, F.col("l"), one).alias("bound"))


def triples(counted: DataFrame, two: DataFrame) -> DataFrame:
    """lang, h1, h2, h3, a, l, r, score of counted phrases of three words: the lower of both cuts, the first of equals."""
    front = two.select("lang", "h1", "h2", F.col("a").alias("f12"), F.col("l").alias("f1"))
    back = two.select("lang", F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    both = counted.join(front, ["lang", "h1", "h2"]).join(back, ["lang", "h2", "h3"])
    both = both.withColumns({"s1": ratio(F.col("a"), F.col("a"), F.col("f1"), F.col("f23")), "s2": ratio(F.col("a"), F.col("a"), F.col("f12"), F.col("f3"))})
    first = F.col("s1") <= F.col("s2")
    return both.select("lang", "h1", "h2", "h3", "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))


def surviving(two: DataFrame, three: DataFrame, state: DataFrame, cover: int) -> DataFrame:
    """Phrases of two and three words at or above their language's threshold that no longer one of ``cover`` percent of their count holds."""
    held = three.select("lang", "h1", "h2", F.col("a").alias("longer")).union(three.select("lang", "h2", "h3", "a")).groupBy("lang", "h1", "h2").agg(F.max("longer").alias("longer"))
    best = two.join(state, "lang").where("score >= t").join(held, ["lang", "h1", "h2"], "left")
    best = best.where(F.col("longer").isNull() | (F.col("longer").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * cover))
    columns = ["lang", "h1", "h2", "h3", "a", "l", "r", "score"]
    best = best.withColumn("h3", F.lit(None).cast("long")).select(*columns)
    return best.union(three.join(state, "lang").where("score >= t").select(*columns))


def mine(docs: DataFrame, text_col: str, lang_col: str, least: int = 10, top: int = 2000, cover: int = 50, hash_bits: int = 64) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of two or three words with at least ``least`` occurrences; those inside a longer candidate that has ``cover``
    percent of their occurrences or more are left out.
    """
    with small_batches(docs.sparkSession):  # every pass over the texts ends in a written table within
        return _mine(docs, text_col, lang_col, least, top, cover, hash_bits)


def _mine(docs: DataFrame, text_col: str, lang_col: str, least: int, top: int, cover: int, hash_bits: int) -> DataFrame:
    spark, mask = docs.sparkSession, (1 << hash_bits) - 1
    rows = pick(docs, text=text_col, lang=lang_col).withColumn("lang", F.coalesce("lang", F.lit("und")))
    seed = 0
    while True:  # until all words have hashes of their own
        every = saved(vocabulary(rows, seed, mask), "vocabulary")
        if every.groupBy("lang", "h").count().where("count > 1").isEmpty():
            break
        seed += 1
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    words = every.where(F.col("n") >= least)
    frequent = bitmap(words, ["h"])
    two = saved(pairs(rows, words, seed, mask, frequent, least), "pairs")

    columns = "lang string, h1 long, h2 long, h3 long, a long, l long, r long, score long"
    three = spark.createDataFrame([], columns)
    state = two.select("lang").distinct().withColumns({"t": F.lit(SCALE + 1).cast("long"), "open": F.lit(True)})
    wanted = 2 * top
    while True:
        # settled languages keep their threshold, so they add nothing to the frontier
        state = saved(state.join(threshold(two, wanted).withColumnRenamed("t", "lower"), "lang").select("lang", F.col("t").alias("before"), F.when(F.col("open"), F.least("t", "lower")).otherwise(F.col("t")).alias("t")), "state")
        fresh = two.join(state, "lang")
        right = fresh.where("bound >= t and bound < before")
        left = fresh.where("score >= t and score < before")
        if not right.isEmpty() or not left.isEmpty():
            counted = grown(rows, 3, seed, mask, frequent, bitmap(right, ["h1", "h2"]), bitmap(left, ["h1", "h2"]))
            counted = saved(counted.where(F.col("n") >= least).withColumnRenamed("n", "a"), "triples")
            three = saved(three.union(triples(counted, two)).distinct(), "scored")
        found = surviving(two, three, state.select("lang", "t"), cover)
        enough = found.groupBy("lang").agg(F.count(F.lit(1)).alias("k"))
        open_ = (F.col("t") > 0) & (F.coalesce("k", F.lit(0)) < top)
        state = saved(state.join(enough, "lang", "left").select("lang", "t", open_.alias("open")), "state")
        if state.where("open").isEmpty():
            break
        wanted *= MORE
    return ranked(saved(found, "surviving"), words, totals, top)


def ranked(found: DataFrame, words: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their words. Ties are cut down in parts first, so no task sees all of a language."""
    found = found.join(threshold(found, top), "lang").where("score >= t").drop("t")
    word = lambda k: words.select("lang", F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"))
    named = found.join(word(1), ["lang", "h1"]).join(word(2), ["lang", "h2"]).join(word(3), ["lang", "h3"], "left")
    named = named.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "score")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    inside = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    firsts = named.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", inside).where(F.col("rank") <= top).drop("part", "rank")
    out = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
