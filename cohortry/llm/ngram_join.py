"""Exact Jaccard self-join on word n-grams, and its connected components.

Texts are reduced to their distinct shingle sets first; equal sets are one class. Two sets of Jaccard similarity t or more differ in at most
D = floor((1 - t) / (1 + t) * (a + b)) shingles. Sets are placed in size bands; a band also takes the sets just below it that may still
reach similarity with its members. Within a band the hash space is cut in D + 1 tiles for the band's largest D: two similar sets agree in
at least one whole tile, so equal tile hashes find every pair. For wide shingles and low similarities tiles can be single shingles, of
which similar sets share one among their first in hash order. Candidates of a tile are first the pairs of each set with the tile's
smallest set; the sets that are not joined by those meet all others of another component in square blocks. Before the exact intersection
of sorted arrays, hashed bitmaps bound the overlap from above: each bit that only one set has is a shingle the other lacks. Large sets
have a second, wider one, so that few pairs carry their shingles. Tables and shuffle files of a step are deleted as soon as it has ended.

A null text is empty; texts without words have an empty set and are linked with nothing. Texts with fewer words than a shingle are one
shingle. Repeated rows and ids are joined as equal texts and labelled with the smallest id, which may be null only if all of them are.
"""

from __future__ import annotations

from functools import reduce
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import ASCII_SPACE, LOWER, Rolling, mix, ranges, slices, text_bytes, word_spans
from .graph import components
from .store import dropped, pick, saved, scratch, shuffles_freed

BAND = 1.5
BITS = 2048
#: Bits of the second bitmap, which sets of more than ``LARGE`` shingles have.
WIDE = 8192
LARGE = 256
BLOCK = 512
#: Shares of the tiles that are counted one after the other.
SHARES = 4
PAIR = "a long, b long"
LINK = "a struct<h1: long, h2: long>, b struct<h1: long, h2: long>"


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the n + 1 offsets between texts."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, before = word_spans(data, offsets, ASCII_SPACE)
    words = Rolling(data).of(starts, ends)
    n_words = np.diff(before)
    counts = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    text = np.repeat(np.arange(len(n_words)), counts)
    first = before[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    hashes = np.zeros(len(text), np.uint64)
    size = np.minimum(n_words, width)[text]
    for k in range(width):
        inside = k < size
        hashes[inside] = mix(hashes[inside] * np.uint64(0x9E3779B97F4A7C15) + words[first[inside] + k] + np.uint64(k + 1))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[fresh], np.searchsorted(text[fresh], np.arange(len(n_words) + 1))


def band_edges(largest: int) -> np.ndarray:
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, floor(edges[-1] * BAND)))
    return np.array(edges)


def tile_hashes(hashes: np.ndarray, offsets: np.ndarray, top: int, bottom: int) -> tuple[np.ndarray, np.ndarray]:
    """Tile hashes of all sets for similarity top / bottom, and the n + 1 offsets between sets."""
    sizes = np.diff(offsets)
    edges = band_edges(int(sizes.max(initial=1)))
    home = np.searchsorted(edges, sizes, "right") - 1
    n_diff = lambda band: (bottom - top) * 2 * (edges[np.minimum(band + 1, len(edges) - 1)] - 1) // (bottom + top)
    edges = np.append(edges, floor(edges[-1] * BAND))
    sums = np.append(np.uint64(0), np.cumsum(mix(hashes + np.uint64(1))))
    values, owner = [], []
    for band, member in ((home, sizes > 0), (home + 1, (sizes > 0) & (sizes * bottom >= top * edges[np.minimum(home + 1, len(edges) - 1)]))):
        tiles = n_diff(band) + 1
        sets = np.flatnonzero(member & (tiles > 1))  # with one tile only equal sets agree
        if not len(sets):
            continue
        n = tiles[sets]
        base = np.cumsum(n) - n
        rows = np.repeat(np.arange(len(sets)), sizes[sets])
        at = np.arange(len(rows)) - np.repeat(np.cumsum(sizes[sets]) - sizes[sets], sizes[sets]) + offsets[sets][rows]
        tile = ((hashes[at] >> np.uint64(32)) * n[rows].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(base[rows] + tile, np.arange(int(n.sum()) + 1))
        where = np.append(at, 0)
        set_of, number = np.repeat(np.arange(len(sets)), n), np.arange(int(n.sum())) - np.repeat(base, n)
        filled = cut[1:] > cut[:-1]
        total = np.zeros(len(number), np.uint64)
        total[filled] = sums[where[cut[1:][filled] - 1] + 1] - sums[where[cut[:-1][filled]]]
        values.append(mix(total + mix((band[sets][set_of] * (1 << 32) + number).astype(np.uint64))))
        owner.append(sets[set_of])
    if not values:
        return np.zeros(0, np.uint64), np.zeros(len(sizes) + 1, np.int64)
    value, owner = np.concatenate(values), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return value[order], np.searchsorted(owner[order], np.arange(len(sizes) + 1))


def prefix_hashes(hashes: np.ndarray, offsets: np.ndarray, top: int, bottom: int) -> tuple[np.ndarray, np.ndarray]:
    """Tiles of single shingles: the n - ceil(t * n) + 1 first ones in hash order, of which two similar sets share one."""
    sizes = np.diff(offsets)
    counts = np.where(sizes > 0, sizes - (-(-sizes * top // bottom)) + 1, 0)
    return mix(hashes[ranges(offsets[:-1], counts)] + np.uint64(9)), np.append(0, np.cumsum(counts))


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), longs(np.ascontiguousarray(values)))


def describe(rows: DataFrame, width: int, top: int, bottom: int, by_prefix: bool) -> DataFrame:
    """id, text key, set size, class (hash of the set; null for an empty one), tile hashes."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "text"):
            hashes, offsets = shingle_sets(batch.column("text"), width)
            sizes = np.diff(offsets)
            tiles, cuts = (prefix_hashes if by_prefix else tile_hashes)(hashes, offsets, top, bottom)
            parts = []
            for salt in (3, 5):
                sums = np.append(np.uint64(0), np.cumsum(mix(hashes * np.uint64(salt) + np.uint64(salt))))
                parts.append(longs(mix(sums[offsets[1:]] - sums[offsets[:-1]])))
            empty = pa.array(sizes == 0)
            cls = pa.StructArray.from_arrays(parts, ["h1", "h2"], mask=empty)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t1"), batch.column("t2"), pa.array(sizes.astype(np.int64)), cls, lists(tiles, cuts)], names=["id", "t1", "t2", "n", "class", "tiles"])

    return rows.mapInArrow(run, f"id {kind}, t1 long, t2 long, n long, class struct<h1: long, h2: long>, tiles array<long>")


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """class, size, bitmap and sorted shingles of texts whose class is given."""

    def run(batches):
        for batch in slices(batches, "text"):
            hashes, offsets = shingle_sets(batch.column("text"), width)
            n = batch.num_rows
            bits = np.zeros((n, BITS), bool)
            bits[np.repeat(np.arange(n), np.diff(offsets)), (hashes & np.uint64(BITS - 1)).astype(np.int64)] = True
            bitmap = pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary())
            wide = pa.array([wide_bitmap(hashes[a:z]) if z - a > LARGE else None for a, z in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
            columns = [batch.column("class"), pa.array(np.diff(offsets).astype(np.int64)), bitmap, wide, lists(hashes, offsets)]
            yield pa.RecordBatch.from_arrays(columns, names=["class", "n", "bitmap", "wide", "shingles"])

    return texts.select("class", "text").mapInArrow(run, "class struct<h1: long, h2: long>, n long, bitmap binary, wide binary, shingles array<long>")


def wide_bitmap(hashes: np.ndarray) -> bytes:
    bits = np.zeros(WIDE, bool)
    bits[((hashes >> np.uint64(20)) & np.uint64(WIDE - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def least_overlap(a, b, top: int, bottom: int):
    """Smallest intersection with bottom * i >= top * (a + b - i)."""
    return -(-(top * (a + b)) // (bottom + top))


def most_common(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Upper bound of the overlaps: a bit that only one bitmap has is a shingle that the other set lacks."""
    return np.minimum(na - np.bitwise_count(a & ~b).sum(-1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(-1, dtype=np.int64))


def bitmaps(column: pa.Array, bits: int = BITS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, bits // 64)


def side(sets: DataFrame, p: str, *columns: str) -> DataFrame:
    names = {"n": "n", "bitmap": "bits", "wide": "bits", "shingles": "h", "class": "class"}
    return sets.select(F.col("class.h1").alias(p), *[F.col(c).alias(p + names[c]) for c in columns])


def bounded(pairs: DataFrame, sets: DataFrame, top: int, bottom: int, column: str = "bitmap", bits: int = BITS) -> DataFrame:
    """The pairs (a, b) whose bitmaps, if both have one, do not rule the similarity out."""

    def bound(batches):
        for batch in batches:
            both = pa.compute.and_(batch.column("abits").is_valid(), batch.column("bbits").is_valid())
            yield batch.select(["a", "b"]).filter(pa.compute.invert(both))
            batch = batch.filter(both)
            na, nb = (batch.column(c).to_numpy() for c in ("an", "bn"))
            most = most_common(bitmaps(batch.column("abits"), bits), na, bitmaps(batch.column("bbits"), bits), nb)
            yield batch.select(["a", "b"]).filter(pa.array(most >= least_overlap(na, nb, top, bottom)))

    both = pairs.join(side(sets, "a", "n", column), "a").join(side(sets, "b", "n", column), "b")
    return both.select("a", "b", "an", "bn", "abits", "bbits").mapInArrow(bound, PAIR)


def linked(pairs: DataFrame, sets: DataFrame, top: int, bottom: int) -> DataFrame:
    """Links between the classes of the pairs (a, b) that reach the similarity, by the exact intersection of their sorted shingles."""

    def exact(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ah"), batch.column("bh"), strict=True):
                x, y = (np.asarray(v.values).view(np.uint64) for v in (x, y))
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(bottom * common >= top * (len(x) + len(y) - common))
            found = batch.select(["aclass", "bclass"]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(found.columns, names=["a", "b"])

    both = pairs.join(side(sets, "a", "shingles", "class"), "a").join(side(sets, "b", "shingles", "class"), "b")
    return both.select("aclass", "bclass", "ah", "bh").mapInArrow(exact, LINK)


def block_pairs(open_rows: DataFrame, top: int, bottom: int) -> DataFrame:
    """Pairs of different components in each tile that the bitmaps do not rule out, from (tile, c, component, members, n, bitmap).

    A member goes to as many block pairs as its tile has blocks of ``BLOCK`` members; a task compares two blocks at a time.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).cast("int")
    rows = open_rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("tile", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "component", "n", "bitmap")

    def cross(key, table):
        _, i, j = (k.as_py() for k in key)
        names = table["c"].combine_chunks()
        own, size, bits = table["own"].to_numpy(), table["n"].to_numpy(), bitmaps(table["bitmap"])
        codes = table["component"].to_numpy()
        left, right, found = np.flatnonzero(own == i), np.flatnonzero(own == j), []
        for x in left:
            y = right[(codes[right] != codes[x]) & ((right > x) | (i != j))]
            y = y[most_common(bits[x], size[x], bits[y], size[y]) >= least_overlap(size[x], size[y], top, bottom)]
            found.append(np.stack([np.full(len(y), x), y], 1))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": names.take(pa.array(pairs[:, 0])), "b": names.take(pa.array(pairs[:, 1]))})

    return rows.groupBy("tile", "i", "j").applyInArrow(cross, PAIR)


def shared_tiles(one: DataFrame) -> DataFrame:
    """tile, lead, members and c of the classes in every tile that holds several, from (c, tiles); in shares, so that only one share's
    shuffle files lie on disk."""
    parts = []
    for k in range(SHARES):
        tiles = one.select("c", F.explode("tiles").alias("tile")).where(F.pmod("tile", F.lit(SHARES)) == k)
        shared = tiles.groupBy("tile").agg(F.min("c").alias("lead"), F.max("c").alias("other"), F.count(F.lit(1)).alias("members"))
        shared = saved(shared.where("lead <> other").select("tile", "lead", "members"), "shared")
        parts.append(saved(tiles.join(shared, "tile"), "members"))
        dropped(shared)
    return reduce(DataFrame.union, parts)


def join_documents(docs: DataFrame, id_col: str, text_col: str, width: int = 3, top: int = 90, bottom: int = 100, by_prefix: bool = False) -> DataFrame:
    """One row per document: id, n_shingles, component_id, n_links (verified links of its set with other sets that were needed).

    ``by_prefix`` takes single shingles as tiles: fewer rows where the similarity is low and shingles are wide, and so rarely common.
    Also the text key (t1, t2) and the component's own key, which tell texts of equal ids apart.
    """
    with scratch() as spare, shuffles_freed(docs.sparkSession):
        return spare(saved(_joined(docs, id_col, text_col, width, top, bottom, by_prefix), "joined"))


def _joined(docs: DataFrame, id_col: str, text_col: str, width: int, top: int, bottom: int, by_prefix: bool) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, id=id_col, text=text_col).withColumn("text", text).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text")})
    described = saved(describe(rows, width, top, bottom, by_prefix), "described")
    classes, named_rows = described.where("class is not null"), saved(described.drop("tiles"), "documents")
    one = classes.groupBy("class").agg(F.min("id").alias("first_id"), F.min(F.struct("t1", "t2")).alias("text_key"), F.first("tiles").alias("tiles"))
    one = saved(one, "classes")
    dropped(described)
    # In tiles a class goes by the first half of its hash: longs are combined before the shuffle and take half the room. Classes that
    # share it are fetched together below, and links join whole classes.
    members = shared_tiles(one.select(F.col("class.h1").alias("c"), "tiles"))
    whole, one = one, saved(one.drop("tiles"), "classes")
    dropped(whole)

    wanted = members.select("c").distinct().join(one.select(F.col("class.h1").alias("c"), "class", "text_key"), "c")
    wanted = wanted.select("class", F.col("text_key.t1").alias("t1"), F.col("text_key.t2").alias("t2"))
    texts = rows.select("t1", "t2", "text").join(wanted, ["t1", "t2"])
    # equal texts give equal sets: one row of each is enough, and first() keeps it without gathering copies; texts are smaller than sets
    held = saved(texts.groupBy("class").agg(F.first("text").alias("text")), "texts", "zstd")
    sets = saved(sets_of(held, width), "sets")
    dropped(held)

    pairs = members.where("c <> lead").select(F.col("lead").alias("a"), F.col("c").alias("b")).distinct()
    narrow = saved(bounded(pairs, sets, top, bottom), "possible")
    possible = saved(bounded(narrow, sets, top, bottom, "wide", WIDE), "possible")
    dropped(narrow)
    links = saved(linked(possible, sets, top, bottom), "links")
    dropped(possible)
    labels = components(links)

    placed = members.join(labels.select(F.col("node.h1").alias("c"), F.col("component.h1").alias("component")), "c", "left").withColumn("component", F.coalesce("component", "c"))
    # tiles of equal membership are one; those within one component need no more
    groups = placed.groupBy("tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("set"), F.first("members").alias("members"))
    undecided = groups.where("lo <> hi").groupBy("set", "members").agg(F.min("tile").alias("tile")).select("tile")
    open_rows = placed.join(undecided, "tile").join(sets.select(F.col("class.h1").alias("c"), "n", "bitmap"), "c")
    more = block_pairs(open_rows.select("tile", "c", "component", "members", "n", "bitmap"), top, bottom)
    more = saved(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "possible")
    more = more.join(links.select(F.least("a.h1", "b.h1").alias("a"), F.greatest("a.h1", "b.h1").alias("b")), ["a", "b"], "left_anti")
    more = saved(bounded(more, sets, top, bottom, "wide", WIDE), "possible")
    links = saved(links.union(linked(more, sets, top, bottom)), "links")
    labels = components(links)

    degree = links.union(links.select("b", "a")).groupBy(F.col("a").alias("class")).agg(F.count(F.lit(1)).alias("n_links"))
    named = one.select("class", "first_id").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    names = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    table = named.join(names, "component").select("class", "component", "component_id").join(degree, "class", "left")
    out = named_rows.join(table, "class", "left")
    return out.select("id", "t1", "t2", "component", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str, text_col: str, width: int = 5, top: int = 80, bottom: int = 100) -> DataFrame:
    """The rows, with all their columns, of one document of each component: the one with the smallest id. Documents without words stay."""
    joined = join_documents(docs, id_col, text_col, width, top, bottom, by_prefix=True)
    key = F.struct("id", "t1", "t2")
    chosen = joined.where("component is not null").groupBy("component").agg(F.min(key).alias("__key")).select("__key")
    chosen = chosen.union(joined.where("component is null").select(key.alias("__key")).distinct())
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = docs.withColumn("__key", F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")))
    kept = own.join(chosen, "__key")
    # rows of equal id and text are copies too; they already lie together
    first = Window.partitionBy("__key").orderBy("__key")
    empty = F.trim(text) == ""
    return kept.withColumn("__n", F.row_number().over(first)).where((F.col("__n") == 1) | empty).select(*[F.col(f"`{c}`") for c in docs.columns])
