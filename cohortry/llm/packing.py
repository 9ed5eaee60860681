"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Items are dealt into shards of about ``SHARD`` items by a hash. Each shard is evolved on several islands. An individual is a set of bins;
its fitness is the mean square of the fill. Crossover injects whole well-filled bins of one parent into the other, removes the bins that
now hold duplicates and returns their displaced items by best fit, longest first; mutation dissolves the least filled bins. After
each epoch the elite of every island moves to the next island of its shard. Bins that stay underfilled are dissolved and their items are
packed again in shards of the next level, across the borders of the first, until one shard is left or nothing more is gained.

Documents are encoded, closed with the id 0 and cut into pieces of the capacity only if they are longer. A null text is empty and gives
one piece, the closing id. Rows with equal or null ids are packed each by itself. No row is dropped; an empty table gives no rows.
"""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import pick, saved
from .wordpieces import load

CAPACITY = 2048
SHARD = 4096
ISLANDS = 2
POPULATION = 4
GENERATIONS = 12
EPOCHS = 2
WELL_FILLED = 0.985


class Bins:
    """Bins of one individual with a best-fit index: the bit ``f`` of ``free`` is set if a bin has ``f`` free places."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] = ()):  # type: ignore[assignment]
        self.sizes, self.capacity, self.bins, self.left = sizes, capacity, [], []
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free = 0
        for items in bins:
            self.open(items)

    def open(self, items: list[int]) -> None:
        self.bins.append(items)
        self.left.append(self.capacity - sum([self.sizes[i] for i in items]))
        self._index(len(self.bins) - 1)

    def _index(self, b: int) -> None:
        f = self.left[b]
        self.by_free[f].append(b)
        self.free |= 1 << f

    def best_fit(self, items: list[int]) -> None:
        """Put the items, longest first, where the least room remains."""
        sizes = self.sizes
        for i in sorted(items, key=sizes.__getitem__, reverse=True):
            size = sizes[i]
            fitting = self.free >> size
            if not fitting:
                self.open([i])
                continue
            f = size + (fitting & -fitting).bit_length() - 1
            b = self.by_free[f].pop()
            if not self.by_free[f]:
                self.free &= ~(1 << f)
            self.bins[b].append(i)
            self.left[b] = f - size
            self._index(b)


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> float:
    return sum([(sum([sizes[i] for i in b]) / capacity) ** 2 for b in bins]) / max(1, len(bins))


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """``a`` with some of the best bins of ``b``."""
    full = sorted(b, key=lambda x: -sum([sizes[i] for i in x]))[: max(1, len(b) // 2)]
    injected = rng.sample(full, max(1, len(full) // 3))
    taken = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    child = Bins(sizes, capacity, [*map(list, injected), *kept])
    child.best_fit(displaced)
    return child.bins


def mutate(bins: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Dissolve the least filled bins and a few others, and put their items back by best fit."""
    order = sorted(range(len(bins)), key=lambda k: sum([sizes[i] for i in bins[k]]))
    chosen = set(order[: max(1, len(bins) // 10)]) | set(rng.sample(order, max(1, len(bins) // 12)))
    items = [i for k in chosen for i in bins[k]]
    rest = Bins(sizes, capacity, [list(x) for k, x in enumerate(bins) if k not in chosen])
    # pairs that fill a bin exactly or nearly are found by looking for the best partner of a long item
    rest.best_fit(items)
    return rest.bins


def first_individual(sizes: list[int], capacity: int, rng: random.Random, noise: float) -> list[list[int]]:
    made = Bins(sizes, capacity)
    if not noise:
        made.best_fit(list(range(len(sizes))))
        return made.bins
    # a random part is placed first, in any order, and the rest by best fit
    order = list(range(len(sizes)))
    rng.shuffle(order)
    cut = int(len(order) * noise)
    for i in order[:cut]:
        made.best_fit([i])
    made.best_fit(order[cut:])
    return made.bins


def evolve(sizes: list[int], capacity: int, population: list[list[list[int]]], seed: int) -> list[list[list[int]]]:
    """One epoch of an island; the best individual stands first."""
    rng = random.Random(seed)
    population = population or [first_individual(sizes, capacity, rng, k * 0.15) for k in range(POPULATION)]
    scored = sorted(((fitness(p, sizes, capacity), p) for p in population), key=lambda x: -x[0])
    bound = -(-sum(sizes) // capacity)
    for _ in range(GENERATIONS):
        if len(scored[0][1]) <= bound:
            break
        a, b = rng.sample(scored, 2) if len(scored) > 1 else (scored[0], scored[0])
        child = mutate(crossover(a[1], b[1], sizes, capacity, rng), sizes, capacity, rng)
        scored = sorted([*scored, (fitness(child, sizes, capacity), child)], key=lambda x: -x[0])[:POPULATION]
    return [p for _, p in scored]


def flat(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for k, items in enumerate(bins):
        out[items] = k
    return out


def unflat(places: np.ndarray) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(int(places.max()) + 1)]
    for i, k in enumerate(places.tolist()):
        bins[k].append(i)
    return bins


def epoch(shards: DataFrame, capacity: int, number: int) -> DataFrame:
    """Evolve every island by itself: each row is an island with its items' sizes and its population."""

    def run(batches):
        for pdf in batches:
            out = []
            for shard, island, sizes, population in zip(pdf["shard"], pdf["island"], pdf["sizes"], pdf["population"], strict=True):
                sizes = [int(s) for s in sizes]
                seed = zlib.crc32(struct.pack("<qii", shard, island, number))
                grown = evolve(sizes, capacity, [unflat(np.asarray(p)) for p in population], seed)
                out.append([flat(p, len(sizes)) for p in grown])
            yield pdf.assign(population=out)

    return shards.mapInPandas(run, shards.schema)


def migrate(islands: DataFrame) -> DataFrame:
    """Every island takes in the elite of the island before it in its shard."""
    elites = islands.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("population")[0].alias("elite"))
    joined = islands.join(elites, ["shard", "island"])
    return joined.withColumn("population", F.slice(F.concat(F.array("elite"), "population"), 1, POPULATION)).select(islands.columns)


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """Bins for all items: key, sequence_id, offset. ``key`` must be unique and not null, sizes from 1 to ``capacity``.

    Items as large as a bin get one each; the others are evolved. Items in a task: about ``SHARD``, whatever the table's size.
    """
    items = pick(items, key=key, size=size)
    whole = items.where(F.col("size") == capacity).select("key", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done, level, before = items.where(F.col("size") < capacity), [whole], 0, None
    while True:
        n = rest.count()
        if n == 0:
            break
        shards, last = -(-n // SHARD), before is not None and n > 0.9 * before
        level, before = level + 1, n
        islands = (
            rest.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(shards)))
            .groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("key", "size"))).alias("items"))  # about SHARD items
            .select("shard", F.col("items.key").alias("keys"), F.col("items.size").cast("array<int>").alias("sizes"))
            .withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])))
            .withColumn("population", F.array().cast("array<array<int>>"))
        ).repartition(shards * ISLANDS, "shard", "island")
        for e in range(EPOCHS):
            islands = epoch(islands, capacity, e + 1)
            if e < EPOCHS - 1:
                islands = migrate(saved(islands, "islands"))
        final = level >= 4 or shards == 1 or last

        def best(batches, final=final, level=level):
            for pdf in batches:
                out: dict[str, list] = {"key": [], "sequence_id": [], "offset": [], "size": []}
                for shard, keys, sizes, places in zip(pdf["shard"], pdf["keys"], pdf["sizes"], pdf["places"], strict=True):
                    for k, bin_items in enumerate(unflat(np.asarray(places))):
                        at, keep = 0, final or sum(int(sizes[i]) for i in bin_items) >= WELL_FILLED * capacity
                        for i in bin_items:
                            out["key"].append(keys[i])
                            out["size"].append(sizes[i])
                            out["sequence_id"].append(-1 - ((level << 56) | (int(shard) << 16) | k) if keep else None)
                            out["offset"].append(at)
                            at += int(sizes[i])
                # not by way of floats, which cannot hold such numbers
                yield pd.DataFrame(out | {"sequence_id": pd.array(out["sequence_id"], "Int64")})

        score = F.aggregate(F.array_distinct("places"), F.lit(0), lambda s, x: s + 1)
        chosen = islands.select("shard", "island", "keys", "sizes", F.col("population")[0].alias("places")).withColumn("bins", score)
        winners = chosen.groupBy("shard").agg(F.min_by(F.struct("keys", "sizes", "places"), F.struct("bins", "island")).alias("w")).select("shard", "w.*")
        kind = items.schema["key"].dataType.simpleString()
        placed = saved(winners.mapInPandas(best, f"key {kind}, sequence_id long, offset long, size {items.schema['size'].dataType.simpleString()}"), "packed")
        done.append(placed.where("sequence_id is not null").select("key", "sequence_id", "offset"))
        if final:
            break
        rest = placed.where("sequence_id is null").select("key", "size")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def token_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: key (unique), id, piece, start, length, ids_crc32."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = pick(docs, id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())

    def cut(batches):
        coder = load(path)
        for batch in batches:
            source, out = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = coder.encode(text or "") + b"\0\0\0\0"
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    source.append(k)
                    out.append((n, at // 4, len(part) // 4, zlib.crc32(part)))
            piece, start, length, crc = np.array(out, np.int64).reshape(-1, 4).T
            owner = batch.select(["row", "id"]).take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([*owner.columns, pa.array(piece, pa.int32()), *map(pa.array, (start, length, crc))], names=["row", "id", "piece", "start", "length", "ids_crc32"])

    pieces = rows.mapInArrow(cut, f"row long, id {kind}, piece int, start long, length long, ids_crc32 long")
    return saved(pieces.withColumn("key", F.struct("row", "piece")).drop("row"), "pieces")


def pack_documents(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, path, id_col, text_col, capacity)
    return pieces.join(pack(pieces, "key", "length", capacity), "key").drop("key")
