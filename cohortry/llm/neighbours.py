"""Nearest neighbours by cosine with a vantage-point tree per shard.

Vectors are scaled to length one, where a larger cosine is a smaller Euclidean distance, a metric. Each shard of about ``SHARD`` vectors
(dealt by a hash of the id) builds a tree: a vantage point, the median distance to it, the nearer half inside and the rest outside. A
query skips a half if the triangle inequality puts all of it beyond the query's k-th best distance multiplied by ``factor``: at one the
search is exact, below one it prunes more. Each block of queries meets each shard once; the k best of the shards are then joined.

Scores are cosines of the original vectors in double precision, each computed by the same sums, so equal vectors tie exactly and ties go
to the smaller id. Vectors that are null, zero, of no component, or hold a null or a non-finite component take no part; nor do rows with
a null id. Candidate rows that share an id are listed each; query rows that share an id are one query, answered by the best scores of either. Vectors of another length than the query's are not compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import pick, saved

SHARD = 4096
BLOCK = 2048
LEAF = 64


class Tree:
    """Vantage-point tree over unit vectors; ``search`` handles many queries together."""

    def __init__(self, unit: np.ndarray, seed: int = 7):
        self.unit, self.rng = unit, np.random.default_rng(seed)
        self.root = self.build(np.arange(len(unit)))

    def build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        point = rows[self.rng.integers(len(rows))]
        far = np.sqrt(np.maximum(0, 2 - 2 * (self.unit[rows] @ self.unit[point])))
        middle = np.median(far)
        inside = far <= middle
        if inside.all() or not inside.any():  # equal distances: nothing to divide by
            return rows
        near, rest = far[inside], far[~inside]
        return point, (near.min(), near.max(), self.build(rows[inside])), (rest.min(), rest.max(), self.build(rows[~inside]))

    def search(self, queries: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, factor: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query candidate rows that include its k nearest (by cosine, ties within 1e-9 kept), the query's own id left out."""
        self.best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in queries]
        self.bound = np.full(len(queries), np.inf)
        self.queries, self.ids, self.own, self.k, self.factor = queries, ids, own, k, factor
        self.visit(self.root, np.arange(len(queries)))
        return self.best

    def visit(self, node, active: np.ndarray) -> None:
        if isinstance(node, np.ndarray):
            return self.scan(node, active)
        point, *halves = node
        d = np.sqrt(np.maximum(0, 2 - 2 * (self.queries[active] @ self.unit[point])))
        gaps = [np.maximum(0, np.maximum(low - d, d - high)) for low, high, _ in halves]  # no member of the half is nearer than this
        inner_first = gaps[0] <= gaps[1]
        for first in (True, False):  # each query takes its nearer half first
            for h, (_, _, child) in enumerate(halves):
                turn = inner_first == (h == 0)
                turn = turn if first else ~turn
                go = turn & (gaps[h] <= self.bound[active] * self.factor + 1e-7)
                if go.any():
                    self.visit(child, active[go])

    def scan(self, rows: np.ndarray, active: np.ndarray) -> None:
        cosines = self.queries[active] @ self.unit[rows].T
        for q, cos in zip(active, cosines, strict=True):
            score, kept = self.best[q]
            good = (self.ids[rows] != self.own[q]) & (cos >= (score.min() if len(score) >= self.k else -2) - 1e-9)
            score, kept = np.append(score, cos[good]), np.append(kept, rows[good])
            if len(score) > self.k:
                least = np.partition(score, -self.k)[-self.k]
                if len(score) > 4 * self.k:  # exact copies: of equal vectors the smallest ids are enough
                    order = np.lexsort((self.ids[kept], -np.round(score, 9)))[: 3 * self.k]
                    clear = score > least + 1e-9
                    near = score >= least - 1e-9
                    chosen = np.zeros(len(score), bool)
                    chosen[order] = True
                    mask = (clear | chosen) & near if self._copies(kept[near]) else near
                else:
                    mask = score >= least - 1e-9
                score, kept = score[mask], kept[mask]
            self.best[q] = (score, kept)
            if len(score) >= self.k:
                self.bound[q] = np.sqrt(max(0.0, 2 - 2 * np.partition(score, -self.k)[-self.k]))

    def _copies(self, rows: np.ndarray) -> bool:
        return bool((self.unit[rows] == self.unit[rows[-1]]).all())


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of one vector with many, by row sums only: equal inputs give equal results wherever they stand."""
    dot = (a * b).sum(1)
    return dot / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(1)))


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 5, factor: float = 1.0) -> DataFrame:
    """The k nearest of ``vectors`` for each row of ``queries``: query_id, rank (from 1), vec_id, score."""

    def clean(df: DataFrame) -> DataFrame:
        rows = pick(df, id=id_col, v=vector_col)
        return rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("v", F.transform("v", lambda x: x.cast("double")))

    base, asked = clean(vectors), clean(queries)
    sizes = base.groupBy().agg(F.count(F.lit(1)).alias("n")).first()["n"], asked.count()
    shards, blocks = max(1, -(-sizes[0] // SHARD)), max(1, -(-sizes[1] // BLOCK))
    dealt = base.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int")).withColumn("dim", F.size("v"))
    # every block of queries goes to every shard: the stated query set against all rows, BLOCK x SHARD vectors at a time
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int")).withColumn("dim", F.size("v"))
    to_shards = blocked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    to_blocks = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = vectors.schema[id_col].dataType.simpleString()

    def local(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            data, ids = np.stack(left["v"].to_numpy()), left["id"].to_numpy()
            asked, own = np.stack(right["v"].to_numpy()), right["id"].to_numpy()
            scaled = [x / np.abs(x).max(1, keepdims=True) for x in (data, asked)]
            scaled = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in scaled]
            tree = Tree(scaled[0])
            for q, (_, rows) in enumerate(tree.search(scaled[1], ids, own, k, factor)):
                score = cosine(asked[q], data[rows])
                order = np.lexsort((ids[rows], -score))[:k]
                out["query_id"] += [own[q]] * len(order)
                out["vec_id"] += ids[rows][order].tolist()
                out["score"] += score[order].tolist()
        return pd.DataFrame(out)

    keys = ["shard", "block", "dim"]
    found = to_blocks.groupBy(*keys).cogroup(to_shards.groupBy(*keys)).applyInPandas(local, f"query_id {kind}, vec_id {kind}, score double")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    # k rows per shard and query id at most
    ranked = saved(found, "found").groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("p", "b"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
