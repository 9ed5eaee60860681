"""Weighted logistic regressions of many models at once, by iteratively reweighted least squares.

All models read the same rows under weights of their own (a training fold is a set of rows with weight zero elsewhere) and may leave out
features. Each step is one pass: every task adds up the loss, the gradient and the Gram matrix of all models for its rows, the engine sums
them cell by cell, and the driver solves a small system per model. So k folds cost about as many passes as one fit, and what reaches the
driver depends on the number of features alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Logit:
    """A fitted model: log odds = intercept + coefficients . features (missing ones replaced by ``fills``)."""

    features: list[str]
    intercept: float
    coefficients: list[float]
    fills: list[float]

    def logit(self) -> Column:
        out = F.lit(self.intercept)
        for f, c, fill in zip(self.features, self.coefficients, self.fills, strict=True):
            if c:
                value = F.col(f"`{f}`").cast("double")
                out = out + F.lit(c) * (F.coalesce(value, F.lit(fill)) if np.isfinite(fill) else value)
        return out

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.logit()))


def _sums(df: DataFrame, label: str, features: list[str], weights: list[Column], beta: np.ndarray, fills: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Per model: loss, gradient and Gram matrix at ``beta``, on scaled features; one row of cells each."""
    q = len(features) + 1
    names = [f"__x{i}" for i in range(q - 1)]
    marks = [f"__w{m}" for m in range(len(weights))]
    rows = df.select(
        F.col(f"`{label}`").cast("double").alias("__y"), *[F.col(f"`{f}`").cast("double").alias(n) for f, n in zip(features, names, strict=True)],
        *[F.coalesce(w.cast("double"), F.lit(0.0)).alias(n) for w, n in zip(weights, marks, strict=True)],
    ).where(F.col("__y").isNotNull())

    def run(batches):
        cells = np.zeros((len(marks), 1 + q + q * q))
        for batch in batches:
            y = batch.column("__y").to_numpy(zero_copy_only=False)
            raw = np.stack([np.ones(len(y)), *[batch.column(n).to_numpy(zero_copy_only=False) for n in names]], axis=1)
            for m, mark in enumerate(marks):
                w = batch.column(mark).to_numpy(zero_copy_only=False)
                some = w != 0
                if not some.any():
                    continue
                x = raw[some]
                x[:, 1:] = (np.where(np.isnan(x[:, 1:]), fills[m], x[:, 1:]) - centre) / scale
                if np.isnan(x).any():
                    raise ValueError("a feature is missing and has no fill")
                eta, own = x @ beta[m], w[some]
                p = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                cells[m, 0] += own @ (np.logaddexp(0, eta) - y[some] * eta)
                cells[m, 1 : 1 + q] += x.T @ (own * (y[some] - p))
                cells[m, 1 + q :] += (x.T @ (x * (own * p * (1 - p))[:, None])).ravel()
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells.ravel()[at])], names=["cell", "value"])

    out = np.zeros(len(weights) * (1 + q + q * q))
    for r in rows.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out.reshape(len(weights), -1)


def fit_logits(
    df: DataFrame, label: str, features: list[str], weights: list[Column], fills: list[list[float]] | None = None, masks: list[list[str]] | None = None,
    ridge: float = 0.0, max_iter: int = 50, tol: float = 1e-8,
) -> list[Logit]:
    """One model per weight column; rows without a label, and of weight zero or null, are not learnt from.

    ``fills`` are the values of missing features per model; without them a missing feature is an error. ``masks`` names the features a
    model uses. ``ridge`` penalises coefficients of standardised features (per unit of weight), not the intercept. A step that raises the loss is
    halved. ``df`` is read once for each step and should be written beforehand.
    """
    q, k = len(features) + 1, len(weights)
    stats = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{t}{i}") for i, c in enumerate(features) for t, f in (("m", F.avg), ("s", F.stddev_samp))],
                   *[F.sum(F.when(F.col(f"`{label}`").isNotNull(), w.cast("double"))).alias(f"w{m}") for m, w in enumerate(weights)]).first()
    centre = np.array([stats[f"m{i}"] or 0.0 for i in range(q - 1)])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(q - 1)])
    total = np.array([stats[f"w{m}"] or 0.0 for m in range(k)])
    filled = np.array(fills, float) if fills is not None else np.full((k, q - 1), np.nan)
    used = np.ones((k, q), bool)
    if masks is not None:
        used[:, 1:] = [[f in mask for f in features] for mask in masks]
    penalty = ridge * total[:, None] * np.append(0.0, np.ones(q - 1))
    beta, before, step = np.zeros((k, q)), np.full(k, np.inf), np.zeros((k, q))
    done = total == 0
    for _ in range(max_iter):
        cells = _sums(df, label, features, weights, beta, np.where(used[:, 1:], filled, centre), centre, scale)
        for m in np.flatnonzero(~done):
            loss = cells[m, 0] + 0.5 * penalty[m] @ beta[m] ** 2
            if loss > before[m] + 1e-9 * abs(before[m]) and np.abs(step[m]).max() > tol:
                step[m] /= 2
                beta[m] -= step[m]
                continue
            u = used[m]
            gradient = (cells[m, 1 : 1 + q] - penalty[m] * beta[m])[u]
            gram = cells[m, 1 + q :].reshape(q, q)[np.ix_(u, u)] + np.diag(penalty[m][u])
            before[m], step[m] = loss, 0.0
            step[m, u] = np.linalg.lstsq(gram, gradient, rcond=1e-12)[0]
            beta[m] += step[m]
            done[m] = np.abs(step[m]).max() <= tol
        if done.all():
            break
    slopes = beta[:, 1:] / scale
    return [Logit(list(features), float(beta[m, 0] - slopes[m] @ centre), [float(c) for c in slopes[m]], [float(x) for x in filled[m]]) for m in range(k)]


def score_sums(df: DataFrame, label: str, model: Logit, weight: Column) -> DataFrame:
    """(term, total, size) of the score equations: sum of w (y - p) x, zero at the maximum, and of w |x| to compare it with."""
    w, rest = F.coalesce(weight.cast("double"), F.lit(0.0)), F.col(f"`{label}`").cast("double") - model.probability()
    terms = {"": F.lit(1.0)}
    for f, fill in zip(model.features, model.fills, strict=True):
        value = F.col(f"`{f}`").cast("double")
        terms[f] = F.coalesce(value, F.lit(fill)) if np.isfinite(fill) else value
    one = df.agg(F.array(*[F.struct(F.lit(t).alias("term"), F.sum(w * rest * x).alias("total"), F.sum(w * F.abs(x)).alias("size")) for t, x in terms.items()]).alias("a"))
    return one.select(F.inline("a"))
