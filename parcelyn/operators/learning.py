"""A model of pairs: filled features, balanced logistic regression, out-of-fold probabilities.

A missing value becomes the median of the training rows. Both classes weigh the same. The penalty holds coefficients of
features of weighted deviation 1, as in Spark's LogisticRegression with standardization; its optimum is found by Newton's
method. The models of all folds are fitted together: in a pass over the rows each Arrow task adds up loss, gradient and
Hessian of every model, Spark sums these, and the driver solves for as many unknowns as there are features. Rows are read
once a pass and never kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Passes at most, and the step in deviations below which the next one would change no shown digit.
PASSES, STEP = 50, 1e-5


@dataclass
class Logistic:
    """log-odds = offset + sum of weights * features, a missing feature being its fill."""

    features: list[str]
    fill: np.ndarray
    weight: np.ndarray
    offset: float


def _known(name: str) -> Column:
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def _statistics(x: DataFrame, n: int) -> dict[tuple[int, int], np.ndarray]:
    """By fold and label: rows, then of each feature the known values, their mean and their squared deviations."""
    of = lambda i: (F.count(f"x{i}"), F.coalesce(F.avg(f"x{i}"), F.lit(0.0)), F.coalesce(F.var_pop(f"x{i}") * F.count(f"x{i}"), F.lit(0.0)))
    got = x.groupBy("fold", "label").agg(F.count("*"), *(c for i in range(n) for c in of(i))).collect()
    return {(r[0], int(r[1])): np.array(r[2:], np.float64) for r in got}


def _merged(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, mean, squared deviations) of groups together."""
    n, mean, dev = (np.array(g, np.float64) for g in groups[0])
    for k, m, d in groups[1:]:
        both = np.maximum(n + k, 1)
        dev = dev + d + (m - mean) ** 2 * n * k / both
        mean, n = (mean * n + m * k) / both, n + k
    return n, mean, dev


def _solved(h: np.ndarray, g: np.ndarray, free: np.ndarray) -> np.ndarray:
    out = np.zeros(len(g))
    out[free] = np.linalg.lstsq(h[np.ix_(free, free)], g[free], rcond=None)[0]
    return out


def fit_folds(rows: DataFrame, features: list[str], fold: Column, folds: int, penalty: float = 0.01) -> list[Logistic]:
    """A model for each fold, of the rows of the others; one of all rows if folds is 1. rows are read in every pass."""
    x = rows.select(fold.cast("int").alias("fold"), (F.col("truth") == "duplicate").cast("double").alias("label"), *(_known(c).alias(f"x{i}") for i, c in enumerate(features)))
    x = x.where("label IS NOT NULL AND fold IS NOT NULL")
    stats, d = _statistics(x, len(features)), len(features)
    inside = lambda k: [s for s in stats if folds == 1 or s[0] != k]
    part = lambda s: stats[s][1:].reshape(d, 3).T
    held = sum((part(s)[0] for s in stats), np.zeros(d))
    total = sum(s[0] for s in stats.values())
    fills = [np.zeros(d) for _ in range(folds)]
    holed = [i for i in range(d) if 0 < held[i] < total]
    if holed:
        median = lambda i, k: F.percentile_approx(F.col(f"x{i}") if folds == 1 else F.when(F.col("fold") != k, F.col(f"x{i}")), 0.5, 1000)
        got = x.agg(*(median(i, k).alias(f"m{k}_{i}") for k in range(folds) for i in holed)).first()
        for k in range(folds):
            fills[k][holed] = [got[f"m{k}_{i}"] or 0.0 for i in holed]

    def classes(k: int, fill: np.ndarray) -> list[tuple]:
        """(n, mean, squared deviations) of filled features in a model's rows of label 0 and of label 1."""
        out = []
        for y in (0, 1):
            own = [s for s in inside(k) if s[1] == y]
            groups = [(np.zeros(d), np.zeros(d), np.zeros(d)), *(tuple(part(s)) for s in own)]
            n = sum(stats[s][0] for s in own)
            known = sum((part(s)[0] for s in own), np.zeros(d))
            out.append(_merged([*groups, (n - known, fill, np.zeros(d))]))
        return out

    # One scale for all models keeps sums well-conditioned; the penalty is each model's own.
    whole = _merged([(np.zeros(d), np.zeros(d), np.zeros(d)), *(tuple(part(s)) for s in stats)])
    centre, scale = whole[1], np.sqrt(whole[2] / np.maximum(whole[0] - 1, 1))
    used = np.flatnonzero((held > 0) & (scale > 0))
    centre, scale = centre[used], scale[used]
    size = len(used) + 1
    weights, ridge, free, theta = np.zeros((folds, 2)), np.zeros((folds, size)), np.zeros((folds, size), bool), np.zeros((folds, size))
    live = []
    for k in range(folds):
        n = [sum(stats[s][0] for s in inside(k) if s[1] == y) for y in (0, 1)]
        if not all(n):
            theta[k, -1] = math.inf if n[1] else -math.inf if n[0] else 0.0
            continue
        live.append(k)
        weights[k] = 0.5 / n[0], 0.5 / n[1]
        zero, one = classes(k, fills[k])
        middle = (zero[1] + one[1]) / 2
        spread = sum(w * (c[2] + c[0] * (c[1] - middle) ** 2) for w, c in zip(weights[k], (zero, one), strict=True))
        spread = spread / (1 - 0.25 / n[0] - 0.25 / n[1]) if n[0] + n[1] > 2 else spread
        ridge[k, :-1] = penalty * spread[used] / scale**2
        free[k] = [*(spread[used] > 0), True]
    filled = np.array(fills)[:, used]
    gaps = bool(set(used) & set(holed))
    table = x.select("fold", "label", *(f"x{i}" for i in used))

    def sums(theta: np.ndarray) -> np.ndarray:
        """models x (loss, gradient, Hessian)."""

        def add_up(batches):
            import pyarrow as pa

            out = np.zeros((folds, 1 + size + size * size))
            for batch in batches:
                own, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                raw = np.ones((len(y), size))
                for i in range(size - 1):
                    raw[:, i] = (batch.column(2 + i).to_numpy(zero_copy_only=False) - centre[i]) / scale[i]
                for k in live:
                    u = raw
                    if gaps:
                        u = raw.copy()
                        u[:, :-1] = np.where(np.isnan(raw[:, :-1]), (filled[k] - centre) / scale, raw[:, :-1])
                    w = np.where(y == 1, weights[k, 1], weights[k, 0])
                    if folds > 1:
                        w = w * (own != k)
                    z = u @ theta[k]
                    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                    out[k, 0] += w @ (np.logaddexp(0.0, z) - y * z)
                    out[k, 1 : 1 + size] += u.T @ (w * (p - y))
                    out[k, 1 + size :] += (u.T @ (u * (w * p * (1 - p))[:, None])).ravel()
            model, at = np.nonzero(out)
            yield pa.record_batch([pa.array(model.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(out[model, at])], ["model", "at", "value"])

        got = table.mapInArrow(add_up, "model int, at int, value double").groupBy("model", "at").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros((folds, 1 + size + size * size))
        out[got.column("model").to_numpy(), got.column("at").to_numpy()] = got.column("value").to_numpy()
        return out

    base, best = theta.copy(), np.full(folds, math.inf)
    slope = np.zeros_like(theta)
    for _ in range(PASSES if live else 0):
        got, largest = sums(theta), 0.0
        for k in live:
            loss = got[k, 0] + 0.5 * ridge[k] @ theta[k] ** 2
            if loss > best[k] + 1e-12 * abs(best[k]):
                # Too far: half the way.
                slope[k] /= 2
            else:
                h = got[k, 1 + size :].reshape(size, size) + np.diag(ridge[k])
                base[k], best[k] = theta[k], loss
                slope[k] = -_solved(h, got[k, 1 : 1 + size] + ridge[k] * theta[k], free[k])
            theta[k] = base[k] + slope[k]
            largest = max(largest, float(np.abs(slope[k]).max()))
        if largest < STEP:
            break
    out = []
    for k in range(folds):
        weight = np.zeros(d)
        weight[used] = theta[k, :-1] / scale
        out.append(Logistic(features, fills[k], weight, float(theta[k, -1] - weight[used] @ centre)))
    return out


def fit(rows: DataFrame, features: list[str]) -> Logistic:
    return fit_folds(rows, features, F.lit(0), 1)[0]


def _probability(models: list[Logistic], fold: Column) -> Column:
    """p by the model of a row's fold."""
    of = lambda values: F.get(F.array(*(F.lit(float(v)) for v in values)), fold)
    z = of(m.offset for m in models)
    for i, name in enumerate(models[0].features):
        if any(m.weight[i] for m in models):
            z = z + of(m.weight[i] for m in models) * F.coalesce(_known(name), of(m.fill[i] for m in models))
    return 1 / (1 + F.exp(-z))


def probability(model: Logistic, rows: DataFrame) -> DataFrame:
    """rows with p, the probability of being the same."""
    return rows.select("*", _probability([model], F.lit(0)).alias("p"))


def cross_validated(rows: DataFrame | Callable[[], DataFrame], features: list[str], folds: int = 5, labelled: DataFrame | None = None) -> DataFrame:
    """(a_id, b_id, truth, p): each pair scored by the model of the other folds; the fold comes from a hash of the pair.

    labelled: the same rows without features, where these cost much, and rows then a function that makes them. If no fold
    is learned from both classes, features tell nothing: they aren't made, and labelled is scored itself.
    """
    fold = F.pmod(F.xxhash64("a_id", "b_id"), F.lit(folds)).cast("int")
    if labelled is not None:
        classes = labelled.where("truth IS NOT NULL").groupBy(fold.alias("fold"), (F.col("truth") == "duplicate").alias("one")).count().collect()
        held = [{r.one for r in classes if r.fold != k} for k in range(folds)]
        if all(len(h) < 2 for h in held):
            none = np.zeros(0)
            models = [Logistic([], none, none, math.inf if True in h else -math.inf if h else 0.0) for h in held]
            return labelled.select("a_id", "b_id", "truth", _probability(models, fold).alias("p"))
    rows = rows() if callable(rows) else rows
    models = fit_folds(rows, features, fold, folds)
    return rows.select("a_id", "b_id", "truth", _probability(models, fold).alias("p"))
