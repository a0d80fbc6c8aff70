"""Gradient boosting of pairs on histograms, with missing values sent left or right and cross-fitted calibration.

Features become bins by their quantiles, once, and are written in one byte each. A tree grows level by level. For each
level every task adds up its rows' gradients by node, feature and bin, in whole numbers, so that sums don't depend on
their order, and Spark sums these up; splits are chosen on the driver from at most models * nodes * features * bins
sums, whatever the number of rows. A model for each fold's rest and one of all rows grow together, in the same passes.

The folds' own rows, each scored by the model that hasn't seen it, give the calibration: a logistic curve over raw
scores, fitted on a histogram of them.

Rows need a label that is 0 or 1; others, nulls too, are left out. Without rows, or with one class only, the model gives
the share of ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Bins of known values; one more holds missing ones.
BINS = 63
#: Gradients are summed as multiples of 2 ** -SHIFT, and calibration takes raw scores by this many a unit.
SHIFT, STEPS = 30, 50


@dataclass
class Tree:
    """A complete binary tree in arrays; node 1 is the top, and k has the children 2k and 2k + 1. feature -1: a leaf."""

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    missing_left: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        n = 2 << self.depth
        self.feature, self.bin, self.missing_left, self.value = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins has come to."""
        at = np.ones(len(bins), np.int32)
        for k in range(1, 1 << self.depth):
            if self.feature[k] < 0:
                continue
            own = bins[:, self.feature[k]]
            # A missing value's bin is above all others, so it goes right by itself.
            right = own > self.bin[k]
            if self.missing_left[k]:
                right &= own != BINS
            at = np.where(at == k, np.int32(2 * k) + right, at)
        return at


@dataclass
class Boosted:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, bins: np.ndarray) -> np.ndarray:
        return self.base + sum((t.value[t.nodes(bins)] for t in self.trees), np.zeros(len(bins)))


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Rows x features of bins; NaN is BINS."""
    out = np.empty(values.shape, np.uint8)
    for k, e in enumerate(edges):
        out[:, k] = np.where(np.isnan(values[:, k]), BINS, np.searchsorted(e, values[:, k], "left"))
    return out


def quantile_edges(rows: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Upper edges of bins: distinct quantiles of known values, but for the largest."""
    points = [k / BINS for k in range(1, BINS)]
    known = [F.percentile_approx(F.when(~F.isnan(c), F.col(c)), points, 10_000).alias(c) for c in features]
    got = rows.select(*(F.col(c).cast("double").alias(c) for c in features)).agg(*known).first()
    return [np.unique(np.array(got[c] or [], np.float64)) for c in features]


def _matrix(batch, first: int) -> np.ndarray:
    return np.column_stack([np.nan_to_num(c.to_numpy(zero_copy_only=False).astype(np.float64), nan=np.nan) for c in batch.columns[first:]])


def gradients(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-raw))
    scaled = lambda x: np.rint(x * (1 << SHIFT)).astype(np.int64)
    return scaled(weight * (p - label)), scaled(weight * p * (1 - p))


def summed(key: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by key: as doubles where these hold every sum exactly."""
    if np.abs(v.astype(np.float64)).sum() < 2.0**52:
        return np.bincount(key, v, size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, key, v)
    return out


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, penalty: float, least_rows: int) -> tuple | None:
    """(feature, bin, missing_left) of the greatest gain above zero, from features x (BINS + 1) sums; the first of equals."""
    unit = 1.0 / (1 << SHIFT)
    worth = lambda a, b: (a * unit) ** 2 / (b * unit + penalty)
    whole = worth(float(g[0].sum()), float(h[0].sum()))
    best, found = 1e-9, None
    for missing_left in (False, True):
        extra = (lambda x: x[:, BINS:]) if missing_left else (lambda x: np.zeros((len(x), 1), x.dtype))
        left = [np.cumsum(x[:, :BINS], axis=1)[:, :-1] + extra(x) for x in (g, h, n)]
        right = [x.sum(axis=1, keepdims=True) - a for x, a in zip((g, h, n), left, strict=True)]
        gain = np.where((left[2] >= least_rows) & (right[2] >= least_rows), worth(left[0].astype(float), left[1].astype(float)) + worth(right[0].astype(float), right[1].astype(float)) - whole, 0)
        at = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[at] > best:
            best, found = float(gain[at]), (int(at[0]), int(at[1]), missing_left)
    return found


def of_one_class(rows: DataFrame, features: list[str], label: str) -> Boosted | None:
    """The model of rows without both classes, which needs none of their features; None if both are there."""
    count = {r[0]: r["count"] for r in rows.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int")).count().collect()}
    if len(count) == 2:
        return None
    share = count.get(1, 0) / max(1, sum(count.values()))
    return Boosted(features, [], math.log((share + 1e-6) / (1 - share + 1e-6)), [])


def fit(rows: DataFrame, features: list[str], label: str, rounds: int = 40, depth: int = 3, rate: float = 0.15, penalty: float = 1.0, least_rows: int = 10, folds: int = 5, by: tuple[str, ...] = ("a_id", "b_id")) -> Boosted:
    """Both classes weigh the same. A row's fold comes from a hash of the columns `by`."""
    known = rows.where(F.col(label).isin(0, 1))
    alone = of_one_class(known, features, label)
    if alone:
        return alone
    edges = quantile_edges(known, features)
    own = known.select(F.pmod(F.xxhash64(*by), F.lit(folds)).cast("int").alias("fold"), F.col(label).cast("double").alias("label"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)))

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            bins = binned(_matrix(batch, 2), edges)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in bins], pa.binary())], ["fold", "label", "bins"])

    table = written(own.mapInArrow(pack, "fold int, label double, bins binary"), "binned")
    count = {(r.fold, r.label): r["count"] for r in table.groupBy("fold", "label").count().collect()}
    models, weights = [], []
    for out in [*range(folds), None]:
        ones, zeros = (sum(n for (f, y), n in count.items() if f != out and y == k) for k in (1.0, 0.0))
        weights.append((0.5 * (ones + zeros) / zeros, 0.5 * (ones + zeros) / ones) if ones and zeros else None)
        share = ones / max(1, ones + zeros)
        models.append(Boosted(features, edges, 0.0 if weights[-1] else math.log((share + 1e-6) / (1 - share + 1e-6)), []))
    spark, width, slots = rows.sparkSession, len(features), BINS + 1

    def level_sums(level: int) -> dict[tuple[int, int], list[np.ndarray]]:
        shared = spark.sparkContext.broadcast((models, weights))

        def add_up(batches):
            import pyarrow as pa

            models, weights = shared.value
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                fold, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                bins = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, width)
                for m, (model, weight) in enumerate(zip(models, weights, strict=True)):
                    use = fold != m
                    if weight is None or not use.any():
                        continue
                    tree, x = model.trees[-1], bins[use]
                    before = Boosted(model.features, model.edges, model.base, model.trees[:-1])
                    at = tree.nodes(x) - (1 << level)
                    live = (at >= 0) & (at < 1 << level)
                    if not live.any():
                        continue
                    g, h = gradients(before.raw(x), y[use], np.where(y[use] == 1, weight[1], weight[0]))
                    total = sums.setdefault(m, np.zeros((3, (1 << level) * width * slots), np.int64))
                    key = ((at[live, None] * width + np.arange(width)[None, :]) * slots + x[live]).ravel()
                    for k, v in enumerate((g[live], h[live], np.ones(live.sum(), np.int64))):
                        total[k] += summed(key, np.repeat(v, width), total.shape[1])
            for m, total in sums.items():
                some = np.flatnonzero(total[2])
                yield pa.record_batch([pa.array(np.full(len(some), m, np.int32)), pa.array(some.astype(np.int32)), *(pa.array(total[k, some]) for k in range(3))], ["model", "key", "g", "h", "n"])

        got = table.select("fold", "label", "bins").mapInArrow(add_up, "model int, key int, g long, h long, n long").groupBy("model", "key").agg(*(F.sum(c).alias(c) for c in "ghn")).toArrow()
        model, key = got.column("model").to_numpy(), got.column("key").to_numpy()
        out = {}
        for m in np.unique(model).tolist():
            own = model == m
            sums = np.zeros((3, (1 << level) * width * slots), np.int64)
            for k, c in enumerate("ghn"):
                sums[k, key[own]] = got.column(c).to_numpy()[own]
            for node, part in enumerate(np.moveaxis(sums.reshape(3, 1 << level, width, slots), 1, 0)):
                if part[2].any():
                    out[m, (1 << level) + node] = list(part)
        shared.unpersist()
        return out

    unit = 1.0 / (1 << SHIFT)
    for _ in range(rounds):
        for model in models:
            model.trees.append(Tree(depth))
        for level in range(depth):
            for (m, node), (g, h, n) in level_sums(level).items():
                tree = models[m].trees[-1]
                if level == 0:
                    tree.value[node] = -rate * g[0].sum() * unit / (h[0].sum() * unit + penalty)
                split = best_split(g, h, n, penalty, least_rows)
                if split is None:
                    continue
                f, b, missing_left = split
                tree.feature[node], tree.bin[node], tree.missing_left[node] = f, b, missing_left
                left = [x[f, : b + 1].sum() + (x[f, BINS] if missing_left else 0) for x in (g, h)]
                for child, (cg, ch) in ((2 * node, left), (2 * node + 1, [x[f].sum() - a for x, a in zip((g, h), left, strict=True)])):
                    tree.value[child] = -rate * cg * unit / (ch * unit + penalty)
    done = models[-1]
    done.slope, done.offset = _calibrated(table, models, width)
    return done


def _calibrated(table: DataFrame, models: list[Boosted], width: int) -> tuple[float, float]:
    """Slope and offset of the logistic curve from raw scores of rows, each by its own fold's model, to probabilities."""
    shared = table.sparkSession.sparkContext.broadcast(models)

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            fold, bins = batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, width)
            raw = np.zeros(len(fold))
            for m in np.unique(fold).tolist():
                raw[fold == m] = shared.value[m].raw(bins[fold == m])
            yield pa.record_batch([pa.array(np.rint(np.clip(raw, -20, 20) * STEPS).astype(np.int32)), batch.column(1)], ["step", "label"])

    got = table.mapInArrow(scan, "step int, label double").groupBy("step").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).orderBy("step").toArrow()
    x, n, ones = (got.column(c).to_numpy().astype(np.float64) for c in ("step", "n", "ones"))
    return logistic_curve(x / STEPS, n, ones)


def logistic_curve(x: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[float, float]:
    """Newton's method on the penalised likelihood of ones among n at x; both ends count as one more doubtful row."""
    slope, offset = 1.0, 0.0
    # Targets a little inside of 0 and 1 keep the curve finite where scores part the classes.
    total, hits = n.sum(), ones.sum()
    high, low = (hits + 1) / (hits + 2), 1 / (total - hits + 2)
    target = ones * high + (n - ones) * low
    for _ in range(100):
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        d, w = target - n * p, n * p * (1 - p) + 1e-12
        a = np.array([[np.sum(w * x * x) + 1e-6, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-6]])
        step = np.linalg.solve(a, np.array([np.sum(d * x), np.sum(d)]))
        size = min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        slope, offset = slope + size * float(step[0]), offset + size * float(step[1])
        if np.abs(step).max() < 1e-10:
            break
    return slope, offset


def probability(model: Boosted, rows: DataFrame) -> DataFrame:
    """rows with p, the calibrated probability of label 1."""
    from pyspark.sql import types as T

    if not model.trees:
        return rows.withColumn("p", F.lit(1 / (1 + math.exp(-(model.slope * model.base + model.offset)))))
    names = rows.columns
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields, T.StructField("p", T.DoubleType())])

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            m = shared.value
            bins = binned(_matrix(batch, len(names)), m.edges)
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(1 / (1 + np.exp(-(m.slope * m.raw(bins) + m.offset))))], [*names, "p"])

    return rows.select("*", *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(model.features))).mapInArrow(scan, schema)
