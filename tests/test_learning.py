"""The pair model by a plain solver: medians for gaps, scaled features, balanced weights, penalised logistic regression."""

import numpy as np
from pyspark.sql import functions as F

from parcelyn.operators import learning


def plain_probabilities(x, y, new, penalty=0.01):
    """Newton steps on the weighted log-likelihood, the penalty on coefficients of features of weighted deviation 1."""
    median = np.array([np.sort(c[~np.isnan(c)])[(np.sum(~np.isnan(c)) - 1) // 2] for c in x.T])
    x, new = (np.where(np.isnan(a), median, a) for a in (x, new))
    mean, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    sd[sd == 0] = 1.0
    x, new = (x - mean) / sd, (new - mean) / sd
    w = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    w /= w.sum()
    spread = np.sqrt((w[:, None] * (x - w @ x) ** 2).sum(axis=0) / (1 - (w**2).sum()))
    a, theta = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    ridge = np.append(penalty * spread**2, 0.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ theta))
        step = np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + np.diag(ridge + 1e-12), a.T @ (w * (p - y)) + ridge * theta)
        theta -= step
        if np.abs(step).max() < 1e-10:
            break
    return 1 / (1 + np.exp(-np.hstack([new, np.ones((len(new), 1))]) @ theta))


def test_probabilities_by_a_plain_solver(spark):
    rng = np.random.default_rng(2)
    n = 400
    x = rng.normal(size=(n, 3)) * [1.0, 20.0, 0.1] + [0.0, 5.0, 1.0]
    y = (x[:, 0] + x[:, 1] / 20 + rng.normal(size=n) > 1.2).astype(int)
    x[rng.random((n, 3)) < 0.1] = np.nan
    rows = spark.createDataFrame([(i, *map(float, r), "duplicate" if t else "different") for i, (r, t) in enumerate(zip(x, y))], "id int, f0 double, f1 double, f2 double, truth string")
    names = ["f0", "f1", "f2"]
    train, test = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
    got = {r.id: r.p for r in learning.probability(learning.fit(train, names), test).select("id", "p").collect()}
    part = np.arange(n) % 4 != 0
    due = plain_probabilities(x[part], y[part], x[~part])
    assert np.abs(np.array([got[i] for i in np.flatnonzero(~part).tolist()]) - due).max() < 0.01


def test_folds_score_each_pair_once(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("a_id"), (F.col("id") + 1).cast("string").alias("b_id"), (F.col("id") % 7).cast("double").alias("f0"), F.when(F.col("id") % 7 > 3, "duplicate").otherwise("different").alias("truth"))
    got = learning.cross_validated(rows, ["f0"], 3).collect()
    assert len({(r.a_id, r.b_id) for r in got}) == len(got) == 300
    assert all((r.p > 0.5) == (r.truth == "duplicate") for r in got)


def _pairs(spark, one):
    """Pairs whose class depends on two features, one of them with gaps, or that are all of one class."""
    n = F.col("id")
    truth = F.when((F.col("f0") + F.col("f1") / 20 + F.rand(5) > 1.6) if one else F.lit(False), "duplicate").otherwise("different")
    x = spark.range(600).select(n.cast("string").alias("a_id"), (n + 1).cast("string").alias("b_id"), (n % 7 / 5.0).alias("f0"), (n * 37 % 101 / 5.0).alias("f1"), F.lit(3.0).alias("f2"), "id")
    x = x.withColumn("truth", truth).withColumn("f1", F.when(n % 9 == 0, F.lit(float("nan"))).otherwise(F.col("f1")))
    return x.drop("id").localCheckpoint()


def test_folds_fitted_together_are_those_fitted_apart(spark):
    x, names, folds = _pairs(spark, True), ["f0", "f1", "f2"], 3
    fold = F.pmod(F.xxhash64("a_id", "b_id"), F.lit(folds)).cast("int")
    got = {r.a_id: r.p for r in learning.cross_validated(x, names, folds).collect()}
    rows = x.withColumn("fold", fold).collect()
    values = lambda own: np.array([[r.f0, r.f1] for r in own])
    for k in range(folds):
        train, test = [r for r in rows if r.fold != k], [r for r in rows if r.fold == k]
        due = plain_probabilities(values(train), np.array([int(r.truth == "duplicate") for r in train]), values(test))
        assert np.abs(np.array([got[r.a_id] for r in test]) - due).max() < 1e-6


def test_features_are_not_made_for_one_class(spark):
    def never():
        raise AssertionError("features were made")

    x = _pairs(spark, False)
    got = learning.cross_validated(never, ["f0", "f1"], 3, labelled=x.select("a_id", "b_id", "truth")).collect()
    assert len(got) == 600 and all(r.p == 0 for r in got)
    assert [r.p for r in learning.cross_validated(x, ["f0", "f1"], 3).collect()] == [0.0] * 600
    two = _pairs(spark, True)
    both = [learning.cross_validated(lambda: two, ["f0", "f1"], 3, labelled=two.select("a_id", "b_id", "truth")), learning.cross_validated(two, ["f0", "f1"], 3)]
    a, b = ({r.a_id: round(r.p, 9) for r in x.collect()} for x in both)
    assert a == b
