"""Toxicity grades by cumulative-link (proportional-odds) ordinal regression on sparse text features.

P(grade > k) = logistic(w . x - c_k): all thresholds c_0 < c_1 < ... share the weights w. x has log(1 + count) for each
hashed word and each hashed stem (a word's first STEM letters); words are letters only, lower-cased. Those whose share of
toxic documents differs from the rest's beyond chance get a weight, the others' is 0. The result is the expected
severity, the sum of P(grade > k).

Labels say toxic or not. Grades of the labelled toxic documents are thirds of a cross-fitted score: each half of the
sample is scored by a model of two grades that was fitted on the other half, so a document's grade doesn't come from
its own label.

The model is fitted on a bounded sample of labelled rows (`most_labels`: half of them toxic, or more of one kind where
the other has fewer, in the order of a hash of doc_id). Rows are weighted so that the kinds count as among all labels.
Words are counted on the executors; of the sample only the features with a weight reach the driver. Every document is
scored.

Defined results: null text has no words and the score of an empty document; a null doc_id and repeated rows are kept as
rows; labels with null toxic are left out; an empty table gives an empty result, and without labels of both kinds every
severity is 0; only doc_id and text, and doc_id and toxic of labels, are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Words take the lower half of all features, stems the upper half.
FEATURES = 1 << 20
STEM = 5
GRADES = 4
#: A word gets a weight if so many labelled documents hold it, and if it lies so many standard errors from chance.
LEAST_DOCS, LEAST_Z = 5, 6.0
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> tuple[int, int]:
    """The numbers of a word and of its stem."""
    half = FEATURES // 2
    return crc32(word.encode("utf-8", "surrogatepass")) % half, half + crc32(word[:STEM].encode("utf-8", "surrogatepass")) % half


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, ascending, and how often each occurs."""
    found: dict[int, int] = {}
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        for at in features_of(word):
            found[at] = found.get(at, 0) + n
    at = np.array(sorted(found), np.int64)
    return at, np.array([found[k] for k in at.tolist()], np.int64)


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    cuts: np.ndarray

    def severity(self, score: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -60, 60)))).sum(axis=1)


def _standard_errors(clean: Column, toxic: Column, n0: int, n1: int) -> Column:
    """How far a feature's share among toxic documents is from that among clean ones."""
    p = (clean + toxic) / (n0 + n1)
    return F.abs(toxic / n1 - clean / n0) / F.sqrt(F.greatest(p * (F.lit(1.0) - p), F.lit(1e-9)) * (1 / n0 + 1 / n1))


def cross_fitted(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each row's score by a model of two grades, fitted on the rows of the other parity."""
    fold, out = np.arange(len(rows)) % 2, np.zeros(len(rows))
    for k in (0, 1):
        at = np.flatnonzero(fold != k)
        if not len(at) or toxic[at].all() or not toxic[at].any():
            at = np.arange(len(rows))
        model = fit_ordinal([rows[i] for i in at], toxic[at].astype(np.int64), weights[at], levels=2)
        out[fold == k] = [model.weights[a] @ np.log1p(n) for (a, n), f in zip(rows, fold, strict=True) if f == k]
    return out


def graded(scores: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for clean rows, 1 to GRADES - 1 for toxic ones by equal parts of their scores."""
    edges = np.quantile(scores[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    return np.where(toxic, 1 + np.searchsorted(edges, scores, "left"), 0)


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, weights: np.ndarray, levels: int = GRADES, penalty: float = 0.001, rounds: int = 500, rate: float = 0.05) -> OrdinalModel:
    """Adam on the penalised, weighted log-likelihood; cuts are kept apart as a first cut and positive steps."""
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([np.log1p(r[1]) for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    used, at = np.unique(at, return_inverse=True)
    importance = weights / weights.sum()
    w, theta = np.zeros(len(used)), np.array([1.0, *np.zeros(levels - 2)])
    m, v = np.zeros(len(w) + len(theta)), np.zeros(len(w) + len(theta))

    def cdf(x):
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))

    for step in range(1, rounds + 1):
        cuts = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        score = np.bincount(owner, value * w[at], len(rows))
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        up, down = cdf(edge[grades + 1] - score), cdf(edge[grades] - score)
        up[grades == levels - 1], down[grades == 0] = 1.0, 0.0
        p = np.maximum(up - down, 1e-12)
        du, dd = up * (1 - up) / p * importance, down * (1 - down) / p * importance
        ds = du - dd
        gw = np.bincount(at, value * ds[owner], len(w)) + penalty * w
        gc = np.zeros(levels - 1)
        np.add.at(gc, grades[grades < levels - 1], -du[grades < levels - 1])
        np.add.at(gc, grades[grades > 0] - 1, dd[grades > 0])
        tail = np.cumsum(gc[::-1])[::-1]
        g = np.concatenate([gw, tail[:1], tail[1:] * np.exp(theta[1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, theta = w - move[: len(w)], theta - move[len(w) :]
    whole = np.zeros(FEATURES)
    whole[used] = w
    return OrdinalModel(whole, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = 6000) -> OrdinalModel:
    """Fit on at most most_labels labelled documents."""
    bounded_batches(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("int") > 0).alias("toxic")).where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    number = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    order, half = F.xxhash64("doc_id"), most_labels // 2
    limit = {k: max(half, most_labels - number.get(not k, 0)) for k in (True, False)}
    chosen = marks.where("toxic").orderBy(order, "doc_id").limit(limit[True]).union(marks.where("NOT toxic").orderBy(order, "doc_id").limit(limit[False]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = written(rows.select("doc_id", "text", "toxic"), "labelled")

    def tally(batches):
        import pyarrow as pa

        seen = np.zeros((2, FEATURES), np.int32)
        for batch in batches:
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen[int(toxic), counted(text)[0]] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(seen[0, at].astype(np.int64)), pa.array(seen[1, at].astype(np.int64))], ["at", "clean", "toxic"])

    taken = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(taken) < 2:
        return OrdinalModel(np.zeros(FEATURES), np.full(GRADES - 1, 60.0))
    held = sample.mapInArrow(tally, "at int, clean long, toxic long").groupBy("at").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    far = _standard_errors(F.col("clean"), F.col("toxic"), taken[False], taken[True]) >= LEAST_Z
    telling = np.array(sorted(r["at"] for r in held.where(far & (F.col("clean") + F.col("toxic") >= LEAST_DOCS)).select("at").collect()), np.int64)

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            found = [(a[own], n[own]) for a, n in map(counted, batch.column(1).to_pylist()) for own in [np.isin(a, telling)]]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([a.tolist() for a, _ in found], pa.list_(pa.int32())), pa.array([n.tolist() for _, n in found], pa.list_(pa.int32()))], ["doc_id", "toxic", "at", "n"])

    got = sample.mapInArrow(scan, "doc_id long, toxic boolean, at array<int>, n array<int>").toArrow().sort_by("doc_id")
    toxic = np.array(got.column("toxic").to_pylist(), bool)
    sparse = [(np.array(a, np.int64), np.array(n, np.int64)) for a, n in zip(got.column("at").to_pylist(), got.column("n").to_pylist(), strict=True)]
    weights = np.where(toxic, number[True] / taken[True], number[False] / taken[False])
    return fitted(sparse, toxic, weights)


def fitted(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, weights: np.ndarray) -> OrdinalModel:
    return fit_ordinal(rows, graded(cross_fitted(rows, toxic, weights), toxic), weights)


def score(docs: DataFrame, model: OrdinalModel, least: float = 0.5) -> DataFrame:
    """(doc_id, severity, grade, toxic): expected severity, rounded to a grade; toxic from `least` on."""
    bounded_batches(docs.sparkSession)
    used = np.flatnonzero(model.weights)
    kept, cuts = dict(zip(used.tolist(), model.weights[used].tolist(), strict=True)), model.cuts

    def scan(batches):
        import pyarrow as pa

        own = OrdinalModel(np.zeros(0), cuts)
        memo: dict[str, list[int]] = {}
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                found: dict[int, int] = {}
                for word, n in Counter(_WORD.findall((text or "").lower())).items():
                    numbers = memo.get(word)
                    if numbers is None:
                        if len(memo) >= 500_000:
                            memo.clear()
                        numbers = memo[word] = [at for at in features_of(word) if at in kept]
                    for at in numbers:
                        found[at] = found.get(at, 0) + n
                scores.append(sum(kept[at] * math.log1p(n) for at, n in sorted(found.items())))
            s = own.severity(np.array(scores, np.float64))
            yield pa.record_batch([batch.column(0), pa.array(np.round(s, 6)), pa.array(np.floor(s + 0.5).astype(np.int32)), pa.array(s >= least)], ["doc_id", "severity", "grade", "toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, severity double, grade int, toxic boolean")
