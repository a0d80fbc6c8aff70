"""The vector index against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelyn.config import DEFAULT
from parcelyn.operators import pairs as P
from parcelyn.operators import vectors as V
from parcelyn.plans import catalogue

KIND = "id long, source_domain string, price double, size_sqm double, embedding array<float>"


def listings_of(n, dim, groups, seed, equal=0):
    """Noisy copies of a few directions, some rows with missing values, some with one and the same vector."""
    rng, gen = random.Random(seed), np.random.default_rng(seed)
    heads = gen.normal(size=(groups, dim))
    rows = []
    for i in range(n):
        v = heads[rng.randrange(groups)] + gen.normal(size=dim) * rng.choice([0.1, 0.3])
        rows.append((i, rng.choice(["a", "b", "c", None]) if i % 9 == 0 else rng.choice("abc"), rng.choice([None, 0.0, 100.0, 120.0, 150.0, 500.0]), rng.choice([None, 50.0, 55.0, 80.0]), [float(np.float32(x)) for x in v]))
    rows += [(10_000 + i, rng.choice("ab"), None, None, [1.0] + [0.0] * (dim - 1)) for i in range(equal)]
    rows += [(20_000, "a", 1.0, 1.0, None), (20_001, "a", 1.0, 1.0, [0.0] * dim), (20_002, "b", 1.0, 1.0, [1.0, 2.0]), (20_003, "a", 1.0, 1.0, [1.0, 2.0]), (20_004, "c", None, None, [])]
    return rows


def cosine(v, w):
    if not v or not w or len(v) != len(w):
        return None
    v, w = np.array(v), np.array(w)
    size = float(np.sqrt(v @ v) * np.sqrt(w @ w))
    return float(v @ w) / size if size > 0 else None


def brute(rows, reject, k):
    near = lambda p, q, most: not (p and q) or abs(p - q) / max(p, q) < most
    out = {}
    for i, s, p, z, v in rows:
        found = []
        for j, t, q, y, w in rows:
            c = cosine(v, w) if i < j and s and t and s != t and near(p, q, DEFAULT.price_tolerance) and near(z, y, DEFAULT.size_tolerance) else None
            if c is not None and c > reject:
                found.append((-round(c, 9), j))
        for c, j in sorted(found)[:k]:
            out[i, j] = -c
    return out


@pytest.mark.parametrize(("reject", "block", "equal"), [(0.92, 2048, 0), (0.5, 64, 0), (-0.2, 50, 70), (0.985, 16, 150)])
def test_similar_pairs_lose_nothing(spark, monkeypatch, reject, block, equal):
    """Missing prices, equal vectors in a third of all rows, other lengths, blocks that split cells: exactly the pairs."""
    monkeypatch.setattr(V, "BLOCK", block)
    rows = listings_of(300, 24, 12, 3, equal)
    got = P.similar_pairs(spark.createDataFrame(rows, KIND).repartition(3), DEFAULT, reject).collect()
    due = brute(rows, reject, DEFAULT.candidates_per_listing)
    assert {(r.a_id, r.b_id) for r in got} == set(due) and len(got) == len(due)
    assert all(abs(r.similarity - due[r.a_id, r.b_id]) < 1e-6 for r in got)


def test_recall_of_probes(spark):
    """At least 0.95 of the 50 nearest on the driver's vectors, with a part of the cells probed, every row indexed."""
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    rows = [(r.id, np.array(r.embedding, np.float64)) for r in frame.collect()]
    ids, m = np.array([i for i, _ in rows]), np.array([v / np.linalg.norm(v) for _, v in rows])
    near = m @ m.T
    np.fill_diagonal(near, -2)
    cells = V.fit(frame)
    assert V.indexed(frame, cells).select("id").distinct().count() == len(rows)
    probes = V.probes_needed(frame, cells, 50)
    assert 1 < probes <= len(cells[64])
    found = {}
    for r in V.best(frame, 50, lambda a, b: a["rank"] != b["rank"], probes=probes, cells=cells).collect():
        found.setdefault(r.a_id, set()).add(r.b_id)
    recall = np.mean([len(found[i] & set(ids[np.argsort(-near[k])[:50]].tolist())) / 50 for k, i in enumerate(ids.tolist())])
    assert recall >= 0.95, (probes, recall)


def test_few_probes_where_vectors_cluster(spark):
    rows = listings_of(600, 32, 40, 11)
    frame = spark.createDataFrame(rows, KIND).where("id < 10000").select("id", "embedding")
    cells = V.fit(frame, cells=24)
    assert V.probes_needed(frame, cells, 5) <= 6


def test_recall_of_the_registered_query(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in frame.collect()]
    ids, m = [i for i, _ in rows], np.array([v / np.linalg.norm(v) for _, v in rows])
    near = m @ m.T
    np.fill_diagonal(near, -2)
    got = {(r.a_id, r.b_id) for r in catalogue.QUERIES["index_neighbours"](spark, "/root/testdata/sf0.001").collect()}
    due = {(ids[k], ids[j]) for k in range(len(ids)) for j in np.argsort(-near[k])[:10]}
    assert len(got) == len(due) and len(got & due) >= 0.95 * len(due), len(got & due) / len(due)


def test_few_queries_and_no_rows(spark):
    rows = listings_of(200, 16, 5, 7)
    frame = spark.createDataFrame(rows, KIND)
    got = V.best(frame, 3, lambda a, b: a["rank"] != b["rank"], above=-1.0, queries=F.col("id") % 50 == 0)
    assert {r.a_id for r in got.collect()} == {r[0] for r in rows if r[0] % 50 == 0 and cosine(r[4], r[4])}
    assert P.similar_pairs(frame.where("id < 0")).count() == 0


def met(n, k, above, seed=1, spread=1.0, cells=40, later=False):
    """Pairs that one group of queries hands on after it has met n members cell by cell, with their true similarities."""
    gen = np.random.default_rng(seed)
    m = gen.normal(size=n * 24).reshape(n, 24) * spread + (spread < 1)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    heads = V.centroids(m, cells).astype(np.float32)
    r = V._rounded(m, {24: heads})
    x, error, rank = np.frombuffer(b"".join(r["code"]), np.int8).reshape(n, -1) * r["scale"][:, None], r["error"].astype(float), np.arange(n)
    held = {c: float(r["angle"][r["cell"] == c].max()) for c in np.unique(r["cell"]).tolist()}
    digest = np.array([np.frombuffer(d, np.int64, 2) for d in r["digest"]])
    group, out = V._Group(x[::5], error[::5], rank[::5], {}, k, above, 8, later, heads, held), []
    for c in held:
        at = np.flatnonzero(r["cell"] == c)
        out += group.meet(c, x[at], error[at], rank[at], {}, digest[at], lambda a, b: a["rank"] != b["rank"], 64)
    out += group.rest()
    near = m[::5] @ m.T
    near[np.arange(len(near)), rank[::5]] = -2
    if later:
        near[rank[None, :] < rank[::5][:, None]] = -2
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out]), near


def test_a_group_hands_on_few_pairs_however_many_cells():
    """Not the k best of each cell that a query probes, which are shuffled, but those of all."""
    a, b, near = met(4000, 10, -1.0, cells=200)
    assert len(a) < 800 * 10 * 4
    due = {(q * 5, int(j)) for q in range(len(near)) for j in np.argsort(-near[q])[:10]}
    assert due <= set(zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("later", [False, True])
def test_a_group_holds_few_pairs_of_near_copies(monkeypatch, later):
    """Near copies can't be told apart by rounded vectors: they are handed on early, none twice and none lost."""
    monkeypatch.setattr(V, "HELD", 2000)
    a, b, near = met(1500, 3, 0.2, spread=0.001, cells=4, later=later)
    got = list(zip(a.tolist(), b.tolist(), strict=True))
    due = {(q * 5, int(j)) for q in range(len(near)) for j in np.argsort(-near[q])[:3] if near[q, j] > 0.2}
    assert due <= set(got) and len(got) == len(set(got)) > 2000
