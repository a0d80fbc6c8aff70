"""Ordered union against a sequential one; clusters grown by batches against a full run."""

import random

import pytest
from pyspark.sql import functions as F

from parcelyn.config import Bands, Config
from parcelyn.operators import clusters as K
from parcelyn.operators import incremental as I
from parcelyn.operators.graph import components
from parcelyn.plans.listings import listings

SMALL = "/root/testdata/sf0.001"
#: Bands at which some of the driver's listings are duplicates.
LOOSE = Config(bands=Bands(strong_same=0.0, weak_same=-0.1, strong_different=-0.9, weak_different=-0.8))


def sequential(edges, labels):
    """Members and blocked edges, edge by edge."""
    parent, label = {}, {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    blocked = set()
    for a, b in edges:
        for n in (a, b):
            find(n)
            if n in labels:
                label[n] = labels[n]
    for a, b in sorted(edges):
        p, q = sorted((find(a), find(b)))
        if p == q:
            continue
        la, lb = label.get(p), label.get(q)
        if la and lb and la != lb:
            blocked.add((a, b, min(la, lb), max(la, lb)))
            continue
        parent[q] = p
        if la or lb:
            label[p] = la or lb
    return {n: (find(n), label.get(find(n))) for n in parent}, blocked


@pytest.mark.parametrize("seed", range(5))
def test_ordered_union_as_in_sequence(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([12, 40, 120])
    name = [f"n{x:03d}" for x in rng.sample(range(1000), n)]
    edges = {tuple(sorted(rng.sample(name, 2))) for _ in range(rng.randint(n // 2, 2 * n))}
    if seed == 1:  # a chain in order, labelled at both ends
        edges = set(zip(sorted(name), sorted(name)[1:], strict=False))
    labels = {x: rng.choice("ABCD") for x in name if rng.random() < (0.05, 0.15, 0.5)[seed % 3]}
    if seed == 1:
        labels = {min(name): "A", max(name): "B", sorted(name)[n // 2]: "A"}
    members, blocked = K.ordered_union(spark.createDataFrame(sorted(edges), "a_id string, b_id string"), spark.createDataFrame(list(labels.items()) or [("x", "Z")], "node string, cluster_id string"))
    due, left_out = sequential(edges, labels)
    assert {r.node: (r.root, r.cluster_id) for r in members.collect()} == due
    assert {tuple(r) for r in blocked.collect()} == left_out


def test_ordered_union_of_no_edges(spark):
    members, blocked = K.ordered_union(spark.createDataFrame([], "a_id string, b_id string"), spark.createDataFrame([("a", "A")], "node string, cluster_id string"))
    assert members.count() == 0 and blocked.count() == 0


def full_run(rows):
    found = I.scored_with_pool(rows, rows.limit(0), LOOSE)
    joined = components(found.where("verdict = 'duplicate'").select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    at = rows.select(F.col("id").alias("node")).join(joined, "node", "left").select("node", F.coalesce("root", "node"))
    return {tuple(r) for r in at.collect()}, {tuple(r) for r in found.select("a_id", "b_id", "verdict").collect()}


@pytest.mark.parametrize("batches", [1, 4])
def test_any_split_gives_the_full_run(spark, tmp_path, batches):
    rows = listings(spark, SMALL).withColumn("part", F.pmod(F.xxhash64("id", F.lit(batches)), F.lit(batches))).cache()
    due, verdicts = full_run(rows.drop("part"))
    state = I.GrowingClusters(spark, f"{tmp_path}/state", LOOSE)
    state.create(rows.drop("part"), buckets=4)
    for k in range(batches):
        assert state.absorb(rows.where(F.col("part") == k).drop("part"), k)
    assert {tuple(r) for r in state.clusters().collect()} == due
    assert {tuple(r) for r in state.verdicts().select("a_id", "b_id", "verdict").collect()} == verdicts
    assert len({r for _, r in due}) < len(due)
    # A repeated batch changes nothing.
    assert not state.absorb(rows.drop("part"), batches - 1) and {tuple(r) for r in state.clusters().collect()} == due


def test_merges_of_merged_roots(spark, tmp_path):
    """Links that arrive in bad order: roots move several times, and nodes of old batches aren't rewritten."""
    rng = random.Random(3)
    state = I.GrowingClusters(spark, f"{tmp_path}/state")
    state.create(spark.createDataFrame([], "id string"), buckets=3)
    links = [(f"n{a:02d}", f"n{b:02d}") for a, b in (rng.sample(range(60), 2) for _ in range(45))]
    seen = []
    for k in range(5):
        part = [tuple(sorted(x, reverse=True)) for x in links[k * 9 : k * 9 + 9]]
        seen += part
        nodes, roots = state.merged(spark.createDataFrame(part, "a string, b string"), spark.createDataFrame([(f"n{k:02d}",)], "node string"))
        state.tables.change({"nodes": nodes, "roots": roots})
        due, _ = sequential({tuple(sorted(x)) for x in seen}, {})
        got = {r.node: r.root for r in state.clusters().collect()}
        assert got == {**{f"n{i:02d}": f"n{i:02d}" for i in range(k + 1)}, **{n: r for n, (r, _) in due.items()}}


def test_stream_of_listings(spark, tmp_path):
    rows = listings(spark, SMALL).repartition(4, "id")
    rows.write.parquet(f"{tmp_path}/in")
    state = I.GrowingClusters(spark, f"{tmp_path}/state", LOOSE)
    state.create(rows, buckets=4)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    I.grow(stream, state, f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    due, _ = full_run(spark.read.parquet(f"{tmp_path}/in"))
    assert {tuple(r) for r in state.clusters().collect()} == due


def test_verdicts_of_earlier_batches_stay_where_they_are(spark, tmp_path):
    """A batch appends its verdicts; those of a listing that comes again are the latest ones."""
    rows = listings(spark, SMALL).cache()
    first, more = rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) > 0), rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) == 0)
    state = I.GrowingClusters(spark, f"{tmp_path}/state", LOOSE)
    state.create(rows, buckets=2)
    assert state.absorb(first, 0)
    before = state.tables._state()["tables"]["verdicts"]["paths"]
    dearer = first.where(F.pmod(F.xxhash64("id"), F.lit(5)) == 0).withColumn("price", F.col("price") * 9)
    assert state.absorb(more.unionByName(dearer), 1)
    after = state.tables._state()["tables"]["verdicts"]["paths"]
    assert before and before.items() <= after.items()
    now = first.join(dearer.select("id"), "id", "left_anti").unionByName(more).unionByName(dearer)
    due = {tuple(r) for r in I.scored_with_pool(now, now.limit(0), LOOSE).select("a_id", "b_id", "verdict").collect()}
    got = [tuple(r) for r in state.verdicts().select("a_id", "b_id", "verdict").collect()]
    assert set(got) == due and len(got) == len(due)
