"""Invariants over random inputs: symmetry of pairs, components, idempotent upserts, one approved cluster a component."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelyn.operators import clusters as K
from parcelyn.operators import scoring as S
from parcelyn.operators.graph import components
from parcelyn.plans import catalogue
from parcelyn.storage import latest, upsert

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_swapped_pairs_get_the_same_verdict(spark):
    x = catalogue.blocked(spark, "/root/testdata/sf0.001")
    turned = x.select(*(F.col(("b_" if c[:2] == "a_" else "a_") + c[2:]).alias(c) if c[:2] in ("a_", "b_") else F.col(c) for c in x.columns))
    one = {(r.a_id, r.b_id): (r.verdict, round(r.confidence, 9), r.tier) for r in S.rule_scores(x).collect()}
    two = {(r.b_id, r.a_id): (r.verdict, round(r.confidence, 9), r.tier) for r in S.rule_scores(turned).collect()}
    assert one == two and one


@FEW
@given(st.integers(0, 10_000))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(80))]
    # A long chain settles too.
    edges += [(100 + i, 101 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    due = {x: find(x) for x in root}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == due


@FEW
@given(st.lists(st.tuples(st.integers(0, 8), st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.sampled_from("xy"))), max_size=12))
def test_upsert_is_idempotent(spark, rows):
    schema = "id int, price int, status string"
    old = spark.createDataFrame([(i, i, "old") for i in range(5)], schema)
    new = latest(spark.createDataFrame([(*r,) for r in rows], schema).withColumn("at", F.lit(1)), ["id"], "at").drop("at")
    once = upsert(old, new, ["id"], protected=("status",))
    twice = upsert(once, new, ["id"], protected=("status",))
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, twice.collect()), key=repr)
    assert {r.id: r.status for r in once.where("id < 5").collect()} == dict.fromkeys(range(5), "old")


@FEW
@given(st.integers(0, 10_000))
def test_one_approved_cluster_a_component(spark, seed):
    rng = random.Random(seed)
    name = lambda i: f"p{i:02d}"
    pairs = {tuple(sorted(rng.sample(range(20), 2))) for _ in range(14)}
    duplicates = spark.createDataFrame([(name(a), name(b), 0.5 + rng.random() / 2) for a, b in sorted(pairs)], "a_id string, b_id string, confidence double")
    seeds = spark.createDataFrame([(name(i), f"C{i % 3}") for i in range(0, 20, 4)], "property_id string, cluster_id string")
    known = spark.createDataFrame([(f"C{i}",) for i in range(3)], "id string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    members, _, _ = K.seeded_components(duplicates, seeds, known)
    rows = members.collect()
    by_root = {}
    for r in rows:
        by_root.setdefault(r.root, set()).add(r.cluster_id)
    assert len({r.property_id for r in rows}) == len(rows)
    assert all(len(c) == 1 for c in by_root.values())
