"""Pairs measured by blocks in Arrow tasks are those of the join, with the same values."""

import math

import pytest
from pyspark.sql import functions as F

from parcelyn.functions import matching as M
from parcelyn.operators import pairs as P
from parcelyn.plans import catalogue
from parcelyn.sources.readers import table

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["price", "source_domain", "area", "photos"]


def _listings(spark):
    """Two municipalities; vectors and values that are missing, of other lengths, of length zero or not numbers."""
    rows = []
    for i in range(70):
        vector = [math.sin(i * k + 1) for k in range(1, 5)]
        vector = {3: None, 5: [0.0] * 4, 7: [1.0, None, 2.0, 3.0], 9: [1.0, 2.0], 11: [float("nan")] * 4, 13: []}.get(i % 20, vector)
        place = (None, 23.0) if i % 9 == 0 else (float("nan"), 23.0) if i % 9 == 1 else (39.0 + i % 6, 23.0 + i % 4)
        photos = None if i % 8 == 0 else [f"h{k}" for k in range(i % 5)] + ["h0", f"own{i}"]
        source = None if i == 20 else f"s{i % 3}"
        area = None if i % 11 == 0 else f"a{i % 2}"
        rows.append((f"{i * 37 % 101:03d}", source, "N" if i % 7 else "M" if i else None, i != 30, "villa" if i % 4 else None, i % 6 or None, area, *place, vector, photos))
    schema = "id string, source_domain string, municipality string, is_active boolean, category string, price int, area string, lat double, lng double, embedding array<float>, photos array<string>"
    return M.of_listing(spark.createDataFrame(rows, schema))


@pytest.mark.parametrize("block", [4, 1024])
def test_blocks_measure_what_the_join_does(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK_ROWS", block)
    monkeypatch.setattr(P, "TILE_PAIRS", 7)
    monkeypatch.setattr(P, "SHARED_VALUES", 2)
    x = _listings(spark)
    joined = P.hydrated_blocks(x, [*COLUMNS, "lat", "lng", "embedding", "norm", "shown_photos"], 2)
    at = [F.col(c) for c in ("a_lat", "a_lng", "b_lat", "b_lng")]
    measures = {
        "similarity": M.cosine(F.col("a_embedding"), F.col("b_embedding"), F.col("a_norm"), F.col("b_norm")),
        "metres": M.distance_m(*at),
        "km": M.haversine_km(*at),
    }
    others = {"same_area": F.col("a_area") == F.col("b_area"), "shared_shown_photos": M.shared_photos(F.col("a_shown_photos"), F.col("b_shown_photos")), "shared_photos": M.shared_photos(F.col("a_photos"), F.col("b_photos"))}
    held = [f"{s}_{c}" for c in COLUMNS for s in "ab"]
    due = joined.select("a_id", "b_id", *held, *(c.alias(k) for k, c in (measures | others).items())).collect()
    got = P.measured_blocks(x, COLUMNS, ["area"], ("metres", "km"), ("shown_photos", "photos"), salts=2).collect()
    assert len(got) == len(due) > 300
    due = {(r.a_id, r.b_id): r for r in due}
    for r in got:
        want = due.pop((r.a_id, r.b_id))
        assert [r[c] for c in (*held, *others)] == [want[c] for c in (*held, *others)]
        for k in measures:
            a, b = r[k], want[k]
            # Near places: the arc cosine turns a last digit into decimetres.
            near = 1.0 if k == "metres" else 1e-6
            assert (a is None) == (b is None), (k, a, want)
            assert a is None or math.isnan(a) and math.isnan(b) or abs(a - b) < near
    assert not due


def test_empty_listings_have_no_pairs(spark):
    x = _listings(spark)
    assert P.measured_blocks(x.limit(0), COLUMNS, ["area"], ("km",)).count() == 0
    assert P.measured_blocks(x.where("municipality = 'none'"), COLUMNS).count() == 0


@pytest.mark.parametrize("name", ["tier1_scores", "weighted_scores", "cascade_summary", "run_counters", "similarity_or_backend", "pair_features", "learning_features", "model_rows"])
def test_no_pair_is_measured_by_lambdas(spark, name):
    """Vectors, lists and texts stay with their listing: a pair's plan has no function over an array's elements."""
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("FlatMapGroupsInArrow")
    assert len(above) == 2 and not any(k in above[0] for k in ("zip_with", "aggregate(", "array_intersect", "acos", "asin"))


def test_blocks_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", 20)
    x = table(spark, SMALL, "customer").select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") % 2).cast("string").alias("source_domain"), F.lit("m").alias("municipality"), F.lit(True).alias("is_active"), F.lit("v").alias("category"), F.array(F.lit(1.0)).alias("embedding"))
    whole = P.measured_blocks(M.of_listing(x), [])
    n = x.count()
    assert whole.count() == x.where("source_domain = 0").count() * x.where("source_domain = 1").count()
    largest = whole.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < n * n / 8


def test_rounding_without_decimals(spark):
    x = spark.range(20_000).select(F.explode(F.array(F.rand(1) * 3 - 1, F.floor(F.rand(2) * 1e8) / 1e7, F.floor(F.rand(3) * 1000) / F.floor(F.rand(4) * 999 + 1), *map(F.lit, (-1e-9, -0.0, 0.0078125, 1.0000005, -2.5, float("nan"), float("inf"), 1e300)), F.rand(6) * 1e6, F.lit(None).cast("double"))).alias("x"))
    for d in (0, 5, 6):
        assert x.where(~M.rounded(F.col("x"), d).cast("string").eqNullSafe(F.round("x", d).cast("string"))).count() == 0


@pytest.mark.parametrize("name", ["model_tier", "boosted_tier"])
def test_one_class_needs_no_features(spark, name):
    """No two listings of different sites end in one digit, so all labels are the same: no features are written or scored."""
    from parcelyn import storage

    before = storage.n_written()
    found = catalogue.QUERIES[name](spark, SMALL)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert storage.n_written() == before and not any(k in plan for k in ("MapInArrow", "similarity", "km#"))
    assert {(r.verdict, r.confidence) for r in found.collect()} == {("different", 1.0)}


def test_predictions_are_shuffled_only_where_ids_repeat(spark, tmp_path):
    from parcelyn.plans import further

    def plan(folder):
        return further.prediction_history(spark, folder)._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]

    assert "Aggregate" not in plan(SMALL)
    x = table(spark, SMALL, "embeddings")
    x.union(x.limit(40)).write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("customer", "part"):
        table(spark, SMALL, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert "Aggregate" in plan(str(tmp_path))
    got = further.prediction_history(spark, str(tmp_path))
    assert got.count() == got.select("pair_key").distinct().count() == further.prediction_history(spark, SMALL).count()


def test_new_listings_meet_a_pool_in_parts(spark, monkeypatch):
    """The join deals a municipality over tasks, and nothing is scored that a hard rule decides."""
    from parcelyn.streaming import jobs

    x = _listings(spark).where("municipality IS NOT NULL").withColumns({"size_sqm": F.lit(80.0), "year_built": 2000 + F.coalesce("price", F.lit(0)) * 4, "bedrooms": F.lit(2)})
    new = x.where("price > 3")
    whole = jobs.incremental_dedup(new, x)
    due = {tuple(r) for r in whole.collect()}
    monkeypatch.setattr(P, "BLOCK_ROWS", 5)
    dealt = jobs.incremental_dedup(new, x)
    assert {tuple(r) for r in dealt.collect()} == due and len(due) > 100
    assert dealt.where("a_id >= ''").select(F.spark_partition_id().alias("task")).distinct().count() > 4
    hard = [line for line in dealt._jdf.queryExecution().optimizedPlan().toString().split("Join Inner") if "tier" in line]
    assert "similarity" not in hard[0] and {r[5] for r in due} == {0, 1}
