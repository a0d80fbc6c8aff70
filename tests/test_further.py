"""Joins with missing values, areas far away, hashes of images, texts for models, changes to tables."""

import math
import random
import struct

import numpy as np
from pyspark.sql import functions as F

from parcelyn.config import DEFAULT
from parcelyn.functions import images, prompts
from parcelyn.functions import matching as M
from parcelyn.operators import clusters as K
from parcelyn.operators import graph
from parcelyn.operators import pairs as P
from parcelyn.operators import reports as R
from parcelyn.operators import scoring as S
from parcelyn.storage import changed

SIDES = "id int, source_domain string, price int, size_sqm double"


def test_tolerant_join_with_missing_values(spark):
    """All pairs by brute force, with missing, zero and known values; no join of the plan is a product."""
    rng = random.Random(4)
    rows = [(i, f"s{i % 3}", rng.choice([None, 0, 90, 100, 130, 400]), rng.choice([None, 0.0, 50.0, 55.0, 70.0])) for i in range(120)]
    x = spark.createDataFrame(rows, SIDES)
    a, b = (x.select(*(F.col(c).alias(f"{s}_{c}") for c in x.columns)) for s in "ab")
    joined = P.tolerant_join(a, b)

    def near(p, q, most):
        return not (p and q) or abs(p - q) / max(p, q) < most

    due = sorted((r[0], s[0]) for r in rows for s in rows if r[0] < s[0] and r[1] != s[1] and near(r[2], s[2], DEFAULT.price_tolerance) and near(r[3], s[3], DEFAULT.size_tolerance))
    assert sorted((r.a_id, r.b_id) for r in joined.collect()) == due
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nearest_area_everywhere(spark):
    """Points near and far from areas, across the date line, by brute force in degrees and in metres."""
    rng = random.Random(5)
    points = [(i, rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(150)] + [(200, 10.0, 179.9), (201, None, 1.0)]
    areas = [(i, rng.uniform(-60, 60), rng.uniform(-180, 180)) for i in range(12)] + [(50, 10.0, -179.9), (51, None, None)]
    p, a = spark.createDataFrame(points, "id int, lat double, lng double"), spark.createDataFrame(areas, "area_id int, lat double, lng double")

    def metres(x, y):
        f, g = math.radians(x[1]), math.radians(y[1])
        c = math.sin(f) * math.sin(g) + math.cos(f) * math.cos(g) * math.cos(math.radians(y[2] - x[2]))
        return math.acos(max(-1.0, min(1.0, c))) * M.EARTH_M

    for spherical, far in ((False, lambda x, y: math.hypot(x[1] - y[1], x[2] - y[2])), (True, metres)):
        got = {r.id: (r.area_id, r.distance) for r in P.nearest_area(p, a, spherical=spherical).collect()}
        assert set(got) == {x[0] for x in points if x[1] is not None}
        for x in points:
            if x[1] is not None:
                d, area = min((far(x, y), y[0]) for y in areas if y[1] is not None)
                assert got[x[0]][0] == area and abs(got[x[0]][1] - d) < 1e-3


def test_spread_join(spark):
    rows = spark.range(1000).selectExpr("IF(id < 900, 0L, id) AS k", "id AS v")
    table = rows.groupBy("k").agg(F.count("*").alias("held")).withColumn("name", F.concat(F.lit("n"), "k"))
    got = graph.spread_join(rows, table, "k", "held", "v", most=50)
    assert {(r.k, r.v, r.name) for r in got.collect()} == {(0 if i < 900 else i, i, f"n{0 if i < 900 else i}") for i in range(1000)}


def bmp(pixels):
    h, w, _ = pixels.shape
    row = (w * 3 + 3) // 4 * 4
    body = b"".join(pixels[y, :, ::-1].tobytes().ljust(row, b"\0") for y in range(h - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def ppm(pixels):
    return b"P6\n# made here\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def test_image_hashes(spark, tmp_path):
    """One picture in two formats and sizes has one hash or nearly so, another one is far away; the rest has none."""
    y, x = np.mgrid[0:96, 0:128]
    picture = np.stack([128 + 100 * np.sin(x / 17 + y / 29), 128 + 80 * np.cos(y / 11), x + y], axis=2).clip(0, 255).astype(np.uint8)
    other = np.stack([(x * y) % 256] * 3, axis=2).astype(np.uint8)
    files = {"a.bmp": bmp(picture), "b.ppm": ppm(picture), "c.ppm": ppm(np.repeat(np.repeat(picture, 2, 0), 2, 1)), "d.bmp": bmp(other), "e.bmp": bmp(picture[:20]), "f.jpg": b"\xff\xd8\xff", "g.ppm": ppm(picture)[:200], "h.bmp": b"BM"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path[-5:]: r.phash for r in images.image_hashes(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    bits = lambda a, b: (int(got[a], 16) ^ int(got[b], 16)).bit_count()
    assert got["a.bmp"] == got["b.ppm"] and bits("a.bmp", "c.ppm") <= 6 < bits("a.bmp", "d.bmp")
    assert [got[k] for k in ("e.bmp", "f.jpg", "g.ppm", "h.bmp")] == [None] * 4 and images.perceptual_hash(None) is None


def test_pair_prompt(spark):
    facts = {"source_domain": "s", "category": None, "price": 1234567, "size_sqm": 80.4, "land_size_sqm": None, "year_built": 1999, "bedrooms": 3, "bathrooms": None, "area": None, "municipality": "M", "description": "x" * 700}
    features = {"embedding_cosine_sim": 0.98765, "phash_min_hamming": 64.0, "phash_close_count": 0.0, "year_built_diff": float("nan"), "price_log_ratio": 0.1, "size_sqm_ratio": None, "bedrooms_diff": 1.0, "same_calc_municipality": 1.0, "same_calc_area": 0.0}
    lit = lambda v, kind: F.lit(v).cast(kind)
    kinds = {"price": "int", "size_sqm": "double", "land_size_sqm": "double", "year_built": "int", "bedrooms": "int", "bathrooms": "int"}
    text = spark.range(1).select(prompts.pair_prompt(lambda side, name: lit(facts[name], kinds.get(name, "string")), {k: lit(v, "double") for k, v in features.items()}).alias("t")).first().t
    lines = text.split("\n")
    for line in ("- category: NULL", "- price: 1,234,567 EUR", "- size: 80 sqm", "- land: NULL sqm", "- location: ?, M", f'- description: "{"x" * 600}"'):
        assert lines.count(line) == 2
    for line in ("- embedding_cosine_sim: 0.988", "- phash_min_hamming: 64", "- year_built_diff: NULL", "- size_sqm_ratio: NULL", "- same_calc_municipality: yes", "- same_calc_area: no"):
        assert lines.count(line) == 1


def test_dry_run_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    after = {"t": spark.read.parquet(path).where("id > 3")}
    assert [tuple(r) for r in changed(spark, {"t": path}, after).collect()] == [("t", 10, 6, -4)]
    assert spark.read.parquet(path).count() == 10
    assert [tuple(r) for r in changed(spark, {"t": path}, after, dry_run=False).collect()] == [("t", 10, 6, -4)]
    assert spark.read.parquet(path).count() == 6


def test_two_approved_clusters_stay_apart(spark):
    """A chain between two approved clusters: the edge that would join them is left out and reported."""
    duplicates = spark.createDataFrame([("a1", "m1", 0.9), ("m1", "m2", 0.9), ("m2", "b1", 0.9), ("a1", "b1", 0.8)], "a_id string, b_id string, confidence double")
    seeds = spark.createDataFrame([("a1", "A"), ("b1", "B")], "property_id string, cluster_id string")
    clusters = spark.createDataFrame([("A", "2024-01-01"), ("B", "2024-01-02")], "id string, created_at string")
    members, flags, disagreements = K.seeded_components(duplicates, seeds, clusters)
    got = {r.property_id: r.cluster_id for r in members.collect()}
    assert got["m1"] == "A" and got["m2"] == "B"
    assert {(r.a_id, r.b_id, r.cluster_a, r.cluster_b) for r in disagreements.collect()} == {("m1", "m2", "A", "B"), ("a1", "b1", "A", "B")}


def test_agents_file_has_a_mark(spark, tmp_path):
    R.write_agents(spark.createDataFrame([("a", 1)], "name string, n int").coalesce(1), str(tmp_path / "x"))
    [file] = (tmp_path / "x").glob("part-*")
    assert file.read_bytes() == b"\xef\xbb\xbfname;n\na;1\n"


def test_dense_areas_meet_few_points_each(spark):
    """3,000 places of areas in one degree and as many points: the first grid is so fine that no cell has many."""
    areas = spark.range(6000).selectExpr("id AS area_id", "39 + id % 3000 % 61 / 61D AS lat", "22 + id % 3000 % 59 / 59D AS lng")
    own = areas.groupBy(F.col("lat").alias("area_lat"), F.col("lng").alias("area_lng")).agg(F.min("area_id").alias("area_id"))
    width = P._first_width(own, 0.25)
    assert own.groupBy(F.floor(F.col("area_lat") / width), F.floor(F.col("area_lng") / width)).count().agg(F.max("count")).first()[0] <= 8
    points = spark.range(400).selectExpr("id", "39 + id * 37 % 101 / 101D AS lat", "22 + id * 91 % 97 / 97D AS lng")
    near = {r.id: (r.area_id, r.distance) for r in P.nearest_area(points, areas).collect()}
    every = points.crossJoin(areas.withColumnsRenamed({"lat": "y", "lng": "x"})).selectExpr("id", "struct(sqrt(pow(lat - y, 2) + pow(lng - x, 2)) AS d, area_id) AS s").groupBy("id").agg(F.min("s").alias("s"))
    assert near == {r.id: (r.s.area_id, r.s.d) for r in every.collect()}


def test_blocks_bring_columns_without_shuffling_pairs(spark):
    """Pairs with both sides' columns are those of a plain join, in a plan of one join; what concerns one listing is computed once."""
    rows = spark.range(120).selectExpr("lpad(id, 4, '0') AS id", "'s' || id % 3 AS source_domain", "IF(id % 7 = 0, NULL, 'm' || id % 2) AS municipality", "id % 11 <> 0 AS is_active", "id * 3 AS price")
    got = P.hydrated_blocks(rows, ["price", "source_domain", "municipality"], salts=3)
    plain = P.hydrate(P.block_pairs(rows), rows, ["price", "source_domain", "municipality"])
    assert got.columns == ["a_id", "b_id", "a_price", "b_price", "a_source_domain", "b_source_domain", "a_municipality", "b_municipality"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.select(got.columns).collect())) != []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1


def _four(spark):
    own = "source_domain STRING, category STRING, price INT, size_sqm DOUBLE, bedrooms INT, year_built INT, embedding ARRAY<FLOAT>"
    columns = ", ".join(f"{s}_{c}" for s in "ab" for c in own.split(", "))
    base = lambda src, v: (src, "Villa", 100, 80.0, 2, 2000, v)
    rows = [(f"{k}", "9", False, *base("s1", a), *base(b_src, b)) for k, (b_src, a, b) in enumerate([("s2", [1.0, 0.0], [1.0, 0.0]), ("s2", [1.0, 0.0], [0.0, 1.0]), ("s1", [1.0, 0.0], [1.0, 0.0]), ("s2", [1.0, 0.0], [0.6, 0.8]), ("s2", [0.0, 0.0], [1.0, 0.0])])]
    return spark.createDataFrame(rows, f"a_id STRING, b_id STRING, has_feedback BOOLEAN, {columns}")


def test_similarity_or_backend_makes_pairs_once(spark):
    """Without a backend all is one pass; with the default backend given the rows are the same, and nothing is joined."""
    pairs = _four(spark)
    one, two = S.similarity_or_backend(pairs), S.similarity_or_backend(pairs, S.UncertainBackend())
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert [r.verdict for r in one.orderBy("a_id").collect()] == ["duplicate", "different", "different", "uncertain", "uncertain"]
    for df, unions in ((one, 0), (two, 1)):
        plan = df._jdf.queryExecution().analyzed().toString()
        assert "Join" not in plan and plan.count("Union") == unions


def test_cascade_without_backends_is_one_pass(spark):
    pairs = _four(spark)
    one, many = S.cascade(pairs), S.cascade(pairs, S.UncertainBackend(), S.UncertainBackend())
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and {r.tier for r in one.collect()} >= {0, 3}
    assert "Union" not in one._jdf.queryExecution().analyzed().toString()


def test_run_counters_of_conditions(spark):
    x = S.rule_scores(_four(spark))
    ends = [x.where(F.col("a_id") == k) for k in "123"]
    got = S.run_counters(x, *(F.col("a_id") == k for k in "123"))
    assert got.collect() == S.run_counters(x, *ends).collect() and "Join" not in got._jdf.queryExecution().analyzed().toString()


def test_new_listings_bring_their_norms_into_the_join(spark):
    """What concerns one listing is computed below the join with the pool, once a listing."""
    from parcelyn.streaming import jobs

    own = spark.createDataFrame([(k, f"s{k}", "m", "Villa", 100, 80.0, 2, 2000, [1.0, 0.5 * k]) for k in (0, 1)], "id int, source_domain string, municipality string, category string, price int, size_sqm double, bedrooms int, year_built int, embedding array<float>")
    got = jobs.incremental_dedup(own.where("id = 0"), own)
    assert [(r.a_id, r.b_id) for r in got.collect()] == [(0, 1)]
    above = got._jdf.queryExecution().analyzed().toString().split("Join Inner")[0]
    assert "AS a_norm" not in above and "AS b_norm" not in above
