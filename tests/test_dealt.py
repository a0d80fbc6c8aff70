"""Work that grows out of a small file is shared by several tasks."""

from pyspark.sql import functions as F

from parcelyn.operators import clusters as K
from parcelyn.operators import feedback as B
from parcelyn.operators import pairs as P
from parcelyn.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def test_descriptions_are_dealt(spark):
    x = catalogue.QUERIES["mined_descriptions"](spark, SMALL)
    assert x.select(F.spark_partition_id().alias("task")).distinct().count() > 1


def test_blocks_stay_bounded(spark, monkeypatch):
    """More rows of a value make more blocks and tasks, not larger ones."""
    monkeypatch.setattr(P, "BLOCK_ROWS", 50)
    monkeypatch.setattr(P, "TASK_PAIRS", 5_000)
    a = spark.range(600).select(F.col("id").alias("a_id"), F.lit("m").alias("k"))
    b = a.withColumnRenamed("a_id", "b_id")
    found = P.dealt_join(a, b, "k", "a_id", "b_id").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in found) == 600 * 600 and max(r["count"] for r in found) < 600 * 600 // 12


def test_pairs_of_clusters_are_dealt_and_unique_before_hashes(spark):
    rows = spark.createDataFrame([(c, f"{c}-{i}") for c in range(40) for i in range(3)] + [(99, "0-0"), (99, "0-1")], "cluster_id long, property_id string")
    x = K.member_pairs(rows)
    assert x.select(F.spark_partition_id().alias("task")).distinct().count() > 4
    hashes = rows.select(F.col("property_id").alias("id"), F.lit("h").alias("content_hash"))
    got = B.of_rejected_clusters(rows, hashes)
    assert got.count() == got.distinct().count() == 120 and got.where("hash_a = 'h' AND hash_b = 'h'").count() == 120
    tops = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
    assert tops and not any("a_id" in line and "b_id" in line and "hash_a" in line for line in tops)


def test_edges_are_searched_once(spark):
    """Components read written edges: their plan has no search of its own."""
    plan = catalogue.QUERIES["approved_components"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
