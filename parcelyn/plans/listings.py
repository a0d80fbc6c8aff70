"""Listings made of the driver's tables, in Spark and, with the same rows, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Bands, Config
from ..sources.readers import table

#: Bands that fit the vectors of the driver's tables, whose cosines stay below 0.7.
SCALED = Config(bands=Bands(strong_same=0.30, weak_same=0.20, strong_different=-0.20, weak_different=-0.10), reject_similarity=0.30, merge_similarity=0.40)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c, p = (table(spark, sf_dir, t) for t in ("embeddings", "customer", "part"))
    x = e.join(c, F.col("c_custkey") == F.col("vec_id")).join(p, F.col("p_partkey") == F.col("vec_id"))
    k = F.col("vec_id")
    return x.select(
        F.lpad(k.cast("string"), 12, "0").alias("id"),
        F.concat(F.lit("site"), (k % 5).cast("string")).alias("source_domain"),
        F.concat(F.lit("M"), F.col("c_nationkey").cast("string")).alias("municipality"),
        F.concat(F.lit("A"), (k % 11).cast("string")).alias("area"),
        F.col("p_type").alias("category"),
        F.floor(F.abs("c_acctbal") * 100).cast("int").alias("price"),
        F.col("p_size").cast("double").alias("size_sqm"),
        (k % 6).cast("int").alias("bedrooms"),
        (1990 + k % 35).cast("int").alias("year_built"),
        (39.5 + (k % 97) / 100.0).alias("lat"),
        (23.0 + (k % 89) / 100.0).alias("lng"),
        (k % 13 != 0).alias("is_active"),
        F.when(k % 17 == 0, "DELISTED").otherwise("ACTIVE").alias("status"),
        F.col("p_name").alias("description"),
        F.sha2(F.col("p_name"), 256).alias("content_hash"),
        F.col("label").cast("int").alias("label"),
        "embedding",
    )


SQL = """listings AS (SELECT lpad(CAST(vec_id AS VARCHAR), 12, '0') AS id, 'site' || (vec_id % 5) AS source_domain, 'M' || c_nationkey AS municipality,
    'A' || (vec_id % 11) AS area, p_type AS category, CAST(floor(abs(c_acctbal) * 100) AS INTEGER) AS price, CAST(p_size AS DOUBLE) AS size_sqm,
    CAST(vec_id % 6 AS INTEGER) AS bedrooms, CAST(1990 + vec_id % 35 AS INTEGER) AS year_built, 39.5::DOUBLE + (vec_id % 97) / 100.0::DOUBLE AS lat, 23.0::DOUBLE + (vec_id % 89) / 100.0::DOUBLE AS lng,
    vec_id % 13 <> 0 AS is_active, CASE WHEN vec_id % 17 = 0 THEN 'DELISTED' ELSE 'ACTIVE' END AS status, p_name AS description, sha256(p_name) AS content_hash,
    CAST(label AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS embedding
    FROM embeddings JOIN customer ON c_custkey = vec_id JOIN part ON p_partkey = vec_id)"""

#: Blocked pairs with both listings' columns.
PAIRS_SQL = (
    SQL
    + """, pairs AS (SELECT a.id AS a_id, b.id AS b_id, a.price AS a_price, b.price AS b_price, a.size_sqm AS a_size_sqm, b.size_sqm AS b_size_sqm, a.bedrooms AS a_bedrooms,
    b.bedrooms AS b_bedrooms, a.year_built AS a_year_built, b.year_built AS b_year_built, a.lat AS a_lat, b.lat AS b_lat, a.lng AS a_lng, b.lng AS b_lng, a.area AS a_area, b.area AS b_area,
    a.category AS a_category, b.category AS b_category, a.source_domain AS a_source_domain, b.source_domain AS b_source_domain, list_cosine_similarity(a.embedding, b.embedding) AS similarity
    FROM listings a JOIN listings b ON a.municipality = b.municipality AND a.source_domain <> b.source_domain AND a.id < b.id WHERE a.is_active AND b.is_active)"""
)

PAIR_COLUMNS = ["source_domain", "category", "price", "size_sqm", "bedrooms", "year_built", "lat", "lng", "area", "embedding"]
