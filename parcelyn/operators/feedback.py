"""Judgements of people on pairs: validation, guarded upsert, bulk rejections, deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import latest
from .clusters import member_pairs

#: Reasons that can be given, sources, and the sources whose judgement only their like may replace.
REASONS = ("location", "house_size", "land_size", "type", "bedrooms", "bathrooms", "levels", "year_built", "price")
SOURCES = ("admin_reject", "manual_split", "cluster_dissolve")
STRONG = ("admin_reject", "manual_split")
KEYS = ["prop_a_id", "prop_b_id"]


def validated(rows: DataFrame) -> DataFrame:
    """Known reasons, sorted and once each; known sources; text of 1000 characters or null; ids in order with their hashes."""
    a, b = F.col("prop_a_id"), F.col("prop_b_id")
    turned = a > b
    text = F.nullif(F.substring(F.trim(F.coalesce("reason_text", F.lit(""))), 1, 1000), F.lit(""))
    ha, hb = F.coalesce("hash_a", F.lit("")), F.coalesce("hash_b", F.lit(""))
    x = rows.where(F.col("feedback_source").isin(*SOURCES) & (a != b))
    return x.withColumns(
        {
            "prop_a_id": F.least(a, b),
            "prop_b_id": F.greatest(a, b),
            "hash_a": F.when(turned, hb).otherwise(ha),
            "hash_b": F.when(turned, ha).otherwise(hb),
            "reason_attributes": F.array_sort(F.array_distinct(F.array_intersect(F.coalesce("reason_attributes", F.array().cast("array<string>")), F.array(*map(F.lit, REASONS))))),
            "reason_text": text,
        }
    )


def upsert_feedback(old: DataFrame, new: DataFrame) -> DataFrame:
    """New judgements by pair, the latest of each; a strong one stays unless a strong one comes. Stored hashes stay."""
    incoming = latest(new, KEYS, "created_at")
    n = incoming.select(*KEYS, *(F.col(c).alias(f"_n_{c}") for c in incoming.columns if c not in KEYS))
    x = old.withColumn("_old", F.lit(True)).join(n.withColumn("_new", F.lit(True)), KEYS, "full_outer")
    fresh = F.col("_old").isNull()
    replace = F.col("_new").isNotNull() & (~F.col("feedback_source").isin(*STRONG) | F.col("_n_feedback_source").isin(*STRONG))

    def column(c: str) -> Column:
        if c in KEYS:
            return F.col(c)
        keeps = c in ("hash_a", "hash_b", "created_at") or f"_n_{c}" not in n.columns
        new_value = F.col(f"_n_{c}") if f"_n_{c}" in n.columns else F.lit(None)
        return F.when(fresh, new_value).when(F.lit(not keeps) & F.coalesce(replace, F.lit(False)), new_value).otherwise(F.col(c)).alias(c)

    return x.select(*map(column, old.columns))


def of_rejected_clusters(members: DataFrame, hashes: DataFrame, source: str = "admin_reject") -> DataFrame:
    """A judgement for every pair within the given clusters."""
    return _with_hashes(member_pairs(members), hashes, source)


def of_removed_members(removed: DataFrame, remaining: DataFrame, hashes: DataFrame) -> DataFrame:
    """A judgement for every removed member with every remaining one of its cluster."""
    a, b = removed.select("cluster_id", F.col("property_id").alias("x")), remaining.select("cluster_id", F.col("property_id").alias("y"))
    pairs = a.join(b, "cluster_id").where("x <> y").select("cluster_id", F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"))
    return _with_hashes(pairs, hashes, "manual_split")


def of_dissolved_clusters(members: DataFrame, hashes: DataFrame, existing: DataFrame) -> DataFrame:
    """A judgement for every pair of hashed members that isn't judged yet."""
    new = _with_hashes(member_pairs(members), hashes, "cluster_dissolve").where("hash_a IS NOT NULL AND hash_b IS NOT NULL")
    return new.join(existing.select(*KEYS), KEYS, "left_anti")


def _with_hashes(pairs: DataFrame, hashes: DataFrame, source: str) -> DataFrame:
    """Each pair once with its listings' hashes. Pairs are made unique by their ids alone, before the long hashes come."""
    known = hashes.select("id", "content_hash").distinct()
    a = known.select(F.col("id").alias("a_id"), F.col("content_hash").alias("hash_a"))
    b = known.select(F.col("id").alias("b_id"), F.col("content_hash").alias("hash_b"))
    x = pairs.select("a_id", "b_id").distinct().join(a, "a_id", "left").join(b, "b_id", "left")
    return x.select(F.col("a_id").alias("prop_a_id"), F.col("b_id").alias("prop_b_id"), "hash_a", "hash_b", F.lit(source).alias("feedback_source"))


def deleted_among(feedback: DataFrame, ids: DataFrame) -> DataFrame:
    """feedback without pairs both ends of which are among ids (id)."""
    inside = feedback.join(ids.select(F.col("id").alias("prop_a_id")), "prop_a_id", "left_semi").join(ids.select(F.col("id").alias("prop_b_id")), "prop_b_id", "left_semi")
    return feedback.join(inside.select(*KEYS), KEYS, "left_anti")


def listed(feedback: DataFrame, listings: DataFrame, media: DataFrame, reason: str | None = None, source: str | None = None, since: Column | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, total) of judgements with both listings and their main photos; filters that aren't given don't count."""
    x = feedback
    if reason is not None:
        x = x.where(F.array_contains("reason_attributes", reason))
    if source is not None:
        x = x.where(F.col("feedback_source") == source)
    if since is not None:
        x = x.where(F.col("created_at") >= since)
    main = media.groupBy("property_id").agg(F.min_by("image_url", F.struct((~F.col("is_main_photo")).alias("m"), "created_at", "image_url")).alias("photo"))
    p = listings.select("id", "url", "price", "source_domain").join(main.select(F.col("property_id").alias("id"), "photo"), "id", "left")
    a, b = (p.select(F.col("id").alias(f"prop_{s}_id"), *(F.col(c).alias(f"{s}_{c}") for c in ("url", "price", "source_domain", "photo"))) for s in "ab")
    page = x.join(a, "prop_a_id").join(b, "prop_b_id").orderBy(F.col("created_at").desc(), *KEYS).offset(offset).limit(min(limit, 200))
    return page, x.agg(F.count("*").alias("total"))


def invalidated(cache: DataFrame, ids: DataFrame) -> DataFrame:
    """Cached pair verdicts without those of any of ids (id)."""
    x = cache.withColumns({"_a": F.substring_index("pair_key", ":", 1), "_b": F.substring_index("pair_key", ":", -1)})
    keys = ids.select(F.col("id"))
    return x.join(keys, x["_a"] == keys["id"], "left_anti").join(keys, x["_b"] == keys["id"], "left_anti").drop("_a", "_b")


def contradictions(feedback: DataFrame, members: DataFrame) -> DataFrame:
    """Judged pairs both ends of which share a cluster."""
    a = members.select(F.col("property_id").alias("prop_a_id"), "cluster_id")
    b = members.select(F.col("property_id").alias("prop_b_id"), F.col("cluster_id").alias("_b"))
    return feedback.join(a, "prop_a_id").join(b, "prop_b_id").where("cluster_id = _b").drop("_b")
