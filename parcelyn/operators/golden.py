"""One record for each cluster from its members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.matching import same_photo


def first_mode(values: Column) -> Column:
    """The most frequent non-null value of an array; of equals the one seen first."""
    known = F.filter(values, lambda v: v.isNotNull())
    distinct = F.array_distinct(known)
    counted = F.transform(distinct, lambda v, i: F.struct(F.size(F.filter(known, lambda w: w == v)).alias("n"), (-i).alias("order"), v.alias("v")))
    return F.array_max(counted)["v"]


def mode_or_mean(values: Column) -> Column:
    """The mode if a value occurs more than once, else the mean."""
    known = F.filter(values, lambda v: v.isNotNull())
    repeated = F.size(F.array_distinct(known)) < F.size(known)
    mean = F.aggregate(known, F.lit(0.0), lambda s, v: s + v.cast("double"), lambda s: s / F.size(known))
    return F.when(F.size(known) > 0, F.when(repeated, first_mode(values).cast("double")).otherwise(mean))


def first_filled(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull() & (v.cast("string") != "")), F.lit(0))


def distinct_photos(photos: Column, config: Config = DEFAULT) -> Column:
    """Photos (struct<phash, url>) in order, without those within a few bits of one kept before; without a hash all stay."""

    def step(kept: Column, x: Column) -> Column:
        blank = x["phash"].isNull() | (x["phash"] == "")
        seen = F.exists(kept, lambda y: same_photo(x["phash"], y["phash"], strict=True, config=config))
        return F.when(blank | ~seen, F.array_append(kept, x)).otherwise(kept)

    return F.aggregate(photos, F.filter(photos, lambda _: F.lit(False)), step)


def golden_records(members: DataFrame) -> DataFrame:
    """A golden record for each cluster_id. Members are taken in order of (created_at, id).

    A cluster is the listings of one property, so its members fit into one row.
    """
    columns = ["price", "size_sqm", "land_size_sqm", "bedrooms", "bathrooms", "year_built", "category", "municipality", "area", "lat", "lng", "description", "source_domain"]
    have = [c for c in columns if c in members.columns]
    rows = members.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", *have, *(c for c in ("features",) if c in members.columns)))).alias("m"))
    each = lambda c: F.transform("m", lambda x: x[c])
    out = {"member_count": F.size("m"), "source_property_ids": each("id")}
    for c in have:
        if c == "price":
            out[c] = F.array_min(each(c))
        elif c in ("size_sqm", "land_size_sqm"):
            out[c] = mode_or_mean(each(c))
        elif c in ("bedrooms", "bathrooms", "year_built"):
            out[c] = first_mode(each(c))
        elif c == "source_domain":
            out["source_domains"] = F.array_sort(F.array_distinct(each(c)))
        else:
            out[c] = first_filled(each(c))
    if "features" in members.columns:
        out["features"] = F.array_sort(F.array_distinct(F.flatten(F.transform("m", lambda x: F.map_keys(F.map_filter(F.coalesce(x["features"], F.create_map().cast("map<string,boolean>")), lambda k, v: v))))))
    return rows.select("cluster_id", *(v.alias(k) for k, v in out.items()))


def representatives(members: DataFrame) -> DataFrame:
    """(cluster_id, id, filled) of each cluster's fullest member; of equals the least id."""
    fields = ("price", "size_sqm", "land_size_sqm", "bedrooms", "bathrooms", "year_built", "description", "embedding")
    filled = sum((F.col(c).isNotNull().cast("int") for c in fields if c in members.columns), F.lit(0))
    x = members.withColumn("_filled", filled)
    best = F.min(F.struct((-F.col("_filled")).alias("f"), "id")).alias("best")
    return x.groupBy("cluster_id").agg(best).select("cluster_id", "best.id", (-F.col("best.f")).alias("filled"))
