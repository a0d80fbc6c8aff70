"""Snapshots against stored listings: what is new, changed, gone or back; prices, media, repeated fetches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

#: Columns that an upsert never overwrites.
PROTECTED = ("status", "is_active", "previous_price", "cluster_id", "embedding", "content_hash", "image_phashes", "details_fetch_attempts", "last_details_fetch_at")


def snapshot_diff(known: DataFrame, seen: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(site_property_id, id, change, old_price, new_price, coverage): what a site's snapshot means for its listings.

    known: id, site_property_id, url, price, status. seen: site_property_id, url, price. A listing is found by its id
    on the site, else by its url (renamed). Listings that aren't seen are delisted, unless they already are, are sold,
    or the snapshot covers less than the least share of all known ones. The last of repeated rows counts.
    """
    k = known.select("id", F.col("site_property_id").alias("known_sid"), F.col("url").alias("known_url"), F.col("price").alias("old_price"), "status")
    s = seen.select("site_property_id", "url", F.col("price").alias("new_price"))
    by_id = s.join(k.select(F.col("known_sid").alias("site_property_id"), F.col("id").alias("id1")), "site_property_id", "left")
    taken = by_id.where("id1 IS NOT NULL").select(F.col("id1").alias("id"))
    free = k.join(taken, "id", "left_anti").where("known_url IS NOT NULL").groupBy(F.col("known_url").alias("url")).agg(F.min("id").alias("id2"))
    found = by_id.join(free, "url", "left").select("site_property_id", "new_price", F.coalesce("id1", "id2").alias("id"), (F.col("id1").isNull() & F.col("id2").isNotNull()).alias("renamed"))
    joined = found.join(k.select("id", "old_price", "status", "known_sid"), "id", "full_outer")
    counts = k.join(found.where("id IS NOT NULL").select("id").distinct().withColumn("hit", F.lit(1)), "id", "left").agg((F.count("hit") / F.nullif(F.count("*"), F.lit(0))).alias("coverage"))
    joined = joined.join(F.broadcast(counts))
    seen_now = F.col("site_property_id").isNotNull()
    change = (
        F.when(seen_now & F.col("status").isNull(), "new")
        .when(seen_now & F.col("status").isin("DELISTED", "SOLD"), "revived")
        .when(seen_now & F.col("old_price").isNotNull() & (F.col("new_price") != F.col("old_price")), "price_changed")
        .when(seen_now & F.col("renamed"), "renamed")
        .when(seen_now, "unchanged")
        .when(F.col("status").isin("DELISTED", "SOLD"), "gone")
        .when(F.col("coverage") >= config.delist_coverage, "delisted")
        .otherwise("missing")
    )
    return joined.select(F.coalesce("site_property_id", "known_sid").alias("site_property_id"), "id", change.alias("change"), "old_price", "new_price", "coverage")


def after_diff(known: DataFrame, diff: DataFrame, now: Column) -> DataFrame:
    """Stored listings after a diff: status and times; a revived one loses its content hash so that it is read anew."""
    d = diff.where("id IS NOT NULL").select("id", F.col("change").alias("_change"))
    x = known.join(d, "id", "left")
    status = F.when(F.col("_change") == "delisted", "DELISTED").when(F.col("_change") == "revived", "ACTIVE").when(F.col("_change") == "price_changed", "PRICE_CHANGED").otherwise(F.col("status"))
    seen = F.coalesce(F.col("_change").isin("revived", "price_changed", "renamed", "unchanged"), F.lit(False))
    out = {"status": status, "is_active": F.when(F.col("_change") == "delisted", False).when(F.col("_change") == "revived", True).otherwise(F.col("is_active")), "last_seen_at": F.when(seen, now).otherwise(F.col("last_seen_at"))}
    if "content_hash" in known.columns:
        out["content_hash"] = F.when(F.col("_change") == "revived", F.lit(None)).otherwise(F.col("content_hash"))
    return x.withColumns(out).select(*known.columns)


def sync_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("n"))


def price_changes(observations: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """History rows (keys, old_price, new_price, changed_at) from observed prices (price, seen_at).

    A missing price is no observation; the first price fills in without a history row; an equal one changes nothing.
    """
    w = Window.partitionBy(*keys).orderBy("seen_at", "price")
    x = observations.where("price IS NOT NULL").withColumn("old_price", F.lag("price").over(w))
    return x.where("old_price IS NOT NULL AND price <> old_price").select(*keys, "old_price", F.col("price").alias("new_price"), F.col("seen_at").alias("changed_at"))


def with_price(listings: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listings, history) after incoming prices (id, price, seen_at), one a listing.

    No price: nothing. No stored price: filled in, previous_price only where it was null. Equal: nothing. Else a history
    row, the old price kept as previous_price and status PRICE_CHANGED.
    """
    x = listings.join(incoming.select("id", F.col("price").alias("_new"), F.col("seen_at").alias("_at")), "id", "left")
    fill = F.col("_new").isNotNull() & F.col("price").isNull()
    changed = F.col("_new").isNotNull() & F.col("price").isNotNull() & (F.col("_new") != F.col("price"))
    history = x.where(changed).select("id", F.col("price").alias("old_price"), F.col("_new").alias("new_price"), F.col("_at").alias("changed_at"))
    new = x.withColumns(
        {
            "previous_price": F.when(changed, F.col("price")).when(fill, F.coalesce("previous_price", "_new")).otherwise(F.col("previous_price")),
            "price": F.when(fill | changed, F.col("_new")).otherwise(F.col("price")),
            "status": F.when(changed, "PRICE_CHANGED").otherwise(F.col("status")),
        }
    )
    return new.select(*listings.columns), history


def photos_by_listing(media: DataFrame) -> DataFrame:
    """(property_id, image_phashes): hashes in input order, an empty one where there is none."""
    return media.groupBy("property_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.coalesce("phash", F.lit("")).alias("phash")))), lambda x: x["phash"]).alias("image_phashes"))


def upsert_media(old: DataFrame, new: DataFrame) -> DataFrame:
    """Media by (property_id, image_url); a local path changes only if a new one is given."""
    from ..storage import upsert

    return upsert(old, new, ["property_id", "image_url"], protected=("created_at",))


def media_path(domain: Column, listing: Column, position: Column, url: Column) -> Column:
    ext = F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"\.(jpe?g|png|webp|gif)$", 1), F.lit("")), F.lit("jpg"))
    return F.concat(F.lit("data/media/"), domain, F.lit("/"), listing.cast("string"), F.lit("/"), F.lpad(position.cast("string"), 2, "0"), F.lit("_"), F.substring(F.md5(url), 1, 6), F.lit("."), ext)


def needs_refetch(now: Column, config: Config = DEFAULT) -> Column:
    """Whether a listing lacks data, has attempts left and hasn't been fetched for a while."""
    lacking = (
        F.col("size_sqm").isNull()
        | F.col("category").isNull()
        | (F.length(F.coalesce(F.col("description"), F.lit(""))) < config.min_description)
        | (F.coalesce(F.col("n_features"), F.lit(0)) == 0)
        | F.col("price").isNull()
    )
    rested = F.col("last_details_fetch_at").isNull() | (F.col("last_details_fetch_at") <= now - F.make_dt_interval(F.lit(config.refetch_days)))
    return lacking & (F.coalesce(F.col("details_fetch_attempts"), F.lit(0)) < config.refetch_attempts) & rested


def merged_details(old: DataFrame, fetched: DataFrame, fill: tuple[str, ...]) -> DataFrame:
    """Missing columns are filled, a longer description replaces a shorter one, and new features win."""
    n = fetched.select("id", *(F.col(c).alias(f"_n_{c}") for c in fetched.columns if c != "id"))
    x = old.join(n, "id", "left")
    out = {c: F.coalesce(F.col(c), F.col(f"_n_{c}")) for c in fill}
    longer = F.length("_n_description") > F.length(F.coalesce("description", F.lit("")))
    out["description"] = F.when(longer, F.col("_n_description")).otherwise(F.col("description"))
    out["features"] = merged_features(F.col("features"), F.col("_n_features"))
    return x.withColumns(out).select(*old.columns)


def merged_features(old: Column, new: Column) -> Column:
    """Both maps; a new value wins."""
    empty = F.create_map().cast("map<string,boolean>")
    o, n = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(o, lambda k, v: ~F.map_contains_key(n, k)), n)


def back_filled_features(old: Column, new: Column) -> Column:
    """The merged map if it brings keys that weren't there, else the old one."""
    empty = F.create_map().cast("map<string,boolean>")
    extra = F.size(F.array_except(F.map_keys(F.coalesce(new, empty)), F.map_keys(F.coalesce(old, empty))))
    return F.when(extra > 0, merged_features(old, new)).otherwise(old)


def newcomers(seeds: DataFrame, details: DataFrame) -> DataFrame:
    """Seeds with the details fetched for them; a non-null detail wins."""
    shared = [c for c in details.columns if c in seeds.columns and c != "url"]
    own = [c for c in details.columns if c not in seeds.columns]
    d = details.select("url", *(F.col(c).alias(f"_d_{c}") for c in shared), *own)
    x = seeds.join(d, "url", "left").withColumns({c: F.coalesce(F.col(f"_d_{c}"), F.col(c)) for c in shared})
    return x.select(*seeds.columns, *own)


def stale_embeddings(listings: DataFrame, text: Column) -> DataFrame:
    """Listings whose text's hash isn't the stored one."""
    return listings.withColumn("new_hash", F.sha2(text, 256)).where(~F.col("new_hash").eqNullSafe(F.col("content_hash")))


def external_cache(old: DataFrame, new: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """External listings by (source, id): a changed text loses its vector; every one seen lives for some more hours."""
    n = new.select("external_source", "external_id", F.col("canonical_text").alias("_text"), F.sha2("canonical_text", 256).alias("_hash"))
    x = old.join(n, ["external_source", "external_id"], "full_outer")
    same = F.coalesce(F.col("_hash") == F.col("content_hash"), F.lit(False))
    return x.withColumns(
        {
            "embedding": F.when(F.col("_hash").isNull() | same, F.col("embedding")),
            "canonical_text": F.coalesce("_text", "canonical_text"),
            "content_hash": F.coalesce("_hash", "content_hash"),
            "expires_at": F.when(F.col("_hash").isNotNull(), now + F.make_dt_interval(F.lit(0), F.lit(hours))).otherwise(F.col("expires_at")),
        }
    ).select(*old.columns)


def needs_golden(clusters: DataFrame, now: Column, config: Config = DEFAULT) -> DataFrame:
    """Approved clusters whose golden record is missing or older than they are, or whose outside check is due."""
    due = F.col("last_external_check_at").isNull() | (F.col("last_external_check_at") < now - F.make_dt_interval(F.lit(0), F.lit(config.recheck_hours)))
    return clusters.where((F.col("status") == "APPROVED") & (F.col("power_generated_at").isNull() | (F.col("updated_at") > F.col("power_generated_at")) | due))
