"""Further registered queries: features and texts for models, histories, new clusters, filters, counters, seeded edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import matching as M
from ..functions import prompts
from ..functions import textmine as X
from ..operators import clusters as K
from ..operators import feedback as B
from ..operators import lifecycle as L
from ..operators import pairs as P
from ..operators import reports as R
from ..operators import scoring as S
from ..sources.readers import table
from ..storage import deltas
from .catalogue import JUDGED_SQL, MEMBERS_SQL, RULED_SQL, SALTS, attempts, members, pairs_judged, query, ruled, scored, streamed
from .listings import SCALED, SQL, listings
from .more import day, later

# --- what models are given -------------------------------------------------------------------------------------------

SITES = ("glrealestate.gr", "greekexclusiveproperties.com", "realestatecenter.gr")
#: Some places and numbers of bedrooms are unknown, and three sites are those that the model knows.
HOLED_SQL = """holed AS (SELECT * REPLACE (nullif(bedrooms, 5) AS bedrooms, nullif(area, 'A10') AS area, CASE source_domain WHEN 'site0' THEN 'glrealestate.gr' WHEN 'site1' THEN 'greekexclusiveproperties.com' WHEN 'site2' THEN 'realestatecenter.gr' ELSE source_domain END AS source_domain),
    ['h' || (id::BIGINT % 3), 'h' || (id::BIGINT % 7), ''] AS photos FROM listings)"""


def holed(spark: SparkSession, sf: str) -> DataFrame:
    x, domain = listings(spark, sf), F.col("source_domain")
    for k, site in enumerate(SITES):
        domain = F.when(F.col("source_domain") == f"site{k}", site).otherwise(domain)
    n = F.col("id").cast("long")
    hashes = F.array(F.concat(F.lit("h"), (n % 3).cast("string")), F.concat(F.lit("h"), (n % 7).cast("string")), F.lit(""))
    return x.withColumns({"bedrooms": F.nullif("bedrooms", F.lit(5)), "area": F.nullif("area", F.lit("A10")), "source_domain": domain, "photos": hashes})


@query(
    f"""WITH {SQL}, {HOLED_SQL}, p AS (SELECT a, b FROM holed a JOIN holed b ON a.municipality = b.municipality AND a.source_domain <> b.source_domain AND a.id < b.id WHERE a.is_active AND b.is_active)
    SELECT a.id AS a_id, b.id AS b_id, round(list_cosine_similarity(a.embedding, b.embedding), 5) AS cosine_sim,
    round(acos(least(1, greatest(-1, sin(radians(a.lat)) * sin(radians(b.lat)) + cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lng) - radians(a.lng))))) * 6371000, 0) AS gps_distance_m,
    abs(a.year_built - b.year_built)::DOUBLE AS year_diff, CASE WHEN a.price > 0 AND b.price > 0 THEN round(abs(a.price - b.price) / greatest(a.price, b.price)::DOUBLE, 5) END AS price_diff_pct,
    CASE WHEN a.size_sqm > 0 AND b.size_sqm > 0 THEN round(abs(a.size_sqm - b.size_sqm) / greatest(a.size_sqm, b.size_sqm), 5) END AS size_diff_pct,
    len(list_filter(list_distinct(list_intersect(a.photos, b.photos)), lambda x: x <> ''))::DOUBLE AS shared_phash_count, (lower(a.category) = lower(b.category))::INTEGER AS same_canonical_category,
    coalesce((a.bedrooms = b.bedrooms)::INTEGER, -1) AS bedrooms_match_state, coalesce((a.municipality = b.municipality)::INTEGER, -1) AS same_municipality_state, coalesce((a.area = b.area)::INTEGER, -1) AS same_calc_area_state,
    (least(a.source_domain, b.source_domain) = 'glrealestate.gr' AND greatest(a.source_domain, b.source_domain) = 'greekexclusiveproperties.com')::INTEGER AS src_gl_greek,
    (least(a.source_domain, b.source_domain) = 'glrealestate.gr' AND greatest(a.source_domain, b.source_domain) = 'realestatecenter.gr')::INTEGER AS src_gl_real,
    (least(a.source_domain, b.source_domain) = 'greekexclusiveproperties.com' AND greatest(a.source_domain, b.source_domain) = 'realestatecenter.gr')::INTEGER AS src_greek_real, 0 AS src_same_source FROM p"""
)
def model_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The model's 14 features, with unknown places and numbers of bedrooms among them."""
    own = M.of_listing(holed(spark, sf))
    f = M.model_features(lambda side, name: F.col(f"{side}_{name}"), once=True, measured=True)
    rounded = {"cosine_sim": 5, "gps_distance_m": 0, "price_diff_pct": 5, "size_diff_pct": 5}
    shown = [M.rounded(F.nanvl(c, F.lit(None).cast("double")), rounded[k]).alias(k) if k in rounded else c.alias(k) for k, c in f.items()]
    equal = ["canonical_category", "bedrooms", "municipality", "area"]
    x = P.measured_blocks(own, ["source_domain", "price", "size_sqm", "year_built"], equal, ("metres",), ("shown_photos",), SALTS)
    return x.select("a_id", "b_id", *shown)


@query(
    f"""WITH {SQL} SELECT id, '- source: ' || source_domain || chr(10) || '- category: ' || category || chr(10) || '- price: ' || format('{{:,}}', price::BIGINT) || ' EUR' || chr(10) || '- size: ' || printf('%.0f', size_sqm) || ' sqm' || chr(10) || '- land: NULL sqm' || chr(10) || '- year_built: ' || year_built || chr(10)
    || '- bedrooms: ' || bedrooms || chr(10) || '- bathrooms: NULL' || chr(10) || '- location: ' || area || ', ' || municipality || chr(10) || '- description: "' || substr(description, 1, 600) || '"' AS facts FROM listings"""
)
def listing_texts(spark: SparkSession, sf: str) -> DataFrame:
    x = listings(spark, sf).withColumns({"land_size_sqm": F.lit(None).cast("double"), "bathrooms": F.lit(None).cast("int")})
    return x.select("id", prompts.listing_text(lambda name: F.col(name)).alias("facts"))


@query("SELECT doc_id, (length(text) >= 300)::INTEGER AS long_texts FROM documents WHERE text IS NOT NULL")
def long_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.when(F.length(prompts.cut_text(F.col("text"), 300)) == 300, 1).otherwise(0).alias("long_texts"))


# --- what a run leaves behind ----------------------------------------------------------------------------------------


@query(f"WITH {RULED_SQL} SELECT a_id || ':' || b_id AS pair_key, verdict, tier AS tier_emitted, CASE WHEN rule IS NOT NULL THEN rule END AS rule, TIMESTAMP '2024-01-01' AS scored_at FROM scored")
def prediction_history(spark: SparkSession, sf: str) -> DataFrame:
    unique = listings(spark, sf).groupBy("id").count().where("count > 1").isEmpty()
    # Of the reasons only a rule's is shown, so that those of a score aren't made.
    x = S.predictions(scored(spark, sf).withColumn("reasoning", F.col("rule")), day(), unique)
    return x.select("pair_key", "verdict", "tier_emitted", F.when(F.col("tier_emitted") == 0, F.col("reasoning")).alias("rule"), "scored_at")


@query(f"WITH {RULED_SQL} SELECT count(*) FILTER (tier = 0) AS tier_0, count(*) FILTER (tier = 1) AS tier_1, 0 AS tier_2, 0 AS tier_3, count(*) FILTER (verdict = 'uncertain') AS uncertain, count(*) FILTER (a_id LIKE '%3') AS cached, count(*) FILTER (a_id LIKE '%4') AS skipped, count(*) FILTER (a_id LIKE '%5') AS errors FROM scored")
def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    return S.run_counters(scored(spark, sf), *(F.col("a_id").endswith(end) for end in "345"))


@query(f"WITH {MEMBERS_SQL} SELECT sha256(string_agg(property_id, ',' ORDER BY property_id)) AS id, 'PENDING' AS status, count(*) AS member_count, 0.5::DOUBLE AS ai_score, 'engine: created at 2024-01-01T00:00:00' AS notes, count(*) AS n_junction FROM members GROUP BY cluster_id HAVING cluster_id % 2 = 1 AND count(*) > 1")
def pending_clusters(spark: SparkSession, sf: str) -> DataFrame:
    m = members(spark, sf).withColumnRenamed("cluster_id", "root")
    made = m.groupBy("root").agg(F.count("*").alias("member_count")).where("member_count > 1")
    made = made.select("root", F.when(F.col("root") % 2 == 0, F.lit("attached")).alias("cluster_id"), "member_count", F.lit(0.5).alias("ai_score"))
    clusters, junction = K.pending_clusters(made, m, day())
    return clusters.join(junction.groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("n_junction")), "id").select("id", "status", "member_count", "ai_score", "notes", "n_junction")


@query(
    f"WITH {MEMBERS_SQL}, {JUDGED_SQL}, gone AS (SELECT * FROM members WHERE cluster_id % 10 = 0), more AS (SELECT x.property_id AS a, y.property_id AS b FROM gone x JOIN gone y ON x.cluster_id = y.cluster_id AND x.property_id < y.property_id EXCEPT SELECT a, b FROM judged) "
    "SELECT 'members' AS name, (SELECT count(*) FROM members) AS before, (SELECT count(*) FROM members WHERE cluster_id % 10 <> 0) AS after, -(SELECT count(*) FROM gone) AS delta UNION ALL "
    "SELECT 'feedback', (SELECT count(*) FROM judged), (SELECT count(*) FROM judged) + (SELECT count(*) FROM more), (SELECT count(*) FROM more)"
)
def dry_run_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """What dissolving every tenth cluster would change: members that are let go and judgements that are added."""
    m, judged = members(spark, sf), pairs_judged(spark, sf)
    commands = m.where("cluster_id % 10 = 0").select("cluster_id").distinct()
    hashes = m.select(F.col("property_id").alias("id"), F.lit("h").alias("content_hash"))
    new = B.of_dissolved_clusters(m.join(commands, "cluster_id", "left_semi"), hashes, judged)
    kept, _ = K.dissolve(m, commands.select(F.col("cluster_id").alias("id")), commands)
    return deltas({"members": m, "feedback": judged}, {"members": kept, "feedback": judged.unionByName(new.select("prop_a_id", "prop_b_id"))})


# --- filters ---------------------------------------------------------------------------------------------------------

READY = Config(min_description=5)


@query(f"WITH {SQL} SELECT id FROM listings WHERE label % 4 <> 0 AND municipality <> 'M3' AND bedrooms < 5 AND length(description) >= 5")
def eligible_listings(spark: SparkSession, sf: str) -> DataFrame:
    x = listings(spark, sf).withColumns({
        "embedding": F.when(F.col("label") % 4 != 0, F.col("embedding")), "municipality": F.nullif("municipality", F.lit("M3")),
        "bedrooms": F.nullif("bedrooms", F.lit(5)), "land_size_sqm": F.lit(None).cast("double"),
    })
    return P.eligible(x, READY).select("id")


PAIRED_SQL = "paired AS (SELECT x.property_id AS a_id, y.property_id AS b_id FROM members x JOIN members y ON y.property_id::BIGINT = x.property_id::BIGINT + 1)"


def paired(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours by number; every eighth pair crosses two clusters."""
    m = members(spark, sf).select(F.col("property_id").alias("a_id"))
    return m.join(m.where("a_id > '000000000'").select(F.lpad((F.col("a_id").cast("long") - 1).cast("string"), 9, "0").alias("a_id"), F.col("a_id").alias("b_id")), "a_id")


@query(f"WITH {MEMBERS_SQL}, {JUDGED_SQL}, {PAIRED_SQL} SELECT a_id, b_id FROM paired WHERE NOT EXISTS (SELECT 1 FROM judged WHERE a = a_id AND b = b_id)")
def pairs_without_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return P.without_feedback(paired(spark, sf), pairs_judged(spark, sf))


@query(f"WITH {MEMBERS_SQL}, {JUDGED_SQL}, {PAIRED_SQL} SELECT a_id, b_id, EXISTS (SELECT 1 FROM judged WHERE a = a_id AND b = b_id) AS has_feedback FROM paired")
def pairs_with_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return P.with_feedback(paired(spark, sf), pairs_judged(spark, sf))


@query(f"WITH {MEMBERS_SQL}, {PAIRED_SQL} SELECT a_id, b_id FROM paired JOIN members x ON x.property_id = a_id JOIN members y ON y.property_id = b_id WHERE x.cluster_id <> y.cluster_id")
def pairs_across_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return P.without_common_cluster(paired(spark, sf), members(spark, sf))


@query(
    f"""WITH {MEMBERS_SQL}, {JUDGED_SQL}, f AS (SELECT a, b, a::BIGINT % 100 AS days FROM judged WHERE a::BIGINT % 2 = 0 AND a::BIGINT % 100 >= 10)
    SELECT a AS prop_a_id, b AS prop_b_id, 'u' || a AS a_url, 'p' || (a::BIGINT % 3) AS a_photo, (SELECT count(*) FROM f) AS total FROM f JOIN members m ON m.property_id = b ORDER BY days DESC, a, b LIMIT 20 OFFSET 5"""
)
def feedback_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of judgements for a reason since a day, with both listings and their main photos."""
    n = F.col("prop_a_id").cast("long")
    f = pairs_judged(spark, sf).select("prop_a_id", "prop_b_id", F.array(F.when(n % 2 == 0, "price").otherwise("photo")).alias("reason_attributes"), F.lit("admin").alias("feedback_source"), later(n % 100).alias("created_at"))
    own = members(spark, sf).select(F.col("property_id").alias("id"), F.concat(F.lit("u"), F.col("property_id")).alias("url"), F.lit(1).alias("price"), F.lit("s").alias("source_domain"))
    k = F.col("id").cast("long")
    photo = lambda shift, main: own.select(F.col("id").alias("property_id"), F.concat(F.lit("p"), ((k + shift) % 3).cast("string")).alias("image_url"), F.lit(main).alias("is_main_photo"), day().alias("created_at"))
    page, total = B.listed(f, own, photo(0, True).union(photo(1, False)), reason="price", since=later(F.lit(10)), limit=20, offset=5)
    return page.select("prop_a_id", "prop_b_id", "a_url", "a_photo").join(F.broadcast(total))


@query("SELECT a || ':' || b AS pair_key FROM (SELECT lpad(c_custkey::VARCHAR, 9, '0') AS a, lpad((c_custkey + 1)::VARCHAR, 9, '0') AS b, c_custkey AS k FROM customer) WHERE k % 5 <> 0 AND (k + 1) % 5 <> 0")
def invalidated_cache(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    name = lambda x: F.lpad(x.cast("string"), 9, "0")
    touched = c.select((k - 1).alias("n")).union(c.select((k + 1).alias("n"))).union(c.select(k.alias("n"))).where("n % 5 = 0").distinct()
    return B.invalidated(c.select(M.pair_key(name(k), name(k + 1)).alias("pair_key")), touched.select(name(F.col("n")).alias("id")))


@query("SELECT o_orderkey AS id FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price FROM orders WHERE date_trunc('month', o_orderdate)::DATE = DATE '1995-01-01' OR (date_trunc('month', o_orderdate) + to_days((o_orderkey % 40)::INTEGER))::DATE = DATE '1995-01-01')")
def listings_of_day(spark: SparkSession, sf: str) -> DataFrame:
    """A day's report: listings made or changed on it."""
    k, made = F.col("o_orderkey"), F.date_trunc("month", "o_orderdate")
    x = table(spark, sf, "orders").select(k.alias("id"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"), made.alias("created_at"), (made + F.make_dt_interval((k % 40).cast("int"))).alias("updated_at"))
    return R.of_day(x, F.lit("1995-01-01").cast("date")).select("id")


# --- counters --------------------------------------------------------------------------------------------------------


@query(
    """SELECT count(*) FILTER (k % 4 = 0) AS ok, count(*) FILTER (k % 4 = 1) AS warning, count(*) FILTER (k % 4 > 1) AS critical, sum(k % 50)::BIGINT AS listings_found, sum(k % 7)::BIGINT AS new_count, sum(k % 5)::BIGINT AS delisted_count,
    sum(k % 3)::BIGINT AS revived_count, sum(k % 11)::BIGINT AS price_changed FROM (SELECT s_suppkey AS k FROM supplier)"""
)
def domain_totals(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    status = F.element_at(F.array(*map(F.lit, ("OK", "WARNING", "CRITICAL", "CLOUDFLARE"))), (k % 4 + 1).cast("int"))
    counts = {"listings_found": 50, "new_count": 7, "delisted_count": 5, "revived_count": 3, "price_changed": 11}
    return R.domain_totals(table(spark, sf, "supplier").select(status.alias("status"), *((k % n).alias(c) for c, n in counts.items())))


@query(
    """SELECT count(*) AS total, count(*) FILTER (k % 6 <> 0) AS ok, count(*) FILTER (k % 6 = 0) AS errors, sum(k % 4) FILTER (k % 6 <> 0)::BIGINT AS new_images_total, sum(k % 3) FILTER (k % 6 <> 0)::BIGINT AS extras_added_total,
    count(*) FILTER (k % 6 <> 0 AND k % 5 = 0) AS had_zero_media, count(*) FILTER (k % 6 <> 0 AND k % 5 = 0 AND k % 4 > 0) AS rescued_from_zero, count(*) FILTER (k % 6 <> 0 AND k % 2 = 0) AS columns_patched_total FROM (SELECT o_orderkey AS k FROM orders)"""
)
def refresh_summary(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    extras = F.slice(F.array(F.lit("pool"), F.lit("gym")), F.lit(1), (k % 3).cast("int"))
    patched = F.when(k % 2 == 0, F.array(F.lit("price")))
    return R.refresh_summary(table(spark, sf, "orders").select((k % 6 != 0).alias("ok"), (k % 4).alias("new_images"), extras.alias("extras_added"), patched.alias("fields_patched"), (k % 5).alias("n_media")))


# --- verdicts --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN p >= 0.75 THEN 'duplicate' WHEN p < 0.35 THEN 'different' ELSE 'uncertain' END AS verdict, round(CASE WHEN p >= 0.75 THEN p WHEN p < 0.35 THEN 1 - p ELSE abs(p - 0.5) * 2 END, 6)::DOUBLE AS confidence FROM (SELECT doc_id, (doc_id % 101) / 100.0::DOUBLE AS p FROM documents)")
def threshold_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    verdict, confidence = S.threshold_verdict(F.col("p"))
    x = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 101 / 100.0).alias("p"))
    return x.select("doc_id", verdict.alias("verdict"), F.round(confidence, 6).alias("confidence"))


@query(f"WITH {RULED_SQL}, s AS (SELECT a_id, b_id, list_cosine_similarity(a.embedding, b.embedding) AS c FROM scored JOIN listings a ON a.id = a_id JOIN listings b ON b.id = b_id) SELECT a_id, b_id, CASE WHEN tier = 0 THEN 'different' WHEN c >= 0.2 THEN 'duplicate' WHEN c < 0 THEN 'different' ELSE 'uncertain' END AS verdict, CASE WHEN tier = 0 THEN 1.0::DOUBLE WHEN c >= 0.2 OR c < 0 THEN 0.95 ELSE 0 END AS confidence FROM scored JOIN s USING (a_id, b_id)")
def similarity_or_backend(spark: SparkSession, sf: str) -> DataFrame:
    return S.similarity_or_backend(ruled(spark, sf), same=0.2, different=0.0).select("a_id", "b_id", "verdict", "confidence")


@query(
    f"""WITH {MEMBERS_SQL}, {PAIRED_SQL} SELECT a_id, b_id, CASE WHEN a_id::BIGINT % 4 = 0 THEN 'approved' WHEN a_id::BIGINT % 4 = 1 THEN 'rejected' ELSE 'pending' END AS verdict FROM paired"""
)
def after_vision(spark: SparkSession, sf: str) -> DataFrame:
    """Sure answers decide; unsure ones and pairs without an answer stay pending."""
    x, n = paired(spark, sf), F.col("a_id").cast("long")
    answers = x.where(n % 4 != 3).select("a_id", "b_id", (n % 4 != 1).alias("same"), F.when(n % 4 == 2, 0.7).otherwise(0.9).alias("confidence"))
    return S.after_vision(x.withColumn("verdict", F.lit("pending")), answers).select("a_id", "b_id", "verdict")


@query(f"WITH {MEMBERS_SQL}, {PAIRED_SQL}, s AS (SELECT * FROM members WHERE property_id::BIGINT % 5 < 3) SELECT a_id, b_id, CASE WHEN x.cluster_id IS NULL AND y.cluster_id IS NULL THEN 'free' WHEN x.cluster_id = y.cluster_id THEN 'inside' WHEN x.cluster_id <> y.cluster_id THEN 'disagree' ELSE 'attach' END AS kind FROM paired LEFT JOIN s x ON x.property_id = a_id LEFT JOIN s y ON y.property_id = b_id")
def edge_cases(spark: SparkSession, sf: str) -> DataFrame:
    seeds = members(spark, sf).where("CAST(property_id AS BIGINT) % 5 < 3")
    return K.edge_cases(paired(spark, sf).withColumn("confidence", F.lit(1.0)), seeds).select("a_id", "b_id", "kind")


@query(f"WITH {MEMBERS_SQL}, {PAIRED_SQL} SELECT x.cluster_id AS root, count(*) AS n_edges, round(avg(1.0 / (1 + a_id::BIGINT % 3)), 6)::DOUBLE AS ai_score FROM paired JOIN members x ON x.property_id = a_id JOIN members y ON y.property_id = b_id AND x.cluster_id = y.cluster_id WHERE x.cluster_id % 2 = 1 GROUP BY 1")
def materialised_clusters(spark: SparkSession, sf: str) -> DataFrame:
    m = members(spark, sf).select("property_id", F.col("cluster_id").alias("root"), F.when(F.col("cluster_id") % 2 == 0, F.lit("old")).alias("cluster_id"))
    edges = paired(spark, sf).withColumn("confidence", 1.0 / (1 + F.col("a_id").cast("long") % 3))
    made = K.materialised(m, edges).where("cluster_id IS NULL")
    return made.select("root", (F.col("member_count") - 1).alias("n_edges"), F.round("ai_score", 6).alias("ai_score"))


@query(f"WITH {MEMBERS_SQL} SELECT cluster_id, count(DISTINCT property_id::BIGINT % 4) AS n_locked FROM members WHERE property_id::BIGINT % 4 < 3 GROUP BY 1 HAVING count(DISTINCT property_id::BIGINT % 4) > 1")
def lock_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("property_id").cast("long")
    m = members(spark, sf)
    nodes = m.select(F.col("property_id").alias("node"), F.col("cluster_id").alias("root"))
    own = m.select(F.col("property_id").alias("id"), (n % 4).cast("string").alias("cluster_id"))
    locked = spark.createDataFrame([(str(k), k < 3) for k in range(4)], "id string, verdict_locked boolean")
    return K.lock_conflicts(nodes, own, locked).select(F.col("root").alias("cluster_id"), "n_locked")


@query("SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'DELISTED' WHEN 1 THEN 'ACTIVE' WHEN 2 THEN 'PRICE_CHANGED' ELSE 'NEW' END AS status, c_custkey % 5 <> 0 AND (c_custkey % 5 = 1 OR c_custkey % 2 = 0) AS is_active, CASE WHEN c_custkey % 5 <> 1 THEN 'h' END AS content_hash, c_custkey % 5 IN (1, 2, 3) AS seen FROM customer")
def after_diff(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    known = c.select(k.alias("id"), F.lit("NEW").alias("status"), (k % 2 == 0).alias("is_active"), day().alias("last_seen_at"), F.lit("h").alias("content_hash"))
    change = F.element_at(F.array(*map(F.lit, ("delisted", "revived", "price_changed", "unchanged"))), (k % 5 + 1).cast("int"))
    diff = c.where(k % 5 < 4).select(k.alias("id"), change.alias("change"))
    x = L.after_diff(known, diff, later(F.lit(3)))
    return x.select("id", "status", "is_active", "content_hash", (F.col("last_seen_at") > day()).alias("seen"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'garden:true,pool:false' ELSE 'pool:true' END AS features FROM customer")
def back_filled_features(spark: SparkSession, sf: str) -> DataFrame:
    """A map that brings a new key is merged in; one that doesn't changes nothing."""
    k = F.col("c_custkey")
    old, pool = F.create_map(F.lit("pool"), F.lit(True)), F.create_map(F.lit("pool"), F.lit(False))
    new = F.when(k % 3 == 0, F.map_concat(pool, F.create_map(F.lit("garden"), F.lit(True)))).otherwise(pool)
    x = table(spark, sf, "customer").select(k.alias("id"), L.back_filled_features(old, new).alias("m"))
    return x.select("id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))), ",").alias("features"))


# --- photos and texts ------------------------------------------------------------------------------------------------


def _hash(n: Column) -> Column:
    return F.lpad(F.lower(F.hex(n)), 16, "0")


@query("SELECT doc_id, least(bit_count(doc_id ^ (doc_id * 3)), bit_count((doc_id + 1) ^ (doc_id * 3)))::INTEGER AS least, ((bit_count(doc_id ^ (doc_id * 3)) <= 10)::INTEGER + (bit_count((doc_id + 1) ^ (doc_id * 3)) <= 10)::INTEGER) AS close FROM (SELECT xor(doc_id, 0) AS doc_id FROM documents)".replace("doc_id ^ (doc_id * 3)", "xor(doc_id, doc_id * 3)").replace("(doc_id + 1) ^ (doc_id * 3)", "xor(doc_id + 1, doc_id * 3)"))
def photo_distances(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    x = table(spark, sf, "documents").select(k, M.photo_distances(F.array(_hash(k), _hash(k + 1)), F.array(_hash(k * 3))).alias("d"))
    return x.select("doc_id", "d.least", "d.close")


@query("SELECT doc_id, (bit_count(xor(doc_id, doc_id * 5)) <= 6)::INTEGER AS matches, (doc_id % 2 = 0 AND bit_count(xor(doc_id, doc_id * 5)) <= 6)::INTEGER AS without_stock FROM documents")
def near_photo_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Photos count as the same up to a few differing bits; every other one is a stock photo."""
    k = F.col("doc_id")
    a, b = F.array(_hash(k), F.lit("")), F.array(F.lit("").cast("string"), _hash(k * 5))
    stock = F.when(k % 2 == 1, F.array(_hash(k))).otherwise(F.array(F.lit("none")))
    return table(spark, sf, "documents").select("doc_id", M.greedy_photo_matches(a, b).alias("matches"), M.greedy_photo_matches(a, b, stock).alias("without_stock"))


#: Names of categories as sites write them, and what they are.
KNOWN = (("Villa", "villa"), (" BUNGALOW ", "detached_house"), ("STUDIO", "studio"), ("apartment complex", "multi_unit_building"), ("Maisonette", "maisonette"), ("", "unknown"), ("Castle", "unknown_label_castle"))
_KNOWN_SQL = " ".join(f"WHEN {k} THEN '{v[1]}'" for k, v in enumerate(KNOWN))


@query(f"SELECT doc_id, CASE doc_id % {len(KNOWN)} {_KNOWN_SQL} END AS canonical FROM documents")
def known_categories(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n, _ in KNOWN))
    return table(spark, sf, "documents").select("doc_id", M.canonical_category(F.element_at(names, (F.col("doc_id") % len(KNOWN) + 1).cast("int"))).alias("canonical"))


@query("SELECT doc_id, (doc_id % 3 = doc_id % 2)::INTEGER + (doc_id % 3 = 7)::INTEGER AS shared FROM documents")
def shared_photos(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    name = lambda n: F.concat(F.lit("h"), n.cast("string"))
    return table(spark, sf, "documents").select("doc_id", M.shared_photos(F.array(name(k % 3), F.lit("x")), F.array(name(k % 2), name(F.lit(7)))).alias("shared"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'beds=3,garden=true,heated_pool=true' ELSE 'beds=3,heated_pool=true' END AS flat FROM documents")
def flat_payloads(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    known = F.create_map(F.lit("beds"), F.lit("3"), F.lit("baths"), F.lit(None).cast("string"))
    flags = F.create_map(F.lit("garden"), k % 2 == 0, F.lit("gym"), F.lit(False))
    x = table(spark, sf, "documents").select("doc_id", X.flat_payload(known, flags, F.array(F.lit(" Heated Pool"), F.lit("heated-pool"), F.lit(" "))).alias("m"))
    return x.select("doc_id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("flat"))


# --- the ten sites ---------------------------------------------------------------------------------------------------


def _items(*pairs: tuple[str, str], start: str, middle: str, end: str) -> str:
    return "".join(f"{start}{label}{middle}{value}{end}" for label, value in pairs)


_KF = dict(start="<li>", middle=": ", end="</li>")
#: A listing in the markup of each site. %1: price, %2: size, %3: land, %4: bedrooms, %5: bathrooms, %6: year, %7: part's name.
SITE_PAGES = {
    "glrealestate.gr": '<ul class="kf_property_detail_Essentail">' + _items(("Price", "%1$s€"), ("Size", "%2$s m²"), ("Land area", "%3$s m²"), ("Bedrooms", "%4$s"), ("Bathrooms", "%5$s"), ("Year of Construction", "%6$s"), ("Area", "Nikiti"), ("Kitchens", "2"), ("Furnished", "Yes"), ("Type", "For Sale"), **_KF) + '<li>Pool</li></ul><div class="kf_property_detail_uptwon">%7$s</div>',
    "realestatecenter.gr": _items(("Price", "€ %1$s"), ("Size", "%2$s sqm"), ("Plot", "%3$s sqm"), ("Bedrooms", "%4$s"), ("Bathrooms", "%5$s"), ("Year built", "%6$s"), start='<div class="spec"><h3>', middle="</h3><p>", end="</p></div>") + '<div class="accordion-content"><ul><li>Pool</li></ul></div><span class="full-desc">%7$s</span>',
    "greekexclusiveproperties.com": '<h5 class="price">%1$s €</h5><span class="property-meta-size">%2$s m2</span><span class="property-meta-lot-size">%3$s m2</span><span class="property-meta-bedrooms">%4$s Bedrooms</span><span class="property-meta-bath">%5$s Baths</span><address class="title">Hanioti, Halkidiki</address><div class="detail">Year built: %6$s</div><div class="detail">Furnished: Yes</div><li class="feature">Pool</li><div class="property-description">%7$s</div>',
    "sousouras-realestate.gr": '<span class="price">%1$s €</span><span class="area">%2$s m²</span><table class="info-table">' + _items(("Rooms", "%4$s"), ("Bathrooms", "%5$s"), ("Construction year", "%6$s"), ("Plot size", "%3$s m²"), ("Neighborhood", "Nikiti"), ("Kitchens", "2"), start="<tr><th>", middle="</th><td>", end="</td></tr>") + '</table><ul class="property-amenities"><li>Pool</li></ul><div class="property-content">%7$s</div>',
    "sithoniarental-sales.gr": '<ul class="kf_property_detail_Essentail">' + _items(("Price", "%1$s€"), ("Area", "%2$s m²"), ("Land", "%3$s m²"), ("Bedrooms", "%4$s"), ("Bathrooms", "%5$s"), ("Year built", "%6$s"), ("Neighborhood", "Nikiti"), ("Kitchens", "2"), ("Furnished", "Yes"), **_KF) + '<li>Pool</li></ul><div class="kf_property_detail_uptwon">%7$s</div>',
    "halkidikiestate.com": '<div class="property-price"><span>%1$s €</span></div><div class="property-title"><span>Sarti</span></div><ul class="information-list">' + _items(("Area", "%2$s m²"), ("Plot area", "%3$s m²"), ("Rooms", "%4$s"), ("Bathroom", "%5$s"), ("Year of manufacture", "%6$s"), ("Kitchen", "2"), ("Code", "x1"), **_KF) + '<li>Pool</li></ul><div id="property-desc">%7$s</div>',
    "engelvoelkers.com": '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"dehydratedState":{"queries":[{"queryKey":["other"],"state":{}},{"queryKey":["listing",{}],"state":{"data":{"listing":{"price":{"salesPrice":%1$s},"area":{"livingSurface":%2$s,"plotSurface":%3$s},"bedrooms":{"min":%4$s,"max":9},"bathrooms":{"min":%5$s},"constructionYear":%6$s,"profile":{"description":"%7$s"}}}}}]}}}}</script>',
    "halkidikirealestate.com": '<div class="propertyPrice">€%1$s</div>' + _items(("Size", "%2$s m²"), ("Plot", "%3$s m²"), ("Bedrooms", "%4$s"), ("Bathrooms", "%5$s"), ("Year built", "%6$s"), ("Area", "Nikiti"), ("Sea", "1.5 km"), ("Furnished", "Yes"), start='<div class="detailsToProperty"><div class="row"><div><span>', middle="</span></div><div>", end="</div></div></div>") + '<div class="indexTitle">%7$s</div>',
    "ellasestate.com": '<script type="application/ld+json">{"@type":"RealEstateListing","offers":{"price":"%1$s"},"description":"%7$s","address":{"streetAddress":"Gerakini"}}</script>' + _items(("Area size", "%2$s sqm"), ("Plot size", "%3$s sqm"), ("Bedrooms", "%4$s"), ("Bathrooms", "%5$s"), ("Year built", "%6$s"), start='<div class="rh_ultra_prop_card__meta"><span class="rh-ultra-meta-label">', middle='</span><span class="figure">', end="</span></div>") + '<div class="rh_property__features_wrap"><a>Pool</a></div>',
    "grekodom.com": '<div class="property-pricing"><div class="property-price">€ %1$s</div></div><ul class="property-main-features">' + _items(("Size", "%2$s"), ("Land area", "%3$s"), ("Rooms", "%4$s"), ("Bathrooms", "%5$s"), ("Year built", "%6$s"), ("Floors", "2"), ("Furniture", "Yes"), ("Sq. meters", "7"), **_KF) + '</ul><div class="property-description">%7$s</div>',
}
#: What else each site's page holds: (area, municipality, notes, features).
SITE_EXTRAS = {
    "glrealestate.gr": ("Nikiti", None, "kitchens_count=2", "furnished=true,pool=true"),
    "realestatecenter.gr": (None, None, "", "pool=true"),
    "greekexclusiveproperties.com": (None, "Kassandra", "", "furnished=true,pool=true"),
    "sousouras-realestate.gr": ("Nikiti", None, "kitchens_count=2", "pool=true"),
    "sithoniarental-sales.gr": ("Nikiti", None, "kitchens_count=2", "furnished=true,pool=true"),
    "halkidikiestate.com": (None, "Sithonia", "kitchen_count=2", "pool=true"),
    "engelvoelkers.com": (None, None, "", ""),
    "halkidikirealestate.com": ("Nikiti", None, "distance_from_sea_m=1500", "furnished=true"),
    "ellasestate.com": (None, "Polygyros", "", "pool=true"),
    "grekodom.com": (None, None, "floors_total=2", "furnished=true"),
}
_EXTRAS_SQL = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in (domain, *extras)) + ")" for domain, extras in SITE_EXTRAS.items())


@query(
    f"""SELECT 'http://' || domain || '/property/' || p_partkey AS url, p_partkey::VARCHAR AS site_property_id, domain AS source_domain, (100000 + p_partkey * 7)::BIGINT AS price, (80 + p_partkey % 100)::DOUBLE AS size_sqm, (500 + p_partkey % 400)::DOUBLE AS land_size_sqm,
    (1 + p_partkey % 6)::INTEGER AS bedrooms, (1 + p_partkey % 3)::INTEGER AS bathrooms, (1950 + p_partkey % 70)::INTEGER AS year_built, area, municipality, p_name AS description, notes, features FROM part CROSS JOIN (VALUES {_EXTRAS_SQL}) e(domain, area, municipality, notes, features)"""
)
def parsed_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Listings out of pages in the markup of all ten sites."""
    from ..sources import html

    # Few bytes make many pages: parts are dealt over all tasks.
    k, part, out = F.col("p_partkey"), table(spark, sf, "part").select("p_partkey", "p_name").repartition(P.tasks(spark)), None
    values = [100000 + k * 7, 80 + k % 100, 500 + k % 400, 1 + k % 6, 1 + k % 3, 1950 + k % 70]
    shown = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    for domain, page in SITE_PAGES.items():
        url = F.concat(F.lit(f"http://{domain}/property/"), k.cast("string"))
        pages = part.select(url.alias("url"), F.format_string(page, *(v.cast("string") for v in values), F.col("p_name")).alias("html"))
        spec = html.SITES[domain]
        x = html.routed(html.parse_pages(pages, spec), spec)
        columns = ["url", "site_property_id", "source_domain", F.col("price").cast("long").alias("price"), "size_sqm", "land_size_sqm", "bedrooms", "bathrooms", "year_built", "area", "municipality", "description"]
        x = x.select(*columns, shown("notes").alias("notes"), shown("features").alias("features"))
        out = x if out is None else out.union(x)
    return out


# --- streams ---------------------------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, CASE WHEN user_id % 3 = 0 THEN 'ACTIVE' ELSE 'SOLD' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_changes(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming import jobs

    x = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("updated_at"), F.when(F.col("user_id") % 3 == 0, "ACTIVE").otherwise("SOLD").alias("status"))
    return streamed(spark, x, jobs.daily_changes, "complete")


@query("SELECT event_id AS id FROM events")
def stream_retained(spark: SparkSession, sf: str) -> DataFrame:
    """Every attempt comes twice and is kept once."""
    from ..streaming import jobs

    x = attempts(spark, sf)
    return streamed(spark, x.union(x), lambda rows: jobs.retained(rows, 3650), "append").select("id")


@query(f"WITH {RULED_SQL}, n AS (SELECT * FROM listings WHERE label < 5) SELECT n.id AS a_id, b.id AS b_id FROM n JOIN listings b ON n.municipality = b.municipality AND n.source_domain <> b.source_domain AND n.id <> b.id")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """New listings of a stream against the whole pool."""
    from ..streaming import jobs

    x = listings(spark, sf)
    return streamed(spark, x.where("label < 5"), lambda new: jobs.incremental_dedup(new, x), "append").select("a_id", "b_id")


def grown(spark: SparkSession, sf: str):
    """The state after a stream has brought the active listings in three batches."""
    from ..operators import incremental
    from ..storage import fresh_path

    x, path, folder, log = listings(spark, sf).where("is_active"), *(fresh_path(spark, k) for k in ("stream-in", "stream-state", "stream-log"))
    for k in range(3):
        x.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(path)
    state = incremental.GrowingClusters(spark, folder, SCALED, linking=("duplicate", "uncertain"))
    state.create(x, buckets=4)
    stream = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(path)
    incremental.grow(stream, state, log).trigger(availableNow=True).start().awaitTermination()
    return state


@query(
    f"""WITH RECURSIVE {RULED_SQL}, arcs AS (SELECT a_id AS x, b_id AS y FROM scored WHERE verdict <> 'different' UNION ALL SELECT b_id, a_id FROM scored WHERE verdict <> 'different'),
    walk AS (SELECT DISTINCT x AS node, x AS reach FROM arcs UNION SELECT w.node, b.y FROM walk w JOIN arcs b ON w.reach = b.x),
    joined AS (SELECT node, min(reach) AS root FROM walk GROUP BY 1),
    judged AS (SELECT node, count(*) AS n_pairs, count(*) FILTER (verdict <> 'different') AS n_linked, round(sum(confidence), 5) AS confidence FROM (SELECT unnest([a_id, b_id]) AS node, verdict, confidence FROM scored) GROUP BY 1)
    SELECT id AS node, coalesce(root, id) AS root, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_linked, 0) AS n_linked, coalesce(judged.confidence, 0)::DOUBLE AS confidence
    FROM listings LEFT JOIN joined ON joined.node = id LEFT JOIN judged ON judged.node = id WHERE is_active"""
)
def stream_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters and verdicts that grew batch by batch are those of all listings at once."""
    state = grown(spark, sf)
    ends = state.verdicts().select(F.explode(F.array("a_id", "b_id")).alias("node"), "verdict", "confidence")
    judged = ends.groupBy("node").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("verdict") != "different").alias("n_linked"), F.round(F.sum("confidence"), 5).alias("confidence"))
    nothing = {"n_pairs": 0, "n_linked": 0, "confidence": 0.0}
    return state.clusters().join(judged, "node", "left").fillna(nothing)


@query(
    """WITH m AS (SELECT c_custkey AS k, c_custkey // 7 AS g, c_custkey % 7 AS i FROM customer), n AS (SELECT * FROM m WHERE (SELECT max(k) FROM m) >= g * 7 + 5 AND i BETWEEN 1 AND 5 AND g * 7 + 1 >= (SELECT min(k) FROM m))
    SELECT lpad(k::VARCHAR, 9, '0') AS node, lpad((CASE WHEN i = 5 THEN k ELSE g * 7 + 1 END)::VARCHAR, 9, '0') AS root, CASE WHEN i = 5 THEN 'B' ELSE 'A' END || g AS cluster_id,
    CASE WHEN i = 5 THEN lpad((k - 1)::VARCHAR, 9, '0') END AS blocked_from FROM n"""
)
def contested_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of five listings between two approved clusters each: the last link of a chain comes too late."""
    k = F.col("c_custkey")
    name = lambda x: F.lpad(x.cast("string"), 9, "0")
    c = table(spark, sf, "customer").select(k, (k % 7).alias("i"), F.expr("c_custkey div 7").alias("g"))
    whole = c.where("i BETWEEN 1 AND 5").groupBy("g").agg(F.count("*").alias("n")).where("n = 5").select("g")
    c = c.join(whole, "g")
    edges = c.where("i BETWEEN 1 AND 4").select(name(k).alias("a_id"), name(k + 1).alias("b_id"))
    labels = c.where("i IN (1, 5)").select(name(k).alias("node"), F.concat(F.when(F.col("i") == 1, "A").otherwise("B"), F.col("g").cast("string")).alias("cluster_id"))
    members, blocked = K.ordered_union(edges, labels)
    return members.join(blocked.select(F.col("b_id").alias("node"), F.col("a_id").alias("blocked_from")), "node", "left")
