"""More registered queries: caches, flags, admin actions, merges, external checks, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import matching as M
from ..functions import textmine as X
from ..operators import clusters as K
from ..operators import feedback as B
from ..operators import lifecycle as L
from ..operators import pairs as P
from ..operators import reports as R
from ..operators import scoring as S
from ..sources import html, readers
from ..sources.readers import table
from .catalogue import JUDGED_SQL, MEMBERS_SQL, members, pairs_judged, query
from .listings import SQL, listings

FIRST = "2024-01-01"


def day() -> Column:
    return F.lit(FIRST).cast("timestamp")


def later(days: Column) -> Column:
    return day() + F.make_dt_interval(days.cast("int"))


# --- sources ---------------------------------------------------------------------------------------------------------


@query(f"WITH {SQL} SELECT id, price FROM listings WHERE source_domain = 'site3'")
def scan_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    return readers.scan(listings(spark, sf), "site3", without=("embedding",)).select("id", "price")


@query(
    """SELECT p_partkey AS id, coalesce(m, 0) AS n_media, coalesce(h, 0) AS n_changes FROM part LEFT JOIN (SELECT l_partkey, count(*) AS m FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) a ON a.l_partkey = p_partkey
    LEFT JOIN (SELECT l_partkey, count(*) AS h FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) b ON b.l_partkey = p_partkey"""
)
def with_children(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    at = F.col("l_shipdate")
    media = line.where("l_linenumber = 1").select(F.col("l_partkey").alias("property_id"), at.alias("created_at"), F.col("l_suppkey").cast("string").alias("image_url"))
    history = line.where("l_linenumber = 2").select(F.col("l_partkey").alias("property_id"), at.alias("changed_at"), F.col("l_quantity").alias("old_price"), F.col("l_extendedprice").alias("new_price"))
    x = readers.with_children(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), media, history)
    n = lambda c: F.coalesce(F.size(F.coalesce(F.col(c), F.array())), F.lit(0)).cast("long")
    return x.select("id", n("media").alias("n_media"), n("price_history").alias("n_changes"))


@query("SELECT n_nationkey::VARCHAR AS c1, n_name || CASE WHEN n_nationkey % 2 = 0 THEN '''s' ELSE '' END AS c2, CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey::VARCHAR END AS c3 FROM nation")
def dump_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    name = F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, "\\'s").otherwise(""))
    row = F.concat(F.lit("("), F.col("n_nationkey").cast("string"), F.lit(", '"), name, F.lit("', "), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey").cast("string")).otherwise("NULL"), F.lit(")"))
    text = n.agg(F.concat(F.lit("INSERT INTO `nation` VALUES\n"), F.array_join(F.array_sort(F.collect_list(row)), ",\n"), F.lit(";\n")).alias("value"))
    return readers.dump_rows(text, 3)


@query()
def parsed_pages(spark: SparkSession, sf: str) -> DataFrame:
    spec = html.SiteSpec("example", items=("nav",), description=("article", "content"), listing_link="^/")
    x = html.routed(html.parse_pages(table(spark, sf, "pages"), spec), spec)
    return html.with_mined(x).select("url", "site_property_id", "price", "category", F.length("description").alias("length"))


# --- lifecycle -------------------------------------------------------------------------------------------------------


@query(
    """SELECT doc_id AS external_id, doc_id % 3 = 0 AS kept_vector, doc_id % 2 = 0 AS lives_on FROM documents"""
)
def external_cache(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    d = table(spark, sf, "documents")
    old = d.select(F.lit("x").alias("external_source"), k.alias("external_id"), F.col("text").alias("canonical_text"), F.sha2("text", 256).alias("content_hash"), F.array(F.lit(1.0)).alias("embedding"), day().alias("expires_at"))
    # Every third text is the same, the others change; rows that aren't seen keep what they have.
    new = d.where("doc_id % 2 = 0 OR doc_id % 3 <> 0").select(F.lit("x").alias("external_source"), k.alias("external_id"), F.when(k % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("canonical_text"))
    x = L.external_cache(old, new, later(F.lit(10)))
    seen = (F.col("external_id") % 2 == 0) | (F.col("external_id") % 3 != 0)
    ok = (F.col("expires_at") > later(F.lit(10))) == seen
    return x.select("external_id", (F.col("embedding").isNotNull()).alias("kept_vector"), (ok & (F.col("external_id") % 2 == 0)).alias("lives_on"))


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 5.0::DOUBLE ELSE 7.0 END AS size_sqm, CASE WHEN c_custkey % 3 = 0 THEN 'a longer text' ELSE 'short' END AS description,
    CASE WHEN c_custkey % 5 = 0 THEN 'garden:false,gym:true,pool:true' ELSE 'garden:false,pool:true' END AS features FROM customer"""
)
def merged_details(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    old = c.select(k.alias("id"), F.when(k % 2 == 0, 5.0).alias("size_sqm"), F.lit("short").alias("description"), F.create_map(F.lit("garden"), F.lit(True), F.lit("pool"), F.lit(True)).alias("features"))
    gym = F.when(k % 5 == 0, F.create_map(F.lit("gym"), F.lit(True))).otherwise(F.create_map().cast("map<string,boolean>"))
    new = c.select(k.alias("id"), F.lit(7.0).alias("size_sqm"), F.when(k % 3 == 0, "a longer text").otherwise("s").alias("description"), F.map_concat(F.create_map(F.lit("garden"), F.lit(False)), gym).alias("features"))
    x = L.merged_details(old, new, ("size_sqm",))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("features"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))), ",")
    return x.select("id", "size_sqm", "description", shown.alias("features"))


@query("SELECT 'u' || c_custkey AS url, CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 1 ELSE c_custkey END AS price, CASE WHEN c_custkey % 2 = 0 THEN 'Villa' END AS category FROM customer")
def newcomers(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    url = F.concat(F.lit("u"), k.cast("string")).alias("url")
    return L.newcomers(c.select(url, k.alias("price")), c.where(k % 2 == 0).select(url, (k + 1).alias("price"), F.lit("Villa").alias("category")))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 4 <> 0")
def stale_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("vec_id")
    text = k.cast("string")
    x = table(spark, sf, "embeddings").select(k.alias("id"), text.alias("text"), F.when(k % 4 == 0, F.sha2(text, 256)).when(k % 4 == 1, "other").alias("content_hash"))
    return L.stale_embeddings(x, F.col("text")).select("id")


@query(
    """SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 AND (c_custkey % 3 = 0 OR c_custkey % 10 > 5 OR c_custkey % 7 = 0 OR c_custkey % 20 < 9)"""
)
def needs_golden(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    x = table(spark, sf, "customer").select(k.alias("id"), F.when(k % 2 == 0, "APPROVED").otherwise("PENDING").alias("status"), F.when(k % 3 != 0, later(F.lit(5))).alias("power_generated_at"), later(k % 10).alias("updated_at"), F.when(k % 7 != 0, later(k % 20)).alias("last_external_check_at"))
    return L.needs_golden(x, later(F.lit(10))).select("id")


@query("SELECT doc_id // 5 AS property_id, string_agg(CASE WHEN doc_id % 3 = 0 THEN '' ELSE substr(md5(text), 1, 8) END, ',' ORDER BY doc_id) AS image_phashes FROM documents GROUP BY 1")
def photos_by_listing(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    media = table(spark, sf, "documents").select(F.expr("doc_id div 5").alias("property_id"), k.alias("position"), F.when(k % 3 != 0, F.substring(F.md5("text"), 1, 8)).alias("phash"))
    return L.photos_by_listing(media).select("property_id", F.array_join("image_phashes", ",").alias("image_phashes"))


# --- clusters and people ---------------------------------------------------------------------------------------------


@query(f"WITH {MEMBERS_SQL} SELECT cluster_id, least(property_id, anchor) AS pair_a_id, greatest(property_id, anchor) AS pair_b_id FROM (SELECT cluster_id + 1 AS loser, property_id FROM members WHERE substr(property_id, 9, 1) = '4') f JOIN (SELECT cluster_id, min(property_id) AS anchor FROM members GROUP BY 1) a ON a.cluster_id = f.loser WHERE loser % 3 <> 0")
def bridge_flags(spark: SparkSession, sf: str) -> DataFrame:
    m = members(spark, sf)
    flags = m.where("substr(property_id, 9, 1) = '4'").select("property_id", F.col("cluster_id").alias("winner"), (F.col("cluster_id") + 1).alias("loser"))
    made = K.bridge_flags(flags, m)
    return K.new_flags(made, made.where("cluster_id % 3 = 0")).select("cluster_id", "pair_a_id", "pair_b_id")


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'APPROVED' WHEN c_custkey % 10 = 5 THEN 'PENDING' WHEN c_custkey % 2 = 0 THEN 'PENDING' ELSE 'APPROVED' END AS status,
    CASE WHEN c_custkey % 10 = 0 THEN true WHEN c_custkey % 10 = 5 THEN false ELSE c_custkey % 2 = 1 END AS locked FROM customer"""
)
def bulk_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    old = c.select(k.alias("id"), F.when(k % 2 == 0, "PENDING").otherwise("APPROVED").alias("status"), (k % 2 == 1).alias("verdict_locked"), F.lit(None).cast("timestamp").alias("verdict_locked_at"), F.lit(None).cast("string").alias("verdict_locked_by"))
    commands = c.where("c_custkey % 5 = 0").select(k.alias("id"), F.when(k % 10 == 0, "APPROVED").otherwise("PENDING").alias("verdict"), F.lit("me").alias("by"))
    return K.verdicts(old, commands, day())[0].select("id", "status", F.col("verdict_locked").alias("locked"))


@query(f"WITH {MEMBERS_SQL}, {JUDGED_SQL} SELECT x.cluster_id, count(*) AS n FROM judged j JOIN members x ON x.property_id = j.a JOIN members y ON y.property_id = j.b AND x.cluster_id = y.cluster_id GROUP BY 1")
def recurrences(spark: SparkSession, sf: str) -> DataFrame:
    return K.recurrences(pairs_judged(spark, sf), members(spark, sf))


@query(f"WITH {MEMBERS_SQL} SELECT CASE WHEN cluster_id % 4 = 1 THEN cluster_id - 1 ELSE cluster_id END AS cluster_id, count(*) AS n FROM members WHERE cluster_id % 4 <> 2 AND NOT (cluster_id % 4 = 3 AND substr(property_id, 9, 1) = '0') GROUP BY 1")
def admin_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Dissolve every fourth cluster, take members out of another, merge a third into its forerunner."""
    m = members(spark, sf)
    ids = m.select("cluster_id").distinct()
    m, _ = K.dissolve(m, ids.select(F.col("cluster_id").alias("id")), ids.where("cluster_id % 4 = 2"))
    m = K.remove_members(m, m.where("cluster_id % 4 = 3 AND substr(property_id, 9, 1) = '0'"))
    merged = K.merge_clusters(m, ids.where("cluster_id % 4 = 1").select(F.col("cluster_id").alias("source"), (F.col("cluster_id") - 1).alias("target")))
    return merged.groupBy("cluster_id").agg(F.count("*").alias("n"))


@query(f"WITH {MEMBERS_SQL} SELECT least(r.property_id, k.property_id) AS prop_a_id, greatest(r.property_id, k.property_id) AS prop_b_id FROM members r JOIN members k ON r.cluster_id = k.cluster_id WHERE substr(r.property_id, 9, 1) = '0' AND substr(k.property_id, 9, 1) <> '0'")
def removal_feedback(spark: SparkSession, sf: str) -> DataFrame:
    m = members(spark, sf)
    gone = F.substring("property_id", 9, 1) == "0"
    hashes = m.select(F.col("property_id").alias("id"), F.lit("h").alias("content_hash"))
    return B.of_removed_members(m.where(gone), m.where(~gone), hashes).select("prop_a_id", "prop_b_id")


@query(
    """SELECT a_id, b_id FROM (SELECT lpad(o_orderkey::VARCHAR, 9, '0') AS a_id, lpad((o_orderkey + 1)::VARCHAR, 9, '0') AS b_id, (o_orderkey * 7919 % 10007) / 10007.0::DOUBLE AS similarity FROM orders) ORDER BY similarity DESC, a_id, b_id LIMIT 50"""
)
def vision_candidates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    x = table(spark, sf, "orders").select(F.lpad(k.cast("string"), 9, "0").alias("a_id"), F.lpad((k + 1).cast("string"), 9, "0").alias("b_id"), (k * 7919 % 10007 / 10007.0).alias("similarity"))
    return S.vision_candidates(x).select("a_id", "b_id")


@query(
    f"""WITH {SQL}, r AS (SELECT * FROM listings WHERE label < 5), c AS (SELECT * FROM listings WHERE label >= 5), t AS (SELECT r.id, max(list_cosine_similarity(r.embedding, c.embedding)) AS s FROM r JOIN c ON r.category = c.category AND r.municipality = c.municipality
    AND c.size_sqm BETWEEN floor(r.size_sqm * 0.85) AND floor(r.size_sqm * 1.15) GROUP BY 1) SELECT r.id AS cluster_id, round(s, 6) AS top_similarity, coalesce(s < 0.95, true) AS is_unique FROM r LEFT JOIN t USING (id)"""
)
def external_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    x = listings(spark, sf)
    own = x.where("label < 5").withColumnRenamed("id", "cluster_id")
    return S.external_uniqueness(own, own, x.where("label >= 5")).select("cluster_id", F.round("top_similarity", 6).alias("top_similarity"), "is_unique")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'uncertain' ELSE 'duplicate' END AS verdict, CASE doc_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 ELSE 0.0 END AS confidence, CASE WHEN doc_id % 4 IN (0, 1) THEN 2 ELSE 0 END AS n_signals FROM documents")
def parsed_answers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    json = F.when(k % 4 == 0, '{"verdict": "DUPLICATE", "confidence": 7, "signals": ["a", "b"]}').when(k % 4 == 1, '{"verdict": "duplicate", "confidence": 0.5, "signals": ["a", "b"]}').when(k % 4 == 2, '{"verdict": "duplicate", "confidence": "?"}').otherwise("not json")
    x = table(spark, sf, "documents").select("doc_id", S.parsed_answer(json).alias("p"))
    return x.select("doc_id", "p.verdict", "p.confidence", F.size("p.signals").alias("n_signals"))


# --- reports ---------------------------------------------------------------------------------------------------------


@query("SELECT l_partkey AS property_id, l_orderkey || '-' || l_linenumber AS photo FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) <= 3")
def first_photos(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("property_id"), "l_shipdate", "l_orderkey", "l_linenumber", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("photo"))
    return P.top_per_group(x, ["property_id"], [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber")], 3).select("property_id", "photo")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 >= 2 ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    x = table(spark, sf, "customer").select(k.alias("id"), F.when(k % 3 == 0, "PENDING").otherwise("APPROVED").alias("status"), F.lit("1").alias("engine_version"), (k % 5).alias("member_count"), F.col("c_acctbal").alias("created_at"))
    return R.reviews(x, "PENDING", "1").select("id")


@query("SELECT s_suppkey AS agent_id, s_suppkey % 4 AS tokens_used, s_suppkey % 3 AS devices FROM supplier")
def agent_report(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("s_suppkey"), table(spark, sf, "supplier")
    repeat = lambda n: s.select(k.alias("agent_id"), F.explode(F.sequence(F.lit(0), n)).alias("i")).where("i > 0")
    tokens = repeat(k % 4).withColumn("used", F.lit(True)).unionByName(s.select(k.alias("agent_id"), F.lit(0).cast("long").alias("i"), F.lit(False).alias("used")))
    return R.agent_report(s.select(k.alias("agent_id")), tokens, repeat(k % 3)).select("agent_id", "tokens_used", "devices")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'ACTIVE' ELSE 'SOLD' END AS status FROM orders")
def delivered_reports(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    x = table(spark, sf, "orders").select(k.alias("id"), F.when(k % 4 == 0, "NEW").when(k % 4 == 1, "PRICE_CHANGED").otherwise("SOLD").alias("status"))
    return R.after_delivery(x, spark.range(3)).select("id", "status")


@query("SELECT count(*) FILTER (c_custkey % 10 >= 5) AS created, count(*) FILTER (c_custkey % 10 >= 5 AND c_custkey % 2 = 0) AS approved, count(*) FILTER (c_custkey % 10 >= 5 AND c_custkey % 2 = 1) AS pending, count(*) FILTER (c_custkey % 7 = 0) AS locked FROM customer")
def cluster_stats(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    x = table(spark, sf, "customer").select(later(k % 10).alias("created_at"), F.when(k % 2 == 0, "APPROVED").otherwise("PENDING").alias("status"), (k % 7 == 0).alias("verdict_locked"))
    return R.cluster_stats(x, later(F.lit(5)))


@query("SELECT page_id, contains(lower(url), 'sana') OR contains(lower(url), 'sani') OR contains(lower(url), 'elia') OR contains(lower(url), 'akti') OR page_id % 3 = 0 AS hit FROM pages")
def region_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The addresses hold no place of the region but by chance; every third location does."""
    k = F.col("page_id")
    return table(spark, sf, "pages").select("page_id", X.in_region(F.col("url"), F.when(k % 3 == 0, "Nea Fokea")).alias("hit"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'B+' ELSE 'unknown' END AS energy, (p_partkey % 900 + 1) * 1000 AS metres, p_partkey % 2 = 0 AS yes FROM part")
def scalar_cleaners(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    energy = F.when(k % 4 == 0, "Α").when(k % 4 == 1, "γ").when(k % 4 == 2, "b+").otherwise("unknown")
    far = F.concat((k % 900 + 1).cast("string"), F.lit(" km from the sea"))
    return table(spark, sf, "part").select("p_partkey", C.energy_class(energy).alias("energy"), C.metres(far).alias("metres"), C.yes_no(F.when(k % 2 == 0, " Yes").otherwise("no")).alias("yes"))


@query(f"WITH {SQL} SELECT id, 'unknown_label_' || lower(category) AS canonical FROM listings")
def canonical_categories(spark: SparkSession, sf: str) -> DataFrame:
    return listings(spark, sf).select("id", M.canonical_category(F.col("category")).alias("canonical"))
