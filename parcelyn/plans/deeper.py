"""Registered queries over operators that only unit tests reached before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, weighted
from ..functions import cleaning as C
from ..functions import matching as M
from ..functions import textmine as X
from ..operators import clusters as K
from ..operators import feedback as B
from ..operators import pairs as P
from ..operators import reports as R
from ..operators import scoring as S
from ..sources import readers
from ..sources.readers import table
from ..storage import Tables, fresh_path, latest, upsert
from .catalogue import MEMBERS_SQL, RULED_SQL, members, query, ruled
from .listings import SCALED
from .more import day

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- values in texts -------------------------------------------------------------------------------------------------


@query(
    r"""WITH t AS (SELECT doc_id, text, translate(text, chr(160) || chr(8239), '  ') AS plain FROM documents),
    n AS (SELECT *, nullif(regexp_extract(text, '\d+(?:[.,]\d+)?'), '') AS sqm, nullif(regexp_extract(plain, '-?\d[\d ]*(?:[.,]\d+)?'), '') AS num FROM t)
    SELECT doc_id, TRY_CAST(regexp_replace(text, '[^0-9]', '', 'g') AS BIGINT) AS all_digits, TRY_CAST(regexp_replace(replace(text, ',', '.'), '[^0-9.-]', '', 'g') AS DOUBLE) AS coordinate,
    TRY_CAST(replace(sqm, ',', '.') AS DOUBLE) AS sqm, TRY_CAST(replace(replace(num, ' ', ''), ',', '.') AS DOUBLE) AS number, TRY_CAST(floor(TRY_CAST(replace(replace(num, ' ', ''), ',', '.') AS DOUBLE)) AS BIGINT) AS whole,
    sha256(trim(regexp_replace(plain, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS plain FROM n"""
)
def text_numbers(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", C.clean_int(t).alias("all_digits"), C.clean_coordinate(t).alias("coordinate"), C.first_sqm(t).alias("sqm"), C.number_in_text(t).alias("number"), C.int_in_text(t).alias("whole"), F.sha2(C.plain_blanks(t), 256).alias("plain"))


@query(
    r"""SELECT page_id, length(html) AS kept, url AS description, url || '-300x200' AS image, regexp_replace(url, '\?.*$', '') || '_1600x1200.jpg' AS full_size, regexp_replace(url, '\?.*$', '') || '.jpg' AS whole,
    array_to_string(list_filter(list_transform(generate_series(1, len(string_split(url, '/'))), lambda i: CASE WHEN list_position(string_split(url, '/'), string_split(url, '/')[i]) = i THEN string_split(url, '/')[i] END), lambda x: x IS NOT NULL), '/') AS parts FROM pages"""
)
def page_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Struck prices, meta tags in both orders, image addresses and path parts, around every page as it is."""
    url, plain = F.col("url"), F.regexp_replace("url", r"\?.*$", "")
    struck = F.concat(F.lit('<s class="old">\n'), url, F.lit("</s>"), F.col("html"), F.lit("<S>1</S>"))
    head = F.concat(F.lit('<meta property="og:description" content="'), url, F.lit('"><meta content="'), url, F.lit('-300x200" property="og:image">'), F.col("html"))
    return table(spark, sf, "pages").select(
        "page_id", F.length(C.without_struck(struck)).alias("kept"), C.meta_property(head, "og:description").alias("description"), C.meta_property(head, "og:image").alias("image"),
        C.full_size_image(F.concat(plain, F.lit("_640x480.jpg"))).alias("full_size"), C.without_thumbnail(F.concat(plain, F.lit("-150x150.jpg"))).alias("whole"), F.array_join(C.distinct_in_order(F.split("url", "/")), "/").alias("parts"),
    )


@query(
    r"""SELECT p_partkey AS id, regexp_replace(lower(regexp_replace(p_brand || 'Name', '([A-Z])', '_\1', 'g')), '^_', '') AS snake, CAST(p_size AS VARCHAR) AS levels,
    lower(trim(p_name)) NOT IN ('', 'false', 'no', '0', 'none') AS yes, false AS numeric_yes,
    CASE WHEN p_partkey % 3 = 0 THEN 'garage,alarm_system,sea_view' ELSE 'alarm,parking,sea_view' END AS filled, 'R' || p_partkey AS reference, '0' || (1 + p_partkey % 9) || '/02/2024' AS updated FROM part"""
)
def mined_values(spark: SparkSession, sf: str) -> DataFrame:
    """Names, truths, features filled in beside their synonyms, and the references of a listing's text."""
    k = F.col("p_partkey")
    known = F.when(k % 3 == 0, F.create_map(F.lit("garage"), F.lit(True))).otherwise(F.create_map(F.lit("alarm"), F.lit(True)))
    found = F.create_map(*(x for name in ("parking", "alarm_system", "sea_view") for x in (F.lit(name), F.lit(True))))
    text = F.concat(F.lit("Ref: R"), k.cast("string"), F.lit(" of "), F.col("p_name"), F.lit(". Last updated: 0"), (1 + k % 9).cast("string"), F.lit("/02/2024"))
    filled = F.map_keys(X.fill_features(known, found))
    ordered = F.concat(F.slice(filled, 1, 1), F.array_sort(F.slice(filled, 2, 9)))
    return table(spark, sf, "part").select(
        k.alias("id"), C.snake_case(F.concat("p_brand", F.lit("Name"))).alias("snake"), C.levels_text(F.col("p_size")).alias("levels"), M.truthy(F.col("p_name")).alias("yes"), M.truthy(F.col("p_size").cast("string")).alias("numeric_yes"),
        F.array_join(ordered, ",").alias("filled"), X.system_data(text)["site_property_id"].alias("reference"), X.system_data(text)["last_updated"].alias("updated"),
    )


@query(
    """WITH b AS (SELECT conv_id, text, (contains(lower(text), 'the'))::INT + (contains(lower(text), 'ing'))::INT + (contains(lower(text), 'é'))::INT AS hits FROM conversations)
    SELECT conv_id, arg_max(text, (hits, length(text), text)) AS description FROM b WHERE text IS NOT NULL GROUP BY 1"""
)
def main_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The turn of each conversation that speaks most of what is asked for."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("blocks"))
    return turns.select("conv_id", C.main_description(F.col("blocks"), ("the", "ing", "é")).alias("description"))


# --- clusters, feedback, telemetry -----------------------------------------------------------------------------------


@query(f"WITH {MEMBERS_SQL} SELECT x.property_id AS prop_a_id, y.property_id AS prop_b_id, sha256(x.property_id) AS hash_a, sha256(y.property_id) AS hash_b, 'admin_reject' AS feedback_source FROM members x JOIN members y ON x.cluster_id = y.cluster_id AND x.property_id < y.property_id")
def rejected_cluster_feedback(spark: SparkSession, sf: str) -> DataFrame:
    m = members(spark, sf)
    return B.of_rejected_clusters(m, m.select(F.col("property_id").alias("id"), F.sha2("property_id", 256).alias("content_hash")))


@query(
    f"""WITH {MEMBERS_SQL}, d AS (SELECT a.cluster_id AS ca, b.cluster_id AS cb, a.property_id AS pa, b.property_id AS pb FROM members a JOIN members b ON b.property_id::BIGINT = a.property_id::BIGINT + 1 AND a.cluster_id <> b.cluster_id)
    SELECT least(ca, cb) AS cluster_id, least(pa, pb) AS pair_a_id, greatest(pa, pb) AS pair_b_id, 'approved_disagreement' AS flag_type FROM d WHERE least(ca, cb) % 4 <> 0"""
)
def disagreement_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours in different approved clusters, flagged once; every fourth cluster has its flag already."""
    m = members(spark, sf)
    a = m.select(F.col("property_id").alias("a_id"), F.col("cluster_id").alias("cluster_a"), (F.col("property_id").cast("long") + 1).alias("n"))
    b = m.select(F.col("property_id").alias("b_id"), F.col("cluster_id").alias("cluster_b"), F.col("property_id").cast("long").alias("n"))
    flags = K.disagreement_flags(a.join(b, "n").where("cluster_a <> cluster_b"))
    return K.new_flags(flags.union(flags), flags.where("cluster_id % 4 = 0"))


@query(
    """WITH l AS (SELECT c_custkey AS id, c_custkey // 8 AS cluster_id, c_mktsegment AS status FROM customer), held AS (SELECT cluster_id, count(*) AS n FROM l WHERE status <> 'MACHINERY' GROUP BY 1),
    c AS (SELECT DISTINCT cluster_id, cluster_id % 5 = 0 AS locked FROM l UNION ALL SELECT 1000000 + s_suppkey, s_suppkey % 2 = 0 FROM supplier)
    SELECT c.cluster_id AS id, locked, coalesce(n, 0)::INTEGER AS member_count FROM c LEFT JOIN held ON held.cluster_id = c.cluster_id WHERE locked OR n IS NOT NULL"""
)
def released_and_recounted(spark: SparkSession, sf: str) -> DataFrame:
    """Sold listings leave, clusters without members go unless they are locked, and the others are counted anew."""
    k = F.col("c_custkey")
    own = table(spark, sf, "customer").select(k.alias("id"), F.expr("c_custkey div 8").alias("cluster_id"), F.when(F.col("c_mktsegment") == "MACHINERY", "SOLD").otherwise("ACTIVE").alias("status"))
    more = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("id"), (F.col("s_suppkey") % 2 == 0).alias("verdict_locked"))
    known = own.select(F.col("cluster_id").alias("id")).distinct().withColumn("verdict_locked", F.col("id") % 5 == 0).unionByName(more).withColumn("member_count", F.lit(-1))
    held = K.release_sold(own).where("cluster_id IS NOT NULL")
    return K.recounted(K.without_orphans(known, held), held).select("id", F.col("verdict_locked").alias("locked"), "member_count")


@query(
    """SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS domain, length(url) > 20 AS long_url, least(length(repeat(url, 20)), 500) AS url_length, CASE page_id % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'http_error' WHEN 2 THEN CASE WHEN length(html) < 200 THEN 'empty' END ELSE 'empty' END AS error_code,
    (page_id % 4 = 2 AND length(html) >= 200) AS success, left(html, 500) AS error_text FROM pages"""
)
def attempt_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Responses as telemetry: page bodies behind good and bad statuses, texts cut to what is kept."""
    k = F.col("page_id")
    status = F.when(k % 4 == 0, 429).when(k % 4 == 1, 404).otherwise(200)
    body = F.when(k % 4 == 3, F.substring("html", 1, 150)).otherwise(F.col("html"))
    x = table(spark, sf, "pages").select(k, F.concat(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit(" "), k.cast("string")).alias("domain"), F.repeat("url", 20).alias("url"), (k % 3).alias("stage"), status.alias("status"), body.alias("body"), F.lit(1.0).alias("duration_ms"), F.col("html").alias("error_text"), day().alias("created_at"))
    got = readers.attempts(x)
    parts = F.split("domain", " ")
    return got.select(parts[1].cast("long").alias("page_id"), parts[0].alias("domain"), (F.length("url") > 20).alias("long_url"), F.length("url").alias("url_length"), "error_code", "success", "error_text")


@query(
    """WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS seen, count(*) AS n FROM events GROUP BY 1)
    SELECT user_id, (CASE WHEN user_id % 4 = 0 THEN seen ELSE 0 END) = 0 AND n >= 50 AS walled FROM u"""
)
def walled_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Sites that show nothing although much of them is known."""
    x = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("seen"), F.count("*").alias("n"))
    return x.select("user_id", R.walled_off(F.when(F.col("user_id") % 4 == 0, F.col("seen")).otherwise(0), F.col("n")).alias("walled"))


@query(
    """SELECT event_id FROM events WHERE event_type <> 'error' AND ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-20' AND user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) % 2 = 0)"""
)
def valid_tokens(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    tokens = e.select("event_id", F.col("user_id").alias("agent_id"), (F.col("event_type") == "error").alias("used"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 10 DAY")).alias("expires_at"))
    agents = e.groupBy(F.col("user_id").alias("agent_id")).agg((F.count("*") % 2 == 0).alias("is_active"))
    return R.valid_tokens(tokens, agents, F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query(
    """SELECT o_orderkey AS id, '€' || replace(format('{:,}', floor(o_totalprice)::BIGINT), ',', '.') AS price, strftime((o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Athens', '%d/%m/%Y %H:%M') AS local,
    CASE WHEN o_orderdate > TIMESTAMP '1998-06-01' - INTERVAL 2 DAY THEN 'green' WHEN o_orderdate > TIMESTAMP '1998-06-01' - INTERVAL 7 DAY THEN 'yellow' ELSE 'red' END AS age FROM orders"""
)
def shown_orders(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), R.euro_text(F.floor("o_totalprice").cast("long")).alias("price"), R.local_time(at).alias("local"), R.age_colour(at, F.lit("1998-06-01").cast("timestamp")).alias("age"))


# --- keyed tables ----------------------------------------------------------------------------------------------------


@query(
    """WITH n AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS v, max(o_orderkey) AS at FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1), o AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS v, max(o_orderkey) AS at FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
    SELECT coalesce(n.k, o.k) AS pair_key, coalesce(n.v, o.v) AS verdict, coalesce(n.at, o.at) AS scored_at FROM n FULL JOIN o ON n.k = o.k"""
)
def pair_cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The last verdict of each pair wins, within what comes and against what is there."""
    x = table(spark, sf, "orders").select(F.col("o_custkey").alias("pair_key"), F.col("o_orderstatus").alias("verdict"), F.col("o_orderkey").alias("scored_at"))
    old, new = (latest(x.where(F.col("scored_at") % 2 == k), ["pair_key"], "scored_at") for k in (0, 1))
    return upsert(old, new, ["pair_key"])


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment, c_acctbal AS balance FROM customer WHERE c_nationkey <> 3 OR c_custkey % 10 = 0
    UNION ALL SELECT 1000000 + s_suppkey, 'ADDED', s_acctbal FROM supplier"""
)
def tables_in_step(spark: SparkSession, sf: str) -> DataFrame:
    """A keyed table after a nation was taken out, some rows were changed in part, and others were added, in two switches."""
    tables = Tables(spark, fresh_path(spark, "tables"))
    c = table(spark, sf, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    tables.create("listings", rows, ["id"], buckets=16)
    tables.change(deletes={"listings": c.where("c_nationkey = 3").select(F.col("c_custkey").alias("id"))})
    kept = rows.where("id % 10 = 0").withColumn("segment", F.lit("NEW"))
    added = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("id"), F.lit("ADDED").alias("segment"), F.col("s_acctbal").alias("balance"))
    tables.change({"listings": kept.union(added)})
    return tables.read("listings")


# --- places, costs, weights ------------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 19 <> 0 THEN 39 + (c_custkey * 37 % 1009) / 500.0::DOUBLE END AS lat, 22 + (c_custkey * 91 % 997) / 480.0::DOUBLE AS lng FROM customer),
    a AS (SELECT s_suppkey AS area_id, 39 + (s_suppkey * 53 % 499) / 250.0::DOUBLE AS lat, 22 + (s_suppkey * 29 % 503) / 240.0::DOUBLE AS lng, n_nationkey AS municipality_id, n_regionkey AS prefecture_id FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 6 <> 0 AND n_nationkey <> 7)
    SELECT p.id, area_id, municipality_id, prefecture_id, round(distance, 6) AS distance FROM p LEFT JOIN (SELECT id, arg_min(struct_pack(a := area_id, m := municipality_id, r := prefecture_id, d := sqrt(pow(p.lat - a.lat, 2) + pow(p.lng - a.lng, 2))), (sqrt(pow(p.lat - a.lat, 2) + pow(p.lng - a.lng, 2)), area_id)) AS best
        FROM p, a WHERE p.lat IS NOT NULL GROUP BY 1) USING (id), (SELECT 1) CROSS JOIN LATERAL (SELECT best.a AS area_id, best.m AS municipality_id, best.r AS prefecture_id, best.d AS distance)"""
)
def located_listings(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest area of each listing, with its municipality and prefecture; areas with a blank place don't count."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, sf, "customer").select(k.alias("id"), F.when(k % 19 != 0, 39 + (k * 37 % 1009) / 500.0).alias("lat"), (22 + (k * 91 % 997) / 480.0).alias("lng"))
    lat = F.when(s % 6 == 0, "").otherwise((39 + (s * 53 % 499) / 250.0).cast("string"))
    areas = table(spark, sf, "supplier").select(s.alias("area_id"), lat.alias("lat"), (22 + (s * 29 % 503) / 240.0).cast("string").alias("lng"), F.col("s_nationkey").alias("municipality_id"))
    places = table(spark, sf, "nation").where("n_nationkey <> 7").select(F.col("n_nationkey").alias("municipality_id"), F.col("n_regionkey").alias("prefecture_id"))
    found = P.located(points, areas, places, table(spark, sf, "region").select(F.col("r_regionkey").alias("prefecture_id")))
    return found.select("id", "area_id", "municipality_id", "prefecture_id", F.round("distance", 6).alias("distance"))


@query("SELECT event_type, count(*) AS n, round(sum(value) / 1000, 6) AS cost_usd, round(sum(value), 1) AS total_ms, round(sum(value) / count(*), 1) AS mean_ms, round(sum(value) / count(*), 2) AS seconds_per_1000 FROM events GROUP BY 1")
def evaluation_costs(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "events").select("event_type", (F.col("value") / 1000).alias("cost_usd"), F.col("value").alias("latency_ms"))
    return R.evaluation_costs(x, "event_type")


@query(f"WITH {RULED_SQL} SELECT a_id, b_id, score + CASE WHEN a_bedrooms = b_bedrooms THEN 0.25 ELSE 0.0 END + CASE WHEN a_area = b_area THEN -1.5 ELSE 0.0 END AS score FROM scored JOIN pairs USING (a_id, b_id)")
def weighted_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores under weights that come from a table: bedrooms count for more, one area against."""
    weights = spark.createDataFrame([("bedrooms_same", DEFAULT.weights.bedrooms_same + 0.25), ("same_area", DEFAULT.weights.same_area - 1.5)], "name string, weight double")
    config = weighted([tuple(r) for r in weights.collect()], SCALED)
    return S.rule_scores(ruled(spark, sf), config).select("a_id", "b_id", "score")


# --- list walks ------------------------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT page_id, page_id // 5 AS site, page_id % 5 AS place, page_id % 5 + 1 AS page, page_id % 7 AS n, length(html) AS own FROM pages),
    reach AS (SELECT a.* FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.site = a.site AND b.place < a.place AND b.n = 0) AND EXISTS (SELECT 1 FROM p b WHERE b.site = a.site AND b.place = 0))
    SELECT 'site' || site AS domain, page::INTEGER AS page, n::INTEGER AS n_cards, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS stage FROM reach"""
)
def walked_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Walks over lists of up to five pages each, made of all pages: one without cards ends its site's walk."""
    from ..sources import crawl

    k = F.col("page_id")
    name, place = F.concat(F.lit("site"), F.expr("page_id div 5").cast("string")), k % 5
    address = lambda p: F.concat(F.lit("http://"), name, F.lit("/list?page="), (p + 1).cast("string"))
    card = lambda i: F.concat(F.lit('<a class="property-item" href="http://x/listing-'), (k * 10 + i).cast("string"), F.lit('"><i class="price">€ 500.000</i></a>'))
    shown = F.when(k % 7 == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(k % 7, F.lit(1))), card), ""))
    following = F.when(place < 4, F.concat(F.lit('<a rel="next" href="'), address(place + 1), F.lit('">'))).otherwise(F.lit('<li class="last disabled">'))
    x = table(spark, sf, "pages").withColumn("list", F.concat(F.rpad(F.lit("<p>"), 220, "x"), shown, following, F.regexp_replace("html", "(?i)<a |<li", "<b ")))
    good = x.select(address(place).alias("url"), F.when(k % 3 == 0, 1).otherwise(0).alias("stage"), F.lit(200).alias("status"), F.col("list").alias("body"))
    bad = x.where(k % 3 == 0).select(address(place).alias("url"), F.lit(0).alias("stage"), F.lit(403).alias("status"), F.lit("").alias("body"))
    starts = x.where(place == 0).select(name.alias("domain"), address(place).alias("url"), F.lit(0).alias("preferred"))
    _, pages, _ = crawl.walk(starts, good.union(bad))
    return pages.where("error_code IS NULL").select("domain", "page", "n_cards", "stage")
