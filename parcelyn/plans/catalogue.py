"""Registered queries of the listing engine, each with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import cleaning as C
from ..functions import matching as M
from ..functions import textmine as X
from ..operators import clusters as K
from ..operators import feedback as B
from ..operators import golden as G
from ..operators import lifecycle as L
from ..operators import pairs as P
from ..operators import reports as R
from ..operators import scoring as S
from ..operators import vectors as V
from ..sources import readers
from ..sources.readers import table
from ..storage import upsert, written
from .listings import PAIR_COLUMNS, PAIRS_SQL, SCALED, SQL, listings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- blocking, features, scores --------------------------------------------------------------------------------------


#: Parts of each municipality's listings; 25 municipalities then have 1,600 blocks.
SALTS = 8


@query(f"WITH {PAIRS_SQL} SELECT a_id, b_id FROM pairs")
def block_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return P.block_pairs(listings(spark, sf), SALTS)


def blocked(spark: SparkSession, sf: str) -> DataFrame:
    own = M.of_listing(listings(spark, sf))
    return P.hydrated_blocks(own, [*PAIR_COLUMNS, "norm", "canonical_category"], SALTS).withColumn("has_feedback", F.lit(False))


def measured(spark: SparkSession, sf: str, columns: list[str], equal: list[str], *measures: str) -> DataFrame:
    """Pairs with their similarity and what is named, no more: these columns come out of Arrow tasks, where none is pruned."""
    return P.measured_blocks(M.of_listing(listings(spark, sf)), columns, equal, measures, salts=SALTS)


def bare_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return P.measured_blocks(listings(spark, sf), [], salts=SALTS, similar=False)


def ruled(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with what the rule scores read."""
    own = M.of_listing(listings(spark, sf)).withColumn("known_category", F.nullif("canonical_category", F.lit("unknown")))
    x = P.measured_blocks(own, ["price", "size_sqm", "year_built"], ["known_category", "area", "bedrooms"], ("metres",), salts=SALTS)
    return x.withColumns({"has_feedback": F.lit(False), "same_source_domain": F.lit(False)})


@query(
    f"""WITH {PAIRS_SQL} SELECT a_id, b_id, a_id || ':' || b_id AS pair_key, round(similarity, 6) AS similarity,
    CASE WHEN a_price > 0 AND b_price > 0 THEN round(greatest(a_price, b_price) / least(a_price, b_price)::DOUBLE, 6) END AS price_ratio,
    CASE WHEN a_size_sqm > 0 AND b_size_sqm > 0 THEN round(abs(a_size_sqm - b_size_sqm) / greatest(a_size_sqm, b_size_sqm), 6) END AS size_diff,
    abs(a_year_built - b_year_built) AS year_diff, a_bedrooms = b_bedrooms AS bedrooms_match, a_area = b_area AS same_area FROM pairs"""
)
def pair_features(spark: SparkSession, sf: str) -> DataFrame:
    return measured(spark, sf, ["price", "size_sqm", "year_built"], ["area", "bedrooms"]).select(
        "a_id",
        "b_id",
        M.pair_key(F.col("a_id"), F.col("b_id")).alias("pair_key"),
        M.rounded(F.col("similarity"), 6).alias("similarity"),
        M.rounded(M.ratio(F.col("a_price"), F.col("b_price")), 6).alias("price_ratio"),
        M.rounded(M.relative_difference(F.col("a_size_sqm"), F.col("b_size_sqm")), 6).alias("size_diff"),
        F.abs(F.col("a_year_built") - F.col("b_year_built")).alias("year_diff"),
        F.col("same_bedrooms").alias("bedrooms_match"),
        "same_area",
    )


RULED_SQL = (
    PAIRS_SQL
    + """, named AS (SELECT *, CASE WHEN coalesce(trim(a_category), '') = '' THEN 'unknown' ELSE 'unknown_label_' || lower(trim(a_category)) END AS ca,
    CASE WHEN coalesce(trim(b_category), '') = '' THEN 'unknown' ELSE 'unknown_label_' || lower(trim(b_category)) END AS cb,
    acos(least(1, greatest(-1, sin(radians(a_lat)) * sin(radians(b_lat)) + cos(radians(a_lat)) * cos(radians(b_lat)) * cos(radians(b_lng) - radians(a_lng))))) * 6371000 AS metres,
    CASE WHEN a_price > 0 AND b_price > 0 THEN greatest(a_price, b_price) / least(a_price, b_price)::DOUBLE END AS pr,
    CASE WHEN a_price > 0 AND b_price > 0 THEN abs(a_price - b_price) / greatest(a_price, b_price)::DOUBLE END AS pd,
    CASE WHEN a_size_sqm > 0 AND b_size_sqm > 0 THEN abs(a_size_sqm - b_size_sqm) / greatest(a_size_sqm, b_size_sqm) END AS sd FROM pairs),
    ruled AS (SELECT *, CASE WHEN ca <> 'unknown' AND cb <> 'unknown' AND ca <> cb THEN 'category_mismatch' WHEN abs(a_year_built - b_year_built) > 5 THEN 'year_built' END AS rule,
    CASE WHEN similarity >= 0.3 THEN 2.0 WHEN similarity >= 0.2 THEN 1.0 WHEN similarity < -0.2 THEN -2.0 WHEN similarity < -0.1 THEN -1.0 ELSE 0.0 END
    + CASE WHEN pr <= 1.3 THEN 1.0 WHEN pr >= 3.0 THEN -2.0 ELSE 0.0 END + CASE WHEN sd > 0.5 THEN -1.0 ELSE 0.0 END
    + CASE WHEN a_bedrooms = b_bedrooms THEN 0.5 WHEN a_bedrooms <> b_bedrooms THEN -0.5 ELSE 0.0 END + CASE WHEN abs(a_year_built - b_year_built) <= 1 THEN 0.5 ELSE 0.0 END
    + CASE WHEN metres <= 100 AND a_bedrooms <> b_bedrooms AND pd > 0.2 THEN -2.0 ELSE 0.0 END + CASE WHEN metres > 50000 THEN -1.0 ELSE 0.0 END
    + CASE WHEN a_area = b_area THEN 0.5 ELSE 0.0 END AS score FROM named),
    scored AS (SELECT a_id, b_id, rule, CAST(score AS DOUBLE) AS score, CASE WHEN rule IS NOT NULL THEN 0 ELSE 1 END AS tier,
    CASE WHEN rule IS NOT NULL THEN 'different' WHEN score >= 2 THEN 'duplicate' WHEN score <= -2 THEN 'different' ELSE 'uncertain' END AS verdict,
    CASE WHEN rule IS NOT NULL THEN 1.0 ELSE least(1.0, abs(score) / 6.0) END AS confidence FROM ruled)"""
)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return S.rule_scores(ruled(spark, sf), SCALED)


@query(f"WITH {RULED_SQL} SELECT a_id, b_id, rule FROM scored WHERE rule IS NOT NULL")
def tier0_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return blocked(spark, sf).select("a_id", "b_id", S.hard_rules(SCALED, once=True).alias("rule")).where("rule IS NOT NULL")


@query(f"WITH {RULED_SQL} SELECT a_id, b_id, tier, verdict, score, round(confidence, 6)::DOUBLE AS confidence FROM scored")
def tier1_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("a_id", "b_id", "tier", "verdict", "score", M.rounded(F.col("confidence"), 6).alias("confidence"))


@query(f"WITH {RULED_SQL} SELECT CASE WHEN verdict = 'uncertain' THEN 3 ELSE tier END AS tier, verdict, count(*) AS n_pairs FROM scored GROUP BY 1, 2")
def cascade_summary(spark: SparkSession, sf: str) -> DataFrame:
    return S.dedup_report(S.cascade(ruled(spark, sf), config=SCALED))


@query(
    """WITH s AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
    SELECT a_id, b_id, round(c, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY c DESC, b_id) <= 5"""
)
def topk_similar(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    found = V.best(rows, 5, lambda a, b: a["label"] == b["label"], ("label",), above=-1.0)
    return found.select("a_id", "b_id", F.round("similarity", 6).alias("similarity"))


@query()
def index_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 nearest vectors of each one, from as many cells of an index as a sample of queries needs."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    cells = V.fit(rows)
    return V.best(rows, 10, lambda a, b: a["rank"] != b["rank"], probes=V.probes_needed(rows, cells, 10), cells=cells)


EDGES_SQL = (
    SQL
    + """, edges AS (SELECT a.id AS a_id, b.id AS b_id, list_cosine_similarity(a.embedding, b.embedding) AS similarity FROM listings a JOIN listings b
    ON a.source_domain <> b.source_domain AND a.id < b.id AND (NOT coalesce(a.price > 0 AND b.price > 0, false) OR abs(a.price - b.price) / greatest(a.price, b.price)::DOUBLE < 0.3)
    AND (NOT coalesce(a.size_sqm > 0 AND b.size_sqm > 0, false) OR abs(a.size_sqm - b.size_sqm) / greatest(a.size_sqm, b.size_sqm) < 0.15)
    WHERE list_cosine_similarity(a.embedding, b.embedding) > 0.1 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY similarity DESC, b.id) <= 50)"""
)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    e = P.similar_pairs(listings(spark, sf), DEFAULT, reject=0.10)
    return e.withColumn("verdict", S.similarity_verdict(F.col("similarity"), F.lit(0), merge=0.15)).withColumn("photo_matches", F.lit(0))


@query(f"WITH {EDGES_SQL} SELECT a_id, b_id, round(similarity, 6) AS similarity, CASE WHEN similarity > 0.15 THEN 'approved' ELSE 'pending' END AS verdict FROM edges")
def v1_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).select("a_id", "b_id", F.round("similarity", 6).alias("similarity"), "verdict")


NODES_SQL = (
    EDGES_SQL
    + """, arcs AS (SELECT a_id AS x, b_id AS y FROM edges WHERE similarity > 0.15 UNION ALL SELECT b_id, a_id FROM edges WHERE similarity > 0.15),
    walk AS (SELECT DISTINCT x AS node, x AS reach FROM arcs UNION SELECT w.node, b.y FROM walk w JOIN arcs b ON w.reach = b.x),
    joined AS (SELECT node, min(reach) AS root FROM walk GROUP BY 1),
    nodes AS (SELECT node, root FROM joined UNION ALL SELECT DISTINCT n, n FROM (SELECT unnest([a_id, b_id]) AS n FROM edges WHERE similarity <= 0.15) WHERE n NOT IN (SELECT node FROM joined))"""
)


@query(f"WITH RECURSIVE {NODES_SQL} SELECT node, root FROM nodes")
def approved_components(spark: SparkSession, sf: str) -> DataFrame:
    return K.approved_components(written(edges(spark, sf), "edges"))


@query(
    f"""WITH RECURSIVE {NODES_SQL}, sizes AS (SELECT root, count(*) AS member_count FROM nodes GROUP BY 1 HAVING count(*) > 1)
    SELECT s.root, s.member_count, round(max(similarity), 6) AS max_similarity, 0 AS max_photo_matches, bool_or(similarity <= 0.15) AS any_pending
    FROM edges JOIN nodes na ON na.node = a_id JOIN nodes nb ON nb.node = b_id AND na.root = nb.root JOIN sizes s ON s.root = na.root GROUP BY 1, 2"""
)
def cluster_metrics(spark: SparkSession, sf: str) -> DataFrame:
    from ..storage import written

    e = written(edges(spark, sf), "edges")
    return K.component_metrics(e, K.approved_components(e)).withColumn("max_similarity", F.round("max_similarity", 6))


@query(
    f"""WITH RECURSIVE {NODES_SQL}, held AS (SELECT node, root, CASE WHEN substr(node, 12, 1) = '3' THEN 'L' || substr(node, 10, 1) WHEN substr(node, 12, 1) = '5' THEN 'U' || substr(node, 10, 1) END AS own FROM nodes),
    big AS (SELECT root FROM nodes GROUP BY 1 HAVING count(*) > 1),
    pend AS (SELECT na.root, bool_or(similarity <= 0.15) AS p FROM edges JOIN nodes na ON na.node = a_id JOIN nodes nb ON nb.node = b_id AND na.root = nb.root GROUP BY 1),
    pick AS (SELECT root, min(own) FILTER (own LIKE 'L%') AS lock, min(own) FILTER (own LIKE 'U%') AS again FROM held GROUP BY 1)
    SELECT node AS property_id, coalesce(lock, again, sha256(n.root)) AS cluster_id, CASE WHEN lock IS NOT NULL THEN 'APPROVED' WHEN p THEN 'PENDING' ELSE 'APPROVED' END AS status, lock IS NULL AND again IS NULL AS is_new
    FROM nodes n JOIN big USING (root) JOIN pend USING (root) JOIN pick USING (root)"""
)
def resolved_clusters(spark: SparkSession, sf: str) -> DataFrame:
    from ..storage import written

    e = written(edges(spark, sf), "edges")
    nodes = written(K.approved_components(e), "nodes")
    last, kind = F.substring("id", 12, 1), F.substring("id", 10, 1)
    own = listings(spark, sf).select("id", F.when(last == "3", F.concat(F.lit("L"), kind)).when(last == "5", F.concat(F.lit("U"), kind)).alias("cluster_id"))
    known = own.where("cluster_id IS NOT NULL").select(F.col("cluster_id").alias("id")).distinct()
    known = known.select("id", F.col("id").startswith("L").alias("verdict_locked"), F.lit("APPROVED").alias("status"))
    return K.resolve(nodes, K.component_metrics(e, nodes), own, known)


LEARNING = ("price_log_ratio", "size_sqm_ratio", "bedrooms_diff", "year_built_diff", "distance_km", "embedding_cosine_sim", "same_calc_area")


def learnable(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, Column]]:
    """Pairs and their features for models; what the tables lack is null."""
    x = measured(spark, sf, ["price", "size_sqm", "bedrooms", "year_built"], ["area", "canonical_category"], "km")
    missing = {"land_size_sqm": "double", "bathrooms": "int", "photos": "array<string>", "municipality": "string"}
    return x, M.learning_features(lambda s, n: F.lit(None).cast(missing[n]) if n in missing else F.col(f"{s}_{n}"), measured=True)


@query(
    f"""WITH {PAIRS_SQL} SELECT a_id, b_id, CASE WHEN a_price > 0 AND b_price > 0 THEN round(ln(greatest(a_price, b_price) / greatest(least(a_price, b_price), 1)::DOUBLE), 5) END AS price_log_ratio,
    CASE WHEN a_size_sqm > 0 AND b_size_sqm > 0 THEN round(greatest(a_size_sqm, b_size_sqm) / least(a_size_sqm, b_size_sqm), 5) END AS size_sqm_ratio,
    abs(a_bedrooms - b_bedrooms)::DOUBLE AS bedrooms_diff, abs(a_year_built - b_year_built)::DOUBLE AS year_built_diff,
    round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b_lat - a_lat) / 2), 2) + cos(radians(a_lat)) * cos(radians(b_lat)) * pow(sin(radians(b_lng - a_lng) / 2), 2)))), 5) AS distance_km,
    round(similarity, 5) AS embedding_cosine_sim, (a_area = b_area)::INTEGER::DOUBLE AS same_calc_area FROM pairs"""
)
def learning_features(spark: SparkSession, sf: str) -> DataFrame:
    x, found = learnable(spark, sf)
    return x.select("a_id", "b_id", *(M.rounded(F.nanvl(found[k], F.lit(None).cast("double")), 5).alias(k) for k in LEARNING))


@query()
def model_tier(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.learning import cross_validated

    x, found = learnable(spark, sf)
    truth = F.when(F.substring("a_id", -1, 1) == F.substring("b_id", -1, 1), "duplicate").otherwise("different")
    rows = lambda: written(x.select("a_id", "b_id", truth.alias("truth"), *(c.alias(k) for k, c in found.items())), "features")
    p = cross_validated(rows, list(found), labelled=bare_pairs(spark, sf).withColumn("truth", truth))
    verdict, confidence = S.model_verdict(F.col("p"))
    return p.select("a_id", "b_id", verdict.alias("verdict"), M.rounded(confidence, 4).alias("confidence"))


@query()
def boosted_tier(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of boosted trees on the pairs that model_tier scores, each pair by what its label tells."""
    from ..operators import boosting

    x, found = learnable(spark, sf)
    same = (F.substring("a_id", -1, 1) == F.substring("b_id", -1, 1)).cast("int")
    rows = bare_pairs(spark, sf).withColumn("same", same)
    model = boosting.of_one_class(rows, list(found), "same")
    if model is None:
        rows = written(x.select("a_id", "b_id", same.alias("same"), *(c.alias(k) for k, c in found.items())), "features")
        model = boosting.fit(rows, list(found), "same", rounds=12)
    verdict, confidence = S.model_verdict(F.col("p"))
    return boosting.probability(model, rows).select("a_id", "b_id", verdict.alias("verdict"), M.rounded(confidence, 4).alias("confidence"))


# --- texts and values ------------------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(M.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


CANONICAL_SQL = (
    SQL
    + """, texts AS (SELECT id, 'category: ' || lower(trim(category)) || ' | prefecture: unknown | municipality: ' || lower(municipality) || ' | area: ' || lower(area) || ' | size_sqm: ' || printf('%.1f', size_sqm)
    || ' | land_size_sqm: ? | bedrooms: ' || bedrooms || ' | bathrooms: ? | year_built: ' || year_built || ' | levels: unknown | features: none | phashes: none' AS canonical_text FROM listings)"""
)


@query(f"WITH {CANONICAL_SQL} SELECT id, canonical_text, sha256(canonical_text) AS content_hash FROM texts")
def canonical_text(spark: SparkSession, sf: str) -> DataFrame:
    x = listings(spark, sf)
    missing = {"prefecture": "string", "land_size_sqm": "double", "bathrooms": "int", "levels": "string", "features": "array<string>", "photos": "array<string>"}
    text = M.canonical_text(lambda n: F.lit(None).cast(missing[n]) if n in missing else F.col(n))
    return x.select("id", text.alias("canonical_text")).withColumn("content_hash", M.content_hash(F.col("canonical_text")))


@query(
    """SELECT o_orderkey, floor(o_totalprice)::BIGINT AS single, CASE WHEN floor(o_totalprice) > 1000 THEN floor(o_totalprice)::BIGINT END AS first_over, (o_orderkey % 900 + 100) * 1000 AS dotted,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 900 + 100) * 1000 END AS cents, (o_orderkey % 90 + 10)::DOUBLE + 0.5 AS decimals FROM orders"""
)
def clean_prices(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "orders")
    whole, k = F.floor("o_totalprice").cast("string"), (F.col("o_orderkey") % 900 + 100).cast("string")
    return x.select(
        "o_orderkey",
        C.first_int(F.concat(F.lit("price "), whole, F.lit(" euro"))).alias("single"),
        C.clean_price(F.concat(F.lit("€"), whole, F.lit(",00 (€12)"))).alias("first_over"),
        C.euro_int(F.concat(k, F.lit(".000€"))).alias("dotted"),
        C.euro_int(F.when(F.col("o_orderkey") % 3 == 0, "POA").otherwise(F.concat(F.lit("Price: "), k, F.lit(".000,00€")))).alias("cents"),
        C.clean_float(F.concat((F.col("o_orderkey") % 90 + 10).cast("string"), F.lit(",5 m2"))).alias("decimals"),
    )


@query(
    """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS h1,
    regexp_replace(regexp_replace(lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS title_slug FROM pages"""
)
def html_title_h1(spark: SparkSession, sf: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf, "pages").select("page_id", title.alias("title"), F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1).alias("h1"), C.slug(title).alias("title_slug"))


@query(
    """SELECT page_id, regexp_replace(regexp_extract(lower(trim(url)), '://([^/?#:]*)', 1), '^www\\.', '') AS host,
    regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1) AS last_part, nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\\d+)\\D*$', 1), '') AS url_id FROM pages"""
)
def url_slug(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", C.bare_host(url).alias("host"), C.last_path_part(url).alias("last_part"), C.url_id(url).alias("url_id"))


DESCRIPTION = ("Villa of ", " sqm with ", " bedrooms and ", " bathrooms, built in ", ", swimming pool, garden and parking. Villa near the hotel.")


@query(
    """SELECT p_partkey, (p_size * 10 + 100)::DOUBLE AS size_sqm, (p_size % 6 + 1)::INTEGER AS bedrooms, (p_size % 3 + 1)::INTEGER AS bathrooms, (1990 + p_size % 30)::INTEGER AS year_built, 'Villa' AS category, 'garden,parking,swimming_pool' AS features FROM part"""
)
def mined_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    values = [s * 10 + 100, s % 6 + 1, s % 3 + 1, 1990 + s % 30]
    text = F.concat(F.lit(DESCRIPTION[0]), *(x for v, t in zip(values, DESCRIPTION[1:], strict=True) for x in (v.cast("string"), F.lit(t))))
    # Few bytes make much work: parts are dealt over all tasks.
    x = table(spark, sf, "part").select("p_partkey", "p_size").repartition(P.tasks(spark)).select("p_partkey", text.alias("text"))
    m = [X.metric(F.col("text"), k).alias(k) for k in ("size_sqm", "bedrooms", "bathrooms", "year_built")]
    return x.select("p_partkey", *m, X.property_type(F.col("text")).alias("category"), F.array_join(F.array_sort(F.map_keys(X.features(F.col("text")))), ",").alias("features"))


@query("SELECT doc_id, length(trim(text, ' ')) >= 50 AS passes, length(text) >= 200 AS long_enough FROM documents")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.passes_quality(F.col("text")).alias("passes"), X.needs_model(F.col("text"), F.lit(0)).alias("long_enough"))


# --- places and photos -----------------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT c_custkey AS id, 39 + (c_custkey % 83) / 41.0::DOUBLE AS lat, 22 + (c_custkey % 71) / 35.0::DOUBLE AS lng FROM customer),
    a AS (SELECT s_suppkey AS area_id, 39 + (s_suppkey % 13) / 6.5::DOUBLE AS lat, 22 + (s_suppkey % 11) / 5.5::DOUBLE AS lng FROM supplier),
    d AS (SELECT id, area_id, sqrt(pow(p.lat - a.lat, 2) + pow(p.lng - a.lng, 2)) AS distance FROM p CROSS JOIN a)
    SELECT id, round(min(distance), 6) AS distance FROM d GROUP BY 1"""
)
def nearest_area(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, sf, "customer").select(k.alias("id"), (39 + (k % 83) / 41.0).alias("lat"), (22 + (k % 71) / 35.0).alias("lng"))
    areas = table(spark, sf, "supplier").select(s.alias("area_id"), (39 + (s % 13) / 6.5).alias("lat"), (22 + (s % 11) / 5.5).alias("lng"))
    return P.nearest_area(points, areas).select("id", F.round("distance", 6).alias("distance"))


@query(
    f"""WITH {PAIRS_SQL} SELECT a_id, b_id, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b_lat - a_lat) / 2), 2) + cos(radians(a_lat)) * cos(radians(b_lat)) * pow(sin(radians(b_lng - a_lng) / 2), 2)))), 4) AS km,
    round(acos(least(1, greatest(-1, sin(radians(a_lat)) * sin(radians(b_lat)) + cos(radians(a_lat)) * cos(radians(b_lat)) * cos(radians(b_lng) - radians(a_lng))))) * 6371000, 0) AS metres FROM pairs"""
)
def haversine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    at = [F.col(c) for c in ("a_lat", "a_lng", "b_lat", "b_lng")]
    return blocked(spark, sf).select("a_id", "b_id", F.round(M.haversine_km(*at), 4).alias("km"), F.round(M.distance_m(*at), 0).alias("metres"))


@query(
    """WITH h AS (SELECT doc_id, substr(sha256(text), 1, 16) AS phash FROM documents)
    SELECT a.doc_id AS a_id, b.doc_id AS b_id, (bit_count(xor(('0x' || substr(a.phash, 1, 8))::BIGINT, ('0x' || substr(b.phash, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(a.phash, 9, 8))::BIGINT, ('0x' || substr(b.phash, 9, 8))::BIGINT)))::INTEGER AS bits
    FROM h a JOIN h b ON b.doc_id = a.doc_id + 1"""
)
def hamming_pairs(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("phash"))
    b = h.select(F.col("doc_id").alias("b_id"), (F.col("doc_id") - 1).alias("a_id"), F.col("phash").alias("b_phash"))
    return h.select(F.col("doc_id").alias("a_id"), "phash").join(b, "a_id").select("a_id", "b_id", M.hamming(F.col("phash"), F.col("b_phash"), 64).cast("int").alias("bits"))


@query("SELECT substr(sha256(text), 1, 2) AS phash, count(DISTINCT doc_id) AS n_listings FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 5")
def stock_photos(spark: SparkSession, sf: str) -> DataFrame:
    return R.stock_photos(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array(F.substring(F.sha2("text", 256), 1, 2)).alias("image_phashes")))


def photos(spark: SparkSession, sf: str, k: int = 4) -> DataFrame:
    """k perceptual hashes for each document, some of them shared by neighbours."""
    h = F.sha2((F.col("doc_id") / 2).cast("long").cast("string"), 256)
    return table(spark, sf, "documents").select("doc_id", F.array(*(F.substring(h, 1 + 16 * i, 16) for i in range(k - 1)), F.substring(F.sha2("text", 256), 1, 16)).alias("photos"))


@query("SELECT a.doc_id AS a_id, b.doc_id AS b_id, CASE WHEN a.doc_id % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN a.text = b.text THEN 1 ELSE 0 END AS matches FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def greedy_photo_matches(spark: SparkSession, sf: str) -> DataFrame:
    p = photos(spark, sf)
    b = p.select((F.col("doc_id") - 1).alias("a_id"), F.col("doc_id").alias("b_id"), F.col("photos").alias("b_photos"))
    return p.select(F.col("doc_id").alias("a_id"), "photos").join(b, "a_id").select("a_id", "b_id", M.greedy_photo_matches(F.col("photos"), F.col("b_photos")).alias("matches"))


@query("SELECT doc_id // 2 AS cluster_id, 3 + count(DISTINCT text) AS n_photos FROM documents GROUP BY 1")
def gallery_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    each = photos(spark, sf).select((F.col("doc_id") / 2).cast("long").alias("cluster_id"), "doc_id", "photos").groupBy("cluster_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "photos"))), lambda x: x["photos"])).alias("p"))
    kept = G.distinct_photos(F.transform("p", lambda h: F.struct(h.alias("phash"), h.alias("url"))))
    return each.select("cluster_id", F.size(kept).cast("long").alias("n_photos"))


# --- lifecycle -------------------------------------------------------------------------------------------------------


@query(
    """WITH known AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 12 = 5 THEN 'DELISTED' WHEN o_orderkey % 12 = 7 THEN 'SOLD' ELSE 'ACTIVE' END AS status, floor(o_totalprice)::BIGINT AS price FROM orders WHERE o_orderkey % 10 <> 0),
    seen AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN floor(o_totalprice)::BIGINT + 1 ELSE floor(o_totalprice)::BIGINT END AS price, o_orderkey % 13 = 0 AS moved FROM orders WHERE o_orderkey % 7 <> 0),
    j AS (SELECT k.id AS kid, s.id AS sid, k.status, k.price AS old_price, s.price AS new_price, coalesce(s.moved, false) AND k.id IS NOT NULL AS renamed FROM known k FULL JOIN seen s ON k.id = s.id)
    SELECT change, count(*) AS n FROM (SELECT CASE WHEN sid IS NOT NULL AND kid IS NULL THEN 'new' WHEN sid IS NOT NULL AND status IN ('DELISTED', 'SOLD') THEN 'revived' WHEN sid IS NOT NULL AND old_price <> new_price THEN 'price_changed'
    WHEN sid IS NOT NULL AND renamed THEN 'renamed' WHEN sid IS NOT NULL THEN 'unchanged' WHEN status IN ('DELISTED', 'SOLD') THEN 'gone' ELSE 'delisted' END AS change FROM j) GROUP BY 1"""
)
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    known = o.where("o_orderkey % 10 <> 0").select(k.alias("id"), k.cast("string").alias("site_property_id"), F.concat(F.lit("/p/"), k.cast("string")).alias("url"), price.alias("price"), F.when(k % 12 == 5, "DELISTED").when(k % 12 == 7, "SOLD").otherwise("ACTIVE").alias("status"))
    sid = F.when(k % 13 == 0, F.concat(F.lit("n"), k.cast("string"))).otherwise(k.cast("string"))
    seen = o.where("o_orderkey % 7 <> 0").select(sid.alias("site_property_id"), F.concat(F.lit("/p/"), k.cast("string")).alias("url"), F.when(k % 11 == 0, price + 1).otherwise(price).alias("price"))
    return L.sync_counts(L.snapshot_diff(known, seen))


OBSERVED_SQL = """observed AS (SELECT l_partkey AS id, floor(l_extendedprice / l_quantity)::DOUBLE AS price, l_shipdate AS seen_at FROM lineitem)"""


def observed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"), F.col("l_shipdate").alias("seen_at"))


@query(f"WITH {OBSERVED_SQL} SELECT id, old_price, price AS new_price, seen_at AS changed_at FROM (SELECT *, lag(price) OVER (PARTITION BY id ORDER BY seen_at, price) AS old_price FROM observed) WHERE old_price IS NOT NULL AND price <> old_price")
def price_changes(spark: SparkSession, sf: str) -> DataFrame:
    return L.price_changes(observed(spark, sf))


@query(
    """SELECT coalesce(o.o_orderkey, n.o_orderkey) AS id, coalesce(n.o_totalprice, o.o_totalprice) AS price, CASE WHEN o.o_orderkey IS NULL THEN n.o_orderstatus ELSE o.o_orderstatus END AS status
    FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) o FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice + 1 END AS o_totalprice, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 3 <> 1) n ON o.o_orderkey = n.o_orderkey"""
)
def upsert_listings(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    new = o.where("id % 3 <> 1").withColumns({"price": F.when(F.col("id") % 4 != 0, F.col("price") + 1), "status": F.lit("X")})
    return upsert(o.where("id % 3 <> 0"), new, ["id"], protected=("status",))


def new_prices(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    old = table(spark, sf, "orders").select(k.alias("id"), F.when(k % 5 != 0, F.floor("o_totalprice").cast("long")).alias("price"), F.lit(None).cast("long").alias("previous_price"), F.lit("ACTIVE").alias("status"))
    new = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(k.alias("id"), F.floor(F.col("o_totalprice") + k % 3).cast("long").alias("price"), F.col("o_orderdate").alias("seen_at"))
    return L.with_price(old, new)


@query(
    """SELECT o_orderkey AS id, CASE WHEN n IS NOT NULL THEN n ELSE p END AS price, CASE WHEN n IS NOT NULL AND p IS NULL THEN n WHEN n <> p THEN p END AS previous_price, CASE WHEN n <> p THEN 'PRICE_CHANGED' ELSE 'ACTIVE' END AS status
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN floor(o_totalprice)::BIGINT END AS p, CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice + o_orderkey % 3)::BIGINT END AS n FROM orders)"""
)
def price_recorder(spark: SparkSession, sf: str) -> DataFrame:
    return new_prices(spark, sf)[0]


@query(
    """SELECT doc_id FROM documents WHERE (doc_id % 4 = 0 OR length(text) < 50 OR doc_id % 7 = 0) AND doc_id % 8 < 5 AND (doc_id % 3 = 0 OR TIMESTAMP '2024-01-01' + INTERVAL (doc_id % 20) DAY <= TIMESTAMP '2024-01-15' - INTERVAL 7 DAY)"""
)
def redeep_candidates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    x = table(spark, sf, "documents").select(
        "doc_id", F.when(k % 4 != 0, 50.0).alias("size_sqm"), F.lit("villa").alias("category"), F.col("text").alias("description"), F.when(k % 7 == 0, 0).otherwise(3).alias("n_features"), F.lit(1).alias("price"),
        (k % 8).alias("details_fetch_attempts"), F.when(k % 3 != 0, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((k % 20).cast("int"))).alias("last_details_fetch_at"),
    )
    return x.where(L.needs_refetch(F.lit("2024-01-15").cast("timestamp"))).select("doc_id")


@query(
    """SELECT vec_id, CASE WHEN p_name LIKE '%a%' THEN 'data/media/site/' || vec_id || '/' || lpad((vec_id % 30)::VARCHAR, 2, '0') || '_' || substr(md5('http://x/' || vec_id || '.png?w=1'), 1, 6) || '.png'
    ELSE 'data/media/site/' || vec_id || '/' || lpad((vec_id % 30)::VARCHAR, 2, '0') || '_' || substr(md5('http://x/' || vec_id), 1, 6) || '.jpg' END AS path FROM embeddings JOIN part ON p_partkey = vec_id"""
)
def media_paths(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "embeddings").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("vec_id"))
    url = F.concat(F.lit("http://x/"), F.col("vec_id").cast("string"), F.when(F.col("p_name").contains("a"), ".png?w=1").otherwise(""))
    return x.select("vec_id", L.media_path(F.lit("site"), F.col("vec_id"), F.col("vec_id") % 30, url).alias("path"))


# --- judgements ------------------------------------------------------------------------------------------------------


def judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    base = table(spark, sf, "orders").select(k.cast("string").alias("prop_a_id"), (k + 1).cast("string").alias("prop_b_id"), F.lit("h1").alias("hash_a"), F.lit("h2").alias("hash_b"), F.array(F.lit("price"), F.lit("bad"), F.lit("price"), F.lit("location")).alias("reason_attributes"), F.concat(F.lit("  "), F.col("o_orderpriority")).alias("reason_text"), k.alias("k"), F.col("o_orderdate").alias("created_at"))
    old = base.where("k % 3 <> 0").withColumn("feedback_source", F.when(F.col("k") % 2 == 0, "admin_reject").otherwise("cluster_dissolve")).drop("k")
    new = base.where("k % 3 <> 1").withColumns({"feedback_source": F.when(F.col("k") % 5 == 0, "manual_split").otherwise("cluster_dissolve"), "reason_text": F.lit(" new ")}).drop("k")
    return B.validated(old), B.validated(new)


@query(
    """SELECT least(k::VARCHAR, (k + 1)::VARCHAR) AS prop_a_id, greatest(k::VARCHAR, (k + 1)::VARCHAR) AS prop_b_id, 'location,price' AS reasons, CASE WHEN k % 3 = 0 OR (k % 3 <> 1 AND (k % 2 <> 0 OR k % 5 = 0)) THEN 'new' ELSE trim(o_orderpriority) END AS reason_text,
    CASE WHEN k % 3 = 0 OR (k % 3 <> 1 AND (k % 2 <> 0 OR k % 5 = 0)) THEN CASE WHEN k % 5 = 0 THEN 'manual_split' ELSE 'cluster_dissolve' END ELSE CASE WHEN k % 2 = 0 THEN 'admin_reject' ELSE 'cluster_dissolve' END END AS feedback_source
    FROM (SELECT o_orderkey AS k, o_orderpriority FROM orders)"""
)
def feedback_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return B.upsert_feedback(*judged(spark, sf)).select("prop_a_id", "prop_b_id", F.array_join("reason_attributes", ",").alias("reasons"), "reason_text", "feedback_source")


MEMBERS_SQL = "members AS (SELECT c_custkey // 8 AS cluster_id, lpad(c_custkey::VARCHAR, 9, '0') AS property_id FROM customer)"
JUDGED_SQL = "judged AS (SELECT lpad(c_custkey::VARCHAR, 9, '0') AS a, lpad((c_custkey + 1)::VARCHAR, 9, '0') AS b FROM customer WHERE c_custkey % 3 = 0)"


def members(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(F.expr("c_custkey div 8").alias("cluster_id"), F.lpad(k.cast("string"), 9, "0").alias("property_id"))


def pairs_judged(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.lpad(k.cast("string"), 9, "0").alias("prop_a_id"), F.lpad((k + 1).cast("string"), 9, "0").alias("prop_b_id"))


@query(f"WITH {MEMBERS_SQL}, {JUDGED_SQL} SELECT x.cluster_id, count(*) AS n_pairs, count(j.a) AS n_rejected FROM members x JOIN members y ON x.cluster_id = y.cluster_id AND x.property_id < y.property_id LEFT JOIN judged j ON j.a = x.property_id AND j.b = y.property_id GROUP BY 1")
def rejected_pairs_per_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return K.rejected_per_cluster(members(spark, sf), pairs_judged(spark, sf))


@query(f"WITH {MEMBERS_SQL}, {JUDGED_SQL} SELECT x.property_id AS prop_a_id, y.property_id AS prop_b_id FROM members x JOIN members y ON x.cluster_id = y.cluster_id AND x.property_id < y.property_id LEFT JOIN judged j ON j.a = x.property_id AND j.b = y.property_id WHERE j.a IS NULL")
def dissolve_feedback(spark: SparkSession, sf: str) -> DataFrame:
    m = members(spark, sf)
    hashes = m.select(F.col("property_id").alias("id"), F.lit("h").alias("content_hash"))
    return B.of_dissolved_clusters(m, hashes, pairs_judged(spark, sf)).select("prop_a_id", "prop_b_id")


@query(f"WITH {MEMBERS_SQL}, {JUDGED_SQL} SELECT j.a AS prop_a_id, j.b AS prop_b_id, x.cluster_id FROM judged j JOIN members x ON x.property_id = j.a JOIN members y ON y.property_id = j.b WHERE x.cluster_id = y.cluster_id")
def contradictions(spark: SparkSession, sf: str) -> DataFrame:
    return B.contradictions(pairs_judged(spark, sf), members(spark, sf)).select("prop_a_id", "prop_b_id", "cluster_id")


@query(f"WITH {JUDGED_SQL} SELECT a AS prop_a_id, b AS prop_b_id FROM judged WHERE NOT (a::BIGINT % 2 = 0 AND a::BIGINT % 9 < 5 AND b::BIGINT % 9 < 5)")
def feedback_deleted(spark: SparkSession, sf: str) -> DataFrame:
    # The pairs to forget: both ends in the set, which holds even first ends and all second ends of certain remainders.
    k = F.col("c_custkey")
    inside = table(spark, sf, "customer").select(k).union(table(spark, sf, "customer").select((k + 1).alias("c_custkey"))).distinct().where("c_custkey % 9 < 5")
    judged_pairs = pairs_judged(spark, sf)
    even = judged_pairs.where("cast(prop_a_id as bigint) % 2 = 0")
    ids = inside.select(F.lpad(k.cast("string"), 9, "0").alias("id"))
    return B.deleted_among(even, ids).unionByName(judged_pairs.where("cast(prop_a_id as bigint) % 2 <> 0"))


@query(
    """SELECT a_id, b_id, hit FROM (SELECT lpad(o_orderkey::VARCHAR, 9, '0') AS a_id, lpad((o_orderkey + 5)::VARCHAR, 9, '0') AS b_id, o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS hit FROM orders)"""
)
def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    a, b = F.lpad(k.cast("string"), 9, "0"), F.lpad((k + 5).cast("string"), 9, "0")
    o = table(spark, sf, "orders")
    pairs = o.select(a.alias("a_id"), b.alias("b_id"), F.concat(F.lit("h"), a).alias("a_content_hash"), F.concat(F.lit("h"), b).alias("b_content_hash"))
    cache = o.where(k % 2 != 0).select(
        M.pair_key(a, b).alias("pair_key"), F.when(k % 3 == 0, "old").otherwise("v").alias("engine_version"), F.when(k % 5 == 0, "x").otherwise(F.concat(F.lit("h"), a)).alias("a_content_hash"), F.concat(F.lit("h"), b).alias("b_content_hash"),
        F.lit("different").alias("verdict"), F.lit(None).cast("double").alias("confidence"), F.lit("").alias("reasoning"), F.lit(1).alias("tier_emitted"), F.when(k % 7 == 0, F.lit("2020-01-01").cast("timestamp")).alias("expires_at"),
    )
    hits, misses = S.cached(pairs, cache, "v", F.lit("2024-01-01").cast("timestamp"))
    return hits.select("a_id", "b_id", F.lit(True).alias("hit")).union(misses.select("a_id", "b_id", F.lit(False).alias("hit")))


@query(
    """WITH e AS (SELECT o_orderkey AS p, o_custkey % 40 AS c, (o_orderkey % 3) / 4.0::DOUBLE + 0.25 AS v FROM orders UNION ALL SELECT o_orderkey, (o_custkey + 7) % 40, 0.5 FROM orders WHERE o_orderkey % 2 = 0),
    m AS (SELECT p, c, avg(v) AS mean FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY (mean >= best - 1e-9) DESC, CASE WHEN mean >= best - 1e-9 THEN 100 - c END NULLS LAST, mean DESC, c) AS k FROM (SELECT *, max(mean) OVER (PARTITION BY p) AS best FROM m))
    SELECT 'p' || p AS property_id, max(CASE WHEN k = 1 THEN 'c' || lpad(c::VARCHAR, 3, '0') END) AS winner, coalesce(string_agg('c' || lpad(c::VARCHAR, 3, '0'), ',' ORDER BY c) FILTER (k > 1), '') AS losers FROM r GROUP BY 1"""
)
def bridge_resolution(spark: SparkSession, sf: str) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    name = lambda c: F.concat(F.lit("c"), F.lpad((c % 40).cast("string"), 3, "0"))
    one = o.select(F.concat(F.lit("p"), k.cast("string")).alias("a_id"), name(F.col("o_custkey")).alias("c"), (k % 3 / 4.0 + 0.25).alias("confidence"))
    two = o.where(k % 2 == 0).select(F.concat(F.lit("p"), k.cast("string")).alias("a_id"), name(F.col("o_custkey") + 7).alias("c"), F.lit(0.5).alias("confidence"))
    cases = one.union(two).select("a_id", F.concat(F.lit("z"), F.col("c")).alias("b_id"), "confidence", F.lit(None).cast("string").alias("a_cluster"), F.col("c").alias("b_cluster"), F.lit("attach").alias("kind"))
    known = spark.range(40).select(name(F.col("id")).alias("id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((100 - F.col("id")).cast("int"))).alias("created_at"))
    return K.bridges(cases, known).select("property_id", "winner", F.array_join("losers", ",").alias("losers"))


@query(
    """WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 6 NOT IN (0, 5)), s AS (SELECT c_custkey AS p, 'C' || (c_custkey // 6) AS c FROM customer WHERE c_custkey % 6 = 1 AND c_custkey % 12 < 6),
    w AS (SELECT a AS n, a AS r FROM e UNION SELECT b, b FROM e UNION SELECT w.n, x.y FROM w JOIN (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e) x ON w.r = x.x)
    SELECT n // 6 AS grp, count(DISTINCT n) - (CASE WHEN n // 6 % 2 = 0 THEN 1 ELSE 0 END) AS member_count, CASE WHEN n // 6 % 2 = 0 THEN 'C' || (n // 6) END AS cluster_id FROM w GROUP BY 1, 3"""
)
def seeded_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of five listings; the first of every other chain is in an approved cluster already."""
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    name = lambda x: F.lpad(x.cast("string"), 9, "0")
    duplicates = c.where(~(k % 6).isin(0, 5)).select(name(k).alias("a_id"), name(k + 1).alias("b_id"), F.lit(0.9).alias("confidence"))
    seeds = c.where((k % 6 == 1) & (k % 12 < 6)).select(name(k).alias("property_id"), F.concat(F.lit("C"), F.expr("c_custkey div 6").cast("string")).alias("cluster_id"))
    known = seeds.select(F.col("cluster_id").alias("id"), F.lit("2024-01-01").cast("timestamp").alias("created_at")).distinct()
    found, _, _ = K.seeded_components(duplicates, seeds, known)
    x = found.withColumn("grp", F.expr("cast(property_id as bigint) div 6"))
    return x.groupBy("grp").agg(F.count("*").alias("member_count"), F.max("cluster_id").alias("cluster_id"))


# --- reports ---------------------------------------------------------------------------------------------------------


@query(
    """SELECT source AS source_domain, count(*) AS n, round(avg(length(text)), 4) AS mean_length, round(avg(CASE WHEN doc_id % 9 >= 5 THEN 1.0 ELSE 0.0 END) * 100)::INTEGER AS features_pct, round(avg(CASE WHEN doc_id % 7 > 0 THEN 1.0 ELSE 0.0 END) * 100)::INTEGER AS price_pct FROM documents GROUP BY 1"""
)
def quality_metrics(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    return R.quality_metrics(table(spark, sf, "documents").select(F.col("source").alias("source_domain"), F.col("text").alias("description"), (k % 9).alias("n_features"), (k % 7).alias("price")))


@query(
    """SELECT user_id, CASE WHEN user_id % 5 = 0 AND user_id % 2 = 0 THEN 'CLOUDFLARE' WHEN user_id % 2 = 0 THEN 'CRITICAL' WHEN n = 0 OR user_id < 50 OR user_id % 100 < 30 THEN 'WARNING' ELSE 'OK' END AS status FROM (SELECT user_id, count(*) FILTER (event_type = 'view') AS n FROM events GROUP BY 1)"""
)
def domain_status(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    x = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("n"))
    return x.select("user_id", R.domain_status(F.col("n"), u, F.when(u % 100 < 30, 0).otherwise(100), u % 5 == 0, u % 2 == 0).alias("status"))


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("domain"), (F.col("user_id") % 3).cast("int").alias("stage"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("duration_ms"), F.col("ts").cast("timestamp").alias("created_at"))


@query("SELECT (user_id % 3)::INTEGER AS stage, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed, round(avg(value) FILTER (event_type <> 'error'), 4) AS mean_ms FROM events GROUP BY 1")
def stage_stats(spark: SparkSession, sf: str) -> DataFrame:
    return R.stage_stats(attempts(spark, sf))


@query(
    """SELECT kind, count(*) AS calls, count(*) FILTER (NOT ok) AS failed, sum(ti)::BIGINT AS tokens_in, sum(tout)::BIGINT AS tokens_out, round(sum(CASE WHEN NOT ok THEN 0.0 WHEN kind = 'vision' THEN 0.011 WHEN kind = 'llm' THEN ti * 0.15 / 1e6 + tout * 0.6 / 1e6 ELSE ti * 0.02 / 1e6 END)::DOUBLE, 6) AS cost_usd
    FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'llm' WHEN 1 THEN 'vision' ELSE 'embedding' END AS kind, event_type <> 'error' AS ok, event_id % 1000 AS ti, event_id % 100 AS tout FROM events) GROUP BY 1"""
)
def cost_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    kind = F.when(k % 3 == 0, "llm").when(k % 3 == 1, "vision").otherwise("embedding")
    return R.cost_snapshot(table(spark, sf, "events").select(kind.alias("kind"), F.when(kind == "llm", "gpt-4o-mini").when(kind == "embedding", "text-embedding-3-small").alias("model"), (F.col("event_type") != "error").alias("success"), (k % 1000).alias("tokens_in"), (k % 100).alias("tokens_out")))


@query(
    f"""WITH {OBSERVED_SQL}, h AS (SELECT id, strftime(seen_at, '%Y-%m-%d') || ': ' || old_price || ' -> ' || price AS line FROM (SELECT *, lag(price) OVER (PARTITION BY id ORDER BY seen_at, price) AS old_price FROM observed) WHERE old_price IS NOT NULL AND price <> old_price)
    SELECT p_partkey AS id, n_photos, n_changes, history FROM part JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n_photos FROM lineitem GROUP BY 1) ON l_partkey = p_partkey JOIN (SELECT id, count(DISTINCT line) AS n_changes, string_agg(DISTINCT line, ' | ' ORDER BY line) AS history FROM h GROUP BY 1) x ON x.id = p_partkey"""
)
def price_history_report(spark: SparkSession, sf: str) -> DataFrame:
    history = L.price_changes(observed(spark, sf)).withColumnRenamed("id", "property_id")
    media = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("property_id"), F.col("l_suppkey").alias("image_url"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    return R.price_report(p, media, history).where("history IS NOT NULL AND n_photos > 0").select("id", "n_photos", F.size(F.split("history", r" \| ")).cast("long").alias("n_changes"), "history")


GOLD_SQL = "m AS (SELECT c_custkey // 4 AS cluster_id, c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey * 37 % 900)::INTEGER END AS price, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 3 * 10)::DOUBLE END AS size_sqm, CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey * 7 % 3)::INTEGER END AS bedrooms, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS category, 'site' || c_nationkey AS source_domain FROM customer)"


def gold_members(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.expr("c_custkey div 4").alias("cluster_id"), k.alias("id"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.when(k % 7 != 0, (k * 37 % 900).cast("int")).alias("price"), F.when(k % 5 != 0, (k % 3 * 10).cast("double")).alias("size_sqm"),
        F.when(k % 6 != 0, (k * 7 % 3).cast("int")).alias("bedrooms"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("category"), F.concat(F.lit("site"), F.col("c_nationkey").cast("string")).alias("source_domain"),
    )


@query(
    f"""WITH {GOLD_SQL}, s AS (SELECT cluster_id, count(size_sqm) AS n, count(DISTINCT size_sqm) AS d, avg(size_sqm) AS mean FROM m GROUP BY 1),
    sc AS (SELECT cluster_id, size_sqm, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(id)) AS k FROM m WHERE size_sqm IS NOT NULL GROUP BY 1, 2),
    bc AS (SELECT cluster_id, bedrooms, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(id)) AS k FROM m WHERE bedrooms IS NOT NULL GROUP BY 1, 2)
    SELECT cluster_id, count(*)::INTEGER AS member_count, min(price) AS price, any_value(round(CASE WHEN d < n THEN sc.size_sqm WHEN n > 0 THEN mean END, 6)) AS size_sqm, any_value(bc.bedrooms) AS bedrooms, arg_min(category, id) FILTER (category IS NOT NULL) AS category,
    string_agg(DISTINCT source_domain, ',' ORDER BY source_domain) AS source_domains FROM m JOIN s USING (cluster_id) LEFT JOIN (SELECT * FROM sc WHERE k = 1) sc USING (cluster_id) LEFT JOIN (SELECT * FROM bc WHERE k = 1) bc USING (cluster_id) GROUP BY 1"""
)
def golden_record(spark: SparkSession, sf: str) -> DataFrame:
    g = G.golden_records(gold_members(spark, sf))
    return g.select("cluster_id", "member_count", "price", F.round("size_sqm", 6).alias("size_sqm"), "bedrooms", "category", F.array_join("source_domains", ",").alias("source_domains"))


@query(f"WITH {GOLD_SQL}, f AS (SELECT cluster_id, id, (price IS NOT NULL)::INTEGER + (size_sqm IS NOT NULL)::INTEGER + (bedrooms IS NOT NULL)::INTEGER AS filled FROM m) SELECT cluster_id, id, filled FROM f QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY filled DESC, id) = 1")
def representative(spark: SparkSession, sf: str) -> DataFrame:
    return G.representatives(gold_members(spark, sf))


@query(
    """WITH s AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'uncertain' WHEN quality = 1 OR doc_id % 11 = 0 THEN 'duplicate' ELSE 'different' END AS verdict, CASE WHEN quality = 1 THEN 'duplicate' ELSE 'different' END AS truth, toxic AS category FROM labels),
    c AS (SELECT category, count(*) AS n, count(*) FILTER (verdict = 'duplicate' AND truth = 'duplicate') AS tp, count(*) FILTER (verdict = 'duplicate' AND truth <> 'duplicate') AS fp, count(*) FILTER (verdict = 'different' AND truth = 'different') AS tn,
    count(*) FILTER (verdict = 'different' AND truth = 'duplicate') AS fn, count(*) FILTER (verdict = 'uncertain') AS uncertain, count(*) FILTER (truth = 'duplicate') AS positives FROM s GROUP BY 1),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN positives > 0 THEN tp / positives::DOUBLE ELSE 0 END AS q FROM c)
    SELECT category, n, tp, fp, tn, fn, uncertain, positives, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1, round((n - uncertain) / n::DOUBLE, 6) AS coverage FROM r"""
)
def evaluation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    k, good = F.col("doc_id"), F.col("quality") == 1
    verdict = F.when(k % 5 == 0, "uncertain").when(good | (k % 11 == 0), "duplicate").otherwise("different")
    return R.evaluation(table(spark, sf, "labels").select(verdict.alias("verdict"), F.when(good, "duplicate").otherwise("different").alias("truth"), F.col("toxic").alias("category")), "category")


@query(
    """WITH p AS (SELECT floor((doc_id * 37 % 100) / 5.0)::INTEGER AS cell, quality = 1 AND doc_id * 37 % 100 > 20 AS pos FROM labels), c AS (SELECT cell, count(*) AS n, count(*) FILTER (pos) AS pos FROM p GROUP BY 1),
    g AS (SELECT l.low, h.high FROM range(0, 21) l(low), range(10, 21) h(high) WHERE l.low <= h.high),
    x AS (SELECT low, high, sum(CASE WHEN cell >= high THEN pos ELSE 0 END) AS tp, sum(CASE WHEN cell >= high THEN n ELSE 0 END) AS called, sum(CASE WHEN cell >= high OR cell < low THEN n ELSE 0 END) AS decided, sum(n) AS n FROM g, c GROUP BY 1, 2)
    SELECT low * 0.05::DOUBLE AS low, high * 0.05::DOUBLE AS high, round(decided / n::DOUBLE, 6) AS coverage, round(tp / called::DOUBLE, 6) AS precision FROM x WHERE called > 0 AND tp / called::DOUBLE >= 0.8 ORDER BY decided DESC, low, high LIMIT 1"""
)
def calibrated_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") * 37 % 100
    x = table(spark, sf, "labels").select((k / 100.0).alias("p"), F.when((F.col("quality") == 1) & (k > 20), "duplicate").otherwise("different").alias("truth"))
    return R.calibrated_thresholds(x, least_precision=0.8).select("low", "high", F.round("coverage", 6).alias("coverage"), F.round("precision", 6).alias("precision"))


@query(
    """WITH b AS (SELECT user_id, event_type <> 'error' AS ok, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
    r AS (SELECT user_id, g, count(*) AS n FROM b WHERE ok GROUP BY 1, 2) SELECT user_id::VARCHAR AS domain, (user_id % 3)::INTEGER AS stage, max(n) AS longest, max(n) >= 3 AND user_id % 3 > 0 AS promoted FROM r GROUP BY user_id"""
)
def promotion_streak(spark: SparkSession, sf: str) -> DataFrame:
    return R.promotion_streaks(attempts(spark, sf))


@query(
    """SELECT event_id, CASE WHEN s IN (403, 429, 503) THEN 'blocked' WHEN s = 200 AND event_id % 9 = 0 THEN 'blocked' WHEN s NOT IN (200, 201) THEN 'http_error' WHEN event_id % 9 = 1 THEN 'empty' END AS error_code
    FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 403 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN 201 ELSE 200 END AS s FROM events)"""
)
def fetch_errors(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    status = F.when(k % 7 == 0, 403).when(k % 7 == 1, 503).when(k % 7 == 2, 404).when(k % 7 == 3, 201).otherwise(200)
    body = F.when(k % 9 == 0, F.rpad(F.lit("Just a moment..."), 300, ".")).when(k % 9 == 1, "short").when(k % 9 == 2, '{"a": 1}').otherwise(F.rpad(F.lit("page "), 300, "x"))
    return table(spark, sf, "events").select("event_id", readers.fetch_error(status, body).alias("error_code"))


@query(
    """SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS took, CASE WHEN u = 0 THEN '$0' WHEN u < 0.01 THEN printf('$%.4f', u) WHEN u < 1 THEN printf('$%.3f', u) ELSE printf('$%.2f', u) END AS cost
    FROM (SELECT event_id, event_id * 7 % 9000 AS s, (event_id % 5) / 4.0::DOUBLE AS u FROM events)"""
)
def report_texts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf, "events").select("event_id", R.duration_text(k * 7 % 9000).alias("took"), R.money_text(k % 5 / 4.0).alias("cost"))


# --- streams ---------------------------------------------------------------------------------------------------------


def streamed(spark: SparkSession, rows: DataFrame, job: Callable[[DataFrame], DataFrame], mode: str, batches: int = 1, split: Column | None = None, closing: DataFrame | None = None, files: int = 1) -> DataFrame:
    """Write rows to the shared folder, stream them through a job until all are read, and return what it gave.

    With several batches a row goes into the one that split says, in so many files; closing rows come last, alone.
    """
    from ..storage import fresh_path

    path, out, log = (fresh_path(spark, k) for k in ("stream-in", "stream-out", "stream-log"))
    parts = [rows] if batches == 1 else [rows.where(split == k) for k in range(batches)]
    for part in parts:
        (part if batches == 1 else part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(path)
    if closing is not None:
        closing.coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(rows.schema)
    result = job((source.option("maxFilesPerTrigger", files) if batches > 1 else source).parquet(path))
    last = lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    result.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(last).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


def disordered(rows: DataFrame, at: str, by: str, batches: int = 4) -> dict:
    """Settings of streamed(): rows by time, but every other one a batch late, and a closing row long after the last.

    A batch has a file for every quarter of a million of rows, so that several tasks write and read it.
    """
    seconds = F.col(at).cast("timestamp").cast("long")
    first, last, n = rows.agg(F.min(seconds), F.max(seconds), F.count("*")).first()
    width = max(((last or 0) - (first or 0)) // (batches - 1) + 1, 1)
    split = F.floor((seconds - F.lit(first or 0)) / width) + F.pmod(F.xxhash64(by, at), F.lit(2))
    closing = rows.limit(1).withColumns({at: F.timestamp_seconds(F.lit((last or 0) + 4 * width)), by: F.lit(-1).cast(rows.schema[by].dataType)})
    return {"batches": batches, "split": split, "closing": closing, "late": f"{2 * width} seconds", "files": max(-(-n // (batches * 250_000)), 1)}


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, (user_id % 3)::INTEGER AS stage, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed, round(avg(value) FILTER (event_type <> 'error'), 4) AS mean_ms FROM events GROUP BY 1, 2")
def stream_stage_stats(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming import jobs

    return streamed(spark, attempts(spark, sf), jobs.daily_stage_stats, "complete")


@query(f"WITH {OBSERVED_SQL} SELECT id, old_price, price AS new_price, seen_at AS changed_at FROM (SELECT *, lag(price) OVER (PARTITION BY id ORDER BY seen_at, price) AS old_price FROM observed) WHERE old_price IS NOT NULL AND price <> old_price")
def stream_price_history(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming import jobs

    rows = observed(spark, sf).withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    plan = disordered(rows, "seen_at", "id")
    late = plan.pop("late")
    return streamed(spark, rows, lambda x: jobs.price_history(x, late), "append", **plan)


@query(
    """WITH b AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS n FROM b WHERE event_type <> 'error') SELECT user_id::VARCHAR AS domain, (user_id % 3)::INTEGER AS stage, ts AS created_at FROM r WHERE n = 3 AND user_id % 3 > 0"""
)
def stream_promotions(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming import jobs

    rows = attempts(spark, sf)
    plan = disordered(rows, "created_at", "domain")
    late = plan.pop("late")
    return streamed(spark, rows, lambda x: jobs.promotions(x, late), "append", **plan)


from . import deeper, further, more  # noqa: E402, F401 - register further queries
