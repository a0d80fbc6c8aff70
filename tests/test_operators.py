"""Scoring, clusters, lifecycle, judgements and sources on small hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from parcelyn.operators import clusters as K
from parcelyn.operators import feedback as B
from parcelyn.operators import lifecycle as L
from parcelyn.operators import pairs as P
from parcelyn.operators import scoring as S
from parcelyn.sources import html, readers
from parcelyn.storage import replace_table

PAIR = "a_id string, b_id string, a_source_domain string, b_source_domain string, a_category string, b_category string, a_price int, b_price int, a_size_sqm double, b_size_sqm double, a_bedrooms int, b_bedrooms int, a_year_built int, b_year_built int, a_area string, b_area string, a_embedding array<double>, b_embedding array<double>, has_feedback boolean"
SAME, NEAR = [1.0, 0.0], [0.8, 0.6]


def scored(spark, **change):
    row = {"a_id": "a", "b_id": "b", "a_source_domain": "s1", "b_source_domain": "s2", "a_category": "Villa", "b_category": "Villa", "a_price": 108, "b_price": 100, "a_size_sqm": 100.0, "b_size_sqm": 100.0, "a_bedrooms": 3, "b_bedrooms": 3, "a_year_built": 2000, "b_year_built": 2000, "a_area": "x", "b_area": "x", "a_embedding": SAME, "b_embedding": SAME, "has_feedback": False} | change
    return S.rule_scores(spark.createDataFrame([tuple(row.values())], PAIR)).first()


def test_rules(spark):
    r = scored(spark)
    assert (r.verdict, r.score, r.confidence, r.tier) == ("duplicate", 4.5, 0.75, 1)
    assert scored(spark, has_feedback=True, b_source_domain="s1").reasoning == "feedback"
    assert scored(spark, b_source_domain="s1").reasoning == "same_source"
    assert scored(spark, b_category="Studio").reasoning == "category_mismatch"
    assert scored(spark, b_year_built=2005).tier == 1 and scored(spark, b_year_built=2006).reasoning == "year_built"
    r = scored(spark, b_embedding=NEAR, a_price=200, b_bedrooms=None, b_year_built=None, b_area=None, b_size_sqm=None)
    assert (r.verdict, r.score) == ("uncertain", 0.0)
    swapped = scored(spark, a_price=100, b_price=108)
    assert swapped.score == 4.5


def test_similarity_verdict(spark):
    f = lambda s, n: spark.range(1).select(S.similarity_verdict(F.lit(s), F.lit(n)).alias("v")).first().v
    assert [f(0.985, 0), f(0.986, 0), f(0.95, 2), f(0.95, 1)] == ["pending", "approved", "approved", "pending"]


def test_cascade_asks_only_about_the_rest(spark):
    class Yes:
        def score_pairs(self, pairs):
            return pairs.withColumns({"verdict": F.lit("duplicate"), "confidence": F.lit(0.99), "reasoning": F.lit("model")})

    rows = [("a", "b", "s1", "s2", "Villa", "Villa", 200, 100, None, None, None, None, None, None, None, None, SAME, NEAR, False), ("c", "d", "s1", "s1", "Villa", "Villa", 1, 1, None, None, None, None, None, None, None, None, SAME, SAME, False)]
    got = {r.a_id: (r.verdict, r.tier) for r in S.cascade(spark.createDataFrame(rows, PAIR), model=Yes()).collect()}
    assert got == {"a": ("duplicate", 2), "c": ("different", 0)}


def test_components_and_pending(spark):
    e = spark.createDataFrame([("a", "b", "approved", 0.99), ("b", "c", "pending", 0.95), ("d", "e", "pending", 0.95)], "a_id string, b_id string, verdict string, similarity double").withColumn("photo_matches", F.lit(0))
    nodes = K.approved_components(e)
    assert {r.node: r.root for r in nodes.collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}
    m = K.component_metrics(e, nodes).collect()
    assert [(r.root, r.member_count, r.any_pending) for r in m] == [("a", 2, False)]
    e = spark.createDataFrame([("a", "b", "approved", 0.99), ("b", "c", "approved", 0.99), ("a", "c", "pending", 0.95)], "a_id string, b_id string, verdict string, similarity double").withColumn("photo_matches", F.lit(0))
    assert K.component_metrics(e, K.approved_components(e)).first().any_pending


CLUSTERS = "id string, created_at timestamp"


def seeded(spark, duplicates, seeds):
    d = spark.createDataFrame(duplicates, "a_id string, b_id string, confidence double")
    s = spark.createDataFrame(seeds, "property_id string, cluster_id string")
    c = spark.createDataFrame([("C1", dt.datetime(2024, 1, 1)), ("C2", dt.datetime(2024, 1, 2))], CLUSTERS)
    members, flags, disagreements = K.seeded_components(d, s, c)
    return {r.property_id: r.cluster_id or r.root for r in members.collect()}, [tuple(r) for r in flags.collect()], [tuple(r) for r in disagreements.collect()]


def test_bridges(spark):
    seeds = [("m1", "C1"), ("m2", "C2")]
    members, flags, _ = seeded(spark, [("p", "m1", 0.95), ("p", "m2", 0.85)], seeds)
    assert members == {"p": "C1"} and flags == [("p", "C1", "C2")]
    members, flags, _ = seeded(spark, [("p", "m1", 0.9), ("p", "m2", 0.9)], seeds)
    assert members == {"p": "C1"}
    _, _, disagreements = seeded(spark, [("m1", "m2", 0.9)], seeds)
    assert disagreements == [("m1", "m2", "C1", "C2")]
    members, _, disagreements = seeded(spark, [("x", "m1", 0.9), ("y", "m2", 0.9), ("x", "y", 0.9), ("v", "w", 0.8)], seeds)
    assert members == {"x": "C1", "y": "C2", "v": "v", "w": "v"}
    assert disagreements == [("x", "y", "C1", "C2")]


def test_delisting_needs_coverage(spark):
    known = spark.createDataFrame([(i, str(i), f"/{i}", 100, "ACTIVE") for i in range(100)], "id int, site_property_id string, url string, price int, status string")
    for n, due in ((49, "missing"), (50, "delisted")):
        seen = spark.createDataFrame([(str(i), f"/{i}", 100) for i in range(n)], "site_property_id string, url string, price int")
        got = {r.change: r.n for r in L.sync_counts(L.snapshot_diff(known, seen)).collect()}
        assert got == {"unchanged": n, due: 100 - n}


def test_prices(spark):
    old = spark.createDataFrame([(1, None, None, "ACTIVE"), (2, 100, None, "ACTIVE"), (3, 100, None, "ACTIVE"), (4, 100, None, "ACTIVE")], "id int, price int, previous_price int, status string")
    new = spark.createDataFrame([(1, 100), (2, 100), (3, 90), (4, None)], "id int, price int").withColumn("seen_at", F.lit("2024-01-01").cast("timestamp"))
    got, history = L.with_price(old, new)
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, 100, 100, "ACTIVE"), (2, 100, None, "ACTIVE"), (3, 90, 100, "PRICE_CHANGED"), (4, 100, None, "ACTIVE")]
    assert [(r.id, r.old_price, r.new_price) for r in history.collect()] == [(3, 100, 90)]


def test_dissolving_fourteen(spark):
    ids = [f"{i:02d}" for i in range(14)]
    m = spark.createDataFrame([("c", i) for i in ids], "cluster_id string, property_id string")
    known = spark.createDataFrame([("00", "01"), ("00", "02"), ("03", "04")], "prop_a_id string, prop_b_id string")
    hashes = spark.createDataFrame([(i, "h") for i in ids], "id string, content_hash string")
    assert B.of_dissolved_clusters(m, hashes, known).count() == 88


def test_feedback_guard(spark):
    schema = "prop_a_id string, prop_b_id string, hash_a string, hash_b string, reason_attributes array<string>, reason_text string, feedback_source string, created_at timestamp"
    at = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", "b", "1", "2", ["price"], "old", "admin_reject", at)], schema)
    for source, text in (("cluster_dissolve", "old"), ("manual_split", "new")):
        new = spark.createDataFrame([("a", "b", "3", "4", [], "new", source, at)], schema)
        r = B.upsert_feedback(old, new).first()
        assert (r.reason_text, r.hash_a) == (text, "1")
        assert B.upsert_feedback(B.upsert_feedback(old, new), new).count() == 1
    bad = spark.createDataFrame([("b", "a", "1", None, ["price", "nonsense", "price"], "  ", "migration", at), ("b", "a", "1", None, ["price", "nonsense", "price"], "  ", "manual_split", at)], schema)
    r = B.validated(bad).collect()
    assert len(r) == 1 and tuple(r[0])[:6] == ("a", "b", "", "1", ["price"], None)


def test_cache(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    pairs = spark.createDataFrame([("a", "b", "h1", "h2")], "a_id string, b_id string, a_content_hash string, b_content_hash string")
    schema = "pair_key string, engine_version string, a_content_hash string, b_content_hash string, verdict string, confidence double, reasoning string, tier_emitted int, expires_at timestamp"
    good = ("a:b", "v", "h1", "h2", "different", None, "", 1, None)
    for change, hit in (({}, 1), ({1: "w"}, 0), ({2: "x"}, 0), ({8: dt.datetime(2024, 1, 1)}, 0), ({8: dt.datetime(2025, 1, 1)}, 1)):
        row = tuple(change.get(i, v) for i, v in enumerate(good))
        hits, misses = S.cached(pairs, spark.createDataFrame([row], schema), "v", now)
        assert (hits.count(), misses.count()) == (hit, 1 - hit)


def test_verdicts(spark):
    c = spark.createDataFrame([("1", "PENDING", False, None, None), ("2", "APPROVED", True, None, "x")], "id string, status string, verdict_locked boolean, verdict_locked_at timestamp, verdict_locked_by string")
    commands = spark.createDataFrame([("1", "APPROVED", "me"), ("9", "APPROVED", "me"), ("2", "PENDING", "me")], "id string, verdict string, by string")
    got, outcomes = K.verdicts(c, commands, F.current_timestamp())
    assert {(r.id, r.status, r.verdict_locked, r.verdict_locked_by) for r in got.collect()} == {("1", "APPROVED", True, "me"), ("2", "PENDING", False, None)}
    assert {r.id: r.ok for r in outcomes.collect()} == {"1": True, "2": True, "9": False}


def test_tolerant_join_finds_all(spark):
    rows = [(i, f"s{i % 3}", None if i % 11 == 0 else 100 + i * 7 % 90, None if i % 13 == 0 else 10.0 + i * 3 % 9) for i in range(150)]
    x = spark.createDataFrame(rows, "id int, source_domain string, price int, size_sqm double")
    a, b = (x.select(*(F.col(c).alias(f"{s}_{c}") for c in x.columns)) for s in "ab")
    got = sorted((r.a_id, r.b_id) for r in P.tolerant_join(a, b).collect())
    near = lambda p, q, t: not (p and q) or abs(p - q) / max(p, q) < t
    due = sorted((i, j) for i, s, p, z in rows for j, t, q, y in rows if i < j and s != t and near(p, q, 0.3) and near(z, y, 0.15))
    assert got == due


def test_listing_page(spark):
    page = """<html><body><div class="detail">Price: 420.000€</div><div class="detail">Bedrooms: 3</div><div class="detail">Plot size: 1.200 m²</div><div class="detail">Year built: 2005</div>
    <div class="detail">Heating: Yes</div><div class="detail">View: Sea</div><ul><li class="feature">Swimming pool<br></li><div class="property-description">Villa of 250 sqm with a garden and <b>fireplace</b>.</div>
    <a href="/property/villa-77/">x</a><a href="/about">y</a><img src="1.jpg"><script>var x = "<div class='detail'>no</div>"</script></body></html>"""
    spec = html.SITES["greekexclusiveproperties.com"]
    pages = spark.createDataFrame([("http://x/property/villa-12/", page), ("http://x/e/1", None)], "url string, html string")
    parsed = html.parse_pages(pages, spec)
    r = html.with_mined(html.routed(parsed, spec)).where("url like '%villa%'").first()
    assert (r.price, r.bedrooms, r.year_built, r.size_sqm, r.category, r.site_property_id) == (420000, 3, 2005, 250.0, "Villa", "12")
    assert r.features["heating"] and r.features["swimming_pool"] and r.features["fireplace"] and r.notes == {"view": "Sea"} and r.image_urls == ["1.jpg"]
    assert [s.url for s in html.seeds(parsed, spec).collect()] == ["/property/villa-77/"]


def test_site_formats(spark):
    def listing(domain, page):
        spec = html.SITES[domain]
        pages = spark.createDataFrame([("http://x/p/31", page)], "url string, html string")
        return html.routed(html.parse_pages(pages, spec), spec).first()

    r = listing("sousouras-realestate.gr", '<table class="info-table"><tr><th>Bedrooms</th><td>4</td></tr><tr><th>Plot size</th><td>900 m2</td></tr></table><span class="price color2">350.000 €</span><ul class="property-amenities"><li>Pool</li></ul><div class="property-content"><p>Nice.</p></div>')
    assert (r.bedrooms, r.land_size_sqm, r.price, r.features, r.description) == (4, 900.0, 350000, {"pool": True}, "Nice.")
    r = listing("ellasestate.com", '<script type="application/ld+json">{"@type":"RealEstateListing","offers":{"price":"500000"},"geo":{"latitude":40.2,"longitude":23.4}}</script><div class="rh_ultra_prop_card__meta"><span class="rh-ultra-meta-label">Bedrooms</span><span class="figure">3</span></div>')
    assert (r.price, r.bedrooms, r.lat) == (500000, 3, 40.2)
    r = listing("engelvoelkers.com", '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"dehydratedState":{"queries":[{"queryKey":["listing",{}],"state":{"data":{"listing":{"price":{"salesPrice":750000},"bedrooms":{"min":3,"max":4},"area":{"livingSurface":210.5}}}}}]}}}}</script>')
    assert (r.price, r.bedrooms, r.size_sqm) == (750000, 3, 210.5)


def test_dump(spark):
    text = "INSERT INTO `Areas` (`id`) VALUES\n(1, 'A\\'b', NULL, 2.5),\n(2, 'c, (d)', 'e', -1);\n"
    raw = spark.createDataFrame([(text,)], "value string")
    assert [tuple(r) for r in readers.dump_rows(raw, 4).collect()] == [("1", "A'b", None, "2.5"), ("2", "c, (d)", "e", "-1")]
    r = readers.dump_statements(raw).first()
    assert r.table == "areas" and r.statement.startswith("INSERT INTO areas (id)") and "''b" in r.statement


def test_json_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"pairs": [{"id": "2", "ground_truth": "duplicate"}, {"id": "1", "ground_truth": "different"}], "splits": {"train": ["1", "2"], "holdout": []}}')
    assert [r.id for r in readers.labelled_pairs(spark, f"{tmp_path}/p.json", "train").collect()] == ["1", "2"]
    (tmp_path / "s.json").write_text('{"villa": ["Villa"], "land": ["Plot ", null]}')
    assert {r.alias: r.canonical for r in readers.synonyms(spark, f"{tmp_path}/s.json").collect()} == {"villa": "villa", "plot": "land"}


def test_replace_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(5).write.parquet(path)
    replace_table(spark, spark.read.parquet(path).where("id > 2"), path)
    assert spark.read.parquet(path).count() == 2


def test_verdicts_take_all_commands(spark):
    c = spark.createDataFrame([(i, "PENDING", False, None, None) for i in range(250)], "id int, status string, verdict_locked boolean, verdict_locked_at timestamp, verdict_locked_by string")
    commands = spark.createDataFrame([(i, "APPROVED", "me") for i in range(0, 500, 2)], "id int, verdict string, by string")
    got, outcomes = K.verdicts(c, commands, F.current_timestamp())
    assert {r.id for r in got.where("verdict_locked").collect()} == set(range(0, 250, 2))
    assert {r.id: r.ok for r in outcomes.collect()} == {i: i < 250 for i in range(0, 500, 2)}
