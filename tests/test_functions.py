"""Table-driven cases of value cleaning, text mining, matching and reporting."""

import pytest
from pyspark.sql import functions as F

from parcelyn.config import DEFAULT
from parcelyn.functions import cleaning as C
from parcelyn.functions import matching as M
from parcelyn.functions import textmine as X
from parcelyn.operators import golden as G
from parcelyn.operators import reports as R

CASES = [
    (C.euro_int, "420.000€", 420000),
    (C.euro_int, "420.000,00€", 420000),
    (C.euro_int, "1,350,000 €", 1350000),
    (C.euro_int, "Price: 420.000€", 420000),
    (C.euro_int, "", None),
    (C.euro_int, "POA", None),
    (C.euro_int, "1.550.000€1.500.000€", None),
    (C.clean_price, "€500 000 (was €600 000)", 500000),
    (C.clean_price, "1.400.000,00", 1400000),
    (C.clean_price, "500", None),
    (C.clean_float, "127m2", 127.0),
    (C.clean_float, "1,500 m2", 1.5),
    (C.clean_int, "Year: 2020", 2020),
    (C.clean_int, "3-4", 34),
    (C.area_sqm, "280 m²", 280.0),
    (C.area_sqm, "113,7 m²", 113.7),
    (C.area_sqm, "10,500 m²", 10500.0),
    (C.sane_year, "20", None),
    (C.sane_year, "2020", 2020),
    (C.sane_year, "Under Construction", None),
    (C.slug, "Distance from Sea", "distance_from_sea"),
    (C.slug, "Energy class", "energy_class"),
    (C.slug, "WC", "wc"),
    (C.locality_of_title, "For Sale – Villa 280 sq.m. in Kallithea, Halkidiki", "Kallithea"),
    (C.locality_of_title, "Villa for sale in Pefkochori", None),
    (C.locality_of_url, "/property/villa-for-sale-240-sq-m-in-pefkochori/", "Pefkochori"),
    (C.metres, "30m", 30),
    (C.metres, "90km", 90000),
    (C.metres, "1.5km", 1500),
    (X.clean_number, "32.5", 325.0),
    (X.clean_number, "8 000", None),
    (X.clean_number, "120,00", 120.0),
    (C.energy_class, "Γ", "C"),
    (C.energy_class, "a+", "A+"),
    (C.energy_class, "XX", "XX"),
    (C.stated_price, "Price on request", None),
    (C.html_text, "<p>a<br/>b &amp; c</p> ", "a\nb & c"),
    (C.without_struck, "x<s>old</s>y", "xy"),
    (C.snake_case, "hasSeaView", "has_sea_view"),
    (C.full_size_image, "a_100x80.jpg", "a_1600x1200.jpg"),
    (C.without_thumbnail, "a-100x80.jpg", "a.jpg"),
    (C.bare_host, "https://www.Ab.gr:80/x", "ab.gr"),
    (C.privacy_circle, "L.circle([1,2],{radius: 500})", 500),
    (M.canonical_category, "Bungalow", "detached_house"),
    (M.canonical_category, " villa ", "villa"),
    (M.canonical_category, None, "unknown"),
    (M.canonical_category, "Castle", "unknown_label_castle"),
    (X.property_type, "villa villas hotel", "Villa"),
    (X.property_type, "a villa by the hotel", "Hotel/Commercial"),
    (X.property_type, "Βίλα με πισίνα", "Villa"),
    (X.property_type, "nothing", None),
]


def test_cases(spark):
    row = spark.range(1).select(*(f(F.lit(x).cast("string")).alias(f"c{i}") for i, (f, x, _) in enumerate(CASES))).first()
    wrong = [(f.__name__, x, row[i], due) for i, (f, x, due) in enumerate(CASES) if row[i] != due]
    assert not wrong


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("text", "label", "value"), [("Bedrooms: 3", "Bedrooms", "3"), ("Type:: For Sale", "Type", "For Sale"), ("Air condition", "Air condition", None)])
def test_labels(spark, text, label, value):
    assert tuple(one(spark, C.split_label(F.lit(text)))) == (label, value)


def test_hamming(spark):
    a, b = F.lit("ff1e3c5a7b9d0f24"), F.lit("0f1e3c5a7b9d0f25")
    assert one(spark, M.hamming(a, b, 64)) == 5
    assert one(spark, M.hamming(a, F.lit("zz"), 64)) == 64
    assert one(spark, M.greedy_photo_matches(F.array(a, a), F.array(a))) == 1


def test_golden(spark):
    assert one(spark, G.first_mode(F.array(*map(F.lit, (3, 1, 1, 3))))) == 3
    assert one(spark, G.mode_or_mean(F.array(*map(F.lit, (1.0, 2.0))))) == 1.5
    assert one(spark, G.mode_or_mean(F.array(*map(F.lit, (1.0, 2.0, 2.0))))) == 2.0


def test_mining(spark):
    text = F.lit("Villa 280 sqm on a plot of 3.500 sqm, 4 bedrooms 3 bathrooms, built 2005, 50m from the sea, swimming pool")
    got = one(spark, X.analyse(text))
    m = got.metrics
    assert (m.size_sqm, m.bedrooms, m.bathrooms, m.year_built, m.distance_to_sea) == (280.0, 4, 3, 2005, 50.0)
    assert got.extra_features["swimming_pool"] and got.category == "Villa"
    hotel = F.lit("Total builded area in m2 : 8 000")
    assert one(spark, X.metric(hotel, "size_sqm")) is None
    assert one(spark, X.metric(hotel, "size_sqm", strict=False)) == 8000.0
    filled = X.fill_features(F.create_map(F.lit("pool"), F.lit(True)), F.create_map(F.lit("swimming_pool"), F.lit(True), F.lit("gym"), F.lit(True)))
    assert one(spark, filled) == {"pool": True, "gym": True}
    assert one(spark, X.in_region(F.lit("http://x/Sani-villa"), F.lit(None).cast("string")))


def test_html_values(spark):
    page = """<script type="application/ld+json">{"@graph":[{"@type":"RealEstateListing","name":"x"}]}</script>
    <meta property="og:image" content="i.jpg"><div data-lat="40.1" data-lng="23.5"></div><script id="__NEXT_DATA__">{"a":{"b":7}}</script>"""
    html = F.lit(page)
    assert one(spark, F.get_json_object(C.json_ld(html, "RealEstateListing"), "$.name")) == "x"
    assert one(spark, C.meta_property(html, "og:image")) == "i.jpg"
    assert tuple(one(spark, C.html_coordinates(html))) == (40.1, 23.5)
    assert one(spark, C.next_data(html, "$.a.b")) == "7"
    assert one(spark, C.main_description(F.array(F.lit("cookies"), F.lit("a villa by the sea")), ("villa", "sea"))) == "a villa by the sea"
    assert one(spark, C.range_low(F.lit('{"p":{"min":3,"max":5}}'), "$.p")) == 3.0


def test_status(spark):
    f = lambda n, a, b, c, e: one(spark, R.domain_status(*map(F.lit, (n, a, b)), F.lit(c), F.lit(e)))
    assert [f(5, 90, 95, True, True), f(0, 90, 95, False, False), f(5, 49, 95, False, False), f(5, 90, 89, False, False), f(5, 90, 95, False, False), f(5, 90, 95, False, True)] == ["CLOUDFLARE", "WARNING", "WARNING", "WARNING", "OK", "CRITICAL"]
    assert DEFAULT.merge_similarity == 0.985


def test_numbers_that_no_long_holds(spark):
    rows = spark.createDataFrame([("x 12 345 678 901 234 567 890",), ("-9,5 m",), ("-" + "9" * 30,), ("none",), ("9000000000000000000",)], "t string")
    assert [r[0] for r in rows.select(C.int_in_text(F.col("t"))).collect()] == [None, -10, None, None, 9_000_000_000_000_000_000]
