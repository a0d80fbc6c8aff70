"""Canonical forms, hashes, distances and pair features: pure Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from . import patterns as P

EARTH_M, EARTH_KM = 6_371_000.0, 6371.0


# --- canonical forms -------------------------------------------------------------------------------------------------


def category_aliases() -> dict[str, str]:
    """Lower-cased name -> canonical category; a name under two categories is an error."""
    out: dict[str, str] = {}
    for canonical, names in P.CATEGORIES.items():
        for name in names:
            if out.setdefault(name.strip().lower(), canonical) != canonical:
                raise ValueError(f"{name} stands under {out[name.strip().lower()]} and {canonical}")
    return out


def canonical_category(category: Column) -> Column:
    key = F.lower(F.trim(category))
    table = F.create_map(*(F.lit(x) for kv in category_aliases().items() for x in kv))
    return F.when(category.isNull() | (key == ""), "unknown").otherwise(F.coalesce(F.try_element_at(table, key), F.concat(F.lit("unknown_label_"), key)))


def one_decimal(x: Column) -> Column:
    """Half up; see the README on how this differs from binary half-even."""
    return F.when(x.isNotNull(), F.format_string("%.1f", x.cast("double")))


def canonical_text(x) -> Column:
    """Twelve named fields joined by " | ", price left out. x(name) gives a column; `features` and `photos` are arrays."""
    number = lambda c: F.coalesce(one_decimal(c), F.lit("?"))
    whole = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    name = lambda c: F.coalesce(F.nullif(F.lower(F.trim(c.cast("string"))), F.lit("")), F.lit("unknown"))
    listed = lambda c, mark: F.coalesce(F.nullif(F.array_join(c, mark), F.lit("")), F.lit("none"))
    fields = {
        "category": name(x("category")),
        "prefecture": name(x("prefecture")),
        "municipality": name(x("municipality")),
        "area": name(x("area")),
        "size_sqm": number(x("size_sqm")),
        "land_size_sqm": number(x("land_size_sqm")),
        "bedrooms": whole(x("bedrooms")),
        "bathrooms": whole(x("bathrooms")),
        "year_built": whole(x("year_built")),
        "levels": name(x("levels")),
        "features": listed(F.array_sort(x("features")), ", "),
        "phashes": listed(x("photos"), ","),
    }
    return F.concat_ws(" | ", *(F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()))


def truthy(value: Column) -> Column:
    """Whether a string of a feature map says yes; numbers are not features."""
    x = F.lower(F.trim(value))
    return F.coalesce((x != "") & ~x.isin("false", "no", "0", "none") & x.try_cast("double").isNull(), F.lit(False))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


# --- distances -------------------------------------------------------------------------------------------------------


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great circle by the law of cosines, clamped."""
    a, b = F.radians(lat1), F.radians(lat2)
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lng2) - F.radians(lng1))
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))) * EARTH_M


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), h))) * 2 * EARTH_KM


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Null for a missing vector, one of length zero, or different lengths. Norms can be given, computed once a row."""
    size = (norm_a if norm_a is not None else norm(a)) * (norm_b if norm_b is not None else norm(b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def hamming(a: Column, b: Column, default: int) -> Column:
    """Differing bits of two 16-digit hex hashes, compared in halves; `default` for malformed ones."""
    ok = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")

    def half(x: Column, at: int) -> Column:
        return F.conv(F.substring(x, at, 8), 16, 10).cast("long")

    bits = F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))
    return F.when(ok, bits).otherwise(default)


def same_photo(a: Column, b: Column, strict: bool = False, config: Config = DEFAULT) -> Column:
    return hamming(a, b, 1 << 30) <= (config.same_photo_bits_strict if strict else config.same_photo_bits)


def greedy_photo_matches(a: Column, b: Column, stock: Column | None = None, config: Config = DEFAULT) -> Column:
    """Photos of a, in order, that each take the first yet free photo of b that is the same; blanks and stock don't count."""
    keep = lambda xs: F.filter(F.coalesce(xs, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "") & (~F.array_contains(stock, x) if stock is not None else F.lit(True)))

    def take(state: Column, x: Column) -> Column:
        at = F.array_position(F.transform(state["free"], lambda y: same_photo(x, y, config=config)), F.lit(True))
        hit = at > 0
        rest = F.when(hit, F.filter(state["free"], lambda y, i: i + 1 != at)).otherwise(state["free"])
        return F.struct(rest.alias("free"), (state["n"] + hit.cast("int")).alias("n"))

    return F.aggregate(keep(a), F.struct(keep(b).alias("free"), F.lit(0).alias("n")), take, lambda s: s["n"])


def photo_distances(a: Column, b: Column, config: Config = DEFAULT) -> Column:
    """struct<least, close> over all pairs of photos; least is 64 without any."""
    every = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: hamming(x, y, config.no_photo_bits))))
    return F.struct(F.coalesce(F.array_min(every), F.lit(config.no_photo_bits)).alias("least"), F.coalesce(F.size(F.filter(every, lambda d: d <= config.close_photo_bits)), F.lit(0)).alias("close"))


def shared_photos(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def rounded(x: Column, digits: int) -> Column:
    """F.round of a double, by decimal arithmetic only where a tie is near or the number is large."""
    scale = F.lit(10.0**digits)
    v = F.abs(x) * scale
    whole = F.floor(v + 0.5)
    sure = (v < 2.0**36) & (F.abs(v - F.floor(v) - 0.5) > 1e-4)
    return F.when(sure, F.when(x < 0, -whole).otherwise(whole) / scale).otherwise(F.round(x, digits))


# --- pairs -----------------------------------------------------------------------------------------------------------


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(":", F.least(a, b), F.greatest(a, b))


def ratio(a: Column, b: Column) -> Column:
    """Larger by smaller; null if one is missing or not above zero."""
    return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b))


def relative_difference(a: Column, b: Column) -> Column:
    """Difference by the larger; null if one is missing or not above zero."""
    return F.when((a > 0) & (b > 0), F.abs(a - b) / F.greatest(a, b))


def of_listing(listings: DataFrame) -> DataFrame:
    """Listings with what pairs would else compute of each side again: norm, canonical_category, shown_photos of photos, and
    sines and cosines of a place."""
    x = listings.withColumns({"norm": norm(F.col("embedding")), "canonical_category": canonical_category(F.col("category"))})
    if "lat" in listings.columns and "lng" in listings.columns:
        x = x.withColumns({"sin_lat": F.sin(F.radians("lat")), "cos_lat": F.cos(F.radians("lat")), "rad_lng": F.radians("lng")})
    return x.withColumn("shown_photos", shown_photos(F.col("photos"))) if "photos" in listings.columns else x


def learning_features(x, once: bool = False, measured: bool = False) -> dict[str, Column]:
    """13 features of a pair, in fixed order; x(side, name) gives a column. NaN where a value is missing.

    once: x has the columns of of_listing, so nothing of a single listing is computed a pair. measured: pairs have
    similarity, km, same_area and same_canonical_category already (pairs.measured_blocks).
    """
    nan = F.lit(float("nan"))

    def or_nan(c: Column) -> Column:
        return F.coalesce(c.cast("double"), nan)

    def both(name: str) -> tuple[Column, Column]:
        return x("a", name), x("b", name)

    def same(name: str) -> Column:
        a, b = both(name)
        return F.coalesce((a == b).cast("double"), F.lit(0.0))

    pa, pb = both("price")
    photos = photo_distances(*both("photos"))
    if measured:
        km, similarity, same_category = F.col("km"), F.col("similarity"), F.col("same_canonical_category")
    else:
        ca, cb = both("canonical_category") if once else map(canonical_category, both("category"))
        km, same_category = haversine_km(x("a", "lat"), x("a", "lng"), x("b", "lat"), x("b", "lng")), ca == cb
        similarity = cosine(*both("embedding"), *(both("norm") if once else ()))
    return {
        "price_log_ratio": or_nan(F.when((pa > 0) & (pb > 0), F.log(F.greatest(pa, pb) / F.greatest(F.least(pa, pb), F.lit(1))))),
        "size_sqm_ratio": or_nan(ratio(*both("size_sqm"))),
        "land_size_ratio": or_nan(ratio(*both("land_size_sqm"))),
        "bedrooms_diff": or_nan(F.abs(x("a", "bedrooms") - x("b", "bedrooms"))),
        "bathrooms_diff": or_nan(F.abs(x("a", "bathrooms") - x("b", "bathrooms"))),
        "year_built_diff": or_nan(F.abs(x("a", "year_built") - x("b", "year_built"))),
        "distance_km": or_nan(km),
        "embedding_cosine_sim": or_nan(similarity),
        "phash_min_hamming": or_nan(photos["least"]),
        "phash_close_count": or_nan(photos["close"]),
        "same_calc_municipality": same("municipality"),
        "same_calc_area": F.coalesce(F.col("same_area").cast("double"), F.lit(0.0)) if measured else same("area"),
        "same_category_canonical": same_category.cast("double"),
    }


#: Pairs of sites whose one-hot columns the model knows, by the sites' names in order of the alphabet.
SOURCE_PAIRS = {
    "src_gl_greek": ("glrealestate.gr", "greekexclusiveproperties.com"),
    "src_gl_real": ("glrealestate.gr", "realestatecenter.gr"),
    "src_greek_real": ("greekexclusiveproperties.com", "realestatecenter.gr"),
}


def tri_state(match: Column) -> Column:
    """1 where a comparison holds, 0 where it doesn't, -1 where it is unknown."""
    return F.coalesce(match.cast("int"), F.lit(-1))


def shown_photos(photos: Column) -> Column:
    """Photos without blanks and nulls; none if there is no list."""
    return F.filter(F.coalesce(photos, F.array().cast("array<string>")), lambda h: h.isNotNull() & (h != ""))


def model_features(x, once: bool = False, measured: bool = False) -> dict[str, Column]:
    """The 14 features of the pair model, in fixed order; x(side, name) gives a column. NaN where a measure is missing.

    once and measured as in learning_features, with metres for km, same_bedrooms, same_municipality and
    shared_shown_photos. Unlike there, a place or number of bedrooms that one side lacks is unknown (-1), not different.
    """

    def both(name: str) -> tuple[Column, Column]:
        return x("a", name), x("b", name)

    def measure(c: Column) -> Column:
        return F.coalesce(c.cast("double"), F.lit(float("nan")))

    def state(name: str) -> Column:
        if measured:
            return tri_state(F.col(f"same_{name}"))
        a, b = both(name)
        return tri_state(a == b)

    first, second = F.least(*both("source_domain")), F.greatest(*both("source_domain"))
    if measured:
        shared = F.col("shared_shown_photos")
        metres, similarity, same_category = F.col("metres"), F.col("similarity"), F.col("same_canonical_category")
    else:
        ca, cb = both("canonical_category") if once else map(canonical_category, both("category"))
        shared = shared_photos(*(both("shown_photos") if once else map(shown_photos, both("photos"))))
        metres, same_category = distance_m(x("a", "lat"), x("a", "lng"), x("b", "lat"), x("b", "lng")), ca == cb
        similarity = cosine(*both("embedding"), *(both("norm") if once else ()))
    out = {
        "cosine_sim": measure(similarity),
        "gps_distance_m": measure(metres),
        "year_diff": measure(F.abs(x("a", "year_built") - x("b", "year_built"))),
        "price_diff_pct": measure(relative_difference(*both("price"))),
        "size_diff_pct": measure(relative_difference(*both("size_sqm"))),
        "shared_phash_count": shared.cast("double"),
        "same_canonical_category": same_category.cast("int"),
        "bedrooms_match_state": state("bedrooms"),
        "same_municipality_state": state("municipality"),
        "same_calc_area_state": state("area"),
    }
    out |= {name: ((first == a) & (second == b)).cast("int") for name, (a, b) in SOURCE_PAIRS.items()}
    return out | {"src_same_source": (first == second).cast("int")}
