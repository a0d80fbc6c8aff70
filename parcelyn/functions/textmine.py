"""Text mining of descriptions by ordered patterns, in JVM regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

#: Ignore case by Unicode rules, and take word boundaries by Unicode letters.
FLAGS = "(?iuU)"
WHOLE = ("bedrooms", "bathrooms", "year_built")
FILLABLE = ("size_sqm", "land_size_sqm", "bedrooms", "bathrooms", "year_built", "category", "levels")


def clean_number(text: Column, strict: bool = True) -> Column:
    """A number without marks, a tail of ,00 or .00 cut off. strict: blanks inside make it no number."""
    x = F.trim(text) if strict else F.regexp_replace(text, r"[\s ]", "")
    x = F.regexp_replace(F.regexp_replace(x, "[.,]00$", ""), "[.,]", "")
    return F.when(x.rlike(r"^\d+$"), x).try_cast("double")


def metric(text: Column, key: str, strict: bool = True) -> Column:
    """The value of the first pattern that matches; the later ones aren't tried even if it is no number."""
    out = F.lit(None).cast("string")
    for pattern in reversed(P.METRICS[key]):
        out = F.when(text.rlike(FLAGS + pattern), F.regexp_extract(text, FLAGS + pattern, 1)).otherwise(out)
    if key == "levels":
        return F.trim(out)
    number = clean_number(out, strict)
    return number.cast("int") if key in WHOLE else number


def metrics(text: Column, strict: bool = True) -> Column:
    return F.struct(*(metric(text, k, strict).alias(k) for k in P.METRICS))


def property_type(text: Column) -> Column:
    """The type with most matches; of equals the earliest."""
    scores = [F.struct(sum((F.regexp_count(text, F.lit(FLAGS + p)) for p in ps), F.lit(0)).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, ps) in enumerate(P.TYPES.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["name"])


def features(text: Column) -> Column:
    """map<string, boolean> of the features that the text has."""
    pairs = []
    for key, ps in P.FEATURES.items():
        hit = F.lit(False)
        for p in ps:
            hit = hit | text.rlike(FLAGS + p)
        pairs += [F.lit(key), hit]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v)


def system_data(text: Column) -> Column:
    """struct<site_property_id, last_updated>"""
    return F.struct(*(F.nullif(F.trim(F.regexp_extract(text, FLAGS + ps[0], 1)), F.lit("")).alias(k) for k, ps in P.SYSTEM.items()))


def analyse(text: Column, strict: bool = True) -> Column:
    """All of the above; null for empty text."""
    every = F.struct(metrics(text, strict).alias("metrics"), property_type(text).alias("category"), system_data(text)["site_property_id"].alias("site_property_id"), features(text).alias("extra_features"))
    return F.when(F.coalesce(text, F.lit("")) != "", every)


def fill_features(existing: Column, mined: Column) -> Column:
    """existing plus the mined features that neither it nor a synonym of theirs has."""
    synonyms = F.create_map(*(x for k, v in P.SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    own = F.coalesce(existing, F.create_map().cast("map<string,boolean>"))
    keys = F.map_keys(own)
    new = F.map_filter(mined, lambda k, v: ~F.array_contains(keys, k) & ~F.coalesce(F.arrays_overlap(keys, F.try_element_at(synonyms, k)), F.lit(False)))
    return F.map_concat(own, new)


def needs_model(description: Column, n_features: Column, least_length: int = 200, least_features: int = 5) -> Column:
    """Whether a language model should read a description that patterns found little in."""
    return (F.length(F.coalesce(description, F.lit(""))) >= least_length) & (F.coalesce(n_features, F.lit(0)) < least_features)


def passes_quality(description: Column, least: int = 50) -> Column:
    return F.length(F.trim(F.coalesce(description, F.lit("")))) >= least


def in_region(url: Column, location: Column) -> Column:
    text = F.lower(F.concat(F.coalesce(url, F.lit("")), F.lit(" "), F.coalesce(location, F.lit(""))))
    return text.rlike("|".join(P.REGION))


def flat_payload(payload: Column, flags: Column, others: Column) -> Column:
    """A model's answer as a flat map: true flags, known values, and up to 10 other features as short snake-case keys."""
    on = F.map_filter(flags, lambda k, v: F.coalesce(v, F.lit(False)))
    known = F.map_filter(payload, lambda k, v: v.isNotNull())
    keys = F.transform(F.slice(others, 1, 10), lambda x: F.substr(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), F.lit(1), F.lit(50)))
    more = F.map_from_entries(F.transform(F.array_distinct(F.filter(keys, lambda k: k != "")), lambda k: F.struct(k.alias("key"), F.lit("true").alias("value"))))
    return F.map_concat(known, F.transform_values(F.map_filter(on, lambda k, v: ~F.map_contains_key(known, k)), lambda k, v: F.lit("true")), F.map_filter(more, lambda k, v: ~F.map_contains_key(known, k) & ~F.map_contains_key(on, k)))
