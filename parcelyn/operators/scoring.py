"""Scoring of hydrated pairs (columns a_* and b_*): hard rules, additive signals, models, cascade, cache."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import matching as M

SAME, DIFFERENT, UNCERTAIN = "duplicate", "different", "uncertain"


class ScoringBackend(Protocol):
    """A scorer of another kind (a language model, say): adds verdict, confidence and reasoning to pairs."""

    def score_pairs(self, pairs: DataFrame) -> DataFrame: ...


class UncertainBackend:
    """The default: has no opinion."""

    def score_pairs(self, pairs: DataFrame) -> DataFrame:
        return pairs.withColumns({"verdict": F.lit(UNCERTAIN), "confidence": F.lit(0.0), "reasoning": F.lit("no backend")})


def without_opinion(scored: DataFrame, open_: Column) -> DataFrame:
    """scored with what UncertainBackend says where open_ holds, in the same pass."""
    said = {"verdict": F.lit(UNCERTAIN), "confidence": F.lit(0.0), "reasoning": F.lit("no backend")}
    return scored.withColumns({k: F.when(open_, v).otherwise(F.col(k)) for k, v in said.items()})


def _pair(name: str) -> tuple[Column, Column]:
    return F.col(f"a_{name}"), F.col(f"b_{name}")


def has(df: DataFrame, name: str) -> bool:
    return f"a_{name}" in df.columns and f"b_{name}" in df.columns


def hard_rules(config: Config = DEFAULT, once: bool = False, compared: bool = False) -> Column:
    """The reason of the first hard rule that tells a pair apart, or null. once: canonical categories are columns already.

    compared: same_source_domain and same_known_category are, the latter null where a category is unknown.
    """
    years = F.abs(F.col("a_year_built") - F.col("b_year_built"))
    if compared:
        one_source, mismatch = F.col("same_source_domain"), ~F.col("same_known_category")
    else:
        ca, cb = _pair("canonical_category") if once else (M.canonical_category(c) for c in _pair("category"))
        one_source, mismatch = F.col("a_source_domain") == F.col("b_source_domain"), (ca != "unknown") & (cb != "unknown") & (ca != cb)
    return (
        F.when(F.col("has_feedback"), "feedback")
        .when(one_source, "same_source")
        .when(mismatch, "category_mismatch")
        .when(years > config.max_year_difference, "year_built")
    )


def signals(df: DataFrame, similarity: Column, config: Config = DEFAULT) -> list[tuple[str, Column]]:
    """Named terms of the additive score; each is 0 where its inputs are missing. Absent columns leave their terms out."""
    w, bands = config.weights, config.bands
    price_ratio, price_gap = M.ratio(*_pair("price")), M.relative_difference(*_pair("price"))
    bedrooms = F.col("same_bedrooms") if "same_bedrooms" in df.columns else F.col("a_bedrooms") == F.col("b_bedrooms")
    terms = [
        (
            "cosine",
            F.when(similarity >= bands.strong_same, w.cosine_strong)
            .when(similarity >= bands.weak_same, w.cosine_weak)
            .when(similarity < bands.strong_different, w.cosine_strong_different)
            .when(similarity < bands.weak_different, w.cosine_weak_different),
        ),
        ("price", F.when(price_ratio <= config.price_ratio_close, w.price_close).when(price_ratio >= config.price_ratio_far, w.price_far)),
        ("size", F.when(M.relative_difference(*_pair("size_sqm")) > config.size_far, w.size_far)),
        ("bedrooms", F.when(bedrooms, w.bedrooms_same).when(~bedrooms, w.bedrooms_differ)),
        ("year", F.when(F.abs(F.col("a_year_built") - F.col("b_year_built")) <= 1, w.year_close)),
    ]
    if "metres" in df.columns or has(df, "lat") and has(df, "lng"):
        metres = F.col("metres") if "metres" in df.columns else M.distance_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))
        terms.append(("other_unit", F.when((metres <= config.same_building_m) & ~bedrooms & (price_gap > config.other_unit_price), w.other_unit)))
        terms.append(("distance", F.when(metres > config.far_away_m, w.far_away)))
    if "same_area" in df.columns:
        terms.append(("area", F.when(F.col("same_area"), w.same_area)))
    elif has(df, "area"):
        terms.append(("area", F.when(F.col("a_area") == F.col("b_area"), w.same_area)))
    if has(df, "photos"):
        terms.append(("photos", F.when(M.shared_photos(*_pair("photos")) >= 1, w.shared_photo)))
    return [(name, F.coalesce(c, F.lit(0.0))) for name, c in terms]


def decide(score: Column, config: Config = DEFAULT) -> Column:
    return F.when(score >= config.score_same, SAME).when(score <= config.score_different, DIFFERENT).otherwise(UNCERTAIN)


def rule_scores(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds similarity, score, verdict, confidence, reasoning and tier: hard rules first, then the additive score.

    The cosine is computed once a pair, or taken from similarity where pairs have it (pairs.measured_blocks). Hard rules are
    tier 0, a decided score tier 1, and an undecided one stays tier 1.
    """
    norms = [F.col(f"{s}_norm") if f"{s}_norm" in pairs.columns else None for s in "ab"]
    x = pairs if "similarity" in pairs.columns else pairs.withColumn("similarity", M.cosine(*_pair("embedding"), *norms))
    terms = signals(x, F.col("similarity"), config)
    total = sum((c for _, c in terms), F.lit(0.0))
    reasons = F.array_join(F.array_compact(F.array(*(F.when(c != 0, F.concat(F.lit(f"{n} "), F.format_string("%+.1f", c))) for n, c in terms))), "; ")
    x = x.withColumns({"rule": hard_rules(config, has(x, "canonical_category"), "same_known_category" in x.columns), "score": total})
    hard = F.col("rule").isNotNull()
    return x.withColumns(
        {
            "tier": F.when(hard, 0).otherwise(1),
            "verdict": F.when(hard, DIFFERENT).otherwise(decide(F.col("score"), config)),
            "confidence": F.when(hard, 1.0).otherwise(F.least(F.lit(1.0), F.abs("score") / config.score_full)),
            # In the branch itself: a pair that a rule tells apart, as most are, has its texts not made.
            "reasoning": F.when(hard, F.col("rule")).otherwise(reasons),
        }
    )


def similarity_verdict(similarity: Column, photo_matches: Column, config: Config = DEFAULT, merge: float | None = None) -> Column:
    """approved above the merging similarity or with enough equal photos, else pending."""
    bound = config.merge_similarity if merge is None else merge
    return F.when((similarity > bound) | (F.coalesce(photo_matches, F.lit(0)) >= config.photo_matches), "approved").otherwise("pending")


def similarity_or_backend(pairs: DataFrame, backend: ScoringBackend | None = None, same: float = 0.95, different: float = 0.40, config: Config = DEFAULT) -> DataFrame:
    """Hard rules, then clear similarities, and only for the rest the backend."""
    scored = rule_scores(pairs, config)
    clear = F.when(F.col("tier") == 0, DIFFERENT).when(F.col("similarity") >= same, SAME).when(F.col("similarity") < different, DIFFERENT)
    sure = scored.withColumns({"verdict": clear, "confidence": F.when(F.col("tier") == 0, 1.0).otherwise(0.95)})
    out = ["a_id", "b_id", "verdict", "confidence", "reasoning"]
    if backend is None:
        return without_opinion(sure, F.col("verdict").isNull()).select(out)
    rest = backend.score_pairs(sure.where("verdict IS NULL").select(*pairs.columns))
    return sure.where("verdict IS NOT NULL").select(out).unionByName(rest.select(out))


def model_verdict(p: Column, config: Config = DEFAULT) -> tuple[Column, Column]:
    """(verdict, confidence) from a probability of being the same."""
    verdict = F.when(p >= config.model_same, SAME).when(1 - p >= config.model_different, DIFFERENT).otherwise(UNCERTAIN)
    return verdict, F.greatest(p, 1 - p)


def threshold_verdict(p: Column, low: float = 0.35, high: float = 0.75) -> tuple[Column, Column]:
    """(verdict, confidence) between two thresholds; an uncertain pair is as sure as p is far from one half."""
    verdict = F.when(p >= high, SAME).when(p < low, DIFFERENT).otherwise(UNCERTAIN)
    return verdict, F.when(p >= high, p).when(p < low, 1 - p).otherwise(F.abs(p - 0.5) * 2)


def cascade(pairs: DataFrame, model: ScoringBackend | None = None, last: ScoringBackend | None = None, config: Config = DEFAULT) -> DataFrame:
    """(a_id, b_id, verdict, confidence, reasoning, tier): the first tier with an opinion decides, the last one finally.

    Each dearer tier sees only what the cheaper ones left open.
    """
    out = ["a_id", "b_id", "verdict", "confidence", "reasoning", "tier"]
    open_, done = rule_scores(pairs, config), []
    base = pairs.columns
    if model is None and last is None:
        undecided = F.col("verdict") == UNCERTAIN
        return without_opinion(open_.withColumn("tier", F.when(undecided, 3).otherwise(F.col("tier"))), undecided).select(out)
    for tier, backend in ((2, model or UncertainBackend()), (3, last or UncertainBackend())):
        done.append(open_.where(F.col("verdict") != UNCERTAIN).select(out))
        rest = open_.where(F.col("verdict") == UNCERTAIN).select(*base)
        open_ = backend.score_pairs(rest).withColumn("tier", F.lit(tier))
    done.append(open_.select(out))
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole


def cached(pairs: DataFrame, cache: DataFrame, version: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(hits, misses). A cached verdict counts if version and both content hashes are the same and it hasn't expired."""
    a, b = _pair("content_hash")
    key = M.pair_key(F.col("a_id"), F.col("b_id"))
    ordered = F.col("a_id") <= F.col("b_id")
    x = pairs.withColumns({"pair_key": key, "_ha": F.when(ordered, a).otherwise(b), "_hb": F.when(ordered, b).otherwise(a)})
    c = cache.select("pair_key", F.col("engine_version").alias("_v"), F.col("a_content_hash").alias("_ca"), F.col("b_content_hash").alias("_cb"), F.col("verdict").alias("_verdict"), F.coalesce(F.col("confidence"), F.lit(0.0)).alias("_confidence"), F.col("reasoning").alias("_reasoning"), F.col("tier_emitted").alias("_tier"), F.col("expires_at").alias("_expires"))
    x = x.join(c, "pair_key", "left")
    valid = F.coalesce((F.col("_v") == version) & (F.col("_ca") == F.col("_ha")) & (F.col("_cb") == F.col("_hb")) & (F.col("_expires").isNull() | (F.col("_expires") > now)), F.lit(False))
    hits = x.where(valid).select("a_id", "b_id", F.col("_verdict").alias("verdict"), F.col("_confidence").alias("confidence"), F.col("_reasoning").alias("reasoning"), F.col("_tier").alias("tier"))
    return hits, x.where(~valid).select(*pairs.columns)


def predictions(scored: DataFrame, now: Column, unique: bool = False) -> DataFrame:
    """Rows for the history of predictions, one a pair: append them; a pair has a row for every run.

    unique: no pair is there twice, as between listings of unique ids, so that none is shuffled to look for others.
    """
    key = M.pair_key(F.col("a_id"), F.col("b_id"))
    cost = F.col("cost_usd") if "cost_usd" in scored.columns else F.lit(0.0)
    rows = scored.select(key.alias("pair_key"), "a_id", "b_id", "verdict", "confidence", F.nullif("reasoning", F.lit("")).alias("reasoning"), F.col("tier").alias("tier_emitted"), cost.cast("double").alias("cost_usd"), now.alias("scored_at"))
    return rows if unique else rows.dropDuplicates(["pair_key"])


def run_counters(scored: DataFrame, hits: DataFrame | Column, skipped: DataFrame | Column, errors: DataFrame | Column) -> DataFrame:
    """One row over a run: pairs by tier, uncertain ones, and those that were cached, skipped or failed.

    The latter are frames of their own, or conditions on scored, which are counted in the same pass.
    """
    tier, more = F.col("tier"), {"cached": hits, "skipped": skipped, "errors": errors}
    inside = [F.count_if(c).alias(name) for name, c in more.items() if isinstance(c, Column)]
    own = scored.agg(*(F.count_if(tier == k).alias(f"tier_{k}") for k in range(4)), F.count_if(F.col("verdict") == UNCERTAIN).alias("uncertain"), *inside)
    for name, rows in more.items():
        if isinstance(rows, Column):
            continue
        own = own.join(F.broadcast(rows.agg(F.count("*").alias(name))))
    return own


def dedup_report(scored: DataFrame) -> DataFrame:
    """Pairs by tier and verdict."""
    return scored.groupBy("tier", "verdict").agg(F.count("*").alias("n_pairs"))


def parsed_answer(json: Column) -> Column:
    """struct<verdict, confidence, reasoning, signals> of a backend's JSON; anything unsound becomes uncertain."""
    verdict = F.lower(F.get_json_object(json, "$.verdict"))
    ok = F.coalesce(verdict.isin(SAME, DIFFERENT, UNCERTAIN), F.lit(False))
    confidence = F.get_json_object(json, "$.confidence").try_cast("double")
    listed = F.from_json(F.get_json_object(json, "$.signals"), "array<string>")
    return F.struct(
        F.when(ok, verdict).otherwise(UNCERTAIN).alias("verdict"),
        F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0))))).otherwise(0.0).alias("confidence"),
        F.substring(F.coalesce(F.get_json_object(json, "$.reasoning"), F.lit("")), 1, 500).alias("reasoning"),
        F.coalesce(F.transform(F.slice(listed, 1, 10), lambda s: F.substring(s, 1, 80)), F.array().cast("array<string>")).alias("signals"),
    )


def vision_candidates(pending: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The most similar pending pairs, as many as the budget allows."""
    return pending.orderBy(F.col("similarity").desc(), "a_id", "b_id").limit(config.vision_budget)


def after_vision(pending: DataFrame, answers: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Pending pairs with the verdict of sure answers: same is approved, different rejected, others stay."""
    x = pending.join(answers.select("a_id", "b_id", F.col("same").alias("_same"), F.col("confidence").alias("_sure")), ["a_id", "b_id"], "left")
    sure = F.coalesce(F.col("_sure") >= config.vision_confidence, F.lit(False))
    return x.withColumn("verdict", F.when(sure & F.col("_same"), "approved").when(sure & ~F.col("_same"), "rejected").otherwise(F.col("verdict"))).drop("_same", "_sure")


def external_uniqueness(clusters: DataFrame, representatives: DataFrame, candidates: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(cluster_id, top_similarity, is_unique, audited): unique without candidates, or if none is too similar.

    A cluster without a representative or its vector is not unique and isn't audited.
    """
    r = representatives.select("cluster_id", F.col("embedding").alias("_e"), "category", "municipality", "size_sqm")
    size = F.col("size_sqm")
    c = candidates.select(F.col("embedding").alias("_c"), F.col("category").alias("_cat"), F.col("municipality").alias("_mun"), F.col("size_sqm").alias("_size"))
    near = (F.col("category") == F.col("_cat")) & (F.col("municipality") == F.col("_mun")) & F.col("_size").between(F.floor(size * 0.85), F.floor(size * 1.15))
    top = r.where("_e IS NOT NULL").join(c, near).groupBy("cluster_id").agg(F.max(M.cosine(F.col("_e"), F.col("_c"))).alias("top_similarity"))
    known = r.where("_e IS NOT NULL").select("cluster_id").withColumn("audited", F.lit(True))
    x = clusters.select("cluster_id").join(known, "cluster_id", "left").join(top, "cluster_id", "left")
    audited = F.coalesce("audited", F.lit(False))
    return x.select("cluster_id", "top_similarity", (audited & F.coalesce(F.col("top_similarity") < config.unique_below, F.lit(True))).alias("is_unique"), audited.alias("audited"))
