"""Thresholds of matching, merging and reporting. Fixed values that results depend on, in one frozen object."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Bands:
    """Cosine bands of the additive score."""

    strong_same: float = 0.95
    weak_same: float = 0.92
    strong_different: float = 0.40
    weak_different: float = 0.50


@dataclass(frozen=True)
class Weights:
    """Terms of the additive score."""

    cosine_strong: float = 2.0
    cosine_weak: float = 1.0
    cosine_weak_different: float = -1.0
    cosine_strong_different: float = -2.0
    price_close: float = 1.0
    price_far: float = -2.0
    other_unit: float = -2.0
    far_away: float = -1.0
    size_far: float = -1.0
    bedrooms_same: float = 0.5
    bedrooms_differ: float = -0.5
    same_area: float = 0.5
    shared_photo: float = 1.0
    year_close: float = 0.5


@dataclass(frozen=True)
class Config:
    reject_similarity: float = 0.920
    merge_similarity: float = 0.985
    price_tolerance: float = 0.30
    size_tolerance: float = 0.15
    candidates_per_listing: int = 50
    photo_matches: int = 2
    stock_photo_listings: int = 5
    same_photo_bits: int = 6
    same_photo_bits_strict: int = 3
    close_photo_bits: int = 10
    no_photo_bits: int = 64
    min_description: int = 50
    max_year_difference: int = 5
    bands: Bands = field(default_factory=Bands)
    weights: Weights = field(default_factory=Weights)
    price_ratio_close: float = 1.30
    price_ratio_far: float = 3.0
    same_building_m: float = 100.0
    other_unit_price: float = 0.20
    far_away_m: float = 50_000.0
    size_far: float = 0.50
    score_same: float = 2.0
    score_different: float = -2.0
    score_full: float = 6.0
    model_same: float = 0.92
    model_different: float = 0.80
    bridge_epsilon: float = 1e-9
    unique_below: float = 0.95
    recheck_hours: int = 24
    delist_coverage: float = 0.5
    refetch_attempts: int = 5
    refetch_days: int = 7
    features_ok: int = 50
    price_ok: int = 90
    vision_budget: int = 50
    vision_confidence: float = 0.8
    vision_photos: int = 3
    promotion_streak: int = 3
    engine_version: str = "v2.0.0-day3"


DEFAULT = Config()


def weighted(rows: Iterable[tuple[str, float]], config: Config = DEFAULT) -> Config:
    """config with the weights of rows (name, weight), say those of a table that is kept apart; unknown names are refused."""
    given = dict(rows)
    unknown = given.keys() - {f.name for f in fields(Weights)}
    if unknown:
        raise ValueError(f"no such weights: {sorted(unknown)}")
    return replace(config, weights=replace(config.weights, **{k: float(v) for k, v in given.items()}))
