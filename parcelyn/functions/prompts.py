"""Texts that put a pair of listings to a language-model backend."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a description in the full text and in the short one.
FULL, SHORT = 600, 300
#: Facts of a listing in the order of the text, with the unit behind them.
FACTS = (("source", "source_domain", ""), ("category", "category", ""), ("price", "price", " EUR"), ("size", "size_sqm", " sqm"), ("land", "land_size_sqm", " sqm"), ("year_built", "year_built", ""), ("bedrooms", "bedrooms", ""), ("bathrooms", "bathrooms", ""))
#: Computed signals and their decimals.
SIGNALS = (("embedding_cosine_sim", 3), ("phash_min_hamming", 0), ("phash_close_count", 0), ("year_built_diff", 0), ("price_log_ratio", 3), ("size_sqm_ratio", 3), ("bedrooms_diff", 0))
#: What stands for a missing value.
MISSING = "NULL"


def number_text(value: Column, decimals: int = 0, grouped: bool = False) -> Column:
    """A number with fixed decimals (and groups of thousands); missing and NaN are NULL."""
    x = value.cast("double")
    text = F.format_number(x, decimals) if grouped else F.format_string(f"%.{decimals}f", x)
    return F.when(x.isNull() | F.isnan(x), MISSING).otherwise(text)


def cut_text(text: Column, most: int = FULL) -> Column:
    """The first characters of a text; a missing one is empty."""
    return F.coalesce(F.substring(text, 1, most), F.lit(""))


def listing_text(x, most: int = FULL) -> Column:
    """The facts of a listing, a line each; x(name) gives a column."""
    lines = []
    for label, name, unit in FACTS:
        if name == "price":
            value = number_text(x(name), grouped=True)
        elif name.endswith("_sqm"):
            value = number_text(x(name))
        else:
            value = F.coalesce(x(name).cast("string"), F.lit(MISSING))
        lines.append(F.concat(F.lit(f"- {label}: "), value, F.lit(unit)))
    place = F.concat(F.lit("- location: "), F.coalesce(x("area"), F.lit("?")), F.lit(", "), F.coalesce(x("municipality"), F.lit("?")))
    return F.concat_ws("\n", *lines, place, F.concat(F.lit('- description: "'), cut_text(x("description"), most), F.lit('"')))


def pair_prompt(x, features: dict[str, Column], most: int = FULL) -> Column:
    """The text for a pair: both listings and the signals that were computed for it. x(side, name) gives a column."""
    signals = [F.concat(F.lit(f"- {name}: "), number_text(features[name], decimals)) for name, decimals in SIGNALS]
    same = [F.concat(F.lit(f"- {name}: "), F.when(features[name] == 1, "yes").otherwise("no")) for name in ("same_calc_municipality", "same_calc_area")]
    sides = [F.concat_ws("\n", F.lit(f"LISTING {side.upper()}"), listing_text(lambda name, side=side: x(side, name), most)) for side in "ab"]
    return F.concat_ws("\n\n", F.lit("Are these two listings the same property?"), *sides, F.concat_ws("\n", F.lit("SIGNALS"), *signals, *same))
