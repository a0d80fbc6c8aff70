"""List walks over stored responses: stages of fetching, next pages, and seeds of listings.

Responses are a table, as no network is at hand: (url, stage, status, body). A fetch tries a site's stages from its
preferred one upwards until a response is a page; every try is told. A walk goes on in rounds, all sites at once: the
frontier's pages are fetched, their cards read, and the next pages that no round has visited yet are the next frontier.
Each round is written, so a lost executor or a restart costs one round.

A walk of a site ends at a page without cards, at one that says it is the last, at one without any new listing, at one
whose known prices all lie below the least wanted (where a site sorts by price), or where no response is a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..storage import written
from .readers import fetch_error

#: Cards of a list page: a link to a listing and all up to the next card.
CARD = r"""(?is)<a[^>]*class=["'][^"']*property-item[^"']*["'][^>]*>.*?</a>"""
HREF = r"""(?is)href=["']([^"']+)["']"""
NEXT = r"""(?is)<a[^>]*rel=["']next["'][^>]*href=["']([^"']+)["']"""
LAST = r"""(?is)<li[^>]*class=["'][^"']*\blast\b[^"']*\bdisabled\b"""
PRICE = r"""(?is)class=["'][^"']*price[^"']*["'][^>]*>([^<]*)<"""


def fetched(requests: DataFrame, responses: DataFrame, most_stage: int = 4) -> tuple[DataFrame, DataFrame]:
    """(pages, tries): for each request (url, domain, preferred) the response of the least stage that gave a page.

    pages: the requests' columns, with stage, body and error_code; a request without any page has the error of its last
    stage, or no_response. tries: url, domain, stage, success, error_code of every stage up to that one.
    """
    error = fetch_error(F.col("status"), F.col("body"))
    known = responses.select("url", "stage", "body", error.alias("error_code"))
    x = requests.join(known, "url", "left").where(F.col("stage").isNull() | ((F.col("stage") >= F.coalesce("preferred", F.lit(0))) & (F.col("stage") <= most_stage)))
    good = F.col("stage").isNotNull() & F.col("error_code").isNull()
    # Bodies go by with min_by, an aggregate; only the chosen one is kept.
    best = x.groupBy("url").agg(
        F.min(F.when(good, F.col("stage"))).alias("_good"),
        F.min_by(F.when(good, F.col("body")), F.when(good, F.col("stage"))).alias("body"),
        F.max("stage").alias("_last"),
        F.max_by("error_code", "stage").alias("_error"),
    )
    stage = F.coalesce("_good", "_last")
    outcome = F.when(F.col("_good").isNotNull(), F.lit(None).cast("string")).otherwise(F.coalesce("_error", F.lit("no_response")))
    best = requests.join(best, "url", "left").select(*requests.columns, stage.cast("int").alias("stage"), "body", outcome.alias("error_code"))
    upto = best.select("url", F.col("stage").alias("_upto"))
    tries = x.where("stage IS NOT NULL").join(upto, "url").where("stage <= _upto").select("url", "domain", F.col("stage").cast("int").alias("stage"), F.col("error_code").isNull().alias("success"), "error_code")
    return best, tries


def cards(body: Column) -> Column:
    """array<struct<url, price>> of the cards of a list page, in its order; a price may be missing."""
    found = F.regexp_extract_all(body, F.lit(CARD), F.lit(0))
    each = F.transform(found, lambda c: F.struct(F.nullif(F.regexp_extract(c, HREF, 1), F.lit("")).alias("url"), C.euro_int(F.nullif(F.regexp_extract(c, PRICE, 1), F.lit(""))).alias("price")))
    return F.filter(each, lambda c: c["url"].isNotNull())


def walk(starts: DataFrame, responses: DataFrame, least_price: int | None = None, most_rounds: int = 10_000, by_price: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seeds, pages, tries) of a walk from starts (domain, url, preferred).

    seeds: domain, url, site_property_id, price of each listing once, with the first page that shows it; those below
    least_price are left out. pages: domain, url, page (from 1), stage, n_cards, error_code of each page visited, once.
    by_price: a site's list descends by price, so a page wholly below least_price ends its walk.
    """
    frontier = written(starts.select("domain", "url", F.coalesce("preferred", F.lit(0)).alias("preferred")).dropDuplicates(["url"]), "frontier")
    visited, shown, told = [], [], []
    for number in range(1, most_rounds + 1):
        if frontier.isEmpty():
            break
        got, tries = fetched(frontier, responses)
        told.append(written(tries, "tries"))
        got = got.withColumn("cards", F.coalesce(cards("body"), F.array().cast("array<struct<url:string,price:bigint>>")))
        got = got.select("domain", "url", "preferred", F.lit(number).alias("page"), "stage", "error_code", "cards", F.nullif(F.regexp_extract("body", NEXT, 1), F.lit("")).alias("next"), F.coalesce(F.col("body").rlike(LAST), F.lit(False)).alias("last"))
        got = written(got, "list-pages")
        visited.append(got.select("domain", "url", "page", "stage", F.size("cards").cast("int").alias("n_cards"), "error_code"))
        own = got.select("domain", F.col("url").alias("list_url"), "page", F.explode("cards").alias("c")).select("domain", "list_url", "page", "c.url", "c.price")
        new = own if not shown else own.join(_union(shown).select("domain", "url"), ["domain", "url"], "left_anti")
        new = written(new, "seeds")
        shown.append(new)
        more = got.where("next IS NOT NULL AND NOT last AND size(cards) > 0").join(new.select(F.col("list_url").alias("url")).distinct(), "url", "left_semi")
        if by_price and least_price is not None:
            more = more.where(~F.forall("cards", lambda c: F.coalesce(c["price"] < least_price, F.lit(False))))
        frontier = more.select("domain", F.col("next").alias("url"), "preferred").dropDuplicates(["url"]).join(_union(visited).select("url"), "url", "left_anti")
        frontier = written(frontier.select("domain", "url", "preferred"), "frontier")
    else:
        raise RuntimeError(f"walks go on after {most_rounds} rounds")
    empty = starts.sparkSession.createDataFrame
    if not visited:
        return empty([], "domain string, url string, site_property_id string, price bigint"), empty([], "domain string, url string, page int, stage int, n_cards int, error_code string"), empty([], "url string, domain string, stage int, success boolean, error_code string")
    first = F.min_by(F.struct("price"), F.struct("page", "list_url")).alias("first")
    seeds = _union(shown).groupBy("domain", "url").agg(first).select("domain", "url", C.url_id(F.col("url")).alias("site_property_id"), "first.price")
    if least_price is not None:
        seeds = seeds.where(F.coalesce(F.col("price") >= least_price, F.lit(True)))
    return seeds, _union(visited), _union(told)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
