"""Fetched pages, database dumps, labelled pairs, synonym tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of pages that ask a visitor to wait or to prove something.
WAIT = r"(?i)just a moment|checking your browser|attention required|verify you are human|please wait"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(listings: DataFrame, domain: str | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """Listings of a site; columns left out here aren't read from Parquet."""
    x = listings if domain is None else listings.where(F.col("source_domain") == domain)
    return x.drop(*without)


def with_children(listings: DataFrame, media: DataFrame, history: DataFrame) -> DataFrame:
    """Listings with arrays of their media and price changes, each summed up before the join."""
    m = media.groupBy(F.col("property_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("created_at", "image_url"))).alias("media"))
    h = history.groupBy(F.col("property_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("changed_at", "old_price", "new_price"))).alias("price_history"))
    return listings.join(m, "id", "left").join(h, "id", "left")


def fetch_error(status: Column, body: Column) -> Column:
    """blocked, http_error or empty for a response that is no page, else null."""
    text = F.coalesce(body, F.lit(""))
    json = text.rlike(r"^\s*[\[{]")
    return (
        F.when(status.isin(403, 429, 503), "blocked")
        .when((status == 200) & text.rlike(WAIT) & (F.length(text) < 20_000), "blocked")
        .when(status.isNull() | ~status.isin(200, 201), "http_error")
        .when((F.length(text) < 200) & ~json, "empty")
    )


def attempts(responses: DataFrame) -> DataFrame:
    """A telemetry row for each response; url and error text are cut to 500 characters."""
    error = fetch_error(F.col("status"), F.col("body"))
    return responses.select("domain", F.substring("url", 1, 500).alias("url"), "stage", error.isNull().alias("success"), "duration_ms", error.alias("error_code"), F.substring("error_text", 1, 500).alias("error_text"), "created_at")


def external_match(category: Column, municipality: Column, size: Column, other_category: Column, other_municipality: Column, other_size: Column) -> Column:
    """Whether an outside listing is one to compare with: same category and place, size within 15 per cent."""
    return (category == other_category) & (municipality == other_municipality) & other_size.between(F.floor(size * 0.85), F.floor(size * 1.15))


def dump_statements(text: DataFrame) -> DataFrame:
    """(table, statement) from whole dump files (column value): INSERTs up to their ");", in plain SQL.

    Back quotes go, \\' becomes '', and table names are lower-cased.
    """
    found = F.explode(F.regexp_extract_all("value", F.lit(r"(?ims)^\s*(INSERT INTO .*?\)\s*;)"), F.lit(1)))
    x = text.select(found.alias("raw"))
    plain = F.replace(F.replace(F.col("raw"), F.lit("`"), F.lit("")), F.lit("\\'"), F.lit("''"))
    name = F.lower(F.regexp_extract(plain, r"(?i)INSERT INTO\s+(\w+)", 1))
    return x.select(name.alias("table"), F.concat(F.lit("INSERT INTO "), name, F.regexp_replace(plain, r"(?i)^INSERT INTO\s+\w+", "")).alias("statement"))


def dump_rows(text: DataFrame, n: int = 8) -> DataFrame:
    """The first n fields (c1 ...) of every row of the dump's INSERTs; quotes go, NULL becomes null."""
    field = r"(?:NULL|-?\d+(?:\.\d+)?|'(?:[^'\\]|\\.|'')*')"
    row = r"\(\s*(" + r"\s*,\s*".join([field] * n) + r")\s*(?:,|\))"
    found = F.explode(F.regexp_extract_all("value", F.lit(row), F.lit(1)))
    parts = F.regexp_extract_all(F.col("r"), F.lit(field), F.lit(0))
    x = text.select(found.alias("r")).select(parts.alias("p"))

    def value(i: int) -> Column:
        raw = F.col("p")[i]
        inner = F.replace(F.replace(F.regexp_replace(raw, "^'|'$", ""), F.lit("''"), F.lit("'")), F.lit("\\'"), F.lit("'"))
        return F.when(raw != "NULL", F.when(raw.startswith("'"), inner).otherwise(raw)).alias(f"c{i + 1}")

    return x.select(*map(value, range(n)))


def labelled_pairs(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Pairs of a split from a JSON file {pairs: [...], splits: {name: [ids]}}, by id."""
    raw = spark.read.option("multiLine", True).json(path)
    pairs = raw.select(F.explode("pairs").alias("p"), F.col(f"splits.{split}").alias("ids")).where(F.array_contains("ids", F.col("p.id")))
    return pairs.select("p.*").orderBy("id")


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(alias, canonical) from a JSON map of lists; an alias under two names is an error."""
    raw = spark.read.option("wholetext", True).text(path)
    x = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("canonical", "names"))
    x = x.select("canonical", F.explode("names").alias("alias")).where("alias IS NOT NULL").select(F.lower(F.trim("alias")).alias("alias"), "canonical")
    checked = x.groupBy("alias").agg(F.min("canonical").alias("canonical"), F.max("canonical").alias("_other"))
    return checked.select("alias", F.when(F.col("canonical") == F.col("_other"), F.col("canonical")).otherwise(F.raise_error(F.concat(F.lit("alias under two names: "), F.col("alias")))).alias("canonical"))


def write_results(rows: DataFrame, path: str) -> None:
    """Results as JSON lines, replacing earlier ones."""
    rows.coalesce(1).write.mode("overwrite").json(path)
