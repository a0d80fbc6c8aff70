"""Aggregates and reports: quality, stages, costs, evaluation, status, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

#: Dollars for a million tokens (in, out) by model, and for a vision call.
RATES = (("gpt-4o-mini", 0.15, 0.60), ("gpt-4o", 2.50, 10.00), ("text-embedding-3-small", 0.02, 0.0), ("text-embedding-3-large", 0.13, 0.0))
VISION_CALL = 0.011


def stock_photos(listings: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(phash, n_listings) of photos that too many listings show."""
    each = listings.select("id", F.explode(F.array_distinct("image_phashes")).alias("phash")).where("phash <> ''")
    return each.groupBy("phash").agg(F.countDistinct("id").alias("n_listings")).where(F.col("n_listings") > config.stock_photo_listings)


def quality_metrics(listings: DataFrame, by: str = "source_domain") -> DataFrame:
    """Listings, mean length of descriptions, and per cent (rounded) with five features or more, and with a price."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)) * 100).cast("int")
    return listings.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(F.length("description")), 4).alias("mean_length"), share(F.coalesce(F.col("n_features"), F.lit(0)) >= 5).alias("features_pct"), share(F.coalesce(F.col("price"), F.lit(0)) > 0).alias("price_pct"))


def domain_status(listings: Column, features_pct: Column, price_pct: Column, blocked: Column, error: Column, config: Config = DEFAULT) -> Column:
    return (
        F.when(blocked & error, "CLOUDFLARE")
        .when(error, "CRITICAL")
        .when((listings == 0) | (features_pct < config.features_ok) | (price_pct < config.price_ok), "WARNING")
        .otherwise("OK")
    )


def walled_off(found: Column, active: Column, least: int = 50) -> Column:
    """Nothing found where many are known: the site shuts us out."""
    return (found == 0) & (active >= least)


def stage_stats(attempts: DataFrame, since: Column | None = None) -> DataFrame:
    """Fetch attempts by stage: successes, failures and the mean milliseconds of successes."""
    x = attempts if since is None else attempts.where(F.col("created_at") >= since)
    return x.groupBy("stage").agg(F.count_if(F.col("success")).alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.round(F.avg(F.when(F.col("success"), F.col("duration_ms"))), 4).alias("mean_ms"))


def cluster_stats(clusters: DataFrame, since: Column) -> DataFrame:
    new = F.col("created_at") >= since
    return clusters.agg(F.count_if(new).alias("created"), F.count_if(new & (F.col("status") == "APPROVED")).alias("approved"), F.count_if(new & (F.col("status") == "PENDING")).alias("pending"), F.count_if(F.coalesce("verdict_locked", F.lit(False))).alias("locked"))


def token_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars; 0 for an unknown model."""
    out = F.lit(0.0)
    for name, i, o in RATES:
        out = F.when(model == name, tokens_in * i / 1e6 + tokens_out * o / 1e6).otherwise(out)
    return out


def cost_snapshot(usage: DataFrame) -> DataFrame:
    """Calls, failures, tokens and dollars by kind (llm, vision, embedding). A failed call costs nothing."""
    tokens = token_cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out"))
    cost = F.when(~F.col("success"), 0.0).when(F.col("kind") == "vision", VISION_CALL).otherwise(tokens)
    return usage.groupBy("kind").agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failed"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum(cost), 6).alias("cost_usd"))


def evaluation(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Precision, recall, F1 and coverage of verdicts (verdict, truth). Abstentions lower recall and coverage.

    A missing verdict is an abstention. Precision is 0 without positive verdicts.
    """
    v, t = F.coalesce("verdict", F.lit("uncertain")), F.col("truth")
    counts = {
        "n": F.count("*"),
        "tp": F.count_if((v == "duplicate") & (t == "duplicate")),
        "fp": F.count_if((v == "duplicate") & (t != "duplicate")),
        "tn": F.count_if((v == "different") & (t == "different")),
        "fn": F.count_if((v == "different") & (t == "duplicate")),
        "uncertain": F.count_if(v == "uncertain"),
        "positives": F.count_if(t == "duplicate"),
    }
    x = (scored.groupBy(by) if by else scored.groupBy()).agg(*(c.alias(k) for k, c in counts.items()))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    x = x.withColumns({"precision": zero(F.col("tp"), F.col("tp") + F.col("fp")), "recall": zero(F.col("tp"), F.col("positives"))})
    x = x.withColumns({"f1": zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "coverage": zero(F.col("n") - F.col("uncertain"), F.col("n"))})
    return x.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "coverage")})


def evaluation_costs(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Pairs with their dollars and latencies (verdict, cost_usd, latency_ms): sums, means, and seconds a thousand pairs."""
    cost, ms = F.coalesce("cost_usd", F.lit(0.0)), F.coalesce("latency_ms", F.lit(0.0))
    x = (scored.groupBy(by) if by else scored.groupBy()).agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum(cost), F.lit(0.0)), 6).alias("cost_usd"), F.coalesce(F.sum(ms), F.lit(0.0)).alias("total_ms"))
    mean = F.coalesce(F.try_divide("total_ms", "n"), F.lit(0.0))
    return x.withColumns({"mean_ms": F.round(mean, 1), "seconds_per_1000": F.round(mean, 2), "total_ms": F.round("total_ms", 1)})


def calibrated_thresholds(predictions: DataFrame, least_precision: float = 0.95, step: float = 0.05) -> DataFrame:
    """(low, high, coverage, precision): of all grids low <= high the one that covers most at the wanted precision.

    Predictions (p, truth) are counted into the grid's cells first, so the grid meets few rows whatever their number.
    """
    cells = round(1 / step)
    # Rounding keeps values on a grid line on its upper side.
    cell = F.least(F.floor(F.round(F.col("p") / step, 9)), F.lit(cells)).cast("int")
    counts = predictions.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.count_if(F.col("truth") == "duplicate").alias("pos"))
    grid = predictions.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(cells))).alias("low"))
    grid = grid.withColumn("high", F.explode(F.sequence(F.greatest(F.col("low"), F.lit(cells // 2)), F.lit(cells))))
    x = F.broadcast(grid).join(counts).groupBy("low", "high").agg(
        F.sum(F.when(F.col("cell") >= F.col("high"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("cell") >= F.col("high"), F.col("n")).otherwise(0)).alias("called"),
        F.sum(F.when((F.col("cell") >= F.col("high")) | (F.col("cell") < F.col("low")), F.col("n")).otherwise(0)).alias("decided"),
        F.sum("n").alias("n"),
    )
    x = x.withColumns({"precision": F.coalesce(F.try_divide("tp", "called"), F.lit(0.0)), "coverage": F.col("decided") / F.col("n")})
    best = x.where(F.col("precision") >= least_precision).agg(F.max_by(F.struct("low", "high", "coverage", "precision"), F.struct("coverage", -F.col("low"), -F.col("high"))).alias("b"))
    return best.where("b IS NOT NULL").select((F.col("b.low") * step).alias("low"), (F.col("b.high") * step).alias("high"), "b.coverage", "b.precision")


def promotion_streaks(attempts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(domain, stage, longest): runs of successes at one stage; promoted when one is long enough. Gaps and islands."""
    w = Window.partitionBy("domain").orderBy("created_at", "id")
    x = attempts.withColumn("_broken", F.sum(F.when(~F.col("success") | ~F.col("stage").eqNullSafe(F.lag("stage").over(w)), 1).otherwise(0)).over(w))
    runs = x.where("success").groupBy("domain", "_broken").agg(F.count("*").alias("n"), F.min("stage").alias("stage"))
    best = runs.groupBy("domain", "stage").agg(F.max("n").alias("longest"))
    return best.withColumn("promoted", (F.col("longest") >= config.promotion_streak) & (F.col("stage") > 0))


def price_report(listings: DataFrame, media: DataFrame, history: DataFrame) -> DataFrame:
    """Listings with their number of photos and a text of price changes, newest price first; each side summed up first."""
    photos = media.groupBy(F.col("property_id").alias("id")).agg(F.countDistinct("image_url").alias("n_photos"))
    line = F.concat(F.date_format("changed_at", "yyyy-MM-dd"), F.lit(": "), F.col("old_price").cast("string"), F.lit(" -> "), F.col("new_price").cast("string"))
    changes = history.groupBy(F.col("property_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(line)), " | ").alias("history"))
    return listings.join(photos, "id", "left").join(changes, "id", "left").withColumn("n_photos", F.coalesce("n_photos", F.lit(0))).orderBy(F.col("price").desc_nulls_last(), "id")


def reviews(clusters: DataFrame, status: str, version: str, limit: int = 50) -> DataFrame:
    """The newest clusters of two or more with a status."""
    return clusters.where((F.col("status") == status) & (F.col("engine_version") == version) & (F.col("member_count") >= 2)).orderBy(F.col("created_at").desc(), "id").limit(limit)


def agent_report(agents: DataFrame, tokens: DataFrame, devices: DataFrame) -> DataFrame:
    used = tokens.groupBy("agent_id").agg(F.count_if(F.col("used")).alias("tokens_used"))
    own = devices.groupBy("agent_id").agg(F.count("*").alias("devices"))
    x = agents.join(used, "agent_id", "left").join(own, "agent_id", "left")
    return x.withColumns({"tokens_used": F.coalesce("tokens_used", F.lit(0)), "devices": F.coalesce("devices", F.lit(0))})


#: Marks a text file as UTF-8 for spreadsheet programs.
BYTE_ORDER_MARK = "\ufeff"


def write_agents(report: DataFrame, path: str) -> None:
    """Rows behind a header, with semicolons; every file begins with a byte order mark in its first column's name."""
    first, *rest = report.columns
    report.select(F.col(first).alias(BYTE_ORDER_MARK + first), *rest).write.option("sep", ";").option("header", True).csv(path)


def valid_tokens(tokens: DataFrame, agents: DataFrame, now: Column) -> DataFrame:
    return tokens.where(~F.col("used") & (F.col("expires_at") > now)).join(agents.where("is_active").select("agent_id"), "agent_id", "left_semi")


def of_day(listings: DataFrame, day: Column) -> DataFrame:
    """Listings made or changed on a day, dearest first; those without a price come before all others."""
    hit = (F.to_date("created_at") == day) | (F.to_date("updated_at") == day)
    return listings.where(F.coalesce(hit, F.lit(False))).orderBy(F.col("price").desc_nulls_first(), "id")


def domain_totals(domains: DataFrame) -> DataFrame:
    """One row over all domains (status and counts): domains by status and the sums of what was found."""
    status = F.col("status")
    sums = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("listings_found", "new_count", "delisted_count", "revived_count", "price_changed")}
    counts = {"ok": F.count_if(status == "OK"), "warning": F.count_if(status == "WARNING"), "critical": F.count_if(status.isin("CRITICAL", "CLOUDFLARE"))}
    return domains.agg(*(c.cast("long").alias(k) for k, c in (counts | sums).items()))


def refresh_summary(outcomes: DataFrame) -> DataFrame:
    """Counters over refreshed listings: ok, new_images, extras_added, fields_patched (arrays) and n_media before.

    What a failed listing reports counts for nothing but its error.
    """
    ok, none = F.col("ok"), F.col("n_media") == 0
    size = lambda c: F.coalesce(F.sum(F.when(ok, F.greatest(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))), F.lit(0)))), F.lit(0))
    counters = {
        "total": F.count("*"),
        "ok": F.count_if(ok),
        "errors": F.count_if(~ok),
        "new_images_total": F.coalesce(F.sum(F.when(ok, F.col("new_images"))), F.lit(0)),
        "extras_added_total": size("extras_added"),
        "had_zero_media": F.count_if(ok & none),
        "rescued_from_zero": F.count_if(ok & none & (F.col("new_images") > 0)),
        "columns_patched_total": size("fields_patched"),
    }
    return outcomes.agg(*(c.cast("long").alias(k) for k, c in counters.items()))


def due_reports(listings: DataFrame) -> DataFrame:
    return listings.where(F.col("status").isin("NEW", "PRICE_CHANGED"))


def after_delivery(listings: DataFrame, delivered: DataFrame) -> DataFrame:
    """Reported listings become active if at least one report went out (delivered: a row for each)."""
    any_ = delivered.agg((F.count("*") > 0).alias("_any"))
    x = listings.join(F.broadcast(any_))
    return x.withColumn("status", F.when(F.col("_any") & F.col("status").isin("NEW", "PRICE_CHANGED"), "ACTIVE").otherwise(F.col("status"))).drop("_any")


# --- texts of reports ------------------------------------------------------------------------------------------------


def duration_text(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def money_text(usd: Column) -> Column:
    """More decimals for smaller sums."""
    return F.when(usd == 0, "$0").when(usd < 0.01, F.format_string("$%.4f", usd)).when(usd < 1, F.format_string("$%.3f", usd)).otherwise(F.format_string("$%.2f", usd))


def spaced_thousands(n: Column) -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))


def euro_text(price: Column) -> Column:
    return F.when(price.isNull(), "—").otherwise(F.concat(F.lit("€"), F.replace(F.format_number(price, 0), F.lit(","), F.lit("."))))


def local_time(utc: Column, zone: str = "Europe/Athens", form: str = "dd/MM/yyyy HH:mm") -> Column:
    return F.date_format(F.from_utc_timestamp(utc, zone), form)


def age_colour(created: Column, now: Column) -> Column:
    days = (now.cast("double") - created.cast("double")) / 86400
    return F.when(days < 2, "green").when(days < 7, "yellow").otherwise("red")
