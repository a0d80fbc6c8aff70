"""Streams of fetch attempts, listings and price observations."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..config import DEFAULT, Config
from ..functions import matching as M
from ..operators import pairs, scoring


def daily_stage_stats(attempts: DataFrame, late: str = "1 day") -> DataFrame:
    """Attempts by day and stage: successes, failures, mean milliseconds of successes. Rows later than `late` are dropped."""
    by = attempts.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day"), "stage")
    return by.agg(F.count_if(F.col("success")).alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.round(F.avg(F.when(F.col("success"), F.col("duration_ms"))), 4).alias("mean_ms")).select(F.col("window.start").alias("day"), "stage", "ok", "failed", "mean_ms")


def daily_changes(listings: DataFrame, late: str = "1 day") -> DataFrame:
    """Listings by day of their last update and status."""
    by = listings.withWatermark("updated_at", late).groupBy(F.window("updated_at", "1 day"), "status")
    return by.agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "status", "n")


def retained(attempts: DataFrame, days: int = 30) -> DataFrame:
    """Attempts, each once; ids are remembered for `days`, and rows older than that are dropped."""
    return attempts.withWatermark("created_at", f"{days} days").dropDuplicatesWithinWatermark(["id"])


#: State with lists and timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys are dealt over so many groups, each with one state: a call to the store serves many keys and rows.
GROUPS = 512
#: A stored piece holds so many rows at least, if its batch has them, and whole stretches.
PIECE = 1000


class _Fold(StatefulProcessor):
    """Keeps the rows of a group of keys until the watermark has passed their stretch, then folds them in order of time.

    What a batch brings becomes new pieces of whole stretches of event time, so of the waiting rows only pieces that the
    watermark cuts are written again. The carries of a group's keys are one value, written when rows of it are folded.
    One timer a group waits for its earliest stretch's end or its first idle key.
    """

    def __init__(self, columns: list[str], order: str, step: Callable, width_ms: int, idle_ms: int, names: list[str]):
        self.names = names
        self.columns, self.place, self.step, self.width, self.idle = columns, 2 + columns.index(order), step, width_ms, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "least long, part long", "rows binary")
        self.carries = handle.getValueState("carries", "value binary")
        self.plan = handle.getValueState("plan", "timer long, parts long")

    def _stored(self, rows: list[tuple], parts: int) -> int:
        """Keep rows (us, key, columns) as pieces; the number of the next piece."""
        rows.sort(key=lambda r: r[0])
        piece, stretch = [], None
        for r in [*rows, None]:
            at = r and r[0] // 1000 // self.width
            if piece and (r is None or (at != stretch and len(piece) >= PIECE)):
                self.waiting.updateValue((piece[0][0], parts), (pickle.dumps(piece),))
                piece, parts = [], parts + 1
            piece.append(r)
            stretch = at
        return parts

    def _end(self, us: int) -> int:
        return (us // 1000 // self.width + 1) * self.width

    def handleInputRows(self, key, rows, timerValues):
        new = []
        for frame in rows:
            for nulls, us, *values in zip(*(frame[c].tolist() for c in ("nulls", "us", "key", *(f"v{i}" for i in range(len(self.columns))))), strict=True):
                if nulls:
                    values = [None if nulls >> i & 1 else v for i, v in enumerate(values)]
                new.append((us, *(float(v) if isinstance(v, Decimal) else v for v in values)))
        if new:
            timer, parts = self.plan.get() if self.plan.exists() else (None, 0)
            parts = self._stored(new, parts)
            end = self._end(new[0][0])
            if timer is None or end < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(end)
                timer = end
            self.plan.update((timer, parts))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs()
        before = mark // self.width * self.width * 1000
        carries = pickle.loads(self.carries.get()[0]) if self.carries.exists() else {}
        ready, later, least = [], [], []
        for at in [tuple(k) for k in self.waiting.keys()]:
            if at[0] >= before:
                least.append(at[0])
                continue
            for r in pickle.loads(self.waiting.getValue(at)[0]):
                (ready if r[0] < before else later).append(r)
            self.waiting.removeKey(at)
        ready.sort(key=lambda r: (r[0], r[self.place]))
        found = []
        for us, own, *values in ready:
            carry, last = carries.get(own, (None, None))
            if last is not None and us // 1000 - last > self.idle:
                carry = None
            carry, made = self.step(carry, dict(zip(self.columns, values, strict=True)) | {"us": us})
            carries[own] = carry, us // 1000
            if made is not None:
                found.append((own, *made))
        kept = {k: c for k, c in carries.items() if c[1] + self.idle >= mark}
        if kept:
            if ready or len(kept) < len(carries):
                self.carries.update((pickle.dumps(kept),))
        else:
            self.carries.clear()
        parts = self._stored(later, self.plan.get()[1])
        least += [r[0] for r in later[:1]]
        timers = [*(self._end(us) for us in least), *(c[1] + self.idle + 1 for c in kept.values())]
        if timers:
            timer = max(min(timers), mark + 1)
            self.handle.registerTimer(timer)
            self.plan.update((timer, parts))
        else:
            self.plan.clear()
        return iter([pd.DataFrame(found, columns=self.names, dtype=object)] if found else [])

    def close(self) -> None:
        pass


def in_event_time(rows: DataFrame, key: str, at: str, order: str, late: str, step: Callable, out: str, stretch: str = "1 hour", idle: str = "365 days", groups: int = GROUPS) -> DataFrame:
    """A fold over each key's rows in order of (at, order), whatever order and batches they come in.

    Rows wait by stretches of event time until the watermark has passed their stretch's end, so none that comes before
    them can still arrive; rows later than `late` are dropped. step(carry, row) gives (new carry, output row or None);
    row has the columns and `us`, the microseconds of `at`, and gives times back as such; carry starts as None. A key
    without rows for `idle` is forgotten and starts anew. Output rows have the schema `out`, the key first. Keys share
    states by `groups` of their hashes, which must stay the same while a checkpoint is in use.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    columns = [c for c in rows.columns if c not in (key, at)]
    given = T.StructType([T.StructField(f.split()[0], T._parse_datatype_string(f.split(None, 1)[1])) for f in out.split(", ")])
    plain = T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in given])
    ms = lambda x: int(timedelta_of(x).total_seconds() * 1000)
    # Pandas turns whole numbers with nulls into floats, so nulls are marked apart.
    filled = lambda c, t: F.coalesce(c, F.lit(0).cast(t)) if isinstance(t, (T.NumericType, T.BooleanType)) else F.col(c)
    nulls = sum((F.col(c).isNull().cast("long") * 2**i for i, c in enumerate([key, *columns])), F.lit(0).cast("long"))
    group = F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")
    values = [filled(c, rows.schema[c].dataType).alias("key" if c == key else f"v{columns.index(c)}") for c in (key, *columns)]
    marked = rows.withWatermark(at, late).where(F.col(at).isNotNull()).select(group.alias("group"), F.col(at).alias("at"), *values, F.unix_micros(at).alias("us"), nulls.alias("nulls"))
    folded = marked.groupBy("group").transformWithStateInPandas(_Fold(columns, order, step, ms(stretch), ms(idle), plain.names), plain, "append", "eventTime")
    return folded.select(*(F.timestamp_micros(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in given))


def timedelta_of(text: str) -> timedelta:
    """A number and a unit (seconds, minutes, hours, days)."""
    n, unit = text.split()
    return timedelta(**{unit.rstrip("s") + "s": float(n)})


def promotions(attempts: DataFrame, late: str = "1 day", config: Config = DEFAULT, idle: str = "365 days") -> DataFrame:
    """(domain, stage, created_at) whenever a domain reaches the streak of successes at a stage above 0, in event time.

    A streak doesn't outlast a silence longer than `idle`.
    """
    need = config.promotion_streak

    def step(carry, r):
        stage, streak = carry or (-1, 0)
        if not r["success"]:
            return (-1, 0), None
        streak = streak + 1 if r["stage"] == stage else 1
        stage = r["stage"]
        return (stage, streak), (int(stage), r["us"]) if streak == need and stage > 0 else None

    rows = attempts.select("domain", "created_at", "id", "success", "stage")
    return in_event_time(rows, "domain", "created_at", "id", late, step, "domain string, stage int, created_at timestamp", idle=idle)


def price_history(observations: DataFrame, late: str = "1 day", idle: str = "3650 days") -> DataFrame:
    """(id, old_price, new_price, changed_at) of prices that changed, in event time; missing prices are passed over.

    A listing not seen for longer than `idle` begins anew.
    """

    def step(last, r):
        return r["price"], (float(last), float(r["price"]), r["us"]) if last is not None and r["price"] != last else None

    rows = observations.select("id", "seen_at", "price").where("price IS NOT NULL")
    return in_event_time(rows, "id", "seen_at", "price", late, step, "id long, old_price double, new_price double, changed_at timestamp", idle=idle)


def incremental_dedup(new: DataFrame, pool: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Verdicts on pairs of new listings with the pool: a stream-static join on municipality, then the rule scores.

    The pool of a municipality is dealt over parts, as many as its rows need, and new listings are sent to each of them, so
    tasks grow in number and not in size. Pairs that a hard rule tells apart, the most of them by far, are a branch of their
    own, which holds no vectors, similarities and scores.
    """
    columns = ["source_domain", "category", "price", "size_sqm", "bedrooms", "year_built", "embedding", "norm", "canonical_category"]
    new, pool = M.of_listing(new), M.of_listing(pool)
    a = new.where("municipality IS NOT NULL").select(F.col("id").alias("a_id"), "municipality", *(F.col(c).alias(f"a_{c}") for c in columns))
    b = pool.where("municipality IS NOT NULL").select(F.col("id").alias("b_id"), "municipality", *(F.col(c).alias(f"b_{c}") for c in columns))
    pairs_at_most, rows = b.groupBy("municipality").count().agg(F.sum(F.col("count") * F.col("count")), F.max("count")).first()
    parts, keys = -(-(rows or 1) // pairs.BLOCK_ROWS), ["municipality", "_part"]
    share = max(pairs.tasks(b.sparkSession), -(-(pairs_at_most or 0) // pairs.TASK_PAIRS))
    a = a.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(share, *keys)
    b = b.withColumn("_part", F.pmod(F.xxhash64("b_id"), F.lit(parts)).cast("int")).repartition(share, *keys)
    x = a.join(b, keys).where("a_source_domain <> b_source_domain AND a_id <> b_id").withColumn("has_feedback", F.lit(False))
    rule = scoring.hard_rules(config, once=True)
    hard = x.where(rule.isNotNull()).select("a_id", "b_id", F.lit(scoring.DIFFERENT).alias("verdict"), F.lit(1.0).alias("confidence"), rule.alias("reasoning"), F.lit(0).alias("tier"))
    return hard.unionByName(scoring.rule_scores(x.where(rule.isNull()), config).select("a_id", "b_id", "verdict", "confidence", "reasoning", "tier"))


def dedup_into(new: DataFrame, pool: DataFrame, path: str, checkpoint: str, config: Config = DEFAULT):
    """Start the incremental deduplication; verdicts are appended to a Parquet table, exactly once by its own log."""
    return incremental_dedup(new, pool, config).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


