"""Asking an outside model about pairs: bounded concurrency, retries, a budget, costs and latencies, and no question twice.

The budget is shared out before anything is asked: pairs are dealt over parts by a hash, each part gets the share of the
budget that its pairs are of all, and spends it in order of priority. A call is made only while the part has room for the
dearest call that the backend can make, so the sum over all parts stays within the budget wherever the parts run. What a
part can't pay for is reported as over budget and is asked by a later run.

Answers are written once; a later run takes pairs whose cached verdict still holds from the cache. A task that is lost
half-way asks its own pairs again under the same keys, by which a backend with idempotent requests knows them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.matching import pair_key
from ..storage import written
from . import scoring
from .reports import RATES


@dataclass(frozen=True)
class Reply:
    text: str
    tokens_in: int = 0
    tokens_out: int = 0


class Transient(Exception):
    """A failure after which the same question may be asked again."""


#: Asks one question: (key, prompt) to its reply.
Ask = Callable[[str, str], Reply]


@dataclass(frozen=True)
class Limits:
    """Dollars for all calls and for the dearest one; calls at a time in a part; tries, and seconds before the second."""

    budget_usd: float
    most_usd_a_call: float
    concurrency: int = 8
    tries: int = 3
    first_wait: float = 2.0
    parts: int = 16


def reply_cost(reply: Reply, rates: tuple[float, float]) -> float:
    return reply.tokens_in * rates[0] / 1e6 + reply.tokens_out * rates[1] / 1e6


def one_answer(ask: Ask, key: str, prompt: str, limits: Limits, rates: tuple[float, float]) -> tuple:
    """(text, tokens_in, tokens_out, cost_usd, latency_ms, tries, outcome). Tries wait twice as long each time."""
    began = time.monotonic()
    for k in range(1, limits.tries + 1):
        try:
            reply = ask(key, prompt)
            return reply.text, reply.tokens_in, reply.tokens_out, reply_cost(reply, rates), (time.monotonic() - began) * 1000, k, "answered"
        except Transient as e:
            last = str(e)
            if k < limits.tries:
                time.sleep(limits.first_wait * 2 ** (k - 1))
        except Exception as e:  # A bad question stays bad: it is reported, not asked again.
            return str(e), 0, 0, 0.0, (time.monotonic() - began) * 1000, k, "failed"
    return last, 0, 0, 0.0, (time.monotonic() - began) * 1000, limits.tries, "failed"


def asked(questions: DataFrame, ask: Ask, limits: Limits, model: str = "gpt-4o-mini") -> DataFrame:
    """questions (a_id, b_id, prompt, priority) with text, tokens_in, tokens_out, cost_usd, latency_ms, tries, outcome.

    outcome: answered, failed or over budget. The result is written before it is returned, so that nothing is asked again
    however often it is read.
    """
    rates = {name: (i, o) for name, i, o in RATES}[model]
    key = pair_key(F.col("a_id"), F.col("b_id"))
    x = questions.select("a_id", "b_id", "prompt", F.col("priority").cast("double").alias("priority"), key.alias("key"))
    x = written(x.dropDuplicates(["key"]).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(limits.parts)).cast("int")), "questions")
    held = {r.part: r["count"] for r in x.groupBy("part").count().collect()}
    whole = sum(held.values())
    share = {part: limits.budget_usd * n / whole for part, n in held.items()}
    names = ["a_id", "b_id", "text", "tokens_in", "tokens_out", "cost_usd", "latency_ms", "tries", "outcome"]
    ids = questions.schema["a_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        spent: dict[int, float] = {}
        with ThreadPoolExecutor(limits.concurrency) as pool:
            for batch in batches:
                parts, keys, prompts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "key", "prompt"))
                got, at = [], 0
                while at < len(keys):
                    part = parts[at]
                    room = share[part] - spent.get(part, 0.0)
                    n = min(limits.concurrency, int(room / limits.most_usd_a_call + 1e-9)) if limits.most_usd_a_call > 0 else limits.concurrency
                    end = at + 1
                    while end < len(keys) and end - at < max(n, 1) and parts[end] == part:
                        end += 1
                    if n < 1:
                        got.append((None, 0, 0, 0.0, 0.0, 0, "over budget"))
                        at += 1
                        continue
                    wave = list(pool.map(lambda i: one_answer(ask, keys[i], prompts[i], limits, rates), range(at, end)))
                    spent[part] = spent.get(part, 0.0) + sum(w[3] for w in wave)
                    got += wave
                    at = end
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.string())
                yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array([g[k] for g in got], t) for k, t in enumerate(kinds))], names)

    dealt = x.repartition(limits.parts, "part").sortWithinPartitions("part", F.col("priority").desc_nulls_last(), "key")
    out = dealt.mapInArrow(run, f"a_id {ids}, b_id {ids}, text string, tokens_in long, tokens_out long, cost_usd double, latency_ms double, tries int, outcome string")
    return written(out, "answers")


def judged(answers: DataFrame, tier: int = 3) -> DataFrame:
    """Answers with verdict, confidence, reasoning, signals and tier; what wasn't answered is uncertain, with the reason."""
    got = scoring.parsed_answer(F.col("text"))
    ok = F.col("outcome") == "answered"
    x = answers.withColumn("_got", got)
    reason = F.when(ok, F.col("_got.reasoning")).otherwise(F.concat_ws(": ", "outcome", F.substring("text", 1, 200)))
    return x.select(*answers.columns, F.when(ok, F.col("_got.verdict")).otherwise(scoring.UNCERTAIN).alias("verdict"), F.when(ok, F.col("_got.confidence")).otherwise(0.0).alias("confidence"), reason.alias("reasoning"), F.when(ok, F.col("_got.signals")).otherwise(F.array().cast("array<string>")).alias("signals"), F.lit(tier).alias("tier"))


def cache_rows(judgements: DataFrame, pairs: DataFrame, version: str, now: Column, days: int | None = None) -> DataFrame:
    """Rows for the cache of verdicts, of answered pairs alone; pairs has both content hashes."""
    ordered = F.col("a_id") <= F.col("b_id")
    hashes = pairs.select("a_id", "b_id", F.when(ordered, F.col("a_content_hash")).otherwise(F.col("b_content_hash")).alias("a_content_hash"), F.when(ordered, F.col("b_content_hash")).otherwise(F.col("a_content_hash")).alias("b_content_hash"))
    x = judgements.where("outcome = 'answered'").join(hashes.dropDuplicates(["a_id", "b_id"]), ["a_id", "b_id"])
    expires = now + F.make_dt_interval(F.lit(days)) if days is not None else F.lit(None).cast("timestamp")
    return x.select(pair_key(F.col("a_id"), F.col("b_id")).alias("pair_key"), F.lit(version).alias("engine_version"), "a_content_hash", "b_content_hash", "verdict", "confidence", "reasoning", F.col("tier").alias("tier_emitted"), "cost_usd", expires.alias("expires_at"), now.alias("scored_at"))


def ask_open_pairs(pairs: DataFrame, cache: DataFrame, ask: Ask, prompt: Column, priority: Column, limits: Limits, version: str, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts, new cache rows, skipped): cached verdicts where they hold, answers for the rest within the limits.

    skipped: pairs without a content hash on both sides, which can't be cached and aren't asked.
    """
    whole = F.col("a_content_hash").isNotNull() & F.col("b_content_hash").isNotNull()
    hits, misses = scoring.cached(pairs.where(whole), cache, version, now)
    answers = judged(asked(misses.select("a_id", "b_id", prompt.alias("prompt"), priority.alias("priority")), ask, limits))
    columns = ["a_id", "b_id", "verdict", "confidence", "reasoning", "tier"]
    verdicts = hits.select(*columns, F.lit(0.0).alias("cost_usd"), F.lit(0.0).alias("latency_ms"), F.lit("cached").alias("outcome"))
    verdicts = verdicts.unionByName(answers.select(*columns, "cost_usd", "latency_ms", "outcome"))
    return verdicts, cache_rows(answers, misses, version, now), pairs.where(~whole).select("a_id", "b_id")


def rejections(judgements: DataFrame, hashes: DataFrame, existing: DataFrame, now: Column, config: Config = DEFAULT) -> DataFrame:
    """Feedback rows of pairs that a sure answer calls different, so that they aren't proposed again.

    hashes: id, content_hash. Pairs without both hashes, and those that existing feedback has already, get none.
    """
    sure = judgements.where((F.col("verdict") == scoring.DIFFERENT) & (F.col("confidence") >= config.vision_confidence))
    known = hashes.where("content_hash IS NOT NULL")
    a, b = (known.select(F.col("id").alias(f"prop_{s}_id"), F.col("content_hash").alias(f"hash_{s}")) for s in "ab")
    x = sure.select(F.least("a_id", "b_id").alias("prop_a_id"), F.greatest("a_id", "b_id").alias("prop_b_id"), "reasoning").dropDuplicates(["prop_a_id", "prop_b_id"])
    x = x.join(existing.select("prop_a_id", "prop_b_id"), ["prop_a_id", "prop_b_id"], "left_anti").join(a, "prop_a_id").join(b, "prop_b_id")
    text = F.nullif(F.substring(F.trim(F.coalesce("reasoning", F.lit(""))), 1, 1000), F.lit(""))
    return x.select("prop_a_id", "prop_b_id", "hash_a", "hash_b", F.lit("admin_reject").alias("feedback_source"), F.array().cast("array<string>").alias("reason_attributes"), text.alias("reason_text"), now.alias("created_at"))


class AskingBackend:
    """A model as the last tier of scoring.cascade: pairs it has no answer for stay uncertain."""

    def __init__(self, ask: Ask, prompt: Callable[[DataFrame], Column], limits: Limits, priority: Callable[[DataFrame], Column] | None = None):
        self.ask, self.prompt, self.limits, self.priority = ask, prompt, limits, priority

    def score_pairs(self, pairs: DataFrame) -> DataFrame:
        rank = self.priority(pairs) if self.priority else F.lit(0.0)
        got = judged(asked(pairs.select("a_id", "b_id", self.prompt(pairs).alias("prompt"), rank.alias("priority")), self.ask, self.limits))
        return pairs.join(got.select("a_id", "b_id", "verdict", "confidence", "reasoning", "cost_usd", "latency_ms", "outcome"), ["a_id", "b_id"])
