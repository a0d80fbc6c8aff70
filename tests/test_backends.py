"""A seeded stand-in for an outside model: budgets, retries, costs, caches, feedback."""

import json
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parcelyn.operators import backends as A
from parcelyn.operators import scoring as S

KIND = "a_id string, b_id string, a_content_hash string, b_content_hash string, p string, rank double"


def seeded(log):
    """Answers by the key's checksum; one key in seven fails once, one in eleven always, one in thirteen for good."""

    def ask(key, prompt):
        import os

        n = zlib.crc32(key.encode())
        path = f"{log}/{key.replace(':', '-')}"
        with open(path, "a") as f:
            f.write("x")
        tries = os.path.getsize(path)
        if n % 11 == 0 or (n % 7 == 0 and tries == 1):
            raise A.Transient("busy")
        if n % 13 == 0:
            raise ValueError("no such prompt")
        verdict = ("duplicate", "different", "uncertain")[n % 3]
        return A.Reply(json.dumps({"verdict": verdict, "confidence": 0.5 + n % 50 / 100, "reasoning": prompt[:20], "signals": ["s"]}), 1000 + n % 500, 100)

    return ask


def frame(spark, n):
    rows = [(f"p{i:03d}", f"q{i:03d}", f"h{i}" if i % 17 else None, f"g{i}", f"prompt {i}", float(i % 10)) for i in range(n)]
    return spark.createDataFrame(rows, KIND)


def counts(log):
    import os

    return {k: os.path.getsize(f"{log}/{k}") for k in os.listdir(log)}


LIMITS = A.Limits(budget_usd=1.0, most_usd_a_call=0.001, tries=3, first_wait=0.01, concurrency=4, parts=5)
NOW = "2024-05-01"


def empty_cache(spark):
    return spark.createDataFrame([], "pair_key string, engine_version string, a_content_hash string, b_content_hash string, verdict string, confidence double, reasoning string, tier_emitted int, cost_usd double, expires_at timestamp, scored_at timestamp")


def test_a_second_run_asks_nothing_twice(spark, tmp_path):
    ask, now = seeded(str(tmp_path)), F.lit(NOW).cast("timestamp")
    pairs = frame(spark, 200)
    verdicts, cache, skipped = A.ask_open_pairs(pairs, empty_cache(spark), ask, F.col("p"), F.col("rank"), LIMITS, "v1", now)
    rows = {r.a_id: r for r in verdicts.collect()}
    assert len(rows) + skipped.count() == 200 and skipped.count() == 12
    first = counts(tmp_path)
    for r in rows.values():
        n = zlib.crc32(f"{r.a_id}:{r.b_id}".encode())
        asked = first[f"{r.a_id}-{r.b_id}"]
        if n % 11 == 0:
            assert (r.outcome, asked, r.verdict, r.cost_usd) == ("failed", 3, "uncertain", 0.0)
        elif n % 13 == 0:
            assert r.outcome == "failed" and asked == (2 if n % 7 == 0 else 1) and "no such prompt" in r.reasoning
        else:
            assert r.outcome == "answered" and asked == (2 if n % 7 == 0 else 1) and r.verdict == ("duplicate", "different", "uncertain")[n % 3]
            assert r.cost_usd == pytest.approx((1000 + n % 500) * 0.15 / 1e6 + 100 * 0.6 / 1e6) and r.latency_ms > 0 and r.tier == 3
    cache = cache.cache()
    again, more, _ = A.ask_open_pairs(pairs, cache, ask, F.col("p"), F.col("rank"), LIMITS, "v1", now)
    got = Counter(r.outcome for r in again.collect())
    done = [r for r in rows.values() if r.outcome == "answered"]
    assert got["cached"] == len(done) and got["answered"] == 0 and more.count() == 0
    second = counts(tmp_path)
    assert all(second[f"{r.a_id}-{r.b_id}"] == first[f"{r.a_id}-{r.b_id}"] for r in done)
    # Another version, and a changed text, are asked again.
    other = pairs.withColumn("b_content_hash", F.when(F.col("a_id") == done[0].a_id, "new").otherwise(F.col("b_content_hash")))
    changed, _, _ = A.ask_open_pairs(other, cache, ask, F.col("p"), F.col("rank"), LIMITS, "v1", now)
    assert [r.a_id for r in changed.where("outcome = 'answered'").collect()] == [done[0].a_id]


@pytest.mark.parametrize("budget", [0.0, 0.004, 0.02])
def test_the_budget_holds_in_all_parts(spark, tmp_path, budget):
    limits = A.Limits(budget_usd=budget, most_usd_a_call=0.0003, tries=3, first_wait=0.0, concurrency=3, parts=4)
    questions = frame(spark, 150).select("a_id", "b_id", F.col("p").alias("prompt"), F.col("rank").alias("priority"))
    got = A.asked(questions.union(questions.limit(20)), seeded(str(tmp_path)), limits)
    rows = got.collect()
    assert len(rows) == 150 and sum(r.cost_usd for r in rows) <= budget
    out = Counter(r.outcome for r in rows)
    assert out["over budget"] > 0 and (budget == 0) == (out["answered"] == 0)
    assert set(counts(tmp_path)) == {f"{r.a_id}-{r.b_id}" for r in rows if r.outcome != "over budget"}
    rank = {f"p{i:03d}": i % 10 for i in range(150)}
    if out["answered"]:
        mean = lambda o: sum(rank[r.a_id] for r in rows if (r.outcome == "over budget") == o) / max(1, sum((r.outcome == "over budget") == o for r in rows))
        assert mean(False) > mean(True)
    before = counts(tmp_path)
    got.count()
    assert counts(tmp_path) == before


def test_last_tier_of_the_cascade_and_feedback(spark, tmp_path):
    from parcelyn.plans.catalogue import blocked
    from parcelyn.plans.listings import SCALED

    pairs = blocked(spark, "/root/testdata/sf0.001")
    backend = A.AskingBackend(seeded(str(tmp_path)), lambda df: F.concat(F.lit("same? "), F.col("a_id")), LIMITS)
    rows = S.cascade(pairs, last=backend, config=SCALED).collect()
    last = [r for r in rows if r.tier == 3]
    assert len(rows) == pairs.count() and len(last) == len(counts(tmp_path)) > 0
    judged = spark.createDataFrame([("b", "a", "different", 0.9, "other house"), ("a", "c", "different", 0.79, ""), ("a", "d", "different", 0.95, " "), ("a", "e", "duplicate", 0.95, ""), ("a", "f", "different", 1.0, ""), ("c", "d", "different", 0.8, "")], "a_id string, b_id string, verdict string, confidence double, reasoning string")
    hashes = spark.createDataFrame([(x, None if x == "f" else f"h{x}") for x in "abcdef"], "id string, content_hash string")
    existing = spark.createDataFrame([("c", "d")], "prop_a_id string, prop_b_id string")
    got = A.rejections(judged, hashes, existing, F.lit(NOW).cast("timestamp")).collect()
    assert sorted((r.prop_a_id, r.prop_b_id, r.hash_a, r.hash_b, r.reason_text) for r in got) == [("a", "b", "ha", "hb", "other house"), ("a", "d", "ha", "hd", None)]
