"""URL filters: host and path rules, and exact key membership by a cascade of Bloom filters. Built-in functions only.

Level 0 of the cascade encodes the listed keys. Each further level encodes the keys of the other side that all levels so
far let through; the other side is the complete universe of keys. The level that stops a key tells its side, so within
the universe membership is exact, and it is tested by arithmetic on literals: no join.

Lists too long for literals are cut into shards by a hash of the key. Each shard has a cascade of its own, whose words
are a row of a table; the distinct keys of the universe meet their shard's row, and only hosts that turn out to be listed
meet the pages.

Defined results: a null url, and one without "://", has an empty host and path and no rule; an empty host is never
listed; repeated rows are judged each; an empty table gives an empty result; only page_id and url are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Fixed values of the contract: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Hosts that are listed for blocking, with all their subdomains.
LISTED = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
#: Bits of a filter for each key it holds, and the bits that a key sets.
BITS_PER_KEY, HASHES = 12, 6
#: Largest filter in bits that becomes a literal of the plan (8 MB), and bits of a shard's first level beyond that.
MOST_BITS, SHARD_BITS = 1 << 26, 1 << 22

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null. A rule is a host, which fits its subdomains too, and a path's beginning."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        at = rule.index("/")
        own, start = rule[:at], rule[at:]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def suffixes(host: Column) -> Column:
    """A host and the hosts it is a subdomain of; none for an empty host."""
    parts = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits).cast("long")) for i in range(HASHES)]


def _words(text: str) -> Column:
    """A long literal array, folded once by the optimizer."""
    return F.split(F.lit(text), ",").cast("array<bigint>")


@dataclass(frozen=True)
class Cascade:
    """levels: (bits, comma-joined 64-bit words) of each filter, the listed side first."""

    levels: tuple[tuple[int, str], ...]

    def passes(self, key: Column, level: int) -> Column:
        bits, text = self.levels[level]
        words, out = _words(text), F.lit(True)
        for p in _positions(key, level, bits):
            word = F.element_at(words, (F.shiftright(p, 6) + 1).cast("int"))
            out = out & (F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
        return out

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: an odd number of levels lets it through before one stops it."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def bits_for(count: int) -> int:
    """The least power of two that gives each key its bits."""
    return max(64, 1 << (count * BITS_PER_KEY - 1).bit_length()) if count else 64


def _filter(keys: DataFrame, level: int, bits: int) -> tuple[int, str]:
    """A Bloom filter of keys: each set bit is or-ed into its word before the shuffle; the words reach the driver."""
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).collect()
    out = [0] * (bits // 64)
    for r in words:
        out[r.word] = r.bits
    return bits, ",".join(map(str, out))


def sides(listed: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct listed keys, and those of the universe that aren't listed, both written (column key)."""
    listed = written(listed.where("key IS NOT NULL").select("key").distinct(), "listed")
    return listed, written(universe.where("key IS NOT NULL").select("key").distinct().join(listed, "key", "left_anti"), "others")


def cascade(listed: DataFrame, universe: DataFrame, most_levels: int = 64) -> Cascade | None:
    """The cascade for the listed keys (column key) over all keys of universe (column key).

    None if a level would take more than MOST_BITS; then members() gives the same answers.
    """
    inside, outside = sides(listed, universe)
    levels: list[tuple[int, str]] = []
    while len(levels) < most_levels:
        bits = bits_for(inside.count())
        if bits > MOST_BITS:
            return None
        levels.append(_filter(inside, len(levels), bits))
        through = written(outside.where(Cascade(tuple(levels)).passes(F.col("key"), len(levels) - 1)), "through")
        if through.isEmpty():
            return Cascade(tuple(levels))
        inside, outside = through, inside
    raise RuntimeError("the cascade did not end")


def _shard_filter(keys: DataFrame, level: int, shards: int, bits: int) -> DataFrame:
    """(shard, words): a Bloom filter for each shard of keys (key, shard), as a dense array of 64-bit words."""
    at = keys.select("shard", F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("at"))
    words = at.select("shard", F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bits"))
    none = keys.sparkSession.range(shards).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bits // 64 - 1).cast("long"))).alias("word"), F.lit(0).cast("long").alias("bits"))
    dense = words.union(none).groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
    return dense.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def members(listed: DataFrame, universe: DataFrame, most_levels: int = 64) -> DataFrame:
    """The keys of the universe that are listed, told by sharded cascades. No level's size is bounded."""
    shards = max(1, -(-bits_for(listed.count()) // SHARD_BITS))
    shard = F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(shards)).alias("shard")
    inside, outside = (x.select("key", shard) for x in sides(listed, universe))
    open_, found = written(universe.where("key IS NOT NULL").select("key").distinct().select("key", shard), "universe"), []
    for level in range(most_levels):
        bits = bits_for(-(-inside.count() // shards))
        filters = written(_shard_filter(inside, level, shards, bits), "filters")

        def passing(keys: DataFrame) -> DataFrame:
            hit = F.lit(True)
            for p in _positions(F.col("key"), level, bits):
                hit = hit & (F.call_function("shiftrightunsigned", F.element_at("words", (F.shiftright(p, 6) + 1).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
            return keys.join(filters, "shard").select("key", "shard", hit.alias("hit"))

        # A key that this level stops is of the other side than the one it encodes.
        tested = written(passing(open_), "tested")
        if level % 2:
            found.append(tested.where("NOT hit").select("key"))
        open_ = tested.where("hit").select("key", "shard")
        through = written(passing(outside).where("hit").select("key", "shard"), "through")
        if through.isEmpty():
            if level % 2 == 0:
                found.append(open_.select("key"))
            break
        inside, outside = through, inside
    else:
        raise RuntimeError("the cascade did not end")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, listed: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict): the longest rule's verdict, else block for listed hosts and allow for others."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    listed = listed if listed is not None else listed_hosts(spark)
    universe = rows.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("key"))
    built = cascade(listed, universe)
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    by_rule = F.lit(None).cast("string")
    for text, verdict in rules:
        by_rule = F.when(F.col("rule") == text, F.lit(verdict)).otherwise(by_rule)
    if built is None:
        hosts = universe.join(members(listed, universe), "key").select("host").distinct().withColumn("found", F.lit(True))
        rows, found = rows.join(hosts, "host", "left").select("page_id", "host", "path", "found"), F.coalesce("found", F.lit(False))
    else:
        found = F.exists(suffixes(F.col("host")), built.holds)
    return rows.withColumn("rule", rule).withColumn("verdict", F.coalesce(by_rule, F.when(found, "block").otherwise("allow"))).select("page_id", "host", "path", "rule", "verdict")


def listed_hosts(spark: SparkSession, hosts: Sequence[str] = LISTED) -> DataFrame:
    return spark.createDataFrame([(h,) for h in hosts], "key string")
