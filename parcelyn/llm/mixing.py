"""Mixing sources to target weights with exact block quotas and a multivariate-hypergeometric splitting tree.

A keyed hash puts each document at a place on its source's line; equal stretches of the hash are the source's blocks,
so their order is a random permutation. The mix runs over a source's line as often as its target holds its size and
then over a part of it: a source's block quota is the number of blocks it draws in all runs. The splitting tree halves
the output shards and draws each half's quota of every source without replacement, down to single shards, whose block
ranges are disjoint. Its top is split on the driver, the subtrees in tasks, and the shards' ranges of draws are a table.
A document is taken by the shards in whose ranges its draws lie. Rows of a shard are ordered by a second hash.

Where a line is left is found digit by digit from sums over the hash's digits, so no source is ever sorted whole. The
document at that place gives only the words that are still due, which makes every source's words exact.

Defined results: null text has no words; a null source is one source, the last; a null doc_id is a value like others;
rows that repeat a doc_id share a place, and if the line is left there, give equal parts (rounded down); an empty table
gives an empty result; only doc_id, source and text are read to decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_name, quoted, written

#: Fixed value: a word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash, of the digit that a round of the search decides, and of a source's block numbers.
HASH_BITS, DIGIT_BITS, BLOCK_BITS = 60, 10, 16
BLOCKS = 1 << BLOCK_BITS
#: Shards grow in number so that one has about so many words; a task splits a subtree of so many shards.
SHARD_WORDS, SUBTREE = 1 << 25, 1 << 10
#: Rows of the shards' ranges up to which their table (about 40 bytes each) is broadcast.
SMALL_TABLE = 1 << 20
#: Fixed value: the library draws from fewer blocks than this.
LIBRARY_DRAWS = 10**9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _place(source: Column, doc_id: Column, seed: int) -> Column:
    """60 bits of MD5 over seed, source and doc_id."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(source, F.lit("")), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds weight and target to (source, source_size): `share` of all sizes by weight, each at most `most` sizes.

    Filling up: sources in order of most * size / weight are full while the rest's level by weight is above that.
    One row for each source meets in one task; sources, not documents, are counted here.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "rank")
    at = F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1
    x = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), at.cast("int")))
    x = x.withColumn("most", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("most") / F.col("weight"))
    x = x.withColumn("due", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    x = x.withColumn("before", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    x = x.withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("level", (F.col("due") - F.col("before")) / F.col("left"))
    x = x.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank"))).over(Window.partitionBy()))
    return x.select("source", "source_size", "rank", "weight", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def _digit(place: Column, level: int) -> Column:
    return F.pmod(F.shiftright(place, HASH_BITS - DIGIT_BITS * (level + 1)), F.lit(1 << DIGIT_BITS))


def _block(place: Column) -> Column:
    return F.shiftright(place, HASH_BITS - BLOCK_BITS)


def hypergeometric(good: int, bad: int, taken: int, rng: np.random.Generator) -> int:
    """How many of `taken` draws without replacement are good, for any numbers: by inversion around the mode.

    Weights follow from the ratios of neighbouring ones within 40 standard deviations, beyond which they vanish in doubles.
    """
    low, high, total = max(0, taken - bad), min(good, taken), good + bad
    spread = 40 * (math.sqrt(taken / total * (good / total) * bad * ((total - taken) / max(total - 1, 1))) + 1) if total else 0
    mode = min(max((taken + 1) * (good + 1) // (total + 2), low), high)
    first, last = max(low, mode - int(spread)), min(high, mode + int(spread))
    up = np.arange(mode, last, dtype=np.float64)
    down = np.arange(mode, first, -1, dtype=np.float64)
    above = np.cumsum(np.log(good - up) + np.log(taken - up) - np.log(up + 1) - np.log(bad - taken + up + 1))
    below = np.cumsum(np.log(down) + np.log(bad - taken + down) - np.log(good - down + 1) - np.log(taken - down + 1))
    sums = np.cumsum(np.exp(np.concatenate([below[::-1], [0.0], above])))
    return first + int(np.searchsorted(sums, rng.random() * sums[-1], "right"))


def without_replacement(own: np.ndarray, taken: int, rng: np.random.Generator) -> np.ndarray:
    """How many of `taken` draws fall on each source. Sources are halved while they hold more than the library draws from."""
    total = int(own.sum())
    if not total or len(own) == 1:
        return np.full(len(own), taken, np.int64) if total else own
    if total < LIBRARY_DRAWS:
        return rng.multivariate_hypergeometric(own, taken, method="marginals")
    middle = len(own) // 2
    left = int(own[:middle].sum())
    n = hypergeometric(left, total - left, taken, rng)
    return np.concatenate([without_replacement(own[:middle], n, rng), without_replacement(own[middle:], taken - n, rng)])


def halve(own: np.ndarray, low: int, high: int, leaf: int, seed: int, ends) -> Iterator[tuple[int, int, np.ndarray]]:
    """(low, high, block quota of each source) of the nodes with `leaf` shards at most below the node [low, high).

    Each half draws its number of blocks from the node's without replacement. A node's generator comes from the seed
    and the node's place, so that it gives the same wherever it is split.
    """
    if high - low <= leaf:
        yield low, high, own
        return
    middle = (low + high) // 2
    rng = np.random.default_rng([seed, low, high])
    first = without_replacement(own, ends(middle) - ends(low), rng)
    yield from halve(first, low, middle, leaf, seed, ends)
    yield from halve(own - first, middle, high, leaf, seed, ends)


def even_ends(total: int, shards: int):
    """Blocks of all shards before a given one: each gets its equal share."""
    return lambda k: total * k // shards


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources: each source's block quota, split by a tree of multivariate hypergeometric draws."""
    own = quotas.astype(np.int64)
    nodes = halve(own, 0, shards, 1, seed, even_ends(int(own.sum()), shards))
    return np.array([x for _, _, x in nodes], np.int64).reshape(shards, len(own))


def shard_ranges(spark: SparkSession, quotas: list[int], shards: int, seed: int) -> DataFrame:
    """(rank, shard, first, last): the draws [first, last) of the source of that rank that each shard takes."""
    own, total = np.array(quotas, np.int64), int(sum(quotas))
    heads = [(low, high, [int(k) for k in np.flatnonzero(x)], [int(v) for v in x[x > 0]]) for low, high, x in halve(own, 0, shards, SUBTREE, seed, even_ends(total, shards))]

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            for low, high, at, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.array(at, np.int64)
                for shard, _, x in halve(np.array(held, np.int64), low, high, 1, seed, even_ends(total, shards)):
                    some = np.flatnonzero(x)
                    yield pa.record_batch([pa.array((at[some] + 1).astype(np.int32)), pa.array(np.full(len(some), shard, np.int32)), pa.array(x[some])], ["rank", "shard", "draws"])

    rows = spark.createDataFrame(heads, "low int, high int, at array<int>, held array<long>")
    if len(heads) > 1:
        rows = rows.repartition(len(heads))
    last = F.sum("draws").over(Window.partitionBy("rank").orderBy("shard"))
    return rows.mapInArrow(split, "rank int, shard int, draws long").select("rank", "shard", (last - F.col("draws")).alias("first"), last.alias("last"))


def plan(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, shards: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(sizes, decisions, ranges, shards). sizes: row, doc_id, source, size and place of each row. decisions: one a source.

    decisions has target, runs (whole passes), stop (the place where the last pass ends), part (words of each row at
    that place), quota (block draws) and width (draws of one cell). ranges: each shard's draws of each source, by the
    cells that they touch. Without a number of shards it follows the words drawn.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    sizes = written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"), _place(F.col("source"), F.col("doc_id"), seed).alias("place")), "sizes")
    by_source = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.round("target").cast("long")
    by_source = by_source.withColumn("runs", F.coalesce(F.expr("try_divide(round(target), source_size)").cast("long"), F.lit(0).cast("long")))
    state = by_source.select("source", "source_size", "rank", "target", "runs", (whole - F.col("runs") * F.col("source_size")).alias("due"), F.lit(0).cast("long").alias("prefix"), F.lit(2).cast("long").alias("rows"))
    state, done = written(state, "state"), 0
    for level in range(HASH_BITS // DIGIT_BITS):
        if state.where("rows > 1").isEmpty():
            break
        own = state.select(F.struct("source").alias("key"), "due", "prefix")
        inside = F.shiftright("place", HASH_BITS - DIGIT_BITS * level) == F.col("prefix") if level else F.lit(True)
        live = sizes.select(F.struct("source").alias("key"), "size", "place").join(own, "key").where(inside)
        sums = live.groupBy("key", _digit(F.col("place"), level).alias("digit")).agg(F.sum("size").alias("words"), F.when(F.min("place") < F.max("place"), 2).otherwise(1).alias("rows"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("before", before).join(own.select("key", "due"), "key").where("words > 0 AND before <= due AND due < before + words")
        found = sums.select("key", "digit", "before", F.col("rows").alias("found"))
        new = state.withColumn("key", F.struct("source")).join(found, "key", "left")
        new = new.select("source", "source_size", "rank", "target", "runs", (F.col("due") - F.coalesce("before", F.lit(0))).alias("due"), (F.col("prefix") * (1 << DIGIT_BITS) + F.coalesce("digit", F.lit(0))).alias("prefix"), F.coalesce("found", F.lit(0)).cast("long").alias("rows"))
        state = written(new, "state")
        done = level + 1
    shift = HASH_BITS - DIGIT_BITS * done
    at_stop = F.shiftright("place", shift) == F.col("prefix")
    own = state.select(F.struct("source").alias("key"), "prefix")
    stops = sizes.select(F.struct("source").alias("key"), "size", "place").join(own, "key").where(at_stop).groupBy("key").agg(F.max("place").alias("stop"), F.count("*").alias("sharing"))
    state = state.withColumn("key", F.struct("source")).join(stops, "key", "left")
    state = state.withColumn("stop", F.coalesce("stop", F.lit(-1).cast("long"))).withColumn("part", F.coalesce(F.expr("due div sharing"), F.lit(0).cast("long")))
    state = state.withColumn("quota", F.when(F.col("source_size") > 0, F.col("runs") * BLOCKS + _block(F.greatest("stop", F.lit(0).cast("long"))) + 1).otherwise(0))
    # The quotas, a number for each source, reach the driver, as each node of the tree draws from all sources.
    quotas = state.select("rank", "quota", "target").orderBy("rank").collect()
    spark = docs.sparkSession
    if shards is None:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(sum(r.target for r in quotas)) // SHARD_WORDS)
    state = state.withColumn("width", F.greatest(F.ceil(F.col("quota") / shards), F.lit(1)).cast("long"))
    decisions = written(state.select("source", "source_size", "rank", "target", "runs", "stop", "part", "width").coalesce(1), "decisions")
    ranges = shard_ranges(spark, [r.quota for r in quotas], shards, seed).join(decisions.select("rank", "width"), "rank")
    cells = F.sequence(F.expr("first div width"), F.expr("(last - 1) div width"))
    # Both are written, so that their sizes are known when they are joined.
    ranges = written(ranges.select("rank", F.explode(cells).alias("cell"), "shard", "first", "last"), "ranges")
    return sizes, decisions, ranges, shards


def _drawn(rows: DataFrame, decisions: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows (key: struct<source>, size, place, others) with copy, words, shard of each copy that a shard takes.

    A row that no shard takes stays once, without a shard and with no words.
    """
    small = decisions.withColumn("key", F.struct("source")).drop("source")
    x = rows.join(small, "key")
    last = F.when(F.col("place") < F.col("stop"), F.col("size")).when(F.col("place") == F.col("stop"), F.least("part", "size")).otherwise(0)
    x = x.withColumn("due", last.cast("long"))
    passes = F.col("runs") + F.when(F.col("due") > 0, 1).otherwise(0)
    copies = F.when(passes > 0, F.sequence(F.lit(0).cast("long"), passes - 1))
    x = x.withColumn("copy", F.explode_outer(copies))
    x = x.withColumn("draw", F.col("copy") * BLOCKS + _block(F.col("place"))).withColumn("cell", F.expr("draw div width"))
    if ranges.count() <= SMALL_TABLE:
        ranges = F.broadcast(ranges)
    x = x.alias("x").join(ranges.alias("r"), F.expr("x.rank = r.rank AND x.cell = r.cell AND r.first <= x.draw AND x.draw < r.last"), "left")
    words = F.when(F.col("r.shard").isNull(), 0).when(F.col("copy") < F.col("runs"), F.col("size")).otherwise(F.col("due"))
    return x.select(*(F.col(f"x.{c}") for c in rows.columns if c != "key"), "source_size", "target", "copy", words.cast("long").alias("words"), "r.shard")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards): words that the shards take of each row, and these shards.

    shards has shard, copy, block and words of each copy.
    """
    sizes, decisions, ranges, _ = plan(docs, **settings)
    x = _drawn(sizes.select("row", "doc_id", "size", "place", F.struct("source").alias("key")), decisions, ranges)
    one = F.when(F.col("shard").isNotNull(), F.struct("shard", F.col("copy").cast("int").alias("copy"), _block(F.col("place")).cast("int").alias("block"), "words"))
    by_row = x.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(one)).alias("shards"))
    return by_row.drop("row")


def draw(docs: DataFrame, seed: int = 7, **settings) -> DataFrame:
    """The mix itself: rows of docs, once for each copy taken, dealt by shard and shuffled within it.

    A row at the place where a source's last pass ends keeps only the words that are due, with the white space before
    them. Columns and their order are those of docs.
    """
    _, decisions, ranges, shards = plan(docs, seed=seed, **settings)
    columns = docs.columns
    tmp = fresh_name(docs, "mixing")
    text, doc_id = (next(c for c in columns if c.lower() == k) for k in ("text", "doc_id"))
    source = next(c for c in columns if c.lower() == "source")
    row = docs.select(F.struct(*map(quoted, columns)).alias(tmp))
    x = row.select(tmp, n_words(F.col(tmp)[text].cast("string")).alias("size"), _place(F.col(tmp)[source].cast("string"), F.col(tmp)[doc_id].cast("long"), seed).alias("place"), F.struct(F.col(tmp)[source].cast("string").alias("source")).alias("key"))
    x = _drawn(x, decisions, ranges).where("shard IS NOT NULL")
    due = F.array_join(F.slice(F.regexp_extract_all(F.col(tmp)[text], F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.col("words").cast("int")), "")
    cut = F.when(F.col("words") < F.col("size"), due).otherwise(F.col(tmp)[text])
    x = x.select(F.struct(*(cut.alias(c) if c == text else F.col(tmp)[c].alias(c) for c in columns)).alias(tmp), "shard", F.xxhash64("place", "copy").alias("order"))
    return x.repartitionById(shards, "shard").sortWithinPartitions("order").select(*(F.col(tmp)[c].alias(c) for c in columns))
