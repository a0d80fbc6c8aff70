"""Clusters that grow with new listings: components kept as tables and merged by new edges alone.

State is three keyed tables, switched together: the pool of listings, `nodes` (node, root as of the batch that brought it)
and `roots` (root, current) of roots that later edges have merged into others. A batch maps its edges' ends to their
current roots, finds the components of these few roots, and writes its own nodes and the roots that moved. Nodes of earlier
batches are never rewritten, so a batch costs what its listings, their edges and the roots they touch cost. Verdicts are a
log to which a batch appends its own; the pairs of listings that came again are told apart when the log is read.

A batch has a number. One that is in the state already is passed over, so a stream that repeats its last batch after a
failure changes nothing. New listings meet each other and the pool.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import matching as M
from ..storage import Tables, latest, written
from . import scoring
from .graph import components
from .pairs import dealt_join

#: What the rules compare; places and areas where listings have them.
COLUMNS = ["source_domain", "category", "price", "size_sqm", "bedrooms", "year_built", "embedding", "lat", "lng", "area"]


def scored_with_pool(new: DataFrame, pool: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(a_id, b_id, verdict, confidence, reasoning, tier), a_id < b_id, of pairs of new listings with each other and with
    the pool: one municipality, different sources.

    pool must not hold the new listings. Listings of both are dealt over blocks (pairs.dealt_join), so a pair is never
    shuffled; norms and categories are computed once a listing. Pairs that a hard rule tells apart, the most of them by far,
    are a branch of their own, without similarity and score.
    """
    held = [c for c in COLUMNS if c in new.columns]
    own = lambda df: M.of_listing(df.where("municipality IS NOT NULL").select("id", "municipality", *held))
    side = lambda df, s, *more: df.select(F.col("id").alias(f"{s}_id"), "municipality", *(F.col(c).alias(f"{s}_{c}") for c in df.columns if c not in ("id", "municipality", *more)))
    fresh = own(new)
    every = fresh.withColumn("fresh", F.lit(True)).unionByName(own(pool).withColumn("fresh", F.lit(False)))
    pairs = dealt_join(side(fresh, "a"), side(every, "b"), "municipality", "a_id", "b_id")
    # Two new listings meet twice, and one of the two pairs counts; one of the pool may come before or after.
    pairs = pairs.where("a_source_domain <> b_source_domain AND (a_id < b_id OR NOT b_fresh AND a_id <> b_id)").withColumn("has_feedback", F.lit(False))
    rule = scoring.hard_rules(config, once=True)
    out = [F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")]
    hard = pairs.where(rule.isNotNull()).select(*out, F.lit(scoring.DIFFERENT).alias("verdict"), F.lit(1.0).alias("confidence"), rule.alias("reasoning"), F.lit(0).alias("tier"))
    return hard.unionByName(scoring.rule_scores(pairs.where(rule.isNull()), config).select(*out, "verdict", "confidence", "reasoning", "tier"))


class GrowingClusters:
    """Components of listings under a folder that driver and executors share. Pairs of the `linking` verdicts join."""

    def __init__(self, spark: SparkSession, folder: str, config: Config = DEFAULT, linking: tuple[str, ...] = ("duplicate",)):
        self.spark, self.config, self.linking, self.tables = spark, config, linking, Tables(spark, folder)

    def create(self, listings: DataFrame, buckets: int = 64) -> None:
        """Empty state for listings of this schema (id: string)."""
        none = self.spark.createDataFrame
        self.tables.create("pool", listings.limit(0), ["id"], buckets)
        self.tables.create_log("verdicts", none([], "a_id string, b_id string, verdict string, confidence double, reasoning string, tier int, batch long"))
        self.tables.create_log("again", none([], "id string"))
        self.tables.create("nodes", none([], "node string, root string"), ["node"], buckets)
        self.tables.create("roots", none([], "root string, current string"), ["root"], buckets)
        self.tables.create("batches", none([], "batch long"), ["batch"], 1)

    def pool(self) -> DataFrame:
        return self.tables.read("pool")

    def verdicts(self) -> DataFrame:
        """The latest verdict of each pair. Only a pair with a listing that came again can be in the log twice."""
        log = self.tables.read("verdicts")
        if self.tables.is_empty("again"):
            return log.drop("batch")
        ids = self.tables.read("again").distinct()
        a, b = (ids.select(F.col("id").alias(f"{s}_id"), F.lit(True).alias(f"{s}_again")) for s in "ab")
        marked = log.join(a, "a_id", "left").join(b, "b_id", "left").withColumn("again", F.coalesce("a_again", "b_again", F.lit(False)))
        once, more = (marked.where(c).select(*log.columns) for c in ("NOT again", "again"))
        return once.unionByName(latest(more, ["a_id", "b_id"], "batch")).drop("batch")

    def clusters(self) -> DataFrame:
        """(node, root): root is the least node of its component."""
        x = self.tables.read("nodes").join(self.tables.read("roots"), "root", "left")
        return x.select("node", F.coalesce("current", "root").alias("root"))

    def absorb(self, new: DataFrame, batch: int) -> bool:
        """Take a batch of listings in, and say whether it was new. Ids that the pool has already are updated in it.

        An updated listing is compared again; links that were found for it earlier stay.
        """
        if not self.tables.read("batches").where(F.col("batch") == batch).isEmpty():
            return False
        new = written(new.dropDuplicates(["id"]), "batch")
        known = self.pool()
        again = written(known.select("id").join(new.select("id"), "id", "left_semi"), "again")
        pool = known.join(again, "id", "left_anti")
        scored = scored_with_pool(new, pool, self.config).select("a_id", "b_id", "verdict", "confidence", "reasoning", F.col("tier").cast("int").alias("tier"), F.lit(batch).cast("long").alias("batch"))
        # The log's new piece is written once, and counts from the switch on.
        kept = self.tables.staged("verdicts", scored)
        links = self.spark.read.schema(scored.schema).parquet(kept).where(F.col("verdict").isin(*self.linking)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
        nodes, roots = self.merged(links, new.select(F.col("id").alias("node")))
        pieces = {"verdicts": kept} | ({} if again.isEmpty() else {"again": self.tables.staged("again", again)})
        self.tables.change({"pool": new, "nodes": nodes, "roots": roots, "batches": self.spark.createDataFrame([(batch,)], "batch long")}, appended=pieces)
        return True

    def merged(self, links: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of `nodes` and `roots` that links (a, b) and new nodes bring."""
        now = self.tables.read("nodes")
        ends = links.select(F.explode(F.array("a", "b")).alias("node")).union(new.select("node")).distinct()
        moved = self.tables.read("roots")
        at = ends.join(now, "node", "left").withColumn("known", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "node"))
        at = written(at.join(moved, "root", "left").select("node", F.coalesce("current", "root").alias("root"), "known"), "ends")
        a, b = (at.select(F.col("node").alias(s), F.col("root").alias(f"{s}_root")) for s in "ab")
        joined = components(links.join(a, "a").join(b, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
        to = written(joined.select(F.col("node").alias("current"), F.col("root").alias("target")), "moves")
        nodes = at.where("NOT known").withColumnRenamed("root", "current").join(to, "current", "left").select("node", F.coalesce("target", "current").alias("root"))
        # Roots that other nodes hang on: those that moved now, and those whose target moved now.
        changed = to.where("current <> target")
        roots = changed.select(F.col("current").alias("root"), F.col("target").alias("current"))
        again = moved.join(changed, "current").select("root", F.col("target").alias("current"))
        return nodes, latest(roots.union(again).withColumn("one", F.lit(1)), ["root"], "one").drop("one")


def grow(stream: DataFrame, state: GrowingClusters, checkpoint: str):
    """Start a query that takes every micro-batch of new listings in."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: state.absorb(df, batch))
