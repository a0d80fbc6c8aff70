"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, remove


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    path = fresh_path(df.sparkSession, "edges")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: A key is hot if it has more rows than twice a partition's equal share, and this many at least.
FEW = 1000


def hot_from(spark: SparkSession, rows: int) -> int:
    """Most rows of a key that isn't hot; of so many rows at most half as many keys are hot as there are partitions."""
    return max(FEW, 2 * rows // int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_join(rows: DataFrame, table: DataFrame, key: str, held: str, by: str, most: int | None = None, how: str = "inner") -> DataFrame:
    """rows joined to the one row of table with their key. table's `held` counts the rows of each key.

    Hot keys, those with more than `most` rows, are dealt over several tasks by a hash of column `by`, and their row of
    the table is repeated there. They are few, so a list of them is broadcast. Without `most` the table is read once more
    to see whether there are any.
    """
    if most is None:
        n, top = table.agg(F.sum(held), F.max(held)).first()
        most = hot_from(rows.sparkSession, n or 0)
        if (top or 0) <= most:
            return rows.join(table.drop(held), key, how)
    parts = F.ceil(F.col(held) / most).cast("int")
    hot = table.where(F.col(held) > most).select(key, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    repeated = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(repeated, [key, "_part"], how).drop("_part", held)


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    """Each node's larger neighbours move to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("held"))
    return spread_join(both.where("b > a"), least, "a", "held", "b", most).select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    """Each node and its smaller neighbours move to the least of those neighbours. Here a < b in every edge."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("held"))
    moved = spread_join(edges, least, "b", "held", "a", most).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60, most: int | None = None) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its component. Loops are dropped.

    Every round is written to the shared folder and its forerunner deleted. Ends when all nodes hang on their root. A
    node with more than `most` edges (twice a partition's share, if not given) is dealt over several tasks.
    """
    spark = edges.sparkSession
    now, path = _stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(most_rounds):
        # Stars: no node is both a root and a member, and every member has one root.
        roots, nodes = now.select(F.col("a").alias("b")).distinct(), now.groupBy("b").agg(F.count("*").alias("n"))
        if nodes.where("n > 1").isEmpty() and nodes.join(roots, "b", "left_semi").isEmpty():
            break
        hub = most or hot_from(spark, now.count())
        new, new_path = _stored(_small_star(_large_star(now, hub), hub))
        remove(spark, path)
        now, path = new, new_path
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
