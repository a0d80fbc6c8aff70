"""Comparing the members of large candidate groups without comparing all pairs of them.

Members of a group lie in chunks, and every chunk was searched for links together with the group's first members. Most
large groups are then one component. What is left are the minor members, those outside the group's largest component:
they alone still meet all chunks. A pair of members of that component needs no comparison, as it is joined already, so
no connection between members is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minors_against_all(members: DataFrame, roots: DataFrame, size: int) -> DataFrame:
    """(key, i, j, node, root, minor): in each group (key, i, j) some minor members and one chunk of all members.

    members: key, chunk (numbered from 0), node. roots: node, root; a node without one is alone. size: most minor
    members of a group. Keys whose members have one root are gone.
    """
    x = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = x.groupBy("key", "root").agg(F.count("*").alias("n"), F.max("chunk").alias("chunk"))
    keys = parts.groupBy("key").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("main"), (F.sum("n") - F.max("n")).alias("minors"), F.max("chunk").alias("last")).where("minors > 0")
    x = x.join(keys.select("key", "main", "last", F.ceil(F.col("minors") / size).cast("int").alias("parts")), "key")
    minor = x.where("root <> main").withColumn("i", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("last"))))
    every = x.withColumn("j", F.col("chunk")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["key", "i", "j", "node", "root"]
    return minor.select(*columns, F.lit(True).alias("minor")).union(every.select(*columns, F.lit(False).alias("minor")))
