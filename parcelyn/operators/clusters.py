"""Clusters from scored pairs: components, seeding with approved clusters, bridges, persistence, admin actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.matching import pair_key
from ..storage import written
from .graph import components
from .pairs import tasks


def cluster_id(members: Column) -> Column:
    """A deterministic id from the sorted members."""
    return F.sha2(F.array_join(F.array_sort(members), ","), 256)


def approved_components(edges: DataFrame) -> DataFrame:
    """(node, root) from edges (a_id, b_id, verdict): only approved ones join; listings of pending ones alone are single.

    Rejected edges count for nothing.
    """
    joined = components(edges.where("verdict = 'approved'").select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    pending = edges.where("verdict = 'pending'").select(F.explode(F.array("a_id", "b_id")).alias("node")).distinct()
    return joined.union(pending.join(joined, "node", "left_anti").select("node", F.col("node").alias("root")))


def component_metrics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each component of two or more: size, best similarity and photo matches, and whether a pending edge is inside."""
    a = edges.where("verdict <> 'rejected'").join(nodes.select(F.col("node").alias("a_id"), F.col("root").alias("ra")), "a_id").join(nodes.select(F.col("node").alias("b_id"), F.col("root").alias("rb")), "b_id")
    inside = a.where("ra = rb").groupBy(F.col("ra").alias("root")).agg(F.max("similarity").alias("max_similarity"), F.max("photo_matches").alias("max_photo_matches"), F.bool_or(F.col("verdict") == "pending").alias("any_pending"))
    sizes = nodes.groupBy("root").agg(F.count("*").alias("member_count")).where("member_count > 1")
    return sizes.join(inside, "root")


def resolve(nodes: DataFrame, metrics: DataFrame, listings: DataFrame, clusters: DataFrame) -> DataFrame:
    """(property_id, cluster_id, status): which cluster each listing of a component goes to.

    The least locked cluster among the members' own absorbs the component, else the least other one is used again, else
    a new id is made from the members. A component with a pending edge inside is PENDING, a locked cluster stays as it is.
    """
    own = listings.where("cluster_id IS NOT NULL").select(F.col("id").alias("node"), F.col("cluster_id").alias("own"))
    locked = clusters.select(F.col("id").alias("own"), F.col("verdict_locked").alias("locked"), F.col("status").alias("own_status"))
    x = nodes.join(metrics.select("root", "any_pending"), "root").join(own, "node", "left").join(locked, "own", "left")
    chosen = x.groupBy("root").agg(
        F.min(F.when(F.col("locked"), F.struct("own", "own_status"))).alias("lock"),
        F.min(F.when(~F.coalesce("locked", F.lit(False)), F.col("own"))).alias("again"),
        F.bool_or("any_pending").alias("any_pending"),
    )
    # A component can be large, so its id comes from its least member and not from a list of all.
    target = F.coalesce(F.col("lock.own"), F.col("again"), F.sha2(F.col("root").cast("string"), 256))
    status = F.coalesce(F.col("lock.own_status"), F.when(F.col("any_pending"), "PENDING").otherwise("APPROVED"))
    chosen = chosen.select("root", target.alias("cluster_id"), status.alias("status"), (F.col("lock.own").isNull() & F.col("again").isNull()).alias("is_new"))
    return nodes.select("node", "root").join(chosen, "root").select(F.col("node").alias("property_id"), "cluster_id", "status", "is_new")


def lock_conflicts(nodes: DataFrame, listings: DataFrame, clusters: DataFrame) -> DataFrame:
    """(root, n_locked): components that hold members of several locked clusters."""
    locked = clusters.where("verdict_locked").select(F.col("id").alias("cluster_id"))
    x = listings.select(F.col("id").alias("node"), "cluster_id").join(locked, "cluster_id").join(nodes, "node")
    return x.groupBy("root").agg(F.countDistinct("cluster_id").alias("n_locked")).where("n_locked > 1")


def release_sold(listings: DataFrame) -> DataFrame:
    """Sold listings leave their cluster."""
    return listings.withColumn("cluster_id", F.when(F.col("status") != "SOLD", F.col("cluster_id")))


def without_orphans(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters with a member, or locked. members must be the clusters' own kind of membership."""
    held = members.select(F.col("cluster_id").alias("id")).distinct()
    return clusters.where("verdict_locked").unionByName(clusters.where("NOT coalesce(verdict_locked, false)").join(held, "id", "left_semi"))


def recounted(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """member_count from the membership itself."""
    n = members.groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").cast("int").alias("_n"))
    return clusters.join(n, "id", "left").withColumn("member_count", F.coalesce("_n", F.lit(0))).drop("_n").select(*clusters.columns)


# --- seeded clustering -----------------------------------------------------------------------------------------------


def edge_cases(duplicates: DataFrame, seeds: DataFrame) -> DataFrame:
    """Duplicate pairs with their listings' approved clusters and what follows: kind is free, attach, inside or disagree.

    duplicates: a_id, b_id, confidence. seeds: property_id, cluster_id of approved or locked clusters.
    """
    a = seeds.select(F.col("property_id").alias("a_id"), F.col("cluster_id").alias("a_cluster"))
    b = seeds.select(F.col("property_id").alias("b_id"), F.col("cluster_id").alias("b_cluster"))
    x = duplicates.join(a, "a_id", "left").join(b, "b_id", "left")
    both = F.col("a_cluster").isNotNull() & F.col("b_cluster").isNotNull()
    none = F.col("a_cluster").isNull() & F.col("b_cluster").isNull()
    return x.withColumn("kind", F.when(none, "free").when(both & (F.col("a_cluster") == F.col("b_cluster")), "inside").when(both, "disagree").otherwise("attach"))


def bridges(cases: DataFrame, clusters: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(property_id, winner, losers, mean): for each listing with edges to approved clusters the one it goes to.

    The highest mean confidence wins; within a small difference of it the cluster that was made first, then the least id.
    """
    x = cases.where("kind = 'attach'").select(F.when(F.col("a_cluster").isNull(), F.col("a_id")).otherwise(F.col("b_id")).alias("property_id"), F.coalesce("a_cluster", "b_cluster").alias("cluster_id"), "confidence")
    means = x.groupBy("property_id", "cluster_id").agg(F.avg("confidence").alias("mean"))
    means = means.join(clusters.select(F.col("id").alias("cluster_id"), "created_at"), "cluster_id", "left")
    best = means.withColumn("best", F.max("mean").over(Window.partitionBy("property_id")))
    order = Window.partitionBy("property_id").orderBy((F.col("mean") >= F.col("best") - config.bridge_epsilon).desc(), F.when(F.col("mean") >= F.col("best") - config.bridge_epsilon, F.col("created_at")).asc_nulls_last(), F.col("mean").desc(), "cluster_id")
    ranked = best.withColumn("rank", F.row_number().over(order))
    return ranked.groupBy("property_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("cluster_id"))).alias("winner"),
        F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.col("cluster_id")))).alias("losers"),
        F.max(F.when(F.col("rank") == 1, F.col("mean"))).alias("mean"),
    )


def ordered_union(edges: DataFrame, labels: DataFrame, most_rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """(members, blocked) of taking edges (a_id, b_id) in their order: each joins its ends' components, unless both hold
    different labels already.

    labels: node, cluster_id. members: node, root (the component's least node), cluster_id. blocked: a_id, b_id,
    cluster_a, cluster_b of the edges that would have joined two labels.

    An edge is taken just when it belongs to the least spanning forest, by order, of the graph in which all labelled nodes
    are one: what closes a ring there is within one component or between two labels. That forest grows in rounds in
    which every component takes its least edge, so that a component of any size needs some log2 of its nodes, and none is
    ever held by one task.
    """
    edges = edges.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).where("a_id <> b_id").distinct()
    edges = written(edges, "ordered-edges")
    nodes = edges.select(F.explode(F.array("a_id", "b_id")).alias("node")).distinct()
    own = nodes.join(labels.groupBy("node").agg(F.min("cluster_id").alias("cluster_id")), "node", "left")
    # The labelled nodes are one component, the least of all.
    free = F.col("cluster_id").isNull()
    own = written(own.select("node", "cluster_id", F.struct(free.alias("free"), F.when(free, F.col("node")).alias("id")).alias("comp")), "ordered-nodes")
    at, live, taken = own.select("node", "comp"), edges, []
    for _ in range(most_rounds):
        a, b = (at.select(F.col("node").alias(f"{s}_id"), F.col("comp").alias(f"{s}_comp")) for s in "ab")
        live = written(live.join(a, "a_id").join(b, "b_id").where("a_comp <> b_comp"), "ordered-edges")
        least = F.min(F.struct("a_id", "b_id", "comp", "other")).alias("e")
        ends = live.select("a_id", "b_id", F.col("a_comp").alias("comp"), F.col("b_comp").alias("other"))
        ends = ends.union(live.select("a_id", "b_id", "b_comp", "a_comp"))
        chosen = written(ends.groupBy(F.col("comp").alias("of")).agg(least).select("e.*"), "ordered-taken")
        if chosen.isEmpty():
            break
        taken.append(chosen.select("a_id", "b_id"))
        roots = components(chosen.select(F.col("comp").alias("a"), F.col("other").alias("b")))
        # Nodes of the labelled component stay there; only the others look for their new one.
        moving = at.where("comp.free").join(roots.select(F.col("node").alias("comp"), "root"), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
        at, live = written(at.where("NOT comp.free").unionByName(moving), "ordered-nodes"), live.select("a_id", "b_id")
    else:
        raise RuntimeError("the union did not settle")
    forest = taken[0] if taken else edges.limit(0)
    for t in taken[1:]:
        forest = forest.union(t)
    trees = components(forest.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    named = own.select("node", "cluster_id").join(trees, "node", "left").withColumn("root", F.coalesce("root", "node"))
    label = named.groupBy("root").agg(F.min("cluster_id").alias("label"))
    named = written(named.select("node", "root").join(label, "root").select("node", "label"), "ordered-labels")
    a, b = (named.select(F.col("node").alias(f"{s}_id"), F.col("label").alias(f"{s}_label")) for s in "ab")
    both = written(edges.join(a, "a_id").join(b, "b_id"), "ordered-edges")
    roots = components(both.where("a_label <=> b_label").select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    members = named.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("label").alias("cluster_id"))
    blocked = both.where("NOT (a_label <=> b_label)").select("a_id", "b_id", F.least("a_label", "b_label").alias("cluster_a"), F.greatest("a_label", "b_label").alias("cluster_b"))
    return members, blocked


def seeded_components(duplicates: DataFrame, seeds: DataFrame, clusters: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, flags, disagreements) of clustering around approved clusters, which never merge with each other.

    members: property_id, root, cluster_id (null for a new cluster), mean confidence of new ones. Components that would
    touch at most one approved cluster don't depend on order. In the others the free edges are taken in order of (a, b),
    and an edge that would join two approved clusters is left out (ordered_union).
    """
    cases = edge_cases(duplicates, seeds)
    won = bridges(cases, clusters, config)
    flags = won.where(F.size("losers") > 0).select("property_id", "winner", F.explode("losers").alias("loser"))
    held = seeds.select("property_id", "cluster_id").union(won.select("property_id", F.col("winner").alias("cluster_id")))
    free = cases.where("kind = 'free'").select("a_id", "b_id", "confidence")
    nodes = components(free.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    owned = nodes.join(held.select(F.col("property_id").alias("node"), "cluster_id"), "node", "left")
    touched = owned.groupBy("root").agg(F.countDistinct("cluster_id").alias("n"), F.min("cluster_id").alias("cluster_id"))
    plain = owned.select("node", "root").join(touched.where("n <= 1").select("root", "cluster_id"), "root").select(F.col("node").alias("property_id"), "root", "cluster_id")

    conflict = touched.where("n > 1").select("root")
    with_root = free.join(nodes.select(F.col("node").alias("a_id"), "root"), "a_id").join(conflict, "root", "left_semi")
    joined, blocked = ordered_union(with_root.select("a_id", "b_id"), held.select(F.col("property_id").alias("node"), "cluster_id"))
    members = plain.unionByName(joined.select(F.col("node").alias("property_id"), "root", "cluster_id"))
    alone = won.select("property_id", F.col("property_id").alias("root"), F.col("winner").alias("cluster_id")).join(nodes.select(F.col("node").alias("property_id")), "property_id", "left_anti")
    disagreements = cases.where("kind = 'disagree'").select("a_id", "b_id", F.least("a_cluster", "b_cluster").alias("cluster_a"), F.greatest("a_cluster", "b_cluster").alias("cluster_b"))
    return members.unionByName(alone), flags, disagreements.unionByName(blocked)


def materialised(members: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(root, cluster_id, member_count, ai_score): new clusters of two or more with their mean confidence; attachments
    keep a null score."""
    m = members.select(F.col("property_id").alias("a_id"), F.col("root").alias("ra"))
    n = members.select(F.col("property_id").alias("b_id"), F.col("root").alias("rb"))
    score = duplicates.join(m, "a_id").join(n, "b_id").where("ra = rb").groupBy(F.col("ra").alias("root")).agg(F.avg("confidence").alias("mean"))
    sizes = members.groupBy("root").agg(F.count("*").alias("member_count"), F.max("cluster_id").alias("cluster_id"))
    x = sizes.join(score, "root", "left").where("cluster_id IS NOT NULL OR member_count > 1")
    return x.select("root", "cluster_id", "member_count", F.when(F.col("cluster_id").isNull(), F.col("mean")).alias("ai_score"))


def pending_clusters(made: DataFrame, members: DataFrame, now: Column, version: str = "2") -> tuple[DataFrame, DataFrame]:
    """(clusters, junction) rows of new clusters: made has root, member_count, ai_score and no cluster yet.

    A cluster's id comes from its members. Junction rows are (cluster_id, property_id), each once.
    """
    own = members.join(made.where("cluster_id IS NULL").select("root", "member_count", "ai_score"), "root")
    ids = own.groupBy("root", "member_count", "ai_score").agg(cluster_id(F.collect_set("property_id")).alias("id"))
    note = F.concat(F.lit("engine: created at "), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"))
    clusters = ids.select("id", F.lit("PENDING").alias("status"), "member_count", "ai_score", F.lit(None).cast("int").alias("phash_matches"), note.alias("notes"), F.lit(version).alias("engine_version"), now.alias("created_at"))
    junction = members.select("root", "property_id").join(ids.select("root", F.col("id").alias("cluster_id")), "root").select("cluster_id", "property_id").distinct()
    return clusters, junction


def new_flags(flags: DataFrame, existing: DataFrame, keys: tuple[str, ...] = ("cluster_id", "pair_a_id", "pair_b_id", "flag_type")) -> DataFrame:
    """Flags that aren't there yet."""
    return flags.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def disagreement_flags(disagreements: DataFrame) -> DataFrame:
    return disagreements.select(F.least("cluster_a", "cluster_b").alias("cluster_id"), F.least("a_id", "b_id").alias("pair_a_id"), F.greatest("a_id", "b_id").alias("pair_b_id"), F.lit("approved_disagreement").alias("flag_type"))


def bridge_flags(flags: DataFrame, members: DataFrame) -> DataFrame:
    """One flag for each losing cluster; its anchor is the losing cluster's least member."""
    anchor = members.groupBy(F.col("cluster_id").alias("loser")).agg(F.min("property_id").alias("anchor"))
    x = flags.join(anchor, "loser")
    return x.select(F.col("loser").alias("cluster_id"), F.least("property_id", "anchor").alias("pair_a_id"), F.greatest("property_id", "anchor").alias("pair_b_id"), F.lit("bridge").alias("flag_type"))


def year_outliers(members: DataFrame, listings: DataFrame, most: int = 10) -> DataFrame:
    """Beyond what is usual: clusters whose years of building lie far apart."""
    x = members.join(listings.select(F.col("id").alias("property_id"), "year_built"), "property_id").where("year_built IS NOT NULL")
    return x.groupBy("cluster_id").agg(F.min(F.struct("year_built", "property_id")).alias("first"), F.max(F.struct("year_built", "property_id")).alias("last")).where(F.col("last.year_built") - F.col("first.year_built") > most).select("cluster_id", F.least("first.property_id", "last.property_id").alias("pair_a_id"), F.greatest("first.property_id", "last.property_id").alias("pair_b_id"), F.lit("year_diff_outlier").alias("flag_type"))


# --- admin actions ---------------------------------------------------------------------------------------------------


def member_pairs(members: DataFrame) -> DataFrame:
    """(cluster_id, a_id, b_id): all pairs within the given clusters, a_id < b_id. Clusters are dealt over all tasks."""
    members = members.select("cluster_id", "property_id").repartition(tasks(members.sparkSession), "cluster_id")
    a, b = members.select("cluster_id", F.col("property_id").alias("a_id")), members.select("cluster_id", F.col("property_id").alias("b_id"))
    return a.join(b, "cluster_id").where("a_id < b_id")


def dissolve(members: DataFrame, clusters: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, clusters) after commands (cluster_id) have dissolved theirs."""
    gone = commands.select("cluster_id").distinct()
    return members.join(gone, "cluster_id", "left_anti"), clusters.join(gone.select(F.col("cluster_id").alias("id")), "id", "left_anti")


def remove_members(members: DataFrame, commands: DataFrame) -> DataFrame:
    """members without those of commands (cluster_id, property_id)."""
    return members.join(commands.select("cluster_id", "property_id"), ["cluster_id", "property_id"], "left_anti")


def merge_clusters(members: DataFrame, commands: DataFrame) -> DataFrame:
    """Members of `source` clusters move to `target` (commands: source, target; no chains)."""
    to = commands.select(F.col("source").alias("cluster_id"), "target")
    return members.join(to, "cluster_id", "left").select(F.coalesce("target", "cluster_id").alias("cluster_id"), *(c for c in members.columns if c != "cluster_id")).distinct()


def verdicts(clusters: DataFrame, commands: DataFrame, now: Column, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, outcomes) after commands (id, verdict, by): approve locks a cluster, unknown ids and verdicts fail alone.

    All commands are taken, however many, and each has its outcome (id, verdict, ok, outcome). Of several valid ones on a
    cluster the last by column `order` counts and the others are superseded; of equal last ones, and without an order, all
    are refused as ambiguous.
    """
    known = clusters.select("id").distinct().withColumn("_known", F.lit(True))
    judged = commands.withColumn("_at", F.struct(F.col(order) if order else F.lit(0))).join(known, "id", "left")
    judged = judged.withColumn("_valid", F.coalesce("_known", F.lit(False)) & F.coalesce(F.col("verdict").isin("APPROVED", "PENDING"), F.lit(False)))
    # One aggregate a cluster: its last place and how many commands are there.
    valid = judged.where("_valid")
    last = valid.groupBy("id").agg(F.max("_at").alias("_last"), F.max_by(F.struct("verdict", "by"), "_at").alias("_said"))
    at_last = valid.join(last.select("id", "_last"), "id").where(F.col("_at").eqNullSafe(F.col("_last"))).groupBy("id").agg(F.count("*").alias("_equal"))
    last = last.join(at_last, "id")
    taken = last.where("_equal = 1").select("id", F.col("_said.verdict").alias("_verdict"), F.col("_said.by").alias("_by"))
    x = clusters.join(taken, "id", "left")
    hit, approve = F.col("_verdict").isNotNull(), F.col("_verdict") == "APPROVED"
    x = x.withColumns(
        {
            "status": F.coalesce("_verdict", "status"),
            "verdict_locked": F.when(hit, approve).otherwise(F.col("verdict_locked")),
            "verdict_locked_at": F.when(hit & approve, now).when(hit, F.lit(None)).otherwise(F.col("verdict_locked_at")),
            "verdict_locked_by": F.when(hit & approve, F.col("_by")).when(hit, F.lit(None)).otherwise(F.col("verdict_locked_by")),
        }
    )
    ours = F.col("_at").eqNullSafe(F.col("_last"))
    outcome = F.when(~F.coalesce("_known", F.lit(False)), "unknown cluster").when(~F.col("_valid"), "unknown verdict").when(~ours, "superseded").when(F.col("_equal") > 1, "ambiguous").otherwise("done")
    outcomes = judged.join(last.select("id", "_last", "_equal"), "id", "left").select("id", "verdict", outcome.alias("outcome"))
    return x.select(*clusters.columns), outcomes.select("id", "verdict", (F.col("outcome") == "done").alias("ok"), "outcome")


def recurrences(feedback: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, n): judged pairs both ends of which are in one cluster again."""
    a = members.select(F.col("property_id").alias("prop_a_id"), F.col("cluster_id"))
    b = members.select(F.col("property_id").alias("prop_b_id"), F.col("cluster_id").alias("_b"))
    return feedback.join(a, "prop_a_id").join(b, "prop_b_id").where("cluster_id = _b").groupBy("cluster_id").agg(F.count("*").alias("n"))


def rejected_per_cluster(members: DataFrame, feedback: DataFrame) -> DataFrame:
    """(cluster_id, n_pairs, n_rejected) over all pairs of each cluster's members."""
    known = feedback.select(pair_key(F.col("prop_a_id"), F.col("prop_b_id")).alias("key"), F.lit(1).alias("hit")).distinct()
    pairs = member_pairs(members).withColumn("key", pair_key(F.col("a_id"), F.col("b_id"))).join(known, "key", "left")
    return pairs.groupBy("cluster_id").agg(F.count("*").alias("n_pairs"), F.count("hit").alias("n_rejected"))
