"""Modules to components: folders are collapsed, deepest first, then groups are merged by affinity.

A round works on all groups at once. Groups and their links are tables that shrink from round to round; what goes through the
driver is how many groups there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.graph import settled

#: Fixed value: components that an overview should have at most.
MAX_COMPONENTS = 12
#: Digits to which affinities are rounded before they are compared.
DIGITS = 9


def _depth(path: Column) -> Column:
    return F.when(path.isin(".", ""), 0).otherwise(F.size(F.split(path, "/")))


def _ancestor(path: Column, depth: int) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")


def collapse_folders(modules: DataFrame, most: int = MAX_COMPONENTS, share: float = 2.5) -> DataFrame:
    """modules(module, folder, size) -> (module, cluster): from the deepest folders outwards, the groups below a folder become one,
    as long as there are more than `most` groups; never below the folder that all share, and never one with more than `share`
    times its fair part of the whole (8 at least). Of a level the smallest folders go first, if not all are needed."""
    groups = settled(modules.select(F.col("module").alias("cluster"), F.col("folder").alias("anchor"), F.col("size").cast("long").alias("size")), "groups")
    placed = settled(modules.select("module", F.col("module").alias("cluster")), "placed")
    total, n = groups.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return placed
    cap = max(8, -int(-(total / most) * share // 1))
    low, high, deepest = groups.agg(F.min("anchor"), F.max("anchor"), F.max(_depth(F.col("anchor")))).first()
    common = 0  # parts that the least and the greatest path share, and so all between them
    for a, b in zip(low.split("/"), high.split("/"), strict=False):
        if a != b:
            break
        common += 1
    for depth in range(deepest, common, -1):
        if n <= most:
            break
        inside = groups.where(_depth(F.col("anchor")) >= depth).withColumn("into", _ancestor(F.col("anchor"), depth))
        folders = inside.groupBy("into").agg(F.count("*").alias("members"), F.sum("size").alias("size")).where(f"members >= 2 AND size <= {cap}")
        folders = settled(folders, "folders")
        fewer = folders.agg(F.sum(F.col("members") - 1)).first()[0] or 0
        if not fewer:
            continue
        if n - fewer < most:  # then there are fewer folders than groups are wanted
            before = F.sum(F.col("members") - 1).over(Window.orderBy("size", "into").rowsBetween(Window.unboundedPreceding, -1))
            folders = folders.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < n - most)
        moves = inside.join(folders.select("into"), "into").select("cluster", "into")
        moves = settled(moves, "moves")
        placed = settled(placed.join(moves, "cluster", "left").select("module", F.coalesce("into", "cluster").alias("cluster")), "placed")
        merged = groups.join(moves, "cluster", "left").select(F.coalesce("into", "cluster").alias("cluster"), F.coalesce("into", "anchor").alias("anchor"), "size")
        groups = settled(merged.groupBy("cluster", "anchor").agg(F.sum("size").alias("size")), "groups")
        n = groups.count()
    return placed


def merge_by_affinity(groups: DataFrame, links: DataFrame, most: int = MAX_COMPONENTS, cap: int | None = None, least: float = 0.0) -> DataFrame:
    """groups(cluster, size, role: null if none), links(a, b, weight) -> (cluster, merged): the group that each ends in, named after
    its largest (then least) first member.

    The affinity of two groups is the weight between them over the root of the product of both's weights to all others. In a
    round all pairs of which each is the other's best (ties to the least name) merge at once, if their roles don't differ and
    their sizes keep within cap; when fewer merges are needed, the strongest go first. It ends at `most` groups or when no
    pair is left. At least the strongest pair of all merges in each round."""
    rows = settled(groups.select("cluster", F.col("size").cast("long").alias("size"), "role"), "clusters")
    names = settled(rows.select("cluster", F.col("cluster").alias("merged")), "merged")
    flat = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").where("a <> b AND a IS NOT NULL")
    edges = settled(flat.groupBy("a", "b").agg(F.sum("weight").alias("weight")), "cluster-links")
    while (n := rows.count()) > most:
        ends = edges.select(F.col("a").alias("cluster"), F.col("b").alias("other"), "weight").union(edges.select("b", "a", "weight"))
        degree = ends.groupBy("cluster").agg(F.sum("weight").alias("degree"))
        side = rows.join(degree, "cluster")
        near = ends.join(side, "cluster").join(side.select(F.col("cluster").alias("other"), F.col("size").alias("other_size"), F.col("role").alias("other_role"), F.col("degree").alias("other_degree")), "other")
        near = near.where("role <=> other_role OR role IS NULL OR other_role IS NULL")
        near = near.where(F.col("size") + F.col("other_size") <= cap) if cap else near
        near = near.withColumn("affinity", F.round(F.col("weight") / F.sqrt(F.col("degree") * F.col("other_degree")), DIGITS)).where(F.col("affinity") > least)
        # of equal affinities the pair with the least names is everyone's best, so the strongest pair is always mutual
        pair = F.struct(-F.col("affinity"), F.least("cluster", "other").alias("low"), F.greatest("cluster", "other").alias("high"))
        best = settled(near.groupBy("cluster").agg(F.min(pair.alias("p")).alias("p")).select("cluster", "p.low", "p.high", F.col("p.col1").alias("weak")), "cluster-best")
        mutual = best.groupBy("low", "high").agg(F.count("*").alias("sides"), F.min("weak").alias("weak")).where("sides = 2")
        if mutual.isEmpty():
            break
        if n - mutual.count() < most:  # then there are fewer pairs than groups are wanted
            mutual = mutual.orderBy("weak", "low", "high").limit(n - most)
        a, b = (rows.select(F.col("cluster").alias(k), F.col("size").alias(f"size_{k}")) for k in ("low", "high"))
        told = mutual.join(a, "low").join(b, "high")
        kept = F.when(F.col("size_high") > F.col("size_low"), F.col("high")).otherwise(F.col("low"))
        told = told.withColumn("kept", kept)
        moves = settled(told.select(F.col("low").alias("cluster"), "kept").union(told.select("high", "kept")), "cluster-moves")
        into = F.coalesce("kept", "cluster")
        names = settled(names.join(moves.select(F.col("cluster").alias("merged"), "kept"), "merged", "left").select("cluster", F.coalesce("kept", "merged").alias("merged")), "merged")
        rows = settled(rows.join(moves, "cluster", "left").groupBy(into.alias("cluster")).agg(F.sum("size").alias("size"), F.max("role").alias("role")), "clusters")
        ma, mb = (moves.select(F.col("cluster").alias(k), F.col("kept").alias(f"kept_{k}")) for k in ("a", "b"))
        moved = edges.join(ma, "a", "left").join(mb, "b", "left").select(F.coalesce("kept_a", "a").alias("x"), F.coalesce("kept_b", "b").alias("y"), "weight").where("x <> y")
        edges = settled(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("weight").alias("weight")), "cluster-links")
    return names


def cluster_modules(modules: DataFrame, links: DataFrame, most: int = MAX_COMPONENTS, share: float = 2.5) -> DataFrame:
    """modules(module, folder, size, role), links(a, b, weight) of modules -> (module, component)."""
    placed = collapse_folders(modules, most, share)
    held = settled(modules.join(placed, "module"), "modules")
    # a folder has a role if all its modules that have one agree
    groups = held.groupBy("cluster").agg(F.sum("size").alias("size"), F.when(F.count_distinct("role") == 1, F.max("role")).alias("role"))
    ends = held.select("module", "cluster")
    between = links.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"), "weight")
    total = held.agg(F.sum("size")).first()[0] or 0
    named = merge_by_affinity(groups, between, most, max(8, -int(-(total / most) * share // 1)))
    return placed.join(named, "cluster").select("module", F.col("merged").alias("component"))
