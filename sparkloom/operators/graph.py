"""Property graphs: building with evidence, neighbourhoods, bounded walks, closures, components, orders."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_HOPS = 3


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the one that driver and executors share: spark.checkpoint.dir, or below the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{(shared or spark.conf.get('spark.sql.warehouse.dir') + '/sparkloom').rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Setting by which shuffle files go when their job ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written in the passes that are under way.
_PASSES: list[list[DataFrame]] = []


def settled(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written to the shared folder (a folder in it for each value of by) and read back: a loop's lineage ends there. Shuffle
    files of the job go when it ends."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if _PASSES:
        _PASSES[-1].append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of settled tables, once what was made of them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def in_passes(makes: Iterable[Callable[[], DataFrame]], name: str) -> DataFrame:
    """The rows of all that is made (of one schema), a pass after another: what a pass shuffles or settles on its way goes before
    the next begins, so that only results add up on disk."""
    done: list[DataFrame] = []
    for make in makes:
        _PASSES.append([])
        try:
            done.append(settled(make(), name))
        finally:
            held = _PASSES.pop()
        release(*held[:-1])
        if _PASSES:
            _PASSES[-1].append(done[-1])
    return done[0].sparkSession.read.schema(done[0].schema).parquet(*[t.written_at for t in done])


def strongest(rows: DataFrame, keys: list[str], confidence: str = "confidence", seq: str = "seq", last: bool = False) -> DataFrame:
    """One row for each key: that of the highest confidence, and of these the first (last) by seq. Summed on the map side."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(F.col(confidence), F.col(seq) if last else -F.col(seq))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_best")).select(*keys, "_best.*").select(*rows.columns)


def build_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without loops whose both ends are nodes, the strongest for each (kind, src, dst)."""
    ids = nodes.select("id")
    kept = edges.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return strongest(kept.select(*edges.columns), ["kind", "src", "dst"])


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, other, direction, kind, confidence): each edge from both ends."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("direction"), "kind", "confidence")
    return out.union(edges.select("dst", "src", F.lit("in"), "kind", "confidence"))


def edges_of(edges: DataFrame, node: str, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    side = {"out": F.col("src") == node, "in": F.col("dst") == node, "both": (F.col("src") == node) | (F.col("dst") == node)}[direction]
    found = edges.where(side)
    found = found.where(F.col("kind").isin(kinds)) if kinds else found
    return found.orderBy(F.desc("confidence"), "kind", "src", "dst")


def walk(edges: DataFrame, seeds: DataFrame, hops: int = MAX_HOPS, most: int = 60) -> DataFrame:
    """seeds(id) -> (seed, id, depth, confidence): what each seed reaches in either direction, at its least depth, with the
    confidence of the strongest edge that leads there; of a seed the first `most`, by depth, confidence, id."""
    step = settled(adjacency(edges).groupBy("node", "other").agg(F.max("confidence").alias("confidence")).where("node <> other"), "walk-steps")
    front = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"), F.lit(1.0).alias("confidence"))
    found = front
    for depth in range(1, hops + 1):
        ahead = front.join(step.withColumnRenamed("node", "id"), "id").groupBy("seed", "other").agg(F.max(step["confidence"]).alias("confidence"))
        ahead = ahead.join(found.select("seed", F.col("id").alias("other")), ["seed", "other"], "left_anti")
        front = settled(ahead.select("seed", F.col("other").alias("id"), F.lit(depth).alias("depth"), "confidence"), "walk")
        found = found.union(front)
    order = Window.partitionBy("seed").orderBy("depth", F.desc("confidence"), "id")
    return found.where("depth > 0").withColumn("_rk", F.row_number().over(order)).where(F.col("_rk") <= most).drop("_rk")


def find_by_name(nodes: DataFrame, name: str, kind_rank: Column) -> DataFrame:
    """Nodes whose name, last name part or id is the name; only if there are none, those that are but for case."""
    simple = F.element_at(F.split("name", r"\."), -1)
    exact = (F.col("name") == name) | (simple == name) | (F.col("id") == name)
    loose = (F.lower("name") == name.lower()) | (F.lower(simple) == name.lower())
    found = nodes.where(exact | loose).withColumn("tier", F.when(exact, 0).otherwise(1))
    first = found.agg(F.min("tier").alias("_first"))
    return found.join(F.broadcast(first), F.col("tier") == F.col("_first")).drop("_first").orderBy(kind_rank, "id")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): counts by node kind and edge kind, with a total for each (kind null)."""
    n = nodes.rollup("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    return n.union(edges.rollup("kind").agg(F.count("*").alias("n")).select(F.lit("edge"), "kind", "n"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in, n_neighbours)"""
    both = adjacency(edges)
    return both.groupBy("node").agg(
        F.count_if(F.col("direction") == "out").alias("n_out"), F.count_if(F.col("direction") == "in").alias("n_in"), F.count_distinct("other").alias("n_neighbours")
    )


def traverse(edges: DataFrame, seeds: DataFrame, direction: str = "out", hops: int = MAX_HOPS, min_confidence: float = 0.0) -> DataFrame:
    """seeds(id) -> (seed, id, depth): all within so many hops (MAX_HOPS at most), at their least depth. A join a hop."""
    hops = min(max(hops, 0), MAX_HOPS)
    step = adjacency(edges.where(F.col("confidence") >= min_confidence))
    step = step if direction == "both" else step.where(F.col("direction") == direction)
    step = settled(step.select(F.col("node").alias("id"), "other").distinct(), "walk-steps")  # made once, not in each hop
    found = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"))
    front = found
    for depth in range(1, hops + 1):
        front = front.join(step, "id").select("seed", F.col("other").alias("id")).distinct()
        front = front.join(found.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth))
        front = settled(front.select("seed", "id", "depth"), "walk")
        found = found.union(front)
    return found


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, depth): all that can be reached, by the fewest steps, until a round adds nothing. The result may be as large
    as all pairs: components and orders below don't use it."""
    step = settled(edges.where("src <> dst").select("src", "dst").distinct(), "closure")
    found = step.withColumn("depth", F.lit(1))
    front, depth = found, 1
    while True:
        depth += 1
        front = front.select("src", F.col("dst").alias("via")).join(step.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        front = front.join(found.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth))
        front = settled(front, "closure")
        if front.isEmpty():
            return found
        found = found.union(front)


def _reached(step: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(id), step(src, dst) -> (id, label): of the nodes that each node reaches along the edges, itself included, the
    first by a hash of the id. Each round takes the first of the labels of the nodes an edge away, then that label's own
    label: a hash puts labels far ahead, whatever the ids, so known ways grow by a factor each round."""
    labels = settled(nodes.select("id", F.struct(F.xxhash64("id").alias("h"), "id").alias("label")), "reach")
    while True:
        near = step.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))
        new = labels.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        jump = labels.select(F.col("id").alias("via"), F.col("label").alias("jumped"))
        new = settled(new.join(jump, F.col("next.id") == F.col("via")).select("id", "label", F.least("next", "jumped").alias("next")), "reach")
        labels = new.select("id", F.col("next").alias("label"))
        if new.where("next <> label").isEmpty():
            return labels.select("id", "label.id").toDF("id", "label")


def _by_smallest(labels: DataFrame) -> DataFrame:
    """(id, label) -> (id, component): groups of one label, named by their smallest id."""
    names = labels.groupBy("label").agg(F.min("id").alias("component"))
    return labels.join(names, "label").select("id", "component")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): undirected components by their smallest id."""
    links = settled(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "components")
    return _by_smallest(_reached(links, links.select(F.col("src").alias("id")).distinct()))


def _chains(step: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(chains, jumps) of the nodes with one way on: (id, to, steps, low, round) with the first node on the way that has no
    way on or several, and how far it is; round: there is none, the way ends in a circle, `to` is on it and low is the
    circle's smallest id. jumps: (id, to) over 1, 2, 4, ... steps. By doubling, so long chains take few rounds."""
    single = step.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to")).where("n = 1")
    chain = settled(single.select(F.col("src").alias("id"), "to", F.lit(1).cast("long").alias("steps"), F.least("src", "to").alias("low")), "chains")
    jumps, reach, n = [], 1, chain.count()
    while n:
        jumps.append(chain.select("id", "to"))
        jump = chain.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"), F.col("low").alias("lower"))
        moved = chain.join(jump, "to", "left").select(
            "id", F.coalesce("further", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.least("low", F.coalesce("lower", "low")).alias("low"), F.col("further").isNotNull().alias("round")
        )
        chain = settled(moved, "chains")
        reach *= 2
        if reach > n or chain.where("round").isEmpty():
            break
        chain = chain.drop("round")
    return (chain if n else chain.withColumn("round", F.lit(False))), jumps


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component, size): nodes that reach each other, by the smallest id; a node on no cycle is its own.

    Nodes with one way on are taken out first, by doubling: their ways are replaced by steps to where they end. The rest is
    coloured forward and backward, without a closure: by the first node (by a hash) that they reach, then, along edges of one
    colour, by the first that reaches them. Where both are the colour's own node, the node is in that node's component. The
    others go on with the edges between nodes of the same two colours, until there are none. A node that was taken out is in
    the component that its way ends in if something of that component leads to it."""
    nodes = settled(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), "scc")
    every = settled(edges.where("src <> dst").select("src", "dst").distinct(), "scc")
    chains, jumps = _chains(every)
    ends = chains.where("NOT round").select("id", "to")
    step = every.join(chains.select(F.col("id").alias("src")), "src", "left_anti").join(chains.where("round").select(F.col("id").alias("dst")), "dst", "left_anti")
    step = step.join(ends.toDF("dst", "to"), "dst", "left").select("src", "dst", F.coalesce("to", "dst").alias("to"))
    heads = settled(step, "scc")
    step = settled(heads.where("src <> to").select("src", F.col("to").alias("dst")).distinct(), "scc")
    found = nodes.limit(0).select("id", F.col("id").alias("label"))
    while not step.isEmpty():
        live = step.select(F.col("src").alias("id")).union(step.select("dst")).distinct()
        ahead = _reached(step, live)
        same = step.join(ahead.toDF("src", "a"), "src").join(ahead.toDF("dst", "b"), "dst").where("a = b").select("src", "dst")
        same = settled(same, "scc")
        behind = _reached(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), live)
        coloured = settled(ahead.toDF("id", "ahead").join(behind.toDF("id", "behind"), "id"), "scc")
        found = found.union(coloured.where("ahead = behind").select("id", F.col("ahead").alias("label")))
        rest = coloured.where("ahead <> behind")
        x, y = rest.toDF("src", "a", "c"), rest.toDF("dst", "b", "d")
        step = settled(same.join(x, "src").join(y, "dst").where("a = b AND c = d").select("src", "dst"), "scc")
    found = settled(found, "scc")
    # chains that lead from a component back into it, or from a node back to itself
    own = nodes.join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    marked = heads.where("dst <> to").join(own.toDF("src", "a"), "src").join(own.toDF("to", "b"), "to").where("a = b").select(F.col("dst").alias("id")).distinct()
    for jump in jumps:
        marked = settled(marked.union(marked.join(jump, "id").select("to")).distinct(), "scc")
    back = marked.join(ends, "id").join(own.toDF("to", "label"), "to").select("id", "label")
    circle = chains.where("round").select("to", "low").distinct().select(F.col("to").alias("id"), F.col("low").alias("label"))
    through = back.select("label").distinct().select(F.col("label").alias("id"), "label")  # a node that only chains lead back to
    labels = found.union(through.join(found.select("id"), "id", "left_anti")).union(back).union(circle)
    named = nodes.join(_by_smallest(settled(labels, "scc")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    sizes = named.groupBy("component").agg(F.count("*").alias("size"))
    return named.join(sizes, "component").select("id", "component", "size")


def shortest_paths(edges: DataFrame, sources: DataFrame, max_depth: int = 6) -> DataFrame:
    """sources(id) -> (source, id, depth, path): one shortest path each, the first in order of its ids."""
    step = edges.select("src", "dst").distinct()
    found = sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("depth"), F.array("id").alias("path"))
    front = found
    for depth in range(1, max_depth + 1):
        front = front.join(step.withColumnRenamed("src", "id"), "id").groupBy("source", F.col("dst").alias("_to")).agg(F.min("path").alias("path"))
        front = front.select("source", F.col("_to").alias("id"), F.lit(depth).alias("depth"), F.concat("path", F.array("_to")).alias("path"))
        front = settled(front.join(found.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", "depth", "path"), "paths")
        if front.isEmpty():
            break
        found = found.union(front)
    return found


def layers(edges: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(id, layer): the longest way from a node to a sink (layer 0), in steps between strong components; the nodes of a cycle
    are on one layer. parts: the strong components, if they are known.

    Chains of nodes with one way on are followed by doubling, so that only branching nodes take a round each step."""
    of = settled((strong_components(edges) if parts is None else parts).select("id", "component"), "layers")
    step = edges.join(of.toDF("src", "a"), "src").join(of.toDF("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    step = settled(step, "layers")
    chain = _chains(step)[0].select("id", "to", "steps")
    # what remains: nodes without a way on, and branching ones, whose edges lead to such nodes over so many steps
    ends = step.join(chain.select(F.col("id").alias("src")), "src", "left_anti").join(chain.toDF("dst", "to", "steps"), "dst", "left")
    ends = ends.groupBy("src", F.coalesce("to", "dst").alias("dst")).agg(F.max(1 + F.coalesce("steps", F.lit(0))).alias("steps"))
    ends = settled(ends, "layers")
    level = settled(of.select(F.col("component").alias("id")).distinct().join(chain.select("id"), "id", "left_anti").withColumn("layer", F.lit(0).cast("long")), "layers")
    while True:
        up = ends.join(level.select(F.col("id").alias("dst"), "layer"), "dst").groupBy(F.col("src").alias("id")).agg(F.max(F.col("layer") + F.col("steps")).alias("up"))
        new = settled(level.join(up, "id", "left").select("id", F.col("layer").alias("was"), F.coalesce("up", F.lit(0)).alias("layer")), "layers")
        level = new.select("id", "layer")
        if new.where("was <> layer").isEmpty():
            break
    chained = chain.join(level.toDF("to", "layer"), "to").select("id", (F.col("layer") + F.col("steps")).alias("layer"))
    return of.join(level.union(chained).toDF("component", "layer"), "component").select("id", F.col("layer").cast("int").alias("layer"))


def dependency_order(edges: DataFrame) -> DataFrame:
    """(id, layer, component, in_cycle): edges lead from what depends to what it depends on; ordered by layer, then component,
    then id, everything comes after what it depends on, cycles as one."""
    parts = settled(strong_components(edges), "order")
    return layers(edges, parts).join(parts, "id").select("id", "layer", "component", (F.col("size") > 1).alias("in_cycle"))


def cycle_paths(edges: DataFrame) -> DataFrame:
    """(component, path): for each cycle component, one shortest way from its smallest id back to it, the first in order of
    its ids. A round a step, and a row a node and component, so nothing is enumerated."""
    parts = strong_components(edges).where("size > 1").select("id", "component")
    step = edges.where("src <> dst").join(parts.toDF("src", "component"), "src").join(parts.toDF("dst", "other"), "dst").where("component = other").select("src", "dst").distinct()
    step = settled(step, "cycles")
    front = parts.where("id = component").select("component", "id", F.array("id").alias("path"))
    seen, closed = front.select("component", "id"), None
    while True:
        ahead = front.join(step.withColumnRenamed("src", "id"), "id").groupBy("component", F.col("dst").alias("to")).agg(F.min("path").alias("path"))
        ahead = settled(ahead, "cycles")
        back = ahead.where("to = component").select("component", F.concat("path", F.array("to")).alias("path"))
        closed = back if closed is None else closed.union(back)
        ahead = ahead.join(back.select("component"), "component", "left_anti").select("component", F.col("to").alias("id"), F.concat("path", F.array("to")).alias("path"))
        front = settled(ahead.join(seen, ["component", "id"], "left_anti"), "cycles")
        if front.isEmpty():
            return closed
        seen = seen.union(front.select("component", "id"))


def lineage(pairs: DataFrame) -> DataFrame:
    """pairs(new, old) of renames -> (name, origin, steps): each name's way back to its first name. Names whose way leads into a
    circle of renames have no origin: null."""
    back = settled(pairs.select("new", "old").distinct(), "lineage")
    walked = back.select(F.col("new").alias("name"), F.col("old").alias("origin"), F.lit(1).cast("long").alias("steps"))
    reach, n = 1, back.count()
    while True:
        jump = walked.select(F.col("name").alias("origin"), F.col("origin").alias("further"), F.col("steps").alias("more"))
        new = walked.join(jump, "origin", "left").select(
            "name", F.coalesce("further", "origin").alias("origin"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("moved")
        )
        new = settled(new, "lineage")
        walked = new.select("name", "origin", "steps")
        reach *= 2
        if reach > n or new.where("moved").isEmpty():  # a way without a circle has no more steps than there are renames
            none = F.lit(None)
            return new.select("name", F.when(F.col("moved"), none).otherwise(F.col("origin")).alias("origin"), F.when(F.col("moved"), none).otherwise(F.col("steps")).cast("int").alias("steps"))


def file_dependencies(edges: DataFrame, nodes: DataFrame, structural: tuple[str, ...] = ("contains", "defines")) -> DataFrame:
    """(src_path, dst_path, n, confidence): edges between things of different files, structural kinds left out."""
    path = nodes.select("id", "path")
    rows = edges.where(~F.col("kind").isin(*structural)).join(path.toDF("src", "src_path"), "src").join(path.toDF("dst", "dst_path"), "dst").where("src_path <> dst_path")
    return rows.groupBy("src_path", "dst_path").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


def rollup_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """groups(id, grp) -> (src_grp, dst_grp, weight, kinds, confidence): edges taken to any grouping of their ends."""
    g = groups.select("id", "grp")
    rows = edges.join(g.toDF("src", "src_grp"), "src").join(g.toDF("dst", "dst_grp"), "dst").where("src_grp <> dst_grp")
    per_kind = rows.groupBy("src_grp", "dst_grp", "kind").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))
    return per_kind.groupBy("src_grp", "dst_grp").agg(
        F.sum("n").alias("weight"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"), F.max("best").alias("confidence")
    )
