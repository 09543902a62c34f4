"""Labels that spread along edges to a fixpoint, and what follows from it: flows from sources to sinks, depths in scopes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.graph import settled

#: Rounds after which the tables of what is reached are written as one.
COMPACT = 16


def spread(seeds: DataFrame, edges: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """seeds(node, label), edges(src, dst), blocked(node, label) -> (node, label, distance, via): each label at each node that it
    reaches, in the fewest steps, with the least node that it comes from (null at a seed).

    Semi-naive: a round joins only what the last one added, and drops what is there already; it ends when nothing is added,
    after as many rounds as the longest of the shortest ways. Labels are few (kinds), so that rows are nodes times labels. A
    label neither starts at nor passes a node that blocks it. Loops and null ends are ignored."""
    step = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst").distinct()
    stop = blocked.select("node", "label").distinct() if blocked is not None else None
    keep = lambda rows: rows if stop is None else rows.join(stop, ["node", "label"], "left_anti")
    front = keep(seeds.where("node IS NOT NULL AND label IS NOT NULL").select("node", "label").distinct())
    front = settled(front.withColumn("distance", F.lit(0)).withColumn("via", F.lit(None).cast(seeds.schema["node"].dataType)), "spread")
    reached = [front]
    step = settled(step, "spread-edges")
    for distance in range(1, 1 << 30):
        ahead = front.join(step, front["node"] == step["src"]).groupBy(F.col("dst").alias("node"), "label").agg(F.min("src").alias("via"))
        known = reduce(DataFrame.union, reached).select("node", "label")
        ahead = keep(ahead.join(known, ["node", "label"], "left_anti"))
        front = settled(ahead.select("node", "label", F.lit(distance).alias("distance"), "via"), "spread")
        if front.isEmpty():
            return reduce(DataFrame.union, reached)
        reached.append(front)
        if len(reached) == COMPACT:
            reached = [settled(reduce(DataFrame.union, reached), "spread")]
    raise AssertionError


def flows(calls: DataFrame, sources: DataFrame, sinks: DataFrame, cleaners: DataFrame) -> DataFrame:
    """calls(caller, callee), sources(function, source), sinks(function, sink, line), cleaners(function, source): one flow for
    each source kind, sink kind and sink line: (source, sink, line, function, steps). Of several functions with that line the one
    in the fewest steps counts, then the least."""
    reached = spread(sources.select(F.col("function").alias("node"), F.col("source").alias("label")), calls.toDF("src", "dst"), cleaners.select(F.col("function").alias("node"), F.col("source").alias("label")))
    met = sinks.join(reached, sinks["function"] == reached["node"])
    best = met.groupBy(F.col("label").alias("source"), "sink", "line").agg(F.min(F.struct(F.col("distance").alias("steps"), "function")).alias("b"))
    return best.select("source", "sink", "line", "b.function", "b.steps")


def witnesses(found: DataFrame, reached: DataFrame) -> DataFrame:
    """The way of each flow, followed back along via: (source, sink, line, step, function), step 0 at the source. One join a step,
    for all flows at once."""
    at = found.select("source", "sink", "line", F.col("steps").alias("step"), "function")
    link = settled(reached.where("via IS NOT NULL").select(F.col("label").alias("source"), F.col("node").alias("function"), "via"), "ways")
    out = [at := settled(at, "ways")]
    while not at.where("step > 0").isEmpty():
        at = settled(at.where("step > 0").join(link, ["source", "function"]).select("source", "sink", "line", (F.col("step") - 1).alias("step"), F.col("via").alias("function")), "ways")
        out.append(at)
    return reduce(DataFrame.union, out)


def scoped_targets(entries: DataFrame, requires: DataFrame) -> DataFrame:
    """entries(scope, name): a name that is there in a scope, a path of parts between "/", "" for the root; the entry's own path
    is scope/name. requires(path, name): what the entry at a path asks for ("" for the root) -> (path, name, target), target the
    path of the entry of that name in the nearest enclosing scope: the asking entry's own, then its scope, and so on outwards;
    null if no scope has it. The scopes around an entry are as many as its path has parts; they meet the entries by equality."""
    own = entries.select(F.col("scope").alias("around"), "name").distinct()
    cuts = F.split("path", "/")
    around = F.when(F.col("path") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda k: F.array_join(F.slice(cuts, 1, k), "/")))
    asked = requires.select("path", "name").distinct()
    found = asked.select("path", "name", F.explode(around).alias("around")).join(own, ["around", "name"])
    nearest = found.groupBy("path", "name").agg(F.max_by("around", F.length("around")).alias("around"))
    target = F.when(F.col("around") == "", F.col("name")).otherwise(F.concat_ws("/", "around", "name"))
    return asked.join(nearest.select("path", "name", target.alias("target")), ["path", "name"], "left")


def scoped_depths(entries: DataFrame, requires: DataFrame) -> DataFrame:
    """(path, depth): entries that the root's requirements lead to, 1 for its own."""
    edges = scoped_targets(entries, requires).where("target IS NOT NULL").select(F.col("path").alias("src"), F.col("target").alias("dst"))
    root = requires.sparkSession.createDataFrame([("", "root")], "node string, label string")
    return spread(root, edges).where("node <> ''").select(F.col("node").alias("path"), F.col("distance").alias("depth"))
