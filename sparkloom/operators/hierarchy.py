"""Trees: depths, sizes and preorder numbers of all nodes at once."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.graph import settled
from sparkloom.operators.sums import prefix_sums


def hierarchy(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes(id, parent, the columns of order) -> (id, parent, depth, size, preorder): roots (no parent, or one that isn't a node)
    have depth 0; size counts a node and all below it; preorder numbers nodes from 0, parents before children and siblings
    by order, then id. Nodes on a cycle, or below one, are left out.

    Levels from the roots down, sizes from the deepest level up, then numbers down again: a child's number is its parent's, one
    more, and the sizes of the siblings before it. Rounds are as many as the tree is deep; siblings of any number are summed
    in shares."""
    rows = settled(nodes.select("id", "parent", *order), "tree")
    ids = rows.select(F.col("id").alias("parent"))
    level = rows.join(ids, "parent", "left_anti")
    levels = []
    while True:
        level = settled(level, "level")
        if level.isEmpty():
            break
        levels.append(level)
        level = rows.join(level.select(F.col("id").alias("parent")), "parent").select(*rows.columns)
    sized = None
    sizes = []
    for level in reversed(levels):
        below = sized.groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("_below")) if sized is not None else None
        sized = (level.join(below, "id", "left") if below is not None else level.withColumn("_below", F.lit(None).cast("long"))).select(*rows.columns, (F.coalesce("_below", F.lit(0)) + 1).alias("size"))
        sized = settled(sized, "sized")
        sizes.append(sized)
    out, above = [], None
    for depth, level in enumerate(reversed(sizes)):
        level = level.withColumn("_root", F.lit(0)) if above is None else level
        by = ["_root"] if above is None else ["parent"]
        placed = prefix_sums(level, by, [F.col(c) for c in (*order, "id")], "size", "_ahead")
        if above is None:
            placed = placed.withColumn("preorder", F.col("_ahead"))
        else:
            up = above.select(F.col("id").alias("_up"), F.col("preorder").alias("_number"))
            placed = placed.join(up, F.col("parent") == F.col("_up")).withColumn("preorder", F.col("_number") + 1 + F.col("_ahead"))
        above = settled(placed.select("id", "parent", F.lit(depth).alias("depth"), "size", F.col("preorder").cast("long").alias("preorder")), "numbered")
        out.append(above)
    return reduce(DataFrame.union, out) if out else rows.select("id", "parent", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("preorder"))


def _entered(visits: DataFrame) -> DataFrame:
    """Of visits (entry, id, path, above, depth) those that enter their node: the first path to it among visits whose own parent
    enters. What a path is depends on smaller paths only, so repeating this comes to rest."""
    now = visits.where("depth = 0").select("entry", "path", "id", "depth")
    while True:
        alive = visits.where("depth = 0").select("entry", "path", "id", "depth").union(visits.join(now.select("entry", F.col("path").alias("above")), ["entry", "above"]).select("entry", "path", "id", "depth"))
        first = settled(alive.groupBy("entry", "id").agg(F.min(F.struct("path", "depth")).alias("f")).select("entry", "f.path", "id", "f.depth"), "entered")
        if first.count() == now.count() and first.join(now, ["entry", "path"], "left_anti").isEmpty():
            return first
        now = first


#: Fixed value: calls below an entry up to which one task walks them.
WALKED = 500_000


def call_tree(edges: DataFrame, entries: DataFrame, depth: int = 3) -> DataFrame:
    """edges(src, dst, confidence), entries(id) -> (entry, place, id, depth, repeated): each entry's tree of calls down to `depth` (1
    to 6) in the order of a walk that takes the strongest edge first (ties to the least target); a node that the walk has met
    before is marked and not entered again. place counts an entry's rows from 0.

    What an entry reaches is found level by level for all entries at once, a node once however many paths lead to it; then each
    entry walks its own nodes in a task. Entries with more than WALKED calls below them are walked by rows instead."""
    depth = max(1, min(depth, 6))
    strongest = edges.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
    number = F.col("confidence").cast("double")
    turn = F.struct(number.isNull(), ~F.isnan(number), -F.col("confidence"), F.col("dst"))  # as a descending order has them
    kids = strongest.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["dst"]).alias("kids"))
    kids = settled(kids.withColumnRenamed("src", "id"), "kids")
    front = settled(entries.select(F.col("id").alias("entry"), "id").distinct(), "reached")
    reached = front
    for _ in range(1, depth):
        ahead = front.join(kids, "id").select("entry", F.explode("kids").alias("id")).distinct()
        front = settled(ahead.join(reached, ["entry", "id"], "left_anti"), "reached")
        reached = reached.unionByName(front)
    held = settled(reached.join(kids, "id", "left").select("entry", "id", "kids"), "held")
    many = settled(held.groupBy("entry").agg(F.sum(F.greatest(F.size("kids"), F.lit(0))).alias("n")).where(F.col("n") > WALKED).select(F.col("entry").alias("id")), "many")
    types = dict(front.dtypes)

    def walk(key: tuple, rows: pa.Table) -> pa.Table:
        below = dict(zip(rows["id"].to_pylist(), rows["kids"].to_pylist(), strict=True))
        start = key[0].as_py()
        ids, depths, repeated, met, stack = [], [], [], set(), [(start, 0)]
        while stack:
            node, at = stack.pop()
            again = node in met
            ids.append(node)
            depths.append(at)
            repeated.append(again)
            if not again:
                met.add(node)
                if at < depth:
                    stack.extend((k, at + 1) for k in reversed(below.get(node) or ()))
        kind = rows.schema.field("id").type
        columns = [pa.array([start] * len(ids), rows.schema.field("entry").type), pa.array(range(len(ids)), pa.int64()), pa.array(ids, kind), pa.array(depths, pa.int32()), pa.array(repeated, pa.bool_())]
        return pa.Table.from_arrays(columns, names=["entry", "place", "id", "depth", "repeated"])

    schema = f"entry {types['entry']}, place long, id {types['id']}, depth int, repeated boolean"
    if many.isEmpty():
        return held.groupBy("entry").applyInArrow(walk, schema)
    few = held.join(many.select(F.col("id").alias("entry")), "entry", "left_anti")
    return few.groupBy("entry").applyInArrow(walk, schema).unionByName(_walked_by_rows(edges, many, depth).select("entry", "place", "id", F.col("depth").cast("int").alias("depth"), "repeated"))


def _walked_by_rows(edges: DataFrame, entries: DataFrame, depth: int) -> DataFrame:
    """call_tree() of entries with so many calls below them that no task should hold them.

    A visit is known by its path of turns, and paths sort as the walk goes. Visits that enter their node, as far as is known,
    are followed by one step; that may show an earlier path to a node, so who enters is settled again, until all that enter
    have been followed. What is followed is nodes, not all paths."""
    step = edges.groupBy("src", "dst").agg(F.max("confidence").alias("confidence")).withColumn("one", F.lit(1))
    step = prefix_sums(step, ["src"], [F.desc("confidence"), F.col("dst")], "one", "turn")
    step = settled(step.select("src", "dst", F.format_string("%09d", F.col("turn").cast("long")).alias("turn")), "call-steps")
    visits = settled(entries.select(F.col("id").alias("entry"), "id", F.lit("").alias("path"), F.lit(None).cast("string").alias("above"), F.lit(0).alias("depth")).distinct(), "visits")
    followed = visits.select("entry", "path").limit(0)
    while True:
        entered = _entered(visits)
        todo = settled(entered.where(F.col("depth") < depth).join(followed, ["entry", "path"], "left_anti"), "todo")
        if todo.isEmpty():
            break
        ahead = todo.join(step, todo["id"] == step["src"]).select("entry", F.col("dst").alias("id"), F.concat("path", F.lit("/"), "turn").alias("path"), F.col("path").alias("above"), (F.col("depth") + 1).alias("depth"))
        visits = settled(visits.unionByName(ahead), "visits")
        followed = settled(followed.union(todo.select("entry", "path")), "followed")
    shown = visits.where("depth = 0").unionByName(visits.join(entered.select("entry", F.col("path").alias("above")), ["entry", "above"]).select(*visits.columns))
    shown = shown.join(entered.select("entry", "path", F.lit(True).alias("enters")), ["entry", "path"], "left").withColumn("one", F.lit(1))
    out = prefix_sums(shown, ["entry"], [F.col("path")], "one", "place")
    return out.select("entry", F.col("place").cast("long").alias("place"), "id", "depth", F.col("enters").isNull().alias("repeated"))
