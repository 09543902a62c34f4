"""Rankings: round robin, diversification, budgets, bands, ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.graph import settled
from sparkloom.operators.sums import percentile, prefix_sums


def round_robin(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """With turn (place in its group) and lead_<c> of the group's first row: sorted by turn, then the leads, this is the
    round-robin order. A group's rows are counted in shares, so one of any size is dealt over tasks; the order is total."""
    lead = [c for c in rows.columns if c != group]
    ranked = settled(prefix_sums(rows.withColumn("_one", F.lit(1)), [group], order, "_one", "_before"), "turns")
    ranked = ranked.select(*rows.columns, (F.col("_before") + 1).cast("int").alias("turn"))
    firsts = ranked.where("turn = 1").select(F.col(group).alias("_group"), *[F.col(c).alias(f"lead_{c}") for c in lead])
    return ranked.join(firsts, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def diversify(rows: DataFrame, key: str, group: str, score: str, max_anchors: int = 3, ratio: float = 0.75) -> DataFrame:
    """is_anchor for the leading run of rows within ratio of the top score, turn for the others in their group (null
    groups are groups of their own). Anchors are found among the top few rows, so that no total order is made."""
    head = rows.orderBy(F.desc(score), key).limit(max_anchors)
    w = Window.orderBy(F.desc(score), key)  # max_anchors rows
    head = head.withColumn("_top", F.max(score).over(w)).withColumn("_ok", (F.col(score) >= F.col("_top") * ratio).cast("int"))
    anchors = head.withColumn("_run", F.min("_ok").over(w)).where("_run = 1").select(F.col(key).alias("_anchor"))
    marked = rows.join(F.broadcast(anchors), F.col(key) == F.col("_anchor"), "left").withColumn("is_anchor", F.col("_anchor").isNotNull()).drop("_anchor")
    own = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("@"), F.col(key).cast("string")))
    turn = F.row_number().over(Window.partitionBy("is_anchor", own).orderBy(F.desc(score), key))
    return marked.withColumn("turn", F.when(F.col("is_anchor"), 0).otherwise(turn))


def prefix_within(rows: DataFrame, group: list[str], order: list[Column], cost: str, budget: float | Column) -> DataFrame:
    """The rows of each group, in order, until the first that takes the sum over the budget; the order is total. Groups are
    summed in shares, so one of any size is dealt over tasks."""
    return prefix_sums(rows, group, order, cost, "_before").withColumn("used", F.col("_before") + F.col(cost)).drop("_before").where(F.col("used") <= budget)


def greedy_pack(rows: DataFrame, group: list[str], key: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """(group..., used, n, taken): rows of each group taken in order, leaving out any that no longer fits; taken has their keys.

    In rounds: of what is left of a group, the longest prefix that fits is taken, and rows dearer than the rest of the budget
    go. Prefixes are summed in shares of a group, so one of any size is dealt over tasks; each round takes a row or more, and
    what remains of most groups is gone after a few. Rows without a cost are left out."""
    left = rows.where(F.col(cost).isNotNull() & (F.col(cost) <= budget)).select(*group, F.struct(*order_fields(order), F.col(key).alias("_key")).alias("_at"), F.col(key).alias("_key"), F.col(cost).cast("long").alias("_cost"))
    left = settled(left.withColumn("_rest", F.lit(budget).cast("long")), "pack")
    taken = None
    while True:
        run = settled(prefix_sums(left, group, [F.col("_at")], "_cost", "_before").withColumn("_run", F.col("_before") + F.col("_cost")).drop("_before"), "pack")
        first = run.groupBy(*group).agg(F.min(F.when(F.col("_run") > F.col("_rest"), F.col("_at"))).alias("_stop"))
        marked = run.join(first, group).withColumn("_in", F.col("_stop").isNull() | (F.col("_at") < F.col("_stop")))
        now = marked.where("_in").select(*group, "_at", "_key", "_cost")
        taken = now if taken is None else taken.union(now)
        used = marked.where("_in").groupBy(*group).agg(F.sum("_cost").alias("_used"))
        left = marked.where("NOT _in").join(used, group, "left").withColumn("_rest", F.col("_rest") - F.coalesce("_used", F.lit(0)))
        left = settled(left.where("_cost <= _rest").select(*group, "_at", "_key", "_cost", "_rest"), "pack")
        if left.isEmpty():
            break
    # what was taken is bounded by the budget, not by the group
    return taken.groupBy(*group).agg(F.sum("_cost").alias("used"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_at", "_key"))), lambda x: x["_key"]).alias("taken"))


def order_fields(order: list[Column]) -> list[Column]:
    """Fields of a struct that sorts as the columns do: those of numbers that are to fall are negated."""
    return [c.alias(f"_o{n}") for n, c in enumerate(order)]


def ordered_fold(rows: DataFrame, group: list[str], order: str, chunk: Column, delta: str, start: float, low: float, high: float) -> DataFrame:
    """Each group's value after its deltas in order, held between low and high after each.

    A run of held steps is itself one: a shift, a floor and a ceiling. So a group's rows are folded in chunks (a column that
    rises with the order, such as the day), and the few chunks' triples after each other; no group is held as one."""
    held = lambda x: F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))
    step = lambda acc, x: F.struct((acc["shift"] + x[delta]).alias("shift"), held(acc["floor"] + x[delta]).alias("floor"), held(acc["ceiling"] + x[delta]).alias("ceiling"))
    wide = F.struct(F.lit(0.0).alias("shift"), F.lit(float("-inf")).alias("floor"), F.lit(float("inf")).alias("ceiling"))
    parts = rows.groupBy(*group, chunk.alias("_chunk")).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(delta).cast("double").alias(delta)))).alias("_rows"))
    parts = parts.select(*group, "_chunk", F.aggregate("_rows", wide, step).alias("f"))
    listed = parts.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_chunk", "f"))).alias("_parts"))
    apply = lambda acc, x: F.least(F.greatest(acc + x["f"]["shift"], x["f"]["floor"]), x["f"]["ceiling"])
    return listed.select(*group, F.aggregate("_parts", F.lit(float(start)), apply).alias("value"))


def rank_bands(rows: DataFrame, score: str, key: str) -> DataFrame:
    """level: high for the top twentieth (10 at most) of 40 points and more, medium for the top quarter of 15 and more."""
    n = rows.agg(F.count("*").alias("_n"))
    top = rows.select(F.col(key).alias("_k"), F.col(score).alias("_s")).orderBy(F.desc("_s"), "_k").limit(10)
    top = top.withColumn("_rk", F.row_number().over(Window.orderBy(F.desc("_s"), "_k"))).select("_k", "_rk")  # 10 rows
    # the quarter's edge is a value, found without sorting all rows in one place
    edge = percentile(rows, [], score, 0.75, "_edge")
    out = rows.join(F.broadcast(top), F.col(key) == F.col("_k"), "left").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(edge))
    high = (F.col("_rk") <= F.ceil(F.col("_n") * 0.05)) & (F.col(score) >= 40)
    level = F.when(high, "high").when((F.col(score) >= F.col("_edge")) & (F.col(score) >= 15), "medium").otherwise("low")
    return out.withColumn("level", level).drop("_k", "_rk", "_n", "_edge")
