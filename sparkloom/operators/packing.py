"""Packing a budget by levels of detail, for many questions at once.

A question's candidates are few by definition (MAX_ITEMS), so each question is one row with an array of them, and packing is a
fold over that array: budget, what anchors have spent and each candidate's level are carried through the passes in order.
Ranking before it is done on rows; nothing of a question but its chosen candidates meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of detail, least first.
LEVELS = ["relationship", "summary", "signature", "section", "source"]
#: The passes over candidates (all, anchors or others), the level they raise to, and the share of the budget that
#: anchors may have spent after it.
PASSES = [
    ("all", "relationship", 1.0), ("anchors", "summary", 1.0), ("anchors", "signature", 0.55), ("anchors", "section", 0.55), ("anchors", "source", 0.55),
    ("others", "summary", 1.0), ("others", "signature", 1.0), ("others", "section", 1.0), ("anchors", "signature", 1.0), ("anchors", "section", 1.0), ("anchors", "source", 1.0),
]
#: Candidates of a question at most, tokens of budget for each, and the share of the best score that others need.
MAX_ITEMS, TOKENS_PER_ITEM, SCORE_FLOOR = 40, 100, 0.2
#: Anchors at most, and the share of the best score down to which they go.
MAX_ANCHORS, ANCHOR_RATIO = 3, 0.75


def choose_candidates(hits: DataFrame, question: str, key: str, group: str, score: str, budget: int) -> DataFrame:
    """Of each question's hits its anchors, then the others in turns of their groups, as far as the budget has room for items:
    with is_anchor and place (from 0). Ties go by key. Questions are windowed by themselves; their hits are as many as a
    retrieval's limit lets through."""
    by_score = Window.partitionBy(question).orderBy(F.desc(score), key)
    rows = hits.withColumn("_rank", F.row_number().over(by_score)).withColumn("_top", F.first(score).over(by_score))
    near = (F.col("_rank") <= MAX_ANCHORS) & (F.col(score) >= F.col("_top") * ANCHOR_RATIO)
    rows = rows.withColumn("is_anchor", near)  # scores fall, so those near the best are the first
    turn = F.row_number().over(Window.partitionBy(question, "is_anchor", group).orderBy("_rank"))
    rows = rows.withColumn("_turn", F.when(F.col("is_anchor"), 0).otherwise(turn)).where(F.col("is_anchor") | (F.col(score) >= F.col("_top") * SCORE_FLOOR))
    # others: a round of all groups after another, groups by their best
    lead = F.min("_rank").over(Window.partitionBy(question, "is_anchor", group))
    rows = rows.withColumn("_lead", F.when(F.col("is_anchor"), F.col("_rank")).otherwise(lead))
    place = F.row_number().over(Window.partitionBy(question).orderBy(F.desc("is_anchor"), "_turn", "_lead", "_rank")) - 1
    most = max(1, min(MAX_ITEMS, budget // TOKENS_PER_ITEM))
    n = F.count("*").over(Window.partitionBy(question))
    return rows.withColumn("place", place).withColumn("eligible", n).where(F.col("place") < most).drop("_rank", "_top", "_turn", "_lead")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def raised(items: Column, budget: Column) -> Column:
    """items: array of (is_anchor, most: the highest level it may have, costs: tokens at each level, null where it has none) ->
    (used, anchors, levels): the level of each item after all passes, -1 if it got none.

    A pass lifts an item to its level if the item has a lower one (or none, in the first), may have it, and the difference
    fits into the budget and, for an anchor, into the anchors' share."""
    order = [(group, LEVELS.index(level), share) for group, level, share in PASSES]
    steps = F.array(*[F.struct(F.lit(g).alias("of"), F.lit(level).alias("level"), F.lit(share).alias("share")) for g, level, share in order])
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("anchors"), F.transform(items, lambda _: F.lit(-1)).alias("levels"))

    def lift(state: Column, step: Column, at: Column) -> Column:
        def with_item(c: Column) -> Column:
            now = F.get(state["levels"], at)
            more = F.get(c["costs"], step["level"]).cast("long") - F.coalesce(F.when(now >= 0, F.get(c["costs"], now)), F.lit(0))
            in_pass = (step["of"] == "all") | ((step["of"] == "anchors") == c["is_anchor"])
            rises = (step["level"] <= c["most"]) & (step["level"] > now) & ((step["level"] == 0) | (now >= 0))
            fits = (state["used"] + more <= budget) & (~c["is_anchor"] | (state["anchors"] + more <= budget * step["share"]))
            return _let(
                F.when(in_pass & rises & fits, more),
                lambda spent: F.when(
                    spent.isNotNull(),
                    F.struct(
                        (state["used"] + spent).alias("used"),
                        (state["anchors"] + F.when(c["is_anchor"], spent).otherwise(0)).alias("anchors"),
                        F.transform(state["levels"], lambda x, k: F.when(k == at, step["level"]).otherwise(x)).alias("levels"),
                    ),
                ).otherwise(state),
            )

        return _let(F.get(items, at), with_item)

    places = F.sequence(F.lit(0), F.size(items) - 1)
    return F.when(F.size(items) > 0, F.aggregate(steps, start, lambda state, step: F.aggregate(places, state, lambda inner, at: lift(inner, step, at)))).otherwise(start)


def packets(candidates: DataFrame, question: str, key: str, budget: int) -> DataFrame:
    """candidates of choose_candidates() with most and costs -> (question, used, included, dropped, downgraded, items): items are
    (key, level, tokens) in their order, without those that got no level. dropped counts eligible hits that aren't included,
    downgraded the included ones that may have had more."""
    listed = F.array_sort(F.collect_list(F.struct("place", F.col(key).alias("key"), "is_anchor", "most", "costs")))
    rows = candidates.groupBy(question).agg(listed.alias("c"), F.max("eligible").alias("eligible"))
    rows = rows.withColumn("r", raised(F.col("c"), F.lit(budget).cast("long")))
    every = F.transform("c", lambda c, k: F.struct(c["key"].alias("key"), F.get("r.levels", k).alias("level"), F.get(c["costs"], F.get("r.levels", k)).cast("long").alias("tokens"), c["most"].alias("most"), c["costs"].alias("costs")))
    rows = rows.withColumn("i", F.filter(every, lambda x: x["level"] >= 0))
    richer = lambda x: F.exists(F.slice(x["costs"], x["level"] + 2, F.greatest(x["most"] - x["level"], F.lit(0))), lambda t: t.isNotNull())
    return rows.select(
        question, "r.used", F.size("i").alias("included"), (F.col("eligible") - F.size("i")).alias("dropped"), F.size(F.filter("i", richer)).alias("downgraded"),
        F.transform("i", lambda x: F.struct(x["key"].alias("key"), F.get(F.array(*map(F.lit, LEVELS)), x["level"]).alias("level"), x["tokens"].alias("tokens"))).alias("items"),
    )


def packed_in_order(costs: Column, budget: Column) -> Column:
    """(used, taken): which of the costs, gone through in order, still fit when their turn comes; dearer ones are passed over."""
    step = lambda s, cost: F.when(s["used"] + cost <= budget, F.struct((s["used"] + cost).alias("used"), F.concat(s["taken"], F.array(F.lit(True))).alias("taken"))).otherwise(
        F.struct(s["used"].alias("used"), F.concat(s["taken"], F.array(F.lit(False))).alias("taken"))
    )
    return F.aggregate(costs, F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("taken")), step)


def select_sections(sections: Column, budget: Column, least_rest: int = 80, margin: int = 20) -> Column:
    """sections: array of (rank, hits, tokens: long, lines: tokens of the text up to each line at which it may be cut) in the
    record's order -> (used, chosen, partial, partial_lines). Sections go by rank, then more hits, then place; one that doesn't
    fit is passed over. The first that was passed over may still be opened, cut at the last line within what is left less a
    margin, if at least least_rest is left and it keeps two lines or more. chosen and partial are places from 0; partial is
    null without one."""
    keyed = F.transform(sections, lambda s, k: F.struct(s["rank"].alias("rank"), (-s["hits"]).alias("less"), k.alias("at"), s["tokens"].cast("long").alias("tokens"), s["lines"].alias("lines")))

    def chosen(ordered: Column) -> Column:
        def opened(p: Column) -> Column:
            places = F.filter(F.transform(ordered, lambda s, k: F.when(F.get(p["taken"], k), s["at"])), lambda x: x.isNotNull())
            first_out = F.filter(F.transform(ordered, lambda s, k: F.when(~F.get(p["taken"], k), s)), lambda x: x.isNotNull())
            rest = budget - p["used"]
            kept = F.size(F.filter(F.get(first_out, F.lit(0))["lines"], lambda t: t <= rest - margin))
            opens = (F.size(first_out) > 0) & (rest >= least_rest) & (kept > 1)
            return F.struct(p["used"].alias("used"), F.array_sort(places).alias("chosen"), F.when(opens, F.get(first_out, F.lit(0))["at"]).alias("partial"), F.when(opens, kept).otherwise(0).alias("partial_lines"))

        return _let(packed_in_order(F.transform(ordered, lambda s: s["tokens"]), budget), opened)

    return _let(F.array_sort(keyed), chosen)


def fit_levels(items: Column, budget: Column) -> Column:
    """items in order of importance: array of (options: array of (level, tokens) from the one wished for down to the cheapest,
    elastic: tokens that the wished level could take at most, null if it takes no more) -> (used, levels, tokens), level null
    for items left out.

    While the sum is over the budget the last item is lowered by an option, and left out after its cheapest, before the one in
    front of it is touched. What is left then goes to items that still have their first option and are elastic, in order."""
    wished = F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s + F.get(x["options"], F.lit(0))["tokens"].cast("long"))
    none = F.struct(F.lit(None).cast("string").alias("level"), F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("long").alias("elastic"))

    def lower(state: Column, item: Column) -> Column:
        first = F.get(item["options"], F.lit(0))["tokens"].cast("long")
        fitting = F.filter(item["options"], lambda o: state["used"] - first + o["tokens"] <= budget)

        def settled(o: Column) -> Column:
            pick = F.when(o.isNull(), none).otherwise(F.struct(o["level"].alias("level"), o["tokens"].cast("long").alias("tokens"), F.when(o == F.get(item["options"], F.lit(0)), item["elastic"].cast("long")).alias("elastic")))
            return F.struct((state["used"] - first + F.coalesce(o["tokens"].cast("long"), F.lit(0))).alias("used"), F.concat(F.array(pick), state["done"]).alias("done"))

        return _let(F.get(fitting, F.lit(0)), settled)

    start = F.struct(wished.alias("used"), F.array().cast("array<struct<level:string,tokens:bigint,elastic:bigint>>").alias("done"))
    lowered = F.aggregate(F.reverse(items), start, lower)

    def refill(state: Column, x: Column) -> Column:
        room = F.greatest(F.least(budget - state["used"], F.coalesce(x["elastic"] - x["tokens"], F.lit(0).cast("long"))), F.lit(0).cast("long"))
        return _let(room, lambda more: F.struct((state["used"] + more).alias("used"), F.concat(state["levels"], F.array(x["level"])).alias("levels"), F.concat(state["tokens"], F.array(x["tokens"] + more)).alias("tokens")))

    return _let(lowered, lambda s: F.aggregate(s["done"], F.struct(s["used"].alias("used"), F.array().cast("array<string>").alias("levels"), F.array().cast("array<bigint>").alias("tokens")), refill))
