"""Signals to findings: the best of a subject's signals with the evidence of all, and clusters of findings that share evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.graph import components

#: What a signal can rest on, its confidence and its attention, best first.
BASES = ["explicit-rule", "approved-pattern", "project-pattern", "framework", "industry", "heuristic"]
CONFIDENCES = ["high", "medium", "low"]
ATTENTIONS = ["critical", "high", "moderate", "low", "informational"]
#: Places of evidence that a finding shows; findings that a place of evidence may be shared by to tie them together.
SHOWN, SHARED_BY = 12, 20
#: Parts of a subject whose best places are found apart.
PARTS = 32


def _place(column: str, order: list[str]) -> Column:
    """Where a value stands in a list; behind all where it doesn't."""
    return F.coalesce(*[F.when(F.col(column) == v, F.lit(k)) for k, v in enumerate(order)], F.lit(len(order)))


def assemble(signals: DataFrame) -> DataFrame:
    """signals(subject, title, text, basis, confidence, attention, evidence: array of (path, line)) -> (subject, title, basis,
    confidence, attention, n_signals, bases, evidence, more): of a subject's signals the one that rests on the best basis, then
    the more confident, the more urgent, the least title, gives title, basis and confidence; attention is the most urgent of all;
    bases are the different texts, best first; evidence is the union of places, those of better signals first, SHOWN at most,
    and more says how many others there are.

    Everything but the places is summed on the map side. Places are counted once each, by the best signal that has them, and the
    first of a subject are found in parts, then among the parts' first."""
    rank = F.struct(_place("basis", BASES).alias("basis"), _place("confidence", CONFIDENCES).alias("confidence"), _place("attention", ATTENTIONS).alias("attention"), F.col("title"))
    rows = signals.withColumn("rank", rank)
    urgent = F.get(F.array(*map(F.lit, ATTENTIONS)), F.min(_place("attention", ATTENTIONS)))
    best = rows.groupBy("subject").agg(F.min_by(F.struct("title", "basis", "confidence"), "rank").alias("b"), urgent.alias("attention"), F.count("*").alias("n_signals"))
    texts = rows.where("text IS NOT NULL").groupBy("subject", "text").agg(F.min(_place("basis", BASES)).alias("at"))
    bases = texts.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("bases"))
    places = rows.select("subject", "rank", F.explode("evidence").alias("e")).where("e IS NOT NULL").groupBy("subject", F.col("e.path").alias("path"), F.col("e.line").alias("line")).agg(F.min("rank").alias("rank"))
    counts = places.groupBy("subject").agg(F.count("*").alias("n_places"))
    part = F.pmod(F.xxhash64("path", "line"), F.lit(PARTS))
    first = lambda *by: F.row_number().over(Window.partitionBy("subject", *by).orderBy("rank", "path", F.col("line").asc_nulls_first()))
    shown = places.withColumn("part", part).withColumn("n", first("part")).where(F.col("n") <= SHOWN).withColumn("n", first()).where(F.col("n") <= SHOWN)
    evidence = shown.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "path", "line"))), lambda x: F.struct(x["path"].alias("path"), x["line"].alias("line"))).alias("evidence"))
    out = best.join(bases, "subject", "left").join(counts, "subject", "left").join(evidence, "subject", "left")
    empty = F.array().cast("array<struct<path:string,line:int>>")
    return out.select(
        "subject", "b.title", "b.basis", "b.confidence", "attention", "n_signals", F.coalesce("bases", F.array().cast("array<string>")).alias("bases"), F.coalesce("evidence", empty).alias("evidence"),
        F.greatest(F.coalesce("n_places", F.lit(0)) - SHOWN, F.lit(0)).alias("more"),
    )


def evidence_clusters(signals: DataFrame, shared_by: int = SHARED_BY) -> DataFrame:
    """(subject, cluster): subjects that share a place of evidence, directly or through others, under the least of them. A place that
    more than `shared_by` subjects have ties nothing together: it says nothing of any two, and clusters would run together."""
    held = signals.select("subject", F.explode("evidence").alias("e")).where("e IS NOT NULL").select("subject", F.concat_ws(":", "e.path", F.coalesce(F.col("e.line").cast("string"), F.lit(""))).alias("place")).distinct()
    telling = held.groupBy("place").agg(F.count("*").alias("n"), F.min("subject").alias("first")).where((F.col("n") > 1) & (F.col("n") <= shared_by))
    edges = held.join(telling, "place").where("subject <> first").select(F.col("subject").alias("src"), F.col("first").alias("dst"))
    found = components(edges).select(F.col("id").alias("subject"), F.col("component").alias("cluster"))
    return signals.select("subject").distinct().join(found, "subject", "left").select("subject", F.coalesce("cluster", "subject").alias("cluster"))
