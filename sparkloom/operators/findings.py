"""Findings: identity, order, severity, debt, status, trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.sums import percentile

SEVERITIES = ("critical", "high", "medium", "low", "info")
CONFIDENCES = ("high", "medium", "low")
#: Debt points by severity.
POINTS = {"critical": 20, "high": 12, "medium": 7, "low": 3, "info": 1}


def rank_of(column: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.lit(list(order)), column), F.lit(0)), F.lit(len(order) + 1))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unique_ids(findings: DataFrame, id_column: str, seq: Column) -> DataFrame:
    """The second and later of equal ids get "#2", "#3", ..."""
    n = F.row_number().over(Window.partitionBy(id_column).orderBy(seq))
    return findings.withColumn("_n", n).withColumn(id_column, F.when(F.col("_n") > 1, F.concat(F.col(id_column), F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col(id_column))).drop("_n")


def finding_order() -> list[Column]:
    """Severity, confidence, file (null first), line (null as 0), id."""
    return [rank_of(F.col("severity"), SEVERITIES), rank_of(F.col("confidence"), CONFIDENCES), F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), F.col("id")]


def band(value: Column, high: float, medium: float, low: float) -> Column:
    return F.when(value >= high, "high").when(value >= medium, "medium").when(value >= low, "low").otherwise("info")


def status(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    return F.when(critical > 0, "critical").when((high > 0) | (medium >= 10), "degraded").when((medium > 0) | (low >= 5), "attention").otherwise("healthy")


def coverage_status(percent: Column) -> Column:
    return F.when(percent >= 80, "healthy").when(percent >= 60, "attention").when(percent >= 40, "degraded").otherwise("critical")


def ratio(part: Column, whole: Column) -> Column:
    """Percent with one decimal; all of nothing is 100."""
    return F.when(whole == 0, 100.0).otherwise(F.floor(part * 1000 / whole + 0.5) / 10)


def debt_points(findings: DataFrame, severity: str = "severity", weight: str = "weight", value: str = "value", threshold: str = "threshold") -> DataFrame:
    """points = severity points x dimension weight x (1 + how far over the threshold, 2 at most)."""
    sev = F.coalesce(*[F.when(F.col(severity) == s, F.lit(float(p))) for s, p in POINTS.items()], F.lit(0.0))
    over = F.when(F.col(threshold) > 0, F.least((F.col(value) - F.col(threshold)) / F.col(threshold), F.lit(2.0))).otherwise(0.0)
    return findings.withColumn("points", sev * F.col(weight) * (1 + F.greatest(over, F.lit(0.0))))


def debt_by_file(points: DataFrame, file: str, dimension: str) -> DataFrame:
    """(file, points, dimensions): points with 2 more for each dimension after the first."""
    per = points.groupBy(file, dimension).agg(F.sum("points").alias("p"))
    return per.groupBy(file).agg((F.sum("p") + 2 * (F.count("*") - 1)).alias("points"), F.count("*").alias("dimensions"))


def quadrants(files: DataFrame, complexity: str, churn: str) -> DataFrame:
    """Where a file lies against the medians of complexity and churn, over files with either above 0."""
    live = files.where((F.col(complexity) > 0) | (F.col(churn) > 0))
    mid = percentile(live, [], complexity, 0.5, "_c").crossJoin(percentile(live, [], churn, 0.5, "_h"))  # a row each
    c, h = F.col(complexity) > F.col("_c"), F.col(churn) > F.col("_h")
    name = F.when(c & h, "refactor").when(c, "watch").when(h, "active").otherwise("calm")
    return live.crossJoin(F.broadcast(mid)).withColumn("quadrant", name).drop("_c", "_h")


def by_category(rows: DataFrame, array: str, catalog: DataFrame, key: str) -> DataFrame:
    """Findings for each entry of a catalog (a hand-written list), those without any too."""
    counts = rows.select(F.explode(array).alias(key)).groupBy(key).agg(F.count("*").alias("n"))
    return F.broadcast(catalog).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def trend_points(runs: DataFrame, series: list[str], ordinal: str, digest: Column, keep: int) -> DataFrame:
    """Points whose digest differs from the one before, the last `keep` of each series."""
    w = Window.partitionBy(*series).orderBy(ordinal)
    changed = runs.withColumn("_d", digest).withColumn("_p", F.lag("_d").over(w)).where("_p IS NULL OR _p <> _d")
    last = F.row_number().over(Window.partitionBy(*series).orderBy(F.desc(ordinal)))
    return changed.withColumn("_n", last).where(F.col("_n") <= keep).drop("_n", "_d", "_p")


def worst(column: Column, order: tuple[str, ...]) -> Column:
    """Aggregate: the worst status, by place in order (the worst first)."""
    return F.min_by(column, rank_of(column, order))


def component_rank(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """score = sum of weight x value / its maximum (1 at least), three decimals."""
    most = rows.agg(*[F.greatest(F.max(c), F.lit(1)).alias(f"_{c}") for c in weights])
    score = reduce(lambda a, b: a + b, [w * F.col(c) / F.col(f"_{c}") for c, w in weights.items()])
    return rows.crossJoin(F.broadcast(most)).withColumn("score", F.floor(score * 1000 + 0.5) / 1000).drop(*[f"_{c}" for c in weights])


def feature_gap_risk(fan_in: Column, flags: dict[str, tuple[Column, int]]) -> Column:
    """Additive risk: fan-in up to 10, and points for each flag."""
    return F.least(fan_in, F.lit(10)) + reduce(lambda a, b: a + b, [F.when(test, points).otherwise(0) for test, points in flags.values()])
