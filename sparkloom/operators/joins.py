"""Joins beyond equality: snapshots, intervals, bands, ladders, suffixes, ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, status): added, deleted, modified or unchanged."""
    a = old.select(F.col(key), F.col(fingerprint).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(F.col(key), F.col(fingerprint).alias("_new"), F.lit(True).alias("_in_new"))
    status = (
        F.when(F.col("_in_old").isNull(), "added")
        .when(F.col("_in_new").isNull(), "deleted")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("modified")
    )
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def renames(old: DataFrame, new: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(old_key, new_key): deleted and added rows of one fingerprint, where it is the only one on both sides."""
    status = snapshot_diff(old, new, key, fingerprint)

    def side(rows: DataFrame, kind: str) -> DataFrame:
        own = rows.join(status.where(F.col("status") == kind).select(key), key, "left_semi").where(F.col(fingerprint).isNotNull())
        return own.groupBy(fingerprint).agg(F.count("*").alias("n"), F.min(key).alias(f"{kind}_key")).where("n = 1").drop("n")

    return side(old, "deleted").join(side(new, "added"), fingerprint).select(F.col("deleted_key").alias("old_key"), F.col("added_key").alias("new_key"))


def baseline_status(current: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """current with status new or existing, and the baseline's keys that are gone as fixed."""
    marked = current.join(baseline.select(key).distinct().withColumn("_b", F.lit(True)), key, "left")
    now = marked.select(key, F.when(F.col("_b"), "existing").otherwise("new").alias("status"))
    gone = baseline.select(key).distinct().join(current.select(key), key, "left_anti").withColumn("status", F.lit("fixed"))
    return now.union(gone)


def interval_join(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, bucket: int) -> DataFrame:
    """Points inside spans [start, end] of the same by. Spans are put in every bucket they touch and points in their own,
    so that it is an equi-join with a check; choose a bucket near the usual length of a span."""
    p = points.withColumn("_bucket", F.floor(F.col(at) / bucket))
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    return p.join(s, [*by, "_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_bucket")


def innermost(points: DataFrame, spans: DataFrame, by: list[str], point_id: str, at: str, span_id: str, start: str, end: str, bucket: int) -> DataFrame:
    """(point_id, span_id): the shortest span around each point, the least id of equals."""
    found = interval_join(points, spans, by, at, start, end, bucket)
    return found.groupBy(point_id).agg(F.min_by(span_id, F.struct(F.col(end) - F.col(start), F.col(span_id))).alias(span_id))


def band_join(left: DataFrame, right: DataFrame, by: list[str], a: str, b: str, width: int) -> DataFrame:
    """Pairs of the same by whose values differ by less than width: each left row goes to its own bucket and the next on
    either side, right rows to theirs."""
    x = left.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col(a) / width) + k for k in (-1, 0, 1)])))
    y = right.withColumn("_bucket", F.floor(F.col(b) / width))
    return x.join(y, [*by, "_bucket"]).where(F.abs(F.col(a) - F.col(b)) < width).drop("_bucket")


def ladder(refs: DataFrame, targets: DataFrame, ref: str, target: str, rungs: list[tuple[str, list[str], list[str], float]]) -> DataFrame:
    """rungs(name, columns of refs, columns of targets, confidence): for each ref the first rung at which exactly one target has
    the ref's values. Columns: ref, target, rung, confidence; null where no rung decides.

    Targets are counted by a rung's columns before they are joined, and only those that stand alone are, so a join never
    makes more rows than there are refs."""
    rows = refs
    for n, (_, own, theirs, _) in enumerate(rungs):
        alone = targets.groupBy(*[F.col(t).alias(f"_k{n}_{k}") for k, t in enumerate(theirs)]).agg(F.min(target).alias(f"_t{n}"), F.count("*").alias("_c")).where("_c = 1").drop("_c")
        rows = rows.join(alone, [rows[o] == alone[f"_k{n}_{k}"] for k, o in enumerate(own)], "left").drop(*[f"_k{n}_{k}" for k in range(len(own))])
    first = F.coalesce(*[F.when(F.col(f"_t{n}").isNotNull(), F.struct(F.col(f"_t{n}").alias("target"), F.lit(name).alias("rung"), F.lit(conf).alias("confidence"))) for n, (name, _, _, conf) in enumerate(rungs)])
    return rows.select(ref, first.alias("_f")).select(ref, F.col("_f.target").alias(target), F.col("_f.rung").alias("rung"), F.col("_f.confidence").alias("confidence"))


def unique_suffix(refs: DataFrame, paths: DataFrame, ref: str, path: str) -> DataFrame:
    """(ref, path): the path equal to a reference, else the only one that ends in "/" and the reference. Candidates share
    the last part of the path."""
    base = lambda c: F.substring_index(F.col(c), "/", -1)
    found = refs.select(ref).distinct().withColumn("_base", base(ref)).join(paths.select(path).distinct().withColumn("_base", base(path)), "_base")
    found = found.where((F.col(path) == F.col(ref)) | F.col(path).endswith(F.concat(F.lit("/"), F.col(ref)))).withColumn("_same", F.col(path) == F.col(ref))
    sums = found.groupBy(ref).agg(F.min(F.when(F.col("_same"), F.col(path))).alias("_exact"), F.count("*").alias("_n"), F.min(path).alias("_only"))
    return sums.select(ref, F.when(F.col("_exact").isNotNull(), F.col("_exact")).when(F.col("_n") == 1, F.col("_only")).alias(path))


def last_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """rules(pattern, verdict) in order: the verdict of the last rule that matches, null if none does. Rules are a hand-written
    list and become one expression, so rows and rules are never joined."""
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(verdict)) for pattern, verdict in reversed(rules)])


def most_specific(rules: list[tuple[str, int, bool, Column]]) -> Column:
    """rules(verdict, score, forbids, test): the verdict of the highest score; of equals, one that forbids. One expression."""
    held = [F.when(test, F.struct(F.lit(score).alias("score"), F.lit(forbids).alias("forbids"), F.lit(verdict).alias("verdict"))) for verdict, score, forbids, test in rules]
    return F.array_max(F.array_compact(F.array(*held)))["verdict"]


def compare_outcomes(before: DataFrame, after: DataFrame, key: str, passed: str) -> DataFrame:
    """Case by case: improved, regressed, same, missing (not run again) or new."""
    b = before.select(key, F.col(passed).alias("_b"), F.lit(True).alias("_in_b"))
    a = after.select(key, F.col(passed).alias("_a"), F.lit(True).alias("_in_a"))
    change = (
        F.when(F.col("_in_a").isNull(), "missing")
        .when(F.col("_in_b").isNull(), "new")
        .when(F.col("_a") & ~F.col("_b"), "improved")
        .when(~F.col("_a") & F.col("_b"), "regressed")
        .otherwise("same")
    )
    return b.join(a, key, "full_outer").select(key, change.alias("change"))


def first_seen(series: DataFrame, key: str, ordinal: str) -> DataFrame:
    """series(key, ordinal): where each key's present stay began: the last step from absent to present, for keys that are
    there at the end. Ordinals are consecutive."""
    last = series.agg(F.max(ordinal).alias("_end"))
    w = Window.partitionBy(key).orderBy(ordinal)
    steps = series.select(key, ordinal).distinct().withColumn("_before", F.lag(ordinal).over(w))
    starts = steps.where(F.col("_before").isNull() | (F.col("_before") < F.col(ordinal) - 1))
    here = steps.groupBy(key).agg(F.max(ordinal).alias("_last")).crossJoin(F.broadcast(last)).where("_last = _end").select(key)
    return starts.join(here, key, "left_semi").groupBy(key).agg(F.max(ordinal).alias("introduced"))
