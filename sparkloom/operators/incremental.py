"""State that is folded forward instead of being computed anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summarise(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """(keys, n, total, last): a state that can be folded with another of other rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(at).alias("last"))


def fold(state: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The state after the new rows' own summary: one small shuffle of both, no join."""
    return state.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last").alias("last"))


def invalidated(files: DataFrame, changed: DataFrame, depends: str = "depends_on", key: str = "path") -> DataFrame:
    """Files to analyse again: the changed ones, and those that depend on a changed one."""
    touched = changed.select(key).distinct()
    needs = files.select(key, F.explode(depends).alias("on")).join(touched.select(F.col(key).alias("on")), "on", "left_semi").select(key)
    return files.join(touched.union(needs).distinct(), key, "left_semi")


def reusable(results: DataFrame, sources: DataFrame, key: str = "path", fingerprint: str = "hash") -> DataFrame:
    """Stored results whose source has the same fingerprint still."""
    return results.join(sources.select(key, fingerprint), [key, fingerprint], "left_semi")


def freshness(stored: DataFrame, sources: DataFrame, key: str = "path", fingerprint: str = "hash") -> DataFrame:
    """(key, state): fresh, stale, missing (no stored result) or gone (no source)."""
    joined = stored.select(key, F.col(fingerprint).alias("was"), F.lit(True).alias("held")).join(
        sources.select(key, F.col(fingerprint).alias("now"), F.lit(True).alias("there")), key, "full_outer"
    )
    state = F.when(F.col("held").isNull(), "missing").when(F.col("there").isNull(), "gone").when(F.expr("was <=> now"), "fresh").otherwise("stale")
    return joined.select(key, state.alias("state"))


def registry_plan(stored: DataFrame, seen: DataFrame, config: str) -> DataFrame:
    """stored (id, config, size, mtime, hash) of the last run, seen (id, size, mtime, hash) now -> (id, action): reuse (size and time are
    as they were), recheck (they aren't, but the contents are: the entry stays and its times are renewed), rebuild (the contents
    changed, or the configuration that the entry was built with), build (new) or drop (gone). Of a null size or time nothing is
    known, so contents decide; a null hash is a change."""
    old = stored.select("id", F.col("config").alias("_config"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("hash").alias("_hash"), F.lit(True).alias("_old"))
    both = old.join(seen.select("id", "size", "mtime", "hash", F.lit(True).alias("_new")), "id", "full_outer")
    same_file = F.coalesce((F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")), F.lit(False))
    same_text = F.coalesce(F.col("hash") == F.col("_hash"), F.lit(False))
    action = (
        F.when(F.col("_new").isNull(), "drop").when(F.col("_old").isNull(), "build").when(~F.col("_config").eqNullSafe(F.lit(config)), "rebuild")
        .when(same_file, "reuse").when(same_text, "recheck").otherwise("rebuild")
    )
    return both.select("id", action.alias("action"))


def updated_registry(stored: DataFrame, seen: DataFrame, plan: DataFrame, built: DataFrame, config: str) -> DataFrame:
    """The registry after a plan: (id, config, size, mtime, hash, the other columns of built). Entries that are reused or rechecked keep
    what was stored for them, with today's size and time; built (id, ...) has those that were built anew; dropped ones go."""
    rest = [c for c in built.columns if c != "id"]
    kept = stored.join(plan.where("action IN ('reuse', 'recheck')").select("id"), "id", "left_semi").select("id", *rest)
    now = seen.select("id", F.lit(config).alias("config"), "size", "mtime", "hash")
    return now.join(kept.unionByName(built.select("id", *rest)), "id")
