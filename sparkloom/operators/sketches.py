"""Duplicates: equal keys, shingles, sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_groups(rows: DataFrame, key: str, fingerprint: Column) -> DataFrame:
    """(grp, n, first_id, last_id) of fingerprints that several rows share; sums only, so a group may be of any size."""
    groups = rows.groupBy(fingerprint.alias("grp")).agg(F.count("*").alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))
    return groups.where("n > 1")


def shingles(rows: DataFrame, key: str, words: Column, size: int) -> DataFrame:
    """(key, shingle): the distinct runs of `size` words of each row, as 64-bit hashes."""
    held = rows.select(key, words.alias("_w"))
    starts = F.when(F.size("_w") >= size, F.sequence(F.lit(1), F.size("_w") - (size - 1))).otherwise(F.array().cast("array<int>"))
    runs = F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("_w"), i, size))))
    return held.select(key, F.explode(runs).alias("shingle"))
