"""Changes of declarations between two states of files, renames among them matched by how alike they are."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.graph import in_passes, release, settled

#: Share of all tokens of two declarations that a rename has in common, and digits to which it is rounded.
ALIKE, DIGITS = 0.6, 6
#: Fixed value: tokens that are put last in the order of all, the most common ones.
COMMON = 4096
#: Fixed value: shared tokens that a pass may have, if there are fewer tokens.
PASS_SHARED = 2_000_000


def _set(tokens: Column) -> Column:
    """A set of tokens as one text, the same for equal sets: far shorter than an array when rows travel."""
    return F.to_json(F.array_sort(F.array_distinct(F.array_compact(tokens))))


def _prefixes(sides: DataFrame, alike: float) -> DataFrame:
    """sides(side, id, file, set) -> (side, id, file, n, rest, token): the first tokens of each set in an order of all, so many that two
    that are alike share one of them, and how many tokens come after. Common tokens are last in the order, by how many sets have them."""
    tokens = sides.select(F.explode(F.from_json("set", "array<string>")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    top = tokens.orderBy(F.desc("df"), "token").limit(COMMON).collect()
    place = {r["token"]: len(top) - k for k, r in enumerate(top)}  # the others are at 0
    least = alike - 10.0**-DIGITS

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for side, number, file, held in zip(*[batch.column(n).to_pylist() for n in ("side", "id", "file", "set")], strict=True):
                ordered = sorted(json.loads(held), key=lambda t: (place.get(t, 0), t))
                n = len(ordered)
                size = min(n, n - int(-(-n * least // 1)) + 1)
                for column, value in zip(out[:5], (side, number, file, n, n - size), strict=True):
                    column.extend([value] * size)
                out[5].extend(ordered[:size])
            kinds = (pa.bool_(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["side", "id", "file", "n", "rest", "token"])

    return sides.select("side", "id", F.col("file").cast("string").alias("file"), "set").mapInArrow(first, "side boolean, id long, file string, n int, rest int, token string")


def _matched(gone: DataFrame, come: DataFrame, alike: float) -> DataFrame:
    """matched_renames() of (file, name, set). Of equal sets of a file only the least name can be anyone's most alike, so each set is
    one row with a number. Pairs that share one of their first tokens are counted; those that can still be alike (what they share
    so far and all that comes after) are compared whole."""
    both = gone.withColumn("side", F.lit(False)).unionByName(come.withColumn("side", F.lit(True))).where("set IS NOT NULL AND set <> '[]'")
    sides = both.groupBy("side", "file", "set").agg(F.min("name").alias("name"))
    sides = settled(sides.withColumn("id", F.monotonically_increasing_id()), "sets")  # numbers stay from here on
    first = settled(_prefixes(sides, alike), "prefixes")
    a = first.where("NOT side").select("file", "token", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"))
    b = first.where("side").select("file", "token", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"))
    sizes = (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (alike - 10.0**-DIGITS)).alias("sizes")
    share = alike - 10.0**-DIGITS
    # shared tokens may be far more than tokens; sets go in passes, so that a pass has no more of them
    counts = first.groupBy("file", "token").agg(F.count_if("side").alias("x"), F.count_if(~F.col("side")).alias("y"))
    sums = counts.agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("shared"), F.coalesce(F.sum(F.col("x") + F.col("y")), F.lit(0)).alias("tokens")).first()
    passes = sums["shared"] // max(PASS_SHARED, sums["tokens"]) + 1

    def can_be(own: DataFrame) -> DataFrame:
        pairs = own.join(b, ["file", "token"]).where(sizes).groupBy("a", "b")
        pairs = pairs.agg(F.count("*").alias("c"), F.max(F.col("n_a") + F.col("n_b")).alias("n"), F.max(F.greatest("rest_a", "rest_b")).alias("rest"))
        return pairs.where((F.col("c") + F.col("rest")) * (1 + share) >= F.col("n") * share).select("a", "b")

    pairs = in_passes([lambda n=n: can_be(a.where(F.expr(f"pmod(xxhash64(a), {passes})") == n)) for n in range(passes)], "pairs")
    release(first)
    held = lambda own: sides.select(F.col("id").alias(own), "file", F.col("name").alias(f"name_{own}"), F.col("set").alias(f"set_{own}"))
    pairs = pairs.join(held("a"), "a").join(held("b").drop("file"), "b")
    x, y = (F.from_json(c, "array<string>") for c in ("set_a", "set_b"))
    pairs = pairs.select("file", F.col("name_a").alias("old"), F.col("name_b").alias("new"), F.size(F.array_intersect(x, y)).alias("shared"), (F.size(x) + F.size(y)).alias("n"))
    pairs = pairs.select("file", "old", "new", F.round(F.col("shared") / (F.col("n") - F.col("shared")), DIGITS).alias("similarity")).where(F.col("similarity") >= alike)
    pairs = settled(pairs, "alike")
    best = lambda own, other: pairs.groupBy("file", own).agg(F.min_by(other, F.struct(-F.col("similarity"), other)).alias(other))
    return pairs.join(best("old", "new"), ["file", "old", "new"], "left_semi").join(best("new", "old"), ["file", "old", "new"], "left_semi")


def matched_renames(gone: DataFrame, come: DataFrame, alike: float = ALIKE) -> DataFrame:
    """gone and come (file, name, tokens: a set) -> (file, old, new, similarity): pairs of a file of which each is the other's most
    alike (ties to the least name), with a Jaccard similarity of at least `alike`."""
    gone, come = (x.select("file", "name", _set(F.col("tokens")).alias("set")) for x in (gone, come))
    return _matched(gone, come, alike)


def semantic_changes(before: DataFrame, after: DataFrame, moved: DataFrame | None = None, alike: float = ALIKE) -> DataFrame:
    """before and after (file, name, fingerprint, tokens), moved (old_file, new_file) -> (file, event, entity, was): CREATED, DELETED,
    MODIFIED, MOVED (in a file that has moved, else as it was) and RENAMED (was: the old name). Files are told by their new
    paths. A name that is there on both sides is the same declaration; of the others the most alike pairs of a file are renames."""
    if moved is not None:
        to = moved.select(F.col("old_file").alias("file"), F.col("new_file").alias("_to"))
        before = before.join(to, "file", "left").select(F.coalesce("_to", "file").alias("file"), "name", "fingerprint", "tokens", F.col("_to").isNotNull().alias("_moved"))
    else:
        before = before.select("file", "name", "fingerprint", "tokens", F.lit(False).alias("_moved"))
    # tokens travel once, with what tells whether they are needed
    old = before.select("file", "name", F.col("fingerprint").alias("_old"), "_moved", _set(F.col("tokens")).alias("_x"), F.lit(True).alias("_was"))
    new = after.select("file", "name", F.col("fingerprint").alias("_new"), _set(F.col("tokens")).alias("_y"), F.lit(True).alias("_is"))
    both = old.join(new, ["file", "name"], "full_outer")
    same = F.col("_old").eqNullSafe(F.col("_new"))
    event = F.when(F.col("_was").isNull(), "CREATED").when(F.col("_is").isNull(), "DELETED").when(~same, "MODIFIED").when(F.col("_moved"), "MOVED")
    held = F.when(F.col("_was").isNull(), F.col("_y")).when(F.col("_is").isNull(), F.col("_x"))
    rows = settled(both.select("file", event.alias("event"), F.col("name").alias("entity"), held.alias("set")).where("event IS NOT NULL"), "events")
    events, side = rows.drop("set"), lambda kind: rows.where(F.col("event") == kind).select("file", F.col("entity").alias("name"), "set")
    renamed = settled(_matched(side("DELETED"), side("CREATED"), alike), "renamed")
    left = events.join(renamed.select("file", F.col("old").alias("entity"), F.lit("DELETED").alias("event")), ["file", "entity", "event"], "left_anti")
    left = left.join(renamed.select("file", F.col("new").alias("entity"), F.lit("CREATED").alias("event")), ["file", "entity", "event"], "left_anti")
    return left.select("file", "event", "entity", F.lit(None).cast("string").alias("was")).union(renamed.select("file", F.lit("RENAMED"), "new", "old"))
