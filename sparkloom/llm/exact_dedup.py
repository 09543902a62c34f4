"""Exact dedup: equal texts are found by skew-safe combining.

Three combines, and each compares whole texts, for the text itself is part of the grouping key; the digest only deals the
rows out. (1) Each task of the scan folds its own equal texts into one row, which is the map side of the salted grouping.
(2) Rows meet by digest, salt and text. Digests of many rows, of which there are at most HOT_DIGESTS, are dealt over several
salts; the others have one, and are done. (3) The salts' winners of such digests meet by digest and text. Texts travel once;
the counts of digests, which say which are hot, and the places of rows in their groups are narrow.

Should two different texts have one digest, their rows are told apart by text: `digest` can be any function of the text, and
the tests take a poor one.

A null text counts as empty. Of equal texts the row with the largest doc_id stays; null doc_ids are smaller than all others.
Exactly one row of a group stays, also among rows that repeat a doc_id (which of these is not defined: they are equal but for
other columns). Very long texts are compared whole. Columns besides doc_id and text are kept, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, release, table, whole_rows

#: A digest is hot from so many rows on, and from so large a share of all rows on that HOT_DIGESTS can't be passed.
HOT_ROWS, HOT_DIGESTS = 512, 10_000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def text_classes(keyed: DataFrame, hot: DataFrame) -> DataFrame:
    """keyed (digest, doc_id, text) and hot (hot_digest, salts) -> (digest, keep_id, group_size, is_hot) of each different text."""
    # a task's rows of a text go to one salt, so that they can be folded before they leave it
    salted = keyed.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    salted = salted.withColumn("salt", F.expr("pmod(spark_partition_id(), salts)"))
    winners = salted.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = winners.select("digest", "salt", "keep_id", "group_size", F.expr("if(salt IS NULL, NULL, text)").alias("text"))
    winners = materialize(winners, "exact-winners")
    last = winners.where("salt IS NOT NULL").groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    done = winners.where("salt IS NULL").select("digest", "keep_id", "group_size", F.lit(False).alias("is_hot"))
    out = materialize(done.union(last.select("digest", "keep_id", "group_size", F.lit(True))), "exact-classes")
    release(winners)
    return out


def _told_apart(docs: DataFrame, shared: DataFrame, digest: Callable) -> DataFrame:
    """Groups of rows whose digest several different texts have."""
    rows = docs.select("doc_id", _text().alias("text")).withColumn("digest", digest(F.col("text")))
    rows = rows.join(shared.hint("merge"), "digest", "left_semi").withColumn("uid", F.monotonically_increasing_id())
    rows = materialize(rows, "exact-shared")
    groups = rows.groupBy("text").agg(F.max(F.struct("doc_id", "uid")).alias("top"), F.count("*").alias("group_size"))
    kept = (F.col("uid") == F.col("top.uid")).alias("kept")
    return rows.join(groups.hint("merge"), "text").select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", kept, sha256(F.col("text")).alias("text_sha256"))


def groups_of_equal_texts(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs."""
    keyed = docs.select("doc_id", _text().alias("text")).withColumn("digest", digest(F.col("text")))
    named = F.col("digest") if digest is sha256 else sha256(F.col("text"))
    rows = materialize(keyed.select("doc_id", "digest", named.alias("text_sha256"), F.monotonically_increasing_id().alias("uid")), "exact-rows")
    counts = materialize(rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "uid")).alias("top")), "exact-counts")
    at_least = max(HOT_ROWS, rows.count() // HOT_DIGESTS + 1)
    hot = counts.where(F.col("n") >= at_least).select(F.col("digest").alias("hot_digest"), F.ceil(F.col("n") / at_least).cast("int").alias("salts"))

    classes = text_classes(keyed, hot)
    shared = classes.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    collides = not shared.isEmpty()
    if collides:
        shared = materialize(shared, "exact-collisions")
        classes, rows = (x.join(shared.hint("merge"), "digest", "left_anti") for x in (classes, rows))
    placed = classes.join(counts.select("digest", F.col("top.uid").alias("top_uid")).hint("merge"), "digest")
    # rows of hot digests meet their group where they are: there is one row of each
    held = rows.join(F.broadcast(hot.select("hot_digest")), F.col("digest") == F.col("hot_digest"), "left")
    found = held.where("hot_digest IS NULL").join(placed.where("NOT is_hot").hint("merge"), "digest")
    found = found.unionByName(held.where("hot_digest IS NOT NULL").join(F.broadcast(placed.where("is_hot")), "digest"))
    out = found.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("top_uid")).alias("kept"), "text_sha256")
    return out.unionByName(_told_apart(docs, shared, digest)) if collides else out


def drop_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """docs with one row of each text; the other columns stay, whatever their names."""
    kept = groups_of_equal_texts(docs, digest).where("kept").select(F.col("doc_id").alias("keep_id"), "text_sha256")
    rows = docs.select(whole_rows(docs), "doc_id", sha256(_text()).alias("own"))
    staying = rows.join(kept.hint("merge"), F.expr("own = text_sha256 AND doc_id <=> keep_id"), "left_semi")
    return staying.groupBy("own", "doc_id").agg(F.first("row").alias("row")).select("row.*")  # of rows that repeat both, one


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups_of_equal_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def oracle() -> str:
    return """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text"""
