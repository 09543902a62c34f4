"""Mentions of a dictionary's phrases in texts: leftmost, then longest, none inside another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a phrase at most.
MAX_WORDS = 10


def phrase_keys(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrases(words) -> (token, offset, term, words): each phrase of one to MAX_WORDS words under the token that docs(words) have
    least often, its first of equals. Phrases with a word that no document has are left out: they can't be found."""
    known = phrases.where(F.size("words").between(1, MAX_WORDS)).select("words", F.array_join("words", " ").alias("term")).dropDuplicates(["term"])
    parts = known.select("term", "words", F.posexplode("words").alias("offset", "token"))
    counts = docs.select(F.explode("words").alias("token")).join(parts.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = parts.join(counts, "token", "left").groupBy("term").agg(F.min(F.struct("n", "offset", "token")).alias("k"), F.count_if(F.col("n").isNull()).alias("absent"), F.any_value("words").alias("words"))
    return rarest.where("absent = 0").select("k.token", "k.offset", "term", "words")


def mentions(docs: DataFrame, phrases: DataFrame, doc_id: str) -> DataFrame:
    """docs(doc_id, words: array), phrases(words: array) -> (doc_id, start, n_words, term): the phrases that stand in each document,
    words counted from 0. From left to right the longest phrase that begins at a word is taken, and the search goes on
    behind it. doc_id is a key; null ones and documents without words are left out.

    Words that some phrase is filed under fetch it; candidates are gathered by document and held against its words there, so
    texts are joined once, not with each candidate."""
    rows = docs.where(F.col(doc_id).isNotNull() & (F.size("words") > 0)).select(F.col(doc_id).alias("_doc"), "words")
    keys = phrase_keys(rows, phrases)
    places = rows.select("_doc", F.posexplode("words").alias("at", "token")).join(keys, "token")
    places = places.select("_doc", F.struct((F.col("at") - F.col("offset")).alias("start"), (-F.size(keys["words"])).alias("less"), "term", keys["words"].alias("phrase")).alias("c")).where("c.start >= 0")
    gathered = places.groupBy("_doc").agg(F.collect_list("c").alias("c"))  # no more than a document's words and what is filed under them
    held = gathered.join(rows, "_doc").select("_doc", F.array_sort(F.filter("c", lambda c: F.slice(F.col("words"), c["start"] + 1, -c["less"]) == c["phrase"])).alias("c"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,n_words:int,term:string>>").alias("out"))
    claim = lambda s, c: F.when(c["start"] < s["end"], s).otherwise(
        F.struct((c["start"] - c["less"]).alias("end"), F.array_append(s["out"], F.struct(c["start"].alias("start"), (-c["less"]).alias("n_words"), c["term"].alias("term"))).alias("out"))
    )
    return held.select(F.col("_doc").alias(doc_id), F.explode(F.aggregate("c", start, claim)["out"]).alias("m")).select(doc_id, "m.*")
