"""Filter interaction audit: what each order of the filters removes, from a packed bitmap index.

The index is made partition by partition: a block of rows becomes NumPy bitsets, one for each filter's failures, each label
and each part. For each part and each of the 2^n sets of filters that an order can have gone through, the rows that passed
all of them are the part's bits AND NOT the failures', and their popcounts, over all rows and over each label's, are the
block's share. Blocks are summed by part and set: 32 rows of a few numbers for each part, which is all that leaves a
partition. Everything in the report is a difference of two of these counts: kept(S), removed(S, f) = kept(S) - kept(S + f).

One reading of the texts gives each row's failures as bits and the digest of its text. A row is a repetition if its text has
a smaller doc_id anywhere in the table: the smallest of each digest is summed up first, and rows look themselves up by
digest and doc_id, so that copies of one text are spread over all tasks.

A null text counts as empty, a null lang as the part of the empty string. A null doc_id repeats nothing and has no label.
Rows that repeat a doc_id are judged one by one; equal ones are not copies of each other, for no doc_id is smaller. A
doc_id with several rows of labels counts as good, or toxic, if any says so. Very long texts are judged whole. Other columns
are not looked at. An empty table has no part and gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, slices, table

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 3
CAPITALS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: The filter that looks at all rows; the others look at one text each.
REPEATS = 1 << FILTERS.index("E")
#: Rows of a block of the index: 8 KB a bitset.
BLOCK = 1 << 16


def failures(text: bytes) -> int:
    """Bits of the filters A to D that the text fails. bytes.split() parts words at 0x20 and 0x09-0x0D alone."""
    words = text.split()
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
        100 * (len(text) - len(text.translate(None, CAPITALS))) > MAX_CAPITAL_PERCENT * len(text.decode(errors="replace")),
        len(text.translate(None, MARKS)) < len(text),
    )
    return sum(1 << k for k, fail in enumerate(fails) if fail)


def _judge(batches):
    for batch in batches:
        for part in slices([batch]):
            texts = [t or b"" for t in part.column(0).cast(pa.binary()).to_pylist()]
            judged = [(failures(t), hashlib.sha256(t).digest()) for t in texts]
            fails, digests = zip(*judged, strict=True) if judged else ((), ())
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(fails, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "fails", "digest"])


def judged_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic) of every row of docs; fails has a bit for each filter."""
    rows = docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"))
    rows = materialize(rows.mapInArrow(_judge, "doc_id long, part string, fails int, digest binary"), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("is_first", F.lit(True))
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    told = told.agg(F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"))
    rows = rows.join(first.hint("merge"), ["digest", "doc_id"], "left").join(told.hint("merge"), "doc_id", "left")
    repeats = F.expr("doc_id IS NOT NULL AND is_first IS NULL")
    return rows.select("part", F.when(repeats, F.col("fails").bitwiseOR(F.lit(REPEATS))).otherwise(F.col("fails")).alias("fails"), F.expr("coalesce(good, false)").alias("good"), F.expr("coalesce(toxic, false)").alias("toxic"))


def block_counts(parts: np.ndarray, fails: np.ndarray, labels: list[np.ndarray], filters: int) -> dict[str, np.ndarray]:
    """part -> counts[set of filters, all and each label] of the rows of a block that pass all of the set."""
    order = np.argsort(parts, kind="stable")  # a part's bits stand together, so only their bytes are looked at
    names, starts = np.unique(parts[order], return_index=True)
    ends = [*starts[1:], len(order)]
    fails = fails[order]
    fail_bits = [np.packbits((fails >> k) & 1) for k in range(filters)]
    label_bits = [np.packbits(x[order]) for x in labels]
    out = {}
    for name, start, end in zip(names, starts, ends, strict=True):
        low, high = start // 8, -(-end // 8)
        part_bits = np.zeros(8 * (high - low), np.uint8)
        part_bits[start - 8 * low : end - 8 * low] = 1
        passed = {0: np.packbits(part_bits)}
        counts = np.zeros((1 << filters, 1 + len(labels)), np.int64)
        for chosen in range(1 << filters):
            if chosen:  # without its highest filter the set is done already
                k = chosen.bit_length() - 1
                passed[chosen] = passed[chosen ^ (1 << k)] & ~fail_bits[k][low:high]
            for column, bits in enumerate([None, *label_bits]):
                left = passed[chosen] if bits is None else passed[chosen] & bits[low:high]
                counts[chosen, column] = np.bitwise_count(left).sum()
        out[name] = counts
    return out


def _index(filters: int):
    def run(batches):
        for batch in batches:
            for block in slices([batch], BLOCK):
                if block.num_rows == 0:
                    continue
                parts = np.array(block.column(0).to_pylist(), object)
                fails, good, toxic = (block.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
                for name, counts in block_counts(parts, fails, [good, toxic], filters).items():
                    sets = pa.array(range(1 << filters), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(counts), pa.string()), sets, *(pa.array(counts[:, c]) for c in range(3))], ["part", "passed", "kept", "good", "toxic"])

    return run


def counts_by_set(rows: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, passed, kept, good, toxic): how many rows of a part pass each set of filters."""
    found = rows.mapInArrow(_index(filters), "part string, passed int, kept long, good long, toxic long")
    return materialize(found.groupBy("part", "passed").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")]), "audit-counts")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    counts = counts_by_set(judged_rows(docs, labels))
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            steps.append(("".join(FILTERS[x] for x in order), step, FILTERS[k], before, before | 1 << k))
            before |= 1 << k
    steps = F.broadcast(docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, before int, after int"))  # 600 rows
    left = counts.toDF("part", "before", "kept_before", "good_before", "toxic_before").join(steps, "before")
    both = left.join(counts.withColumnRenamed("passed", "after"), ["part", "after"])
    both = both.select(
        "part", "filter_order", "step", "filter", "before", "after", "kept", (F.col("kept_before") - F.col("kept")).alias("removed"),
        (F.col("good_before") - F.col("good")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic")).alias("toxic_lost"),
    )
    # as the first filter it removes all that fail it, as the last those that fail no other
    w = Window.partitionBy("part", "filter")
    fails = F.max(F.when(F.col("before") == 0, F.col("removed"))).over(w)
    alone = F.max(F.when(F.col("after") == (1 << len(FILTERS)) - 1, F.col("removed"))).over(w)
    return both.select("part", "filter_order", "step", "kept", "removed", (fails - F.col("removed")).alias("redundant"), alone.alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(w).alias("shapley"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def oracle() -> str:
    return r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         MAP {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
              'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
              'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(d.doc_id > first_id, false)} AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
o AS (SELECT letter AS filter_order FROM letters
      UNION ALL SELECT filter_order || letter FROM o, letters WHERE NOT contains(filter_order, letter)),
s AS (SELECT filter_order, k AS step, filter_order[k] AS filter, filter_order[1:k-1] AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE length(filter_order) = 5),
j AS (SELECT part, filter_order, step, filter, n, good, toxic, fails[filter] AS fail,
             len(list_filter(string_split(before, ''), lambda x: x <> '' AND coalesce(fails[x], false))) > 0 AS gone,
             len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: x <> filter AND fails[x])) > 0 AS other
      FROM c, s),
r AS (SELECT part, filter_order, step, filter,
             sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN gone AND fail THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN fail AND NOT other THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN NOT gone AND fail THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN NOT gone AND fail THEN toxic ELSE 0 END) AS toxic_lost
      FROM j GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r"""
