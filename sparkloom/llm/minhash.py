"""MinHash near-dedup with b-bit signatures.

A document's set is its distinct 4-word shingles (5 in the pipeline) as 64-bit hashes. Documents with equal sets are one
class from the start, found by a hash of the set, and only one of each class goes on. For these: 228 minima in 38 bands of 6; documents
that agree on a band are candidates (a pair at similarity 0.8 is missed with probability (1 - 0.8^6)^38 < 1e-5). Of each
minimum the low 4 bits are kept and packed; the share of equal 4-bit fields, corrected for the sixteenth that agrees by
chance, estimates the similarity, and pairs far below the threshold go. The rest are confirmed on full sets.

Candidate pairs are not all pairs of a band's bucket. The result asks for components, so a bucket only has to tie
together what belongs together: its members are first compared with its smallest one, then, where they are in different
components still, with a leader drawn by a hash, another in each bucket. That ties large groups of near copies together.
Last, in buckets whose members are in different components yet, every member outside the bucket's first component is
compared with every member of another component: all that the threshold allows by their sizes and by bitmaps of their sets
(an exact bound on the intersection), once over all bands. So members of a large component never meet each other, no
link between components is lost, and a bucket's members are dealt in parts, so that no bucket is one task's.

Nulls, empty texts and texts without words have an empty set and link with nothing. A text of fewer words than a shingle
has one shingle, the whole. Very long texts are hashed whole. Should rows share a doc_id but not their text, each has the
component of its own set, and all sets are searched; a null doc_id links with nothing. Joins are merge joins at every size. Of a component's rows the smallest
doc_id names it; rows that share it are kept together. Other columns are ignored (the filter keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import connected_components, materialize, release, ship, slices, table, whole_rows

BANDS, ROWS, BITS = 38, 6, 4
PERMUTATIONS = BANDS * ROWS
WORDS = -(-PERMUTATIONS // 64)
#: 64-bit words of the bitmap in which each shingle of a set marks a bit.
MARKS = 16
#: Rounds that compare bucket members with one leader, before what remains apart is compared in full.
STAR_ROUNDS = 2
#: Members of a bucket that are compared in one part, in the last comparison.
PART = 512
#: How far below the threshold an estimate may lie for a pair to be confirmed: 4 standard deviations.
SLACK = 0.11
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


@cache
def _constants() -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(7)
    return (made.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)), made.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)


def word_hashes(text: str | None, seen: dict[bytes, int]) -> np.ndarray:
    """Hashes of the words (runs of other than ASCII white space, A-Z lower-cased), through a bounded cache."""
    if len(seen) > 500_000:
        seen.clear()
    out = []
    for w in (text or "").encode("utf-8", "surrogatepass").lower().split():
        h = seen.get(w)
        if h is None:
            h = seen[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingles(text: str | None, size: int, seen: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = word_hashes(text, seen)
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(size))
        for k in range(size):
            out = (out ^ (out >> np.uint64(29))) * _MIX[0] + words[k : k + n] * _MIX[1 + k % 4]
        out ^= out >> np.uint64(32)
        out *= _MIX[2]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each permutation, in blocks that stay in the processor's cache."""
    a, b = _constants()
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(PERMUTATIONS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(low), 256):
        part = a[:, None] * low[None, at : at + 256]
        part += b[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def pack(mins: np.ndarray) -> list[int]:
    """The low bits of every minimum: BITS planes of WORDS 64-bit numbers, a bit for each permutation."""
    planes = np.zeros((BITS, WORDS * 64), dtype=np.uint8)
    for k in range(BITS):
        planes[k, :PERMUTATIONS] = mins >> np.uint32(k) & np.uint32(1)
    return np.packbits(planes, axis=1).view(np.int64).ravel().tolist()


def agrees(a: str, b: str, threshold: float) -> str:
    """SQL condition on two packed signatures: the share of equal fields, less those equal by chance, estimates the
    similarity; it may lie SLACK below the threshold."""
    planes = lambda w: " | ".join(f"({a}[{k * WORDS + w}] ^ {b}[{k * WORDS + w}])" for k in range(BITS))
    differ = " + ".join(f"bit_count({planes(w)})" for w in range(WORDS))
    chance = 1 / 2**BITS
    most = int(PERMUTATIONS * (1 - chance) * (1 - (threshold - SLACK)))
    return f"({differ}) <= {most}"


def marks(hashes: np.ndarray) -> list[int]:
    """The bitmap of a set: a bit for each shingle, by other bits of its hash than the minima take."""
    bits = np.zeros(MARKS * 64, dtype=np.uint8)
    bits[(hashes & np.uint64(MARKS * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def may_meet(a: str, b: str, na: str, nb: str, threshold: float) -> str:
    """SQL condition on two bitmaps and set sizes that every pair at the threshold meets: a bit that one bitmap has alone
    stands for at least one shingle that the other set lacks, which bounds the intersection."""
    alone = lambda x, y: " + ".join(f"bit_count({x}[{w}] & ~{y}[{w}])" for w in range(MARKS))
    percent = round(threshold * 100)
    most = f"least({na} - ({alone(a, b)}), {nb} - ({alone(b, a)}))"
    return f"{100 + percent} * {most} >= {percent} * ({na} + {nb})"


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in slices(batches):
            count, key, packed, bands, bitmap = [], [], [], [], []
            for text in batch["text"].to_pylist():
                own = shingles(text, size, seen)
                count.append(len(own))
                if len(own):
                    mins = minima(own)
                    key.append(xxhash.xxh3_128_digest(own.tobytes()))
                    packed.append(pack(mins))
                    bitmap.append(marks(own))
                    bands.append([xxhash.xxh3_64_intdigest(mins[k * ROWS : k * ROWS + ROWS].tobytes(), seed=k) - 2**63 for k in range(BANDS)])
                else:
                    key.append(None), packed.append(None), bands.append(None), bitmap.append(None)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"],
                    "n_shingles": pa.array(count, pa.int64()),
                    "set_key": pa.array(key, pa.binary()),
                    "packed": pa.array(packed, pa.list_(pa.int64())),
                    "bands": pa.array(bands, pa.list_(pa.int64())),
                    "marks": pa.array(bitmap, pa.list_(pa.int64())),
                }
            )

    return run


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, packed, bands, marks) of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_sign(size), "doc_id long, n_shingles long, set_key binary, packed array<long>, bands array<long>, marks array<long>")


def _overlap(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        percent = round(threshold * 100)
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist(), strict=True):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in slices(batches):
            made = [shingles(text, size, seen).tobytes() for text in batch["text"].to_pylist()]
            own = [xxhash.xxh3_128_digest(x) == k for x, k in zip(made, batch["set_key"].to_pylist(), strict=True)]
            out = pa.RecordBatch.from_pydict({"set_key": batch["set_key"], "set": pa.array(made, pa.binary())})
            yield out.filter(pa.array(own, pa.bool_()))

    return run


def confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, threshold: float) -> DataFrame:
    """Of pairs (ka, a, kb, b) of sets and their nodes, the (a, b) whose full sets meet the threshold. nodes: (node, set_key)."""
    wanted = pairs.select(F.col("ka").alias("set_key")).union(pairs.select("kb")).distinct().join(nodes.select("set_key", "node").hint("merge"), "set_key")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # a text of that doc_id with that set; should there be several, their sets are equal
    sets = wanted.join(texts.hint("merge"), F.col("node") == F.col("doc_id")).select("set_key", "text").mapInArrow(_sets(size), "set_key binary, set binary")
    sets = materialize(sets.dropDuplicates(["set_key"]), "minhash-sets")
    # a member's set travels with the pair to its leader's, not the leader's to all of its members
    joined = pairs.join(sets.toDF("kb", "sb").hint("merge"), "kb").join(sets.toDF("ka", "sa").hint("merge"), "ka").select("a", "b", "sa", "sb")
    found = materialize(joined.mapInArrow(_overlap(threshold), "a long, b long"), "minhash-links")
    release(sets)
    return found


def links(docs: DataFrame, signed: DataFrame, size: int, threshold: float) -> DataFrame:
    """Confirmed links (a, b) between the smallest doc_ids of sets, enough of them that every two linked sets are in one
    component."""
    least = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    own = least.groupBy("set_key").agg(F.min("doc_id").alias("node")).toDF("own_key", "node")  # one of each class of equal sets
    one = least.join(own.hint("merge"), F.expr("set_key = own_key AND doc_id = node")).select("node", "set_key", "n_shingles", "packed", "bands", "marks")
    one = materialize(one.dropDuplicates(["set_key"]), "minhash-classes")
    keyed = one.select("set_key", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = keyed.join(shared.hint("merge"), "key", "left_semi").join(one.select("set_key", "node", "n_shingles", "packed").hint("merge"), "set_key").withColumn("part", F.col("node"))
    buckets = materialize(buckets, "minhash-buckets")

    def check(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.select("ka", "a", "kb", "b").distinct(), "minhash-pairs")
        found = confirm(pairs, docs, one, size, threshold)
        release(pairs)
        return found

    found = None
    for n in range(STAR_ROUNDS):
        # each member with its bucket's leader: the smallest, then one by a hash, another in each bucket
        order = F.col("node") if n == 0 else F.xxhash64("set_key", "key", F.lit(n))
        leaders = buckets.groupBy("key").agg(F.min(F.struct(order.alias("at"), "set_key", "node", "part", "packed")).alias("first"))
        leaders = leaders.select("key", F.col("first.set_key").alias("ka"), F.col("first.node").alias("a"), F.col("first.part").alias("parta"), F.col("first.packed").alias("pa"))
        near = buckets.join(leaders.hint("merge"), "key").where(f"part <> parta AND {agrees('pa', 'packed', threshold)}")
        pairs = check(near.select("ka", "a", F.col("set_key").alias("kb"), F.col("node").alias("b")))
        found = pairs if found is None else found.union(pairs)
        # buckets whose members are in different components by now go on; their first component is the largest, as a rule
        parts = materialize(connected_components(found), "minhash-parts")
        placed = buckets.drop("part", "main").join(parts.hint("merge"), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        apart = placed.groupBy("key").agg(F.min("part").alias("main"), F.max("part").alias("q"), F.count("*").alias("size")).where("main <> q")
        left = materialize(placed.drop("size").join(apart.drop("q").hint("merge"), "key"), "minhash-apart")
        release(buckets, parts)
        buckets = left
    # members outside the first component meet all others, dealt by these; a pair counts in the first bucket that it shares
    last = buckets.join(one.select("set_key", "bands", "marks").hint("merge"), "set_key").select(
        "key", "set_key", "node", "n_shingles", "part", "main", "packed", "marks", F.expr("slice(bands, 1, cast(array_position(bands, key) AS int) - 1)").alias("before"),
        F.ceil(F.col("size") / PART).cast("int").alias("deals"),
    )
    x = last.where("part <> main").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    x = x.select("key", "deal", F.col("set_key").alias("kb"), F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("part").alias("partb"), F.col("packed").alias("pb"), F.col("marks").alias("mb"), F.col("before").alias("befb"))
    y = last.withColumn("deal", F.pmod(F.xxhash64("set_key"), F.col("deals")).cast("int"))
    y = y.select("key", "deal", F.col("set_key").alias("ka"), F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("part").alias("parta"), "main", F.col("packed").alias("pa"), F.col("marks").alias("ma"), F.col("before").alias("befa"))
    once = "(parta = main OR a < b OR a = b AND ka < kb)"
    sizes = f"least(na, nb) >= {threshold} * greatest(na, nb)"
    rest = x.join(y.hint("merge"), ["key", "deal"]).where(f"parta <> partb AND {once} AND {sizes} AND {agrees('pa', 'pb', threshold)} AND {may_meet('ma', 'mb', 'na', 'nb', threshold)} AND NOT arrays_overlap(befa, befb)")
    return found.union(check(rest.select("ka", "a", "kb", "b")))


def components(docs: DataFrame, size: int = 4, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    ship(docs.sparkSession)
    signed = materialize(signatures(docs, size), "minhash")
    near = connected_components(links(docs, signed, size, threshold))
    classes = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("node"))
    named = classes.join(near.hint("merge"), "node", "left").select(F.col("set_key").alias("own_key"), F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(named.hint("merge"), F.col("set_key") == F.col("own_key"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id. Rows without a doc_id stay."""
    found = components(docs, size, threshold)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"))
    rows = docs.select(whole_rows(docs), F.col("doc_id").cast("long").alias("own_id"))
    return rows.join(gone.distinct().hint("merge"), F.expr("own_id = gone_id"), "left_anti").select("row.*")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
