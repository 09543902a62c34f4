"""Benchmark decontamination: greedy string tiling.

Words are lower-cased, with punctuation at either end off. Documents and test items that share a run of `min_match`
words (a seed) are joined by it, and each such pair is tiled: the longest match of words not marked yet is marked in
both, again and again, until none of `min_match` words is left. Lengths are found by running Karp-Rabin hashes over the
unmarked stretches. The tiles' words over the item's words are its coverage, so a passage whose parts stand in another order
is covered like one in order.

Seeds are rows and are joined by their hash, whatever the size of the benchmark. Before that, a bitmap of `FILTER_BITS` bits
of the items' seeds, made in Spark and of that size always, goes to the tasks that read the documents; only texts with a seed
in it leave them, with the stretches of words that lie in such seeds (all that a tile can have). A bitmap that a large
benchmark fills lets more through, and the join decides. So documents are read once, whole, and never shuffled.

A seed that many documents or items hold is dealt on both sides of the join: seeds with a `HOT_SHARE`th of a side's rows (so
no more than that many on a side, which bounds what is broadcast) have their documents in up to `HOT_PARTS` parts, their items too, and
each part meets each. Where only a coverage of at least some share counts (`contaminated`), an item asks for documents by
its rarest seeds alone: tiles over that share hold a known number of its seeds (`_needed`), so the commonest seeds,
as long as they are fewer than this, can't find a document that the others don't. Each pair is tiled all the same.

Null or empty texts, and items without words, match nothing; an item of fewer than `min_match` words is matched as a whole
by its own words in a row. Very long texts cost time in proportion to their length for each tile, also where one word
repeats. Equal items are tiled each; rows of one doc_id are told apart by their texts, and of equal rows each has its row. Ties of
length go to the match that is first in the item, then first in the document; of items covered alike the smallest item_id
is named. Empty tables give empty results. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, ship, slices, table, whole_rows

MIN_MATCH = 5
COVERAGE = 0.8
FILTER_BITS = 1 << 25
HOT_SHARE = 10_000
HOT_PARTS = 32
#: Rows of a seed that are never dealt.
HOT_LEAST = 512
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…¿¡–—"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def tokens(text: str | None) -> list[str]:
    return [w for w in (x.strip(_EDGE) for x in (text or "").lower().split()) if w]


def hashed(words: list[str], seen: dict[str, int]) -> np.ndarray:
    """64-bit word hashes, through a cache that is emptied when it is large."""
    if len(seen) > 500_000:
        seen.clear()
    out = []
    for w in words:
        h = seen.get(w)
        if h is None:
            h = seen[w] = xxhash.xxh3_64_intdigest(w) or 1  # 0 stands between stretches
        out.append(h)
    return np.array(out, dtype=np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**n, modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base]) <= n:
        with np.errstate(over="ignore"):
            _POWERS[base] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n + 64, base, dtype=np.uint64))])
    return _POWERS[base][: n + 1]


class Running:
    """Karp-Rabin hashes, modulo 2**64, of every run of a text, from one pass of sums."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * _powers(_INVERSE, self.n)[: self.n])])

    def of(self, size: int) -> np.ndarray:
        if size > self.n:
            return np.empty(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            return (self.sums[size:] - self.sums[:-size]) * _powers(_BASE, self.n)[size - 1 : self.n]


def running(values: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of every run of `size` words."""
    return Running(values).of(size)


def _free_starts(free: np.ndarray, size: int) -> np.ndarray:
    whole = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(whole[size:] == whole[:-size]) if len(free) >= size else np.empty(0, dtype=np.int64)


def tile(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in doc, length), longest first."""
    free_i, free_d = np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool)
    in_item, in_doc, tiles = Running(item), Running(doc), []

    def shared(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of unmarked runs of that size in both, and their hashes, where both have the hash."""
        i, j = _free_starts(free_i, size), _free_starts(free_d, size)
        hi, hj = in_item.of(size)[i], in_doc.of(size)[j]
        a, b = np.isin(hi, hj), np.isin(hj, hi)
        return i[a], hi[a], j[b], hj[b]

    longest = min(len(item), len(doc))
    while longest >= min_match:
        low, high = min_match - 1, longest  # a match of n words holds one of n - 1
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(shared(middle)[0]) else (low, middle - 1)
        if low < min_match:
            break
        i, hi, j, hj = shared(low)
        order = np.argsort(hj, kind="stable")
        places, begins, ends = j[order], np.searchsorted(hj[order], hi), np.searchsorted(hj[order], hi, side="right")
        at: dict[int, int] = {}  # by run: the first place in the document that may be unmarked yet
        for start, begin, end in zip(i.tolist(), begins.tolist(), ends.tolist(), strict=True):
            if not free_i[start : start + low].all():
                continue  # an earlier tile of this round touches it: it waits for the next
            for k in range(at.get(begin, begin), end):
                place, at[begin] = int(places[k]), k + 1
                if free_d[place : place + low].all() and (item[start : start + low] == doc[place : place + low]).all():
                    free_i[start : start + low] = free_d[place : place + low] = False
                    tiles.append((start, place, low))
                    break
        longest = low - 1
    return tiles


def _seeded(min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An item's words as hashes, its distinct seeds, and how often each stands in it."""
        for batch in slices(batches):
            rows = []
            for text in batch["text"].to_pylist():
                v = hashed(tokens(text), {})
                size = min(min_match, len(v))
                seeds, times = np.unique(_sized(running(v, size), size), return_counts=True) if size else (v, v)
                rows.append((v.tobytes(), size, _signed(seeds), times.astype(np.int64)) if size else (None, 0, [], []))
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            made = [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["item_id"], *made], names=["item_id", "words", "seed_size", "seeds", "times"])

    return run


def _sized(hashes: np.ndarray, size: int) -> np.ndarray:
    """Seeds of different sizes are different."""
    with np.errstate(over="ignore"):
        return (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(size)


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def seed_bitmap(items: DataFrame) -> np.ndarray:
    """A bitmap of the items' seeds: its 64-bit words are made in Spark, and those with a bit, FILTER_BITS / 64 at most, come to
    the driver."""
    bit = F.pmod("seed", F.lit(FILTER_BITS))
    bits = items.select(F.explode("seeds").alias("seed")).select(F.floor(bit / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(pmod(seed, 64) AS int))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype="<i8")
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def _touched(bitmap: np.ndarray, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with a seed in the bitmap: the stretches of words that lie in such seeds, a 0 between them, and the seeds."""
        seen: dict[str, int] = {}
        for batch in slices(batches):
            kept, parts, seeds = [], [], []
            for n, text in enumerate(batch["text"].to_pylist()):
                doc = hashed(tokens(text), seen)
                own, found, inside = Running(doc), [], np.zeros(len(doc) + 1, dtype=np.int64)
                for size in sizes:
                    h = _sized(own.of(size), size)
                    bit = _signed(h) % (8 * len(bitmap))
                    at = np.flatnonzero(bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    if len(at):
                        found.append(h[at])
                        np.add.at(inside, at, 1)
                        np.add.at(inside, at + size, -1)
                if found:
                    held = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
                    breaks = np.flatnonzero(np.diff(held) > 1) + 1
                    kept.append(n)
                    parts.append(np.insert(doc[held], breaks, np.uint64(0)).tobytes())
                    seeds.append(_signed(np.unique(np.concatenate(found))))
            made = [pa.array(parts, pa.binary()), pa.array(seeds, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(kept, pa.int64())) for c in ("doc_id", "row_key")), *made], names=["doc_id", "row_key", "parts", "seeds"])

    return run


_TILED = ["item_words", "covered_words", "tiles", "longest", "coverage"]


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows, kept = [], []
        for n, (words, size, parts) in enumerate(zip(*(batch[c].to_pylist() for c in ("words", "seed_size", "parts")), strict=True)):
            item = np.frombuffer(words, dtype=np.uint64)
            tiles = tile(item, np.frombuffer(parts, dtype=np.uint64), size)
            covered = sum(t[2] for t in tiles)
            if covered:
                kept.append(n)
                rows.append((len(item), covered, len(tiles), tiles[0][2], covered / len(item)))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        made = [pa.array(c, pa.float64() if k == 4 else pa.int64()) for k, c in enumerate(columns)]
        yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(kept, pa.int64())) for c in ("doc_id", "row_key", "item_id")), *made], names=["doc_id", "row_key", "item_id", *_TILED])


def _hot(seeds: DataFrame, name: str) -> DataFrame:
    """(seed, name: its parts) of the seeds with at least a HOT_SHARE-th of the rows; so there are HOT_SHARE at most."""
    counts = seeds.groupBy("seed").agg(F.count("*").alias("n"))
    least = max(HOT_LEAST, (seeds.count() + HOT_SHARE - 1) // HOT_SHARE)
    return counts.where(F.col("n") >= least).select("seed", F.least(F.ceil(F.col("n") / least) + 1, F.lit(HOT_PARTS)).cast("int").alias(name))


def _needed(coverage: float):
    """The places of seeds that tiles over that share of an item's words hold at least: a tile of n words has n - size + 1
    places, no fewer than n / size."""
    n_words = F.octet_length("words") / 8
    return F.greatest(F.lit(1), F.ceil(n_words * coverage / F.col("seed_size") - 1e-9))


def _asking(items: DataFrame, doc_seeds: DataFrame, coverage: float) -> DataFrame:
    """(item_no, seed): the seeds by which items look for documents that may cover such a share of them."""
    own = items.select("item_no", _needed(coverage).alias("needed"), F.explode(F.arrays_zip("seeds", "times")).alias("s"))
    own = own.select("item_no", "needed", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times"))
    if coverage <= 0:
        return own.select("item_no", "seed")
    counts = doc_seeds.groupBy("seed").agg(F.count("*").alias("n"))
    commonest_first = Window.partitionBy("item_no").orderBy(F.desc("n"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    return own.join(counts, "seed").withColumn("so_far", F.sum("times").over(commonest_first)).where("so_far >= needed").select("item_no", "seed")


def _pairs(doc_seeds: DataFrame, item_seeds: DataFrame) -> DataFrame:
    """(doc_no, item_no) that share a seed; hot seeds are dealt by parts of both sides."""
    hot = materialize(_hot(doc_seeds, "doc_parts").join(_hot(item_seeds, "item_parts"), "seed", "full"), "tile-hot")  # 2 * HOT_SHARE rows at most

    def dealt(rows: DataFrame, no: str, own: str, other: str) -> DataFrame:
        parts = lambda c: F.coalesce(F.col(f"{c}_parts"), F.lit(1))
        rows = rows.join(F.broadcast(hot), "seed", "left").withColumn(own, F.pmod(F.xxhash64(no), parts(own)).cast("int"))
        return rows.select("seed", no, own, F.explode(F.sequence(F.lit(0), parts(other) - 1)).alias(other))

    docs, items = dealt(doc_seeds, "doc_no", "doc", "item"), dealt(item_seeds, "item_no", "item", "doc")
    return docs.join(items, ["seed", "doc", "item"]).select("doc_no", "item_no").distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = 0.0) -> DataFrame:
    """(doc_id, row_key, item_id, item_words, covered_words, tiles, longest, coverage) of every pair that shares a seed, or
    of those that may cover at least such a share, every pair that does among them. row_key is the hash of the document's text."""
    ship(docs.sparkSession)
    item_id, doc_id = (f"{c} {df.schema[c].dataType.simpleString()}" for c, df in (("item_id", benchmark), ("doc_id", docs)))
    items = benchmark.select("item_id", "text").mapInArrow(_seeded(min_match), f"{item_id}, words binary, seed_size int, seeds array<long>, times array<long>")
    items = materialize(items.where("seed_size > 0").withColumn("item_no", F.monotonically_increasing_id()), "tile-items")
    sizes = sorted(r["seed_size"] for r in items.select("seed_size").distinct().collect())  # min_match values at most
    texts = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    touched = texts.mapInArrow(_touched(seed_bitmap(items), sizes), f"{doc_id}, row_key long, parts binary, seeds array<long>")
    touched = materialize(touched.withColumn("doc_no", F.monotonically_increasing_id()), "tile-texts")
    doc_seeds = touched.select("doc_no", F.explode("seeds").alias("seed"))
    pairs = _pairs(doc_seeds, _asking(items, doc_seeds, coverage))
    held = pairs.join(touched.select("doc_no", "doc_id", "row_key", "parts"), "doc_no").join(items.select("item_no", "item_id", "words", "seed_size"), "item_no")
    made = ", ".join(f"{c} {'double' if c == 'coverage' else 'long'}" for c in _TILED)
    return held.select("doc_id", "row_key", "item_id", "words", "seed_size", "parts").mapInArrow(_tiled, f"{doc_id}, row_key long, {item_id}, {made}")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, row_key, ...): texts that cover at least that share of some item, with the item they cover most."""
    hits = overlaps(docs, benchmark, min_match, coverage).where(F.col("coverage") >= coverage)
    best = F.min(F.struct((-F.col("coverage")).alias("c"), (-F.col("covered_words")).alias("w"), "item_id", "tiles", "longest")).alias("best")
    return hits.groupBy("doc_id", "row_key").agg(best, F.countDistinct("item_id").alias("n_items")).select(
        "doc_id", "row_key", "best.item_id", (-F.col("best.c")).alias("coverage"), (-F.col("best.w")).alias("covered_words"), "best.tiles", "best.longest", "n_items"
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """docs without the contaminated ones."""
    bad = contaminated(docs, benchmark, min_match, coverage).select(F.col("doc_id").alias("bad_id"), F.col("row_key").alias("bad_key"))
    own = docs.select(whole_rows(docs), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"))
    return own.join(bad, F.expr("own_id <=> bad_id AND own_key = bad_key"), "left_anti").select("row.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hits = overlaps(docs.select("doc_id", "text"), bench.select("item_id", "text"))
    return hits.select(
        "doc_id", "item_id", "item_words", "covered_words", "tiles", "longest", "coverage", (F.col("coverage") >= COVERAGE).alias("contaminated")
    )
