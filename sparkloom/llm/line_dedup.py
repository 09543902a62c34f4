"""Line dedup: winnowing over line hashes.

A document is its sequence of lines; blank lines don't count. A window is a shortest run of lines with at least
`min_words` words, counted forward from each line or back from each line, so a single long line is one, and so are ten
short ones. From every window the line with the smallest hash is selected (the rightmost of equals). The selected lines
are the fingerprints, and all that leaves a text at first: any run of at least `min_words` words that two documents
share, or that one document repeats, holds a whole window and so the same fingerprint in both places. That is the
guarantee of winnowing, with the window measured in words.

1. Positions are joined: a fingerprint that stands at one place of the corpus starts no match and goes (most of the corpus,
   after a map-side count). The places that are left are seeds.
2. Each seed is extended both ways, line by line, as far as the windows that selected it reach: these are the least runs
   that a match around the seed must cover. Each is keyed by the hash of all its lines and joined to the first place of
   the key, by (doc_id, line), which is its original: a match is a place, its original, and the run they have in common.
3. Matches of one text that overlap or touch are one longer repeated run, and it is deleted. Each line of a repeated run
   either has `min_words` words from it to the run's end, or from the run's start to it, or lies in the first forward
   window, so the run goes whole, first line to last, whichever earlier document each part came from.

No pairs of positions are made: a passage that a third of the documents share costs one row a place. Texts without a seed
are not looked at again, and lines that no seed leads to are never compared.

The first occurrence of a passage always stays. Null and empty texts stay as they are, and rows without doc_id too:
these neither repeat nor are repeated. Very long texts are handled whole, in time in proportion to their lines. Places are
ordered by (doc_id, hash of the text, first line, last line), so there are no ties; equal rows of one doc_id are both
kept as they are found. Other columns pass through, but for those named as the three counts, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import materialize, ship, slices, table, whole_rows

MIN_WORDS = 50


def line_table(text: str) -> tuple[list[str], list[int], np.ndarray, np.ndarray]:
    """(lines, numbers of the lines that count, their hashes, their words); spaces within a line count once."""
    lines = text.split("\n")
    numbers, hashes, sizes = [], [], []
    for n, line in enumerate(lines):
        found = line.split()
        if found:
            numbers.append(n)
            hashes.append(xxhash.xxh3_64_intdigest(" ".join(found)))
            sizes.append(len(found))
    return lines, numbers, np.array(hashes, dtype=np.uint64), np.array(sizes, dtype=np.int64)


def windows(sizes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of each window: from each line on, as few as have min_words words."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    last = np.searchsorted(upto, upto[:-1] + min_words)
    first = np.arange(len(sizes))[last < len(upto)]
    return first, last[last < len(upto)] - 1


def backward_windows(sizes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of each window: back from each line, as few as have min_words words."""
    first, last = windows(sizes[::-1], min_words)
    return len(sizes) - 1 - last[::-1], len(sizes) - 1 - first[::-1]


def all_windows(sizes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of both kinds, each once, in order of their first lines, then last ones (neither ever falls)."""
    (a, b), (c, d) = windows(sizes, min_words), backward_windows(sizes, min_words)
    n = len(sizes) + 1
    runs = np.unique(np.concatenate([a * n + b, c * n + d]))
    return runs // n, runs % n


def fingerprints(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The selected line of each window: its smallest hash, the rightmost of equals. Monotone queue, linear."""
    out = np.empty(len(first), dtype=np.int64)
    queue: list[int] = []
    head = end = 0
    values = hashes.tolist()
    for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        while end <= b:
            while len(queue) > head and values[queue[-1]] >= values[end]:
                queue.pop()
            queue.append(end)
            end += 1
        while queue[head] < a:
            head += 1
        out[k] = queue[head]
    return out


def window_keys(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[int]:
    data = memoryview(np.ascontiguousarray(hashes)).cast("B")
    return [xxhash.xxh3_64_intdigest(data[8 * a : 8 * b + 8]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]


def _signed(values) -> np.ndarray:
    return np.asarray(values, dtype=np.uint64).view(np.int64)


_TEXT = "doc_id long, row_key long, hashes binary, sizes binary, picked array<int>, fingerprints array<long>"


def _select(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The line hashes and sizes of each text that holds a window, and its fingerprints: selected lines, each once."""
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, row_key, text in zip(batch["doc_id"].to_pylist(), batch["row_key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                _, _, hashes, sizes = line_table(text)
                first, last = all_windows(sizes, min_words)
                if len(first):
                    picked = np.unique(fingerprints(hashes, first, last))
                    rows.append((doc_id, row_key, hashes.tobytes(), sizes.astype(np.int32).tobytes(), picked, _signed(hashes[picked])))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "row_key", "hashes", "sizes", "picked", "fingerprints"])

    return run


def _extend(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs around the seeds of each text: the windows that selected a seed, keyed by the hash of their lines."""
        for batch in slices(batches):
            parts = []
            for doc_id, row_key, data, words, seeds in zip(*(batch[c].to_pylist() for c in ("doc_id", "row_key", "hashes", "sizes", "seeds")), strict=True):
                hashes, sizes = np.frombuffer(data, dtype=np.uint64), np.frombuffer(words, dtype=np.int32).astype(np.int64)
                first, last = all_windows(sizes, min_words)
                seeded = np.zeros(len(sizes), dtype=bool)
                seeded[seeds] = True
                held = seeded[fingerprints(hashes, first, last)]
                first, last = first[held], last[held]
                parts.append((doc_id, row_key, first, last, _signed(window_keys(hashes, first, last))))
            n = [len(p[2]) for p in parts]
            columns = [np.repeat([p[k] for p in parts], n) for k in (0, 1)] + [np.concatenate([p[k] for p in parts]) if parts else [] for k in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "row_key", "start", "last", "key"])

    return run


def shared_positions(texts: DataFrame) -> DataFrame:
    """(doc_id, row_key, seeds): the places of each text's fingerprints that stand at more than one place of the corpus."""
    places = texts.select("doc_id", "row_key", F.explode(F.arrays_zip("picked", "fingerprints")).alias("f"))
    places = places.select("doc_id", "row_key", F.col("f.picked").alias("at"), F.col("f.fingerprints").alias("fingerprint"))
    place = F.struct("doc_id", "row_key", "at")
    shared = places.groupBy("fingerprint").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("fingerprint")
    shared = materialize(shared, "winnow-shared")
    return places.join(shared.hint("merge"), "fingerprint", "left_semi").groupBy("doc_id", "row_key").agg(F.collect_set("at").alias("seeds"))


def matches(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row_key, start, last, from_doc, from_key, from_start): runs of lines, by their ranks among the lines that
    count, that repeat the same lines of an earlier place."""
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    texts = materialize(texts.mapInArrow(_select(min_words), _TEXT), "winnow-texts")
    seeds = shared_positions(texts)
    seeded = texts.select("doc_id", "row_key", "hashes", "sizes").join(seeds.hint("merge"), ["doc_id", "row_key"])
    runs = materialize(seeded.mapInArrow(_extend(min_words), "doc_id long, row_key long, start long, last long, key long"), "winnow-runs")
    place = F.struct("doc_id", "row_key", "start", "last")
    first = runs.groupBy("key").agg(F.min(place).alias("original"), F.max(place).alias("end")).where("original <> end").select("key", "original")
    first = materialize(first, "winnow-originals")
    later = runs.select("key", place.alias("at")).join(first.hint("merge"), "key").where("at <> original")
    return later.select("at.*", F.col("original.doc_id").alias("from_doc"), F.col("original.row_key").alias("from_key"), F.col("original.start").alias("from_start"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row_key, runs): the runs of each text that repeat an earlier place."""
    return matches(docs, min_words).groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set(F.struct("start", "last"))).alias("runs"))


def _cut(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, deleted, gone, runs = [], [], [], []
            row = {f.name: c for f, c in zip(batch["row"].type, batch["row"].flatten(), strict=True)}
            for text, repeated in zip(row["text"].to_pylist(), batch["runs"].to_pylist(), strict=True):
                if repeated is None:
                    texts.append(text), deleted.append(0), gone.append(0), runs.append(0)
                    continue
                lines, numbers, _, sizes = line_table(text)
                drop = np.zeros(len(numbers), dtype=bool)
                for r in repeated:
                    drop[r["start"] : r["last"] + 1] = True
                out = {numbers[k] for k in np.flatnonzero(drop)}
                texts.append("\n".join(line for n, line in enumerate(lines) if n not in out))
                deleted.append(int(drop.sum()))
                gone.append(int(sizes[drop].sum()))
                runs.append(int((np.diff(np.concatenate([[0], drop.astype(np.int8)])) == 1).sum()))
            counts = {"lines_deleted": deleted, "words_deleted": gone, "runs_deleted": runs}
            yield pa.RecordBatch.from_pydict(row | {"text": pa.array(texts, pa.string())} | {c: pa.array(v, pa.int64()) for c, v in counts.items()})

    return run


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later repeats cut out of text, and lines_deleted, words_deleted, runs_deleted (0 where nothing was)."""
    extra = ["lines_deleted", "words_deleted", "runs_deleted"]
    ship(docs.sparkSession)
    docs = docs.drop(*extra)
    rows = materialize(repeats(docs, min_words), "winnow-repeats")
    marked = docs.select(whole_rows(docs), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_key"))
    hit = rows.select(F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key"), "runs")
    # a merge join at every size: what is repeated grows with the corpus
    joined = marked.join(hit.hint("merge"), F.expr("own_id = hit_id AND own_key = hit_key"), "left")
    schema = T.StructType([*docs.schema, *[T.StructField(c, T.LongType()) for c in extra]])
    return joined.select("row", "runs").mapInArrow(_cut(min_words), schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "lines_deleted", "words_deleted", "runs_deleted")
