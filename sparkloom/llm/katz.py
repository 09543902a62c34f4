"""LM scoring by Katz backoff, of any order (`ORDER` unless told otherwise).

P(w | h) is the Good-Turing discounted count ratio d(c) * c(h, w) / c(h) where the n-gram (h, w) was seen in training, else
alpha(h) * P(w | h'), with h' the history without its first word, and so on down to P(w): the discounted unigram ratio, or
the mass that discounting leaves for a word that training doesn't have (one class). A history that training doesn't have
leaves the word to h'. Discounts are Katz's for counts up to 5, by order; larger counts, and any count whose discount isn't
between 0 and 1, are discounted by a thousandth only, so that every history keeps some mass for new words. alpha(h) is
exact: (1 - sum of P(w | h) over the seen w) / (1 - sum of their P(w | h')), so every history's distribution adds up to 1.
Histories before a text's first word are filled up with a start mark.

How it runs. Documents are taken in chunks of about 600,000 tokens. A chunk sends each of its distinct n-grams once, with
its training count, to the partition of the n-gram's hash; there the counts of all chunks are added up, each chunk is sent
back the totals of its own n-grams, in their order, and one of the chunks that have it in training owns it. So an n-gram,
however frequent, is one entry per chunk, a frequent word's pairs lie in all partitions, and nothing is gathered by word or
document. Next, each chunk evaluates its tokens from the longest history down, writes the rows (order, history, word, count)
of the n-grams that it owns and, added up by history, their classes (how many of these n-grams, and of the shorter ones
that they end in, were seen once, twice, ...), and asks for alpha of the histories that its unseen n-grams back off from.
Partitions of histories add up the classes and answer. All of it is written as tables in the shared folder, partitioned by
kind; a history or word is there as its 64-bit hash.

A chunk's state and what it asks come from one reading and are written by one job, so no later reading has to deal the
documents alike. Tasks of that job may be repeated: rows must come from files (as the query's do), else they are written to
the shared folder first. Null texts are empty: they have the end token only. A null doc_id is learned from. Very long texts
are scored whole, in a chunk of their own if need be. Repeated rows are learned from and scored each; there are no ties.
Other columns are ignored. Without training rows every word is unknown.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, release, ship, slices, table

ORDER = 2
KEEP = 5
SLIGHT = 1e-3
CHUNK_TOKENS = 600_000
#: Bytes of text for each partition of the model.
PARTITION_BYTES = 24_000_000
#: How counts are written: words of several chunks fit one dictionary.
WRITTEN = {"compression": "zstd", "parquet.dictionary.page.size": str(16 << 20)}
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" end", b" start"))
_ROWS = "kind string, level int, part int, chunk long, data binary, history long, word long, n long"
_KINDS = {"kind": pa.string(), "level": pa.int32(), "part": pa.int32(), "chunk": pa.int64(), "data": pa.binary(), "history": pa.int64(), "word": pa.int64(), "n": pa.int64()}


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; integers shrink to the width they need, and their bytes go plane by plane."""
    out = []
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype.itemsize > 1 and len(a):
            top = int(a.max())
            a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else a.view(np.uint8)
        out += [struct.pack("<4sq", a.dtype.str.encode(), len(a)), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    at, out = 0, []
    while at < len(data):
        kind, n = struct.unpack_from("<4sq", data, at)
        kind = np.dtype(kind.rstrip(b"\0").decode())
        at += 12
        size = n * kind.itemsize
        planes = np.frombuffer(data, dtype=np.uint8, count=size, offset=at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += size
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as differences, which take fewer bytes."""
    return np.diff(keys, prepend=np.uint64(0))


def _parts(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Runs of ascending keys by partition: their highest bits."""
    if len(keys):
        part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
        edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield int(part[a]), slice(a, b)


def _joined(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a history followed by a word."""
    with np.errstate(over="ignore"):
        out = (history ^ (history >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word * np.uint64(0xC2B2AE3D27D4EB4F)
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def grams(words: np.ndarray, first: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(keys, histories) by level from 1: of each token the hash of the n-gram that ends there, and of its history."""
    keys, histories, start = [words], [np.zeros_like(words)], np.array([START])
    for _ in range(2, order + 1):
        history = np.concatenate([start, keys[-1][:-1]])
        history[first] = start
        keys.append(_joined(history, words))
        histories.append(history)
        start = _joined(start, np.array([START]))
    return keys, histories


def _firsts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def asked(ids: list, held: list[bool], words: list[np.ndarray], order: int, bits: int) -> Iterator[tuple]:
    """What a chunk sends: for each level and partition its distinct n-grams with their training counts, and its state."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    tokens = np.concatenate(words)
    train = np.repeat(~np.array(held, dtype=bool), sizes)
    for level, keys in enumerate(grams(tokens, _firsts(sizes), order)[0], 1):
        names, of = np.unique(keys, return_inverse=True)
        counts = np.bincount(of, weights=train, minlength=len(names)).astype(np.int32)
        for part, at in _parts(names, bits):
            yield "ask", level, part, pack(_steps(names[at]), counts[at])
        del names, of, counts
    # tokens as ranks by frequency: most take a byte or two
    names, of, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    by_count = np.argsort(-counts, kind="stable")
    rank = np.empty(len(names), dtype=np.int64)
    rank[by_count] = np.arange(len(names))
    numbers = np.array([0 if i is None else i for i in ids], dtype=np.int64).view(np.uint64)
    null = np.array([i is None for i in ids], dtype=np.uint8)
    yield "state", 0, -1, pack(numbers, null, np.array(held, dtype=np.uint8), sizes, rank[of], names[by_count])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list, list]]:
    """A task's rows in chunks, with an id that no other chunk of the job has."""
    seen: dict[bytes, int] = {}
    ids, held, words, size, n = [], [], [], 0, TaskContext.get().partitionId() << 32
    for batch in slices(batches):
        for doc_id, out, text in zip(batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if len(seen) > 150_000:
                seen.clear()
            own = []
            for w in (text or "").encode("utf-8", "surrogatepass").lower().split():
                h = seen.get(w)
                if h is None:
                    h = seen[w] = xxhash.xxh3_64_intdigest(w)
                own.append(h)
            own.append(int(END))
            ids.append(doc_id), held.append(out), words.append(np.array(own, dtype=np.uint64))
            size += len(own)
            if size >= CHUNK_TOKENS:
                yield n, ids, held, words
                ids, held, words, size, n = [], [], [], 0, n + 1
    if ids:
        yield n, ids, held, words


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (kind, level, part, chunk, data)."""
    columns = list(zip(*rows, strict=True)) or [()] * 5
    some = [pa.array(c, t) for c, t in zip(columns, list(_KINDS.values())[:5], strict=True)]
    return pa.RecordBatch.from_arrays([*some, *[pa.nulls(len(rows), pa.int64())] * 3], names=list(_KINDS))


def _ask(order: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, ids, held, words in chunks(batches):
            for kind, level, part, data in asked(ids, held, words, order, bits):
                yield _blobs([(kind, level, part, n, data)])

    return run


def _received(group: pa.Table, *names: str) -> list[tuple]:
    return sorted(zip(*(group[c].to_pylist() for c in (*names, "data")), strict=True), key=lambda r: r[:-1])


def _count(group: pa.Table) -> pa.Table:
    """One partition of n-grams of one level: totals, answers to the chunks, and counts of counts. A chunk's state passes
    through."""
    if group["kind"][0].as_py() == "state":
        return group
    level, part = group["level"][0].as_py(), group["part"][0].as_py()
    rows = _received(group, "chunk")
    parts = [unpack(data) for _, data in rows]
    keys, of = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_inverse=True)
    train = np.concatenate([p[1] for p in parts]).astype(np.int64)
    total = np.bincount(of, weights=train).astype(np.int64)
    live = np.flatnonzero(train)
    owns = np.zeros(len(of), dtype=np.uint8)  # the first chunk that has it in training
    owns[live[np.unique(of[live], return_index=True)[1]]] = 1
    out, at = [], 0
    for (chunk, _), p in zip(rows, parts, strict=True):
        n = len(p[0])
        out.append(("answer", level, part, chunk, pack(total[of[at : at + n]], owns[at : at + n])))
        at += n
    sizes = np.bincount(np.minimum(total, KEEP + 2), minlength=KEEP + 3)[1 : KEEP + 2]
    texts = total[keys == END].sum() if level == 1 else 0
    stats = np.array([*sizes, total.sum(), (total > 0).sum(), texts], dtype=np.int64)  # rows: a number is its place
    k = len(stats)
    numbers = [pa.array(["stats"] * k, pa.string()), pa.array(np.full(k, level, np.int32)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(np.arange(k)), pa.nulls(k, pa.int64()), pa.array(stats)]
    return pa.concat_tables([pa.Table.from_batches([_blobs(out)]), pa.Table.from_arrays(numbers, names=list(_KINDS))])


def discounts(sizes: np.ndarray) -> np.ndarray:
    """d for counts 0..KEEP, and last for all above. sizes: how many things were seen once, twice, ... KEEP + 1 times."""
    out = np.full(KEEP + 2, 1 - SLIGHT)
    n = [0.0, *sizes.astype(float)]
    if n[1] > 0:
        top = (KEEP + 1) * n[KEEP + 1] / n[1]
        for r in range(1, KEEP + 1):
            if n[r] > 0 and top < 1:
                d = ((r + 1) * n[r + 1] / n[r] / r - top) / (1 - top)
                if 0 < d < 1:
                    out[r] = d
    return out


class Model:
    """What all chunks share, a few numbers: the discounts of each level, and how many tokens, words and texts there are."""

    def __init__(self, sizes: list[np.ndarray], tokens: int, words: int, texts: int):
        self.order, self.discount = len(sizes), [discounts(s) for s in sizes]
        self.tokens, self.words, self.texts = tokens, words, texts
        r = np.arange(1, KEEP + 1)
        low = sizes[0][:KEEP] * r
        seen = (low * self.discount[0][1 : KEEP + 1]).sum() + (tokens - low.sum()) * self.discount[0][KEEP + 1]
        self.unknown = 1 - seen / tokens if tokens else 1.0

    def held(self, level: int, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return counts * self.discount[level - 1][np.minimum(counts, KEEP + 1)]

    def word_prob(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.held(1, counts) / max(1, self.tokens), self.unknown)

    def alpha(self, level: int, own: list[np.ndarray], lower: list[np.ndarray], lower_total: np.ndarray) -> np.ndarray:
        """From the classes of the counts after a history, those of the shorter n-grams, and the shorter history's count."""
        r = np.arange(1, KEEP + 1)

        def summed(level: int, classes: list[np.ndarray]) -> np.ndarray:
            d = self.discount[level - 1]
            return sum(p * k * d[k] for p, k in zip(classes[:KEEP], r, strict=True)) + classes[KEEP] * d[KEEP + 1]

        total = sum(p * k for p, k in zip(own[:KEEP], r, strict=True)) + own[KEEP]
        return (1 - summed(level, own) / total) / (1 - summed(level - 1, lower) / lower_total)


def _classes(counts: np.ndarray, by: np.ndarray, n: int) -> list[np.ndarray]:
    """For each of n groups: how many of its counts are 1, 2, ... KEEP, and the sum of those above."""
    out = [np.bincount(by[counts == r], minlength=n) for r in range(1, KEEP + 1)]
    high = counts > KEEP
    return [*out, np.bincount(by[high], weights=counts[high], minlength=n).astype(np.int64)]


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(keys).view(np.int64))


def _evaluate(model: Model, bits: int):
    def run(group: pa.Table) -> pa.Table:
        """A chunk's state and the answers to it -> sums so far, rows and classes of its own n-grams, and what it asks about
        histories."""
        chunk = group["chunk"][0].as_py()
        received = _received(group, "kind", "level", "part")
        state = unpack(next(r[-1] for r in received if r[0] == "state"))
        numbers, null, held, sizes, ranks, names = state
        words, first = names[ranks], _firsts(sizes)
        n, doc = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
        keys, histories = grams(words, first, model.order)
        out, tables, asks = [], [], []
        value = below = None  # log10 of P at the level before, and the n-grams' counts there
        backs: list[tuple[int, np.ndarray, np.ndarray]] = []
        before_total = None
        for level in range(1, model.order + 1):
            answers = [unpack(data) for kind, at, _, data in received if kind == "answer" and at == level]
            total = np.concatenate([a[0] for a in answers]).astype(np.int64)
            distinct, at, of = np.unique(keys[level - 1], return_index=True, return_inverse=True)
            own = np.flatnonzero(np.concatenate([a[1] for a in answers]))
            count = total[of]
            mine = at[own]  # a token of each n-gram that the chunk owns
            rows = np.argsort(histories[level - 1][mine], kind="stable")  # a history's rows together take fewer bytes
            tables.append(
                pa.Table.from_arrays(
                    [pa.array(["counts"] * len(own), pa.string()), pa.array(np.full(len(own), level, np.int32)), pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.binary()),
                     _signed(histories[level - 1][mine][rows]), _signed(words[mine][rows]), pa.array(total[own][rows])], names=list(_KINDS),
                )
            )
            if level == 1:
                value, known = np.log10(model.word_prob(count)), count > 0
                base = np.bincount(doc, weights=np.log10((count + 0.5) / (model.tokens + 0.5 * (model.words + 1))), minlength=n)
            else:
                history_total = np.concatenate([[0], below[:-1]])
                history_total[first] = model.texts
                seen = count > 0
                with np.errstate(divide="ignore", invalid="ignore"):
                    value = np.where(seen, np.log10(model.held(level, count) / history_total), value)
                # a longer n-gram that is seen leaves nothing to this level
                backs = [(l, k[~seen[k]], t[~seen[k]]) for l, k, t in backs]
                short = np.flatnonzero(~seen & (history_total > 0))
                lower_total = np.full(len(short), max(1, model.tokens)) if level == 2 else before_total[short]
                backs.append((level, short, lower_total))
                before_total = history_total
                names_of, by = np.unique(histories[level - 1][mine], return_inverse=True)
                columns = [*_classes(total[own], by, len(names_of)), *_classes(below[mine], by, len(names_of))]
                out += [("history", level, part, chunk, pack(_steps(names_of[s]), *(c[s] for c in columns))) for part, s in _parts(names_of, bits)]
            below = count
        for level, at, lower_total in backs:
            wanted, one, spot = np.unique(histories[level - 1][at], return_index=True, return_inverse=True)
            asks += [doc[at], spot]
            out += [("ask", level, part, chunk, pack(_steps(wanted[s]), lower_total[one][s])) for part, s in _parts(wanted, bits)]
        sums = np.bincount(doc, weights=value, minlength=n)
        out.append(("state", 0, -1, chunk, pack(numbers, null, held, sizes, np.bincount(doc, weights=known, minlength=n).astype(np.int64), base, sums, *asks)))
        return pa.concat_tables([pa.Table.from_batches([_blobs(out)]), *tables])

    return run


def _back_off(model: Model):
    def run(group: pa.Table) -> pa.Table:
        """One partition of histories of one level: their classes added up, and log10 of alpha for the chunks that ask."""
        level, part = group["level"][0].as_py(), group["part"][0].as_py()
        received = _received(group, "kind", "chunk")
        asks = [(chunk, np.cumsum(own, dtype=np.uint64), total) for kind, chunk, data in received if kind == "ask" for own, total in [unpack(data)]]
        if not asks:
            return pa.Table.from_batches([_blobs([])])
        wanted, one = np.unique(np.concatenate([k for _, k, _ in asks]), return_index=True)
        lower_total = np.concatenate([t for *_, t in asks])[one].astype(np.int64)
        sums = [np.zeros(len(wanted), dtype=np.int64) for _ in range(2 * KEEP + 2)]
        for kind, _, data in received:
            if kind == "history":
                own, *columns = unpack(data)
                own = np.cumsum(own, dtype=np.uint64)
                at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                hit = wanted[at] == own
                for s, c in zip(sums, columns, strict=True):
                    s[at[hit]] += c[hit].astype(np.int64)  # a chunk has each history once
        value = np.log10(model.alpha(level, sums[: KEEP + 1], sums[KEEP + 1 :], lower_total))
        rows = [("alpha", level, part, chunk, pack(value[np.searchsorted(wanted, k)])) for chunk, k, _ in asks]
        return pa.Table.from_batches([_blobs(rows)])

    return run


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _finish(group: pa.Table) -> pa.Table:
    received = _received(group, "kind", "level", "part")
    numbers, null, held, sizes, known, base, total, *asks = unpack(next(r[-1] for r in received if r[0] == "state"))
    for level, (doc, spot) in enumerate(zip(asks[::2], asks[1::2], strict=True), 2):
        found = [unpack(data)[0] for kind, at, _, data in received if kind == "alpha" and at == level]
        if found:
            total = total + np.bincount(doc, weights=np.concatenate(found)[spot], minlength=len(sizes))
    return pa.table(
        {
            "doc_id": pa.array(numbers.astype(np.uint64).view(np.int64), mask=null.astype(bool)),
            "held_out": pa.array(held.astype(bool)),
            "n_tokens": pa.array(sizes.astype(np.int64)),
            "n_known": pa.array(known.astype(np.int64)),
            "base_score": pa.array(base.astype(np.float64)),
            "score": pa.array(total.astype(np.float64)),
        }
    )


def score_documents(docs: DataFrame, order: int = ORDER, from_files: bool = False) -> tuple[DataFrame, Model, DataFrame]:
    """docs(doc_id, text, held_out) -> (scores of every row, the shared numbers, the counts (level, history, word, n); at
    level 1 the history is 0)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    if not from_files:
        rows = materialize(rows, "katz-rows")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / PARTITION_BYTES))))
    # a partition's asks are one group, and each state is one of its own
    own = F.struct("level", "part", F.when(F.col("kind") == "state", F.col("chunk")).alias("own"))
    counted = rows.mapInArrow(_ask(order, bits), _ROWS).groupBy(own).applyInArrow(_count, _ROWS)
    totals = materialize(counted, "katz-totals", ("kind",))
    counted = totals.select("kind", "level", "part", "chunk", "data", "history", "word", "n")
    sums = np.zeros((order, KEEP + 4), dtype=np.int64)
    for r in counted.where("kind = 'stats'").groupBy("level", "history").agg(F.sum("n").alias("n")).collect():  # KEEP + 4 numbers a level
        sums[r["level"] - 1, r["history"]] = r["n"]
    model = Model([row[: KEEP + 1] for row in sums], *(int(x) for x in sums[0, KEEP + 1 :]))
    judged = counted.where("kind IN ('state', 'answer')").groupBy("chunk").applyInArrow(_evaluate(model, bits), _ROWS)
    judged = materialize(judged, "katz-chunks", ("kind",), WRITTEN).select("kind", "level", "part", "chunk", "data", "history", "word", "n")
    release(totals)
    alphas = judged.where("kind IN ('history', 'ask')").groupBy(F.struct("level", "part")).applyInArrow(_back_off(model), _ROWS)
    scores = judged.where("kind = 'state'").union(alphas).groupBy("chunk").applyInArrow(_finish, _RESULT)
    return scores, model, judged.where("kind = 'counts'").select("level", "history", "word", "n")


def op8_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)).alias("held_out")
    scores, model, _ = score_documents(docs.select("doc_id", "text", held), from_files=True)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
