"""Embedding near-dedup by NN-descent.

Vectors are compared within their label only, by cosine in double precision. Vectors of equal directions (same label and
unit vector, to `DIGITS` digits, so scaled copies too) are one point with a weight. A first neighbour graph comes from random projections: each of a few trees deals the points
of a label into leaves by the signs of random projections, as many signs as make leaves of about `LEAF` points, and a
leaf's points are compared with each other. Then the graph is refined: each point gathers its neighbours and those
whose neighbour it is, these are compared with each other (neighbours of neighbours), and each point keeps the best `K`,
until a round changes little. Each round also deals one tree's leaves anew, so that points meet others of other parts.

A list that is full of links (all `K` at or above the threshold) is saturated and is enlarged, up to `ENLARGED` times, as
long as it is full. A point with more links than that has its whole component of found links compared: the component's
members are dealt into blocks, and blocks are compared with blocks, each pair where it is dealt, which gives every link
inside without a limit; of each block pair only counts come out. Other points keep their lists' threshold edges.

Recall is audited label by label. Of each label `AUDIT_POINTS` points spread by a hash are asked, and as many of those whose
lists reach within `NEAR` of the threshold, where links are likely; their links are found by brute force against all points
of the label, block by block, and each block only counts. A label's recall is the share of these links that lead into the
same component, and of these that n_links counts, whichever is less. Labels below `MIN_RECALL` are searched again by themselves,
from other trees with longer lists; labels with fewer than `MIN_LINKS` audited links are also judged together, as few links
say little. Those that are still below it after the last attempt are compared in full, blocks with blocks. The graph misses only
what the audit can't see; no list is cut without the exact way above. Components are those of all links found.

Leaves and gathered lists that are larger than a block (equal signs, hubs) are dealt into parts by a hash that changes
with the tree, round and attempt, so that no group, however many points agree, is gathered in one task.

Null vectors and labels, zero vectors and those with null or non-finite components, and an empty table link nothing.
Vectors of different lengths never link. Rows that share a vec_id are copies of one vector id: each has the links of its
own vector, and what any of them links is searched. Ties of similarity in a list go to the larger point number, which
decides nothing else: links and components don't depend on it. A null vec_id links nothing. Vectors of any length are
held whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import connected_components, materialize, ship, table

THRESHOLD = 0.93
K = 10
#: Times K to which a list that is full of links is enlarged.
ENLARGED = 4
TREES = 3
LEAF = 32
BLOCK = 512
MAX_ROUNDS = 6
#: A round that adds fewer links than this share of those found is the last.
SETTLED = 0.002
AUDIT_POINTS = 64
#: Below the threshold by less: a point is likely to have links.
NEAR = 0.03
MIN_LINKS = 20
MIN_RECALL = 0.95
SIGNS = 30
#: Digits of the components of unit vectors that tell points apart; scaled copies differ in the last ones of a double.
DIGITS = 12


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors, and a key that vectors of a label with one direction share; null where a row can't link."""
    for batch in batches:
        keys, units = [], []
        for vec_id, label, v in zip(batch["vec_id"].to_pylist(), batch["label"].to_pylist(), batch["embedding"].to_pylist(), strict=True):
            key = unit = None
            if vec_id is not None and label is not None and v and None not in v:
                x = np.array(v, dtype=np.float64)
                size = np.linalg.norm(x) if np.isfinite(x).all() else 0.0
                if np.isfinite(size) and size > 0:
                    x = x / size
                    own = np.round(x, DIGITS) + 0.0  # no negative zeros
                    key = xxhash.xxh3_128_digest(label.encode() + b"\0" + own.tobytes())
                    unit = x.tobytes()
            keys.append(key), units.append(unit)
        yield pa.RecordBatch.from_pydict(
            {"vec_id": batch["vec_id"], "label": batch["label"], "key": pa.array(keys, pa.binary()), "unit": pa.array(units, pa.binary())}
        )


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def _coded(trees: int, attempt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The signs of each tree's projections, as one number a tree."""
        for batch in batches:
            units = batch["unit"].to_pylist()
            codes = np.zeros((len(units), trees), dtype=np.int64)
            sizes = np.array([len(u) // 8 for u in units])
            for size in set(sizes.tolist()):
                rows = np.flatnonzero(sizes == size)
                made = np.random.default_rng([size, attempt]).standard_normal((trees, size, SIGNS))
                x = _matrix([units[r] for r in rows])
                for t in range(trees):
                    codes[rows, t] = (x @ made[t] > 0) @ (1 << np.arange(SIGNS))
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "label": batch["label"], "dim": pa.array(sizes, pa.int32()), "unit": batch["unit"], "codes": pa.array(codes.tolist(), pa.list_(pa.int64()))})

    return run


def _compared(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """ids, units of a group -> each member's k best in it, and links up to the enlarged length."""
        for batch in batches:
            a, b, sims = [], [], []
            for ids, units in zip(batch["ids"].to_pylist(), batch["units"].to_pylist(), strict=True):
                ids, first = np.unique(np.array(ids, dtype=np.int64), return_index=True)
                if len(ids) < 2:
                    continue
                x = _matrix([units[i] for i in first])
                s = x @ x.T
                np.fill_diagonal(s, -2)
                n = min(k * ENLARGED, len(ids) - 1)
                best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                found = np.take_along_axis(s, best, 1)
                least = np.sort(found, axis=1)[:, -min(k, n)]
                keep = (found >= least[:, None]) | (found >= THRESHOLD)  # beyond k, links only
                a.append(np.repeat(ids, n)[keep.ravel()]), b.append(ids[best][keep]), sims.append(found[keep])
            join = lambda parts, kind: np.concatenate(parts) if parts else np.array([], dtype=kind)
            yield pa.RecordBatch.from_pydict({"a": pa.array(join(a, np.int64)), "b": pa.array(join(b, np.int64)), "sim": pa.array(join(sims, np.float64))})

    return run


_EDGE = "a long, b long, sim double"


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of each point, or as many as an enlarged list holds if these are links."""
    ranked = F.sort_array(F.collect_set(F.struct("sim", "b")), asc=False)
    top = edges.groupBy("a").agg(F.slice(ranked, 1, k * ENLARGED).alias("top"))
    full = F.coalesce(F.get("top", F.lit(k - 1))["sim"] >= THRESHOLD, F.lit(False))
    listed = top.select("a", F.posexplode("top").alias("at", "e"), full.alias("full"))
    return listed.where((F.col("at") < k) | F.col("full") & (F.col("e.sim") >= THRESHOLD)).select("a", "e.b", "e.sim")


def _grouped(rows: DataFrame, keys: list[str], size: int, *salt, only_dealt: bool = False) -> DataFrame:
    """rows(keys..., id, unit) gathered by keys into lists of about `size` at most; larger groups are dealt by a hash of
    id, keys and salt (only_dealt: and smaller ones left out)."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("in_group"))
    if only_dealt:
        counts = counts.where(F.col("in_group") > size)
    part = F.pmod(F.xxhash64("id", *keys, *[F.lit(x) for x in salt]), F.ceil(F.col("in_group") / size))
    # one column, so that a group's parts are dealt by it and not by the keys alone
    dealt = rows.join(counts, keys).select(F.struct(*keys, part.alias("part")).alias("own"), "id", "unit")
    return dealt.groupBy("own").agg(F.collect_list("id").alias("ids"), F.collect_list("unit").alias("units"))


def neighbour_graph(points: DataFrame, k: int = K, attempt: int = 0) -> DataFrame:
    """points(id, label, unit) -> (a, b, sim): NN-descent's k best neighbours of each point; trees differ by attempt."""
    coded = points.mapInArrow(_coded(TREES, attempt), "id long, label string, dim int, unit binary, codes array<long>")
    per_label = coded.groupBy("label", "dim").agg(F.count("*").alias("n"))
    signs = F.greatest(F.lit(0), F.least(F.lit(SIGNS), F.ceil(F.log2(F.col("n") / LEAF)))).cast("int")
    placed = coded.join(per_label.select("label", "dim", signs.alias("signs")), ["label", "dim"]).select(
        "label", "dim", "id", "unit", F.posexplode("codes").alias("tree", "code"), "signs"
    )
    placed = placed.select("label", "dim", "tree", F.expr("code & (shiftleft(1L, signs) - 1)").alias("leaf"), "id", "unit")
    leaves = _grouped(placed, ["label", "dim", "tree", "leaf"], 2 * LEAF, attempt)
    graph = materialize(_best(leaves.select("ids", "units").mapInArrow(_compared(k), _EDGE), k), "descent-0")
    links = None
    for n in range(1, MAX_ROUNDS + 1):
        near = graph.select("a", "b").union(graph.select("b", "a")).toDF("a", "b").distinct()
        lists = near.join(points.select(F.col("id").alias("b"), "unit"), "b").select("a", F.col("b").alias("id"), "unit")
        # the point itself is in its list, so that a neighbour's neighbour meets it too
        lists = lists.union(points.select(F.col("id").alias("a"), "id", "unit"))
        groups = _grouped(lists, ["a"], 4 * k, attempt, n).select("ids", "units")
        # parts of a large leaf share no neighbour, so their points are also dealt anew
        again = placed.where(F.col("tree") == n % TREES)
        groups = groups.union(_grouped(again, ["label", "dim", "tree", "leaf"], 2 * LEAF, attempt, n, only_dealt=True).select("ids", "units"))
        graph = materialize(_best(graph.union(groups.mapInArrow(_compared(k), _EDGE)), k), f"descent-{n}")
        now = graph.where(F.col("sim") >= THRESHOLD).count()
        if links is not None and now - links <= SETTLED * max(now, 1):
            break
        links = now
    return graph


def _block_counts(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two blocks -> for each member of the first, the weight of its links in the second."""
        for batch in batches:
            ids, counts = [], []
            columns = (batch[c].to_pylist() for c in ("ids", "units", "other_ids", "other_units", "other_weights"))
            for own, units, other, other_units, weights in zip(*columns, strict=True):
                x, y = _matrix(units), _matrix(other_units)
                linked = (x @ y.T >= threshold) & (np.array(own)[:, None] != np.array(other)[None, :])
                ids.append(np.array(own, dtype=np.int64))
                counts.append(linked @ np.array(weights, dtype=np.int64))
            join = lambda parts: np.concatenate(parts) if parts else np.array([], dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"id": pa.array(join(ids)), "n": pa.array(join(counts))})

    return run


def _blocks(rows: DataFrame, keys: list[str], name: str, *more: str) -> DataFrame:
    """rows(keys..., id, unit, weight, more...) in blocks of about BLOCK, and how many blocks those keys have."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("n_blocks"))
    own = F.struct(*keys, "n_blocks", F.pmod(F.xxhash64("id"), "n_blocks").alias("block")).alias("own")
    blocked = rows.join(sizes, keys).select(own, "id", "unit", "weight", *more).groupBy("own").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("id", "unit", "weight", *more)])
    return materialize(blocked.select("own.*", *[f"{c}s" for c in ("id", "unit", "weight", *more)]), name)


def _met(blocks: DataFrame, keys: list[str], asking: DataFrame | None = None, *more: str) -> DataFrame:
    """Each block, or each list that asks, with each block of its keys, dealt by the other block, so that no group is one task."""
    own = ["ids", "units", *[f"{c}s" for c in more]]
    at = lambda block: F.struct(*keys, block.alias("block")).alias("at")
    other = blocks.select(at(F.col("block")), *[F.col(c).alias(f"other_{c}") for c in (*own, "weights")])
    asking = (asking or blocks).select(*keys, *own, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("to"))
    return asking.select(at(F.col("to")), *own, keys[0]).join(other, "at").select(keys[0], *own, *[f"other_{c}" for c in (*own, "weights")])


def enlarged_counts(points: DataFrame, parts: DataFrame, saturated: DataFrame) -> DataFrame:
    """(id, n): links of the saturated points inside their components. parts: (node, component); blocks meet blocks."""
    members = points.select("id", "unit", "weight").join(parts.select(F.col("node").alias("id"), "component"), "id")
    wanted = parts.join(saturated.select(F.col("a").alias("node")), "node", "left_semi").select("component").distinct()
    blocks = _blocks(members.join(wanted, "component", "left_semi"), ["component"], "descent-blocks")
    counts = _met(blocks, ["component"]).mapInArrow(_block_counts(THRESHOLD), "id long, n long")
    return counts.groupBy("id").agg(F.sum("n").alias("n")).join(saturated.select(F.col("a").alias("id")), "id", "left_semi")


def _block_links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two blocks -> for each member of the first, the weight of its links in the second, and links that join what
        the two blocks join: each linked member of both to the smallest id it reaches."""
        for batch in batches:
            a, b, n = [], [], []
            columns = (batch[c].to_pylist() for c in ("ids", "units", "other_ids", "other_units", "other_weights"))
            for own, units, other, other_units, weights in zip(*columns, strict=True):
                own, other = np.array(own, dtype=np.int64), np.array(other, dtype=np.int64)
                linked = (_matrix(units) @ _matrix(other_units).T >= threshold) & (own[:, None] != other[None, :])
                rows, cols = linked.any(axis=1), linked.any(axis=0)
                linked = linked[rows][:, cols]
                x, y, largest = own[rows], other[cols], np.iinfo(np.int64).max
                while len(x):
                    low = np.minimum(x, np.where(linked, y[None, :], largest).min(axis=1))
                    other_low = np.minimum(y, np.where(linked, low[:, None], largest).min(axis=0))
                    if (low == x).all() and (other_low == y).all():
                        break
                    x, y = low, other_low
                a += [own[rows], other[cols]]
                b += [x, y]
                n += [linked @ np.array(weights, dtype=np.int64)[cols], np.zeros(len(y), dtype=np.int64)]
            join = lambda parts: pa.array(np.concatenate(parts) if parts else np.array([], dtype=np.int64))
            yield pa.RecordBatch.from_pydict({"a": join(a), "b": join(b), "n": join(n)})

    return run


def compared_in_full(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, b) links that join what is linked, (id, n) weights of links) of all points; blocks meet blocks,
    so lists stay short, but the work grows with the square of a label."""
    own = points.withColumn("dim", F.octet_length("unit"))
    pairs = _met(_blocks(own, ["label", "dim"], "full-blocks"), ["label", "dim"])
    found = materialize(pairs.mapInArrow(_block_links(THRESHOLD), "a long, b long, n long"), "full-links")
    return found.where("a <> b").select("a", "b").distinct(), found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n")).where("n > 0")


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Asked points and a block -> for each, the weight of its links in the block, and of those inside its component."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        columns = ("label", "ids", "units", "components", "other_ids", "other_units", "other_weights", "other_components")
        for label, own, units, part, other, other_units, weights, other_part in zip(*(batch[c].to_pylist() for c in columns), strict=True):
            linked = (_matrix(units) @ _matrix(other_units).T >= THRESHOLD) & (np.array(own)[:, None] != np.array(other)[None, :])
            inside = linked & (np.array(part)[:, None] == np.array(other_part)[None, :])
            w = np.array(weights, dtype=np.int64)
            for to, values in zip(out, ([label] * len(own), own, linked @ w, inside @ w), strict=True):
                to.extend(values)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["label", "id", "n", "joined"])


def audit_recall(points: DataFrame, graph: DataFrame, parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, n, hit): by label, the links of the asked points, and those found, which are those that parts(node, component)
    join or that counts(id, n) count, whichever are fewer."""
    component = F.coalesce("component", "id").alias("component")
    placed = points.join(parts.withColumnRenamed("node", "id"), "id", "left").select("id", "label", F.octet_length("unit").alias("dim"), "unit", "weight", component)
    blocks = _blocks(placed, ["label", "dim"], "audit-blocks", "component")
    likely = graph.where(F.col("sim") >= THRESHOLD - NEAR).select(F.col("a").alias("id")).distinct().withColumn("likely", F.lit(True))
    spread = F.xxhash64("id", F.lit("audit"))
    asked = placed.join(likely, "id", "left").withColumn("likely", F.coalesce("likely", F.lit(False))).withColumn("bin", F.pmod(spread, F.lit(AUDIT_POINTS)))
    first = F.min_by(F.struct("id", "unit", "component"), F.struct(spread, "id")).alias("p")  # one point a bin, found on the map side
    asked = asked.groupBy("label", "dim", "likely", "bin").agg(first)
    lists = asked.groupBy("label", "dim").agg(*[F.collect_list(f"p.{c}").alias(f"{c}s") for c in ("id", "unit", "component")])  # 2 * AUDIT_POINTS at most
    asking = lists.join(blocks.groupBy("label", "dim").agg(F.max("n_blocks").alias("n_blocks")), ["label", "dim"])
    met = _met(blocks, ["label", "dim"], asking, "component")
    true = met.mapInArrow(_audited, "label string, id long, n long, joined long").groupBy("label", "id").agg(F.sum("n").alias("n"), F.sum("joined").alias("joined"))
    judged = true.join(counts.select("id", F.col("n").alias("counted")), "id", "left")
    hit = F.least("joined", F.least("n", F.coalesce("counted", F.lit(0))))
    return materialize(judged.groupBy("label").agg(F.sum("n").alias("n"), F.sum(hit).alias("hit")), "audit")


def short_labels(audit: DataFrame) -> DataFrame:
    """The labels whose recall is too low: by themselves, or as some of those with few links when these are short together."""
    few = audit.where(F.col("n") < MIN_LINKS).agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).first()
    together = bool(few["n"]) and few["hit"] < MIN_RECALL * few["n"]
    return materialize(audit.where((F.col("hit") < MIN_RECALL * F.col("n")) | (F.col("n") < MIN_LINKS) & F.lit(together)).select("label"), "audit-short")


def _counted(points: DataFrame, linked: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """(id, n): the weights of the points' links; listed ones, or all of the component where a list was full."""
    weights = points.select(F.col("id").alias("b"), "weight")
    both = linked.select("a", "b").union(linked.select("b", "a")).toDF("a", "b").distinct()
    saturated = materialize(linked.groupBy("a").count().where(F.col("count") >= k * ENLARGED).select("a"), "descent-saturated")
    # a neighbour of a saturated point may be short of links too: all members of such components are counted in full
    in_full = parts.join(parts.join(saturated.toDF("node"), "node", "left_semi").select("component").distinct(), "component", "left_semi").select(F.col("node").alias("a"))
    in_full = materialize(in_full, "descent-in-full")
    listed = both.join(in_full, "a", "left_anti").join(weights, "b").groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("n"))
    return materialize(listed.union(enlarged_counts(points, parts, in_full)), "descent-counts")


def search(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((vec_id, n_links, component_id) of every row, (label, n, hit): links as audited)."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialize(rows.mapInArrow(_points, "vec_id long, label string, key binary, unit binary"), "descent-rows")
    able = rows.where("key IS NOT NULL")
    points = able.groupBy("key").agg(
        F.min("vec_id").alias("name"), F.first("label").alias("label"), F.first("unit").alias("unit"), F.count_distinct("vec_id").alias("weight")
    )
    # numbers of our own, fixed once written: rows that share a vec_id are different points
    points = materialize(points.withColumn("id", F.monotonically_increasing_id()), "descent-points")
    todo, done = points, []  # links stay within a label, so labels are done one by one
    for attempt, k in enumerate((K, 2 * K, 4 * K)):
        graph = neighbour_graph(todo, k, attempt)
        linked = graph.where(F.col("sim") >= THRESHOLD)
        parts = materialize(connected_components(linked.select("a", "b")), "descent-parts")
        counts = _counted(todo, linked, parts, k)
        audit = audit_recall(todo, graph, parts, counts)
        short = short_labels(audit)
        if short.isEmpty():
            done.append((parts, counts, audit))
            break
        good = todo.join(short, "label", "left_anti").select("id")
        done.append((parts.join(good.toDF("node"), "node", "left_semi"), counts.join(good, "id", "left_semi"), audit.join(short, "label", "left_anti")))
        todo = materialize(todo.join(short, "label", "left_semi"), "descent-again")
    else:
        full, counts = compared_in_full(todo)
        parts = materialize(connected_components(full), "descent-parts")
        done.append((parts, counts, audit_recall(todo, full.withColumn("sim", F.lit(THRESHOLD)), parts, counts)))
    parts, counts, audit = (reduce(DataFrame.unionByName, found) for found in zip(*done, strict=True))
    named = points.select("key", "id", "name", "weight").join(counts, "id", "left").join(parts.select(F.col("node").alias("id"), "component"), "id", "left")
    lowest = named.where("component IS NOT NULL").groupBy("component").agg(F.min("name").alias("lowest"))  # the smallest vec_id of each component
    named = named.join(lowest, "component", "left").select(
        F.col("key").alias("own_key"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("lowest", "name").alias("component")
    )
    out = rows.select("vec_id", "key").join(named, F.col("key") == F.col("own_key"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")), audit


def _recall(audit: DataFrame) -> tuple[float, int]:
    """The share of all audited links that was found, and how many were audited."""
    total = audit.agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).first()
    return (total["hit"] / total["n"] if total["n"] else 1.0), int(total["n"] or 0)


def near_duplicates(vectors: DataFrame) -> tuple[DataFrame, float]:
    """((vec_id, n_links, component_id) of every row, recall as audited)."""
    out, audit = search(vectors)
    return out, _recall(audit)[0]


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, audit = search(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    recall, links = _recall(audit)
    kept = (F.col("vec_id") == F.col("component_id")).alias("kept")
    return out.select("vec_id", "n_links", "component_id", kept, F.lit(float(recall)).alias("audited_recall"), F.lit(links).cast("long").alias("audited_links"))
