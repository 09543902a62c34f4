"""Conversation structure repair: the cheapest edits that give a conversation a sound order of turns.

Method: Dijkstra on the implicit lattice of (turn index, grammar state). An edge keeps, re-roles or deletes the next turn, or
inserts an empty one; the queue's key is (cost, audit), audit being the edits' initials so far, and the search of a whole
conversation stops at the first accepting end node that is popped. Nodes are made when they are reached. A cost follows from
the audit and the turns, so of two ways to a node the one with the smaller key stays smaller however they go on.

Turns are sorted by range over conversation and turn, so a conversation of any size is dealt over tasks. One that lies within a
task and has at most LONG turns and LONG_BYTES of text is solved where it stands. The others (two at each edge of a task, and
the long ones) are written as rows in their order and go the long way: the first of equal turns is found by grouping, blocks
of BLOCK turns are searched from every state to every state, and the blocks of a conversation are chained by (cost, audit),
which takes bytes in proportion to its audit. Both ways give the same rows. Only a digest of one whole conversation, which
op13_turn_repair is asked for, runs through a long conversation in one task, as a stream of its blocks.

Order: by turn, nulls first, then by role and text. A null role or text is one space; a null conv_id is a conversation of
its own. Rows that are equal in all columns are copies of each other: the first is sound, the others are
duplicates. Empty texts are blank. Very long texts travel whole. Other columns are not looked at. No rows, no conversations.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from sparkloom.llm.common import materialize, ship, slices, table

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: What a truncated turn costs besides if it stays.
TRUNCATED_COST = 5
#: The grammar (s?(ua)+)?: state -> initial -> next state. It begins at START.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ACCEPTING = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
ALTERNATING = ("su", "ua", "au")
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LONG, LONG_BYTES, BLOCK = 1024, 1 << 24, 256
#: Characters of role and text in a range.
HEAD = 32

_LONG, _TEXT = pa.int64(), pa.string()
TURNS = pa.list_(pa.struct([("edit", _TEXT), ("role", _TEXT), ("text", _TEXT)]))
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SOLVED = pa.schema([("conv_id", _LONG), *((c, _LONG) for c in COUNTS), ("audit", _TEXT), ("turns", TURNS)])
#: A row that goes the long way; at is its place in the order of all rows. dropped rows only say that there is a conversation.
OPEN = pa.schema([("conv_id", _LONG), ("at", _LONG), ("dropped", pa.bool_()), ("turn", _LONG), ("role", _TEXT), ("text", _TEXT)])
EITHER = pa.schema([("solved", pa.struct(list(SOLVED))), ("open", pa.struct(list(OPEN)))])
WAYS = pa.list_(pa.struct([("start", _LONG), ("end", _LONG), ("cost", _LONG), ("audit", _TEXT)]))
BLOCK_WAYS = pa.schema([("conv_id", _LONG), ("block", _LONG), ("ways", WAYS)])
PARTS = pa.list_(pa.struct([("block", _LONG), ("start", _LONG), ("audit", _TEXT)]))
CHAINED = pa.schema([("conv_id", _LONG), ("cost", _LONG), ("audit", _TEXT), ("parts", PARTS)])
PIECES = pa.schema([("conv_id", _LONG), ("piece", _LONG), ("turns", TURNS)])
DIGESTS = pa.schema([("own", _LONG), ("repaired_sha256", _TEXT)])


def symbol(role: str, fault: int) -> str:
    """What the lattice has to know of a turn: its initial if the grammar has it, else x; upper case if it is truncated; - if
    it has to go."""
    if fault in (BLANK, DUPLICATE):
        return "-"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial.upper() if fault == TRUNCATED else initial


def fault_of(text: str) -> int:
    """BLANK, TRUNCATED or 0; only the turns before it tell a duplicate."""
    solid = text.rstrip(SPACE)
    return BLANK if not solid else 0 if solid[-1] in ENDS else TRUNCATED


def moves(state: int, mark: str | None):
    """(edit, cost, next state, whether the turn is used) from a node; mark is the next turn's symbol, None behind the last."""
    if mark is not None:
        yield DELETE, COSTS[DELETE], state, True
        if mark != "-":
            extra = TRUNCATED_COST if mark.isupper() else 0
            if mark.lower() in GRAMMAR[state]:
                yield KEEP, COSTS[KEEP] + extra, GRAMMAR[state][mark.lower()], True
            for initial in ROLES:
                if initial in GRAMMAR[state]:
                    yield REROLE, COSTS[REROLE] + extra, GRAMMAR[state][initial], True
    for initial in ROLES:
        if initial in GRAMMAR[state]:
            yield INSERT, COSTS[INSERT], GRAMMAR[state][initial], False


def search(marks: str, start: int = START, until=ACCEPTING) -> dict[int, tuple[int, str]]:
    """End state -> (cost, audit) of the best way over the turns. With `until`, only the first such end node that is popped."""
    queue, done, ends = [(0, "", 0, start)], set(), {}
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(marks):
            if until is not None and state in until:
                return {state: (cost, audit)}
            ends[state] = (cost, audit)
        for edit, price, after, used in moves(state, marks[at] if at < len(marks) else None):
            if (at + used, after) not in done:
                heapq.heappush(queue, (cost + price, audit + edit, at + used, after))
    return ends


@lru_cache(maxsize=1 << 16)
def best(marks: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return next(iter(search(marks).values()))


def edited(audit: str, turns: list[tuple[str, str]], state: int = START) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the turns that stay or are inserted, beginning at a state of the grammar."""
    out, rest = [], iter(turns)
    for edit in audit:
        role, text = next(rest) if edit != INSERT else (None, "")
        if edit == DELETE:
            continue
        if edit != KEEP:
            initial = next(i for i in GRAMMAR[state] if i in ROLES)  # each state has one
            role = ROLES[initial]
        state = GRAMMAR[state][role[0]]
        out.append((edit, role, text))
    return out


def _spread(turns: list) -> tuple[int, int]:
    """Missing turn numbers between the smallest and the largest."""
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def solve(conv_id, rows: list[tuple]) -> dict:
    """rows: (turn, role, text) of a whole conversation in order."""
    seen, marks, faults = set(), [], [0] * 4
    for _, role, text in rows:
        fault = fault_of(text)
        if fault != BLANK and (role, text) in seen:
            fault = DUPLICATE
        seen.add((role, text))
        faults[fault] += 1
        marks.append(symbol(role, fault))
    cost, audit = best("".join(marks))
    pairs = zip(rows, rows[1:], strict=False)
    return {
        "conv_id": conv_id, "gaps": _spread([r[0] for r in rows]), "blank": faults[BLANK], "duplicate": faults[DUPLICATE], "truncated": faults[TRUNCATED],
        "illegal": sum(a[1][:1] + b[1][:1] not in ALTERNATING for a, b in pairs), "cost": cost, "audit": audit,
        "turns": [dict(zip(("edit", "role", "text"), x, strict=True)) for x in edited(audit, [r[1:] for r in rows])],
    }


def _stand_alone(long: int, size_limit: int, block: int):
    """Solve the conversations that lie within a task; hand on the rows of the others. A row of the result has either."""

    def run(batches):
        task = TaskContext.get().partitionId() << 40
        out: list[dict] = []
        own, size, edge, flowing, at, conv = [], 0, True, False, 0, object()  # conv: nothing yet

        def pack():
            batch = pa.RecordBatch.from_pylist(out, EITHER)
            out.clear()
            return batch

        def hand_on():
            out.extend({"open": r} for r in own)
            own.clear()

        for batch in slices(batches):
            for row in batch.to_pylist():
                if row["conv_id"] != conv or at == 0:
                    if at and not (edge or flowing):
                        out.append({"solved": solve(conv, [(r["turn"], r["role"], r["text"]) for r in own if not r["dropped"]])})
                        own.clear()
                    else:
                        hand_on()
                    edge, flowing, size, conv = at == 0, False, 0, row["conv_id"]
                own.append(row | {"at": task + at})
                at += 1
                size += len(row["text"] or "")
                if len(own) > long or size > size_limit or flowing or edge and len(own) >= block:
                    flowing, size = True, 0
                    hand_on()
                if len(out) >= 512 or flowing and out:
                    yield pack()
        hand_on()  # it may go on in the next task
        if out:
            yield pack()

    return run


def _first_of_equals(rows: DataFrame) -> DataFrame:
    """Open rows with their fault and symbol, without text."""
    named = rows.where("NOT dropped").withColumn("digest", F.sha2("text", 256))
    first = named.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first_at")).select("first_at")
    solid = F.rtrim("text", F.lit(SPACE))
    blank, cut = solid == "", ~F.right(solid, F.lit(1)).isin(*ENDS)
    marked = named.select("conv_id", "at", "turn", F.substring("role", 1, 1).alias("initial"), F.when(blank, BLANK).when(cut, TRUNCATED).otherwise(0).alias("fault"))
    marked = marked.join(first.hint("merge"), F.col("at") == F.col("first_at"), "left")
    return marked.withColumn("fault", F.when((F.col("fault") != BLANK) & F.col("first_at").isNull(), DUPLICATE).otherwise(F.col("fault"))).drop("first_at")


def _block_ways(batches):
    """Each block of turns, from each state to each state."""
    for batch in batches:
        ways = []
        for turns in batch.column(2).to_pylist():
            marks = "".join(symbol(t["initial"], t["fault"]) for t in turns)
            ways.append([{"start": s, "end": e, "cost": c, "audit": a} for s in GRAMMAR for e, (c, a) in search(marks, s, None).items()])
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ways, WAYS)], schema=BLOCK_WAYS)


def chain(blocks: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """Blocks in order, each (start, end) -> (cost, audit) -> the cost, and each block's start and audit on the best way."""
    reached = {START: (0, "", None)}  # state -> cost, audit, the way here
    for ways in blocks:
        after: dict = {}
        for (start, end), (cost, audit) in ways.items():
            if start in reached:
                so_far, text, way = reached[start]
                found = (so_far + cost, text + audit, (way, start, audit))
                if end not in after or found[:2] < after[end][:2]:
                    after[end] = found
        reached = after
    cost, _, way = min((reached[s] for s in ACCEPTING if s in reached), key=lambda x: x[:2])
    pieces = []
    while way is not None:
        way, start, audit = way
        pieces.append((start, audit))
    return cost, pieces[::-1]


def _chained(batches):
    for batch in batches:
        for row in batch.to_pylist():
            blocks = sorted(row["blocks"], key=lambda b: b["block"])
            cost, pieces = chain([{(w["start"], w["end"]): (w["cost"], w["audit"]) for w in b["ways"]} for b in blocks])
            parts = [{"block": b["block"], "start": s, "audit": a} for b, (s, a) in zip(blocks, pieces, strict=True)]
            yield pa.RecordBatch.from_pylist([{"conv_id": row["conv_id"], "cost": cost, "audit": "".join(a for _, a in pieces), "parts": parts}], CHAINED)


def _pieces(batches):
    for batch in batches:
        for row in batch.to_pylist():
            rows = sorted(row["rows"], key=lambda r: r["at"])
            turns = [dict(zip(("edit", "role", "text"), x, strict=True)) for x in edited(row["audit"], [(r["role"], r["text"]) for r in rows], row["start"])]
            yield pa.RecordBatch.from_pylist([{"conv_id": row["conv_id"], "piece": row["block"], "turns": turns}], PIECES)


def _the_long_way(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open rows -> (conv_id and the summary) and (conv_id, piece, turns)."""
    block = F.expr(f"shiftright(at, {BLOCK.bit_length() - 1})").alias("block")
    marked = materialize(_first_of_equals(rows), "turns-marked")
    numbers = marked.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))  # a number once, then counted
    gaps = numbers.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    faults = marked.groupBy("conv_id").agg(*[F.sum(F.when(F.col("fault") == n, 1).otherwise(0)).alias(c) for c, n in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))])
    turns = F.array_sort(F.collect_list(F.struct("at", "initial", "fault"))).alias("turns")  # at most BLOCK
    blocks = materialize(marked.select("conv_id", block, "at", "initial", "fault").groupBy("conv_id", "block").agg(turns), "turns-blocks")
    inner = F.expr("aggregate(sequence(2, size(turns)), 0L, (n, k) -> n + if(concat(turns[k - 2].initial, turns[k - 1].initial) IN ('su', 'ua', 'au'), 0L, 1L))")
    edges = blocks.select("conv_id", "block", F.expr("turns[0].initial").alias("head"), F.expr("turns[size(turns) - 1].initial").alias("tail"), F.when(F.size("turns") > 1, inner).otherwise(F.lit(0).cast("long")).alias("inner"))
    ways = blocks.mapInArrow(_block_ways, from_arrow_schema(BLOCK_WAYS))
    # what stands between two blocks of a conversation: the blocks' edges in order, a few bytes for each
    between = edges.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "head", "tail"))).alias("e"), F.sum("inner").alias("inner"))
    meeting = F.expr("aggregate(sequence(2, size(e)), 0L, (n, k) -> n + if(concat(e[k - 2].tail, e[k - 1].head) IN ('su', 'ua', 'au'), 0L, 1L))")
    illegal = between.select("conv_id", (F.col("inner") + F.when(F.size("e") > 1, meeting).otherwise(F.lit(0).cast("long"))).alias("illegal"))
    chained = materialize(ways.groupBy("conv_id").agg(F.collect_list(F.struct("block", "ways")).alias("blocks")).mapInArrow(_chained, from_arrow_schema(CHAINED)), "turns-chained")
    every = rows.select("conv_id").distinct()
    summary = every
    for part in (gaps, faults, illegal, chained.drop("parts")):
        part = part.withColumnRenamed("conv_id", "own")
        summary = summary.join(part.hint("merge"), F.expr("conv_id <=> own"), "left").drop("own")
    summary = summary.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"))
    parts = chained.select("conv_id", F.explode("parts").alias("p")).select(F.col("conv_id").alias("own"), "p.*")
    texts = rows.where("NOT dropped").select("conv_id", block, "at", "role", "text").groupBy("conv_id", "block").agg(F.collect_list(F.struct("at", "role", "text")).alias("rows"))
    pieces = texts.withColumnRenamed("block", "own_block").join(parts.hint("merge"), F.expr("conv_id <=> own AND own_block = block")).select("conv_id", "block", "start", "audit", "rows")
    return summary, pieces.mapInArrow(_pieces, from_arrow_schema(PIECES))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """turns (conv_id, turn, role, text, dropped) -> what is found of conversations solved whole (conv_id, the summary, turns),
    of the others (conv_id, the summary), and their turns in pieces (conv_id, piece, turns), piece ascending in order."""
    ship(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.lit(0).cast("long").alias("at"), "dropped", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    # the ranges are found from beginnings of role and text, which order rows as the whole ones do as far as they go
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substring("role", 1, HEAD).asc(), F.when(F.length("role") <= HEAD, F.substring("text", 1, HEAD)).asc_nulls_last()]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    both = rows.mapInArrow(_stand_alone(LONG, LONG_BYTES, BLOCK), from_arrow_schema(EITHER))
    both = materialize(both, "turns")
    summary, pieces = _the_long_way(both.where("open IS NOT NULL").select("open.*"))
    return both.where("solved IS NOT NULL").select("solved.*"), summary, pieces


def damage(conversations: DataFrame) -> DataFrame:
    """The query's damage: by crc32 of conv_id:turn modulo 20 a row is dropped (0), emptied (1), robbed of its ends of
    sentences (2), repeated (3) or given to the user (4)."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.pmod(F.crc32(named.cast("binary")), F.lit(20)).alias("hit"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("hit") == 0).alias("dropped"))


def _digests(batches):
    """Lines of a conversation in order -> its digest; only the hash's state is held."""
    conv, state = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != conv:
                if state is not None:
                    yield pa.RecordBatch.from_pylist([{"own": conv, "repaired_sha256": state.hexdigest()}], DIGESTS)
                conv, state, begun = row["conv_id"], hashlib.sha256(), False
            for t in row["turns"]:
                state.update((("\n" if begun else "") + f"{t['role']}:{t['text']}").encode())
                begun = True
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"own": conv, "repaired_sha256": state.hexdigest()}], DIGESTS)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(*repair(damage(table(spark, sf_dir, "conversations"))))


def digested(solved: DataFrame, summary: DataFrame, pieces: DataFrame) -> DataFrame:
    """The three parts of repair() as a row for each conversation, its turns as a digest."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    whole = solved.select(*[c for c in solved.columns if c != "turns"], F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    streamed = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_digests, from_arrow_schema(DIGESTS))
    empty = hashlib.sha256(b"").hexdigest()
    long = summary.join(streamed.hint("merge"), F.expr("conv_id <=> own"), "left").drop("own").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(empty)))
    return whole.unionByName(long)
