"""Line dedup, MinHash near-dedup and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from llm.fixtures import DOCS, components_of, near_copies, prose, vocabulary

from sparkloom.llm import line_dedup, minhash
from sparkloom.llm.common import connected_components

WORDS = 12


def passages(seed: int = 3) -> list[tuple]:
    """Texts of lines, with passages that stand in several, some extended by what their neighbours don't have."""
    made = random.Random(seed)
    words = vocabulary(seed)
    line = lambda: " ".join(prose(made, words, made.randint(1, 6)))
    shared = [[line() for _ in range(made.randint(3, 9))] for _ in range(4)] + [[" ".join(prose(made, words, 20))]]
    rows = []
    for n in range(30):
        lines = []
        for _ in range(made.randint(1, 5)):
            lines += made.choice(shared) if made.random() < 0.5 else [line() for _ in range(made.randint(1, 4))]
            if made.random() < 0.3:
                lines.append("")
        rows.append((n, "\n".join(lines), "en", "s", 0))
    return [*rows, (30, None, None, None, None), (31, "", "en", "s", 0), (None, rows[0][1], "en", "s", 0)]


def cut_by_hand(rows: list[tuple], min_words: int) -> dict[int, str]:
    """Every window of lines as the tuple of its lines; the first place of each, by (doc_id, line), stays."""
    seen: set = set()
    out = {}
    for doc_id, text in sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None):
        lines = text.split("\n")
        counted = [(n, " ".join(x.split())) for n, x in enumerate(lines) if x.split()]
        drop: set[int] = set()
        for a in range(len(counted)):
            total = 0
            for b in range(a, len(counted)):
                total += len(counted[b][1].split())
                if total >= min_words:
                    key = tuple(x for _, x in counted[a : b + 1])
                    if key in seen:
                        drop |= {n for n, _ in counted[a : b + 1]}
                    seen.add(key)
                    break
        out[doc_id] = "\n".join(x for n, x in enumerate(lines) if n not in drop)
    return out


def test_line_dedup_is_what_brute_force_cuts(spark):
    rows = passages()
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3), WORDS).collect()
    want = cut_by_hand(rows, WORDS)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] is not None and r["text"] is not None} == want
    assert any(r["lines_deleted"] for r in got)
    whole = {r[0]: r[1] for r in rows}
    for r in got:
        if r["doc_id"] is None or r["text"] is None:
            assert (r["lines_deleted"], r["words_deleted"], r["runs_deleted"]) == (0, 0, 0)
        else:
            assert len(whole[r["doc_id"]].split()) - len(r["text"].split()) == r["words_deleted"]


def test_line_dedup_keeps_other_columns_and_takes_empty_tables(spark):
    schema = "doc_id int, text string, row struct<starts:int>, starts string, own_key int, lines_deleted string"
    text = " ".join(["word"] * 15)
    rows = [(1, text, (1,), "a", 7, "x"), (2, text, None, None, 8, "y"), (2, text, None, None, 8, "y"), (3, "other " + text, None, "b", 9, None)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(line_dedup.dedup_lines(df, WORDS).collect(), key=lambda r: (r["doc_id"], r["text"]))
    assert [(r["doc_id"], r["own_key"], r["starts"], r["lines_deleted"]) for r in got] == [(1, 7, "a", 0), (2, 8, None, 1), (2, 8, None, 1), (3, 9, "b", 0)]
    assert got[0]["row"]["starts"] == 1 and [r["text"] for r in got[1:3]] == ["", ""]
    assert line_dedup.dedup_lines(df.limit(0), WORDS).count() == 0


def test_fingerprints_are_the_rightmost_minima_of_their_windows():
    made = np.random.default_rng(1)
    hashes, sizes = made.integers(0, 9, 200).astype(np.uint64), made.integers(1, 6, 200)
    first, last = line_dedup.windows(sizes, 11)
    for a, b, k in zip(first, last, line_dedup.fingerprints(hashes, first, last), strict=True):
        assert sizes[a : b + 1].sum() >= 11 > sizes[a:b].sum()
        assert k == max(i for i in range(a, b + 1) if hashes[i] == hashes[a : b + 1].min())


def shingle_set(text: str | None, size: int) -> set:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < size else {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def near_by_hand(rows: list[tuple], size: int) -> dict[int, tuple[int, int]]:
    sets = {r[0]: shingle_set(r[1], size) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[b]]
    found = components_of(sets, links)
    return {n: (len(s), found[n]) for n, s in sets.items()}


@pytest.mark.parametrize("size", [4, 5])
def test_minhash_components_are_those_of_brute_force(spark, size):
    rows = near_copies(size)
    got = minhash.components(spark.createDataFrame(rows, DOCS).repartition(3), size).collect()
    want = near_by_hand(rows, size)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert 1 < len({c for _, c in want.values()}) < len(rows)


def test_minhash_handles_repeated_rows_nulls_clashes_and_nothing(spark):
    text = "a b c d e f g h"
    schema = "doc_id long, text string, gone_id string, row string"
    rows = [(4, text, "x", "p"), (4, text, "x", "p"), (2, text.upper(), None, "q"), (None, text, "n", None), (9, None, None, None), (8, "", "e", None)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.components(df).collect()), key=str)
    assert got == sorted([(4, 5, 2), (4, 5, 2), (2, 5, 2), (None, 5, None), (9, 0, 9), (8, 0, 8)], key=str)
    kept = minhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), r["row"]) for r in kept.collect()) == [("2", "q"), ("8", None), ("9", None), ("None", None)]
    assert minhash.components(df.limit(0)).count() == 0


def test_packed_signatures_estimate_similarity():
    made = np.random.default_rng(4)
    pool = made.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[200:2200]  # 1800 of 2200
    x, y = (np.array(minhash.pack(minhash.minima(v))).reshape(minhash.BITS, minhash.WORDS) for v in (a, b))
    differ = np.unpackbits(np.bitwise_or.reduce(x ^ y, axis=0).view(np.uint8)).sum()
    chance = 1 / 2**minhash.BITS
    estimate = 1 - differ / minhash.PERMUTATIONS / (1 - chance)
    assert abs(estimate - 1800 / 2200) < minhash.SLACK


def test_components_of_chains_stars_and_loops(spark):
    made = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    edges += [(made.randint(300, 340), made.randint(300, 340)) for _ in range(30)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components_of({n for e in real for n in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmaps_never_rule_out_a_pair_at_the_threshold(spark):
    made = np.random.default_rng(5)
    rows = []
    for n in (1, 5, 40, 300, 5000):
        for share in (0.5, 0.85, 0.89, 0.95, 1.0):
            pool = made.integers(0, 2**63, 2 * n).astype(np.uint64)
            both = int(n * share)
            a, b = set(pool[:n].tolist()), set(pool[n - both : 2 * n - both].tolist())
            held = [minhash.marks(np.array(sorted(v), dtype=np.uint64)) for v in (a, b)]
            rows.append((*held, len(a), len(b), 100 * len(a & b) >= 80 * len(a | b)))
    df = spark.createDataFrame(rows, "ma array<long>, mb array<long>, na long, nb long, near boolean")
    judged = [(r["near"], r["may"]) for r in df.selectExpr("near", f"{minhash.may_meet('ma', 'mb', 'na', 'nb', 0.8)} AS may").collect()]
    assert all(may for near, may in judged if near) and any(near for near, _ in judged)
    assert sum(not may for _, may in judged) >= 3


def cut_maximal_runs(rows: list[tuple], min_words: int) -> dict[int, str]:
    """Every pair of places: their common run, as long as it goes, is cut from the later one if it has min_words words."""
    texts = sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None)
    counted = {d: [(n, " ".join(x.split())) for n, x in enumerate(t.split("\n")) if x.split()] for d, t in texts}
    places = [(d, k) for d, _ in texts for k in range(len(counted[d]))]
    drop: dict[int, set[int]] = {d: set() for d, _ in texts}
    for i, (d, a) in enumerate(places):
        for e, b in places[i + 1 :]:
            if counted[d][a][1] != counted[e][b][1] or a and b and counted[d][a - 1][1] == counted[e][b - 1][1]:
                continue
            n = 0
            while a + n < len(counted[d]) and b + n < len(counted[e]) and counted[d][a + n][1] == counted[e][b + n][1]:
                n += 1
            run = counted[e][b : b + n]
            if sum(len(x.split()) for _, x in run) >= min_words:
                drop[e] |= {k for k, _ in run}
    return {d: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop[d]) for d, t in texts}


def test_line_dedup_cuts_repeated_runs_from_their_first_line_to_their_last(spark):
    rows = [*passages(), *[(n, "\n".join([" ".join(["long"] * 14), "and a tail", "of two lines"]), "en", "s", 0) for n in (40, 41, 42)]]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3), WORDS).collect() if r["text"] is not None}
    want = cut_maximal_runs(rows, WORDS)
    assert {d: t for d, t in got.items() if d is not None} == want
    assert want[40] == rows[-3][1] and want[41] == want[42] == ""


def test_short_tails_and_very_long_texts_go_with_their_runs(spark, monkeypatch):
    block = "\n".join(" ".join([f"{c}{k}" for k in range(n)]) for c, n in (("a", 30), ("b", 30), ("c", 5)))
    long = "\n".join(f"line {k} of a very long text" for k in range(60_000))
    rows = [(1, block, "en", "s", 0), (2, "other first\n" + block, "en", "s", 0), (3, long, "en", "s", 0), (4, "x\n" + long + "\ny", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: (r["text"], r["lines_deleted"], r["runs_deleted"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: (block, 0, 0), 2: ("other first", 3, 1), 3: (long, 0, 0), 4: ("x\ny", 60_000, 1)}
    # matches come from joined fingerprints alone
    found = line_dedup.shared_positions
    monkeypatch.setattr(line_dedup, "shared_positions", lambda texts: found(texts).limit(0))
    assert {r["lines_deleted"] for r in line_dedup.dedup_lines(df).collect()} == {0}


def test_sets_of_one_doc_id_are_all_searched(spark):
    text = [f"w{k}" for k in range(60)]
    other = [f"v{k}" for k in range(60)]
    near = lambda words, k: " ".join([*words[:k], "changed", *words[k + 1 :]])
    rows = [(1, " ".join(text)), (1, " ".join(other)), (2, near(text, 59)), (3, near(other, 0)), (4, " ".join(other))]
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1)]


def test_members_of_a_bucket_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 3)
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 1)
    made = random.Random(21)
    words = vocabulary(21)
    base = prose(made, words, 80)
    texts = []
    for _ in range(40):  # near copies of one text, many of them too far from the first
        copy = list(base)
        for _ in range(made.randint(0, 4)):
            copy[made.randrange(80)] = made.choice(words)
        texts.append(" ".join(copy))
    rows = [(n, t) for n, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_by_hand(rows, 4)
