"""Mentions, trees, assembled findings, changes, sums and streamed state against plain models on small rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom import streaming
from sparkloom.operators import assembly, changes, hierarchy, incremental, mentions, sums


def test_mentions_are_leftmost_and_longest(spark):
    made = random.Random(3)
    words = list("abcdef")
    docs = [(n, [made.choice(words) for _ in range(made.randint(0, 40))]) for n in range(80)] + [(None, ["a", "b"]), (99, None)]
    phrases = [[made.choice(words) for _ in range(made.randint(1, 4))] for _ in range(14)] + [["a"] * 11, [], ["zz", "a"]]
    known = {tuple(p) for p in phrases if 1 <= len(p) <= 10}
    want = set()
    for n, text in docs:
        at = 0
        while n is not None and text and at < len(text):
            found = next((k for k in range(10, 0, -1) if at + k <= len(text) and tuple(text[at : at + k]) in known), 0)
            if found:
                want.add((n, at, found, " ".join(text[at : at + found])))
            at += found or 1
    got = mentions.mentions(spark.createDataFrame(docs, "doc long, words array<string>"), spark.createDataFrame([(p,) for p in phrases], "words array<string>"), "doc")
    assert {tuple(r) for r in got.collect()} == want


def test_preorder_depths_and_sizes(spark):
    made = random.Random(8)
    rows = [(n, made.randrange(n) if n % 9 and n else None, made.randrange(3)) for n in range(150)] + [(200, 201, 0), (201, 200, 0), (202, 201, 1), (300, 999, 2)]
    below: dict = {}
    ids = {r[0] for r in rows}
    for n, parent, turn in rows:
        below.setdefault(parent if parent in ids else None, []).append((turn, n))
    want, count = {}, 0

    def visit(n, depth):
        nonlocal count
        own, count = count, count + 1
        size = 1 + sum(visit(k, depth + 1) for _, k in sorted(below.get(n, [])))
        want[n] = (depth, size, own)
        return size

    for _, root in sorted(below[None]):
        visit(root, 0)
    got = hierarchy.hierarchy(spark.createDataFrame(rows, "id int, parent int, turn int").repartition(5), ["turn"])
    assert {r["id"]: (r["depth"], r["size"], r["preorder"]) for r in got.collect()} == want
    assert hierarchy.hierarchy(spark.createDataFrame([], "id int, parent int, turn int"), ["turn"]).count() == 0


@pytest.mark.parametrize(("seed", "depth"), [(1, 2), (5, 6)])
def test_call_trees_are_those_of_a_walk(spark, seed, depth):
    made = random.Random(seed)
    calls = {(made.randrange(14), made.randrange(14)): made.choice([0.5, 0.7, 0.9]) for _ in range(40)}
    ahead: dict = {}
    for (a, b), c in calls.items():
        ahead.setdefault(a, []).append((-c, b))
    want = set()
    for entry in (0, 3, 50):
        met, rows = set(), []

        def walk(n, d, met=met, rows=rows, entry=entry):
            rows.append((entry, len(rows), n, d, n in met))
            if n in met:
                return
            met.add(n)
            if d < depth:
                for _, k in sorted(ahead.get(n, [])):
                    walk(k, d + 1)

        walk(entry, 0)
        want |= set(rows)
    edges = spark.createDataFrame([(a, b, c) for (a, b), c in calls.items()], "src int, dst int, confidence double")
    got = hierarchy.call_tree(edges, spark.createDataFrame([(0,), (3,), (50,)], "id int"), depth)
    assert {tuple(r) for r in got.collect()} == want


def test_the_best_signal_speaks_and_all_give_evidence(spark):
    rows = [
        ("a", "late", "x", "heuristic", "high", "critical", [("f", 1), ("g", None)]), ("a", "first", "y", "approved-pattern", "low", "low", [("f", 1), ("h", 2)]), ("a", "other", "y", "approved-pattern", "low", "low", None),
        ("b", "only", None, "strange", None, None, [("h", 2)]), ("c", "alone", "z", "project-pattern", "high", "high", [("q", n) for n in range(20)]),
    ]
    df = spark.createDataFrame(rows, "subject string, title string, text string, basis string, confidence string, attention string, evidence array<struct<path:string,line:int>>")
    got = {r["subject"]: r for r in assembly.assemble(df).collect()}
    a = got["a"]
    assert (a["title"], a["basis"], a["attention"], a["n_signals"], a["bases"], a["more"]) == ("first", "approved-pattern", "critical", 3, ["y", "x"], 0)
    assert [tuple(e) for e in a["evidence"]] == [("f", 1), ("h", 2), ("g", None)]
    assert (got["b"]["bases"], got["b"]["attention"]) == ([], None) and (len(got["c"]["evidence"]), got["c"]["more"]) == (12, 8)
    assert {r["subject"]: r["cluster"] for r in assembly.evidence_clusters(df).collect()} == {"a": "a", "b": "a", "c": "c"}
    assert {r["subject"]: r["cluster"] for r in assembly.evidence_clusters(df, 1).collect()} == {"a": "a", "b": "b", "c": "c"}
    assert assembly.assemble(df.limit(0)).count() == 0


def test_renames_are_each_others_most_alike(spark):
    t = lambda s: list(s)
    before = [("f", "same", "1", t("abc")), ("f", "old", "2", t("abcdefgh")), ("f", "twin", "3", t("abcde")), ("f", "gone", "4", t("xyz")), ("m", "moves", "5", t("q")), ("f", "edit", "6", t("pqr"))]
    after = [("f", "same", "1", t("abc")), ("f", "new", "7", t("abcdefgi")), ("f", "came", "8", t("uvw")), ("n", "moves", "5", t("q")), ("f", "edit", "9", t("pqrs")), ("g", "else", "4", t("xyz"))]
    ddl = "file string, name string, fingerprint string, tokens array<string>"
    got = changes.semantic_changes(spark.createDataFrame(before, ddl), spark.createDataFrame(after, ddl), spark.createDataFrame([("m", "n")], "old_file string, new_file string"))
    assert {tuple(r) for r in got.collect()} == {
        ("f", "RENAMED", "new", "old"), ("f", "DELETED", "twin", None), ("f", "DELETED", "gone", None), ("f", "CREATED", "came", None), ("f", "MODIFIED", "edit", None), ("n", "MOVED", "moves", None), ("g", "CREATED", "else", None),
    }


def test_sums_in_shares_and_percentiles(spark):
    made = random.Random(4)
    rows = [(made.choice(["a", "b", None]), made.randrange(50), made.choice([None, *range(30)])) for _ in range(900)]
    df = spark.createDataFrame([(g, n, v, k) for k, (g, n, v) in enumerate(rows)], "g string, n int, v int, k int").repartition(7)
    got = {r["k"]: r["s"] for r in sums.prefix_sums(df, ["g"], [F.desc("n"), F.col("k")], "n", "s").collect()}
    for g in ("a", "b", None):
        total = 0
        for n, k in sorted((-r[1], k) for k, r in enumerate(rows) if r[0] == g):
            assert got[k] == total
            total -= n
    import numpy as np

    want = {g: float(np.percentile([r[2] for r in rows if r[0] == g and r[2] is not None], 37)) for g in ("a", "b", None)}
    assert {r["g"]: pytest.approx(r["p"]) for r in sums.percentile(df, ["g"], "v", 0.37, "p").collect()} == want
    assert sums.percentile(df, [], "v", 0.5, "p").first()["p"] == float(np.median([r[2] for r in rows if r[2] is not None]))


def test_a_repeated_batch_gives_the_same_versions(spark, tmp_path):
    rows = [("x", n % 3, n, float(n)) for n in range(30)]
    ddl = "kind string, user int, ts int, value double"
    for k in range(3):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], ddl).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    source = lambda: spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/in")
    keys = ["kind", "user"]
    args = (f"{tmp_path}/state", lambda b: incremental.summarise(b, keys, "ts", "value"), lambda a, b: incremental.fold(a, b, keys), f"{tmp_path}/progress")

    def fail(batch):
        if batch == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception):
        streaming.keep_versions(source(), *args, before=fail)
    assert streaming.latest_version(spark, f"{tmp_path}/state") == 0
    streaming.keep_versions(source(), *args)
    assert streaming.latest_version(spark, f"{tmp_path}/state") == 2
    got = {r["user"]: (r["n"], r["total"], r["last"]) for r in streaming.read_version(spark, f"{tmp_path}/state").collect()}
    assert got == {u: (10, float(sum(range(u, 30, 3))), max(range(u, 30, 3))) for u in range(3)}
    assert streaming.read_version(spark, f"{tmp_path}/state", 0).agg(F.sum("n")).first()[0] == 10
    drained = streaming.drain(source(), f"{tmp_path}/drained", "append")
    assert sorted(tuple(r) for r in drained.collect()) == sorted(rows)


def test_a_registry_builds_what_it_must(spark):
    stored = spark.createDataFrame([(1, "c", 5, 1, "a"), (2, "c", 5, 1, "a"), (3, "c", 5, 1, "a"), (4, "old", 5, 1, "a"), (5, "c", 5, 1, "a"), (7, "c", None, 1, "a")], "id int, config string, size int, mtime int, hash string").withColumn("entry", F.concat(F.lit("e"), "id"))
    seen = spark.createDataFrame([(1, 5, 1, "b"), (2, 5, 2, "a"), (3, 6, 2, "b"), (4, 5, 1, "a"), (6, 1, 1, "n"), (7, None, 1, "a")], "id int, size int, mtime int, hash string")
    plan = incremental.registry_plan(stored, seen, "c")
    assert {r["id"]: r["action"] for r in plan.collect()} == {1: "reuse", 2: "recheck", 3: "rebuild", 4: "rebuild", 5: "drop", 6: "build", 7: "recheck"}
    built = spark.createDataFrame([(3, "n3"), (4, "n4"), (6, "n6")], "id int, entry string")
    got = {r["id"]: (r["config"], r["mtime"], r["entry"]) for r in incremental.updated_registry(stored, seen, plan, built, "c").collect()}
    assert got == {1: ("c", 1, "e1"), 2: ("c", 2, "e2"), 3: ("c", 2, "n3"), 4: ("c", 1, "n4"), 6: ("c", 1, "n6"), 7: ("c", 1, "e7")}
