"""What larger tables and odd texts have shown: results that differed, and disk, shuffles and rounds that grew."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from helpers import SF, assert_same
from pyspark.sql import functions as F

from sparkloom.operators import changes, hierarchy, linking, retrieval
from sparkloom.plans import packing_queries, repository_queries


def test_intents_take_words_between_other_letters(spark):
    import duckdb

    texts = ["\u00e4test te", "test\u00f6", "a\u00fctest", "F\u0130ND it", "fix\u0663", "fix\u0301", "\u00e9fix", "attest", "test_", "why doesn't\u00e9", "stack  trace", "\u212aind of fix", "", None]
    cases = " ".join(f"WHEN regexp_matches(lower(t), '{p.replace(chr(39), chr(39) * 2)}') THEN '{name}'" for name, p in retrieval.INTENTS.items())
    want = [duckdb.execute(f"SELECT CASE {cases} ELSE 'explain' END FROM (SELECT ?::VARCHAR AS t)", [t]).fetchall()[0][0] for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = {r["n"]: r["i"] for r in df.select("n", retrieval.detect_intent(F.col("t")).alias("i")).collect()}
    assert [got[n] for n in range(len(texts))] == want and want[:4] == ["test", "test", "test", "locate"]
    assert [retrieval.intent_of(t) for t in texts if t is not None] == [w for t, w in zip(texts, want, strict=True) if t is not None]


@pytest.mark.parametrize("name", ["import_edges", "name_links"])
def test_linking_goes_in_passes_of_which_only_results_stay(spark, name, monkeypatch):
    monkeypatch.setattr(repository_queries, "PASS_ROWS", 2500)
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    assert_same(repository_queries.QUERIES[name](spark, SF), repository_queries.ORACLES[name], SF)
    left = sorted(p.name.split("-")[0] for p in set(shared.iterdir()) - before)
    assert left == ["pairs", "pass", "pass", "pass"]


def test_files_of_folders_are_counted_before_they_are_joined(spark):
    files = spark.createDataFrame([(f"java/a/b/P{n}.java",) for n in range(40)] + [(f"java/c/b/P{n}.java",) for n in range(30)] + [("go/x/y.go",), ("go/x/z.go",), ("src/p.py",)], "path string")
    refs = spark.createDataFrame([("1", "java", "java/q.java", "b.*"), ("2", "java", "java/q.java", "a.b.*"), ("3", "go", "go/m.go", "e.org/x"), ("4", "python", "src/q.py", "./.p"), ("5", "python", "src/q.py", "p"), ("6", "python", "src/q.py", "no")], "ref_id string, language string, path string, spec string")
    resolved = linking.resolve_imports(refs, files, spark.createDataFrame([("e.org", "go")], "module string, folder string"))
    want = {tuple(r) for r in linking.imported_files(resolved, files).groupBy("ref_id").agg(F.count("*"), F.min("path")).collect()}
    assert {tuple(r) for r in linking.counted_files(resolved, files).collect()} == want and ("1", 70, "java/a/b/P0.java") in want


def test_renames_of_many_copies_compare_a_set_once(spark, monkeypatch):
    monkeypatch.setattr(changes, "PASS_SHARED", 100)
    made = random.Random(6)
    base = [[f"w{made.randrange(60)}" for _ in range(made.randint(0, 14))] for _ in range(25)]
    near = lambda t: [*t[: made.randint(len(t) // 2, len(t))], *[f"w{made.randrange(60)}" for _ in range(made.randrange(3))]]
    gone = [(made.choice("fg"), f"o{n:03}", near(made.choice(base))) for n in range(90)] + [("h", f"o{n}", ["x", "y", "z"]) for n in range(40)]
    come = [(made.choice("fg"), f"n{n:03}", near(made.choice(base))) for n in range(90)] + [("h", f"n{n}", ["z", "y", "x", "x"]) for n in range(40)]
    alike = {}
    for f, o, x in gone:
        for g, n, y in come:
            if f == g and x and y and (s := round(len(set(x) & set(y)) / len(set(x) | set(y)), 6)) >= 0.6:
                alike[f, o, n] = s
    want = {(f, o, n, s) for (f, o, n), s in alike.items() if n == min((-t, m) for (g, p, m), t in alike.items() if (g, p) == (f, o))[1] and o == min((-t, p) for (g, p, m), t in alike.items() if (g, m) == (f, n))[1]}
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    got = changes.matched_renames(*[spark.createDataFrame(rows, "file string, name string, tokens array<string>") for rows in (gone, come)])
    assert {tuple(r) for r in got.collect()} == want and len(want) > 10
    compared = next(p for p in set(shared.iterdir()) - before if p.name.startswith("alike-"))
    assert spark.read.parquet(str(compared)).where("file = 'h'").count() == 1


def test_questions_go_in_passes_over_postings(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PASS_TERMS", 20)
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    assert_same(packing_queries.QUERIES["context_packets"](spark, SF), packing_queries.ORACLES["context_packets"], SF)
    assert sum(p.name.startswith("best-") for p in set(shared.iterdir()) - before) > 2


@pytest.mark.parametrize("terms", [1, 40])
def test_covers_go_in_passes_and_keep_few_of_those_alike(spark, monkeypatch, terms):
    monkeypatch.setattr(retrieval, "PASS_TERMS", terms * 10)
    assert_same(packing_queries.cover_picks(spark, SF), packing_queries.ORACLES["cover_picks"], SF)
    covers = packing_queries._covers(spark, SF, 0.15, 7)
    alike = covers.groupBy("task", "candidate", "score").agg(F.array_sort(F.collect_list("need")).alias("needs")).groupBy("task", "needs", "score").agg(F.count("*").alias("n"))
    assert alike.agg(F.max("n")).first()[0] == 7


def test_long_calls_are_walked_by_rows_with_the_same_tree(spark, monkeypatch):
    made = random.Random(9)
    edges = spark.createDataFrame([(made.randrange(30), made.randrange(30), made.choice([0.5, 0.9, None])) for _ in range(90)], "src int, dst int, confidence double")
    entries = spark.createDataFrame([(0,), (1,), (77,), (1,)], "id int")
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    want = {tuple(r) for r in hierarchy.call_tree(edges, entries, 4).collect()}
    assert not any(p.name.startswith(("visits-", "entered-")) for p in set(shared.iterdir()) - before)  # no rounds over visits
    monkeypatch.setattr(hierarchy, "WALKED", 20)
    assert {tuple(r) for r in hierarchy.call_tree(edges, entries, 4).collect()} == want and (77, 0, 77, 0, False) in want
