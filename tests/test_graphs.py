"""Graph operators on hand-made graphs against plain Python."""

from __future__ import annotations

import random

from sparkloom.operators import graph

EDGES = "src long, dst long"


def strong_by_hand(edges):
    nodes = {n for e in edges for n in e}
    reach = {}
    for n in nodes:
        seen, front = {n}, [n]
        while front:
            front = [b for a, b in edges if a in front and b not in seen and not seen.add(b)]
        reach[n] = seen
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


def test_strong_components_are_those_of_plain_search(spark):
    made = random.Random(4)
    edges = [(made.randrange(30), made.randrange(30)) for _ in range(45)] + [(50, 50), (60, 61)]
    got = {r["id"]: r["component"] for r in graph.strong_components(spark.createDataFrame(edges, EDGES)).collect()}
    assert got == strong_by_hand(edges)
    assert graph.strong_components(spark.createDataFrame([], EDGES)).count() == 0


def test_long_cycles_and_paths_have_components_and_layers(spark):
    n = 1000
    cycle = [(k, (k + 1) % n) for k in range(n)]
    path = [(2000 + k + 1, 2000 + k) for k in range(n)] + [(2000, 5)]  # a way down into the cycle
    df = spark.createDataFrame(cycle + path, EDGES)
    got = {r["id"]: (r["layer"], r["component"], r["in_cycle"]) for r in graph.dependency_order(df).collect()}
    assert {got[k] for k in range(n)} == {(0, 0, True)}
    assert all(got[2000 + k] == (k + 1, 2000 + k, False) for k in range(n + 1))


def test_layers_of_branching_graphs_are_longest_ways(spark):
    made = random.Random(6)
    edges = [(a, b) for a in range(25) for b in range(a) if made.random() < 0.12]
    depth = {}
    for n in range(25):
        depth[n] = max((depth[b] + 1 for a, b in edges if a == n), default=0)
    got = {r["id"]: r["layer"] for r in graph.layers(spark.createDataFrame(edges, EDGES)).collect()}
    assert got == {n: depth[n] for n in {x for e in edges for x in e}}


def test_cycle_paths_lead_back(spark):
    edges = [(1, 2), (2, 3), (3, 1), (2, 1), (7, 8), (8, 9), (9, 7), (3, 7), (4, 1)]
    got = {r["component"]: r["path"] for r in graph.cycle_paths(spark.createDataFrame(edges, EDGES)).collect()}
    assert got == {1: [1, 2, 1], 7: [7, 8, 9, 7]}


def test_renames_lead_to_their_first_name_or_round_in_circles(spark):
    pairs = [("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "x")]
    got = {r["name"]: (r["origin"], r["steps"]) for r in graph.lineage(spark.createDataFrame(pairs, "new string, old string")).collect()}
    assert got == {"b": ("a", 1), "c": ("a", 2), "d": ("a", 3), "x": (None, None), "y": (None, None), "z": (None, None)}


def test_walks_stop_at_their_limit(spark):
    edges = spark.createDataFrame([("hub", f"n{k:03d}", 1 - k / 1000) for k in range(100)] + [("n000", "far", 0.5)], "src string, dst string, confidence double").selectExpr("*", "'e' kind")
    got = [r["id"] for r in graph.walk(edges, spark.createDataFrame([("hub",)], "id string"), 2, 60).orderBy("depth", "id").collect()]
    assert got == [f"n{k:03d}" for k in range(60)]
