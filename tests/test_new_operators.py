"""Linking, packing, covers, flows and clustering on small hand-made rows and against plain models."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import clustering, flows, linking, packing, reports, routing


def test_imports_of_each_language(spark):
    files = ["src/app/__init__.py", "src/app/core.py", "app/util.py", "src/app/deep/x.py", "g/api/a.go", "g/api/a_test.go", "g/api/v2/b.go", "rs/src/lib.rs", "rs/src/net.rs", "rs/src/net/tcp/mod.rs", "rs/src/io/mod.rs", "j/main/a/b/C.java", "j/test/a/b/C.java", "j/main/a/b/D.java"]
    cases = {
        ("python", "src/app/core.py", "app.core"): ("file", "src/app/core.py", 1),
        ("python", "src/app/core.py", "app.util"): ("file", "app/util.py", 1),
        ("python", "src/app/core.py", "."): ("file", "src/app/__init__.py", 1),
        ("python", "src/app/deep/x.py", "..core"): ("file", "src/app/core.py", 1),
        ("python", "src/app/deep/x.py", "...."): ("missing", None, 0),
        ("python", "src/app/core.py", ".gone"): ("missing", None, 0),
        ("python", "src/app/core.py", "numpy.linalg"): ("external", "numpy", 0),
        ("go", "g/m.go", "x.org/m/api"): ("folder", "g/api", 1),
        ("go", "g/m.go", "x.org/m/api/v2"): ("folder", "g/api/v2", 1),
        ("go", "g/m.go", "x.org/m/none"): ("missing", None, 0),
        ("go", "g/m.go", "fmt"): ("external", "fmt", 0),
        ("rust", "rs/src/lib.rs", "mod:net"): ("file", "rs/src/net.rs", 1),
        ("rust", "rs/src/net.rs", "mod:tcp"): ("file", "rs/src/net/tcp/mod.rs", 1),
        ("rust", "rs/src/net.rs", "crate::net::tcp::Stream"): ("file", "rs/src/net/tcp/mod.rs", 1),
        ("rust", "rs/src/net/tcp/mod.rs", "super::super::x"): ("missing", None, 0),
        ("rust", "rs/src/net.rs", "self::io"): ("file", "rs/src/io/mod.rs", 1),
        ("rust", "rs/src/net.rs", "serde::de"): ("external", "serde", 0),
        ("java", "j/main/X.java", "a.b.D"): ("file", "j/main/a/b/D.java", 1),
        ("java", "j/main/X.java", "a.b.C"): ("ambiguous", None, 0),
        ("java", "j/main/X.java", "a.b.*"): ("folder", "j/main/a/b", 3),
        ("java", "j/main/X.java", "org.slf4j.Logger"): ("external", "org.slf4j", 0),
        (None, "a", "b"): ("missing", None, 0),
        ("python", None, None): ("missing", None, 0),
    }
    refs = spark.createDataFrame([(n, *key) for n, key in enumerate(cases)], "ref_id int, language string, path string, spec string")
    roots = spark.createDataFrame([("x.org/m", "g"), ("x.org/m/api/v2", "g/api/v2")], "module string, folder string")
    known = spark.createDataFrame([(f,) for f in files], "path string")
    found = linking.resolve_imports(refs, known, roots)
    got = {r["ref_id"]: (r["status"], r["target"], r["n_files"]) for r in found.collect()}
    assert got == dict(enumerate(cases.values()))
    reached = {(r["ref_id"], r["path"]) for r in linking.imported_files(found, known).collect()}
    wild = list(cases).index(("java", "j/main/X.java", "a.b.*"))
    assert {p for n, p in reached if n == wild} == {f for f in files if f.startswith("j/")}
    assert linking.resolve_imports(refs.limit(0), known, roots).count() == 0


@pytest.mark.parametrize("path", ["a/../../b", "./a//b/", "..", "a/..", "/x/./y", "a/b/../c"])
def test_normalized_paths(spark, path):
    import posixpath

    got = spark.range(1).select(linking.normalized(F.lit(path))).first()[0]
    assert got == posixpath.normpath(path).lstrip("/")


def _packed(items, budget):
    """The passes by a plain loop."""
    used = spent = 0
    levels = [-1] * len(items)
    for group, name, share in packing.PASSES:
        level = packing.LEVELS.index(name)
        for n, (anchor, most, costs) in enumerate(items):
            if group != "all" and (group == "anchors") != anchor:
                continue
            if level > most or level <= levels[n] or (level and levels[n] < 0) or costs[level] is None:
                continue
            more = costs[level] - (costs[levels[n]] if levels[n] >= 0 else 0)
            if used + more <= budget and (not anchor or spent + more <= budget * share):
                used, spent, levels[n] = used + more, spent + more * anchor, level
    return used, spent, levels


def test_packing_in_passes_is_that_of_a_loop(spark):
    made = random.Random(2)
    rows = []
    for n in range(120):
        items = [(made.random() < 0.3, made.randint(1, 4), sorted(made.randint(1, 300) for _ in range(5))) for _ in range(made.randint(0, 12))]
        items = [(a, m, [None if k and made.random() < 0.1 and k > m else c for k, c in enumerate(cs)]) for a, m, cs in items]
        rows.append((n, items, made.choice([0, 50, 400, 1500])))
    df = spark.createDataFrame(rows, "n int, items array<struct<is_anchor:boolean,most:int,costs:array<int>>>, budget long")
    for r in df.select("n", packing.raised(F.col("items"), F.col("budget")).alias("r")).collect():
        assert (r["r"]["used"], r["r"]["anchors"], list(r["r"]["levels"])) == _packed(*rows[r["n"]][1:]), rows[r["n"]]


def test_levels_are_lowered_from_the_last_and_refilled_from_the_first(spark):
    option = lambda *x: [{"level": f"l{k}", "tokens": t} for k, t in enumerate(x)]
    rows = [([(option(100, 50, 10), 200), (option(80, 20), None), (option(30), 90)], 175), ([(option(100), None)], 50), ([(option(40, 10), 100), (option(40, 10), 100)], 110), ([], 10)]
    df = spark.createDataFrame(rows, "items array<struct<options:array<struct<level:string,tokens:int>>,elastic:int>>, budget long")
    got = [(r["f"]["used"], r["f"]["levels"], r["f"]["tokens"]) for r in df.coalesce(1).select(packing.fit_levels(F.col("items"), F.col("budget")).alias("f")).collect()]
    assert got == [(175, ["l0", "l1", None], [155, 20, 0]), (0, [None], [0]), (110, ["l0", "l0"], [70, 40]), (0, [], [])]


def _cover(covers, conflicts, picks, least, by):
    out = []
    for task in {c[0] for c in covers}:
        offers: dict = {}
        for t, cand, score, need, weight in covers:
            if t == task and score >= least:
                held = offers.setdefault(cand, [score, {}])
                held[0] = max(held[0], score)
                held[1][need] = max(weight, held[1].get(need, weight))
        done: set = set()
        for pick in range(1, picks + 1):
            gains = []
            for cand, (score, needs) in offers.items():
                left = {n: w for n, w in needs.items() if n not in done}
                if left:
                    gain = round(sum(left.values()), 6)
                    gains.append(((-gain, -score, cand) if by == "gain" else (-score, -gain, cand), cand, gain, len(left)))
            if not gains:
                break
            _, cand, gain, n = min(gains)
            out.append((task, pick, cand, gain, n))
            done |= set(offers.pop(cand)[1])
            for a, b in conflicts:
                if cand in (a, b):
                    offers.pop(a if b == cand else b, None)
    return sorted(out)


@pytest.mark.parametrize("by", ["gain", "score"])
def test_greedy_cover_is_that_of_a_loop(spark, by):
    made = random.Random(6)
    covers = [(f"t{made.randrange(9)}", made.randrange(12), made.randrange(11) / 10, f"n{made.randrange(7)}", made.randrange(1, 9) / 4) for _ in range(400)]
    conflicts = [(made.randrange(12), made.randrange(12)) for _ in range(6)]
    df = spark.createDataFrame(covers, "task string, candidate int, score double, need string, weight double")
    got = routing.greedy_cover(df, spark.createDataFrame(conflicts, "a int, b int"), max_picks=3, min_score=0.2, by=by)
    assert sorted(tuple(r) for r in got.select("task", "pick", "candidate", "gain", "n_needs").collect()) == _cover(covers, conflicts, 3, 0.2, by)
    assert routing.greedy_cover(df.limit(0)).count() == 0


def test_flows_and_their_ways(spark):
    calls = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4), (4, 1), (4, 5), (5, 5), (6, 7), (None, 3)], "caller int, callee int")
    sources = spark.createDataFrame([(1, "web"), (6, "web"), (2, "env")], "function int, source string")
    sinks = spark.createDataFrame([(5, "sql", 9), (3, "sql", 9), (7, "html", 1)], "function int, sink string, line int")
    cleaners = spark.createDataFrame([(4, "env"), (7, "web")], "function int, source string")
    found = flows.flows(calls, sources, sinks, cleaners)
    assert sorted(tuple(r) for r in found.collect()) == [("env", "sql", 9, 3, 1), ("web", "sql", 9, 3, 2)]
    reached = flows.spread(sources.toDF("node", "label"), calls.toDF("src", "dst"), cleaners.toDF("node", "label"))
    ways = sorted(tuple(r) for r in flows.witnesses(found, reached).collect())
    assert ways == [("env", "sql", 9, 0, 2), ("env", "sql", 9, 1, 3), ("web", "sql", 9, 0, 1), ("web", "sql", 9, 1, 2), ("web", "sql", 9, 2, 3)]


def test_names_come_from_the_nearest_scope(spark):
    entries = spark.createDataFrame([("", "a"), ("", "b"), ("a", "b"), ("a/b", "c"), ("", "c"), ("b", "d")], "scope string, name string")
    requires = spark.createDataFrame([("", "a"), ("a", "b"), ("a/b", "c"), ("a/b/c", "d"), ("a/b", "a"), ("b", "c")], "path string, name string")
    got = {(r["path"], r["name"]): r["target"] for r in flows.scoped_targets(entries, requires).collect()}
    assert got == {("", "a"): "a", ("a", "b"): "a/b", ("a/b", "c"): "a/b/c", ("a/b/c", "d"): None, ("a/b", "a"): "a", ("b", "c"): "c"}
    assert {(r["path"], r["depth"]) for r in flows.scoped_depths(entries, requires).collect()} == {("a", 1), ("a/b", 2), ("a/b/c", 3)}


def _clustered(modules, links, most, share):
    """Folders, then mutual best pairs in rounds, by plain loops."""
    groups = {m: (f, s) for m, f, s, _ in modules}
    placed = {m: m for m in groups}
    cap = max(8, math.ceil(sum(s for _, s in groups.values()) / most * share))
    anchors = [f.split("/") for f, _ in groups.values()]
    common = 0
    while all(len(a) > common and a[common] == anchors[0][common] for a in anchors):
        common += 1
    for depth in range(max(map(len, anchors)), common, -1):
        if len(groups) <= most:
            break
        folders: dict = {}
        for g, (f, _) in groups.items():
            if len(f.split("/")) >= depth:
                folders.setdefault("/".join(f.split("/")[:depth]), []).append(g)
        for into, members in sorted(((i, m) for i, m in folders.items() if len(m) > 1 and sum(groups[g][1] for g in m) <= cap), key=lambda x: (sum(groups[g][1] for g in x[1]), x[0])):
            if len(groups) <= most:
                break
            size = sum(groups.pop(g)[1] for g in members)
            groups[into] = (into, size)
            placed = {m: into if c in members else c for m, c in placed.items()}
    roles: dict = {}
    for m, _, _, r in modules:
        roles.setdefault(placed[m], set()).add(r)
    role = {g: next(iter(r - {None})) if len(r - {None}) == 1 else None for g, r in roles.items()}
    size = {g: s for g, (_, s) in groups.items()}
    weight: Counter = Counter()
    for a, b, w in links:
        x, y = sorted((placed[a], placed[b]))
        if x != y:
            weight[x, y] += w
    while len(size) > most:
        degree: Counter = Counter()
        for (a, b), w in weight.items():
            degree[a] += w
            degree[b] += w
        best: dict = {}
        for (a, b), w in weight.items():
            if size[a] + size[b] <= cap and (role[a] == role[b] or role[a] is None or role[b] is None):
                key = (-round(w / math.sqrt(degree[a] * degree[b]), 9), a, b)
                for g in (a, b):
                    best[g] = min(best.get(g, key), key)
        pairs = sorted({k for k in best.values() if best[k[1]] == k == best[k[2]]})[: len(size) - most]
        if not pairs:
            break
        for _, a, b in pairs:
            kept, gone = (b, a) if size[b] > size[a] else (a, b)
            size[kept] += size.pop(gone)
            role[kept] = max([r for r in (role[a], role[b]) if r is not None], default=None)
            placed = {m: kept if c == gone else c for m, c in placed.items()}
            moved: Counter = Counter()
            for (x, y), w in weight.items():
                x, y = sorted((kept if x == gone else x, kept if y == gone else y))
                if x != y:
                    moved[x, y] += w
            weight = moved
    return placed


@pytest.mark.parametrize(("seed", "most"), [(1, 4), (2, 9), (3, 40)])
def test_components_are_those_of_a_plain_model(spark, seed, most):
    made = random.Random(seed)
    folders = [f"src/{a}/{b}" for a in "abc" for b in "xyz"] + ["src/d", "src/d/deep/er"]
    modules = [(f"{made.choice(folders)}/m{k}", "", made.randint(1, 5), made.choice([None, None, None, "api", "db"])) for k in range(45)]
    modules = [(m, m.rpartition("/")[0], s, r) for m, _, s, r in modules]
    links = [(made.choice(modules)[0], made.choice(modules)[0], made.randint(1, 9)) for _ in range(160)]
    df = spark.createDataFrame(modules, "module string, folder string, size int, role string")
    got = clustering.cluster_modules(df, spark.createDataFrame(links, "a string, b string, weight int"), most)
    assert {r["module"]: r["component"] for r in got.collect()} == _clustered(modules, links, most, 2.5)


def test_set_digest_hashes_the_sorted_hashes_of_each_bucket(spark):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    rows = [(f"p{k}", f"h{k % 7}") for k in range(900)] + [("p", "copy")] * 9000 + [("p1", "h1")]
    buckets = {}
    for h in sorted(sha("\0".join(r)) for r in rows):
        buckets.setdefault(h[:2], []).append(h)
    want = (sha("".join(sorted(sha("".join(b)) for b in buckets.values()))), len(buckets), len(rows))
    df = spark.createDataFrame(rows, "path string, hash string")
    columns = ("digest", "buckets", "n")
    assert [tuple(r) for r in reports.set_digest(df, "path", "hash").select(*columns).collect()] == [want]
    assert [tuple(r) for r in reports.set_digest(df.orderBy("hash", "path").coalesce(1), "path", "hash").select(*columns).collect()] == [want]
    assert [tuple(r) for r in reports.set_digest(df.limit(0), "path", "hash").select(*columns).collect()] == [(None, 0, 0)]


def test_names_may_be_spoken_as_words(spark):
    from sparkloom.operators import retrieval

    assert retrieval.spoken_names("the xml parser") == ["thexml", "xmlparser", "thexmlparser"]
    nodes = spark.createDataFrame([(n, "class", name, False, True) for n, name in enumerate(["SessionStore", "session", "XmlParserPool", "xml_parser"])], "id int, kind string, name string, is_test boolean, exported boolean")
    edges = spark.createDataFrame([], "kind string, src int, dst int, confidence double")
    fields = {"name": (F.array(F.lower("name")), 1.0)}
    found = {r["id"]: r["symbol"] for r in retrieval.retrieve(nodes, edges, fields, "where is the session store").collect()}
    assert found[0] == 0.9 and found[1] <= retrieval.PLAIN_WORD_CAP
    found = {r["id"]: r["symbol"] for r in retrieval.retrieve(nodes, edges, fields, "fix the xml parser").collect()}
    assert found[3] == 0.9 and found[2] == 0.25
