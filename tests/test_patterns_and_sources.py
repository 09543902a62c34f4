"""Pattern operators, file sources and incremental state on hand-made rows."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from sparkloom.functions import patterns
from sparkloom.operators import incremental
from sparkloom.sources import files


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_line_rules_and_their_counts(spark):
    df = spark.createDataFrame([(1, "mail a@b.org\nTODO\r\nTODO x"), (2, None), (3, ""), (4, "copyright 10.0.0.1")], "doc_id long, text string")
    hits = patterns.line_hits(df, "doc_id", patterns.LINE_RULES)
    assert rows_of(hits, "doc_id", "line_no", "rule") == [(1, 1, "email"), (1, 2, "work-marker"), (1, 3, "work-marker"), (4, 1, "ip-address"), (4, 1, "license-word")]
    assert (("work-marker", 2, 1, "1")) in rows_of(patterns.hits_by_rule(hits, "doc_id"), "rule", "n_hits", "n_keys", "first_keys")


def test_secrets_are_reported_by_hash(spark):
    df = spark.createDataFrame([(1, 'x\nAPI_KEY = "abcdef123"'), (2, "token: short"), (3, "tokens: abcdefgh")], "doc_id long, text string")
    want = [(1, 2, "api_key", 9, hashlib.sha256(b"abcdef123").hexdigest()[:16])]
    assert rows_of(patterns.secret_hits(df, "doc_id").where("size > 5 AND kind <> 'token'"), "doc_id", "line_no", "kind", "size", "fingerprint") == want


def test_page_checks_and_titles(spark):
    full = '<html lang="en"><head><title> A </title><meta name="viewport" content="x"><meta name="description"><link rel="canonical"></head><h1>x</h1><img src="a" alt=""><img src="b"></html>'
    df = spark.createDataFrame([(1, full), (2, None), (3, "<title> </title>")], "page_id long, html string")
    found = {r["page_id"]: r for r in patterns.page_checks(df).collect()}
    assert not any(found[1][c] for c in found[1].asDict() if c.startswith("no_")) and found[1]["images_without_alt"] == 1
    assert all(found[2][c] for c in found[2].asDict() if c.startswith("no_")) and found[3]["no_title"]
    assert rows_of(patterns.titles(df), "page_id", "title") == [(1, "A")]
    tag = spark.createDataFrame([('<a HREF="x" class="k" href="y">',)], "t string").select(patterns.attributes(F.col("t")).alias("m")).first()
    assert tag["m"] == {"href": "x", "class": "k"}


def test_stack_frames_of_two_languages(spark):
    text = 'Traceback\n  File "a/b.py", line 3, in f\n    at run (/x/y.js:10:5)\n    at /x/z.js:7:1\nend'
    got = patterns.stack_frames(spark.createDataFrame([(1, text)], "id long, text string"), "id").orderBy("frame_no").collect()
    assert [(r["path"], r["line"], r["col"]) for r in got] == [("a/b.py", 3, None), ("/x/y.js", 10, 5), ("/x/z.js", 7, 1)]


def test_longer_phrases_claim_their_words(spark):
    df = spark.createDataFrame([(["in", "the", "end", "of", "the"],)], "w array<string>")
    hits = df.select(F.explode(patterns.phrase_hits(F.col("w"), {"in": 1, "the": 1, "in the end": 4, "of the": 3})).alias("h")).select("h.*")
    assert rows_of(hits, "start", "phrase") == [(0, "in the end"), (3, "of the")]


def test_repository_scan(spark, tmp_path):
    root = tmp_path / "re.po"
    (root / "src").mkdir(parents=True)
    (root / "tests").mkdir()
    (root / "src" / "a.py").write_text("x = 1\n")
    (root / "tests" / "test_a.py").write_text("assert 1\n")
    (root / "package.json").write_text("{}")
    (root / "b.bin").write_bytes(b"a\0b")
    (root / "big.md").write_text("z" * 2000)
    got = {r["path"]: r for r in files.scan(spark, str(root), max_bytes=1000).collect()}
    assert {k: v["role"] for k, v in got.items()} == {"src/a.py": "source", "tests/test_a.py": "test", "package.json": "manifest", "b.bin": "other", "big.md": "docs"}
    assert got["src/a.py"]["hash"] == hashlib.sha256(b"x = 1\n").hexdigest() and got["src/a.py"]["text"] == "x = 1\n"
    assert (got["b.bin"]["skipped"], got["big.md"]["skipped"], got["big.md"]["text"]) == ("binary", "too-large", None)


def test_coverage_manifests_locks_and_test_logs(spark):
    lcov = spark.createDataFrame([(1, "SF:a.py\nDA:1,0\nDA:2,3\nend_of_record\nSF:b.py\nDA:1,1"), (2, "SF:a.py\nDA:1,5\nDA:x,1")], "report int, text string")
    assert rows_of(files.lcov(lcov), "path", "line", "hits") == [("a.py", 1, 5), ("a.py", 2, 3), ("b.py", 1, 1)]
    manifest = json.dumps({"dependencies": {"x": "^1"}, "devDependencies": {"y": "2"}})
    lock = json.dumps({"packages": {"": {}, "node_modules/x": {"version": "1.0", "license": "MIT"}, "node_modules/x/node_modules/y": {"version": "2.0", "dev": True}}})
    of = lambda text: spark.createDataFrame([("p", text), ("q", "{broken"), ("r", None)], "path string, text string")
    assert rows_of(files.npm_manifest(of(manifest)), "name", "version", "dev") == [("x", "^1", False), ("y", "2", True)]
    assert rows_of(files.npm_lock(of(lock)), "name", "version", "dev", "license", "nested") == [("x", "1.0", False, "MIT", 0), ("y", "2.0", True, None, 1)]
    blocks = 'version = 3\n[[package]]\nname = "a"\nversion = "1"\n\n[[package]]\nname = "b"\nversion = "2"\n'
    assert rows_of(files.block_lock(of(blocks)), "name", "version") == [("a", "1"), ("b", "2")]
    tap = spark.createDataFrame([("r", "TAP version 13\nok 1 - a\nnot ok 2 - b\nok 3 c # SKIP later\n1..3"), ("s", "ok 1 - a\n1..2"), ("t", None)], "run string, text string")
    assert rows_of(files.tap_outcomes(tap).where("run = 'r'"), "number", "name", "outcome") == [(1, "a", "passed"), (2, "b", "failed"), (3, "c", "skipped")]
    assert rows_of(files.tap_complete(tap), "run", "planned", "seen", "complete") == [("r", 3, 3, True), ("s", 2, 1, False), ("t", None, 0, False)]


def test_incremental_state(spark):
    source = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    stored = spark.createDataFrame([("a", "1"), ("b", "old"), ("z", "9")], "path string, hash string")
    assert rows_of(incremental.freshness(stored, source), "path", "state") == [("a", "fresh"), ("b", "stale"), ("c", "missing"), ("z", "gone")]
    assert rows_of(incremental.reusable(stored, source), "path") == [("a",)]
    held = spark.createDataFrame([("a", ["b"]), ("b", []), ("c", ["a"]), ("d", None)], "path string, depends_on array<string>")
    assert rows_of(incremental.invalidated(held, spark.createDataFrame([("b",)], "path string")), "path") == [("a",), ("b",)]
