"""License scans, URL filters, WARC, decontamination, mixing and the registered queries."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import SF, SF_ORACLE, assert_same
from llm.fixtures import DOCS, prose, vocabulary
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import common, decontaminate, language, license_scan, mixing, registry, url_filter, warc
from sparkloom.llm.common import new_path


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    assert_same(registry.queries()[name](spark, SF_ORACLE), registry.oracle_sql()[name], SF_ORACLE)


def test_license_scan_finds_places_and_notices(spark):
    rows = [
        (1, "CC BY cc.by ccby\ngeneral public\nlicense", None),
        (2, "This work is licensed under the GNU General Public License, version 3!", "x"),
        (3, None, None),
        (4, "", None),
        (5, "all rights all rights reserved " * 3, None),
        (5, "Released under the MIT License", None),
        (None, "ALL RIGHTS RESERVED", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, held string").withColumn("label", F.lit(1))
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in license_scan.scan(df).collect()), key=str)
    assert (1, 8, 3, 0, 5, "cc-by,gpl", "cc-by,gpl") in got
    assert (3, 0, 0, None, None, "", "") in got and (4, 0, 0, None, None, "", "") in got
    assert next(x for x in got if x[0] == 2)[5:] == ("gpl", "gpl,gpl-notice")
    assert sorted(x[2] for x in got if x[0] == 5) == [0, 3]
    assert next(x for x in got if x[0] is None)[2:6] == (1, 0, 0, "reserved")
    assert license_scan.scan(df.limit(0)).count() == 0


def test_license_pairs_are_those_of_brute_force(spark):
    made = random.Random(9)
    words = vocabulary(9, 30)
    templates = {f"t{k}": " ".join(made.sample(words, made.randint(1, 20))) for k in range(14)}
    rows = [(n, "\n".join(" ".join(prose(made, words, made.randint(0, 20))) for _ in range(5))) for n in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = license_scan.token_order(df, sorted({w for t in templates.values() for w in t.split()}))
    ranked = license_scan.ranked_templates(templates, order, 0.6)
    blocked = df.select("doc_id", F.explode(license_scan.blocks(license_scan.words(F.col("text")), order, ranked)).alias("b")).select("doc_id", "b.*")
    got = {(r["doc_id"], r["block"], r["label"], r["shared"]) for r in license_scan.containment_join(blocked, ranked).collect()}
    want = set()
    for n, text in rows:
        held = text.split()
        for label, t in templates.items():
            own, c = set(t.split()), license_scan.length_class(t)
            for k in range(0, -(-len(held) // c)):
                shared = len(own & set(held[k * c : k * c + 2 * c]))
                if shared >= 0.6 * len(own) - 1e-9:
                    want.add((n, k, label, shared))
    assert got == want and len(want) > 50


def test_wrapped_notices_and_rows_of_one_doc_id(spark):
    mit = license_scan.TEMPLATES["mit-text"].split()
    wrapped = "\n".join(" * " + " ".join(mit[k : k + 9]) for k in range(0, len(mit), 9))
    rows = [(1, "Redistribution and use in source and binary forms, with or without\n * modification, are permitted"), (2, "x " * 40 + wrapped), (2, "plain words only"), (None, "Released under\nthe MIT License"), (None, "")]
    rows += [(3, "word " * 200_000 + "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0." + " word" * 1000)]
    got = sorted(((str(r["doc_id"]), r["labels"], r["score"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [("1", "bsd-redistribution", 1.0), ("2", "", 0.0), ("2", "mit-permission,mit-text", 1.0), ("3", "mpl-2.0", 1.0), ("None", "", 0.0), ("None", "mit", 1.0)]
    assert {r["labels"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates={}).collect()} == {""}


def test_url_rules_win_by_length_on_hosts_and_subdomains(spark):
    rows = [
        (1, "http://a.Example.COM/en/7x?q#f"), (2, "http://example.com/en/8"), (3, "https://notexample.com/en/7"), (4, "https://example.net/de/81"),
        (5, "https://x.net/de/8"), (6, "ftp://com"), (7, "no scheme com/en/"), (8, None), (9, ""), (10, "http://casino-royal.biz/x"), (11, "http://a.org/es/"), (11, "http://a.org/es/"),
        (12, "http://spam-farm.org/es/"), (13, "a://b?c://com/en/"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(5)).withColumn("judged", F.lit("x"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()}
    assert got[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2][2:] == ("com/en/", "block") and got[3] == ("notexample.com", "/en/7", "com/en/", "block")
    assert got[4][2:] == ("example.net/de/8", "block") and got[5][2:] == ("net/de/", "block")
    assert got[6] == ("com", "", None, "allow") and got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10][2:] == (None, "block") and got[11][2:] == ("org/es/", "block") and got[12][2:] == ("org/es/", "block")
    assert got[13] == ("b", "", None, "allow")
    assert url_filter.judge(df).count() == len(rows) and url_filter.judge(df.limit(0)).count() == 0


def test_url_rules_have_the_words_of_the_contract(spark):
    rows = [
        (1, "http://com/en/1"), (2, "http://www.example.com/en/71"), (3, "http://x.net/de/1"), (4, "http://EXAMPLE.net/de/7"), (5, "http://a.example.net/de/81"), (6, "http://b.org/es/"),
        (7, "http://casino.net/de/1"), (8, "http://casino.net/fr/1"), (9, "http://x.net/DE/1"), (10, "http://xnet/de/"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()}
    assert got == {
        1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: ("net/de/", "allow"), 4: ("net/de/", "allow"), 5: ("example.net/de/8", "block"), 6: ("org/es/", "block"),
        7: ("net/de/", "allow"), 8: (None, "block"), 9: (None, "allow"), 10: (None, "allow"),
    }


def test_rules_without_a_literal_are_refused(spark):
    with pytest.raises(ValueError):
        url_filter.judge(spark.createDataFrame([(1, "a://b")], "page_id long, url string"), pattern_rules=(url_filter.PatternRule("any", ".*", ()),))


def test_archives_come_back_whole(spark):
    big = "é" * 600
    tricky = f"a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n{'z' * 1000}"
    rows = [(1, "http://a/x?y#z", big), (7, "http://b", big), (3, None, None), (4, "", "\n"), (5, "http://c/\r\nX: y", tricky), (9, "u", tricky), (9, "u", tricky), (6, "v", big[:400]), (8, "v", big[:400]), (None, "w", "no number"), (None, "w", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = new_path(spark, "warc")
    warc.write_archive(df.repartition(2), path)
    captures = warc.assemble(warc.read_records(spark, path, with_payload=True)).collect()
    assert len(captures) == len(rows)
    unnumbered = sorted((r["payload_bytes"], r["record_type"]) for r in captures if r["record_id"].startswith("<urn:capture:none-"))
    assert unnumbered == [(9, "response"), (1200, "revisit")]
    by_id = {int(r["record_id"].split(":")[2].split("-")[0]): r for r in captures if ":none-" not in r["record_id"]}
    assert {k: r["record_type"] for k, r in by_id.items()} == {1: "revisit", 7: "response", 3: "response", 4: "response", 5: "revisit", 9: "response", 6: "response", 8: "response"}
    for page_id, _, html in rows[:-2]:
        r, data = by_id[page_id], (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == data and r["digest_ok"]
        assert r["request"]["n"] >= 1 and f"pageId: {page_id}\r\n" in r["metadata"][0]["fields"]
    assert by_id[1]["refers_to"] == by_id[7]["record_id"] and by_id[5]["refers_to"] == by_id[9]["record_id"]
    empty = new_path(spark, "warc")
    warc.write_archive(df.limit(0), empty)
    assert warc.assemble(warc.read_records(spark, empty)).count() == 0


def test_broken_and_concurrent_records(spark):
    def record(kind: str, name: str, block: str, to: str | None = None) -> str:
        return f"WARC/1.1\r\nwarc-type: {kind}\r\nWARC-Record-ID: {name}\r\n" + (f"WARC-Concurrent-To: {to}\r\n" if to else "") + f"Content-Length: {len(block)}\r\n\r\n{block}\r\n\r\n"

    text = "junk" + record("response", "r", "HTTP/1.1 200 OK\r\n\r\nbody") + record("request", "q", "GET /", "r") + record("metadata", "m", "k: v", "q") + record("metadata", "n", "k: x", "m") + record("metadata", "o", "k: y", "n") + record("metadata", "c1", "k", "c2") + record("metadata", "c2", "k", "c1") + record("metadata", "lost", "k: w", "nowhere") + "WARC/1.1\r\nno length\r\n\r\n"
    path = new_path(spark, "warc")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    (capture,) = warc.assemble(warc.read_records(spark, path, with_payload=True)).collect()
    assert bytes(capture["payload"]) == b"body" and capture["request"]["record_id"] == "q"
    assert [m["record_id"] for m in capture["metadata"]] == ["m", "n", "o"]  # through the request, and through one another


def tiles_by_hand(item: list[str], doc: list[str], least: int) -> int:
    """Words covered by greedy string tiling, straight from its definition."""
    free_i, free_d, covered = [True] * len(item), [True] * len(doc), 0
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and free_i[i + n] and free_d[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n >= least:
                    found.append((i, j))
        if best < least:
            return covered
        for i, j in found:
            if all(free_i[i : i + best]) and all(free_d[j : j + best]):
                free_i[i : i + best] = free_d[j : j + best] = [False] * best
                covered += best


def test_tiling_is_what_brute_force_covers(spark, monkeypatch):
    made = random.Random(12)
    words = vocabulary(12, 60)
    items = [(k, " ".join(prose(made, words, made.randint(3, 30)))) for k in range(15)]
    docs = []
    for n in range(40):
        parts = prose(made, words, made.randint(0, 30))
        for _ in range(made.randint(0, 3)):
            own = made.choice(items)[1].split()
            cut = made.randrange(len(own))
            parts[len(parts) // 2 : len(parts) // 2] = [*own[cut:], *own[:cut]] if made.random() < 0.5 else own
        docs.append((n, " ".join(parts).upper(), "en", "s", 0))
    docs += [(40, None, None, None, None), (41, "", "en", "s", 0)]
    bench = spark.createDataFrame([*items, (98, None), (99, "")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 1 << 15)  # much passes by chance
    df = spark.createDataFrame(docs, DOCS)
    got = {(r["doc_id"], r["item_id"]): r["covered_words"] for r in decontaminate.overlaps(df, bench).collect()}
    want = {}
    for n, text, *_ in docs:
        for k, item in items:
            own = item.split()
            covered = tiles_by_hand(own, (text or "").lower().split(), min(decontaminate.MIN_MATCH, len(own)))
            if covered:
                want[n, k] = covered
    assert got == want and len(want) > 30
    kept = decontaminate.remove_contaminated(df.withColumn("bad_id", F.lit(1)).withColumn("own_key", F.lit("x")), bench)
    size = {k: len(t.split()) for k, t in items}
    bad = {n for (n, k), c in want.items() if c >= decontaminate.COVERAGE * size[k]}
    assert {r["doc_id"] for r in kept.collect()} == {d[0] for d in docs} - bad and bad


@pytest.mark.parametrize("share", [0.3, 0.8])
def test_common_seeds_are_dealt_and_rare_ones_asked_for(spark, monkeypatch, share):
    made = random.Random(31)
    words, notice = vocabulary(31, 80), "this may be copied by anyone freely".split()  # 3 seeds
    items = [(k, " ".join([*prose(made, words, made.randint(16, 25)), *notice, *(notice if k % 5 == 0 else [])])) for k in range(12)]
    docs = []
    for n in range(60):  # the notice is in every document and item
        own = made.choice(items)[1].split()
        docs.append((n, " ".join([*prose(made, words, 20), *own[: made.randint(0, len(own))], "x", *notice])))
    items += [(12, " ".join(words[:3])), (13, " ".join(["w"] * 30))]
    docs += [(60, "w " * 12), (61, " ".join(words[:9]))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "HOT_LEAST", 10**9)
    whole = {tuple(r) for r in decontaminate.overlaps(df, bench).collect()}
    assert len(whole) >= 60 * 12
    monkeypatch.setattr(decontaminate, "HOT_LEAST", 4)
    seen = []
    monkeypatch.setattr(decontaminate, "materialize", lambda rows, name, *a: seen.append((name, m := common.materialize(rows, name, *a))) or m)
    assert {tuple(r) for r in decontaminate.overlaps(df, bench).collect()} == whole
    (hot,) = [m.collect() for name, m in seen if name == "tile-hot"]
    assert max(r["doc_parts"] or 0 for r in hot) > 12 and max(r["item_parts"] or 0 for r in hot) > 3
    bounded = {tuple(r) for r in decontaminate.overlaps(df, bench, coverage=share).collect()}
    at = decontaminate.overlaps(df, bench).columns.index("coverage")
    assert {r for r in bounded if r[at] >= share} == {r for r in whole if r[at] >= share}
    assert bounded <= whole and (share < 0.5 or len(bounded) < len(whole) / 2)


def test_tiles_are_those_of_the_definition_where_words_repeat():
    made = random.Random(30)
    for n in range(300):
        words = [str(k) for k in range(1 + n % 4)]
        item, doc = ([made.choice(words) for _ in range(made.randint(1, 14))] for _ in range(2))
        doc = doc * made.randint(1, 3)
        own = [np.array([int(w) + 1 for w in t], dtype=np.uint64) for t in (item, doc)]
        least = min(2, len(item))
        assert sum(t[2] for t in decontaminate.tile(*own, least)) == tiles_by_hand(item, doc, least)
    item, doc = np.full(200, 7, dtype=np.uint64), np.full(200_000, 7, dtype=np.uint64)  # a very long text of one word
    assert decontaminate.tile(item, doc, 5) == [(0, 0, 200)]


def test_items_may_have_names_and_texts_may_be_very_long(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    docs = spark.createDataFrame([(1, "w " * 300_000 + passage), (1, passage), (1, passage), (None, passage.upper() + "!"), (2, "w " * 50), (3, None)], "doc_id int, text string")
    bench = spark.createDataFrame([("a", passage), ("b", passage), (None, "w w"), ("c", "")], "item_id string, text string")
    got = sorted((str(r["doc_id"]), str(r["item_id"]), r["coverage"], r["n_items"]) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [("1", "a", 1.0, 2), ("1", "a", 1.0, 2), ("2", "None", 1.0, 0), ("None", "a", 1.0, 2)]
    assert [r["doc_id"] for r in decontaminate.remove_contaminated(docs, bench).collect()] == [3]


def test_decontamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c d e f", "en", "s", 0)], DOCS), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.remove_contaminated(docs, bench).count() == 0
    assert decontaminate.remove_contaminated(docs, bench.limit(0)).count() == 1
    assert decontaminate.overlaps(docs.limit(0), bench).count() == 0


def test_budgets_fill_siblings_before_ancestors(spark):
    leaves = [("web", "en", "a", 10), ("web", "en", "b", 100), ("web", "de", "c", 1000), ("news", "en", "d", 1000)]
    mix = mixing.Mix(domain_weights={"web": 3, "news": 1}, lang_weights={"en": 1, "de": 1}, share=0.5, max_epochs=1)
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), mix).collect()}
    # 1055 in all: web 791, of which en may have 395 but holds 110; the rest goes to its sibling de, none to news
    assert got == {"a": 10, "b": 100, "c": 681, "d": 263}


def test_mixing_of_nulls_repeats_and_clashing_columns(spark):
    rows = [(n, "w " * (1 + n % 7), ["en", "de", None][n % 3], f"src{n % 4}", n) for n in range(40)]
    rows += [(1, "w " * 2, "de", "src1", 1), (50, None, "en", "src0", 0), (51, "", None, None, None), (None, "x y z", "fr", None, 3)]
    df = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("r")).withColumn("p_id", F.lit(3)).withColumn("epoch", F.lit("clash"))
    out = mixing.mix_documents(df)
    assert out.columns == [*[c for c in df.columns if c != "epoch"], "domain", "epoch", "n_tokens"]
    got = out.collect()
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    assert 0.8 * total <= sum(r["n_tokens"] for r in got) <= 1.3 * total
    assert not any(r["doc_id"] in (50, 51) for r in got)
    assert all(r["n_tokens"] == len(r["text"].split()) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(df.repartition(3)).collect()))
    assert mixing.mix_documents(df.limit(0)).count() == 0


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = {r["item_id"]: decontaminate.tokens(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    at = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF)
        path = new_path(spark, name)
        out.write.parquet(path)
        at = spark.read.parquet(path)
        seen[name] = at.collect()
        if name != "mixing":
            assert at.columns == docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in seen["language_id"]} == {k for k, t in before.items() if language.has_letter(t)}
    assert all(r["text"] in before[r["doc_id"]] or len(r["text"]) < len(before[r["doc_id"]]) for r in seen["line_dedup"])
    ids = {r["doc_id"] for r in seen["minhash_dedup"]}
    assert ids < {r["doc_id"] for r in seen["line_dedup"]}
    text = {r["doc_id"]: " ".join(decontaminate.tokens(r["text"])) for r in seen["minhash_dedup"]}
    holds = {k for k, t in text.items() if any(len(v) >= 5 and f" {' '.join(v)} " in f" {t} " for v in bench.values())}
    left = {r["doc_id"] for r in seen["decontaminate"]}
    assert left <= ids - holds and len(left) >= 0.8 * len(ids)
    assert {r["doc_id"] for r in seen["mixing"]} <= left and seen["mixing"]


def test_regular_expressions_name_their_literals():
    for rule in url_filter.PATTERN_RULES:
        assert all(re.search(rf"\b{w}\b", rule.regex) for w in rule.literals)
        assert np.all([w == w.lower() for w in rule.literals])


def test_pipeline_runs_as_its_stages_and_takes_odd_rows(spark, tmp_path):
    whole = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "lang", "source", "n_chars", "domain", "epoch", "n_tokens"} == set(whole.columns) and whole.count() > 100
    passage = " ".join(f"word{k} of" for k in range(40))
    item = "the test item that a document may hold word for word"
    rows = [(1, passage, "en", "src1", 1), (1, passage, "en", "src1", 1), (2, passage, None, None, None), (3, None, "en", "src1", 0), (4, "", "en", "src1", 0), (5, "12 34", "de", "src2", 5)]
    rows += [(None, "a row without a number", "en", "src3", 3), (6, f"here stands {item} and more", "en", "src1", 9), (7, "x " * 100_000 + "end", "en", "src4", 7), (8, "plain words of a clean text", "en", "src0", 2)]
    df = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("clash")).withColumn("own_id", F.lit(7))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = sorted({str(r["doc_id"]) for r in at.collect()})
    assert ids["language_id"] == ["1", "2", "6", "7", "8", "None"]
    assert ids["line_dedup"] == ids["minhash_dedup"] == ["1", "6", "7", "8", "None"]
    assert ids["decontaminate"] == ["1", "7", "8", "None"] and set(ids["mixing"]) <= set(ids["decontaminate"])
    empty = tmp_path / "empty"
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def _warc(version: str, records: list[tuple[list[tuple[str, str]], bytes]]) -> bytes:
    out = b""
    for headers, block in records:
        lines = [f"WARC/{version}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
        out += "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    return out


@pytest.mark.parametrize("version", ["1.0", "1.1"])
def test_records_of_either_version_may_be_concurrent_to_several(spark, tmp_path, version):
    http = b"HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\nWARC/1.0 WARC/1.x"
    records = [
        ([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<i>")], b"software: x"),
        ([("WARC-Type", "response"), ("WARC-Record-ID", "<a>")], http),
        ([("WARC-Type", "response"), ("WARC-Record-ID", "<b>")], http + b"!"),
        ([("WARC-Type", "request"), ("WARC-Record-ID", "<q>"), ("WARC-Concurrent-To", "<a>")], b"GET / HTTP/1.1\r\n\r\n"),
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m>"), ("WARC-Concurrent-To", "<a>"), ("WARC-Concurrent-To", "<b>")], b"k: v"),
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<n>"), ("WARC-Concurrent-To", "<m>"), ("WARC-Concurrent-To", "<a>")], b"k: w"),
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<o>"), ("WARC-Concurrent-To", "<p>")], b"a circle"),
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<p>"), ("WARC-Concurrent-To", "<o>")], b"a circle"),
    ]
    (tmp_path / "x.warc").write_bytes(_warc(version, records))
    read = warc.read_records(spark, str(tmp_path / "x.warc"), with_payload=True)
    assert read.count() == len(records)
    got = {r["record_id"]: (bytes(r["payload"]), r["request"]["n"], sorted(m["record_id"] for m in r["metadata"])) for r in warc.assemble(read).collect()}
    assert got == {"<a>": (b"WARC/1.1\r\nWARC/1.0 WARC/1.x", 1, ["<m>", "<n>"]), "<b>": (b"WARC/1.1\r\nWARC/1.0 WARC/1.x!", 0, ["<m>", "<n>"])}
