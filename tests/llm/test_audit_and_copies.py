"""Filter audit and exact dedup: brute force on odd rows. (Whole tables are held against SQL with the other queries.)"""

from __future__ import annotations

import hashlib
import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts(seed: int, n: int) -> list[tuple]:
    made = random.Random(seed)
    pool = [None, "", "  ", "é" * 40, "A b c", "x" * 70_000 + " Y", "a# b", "word " * 300, " ".join(f"w{k}" for k in range(250)), "\x0bZ\x1cz q", "ÀÀÀ A"]
    rows = [(made.choice([None, *range(n)]), made.choice(pool), made.choice(["en", "de", None, ""])) for _ in range(n)]
    return rows + rows[:5]


def test_audit_is_that_of_filters_run_one_by_one(spark):
    rows = _texts(3, 150)
    made = random.Random(4)
    labels = [(made.choice([None, *range(150)]), made.choice([0, 1, None]), made.choice([0, 1, None])) for _ in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("part", F.lit("x")).withColumn("fails", F.lit(1)).repartition(5)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}

    smallest: dict = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    judged = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and doc_id > smallest[text],
        }
        own = [x for x in labels if x[0] == doc_id and doc_id is not None]
        judged.append((lang or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    want, shapley = {}, {}
    for part in {j[0] for j in judged}:
        for order in permutations("ABCDE"):
            left = [j for j in judged if j[0] == part]
            every = list(left)
            for step, f in enumerate(order, 1):
                gone = [j for j in left if j[1][f]]
                left = [j for j in left if not j[1][f]]
                failing = [j for j in every if j[1][f]]
                alone = [j for j in failing if sum(j[1].values()) == 1]
                want[part, "".join(order), step] = (len(left), len(gone), len(failing) - len(gone), len(alone), sum(j[2] for j in gone), sum(j[3] for j in gone))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    want = {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}
    assert got == want
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_index_of_many_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "BLOCK", 7)
    made = random.Random(1)
    rows = [(f"p{made.randrange(9)}", made.randrange(32), made.random() < 0.5, made.random() < 0.2) for _ in range(500)]
    df = spark.createDataFrame(rows, "part string, fails int, good boolean, toxic boolean").repartition(3)
    for r in filter_audit.counts_by_set(df).collect():
        passing = [x for x in rows if x[0] == r["part"] and not x[1] & r["passed"]]
        assert (r["kept"], r["good"], r["toxic"]) == (len(passing), sum(x[2] for x in passing), sum(x[3] for x in passing))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: F.length(text).cast("string"), lambda text: F.lit("same")])
def test_copies_are_found_whatever_the_digest(spark, monkeypatch, digest):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 8)
    made = random.Random(7)
    pool = [None, "", " ", "a", "b", "A", "a ", "é", "é", "long " * 20_000, "long " * 19_999 + "lonG "] + [f"t{k}" for k in range(60)]
    rows = [(made.choice([None, *range(400)]), made.choice(pool[:8] if n % 3 == 0 else pool)) for n in range(400)]
    rows += rows[:20]  # rows that repeat both
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("uid", F.lit("u")).repartition(6)
    got = exact_dedup.groups_of_equal_texts(df, digest).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    groups: dict = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    by = {_sha(t): ids for t, ids in groups.items()}
    kept: dict = {}
    for r in got:
        ids = by[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert kept == dict.fromkeys(by, 1)
    left = exact_dedup.drop_copies(df, digest)
    assert left.columns == ["doc_id", "text", "digest", "uid"]
    assert sorted(r["text"] or "" for r in left.collect()) == sorted(groups)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_no_copies_in_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.groups_of_equal_texts(df).count() == 0 and exact_dedup.drop_copies(df).count() == 0
