"""Language ID, Katz scoring and embedding near-dedup against held-out accuracy and brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SF
from llm.fixtures import DOCS, components_of, prose, vocabulary
from pyspark.sql import functions as F

from sparkloom.llm import katz, language, neighbours


def test_language_is_right_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id")
    rows = found.where("lang IS NOT NULL").collect()
    assert len(rows) >= 900
    judged = [r for r in rows if r["held_out"] and r["lang_pred"] != "und" and len(r["text"].split()) >= 5]
    right = sum(r["lang"] == r["lang_pred"] for r in judged)
    assert right >= 0.97 * len(judged) > 100
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))


def test_language_of_nulls_empties_and_unknown_tables(spark):
    rows = [(1, "the house and the garden", "en", "s", 0), (1, "the house and the garden", "en", "s", 0), (2, None, "en", "s", 0), (3, "123 !", "de", None, 0), (None, "das Haus und der Garten", "de", "s", 0), (5, "", None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit(-1))
    got = {(r["doc_id"], r["lang_pred"]) for r in language.identify(df).collect()}
    assert (2, "und") in got and (3, "und") in got and (5, "und") in got and len(got) >= 4
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "None"]
    unlearned = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlearned).collect()} == {"und"}
    assert language.identify(df.limit(0)).count() == 0


def test_language_learns_nothing_from_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    wrong = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    got = {r["lang_pred"] for r in language.identify(wrong).collect()}
    assert "xx" not in got


def slow_features(text: str) -> np.ndarray:
    """Counts of byte pairs and triples one at a time."""
    data = [b if b >= 128 or chr(b).isalpha() else 32 for b in b" " + text.lower().encode("utf-8", "replace") + b" "]
    counts = [0] * language.DIM
    for k in range(len(data) - 1):
        if data[k : k + 2] != [32, 32]:
            counts[(data[k] * 73 + data[k + 1]) % language.DIM2] += 1
    for k in range(len(data) - 2):
        h = data[k] * 1973 + data[k + 1] * 503 + data[k + 2] * 43
        counts[language.DIM2 + (h ^ h >> 7) % language.DIM3] += 1
    for at in ((32 * 73 + 32) % language.DIM2, language.DIM2 + (lambda h: (h ^ h >> 7) % language.DIM3)(32 * 2519)):
        counts[at] = 0
    root = [math.sqrt(c) for c in counts]
    size = math.sqrt(sum(c * c for c in root))
    return np.array([c / size if size else 0.0 for c in root])


def test_language_of_every_row_is_that_of_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_PER_LANG", 16)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    # the sample, from hashes of all rows
    bins: dict[tuple, tuple] = {}
    for r in docs.select("*", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.xxhash64("text").alias("t")).collect():
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            key = (r["lang"], r["h"] % 16)
            bins[key] = min(bins.get(key, (math.inf,)), (r["h"], r["t"], r["doc_id"], r["text"]))
    rows = [(lang, slow_features(v[3])) for (lang, _), v in bins.items() if language.has_letter(v[3])]
    rows = sorted(((lang, x.astype(np.float16)) for lang, x in rows), key=lambda r: (r[0], r[1].tobytes()))
    model = language.fit(np.array([x for _, x in rows], dtype=np.float32), [lang for lang, _ in rows])

    def judged(text: str | None) -> tuple[str, float]:
        if not language.has_letter(text):
            return "und", 0.0
        x = slow_features(text)
        chance = {part: 1 / (1 + math.exp(-(a * (float(w[:-1] @ x) + float(w[-1])) + b))) for part, (a, b), w in zip(model["parts"], model["slopes"], model["weights"], strict=True)}
        names = list(model["families"])
        sure = {f: chance.get(("family", f), 1.0) for f in names}
        if len(names) == 2:
            sure[names[1]] = 1 - sure[names[0]]
        family = max(names, key=lambda f: sure[f])
        own, votes, means = model["families"][family], Counter(), Counter()
        for part, p in chance.items():
            if part[0] == "pair" and part[1] == family:
                votes[part[2] if p >= 0.5 else part[3]] += 1
                means[part[2]] += p
                means[part[3]] += 1 - p
        best = max(own, key=lambda v: (votes[v], means[v]))
        return best, sure[family] / sum(sure.values()) * (means[best] / (len(own) - 1) if len(own) > 1 else 1)

    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    texts = docs.collect()
    assert len(got) == len(texts) >= 200
    for r in texts:
        lang, score = judged(r["text"])
        assert got[r["doc_id"]]["lang_pred"] == lang
        assert abs(got[r["doc_id"]]["score"] - score) < 1e-3


def test_families_of_codes_and_of_many_languages():
    assert [language.family_of(v) for v in ("en", "deu", "EN-gb", "pt_BR", "spa", "zh", "tlh")] == ["germanic", "germanic", "germanic", "romance", "romance", "other", "other"]
    made = np.random.default_rng(4)
    langs = [f"q{k:03d}" for k in range(400)]  # more than there were places for, none with a known family
    middles = np.abs(made.standard_normal((len(langs), language.DIM)))
    x = np.repeat(middles, 2, axis=0) + 0.05 * np.abs(made.standard_normal((2 * len(langs), language.DIM)))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    names = [v for v in langs for _ in range(2)]
    families = language.families_of(x, names)
    assert sorted(v for own in families.values() for v in own) == langs
    assert max(map(len, families.values())) <= language.FAMILY_SIZE
    few = np.isin(names, langs[:40])
    model = language.fit(x[few], [v for v in names if v in langs[:40]])
    assert len(model["parts"]) < 40 * language.FAMILY_SIZE
    assert np.mean(np.array(language.predict(model, x[few])[0]) == np.array(names)[few]) == 1


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ROWS", 330)
    words = {n: vocabulary(n, 6) for n in range(320)}
    rows = [(n * 320 + k, " ".join(own * 3), f"q{k:03d}") for n in range(3) for k, own in words.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {r["lang"] for r in language.sample(df).collect()}
    assert learned == {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2} and len(learned) > 300


def katz_by_hand(train: list[list[str]], texts: list[list[str]], order: int):
    """Log10 probability of each text by dictionaries and recursion, and some histories' sums over all words and the
    unknown one."""

    def grams(text: list[str], n: int):
        padded = ["<s>"] * (n - 1) + [*text, "</s>"]
        return [tuple(padded[k : k + n]) for k in range(len(text) + 1)]

    counts = [Counter(g for t in train for g in grams(t, n)) for n in range(1, order + 1)]
    after = [defaultdict(dict) for _ in counts]
    for n, c in enumerate(counts):
        for g, r in c.items():
            after[n][g[:-1]][g[-1]] = r
    tokens, words = sum(counts[0].values()), {g[0] for g in counts[0]}

    def discount(found: Counter) -> dict[int, float]:
        sizes = Counter(found.values())
        out = defaultdict(lambda: 1 - katz.SLIGHT)
        if sizes[1]:
            top = (katz.KEEP + 1) * sizes[katz.KEEP + 1] / sizes[1]
            for r in range(1, katz.KEEP + 1):
                if sizes[r] and top < 1:
                    d = ((r + 1) * sizes[r + 1] / (r * sizes[r]) - top) / (1 - top)
                    if 0 < d < 1:
                        out[r] = d
        return out

    d = [discount(c) for c in counts]
    unknown = 1 - sum(c * d[0][c] / tokens for c in counts[0].values())

    def prob(history: tuple, w: str) -> float:
        n, own = len(history), after[len(history)].get(history, {})
        if w in own:
            return own[w] * d[n][own[w]] / sum(own.values())
        if not n:
            return unknown
        if not own:
            return prob(history[1:], w)
        return (1 - sum(prob(history, x) for x in own)) / (1 - sum(prob(history[1:], x) for x in own)) * prob(history[1:], w)

    scores = [sum(math.log10(prob(g[:-1], g[-1])) for g in grams(t, order)) for t in texts]
    sums = [sum(prob(h, w) for w in words) + prob(h, "never seen") for h in list(after[-1])[:40]]
    base = [sum(math.log10((counts[0][w,] + 0.5) / (tokens + 0.5 * (len(words) + 1))) for w in [*t, "</s>"]) for t in texts]
    return scores, sums, base, counts, tokens


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_scores_are_those_of_dictionaries(spark, monkeypatch, order):
    made = random.Random(8)
    words = vocabulary(8, 40)
    rows = [(n, " ".join(prose(made, words[: 10 + n % 30], made.randint(0, 60))), n % 4 == 1) for n in range(60)]
    rows += [(60, None, False), (61, "neverseen before THIS", True), (62, "", True), (None, words[0].upper(), False), (3, rows[3][1], False)]
    rows += [(63, " ".join(prose(made, words, 5000)), True)]  # longer than a chunk
    monkeypatch.setattr(katz, "PARTITION_BYTES", 2000)  # several partitions
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 300)
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").withColumn("chunk", F.lit("clash")).repartition(4)
    scores, model, tables = katz.score_documents(df, order)
    texts = [(t or "").lower().split() for _, t, _ in rows]
    want, sums, base, counts, tokens = katz_by_hand([t for t, r in zip(texts, rows, strict=True) if not r[2]], texts, order)
    assert np.allclose(sums, 1)
    assert (model.tokens, model.words, model.order) == (tokens, len(counts[0]), order)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in scores.collect())
    known = [sum(counts[0][w,] > 0 for w in [*t, "</s>"]) for t in texts]
    assert got == sorted((str(r[0]), r[2], len(t) + 1, k, round(b, 6), round(s, 6)) for r, t, k, b, s in zip(rows, texts, known, base, want, strict=True))
    # the counts are rows, each n-gram once
    for level, own in enumerate(counts, 1):
        held = tables.where(f"level = {level}")
        assert held.count() == held.distinct().count() == len(own)
        assert sorted(r["n"] for r in held.collect()) == sorted(own.values())
        assert sorted(r["s"] for r in held.groupBy("history").agg(F.sum("n").alias("s")).collect()) == sorted(Counter(t for g, c in own.items() for t in [g[:-1]] * c).values())


def test_katz_without_rows_or_training(spark):
    schema = "doc_id long, text string, held_out boolean"
    assert katz.score_documents(spark.createDataFrame([], schema))[0].count() == 0
    (row,) = katz.score_documents(spark.createDataFrame([(1, "a b", True)], schema))[0].collect()
    assert (row["n_tokens"], row["n_known"], math.isfinite(row["score"])) == (3, 0, True)


def test_katz_scores_do_not_depend_on_how_files_are_split(spark, tmp_path, monkeypatch):
    made = random.Random(10)
    words = vocabulary(10, 40)
    rows = [(n, " ".join(prose(made, words, 1 + n % 50)), n % 4 == 1) for n in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(8).write.parquet(f"{tmp_path}/docs")
    key, out = "spark.sql.files.minPartitionNum", []
    split = katz.Model

    def other_cores(*args):  # between the jobs, as if executors had been lost or added
        spark.conf.set(key, "1")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        return split(*args)

    for model in (split, other_cores):
        monkeypatch.setattr(katz, "Model", model)
        spark.conf.set(key, "8")
        try:
            scores, _, _ = katz.score_documents(spark.read.parquet(f"{tmp_path}/docs"), from_files=True)
            out.append({r["doc_id"]: (r["n_tokens"], round(r["score"], 6)) for r in scores.collect()})
        finally:
            spark.conf.unset(key)
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert out[0] == out[1] and len(out[0]) == len(rows)


VECTORS = "vec_id long, label int, embedding array<float>"


def cosines(rows: list[tuple]) -> tuple[dict, list[tuple]]:
    good = [(i, l, np.array(v, dtype=np.float64)) for i, l, v in rows if l is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links = []
    for n, (i, l, v) in enumerate(good):
        for j, m, w in good[n + 1 :]:
            if l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= neighbours.THRESHOLD:
                links.append((i, j))
    counts = Counter(x for e in links for x in e)
    return {i: counts[i] for i, _, _ in rows}, links


def test_embedding_links_are_those_of_brute_force(spark):
    made = np.random.default_rng(6)
    rows = []
    for c in range(40):
        middle = made.standard_normal(16)
        for _ in range(int(made.integers(1, 9)) if c else 60):  # one group has more links than a list holds
            rows.append((len(rows), c % 3, (middle + 0.12 * made.standard_normal(16)).astype(np.float32).tolist()))
    rows += [(len(rows) + k, 1, rows[70][2]) for k in range(25)]  # equal vectors
    n = len(rows)
    rows += [(n, None, rows[0][2]), (n + 1, 1, None), (n + 2, 1, [0.0] * 16), (n + 3, 1, [float("nan")] + [1.0] * 15), (n + 4, 1, []), (n + 5, 1, [1.0, 2.0]), (n + 6, 1, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("key", F.lit("clash")).repartition(3)
    found, recall = neighbours.near_duplicates(df)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()}
    want, links = cosines(rows)
    parts = components_of(want, links)
    assert recall >= neighbours.MIN_RECALL and len(got) == len(rows)
    assert sum(g[0] for g in got.values()) >= 0.98 * sum(want.values())
    assert all(got[i][0] <= want[i] for i in want)
    assert sum(got[i][1] == parts[i] for i in want) >= 0.98 * len(rows)
    assert all(got[i] == (0, i) for i in range(n, n + 7))


def test_embeddings_without_links(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (None, 1, [1.0, 0.0]), (2, 2, [1.0, 0.0])], VECTORS)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in neighbours.near_duplicates(df)[0].collect()), key=str)
    assert got == sorted([(1, 0, 1), (1, 0, 1), (None, 0, None), (2, 0, 2)], key=str)
    assert neighbours.near_duplicates(df.limit(0))[0].count() == 0


def test_tight_groups_larger_than_a_leaf_are_one_component(spark):
    made = np.random.default_rng(8)
    middle = made.standard_normal(8)
    rows = [(k, 1, (middle + 1e-7 * made.standard_normal(8)).tolist()) for k in range(400)]  # alike in every tree
    scaled = made.standard_normal(8)
    rows += [(400 + k, 2, (scaled * made.uniform(0.1, 9)).tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    found, recall = neighbours.near_duplicates(df)
    assert recall == 1
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in found.collect()} == {(k, 399, k // 400 * 400) for k in range(800)}


def test_what_the_graph_misses_is_compared_in_full(spark, monkeypatch):
    made = np.random.default_rng(9)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "neighbour_graph", lambda points, *_: points.limit(0).selectExpr("id a", "id b", "0d sim"))
    middles = made.standard_normal((12, 5))
    rows = [(k, k % 2, (middles[made.integers(12)] + 0.3 * made.standard_normal(5)).tolist()) for k in range(150)]
    found, recall = neighbours.near_duplicates(spark.createDataFrame(rows, VECTORS.replace("float", "double")).repartition(3))
    want, links = cosines(rows)
    parts = components_of(want, links)
    assert recall == 1 and len(set(parts.values())) < 100
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()} == {i: (want[i], parts[i]) for i in want}


def test_a_bad_label_does_not_hide_behind_a_good_one(spark, monkeypatch):
    made = np.random.default_rng(14)
    whole, asked = neighbours.neighbour_graph, []

    def one_label_lost(points, k, attempt):
        asked.append({r["label"] for r in points.select("label").distinct().collect()})
        kept = points.where("label = '1'").select(F.col("id").alias("a"))
        return whole(points, k, attempt).join(kept, "a", "left_semi")

    monkeypatch.setattr(neighbours, "neighbour_graph", one_label_lost)
    middles = made.standard_normal((60, 6))
    rows = [(k, 1, (middles[k % 50] + 0.02 * made.standard_normal(6)).tolist()) for k in range(400)]
    rows += [(400 + k, 2, (middles[50 + k // 2] + 0.02 * made.standard_normal(6)).tolist()) for k in range(20)]  # 20 of 2,800 links
    out, audit = neighbours.search(spark.createDataFrame(rows, VECTORS.replace("float", "double")).repartition(3))
    want, links = cosines(rows)
    parts = components_of(want, links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out.collect()}
    assert asked == [{"1", "2"}, {"2"}, {"2"}]
    assert all(got[i] == (want[i], parts[i]) for i in range(400, 420)) and sum(want[i] for i in range(400, 420)) >= 20
    assert {r["label"]: r["hit"] / r["n"] for r in audit.collect()}["2"] == 1
    assert sum(got[i][0] for i in range(400)) >= 0.98 * sum(want[i] for i in range(400))


def test_rows_of_one_vec_id_are_points_of_their_own(spark):
    rows = [(1, 1, [1.0, 0.0, 0.0]), (1, 1, [0.0, 1.0, 0.0]), (2, 1, [0.0, 1.0, 0.001]), (3, 1, [0.0, 0.0, 1.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in neighbours.near_duplicates(spark.createDataFrame(rows, VECTORS))[0].collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_full_lists_are_enlarged(spark):
    made = np.random.default_rng(11)
    middle = made.standard_normal(8)
    rows = [(k, 1, (middle + 0.01 * made.standard_normal(8)).tolist()) for k in range(30)]  # 29 links each: more than K, fewer than an enlarged list
    points = spark.createDataFrame([(r[0], "1", (lambda v: v / np.linalg.norm(v))(np.array(r[2])).tobytes(), 1) for r in rows], "id long, label string, unit binary, weight long")
    graph = neighbours.neighbour_graph(points).groupBy("a").count().collect()
    assert {r["count"] for r in graph} == {29}
