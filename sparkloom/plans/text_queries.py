"""Text, retrieval and duplicate queries over documents, conversations, part and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import ranking, retrieval, sketches
from sparkloom.session import read_table

QUESTION = ["license", "apache", "rights"]
PREFIX_QUESTION = ["licen", "reserv"]
SYNONYMS = {"license": ["licensed", "released"], "rights": ["reserved"]}

_W = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
_POSTS = f"""
    terms AS (SELECT doc_id AS doc, unnest({_W.format("text")}) AS term FROM documents),
    posts AS (SELECT doc, term, count(*) AS tf FROM terms GROUP BY ALL),
    lens AS (SELECT doc, sum(tf) AS len FROM posts GROUP BY doc),
    tot AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lens)"""


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(read_table(spark, d, "documents"), "doc_id", T.words(F.col("text")))


def _bm25(spark: SparkSession, d: str, terms: list[str], synonyms: dict | None = None, prefix: bool = False) -> DataFrame:
    return retrieval.bm25(read_table(spark, d, "documents"), "doc_id", T.words(F.col("text")), terms, synonyms, prefix)


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    w = T.words(F.col("text"))
    return read_table(spark, d, "documents").select("doc_id", F.size(w).alias("n_tokens"), F.size(F.array_distinct(w)).alias("n_terms"))


def term_df(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark, d).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def identifier_split(spark: SparkSession, d: str) -> DataFrame:
    names = read_table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return names.select("key", F.array_join(T.split_identifier(F.col("name")), " ").alias("parts"))


def porter_stem(spark: SparkSession, d: str) -> DataFrame:
    """Stems of the distinct words only: a word is stemmed once however often it stands."""
    vocabulary = read_table(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return T.with_stem(vocabulary, "word")


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"), T.byte_token_estimate(F.col("text")).alias("byte_tokens"))


def first_sentence(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "conversations").select("conv_id", "turn", T.first_sentence(F.col("text")).alias("sentence"))


def excerpt_context(spark: SparkSession, d: str) -> DataFrame:
    """Lines that name a license, each with a line of context on both sides."""
    lines = read_table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-1, 1)
    hit = F.lower("line").contains("license")
    return lines.withColumn("near", F.max(hit.cast("int")).over(w)).where("near = 1").select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("line").alias("line"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    found = _bm25(spark, d, QUESTION)
    return retrieval.top(found, 20).select("doc", "score")


def bm25_prefix(spark: SparkSession, d: str) -> DataFrame:
    found = _bm25(spark, d, PREFIX_QUESTION, prefix=True)
    return found.select("doc", F.round("lexical", 6).alias("lexical"))


def bm25_synonym(spark: SparkSession, d: str) -> DataFrame:
    found = _bm25(spark, d, QUESTION, SYNONYMS)
    return found.select("doc", F.round("lexical", 6).alias("lexical"), F.round("semantic", 6).alias("semantic"))


def bm25_weighted_fields(spark: SparkSession, d: str) -> DataFrame:
    parts = read_table(spark, d, "part")
    fields = {"name": (T.words(F.col("p_name")), 4.0), "type": (T.words(F.col("p_type")), 2.0), "brand": (T.words(F.col("p_brand")), 1.0)}
    found = retrieval.bm25(parts, "p_partkey", fields, ["economy", "brass", "brand", "large"])
    return found.select("doc", F.round("lexical", 6).alias("lexical"))


def symbol_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Nations against typed names."""
    asked = spark.createDataFrame([(x,) for x in ("NATION_1", "nation_3", "Nation5", "ation", "GERMANY", "germany", "land")], "asked string")
    nations = read_table(spark, d, "nation").select(F.col("n_name").alias("name"))
    scored = nations.crossJoin(F.broadcast(asked)).withColumn("signal", retrieval.symbol_signal(F.col("name"), F.col("asked")))
    return scored.where("signal > 0").groupBy("name").agg(F.max("signal").alias("signal"))


def intent_classify(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "conversations").select("conv_id", "turn", retrieval.detect_intent(F.col("text")).alias("intent"))


def hybrid_score(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and synonym signals over their maxima, a name signal for short texts, a prior by language."""
    found = _bm25(spark, d, QUESTION, SYNONYMS)
    found = retrieval.normalised(retrieval.normalised(found, "lexical", "lex"), "semantic", "sem")
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "lang", "n_chars")
    found = found.join(docs, "doc")
    symbol = F.when(F.col("n_chars") < 500, 1.0).otherwise(0.25)
    prior = F.when(F.col("lang") == "en", 1.0).otherwise(0.75)
    return found.select("doc", F.round(retrieval.hybrid_score(F.col("lex"), symbol, F.col("sem"), F.lit(0.0), prior), 4).alias("score"))


def _sales(spark: SparkSession, d: str) -> DataFrame:
    """(supplier, part, amount): lineitem summed to one row a pair, for it has no key."""
    return read_table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part")).agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("amount")
    )


def round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Parts by amount, taken supplier by supplier: all first ones, then all second ones. Rows of a supplier are ranked
    by themselves; the order of suppliers is that of their first rows."""
    return ranking.round_robin(_sales(spark, d), "supplier", [F.desc("amount"), F.asc("part")]).select(
        "supplier", "part", F.col("turn").cast("long").alias("turn"), F.col("lead_amount").alias("lead_amount")
    )


def diversify_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers by amount: the leading ones within three quarters of the top stay first (3 at most)."""
    total = _sales(spark, d).groupBy("supplier").agg(F.sum("amount").alias("amount"))
    nations = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"))
    out = ranking.diversify(total.join(nations, "supplier"), "supplier", "nation", "amount")
    return out.select("supplier", "nation", "is_anchor", F.col("turn").cast("long").alias("turn"))


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, d, "documents").select(F.col("lang").alias("query"), F.col("doc_id").alias("item"), "n_chars")
    w = Window.partitionBy("query").orderBy(F.desc("n_chars"), "item")
    ranked = docs.withColumn("rk", F.row_number().over(w)).drop("n_chars")
    good = read_table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("item"))
    return ranked, docs.select("query", "item").join(good, "item", "left_semi")


def precision_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    ranked, relevant = _ranked(spark, d)
    out = retrieval.ranking_metrics(ranked, relevant, 10)
    return out.select("query", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "recall_at_k", "rr")])


def mrr(spark: SparkSession, d: str) -> DataFrame:
    ranked, relevant = _ranked(spark, d)
    return retrieval.ranking_metrics(ranked, relevant, 10).agg(F.round(F.avg("rr"), 6).alias("mrr"))


def set_f1(spark: SparkSession, d: str) -> DataFrame:
    """Documents of 1,000 characters or more, as a guess at good quality, against the labels, by language."""
    docs = read_table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") >= 1000).alias("guess"))
    both = docs.join(read_table(spark, d, "labels"), "doc_id").withColumn("good", F.col("quality") == 1)
    n = both.groupBy("lang").agg(
        F.count_if(F.col("guess") & F.col("good")).alias("tp"), F.count_if(F.col("guess")).alias("guessed"), F.count_if(F.col("good")).alias("actual")
    )
    return n.select("lang", F.round(F.when(F.col("guessed") + F.col("actual") == 0, 0.0).otherwise(2 * F.col("tp") / (F.col("guessed") + F.col("actual"))), 6).alias("f1"))


def percentile_floor(spark: SparkSession, d: str) -> DataFrame:
    values = read_table(spark, d, "documents").select("lang", "n_chars")
    return retrieval.percentile_floor(values, ["lang"], "n_chars", 0.95, "p95")


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return sketches.duplicate_groups(read_table(spark, d, "documents"), "doc_id", F.md5("text"))


def shape_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose markup is alike once words, numbers and strings are put in one form."""
    return sketches.duplicate_groups(read_table(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), "id", F.md5(F.regexp_replace(F.regexp_replace("text", "[0-9]+", "N"), "[A-Za-z]+", "I")))


def duplicate_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of 40 characters or more after their first occurrence, a row for each line that repeats."""
    lines = read_table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.trim("line")) >= 40)
    return lines.groupBy(F.md5(F.trim("line")).alias("line")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc")).where("n > 1")


def benchmark_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Runs of 8 words that a test item and a document share, by pair: an equi-join on the run."""
    docs = sketches.shingles(read_table(spark, d, "documents"), "doc_id", T.words(F.col("text")), 8)
    items = sketches.shingles(read_table(spark, d, "benchmark"), "item_id", T.words(F.col("text")), 8)
    return docs.join(items, "shingle").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


def set_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Term sets of each turn and the one before it."""
    turns = read_table(spark, d, "conversations").withColumn("terms", F.array_distinct(T.words(F.col("text"))))
    w = Window.partitionBy("conv_id").orderBy("turn")
    both = turns.withColumn("before", F.lag("terms").over(w)).where("before IS NOT NULL")
    return both.select("conv_id", "turn", F.round(T.jaccard(F.col("terms"), F.col("before")), 6).alias("jaccard"))


def bottomk_sketch_jaccard(spark: SparkSession, d: str) -> DataFrame:
    turns = read_table(spark, d, "conversations").withColumn("sketch", T.bottom_sketch(T.words(F.col("text"))))
    w = Window.partitionBy("conv_id").orderBy("turn")
    both = turns.withColumn("before", F.lag("sketch").over(w)).where("before IS NOT NULL")
    return both.select("conv_id", "turn", F.round(T.sketch_similarity(F.col("sketch"), F.col("before")), 6).alias("similarity"))


def term_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of the term sets of each turn and the one before it."""
    turns = read_table(spark, d, "conversations").withColumn("terms", F.array_distinct(T.words(F.col("text"))))
    w = Window.partitionBy("conv_id").orderBy("turn")
    both = turns.withColumn("before", F.lag("terms").over(w)).where("size(before) > 0 AND size(terms) > 0")
    cosine = F.size(F.array_intersect("terms", "before")) / F.sqrt(F.size("terms") * F.size("before"))
    return both.select("conv_id", "turn", F.round(cosine, 6).alias("cosine"))


_BM25 = "ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))"
_PREV = f"""WITH t AS (SELECT conv_id, turn, list_distinct({_W.format("text")}) AS terms FROM conversations),
    b AS (SELECT *, lag(terms) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t)"""
_RANKED = """WITH docs AS (SELECT lang AS query, doc_id AS item, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rk FROM documents),
    rel AS (SELECT query, item, rk FROM docs WHERE item IN (SELECT doc_id FROM labels WHERE quality = 1)),
    m AS (SELECT query, count(*) FILTER (WHERE rk <= 10) / 10 AS precision_at_k, count(*) FILTER (WHERE rk <= 10) / count(*) AS recall_at_k, 1 / min(rk) AS rr FROM rel GROUP BY query)"""
_SALES = "s AS (SELECT l_suppkey AS supplier, l_partkey AS part, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS amount FROM lineitem GROUP BY ALL)"
_QUESTION = ", ".join(f"('{t}', 1.0, false)" for t in QUESTION)

QUERIES = {
    f.__name__: f
    for f in (
        token_counts, term_df, identifier_split, porter_stem, token_estimate, first_sentence, excerpt_context, bm25_topk, bm25_prefix, bm25_synonym,
        bm25_weighted_fields, symbol_ladder, intent_classify, hybrid_score, round_robin, diversify_anchors, precision_recall_at_k, mrr, set_f1,
        percentile_floor, exact_duplicates, shape_duplicates, duplicate_paragraphs, benchmark_overlap, set_jaccard, bottomk_sketch_jaccard, term_cosine,
    )
}

ORACLES = {
    "token_counts": f"WITH t AS (SELECT doc_id, {_W.format('text')} AS w FROM documents) SELECT doc_id, len(w)::INTEGER AS n_tokens, len(list_distinct(w))::INTEGER AS n_terms FROM t",
    "term_df": f"WITH {_POSTS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM posts GROUP BY term",
    "identifier_split": "SELECT c_custkey AS key, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(c_name, '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS parts FROM customer",
    "token_estimate": """SELECT conv_id, turn, coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|\\n|[^\\sA-Za-z0-9]'),
        lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z]') THEN ceil(length(t) / 4) WHEN regexp_matches(t, '^[0-9]') THEN ceil(length(t) / 3) ELSE 1 END)), 0)::BIGINT AS tokens,
        ceil(strlen(text) / 4)::BIGINT AS byte_tokens FROM conversations""",
    "first_sentence": """WITH f AS (SELECT conv_id, turn, trim(regexp_replace(regexp_split_to_array(trim(text), '\\n\\s*\\n')[1], '\\s+', ' ', 'g')) AS flat FROM conversations),
        o AS (SELECT *, regexp_extract(flat, '^(.*?[.!?])(\\s|$)', 1) AS one FROM f) SELECT conv_id, turn, substr(CASE WHEN one <> '' THEN one ELSE flat END, 1, 160) AS sentence FROM o""",
    "excerpt_context": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
        h AS (SELECT doc_id, pos FROM l WHERE contains(lower(line), 'license'))
        SELECT DISTINCT l.doc_id, l.pos::BIGINT AS pos, md5(l.line) AS line FROM l JOIN h ON l.doc_id = h.doc_id AND abs(l.pos - h.pos) <= 1""",
    "bm25_topk": f"""WITH {_POSTS}, q(t, w, syn) AS (VALUES {_QUESTION}), hit AS (SELECT doc, term, tf FROM posts JOIN q ON term = t), df AS (SELECT term, count(*) AS df FROM hit GROUP BY term)
        SELECT doc, round(sum({_BM25}), 6) AS score FROM hit JOIN df USING (term) JOIN lens USING (doc), tot GROUP BY doc ORDER BY score DESC, doc LIMIT 20""",
    "bm25_prefix": f"""WITH {_POSTS}, q(t) AS (VALUES {', '.join(f"('{t}')" for t in PREFIX_QUESTION)}),
        hit AS (SELECT doc, term, tf, CASE WHEN term = t THEN 1.0 ELSE 0.5 END AS w FROM posts JOIN q ON starts_with(term, t)), df AS (SELECT term, count(DISTINCT doc) AS df FROM posts GROUP BY term)
        SELECT doc, round(sum(w * {_BM25}), 6) AS lexical FROM hit JOIN df USING (term) JOIN lens USING (doc), tot GROUP BY doc""",
    "bm25_synonym": f"""WITH {_POSTS}, q(t, w, syn) AS (VALUES {_QUESTION}, ('licensed', 0.7, true), ('released', 0.7, true), ('reserved', 0.7, true)),
        hit AS (SELECT doc, term, tf, w, syn FROM posts JOIN q ON term = t), df AS (SELECT term, count(*) AS df FROM posts GROUP BY term)
        SELECT doc, round(coalesce(sum(w * {_BM25}) FILTER (WHERE NOT syn), 0), 6) AS lexical, round(coalesce(sum(w * {_BM25}) FILTER (WHERE syn), 0), 6) AS semantic
        FROM hit JOIN df USING (term) JOIN lens USING (doc), tot GROUP BY doc""",
    "bm25_weighted_fields": f"""WITH terms AS (SELECT p_partkey AS doc, unnest({_W.format('p_name')}) AS term, 4 AS n FROM part UNION ALL SELECT p_partkey, unnest({_W.format('p_type')}), 2 FROM part
        UNION ALL SELECT p_partkey, unnest({_W.format('p_brand')}), 1 FROM part), posts AS (SELECT doc, term, sum(n) AS tf FROM terms GROUP BY ALL),
        lens AS (SELECT doc, sum(tf) AS len FROM posts GROUP BY doc), tot AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lens), df AS (SELECT term, count(*) AS df FROM posts GROUP BY term)
        SELECT doc, round(sum({_BM25}), 6) AS lexical FROM posts JOIN df USING (term) JOIN lens USING (doc), tot WHERE term IN ('economy', 'brass', 'brand', 'large') GROUP BY doc""",
    "symbol_ladder": """WITH q(a) AS (VALUES ('NATION_1'), ('nation_3'), ('Nation5'), ('ation'), ('GERMANY'), ('germany'), ('land')),
        s AS (SELECT n_name AS name, CASE WHEN a = n_name THEN 1.0 WHEN lower(a) = lower(n_name) THEN 0.9
            WHEN regexp_replace(lower(a), '[^a-z0-9]', '', 'g') = regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') THEN 0.9 WHEN length(a) >= 4 AND contains(lower(n_name), lower(a)) THEN 0.25 ELSE 0 END::DOUBLE AS signal FROM nation, q)
        SELECT name, max(signal) AS signal FROM s WHERE signal > 0 GROUP BY name""",
    "intent_classify": "SELECT conv_id, turn, CASE "
    + " ".join(f"WHEN regexp_matches(lower(text), '{p.replace(chr(39), chr(39) * 2)}') THEN '{name}'" for name, p in retrieval.INTENTS.items())
    + " ELSE 'explain' END AS intent FROM conversations",
    "hybrid_score": f"""WITH {_POSTS}, q(t, w, syn) AS (VALUES {_QUESTION}, ('licensed', 0.7, true), ('released', 0.7, true), ('reserved', 0.7, true)),
        hit AS (SELECT doc, term, tf, w, syn FROM posts JOIN q ON term = t), df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
        f AS (SELECT doc, coalesce(sum(w * {_BM25}) FILTER (WHERE NOT syn), 0) AS lexical, coalesce(sum(w * {_BM25}) FILTER (WHERE syn), 0) AS semantic FROM hit JOIN df USING (term) JOIN lens USING (doc), tot GROUP BY doc)
        SELECT doc, round(floor((0.35 * coalesce(lexical / nullif(max(lexical) OVER (), 0), 0) + 0.35 * CASE WHEN n_chars < 500 THEN 1.0 ELSE 0.25 END + 0.1 * coalesce(semantic / nullif(max(semantic) OVER (), 0), 0))
            * (0.6 + 0.4 * CASE WHEN lang = 'en' THEN 1.0 ELSE 0.75 END) * 1e6 + 0.5) / 1e6, 4)::DOUBLE AS score FROM f JOIN documents ON doc = doc_id""",
    "round_robin": f"WITH {_SALES} SELECT supplier, part, row_number() OVER (PARTITION BY supplier ORDER BY amount DESC, part) AS turn, max(amount) OVER (PARTITION BY supplier) AS lead_amount FROM s",
    "diversify_anchors": f"""WITH {_SALES}, t AS (SELECT supplier, sum(amount)::BIGINT AS amount FROM s GROUP BY supplier), r AS (SELECT t.*, s_nationkey AS nation, row_number() OVER (ORDER BY amount DESC, supplier) AS rk,
        max(amount) OVER () AS most FROM t JOIN supplier ON supplier = s_suppkey), a AS (SELECT *, rk <= 3 AND amount >= 0.75 * most AS is_anchor FROM r)
        SELECT supplier, nation, is_anchor, CASE WHEN is_anchor THEN 0 ELSE row_number() OVER (PARTITION BY is_anchor, nation ORDER BY amount DESC, supplier) END AS turn FROM a""",
    "precision_recall_at_k": f"{_RANKED} SELECT query, round(precision_at_k, 6) AS precision_at_k, round(recall_at_k, 6) AS recall_at_k, round(rr, 6) AS rr FROM m",
    "mrr": f"{_RANKED} SELECT round(avg(rr), 6) AS mrr FROM m",
    "set_f1": """SELECT lang, round(coalesce(2 * count(*) FILTER (WHERE n_chars >= 1000 AND quality = 1) / nullif(count(*) FILTER (WHERE n_chars >= 1000) + count(*) FILTER (WHERE quality = 1), 0), 0), 6) AS f1
        FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
    "percentile_floor": "WITH l AS (SELECT lang, list_sort(list(n_chars)) AS v FROM documents GROUP BY lang) SELECT lang, v[least(len(v) - 1, floor(len(v) * 0.95)::BIGINT) + 1] AS p95 FROM l",
    "exact_duplicates": "SELECT md5(text) AS grp, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "shape_duplicates": "SELECT md5(regexp_replace(regexp_replace(text, '[0-9]+', 'N', 'g'), '[A-Za-z]+', 'I', 'g')) AS grp, count(*) AS n, min(conv_id * 1000 + turn) AS first_id, max(conv_id * 1000 + turn) AS last_id FROM conversations GROUP BY 1 HAVING count(*) > 1",
    "duplicate_paragraphs": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT md5(trim(line)) AS line, count(*) AS n, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM l WHERE length(trim(line)) >= 40 GROUP BY 1 HAVING count(*) > 1",
    "benchmark_overlap": f"""WITH d AS (SELECT doc_id, {_W.format('text')} AS w FROM documents), b AS (SELECT item_id, {_W.format('text')} AS w FROM benchmark),
        ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS s FROM d, unnest(range(1, len(w) - 6)) AS r(i)), bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS s FROM b, unnest(range(1, len(w) - 6)) AS r(i))
        SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY ALL""",
    "set_jaccard": f"{_PREV} SELECT conv_id, turn, round(CASE WHEN len(terms) + len(before) = 0 THEN 0 ELSE len(list_intersect(terms, before)) / len(list_distinct(list_concat(terms, before))) END, 6) AS jaccard FROM b WHERE before IS NOT NULL",
    "bottomk_sketch_jaccard": f"""WITH t AS (SELECT conv_id, turn, list_sort(list_distinct(list_transform({_W.format("text")}, lambda x: md5(x))))[1:64] AS sk FROM conversations),
        b AS (SELECT *, lag(sk) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t), u AS (SELECT *, list_sort(list_distinct(list_concat(sk, before)))[1:64] AS un FROM b WHERE before IS NOT NULL)
        SELECT conv_id, turn, round(CASE WHEN len(un) = 0 THEN 0 ELSE len(list_filter(un, lambda x: list_contains(sk, x) AND list_contains(before, x))) / len(un) END, 6) AS similarity FROM u""",
    "term_cosine": f"{_PREV} SELECT conv_id, turn, round(len(list_intersect(terms, before)) / sqrt(len(terms) * len(before)), 6) AS cosine FROM b WHERE len(terms) > 0 AND len(before) > 0",
}
