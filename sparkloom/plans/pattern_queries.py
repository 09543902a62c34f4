"""Pattern queries over documents, pages and conversations, and the incremental fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import patterns
from sparkloom.functions import text as T
from sparkloom.operators import incremental, mentions
from sparkloom.session import read_table

PHRASES = {"the": 1, "of the": 3, "in": 1, "and the": 2, "to": 1, "is": 1, "in the end": 4}
#: The old part of the events; what comes after is folded in.
SPLIT_AT = "2024-01-16"

_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
_LINES = "SELECT {key}, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT {key}, regexp_split_to_array(text, '\\r?\\n') AS ls FROM {table} WHERE text IS NOT NULL)"


def line_pattern_scan(spark: SparkSession, d: str) -> DataFrame:
    hits = patterns.line_hits(read_table(spark, d, "documents"), "doc_id", patterns.LINE_RULES)
    return patterns.hits_by_rule(hits, "doc_id")


def line_pattern_hits(spark: SparkSession, d: str) -> DataFrame:
    return patterns.line_hits(read_table(spark, d, "documents"), "doc_id", patterns.LINE_RULES)


def secret_like_scan(spark: SparkSession, d: str) -> DataFrame:
    return patterns.secret_hits(read_table(spark, d, "documents"), "doc_id")


def html_checks(spark: SparkSession, d: str) -> DataFrame:
    return patterns.page_checks(read_table(spark, d, "pages"))


def html_duplicate_titles(spark: SparkSession, d: str) -> DataFrame:
    titles = patterns.titles(read_table(spark, d, "pages"))
    return titles.groupBy("title").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page")).where("n_pages > 1")


def prompt_static_score(spark: SparkSession, d: str) -> DataFrame:
    asked = read_table(spark, d, "conversations").where("role <> 'assistant' AND text IS NOT NULL")
    scores = patterns.prompt_scores(F.col("text"))
    return asked.select("conv_id", "turn", patterns.static_score(scores).alias("score"), F.size(F.array_compact(F.array(*scores.values()))).alias("n_dimensions"))


def phrase_rules(spark: SparkSession, d: str) -> DataFrame:
    """Weight of the phrases in each turn, places that a longer phrase claims left out."""
    found = patterns.phrase_hits(F.col("words"), PHRASES)
    turns = read_table(spark, d, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("words")).where("size(words) > 0")
    out = turns.select("conv_id", "turn", F.explode(found).alias("hit"))
    return out.groupBy("conv_id", "turn").agg(F.count("*").alias("n_hits"), F.sum("hit.weight").alias("weight"), F.min("hit.start").alias("first_word"))


def ngram_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of benchmark items in documents: each item whole, in pieces of eight words, and its first three words, which give way
    where the longer piece stands."""
    w = T.words(F.col("text"))
    items = read_table(spark, d, "benchmark").select(w.alias("w")).where("size(w) > 0")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 8).cast("int")), lambda k: F.slice(F.col("w"), k * 8 + 1, 8))
    phrases = items.select(F.explode(F.array_append(pieces, F.slice("w", 1, 3))).alias("words"))
    docs = read_table(spark, d, "documents").select("doc_id", w.alias("words"))
    return mentions.mentions(docs, phrases, "doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first_word"))


def incremental_equals_full(spark: SparkSession, d: str) -> DataFrame:
    """Counts by user and type from a state of the old events with the new ones folded in."""
    events = read_table(spark, d, "events").select("user_id", "event_type", "ts", "value")
    keys = ["user_id", "event_type"]
    state = incremental.summarise(events.where(F.col("ts") < SPLIT_AT), keys, "ts", "value")
    new = incremental.summarise(events.where(F.col("ts") >= SPLIT_AT), keys, "ts", "value")
    return incremental.fold(state, new, keys).select(*keys, "n", F.round("total", 4).alias("total"), F.col("last").alias("last_ts"))


QUERIES = {
    f.__name__: f
    for f in (line_pattern_scan, line_pattern_hits, secret_like_scan, html_checks, html_duplicate_titles, prompt_static_score, phrase_rules, ngram_mentions, incremental_equals_full)
}


def _quoted(text: str) -> str:
    return text.replace("'", "''")


_HITS = f"l AS ({_LINES.format(key='doc_id', table='documents')}), h AS (" + " UNION ALL ".join(
    f"SELECT doc_id, line_no, '{name}' AS rule FROM l WHERE regexp_matches(line, '{_quoted(regex)}')" for name, regex in patterns.LINE_RULES.items()
) + ")"
_PLACES = " UNION ALL ".join(
    f"SELECT conv_id, turn, unnest(list_filter(range(0, len(w)), lambda i: {' AND '.join(f'coalesce(w[i + {k + 1}] = {chr(39)}{p}{chr(39)}, false)' for k, p in enumerate(phrase.split()))})) AS start,"
    f" {len(phrase.split())} AS size, {weight} AS weight FROM t"
    for phrase, weight in PHRASES.items()
)
_SCORES = """CASE WHEN n < 5 THEN 40 WHEN n > 400 THEN 60 ELSE 100 END, CASE WHEN regexp_matches(text, '[0-9]|"[^"]+"') THEN 100 ELSE 50 END,
    CASE WHEN contains(text, '?') THEN 100 ELSE 60 END, CASE WHEN n >= 40 THEN CASE WHEN contains(text, chr(10)) THEN 100 ELSE 30 END END"""

ORACLES = {
    "line_pattern_hits": f"WITH {_HITS} SELECT doc_id, line_no, rule FROM h",
    "line_pattern_scan": f"""WITH {_HITS}, k AS (SELECT rule, doc_id, count(*) AS n FROM h GROUP BY ALL)
        SELECT rule, sum(n)::BIGINT AS n_hits, count(*) AS n_keys, array_to_string(list_sort(list(doc_id))[1:12], ',') AS first_keys FROM k GROUP BY rule""",
    "secret_like_scan": f"""WITH l AS ({_LINES.format(key='doc_id', table='documents')}),
        s AS (SELECT doc_id, line_no, regexp_extract(line, '{_quoted(patterns.SECRET)}', 1) AS kind, regexp_extract(line, '{_quoted(patterns.SECRET)}', 2) AS v FROM l WHERE regexp_matches(line, '{_quoted(patterns.SECRET)}'))
        SELECT doc_id, line_no, lower(kind) AS kind, length(v) AS size, substr(sha256(v), 1, 16) AS fingerprint FROM s""",
    "html_checks": r"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages)
        SELECT page_id, NOT regexp_matches(html, '(?is)<title[^>]*>[^<]*[^<\s][^<]*</title>') AS no_title, NOT regexp_matches(html, '(?i)<html[^>]* lang=') AS no_lang,
        NOT regexp_matches(html, '(?i)<meta[^>]*name=.viewport') AS no_viewport, NOT regexp_matches(html, '(?i)<meta[^>]*name=.description') AS no_description,
        NOT regexp_matches(html, '(?i)<link[^>]*rel=.canonical') AS no_canonical, NOT regexp_matches(html, '(?i)<h1[ >]') AS no_heading,
        len(list_filter(regexp_extract_all(html, '(?i)<img[^>]*>'), lambda t: NOT regexp_matches(t, '(?i) alt='))) AS images_without_alt FROM p""",
    "html_duplicate_titles": """WITH t AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)) AS title FROM pages)
        SELECT title, count(*) AS n_pages, min(page_id) AS first_page, max(page_id) AS last_page FROM t WHERE title <> '' GROUP BY title HAVING count(*) > 1""",
    "prompt_static_score": f"""WITH t AS (SELECT conv_id, turn, text, len(list_filter(regexp_split_to_array(text, '[^\\w]+'), lambda w: w <> '')) AS n
            FROM conversations WHERE role <> 'assistant' AND text IS NOT NULL),
        s AS (SELECT conv_id, turn, list_filter([{_SCORES}], lambda x: x IS NOT NULL) AS held FROM t)
        SELECT conv_id, turn, floor(list_sum(held)::DOUBLE / len(held) + 0.5)::INTEGER AS score, len(held) AS n_dimensions FROM s""",
    "phrase_rules": f"""WITH t AS (SELECT conv_id, turn, {_WORDS.format('text')} AS w FROM conversations), p AS ({_PLACES})
        SELECT conv_id, turn, count(*) AS n_hits, sum(weight)::BIGINT AS weight, min(start) AS first_word FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.conv_id = p.conv_id
            AND q.turn = p.turn AND q.size > p.size AND q.start < p.start + p.size AND p.start < q.start + q.size) GROUP BY conv_id, turn""",
    "ngram_mentions": f"""WITH b AS (SELECT {_WORDS.format('text')} AS w FROM benchmark), p AS (SELECT unnest(list_append(list_transform(range(0, (len(w) - 1) // 8 + 1), lambda k: w[k * 8 + 1:k * 8 + 8]), w[1:3])) AS words FROM b WHERE len(w) > 0),
        terms AS (SELECT DISTINCT array_to_string(words, ' ') AS term, len(words) AS n FROM p), d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS first FROM d), k AS (SELECT doc_id, i, n, term FROM g JOIN (SELECT *, string_split(term, ' ')[1] AS first FROM terms) USING (first)),
        h AS (SELECT doc_id, i - 1 AS pos, n, term FROM k JOIN d USING (doc_id) WHERE term = array_to_string(w[i:i + n - 1], ' ')),
        o AS (SELECT doc_id, list({{'pos': pos, 'n': n, 'term': term}} ORDER BY pos, n DESC) AS c FROM h GROUP BY doc_id),
        f AS (SELECT doc_id, list_reduce(c, lambda s, x: CASE WHEN x.pos < s.last THEN s ELSE {{'last': x.pos + x.n, 'kept': list_append(s.kept, x)}} END, {{'last': 0::BIGINT, 'kept': []::STRUCT(pos BIGINT, n BIGINT, term VARCHAR)[]}}).kept AS m FROM o),
        e AS (SELECT doc_id, unnest(m) AS x FROM f) SELECT doc_id, x.term AS term, count(*) AS n, min(x.pos) AS first_word FROM e GROUP BY ALL""",
    "incremental_equals_full": """SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total, max(ts) AS last_ts FROM events GROUP BY user_id, event_type""",
}
