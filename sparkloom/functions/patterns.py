"""Pattern operators over lines, pages and prompts: column expressions only, one pass over the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Line rules: name -> regular expression (ASCII, understood alike by Java's and DuckDB's engines).
LINE_RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "url": r"https?://[^ ]+",
    "ip-address": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "long-number": r"\b[0-9]{9,}\b",
    "work-marker": r"\b(TODO|FIXME|HACK|XXX)\b",
    "license-word": r"(?i)\b(licensed|license|copyright)\b",
}
#: key = value, where the key is a word for a secret.
SECRET = r"(?i)\b(password|passwd|secret|token|api[_-]?key)\b *[:=] *[\"']?([^ \"',;]{6,})"
#: path, line and column of Python's and of V8's stack lines.
PYTHON_FRAME = r'File "([^"]+)", line ([0-9]+)'
V8_FRAME = r"at (?:.*\()?([^():]+):([0-9]+):([0-9]+)\)?$"


def lines(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no from 1, line) of every line; null texts have none."""
    return rows.select(key, F.posexplode(F.split(text, "\r?\n")).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line")


def line_hits(rows: DataFrame, key: str, rules: dict[str, str], text: str = "text") -> DataFrame:
    """(key, line_no, rule): all rules are tried while a line is at hand, so there is no join of lines and rules."""
    found = F.array_compact(F.array(*[F.when(F.col("line").rlike(regex), F.lit(name)) for name, regex in rules.items()]))
    return lines(rows, key, text).select(key, "line_no", F.explode(found).alias("rule"))


def hits_by_rule(hits: DataFrame, key: str, most: int = 12) -> DataFrame:
    """(rule, n_hits, n_keys, first_keys): hits and distinct keys of each rule, with the smallest few keys.

    Keys are made distinct before they are gathered, and only the smallest are: a window keeps `most` of them in each
    partition before it deals them out."""
    per_key = hits.groupBy("rule", key).agg(F.count("*").alias("n"))
    first = per_key.withColumn("rk", F.row_number().over(Window.partitionBy("rule").orderBy(key))).where(F.col("rk") <= most)
    samples = first.groupBy("rule").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("first_keys"))
    counts = per_key.groupBy("rule").agg(F.sum("n").alias("n_hits"), F.count("*").alias("n_keys"))
    return counts.join(samples, "rule")


def secret_hits(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, kind, size, fingerprint): values are reported by length and hash, never as they are."""
    found = lines(rows, key, text).where(F.col("line").rlike(SECRET))
    value = F.regexp_extract("line", SECRET, 2)
    return found.select(
        key, "line_no", F.lower(F.regexp_extract("line", SECRET, 1)).alias("kind"), F.length(value).alias("size"), F.substring(F.sha2(value, 256), 1, 16).alias("fingerprint")
    )


def attributes(tag: Column) -> Column:
    """A tag's quoted attributes as a map, names lower-cased; of equal names the first counts."""
    pairs = F.regexp_extract_all(tag, F.lit(r"([A-Za-z-]+)=\"([^\"]*)\""), F.lit(0))
    named = F.transform(pairs, lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("k"), F.regexp_extract(p, r'="([^"]*)"', 1).alias("v")))
    first = F.filter(named, lambda x, n: F.array_position(F.transform(named, lambda y: y["k"]), x["k"]) == n + 1)
    return F.map_from_entries(first)


def page_checks(pages: DataFrame) -> DataFrame:
    """Static checks of each page: what is missing, and images without alternative text. A null page misses all."""
    html = F.coalesce("html", F.lit(""))
    has = lambda regex: html.rlike(regex)
    images = F.regexp_extract_all(html, F.lit(r"(?i)<img[^>]*>"), F.lit(0))
    return pages.select(
        "page_id",
        (~has(r"(?is)<title[^>]*>[^<]*[^<\s][^<]*</title>")).alias("no_title"),
        (~has(r"(?i)<html[^>]* lang=")).alias("no_lang"),
        (~has(r"(?i)<meta[^>]*name=.viewport")).alias("no_viewport"),
        (~has(r"(?i)<meta[^>]*name=.description")).alias("no_description"),
        (~has(r"(?i)<link[^>]*rel=.canonical")).alias("no_canonical"),
        (~has(r"(?i)<h1[ >]")).alias("no_heading"),
        F.size(F.filter(images, lambda t: ~t.rlike(r"(?i) alt="))).alias("images_without_alt"),
    )


def titles(pages: DataFrame) -> DataFrame:
    """(page_id, title) of pages with a title that isn't blank."""
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)</title>", 1))
    return pages.select("page_id", title.alias("title")).where("title <> ''")


def stack_frames(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, frame_no from 1, path, line, col) of the stack lines in a text, in order."""
    parsed = lines(rows, key, text).select(
        key,
        "line_no",
        F.when(F.col("line").rlike(PYTHON_FRAME), F.struct(F.regexp_extract("line", PYTHON_FRAME, 1).alias("path"), F.regexp_extract("line", PYTHON_FRAME, 2).cast("int").alias("line"), F.lit(None).cast("int").alias("col")))
        .when(F.col("line").rlike(V8_FRAME), F.struct(F.regexp_extract("line", V8_FRAME, 1).alias("path"), F.regexp_extract("line", V8_FRAME, 2).cast("int").alias("line"), F.regexp_extract("line", V8_FRAME, 3).cast("int").alias("col")))
        .alias("frame"),
    ).where("frame IS NOT NULL")
    order = Window.partitionBy(key).orderBy("line_no")
    return parsed.select(key, F.row_number().over(order).alias("frame_no"), "frame.path", "frame.line", "frame.col")


def prompt_scores(text: Column) -> dict[str, Column]:
    """Scores of 0 to 100 of some dimensions of a prompt; null where a dimension doesn't apply."""
    words = F.size(F.filter(F.split(text, r"[^\w]+"), lambda w: w != ""))
    return {
        "length": F.when(words < 5, 40).when(words > 400, 60).otherwise(100),
        "specific": F.when(text.rlike(r"[0-9]|\"[^\"]+\""), 100).otherwise(50),
        "asks": F.when(text.rlike(r"\?"), 100).otherwise(60),
        "structure": F.when(words >= 40, F.when(text.contains("\n"), 100).otherwise(30)),
    }


def static_score(scores: dict[str, Column]) -> Column:
    """The rounded mean of the dimensions that apply."""
    held = F.array_compact(F.array(*[s.cast("double") for s in scores.values()]))
    return F.floor(F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held) + 0.5).cast("int")


def _phrase_places(words: Column, own: list[str], phrase: str, weight: int) -> Column:
    def here(i: Column) -> Column:
        test = F.get(words, i) == own[0]
        for k, word in enumerate(own[1:], 1):
            test = test & (F.get(words, i + k) == word)
        return F.coalesce(test, F.lit(False))

    starts = F.filter(F.sequence(F.lit(0), F.size(words)), here)
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(len(own)).alias("size"), F.lit(phrase).alias("phrase"), F.lit(weight).alias("weight")))


def phrase_hits(words: Column, phrases: dict[str, int]) -> Column:
    """Array of (start, size, phrase, weight): places of the phrases; a place that a longer phrase overlaps is claimed by it."""
    parts = [_phrase_places(words, phrase.split(" "), phrase, weight) for phrase, weight in phrases.items()]
    every = F.flatten(F.array(*parts))
    claims = lambda x, y: (y["size"] > x["size"]) & (y["start"] < x["start"] + x["size"]) & (x["start"] < y["start"] + y["size"])
    return F.filter(every, lambda x: ~F.exists(every, lambda y: claims(x, y)))
