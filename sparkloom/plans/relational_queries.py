"""Joins, history, mining, scoring, findings and folds over the business tables.

Orders stand for commits (customer = author, order date = time), lineitems for the files they touch (part = path), parts
and suppliers for modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom import streaming
from sparkloom.operators import findings, incremental, joins, mining, ranking
from sparkloom.operators.graph import new_folder
from sparkloom.session import read_table


def _year_parts(spark: SparkSession, d: str, year: int) -> DataFrame:
    """(part, digest): parts shipped in a year with a digest of their quantity."""
    li = read_table(spark, d, "lineitem").where(F.year("l_shipdate") == year)
    return li.groupBy(F.col("l_partkey").alias("part")).agg(F.md5(F.sum("l_quantity").cast("long").cast("string")).alias("digest"))


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return joins.snapshot_diff(_year_parts(spark, d, 1997), _year_parts(spark, d, 1998), "part", "digest")


def rename_pairs(spark: SparkSession, d: str) -> DataFrame:
    return joins.renames(_year_parts(spark, d, 1997), _year_parts(spark, d, 1998), "part", "digest")


def baseline_status(spark: SparkSession, d: str) -> DataFrame:
    return joins.baseline_status(_year_parts(spark, d, 1998), _year_parts(spark, d, 1997), "part")


def baseline_fixed(spark: SparkSession, d: str) -> DataFrame:
    return baseline_status(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Each order's span from its date to its last shipping, in seconds, by customer."""
    li = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("end"))
    return read_table(spark, d, "orders").join(li, "o_orderkey").select(F.col("o_custkey").alias("cust"), "o_orderkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("start"), "end").where("start <= end")


def interval_innermost(spark: SparkSession, d: str) -> DataFrame:
    """For each order date, the shortest order of the same customer that was open then."""
    spans = _spans(spark, d)
    points = spans.select("cust", F.col("o_orderkey").alias("point"), F.col("start").alias("at"))
    return joins.innermost(points, spans, ["cust"], "point", "at", "o_orderkey", "start", "end", 30 * 86400)


def interval_members(spark: SparkSession, d: str) -> DataFrame:
    """How many orders of the same customer began while each was open."""
    spans = _spans(spark, d)
    points = spans.select("cust", F.col("start").alias("at"), F.col("o_orderkey").alias("point"))
    return joins.interval_join(points, spans, ["cust"], "at", "start", "end", 30 * 86400).groupBy("o_orderkey").agg(F.count("*").alias("n"))


def ladder_link(spark: SparkSession, d: str) -> DataFrame:
    """A supplier for each customer: the only one of its nation with its balance band, the only one of the nation, the
    only one of the region in its band; else none."""
    nation = read_table(spark, d, "nation").select(F.col("n_nationkey"), F.col("n_regionkey").alias("region"))
    c = read_table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("cn"), "region", F.floor(F.col("c_acctbal") / 1000).alias("cb"))
    s = read_table(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("supp"), F.col("s_nationkey").alias("sn"), F.col("region").alias("sr"), F.floor(F.col("s_acctbal") / 1000).alias("sb"))
    rungs = [("nation and band", ["cn", "cb"], ["sn", "sb"], 0.8), ("nation", ["cn"], ["sn"], 0.65), ("band", ["region", "cb"], ["sr", "sb"], 0.5)]
    return joins.ladder(c, s, "cust", "supp", rungs).select("cust", "supp", "rung", "confidence")


def unique_suffix(spark: SparkSession, d: str) -> DataFrame:
    """URL paths of two parts, found in all paths by their end."""
    pages = read_table(spark, d, "pages").select(F.regexp_extract("url", r"://([^?#]*)", 1).alias("path"))
    refs = pages.select(F.concat_ws("/", F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1)).alias("ref")).where("ref <> ''")
    return joins.unique_suffix(refs, pages, "ref", "path").where("path IS NOT NULL")


def band_proximity(spark: SparkSession, d: str) -> DataFrame:
    """Errors and purchases of one user less than ten minutes apart."""
    e = read_table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    a = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("at").alias("a"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("at").alias("b"))
    return joins.band_join(a, b, ["user_id"], "a", "b", 600_000_000).select("error_id", "purchase_id")


def anti_unused(spark: SparkSession, d: str) -> DataFrame:
    """Parts that no order of 1998 holds."""
    used = read_table(spark, d, "lineitem").where(F.year("l_shipdate") == 1998).select(F.col("l_partkey").alias("p_partkey"))
    return read_table(spark, d, "part").join(used, "p_partkey", "left_anti").select("p_partkey")


def anti_covered(spark: SparkSession, d: str) -> DataFrame:
    """Returned lines of (part, supplier) pairs that no returned line of another order covers."""
    li = read_table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey", "l_suppkey", "l_orderkey")
    n = li.groupBy("l_partkey", "l_suppkey").agg(F.count_distinct("l_orderkey").alias("orders"))
    return n.where("orders = 1").select("l_partkey", "l_suppkey")


def most_specific_rule(spark: SparkSession, d: str) -> DataFrame:
    brand, kind = F.col("p_brand"), F.upper("p_type")
    rules = [("allow", 0, False, F.lit(True)), ("forbid", 1, True, brand.startswith("Brand#1")), ("allow", 2, False, brand.startswith("Brand#1") & kind.contains("STEEL")), ("forbid", 2, True, kind.contains("BRASS"))]
    return read_table(spark, d, "part").select("p_partkey", joins.most_specific(rules).alias("verdict"))


def last_match_wins(spark: SparkSession, d: str) -> DataFrame:
    rules = [(".*", "keep"), ("/en/", "drop"), (r"/en/[0-9]*7", "keep")]
    return read_table(spark, d, "pages").select("page_id", joins.last_match(F.col("url"), rules).alias("verdict"))


def compare_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Parts by whether most of their lines were kept, 1997 against 1998."""
    def year(y: int) -> DataFrame:
        li = read_table(spark, d, "lineitem").where(F.year("l_shipdate") == y)
        return li.groupBy(F.col("l_partkey").alias("part")).agg((F.count_if(F.col("l_returnflag") == "R") * 2 < F.count("*")).alias("passed"))

    return joins.compare_outcomes(year(1997), year(1998), "part", "passed").groupBy("change").agg(F.count("*").alias("n"))


# history


def _commits(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").join(read_table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))


def churn(spark: SparkSession, d: str) -> DataFrame:
    return _commits(spark, d).groupBy(F.col("l_partkey").alias("path")).agg(
        F.count_distinct("o_orderkey").alias("commits"), F.count_distinct("o_custkey").alias("authors"), F.sum(F.col("l_quantity").cast("long")).alias("added"), F.max("o_orderdate").cast("string").alias("last")
    )


def monthly_clusters(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("category")).agg(
        F.count("*").alias("n"), F.count_distinct("o_custkey").alias("authors")
    )


def fix_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of urgent and high orders, as fixes, by part; parts of three orders or more."""
    fix = F.col("o_orderpriority").rlike("^[12]-")
    out = _commits(spark, d).groupBy(F.col("l_partkey").alias("path")).agg(F.count("*").alias("n"), F.count_if(fix).alias("fixes"))
    return out.where("n >= 3").select("path", "fixes", findings.ratio(F.col("fixes"), F.col("n")).alias("percent"))


def commit_search(spark: SparkSession, d: str) -> DataFrame:
    """All conditions together: time, author, words of the category."""
    o = read_table(spark, d, "orders").where(F.col("o_orderdate").between("1997-01-01", "1997-12-31") & (F.col("o_custkey") > 10))
    terms = F.array(F.lit("urgent"))
    return o.where(F.forall(terms, lambda t: F.contains(F.lower("o_orderpriority"), t))).select("o_orderkey")


def finding_introduction(spark: SparkSession, d: str) -> DataFrame:
    """The month that each part's present run of months began, for parts shipped in the last month."""
    li = read_table(spark, d, "lineitem")
    months = li.select(F.col("l_partkey").alias("part"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int").alias("ord")).distinct()
    return joins.first_seen(months, "part", "ord")


def trend_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Days on which an event type's count differs from the day before, the last 10 of each."""
    daily = read_table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    out = findings.trend_points(daily, ["event_type"], "day", F.col("n").cast("string"), 10)
    return out.select("event_type", F.col("day").cast("string").alias("day"), "n")


def latest_per_check(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user and type, stale if older than the user's last event by a day."""
    e = read_table(spark, d, "events")
    last = e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    seen = F.max("m.ts").over(Window.partitionBy("user_id"))
    return last.select("user_id", "event_type", F.col("m.event_id").alias("event_id"), (F.unix_seconds(seen.cast("timestamp")) - F.unix_seconds(F.col("m.ts").cast("timestamp")) > 86400).alias("stale"))


# mining


def _orders_by_segment(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return read_table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))


def dominant_value_share(spark: SparkSession, d: str) -> DataFrame:
    return mining.dominant(_orders_by_segment(spark, d), ["c_mktsegment", "c_nationkey"], "o_orderpriority")


def convention_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers whose line status departs from a status that four fifths of the supplier's lines of a year share."""
    li = read_table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), "l_orderkey", "l_linestatus")
    out = mining.outliers(li, ["l_suppkey", "year"], "l_linestatus", "l_orderkey", 0.55)
    return out.groupBy("l_suppkey", "year", "expected").agg(F.count("*").alias("n"))


def project_confidence(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    return mining.dominant(p, ["p_brand"], "p_type").select("p_brand", "p_type", "peers", "confidence")


def size_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Documents of three times their language's median size or more, in its top tenth."""
    docs = read_table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return mining.size_outliers(docs, ["lang"], "doc_id", "n_chars").select("lang", "doc_id", "n_chars")


def ownership_mode(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem").join(read_table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return mining.ownership(li.select(F.col("l_partkey").alias("part"), F.col("s_nationkey").alias("nation")), "nation", "part")


def responsibility_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Users of many more event types a day than their peers of the day."""
    e = read_table(spark, d, "events").select(F.to_date("ts").cast("string").alias("day"), "user_id", "event_type")
    return mining.count_outliers(e, ["day"], "user_id", "event_type").select("day", "user_id", "n_values")


def rare_values(spark: SparkSession, d: str) -> DataFrame:
    return mining.rare_values(_orders_by_segment(spark, d), ["c_nationkey", "c_mktsegment"], "o_orderpriority").select("c_nationkey", "c_mktsegment", "o_orderpriority", "n", "share")


# scoring


def complexity_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Orders by their number of lines, with how many are within the limit of 4."""
    n = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    return n.groupBy("lines").agg(F.count("*").alias("n"), F.count_if(F.col("lines") <= 4).alias("within"))


def severity_bands(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return n.groupBy(findings.band(F.col("q"), 200, 100, 50).alias("band")).agg(F.count("*").alias("n"))


def _debt(spark: SparkSession, d: str) -> DataFrame:
    sev = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_linestatus") == "O", "medium").otherwise("low")
    rows = read_table(spark, d, "lineitem").where("l_quantity > 25").select(
        F.col("l_partkey").alias("file"), F.col("l_returnflag").alias("dimension"), sev.alias("severity"), F.when(F.col("l_returnflag") == "R", 1.5).otherwise(1.0).alias("weight"),
        F.col("l_quantity").alias("value"), F.lit(25.0).alias("threshold"),
    )
    return findings.debt_points(rows)


def debt_points(spark: SparkSession, d: str) -> DataFrame:
    return findings.debt_by_file(_debt(spark, d), "file", "dimension").select("file", F.round("points", 4).alias("points"), "dimensions")


def debt_priority_levels(spark: SparkSession, d: str) -> DataFrame:
    by = findings.debt_by_file(_debt(spark, d), "file", "dimension").withColumn("points", F.round("points", 4))
    return ranking.rank_bands(by, "points", "file").groupBy("level").agg(F.count("*").alias("n"), F.round(F.sum("points"), 2).alias("points"))


def change_complexity_quadrant(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("file")).agg(F.count_distinct("l_orderkey").alias("churn"), F.max(F.col("l_quantity").cast("long")).alias("complexity"))
    return findings.quadrants(li, "complexity", "churn").select("file", "quadrant")


def test_gap_risk(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers by orders, balance and returns; 6 and more are kept."""
    li = read_table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supp")).agg(F.count_distinct("l_orderkey").alias("fan_in"), F.count_if(F.col("l_returnflag") == "R").alias("returns"))
    s = read_table(spark, d, "supplier").join(li, F.col("s_suppkey") == F.col("supp"), "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0))).withColumn("returns", F.coalesce("returns", F.lit(0)))
    risk = findings.feature_gap_risk(F.col("fan_in"), {"returns": (F.col("returns") > 100, 4), "broke": (F.col("s_acctbal") < 0, 3), "far": (F.col("s_nationkey") > 12, 2)})
    return s.select("s_suppkey", risk.cast("long").alias("risk")).where("risk >= 6")


def health_status(spark: SparkSession, d: str) -> DataFrame:
    sev = lambda s: F.count_if(F.col("severity") == s)
    n = _debt(spark, d).groupBy("file").agg(sev("critical").alias("c"), sev("high").alias("h"), sev("medium").alias("m"), sev("low").alias("l"))
    return n.select("file", findings.status(F.col("c"), F.col("h"), F.col("m"), F.col("l")).alias("status"))


def coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Labelled share of each source's documents, with its band."""
    docs = read_table(spark, d, "documents").join(read_table(spark, d, "labels").select("doc_id").distinct().withColumn("hit", F.lit(1)), "doc_id", "left")
    n = docs.groupBy("source").agg(F.count("hit").alias("covered"), F.count("*").alias("total"))
    pct = findings.ratio(F.col("covered"), F.col("total"))
    return n.select("source", pct.alias("percent"), findings.coverage_status(pct).alias("status"))


def structural_protection(spark: SparkSession, d: str) -> DataFrame:
    """Customers with an order of 1998 are direct, those who share a nation with one transitive, others none."""
    direct = read_table(spark, d, "orders").where(F.year("o_orderdate") == 1998).select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("direct", F.lit(True))
    c = read_table(spark, d, "customer").join(direct, "c_custkey", "left")
    near = c.where("direct").select("c_nationkey").distinct().withColumn("near", F.lit(True))
    kind = F.when(F.col("direct"), "direct").when(F.col("near"), "transitive").otherwise("none")
    return c.join(near, "c_nationkey", "left").groupBy(kind.alias("protection")).agg(F.count("*").alias("n"))


def component_rank(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supp")).agg(F.count_distinct("l_orderkey").alias("dependents"), F.count_distinct("l_partkey").alias("defines"), F.count("*").alias("inbound"))
    return findings.component_rank(li, {"dependents": 0.5, "defines": 0.3, "inbound": 0.2}).select("supp", "score")


# findings


def _findings(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    big = li.where("l_quantity >= 49").select(
        F.concat(F.lit("big:"), F.col("l_partkey").cast("string")).alias("id"), F.lit("size").alias("category"), F.lit("medium").alias("severity"), F.lit("high").alias("confidence"),
        F.col("l_partkey").cast("string").alias("file"), F.col("l_linenumber").alias("line"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
    )
    cheap = li.where("l_discount >= 0.1").select(
        F.concat(F.lit("discount:"), F.col("l_partkey").cast("string")).alias("id"), F.lit("price").alias("category"), F.when(F.col("l_returnflag") == "R", "high").otherwise("low").alias("severity"),
        F.lit("medium").alias("confidence"), F.col("l_partkey").cast("string").alias("file"), F.lit(None).cast("int").alias("line"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
    )
    return findings.union_all(big, cheap)


def finding_union(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).groupBy("category", "severity").agg(F.count("*").alias("n"))


def finding_unique_ids(spark: SparkSession, d: str) -> DataFrame:
    out = findings.unique_ids(_findings(spark, d), "id", F.col("seq"))
    return out.select("id").distinct()


def finding_sort_rank(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 findings in their total order."""
    rows = _findings(spark, d).groupBy("id", "severity", "confidence", "file", "line").agg(F.count("*").alias("n"))
    return rows.orderBy(*findings.finding_order()).limit(50)


def findings_by_category(spark: SparkSession, d: str) -> DataFrame:
    f = _findings(spark, d)
    return f.groupBy("category").pivot("severity", ["high", "medium", "low"]).count().select("category", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("high", "medium", "low")])


def owasp_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Findings for each standard that their category maps to, standards without findings too."""
    standards = {"size": ["A04", "A05"], "price": ["A01"]}
    mapped = F.coalesce(*[F.when(F.col("category") == c, F.lit(v)) for c, v in standards.items()])
    catalog = spark.createDataFrame([(f"A{n:02d}",) for n in range(1, 11)], "standard string")
    return findings.by_category(_findings(spark, d).select(mapped.alias("standards")), "standards", catalog, "standard")


# folds


def greedy_budget_pack(spark: SparkSession, d: str) -> DataFrame:
    """Each brand's parts by price, taken while 10,000 lasts; parts that don't fit are passed over."""
    p = read_table(spark, d, "part").select("p_brand", "p_partkey", F.round("p_retailprice").cast("long").alias("price"))
    out = ranking.greedy_pack(p, ["p_brand"], "p_partkey", [-F.col("price"), F.col("p_partkey")], "price", 10_000)
    return out.select("p_brand", "used", "n")


def prefix_budget_cut(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part").select("p_brand", "p_partkey", F.round("p_retailprice").cast("long").alias("price"))
    return ranking.prefix_within(p, ["p_brand"], [F.asc("price"), F.asc("p_partkey")], "price", 10_000).select("p_brand", "p_partkey", "used")


def feedback_fold(spark: SparkSession, d: str) -> DataFrame:
    """Each user's confidence, from one half: purchases raise it, errors lower it, within 0 and 1 after each."""
    delta = F.when(F.col("event_type") == "purchase", 0.125).when(F.col("event_type") == "error", -0.125)
    e = read_table(spark, d, "events").where("event_type IN ('purchase', 'error')").select("user_id", F.struct("ts", "event_id").alias("at"), delta.alias("delta"))
    return ranking.ordered_fold(e, ["user_id"], "at", F.to_date("at.ts"), "delta", 0.5, 0.0, 1.0)


def memory_rank(spark: SparkSession, d: str) -> DataFrame:
    """The three turns of each conversation that share most words with a question, with a quarter more for long ones."""
    from sparkloom.functions.text import words

    asked = F.array(*[F.lit(x) for x in ("the", "of", "and", "thing")])
    t = read_table(spark, d, "conversations").withColumn("w", F.array_distinct(words(F.col("text"))))
    score = F.size(F.array_intersect(asked, F.col("w"))) / 4 + F.when(F.length("text") > 200, 0.25).otherwise(0.0)
    t = t.withColumn("score", score).where(F.size(F.array_intersect(asked, F.col("w"))) > 0)
    w = Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn")
    return t.withColumn("rk", F.row_number().over(w)).where("rk <= 3").select("conv_id", "turn", "score")


# extensions: windows over time


def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "event_type", "n")


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream, counted by day and type as its batches come, drained to its end."""
    rows = read_table(spark, d, "events").select("ts", "event_type", "value")
    found = streaming.tumbling_counts(streaming.read_events(spark, d, "events.parquet*", rows), "1 day", "2 days")
    out = streaming.drain(found, new_folder(spark, "stream"))
    return out.select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "event_type", "n", "value")


def versioned_totals(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream, folded batch by batch into versions of the totals by user and type; the last version."""
    rows = read_table(spark, d, "events").select("user_id", "event_type", "ts", "value")
    keys, folder = ["user_id", "event_type"], new_folder(spark, "versions")
    stream = streaming.read_events(spark, d, "events.parquet*", rows)
    streaming.keep_versions(stream, f"{folder}/state", lambda b: incremental.summarise(b, keys, "ts", "value"), lambda a, b: incremental.fold(a, b, keys), f"{folder}/progress")
    return streaming.read_version(spark, f"{folder}/state").select(*keys, "n", F.round("total", 2).alias("total"))


def registry_actions(spark: SparkSession, d: str) -> DataFrame:
    """Documents as entries of a registry that was written when some were other ones, or not there."""
    docs = read_table(spark, d, "documents")
    now = docs.where("doc_id % 11 <> 3").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 4 == 0, 2).otherwise(1).alias("mtime"), F.md5("text").alias("hash"))
    edited = F.when(F.col("doc_id") % 8 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    was = docs.where("doc_id % 13 <> 5").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 == 0, "v1").otherwise("v2").alias("config"), F.col("n_chars").alias("size"), F.lit(1).alias("mtime"), F.md5(edited).alias("hash"))
    return incremental.registry_plan(was, now, "v2")


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.unix_micros(F.col("session_window.start").cast("timestamp")).alias("start"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        snapshot_diff, rename_pairs, baseline_status, baseline_fixed, interval_innermost, interval_members, ladder_link, unique_suffix, band_proximity, anti_unused, anti_covered,
        most_specific_rule, last_match_wins, compare_outcomes, churn, monthly_clusters, fix_share, commit_search, finding_introduction, trend_dedup, latest_per_check,
        dominant_value_share, convention_outliers, project_confidence, size_outliers, ownership_mode, responsibility_outliers, rare_values, complexity_histogram, severity_bands,
        debt_points, debt_priority_levels, change_complexity_quadrant, test_gap_risk, health_status, coverage_ratio, structural_protection, component_rank, finding_union,
        finding_unique_ids, finding_sort_rank, findings_by_category, owasp_mapping, greedy_budget_pack, prefix_budget_cut, feedback_fold, memory_rank, tumbling_counts, stream_counts, versioned_totals, registry_actions, session_windows,
    )
}

_YEARS = """a AS (SELECT l_partkey AS part, md5(sum(l_quantity)::BIGINT::VARCHAR) AS digest FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY ALL),
    b AS (SELECT l_partkey AS part, md5(sum(l_quantity)::BIGINT::VARCHAR) AS digest FROM lineitem WHERE year(l_shipdate) = 1998 GROUP BY ALL)"""
_STATUS = f"WITH {_YEARS}, st AS (SELECT coalesce(b.part, a.part) AS part, CASE WHEN b.part IS NULL THEN 'fixed' WHEN a.part IS NULL THEN 'new' ELSE 'existing' END AS status FROM a FULL JOIN b ON a.part = b.part)"
_SPANS = "sp AS (SELECT o_custkey AS cust, o_orderkey, epoch(o_orderdate)::BIGINT AS s, e FROM orders JOIN (SELECT l_orderkey, max(epoch(l_shipdate)::BIGINT) AS e FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey WHERE epoch(o_orderdate)::BIGINT <= e)"
_DOM = """c AS (SELECT {g}, {v} AS v, count(*) AS n FROM {t} GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY {g})::BIGINT AS peers, row_number() OVER (PARTITION BY {g} ORDER BY n DESC, v) AS rk FROM c),
    dm AS (SELECT {g}, v, n, peers, n / peers AS share, CASE WHEN peers >= 5 AND n / peers >= 0.8 THEN 'high' WHEN peers >= 3 AND n / peers >= 0.66 THEN 'medium' ELSE 'low' END AS confidence FROM r WHERE rk = 1)"""
_OS = "os AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)"
_DEBT = """db AS (SELECT l_partkey AS file, l_returnflag AS dimension, CASE WHEN l_returnflag = 'R' THEN 'high' WHEN l_linestatus = 'O' THEN 'medium' ELSE 'low' END AS severity, l_quantity AS q FROM lineitem WHERE l_quantity > 25),
    dp AS (SELECT *, CASE severity WHEN 'high' THEN 12 WHEN 'medium' THEN 7 ELSE 3 END::DOUBLE * CASE WHEN dimension = 'R' THEN 1.5 ELSE 1.0 END::DOUBLE * (1 + least((q - 25) / 25, 2)) AS points FROM db),
    df AS (SELECT file, round(sum(points) + 2 * (count(DISTINCT dimension) - 1), 4) AS points, count(DISTINCT dimension) AS dimensions FROM dp GROUP BY file)"""
_FIND = """fd AS (SELECT 'big:' || l_partkey AS id, 'size' AS category, 'medium' AS severity, 'high' AS confidence, l_partkey::VARCHAR AS file, l_linenumber AS line FROM lineitem WHERE l_quantity >= 49
    UNION ALL SELECT 'discount:' || l_partkey, 'price', CASE WHEN l_returnflag = 'R' THEN 'high' ELSE 'low' END, 'medium', l_partkey::VARCHAR, NULL FROM lineitem WHERE l_discount >= 0.1)"""

ORACLES = {
    "snapshot_diff": f"WITH {_YEARS} SELECT coalesce(a.part, b.part) AS part, CASE WHEN a.part IS NULL THEN 'added' WHEN b.part IS NULL THEN 'deleted' WHEN a.digest = b.digest THEN 'unchanged' ELSE 'modified' END AS status FROM a FULL JOIN b ON a.part = b.part",
    "rename_pairs": f"""WITH {_YEARS}, gone AS (SELECT digest, min(part) AS p FROM a WHERE part NOT IN (SELECT part FROM b) GROUP BY digest HAVING count(*) = 1),
        came AS (SELECT digest, min(part) AS p FROM b WHERE part NOT IN (SELECT part FROM a) GROUP BY digest HAVING count(*) = 1) SELECT gone.p AS old_key, came.p AS new_key FROM gone JOIN came USING (digest)""",
    "baseline_status": f"{_STATUS} SELECT * FROM st",
    "baseline_fixed": f"{_STATUS} SELECT status, count(*) AS n FROM st GROUP BY status",
    "interval_innermost": f"WITH {_SPANS} SELECT p.o_orderkey AS point, arg_min(x.o_orderkey, (x.e - x.s) * 1000000000 + x.o_orderkey) AS o_orderkey FROM sp p JOIN sp x ON p.cust = x.cust AND p.s BETWEEN x.s AND x.e GROUP BY p.o_orderkey",
    "interval_members": f"WITH {_SPANS} SELECT x.o_orderkey, count(*) AS n FROM sp p JOIN sp x ON p.cust = x.cust AND p.s BETWEEN x.s AND x.e GROUP BY x.o_orderkey",
    "ladder_link": """WITH p AS (SELECT c_custkey AS cust, s_suppkey AS supp, c_nationkey = s_nationkey AS same, floor(c_acctbal / 1000) = floor(s_acctbal / 1000) AS band FROM customer JOIN nation a ON c_nationkey = a.n_nationkey
        JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN supplier ON s_nationkey = b.n_nationkey), g AS (SELECT cust, count(*) FILTER (WHERE same AND band) AS n0, min(supp) FILTER (WHERE same AND band) AS t0, count(*) FILTER (WHERE same) AS n1, min(supp) FILTER (WHERE same) AS t1,
        count(*) FILTER (WHERE band) AS n2, min(supp) FILTER (WHERE band) AS t2 FROM p GROUP BY cust) SELECT cust, CASE WHEN n0 = 1 THEN t0 WHEN n1 = 1 THEN t1 WHEN n2 = 1 THEN t2 END AS supp,
        CASE WHEN n0 = 1 THEN 'nation and band' WHEN n1 = 1 THEN 'nation' WHEN n2 = 1 THEN 'band' END AS rung, CASE WHEN n0 = 1 THEN 0.8 WHEN n1 = 1 THEN 0.65 WHEN n2 = 1 THEN 0.5 END::DOUBLE AS confidence FROM g""",
    "unique_suffix": """WITH p AS (SELECT DISTINCT regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages), r AS (SELECT DISTINCT string_split(path, '/')[-2] || '/' || string_split(path, '/')[-1] AS ref FROM p),
        m AS (SELECT ref, path FROM r JOIN p ON path = ref OR ends_with(path, '/' || ref)) SELECT ref, coalesce(min(path) FILTER (WHERE path = ref), CASE WHEN count(*) = 1 THEN min(path) END) AS path FROM m GROUP BY ref
        HAVING coalesce(min(path) FILTER (WHERE path = ref), CASE WHEN count(*) = 1 THEN min(path) END) IS NOT NULL""",
    "band_proximity": "SELECT a.event_id AS error_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < 600000000",
    "anti_unused": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE year(l_shipdate) = 1998)",
    "anti_covered": "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL HAVING count(DISTINCT l_orderkey) = 1",
    "most_specific_rule": """SELECT p_partkey, CASE WHEN upper(p_type) LIKE '%BRASS%' THEN 'forbid' WHEN p_brand LIKE 'Brand#1%' AND upper(p_type) LIKE '%STEEL%' THEN 'allow' WHEN p_brand LIKE 'Brand#1%' THEN 'forbid' ELSE 'allow' END AS verdict FROM part""",
    "last_match_wins": "SELECT page_id, CASE WHEN regexp_matches(url, '/en/[0-9]*7') THEN 'keep' WHEN regexp_matches(url, '/en/') THEN 'drop' ELSE 'keep' END AS verdict FROM pages",
    "compare_outcomes": """WITH y AS (SELECT l_partkey AS part, year(l_shipdate) AS y, count(*) FILTER (WHERE l_returnflag = 'R') * 2 < count(*) AS ok FROM lineitem GROUP BY ALL), a AS (SELECT * FROM y WHERE y = 1997), b AS (SELECT * FROM y WHERE y = 1998)
        SELECT CASE WHEN b.part IS NULL THEN 'missing' WHEN a.part IS NULL THEN 'new' WHEN b.ok AND NOT a.ok THEN 'improved' WHEN NOT b.ok AND a.ok THEN 'regressed' ELSE 'same' END AS change, count(*) AS n FROM a FULL JOIN b ON a.part = b.part GROUP BY 1""",
    "churn": "SELECT l_partkey AS path, count(DISTINCT o_orderkey) AS commits, count(DISTINCT o_custkey) AS authors, sum(l_quantity::BIGINT)::BIGINT AS added, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "monthly_clusters": "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS category, count(*) AS n, count(DISTINCT o_custkey) AS authors FROM orders GROUP BY 1, 2",
    "fix_share": "SELECT l_partkey AS path, count(*) FILTER (WHERE regexp_matches(o_orderpriority, '^[12]-')) AS fixes, floor(count(*) FILTER (WHERE regexp_matches(o_orderpriority, '^[12]-')) * 1000 / count(*) + 0.5) / 10 AS percent FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) >= 3",
    "commit_search": "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN '1997-01-01' AND '1997-12-31' AND o_custkey > 10 AND contains(lower(o_orderpriority), 'urgent')",
    "finding_introduction": """WITH m AS (SELECT DISTINCT l_partkey AS part, (year(l_shipdate) * 12 + month(l_shipdate))::INTEGER AS ord FROM lineitem), s AS (SELECT *, lag(ord) OVER (PARTITION BY part ORDER BY ord) AS b FROM m)
        SELECT part, max(ord) FILTER (WHERE b IS NULL OR b < ord - 1) AS introduced FROM s GROUP BY part HAVING max(ord) = (SELECT max(ord) FROM m)""",
    "trend_dedup": """WITH c AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS p FROM c),
        k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS rk FROM l WHERE p IS NULL OR p <> n) SELECT event_type, day::VARCHAR AS day, n FROM k WHERE rk <= 10""",
    "latest_per_check": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rk FROM events), l AS (SELECT * FROM r WHERE rk = 1)
        SELECT user_id, event_type, event_id, floor(epoch(max(ts) OVER (PARTITION BY user_id))) - floor(epoch(ts)) > 86400 AS stale FROM l""",
    "dominant_value_share": f"WITH {_OS}, {_DOM.format(g='c_mktsegment, c_nationkey', v='o_orderpriority', t='os')} SELECT c_mktsegment, c_nationkey, v AS o_orderpriority, n, peers, round(share, 6) AS share, confidence FROM dm",
    "convention_outliers": f"""WITH li AS (SELECT l_suppkey, year(l_shipdate) AS year, l_orderkey, l_linestatus FROM lineitem), {_DOM.format(g='l_suppkey, year', v='l_linestatus', t='li')}
        SELECT li.l_suppkey, li.year::INTEGER AS year, v AS expected, count(*) AS n FROM li JOIN dm ON li.l_suppkey = dm.l_suppkey AND li.year = dm.year WHERE peers >= 3 AND share >= 0.55 AND l_linestatus <> v GROUP BY ALL""",
    "project_confidence": f"WITH {_DOM.format(g='p_brand', v='p_type', t='part')} SELECT p_brand, v AS p_type, peers, confidence FROM dm",
    "size_outliers": """WITH m AS (SELECT *, median(n_chars) OVER (PARTITION BY lang) AS md, count(*) OVER (PARTITION BY lang) AS peers, cume_dist() OVER (PARTITION BY lang ORDER BY n_chars) AS cd FROM documents)
        SELECT lang, doc_id, n_chars FROM m WHERE peers >= 5 AND n_chars >= greatest(md * 3, 300) AND cd >= 0.9""",
    "ownership_mode": """WITH c AS (SELECT l_partkey AS part, s_nationkey AS nation, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, nation) AS rk, sum(n) OVER (PARTITION BY part) AS t FROM c)
        SELECT part, nation AS owner, n, round(n / t, 6) AS share FROM r WHERE rk = 1""",
    "responsibility_outliers": """WITH k AS (SELECT (ts::DATE)::VARCHAR AS day, user_id, count(DISTINCT event_type) AS n_values FROM events GROUP BY ALL), m AS (SELECT day, median(n_values) AS md FROM k GROUP BY day)
        SELECT k.day, user_id, n_values FROM k JOIN m ON k.day = m.day WHERE n_values >= greatest(md + 3, 4)""",
    "rare_values": f"""WITH {_OS}, c AS (SELECT c_nationkey, c_mktsegment, o_orderpriority, count(*) AS n FROM os GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY c_nationkey, c_mktsegment) AS p FROM c)
        SELECT c_nationkey, c_mktsegment, o_orderpriority, n, round(n / p, 6) AS share FROM s WHERE p >= 3 AND round(n / p, 6) <= 0.2""",
    "complexity_histogram": "WITH l AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) SELECT lines, count(*) AS n, count(*) FILTER (WHERE lines <= 4) AS within FROM l GROUP BY lines",
    "severity_bands": "WITH l AS (SELECT l_orderkey, sum(l_quantity::BIGINT) AS q FROM lineitem GROUP BY 1) SELECT CASE WHEN q >= 200 THEN 'high' WHEN q >= 100 THEN 'medium' WHEN q >= 50 THEN 'low' ELSE 'info' END AS band, count(*) AS n FROM l GROUP BY 1",
    "debt_points": f"WITH {_DEBT} SELECT * FROM df",
    "debt_priority_levels": f"""WITH {_DEBT}, r AS (SELECT *, row_number() OVER (ORDER BY points DESC, file) AS rk, count(*) OVER () AS n, quantile_cont(points, 0.75) OVER () AS edge FROM df)
        SELECT CASE WHEN rk <= least(ceil(n * 0.05), 10) AND points >= 40 THEN 'high' WHEN points >= edge AND points >= 15 THEN 'medium' ELSE 'low' END AS level, count(*) AS n, round(sum(points), 2) AS points FROM r GROUP BY 1""",
    "change_complexity_quadrant": """WITH f AS (SELECT l_partkey AS file, count(DISTINCT l_orderkey) AS churn, max(l_quantity::BIGINT) AS complexity FROM lineitem GROUP BY 1), m AS (SELECT median(complexity) AS mc, median(churn) AS mh FROM f)
        SELECT file, CASE WHEN complexity > mc AND churn > mh THEN 'refactor' WHEN complexity > mc THEN 'watch' WHEN churn > mh THEN 'active' ELSE 'calm' END AS quadrant FROM f, m""",
    "test_gap_risk": """WITH l AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS f, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
        k AS (SELECT s_suppkey, least(coalesce(f, 0), 10) + CASE WHEN coalesce(r, 0) > 100 THEN 4 ELSE 0 END + CASE WHEN s_acctbal < 0 THEN 3 ELSE 0 END + CASE WHEN s_nationkey > 12 THEN 2 ELSE 0 END AS risk FROM supplier LEFT JOIN l ON s_suppkey = l_suppkey) SELECT s_suppkey, risk::BIGINT AS risk FROM k WHERE risk >= 6""",
    "health_status": f"""WITH {_DEBT}, n AS (SELECT file, count(*) FILTER (WHERE severity = 'high') AS h, count(*) FILTER (WHERE severity = 'medium') AS m, count(*) FILTER (WHERE severity = 'low') AS l FROM db GROUP BY file)
        SELECT file, CASE WHEN h > 0 OR m >= 10 THEN 'degraded' WHEN m > 0 OR l >= 5 THEN 'attention' ELSE 'healthy' END AS status FROM n""",
    "coverage_ratio": """WITH n AS (SELECT source, count(*) AS t, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS c FROM documents GROUP BY source), p AS (SELECT source, floor(c * 1000 / t + 0.5) / 10 AS percent FROM n)
        SELECT source, percent, CASE WHEN percent >= 80 THEN 'healthy' WHEN percent >= 60 THEN 'attention' WHEN percent >= 40 THEN 'degraded' ELSE 'critical' END AS status FROM p""",
    "structural_protection": """WITH dd AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1998), c AS (SELECT c_nationkey, c_custkey IN (SELECT o_custkey FROM dd) AS direct FROM customer)
        SELECT CASE WHEN direct THEN 'direct' WHEN c_nationkey IN (SELECT c_nationkey FROM c WHERE direct) THEN 'transitive' ELSE 'none' END AS protection, count(*) AS n FROM c GROUP BY 1""",
    "component_rank": """WITH l AS (SELECT l_suppkey AS supp, count(DISTINCT l_orderkey) AS a, count(DISTINCT l_partkey) AS b, count(*) AS c FROM lineitem GROUP BY 1)
        SELECT supp, floor((0.5::DOUBLE * a / (SELECT max(a) FROM l) + 0.3::DOUBLE * b / (SELECT max(b) FROM l) + 0.2::DOUBLE * c / (SELECT max(c) FROM l)) * 1000 + 0.5) / 1000 AS score FROM l""",
    "finding_union": f"WITH {_FIND} SELECT category, severity, count(*) AS n FROM fd GROUP BY ALL",
    "finding_unique_ids": f"WITH {_FIND}, n AS (SELECT id, count(*) AS n FROM fd GROUP BY id) SELECT id || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS id FROM n, unnest(range(1, n + 1)) AS r(k)",
    "finding_sort_rank": f"""WITH {_FIND}, g AS (SELECT id, severity, confidence, file, line, count(*) AS n FROM fd GROUP BY ALL) SELECT * FROM g
        ORDER BY list_position(['critical', 'high', 'medium', 'low', 'info'], severity), list_position(['high', 'medium', 'low'], confidence), coalesce(file, ''), coalesce(line, 0), id LIMIT 50""",
    "findings_by_category": f"WITH {_FIND} SELECT category, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low FROM fd GROUP BY category",
    "owasp_mapping": f"WITH {_FIND} SELECT s AS standard, CASE WHEN s IN ('A04', 'A05') THEN (SELECT count(*) FROM fd WHERE category = 'size') WHEN s = 'A01' THEN (SELECT count(*) FROM fd WHERE category = 'price') ELSE 0 END AS n FROM (SELECT 'A' || lpad(i::VARCHAR, 2, '0') AS s FROM range(1, 11) r(i))",
    "greedy_budget_pack": """WITH RECURSIVE p AS (SELECT p_brand, round(p_retailprice)::BIGINT AS price, row_number() OVER (PARTITION BY p_brand ORDER BY round(p_retailprice)::BIGINT DESC, p_partkey) AS rk FROM part),
        f AS (SELECT p_brand, 0::BIGINT AS rk, 0::BIGINT AS used, 0::BIGINT AS n FROM (SELECT DISTINCT p_brand FROM p) UNION ALL
        SELECT f.p_brand, p.rk, CASE WHEN used + price <= 10000 THEN used + price ELSE used END, CASE WHEN used + price <= 10000 THEN n + 1 ELSE n END FROM f JOIN p ON p.p_brand = f.p_brand AND p.rk = f.rk + 1)
        SELECT p_brand, max(used) AS used, max(n) AS n FROM f GROUP BY p_brand""",
    "prefix_budget_cut": "WITH p AS (SELECT p_brand, p_partkey, sum(round(p_retailprice)::BIGINT) OVER (PARTITION BY p_brand ORDER BY round(p_retailprice)::BIGINT, p_partkey)::BIGINT AS used FROM part) SELECT p_brand, p_partkey, used FROM p WHERE used <= 10000",
    "feedback_fold": """WITH RECURSIVE e AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 0.125 ELSE -0.125 END::DOUBLE AS dl, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rk FROM events WHERE event_type IN ('purchase', 'error')),
        f AS (SELECT DISTINCT user_id, 0::BIGINT AS rk, 0.5::DOUBLE AS v FROM e UNION ALL SELECT f.user_id, e.rk, least(greatest(v + dl, 0), 1) FROM f JOIN e ON e.user_id = f.user_id AND e.rk = f.rk + 1)
        SELECT user_id, arg_max(v, rk) AS value FROM f GROUP BY user_id""",
    "memory_rank": """WITH t AS (SELECT conv_id, turn, length(text) AS ln, len(list_intersect(['the', 'of', 'and', 'thing'], list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')))) AS hit FROM conversations),
        s AS (SELECT *, hit / 4 + CASE WHEN ln > 200 THEN 0.25 ELSE 0 END::DOUBLE AS score FROM t WHERE hit > 0), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rk FROM s) SELECT conv_id, turn, score FROM r WHERE rk <= 3""",
    "tumbling_counts": "SELECT (epoch(ts)::BIGINT - epoch(ts)::BIGINT % 3600)::BIGINT AS start, event_type, count(*) AS n FROM (SELECT date_trunc('second', ts) AS ts, event_type FROM events) GROUP BY ALL",
    "stream_counts": "SELECT (epoch(ts)::BIGINT - epoch(ts)::BIGINT % 86400)::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM (SELECT date_trunc('second', ts) AS ts, event_type, value FROM events) GROUP BY ALL",
    "versioned_totals": "SELECT user_id, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "registry_actions": """SELECT doc_id AS id, CASE WHEN doc_id % 11 = 3 THEN 'drop' WHEN doc_id % 13 = 5 THEN 'build' WHEN doc_id % 9 = 0 THEN 'rebuild' WHEN doc_id % 4 <> 0 THEN 'reuse' WHEN doc_id % 8 = 0 THEN 'rebuild' ELSE 'recheck' END AS action FROM documents WHERE NOT (doc_id % 11 = 3 AND doc_id % 13 = 5)""",
    "session_windows": """WITH l AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
}
