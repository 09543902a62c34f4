"""Mixing sources to target weights: hierarchical budgeting over a domain-language-source tree (DataFrame functions only).

Budgets run down the tree. At each node the budget is dealt to the children by weight; a child that can't use its share
(its tokens times the allowed epochs are fewer) gives the rest back to its siblings by their weights, until all is dealt
or all are full. Because a node's capacity is the sum of its leaves', a shortage leaves the node for its own siblings
only when every leaf below it is full: siblings come before ancestors. The dealing is the closed form of water filling:
children in order of capacity/weight, and the first one at which (budget - capacity before) * weight / (weight from
here on) fits sets the level for all that follow.

Each leaf then takes whole epochs, and of its last one a prefix in seeded order: rows are dealt by md5(seed, epoch,
doc_id), and a row is taken while the tokens before it are short of the budget. The order's first three digits make
4096 bins per leaf, summed before any sort; only the one bin that the budget ends in is sorted and added up row by
row, so no leaf, however large, is gathered in a task.

Rows without text have no tokens and are never taken; a null lang or source is a leaf of its own. Rows that
are equal in doc_id, text, lang and source are taken or left together. Weights of
branches that aren't named are the default; a weight of 0 or less gets nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, table, whole_rows

#: Sources by domain; any other source is in the domain "other".
DOMAINS = {
    "web": ("src0", "src1", "src2", "src3", "src4", "src5"),
    "reference": ("src6", "src7", "src8", "src9", "src10"),
    "news": ("src11", "src12", "src13", "src14", "src15"),
}
TOKEN = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the order that make a bin.
BIN_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """share: of all tokens, the budget. Integer weights keep the arithmetic exact."""

    domain_weights: dict = field(default_factory=lambda: {"web": 5, "reference": 3, "news": 2, "other": 2})
    lang_weights: dict = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 2, "es": 2})
    source_weights: dict = field(default_factory=dict)
    default_weight: int = 1
    share: float = 0.9
    max_epochs: int = 2
    seed: int = 42


def _weight(column: str, weights: dict, default: int):
    out = F.lit(default)
    for key, w in weights.items():
        out = F.when(F.col(column).eqNullSafe(F.lit(key)), F.lit(int(w))).otherwise(out)
    return out.cast("double")


def deal(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes(parent..., name, weight, capacity, total) -> with budget: total dealt to the children of each parent."""
    live = nodes.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(0.0)))
    by = [F.coalesce(F.col(c), F.lit("\0")) for c in parent]
    order = [F.expr("CASE WHEN weight > 0 THEN capacity / weight ELSE double('inf') END"), F.col("name").asc_nulls_first()]
    w = Window.partitionBy(*by).orderBy(*order)
    live = live.select(
        "*",
        F.coalesce(F.sum("capacity").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
        F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("left"),
    )
    share = F.expr("CASE WHEN weight > 0 THEN greatest(total - before, 0D) * weight / left ELSE 0D END")
    live = live.withColumn("fits", (F.col("weight") > 0) & (share <= F.col("capacity")))
    # the first that fits sets the level, and all after it get by the same level
    every = Window.partitionBy(*by)
    live = live.withColumn("rank", F.row_number().over(w))
    live = live.withColumn("first", F.min(F.when(F.col("fits"), F.struct("rank", "before", "left"))).over(every))
    level = F.expr("greatest(total - first.before, 0D) * weight / first.left")
    budget = (
        F.when(F.col("weight") <= 0, 0.0)
        .when(F.col("first").isNull() | (F.col("rank") < F.col("first.rank")), F.col("capacity"))
        .otherwise(F.least(level, F.col("capacity")))
    )
    return live.select(*nodes.columns, budget.alias("budget"))


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves(domain, lang, source, tokens) -> with budget, in whole tokens."""
    sized = leaves.withColumn("capacity", F.col("tokens").cast("double") * mix.max_epochs)
    total = sized.agg(F.sum(F.col("tokens").cast("double")).alias("all_tokens")).select(F.floor(F.coalesce("all_tokens", F.lit(0.0)) * mix.share).cast("double").alias("total"))
    top = sized.groupBy(F.col("domain").alias("name")).agg(F.sum("capacity").alias("capacity")).crossJoin(F.broadcast(total))  # total is one row
    top = deal(top.withColumn("weight", _weight("name", mix.domain_weights, mix.default_weight)), [])
    mid = sized.groupBy("domain", F.col("lang").alias("name")).agg(F.sum("capacity").alias("capacity"))
    mid = mid.join(top.select(F.col("name").alias("d"), F.col("budget").alias("total")), F.expr("domain <=> d")).drop("d")
    mid = deal(mid.withColumn("weight", _weight("name", mix.lang_weights, mix.default_weight)), ["domain"])
    low = sized.select("domain", "lang", F.col("source").alias("name"), "tokens", "capacity")
    low = low.join(mid.select(F.col("domain").alias("d"), F.col("name").alias("l"), F.col("budget").alias("total")), F.expr("domain <=> d AND lang <=> l")).drop("d", "l")
    low = deal(low.withColumn("weight", _weight("name", mix.source_weights, mix.default_weight)), ["domain", "lang"])
    return low.select("domain", "lang", F.col("name").alias("source"), "tokens", F.floor("budget").cast("long").alias("budget"))


def select_rows(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens, row_key, times) of all that is taken, a row per epoch; row_key tells
    apart the rows of one doc_id, and n_tokens adds up the times that equal rows stand."""
    mix = mix or Mix()
    domain = F.lit("other")
    for name, sources in DOMAINS.items():
        domain = F.when(F.col("source").isin(*sources), F.lit(name)).otherwise(domain)
    rows = docs.select(
        "doc_id", domain.alias("domain"), "lang", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKEN)).cast("long").alias("n_tokens"),
        F.xxhash64("text", "lang", "source").alias("row_key"),
    ).where("n_tokens > 0")
    leaf = ["domain", "lang", "source"]
    rows = rows.groupBy("doc_id", *leaf, "row_key").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("times"))
    rows = materialize(rows, "mix-rows")  # a narrow table: texts are read once
    budgets = leaf_budgets(rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")), mix)
    budgets = materialize(budgets.where("budget > 0"), "mix-budgets")
    # each row once per epoch that its leaf starts, with the rest of the budget at that epoch's start
    b = budgets.select(*[F.col(c).alias(f"b_{c}") for c in leaf], "tokens", "budget")
    same = " AND ".join(f"{c} <=> b_{c}" for c in leaf)
    started = rows.join(b, F.expr(same)).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.expr("cast(floor((budget - 1) / tokens) as int)"))))
    started = started.withColumn("rest", F.expr("budget - epoch * tokens")).drop(*[f"b_{c}" for c in leaf])
    whole = started.where("rest >= tokens")
    part = started.where("rest < tokens").withColumn("key", F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    part = part.withColumn("bin", F.substring("key", 1, BIN_DIGITS))
    bins = part.groupBy(*leaf, "bin").agg(F.sum("n_tokens").alias("in_bin"))
    upto = Window.partitionBy(*leaf).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("in_bin").over(upto), F.lit(0))).select(*[F.col(c).alias(f"b_{c}") for c in leaf], F.col("bin").alias("b_bin"), "in_bin", "before")
    part = part.join(bins, F.expr(same + " AND bin = b_bin")).where("before < rest")
    full = part.where("before + in_bin <= rest")
    inside = Window.partitionBy(*leaf, "bin").orderBy("key", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    cut = part.where("before + in_bin > rest").withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where("at < rest")
    columns = ["doc_id", *leaf, "epoch", "n_tokens", "row_key", "times"]
    return whole.select(*columns).unionByName(full.select(*columns)).unionByName(cut.select(*columns))


def mix_documents(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The documents that are taken, with domain, n_tokens, epoch (which replace columns of these names); a document stands
    once for each epoch it is taken in."""
    keep = [c for c in docs.columns if c not in ("domain", "epoch", "n_tokens")]
    picked = select_rows(docs, mix).select(
        F.col("doc_id").alias("p_id"), "domain", "epoch", F.expr("n_tokens div times").alias("n_tokens"), F.col("row_key").alias("p_key")
    )
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    rows = kept.select(whole_rows(kept), F.col("doc_id").alias("own_id"), F.xxhash64("text", "lang", "source").alias("own_key"))
    return rows.join(picked, F.expr("own_id <=> p_id AND own_key = p_key")).select("row.*", "domain", "epoch", "n_tokens")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = select_rows(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    picked = picked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return picked.select("doc_id", "domain", "lang", "source", "epoch", F.expr("n_tokens div times").alias("n_tokens"))


def oracle() -> str:
    """DuckDB: the same levels by trying each child as the first that isn't full; the prefix by one running sum a leaf."""
    mix = Mix()
    domain = "CASE " + " ".join(f"WHEN source IN ({', '.join(repr(s) for s in sources)}) THEN '{name}'" for name, sources in DOMAINS.items()) + " ELSE 'other' END"

    def weight(column: str, weights: dict) -> str:
        return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {w}" for k, w in weights.items()) + f" ELSE {mix.default_weight} END::DOUBLE" if weights else f"{mix.default_weight}::DOUBLE"

    def dealt(name: str, frm: str, parent: str) -> str:
        over = f"PARTITION BY {parent}" if parent else ""
        return f"""
    {name}_o AS (SELECT *, coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lft, row_number() OVER w AS rk
        FROM ({frm}) WINDOW w AS ({over} ORDER BY capacity / weight, name NULLS FIRST)),
    {name}_f AS (SELECT *, min(CASE WHEN greatest(total - before, 0) * weight / lft <= capacity THEN rk END) OVER ({over}) AS fr FROM {name}_o),
    {name} AS (SELECT *, CASE WHEN fr IS NULL OR rk < fr THEN capacity ELSE least(greatest(total
        - max(CASE WHEN rk = fr THEN before END) OVER ({over}), 0) * weight / max(CASE WHEN rk = fr THEN lft END) OVER ({over}), capacity) END AS budget FROM {name}_f)"""

    return f"""
    WITH r AS (SELECT doc_id, {domain} AS domain, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
    rows_ AS (SELECT * FROM r WHERE n_tokens > 0),
    lf AS (SELECT domain, lang, source AS name, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE * {mix.max_epochs} AS capacity FROM rows_ GROUP BY ALL),
    {dealt('d', f"SELECT domain AS name, sum(capacity) AS capacity, {weight('domain', mix.domain_weights)} AS weight, (SELECT floor(sum(tokens)::DOUBLE * {mix.share}) FROM lf) AS total FROM lf GROUP BY domain", '')},
    {dealt('m', f"SELECT lf.domain, lf.lang AS name, sum(lf.capacity) AS capacity, {weight('lf.lang', mix.lang_weights)} AS weight, any_value(d.budget) AS total FROM lf JOIN d ON lf.domain = d.name GROUP BY lf.domain, lf.lang", 'domain')},
    {dealt('s', f"SELECT lf.domain, lf.lang, lf.name, lf.tokens, lf.capacity, {weight('lf.name', mix.source_weights)} AS weight, m.budget AS total FROM lf JOIN m ON lf.domain = m.domain AND lf.lang IS NOT DISTINCT FROM m.name", 'domain, lang')},
    bud AS (SELECT domain, lang, name AS source, tokens, floor(budget)::BIGINT AS budget FROM s WHERE floor(budget) > 0),
    st AS (SELECT rows_.*, tokens, budget, unnest(range(0, ((budget - 1) // tokens) + 1))::INTEGER AS epoch FROM rows_ JOIN bud
        ON rows_.domain = bud.domain AND rows_.lang IS NOT DISTINCT FROM bud.lang AND rows_.source IS NOT DISTINCT FROM bud.source),
    cum AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('{mix.seed}:' || epoch || ':' || doc_id), doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM st)
    SELECT doc_id, domain, lang, source, epoch, n_tokens FROM cum WHERE spot < budget - epoch * tokens"""
