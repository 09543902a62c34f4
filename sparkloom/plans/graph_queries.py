"""Graph queries over a property graph made of the business tables.

Nodes: regions, nations, customers, suppliers, parts. Edges: nation part_of region, customer and supplier located_in
nation, supplier supplies part (one row per lineitem, so repeated), with a confidence each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import graph
from sparkloom.session import read_table


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    def of(table: str, kind: str, key: str, name: str) -> DataFrame:
        return read_table(spark, d, table).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("name"))

    parts = [("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name")]
    out = of(*parts[0])
    for p in parts[1:]:
        out = out.union(of(*p))
    return out


def _link(rows: DataFrame, kind: str, src: str, src_key: str, dst: str, dst_key: str, confidence, seq) -> DataFrame:
    ident = lambda k, c: F.concat(F.lit(f"{k}:"), F.col(c).cast("string"))
    return rows.select(F.lit(kind).alias("kind"), ident(src, src_key).alias("src"), ident(dst, dst_key).alias("dst"), confidence.cast("double").alias("confidence"), seq.cast("long").alias("seq"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    out = _link(read_table(spark, d, "nation"), "part_of", "nation", "n_nationkey", "region", "n_regionkey", F.lit(1.0), F.col("n_nationkey"))
    out = out.union(_link(read_table(spark, d, "customer"), "located_in", "customer", "c_custkey", "nation", "c_nationkey", F.when(F.col("c_acctbal") > 0, 0.9).otherwise(0.5), F.col("c_custkey")))
    return out.union(_link(read_table(spark, d, "supplier"), "located_in", "supplier", "s_suppkey", "nation", "s_nationkey", F.when(F.col("s_acctbal") > 0, 0.9).otherwise(0.5), F.col("s_suppkey")))


def _supplies(spark: SparkSession, d: str) -> DataFrame:
    return _link(read_table(spark, d, "lineitem"), "supplies", "supplier", "l_suppkey", "part", "l_partkey", 1 - F.col("l_discount"), F.col("l_orderkey") * 100 + F.col("l_linenumber"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).union(_supplies(spark, d))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d)


def graph_edges_strongest(spark: SparkSession, d: str) -> DataFrame:
    best = graph.strongest(_edges(spark, d), ["kind", "src", "dst"])
    return best.select("kind", "src", "dst", F.round("confidence", 6).alias("confidence"))


def graph_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Edges between nodes that are there, where parts of a size over 25 are not."""
    gone = read_table(spark, d, "part").where("p_size > 25").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"))
    kept = graph.build_edges(_edges(spark, d), _nodes(spark, d).join(gone, "id", "left_anti"))
    return kept.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.stats(_nodes(spark, d), _edges(spark, d))


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(_places(spark, d)).select("node", "other", "direction", "kind")


def degree_hubs(spark: SparkSession, d: str) -> DataFrame:
    found = graph.degrees(graph.strongest(_edges(spark, d), ["kind", "src", "dst"]))
    return found.orderBy(F.desc("n_in"), "node").limit(10)


def find_by_name(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("kind") == "region", 0).otherwise(1)
    return graph.find_by_name(_nodes(spark, d), "asia", rank).select("id", "kind", "tier")


def traverse_3hop(spark: SparkSession, d: str) -> DataFrame:
    """What lies within three hops against the arrows from region 2, over edges of at least .6 confidence."""
    seeds = spark.createDataFrame([("region:2",)], "id string")
    edges = graph.strongest(_edges(spark, d), ["kind", "src", "dst"])
    return graph.traverse(edges, seeds, "in", 3, 0.6).select("id", "depth")


def reach_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(_places(spark, d))


def reach_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(_places(spark, d)).groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n"))


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_places(spark, d))


def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's way to its region."""
    sources = read_table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"))
    found = graph.shortest_paths(_places(spark, d), sources).where(F.col("id").startswith("region:"))
    return found.select("source", "id", "depth", F.array_join("path", ">").alias("path"))


def _transitions(spark: SparkSession, d: str) -> DataFrame:
    """Event types that follow each other for one user within ten minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read_table(spark, d, "events").withColumn("before", F.lag("event_type").over(w)).withColumn("at", F.lag("ts").over(w))
    soon = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp")) <= 600_000_000
    return rows.where(F.col("before").isNotNull() & soon & (F.col("before") != F.col("event_type"))).select(F.col("before").alias("src"), F.col("event_type").alias("dst")).distinct()


def scc_transitions(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(_transitions(spark, d)).select("id", "component", "size")


def layer_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.layers(_places(spark, d))


def rename_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as one thing renamed again and again: order -> the first of its line."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("new"), F.lag("o_orderkey").over(w).alias("old")).where("old IS NOT NULL")
    return graph.lineage(pairs).select("name", "origin", F.col("steps").cast("long").alias("steps"))


def relationship_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Supplies edges taken to supplier nation and part brand."""
    groups = read_table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("grp"))
    groups = groups.union(read_table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")), F.col("p_brand")))
    out = graph.rollup_edges(_supplies(spark, d), groups)
    return out.select("src_grp", "dst_grp", "weight", F.element_at("kinds", "supplies").alias("supplies"), F.round("confidence", 6).alias("confidence"))


_PLACES = """places AS (SELECT 'part_of' AS kind, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 1.0 AS confidence FROM nation
    UNION ALL SELECT 'located_in', 'customer:' || c_custkey, 'nation:' || c_nationkey, CASE WHEN c_acctbal > 0 THEN 0.9 ELSE 0.5 END FROM customer
    UNION ALL SELECT 'located_in', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, CASE WHEN s_acctbal > 0 THEN 0.9 ELSE 0.5 END FROM supplier)"""
_EDGES = f"""{_PLACES}, supplies AS (SELECT 'supplies' AS kind, 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst, 1 - l_discount AS confidence FROM lineitem),
    edges AS (SELECT * FROM places UNION ALL SELECT * FROM supplies), best AS (SELECT kind, src, dst, max(confidence) AS confidence FROM edges GROUP BY ALL)"""
_NODES = """nodes AS (SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_name AS name FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'part:' || p_partkey, 'part', p_name FROM part)"""
_CLOSURE = f"WITH RECURSIVE {_PLACES}, c AS (SELECT src, dst, 1 AS depth FROM places UNION SELECT c.src, p.dst, depth + 1 FROM c JOIN places p ON c.dst = p.src)"

QUERIES = {
    f.__name__: f
    for f in (
        graph_nodes, graph_edges_strongest, graph_integrity, graph_stats, adjacency, degree_hubs, find_by_name, traverse_3hop, reach_closure, reach_counts,
        connected_components, shortest_path, scc_transitions, layer_depth, rename_lineage, relationship_rollup,
    )
}

ORACLES = {
    "graph_nodes": f"WITH {_NODES} SELECT * FROM nodes",
    "graph_edges_strongest": f"WITH {_EDGES} SELECT kind, src, dst, round(confidence, 6)::DOUBLE AS confidence FROM best",
    "graph_integrity": f"""WITH {_EDGES}, {_NODES}, live AS (SELECT id FROM nodes WHERE id NOT IN (SELECT 'part:' || p_partkey FROM part WHERE p_size > 25))
        SELECT kind, count(*) AS n, round(sum(confidence), 4)::DOUBLE AS confidence FROM best WHERE src IN (SELECT id FROM live) AND dst IN (SELECT id FROM live) GROUP BY kind""",
    "graph_stats": f"WITH {_EDGES}, {_NODES} SELECT 'node' AS what, kind, count(*) AS n FROM nodes GROUP BY ROLLUP (kind) UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY ROLLUP (kind)",
    "adjacency": f"WITH {_PLACES} SELECT src AS node, dst AS other, 'out' AS direction, kind FROM places UNION ALL SELECT dst, src, 'in', kind FROM places",
    "degree_hubs": f"""WITH {_EDGES}, b AS (SELECT src AS node, dst AS other, 1 AS o FROM best UNION ALL SELECT dst, src, 0 FROM best)
        SELECT node, sum(o)::BIGINT AS n_out, sum(1 - o)::BIGINT AS n_in, count(DISTINCT other) AS n_neighbours FROM b GROUP BY node ORDER BY n_in DESC, node LIMIT 10""",
    "find_by_name": f"WITH {_NODES}, f AS (SELECT id, kind, CASE WHEN name = 'asia' THEN 0 ELSE 1 END AS tier FROM nodes WHERE lower(name) = 'asia') SELECT id, kind, tier FROM f WHERE tier = (SELECT min(tier) FROM f)",
    "traverse_3hop": f"""WITH {_EDGES}, ok AS (SELECT src, dst FROM best WHERE confidence >= 0.6), h0 AS (SELECT 'region:2' AS id), h1 AS (SELECT DISTINCT src AS id FROM ok WHERE dst IN (SELECT id FROM h0)),
        h2 AS (SELECT DISTINCT src AS id FROM ok WHERE dst IN (SELECT id FROM h1)), h3 AS (SELECT DISTINCT src AS id FROM ok WHERE dst IN (SELECT id FROM h2)),
        a AS (SELECT id, 0 AS depth FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 UNION ALL SELECT id, 3 FROM h3) SELECT id, min(depth) AS depth FROM a GROUP BY id""",
    "reach_closure": f"{_CLOSURE} SELECT src, dst, min(depth) AS depth FROM c GROUP BY src, dst",
    "reach_counts": f"{_CLOSURE} SELECT dst AS id, count(DISTINCT src) AS n FROM c GROUP BY dst",
    "connected_components": """WITH m AS (SELECT 'nation:' || n_nationkey AS id, n_regionkey AS r FROM nation UNION ALL SELECT 'region:' || n_regionkey, n_regionkey FROM nation
        UNION ALL SELECT 'customer:' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'supplier:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        SELECT DISTINCT id, min(id) OVER (PARTITION BY r) AS component FROM m""",
    "shortest_path": """SELECT 'supplier:' || s_suppkey AS source, 'region:' || n_regionkey AS id, 2 AS depth, 'supplier:' || s_suppkey || '>nation:' || n_nationkey || '>region:' || n_regionkey AS path
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "scc_transitions": """WITH RECURSIVE l AS (SELECT event_type AS dst, ts, lag(event_type) OVER w AS src, lag(ts) OVER w AS at_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        e AS (SELECT DISTINCT src, dst FROM l WHERE src IS NOT NULL AND src <> dst AND epoch_us(ts) - epoch_us(at_) <= 600000000), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src),
        n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), m AS (SELECT a.src AS id, min(a.dst) AS least FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
        k AS (SELECT n.id, coalesce(least(n.id, m.least), n.id) AS component FROM n LEFT JOIN m ON n.id = m.id) SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM k""",
    "layer_depth": f"WITH {_PLACES} SELECT id, CASE split_part(id, ':', 1) WHEN 'region' THEN 0 WHEN 'nation' THEN 1 ELSE 2 END AS layer FROM (SELECT src AS id FROM places UNION SELECT dst FROM places)",
    "rename_lineage": """WITH o AS (SELECT o_orderkey AS name, row_number() OVER w - 1 AS steps, first_value(o_orderkey) OVER w AS origin FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
        SELECT name, origin, steps FROM o WHERE steps > 0""",
    "relationship_rollup": """SELECT 'n' || s_nationkey AS src_grp, p_brand AS dst_grp, count(*) AS weight, count(*) AS supplies, round(max(1 - l_discount), 6)::DOUBLE AS confidence
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
}
