"""Reports over findings, components, units and graphs: joins and groupings, and the rows of exchange formats."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import code
from sparkloom.operators.findings import SEVERITIES, rank_of


def apply_reviews(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """findings with review_status of reviews(id, status), null where there is none, and is_open."""
    joined = findings.drop("review_status").join(reviews.select("id", F.col("status").alias("review_status")), "id", "left")
    return joined.withColumn("is_open", code.is_open(F.col("review_status")))


def relationships_for(edges: DataFrame, selected: DataFrame, anchors: DataFrame, most: int = 30) -> DataFrame:
    """(kind, src, dst, confidence, both): edges between selected things, or at an anchor; those between two first, then by
    confidence. selected(id), anchors(id)."""
    s = selected.select("id").withColumn("sel", F.lit(True))
    a = anchors.select("id").withColumn("anchor", F.lit(True))
    rows = edges.where(~F.col("kind").isin("contains", "defines"))
    rows = rows.join(s.toDF("src", "src_sel"), "src", "left").join(s.toDF("dst", "dst_sel"), "dst", "left").join(a.toDF("src", "src_anchor"), "src", "left").join(a.toDF("dst", "dst_anchor"), "dst", "left")
    no = F.lit(False)
    both = F.coalesce("src_sel", no) & F.coalesce("dst_sel", no)
    at_anchor = (F.coalesce("src_sel", no) & F.coalesce("src_anchor", no)) | (F.coalesce("dst_sel", no) & F.coalesce("dst_anchor", no))
    kept = rows.where(both | at_anchor).select("kind", "src", "dst", "confidence", both.alias("both"))
    return kept.orderBy(F.desc("both"), F.desc("confidence"), "kind", "src", "dst").limit(most)


def related_tests(edges: DataFrame, tests: DataFrame, selected: DataFrame, most: int = 5) -> DataFrame:
    """(path, n): test files by the edges that lead from them to selected things, two more for each selected test. tests(id, path)."""
    kinds = ("imports", "calls", "references", "uses")
    s = selected.select("id")
    links = edges.where(F.col("kind").isin(*kinds)).join(s.toDF("dst"), "dst", "left_semi").join(tests.toDF("src", "path"), "src").select("path", F.lit(1).alias("n"))
    own = tests.join(s, "id", "left_semi").select("path", F.lit(2).alias("n"))
    return links.union(own).groupBy("path").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "path").limit(most)


def verdict(a: Column, b: Column, rules: list[dict], order: list[str], layering: str) -> Column:
    """What a contract says of a dependency of layer a on b: the rule that forbids it, or null. Explicit rules come first:
    an allowed pair is allowed whatever the layering."""
    among = lambda x, patterns: F.greatest(F.lit(False), *[code.target_matches(F.lit(p), x) for p in patterns]) if patterns else F.lit(False)
    at = lambda x: F.array_position(F.lit(order), x)
    forbids, allows = [], []
    for r in rules:
        if "to" in r:
            hit = among(b, [r["to"]])
            forbids.append(F.when(hit & ~a.isin(*r["only_from"]), F.lit(r["id"])))
            allows.append(hit & a.isin(*r["only_from"]))
        else:
            hit = among(a, [r["from"]])
            forbids.append(F.when(hit & among(b, r.get("forbid", [])), F.lit(r["id"])))
            allows.append(hit & among(b, r.get("allow", [])))
    explicit = F.coalesce(*forbids) if forbids else F.lit(None).cast("string")
    allowed = F.greatest(F.lit(False), *allows) if allows else F.lit(False)
    known = (at(a) > 0) & (at(b) > 0)
    upward = known & (at(b) < at(a)) if layering != "none" else F.lit(False)
    skips = known & (at(b) > at(a) + 1) if layering == "strict" else F.lit(False)
    return F.when(explicit.isNotNull(), explicit).when(allowed, F.lit(None)).when(upward | skips, F.lit("layering"))


def rule_deviations(dependencies: DataFrame, layers: dict[str, list[str]], rules: list[dict], layering: str = "none") -> DataFrame:
    """dependencies(path, target): files, or names of things outside, that files depend on -> (path, target, src_layer,
    dst_layer, rule): those that a rule forbids. A path is in the first layer that has a glob for it."""
    of = lambda c: code.layer_of(F.col(c), layers)
    pair = F.struct(of("path").alias("src_layer"), F.coalesce(of("target"), F.when(F.contains("target", F.lit(":")), F.col("target"))).alias("dst_layer"))
    # an array of one is a step that filters aren't pushed through, or the layers' patterns would stand in each of them again
    rows = dependencies.select("path", "target", F.explode(F.array(pair)).alias("l")).select("path", "target", "l.*")
    rows = rows.where("src_layer IS NOT NULL AND dst_layer IS NOT NULL AND src_layer <> dst_layer")
    told = F.explode(F.array(verdict(F.col("src_layer"), F.col("dst_layer"), rules, list(layers), layering))).alias("rule")
    return rows.select("path", "target", "src_layer", "dst_layer", told).where("rule IS NOT NULL")


def advisory_findings(advisories: DataFrame) -> DataFrame:
    """advisories(ecosystem, package, version, id, severity) -> a finding a component, of its worst advisory; unknown counts as
    medium. The first four ids are named."""
    key = F.concat(F.col("ecosystem"), F.lit(":"), F.col("package"), F.lit("@"), F.col("version"))
    rank = rank_of(F.col("severity"), SEVERITIES)
    n = F.row_number().over(Window.partitionBy("component").orderBy("id"))
    rows = advisories.select(key.alias("component"), "id", "severity", rank.alias("rank")).withColumn("n", n)
    out = rows.groupBy("component").agg(
        F.count("*").alias("n_advisories"), F.min_by("severity", "rank").alias("worst"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") <= 4, F.col("id")))), ", ").alias("ids")
    )
    return out.select(F.concat(F.lit("dependency:vuln:"), "component").alias("id"), F.when(F.col("worst") == "unknown", "medium").otherwise(F.col("worst")).alias("severity"), "n_advisories", "ids")


def duplicate_versions(components: DataFrame) -> DataFrame:
    """(ecosystem, name, versions): components that are there in several versions."""
    return components.groupBy("ecosystem", "name").agg(F.array_join(F.array_sort(F.collect_set("version")), ",").alias("versions"), F.count_distinct("version").alias("n")).where("n > 1").drop("n")


def license_histogram(components: DataFrame, deny: list[str], review: list[str]) -> DataFrame:
    counts = components.groupBy("license").agg(F.count("*").alias("n"))
    return counts.withColumn("policy", code.license_policy(F.col("license"), deny, review))


def structural_shared(edges: DataFrame, groups: DataFrame, least: int = 3) -> DataFrame:
    """groups(id, grp) -> (grp, users): groups that depend on no other and that at least so many others depend on."""
    g = groups.select("id", "grp")
    between = edges.select("src", "dst").join(g.toDF("src", "a"), "src").join(g.toDF("dst", "b"), "dst").where("a <> b").select("a", "b").distinct()
    used = between.groupBy(F.col("b").alias("grp")).agg(F.count("*").alias("users")).where(F.col("users") >= least)
    return used.join(between.select(F.col("a").alias("grp")), "grp", "left_anti")


def top_directories(files: DataFrame, k: int) -> DataFrame:
    """files(path) -> the k directories with most files: ties to the higher one, then by name."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    counts = files.groupBy(F.when(folder == "", ".").otherwise(folder).alias("dir")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.size(F.split("dir", "/")), "dir").limit(k)


def set_digest(rows: DataFrame, path: str, content: str) -> DataFrame:
    """(digest, buckets, n): one row that doesn't depend on the order of rows, which are n. The SHA-256 of each (path, hash) pair
    is filed by its first byte; each bucket's are sorted and hashed, then the buckets' digests. Sorted hashes run through a task
    as a stream, so a bucket may have any size. A repeated row counts each time, but travels once; without rows, digest is null."""
    one = F.sha2(F.concat_ws("\x00", path, content), 256)
    counted = rows.select(one.alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    per = counted.repartition(F.substring("h", 1, 2)).sortWithinPartitions("h").mapInArrow(_bucket_digests(), "d string, n long")
    whole = F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256)
    return per.agg(F.when(F.count("*") > 0, whole).alias("digest"), F.count("*").alias("buckets"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def _bucket_digests(piece: int = 4096):
    """A task's hashes with their counts, sorted -> each bucket's digest and its number of rows; only the hash's state is held."""

    def fold(batches):
        bucket, state, total = None, None, 0
        for batch in batches:
            for h, n in zip(batch.column("h").to_pylist(), batch.column("n").to_pylist()):
                if h[:2] != bucket:
                    if state is not None:
                        yield pa.RecordBatch.from_pydict({"d": [state.hexdigest()], "n": [total]})
                    bucket, state, total = h[:2], hashlib.sha256(), 0
                for k in range(0, n, piece):
                    state.update(h.encode() * min(piece, n - k))
                total += n
        if state is not None:
            yield pa.RecordBatch.from_pydict({"d": [state.hexdigest()], "n": [total]})

    return fold


def line_windows(lines: DataFrame, key: str, size: int = 6) -> DataFrame:
    """lines(key, line_no, line) with window: the line and those after it, `size` in all."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(0, size - 1)
    return lines.withColumn("window", F.array_join(F.collect_list("line").over(w), "\n"))


def window_hits(lines: DataFrame, key: str, rules: dict[str, tuple[str, str | None]], size: int = 6) -> DataFrame:
    """(key, line_no, rule): a rule fits a line by its first pattern, if its second is found in the lines from there on."""
    tests = [F.when(F.col("line").rlike(here) & (F.lit(True) if near is None else F.col("window").rlike(near)), F.lit(name)) for name, (here, near) in rules.items()]
    return line_windows(lines, key, size).select(key, "line_no", F.explode(F.array_compact(F.array(*tests))).alias("rule"))


def dockerfile_hits(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, rule) of container files: images without a fixed version, remote scripts, secrets in the environment,
    and per file the user of the last stage and a missing health check."""
    clean = F.trim(F.regexp_replace("line", r"\s+#.*$", ""))
    rows = lines.select(key, "line_no", clean.alias("l"))
    base = r"(?i)^FROM\s+(?:--platform=\S+\s+)?(\S+)(?:\s+AS\s+(\S+))?"
    is_from = F.col("l").rlike(base)
    w = Window.partitionBy(key).orderBy("line_no")
    rows = rows.select("*", F.sum(is_from.cast("int")).over(w).alias("stage"), F.lower(F.when(is_from, F.regexp_extract("l", base, 2))).alias("named"), F.when(is_from, F.regexp_extract("l", base, 1)).alias("image"))
    rows = rows.withColumn("stages", F.collect_set("named").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    env = r"(?i)^(ENV|ARG)\s+([A-Za-z_]\w*)(?:\s*=\s*|\s+)(\S.*)$"
    value = F.regexp_extract("l", env, 3)
    secret = F.col("l").rlike(env) & F.regexp_extract("l", env, 2).rlike("(?i)(secret|password|passwd|token|api_?key)") & ~value.rlike(r"^\$|^[\"']?\$\{") & (F.length(F.regexp_replace(value, "[\"']", "")) >= 4)
    tests = {
        "mutable-image": is_from & code.image_is_mutable(F.col("image")) & ~F.array_contains("stages", F.lower("image")),
        "remote-add": F.col("l").rlike(r"(?i)^ADD\s+https?://") | F.col("l").rlike(r"\b(?:curl|wget)\b[^|]*\|\s*(?:sudo\s+)?(?:ba|z)?sh\b"),
        "secret": secret,
    }
    hits = rows.select(key, "line_no", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))).alias("rule"))
    last = rows.join(rows.groupBy(F.col(key).alias("_k")).agg(F.max("stage").alias("_last")), F.expr(f"{key} = _k AND stage = _last"))
    user = r"(?i)^USER\s+(\S+)"
    ends = last.groupBy(key).agg(
        F.max(F.when(F.col("l").rlike(user), F.struct("line_no", F.regexp_extract("l", user, 1).alias("value")))).alias("user"), F.max(F.col("l").rlike(r"(?i)^HEALTHCHECK\b")).alias("health")
    )
    exposed = rows.groupBy(key).agg(F.max(F.when(F.col("l").rlike(r"(?i)^EXPOSE\b"), F.col("line_no"))).alias("exposed"))
    root = ends.where("user IS NULL OR user.value RLIKE '^(root|0)(:|$)'").select(key, F.coalesce("user.line_no", F.lit(1)).alias("line_no"), F.lit("root").alias("rule"))
    sick = ends.join(exposed, key).where("NOT health AND exposed IS NOT NULL").select(key, F.col("exposed").alias("line_no"), F.lit("no-healthcheck").alias("rule"))
    return hits.union(root).union(sick)


def sarif_results(findings: DataFrame) -> DataFrame:
    """(id, result): a SARIF 2.1.0 result object for each open finding (id, rule_id, severity, title, message, file, line)."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    body = F.struct(
        F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.concat("title", F.lit(". "), "message").alias("text")).alias("message"), F.array(place).alias("locations"),
        F.struct(F.col("id").alias("findingId")).alias("partialFingerprints"), F.struct("severity").alias("properties"),
    )
    return findings.select("id", F.to_json(body).alias("result"))


def bom_components(components: DataFrame) -> DataFrame:
    """(purl, component): a CycloneDX 1.5 component object for each (ecosystem, name, version, dev, license)."""
    purl = F.concat(F.lit("pkg:"), "ecosystem", F.lit("/"), "name", F.lit("@"), "version")
    single = F.array(F.struct(F.struct(F.col("license").alias("id")).alias("license")))
    base = [F.lit("library").alias("type"), purl.alias("bom-ref"), F.col("name"), F.col("version"), purl.alias("purl"), F.when(F.col("dev"), "optional").otherwise("required").alias("scope")]
    known = F.to_json(F.struct(*base, single.alias("licenses")))
    compound = F.to_json(F.struct(*base, F.array(F.struct(F.col("license").alias("expression"))).alias("licenses")))
    body = F.when(F.col("license") == "NOASSERTION", F.to_json(F.struct(*base))).when(F.col("license").rlike(r"\s(AND|OR|WITH)\s"), compound).otherwise(known)
    return components.select(purl.alias("purl"), body.alias("component"))
