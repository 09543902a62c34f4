"""File sources: repository scans, coverage reports, manifests, lockfiles and test logs as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import glob_regex

MAX_BYTES = 1_000_000
#: Languages by file extension.
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "rs": "rust", "java": "java",
    "md": "markdown", "json": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml",
}
TEST_PATH = r"(^|/)(tests?|__tests__|spec)/|[._-](test|spec)\.[a-z]+$|(^|/)test_[^/]+$|(^|/)[^/]*Tests?\.java$"
#: Folders that hold no sources of the repository's own.
EXCLUDED = ("node_modules", ".git", "dist", "build", "coverage", "vendor", "target", "__pycache__", ".venv")
MANIFESTS = ("package.json", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml", "requirements.txt")


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def role_of(path: Column, language: Column) -> Column:
    """The first that fits: manifest, test, docs, config, source, other."""
    name = F.element_at(F.split(path, "/"), -1)
    return (
        F.when(name.isin(*MANIFESTS), "manifest")
        .when(path.rlike(TEST_PATH), "test")
        .when(language == "markdown", "docs")
        .when(language.isin("json", "yaml", "toml"), "config")
        .when(language.isNotNull(), "source")
        .otherwise("other")
    )


def scan(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, size, hash, language, role, skipped, text): a row a file outside the excluded folders and the ignored globs; text
    is null where the file is skipped. Empty files have no row, for Spark's file sources pass over them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = re.sub(r"^[a-z]+:", "", root).strip("/")
    path = F.regexp_replace("path", r"^[a-z]+:/+" + re.escape(below) + "/", "")
    binary = F.instr(F.decode(F.substring("content", 1, 8192), "ISO-8859-1"), "\0") > 0
    skipped = F.when(F.col("length") > max_bytes, "too-large").when(binary, "binary")
    found = files.select(path.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), skipped.alias("skipped"), "content")
    found = found.where(~F.arrays_overlap(F.split("path", "/"), F.lit(list(EXCLUDED))))
    found = found.where(~F.col("path").rlike("|".join(glob_regex(g) for g in ignore))) if ignore else found
    found = found.withColumn("language", language_of(F.col("path")))
    text = F.when(F.col("skipped").isNull(), F.decode("content", "UTF-8"))
    return found.select("path", "size", "hash", "language", role_of(F.col("path"), F.col("language")).alias("role"), "skipped", text.alias("text"))


def lcov(reports: DataFrame, key: str = "report", text: str = "text") -> DataFrame:
    """(path, line, hits) from LCOV texts: the most hits that any report has of a line."""
    rows = reports.select(key, F.posexplode(F.split(text, "\r?\n")).alias("at", "row"))
    source = F.when(F.col("row").startswith("SF:"), F.expr("substring(row, 4)"))
    rows = rows.withColumn("path", F.last(source, ignorenulls=True).over(Window.partitionBy(key).orderBy("at")))
    hit = rows.where(F.col("row").startswith("DA:")).select("path", F.split(F.expr("substring(row, 4)"), ",").alias("v"))
    return hit.groupBy("path", F.get("v", F.lit(0)).try_cast("int").alias("line")).agg(F.max(F.get("v", F.lit(1)).try_cast("long")).alias("hits")).where("line IS NOT NULL")


def npm_manifest(files: DataFrame) -> DataFrame:
    """(path, name, version, dev) of the dependencies that package.json files declare; a malformed file has none."""
    parsed = files.select("path", F.from_json("text", "struct<dependencies:map<string,string>,devDependencies:map<string,string>>").alias("m"))
    declared = lambda column, dev: parsed.select("path", F.explode(f"m.{column}").alias("name", "version"), F.lit(dev).alias("dev"))
    return declared("dependencies", False).unionByName(declared("devDependencies", True))


def npm_lock(files: DataFrame) -> DataFrame:
    """(path, name, version, dev, license, nested) of the packages in package-lock.json files of version 2 and 3."""
    entry = "struct<version:string,dev:boolean,license:string>"
    parsed = files.select("path", F.from_json("text", f"struct<packages:map<string,{entry}>>").alias("m")).select("path", F.explode("m.packages").alias("at", "p")).where("at <> ''")
    name = F.element_at(F.split("at", "node_modules/"), -1)
    return parsed.select("path", name.alias("name"), "p.version", F.coalesce("p.dev", F.lit(False)).alias("dev"), "p.license", (F.size(F.split("at", "node_modules/")) - 2).alias("nested"))


def block_lock(files: DataFrame) -> DataFrame:
    """(path, name, version) of lockfiles made of [[package]] blocks (Cargo, Poetry, uv)."""
    blocks = files.select("path", F.explode(F.filter(F.split("text", r"\[\[package\]\]"), lambda b, n: n > 0)).alias("block"))
    field = lambda name: F.nullif(F.regexp_extract("block", rf'(?m)^{name} *= *"([^"]*)"', 1), F.lit(""))
    return blocks.select("path", field("name").alias("name"), field("version").alias("version")).where("name IS NOT NULL")


def tap_outcomes(logs: DataFrame, key: str = "run", text: str = "text") -> DataFrame:
    """(key, number, name, outcome) of the test lines of TAP logs: passed, failed or skipped."""
    pattern = r"^(not )?ok +([0-9]+)(?: +-)? *([^#]*?) *(?:# *(SKIP|TODO).*)?$"
    rows = logs.select(key, F.explode(F.split(text, "\r?\n")).alias("row")).where(F.col("row").rlike(pattern))
    part = lambda k: F.regexp_extract("row", pattern, k)
    outcome = F.when(part(4) != "", "skipped").when(part(1) != "", "failed").otherwise("passed")
    return rows.select(key, part(2).cast("int").alias("number"), part(3).alias("name"), outcome.alias("outcome"))


def tap_complete(logs: DataFrame, key: str = "run", text: str = "text") -> DataFrame:
    """(key, planned, seen, complete): whether a log has as many test lines as its plan says."""
    plan = logs.select(key, F.nullif(F.regexp_extract(text, r"(?m)^1\.\.([0-9]+)", 1), F.lit("")).cast("int").alias("planned"))
    seen = tap_outcomes(logs, key, text).groupBy(key).agg(F.count_distinct("number").cast("int").alias("seen"))
    return plan.join(seen, key, "left").select(key, "planned", F.coalesce("seen", F.lit(0)).alias("seen"), F.expr("coalesce(planned = coalesce(seen, 0), false)").alias("complete"))
