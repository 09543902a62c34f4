"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Setting by which shuffle files go when their job ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: ASCII letters, for the "lower-case A-Z only" rule.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(column, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset one below the warehouse (in
    local mode, where all is one machine, a temporary folder)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        local = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
        found = tempfile.mkdtemp(prefix="sparkloom-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/sparkloom"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def whole_rows(df: DataFrame):
    """All columns of df as one struct, so that names of our own can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def slices(batches, rows: int = 256):
    """Arrow batches in parts of a few rows, so that what is made of long texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), options: dict | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing.
    Shuffle files of the job go when it ends, for nothing reads them again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("overwrite").options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of materialized tables, once what was made of them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) undirected edges -> (node, component): the smallest id that each node reaches.

    Alternating large-star and small-star rounds over an edge table that is written to the shared folder after each, until
    each node has one edge, to a node that has none: O(log n) rounds, no vertex gathered in one place, a hub's star summed by
    map-side minima. Nodes without an edge are absent. Null ends and loops are ignored; an edge table without rows gives no
    rows. Joins are merge joins at every size: edges grow with the corpus.
    """
    current = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = materialize(current.distinct(), "cc")
    while True:
        # by node: its smaller ends, and whether it is a smaller end itself
        ends = current.select("u", "v", F.lit(False).alias("low")).union(current.select(F.col("v"), F.col("v"), F.lit(True)))
        state = ends.groupBy("u").agg(F.min(F.when(~F.col("low"), F.col("v"))).alias("m"), F.max(F.when(~F.col("low"), F.col("v"))).alias("top"), F.max("low").alias("low"))
        state = materialize(state.where("m IS NOT NULL"), "cc-state")
        if state.where("low OR m <> top").isEmpty():  # a forest of stars
            return current.toDF("node", "component").union(current.select("v", "v").distinct())
        # large star: larger neighbours y of x go to the smallest of x and its neighbours
        large = current.toDF("y", "x").join(state.select(F.col("u").alias("x"), "m").hint("merge"), "x", "left").select(F.col("y").alias("u"), F.coalesce("m", "x").alias("v"))
        large = materialize(large.distinct(), "cc-large")
        # small star: x and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.toDF("u", "v"))
        after = materialize(small.distinct(), "cc")
        release(current, state, large)
        current = after


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session: their Python may not have it on its path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="sparkloom-")) / "sparkloom.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted((root / "sparkloom").rglob("*.py")):
            out.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
