"""Streams of events: counts by window with late rows bounded by a watermark, and changes of files since the last batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def read_events(spark: SparkSession, folder: str, name: str, rows_as: DataFrame) -> DataFrame:
    """A stream of the files called `name` in a folder, with the columns of rows_as."""
    return spark.readStream.schema(rows_as.schema).option("pathGlobFilter", name).parquet(folder)


def tumbling_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """(event_type, start, n, value): by type and window; a window is given out once, when rows are later than it by `late`."""
    at = F.window("ts", width)
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return out.select("event_type", F.col("w.start").alias("start"), "n", "value")


def drain(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """All that is there now, in batches, and the result as a table: each batch is written by the executors into a folder of its own,
    which a repeated batch overwrites, so a lost driver goes on where it was and nothing is gathered in it. In complete mode the
    last batch is the result, in append mode all of them are; a stream without a batch gives an empty table."""
    spark, out = stream.sparkSession, f"{folder}/batches"

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None and not _exists(spark, out):
        return spark.createDataFrame([], stream.schema)
    found = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(out)
    if mode == "complete":
        found = found.join(F.broadcast(found.agg(F.max("batch").alias("batch"))), "batch")  # one row
    return found.select(*stream.columns)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def latest_version(spark: SparkSession, folder: str) -> int | None:
    """The number of the last whole version of a state in a folder; None without one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(at):
        return None
    whole = [int(s.getPath().getName()[len("version=") :]) for s in files.listStatus(at) if s.getPath().getName().startswith("version=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(whole, default=None)


def read_version(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of a state, the last by default."""
    version = latest_version(spark, folder) if version is None else version
    return spark.read.parquet(f"{folder}/version={version}")


def keep_versions(stream: DataFrame, folder: str, summarise: Callable[[DataFrame], DataFrame], fold: Callable[[DataFrame, DataFrame], DataFrame], progress: str, before: Callable[[int], None] | None = None) -> None:
    """Fold what is there now, batch by batch, into a state that is kept as versions: version n is what batch n makes of version
    n - 1. summarise(rows) is a batch's own state, fold(state, state) adds up two.

    A version is written whole by the executors, from the version before and the batch alone. A batch that is repeated, after
    a failure at any point, reads the same version before and writes the same version again, so nothing counts twice and
    nothing is lost; a version that wasn't finished has no mark of success and is overwritten. `before` is called ahead of each
    write (tests let it fail)."""
    spark = stream.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        new = summarise(rows)
        state = fold(spark.read.parquet(f"{folder}/version={batch - 1}"), new) if batch > 0 else new
        if before:
            before(batch)
        state.write.mode("overwrite").parquet(f"{folder}/version={batch}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
