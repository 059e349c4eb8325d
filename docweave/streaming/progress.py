"""Streaming counterparts: progress and running totals, event cursor and ring buffer, resumable map, answer log.

The windowed queries below them (tumbling counts, sessions, late-data deduplication) go beyond the reference.
All streams are started with an available-now trigger by `finished`, so they end with their input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import is_missing


def parquet_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """The Parquet file or folder `name` of `folder` as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def finished(stream: DataFrame, work: str, mode: str = "append") -> DataFrame:
    """Run the stream to the end of its input and read what it wrote. work: a folder of the shared file system."""
    spark = stream.sparkSession
    out, state = f"{work}/out", f"{work}/state"
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:
        # Complete results replace the last ones, batch by batch.
        query = writer.outputMode(mode).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def running_totals(calls: DataFrame, key: str) -> DataFrame:
    """Calls, errors, seconds and tokens so far by operation, in update or complete mode."""
    return calls.groupBy(key).agg(F.count("*").alias("completed"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.round(F.sum("seconds"), 2).alias("seconds"), F.sum("tokens").alias("tokens"))


def progress(groups: DataFrame, finished_groups: DataFrame) -> DataFrame:
    """stem, stage, total, completed, status of a map over groups, polled from its cache."""
    total = groups.groupBy("stem", "stage").agg(F.count("*").alias("total"))
    done = groups.join(finished_groups.select("fingerprint").distinct(), "fingerprint").groupBy("stem", "stage").agg(F.count("*").alias("completed"))
    joined = total.join(done, ["stem", "stage"], "left").fillna(0, ["completed"])
    status = F.when(F.col("completed") == 0, "idle").when(F.col("completed") < F.col("total"), "running").otherwise("done")
    return joined.withColumn("status", status)


def since(events: DataFrame, cursor: int, id_column: str = "event_id") -> DataFrame:
    return events.where(F.col(id_column) > cursor)


def newest(events: DataFrame, size: int = 100, id_column: str = "event_id") -> DataFrame:
    """The newest events, oldest first."""
    return events.orderBy(F.desc(id_column)).limit(size).orderBy(id_column)


def new_items(stream: DataFrame, cache_path: str, key: str, work: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: work on the batch's keys that the cache lacks and append the results to it."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(cache_path).select(key)
        except AnalysisException as e:
            if not is_missing(e):
                raise
            known = spark.createDataFrame([], batch.select(key).schema)
        work(batch.dropDuplicates([key]).join(known, key, "left_anti")).write.mode("append").parquet(cache_path)

    return step


# Beyond the reference ---------------------------------------------------------------------------------------------


def timed(events: DataFrame, late: str) -> DataFrame:
    """Events with their zone-less times read in the session's zone, and a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    windowed = timed(events, late).groupBy(F.window("ts", width), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start_at"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    grouped = timed(events, late).groupBy(F.session_window("ts", gap), "user_id")
    return grouped.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start_at"), F.col("session_window.end").alias("end_at"), "user_id", "n")


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    return timed(events, late).dropDuplicatesWithinWatermark(keys)
