"""Structured Streaming forms of the run, limit, log and dedup jobs.

Event time is ``ts``. Each function takes a streaming DataFrame and returns one; sources and
sinks belong to the caller (``run_to_table`` is the usual one).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockflow.operators import runs
from blockflow.operators.logs import category


def timed(stream: DataFrame, delay: str) -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def page_stats(pages: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Page counts by status and block totals per tumbling window."""
    statused = runs.page_status(timed(pages, delay))
    failed = runs.is_failed(F.col("status"))
    return (statused.groupBy(F.window("ts", window)).agg(
        F.count("*").alias("pages"), F.count_if(failed).alias("pages_error"),
        F.count_if(~failed & (F.col("n_blocks") == 0)).alias("pages_empty"),
        F.sum(F.when(~failed, F.col("n_blocks")).otherwise(0)).alias("blocks"),
        F.sum(F.when(~failed, F.col("n_translated")).otherwise(0)).alias("translated"))
        .withColumn("window_start", F.col("window.start")).drop("window"))


def rate_counts(calls: DataFrame, window: str = "1 hour", limit: int = 500,
                delay: str = "1 hour") -> DataFrame:
    """Calls per client and window, and how many went over the limit."""
    n = timed(calls, delay).groupBy(F.window("ts", window), "client").agg(
        F.count("*").alias("calls"))
    return (n.withColumn("refused", F.greatest(F.lit(0), F.col("calls") - limit))
            .withColumn("window_start", F.col("window.start")).drop("window"))


def log_counts(lines: DataFrame, window: str = "1 hour", slide: str = "30 minutes",
               delay: str = "10 minutes") -> DataFrame:
    """Log categories per sliding window."""
    return (timed(lines, delay).withColumn("category", category(F.col("line")))
            .where(F.col("category").isNotNull())
            .groupBy(F.window("ts", window, slide), "category").agg(F.count("*").alias("n"))
            .withColumn("window_start", F.col("window.start")).drop("window"))


def first_requests(requests: DataFrame, keys: list[str], delay: str = "30 minutes") -> DataFrame:
    """The first of repeated requests; repeats within the watermark are dropped."""
    return timed(requests, delay).dropDuplicatesWithinWatermark(keys)


def liveness(touches: DataFrame, keys: list[str], gap: str = "30 minutes",
             delay: str = "10 minutes") -> DataFrame:
    """Spans in which an entry stays alive, as sessions."""
    return (timed(touches, delay).groupBy(F.session_window("ts", gap), *keys)
            .agg(F.count("*").alias("touches"), F.min("ts").alias("alive_from"))
            .drop("session_window"))


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what is there now, with a checkpoint beside the output, and read the result.

    Running it again processes only new input.
    """
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", path + "/data")
         .option("checkpointLocation", path + "/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path + "/data")
