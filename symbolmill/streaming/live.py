"""A change stream kept as an index, and usage per window of time."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symbolmill.operators.incremental import clean_changes


def usage_windows(calls: DataFrame, size: str = "1 hour", late: str = "14 days") -> DataFrame:
    """(window_start, tool, calls, tokens) of a stream of calls, each call_id once; rows later than ``late`` are dropped by the watermark."""
    clean = calls.withColumn("tool", F.lower(F.trim("tool"))).filter("tool is not null and tool <> '' and ts is not null")
    once = clean.withWatermark("ts", late).dropDuplicatesWithinWatermark(["call_id"])
    tokens = F.sum(F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)))
    return once.groupBy(F.window("ts", size), "tool").agg(F.count("*").alias("calls"), tokens.alias("tokens")).select(F.col("window.start").alias("window_start"), "tool", "calls", "tokens")


def follow_changes(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the last status of each path in the parquet table ``target``, one version a micro-batch.

    A version is written under its batch's number and named last, so that a batch that is run again after a lost driver
    replaces its own version only; readers take the greatest number that is complete (``current``).
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        news = clean_changes(batch).select("path", "status", "changed_at", "change_id")
        old = current(spark, target, before=number)
        every = news if old is None else old.unionByName(news)
        last = every.groupBy("path").agg(F.max(F.struct("changed_at", "change_id", "status")).alias("x"))
        last.select("path", "x.status", "x.changed_at", "x.change_id").write.mode("overwrite").parquet(f"{target}/v={number}")

    return changes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The last complete version of ``target`` (below ``before``), None if there is none."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    done = [v for v in done if before is None or v < before]
    return spark.read.parquet(f"{target}/v={max(done)}") if done else None
