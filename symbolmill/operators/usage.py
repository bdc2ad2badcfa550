"""Accounting of tool calls."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolmill.functions.text import normalize_path

#: Calls that are not accounted.
EXCLUDED = ("get_usage_stats", "clear_cache", "index_repository")


def clean_calls(log: DataFrame) -> DataFrame:
    """One row per call_id with its tool's name in lower case, counts that are null or negative as 0, null lists as empty; calls without a tool are left out."""
    w = Window.partitionBy("call_id").orderBy(F.col("arrived_at").desc_nulls_last())
    once = log.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    zero = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).alias(c)
    return once.select("call_id", "ts", F.lower(F.trim("tool")).alias("tool"), zero("response_chars"), zero("tokens"), F.coalesce("files", F.array().cast("array<string>")).alias("files")).filter("tool is not null and tool <> ''")


def usage_stats(log: DataFrame, total: bool = False) -> DataFrame:
    """(tool, calls, total_tokens, total_chars, avg_tokens) per tool; with ``total`` also a row of null tool over all."""
    calls = clean_calls(log).filter(~F.col("tool").isin(*EXCLUDED))
    grouped = calls.rollup("tool") if total else calls.groupBy("tool")
    return grouped.agg(F.count("*").alias("calls"), F.sum("tokens").alias("total_tokens"), F.sum("response_chars").alias("total_chars"), F.floor(F.avg("tokens") + 0.5).cast("bigint").alias("avg_tokens"))


def first_touch(log: DataFrame, files: DataFrame) -> DataFrame:
    """(tool, files, full_read_tokens): what reading whole files would have cost, each file charged to the first tool that touched it.

    Of equal times the lower call_id is first. Files that are not indexed cost nothing but count.
    """
    touched = clean_calls(log).filter(~F.col("tool").isin(*EXCLUDED)).select("call_id", "ts", "tool", F.explode(F.array_distinct("files")).alias("path")).filter("path is not null")
    first = touched.groupBy("path").agg(F.min_by("tool", F.struct(F.col("ts").isNull(), "ts", "call_id")).alias("tool"))
    cost = files.groupBy("path").agg(F.ceil(F.max("size") / 4).cast("bigint").alias("cost"))
    return first.join(cost, "path", "left").groupBy("tool").agg(F.count("*").alias("files"), F.coalesce(F.sum("cost"), F.lit(0)).alias("full_read_tokens"))


def savings(log: DataFrame, files: DataFrame) -> DataFrame:
    """(tool, calls, total_tokens, files, full_read_tokens, saved): per tool what was answered, the files first touched by it, what reading them whole would have cost, and the difference, at least 0."""
    both = usage_stats(log).join(first_touch(log, files), "tool", "left")
    full = F.coalesce("full_read_tokens", F.lit(0))
    return both.select("tool", "calls", "total_tokens", F.coalesce("files", F.lit(0)).alias("files"), full.alias("full_read_tokens"), F.greatest(full - F.col("total_tokens"), F.lit(0)).alias("saved"))


#: Where answers name files, the path being the first group.
PATH_FORMS = (r"(?m)File:\s*([^\n:]+?)(?::\d+)?$", r"(?m)^\s+([a-zA-Z][\w/\\.-]+\.\w+):\d+", r'"filePath":\s*"([^"]+)"', r'"file":\s*"([^"]+)"')


def response_paths(text: Column) -> Column:
    """The distinct paths that an answer names: without blanks inside, with a dot, slashes forward, without a leading ``./`` or slash; null for null."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in PATH_FORMS])
    trimmed = F.transform(found, lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.array_distinct(F.transform(F.filter(trimmed, lambda p: (p != "") & ~F.contains(p, F.lit(" ")) & F.contains(p, F.lit("."))), lambda p: normalize_path(p)))
