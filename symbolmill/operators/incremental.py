"""Change sets and incremental maintenance of an index."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolmill.functions.text import normalize_path


def parse_name_status(line: Column) -> Column:
    """struct<status, path> of a line of ``git diff --name-status``; null for other statuses than A, M and D."""
    ok = line.rlike(r"^[AMD]\s+.+$")
    names = F.create_map(*[F.lit(x) for x in ("A", "added", "M", "modified", "D", "deleted")])
    return F.when(ok, F.struct(F.try_element_at(names, F.substring(line, 1, 1)).alias("status"), F.regexp_extract(line, r"^[AMD]\s+(.+)$", 1).alias("path")))


def parse_porcelain(line: Column) -> Column:
    """struct<status, path> of a line of ``git status --porcelain``; null if it is none of the known kinds."""
    flags = F.substring(line, 1, 2)
    status = F.when(F.contains(flags, F.lit("M")), "modified").when(F.contains(flags, F.lit("A")), "added").when(F.contains(flags, F.lit("D")), "deleted").when(F.contains(flags, F.lit("?")), "added")
    return F.when(status.isNotNull(), F.struct(status.alias("status"), F.trim(F.substring(line, 4, 1 << 20)).alias("path")))


def status_of(raw: Column) -> Column:
    """added, modified or deleted for a status letter in any case and spacing (``??`` is added); null for others and null."""
    s = F.upper(F.trim(raw))
    return F.when(s == "A", "added").when(s == "M", "modified").when(s == "D", "deleted").when(s == "??", "added")


def clean_changes(changes: DataFrame) -> DataFrame:
    """(repo, path, status, changed_at): one change per change_id with a known status, paths with forward slashes."""
    w = Window.partitionBy("change_id").orderBy(F.col("arrived_at").desc_nulls_last(), F.col("path").asc_nulls_last(), F.col("status").asc_nulls_last())
    once = changes.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return once.select("change_id", "repo", normalize_path(F.col("path")).alias("path"), status_of(F.col("status")).alias("status"), "changed_at").filter("status is not null and path is not null")


def latest_changes(changes: DataFrame) -> DataFrame:
    """(path, status, changed_at): the last change of each path; of equal times the greater change_id."""
    last = clean_changes(changes).groupBy("path").agg(F.max(F.struct("changed_at", "change_id", "status")).alias("x"))
    return last.select("path", "x.status", "x.changed_at")


def scope(changes: DataFrame) -> DataFrame:
    """(repo, status, changes, paths): the change set's size."""
    return clean_changes(changes).groupBy("repo", "status").agg(F.count("*").alias("changes"), F.count_distinct("path").alias("paths"))


def merge(old: DataFrame, changes: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` without the files of changed paths, with the rows of ``new`` for those added or modified.

    ``old`` and ``new`` have the same columns, path among them; ``changes`` has one row per path. A path that is deleted
    goes, one that changed and has no new row goes too. Joining by path costs one shuffle of either side; an index stored by
    path needs none.
    """
    kept = old.join(changes.select("path"), "path", "left_anti")
    fresh = new.join(changes.filter("status <> 'deleted'").select("path"), "path", "left_semi")
    return kept.select(*old.columns).unionByName(fresh.select(*old.columns))
