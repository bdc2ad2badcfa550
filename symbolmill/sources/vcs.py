"""Change sets of a working copy, through git's command line without a shell."""

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolmill.operators.incremental import parse_name_status, parse_porcelain

SCHEMA = "status string, path string"


def _git(repo: str, *args: str) -> list[str]:
    out = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True).stdout
    return [x for x in out.split("\n") if x.strip()]


def is_repository(repo: str) -> bool:
    try:
        return bool(_git(repo, "rev-parse", "--git-dir"))
    except (subprocess.CalledProcessError, OSError):
        return False


def current_branch(repo: str) -> str:
    return _git(repo, "rev-parse", "--abbrev-ref", "HEAD")[0]


def main_branch(repo: str) -> str:
    """main or master, whichever exists (remote or local); main if neither."""
    names = [re.sub(r"^.*/", "", x.strip(" *")) for x in _git(repo, "branch", "-a")]
    return next((n for n in ("main", "master") if n in names), "main")


def _changes(spark: SparkSession, lines: list[str], parse) -> DataFrame:
    # renames become a deletion and an addition
    flat = []
    for x in lines:
        m = re.match(r"R\d*\t([^\t]+)\t(.+)$", x)
        flat += [f"D\t{m[1]}", f"A\t{m[2]}"] if m else [x]
    df = spark.createDataFrame([(x,) for x in flat], "line string")
    return df.select(parse(F.col("line")).alias("x")).filter("x is not null").select("x.status", "x.path").distinct()


def changed_since(spark: SparkSession, repo: str, since: str) -> DataFrame:
    """(status, path) between the merge base with ``since`` and HEAD."""
    if since.startswith("-"):
        raise ValueError("since must be a revision")
    return _changes(spark, _git(repo, "diff", "--name-status", f"{since}...HEAD"), parse_name_status)


def changed_recently(spark: SparkSession, repo: str, days: int) -> DataFrame:
    """(status, path) of what the log's last ``days`` days added, modified or renamed."""
    return _changes(spark, _git(repo, "log", "--name-status", f"--since={int(days)}.days.ago", "--pretty=format:", "--diff-filter=AMR"), parse_name_status)


def uncommitted(spark: SparkSession, repo: str) -> DataFrame:
    """(status, path) of the working copy."""
    return _changes(spark, _git(repo, "status", "--porcelain"), parse_porcelain)
