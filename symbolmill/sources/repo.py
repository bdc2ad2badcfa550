"""A directory tree as a table of files: a data source whose partitions are chunks of paths, read on executors.

Spark's file sources leave out names that begin with a dot or an underscore; this one lists the tree itself, prunes ignored
directories while walking, and gates files by ending and size before they are read.
"""

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from symbolmill.functions.languages import ENDINGS, language_of
from symbolmill.operators.structure import KEPT, LARGEST, ignore_patterns, is_ignored

CHUNK = 200


class Paths(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class RepoReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.chunk = int(options.get("chunk", CHUNK))
        self.only = [p for p in options.get("only", "").split("\n") if p]

    def _listed(self) -> Iterator[str]:
        gitignore = ""
        if os.path.exists(f := os.path.join(self.root, ".gitignore")):
            with open(f, encoding="utf-8", errors="replace") as h:
                gitignore = h.read()
        patterns = ignore_patterns(gitignore)
        if self.only:
            yield from (p for p in self.only if not is_ignored(p, patterns) and os.path.isfile(os.path.join(self.root, p)))
            return
        for here, dirs, names in os.walk(self.root):
            rel = os.path.relpath(here, self.root).replace(os.sep, "/")
            base = "" if rel == "." else rel + "/"
            dirs[:] = sorted(d for d in dirs if not is_ignored(base + d, patterns))
            yield from (base + n for n in sorted(names) if not is_ignored(base + n, patterns))

    def partitions(self):
        paths = [p for p in self._listed() if os.path.splitext(p)[1] in ENDINGS]
        return [Paths(paths[i : i + self.chunk]) for i in range(0, len(paths), self.chunk)] or [Paths([])]

    def read(self, partition):
        for p in partition.paths:
            full = os.path.join(self.root, p)
            try:
                size = os.path.getsize(full)
                if size > LARGEST:
                    continue
                with open(full, encoding="utf-8", errors="replace", newline="") as h:
                    text = h.read()
            except OSError:
                continue
            yield p, size, text.count("\n") + 1, text if size < KEPT else None, os.path.getmtime(full)


class RepoSource(DataSource):
    """``spark.read.format("repofiles").load(root)``; option ``only`` (lines) reads only those."""

    @classmethod
    def name(cls):
        return "repofiles"

    def schema(self):
        return "path string, size bigint, lines int, content string, modified double"

    def reader(self, schema):
        return RepoReader(self.options)


def scan(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """(file_id, path, language, size, lines, content, modified) of the supported files below ``root``; file_id is the path's hash."""
    spark.dataSource.register(RepoSource)
    r = spark.read.format("repofiles")
    if paths is not None:
        r = r.option("only", "\n".join(paths) or "\n")
    df = r.load(root)
    if paths is not None and not paths:
        df = df.filter("false")
    return df.select(F.xxhash64("path").alias("file_id"), "path", language_of(F.col("path")).alias("language"), "size", "lines", "content", "modified")
