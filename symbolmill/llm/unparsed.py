"""Source files whose content the grammar of their language does not accept."""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolmill.functions.languages import language_of
from symbolmill.llm.syntax import judge, languages

LINE = re.compile(r"\r\n|\r|\n")
SCHEMA = "file_id bigint, repo string, language string, verdict string, token bigint, `offset` bigint, line bigint"


def _line(text: str, at: int) -> int | None:
    return len(LINE.findall(text, 0, at)) + 1 if at >= 0 else None


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("content").to_pylist()
        got = [judge(lang, text) for lang, text in zip(b.column("language").to_pylist(), texts)]
        yield pa.RecordBatch.from_arrays(
            [b.column("file_id"), b.column("repo"), b.column("language"), pa.array([v or "ok" for v, _, _ in got], pa.string()), pa.array([at for _, at, _ in got], pa.int64()),
             pa.array([o if o >= 0 else None for _, _, o in got], pa.int64()), pa.array([_line(t, o) for t, (_, _, o) in zip(texts, got)], pa.int64())],
            ["file_id", "repo", "language", "verdict", "token", "offset", "line"],
        )


def judged(files: DataFrame) -> DataFrame:
    """(file_id, repo, language, verdict, token, offset, line) of each file with a content in one of the sixteen languages, once.

    ``verdict`` is ok, ``wrong`` (an empty derivative: ``token`` is the index of the first token that cannot stand there) or
    ``cut`` (the end is not nullable: ``token`` is the number of tokens). ``offset`` counts the characters before that token and
    ``line`` is its line, from 1; both are null for ok. Where ``language`` is null the path's ending
    decides. Files of other languages and null contents are not judged; an empty content is ok, but for grammars that ask
    for more. Extra columns are ignored, null repos kept.
    """
    lang = F.coalesce(F.col("language"), language_of(F.col("path")))
    rows = files.select("file_id", "repo", lang.alias("language"), "content").filter(F.col("content").isNotNull() & F.col("language").isin(sorted(languages())))
    return rows.mapInArrow(_judge, SCHEMA).groupBy("file_id").agg(*[F.first(c).alias(c) for c in ("repo", "language", "verdict", "token", "offset", "line")])


def unparsed(files: DataFrame) -> DataFrame:
    """The rows of ``judged`` that are not ok."""
    return judged(files).filter("verdict <> 'ok'")


def rates(files: DataFrame) -> DataFrame:
    """Per repo (nulls being one) and language: files judged, files that do not parse, and their share."""
    return judged(files).groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum((F.col("verdict") != "ok").cast("int")).alias("unparsed")).withColumn("share", F.col("unparsed") / F.col("files"))
