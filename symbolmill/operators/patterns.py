"""Pattern search and references over file contents, with lines and columns, by built-in expressions."""

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolmill.functions.text import tokenize, tokenize_text


def lines_of_matches(content: Column, pattern: str) -> Column:
    """array<struct<line, text>> of the matches of a pattern that never matches nothing: the pieces between matches and the matches hold the line ends before each."""
    pieces = F.split(content, pattern, -1)
    found = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    ends = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    before = F.aggregate(
        F.arrays_zip(pieces.alias("p"), found.alias("m")),
        F.struct(F.lit(1).alias("line"), F.array().cast("array<int>").alias("at")),
        lambda a, x: F.struct(
            (a["line"] + F.coalesce(ends(x["p"]), F.lit(0)) + F.coalesce(ends(x["m"]), F.lit(0))).alias("line"),
            F.concat(a["at"], F.array(a["line"] + F.coalesce(ends(x["p"]), F.lit(0)))).alias("at"),
        ),
    )["at"]
    return F.filter(F.arrays_zip(before.alias("line"), found.alias("text")), lambda x: x["text"].isNotNull())


def valid(pattern: str) -> bool:
    """Whether a pattern compiles and cannot match the empty string; others find nothing."""
    try:
        return re.compile(pattern).search("") is None
    except re.error:
        return False


def search_patterns(files: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """(file_id, path, line, matched_text, context, score) of each line with matches, case-insensitive.

    Matches are grouped by the line on which they start; the context is two lines before to three after, marked and
    numbered; 100 points, 50 more if the line defines something, 10 for each pattern token in the context. ``limit`` keeps
    the first hits in order of path and line, and only then ranks them. Null contents are skipped; an invalid pattern, or one
    that matches nothing at all, finds nothing.
    """
    shape = "file_id bigint, path string, line int, matched_text string, context string, score int"
    if not valid(pattern):
        return files.sparkSession.createDataFrame([], shape)
    # a file that lacks the pattern is dropped before its matches are laid out
    hit = files.filter(F.col("content").rlike(f"(?iu){pattern}"))
    found = hit.select("file_id", "path", F.split("content", "\n").alias("_lines"), lines_of_matches(F.col("content"), f"(?iu){pattern}").alias("_m"))
    n = F.size("_lines")

    def describe(at: Column) -> Column:
        span = F.sequence(F.greatest(at - 2, F.lit(1)), F.least(at + 3, n))
        text = F.array_join(F.transform(span, lambda i: F.concat(F.when(i == at, "> ").otherwise("  "), i.cast("string"), F.lit(": "), F.element_at("_lines", i))), "\n")
        matched = F.array_join(F.transform(F.filter("_m", lambda m: m["line"] == at), lambda m: m["text"]), ", ")
        return F.struct(at.alias("line"), matched.alias("matched_text"), text.alias("context"), F.element_at("_lines", at).alias("_line"))

    # matches are grouped within the row that holds their file, so nothing is shuffled and no row carries a whole file
    hits = found.select("file_id", "path", F.explode(F.transform(F.array_distinct(F.transform("_m", lambda m: m["line"])), describe)).alias("h")).select("file_id", "path", "h.*")
    line = F.col("_line")
    bonus = F.when(F.contains(line, F.lit("function")) | F.contains(line, F.lit("class")) | F.contains(line, F.lit("def ")) | F.contains(line, F.lit("func ")), 50).otherwise(0)
    score = F.lit(100) + bonus
    hits = hits.withColumn("_t", tokenize(F.col("context")))
    for t in tokenize_text(pattern):
        score = score + F.when(F.array_contains("_t", t), 10).otherwise(0)
    out = hits.select("file_id", "path", "line", "matched_text", "context", score.cast("int").alias("score"))
    return out if limit is None else out.orderBy("path", "line").limit(limit).orderBy(F.desc("score"), "path", "line")


def word(name: str) -> str:
    """A pattern for a whole word; ASCII word characters are what parts words."""
    return f"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])"


def references(files: DataFrame, name: str) -> DataFrame:
    """(file_id, path, line, column, context) of each whole-word, case-sensitive occurrence; columns count from 0."""
    lines = files.filter(F.contains(F.col("content"), F.lit(name))).select("file_id", "path", F.posexplode(F.split("content", "\n")).alias("i", "context"))
    lines = lines.filter(F.contains(F.col("context"), F.lit(name)))
    pieces = F.split("context", word(name), -1)
    starts = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: F.aggregate(F.slice(pieces, 1, k), F.lit(0), lambda a, p: a + F.length(p)) + (k - 1) * len(name))
    found = lines.filter(F.size(pieces) > 1)
    return found.select("file_id", "path", (F.col("i") + 1).alias("line"), F.explode(starts).alias("column"), F.col("context"))


def all_references(files: DataFrame, names: DataFrame) -> DataFrame:
    """(name, file_id, line, hits): occurrences of each of ``names(name)`` as a whole word in any content, by word equality.

    Every content is cut once into its words, so one join answers all names, however many.
    """
    lines = files.filter("content is not null").select("file_id", F.posexplode(F.split("content", "\n")).alias("i", "line_text"))
    words = lines.select("file_id", (F.col("i") + 1).alias("line"), F.explode(F.regexp_extract_all("line_text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("name"))
    return words.join(names.select("name").distinct(), "name", "left_semi").groupBy("name", "file_id", "line").agg(F.count("*").alias("hits"))


def first_per_file(found: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` references of each file."""
    w = Window.partitionBy("file_id").orderBy("line", "column")
    return found.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")
