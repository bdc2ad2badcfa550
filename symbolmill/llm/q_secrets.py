"""Problem 1: credentials in files and symbols."""

from pyspark.sql import functions as F

from symbolmill.llm.secrets import find_secrets, redact_secrets
from symbolmill.sources.tables import table


def records(spark, sf_dir):
    """(kind, record_id, text) of file contents and symbol codes."""
    files = table(spark, sf_dir, "files").select(F.lit("file").alias("kind"), F.col("file_id").alias("record_id"), F.col("content").alias("text"))
    symbols = table(spark, sf_dir, "symbols").select(F.lit("symbol").alias("kind"), F.col("symbol_id").alias("record_id"), F.col("code").alias("text"))
    return files.unionByName(symbols)


def p1_found(spark, sf_dir):
    """kind, record_id and line of each literal credential."""
    return find_secrets(records(spark, sf_dir)).select("kind", "record_id", "line").distinct()


def p1_spans(spark, sf_dir):
    """Each credential's line and the characters it takes in its text."""
    return find_secrets(records(spark, sf_dir))


def p1_redacted(spark, sf_dir):
    """Every text with its credentials, and nothing else, replaced."""
    return redact_secrets(records(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_spans": p1_spans, "p1_redacted": p1_redacted}
