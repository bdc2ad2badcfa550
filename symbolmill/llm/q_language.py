"""Problem 8: missing or wrong language labels."""

from symbolmill.llm.language import languages
from symbolmill.sources.tables import table


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text", "lang")


def p8_languages(spark, sf_dir):
    """Language and confidence of each document and of each paragraph in another language."""
    return languages(_documents(spark, sf_dir))


def p8_found(spark, sf_dir):
    """doc_id, segment and lang of missing or wrong labels and of paragraphs in another language."""
    return languages(_documents(spark, sf_dir), cases_only=True).select("doc_id", "segment", "lang")


QUERIES = {"p8_found": p8_found, "p8_languages": p8_languages}
