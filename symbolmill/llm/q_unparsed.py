"""Problem 4: files that do not parse."""

from symbolmill.llm.unparsed import rates, unparsed
from symbolmill.sources.tables import table


def _files(spark, sf_dir):
    return table(spark, sf_dir, "files", "file_id", "repo", "path", "language", "content")


def p4_files(spark, sf_dir):
    """Files that do not parse, with the token at which they fail."""
    return unparsed(_files(spark, sf_dir))


def p4_found(spark, sf_dir):
    """file_id of each file whose content is not valid syntax of its language."""
    return p4_files(spark, sf_dir).select("file_id")


def p4_rates(spark, sf_dir):
    """Share of files that do not parse per repo and language."""
    return rates(_files(spark, sf_dir))


QUERIES = {"p4_files": p4_files, "p4_found": p4_found, "p4_rates": p4_rates}
