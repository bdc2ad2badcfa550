"""Problem 2: functions beside the prose of their documentation."""

from symbolmill.llm.docpairs import documented, pairs
from symbolmill.sources.tables import latest_rows, table


def p2_pairs(spark, sf_dir):
    """symbol_id, name, signature, code and prose of each documented function."""
    return pairs(table(spark, sf_dir, "symbols"), latest_rows(spark, sf_dir, "symbols", "symbol_id"))


def p2_found(spark, sf_dir):
    """symbol_id of each function whose documentation tells something of use."""
    return documented(table(spark, sf_dir, "symbols")).select("symbol_id")


QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs}
