"""Problem 6: the corpus as ids of a public tokenizer."""

from symbolmill.llm.encode import encode
from symbolmill.sources.tables import table


def p6_ids(spark, sf_dir):
    """doc_id and byte_bpe_50k ids of each document; empty list for an empty or null text."""
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p6_counts(spark, sf_dir):
    """doc_id and number of ids of each document."""
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", out="n_tokens", counts=True)


QUERIES = {"p6_ids": p6_ids, "p6_counts": p6_counts}
