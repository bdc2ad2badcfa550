"""Problem 5: near-duplicate files and functions."""

from pyspark.sql import functions as F

from symbolmill.llm.neardup import all_pairs, components, near_duplicates
from symbolmill.sources.tables import cut, table


def records(spark, sf_dir):
    """File contents (even rids) and codes of functions (odd rids)."""
    files = table(spark, sf_dir, "files").select((F.col("file_id") * 2).alias("rid"), F.col("content").alias("text"))
    symbols = table(spark, sf_dir, "symbols").filter("type = 'function'").select((F.col("symbol_id") * 2 + 1).alias("rid"), F.col("code").alias("text"))
    return files.unionByName(symbols)


def _kind(c):
    return F.when(F.col(c).bitwiseAND(1) == 0, "file").otherwise("symbol")


def _id(c):
    return F.shiftright(c, 1)


def p5_found(spark, sf_dir):
    """kind, id_a, id_b of every pair of records at a similarity of 0.7 or more."""
    pairs = all_pairs(*near_duplicates(records(spark, sf_dir)))
    return pairs.select(_kind("a").alias("kind"), _id("a").alias("id_a"), _id("b").alias("id_b"))


def p5_groups(spark, sf_dir):
    """kind, id, class_id (least id of equal token lists), group_id (least id reachable over links) and the class's links."""
    links, classes = near_duplicates(records(spark, sf_dir))
    links = cut(links)
    degree = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count("*").alias("links"))
    groups = components(links, classes)
    return (
        classes.join(groups, "rid").join(degree, "rep", "left")
        .select(_kind("rid").alias("kind"), _id("rid").alias("id"), _id("rep").alias("class_id"), _id("group_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
