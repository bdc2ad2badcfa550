"""Problem 7: documents laid into containers of each capacity."""

from pyspark.sql import functions as F

from symbolmill.llm.encode import encode
from symbolmill.llm.packing import pack
from symbolmill.sources.tables import cut, table


def p7_packing(spark, sf_dir):
    """container, capacity, bin_id, doc_id, part, start and size (tokens) of every placed document part."""
    sizes = cut(encode(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", out="size", counts=True))
    items = sizes.select(F.col("doc_id").alias("item"), "size")
    return pack(items, table(spark, sf_dir, "containers")).withColumnRenamed("item", "doc_id")


def p7_fill(spark, sf_dir):
    """Bins, tokens and unused share of each container kind."""
    bins = p7_packing(spark, sf_dir).groupBy("container", "capacity", "bin_id").agg(F.sum("size").alias("fill"))
    return bins.groupBy("container", "capacity").agg(
        F.count("*").alias("bins"), F.sum("fill").alias("tokens"), (1 - F.sum("fill") / (F.count("*") * F.first("capacity"))).alias("unused")
    )


QUERIES = {"p7_packing": p7_packing, "p7_fill": p7_fill}
