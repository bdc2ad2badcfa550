"""A third of all rows in one group: copies of one text, near copies, one repository, one source."""

from pyspark.sql import functions as F

from symbolmill.llm.neardup import all_pairs, components, near_duplicates
from symbolmill.llm.packing import pack
from symbolmill.llm.provenance import not_handwritten


def text(words: int, salt: str) -> str:
    return f"concat_ws(' ', transform(sequence(1, {words}), i -> concat('w', i, {salt})))"


def test_copies_and_near_copies(spark):
    n = 120
    base = spark.range(n).withColumn("rid", F.col("id") * 2)
    same = text(100, "''")
    near = f"concat({text(100, chr(39) * 2)}, ' x', id)"
    own = text(100, "concat('_', id)")
    df = base.withColumn("text", F.expr(f"case when id % 3 = 0 then {same} when id % 3 = 1 then {near} else {own} end"))
    links, classes = near_duplicates(df.select("rid", "text"), bits=16)
    k = 2 * n // 3
    pairs = all_pairs(links, classes)
    assert pairs.count() == k * (k - 1) // 2 == pairs.distinct().count()
    groups = [r["count"] for r in components(links, classes).groupBy("group_id").count().collect()]
    assert sorted(groups) == [1] * (n // 3) + [k]
    assert classes.filter("rep = 0").count() == n // 3


def test_generated_family(spark):
    body = "concat_ws('\n', transform(sequence(1, 12), i -> concat('def get_', id, '_', i, '():\n    load(', i, ')\n    return ', i, '\n')))"
    df = spark.range(90).select(F.col("id").alias("file_id"), F.when(F.col("id") % 3 > 0, "hot").alias("repo"), F.concat(F.lit("src/a"), "id", F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.expr(f"case when id % 3 = 0 then {body} else concat('x', id, ' = 1') end").alias("content"))
    got = not_handwritten(df)
    assert got.count() == 30 and {(r["kind"], r["cluster_files"]) for r in got.collect()} == {("generated", 30)}


def test_one_size(spark):
    items = spark.range(3000).select(F.col("id").alias("item"), F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, 51).otherwise(49).alias("size"))
    placed = pack(items, spark.createDataFrame([("a", 100)], "container string, capacity int"), group=200)
    assert placed.count() == 3000 and placed.filter("size > 0").select("bin_id").distinct().count() <= 1020
