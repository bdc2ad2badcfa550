import random

from symbolmill.llm.packing import pack


def check(rows, items, cap):
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r["item"], []).append((r["start"], r["size"]))
        bins[r["bin_id"]] = bins.get(r["bin_id"], 0) + r["size"]
    assert sorted(by) == sorted(i for i, _ in items)
    for i, s in items:
        at = 0
        for start, size in sorted(by[i]):
            assert start == at
            at += size
        assert at == (s or 0)
        assert len(by[i]) == 1 or s > cap
    assert max(bins.values()) <= cap
    return bins


def test_pack(spark):
    r = random.Random(1)
    items = [(i, r.choice([0, None, r.randrange(1, 40), r.randrange(1, 400), 100, 33])) for i in range(3000)]
    df = spark.createDataFrame(items, "item bigint, size int")
    caps = spark.createDataFrame([("a", 100), ("b", None), ("c", 0), ("d", 10_000)], "container string, capacity int")
    rows = pack(df, caps, group=300).collect()
    for c, cap in (("a", 100), ("d", 10_000)):
        bins = check([x for x in rows if x["container"] == c], items, cap)
        assert len(bins) <= 1.03 * sum(s or 0 for _, s in items) / cap + 2
    assert {x["container"] for x in rows} == {"a", "d"}


def test_pack_edges(spark):
    caps = spark.createDataFrame([("a", 100)], "container string, capacity int")
    df = spark.createDataFrame([(1, 0), (2, None)], "item bigint, size int")
    assert {(r["item"], r["size"]) for r in pack(df, caps).collect()} == {(1, 0), (2, 0)}
    assert pack(df.filter("false"), caps).count() == 0
    big = spark.createDataFrame([(i, 60) for i in range(50)], "item bigint, size int")
    assert pack(big, caps, group=10).select("bin_id").distinct().count() == 50
