import random

from symbolmill.llm.encode import SEGMENT, combine, decode_tree, element, encode, encode_text, encoding, join


def texts(n=200):
    r = random.Random(5)
    pieces = ["foo", " bar", "  ", "\n", "\n\n", "'s", "'", "'re", "l", " 12", "中文", "，", "é", "<|endoftext|>", "\t", "...", "don't", "🙂", "a" * 50, " " * 40, "'ll"]
    return ["".join(r.choice(pieces) for _ in range(r.randrange(1, 60))) for _ in range(n)]


def test_tree_equals_whole():
    enc = encoding()
    for t in texts():
        whole = enc.encode_ordinary(t)
        for leaf in (1, 2, 3, 7, 20):
            assert encode_text(enc, t, leaf) == whole, (t, leaf)
        assert decode_tree(enc, whole).decode() == t


def test_join_is_associative():
    enc = encoding()
    for t in texts(60):
        k, j = len(t) // 3, 2 * len(t) // 3
        a, b, c = [(x, enc.encode_ordinary(x)) for x in (t[:k], t[k:j], t[j:])]
        assert join(enc, join(enc, a, b), c)[1] == join(enc, a, join(enc, b, c))[1] == enc.encode_ordinary(t)


def test_encode_dataframe(spark):
    enc = encoding()
    rows = [(i, t, "x") for i, t in enumerate([None, "", " ", "<|endoftext|>", "word " * 400, "a" * 999, *texts(20)])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    for segment in (100, 1 << 18):
        got = {r["doc_id"]: r["ids"] for r in encode(df, "doc_id", "text", segment=segment, leaf=30).collect()}
        assert got == {i: enc.encode_ordinary(t) if t else [] for i, t, _ in rows}
    assert {r["n"] for r in encode(df.limit(2), "doc_id", "text", out="n", counts=True).collect()} == {0}
    assert encode(df.filter("false"), "doc_id", "text").count() == 0


def test_elements_are_a_monoid():
    """Any bracketing of any cuts gives the ids of the whole; counts follow ids."""
    enc, r = encoding(), random.Random(8)
    for t in [*texts(80), "a" * 300, "x1" * 90, " " * 90 + "b"]:
        at = sorted(r.randrange(len(t) + 1) for _ in range(5))
        parts = [element(enc, t[a:b]) for a, b in zip([0, *at], [*at, len(t)])]
        sizes = [e._replace(ids=len(e.ids)) for e in parts]
        while len(parts) > 1:
            k = r.randrange(len(parts) - 1)
            parts[k : k + 2] = [combine(enc, *parts[k : k + 2])]
            sizes[k : k + 2] = [combine(enc, *sizes[k : k + 2])]
        assert parts[0].ids == enc.encode_ordinary(t) and sizes[0].ids == len(parts[0].ids)


def test_texts_above_the_segment(spark):
    """Texts of many segments under the production parameters, joined level by level."""
    enc, r = encoding(), random.Random(4)
    long = ["".join(r.choice(["foo ", "bar", "\n\n", "中文", "'s ", "x" * 40, " " * 30, "12"]) for _ in range(n)) for n in (9000, 30000, 52000)]
    rows = [(i, t) for i, t in enumerate([*long, "z" * 40000, None, "short"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert max(len(t) for t in long) > 8 * SEGMENT
    got = {x["doc_id"]: x["ids"] for x in encode(df, "doc_id", "text").collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in rows}
    sizes = {x["doc_id"]: x["n"] for x in encode(df, "doc_id", "text", out="n", counts=True).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}
