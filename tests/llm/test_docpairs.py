from symbolmill.llm.docpairs import documentation, documented, lexed, pairs

ROWS = [
    (1, "loadQueue", "/**\n * Load queue, but never a raw index.\n * @param a the ordering to use\n */", "function loadQueue(a) { return a }"),
    (2, "loadQueue", "/**\n * Load queue.\n * @param a the ordering to use\n */", "function loadQueue(a) { return a }"),
    (3, "find_it", None, 'def find_it(a: "x" = ":", b={1: "one"}) -> int:\n    r"""Retries with half the voice.\n    """\n    return a'),
    (4, "find_it", None, 'def find_it(a):\n    b = {1: "no doc at all here"}\n    if a:\n        """not a doc of any kind"""\n    return b'),
    (5, "trim", "# TODO: document", "def trim(a)\nend"),
    (6, "trim", "// if (probe > 50) { rotateIndex(); }", "fn trim() {}"),
    (7, "trim", "// 返回 record 的数量，并在 index 为空时报错。", "fn trim() {}"),
    (8, "trim", "/// ---- helpers ----", "fn trim() {}"),
    (9, "trim", "// SPDX-License-Identifier: MIT", "fn trim() {}"),
    (10, "trim", '@doc """\nProverka: waits until the sprite settles.\n"""', "def trim(a) do\nend"),
    (11, "trim", None, None),
    (12, None, "/** Evicts idle depots. */", "int f() {}"),
    (13, "trim", "", ""),
    (14, "trim", "#", "def trim(): pass"),
    (15, "syncBundle", "/** Function sync bundle. */", "x"),
    (16, "trim", "/** eslint-disable-next-line no-shadow */", "x"),
    (17, "x", "/** " + "word " * 50_000 + "*/", "x"),
    (1, "loadQueue", "/**\n * Load queue, but never a raw index.\n */", "function loadQueue(a) { return a }"),
]


def test_documented(spark):
    rows = [(i, n, d, c, "function", None, "s") for i, n, d, c in ROWS] + [(90, "a", "/** Evicts idle depots. */", "x", "class", None, "s")]
    df = spark.createDataFrame(rows, "symbol_id bigint, name string, doc_comment string, code string, type string, indexed_at timestamp, signature string").selectExpr("*", "1 as pos", "2 as tok", "3 as zone")
    got = sorted(r["symbol_id"] for r in documented(df).collect())
    assert got == [1, 3, 7, 10, 12, 17]
    p = {r["symbol_id"]: r for r in pairs(df).collect()}
    assert p[3]["prose"] == "Retries with half the voice." and p[3]["signature"] == "s"
    assert documented(df.filter("false")).count() == 0


def test_islands_and_depth(spark):
    """Comments above are grouped by what interrupts them, in any language; brackets in strings and comments do not count, and an open one shows."""
    rows = [
        (1, "f", "// Waits until the sprite settles,\n// then answers.\n@Deprecated(1)\n// Never blocks the harbor.", "void f() { g(\"}\"); /* } */ }"), (2, "f", "# Trims idle depots first.", "def f(a)\n  { b: [1] }\nend"),
        (3, "f", "-- Moves all voices along.", "function f(a)\n  return { a, { 1 }\nend"), (4, "f", None, "fn f() -> T { (1) }"),
    ]
    df = spark.createDataFrame([(i, n, d, c, "function", None) for i, n, d, c in rows], "symbol_id bigint, name string, doc_comment string, code string, type string, indexed_at timestamp")
    got = {r["symbol_id"]: r for r in documentation(df).collect()}
    assert got[1]["doc"] == "// Waits until the sprite settles,\n// then answers.\n// Never blocks the harbor." and [got[i]["closed"] for i in (1, 2, 3, 4)] == [True, True, False, True] and got[4]["doc"] is None
    islands = {r["island"] for r in lexed(df).filter("symbol_id = 1 and kind = 'comment' and zone = 0").collect()}
    assert len(islands) == 2
    assert lexed(df).filter("zone = 1 and kind <> 'mark'").select("symbol_id").distinct().count() == 4
