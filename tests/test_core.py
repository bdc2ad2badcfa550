import hashlib
import math
import random
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from symbolmill.functions import text as T
from symbolmill.functions.text import format_bytes, fuzzy, may_hold
from symbolmill.operators import edits, graph, incremental, patterns, rank, structure, usage

SYMBOL = "symbol_id bigint, name string, type string, file_path string, ordinal int, line int, end_line int, code string, signature string, doc_comment string"


def symbols(spark, rows):
    return spark.createDataFrame([(i, n, t, p, i, i + 1, i + 2, c, s, None) for i, (n, t, p, c, s) in enumerate(rows)], SYMBOL).selectExpr("*", "1 as score", "2 as tokens", "'x' as token")


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_scalars(spark):
    assert one(spark, T.tokenize, "HTTPServer getUserData_v2 a.b/c foo(bar)") == ["http", "server", "get", "user", "data", "v2", "foo(bar)"]
    assert one(spark, T.tokenize, "The user of the App") == ["user", "app"] == T.tokenize_text("The user of the App")
    assert one(spark, T.tokenize, None) is None and one(spark, T.tokenize, "") == []
    assert round(one(spark, lambda c: T.similarity(c, F.lit("authenticate")), "athenticate"), 4) == 0.9167
    assert not one(spark, lambda c: T.fuzzy(c, F.lit("sitting"), 0.65), "kitten") and one(spark, lambda c: T.fuzzy(c, F.lit("sitting"), 0.57), "kitten")
    assert T.expand("auth") == ["auth", "authenticate", "authentication", "authorize", "authorized", "authorization"] == one(spark, T.expansion_column, "auth")
    assert T.expand("widget") == ["widget"] == one(spark, T.expansion_column, "widget")
    assert one(spark, T.estimate_tokens, "abcde") == 2 and one(spark, T.estimate_tokens, None) == 0
    assert [one(spark, T.format_bytes, n, "bigint") for n in (1023, 1024, 1572864, None)] == ["1023 B", "1.0 KB", "1.5 MB", None]
    match = lambda g, legacy: [bool(re.search(T.glob_pattern(g, legacy), p)) for p in ("a.ts", "src/a.ts", "src/b/a.ts")]
    assert match("**/*.ts", True) == [False, True, False] and match("**/*.ts", False) == [True, True, True] and match("src/*.ts", False) == [False, True, False]
    assert one(spark, lambda c: T.normalize_path(c, "/r/x"), "\\r\\x\\a\\b.py") == "a/b.py"


def test_search_scores(spark):
    df = symbols(spark, [("getUser", "function", "a", None, None), ("userService", "function", "a", None, None), ("parseConfig", "function", "b", None, None), (None, None, None, None, None)])
    got = {r["name"]: round(r["score"], 2) for r in rank.search(df.filter("name is not null"), "user").collect()}
    assert got == {"userService": 853.5, "getUser": 353.5}
    assert rank.search(df, "user").count() == 2
    bm = {r["name"]: r["score"] for r in rank.bm25_names(df.filter("name is not null"), "user").collect()}
    assert math.isclose(bm["getUser"], math.log(1.6), rel_tol=1e-9)
    assert rank.search(df.filter("false"), "user").count() == 0
    best = rank.search(df.filter("name is not null"), "getUser").first()
    assert best["match_reason"][:4] == ["exact name match", "name starts with query", "name contains query", "fuzzy name match"] and best["highlights"][0] == "getUser"


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(1, 20), (2, 30), (3, 5)], "id int, n int").withColumn("text", F.repeat(F.lit("abcd"), F.col("n")))
    assert [r["id"] for r in rank.within_budget(df, F.col("text"), ["id"], 45, 10).collect()] == [1]


def test_similar_and_related(spark):
    df = symbols(spark, [("x1", "function", "a", "x1 y1", None), ("x1", "function", "b", "z1", None), ("getUse", "class", "a", "call x1", None), ("other", "function", "c", None, None), (None, "function", "c", None, None)])
    got = {r["symbol_id"]: round(r["score"], 2) for r in rank.find_similar(df, "x1").collect()}
    assert got[1] == 66.67 and rank.find_similar(df, "nothing").count() == 0
    target = df.filter("symbol_id = 0").first().asDict()
    rel = {r["symbol_id"]: (r["score"], r["reason"]) for r in rank.related(df, target).collect()}
    assert rel[1] == (50, "used in code, same type") and rel[2] == (90, "same file, uses this symbol")


def test_suggest_and_did_you_mean(spark):
    df = symbols(spark, [("authService", "class", "b", None, None), ("author", "class", "a", None, None), ("zed", "class", "a", None, None), ("author", "class", "c", None, None)])
    assert [r["name"] for r in rank.suggest(df, "authentic").collect()] == ["authService"]
    assert [r["name"] for r in rank.suggest(df, "aut").collect()] == ["author", "authService"]
    assert [r["name"] for r in rank.did_you_mean(df, "authro").collect()] == ["author"]


FILES = [(1, "b.ts", "x\nfoo Bar\nbar foo bar\r\n"), (2, "a.ts", "function bar() {\n}\n_bar bar1 bar"), (3, "c.ts", None), (4, "d.ts", "")]


def test_patterns(spark):
    df = spark.createDataFrame(FILES, "file_id bigint, path string, content string").selectExpr("*", "1 as line", "'x' as context", "2 as score")
    got = {(r["file_id"], r["line"]): (r["matched_text"], r["score"]) for r in patterns.search_patterns(df, "bar").collect()}
    assert got == {(1, 2): ("Bar", 110), (1, 3): ("bar, bar", 110), (2, 1): ("bar", 160), (2, 3): ("bar, bar, bar", 110)}
    assert [(r["file_id"], r["line"]) for r in patterns.search_patterns(df, "bar", 2).collect()] == [(2, 1), (2, 3)]
    assert patterns.search_patterns(df, "x*").count() == 0 == patterns.search_patterns(df, "(").count()
    assert [(r["line"], r["text"]) for r in df.filter("file_id = 1").select(F.explode(patterns.lines_of_matches(F.col("content"), r"o\s+B|bar")).alias("m")).select("m.*").collect()] == [(2, "o B"), (3, "bar"), (3, "bar")]
    refs = sorted((r["file_id"], r["line"], r["column"]) for r in patterns.references(df, "bar").collect())
    assert refs == [(1, 3, 0), (1, 3, 8), (2, 1, 9), (2, 3, 10)]
    names = spark.createDataFrame([("bar",), ("foo",), ("bar",)], "name string")
    assert {(r["name"], r["file_id"], r["line"]): r["hits"] for r in patterns.all_references(df, names).collect()} == {("bar", 1, 3): 2, ("foo", 1, 2): 1, ("foo", 1, 3): 1, ("bar", 2, 1): 1, ("bar", 2, 3): 1}
    assert patterns.first_per_file(patterns.references(df, "bar"), 1).count() == 2


def test_graph(spark):
    df = symbols(spark, [("A", "function", "a.x", "A B", "sigA"), ("B", "function", "b.x", "B C", "s"), ("C", "function", "c.x", "C", "s"), ("DE", "variable", "d.x", "xBy", None)])
    names = {(r["src"].split(":")[1], r["dst_name"]) for r in graph.reference_edges(df, words_only=True).collect()}
    assert names == {("A", "B"), ("B", "C")}
    every = graph.reference_edges(df)
    assert {(r["src"].split(":")[1], r["dst_name"]) for r in every.collect()} == names | {("DE", "B")}
    edges = graph.expand_edges(every, df)
    root = df.filter("name = 'A'").select(graph.symbol_key().alias("node"))
    reach = lambda n: sorted(r["node"].split(":")[1] for r in graph.bfs(edges, root, n).collect())
    assert [reach(n) for n in (1, 2, 3, 9)] == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "B", "C"]]
    ctx = {r["src"].split(":")[1]: (r["dependencies"], r["tokens"]) for r in graph.smart_context(edges, df).collect()}
    assert ctx["A"] == (1, 2)
    loops = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", None), ("b", "c"), ("a", "b")], "src string, dst string")
    got = sorted((r["node"], r["depth"]) for r in graph.bfs(loops, spark.createDataFrame([("a",)], "node string"), 5).collect())
    assert got == [("a", 0), ("b", 1), ("c", 2)]
    files = spark.createDataFrame([(1, "src/x.ts", ["./src/x", "'y'", "", None]), (2, "lib/y.ts", None)], "file_id bigint, path string, imports array<string>")
    assert {(r["file_id"], r["import"], r["target_id"]) for r in graph.import_edges(files).collect()} == {(1, "./src/x", 1), (1, "'y'", 2)}


def test_names_in_words_equal_brute_force(spark):
    r = random.Random(3)
    words = sorted({"".join(r.choice("abé_") for _ in range(r.randrange(1, 25))) for _ in range(80)} | {"tariff_walker_tariff_walker", "a"})
    names = sorted({w[i : i + n] for w in words[::3] for n in (1, 2, 3, 5, 7, 8, 9, 15) for i in range(0, len(w) - n + 1, 4)} | {"", "walker_t", "x" * 30, "tariff_x"})
    got = graph.names_in_words(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert sorted((x["word"], x["name"]) for x in got) == sorted((w, n) for w in words for n in names if n and n in w)


def shuffled_rows(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    return sum(x.shuffleWriteRecords() for x in iter_java(store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)))


def iter_java(seq):
    return (seq.apply(i) for i in range(seq.size()))


def test_names_of_many_lengths_shuffle_no_more_rows_than_words_have_characters(spark):
    word = "".join(random.Random(4).choice("abcdefgh") for _ in range(4000))
    names = [word[n : 2 * n] for n in range(100, 1100, 10)]
    before = shuffled_rows(spark)
    got = graph.names_in_words(spark.createDataFrame([(word,), ("abc",)], "word string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert sorted(x["name"] for x in got) == sorted(names) and {x["word"] for x in got} == {word}
    assert shuffled_rows(spark) - before < 5 * (len(word) + sum(map(len, names)))


def broadcasts(df):
    df.collect()  # the plan that ran is known then
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_import_edges_pass_no_table_through_the_driver(spark):
    files = spark.createDataFrame([(1, "src/x.ts", ["./src/x", "'y'"]), (2, "lib/y.ts", None)], "file_id bigint, path string, imports array<string>")
    words, names = spark.createDataFrame([("src/x",), ("y",)], "word string"), spark.createDataFrame([("x",), ("y",)], "name string")
    assert broadcasts(graph.names_in_words(words, names)) == 0 == broadcasts(graph.import_edges(files))


def test_import_links_of_rows_without_an_id(spark):
    files = spark.createDataFrame([(None, "a/main.c", ["unit/walker.h"]), (2, "b/unit/walker.h", None), (3, None, ["a/main.c"])], "file_id bigint, path string, imports array<string>")
    assert [tuple(x) for x in graph.import_links(files).collect()] == [("a/main.c", "b/unit/walker.h")]


def test_import_links_pass_no_table_through_the_driver(spark):
    files = spark.createDataFrame([(1, "src/x.ts", ["./y", "x.ts"]), (2, "lib/y.ts", ["'y'"])], "file_id bigint, path string, imports array<string>")
    links = graph.import_links(files)
    assert broadcasts(links) == 0
    assert {tuple(x) for x in links.collect()} == {("src/x.ts", "lib/y.ts"), ("src/x.ts", "src/x.ts"), ("lib/y.ts", "lib/y.ts")}


def test_structure(spark):
    paths = ["src/a.ts", "src/__init__.py", ".github/w.sh", "node_modules/x.js", "Debug/d.cs", "a.min.js", "notes.txt", "gen/a.py", "src/gen/a.py", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "file_id bigint, path string")
    patterns_ = structure.ignore_patterns("gen/\n# no\n\n")
    got = {r["path"]: r["i"] for r in df.select("path", structure.ignored(F.col("path"), patterns_).alias("i")).collect()}
    assert [p for p in paths if got[p]] == ["node_modules/x.js", "a.min.js", "gen/a.py"]
    assert [p for p in paths if p and structure.is_ignored(p, patterns_)] == ["node_modules/x.js", "a.min.js", "gen/a.py"]
    assert [r[0] for r in df.filter(structure.supported(F.col("path"))).select("path").collect()] == ["src/a.ts", "src/__init__.py", ".github/w.sh", "node_modules/x.js", "Debug/d.cs", "a.min.js", "gen/a.py", "src/gen/a.py"]
    tree = {(r["directory"], r["level"]): r["files"] for r in structure.path_tree(df, 2).collect()}
    assert tree == {("src", 1): 3, ("src/gen", 2): 1, ("Debug", 1): 1, ("gen", 1): 1}


def test_incremental(spark):
    lines = spark.createDataFrame([("R100\ta\tb",), ("A\tx",), ("M\ty",), ("D\tz",), (None,)], "l string")
    assert [tuple(r["x"]) for r in lines.select(incremental.parse_name_status(F.col("l")).alias("x")).filter("x is not null").collect()] == [("added", "x"), ("modified", "y"), ("deleted", "z")]
    lines = spark.createDataFrame([("?? n",), (" M m",), ("A  a",), (" D d",), ("T  t",)], "l string")
    assert [tuple(r["x"]) for r in lines.select(incremental.parse_porcelain(F.col("l")).alias("x")).filter("x is not null").collect()] == [("added", "n"), ("modified", "m"), ("added", "a"), ("deleted", "d")]
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, v int")
    now = spark.createDataFrame([("a", 1), ("b", 2), ("d", 2)], "path string, v int")
    ch = spark.createDataFrame([(1, "r", "b", "A", 1, 1), (2, "r", "b", "m", 2, 2), (3, None, "c", "D", 3, 3), (4, "r", ".\\d", "??", 3, 3), (4, "r", ".\\d", "??", 3, 3), (5, "r", "a", None, 1, 1), (6, "r", "a", "R100", 1, 1)], "change_id bigint, repo string, path string, status string, changed_at int, arrived_at int")
    merged = incremental.merge(old, incremental.latest_changes(ch), now)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, now.collect()))  # as a full index would be
    assert incremental.merge(old.filter("false"), incremental.latest_changes(ch.filter("false")), now).count() == 0


def test_usage(spark):
    log = spark.createDataFrame(
        [(1, 1, " Find_Symbol", 40, 10, ["f", "g"], 1), (1, 1, " Find_Symbol", 40, 10, ["f", "g"], 2), (2, 2, "search_code", None, -5, ["f", "h", None], 1), (3, None, "search_code", 8, 3, None, 1), (4, 3, None, 1, 1, ["f"], 1), (5, 3, "clear_cache", 1, 1, ["q"], 1)],
        "call_id bigint, ts int, tool string, response_chars bigint, tokens bigint, files array<string>, arrived_at int",
    )
    got = {r["tool"]: tuple(r)[1:] for r in usage.usage_stats(log, total=True).collect()}
    assert got == {"find_symbol": (1, 10, 40, 10), "search_code": (2, 3, 8, 2), None: (3, 13, 48, 4)}
    files = spark.createDataFrame([("f", 10), ("g", 4)], "path string, size bigint")
    assert {r["tool"]: (r["files"], r["full_read_tokens"]) for r in usage.first_touch(log, files).collect()} == {"find_symbol": (2, 4), "search_code": (1, 0)}


@pytest.mark.parametrize(("mode", "want"), [("insert", "a\nb\nX\nY\nc"), ("replace", "a\nX\nY\nc"), ("delete", "a\nc")])
def test_splice(spark, tmp_path, mode, want):
    df = spark.createDataFrame([("a\nb\nc", 2, 2)], "content string, line int, end_line int")
    assert df.select(edits.splice(F.col("content"), F.col("line"), F.col("end_line"), F.lit("X\nY"), mode)).first()[0] == want
    (tmp_path / "f.py").write_text("a\nb\nc")
    symbol = {"file_path": "f.py", "name": "b", "line": 2, "end_line": 2, "code": "b"}
    assert edits.edit_file(str(tmp_path), symbol, mode, None if mode == "delete" else "X\nY").success and (tmp_path / "f.py").read_text() == want
    if mode != "insert":
        assert not edits.edit_file(str(tmp_path), symbol, mode, "Z").success


def test_splices_and_sizes_of_all_rows(spark, tmp_path):
    from symbolmill.plans import registry

    texts = {1: "a\nb\nc\nd", 2: "x\r\ny\n", 3: None}
    sizes = [0, 1023, 1024, 1075, 1126, 2406, 1048576, 1101005, 1048576 * 5 // 4, 1024 * 5 // 4, None]
    files = [(i, "r", f"f{i}.py", "python", n, 4, [], [], texts.get(i), None) for i, n in enumerate(sizes)]
    places = [(1, 1, 1), (1, 2, 3), (1, 4, 4), (2, 1, 2), (3, 1, 1), (2, 2, 2)]
    symbols = [(k, f, "r", f"f{f}.py", k, f"n{k}", "function", a, b, None) for k, (f, a, b) in enumerate(places, 19)]
    spark.createDataFrame(files, "file_id bigint, repo string, path string, language string, size bigint, lines int, imports array<string>, exports array<string>, content string, indexed_at timestamp").write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame(symbols, "symbol_id bigint, file_id bigint, repo string, file_path string, ordinal int, name string, type string, line int, end_line int, indexed_at timestamp").write.parquet(f"{tmp_path}/symbols.parquet")
    queries = registry.queries()
    for mode in ("insert", "replace", "delete"):
        want = {}
        for k, (f, a, b) in enumerate(places, 19):
            if texts[f] is not None:
                lines = texts[f].split("\n")
                lines[(b if mode == "insert" else a - 1) : b] = [] if mode == "delete" else ["x = 1", ""]
                want[k] = hashlib.md5("\n".join(lines).encode()).hexdigest()
        assert {r["symbol_id"]: r["content_md5"] for r in queries[f"splice_{mode}_all"](spark, str(tmp_path)).collect()} == want

    def text(n):
        if n is None or n < 1024:
            return n if n is None else f"{n} B"
        by, unit = (1024, "KB") if n < 1048576 else (1048576, "MB")
        return f"{(Decimal(n) / by).quantize(Decimal('0.1'), ROUND_HALF_UP)} {unit}"

    assert {r["file_id"]: r["text"] for r in queries["format_bytes_all"](spark, str(tmp_path)).collect()} == {i: text(n) for i, n in enumerate(sizes)}


def test_trees_imports_and_context(spark):
    edges = spark.createDataFrame([("r", "a", "x"), ("r", "b", None), ("a", "c", "x"), ("b", "c", "x"), ("c", "r", "x"), ("a", None, "x")], "src string, dst string, kind string")
    roots = spark.createDataFrame([("r",)], "node string")
    assert sorted((x["node"], x["depth"], x["parent"]) for x in graph.tree(edges, roots, 3).collect()) == [("a", 1, "r"), ("b", 1, "r"), ("c", 2, "a"), ("r", 0, None)]
    files = spark.createDataFrame([(1, "src/a.ts", ["./b", None]), (2, "lib/b.ts", []), (3, None, ["'./b'"])], "file_id bigint, path string, imports array<string>")
    symbols = spark.createDataFrame([("src/a.ts", "f", 1, "function", "f()", "b()"), ("lib/b.ts", "b", 1, "function", None, "xy"), ("lib/b.ts", "c", 4, "variable", "s", None)], "file_path string, name string, line int, type string, signature string, code string")
    links = graph.import_links(files)
    assert [tuple(x) for x in links.collect()] == [("src/a.ts", "lib/b.ts")]
    assert sorted(tuple(x) for x in graph.expand_imports(links, symbols).collect()) == [("src/a.ts:f:1", "lib/b.ts:b:1"), ("src/a.ts:f:1", "lib/b.ts:c:4")]
    assert [tuple(x) for x in graph.import_degrees(links, symbols).collect()] == [("src/a.ts:f:1", 2)]
    e = spark.createDataFrame([("src/a.ts:f:1", "lib/b.ts:b:1")] * 2 + [("src/a.ts:f:1", "src/a.ts:f:1"), ("src/a.ts:f:1", "gone")], "src string, dst string")
    got = sorted((x["role"], x["key"], x["text"], x["tokens"]) for x in graph.context_rows(e, symbols).filter("src = 'src/a.ts:f:1'").collect())
    assert got == [("code", "src/a.ts:f:1", "b()", 1), ("dependency", "lib/b.ts:b:1", "xy", 1)]
    assert graph.import_links(files.filter("false")).count() == 0


def test_paths_and_savings(spark):
    answer = 'File: lib\\app.js:42\nx\n   src/b.py:7\n{"filePath": "./c/d.ts", "file": "no dot"}\n"file": "e f.ts"\nFile: lib/app.js\n'
    df = spark.createDataFrame([(1, answer), (2, None), (3, "")], "i int, text string")
    got = {r["i"]: r["p"] for r in df.select("i", usage.response_paths(F.col("text")).alias("p")).collect()}
    assert got == {1: ["lib/app.js", "src/b.py", "c/d.ts"], 2: None, 3: []}
    log = spark.createDataFrame([(1, None, "A ", 8, 2, ["x", "y"], None), (2, None, "b", 400, 100, ["x"], None)], "call_id bigint, ts timestamp, tool string, response_chars bigint, tokens bigint, files array<string>, arrived_at timestamp")
    files = spark.createDataFrame([("x", 41), ("y", None)], "path string, size bigint")
    assert {tuple(r) for r in usage.savings(log, files).collect()} == {("a", 1, 2, 2, 11, 9), ("b", 1, 100, 0, 0, 0)}


def test_sizes_as_text(spark):
    sizes = [0, 1023, 1024, 1075, 1076, 1126, 1127, 1048575, 1048576, 5 * 1024 * 1024 + 52429, None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, n bigint")
    got = [r["t"] for r in df.select("i", format_bytes(F.col("n")).alias("t")).orderBy("i").collect()]
    assert got == ["0 B", "1023 B", "1.0 KB", "1.0 KB", "1.1 KB", "1.1 KB", "1.1 KB", "1024.0 KB", "1.0 MB", "5.1 MB", None]


def test_words_that_texts_may_hold(spark):
    """The cheap test never leaves out a text with a token that is similar enough."""
    r = random.Random(6)
    words = ["authentication", "configuration", "load", "token", "serializeGraphNode", "cache"]
    for x in words:
        for threshold in (0.7, 0.8, 0.85):
            rows = []
            for _ in range(40):
                t = list(x.lower())
                for _ in range(r.randrange(4)):
                    k = r.randrange(len(t) + 1)
                    t[k : k + r.randrange(2)] = r.choice(["", "q", "ab"])
                rows.append(("zz " + "".join(t) + " yy", "".join(t)))
            df = spark.createDataFrame(rows, "text string, t string")
            assert df.filter(fuzzy(F.lit(x), F.col("t"), threshold) & ~may_hold(F.col("text"), x, threshold)).count() == 0
