import subprocess

from pyspark.sql import functions as F

from symbolmill.api import Index
from symbolmill.sources.repo import scan
from symbolmill.streaming.live import current, follow_changes, usage_windows


def tree(root):
    files = {
        "src/a.ts": "import { b } from './b'\nexport function load(x) {\n  return helper(x)\n}\n", "src/b.ts": "export function helper(y) {\n  return y\n}\n", "src/__init__.py": "def init_db(x):\n  pass\n", ".github/w.sh": "go() {\n  x\n}\n",
        "node_modules/x.js": "function no() {}", "a.min.js": "x", "notes.txt": "no", "gen/g.py": "x = 1", ".gitignore": "gen/\n", "big.py": "#" * (5 * 1024 * 1024 + 1), "src/gen/k.py": "class K:\n  pass\n",
    }
    for p, text in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)


def test_scan(spark, tmp_path):
    tree(tmp_path)
    got = {r["path"]: r["language"] for r in scan(spark, str(tmp_path)).collect()}
    assert got == {"src/a.ts": "typescript", "src/b.ts": "typescript", "src/__init__.py": "python", ".github/w.sh": "shell", "src/gen/k.py": "python"}
    assert [r["path"] for r in scan(spark, str(tmp_path), ["src/a.ts", "gen/g.py", "none.py"]).collect()] == ["src/a.ts"]
    assert scan(spark, str(tmp_path), []).count() == 0


def test_index_and_operations(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    tree(root)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    git("add", "src", ".github", ".gitignore")
    git("commit", "-qm", "x")
    index = Index(spark, str(root), str(tmp_path / "store"))
    assert index.index_repository()["file_count"] == 5 and index.index_repository()["cached"]
    assert index.find_symbol("helper")["locations"][0]["file"] == "src/b.ts"
    assert index.find_symbol("helpr")["didYouMean"][0]["name"] == "helper"
    assert "return helper(x)" in index.get_function("load")
    assert index.get_class("K").startswith("File: src/gen/k.py:1") and "not found" in index.get_function("nothing")
    assert index.get_relevant_context("load").first()["name"] == "load"
    assert index.get_file_summary("./src/a.ts").first()["types"] == "function=1"
    assert [r["path"] for r in index.search_code("return", "**/*.ts").collect()] == ["src/a.ts", "src/b.ts"]
    assert index.build_dependency_graph(words_only=False, imports=True) == 3
    assert {r["kind"] for r in index.table("edges").select("kind").collect()} == {"reference", "import"}
    assert index.build_dependency_graph() == 1
    assert [(r["role"], r["text"].split("(")[0]) for r in index.get_context_rows("load").collect()][1:] == [("dependency", "export function helper")]
    assert [r["depth"] for r in index.get_dependency_tree("load").collect()] == [0, 1]
    assert index.get_function_with_context("load").first()["dependencies"] == 1
    assert {(r["path"], r["type"]) for r in index.find_symbol_references("helper").collect()} == {("src/a.ts", "usage"), ("src/b.ts", "definition")}
    assert index.get_repository_structure().count() > 0 and index.find_similar("load").count() >= 0
    assert index.get_related_symbols("load").first()["name"] == "helper"
    assert index.replace_symbol("helper", "export function helper2(y) {\n}").success
    assert not index.delete_symbol("helper").success  # the file has changed since
    (root / "src/__init__.py").unlink()
    index.index_git_changes(uncommitted=True)
    full = Index(spark, str(root), str(tmp_path / "store2"))
    full.index_repository()
    names = lambda i: sorted((r["file_path"], r["name"]) for r in i.table("symbols").select("file_path", "name").collect())
    assert names(index) == names(full) and ("src/b.ts", "helper2") in names(index)
    index.track(1, "find_symbol", "abcd", ["src/a.ts"])
    assert [(r["tool"], r["files"]) for r in index.get_savings().collect()] == [("find_symbol", 1)]
    assert {r["tool"]: r["calls"] for r in index.get_usage_stats(reset=True).collect()} == {"find_symbol": 1, None: 1}
    assert index.clear_cache() and not index.clear_cache()


def test_streams(spark, tmp_path):
    schema = "change_id bigint, repo string, path string, status string, changed_at timestamp, arrived_at timestamp"
    at = lambda s: F.to_timestamp(F.lit(f"2026-01-01 00:00:{s:02d}"))
    for k, (path, status) in enumerate([("a", "A"), ("a", "D"), ("b", "M")]):
        spark.range(1).select(F.lit(k).cast("bigint").alias("change_id"), F.lit("r").alias("repo"), F.lit(path).alias("path"), F.lit(status).alias("status"), at(k).alias("changed_at"), at(k).alias("arrived_at")).write.mode("append").parquet(str(tmp_path / "in"))
        follow_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r["path"]: r["status"] for r in current(spark, str(tmp_path / "out")).collect()} == {"a": "deleted", "b": "modified"}
    calls = "call_id bigint, ts timestamp, tool string, tokens bigint"
    spark.range(4).select(F.expr("id div 2").alias("call_id"), at(5).alias("ts"), F.lit(" X").alias("tool"), F.lit(3).cast("bigint").alias("tokens")).write.parquet(str(tmp_path / "calls"))
    q = usage_windows(spark.readStream.schema(calls).parquet(str(tmp_path / "calls"))).writeStream.format("memory").queryName("usage_w").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["tool"], r["calls"], r["tokens"]) for r in spark.table("usage_w").collect()] == [("x", 2, 6)]
