"""The engine's operations over an index of parquet tables (files, symbols, edges, meta, usage)."""

import shutil
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolmill.functions.text import normalize_path
from symbolmill.operators import edits, extract, graph, incremental, patterns, rank, structure, usage
from symbolmill.sources import vcs
from symbolmill.sources.repo import scan

VERSION = "1.0.0"


class Index:
    """An index of one directory tree. Results are DataFrames unless a method says otherwise."""

    def __init__(self, spark: SparkSession, root: str, store: str | None = None):
        self.spark, self.root = spark, str(Path(root).resolve())
        self.store = store or f"{self.root}/.symbolmill"

    # tables

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.store}/{self._version()}/{name}")

    def _version(self) -> str:
        return (Path(self.store) / "current").read_text().strip()

    def _save(self, files: DataFrame, parsed: DataFrame | None = None) -> dict:
        """Write a new version of all tables, then name it current: readers never see half an index. ``parsed`` spares files that are parsed already."""
        version = f"v{int(datetime.now(timezone.utc).timestamp() * 1e6)}"
        base = f"{self.store}/{version}"
        files.write.parquet(f"{base}/sources")
        files = self.spark.read.parquet(f"{base}/sources")
        (extract.parse_files(files) if parsed is None else parsed).write.parquet(f"{base}/parsed")
        parsed = self.spark.read.parquet(f"{base}/parsed")
        files.join(parsed.select("file_id", "imports", "exports"), "file_id", "left").write.parquet(f"{base}/files")
        symbols = parsed.select("file_id", F.posexplode("symbols").alias("ordinal", "s")).select("file_id", "ordinal", "s.*").join(files.select("file_id", F.col("path").alias("file_path")), "file_id")
        symbols = symbols.withColumn("symbol_id", F.xxhash64("file_path", "ordinal")).withColumn("doc_comment", F.lit(None).cast("string"))
        symbols.sortWithinPartitions("name").write.parquet(f"{base}/symbols")
        counts = {"file_count": files.count(), "symbol_count": self.spark.read.parquet(f"{base}/symbols").count()}
        Path(self.store).mkdir(parents=True, exist_ok=True)
        (Path(self.store) / "current").write_text(version)
        return counts

    def _fingerprint(self, files: DataFrame) -> str:
        row = files.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("path", "size", "modified")).alias("x")).first()
        return f"{VERSION}:{row['n']}:{row['x']}"

    # 1, 2: building and dropping

    def index_repository(self, force: bool = False) -> dict:
        """Index the tree unless path, size and time of every file are as they were. Returns counts."""
        found = scan(self.spark, self.root)
        mark, note = self._fingerprint(found.drop("content")), Path(self.store) / "fingerprint"
        if not force and note.exists() and note.read_text() == mark:
            return {"file_count": self.table("files").count(), "symbol_count": self.table("symbols").count(), "cached": True}
        counts = self._save(found)
        note.write_text(mark)
        return {**counts, "cached": False}

    def clear_cache(self) -> bool:
        if Path(self.store).exists():
            shutil.rmtree(self.store)
            return True
        return False

    # 3-8: look-ups and searches

    def find_symbol(self, symbol: str, type: str | None = None) -> dict:
        """found, count and locations, or up to five suggestions in order of file and position."""
        rows = rank.find_symbol(self.table("symbols"), symbol, type).orderBy("file_path", "ordinal").select("file_path", "line", "type", "signature").collect()
        if rows:
            return {"found": True, "count": len(rows), "locations": [{"file": r[0], "line": r[1], "type": r[2], "signature": r[3]} for r in rows]}
        s = self.table("symbols")
        near = s.join(F.broadcast(rank.did_you_mean(s, symbol).limit(1000)), "name").orderBy("file_path", "ordinal").select("name", "file_path", "line").limit(5).collect()
        return {"found": False, "message": f'Symbol "{symbol}" not found', "didYouMean": [r.asDict() for r in near]}

    def _one(self, name: str, kind: str, path: str | None) -> list:
        found = rank.find_symbol(self.table("symbols"), name, kind)
        if path:
            found = found.filter(normalize_path(F.col("file_path")) == path.replace("\\", "/").removeprefix("./"))
        return found.orderBy("file_path", "ordinal").limit(100).collect()

    def _block(self, name: str, kind: str, path: str | None) -> str:
        rows = self._one(name, kind, path)
        if not rows:
            return f'{kind.capitalize()} "{name}" not found' + (f" in {path}" if path else "")
        if len(rows) > 1 and not path:
            return f'Multiple {kind}s named "{name}":\n' + "\n".join(f"  {r['file_path']}:{r['line']}" for r in rows) + "\nSpecify file_path."
        r = rows[0]
        return f"File: {r['file_path']}:{r['line']}\nType: {r['type']}\nSignature: {r['signature']}\n\n{r['code']}"

    def get_function(self, name: str, file_path: str | None = None) -> str:
        return self._block(name, "function", file_path)

    def get_class(self, name: str, methods: list[str] | None = None, file_path: str | None = None) -> str:
        text = self._block(name, "class", file_path)
        if not methods or not text.startswith("File:"):
            return text
        head, code = text.split("\n\n", 1)
        return head + "\n\n" + "\n\n".join(x for m in methods if (x := method_slice(code, m)))

    def get_relevant_context(self, query: str, max_tokens: int = 4000) -> DataFrame:
        """Ranked symbols within the budget; suggestions (score 0) if nothing hits."""
        symbols = self.table("symbols")
        best = rank.search(symbols, query, 50)
        text = F.concat_ws(" ", "name", "type", "file_path", F.get("highlights", F.lit(0)))
        fitting = rank.within_budget(best, text, [F.desc("score"), *rank.ORDER], max_tokens, 10)
        return fitting if best.limit(1).count() else rank.suggest(symbols, query)

    def get_file_summary(self, file_path: str) -> DataFrame:
        files = self.table("files").filter(normalize_path(F.col("path")) == file_path.replace("\\", "/").removeprefix("./"))
        return structure.file_summary(files, self.table("symbols"))

    def search_code(self, pattern: str, file_pattern: str | None = None, max_results: int = 10) -> DataFrame:
        files = self.table("files")
        return patterns.search_patterns(structure.glob_filter(files, file_pattern) if file_pattern else files, pattern, max_results)

    # 9-16: structure and graph

    def get_repository_structure(self, path: str | None = None, depth: int = 3) -> DataFrame:
        files = self.table("files")
        return structure.path_tree(files.filter(F.startswith("path", F.lit(path.rstrip("/") + "/"))) if path else files, depth)

    def get_dependencies(self, file_path: str, symbol: str | None = None) -> DataFrame:
        files = self.table("files").filter(F.col("path") == file_path)
        if symbol is None:
            return files.select("path", "imports", F.size("imports").alias("import_count"))
        wanted = self.table("symbols").filter((F.col("file_path") == file_path) & (F.col("name") == symbol))
        return wanted.select("symbol_id", "type").join(structure.used_symbols(wanted, files), "symbol_id", "left")

    def find_similar(self, symbol: str, limit: int = 5) -> DataFrame:
        return rank.find_similar(self.table("symbols"), symbol, limit)

    def get_usage_stats(self, reset: bool = False) -> DataFrame:
        path = f"{self.store}/usage"
        stats = usage.usage_stats(self.spark.read.parquet(path), total=True)
        if reset:
            rows = stats.collect()
            shutil.rmtree(path)
            return self.spark.createDataFrame(rows, stats.schema)
        return stats

    def get_savings(self) -> DataFrame:
        """Per tool: calls, tokens answered, files touched first by it, what reading them whole would have cost, and the tokens saved."""
        return usage.savings(self.spark.read.parquet(f"{self.store}/usage"), self.table("files"))

    def track(self, call_id: int, tool: str, response: str, files: list[str] | None = None) -> None:
        """Account for one call; where ``files`` are not given they are those that the response names."""
        if files is None:
            files = self.spark.createDataFrame([(response,)], "text string").select(usage.response_paths(F.col("text"))).first()[0]
        row = [(call_id, datetime.now(), tool, len(response), -(-len(response) // 4), files, datetime.now())]
        self.spark.createDataFrame(row, "call_id bigint, ts timestamp, tool string, response_chars bigint, tokens bigint, files array<string>, arrived_at timestamp").write.mode("append").parquet(f"{self.store}/usage")

    def index_git_changes(self, since: str | None = None, days: int | None = None, uncommitted: bool = False) -> dict:
        """Bring the index up to date with a change set; a tree that is no repository, or has no index yet, is indexed whole."""
        if not (Path(self.store) / "current").exists() or not vcs.is_repository(self.root):
            return self.index_repository()
        changes = vcs.uncommitted(self.spark, self.root) if uncommitted else vcs.changed_recently(self.spark, self.root, days) if days else vcs.changed_since(self.spark, self.root, since or vcs.main_branch(self.root))
        once = changes.groupBy("path").agg(F.max_by("status", F.when(F.col("status") == "deleted", 0).otherwise(1)).alias("status"))
        wanted = [r["path"] for r in once.filter("status <> 'deleted'").select("path").collect()]  # a commit's file list, read by the driver to plan the scan
        new = scan(self.spark, self.root, wanted)
        gone = once.select(F.xxhash64("path").alias("file_id"))
        parsed = self.table("parsed").join(gone, "file_id", "left_anti").unionByName(extract.parse_files(new))
        return self._save(incremental.merge(self.table("sources"), once, new), parsed)

    def build_dependency_graph(self, words_only: bool = True, imports: bool = False) -> int:
        """Write reference edges (names that code mentions as whole words, or without ``words_only`` contains anywhere) and, if asked for, import edges, which are all pairs of symbols of the two files; returns their number."""
        symbols = self.table("symbols")
        edges = graph.expand_edges(graph.reference_edges(symbols, words_only), symbols).withColumn("kind", F.lit("reference"))
        if imports:
            links = graph.import_links(self.table("files"))
            edges = edges.unionByName(graph.expand_imports(links, symbols).withColumn("kind", F.lit("import")))
        target = f"{self.store}/{self._version()}/edges"
        edges.write.mode("overwrite").parquet(target)
        return self.spark.read.parquet(target).count()

    def get_dependency_tree(self, symbol: str, max_depth: int = 2) -> DataFrame:
        roots = self.table("symbols").filter(F.col("name") == symbol).orderBy("file_path", "ordinal").limit(1).select(graph.symbol_key().alias("node"))
        return graph.tree(self.table("edges"), roots, max_depth).orderBy("depth", "parent", "node")

    def get_function_with_context(self, name: str) -> DataFrame:
        """Number and tokens of the function's direct dependencies; ``get_context_rows`` has their texts."""
        roots = self.table("symbols").filter((F.col("name") == name) & (F.col("type") == "function")).select(graph.symbol_key().alias("src"))
        return graph.smart_context(self.table("edges").join(roots, "src", "left_semi"), self.table("symbols"))

    def get_context_rows(self, name: str) -> DataFrame:
        """The function's code and the signatures of its direct dependencies, with tokens; the code comes first."""
        roots = self.table("symbols").filter((F.col("name") == name) & (F.col("type") == "function")).select(graph.symbol_key().alias("src"))
        rows = graph.context_rows(self.table("edges").join(roots, "src", "left_semi"), self.table("symbols"))
        return rows.join(roots, "src", "left_semi").orderBy("src", F.col("role") != "code", "key")

    # 17-21: references, edits, related

    def find_symbol_references(self, symbol: str, shown: int = 10) -> DataFrame:
        found = patterns.references(self.table("files"), symbol)
        place = rank.find_symbol(self.table("symbols"), symbol).orderBy("file_path", "ordinal").limit(1).select(F.col("file_path").alias("path"), "line", F.lit("definition").alias("type"))
        typed = found.join(F.broadcast(place), ["path", "line"], "left").withColumn("type", F.coalesce("type", F.lit("usage")))
        return patterns.first_per_file(typed, shown)

    def _edit(self, symbol: str, mode: str, code: str | None, file_path: str | None) -> edits.EditResult:
        found = rank.find_symbol(self.table("symbols"), symbol)
        rows = (found.filter(F.col("file_path") == file_path) if file_path else found).orderBy("file_path", "ordinal").limit(100).collect()
        if not rows:
            return edits.EditResult(False, f'Symbol "{symbol}" not found')
        if len(rows) > 1:
            return edits.EditResult(False, f'Multiple symbols named "{symbol}": ' + ", ".join(f"{r['file_path']}:{r['line']}" for r in rows))
        return edits.edit_file(self.root, rows[0].asDict(), mode, code)

    def insert_after_symbol(self, symbol: str, code: str, file_path: str | None = None) -> edits.EditResult:
        return self._edit(symbol, "insert", code, file_path)

    def replace_symbol(self, symbol: str, code: str, file_path: str | None = None) -> edits.EditResult:
        return self._edit(symbol, "replace", code, file_path)

    def delete_symbol(self, symbol: str, file_path: str | None = None) -> edits.EditResult:
        return self._edit(symbol, "delete", None, file_path)

    def get_related_symbols(self, symbol: str, limit: int = 20) -> DataFrame:
        symbols = self.table("symbols")
        target = symbols.filter(F.col("name") == symbol).orderBy("file_path", "ordinal").limit(1).first()
        return rank.related(symbols, target.asDict(), limit) if target else symbols.select("symbol_id", "name", F.lit(0).alias("score")).filter("false")


def method_slice(code: str, name: str) -> str | None:
    """The lines of a method: from the first line that names it with arguments to the end of its braces, or thirty lines."""
    import re

    lines = code.split("\n")
    start = next((i for i, x in enumerate(lines) if re.search(rf"^\s*(?:async\s+)?(?:(?:public|private|protected)\s+)?(?:[\w<>\[\]]+\s+)?{re.escape(name)}\s*\(", x)), None)
    if start is None:
        return None
    depth, opened = 0, False
    for i in range(start, len(lines)):
        for c in re.findall("[{}]", lines[i]):
            depth += 1 if c == "{" else -1
            opened |= c == "{"
            if opened and depth == 0:
                return "\n".join(lines[start : i + 1])
    return "\n".join(lines[start : start + 31])
