"""Dependency graph: reference and import edges, bounded traversal, context of direct dependencies."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolmill.functions.text import estimate_tokens
from symbolmill.sources.tables import cut


def symbol_key(prefix: str = ""):
    """``file_path:name:line``."""
    return F.concat_ws(":", f"{prefix}file_path", f"{prefix}name", f"{prefix}line")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """(src, dst) once each, whatever their kinds; edges with a null end are left out."""
    return edges.filter("src is not null and dst is not null").select("src", "dst").distinct()


#: Characters of the pieces by which names look for words: a name takes the longest that fits into it.
PIECES = (8, 4, 2, 1)


def _pieces(text: str, sizes) -> Column:
    """The distinct numbers of all pieces of the column ``text`` of each length in the column ``sizes`` (an array)."""
    return F.explode(F.expr(f"array_distinct(flatten(transform({sizes}, n -> transform(sequence(1, length({text}) - n + 1), i -> xxhash64(substring({text}, i, n))))))"))


def names_in_words(words: DataFrame, names: DataFrame) -> DataFrame:
    """(word, name): each distinct name that is a substring of a distinct word; both are given once each.

    A name of word characters can occur in code only inside one run of word characters, so containment in code is
    containment in one of its words. A word that contains a name contains all pieces of the name, so that names of which a
    piece stands in no word drop out, and the others join by their rarest piece and are verified. Work grows with the
    length of the words and with the words that share the rarest pieces, not with words times names; a piece's row carries
    numbers in place of its word and name, which may be long. All joins are shuffled: by the size of the files they are read
    from, Spark takes pieces for small, and a broadcast would pass them through the driver.
    """
    size = F.coalesce(*[F.when(F.length("name") >= n, F.lit(n)) for n in PIECES])
    # at most as many numbers as PIECES has
    sizes = sorted(n for n in names.agg(F.collect_set(size)).first()[0] if n)
    if not sizes:
        return words.select("word", F.lit("").alias("name")).filter("false")
    fit = F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n <= F.length("word"))
    words = words.select("word", F.xxhash64("word").alias("_w"))
    names = names.filter("name <> ''").select("name", F.unhex(F.sha2("name", 256)).alias("_n"))
    parts = words.filter(F.length("word") >= sizes[0]).withColumn("fit", fit).select("_w", _pieces("word", "fit").alias("piece"))
    asked = names.withColumn("fit", F.array(size)).select("_n", _pieces("name", "fit").alias("piece"))
    known = parts.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece"))
    anchors = asked.join(known.hint("merge"), "piece", "left").groupBy("_n").agg(rarest.alias("_r")).filter("_r.n > 0").select("_n", F.col("_r.piece").alias("piece"))
    near = parts.join(anchors.join(names.hint("merge"), "_n").select("piece", "name").hint("merge"), "piece")
    # words of equal numbers are told apart here
    return near.join(words.hint("merge"), "_w").filter(F.contains("word", "name")).select("word", "name")


def reference_edges(symbols: DataFrame, words_only: bool = False) -> DataFrame:
    """(src, dst_name): which names the code of each symbol mentions, where a symbol of that name lies in another file.

    ``words_only`` asks for whole words, the cheaper and stricter meaning; otherwise any substring counts. An edge leads to
    every symbol of the name outside the source's file; it is kept by name, so that a name with many symbols stays one row.
    """
    code = symbols.filter("code is not null").select(symbol_key().alias("src"), "file_path", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"[A-Za-z0-9_]+"), F.lit(0)))).alias("word"))
    names = symbols.filter("name rlike '^[A-Za-z0-9_]+$'").groupBy("name").agg(F.count_distinct("file_path").alias("files"), F.min("file_path").alias("only"))
    if words_only:
        hits = code.withColumnRenamed("word", "name").join(names, "name")
    else:
        found = cut(names_in_words(code.select("word").distinct(), names.select("name")))
        hits = code.join(found, "word").join(names, "name")
    return hits.filter("files > 1 or only <> file_path").select("src", F.col("name").alias("dst_name")).distinct()


def expand_edges(by_name: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst) of reference edges kept by name."""
    dst = symbols.select(F.col("name").alias("dst_name"), "file_path", symbol_key().alias("dst"))
    return by_name.join(dst, "dst_name").filter(F.expr("not startswith(src, concat(file_path, ':'))")).select("src", "dst").distinct()


def _import_words(files: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(source, import, word) of the paths (word) that the imports of each ``source`` lead to, and (file_id, word) of all files."""
    held = cut(files.select("file_id", F.col("path").alias("word"), F.array_distinct("imports").alias("imports"), F.col(source).alias("_source")))
    clean = F.regexp_replace(F.regexp_replace("import", "^['\"]|['\"]$", ""), r"^\./", "")
    imports = held.select(F.col("_source").alias("source"), F.explode("imports").alias("import")).withColumn("name", clean).filter("name <> ''")
    paths = held.filter("word is not null").select("file_id", "word")
    found = names_in_words(paths.select("word").distinct(), imports.select("name").distinct())
    return imports.join(found.hint("merge"), "name").select("source", "import", "word"), paths


def import_edges(files: DataFrame) -> DataFrame:
    """(file_id, import, target_id): files whose path contains an import's text, quotes and one leading ``./`` taken off.

    Null lists and empty remainders find nothing.
    """
    hits, paths = _import_words(files, "file_id")
    return hits.join(paths.withColumnRenamed("file_id", "target_id").hint("merge"), "word").select(F.col("source").alias("file_id"), "import", "target_id").distinct()


def import_links(files: DataFrame) -> DataFrame:
    """(src_path, dst_path): which files' paths each file's imports lead to, once each. Symbol edges are kept in this form, since they are all pairs of symbols of the two files."""
    hits, _ = _import_words(files.filter("path is not null"), "path")
    return hits.select(F.col("source").alias("src_path"), F.col("word").alias("dst_path")).distinct()


def expand_imports(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst) of the symbols of linked files: every symbol of the importing file depends on every one of the imported."""
    ends = symbols.select("file_path", symbol_key().alias("key")).distinct()
    return links.join(ends.select(F.col("file_path").alias("src_path"), F.col("key").alias("src")), "src_path").join(ends.select(F.col("file_path").alias("dst_path"), F.col("key").alias("dst")), "dst_path").select("src", "dst").distinct()


def import_degrees(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dependencies): how many symbols each symbol depends on through its file's imports, without laying the edges out."""
    ends = symbols.select("file_path", symbol_key().alias("key")).distinct()
    sizes = ends.groupBy(F.col("file_path").alias("dst_path")).agg(F.count("*").alias("n"))
    per_file = links.join(sizes, "dst_path").groupBy("src_path").agg(F.sum("n").alias("dependencies"))
    return ends.join(per_file, ends["file_path"] == per_file["src_path"]).select(F.col("key").alias("src"), "dependencies")


def tree(edges: DataFrame, roots: DataFrame, levels: int = 2) -> DataFrame:
    """(root, node, depth, parent): ``bfs`` with the least of the nodes one level up that lead to each; a root has no parent."""
    reached = cut(bfs(edges, roots, levels))
    up = reached.select("root", F.col("node").alias("src"), (F.col("depth") + 1).alias("depth"))
    parents = up.join(distinct_edges(edges), "src").groupBy("root", F.col("dst").alias("node"), "depth").agg(F.min("src").alias("parent"))
    return reached.join(parents, ["root", "node", "depth"], "left").select("root", "node", "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent"))


def bfs(edges: DataFrame, roots: DataFrame, levels: int = 2) -> DataFrame:
    """(root, node, depth): nodes within ``levels`` levels of each root (the root itself is level 1, depth 0), at their least depth.

    Each level joins the frontier to the edges and drops what its root has seen. Frontiers are written to shared storage,
    so the lineage stays short.
    """
    step = distinct_edges(edges)
    seen = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in range(1, levels):
        new = frontier.join(step, frontier["node"] == step["src"]).select("root", F.col("dst").alias("node")).distinct().join(seen, ["root", "node"], "left_anti")
        frontier = cut(new.withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def by_file(reached: DataFrame) -> DataFrame:
    """(root, file_path, nodes): reached symbols per file."""
    path = F.regexp_replace("node", r":[^:]*:[^:]*$", "")
    return reached.groupBy("root", path.alias("file_path")).agg(F.count("*").alias("nodes"))


def context_rows(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, role, key, text, tokens): each symbol's code (role code), and the signature, or code where there is none, of each of its direct dependencies (role dependency).

    Symbols without edges have their code alone; nulls count as empty texts. Of symbols with equal keys the least text counts.
    """
    text = F.when(F.col("type").isin("function", "class") & F.col("signature").isNotNull(), F.col("signature")).otherwise(F.coalesce("code", F.lit("")))
    one = symbols.select(symbol_key().alias("key"), F.coalesce("code", F.lit("")).alias("code"), text.alias("text")).groupBy("key").agg(F.min("code").alias("code"), F.min("text").alias("text"))
    own = one.select(F.col("key").alias("src"), F.lit("code").alias("role"), "key", F.col("code").alias("text"))
    deps = distinct_edges(edges).filter("src <> dst").join(one.select("key"), F.col("src") == F.col("key"), "left_semi").join(one.select(F.col("key").alias("dst"), "text"), "dst")
    rows = own.unionByName(deps.select("src", F.lit("dependency").alias("role"), F.col("dst").alias("key"), "text"))
    return rows.withColumn("tokens", estimate_tokens(F.col("text")))


def smart_context(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dependencies, tokens): direct dependencies of each symbol, without itself, and the tokens of its code and their signatures.

    A function or class with a signature costs that, anything else its code.
    """
    cost = F.when(F.col("type").isin("function", "class") & F.col("signature").isNotNull(), estimate_tokens(F.col("signature"))).otherwise(estimate_tokens(F.col("code")))
    one = symbols.select(symbol_key().alias("key"), estimate_tokens(F.col("code")).alias("own"), cost.alias("cost")).groupBy("key").agg(F.max("own").alias("own"), F.max("cost").alias("cost"))
    deps = distinct_edges(edges).filter("src <> dst").join(one.select(F.col("key").alias("dst"), "cost"), "dst").groupBy("src").agg(F.count("*").alias("dependencies"), F.sum("cost").alias("cost"))
    return deps.join(one.select(F.col("key").alias("src"), "own"), "src").select("src", "dependencies", (F.col("own") + F.col("cost")).alias("tokens"))
