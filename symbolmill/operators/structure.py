"""Files as a whole: ignore rules, gates, globs, summaries, path trees, index statistics and hash."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolmill.functions.languages import ENDINGS, ending
from symbolmill.functions.text import glob_pattern

#: Paths that a scan leaves out.
IGNORED = (
    ".git .svn .hg node_modules package-lock.json yarn.lock pnpm-lock.yaml .pnpm-store dist build out .next .nuxt .output .vercel bin obj packages *.nupkg .vs .vscode *.suo *.user *.sln.docstates "
    "[Dd]ebug [Rr]elease x64 x86 [Bb]in [Oo]bj TestResults *.dbmdl *.jfm _ReSharper* *.[Rr]e[Ss]harper *.DotSettings.user __pycache__ *.pyc *.pyo *.egg-info .pytest_cache .mypy_cache .tox venv .venv env .env virtualenv "
    "*.class *.jar *.war *.ear vendor/bundle .bundle vendor Cargo.lock composer.lock coverage .nyc_output *.lcov .cache .parcel-cache .turbo .idea *.swp *.swo *~ .DS_Store Thumbs.db desktop.ini *.min.js *.min.css *.map *.bundle.js "
    "*.log logs npm-debug.log* yarn-debug.log* yarn-error.log*"
).split()
#: Largest file that is indexed, and size below which its content is kept.
LARGEST, KEPT = 5 * 1024 * 1024, 512 * 1024


def ignore_patterns(gitignore: str = "") -> list[str]:
    """The fixed patterns and the lines of a .gitignore that are neither blank nor comments."""
    return [*IGNORED, *(x for x in map(str.strip, gitignore.split("\n")) if x and not x.startswith("#"))]


def _glob(p: str) -> str:
    # only the dot is escaped; brackets and other marks keep what they mean in a pattern
    return p.replace(".", r"\.").replace("*", ".*")


def ignored(path: Column, patterns: list[str] = IGNORED) -> Column:
    """Whether a scan leaves a path out: equal to a pattern, with a component equal to one, matched whole or by its last component by one with a star, or below one with a final slash."""
    plain = F.array(*[F.lit(p) for p in patterns])
    cond = F.array_contains(plain, path) | F.arrays_overlap(F.split(path, "/"), plain)
    stars = [_glob(p) for p in patterns if "*" in p]
    if stars:
        both = "^(?:" + "|".join(stars) + ")$"
        cond = cond | path.rlike(both) | F.element_at(F.split(path, "/"), -1).rlike(both)
    for p in patterns:
        if p.endswith("/"):
            cond = cond | F.startswith(path, F.lit(p))
    return F.coalesce(cond, F.lit(False))


def is_ignored(path: str, patterns: list[str]) -> bool:
    """``ignored`` of one path, for walking a directory."""
    parts = path.split("/")
    for p in patterns:
        if p == path or p in parts or p.endswith("/") and path.startswith(p):
            return True
        if "*" in p:
            try:
                if re.fullmatch(_glob(p), path) or re.fullmatch(_glob(p), parts[-1]):
                    return True
            except re.error:
                continue
    return False


def supported(path: Column) -> Column:
    """Whether a path's ending is one of the supported ones."""
    return F.coalesce(ending(path).isin(sorted(ENDINGS)), F.lit(False))


def size_gate(size: Column) -> Column:
    """indexed with its content (kept), indexed without (dropped), or skipped; null sizes are skipped."""
    return F.when(size > LARGEST, "skipped").when(size < KEPT, "kept").when(size.isNotNull(), "dropped").otherwise("skipped")


def glob_filter(files: DataFrame, glob: str, legacy: bool = False) -> DataFrame:
    """Files whose path a glob matches."""
    return files.filter(F.col("path").rlike(glob_pattern(glob, legacy)))


def file_summary(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, path, language, lines, size, first_imports, more_imports, exports, symbol_count, types): one row per file.

    ``types`` lists each symbol type with its count in order of first appearance; files without symbols have 0 and ''.
    Null lists are empty.
    """
    kinds = symbols.groupBy("file_id", "type").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    types = kinds.groupBy("file_id").agg(
        F.sum("n").alias("symbol_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "type", "n"))), lambda x: F.concat(x["type"], F.lit("="), x["n"].cast("string"))), ",").alias("types")
    )
    imports = F.coalesce("imports", F.array().cast("array<string>"))
    return files.join(types, "file_id", "left").select(
        "file_id", "path", "language", "lines", "size", F.array_join(F.slice(imports, 1, 10), ",").alias("first_imports"), F.greatest(F.size(imports) - 10, F.lit(0)).alias("more_imports"),
        F.array_join(F.coalesce("exports", F.array().cast("array<string>")), ",").alias("exports"), F.coalesce("symbol_count", F.lit(0)).cast("bigint").alias("symbol_count"), F.coalesce("types", F.lit("")).alias("types"),
    )


def used_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, used): capitalised identifiers of a symbol's code that some import of its file contains, in order, once each."""
    caps = F.array_distinct(F.regexp_extract_all("code", F.lit(r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9_]*"), F.lit(0)))
    rows = symbols.filter("code is not null").select("symbol_id", "file_id", caps.alias("caps")).join(files.select("file_id", "imports"), "file_id")
    used = F.filter("caps", lambda c: F.exists("imports", lambda i: F.contains(i, c)))
    return rows.select("symbol_id", F.array_join(used, ",").alias("used")).filter("used <> ''")


def path_tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """(directory, level, files): every directory down to ``depth`` levels and the files below it; dot, node_modules and dist components are left out."""
    paths = files.filter("path is not null").select("path").distinct().select(F.split("path", "/").alias("p"))
    paths = paths.filter(~F.exists("p", lambda x: F.startswith(x, F.lit(".")) | x.isin("node_modules", "dist")))
    level = paths.filter(F.size("p") > 1).select("p", F.explode(F.sequence(F.lit(1), F.least(F.size("p") - 1, F.lit(depth)))).alias("level"))
    return level.groupBy(F.expr("array_join(slice(p, 1, level), '/')").alias("directory"), "level").agg(F.count("*").alias("files"))


def index_stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row per repo (nulls one of them): files, symbols, bytes, lines, and the hash of its paths.

    The hash is md5 of ``count:N|`` and the exclusive or of 60 bits of each path's md5: it depends on the set of paths only
    and is merged map-side, so that no repo's paths come together in one place.
    """
    f = files.groupBy("repo").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("lines").alias("lines"), F.md5(F.concat(F.lit("count:"), F.count("*").cast("string"), F.lit("|"), F.bit_xor(F.conv(F.substring(F.md5("path"), 1, 15), 16, 10).cast("bigint")).cast("string"))).alias("paths_hash"),
    )
    s = symbols.groupBy(F.col("repo").alias("r")).agg(F.count("*").alias("symbols"))
    return f.join(s, f["repo"].eqNullSafe(s["r"]), "left").select("repo", "files", F.coalesce("symbols", F.lit(0)).alias("symbols"), "bytes", "lines", "paths_hash")
