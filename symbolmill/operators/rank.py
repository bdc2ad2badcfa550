"""Ranked retrieval over symbols: BM25 on names, ten additive signals, a token budget, suggestions, similarity."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolmill.functions.text import edits_within, estimate_tokens, expand, fuzzy, may_hold, similarity, token_pattern, tokenize, tokenize_text

K1, B = 1.5, 0.75
ORDER = ("file_path", "ordinal", "symbol_id")


def _empty_safe(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _is(x: str):
    return lambda t: t == x


def _like(x: str, threshold: float):
    if not edits_within(x, threshold):
        return lambda t: t == x
    return lambda t: (t == x) | fuzzy(F.lit(x), t, threshold)


def _tokens_near(column: str, words: list[str], threshold: float = 1.0) -> Column:
    """Tokens of a column; empty where its text cannot hold one like any of ``words``, so that most texts are never cut up."""
    may = F.lit(False)
    for x in dict.fromkeys(words):
        may = may | may_hold(F.col(column), x, threshold)
    return F.when(may, _empty_safe(tokenize(F.col(column)))).otherwise(F.array().cast("array<string>"))


def _hits(column: str, tokens: str, x: str, threshold: float = 1.0) -> Column:
    """How many tokens of a text are like ``x``: matches of a pattern where only the word itself is, else from the ``tokens`` column."""
    exact = token_pattern(x) if not edits_within(x, threshold) else None
    return F.size(F.filter(F.col(tokens), _like(x, threshold))) if exact is None else F.coalesce(F.regexp_count(F.col(column), F.lit(exact)), F.lit(0))


def _holds(x: str):
    return lambda y: F.contains(F.lower(y), F.lit(x))


def _prefix(x: str):
    return lambda t: F.startswith(t, F.lit(x)) | F.startswith(F.lit(x), t)


def name_statistics(symbols: DataFrame, tokens: list[str]) -> tuple[int, float, dict[str, int]]:
    """Number of symbols, mean name tokens, and in how many names each of ``tokens`` occurs: one small row of aggregates."""
    names = symbols.select(_empty_safe(tokenize(F.col("name"))).alias("t"))
    row = names.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avg"), *[F.sum(F.array_contains("t", t).cast("int")).alias(f"df{i}") for i, t in enumerate(tokens)]).first()
    return row["n"], row["avg"] or 1.0, {t: row[f"df{i}"] or 1 for i, t in enumerate(tokens)}


def bm25(tokens: Column, query: list[str], n: int, average: float, df: dict[str, int]) -> Column:
    """BM25 of a token array for query tokens (repeats count again)."""
    total = F.lit(0.0)
    for q in query:
        tf = F.size(F.filter(tokens, _is(q)))
        idf = F.log(F.lit((n - df[q] + 0.5) / (df[q] + 0.5) + 1))
        total = total + idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.size(tokens) / F.lit(average)))
    return total


def bm25_names(symbols: DataFrame, query: str) -> DataFrame:
    """(symbol_id, name, score) of each symbol whose name shares a token with the query. Null names have no tokens but count."""
    q = tokenize_text(query)
    stats = name_statistics(symbols, sorted(set(q)))
    t = _empty_safe(tokenize(F.col("name")))
    return symbols.select("symbol_id", "name", bm25(t, q, *stats).alias("score")).filter("score > 0")


def _signals(query: str, stats, code: bool = True, comments: bool = True, fuzzy_name: float = 0.7) -> list[tuple[Column, Column]]:
    """(score, reason or null) of each signal, in order."""
    q, low = tokenize_text(query), query.lower()
    name, lname = F.coalesce("name", F.lit("")), F.lower(F.coalesce("name", F.lit("")))
    t = F.col("_name")
    out: list[tuple[Column, Column]] = []

    def when(cond: Column, score, reason) -> None:
        cond = F.coalesce(cond, F.lit(False))
        out.append((F.when(cond, score).otherwise(F.lit(0.0)), F.when(cond, reason)))

    when(lname == low, F.lit(1000.0), F.lit("exact name match"))
    when(F.startswith(lname, F.lit(low)), F.lit(500.0), F.lit("name starts with query"))
    when(F.contains(lname, F.lit(low)), F.lit(300.0), F.lit("name contains query"))
    when(fuzzy(F.lit(query), name, fuzzy_name), F.lit(200.0), F.lit("fuzzy name match"))
    when(F.col("_bm25") > 0, F.col("_bm25") * 50, F.format_string("tokenized match (BM25: %.2f)", "_bm25"))
    for x in dict.fromkeys(e for token in q for e in expand(token)):
        when(F.exists(t, _like(x, 0.8)), F.lit(30.0), F.lit(f'expanded query match: "{x}"'))
    if code:
        for x in q:
            hits = F.col(f"_hits{q.index(x)}")
            when(hits > 0, hits * 10.0, F.concat(F.lit(f'found "{x}" '), hits.cast("string"), F.lit("x in code")))
    if comments:
        for x in q:
            when(_hits("doc_comment", "_doc", x) > 0, F.lit(15.0), F.lit(f'found "{x}" in comment'))
    when(F.contains(F.lit(low), F.col("type")), F.lit(20.0), F.concat(F.lit("type matches: "), F.col("type")))
    for x in q:
        when(_hits("signature", "_sig", x) > 0, F.lit(25.0), F.lit(f'found "{x}" in signature'))
    return out


def search(symbols: DataFrame, query: str, limit: int | None = 20, code: bool = True, comments: bool = True, fuzzy_name: float = 0.7) -> DataFrame:
    """(symbol_id, name, type, file_path, ordinal, score, match_reason, highlights) of the best symbols; ``limit`` None keeps all.

    One pass over symbols: statistics of the query's few tokens come first as one row, every signal is an expression. Ties
    fall by file_path, ordinal and symbol_id. Null names, codes, comments and signatures are empty; symbols without any hit
    are left out; an empty query hits nothing but the type and prefix signals.
    """
    q = tokenize_text(query)
    stats = name_statistics(symbols, sorted(set(q)))
    base = symbols.select(
        "symbol_id", "name", "type", "file_path", "ordinal", "code", "doc_comment", "signature",
        _empty_safe(tokenize(F.col("name"))).alias("_name"), _tokens_near("code", q, 0.85).alias("_code"), _tokens_near("doc_comment", q).alias("_doc"), _tokens_near("signature", q).alias("_sig"),
    ).withColumn("_bm25", bm25(F.col("_name"), q, *stats))
    base = base.select("*", *[_hits("code", "_code", x, 0.85).alias(f"_hits{i}") for i, x in enumerate(q)])
    signals = _signals(query, stats, code, comments, fuzzy_name)
    total = signals[0][0]
    for s, _ in signals[1:]:
        total = total + s
    lines = F.split(F.coalesce("code", F.lit("")), "\n")
    marks = [F.when(r.isNotNull(), F.col("name")) for _, r in signals[:4]]
    if code:
        for x in q:
            hit = F.col(f"_hits{q.index(x)}") > 0
            line = F.get(F.filter(lines, _holds(x)), F.lit(0))
            marks.append(F.when(hit, F.substring(F.regexp_replace(line, r"^\s+|\s+$", ""), 1, 100)))
    marks = F.filter(F.array(*marks), lambda m: m.isNotNull())
    hits = base.select(
        "symbol_id", "name", "type", "file_path", "ordinal", total.alias("score"), F.filter(F.array(*[r for _, r in signals]), lambda r: r.isNotNull()).alias("match_reason"),
        F.when(F.size(marks) > 0, marks).otherwise(F.array("name")).alias("highlights"),
    )
    # filtered behind the limit, scores are computed once; in front of it Catalyst would compute them for the filter too
    return hits.filter("score > 0") if limit is None else hits.orderBy(F.desc("score"), *ORDER).limit(limit).filter("score > 0")


def within_budget(ranked: DataFrame, text: Column, order: list, budget: int, header: int = 0) -> DataFrame:
    """``ranked`` with tokens and running tokens, cut before the first row that does not fit. ``ranked`` is a top-k, so one window holds it."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("tokens", estimate_tokens(text)).withColumn("running", F.sum("tokens").over(w) + header).filter(F.col("running") <= budget)


def find_symbol(symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Exact, case-sensitive look-up."""
    found = symbols.filter(F.col("name") == name)
    return found if kind in (None, "any") else found.filter(F.col("type") == kind)


def did_you_mean(symbols: DataFrame, name: str, threshold: float = 0.65) -> DataFrame:
    """(name, similarity) of each distinct name similar enough."""
    names = symbols.filter("name is not null").select("name").distinct()
    return names.filter(fuzzy(F.lit(name), F.col("name"), threshold)).select("name", similarity(F.lit(name), F.col("name")).alias("similarity"))


def suggest(symbols: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """The first ``limit`` distinct names, by first occurrence, one of whose tokens begins a query token or begins with one."""
    q = tokenize_text(query)
    cond = F.lit(False)
    for x in q:
        cond = cond | F.exists(_empty_safe(tokenize(F.col("name"))), _prefix(x))
    first = symbols.filter(cond).groupBy("name").agg(F.min(F.struct(*ORDER)).alias("at"))
    return first.orderBy("at").limit(limit).select("name", F.col("at.file_path").alias("file_path"), F.col("at.ordinal").alias("ordinal"))


def find_similar(symbols: DataFrame, name: str, limit: int = 5) -> DataFrame:
    """The symbols most like the first one of that name."""
    target = symbols.filter(F.col("name") == name).orderBy(*ORDER).limit(1).select("symbol_id", "name", "code").first()
    if target is None:
        return symbols.select("symbol_id", "name", "file_path", "ordinal", F.lit(0.0).alias("score")).filter("false")
    words = tokenize_text(f"{target['name']} {target['code'] or ''}")
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    theirs = F.array_distinct(tokenize(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("code", F.lit("")))))
    tf = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(v))]) if counts else F.create_map(F.lit(""), F.lit(0))
    mine = F.array(*[F.lit(k) for k in counts]) if counts else F.array(F.lit(""))
    # one step a column: within one expression the words would be cut out again for every use
    cut = symbols.filter(F.col("symbol_id") != target["symbol_id"]).select("symbol_id", "name", "file_path", "ordinal", theirs.alias("_theirs"))
    met = cut.select("symbol_id", "name", "file_path", "ordinal", F.size("_theirs").alias("_n"), F.array_intersect("_theirs", mine).alias("_common"))
    shared = F.aggregate("_common", F.lit(0), lambda a, t: a + F.try_element_at(tf, t))
    scored = met.select("symbol_id", "name", "file_path", "ordinal", (100 * shared / (len(counts) + F.col("_n") - F.size("_common"))).alias("score"))
    # filtered behind the limit: in front of it Catalyst would cut the words out for the filter too
    return scored.orderBy(F.desc("score"), *ORDER).limit(limit).filter("score > 10")


def related(symbols: DataFrame, target: dict, limit: int | None = 20) -> DataFrame:
    """(symbol_id, name, score, reason) of symbols related to ``target`` (a row's symbol_id, name, type, file_path, code).

    Same file 50, a name within three edits 30, named in the target's code 40, naming the target in its own code 40, same type 10.
    """
    code, name = target["code"] or "", target["name"] or ""
    distance = F.levenshtein(F.lower("name"), F.lit(name.lower()))
    parts = [
        (F.col("file_path") == target["file_path"], 50, "same file"), ((distance > 0) & (distance <= 3), 30, "similar name"), (F.contains(F.lit(code), F.col("name")), 40, "used in code"),
        (F.contains(F.col("code"), F.lit(name)), 40, "uses this symbol"), (F.col("type") == target["type"], 10, "same type"),
    ]
    score, reasons = F.lit(0), []
    for cond, points, reason in parts:
        cond = F.coalesce(cond, F.lit(False))
        score = score + F.when(cond, points).otherwise(0)
        reasons.append(F.when(cond, F.lit(reason)))
    out = symbols.filter((F.col("symbol_id") != target["symbol_id"]) & F.col("name").isNotNull()).select("symbol_id", "name", "file_path", "ordinal", score.alias("score"), F.concat_ws(", ", *reasons).alias("reason")).filter("score > 0")
    return out if limit is None else out.orderBy(F.desc("score"), *ORDER).limit(limit)
