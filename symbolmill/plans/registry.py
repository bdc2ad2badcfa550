"""Queries over the supplied tables, by key, each with its SQL where SQL can express it.

Every query reads whole tables. Where a query asks about single symbols, its query set is every symbol whose id is
divisible by 20, or a fixed name or text as a user would type it.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from symbolmill.functions.languages import ENDINGS, ending, language_of
from symbolmill.functions.text import EXPANSIONS, STOPWORDS, estimate_tokens, expansion_column, format_bytes, glob_pattern, tokenize, tokenize_text
from symbolmill.operators import edits, extract, graph, incremental, patterns, rank, structure, usage
from symbolmill.operators.rules import KEYWORD_TYPES, RULES
from symbolmill.sources.tables import latest, latest_rows, table

QUERY, NAME, TYPO, WORD, PATTERN, GLOB = "load token cache", "bindTempo", "bindTemp", "token", "no [a-z]+ left for", "src/**/*.py"


def files(spark, d):
    return latest_rows(spark, d, "files", "file_id")


def symbols(spark, d):
    return latest_rows(spark, d, "symbols", "symbol_id")


def paths(spark, d):
    """Files without their contents."""
    return latest(table(spark, d, "files", "file_id", "repo", "path", "language", "size", "lines", "imports", "exports", "indexed_at"), "file_id")


def names(spark, d):
    """Symbols without their codes."""
    return latest(table(spark, d, "symbols", "symbol_id", "file_id", "repo", "file_path", "ordinal", "name", "type", "line", "end_line", "indexed_at"), "symbol_id")


# SQL fragments, for DuckDB

F_ = "f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC NULLS LAST) = 1)"
S_ = "s AS (SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY indexed_at DESC NULLS LAST) = 1)"
STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def tok(x: str) -> str:
    a = rf"regexp_replace(regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[_\-./\\]', ' ', 'g')"
    return rf"list_filter(string_split_regex(lower({a}), '\s+'), lambda t: length(t) > 1 AND NOT list_contains({STOP}, t))"


def fuzzy_sql(a: str, b: str, threshold: float) -> str:
    return f"(length({a}) > 0 AND length({b}) > 0 AND 1 - (levenshtein(lower({a}), lower({b})) / greatest(length({a}), length({b}))) >= {threshold})"


def lang_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{k}' THEN '{v}'" for k, v in ENDINGS.items()) + " ELSE 'unknown' END"


def ending_sql(x: str) -> str:
    return rf"regexp_extract({x}, '[^/\\](\.[^./\\]*)$', 1)"


Q, SQL = {}, {}


def query(key: str, sql: str | None = None):
    def add(f):
        Q[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


@query("tokenize_names", f"WITH {S_} SELECT symbol_id, array_to_string({tok('name')}, ' ') AS tokens FROM s")
def tokenize_names(spark, d):
    """Tokens of every symbol's name."""
    return names(spark, d).select("symbol_id", F.array_join(tokenize(F.col("name")), " ").alias("tokens"))


@query("term_doc_freq", f"WITH {S_}, t AS (SELECT DISTINCT symbol_id, unnest({tok('name')}) AS token FROM s) SELECT token, count(*) AS df FROM t GROUP BY token")
def term_doc_freq(spark, d):
    """In how many names each token occurs."""
    return names(spark, d).select(F.explode(F.array_distinct(tokenize(F.col("name")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


@query("name_length_by_type", f"WITH {S_} SELECT type, count(*) AS n, round(avg(len({tok('name')})), 6) AS average FROM s GROUP BY type")
def name_length_by_type(spark, d):
    """Symbols and mean name tokens per type."""
    return names(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg(F.size(tokenize(F.col("name")))), 6).alias("average"))


BM25 = f"""st AS (SELECT symbol_id, name, type, file_path, ordinal, code, signature, doc_comment, coalesce({tok('name')}, []) AS tokens FROM s),
g AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM st),
q AS (SELECT unnest({tok("'" + QUERY + "'")}) AS term),
df AS (SELECT term, greatest((SELECT count(*) FROM st WHERE list_contains(tokens, term)), 1) AS df FROM (SELECT DISTINCT term FROM q)),
bm AS (SELECT symbol_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM (SELECT st.symbol_id, len(st.tokens) AS dl, q.term, len(list_filter(st.tokens, lambda t: t = q.term)) AS tf FROM st, q) x JOIN df USING (term), g GROUP BY symbol_id)"""


@query("bm25_names", f"WITH {S_}, {BM25} SELECT symbol_id, round(bm25, 6) AS score FROM bm WHERE bm25 > 0")
def bm25_names(spark, d):
    """BM25 of every name that shares a token with the query."""
    return rank.bm25_names(names(spark, d), QUERY).select("symbol_id", F.round("score", 6).alias("score"))


@query(
    "query_expansion",
    f"WITH {S_}, t AS (SELECT DISTINCT unnest({tok('name')}) AS token FROM s) SELECT token, CASE "
    + " ".join(f"WHEN token = '{k}' THEN '{' '.join([k, *v.split()])}'" for k, v in EXPANSIONS.items())
    + " ELSE token END AS expanded FROM t",
)
def query_expansion(spark, d):
    """What each name token stands for as a query."""
    t = names(spark, d).select(F.explode(tokenize(F.col("name"))).alias("token")).distinct()
    return t.select("token", F.array_join(expansion_column(F.col("token")), " ").alias("expanded"))


@query("did_you_mean", f"WITH n AS (SELECT DISTINCT name FROM symbols WHERE name IS NOT NULL) SELECT name, round(1 - (levenshtein(lower('{TYPO}'), lower(name)) / greatest(length('{TYPO}'), length(name))), 6) AS similarity FROM n WHERE {fuzzy_sql(chr(39) + TYPO + chr(39), 'name', 0.65)}")
def did_you_mean(spark, d):
    """Names like a mistyped one."""
    return rank.did_you_mean(table(spark, d, "symbols", "name"), TYPO).select("name", F.round("similarity", 6).alias("similarity"))


@query("find_symbol", f"WITH {S_} SELECT symbol_id, file_path, line, type, signature FROM s WHERE name = '{NAME}'")
def find_symbol(spark, d):
    """Exact look-up of a name."""
    return rank.find_symbol(latest(table(spark, d, "symbols").filter(F.col("name") == NAME), "symbol_id"), NAME).select("symbol_id", "file_path", "line", "type", "signature")


def _search_sql(tail: str) -> str:
    from symbolmill.functions.text import expand, tokenize_text

    q = tokenize_text(QUERY)
    low = QUERY.lower()
    parts = [
        f"CASE WHEN lower(name) = '{low}' THEN 1000.0 ELSE 0 END", f"CASE WHEN starts_with(lower(name), '{low}') THEN 500.0 ELSE 0 END", f"CASE WHEN contains(lower(name), '{low}') THEN 300.0 ELSE 0 END",
        f"CASE WHEN {fuzzy_sql(chr(39) + QUERY + chr(39), 'name', 0.7)} THEN 200.0 ELSE 0 END", "CASE WHEN bm25 > 0 THEN bm25 * 50 ELSE 0 END",
        *[f"CASE WHEN len(list_filter(tokens, lambda t: t = '{x}' OR {fuzzy_sql(chr(39) + x + chr(39), 't', 0.8)})) > 0 THEN 30.0 ELSE 0 END" for x in dict.fromkeys(e for t in q for e in expand(t))],
        *[f"len(list_filter(code_tokens, lambda t: t = '{x}' OR (abs(length(t) - {len(x)}) <= 0.15 * greatest(length(t), {len(x)}) + 1e-9 AND {fuzzy_sql(chr(39) + x + chr(39), 't', 0.85)}))) * 10.0" for x in q],
        *[f"CASE WHEN list_contains(doc_tokens, '{x}') THEN 15.0 ELSE 0 END" for x in q], f"CASE WHEN contains('{low}', type) THEN 20.0 ELSE 0 END", *[f"CASE WHEN list_contains(sig_tokens, '{x}') THEN 25.0 ELSE 0 END" for x in q],
    ]
    return f"""WITH {S_}, {BM25}, x AS (SELECT st.*, bm25, coalesce({tok('code')}, []) AS code_tokens, coalesce({tok('doc_comment')}, []) AS doc_tokens, coalesce({tok('signature')}, []) AS sig_tokens FROM st JOIN bm USING (symbol_id)),
    scored AS (SELECT symbol_id, name, type, file_path, ordinal, {' + '.join(f'({p})' for p in parts)} AS score FROM x),
    best AS (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, file_path, ordinal, symbol_id LIMIT 50) {tail}"""


@query("search_ranked", _search_sql("SELECT symbol_id, name, round(score, 4) AS score FROM best"))
def search_ranked(spark, d):
    """The 50 best symbols for a query by ten signals."""
    return rank.search(symbols(spark, d), QUERY, 50).select("symbol_id", "name", F.round("score", 4).alias("score"))


@query("search_reasons")
def search_reasons(spark, d):
    """All hits of a query with reasons and highlights."""
    return rank.search(symbols(spark, d), QUERY, None).select("symbol_id", F.array_join("match_reason", "; ").alias("reasons"), F.array_join("highlights", "\n").alias("highlights"))


@query(
    "context_budget",
    _search_sql(", r AS (SELECT symbol_id, ceil((length(name) + length(type) + length(file_path)) / 4)::BIGINT AS tokens, sum(ceil((length(name) + length(type) + length(file_path)) / 4)::BIGINT) OVER (ORDER BY score DESC, file_path, ordinal, symbol_id ROWS UNBOUNDED PRECEDING) + 20 AS running FROM best) SELECT symbol_id, tokens, running::BIGINT AS running FROM r WHERE running <= 400"),
)
def context_budget(spark, d):
    """The best symbols that fit a budget of tokens, cut at the first that does not."""
    best = rank.search(symbols(spark, d), QUERY, 50)
    return rank.within_budget(best, F.concat("name", "type", "file_path"), [F.desc("score"), *rank.ORDER], 400, 20).select("symbol_id", "tokens", "running")


@query(
    "suggest_prefix",
    f"""WITH {S_}, m AS (SELECT name, file_path, ordinal, symbol_id FROM s WHERE len(list_filter({tok('name')}, lambda t: {' OR '.join(f"starts_with(t, '{x}') OR starts_with('{x}', t)" for x in QUERY.split())})) > 0),
    o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY name ORDER BY file_path, ordinal, symbol_id) = 1) SELECT name, file_path, ordinal FROM o ORDER BY file_path, ordinal, symbol_id LIMIT 5""",
)
def suggest_prefix(spark, d):
    """The first five names that begin like the query's words."""
    return rank.suggest(names(spark, d), QUERY)


TARGET = f"t AS (SELECT * FROM s WHERE name = '{NAME}' ORDER BY file_path, ordinal, symbol_id LIMIT 1)"


@query(
    "similar_overlap",
    f"""WITH {S_}, {TARGET}, tt AS (SELECT symbol_id, {tok("concat(name, ' ', coalesce(code, ''))")} AS a FROM t), oo AS (SELECT symbol_id, file_path, ordinal, list_distinct({tok("concat(coalesce(name, ''), ' ', coalesce(code, ''))")}) AS b FROM s),
    p AS (SELECT oo.symbol_id, oo.file_path, oo.ordinal, 100.0 * len(list_filter(tt.a, lambda x: list_contains(oo.b, x))) / len(list_distinct(list_concat(tt.a, oo.b))) AS score FROM oo, tt WHERE oo.symbol_id <> tt.symbol_id)
    SELECT symbol_id, round(score, 4) AS score FROM p WHERE score > 10 ORDER BY score DESC, file_path, ordinal, symbol_id LIMIT 5""",
)
def similar_overlap(spark, d):
    """The five symbols that share most tokens with one."""
    return rank.find_similar(symbols(spark, d), NAME).select("symbol_id", F.round("score", 4).alias("score"))


@query(
    "related_symbols",
    f"""WITH {S_}, {TARGET}, p AS (SELECT s.symbol_id, s.file_path, s.ordinal,
      CASE WHEN s.file_path = t.file_path THEN 50 ELSE 0 END + CASE WHEN levenshtein(lower(s.name), lower(t.name)) BETWEEN 1 AND 3 THEN 30 ELSE 0 END + CASE WHEN contains(t.code, s.name) THEN 40 ELSE 0 END
      + CASE WHEN contains(s.code, t.name) THEN 40 ELSE 0 END + CASE WHEN s.type = t.type THEN 10 ELSE 0 END AS score FROM s, t WHERE s.symbol_id <> t.symbol_id AND s.name IS NOT NULL)
    SELECT symbol_id, score FROM p WHERE score > 0 ORDER BY score DESC, file_path, ordinal, symbol_id LIMIT 20""",
)
def related_symbols(spark, d):
    """The twenty symbols most related to one."""
    s = symbols(spark, d)
    target = s.filter(F.col("name") == NAME).orderBy(*rank.ORDER).limit(1).first()
    if target is None:
        return s.select("symbol_id", F.lit(0).alias("score")).filter("false")
    return rank.related(s, target.asDict()).select("symbol_id", "score")


@query(
    "pattern_search",
    rf"""WITH {F_}, l AS (SELECT file_id, path, content, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM f WHERE content IS NOT NULL)
    SELECT file_id, line::INT AS line, array_to_string(regexp_extract_all(text, '(?i){PATTERN}'), ', ') AS matched_text, (100 + CASE WHEN contains(text, 'function') OR contains(text, 'class') OR contains(text, 'def ') OR contains(text, 'func ') THEN 50 ELSE 0 END)::INT AS score
    FROM l WHERE regexp_matches(text, '(?i){PATTERN}')""",
)
def pattern_search(spark, d):
    """Every line that matches a pattern, scored by what the line defines."""
    hits = patterns.search_patterns(files(spark, d), PATTERN)
    # the context's tokens are left out of the score here, which SQL states on single lines
    base = F.regexp_extract("context", r"(?m)^> \d+: (.*)$", 1)
    bonus = F.when(F.contains(base, F.lit("function")) | F.contains(base, F.lit("class")) | F.contains(base, F.lit("def ")) | F.contains(base, F.lit("func ")), 50).otherwise(0)
    return hits.select("file_id", "line", "matched_text", (F.lit(100) + bonus).cast("int").alias("score"))


def _context_sql() -> str:
    words = " + ".join(f"CASE WHEN list_contains({tok('context')}, '{t}') THEN 10 ELSE 0 END" for t in tokenize_text(PATTERN)) or "0"
    bonus = "CASE WHEN contains(text, 'function') OR contains(text, 'class') OR contains(text, 'def ') OR contains(text, 'func ') THEN 50 ELSE 0 END"
    line = "CASE WHEN i = line THEN '> ' ELSE '  ' END || i || ': ' || l[i]"
    return f"""WITH {F_}, a AS (SELECT file_id, path, string_split(content, chr(10)) AS l FROM f WHERE content IS NOT NULL AND regexp_matches(content, '(?i){PATTERN}')), b AS (SELECT file_id, path, l, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS line FROM a),
    h AS (SELECT * FROM b WHERE regexp_matches(text, '(?i){PATTERN}') ORDER BY path, line LIMIT 10), c AS (SELECT file_id, line, text, array_to_string(list_transform(range(greatest(line - 2, 1), least(line + 3, len(l)) + 1), lambda i: {line}), chr(10)) AS context FROM h)
    SELECT file_id, line::INT AS line, context, (100 + {bonus} + {words})::INT AS score FROM c"""


def _scores_sql() -> str:
    words = " + ".join(f"CASE WHEN list_contains({tok('context')}, '{t}') THEN 10 ELSE 0 END" for t in tokenize_text(PATTERN)) or "0"
    bonus = "CASE WHEN contains(text, 'function') OR contains(text, 'class') OR contains(text, 'def ') OR contains(text, 'func ') THEN 50 ELSE 0 END"
    line = "CASE WHEN i = line THEN '> ' ELSE '  ' END || i || ': ' || l[i]"
    return f"""WITH {F_}, a AS (SELECT file_id, string_split(content, chr(10)) AS l FROM f WHERE content IS NOT NULL AND regexp_matches(content, '(?i){PATTERN}')), b AS (SELECT file_id, l, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS line FROM a),
    c AS (SELECT file_id, line, text, array_to_string(list_transform(range(greatest(line - 2, 1), least(line + 3, len(l)) + 1), lambda i: {line}), chr(10)) AS context FROM b WHERE regexp_matches(text, '(?i){PATTERN}'))
    SELECT file_id, line::INT AS line, array_to_string(regexp_extract_all(text, '(?i){PATTERN}'), ', ') AS matched_text, (100 + {bonus} + {words})::INT AS score FROM c"""


@query("pattern_context", _context_sql())
def pattern_context(spark, d):
    """The first ten hits of a pattern with their contexts, ranked."""
    return patterns.search_patterns(files(spark, d), PATTERN, 10).select("file_id", "line", "context", "score")


_REF = rf"""WITH {F_}, l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM f WHERE content IS NOT NULL),
 w AS (SELECT file_id, line::INT AS line, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: x = '{WORD}')) AS hits FROM l WHERE contains(text, '{WORD}'))"""


@query("references", _REF + " SELECT file_id, line, hits::BIGINT AS hits FROM w WHERE hits > 0")
def references(spark, d):
    """Lines on which a word occurs, and how often."""
    return patterns.references(files(spark, d), WORD).groupBy("file_id", "line").agg(F.count("*").alias("hits"))


@query("references_by_file", _REF + " SELECT file_id, sum(hits)::BIGINT AS hits, count(*) AS lines FROM w WHERE hits > 0 GROUP BY file_id")
def references_by_file(spark, d):
    """Occurrences of a word per file."""
    return patterns.references(files(spark, d), WORD).groupBy("file_id").agg(F.count("*").alias("hits"), F.count_distinct("line").alias("lines"))


@query("references_first_per_file", _REF + " SELECT file_id, max(line) AS last_line, count(*) AS shown FROM (SELECT file_id, line FROM (SELECT file_id, line, unnest(range(hits)) AS k FROM w WHERE hits > 0) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line, k) <= 10) GROUP BY file_id")
def references_first_per_file(spark, d):
    """The first ten references of each file: how many, and the last one's line."""
    return patterns.first_per_file(patterns.references(files(spark, d), WORD)).groupBy("file_id").agg(F.max("line").alias("last_line"), F.count("*").alias("shown"))


@query(
    "references_of_symbols",
    rf"WITH {F_}, {S_}, n AS (SELECT DISTINCT name FROM s WHERE symbol_id % 20 = 0), l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM f WHERE content IS NOT NULL), "
    r"w AS (SELECT file_id, line, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS name FROM l) SELECT name, file_id, line::INT AS line, count(*) AS hits FROM w SEMI JOIN n USING (name) GROUP BY ALL",
)
def references_of_symbols(spark, d):
    """References to every symbol of the query set, in one pass over all contents."""
    wanted = names(spark, d).filter("symbol_id % 20 = 0").select("name")
    return patterns.all_references(files(spark, d), wanted)


@query("line_numbers", rf"WITH {F_}, l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM f WHERE content IS NOT NULL) SELECT file_id, line::INT AS line, count(*) AS n FROM (SELECT file_id, line, unnest(regexp_extract_all(text, 'TODO|FIXME|XXX')) AS m FROM l) GROUP BY ALL")
def line_numbers(spark, d):
    """Line of each match of a pattern, from whole contents."""
    m = files(spark, d).filter("content is not null").select("file_id", F.explode(patterns.lines_of_matches(F.col("content"), "TODO|FIXME|XXX")).alias("m"))
    return m.groupBy("file_id", F.col("m.line").alias("line")).agg(F.count("*").alias("n"))


@query(
    "file_summary",
    f"""WITH {F_}, {S_}, k AS (SELECT file_id, type, count(*) AS n, min(ordinal) AS first FROM s GROUP BY ALL), t AS (SELECT file_id, sum(n)::BIGINT AS symbol_count, string_agg(type || '=' || n, ',' ORDER BY first, type) AS types FROM k GROUP BY file_id)
    SELECT file_id, path, language, lines, size, array_to_string(list_slice(coalesce(imports, []), 1, 10), ',') AS first_imports, greatest(len(coalesce(imports, [])) - 10, 0)::INT AS more_imports, array_to_string(coalesce(exports, []), ',') AS exports, coalesce(symbol_count, 0) AS symbol_count, coalesce(types, '') AS types FROM f LEFT JOIN t USING (file_id)""",
)
def file_summary(spark, d):
    """One row per file: size, imports, exports and symbols by type."""
    return structure.file_summary(paths(spark, d), names(spark, d))


@query("symbols_by_type", f"WITH {S_} SELECT repo, type, count(*) AS n, max(end_line - line + 1)::INT AS longest FROM s GROUP BY repo, type")
def symbols_by_type(spark, d):
    """Symbols and the longest one per repo and type."""
    return names(spark, d).groupBy("repo", "type").agg(F.count("*").alias("n"), F.max(F.col("end_line") - F.col("line") + 1).alias("longest"))


@query("format_bytes", f"WITH {F_} SELECT file_id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024) WHEN size IS NOT NULL THEN printf('%.1f MB', size / 1048576) END AS text FROM f WHERE abs((size / 102.4) % 1 - 0.5) > 0.001")
def formatted_bytes(spark, d):
    """Sizes as text; sizes whose decimal lies on a half are left to tests, since engines round them differently."""
    return paths(spark, d).filter("abs((size / 102.4) % 1 - 0.5) > 0.001").select("file_id", format_bytes(F.col("size")).alias("text"))


def _tenths_sql(unit: int) -> str:
    n = f"floor(size * 10 / {unit} + 0.5)::BIGINT"
    return f"({n}) // 10 || '.' || ({n}) % 10"


@query("format_bytes_all", f"WITH {F_} SELECT file_id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN {_tenths_sql(1024)} || ' KB' WHEN size IS NOT NULL THEN {_tenths_sql(1048576)} || ' MB' END AS text FROM f")
def formatted_bytes_all(spark, d):
    """Every file's size as text: decimals on a half are rounded up, null for null."""
    return paths(spark, d).select("file_id", format_bytes(F.col("size")).alias("text"))


@query("estimate_tokens", f"WITH {S_} SELECT symbol_id, ceil(coalesce(length(code), 0) / 4)::BIGINT AS tokens FROM s")
def estimated_tokens(spark, d):
    """Estimated tokens of every symbol's code."""
    return symbols(spark, d).select("symbol_id", estimate_tokens(F.col("code")).alias("tokens"))


@query(
    "used_symbols",
    rf"WITH {F_}, {S_}, c AS (SELECT symbol_id, imports, list_distinct(list_filter(regexp_extract_all(code, '[A-Za-z0-9_]+'), lambda w: regexp_matches(w, '^[A-Z]'))) AS caps FROM s JOIN f USING (file_id) WHERE code IS NOT NULL), "
    "u AS (SELECT symbol_id, list_filter(caps, lambda c: len(list_filter(imports, lambda i: contains(i, c))) > 0) AS used FROM c) SELECT symbol_id, array_to_string(list_sort(used), ',') AS used FROM u WHERE len(used) > 0",
)
def used_symbols(spark, d):
    """Imported names that each symbol's code uses."""
    return structure.used_symbols(symbols(spark, d), paths(spark, d)).select("symbol_id", F.array_join(F.array_sort(F.split("used", ",")), ",").alias("used"))


_KEY = "concat_ws(':', file_path, name, line)"
_NAMES = "n AS (SELECT name, count(DISTINCT file_path) AS files, min(file_path) AS only_ FROM s WHERE regexp_matches(name, '^[A-Za-z0-9_]+$') GROUP BY name)"


@query(
    "reference_edges",
    rf"WITH {S_}, {_NAMES}, w AS (SELECT DISTINCT {_KEY} AS src, file_path, unnest(regexp_extract_all(code, '[A-Za-z0-9_]+')) AS name FROM s) SELECT DISTINCT src, name AS dst_name FROM w JOIN n USING (name) WHERE files > 1 OR only_ <> file_path",
)
def reference_edges(spark, d):
    """Names of other files that each symbol's code mentions as whole words."""
    return graph.reference_edges(symbols(spark, d), words_only=True)


@query(
    "reference_edges_substring",
    f"WITH {S_}, {_NAMES}, d AS (SELECT DISTINCT {_KEY} AS src, file_path, code FROM s WHERE code IS NOT NULL) SELECT DISTINCT src, n.name AS dst_name FROM d JOIN n ON contains(d.code, n.name) WHERE files > 1 OR only_ <> file_path",
)
def reference_edges_substring(spark, d):
    """Names of other files that each symbol's code contains anywhere."""
    return graph.reference_edges(symbols(spark, d))


@query(
    "import_edges",
    rf"WITH {F_}, i AS (SELECT DISTINCT file_id, unnest(imports) AS import FROM f), c AS (SELECT file_id, import, regexp_replace(regexp_replace(import, '^[''\"]|[''\"]$', '', 'g'), '^\./', '') AS name FROM i) SELECT DISTINCT c.file_id, c.import, f.file_id AS target_id FROM c JOIN f ON contains(f.path, c.name) WHERE c.name <> ''",
)
def import_edges(spark, d):
    """Files that each file's imports lead to."""
    return graph.import_edges(paths(spark, d))


_LINKS = rf"""i AS (SELECT DISTINCT path AS src_path, unnest(imports) AS import FROM f), c AS (SELECT src_path, regexp_replace(regexp_replace(import, '^[''\"]|[''\"]$', '', 'g'), '^\./', '') AS name FROM i WHERE src_path IS NOT NULL),
 links AS (SELECT DISTINCT c.src_path, f.path AS dst_path FROM c JOIN f ON contains(f.path, c.name) WHERE c.name <> ''), k AS (SELECT DISTINCT file_path, {_KEY} AS key FROM s), z AS (SELECT file_path, count(*) AS n FROM k WHERE file_path IS NOT NULL GROUP BY 1)"""


@query("import_links", f"WITH {F_}, {S_}, {_LINKS} SELECT src_path, dst_path FROM links")
def import_links(spark, d):
    """Paths that each file's imports lead to: the symbol edges of imports, kept by file."""
    return graph.import_links(paths(spark, d))


@query("import_degrees", f"WITH {F_}, {S_}, {_LINKS}, p AS (SELECT src_path, sum(n)::BIGINT AS dependencies FROM links JOIN z ON z.file_path = links.dst_path GROUP BY 1) SELECT key AS src, dependencies FROM k JOIN p ON k.file_path = p.src_path")
def import_degrees(spark, d):
    """How many symbols each symbol depends on through its file's imports."""
    return graph.import_degrees(graph.import_links(paths(spark, d)), names(spark, d))


def _roots(spark, d):
    return names(spark, d).filter("symbol_id % 20 = 0").select(graph.symbol_key().alias("node")).distinct()


_BFS = f"""WITH RECURSIVE {S_}, e AS (SELECT DISTINCT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL), r AS (SELECT DISTINCT {_KEY} AS node FROM s WHERE symbol_id % 20 = 0),
 walk AS (SELECT node AS root, node, 0 AS depth FROM r UNION SELECT walk.root, e.dst, walk.depth + 1 FROM walk JOIN e ON e.src = walk.node WHERE walk.depth < 2), b AS (SELECT root, node, min(depth)::INT AS depth FROM walk GROUP BY ALL)"""


@query("dependency_bfs", _BFS + " SELECT root, node, depth FROM b")
def dependency_bfs(spark, d):
    """What each symbol of the query set depends on within three levels."""
    return graph.bfs(table(spark, d, "edges"), _roots(spark, d), 3)


@query("dependency_by_file", _BFS + " SELECT root, regexp_replace(node, ':[^:]*:[^:]*$', '') AS file_path, count(*) AS nodes FROM b GROUP BY ALL")
def dependency_by_file(spark, d):
    """The same, counted per file."""
    return graph.by_file(graph.bfs(table(spark, d, "edges"), _roots(spark, d), 3))


@query(
    "dependency_tree",
    _BFS + ", u AS (SELECT b.root, e.dst AS node, b.depth + 1 AS depth, min(b.node) AS parent FROM b JOIN e ON e.src = b.node GROUP BY 1, 2, 3) SELECT b.root, b.node, b.depth, CASE WHEN b.depth > 0 THEN u.parent END AS parent FROM b LEFT JOIN u ON u.root = b.root AND u.node = b.node AND u.depth = b.depth",
)
def dependency_tree(spark, d):
    """The same walk as a tree: each node under the least node that leads to it."""
    return graph.tree(table(spark, d, "edges"), _roots(spark, d), 3)


@query(
    "context_rows",
    f"""WITH {S_}, e AS (SELECT DISTINCT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst), o AS (SELECT {_KEY} AS key, min(coalesce(code, '')) AS code,
      min(CASE WHEN type IN ('function', 'class') AND signature IS NOT NULL THEN signature ELSE coalesce(code, '') END) AS text FROM s GROUP BY 1),
    r AS (SELECT key AS src, 'code' AS role, key, code AS text FROM o UNION ALL SELECT e.src, 'dependency', e.dst, o.text FROM e JOIN o ON o.key = e.dst WHERE e.src IN (SELECT key FROM o)) SELECT src, role, key, md5(text) AS text_md5, ceil(length(text) / 4)::BIGINT AS tokens FROM r""",
)
def context_rows(spark, d):
    """Each symbol's code and the signatures of its direct dependencies."""
    return graph.context_rows(table(spark, d, "edges"), symbols(spark, d)).select("src", "role", "key", F.md5("text").alias("text_md5"), "tokens")


@query(
    "smart_context",
    f"""WITH {S_}, e AS (SELECT DISTINCT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst), o AS (SELECT {_KEY} AS key, max(ceil(coalesce(length(code), 0) / 4)) AS own,
      max(CASE WHEN type IN ('function', 'class') AND signature IS NOT NULL THEN ceil(length(signature) / 4) ELSE ceil(coalesce(length(code), 0) / 4) END) AS cost FROM s GROUP BY 1),
    g AS (SELECT src, count(*) AS dependencies, sum(cost) AS cost FROM e JOIN o ON o.key = e.dst GROUP BY src) SELECT src, dependencies, (own + g.cost)::BIGINT AS tokens FROM g JOIN o ON o.key = g.src""",
)
def smart_context(spark, d):
    """Direct dependencies of each symbol and the tokens of its context."""
    return graph.smart_context(table(spark, d, "edges"), symbols(spark, d))


@query(
    "path_tree",
    f"WITH {F_}, p AS (SELECT DISTINCT path, string_split(path, '/') AS p FROM f WHERE path IS NOT NULL), k AS (SELECT * FROM p WHERE len(list_filter(p, lambda x: starts_with(x, '.') OR x IN ('node_modules', 'dist'))) = 0), l AS (SELECT p, unnest(range(1, least(len(p) - 1, 3) + 1)) AS level FROM k) SELECT array_to_string(list_slice(p, 1, level), '/') AS directory, level::INT AS level, count(*) AS files FROM l GROUP BY ALL",
)
def path_tree(spark, d):
    """Directories down to three levels and the files below each."""
    return structure.path_tree(paths(spark, d))


@query("glob_filter", f"WITH {F_} SELECT file_id FROM f WHERE regexp_matches(path, '{glob_pattern(GLOB)}')")
def glob_filter(spark, d):
    """Files that a glob matches."""
    return structure.glob_filter(paths(spark, d), GLOB).select("file_id")


def _ignore_sql() -> str:
    plain = "[" + ", ".join(f"'{p}'" for p in structure.IGNORED) + "]"
    stars = "^(?:" + "|".join(structure._glob(p) for p in structure.IGNORED if "*" in p) + ")$"
    return f"WITH {F_} SELECT file_id, (list_contains({plain}, path) OR len(list_intersect(string_split(path, '/'), {plain})) > 0 OR regexp_matches(path, '{stars}') OR regexp_matches(string_split(path, '/')[-1], '{stars}')) AS ignored FROM f"


@query("ignore_filter", _ignore_sql())
def ignore_filter(spark, d):
    """Which files the fixed ignore rules leave out."""
    return paths(spark, d).select("file_id", structure.ignored(F.col("path")).alias("ignored"))


@query("language_map", f"WITH {F_} SELECT file_id, {ending_sql('path')} AS ending, {lang_sql(ending_sql('path'))} AS label FROM f")
def language_map(spark, d):
    """Ending and language label of each path."""
    return paths(spark, d).select("file_id", ending(F.col("path")).alias("ending"), language_of(F.col("path")).alias("label"))


@query("extension_gate", f"WITH {F_} SELECT {ending_sql('path')} IN ({', '.join(repr(k) for k in ENDINGS)}) AS supported, count(*) AS files, sum(size)::BIGINT AS bytes FROM f GROUP BY 1")
def extension_gate(spark, d):
    """Files and bytes that the ending gate lets through."""
    return paths(spark, d).groupBy(structure.supported(F.col("path")).alias("supported")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("size_gate", f"WITH {F_} SELECT file_id, CASE WHEN size > {structure.LARGEST} THEN 'skipped' WHEN size < {structure.KEPT} THEN 'kept' WHEN size IS NOT NULL THEN 'dropped' ELSE 'skipped' END AS gate FROM f")
def size_gate(spark, d):
    """Whether each file's content is kept."""
    return paths(spark, d).select("file_id", structure.size_gate(F.col("size")).alias("gate"))


@query(
    "index_stats",
    f"WITH {F_}, {S_}, a AS (SELECT repo, count(*) AS files, sum(size)::BIGINT AS bytes, sum(lines)::BIGINT AS lines, md5('count:' || count(*) || '|' || bit_xor(('0x' || substr(md5(path), 1, 15))::BIGINT)) AS paths_hash FROM f GROUP BY repo), b AS (SELECT repo, count(*) AS n FROM s GROUP BY repo) SELECT a.repo, files, coalesce(n, 0) AS symbols, bytes, lines, paths_hash FROM a LEFT JOIN b ON a.repo IS NOT DISTINCT FROM b.repo",
)
def index_stats(spark, d):
    """Counts and path hash of each repo's index."""
    return structure.index_stats(paths(spark, d), names(spark, d))


_CH = r"""c AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY arrived_at DESC NULLS LAST, path ASC NULLS LAST, status ASC NULLS LAST) = 1),
 k AS (SELECT change_id, repo, regexp_replace(replace(path, '\', '/'), '^(\./)+|^/+', '') AS path, CASE upper(trim(status)) WHEN 'A' THEN 'added' WHEN 'M' THEN 'modified' WHEN 'D' THEN 'deleted' WHEN '??' THEN 'added' END AS status, changed_at FROM c WHERE path IS NOT NULL),
 cl AS (SELECT * FROM k WHERE status IS NOT NULL), la AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY path ORDER BY changed_at DESC NULLS LAST, change_id DESC) = 1)"""


@query("name_status_parse", r"SELECT DISTINCT change_id, CASE substr(l, 1, 1) WHEN 'A' THEN 'added' WHEN 'M' THEN 'modified' ELSE 'deleted' END AS status, regexp_extract(l, '^[AMD]\s+(.+)$', 1) AS path FROM (SELECT change_id, status || chr(9) || path AS l FROM changes) WHERE regexp_matches(l, '^[AMD]\s+.+$')")
def name_status_parse(spark, d):
    """The change table's rows as lines of a name-status listing, parsed."""
    lines = table(spark, d, "changes").select("change_id", incremental.parse_name_status(F.concat("status", F.lit("\t"), "path")).alias("x"))
    return lines.filter("x is not null").select("change_id", "x.status", "x.path").distinct()


@query("git_status_parse", r"SELECT DISTINCT change_id, CASE WHEN contains(fl, 'M') THEN 'modified' WHEN contains(fl, 'A') THEN 'added' WHEN contains(fl, 'D') THEN 'deleted' WHEN contains(fl, '?') THEN 'added' END AS st, trim(substr(l, 4)) AS path FROM (SELECT change_id, l, substr(l, 1, 2) AS fl FROM (SELECT change_id, rpad(substr(status, 1, 2), 2, ' ') || ' ' || path AS l FROM changes)) WHERE regexp_matches(fl, '[MAD?]')")
def git_status_parse(spark, d):
    """The change table's rows as lines of a porcelain listing, parsed."""
    line = F.concat(F.rpad(F.substring("status", 1, 2), 2, " "), F.lit(" "), F.col("path"))
    return table(spark, d, "changes").select("change_id", incremental.parse_porcelain(line).alias("x")).filter("x is not null").select("change_id", F.col("x.status").alias("st"), "x.path").distinct()


@query("change_scope", f"WITH {_CH} SELECT repo, status, count(*) AS changes, count(DISTINCT path) AS paths FROM cl GROUP BY repo, status")
def change_scope(spark, d):
    """Changes and paths per repo and status."""
    return incremental.scope(table(spark, d, "changes"))


@query(
    "incremental_merge",
    f"WITH {F_}, {_CH} SELECT path, file_id, size, lines, 'old' AS origin FROM f WHERE path NOT IN (SELECT path FROM la) UNION ALL SELECT path, file_id, size + 1, lines, 'new' FROM f WHERE path IN (SELECT path FROM la WHERE status <> 'deleted')",
)
def incremental_merge(spark, d):
    """The index after the change set: changed files taken from a second delivery, deleted ones gone."""
    old = paths(spark, d).select("path", "file_id", "size", "lines")
    new = old.withColumn("size", F.col("size") + 1).withColumn("origin", F.lit("new"))
    return incremental.merge(old.withColumn("origin", F.lit("old")), incremental.latest_changes(table(spark, d, "changes")), new)


_CALLS = "c AS (SELECT * FROM usage_log QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY arrived_at DESC NULLS LAST) = 1), u AS (SELECT call_id, ts, lower(trim(tool)) AS tool, greatest(coalesce(response_chars, 0), 0) AS chars, greatest(coalesce(tokens, 0), 0) AS tokens, coalesce(files, []) AS files FROM c WHERE tool IS NOT NULL AND trim(tool) <> '' AND lower(trim(tool)) NOT IN ('get_usage_stats', 'clear_cache', 'index_repository'))"
_STATS = "count(*) AS calls, sum(tokens)::BIGINT AS total_tokens, sum(chars)::BIGINT AS total_chars, floor(avg(tokens) + 0.5)::BIGINT AS avg_tokens FROM u"


@query("usage_stats", f"WITH {_CALLS} SELECT tool, {_STATS} GROUP BY tool")
def usage_stats(spark, d):
    """Calls and tokens per tool."""
    return usage.usage_stats(table(spark, d, "usage_log"))


@query("usage_rollup_total", f"WITH {_CALLS} SELECT tool, {_STATS} GROUP BY ROLLUP (tool)")
def usage_rollup_total(spark, d):
    """The same with a row over all tools."""
    return usage.usage_stats(table(spark, d, "usage_log"), total=True)


@query(
    "first_touch",
    f"WITH {F_}, {_CALLS}, t AS (SELECT DISTINCT call_id, ts, tool, unnest(files) AS path FROM u), a AS (SELECT path, tool FROM t WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts ASC NULLS LAST, call_id) = 1), k AS (SELECT path, ceil(max(size) / 4)::BIGINT AS cost FROM f GROUP BY path) SELECT tool, count(*) AS files, coalesce(sum(cost), 0)::BIGINT AS full_read_tokens FROM a LEFT JOIN k USING (path) GROUP BY tool",
)
def first_touch(spark, d):
    """Full-read cost of files, charged to the first tool that touched each."""
    return usage.first_touch(table(spark, d, "usage_log"), paths(spark, d))


@query(
    "usage_savings",
    f"""WITH {F_}, {_CALLS}, t AS (SELECT DISTINCT call_id, ts, tool, unnest(files) AS path FROM u), a AS (SELECT path, tool FROM t WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts ASC NULLS LAST, call_id) = 1),
    k AS (SELECT path, ceil(max(size) / 4)::BIGINT AS cost FROM f GROUP BY path), o AS (SELECT tool, count(*) AS files, coalesce(sum(cost), 0)::BIGINT AS full_read_tokens FROM a LEFT JOIN k USING (path) GROUP BY tool),
    st AS (SELECT tool, {_STATS} GROUP BY tool) SELECT st.tool, calls, total_tokens, coalesce(files, 0)::BIGINT AS files, coalesce(full_read_tokens, 0)::BIGINT AS full_read_tokens, greatest(coalesce(full_read_tokens, 0) - total_tokens, 0)::BIGINT AS saved FROM st LEFT JOIN o ON o.tool = st.tool""",
)
def usage_savings(spark, d):
    """Per tool: what was answered, the files it touched first, and what reading those whole would have cost."""
    return usage.savings(table(spark, d, "usage_log"), paths(spark, d))


def _paths_sql() -> str:
    found = ", ".join(f"regexp_extract_all(text, '{p}', 1)" for p in usage.PATH_FORMS)
    return rf"""WITH p AS (SELECT DISTINCT doc_id, trim(unnest(flatten([{found}])), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS p FROM documents WHERE text IS NOT NULL)
    SELECT DISTINCT doc_id, regexp_replace(replace(p, '\', '/'), '^(\./)+|^/+', '') AS path FROM p WHERE p <> '' AND NOT contains(p, ' ') AND contains(p, '.')"""


@query("response_paths", _paths_sql())
def response_paths(spark, d):
    """The files that each document names in the forms of an answer."""
    docs = table(spark, d, "documents", "doc_id", "text").filter("text is not null")
    return docs.select("doc_id", F.explode(usage.response_paths(F.col("text"))).alias("path")).distinct()


@query("pattern_scores", _scores_sql())
def pattern_scores(spark, d):
    """Every line that matches a pattern with the operator's own score: what the line defines, and the pattern's words around it."""
    return patterns.search_patterns(files(spark, d), PATTERN).select("file_id", "line", "matched_text", "score")


def _splice_sql(mode: str, wanted: str) -> str:
    head = {"insert": "end_line", "replace": "line - 1", "delete": "line - 1"}[mode]
    middle = "" if mode == "delete" else "['x = 1', ''], "
    return f"WITH {F_}, {S_}, p AS (SELECT symbol_id, line, end_line, string_split(content, chr(10)) AS l FROM s JOIN f USING (file_id) WHERE {wanted} AND content IS NOT NULL) SELECT symbol_id, md5(array_to_string(flatten([list_slice(l, 1, {head}), {middle}list_slice(l, end_line + 1, len(l))]), chr(10))) AS content_md5 FROM p"


def _splice(mode: str, wanted: str):
    def run(spark, d):
        s = names(spark, d).filter(wanted).select("symbol_id", "file_id", "line", "end_line")
        f = files(spark, d).filter("content is not null").select("file_id", "content")
        return f.join(s, "file_id").select("symbol_id", F.md5(edits.splice(F.col("content"), F.col("line"), F.col("end_line"), F.lit("x = 1\n"), mode)).alias("content_md5"))

    run.__doc__ = f"Each file after the {mode} of one of its symbols, for every symbol{' of the query set' if wanted != 'true' else ''}."
    return run


for _mode in ("insert", "replace", "delete"):
    for _key, _wanted in ((f"splice_{_mode}", "symbol_id % 20 = 0"), (f"splice_{_mode}_all", "true")):
        query(_key, _splice_sql(_mode, _wanted))(_splice(_mode, _wanted))


@query("parse_symbols")
def parse_symbols(spark, d):
    """Every definition that the rules find in file contents."""
    return extract.symbols_of(files(spark, d))


def _regex_sql(rule, group: int) -> str:
    flags = "(?m)" if rule.flags else ""
    quoted = (flags + rule.pattern).replace("'", "''")
    return f"regexp_extract_all(content, '{quoted}', {group})"


def _texts_sql(lang: str, emits: str) -> str:
    """A list of what the rules of a language emit as imports or exports, in their order."""
    parts = []
    for r in RULES[lang]:
        if r.emits == emits:
            x = _regex_sql(r, 1)
            if "|\\(([^)]+)" in r.pattern:  # a second form of the same rule, in its own group
                x = f"list_transform(list_zip({x}, {_regex_sql(r, 2)}), lambda p: CASE WHEN p[1] <> '' THEN p[1] ELSE p[2] END)"
            if r.clean == "strip":
                x = f"list_transform({x}, lambda t: trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"
            if emits == "export":
                x = f"list_transform({x}, lambda t: CASE WHEN t = '' THEN 'module' ELSE t END)"
            parts.append(x)
    return f"flatten([{', '.join(parts)}])" if parts else "[]::VARCHAR[]"


def _symbols_sql(lang: str) -> str:
    """A list of {n, t}: name and type of each symbol in rule order."""
    parts = []
    for r in RULES[lang]:
        if r.emits in ("import", "export"):
            continue
        if r.emits == "by-keyword":
            kind = "CASE " + " ".join(f"WHEN p[1] = '{k}' THEN '{v}'" for k, v in KEYWORD_TYPES.items()) + " END"
            x = f"list_transform(list_zip({_regex_sql(r, 1)}, {_regex_sql(r, 2)}), lambda p: {{'n': p[2], 't': {kind}}})"
        else:
            last = "regexp_extract(p, '[^.:]*$')" if lang == "lua" and r.emits == "function" else "p"
            x = f"list_transform({_regex_sql(r, 1)}, lambda p: {{'n': {last}, 't': '{r.emits}'}})"
        if r.skip:
            x = f"list_filter({x}, lambda q: q.n NOT IN ({', '.join(repr(w) for w in sorted(r.skip))}))"
        parts.append(x)
    return f"flatten([{', '.join(parts)}])"


_FL = F_ + f", fl AS (SELECT file_id, content, coalesce(language, {lang_sql(ending_sql('path'))}) AS language FROM f WHERE content IS NOT NULL)"


@query(
    "parse_imports",
    f"WITH {_FL} SELECT file_id, language, array_to_string(CASE language " + " ".join(f"WHEN '{k}' THEN {_texts_sql(k, 'import')}" for k in RULES) + " END, chr(10)) AS imports, array_to_string(CASE language "
    + " ".join(f"WHEN '{k}' THEN {_texts_sql(k, 'export')}" for k in RULES) + f" END, chr(10)) AS exports FROM fl WHERE language IN ({', '.join(repr(k) for k in RULES)})",
)
def parse_imports(spark, d):
    """Imports and exports that the rules find in file contents."""
    return extract.parse_files(files(spark, d)).select("file_id", "language", F.array_join("imports", "\n").alias("imports"), F.array_join("exports", "\n").alias("exports"))


def _parse(lang: str):
    def run(spark, d):
        found = extract.symbols_of(files(spark, d).filter(F.coalesce("language", language_of(F.col("path"))) == lang))
        return found.select("file_id", "ordinal", "name", "type")

    run.__doc__ = f"Definitions in files of {lang}, in order. Lines and blocks are in parse_symbols."
    return run


for _lang in RULES:
    query(f"parse_{_lang}", f"WITH {_FL}, l AS (SELECT file_id, {_symbols_sql(_lang)} AS l FROM fl WHERE language = '{_lang}'), u AS (SELECT file_id, unnest(l) AS q, generate_subscripts(l, 1) AS i FROM l) SELECT file_id, (i - 1)::INT AS ordinal, q.n AS name, q.t AS type FROM u")(_parse(_lang))


@query("block_lengths")
def block_lengths(spark, d):
    """Per language and type: definitions, and how long their blocks are."""
    s = extract.parse_files(files(spark, d)).select("language", F.explode("symbols").alias("s"))
    return s.groupBy("language", F.col("s.type").alias("type")).agg(F.count("*").alias("n"), F.sum(F.col("s.end_line") - F.col("s.line") + 1).alias("lines"))


@query("last_change_rank", f"WITH {_CH} SELECT path, status, row_number() OVER (PARTITION BY status ORDER BY changed_at DESC, path) AS rn FROM la QUALIFY rn <= 10")
def last_change_rank(spark, d):
    """The ten paths of each status that changed last."""
    w = Window.partitionBy("status").orderBy(F.desc("changed_at"), "path")
    return incremental.latest_changes(table(spark, d, "changes")).withColumn("rn", F.row_number().over(w)).filter("rn <= 10").select("path", "status", "rn")


def queries():
    return dict(Q)


def oracle_sql():
    return dict(SQL)
