"""Functions paired with the prose of their documentation.

A symbol's raw comment and its whole code are lexed into tokens, the tokens become rows, and windows over them do the rest:

* a running sum of brackets gives each token's depth; the first bracket or colon at depth 0 behind the head's parentheses opens the body, and
  the function ends where the depth comes back to 0 behind it,
* runs of comment tokens are islands, numbered by the running count of the tokens that interrupt them, and each island is one piece
  of text,
* lags attach to the function what stands above it, and to its body the string that opens it.

All steps are built-in expressions; after symbols are brought together by id once, windows and groupings need no further shuffle.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolmill.sources.tables import latest

MARK = "\x01"
STRINGS = (
    r'[rRuUbBfF]{0,2}"""[\s\S]*?"""|[rRuUbBfF]{0,2}\'\'\'[\s\S]*?\'\'\'|[rRuUbBfF]{0,2}"[^"\\\r\n]*(?:\\.[^"\\\r\n]*)*"|[rRuUbBfF]{0,2}\'[^\'\\\r\n]*(?:\\.[^\'\\\r\n]*)*\''
)
#: Tokens that matter for depth, zones and documentation. The lexer skips runs of anything else; a string behind a colon
#: and blanks only makes one token with it.
TOKENS = (
    MARK
    + r"|/\*[\s\S]*?\*/|(?:///?|#(?!\{|\[|include|define|if|endif|else|pragma)|--(?!\[\[|[>\w\d(=]))[^\r\n]*|--\[\[[\s\S]*?\]\]"
    + "|" + STRINGS
    + r"|[(\[{]|[)\]}]|:\s*(?:" + STRINGS + r")|:"
)
COMMENT, STRING, OPEN, CLOSE = r"^(?:/\*|//|#|--)", r"^[rRuUbBfF]{0,2}[\"']", r"^[(\[{]$", r"^[)\]}]$"
WORDS = r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{Lo}{2}|\d+"
#: Words that say nothing by themselves.
EMPTY_WORDS = "the an of for to in on at is it its and or with by from as be this that function method class procedure routine helper constructor getter setter der die das le la les el los il lo de du des den het een und et y e".split()
#: Lines that are no prose about the function.
NO_PROSE = (
    r"(?iu)^(?:[@:\\{]|</?\w+[^>]*>$|todo\b|fixme\b|xxx\b|hack\b|tbd\b|spdx|copyright|\(c\)|licen[sc]|all rights|authors?\b\s*:|created (?:by|on)\b|version\s*:|since\s*:"
    r"|(?:param(?:eter)?s?|args?|arguments?|returns?|raises?|throws?|yields?|see also|notes?|examples?)\s*:?\s*$"
    r"|eslint|tslint|jshint|jslint|prettier|istanbul|c8 ignore|v8 ignore|noinspection|suppress|nolint|nosec|noqa|pylint|flake8|mypy|pyright|type:\s*ignore|pragma|go:|rubocop|clippy|rustfmt|swiftlint|ktlint|detekt|checkstyle|sonar|phpcs|phpstan|psalm|shellcheck|luacheck|credo|dialyzer|scalastyle|scalafmt|ignore(?:_for_file)?:|clang-|cppcheck|resharper|fmt:|yapf|isort|coverage|biome-|deno-|#?(?:end)?region\b)"
    r"|^[^\p{L}]*$|^(?:[-=~*#_+]{3,}.*|.*[-=~*#_+]{3,})$"
    r"|[;{}]\s*$|^[\w.$]+\([^)]*\);?$|^(?:return|var|let|const|import|print|del|elif|assert)\s+[\w.]+\s*[(=].*|^(?:if|for|while)\s*\(.*\)"
    r"|^\W*(?:n/?a|none|null|empty|nothing|stub|undocumented|docs?|documentation|description|comment|override[sn]?|inherit(?:ed)?[- ]?docs?|inherited(?: from.*)?|deprecated|private|internal|public|generated stub"
    r"|see (?:above|below|parent|super|base|interface|superclass|base class|the (?:parent|base|interface).*)|same as (?:above|parent|super).*|no (?:description|documentation|docs|comment)s?(?: (?:yet|available|provided|needed))?"
    r"|(?:add|insert|write|put|missing|needs?|provide) (?:an? |the |some )?(?:description|docs?|documentation|comments?)(?: here)?|(?:method|function|class)?\s*(?:description|documentation|docs) (?:goes|comes|to come|here|missing|pending).*"
    r"|auto-?generated .*stub|document (?:me|this|it).*|not (?:yet )?documented.*|siehe oben|voir ci-dessus|v[ée]ase arriba|zie boven|vedi sopra|keine beschreibung|sans description|sin descripci[óo]n|sem descri[çc][ãa]o|senza descrizione|geen beschrijving|нет описания|暂无(?:描述|说明)?|无)\W*$"
)


def lines_of(doc: Column) -> Column:
    """The prose candidates of a documentation text: its lines without comment marks, quotes and blanks around them."""
    bare = F.regexp_replace(doc, r"(?m)^[ \t]*(?:@(?:doc|moduledoc|typedoc)\s+)?(?:/\*+!?|\*+/|\*+|///?!?|#+!?|--+(?:\[\[)?|;+|[rRuUbBfF]{0,2}(?:\"{3}|'{3}))[ \t]?", "")
    bare = F.regexp_replace(bare, r"(?m)[ \t]*(?:\*+/|\"{3}|'{3}|\]\])[ \t]*$", "")
    return F.filter(F.transform(F.split(bare, r"\r\n|\r|\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\s\"']+|[\s\"']+$", ""), r"^</?\w+>|</?\w+>$", "")), lambda x: F.length(x) > 0)


def prose_of(doc: Column, name: Column) -> Column:
    """The lines of ``doc`` that tell something beyond the words of ``name``: two other words at least."""
    own = F.transform(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(WORDS), F.lit(0)), lambda w: F.lower(w))
    known = F.array(*[F.lit(w) for w in EMPTY_WORDS])

    def tells(line: Column) -> Column:
        words = F.transform(F.regexp_extract_all(line, F.lit(WORDS), F.lit(0)), lambda w: F.lower(w))
        new = F.filter(words, lambda w: ~F.exists(own, lambda n: F.startswith(w, n) & (F.length(w) <= F.length(n) + 3)) & ~F.array_contains(known, w) & (F.length(w) > 1))
        return ~F.rlike(line, F.lit(NO_PROSE)) & (F.size(new) >= 2)

    return F.filter(lines_of(doc), tells)


def lexed(symbols: DataFrame) -> DataFrame:
    """(symbol_id, name, pos, tok, kind, zone, depth, island, before, colons) of the tokens of each function, its latest delivery.

    ``zone`` is 0 in the comment above and 1 in the code; ``depth`` counts open brackets behind the token, ``island`` numbers runs of
    comments, ``before`` is the kind of the token before, ``colons`` counts those at depth 0.
    """
    some = symbols.filter("type = 'function' and symbol_id is not null").select("symbol_id", "name", "doc_comment", "code", "indexed_at")
    once = latest(some, "symbol_id")
    text = F.concat(F.coalesce("doc_comment", F.lit("")), F.lit("\n" + MARK + "\n"), F.coalesce("code", F.lit("")))
    tokens = once.select("symbol_id", "name", F.posexplode(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))).alias("pos", "tok"))
    t = F.col("tok")
    kind = (
        F.when(t == MARK, "mark").when(t.rlike(COMMENT), "comment").when(t.rlike(STRING), "string").when(t.rlike(OPEN), "open").when(t.rlike(CLOSE), "close").when(t == ":", "colon").otherwise("opening")
    )
    w = Window.partitionBy("symbol_id").orderBy("pos")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("kind", kind)
    rows = rows.select(
        "symbol_id", "name", "pos", "tok", "kind",
        F.sum(F.when(F.col("kind") == "mark", 1).otherwise(0)).over(running).alias("zone"),
        F.sum(F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)).over(running).alias("depth"),
        # what interrupts a run of comments raises the number of the next
        F.sum(F.when(F.col("kind") == "comment", 0).otherwise(1)).over(running).alias("island"),
        F.lag("kind", 1, "mark").over(w).alias("before"),
    )
    return rows.withColumn("colons", F.sum(F.when(F.col("kind").isin("colon", "opening") & (F.col("depth") == 0) & (F.col("zone") == 1), 1).otherwise(0)).over(running))


def documentation(symbols: DataFrame) -> DataFrame:
    """(symbol_id, name, doc, closed) of each function once: its raw documentation, null if it has none, and whether its brackets close.

    The documentation is every island of comments above the function (or a string there, where the comment is an attribute), and
    in code whose signature ends in a colon the string that opens the body. Null names, comments and codes are empty; a symbol delivered
    again counts once, its latest delivery. Extra columns are ignored.
    """
    above = (F.col("zone") == 0) & F.col("kind").isin("comment", "string")
    opening = (F.col("zone") == 1) & (F.col("kind") == "opening") & F.col("before").isin("close", "string") & (F.col("depth") == 0) & (F.col("colons") == 1)
    rows = lexed(symbols).withColumn("piece", F.when(above | opening, F.struct("pos", F.regexp_replace("tok", r"^:\s*", "").alias("tok"))))
    said = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["tok"]), "\n")
    islands = rows.groupBy("symbol_id", F.when(F.col("piece").isNotNull(), F.col("island")).alias("island")).agg(F.first("name").alias("name"), said.alias("text"), F.max_by("depth", "pos").alias("depth"), F.max("pos").alias("last"))
    part = F.when(F.col("text") != "", F.struct("island", "text"))
    return islands.groupBy("symbol_id").agg(
        F.first("name").alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "\n").alias("doc"), (F.max_by("depth", "last") == 0).alias("closed")
    ).withColumn("doc", F.when(F.col("doc") != "", F.col("doc")))


def documented(symbols: DataFrame) -> DataFrame:
    """(symbol_id, name, closed, prose): the functions whose documentation tells something of use, with the lines that do."""
    return documentation(symbols).select("symbol_id", "name", "closed", prose_of(F.coalesce("doc", F.lit("")), F.col("name")).alias("lines")).filter("size(lines) > 0").select(
        "symbol_id", "name", "closed", F.array_join("lines", "\n").alias("prose")
    )


def pairs(rows: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(symbol_id, name, signature, code, closed, prose) of each documented function. ``symbols`` may hold ``rows`` once per symbol; where it is left out that is done here."""
    once = symbols if symbols is not None else latest(rows.filter("type = 'function'"), "symbol_id")
    return documented(rows).join(once.select("symbol_id", "signature", "code"), "symbol_id").select("symbol_id", "name", "signature", "code", "closed", "prose")
