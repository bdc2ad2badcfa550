"""Scalar text functions as columns: identifier tokens, fuzzy equality, query expansion, token estimates, globs."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that tokens leave out.
STOPWORDS = "the a an and or but in on at to for of with by from as is was are be".split()
#: Abbreviations and what a query for one also looks for.
EXPANSIONS = {
    "auth": "authenticate authentication authorize authorized authorization", "config": "configuration configure settings", "init": "initialize initialization setup", "db": "database data", "repo": "repository", "func": "function",
    "proc": "process procedure", "util": "utility utilities helper", "mgr": "manager", "ctrl": "controller control", "svc": "service", "req": "request", "res": "response result", "err": "error", "msg": "message",
    "val": "value validate validation", "temp": "temporary template", "str": "string", "num": "number numeric", "bool": "boolean", "obj": "object", "arr": "array", "idx": "index", "max": "maximum", "min": "minimum",
}


def tokenize(c: Column) -> Column:
    """Lower-case words of an identifier or text, in order and with repeats; null for null, empty array for no words.

    camelCase, runs of capitals, ``_ - . / \\`` and white space part words; other punctuation stays. Words of one character
    and stopwords are left out.
    """
    parts = F.split(c, r"[_\-./\\\s]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
    return F.filter(F.transform(parts, F.lower), lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def tokenize_text(text: str) -> list[str]:
    """``tokenize`` of a query string."""
    text = re.sub("([a-z])([A-Z])", r"\1 \2", text)
    text = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", text)
    return [t for t in re.split(r"[ \t\n\r\f\v]+", re.sub(r"[_\-./\\]", " ", text).lower()) if len(t) > 1 and t not in STOPWORDS]


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of the lower-case strings; null if either is null or empty."""
    a, b = F.lower(a), F.lower(b)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 1 - (F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))))


def fuzzy(a: Column, b: Column, threshold: float) -> Column:
    """Whether ``similarity`` reaches the threshold; lengths too far apart decide without a distance."""
    la, lb = F.length(a), F.length(b)
    near = F.abs(la - lb) <= (1 - threshold) * F.greatest(la, lb) + 1e-9
    return F.when((la == 0) | (lb == 0), F.lit(False)).when(near, similarity(a, b) >= threshold).otherwise(F.lit(False))


def edits_within(word: str, threshold: float) -> int:
    """The most edits by which a string may differ from ``word`` and still be similar to ``threshold``: the longer it is, the more."""
    longest = int(len(word) / threshold + 1e-9)
    return int((1 - threshold) * longest + 1e-9)


def may_hold(text: Column, word: str, threshold: float = 1.0) -> Column:
    """Whether ``text`` could hold a token as similar to ``word``: of so many edits and one more pieces of the word, one is left whole."""
    word, k = word.lower(), edits_within(word, threshold)
    cuts = [len(word) * i // (k + 1) for i in range(k + 2)]
    low, found = F.lower(text), F.lit(False)
    for a, b in zip(cuts, cuts[1:]):
        found = found | F.contains(low, F.lit(word[a:b]))
    return F.coalesce(found, F.lit(False))


def token_pattern(word: str) -> str | None:
    """A pattern for the occurrences of ``word`` as a token of ``tokenize``; None where the word is no run of lower-case letters and digits that begins with a letter.

    A token stands between the marks that part words or changes of case, and holds no such change itself.
    """
    if not re.fullmatch(r"[a-z][a-z0-9]+", word):
        return None
    forms = "|".join(dict.fromkeys([word, word.capitalize(), word.upper()]))
    change = "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
    return rf"(?=[{word[0]}{word[0].upper()}])(?:(?<![^_\-./\\\s])|{change})(?:{forms})(?:(?![^_\-./\\\s])|{change})"


def expand(token: str) -> list[str]:
    """What a query token stands for: itself first, then its expansions."""
    return [token, *EXPANSIONS.get(token.lower(), "").split()]


def expansion_column(token: Column) -> Column:
    """``expand`` as a column; null for null."""
    m = F.create_map(*[x for k, v in EXPANSIONS.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in [k, *v.split()]]))])
    return F.when(token.isNotNull(), F.coalesce(F.try_element_at(m, F.lower(token)), F.array(token)))


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for null."""
    return F.ceil(F.coalesce(F.length(c), F.lit(0)) / 4).cast("bigint")


def format_bytes(c: Column) -> Column:
    """B, KB or MB, the latter two with one decimal, halves rounded up; null for null."""

    def tenths(unit: int) -> Column:
        n = F.floor(c * 10 / unit + 0.5).cast("bigint")
        return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))

    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1048576, F.concat(tenths(1024), F.lit(" KB"))).otherwise(F.when(c.isNotNull(), F.concat(tenths(1048576), F.lit(" MB"))))


def normalize_path(c: Column, root: str = "") -> Column:
    """Forward slashes, without ``root`` and a leading slash or ``./``."""
    c = F.regexp_replace(c, r"\\", "/")
    if root:
        c = F.regexp_replace(c, "^" + re.escape(root.replace("\\", "/").rstrip("/")) + "(/|$)", "")
    return F.regexp_replace(c, r"^(\./)+|^/+", "")


def glob_pattern(glob: str, legacy: bool = False) -> str:
    """A whole-path regular expression for a glob: ``*`` stays in a directory, ``**`` and ``**/`` cross them, ``?`` is one character.

    ``legacy``: only ``*`` is known, and of ``**`` one star is any single character.
    """
    if legacy:
        return "^" + re.sub(r"\*", "[^/]*", glob.replace(".", r"\.").replace("**", ".*")) + "$"
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob):
        out += {"**/": "(?:[^/]*/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"
