"""Symbols, imports and exports of files, by the rules of their language."""

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolmill.functions.languages import language_of
from symbolmill.operators.rules import KEYWORD_TYPES, RULES

#: How many lines a block has where its end isn't found.
FAR, NEAR = 50, 10
#: Words that open and close blocks of languages without braces.
WORDS = {
    "ruby": (r"\b(?:def|class|module|if|unless|while|until|for|begin|case)\b", r"\bend\b"), "elixir": (r"\bdo\b", r"\bend\b"), "lua": (r"\b(?:function|if|for|while|do|repeat)\b", r"\b(?:end|until)\b"),
}
OPENS = {k: (re.compile(a), re.compile(b)) for k, (a, b) in WORDS.items()}


class Ends:
    """Block ends in one text; line numbers count from 1. Brace positions are found once for the text."""

    def __init__(self, text: str):
        self.text, self.lines = text, text.split("\n")
        self.starts = [0]
        for x in self.lines:
            self.starts.append(self.starts[-1] + len(x) + 1)
        self.braces = [m.start() for m in re.finditer("[{}]", text)]

    def line_of(self, offset: int) -> int:
        return bisect_left(self.starts, offset + 1)

    def brace(self, start: int) -> int:
        depth, opened = 0, False
        for k in range(bisect_left(self.braces, self.starts[start - 1]), len(self.braces)):
            if self.text[self.braces[k]] == "{":
                depth, opened = depth + 1, True
            else:
                depth -= 1
                if opened and depth == 0:
                    return self.line_of(self.braces[k])
        return min(start + FAR, len(self.lines))

    def statement(self, start: int) -> int:
        n = len(self.lines)
        for i in range(start, n + 1):
            if self.lines[i - 1].strip().endswith((";", ",")):
                return i
            if i < n and (after := self.lines[i].strip()) and not after.startswith((".", "(")):
                return i
        return min(start + NEAR, n)

    def indent(self, start: int) -> int:
        base = len(self.lines[start - 1]) - len(self.lines[start - 1].lstrip())
        for i in range(start + 1, len(self.lines) + 1):
            x = self.lines[i - 1]
            if x.strip() and len(x) - len(x.lstrip()) <= base:
                return i - 1
        return len(self.lines)

    def words(self, start: int, language: str) -> int:
        up, down = OPENS[language]
        depth = 1
        for i in range(start + 1, len(self.lines) + 1):
            x = self.lines[i - 1]
            depth += bool(up.search(x))
            depth -= bool(down.search(x))
            if depth == 0:
                return i
        return min(start + FAR, len(self.lines))

    def end(self, block: str, start: int) -> int:
        if block in OPENS:
            return self.words(start, block)
        return {"brace": self.brace, "statement": self.statement, "indent": self.indent}.get(block, lambda s: s)(start)


COMPILED = {lang: [(r, re.compile(r.pattern, r.flags | re.A)) for r in rules] for lang, rules in RULES.items()}


def extract(text: str, language: str) -> tuple[list[tuple], list[str], list[str]]:
    """(symbols, imports, exports) of one text; symbols are (name, type, line, end_line, code, signature) in rule order, then position."""
    symbols, imports, exports = [], [], []
    ends = Ends(text)
    for rule, rx in COMPILED.get(language, ()):
        for m in rx.finditer(text):
            groups = [g for g in m.groups() if g is not None]
            if rule.emits == "import":
                imports.append(groups[0].strip() if rule.clean == "strip" else groups[0])
                continue
            if rule.emits == "export":
                exports.append(groups[0] or "module")
                continue
            kind = KEYWORD_TYPES[groups[0]] if rule.emits == "by-keyword" else rule.emits
            name = groups[1] if rule.emits == "by-keyword" else groups[0]
            if name in rule.skip:
                continue
            if language == "lua" and rule.emits == "function":
                name = re.split("[.:]", name)[-1]
            line = ends.line_of(m.start())
            signature = {"strip": m.group().strip(), "brace": re.sub(r"\s*\{$", "", m.group())}.get(rule.clean, m.group())
            if rule.block == "match":
                symbols.append((name, kind, line, line, m.group(), signature))
                continue
            end = ends.end(rule.block, line)
            symbols.append((name, kind, line, end, "\n".join(ends.lines[line - 1 : end]), signature))
    return symbols, imports, exports


ROW = pa.struct([("name", pa.string()), ("type", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("code", pa.string()), ("signature", pa.string())])
ROW_SQL = "struct<name:string,type:string,line:int,end_line:int,code:string,signature:string>"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [extract(t, lang) for t, lang in zip(b.column("content").to_pylist(), b.column("language").to_pylist())]
        symbols = pa.array([[dict(zip(("name", "type", "line", "end_line", "code", "signature"), s)) for s in x] for x, _, _ in got], pa.list_(ROW))
        yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("language"), symbols, *(pa.array([x[k] for x in got], pa.list_(pa.string())) for k in (1, 2))], ["file_id", "language", "symbols", "imports", "exports"])


def parse_files(files: DataFrame) -> DataFrame:
    """(file_id, language, symbols, imports, exports) of each row with a content in a language that has rules.

    A null language is taken from the path's ending. Files are independent: one pass, no shuffle. Null contents give no row;
    empty ones empty lists. Extra columns are ignored.
    """
    lang = F.coalesce(F.col("language"), language_of(F.col("path")))
    rows = files.select("file_id", lang.alias("language"), "content").filter(F.col("content").isNotNull() & F.col("language").isin(sorted(RULES)))
    return rows.mapInArrow(_extract, f"file_id bigint, language string, symbols array<{ROW_SQL}>, imports array<string>, exports array<string>")


def symbols_of(files: DataFrame) -> DataFrame:
    """(file_id, ordinal, name, type, line, end_line, code, signature) of every definition."""
    return parse_files(files).select("file_id", F.posexplode("symbols").alias("ordinal", "s")).select("file_id", "ordinal", "s.*")
