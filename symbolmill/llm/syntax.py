"""Lexers and grammars of sixteen languages, loose in what names mean and strict in how tokens may follow one another."""

import re
from functools import lru_cache

from symbolmill.llm.derive import EMPTY, Grammar
from symbolmill.llm.python_syntax import Python, python_grammar

DQ, SQ, BQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'", r"`(?:[^`\\]|\\[\s\S])*`"
CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,10})'"
SLASHES, BLOCK, HASH, DASHES = r"//[^\n]*", r"/\*[\s\S]*?\*/", r"#[^\n]*", r"--(?!\[\[)[^\n]*|--\[\[[\s\S]*?\]\]"
TRIPLE = r'"""[\s\S]*?"""'
#: Lines that version control and patches leave in a file.
CONFLICT = r"(?m:^(?:<{7}|>{7}|\|{7}|={7})(?=[ \t\r]|$)[^\n]*|^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@[^\n]*)"
NUMBER = r"0[xX][0-9a-fA-F_]+\w*|0[bB][01_]+\w*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?(?:[fFdDlLuUmMnif]\w{0,4})?(?![\w])|\.\d+(?:[eE][+-]?\d+)?[fFdD]?"
GENERIC = r"(?<=[\w>])<(?:[\w\s,.?\[\]:'*&]|<(?:[\w\s,.?\[\]:'*&]|<[\w\s,.?\[\]:'*&]*>)*>)*>(?!\d)"
BINARY = "== != === !== < > <= >= && || ?? ** // / % | ^ << >> >>> <=> <- <> =~ !~ ||| &&& |> ++. ~> ?: instanceof !in".split()
ASSIGN = "+= -= *= /= %= &= |= ^= <<= >>= **= //= ??= &&= ||= >>>= := .= ..= <<~".split()


def words(text: str, kind: str) -> dict[str, str]:
    return dict.fromkeys(text.split(), kind)


#: Kinds before which a soft keyword is one.
SOFT_BEFORE = {"id", "mod", "cls", "fun", "var", "{", "s", "imp", "new", "const", "type_", "get_", "lit", "if", "pre"}
#: Words that are keywords in some places and names in others.
SOFT = set("record type module namespace of from get set as is file init required add remove partial params on show hide part library late covariant operator factory extension mixin sealed open data inner value field inline override actor convenience indirect lazy where by given match case get_ static async await yield declare readonly abstract satisfies asserts infer union auto expect actual out constructor annotation enum_ permits final_ global print echo".split())


#: Of these, what a language reserves.
HARD = {"python": SOFT, "lua": SOFT, "ruby": SOFT, "elixir": SOFT, "go": SOFT, "rust": {"match", "type", "where", "static", "async", "abstract", "await"}, "java": {"abstract", "static", "case", "yield"}, "csharp": {"case", "is", "as", "static", "abstract", "override", "readonly", "namespace", "operator", "params"}, "cpp": {"case", "static", "namespace", "inline", "operator", "union", "auto"}, "c": {"case", "static", "inline", "auto", "union"}, "php": {"case", "namespace", "static", "as", "abstract", "print", "echo", "match", "global"}, "kotlin": {"is", "as"}, "scala": {"given", "case", "match", "lazy", "sealed", "override", "abstract", "yield", "type"}, "swift": {"case", "is", "as", "static", "extension", "operator", "await", "where"}, "dart": {"case", "is", "late", "static", "as"}, "javascript": {"case", "yield", "await"}, "typescript": {"case", "yield", "await"}}


class Language:
    """How one language's text becomes token kinds, and its grammar."""

    def __init__(self, name, comments, strings, keywords, ops="", lines=False, generic=True, idents=r"[^\W\d]\w*", extra=(), unlexed=""):
        self.name, self.keywords, self.lines = name, keywords, lines
        signs = sorted({*BINARY, *ASSIGN, *"... ..< .. :: ?. ?: !! => -> ++ -- += \\ =".split(), *ops.split()} - set(unlexed.split()), key=len, reverse=True)
        signs = [re.escape(s) for s in signs if not s[0].isalnum()]
        skip = r"(?:[ \t\r\f﻿\xa0]+" + ("" if lines else r"|\n") + r"|\\\n|" + "|".join(c for c in comments) + ")*+"
        parts = [CONFLICT, *extra, *strings, NUMBER, *([GENERIC] if generic else []), idents, *signs, *([r"\n"] if lines else []), r"\S", r"\Z"]
        self.rx = re.compile(skip + "(" + "|".join(parts) + ")")
        self.ident = re.compile(idents)
        self.string = re.compile("|".join(strings))
        self.number = re.compile(NUMBER)
        self.known: dict[str, str] = {}
        self.soft = SOFT & set(keywords) - (HARD.get(name) or set())
        self.signs = {s.replace("\\", ""): s for s in signs}

    def kind(self, t: str) -> str:
        k = self.known.get(t)
        if k is None:
            k = self._kind(t)
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[t] = k
        return k

    def _kind(self, t: str) -> str:
        if t in self.keywords:
            return self.keywords[t]
        if re.fullmatch(CONFLICT, t):
            return "bad"
        if self.string.fullmatch(t) or t[0] == "/" and len(t) > 2 and self.name == "ruby":
            return "s"
        if t[0] == "#" and len(t) > 1 and self.name in ("c", "cpp"):
            return "include" if "include" in t else "directive"
        if t.startswith("#!"):
            return "shebang"
        if t[0] == "'" and self.name == "rust":
            return "mod"
        if self.name in ("ruby", "elixir"):
            if t[0] == ":" and len(t) > 1 and t != "::":
                return "atom"
            if t[0].isupper() and self.ident.fullmatch(t):
                return "const"
        if self.ident.fullmatch(t):
            return "id"
        if self.number.fullmatch(t):
            return "n"
        if len(t) > 1 and t[0] == "<" and t[-1] == ">" and t != "<>" and t != "<=>":
            return "gen"
        if t in ASSIGN:
            return "asg"
        if t in BINARY:
            return "op"
        if t in ("+", "-", "*", "&", "!", "~"):
            return "pm" if t in "+-*&" else "pre"
        if t in ("++", "--"):
            return "++"
        return t

    def prepare(self, text: str) -> str:
        """The text as it is cut into tokens, of equal length."""
        return text

    def scan(self, text: str) -> list[tuple[int, str]]:
        """(offset, token) of every token."""
        return [(m.start(1), m[1]) for m in self.rx.finditer(self.prepare(text)) if m[1]]

    def tokens(self, text: str) -> list[str]:
        return [t for t in self.rx.findall(self.prepare(text)) if t]

    def lex(self, text: str) -> tuple[list[str], list[int]]:
        """Kinds of the tokens of a text, and of each the number of its token; line ends that end a statement are kind ``end``."""
        kind, known = self.kind, self.known
        toks = self.tokens(text)
        raw = [known.get(t) or kind(t) for t in toks]
        if not self.soft.isdisjoint(toks):  # words that are keywords only where a name or a body follows
            for i, t in enumerate(toks):
                if t in self.soft and (i + 1 == len(raw) or raw[i + 1] not in SOFT_BEFORE or i and raw[i - 1] in (".", "?.", "::")):
                    raw[i] = "id"
        return (raw, list(range(len(raw)))) if not self.lines else self.fold(raw)

    #: Kinds after which, or before which, a line end does not end the statement.
    OPEN_ENDED = {"(", "[", ",", "op", "pm", "pre", "=", "asg", ".", "?.", "::", "=>", "->", "?", ":", "\\", "end", "{", ";", "do_", "|", "mod", "in", "@"}
    CONTINUES = {".", "?.", "op", "=>", "?", ":", ")", "]", ",", "=", "asg", "->", "else_", "::", ";", "end", "?:"}

    def fold(self, raw: list[str]) -> tuple[list[str], list[int]]:
        out: list[str] = []
        at: list[int] = []
        depth: list[str] = []
        n = len(raw)
        for i, k in enumerate(raw):
            if k == "\n":
                if depth and depth[-1] != "{":
                    continue
                if not out or out[-1] in self.OPEN_ENDED:
                    continue
                j = i + 1
                while j < n and raw[j] == "\n":
                    j += 1
                if j < n and raw[j] in self.CONTINUES:
                    continue
                out.append("end")
                at.append(i)
                continue
            if k in ("(", "[", "{"):
                depth.append(k)
            elif k in (")", "]", "}") and depth:
                depth.pop()
            elif k in ("do_", "fn_") and self.name in ("ruby", "elixir") and depth and (i + 1 == n or raw[i + 1] != ":"):
                depth.append("{")  # a block among arguments has lines of its own
            elif k == "stop" and depth and depth[-1] == "{":
                depth.pop()
            out.append(k)
            at.append(i)
        return out, at


class Script(Language):
    """JavaScript and TypeScript: what stands in front of a slash tells a regular expression from a division, and templates may nest."""

    REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
    NESTED = re.compile(r"\$\{[^}`]*`")
    #: Kinds that end an operand, so that a slash behind them divides.
    OPERANDS = {"id", "n", "s", "lit", ")", "]", "}", "++"}

    def template(self, text: str, i: int) -> int:
        """Where the template that begins at ``i`` ends."""
        i, depth, n = i + 1, [], len(text)
        while i < n:
            c = text[i]
            if c == "\\":
                i += 1
            elif depth and c == "}":
                depth.pop()
            elif depth and c == "{":
                depth.append("{")
            elif depth and c == "`":
                i = self.template(text, i) - 1
            elif depth and c in "\"'":
                m = self.string.match(text, i)
                i = m.end() - 1 if m else i
            elif not depth and c == "`":
                return i + 1
            elif not depth and text.startswith("${", i):
                depth.append("{")
                i += 1
            i += 1
        return n

    def scan(self, text: str) -> list[tuple[int, str]]:
        out, pos, before, known = [], 0, "", self.known
        while m := self.rx.match(text, pos):
            t, pos = m[1], m.end()
            if not t:
                break
            if t[0] == "/" and before not in self.OPERANDS and (m2 := self.REGEX.match(text, m.start(1))):
                t, pos = "\"\"", m2.end()
            elif t[0] == "`":
                pos = self.template(text, m.start(1))
                t = "\"\"" if text[pos - 1 : pos] == "`" else t
            out.append((m.start(1), t))
            before = (known.get(t) or self.kind(t)) if t != "\n" else before
        return out

    def tokens(self, text: str) -> list[str]:
        toks = super().tokens(text)
        if "/" in toks or "/=" in toks or "`" in toks or self.NESTED.search(text):
            return [t for _, t in self.scan(text)]
        return toks


def expressions(g: Grammar, *, blocks=False, objects=False, trailing=False, named="", ternary=True, casts=False, strings_join=False, colon_args=False, arrow=False, funs="", types=False, pre="", mods="", spread=True, operators="", assigns=True, slices=False, choice=0, closures=False, arms=False) -> int:
    """Rules ``E`` (expression), ``group`` (arguments or parentheses) and their parts."""
    e, block = g.ref("E"), g.ref("block")
    label = g.opt(g.alt(g.seq("id", named), g.seq("s", named) if named == ":" else g.seq("id", named))) if named else g.seq()
    arg = g.seq(g.opt("...") if spread else g.seq(), label, e, g.opt("...") if spread else g.seq())
    items = g.opt(arg, g.star(",", g.opt(arg)))
    group = g.rule("group", g.seq("(", items, ")"))
    index = g.rule("index", g.seq("[", g.opt(g.alt(e, ":"), g.star(g.alt(":", ",", "..", "..."), g.opt(e))), "]"))
    key = g.alt("id", "s", "n", g.seq("[", e, "]"), "kw", "mod", "var", "lit", "fun", "cls", "if", "for", "imp", "ret", "new", "op_word")
    member = g.alt(g.seq("...", e), g.seq(g.opt("mod"), key, g.opt(g.alt(g.seq(":", e), g.seq(group, block)))), g.seq("id", "=", e))
    obj = g.seq("{", g.opt(member, g.star(",", g.opt(member))), "}")
    post = [g.seq(g.alt(".", "?.", "::", "!!."), g.alt("id", "kw", "mod", "n", "new", "cls", "lit", "imp", "fun", "if", "for", "var", "ret", "op_word", group, index, "gen", g.seq("pre", "id"))), group, index, g.tok("++"), g.tok("gen"), g.tok("!!")]
    if not ternary:
        post.append(g.tok("?"))
    if trailing:
        post.append(block)
    if types:
        post.append(g.tok("pre"))
    prim = [g.tok("id", "n", "lit"), g.plus("s") if strings_join else g.tok("s"), group, index]
    if objects:
        prim.append(obj)
    if blocks:
        prim.append(block)
    if choice:
        prim.append(g.seq("switch", "(", e, ")", choice))
    if arrow:
        prim.append(g.tok("op_pre"))  # a bare yield
    if closures:
        one = g.seq(g.star(g.alt("pm", "mod")), g.alt("id", group), g.opt(":", g.ref("type")))
        prim.append(g.seq(g.opt("mod"), "op", g.opt(g.opt(one, g.star(",", one)), "op"), g.opt("->", g.ref("type")), e))
    if arms:
        arm = g.seq(g.alt(e, "default_"), g.star(",", e), "=>", e)
        cases = g.seq("{", arm, g.star(",", arm), g.opt(","), "}")
        prim.append(g.seq("switch", "(", e, ")", cases))
        post.append(g.seq("switch", cases))
    if funs:
        prim.append(g.seq(g.opt("mod"), funs, g.opt("pm"), g.opt("id"), group, g.opt(g.alt(":", "->"), g.ref("type")), block))
    if arrow:
        prim.append(g.seq(g.opt(g.alt("mod", "id")), g.alt(g.ref("params"), "id"), g.opt(":", g.ref("type")), "=>", g.alt(e, block)))
    if slices:  # []T{...}, [3]T{...}, map[K]V{...}
        prim += [g.seq("[", g.opt(g.alt(e, "...")), "]", g.ref("type"), obj), g.seq("id", "[", g.ref("type"), "]", g.ref("type"), obj), g.seq("cls", "{", "}", g.opt(obj)), g.seq("op_word", g.ref("type"))]
    prefix = g.star(g.alt("pm", "pre", "++", "new", *pre.split()))
    if casts:
        prefix = g.star(g.alt("pm", "pre", "++", "new", group, *pre.split()))
    unary = g.seq(prefix, g.alt(*prim), g.star(g.alt(*post)))
    binop = g.alt("op", "pm", *(["=", "asg"] if assigns else []), "op_word", "..", *operators.split())
    rest = g.star(binop, unary)
    tern = g.opt("?", e, ":", e) if ternary else g.seq()
    return g.rule("E", g.seq(unary, rest, tern))


def typed(g: Grammar, style: str) -> None:
    """Rule ``type``: names with arguments, pointers, arrays, functions and unions."""
    t = g.ref("type")
    some = g.opt(t, g.star(",", t))
    atom = g.alt(g.seq("id"), "s", "n", g.seq("[", g.opt(t, g.star(g.alt(",", ";", ":"), g.alt(t, "n"))), "]", g.opt(g.alt("id", g.ref("type")))), g.seq("(", g.opt(g.opt("id", g.opt("?"), ":"), t, g.star(",", g.opt("id", g.opt("?"), ":"), t)), ")"), g.seq("{", g.star(g.alt("id", "s", ":", ",", ";", "?", "|", "end", "mod", g.seq("[", some, "]"))), "}"), "lit", "new", "imp", "kw", "cls", "fun")
    tail = g.star(g.alt(g.seq(g.alt(".", "::"), "id"), "gen", g.seq("[", g.opt(g.alt(t, "n"), *([g.star(",", t)] if style == "go" else [])), "]"), "?", "pre", "pm", "!!", *([g.seq("(", some, ")")] if style == "rust" else [])))
    g.rule("type", g.seq(g.star(g.alt("pm", "pre", "mod", "op_word", *(["cls"] if style == "rust" else []))), atom, tail, g.star(g.alt("op", "pm", "->", "=>", "is_", "op_word"), t)))


def braces(style: str) -> Grammar:
    """The grammar of a language whose blocks are braces."""
    g = Grammar()
    typed(g, style)
    ty, e, block, stmt, group, params = (g.ref(x) for x in ("type", "E", "block", "stmt", "group", "params"))
    semi = style in ("java", "csharp", "c", "cpp", "php", "rust", "dart")
    end = g.plus(";") if semi else g.plus(g.alt(";", "end"))
    g.rule("block", g.seq("{", g.star(g.alt(stmt, "end", ";")), g.ref("last"), "}"))
    heads = style in ("go", "rust", "swift")
    expressions(
        g, blocks=style in ("rust", "kotlin", "scala", "swift", "cpp", "java", "csharp", "dart", "go", "c"), objects=style in ("javascript", "typescript", "dart", "go", "c", "cpp", "csharp", "swift"),
        trailing=style in ("kotlin", "scala", "swift", "rust", "go", "cpp", "java", "csharp") and not heads or style == "cpp", named={"swift": ":", "csharp": ":", "kotlin": "=", "dart": ":", "php": ":"}.get(style, ""), ternary=style not in ("go", "rust", "kotlin", "scala"),
        casts=style in ("java", "csharp", "c", "cpp", "php", "go"), strings_join=style in ("c", "cpp", "dart"), arrow=style in ("javascript", "typescript"), funs="fun" if style in ("javascript", "typescript", "php", "go", "kotlin") else "", assigns=style != "go", slices=style == "go", choice=block if style in ("java", "kotlin", "csharp") else 0, closures=style == "rust", arms=style in ("php", "csharp"),
        types=style in ("typescript", "swift", "kotlin", "dart", "csharp", "rust"), pre={"javascript": "op_pre", "typescript": "op_pre gen", "php": "@ mod", "go": "<-", "rust": "mod", "swift": "mod", "csharp": "mod"}.get(style, ""),
        operators={"javascript": "in", "typescript": "in as_", "kotlin": "in as_ -> ..<", "scala": "-> =>", "rust": "as_ => ... :", "java": "->", "csharp": "=>", "cpp": "-> ...", "c": "->", "php": "=> -> as_", "swift": "as_ ... ..< ??", "dart": "=> as_", "go": ""}.get(style, ""),
    )
    post_if = g.alt(block, stmt) if not heads else block
    # parameters
    decl = style in ("java", "csharp", "c", "cpp", "dart", "go", "php")
    note = g.seq("@", "id", g.star(".", "id"), g.opt(group))
    ident = g.alt("id", g.seq("{", g.star(g.alt("id", ",", ":", "=", "n", "s", "...")), "}"), g.seq("[", g.star(g.alt("id", ",", "=", "n", "s", "...")), "]"))
    if style == "javascript":
        param = g.seq(g.opt("..."), ident, g.opt("=", e))
    elif style == "typescript":
        param = g.seq(g.star("mod"), g.opt("..."), ident, g.opt("?"), g.opt(":", ty), g.opt("=", e))
    elif style in ("kotlin", "scala", "rust", "swift"):
        param = g.seq(g.opt(note), g.star(g.alt("mod", "var", "pm")), g.opt("id"), g.alt("id", "lit"), g.opt(":", ty, g.opt("...")), g.opt("=", e))
    elif style == "go":
        param = g.seq(g.opt("id"), g.opt("..."), ty)
    elif style == "php":
        param = g.seq(g.star("mod"), g.opt(g.opt("?"), ty), g.opt("pm"), g.opt("..."), g.opt("id"), g.opt("=", e))
    else:
        param = g.seq(g.star(g.alt("mod", "var", note)), g.alt("...", g.seq(ty, g.opt("..."), g.opt("id"), g.star(index_of(g)), g.opt(g.alt("=", ":"), e))))
        if style == "dart":
            param = g.alt(param, g.seq("{", g.star(g.alt("id", "mod", "gen", ",", "?", "=", "n", "s", "lit", ".")), "}"), g.seq("[", g.star(g.alt("id", "mod", "gen", ",", "?", "=", "n", "s", "lit")), "]"), g.seq("id", ".", "id"))
    g.rule("params", g.seq("(", g.opt(param, g.star(",", g.opt(param))), ")"))
    attr = {"java": note, "kotlin": note, "scala": note, "swift": note, "dart": note, "typescript": note, "csharp": g.seq("[", e, g.star(",", e), "]"), "rust": g.seq("#", g.opt("pre"), "[", g.star(g.alt("id", "=", "s", "n", ",", "::", group)), "]"), "php": g.seq("#", "[", e, "]")}.get(style)
    lead = g.star(g.alt("mod", g.seq("mod", group), *([attr, g.seq(attr, "end")] if attr is not None else [])))
    body = g.alt(block, end if semi else EPS_END(g, end))
    result = {"typescript": g.opt(":", ty), "kotlin": g.opt(":", ty), "scala": g.opt(":", ty), "rust": g.opt("->", ty), "swift": g.seq(g.star("mod"), g.opt("->", ty)), "go": g.opt(g.alt(ty, params)), "php": g.opt(":", g.opt("?"), ty)}.get(style, g.seq())
    where = g.opt("where", g.star(g.alt("id", ":", ",", "gen", "pm", "::", ".", "op", "==", group)))
    forms = [block]
    kinds = g.seq("[", g.plus("id", g.star(",", "id"), ty, g.opt(",")), "]")  # type parameters of Go
    # functions with a keyword
    receiver = g.opt(params) if style == "go" else g.seq()
    name = g.seq(g.opt("pm"), g.alt("id", "new", "kw")) if style in ("javascript", "typescript", "php") else g.seq(g.alt("id", "s", "new"), g.star(".", "id"))
    if style in ("javascript", "typescript", "php", "go", "rust", "swift", "kotlin"):
        tail = [g.seq(where, block)]
        if style == "kotlin":
            tail += [g.seq("=", e, end), end]
        if style in ("typescript", "rust", "swift", "php", "go"):
            tail.append(end)
        forms.append(g.seq(lead, "fun", receiver, g.opt("gen"), name, g.opt(g.alt("gen", kinds)) if style == "go" else g.opt("gen"), params, result, g.alt(*tail)))
    if style == "scala":
        forms.append(g.seq(lead, "fun", g.alt("id", "op", "new"), g.opt(index_of(g)), g.star(params), result, g.alt(end, g.seq("=", e, end), block)))
    # classes and the like
    bases = g.star(g.alt("id", "gen", "ext", "op_word", ".", "::", ",", ":", "mod", "pm", params, group, g.seq("[", g.opt(ty), "]"), "lit", "?", "acc"))
    if style in ("go",):
        forms.append(g.seq("type_", "id", g.opt(g.alt("gen", kinds)), g.opt("="), g.alt(g.seq("cls", "{", g.star(g.alt("id", ".", "gen", "s", "pm", "end", ";", ",", "cls", "[", "]", "n", params, "(", ")", "{", "}")), "}"), ty), end))
        forms.append(g.seq(g.alt("var", "const_"), "(", g.star(g.alt("end", ";", g.seq("id", g.opt(ty), g.opt("=", e)))), ")", end))
        forms.append(g.seq("imp", g.alt(g.seq(g.opt("id"), "s"), g.seq("(", g.star(g.alt("s", "id", "end", ";", ".")), ")"), "id"), end))
    elif style in ("c",):
        forms.append(g.seq(lead, "cls", g.opt("id"), g.opt(g.alt(g.ref("fields"), g.ref("enum"))), g.star(g.alt("id", "pm", ",", g.seq("=", e), index_of(g))), ";"))
        forms.append(g.seq("cls", "id", g.star("pm"), "id", g.alt(g.seq(params, block), g.seq(g.opt("=", e), ";"))))
        g.rule("fields", g.seq("{", g.star(g.alt("id", "mod", "pm", ",", ";", ":", "n", "cls", index_of(g), params, group, g.ref("fields"))), "}"))
        g.rule("enum", g.seq("{", g.opt("id", g.opt("=", e), g.star(",", g.opt("id", g.opt("=", e)))), "}"))
    else:
        enum = g.seq("{", g.star(g.alt(g.seq(g.alt("id", "s"), g.opt(group), g.opt("=", e), g.opt(block)), ",", g.seq(g.opt("end")), g.seq("if", "id"))), g.opt(";", g.star(g.alt(stmt, "end"))), "}")
        fields = g.seq("{", g.star(g.alt(g.seq(lead, g.alt("id", "s"), g.opt("?"), g.opt(params), ":", ty), ",", ";", "end", g.seq("[", "id", ":", ty, "]", ":", ty))), "}") if style in ("typescript", "rust") else EMPTY
        inside = g.ref("members") if style in ("javascript", "typescript") else block
        kind_ = g.seq(lead, "cls", g.opt("cls"), g.opt(g.alt("id", "gen")), bases, where, g.alt(inside, *([block] if style == "typescript" else []), enum, fields, g.alt(end) if style in ("kotlin", "scala", "rust", "csharp", "cpp", "java") else inside), g.opt(";") if style in ("cpp", "c", "csharp") else g.seq())
        forms.append(kind_)
    # variables with a keyword
    if style in ("javascript", "typescript", "go", "rust", "swift", "kotlin", "scala", "dart", "csharp", "java", "cpp"):
        dest = g.seq(g.star("mod"), g.alt(ident, g.ref("params") if style in ("kotlin", "rust", "swift", "scala", "csharp") else ident), g.opt("pre"))
        typed_ = {"javascript": g.seq(), "go": g.opt(ty), "java": g.seq(), "cpp": g.seq(), "csharp": g.seq(), "dart": g.seq()}.get(style, g.opt(":", ty))
        more = g.star(",", dest, typed_, g.opt("=", e))
        first = {"dart": g.alt(dest, g.seq(ty, dest)), "cpp": g.seq(g.star("pm"), dest)}.get(style, dest)
        value = g.alt(e, g.ref("control")) if style in ("kotlin", "scala", "rust", "swift") else e
        stop = end
        if style in ("kotlin", "swift", "csharp"):
            stop = g.alt(end, g.seq(block, g.opt("end")))
        if style == "rust":
            stop = g.seq(g.opt("else_", block), end)
        forms.append(g.seq(lead, "var", first, typed_, g.opt(g.alt("=", "asg") if style == "go" else "=", value), more, stop))
    if style == "typescript":
        forms.append(g.seq(lead, "type_", "id", g.opt("gen"), "=", ty, end))
    record = g.seq(lead, "rec_", "id", g.opt("gen"), params, g.star(g.alt("ext", "id", ",", ".", "gen")), block)
    if style == "java":
        forms.append(record)
    if style == "rust":
        forms.append(g.seq(lead, "const_", g.opt("var"), "id", ":", ty, "=", e, end))
        forms.append(g.seq(lead, "type_", "id", g.opt("gen"), "=", ty, end))
        tree = g.ref("usetree")
        g.rule("usetree", g.alt(g.seq(g.alt("id", "pm"), g.opt("::", tree), g.opt("as_", "id")), g.seq("{", g.opt(tree, g.star(",", g.opt(tree))), "}")))
        forms.append(g.seq(lead, "imp", g.opt("::"), tree, end))
        forms.append(g.seq("id", "pre", g.opt("id"), g.alt(g.seq(g.alt(group, index_of(g)), end), block)))
    if style == "go":
        forms.append(g.seq(g.alt("const_"), "id", g.opt(ty), "=", e, end))
    # control
    cond = g.seq("(", g.opt(e, g.star(g.alt(",", ";"), g.opt(e))), ")")
    if style in ("javascript", "typescript"):
        loop = g.seq("(", g.alt(g.seq(g.opt("var"), ident, g.alt("in", "of_"), e), g.seq(g.opt(g.opt("var"), ident, g.opt("=", e), g.star(",", e)), ";", g.opt(e), ";", g.opt(e, g.star(",", e)))), ")")
        control = [g.seq("for", g.opt("op_pre"), loop, post_if), g.seq(g.alt("if", "while"), cond, post_if)]
    elif style in ("java", "cpp", "c"):
        v = g.alt("var", g.seq(g.star("mod"), ty)) if style != "c" else g.seq(g.star("mod"), g.opt("cls"), ty)
        each = [g.seq(g.star("mod"), v, g.star("pm"), ident, ":", e)] if style != "c" else []
        loop = g.seq("(", g.alt(*each, g.seq(g.opt(g.alt(e, g.seq(v, "id", "=", e)), g.star(",", e)), ";", g.opt(e), ";", g.opt(e, g.star(",", e)))), ")")
        control = [g.seq("for", loop, post_if), g.seq(g.alt("if", "while"), g.opt("mod"), cond, post_if)]
    elif style in ("csharp", "dart"):
        v = g.alt("var", ty, g.seq("mod", g.opt(ty)))
        each = g.seq("(", v, ident, "in", e, ")")
        loop = g.seq("(", g.opt(g.alt(e, g.seq(v, "id", "=", e)), g.star(",", e)), ";", g.opt(e), ";", g.opt(e, g.star(",", e)), ")")
        control = [g.seq("foreach", each, post_if) if style == "csharp" else g.seq("for", each, post_if), g.seq("for", loop, post_if), g.seq(g.alt("if", "while"), cond, post_if)]
    elif style == "php":
        each = g.seq("(", e, "as_", g.opt(e, "=>"), g.opt("pm"), e, ")")
        control = [g.seq("foreach", each, post_if), g.seq("for", g.seq("(", g.opt(e, g.star(",", e)), ";", g.opt(e), ";", g.opt(e), ")"), post_if), g.seq(g.alt("if", "while"), cond, post_if)]
    elif style == "kotlin":
        control = [g.seq("for", g.seq("(", g.alt("id", g.ref("params")), g.opt(":", ty), "in", e, ")"), post_if), g.seq(g.alt("if", "while"), cond, g.alt(post_if, e))]
    elif style == "scala":
        gens = g.plus(g.alt("id", g.seq("(", g.star(g.alt("id", ",")), ")")), g.alt("op", "="), e, g.star(g.alt(";", "end", g.seq("if", e))))
        control = [g.seq("for", g.alt(g.seq("(", gens, ")"), g.seq("{", g.star("end"), gens, "}")), g.opt("yield_"), g.alt(post_if, e)), g.seq(g.alt("if", "while"), cond, g.alt(post_if, e))]
    elif style == "go":
        simple = g.seq(e, g.star(",", e), g.opt(g.alt("=", "asg"), g.opt("range_"), e, g.star(",", e)))
        control = [g.seq("for", g.opt(g.alt(simple, g.seq("range_", e), g.seq(g.opt(simple), ";", g.opt(e), ";", g.opt(simple)))), block), g.seq("if", g.opt(simple, ";"), simple, block), g.seq("switch", g.opt(simple), g.opt(";", g.opt(simple)), block)]
    elif style == "rust":
        control = [g.seq("for", g.alt(ident, g.ref("params"), group), "in", e, block), g.seq(g.alt("if", "while"), g.opt("var", e, ), e, block), g.seq("loop", block), g.seq("switch", e, "{", g.star(g.alt(g.seq(e, g.opt("if", e), "=>", g.alt(e, block, stmt)), ",")), "}")]
    else:  # swift
        control = [g.seq("for", g.alt(ident, g.ref("params")), "in", e, g.opt("where", e), block), g.seq(g.alt("if", "while"), g.opt("var", "id", g.opt("=", e)), g.opt(e), g.star(",", g.alt(e, g.seq("var", "id", "=", e))), block), g.seq("guard", g.opt("var"), e, "else_", block)]
    control += [
        g.seq("else_", g.opt("->") if style == "kotlin" else g.seq(), g.alt(post_if, stmt if not heads else g.ref("control"), *([e] if style in ("kotlin", "scala") else []))),
        g.seq("try", g.opt(cond) if style in ("java",) else g.seq(), block), g.seq("catch", g.opt(g.alt(params, group, cond)), block) if not heads else g.seq("catch", g.opt(e), block), g.seq("finally", block),
        g.seq("do_", block, g.opt("end"), g.opt("while", g.alt(cond, e), g.opt(end))), g.seq("switch", cond if not heads else e, block), g.seq("case_", g.alt(e, g.seq(ty, "id")) if style in ("java", "csharp") else e, g.star(",", e), g.opt("if", e), g.alt(":", "->", "=>")), g.seq("default_", g.alt(":", "->")), g.seq("lock_", cond, block),
    ]
    g.rule("control", g.alt(*control))
    forms.append(g.ref("control"))
    # jumps and imports
    forms.append(g.seq("ret", g.opt(g.alt(g.seq(e, g.star(",", e)), *([g.ref("control")] if style in ("rust", "kotlin", "scala", "swift") else []))), end))
    path = g.seq("id", g.star(g.alt(".", "::", "\\"), g.alt("id", "pm", "op_word")), g.opt("." if style == "scala" else "::", "{", g.star(g.alt("id", ",", "=>")), "}"))
    if style in ("javascript", "typescript"):
        names = g.seq("{", g.star(g.alt("id", ",", "as_", "default_", "type_")), "}")
        what = g.alt("id", names, g.seq("pm", "as_", "id"), g.seq("id", ",", names))
        forms.append(g.seq("imp", g.alt("s", g.seq(g.opt("type_"), what, "from_", "s")), end))
        forms.append(g.seq("export_", g.alt(g.seq(g.alt(names, g.seq("pm", g.opt("as_", "id"))), g.opt("from_", "s"), end), stmt, g.seq("default_", g.alt(g.seq(e, end), stmt)))))
        # methods of classes and fields
        key = g.alt("id", "s", "kw", g.seq("[", e, "]"), "new", "#")
        method = g.seq(lead, g.opt("pm"), key, g.opt("gen"), params, result, g.alt(block, end) if style == "typescript" else block)
        field = g.seq(lead, key, *([g.opt(g.alt("?", "pre")), g.opt(":", ty)] if style == "typescript" else []), g.opt("=", e), end)
        last_field = g.seq(lead, key, *([g.opt("?"), g.opt(":", ty)] if style == "typescript" else []), g.opt("=", e))
        g.rule("members", g.seq("{", g.star(g.alt(method, field, g.seq("mod", block), "end", ";")), g.opt(last_field), "}"))
    elif style in ("java", "kotlin", "scala", "swift", "csharp", "php"):
        alias = g.opt(g.alt("=", "as_"), path) if style != "java" else g.seq()
        forms.append(g.seq(g.opt("mod"), "imp", g.star(g.alt("mod", "fun", "const_")), path, alias, g.opt("{", g.star(g.alt("id", ",")), "}") if style == "php" else g.seq(), end))
        forms.append(g.seq("pkg", path, g.alt(end, block) if style in ("csharp", "php") else end))
    elif style == "dart":
        forms.append(g.seq("imp", "s", g.star(g.alt("as_", "id", ",", "mod")), end))
    elif style in ("c", "cpp"):
        forms += [g.tok("include"), g.tok("directive")]
        if style == "cpp":
            forms += [g.seq("imp", g.opt("pkg"), path, g.opt("=", ty), end), g.seq("pkg", g.opt(path), g.alt(block, g.seq("=", path, end))), g.seq("acc", ":"), g.seq("template_", g.opt("gen"), stmt)]
    if style == "go":
        forms += [g.seq("pkg", "id", end), g.seq(g.alt("defer_"), e, end), g.seq(e, g.star(",", e), g.alt("=", "asg"), g.opt("range_"), e, g.star(",", e), end)]
    # declarations without a keyword
    if decl and style not in ("go",):
        one = g.seq(g.star("pm"), "id", g.star(index_of(g)), g.opt("=", g.alt(e, g.ref("block"))))
        forms.append(g.seq(lead, g.opt("gen"), ty, one, g.star(",", one), end))
        throws = g.star(g.alt("mod", "ext", "op_word", "id", ",", ".")) if style == "java" else g.star("mod") if style != "c" else g.seq()
        arrow = g.alt(block, end, g.seq("=>", e, end), g.seq(":", e, g.star(",", e), block)) if style in ("csharp", "cpp", "dart") else g.alt(block, end)
        forms.append(g.seq(lead, g.opt("gen"), g.opt(ty), g.alt("id", g.seq("id", "::", g.opt("pre"), "id"), "get_"), g.opt("gen"), params, throws, where, arrow))
        if style == "csharp":
            forms += [g.seq(lead, ty, "id", block, g.opt("=", e, end)), g.seq(lead, ty, "id", "=>", e, end), g.seq(lead, g.alt("get_"), g.alt(end, block, g.seq("=>", e, end)))]
    if style in ("kotlin", "swift"):
        forms.append(g.seq(lead, "new", g.opt("?"), g.opt(params), g.opt(":", e), g.opt(block)))
        forms.append(g.seq(lead, g.alt("get_"), g.opt(params), g.opt(":", ty), g.alt(block, g.seq("=", e), EPS_END(g, end))))
        forms.append(g.seq("case_", g.plus(g.alt("id", ",", group, g.seq("=", e))), end))
    several = g.star(",", e) if style in ("javascript", "typescript", "c", "cpp", "go") else g.seq()
    forms.append(g.seq(lead, e, several, end) if style not in ("java", "csharp", "c", "dart") else g.seq(e, several, end))
    forms.append(g.seq("id", ":", stmt) if style in ("javascript", "typescript", "c", "cpp", "java", "go") else block)
    g.rule("stmt", g.alt(*forms))
    # the last statement of a block or file may lack its end where the language allows it
    tail = g.alt(e, g.seq("ret", g.opt(e, g.star(",", e))), g.seq("imp", path)) if not semi or style == "rust" else EMPTY_SEQ(g)
    if not semi:
        loose = g.alt(g.seq(lead, e, several), g.seq("ret", g.opt(e, g.star(",", e))), g.seq(lead, "var", g.star("mod"), ident, g.opt(":", ty), g.opt(g.alt("=", "asg"), e)), g.seq("pkg", path), g.seq("imp", path), g.seq("imp", "s"))
        if style in ("javascript", "typescript"):
            loose = g.alt(loose, g.seq("imp", what, "from_", "s"), g.seq("export_", "default_", e), g.seq("export_", "var", ident, g.opt(":", ty), "=", e))
        if style == "go":
            loose = g.alt(loose, g.seq(e, g.star(",", e), g.alt("=", "asg"), e, g.star(",", e)), g.seq("imp", g.opt("id"), "s"), g.seq("var", "id", g.opt(ty), "=", e))
        if style == "kotlin" or style == "scala":
            loose = g.alt(loose, g.seq(lead, "fun", "id", g.star(params), g.opt(":", ty), "=", e))
        tail = g.opt(loose)
    else:
        tail = g.opt(tail) if style == "rust" else g.seq()
    g.rule("last", tail)
    start = g.seq(g.opt("open_tag") if style == "php" else g.seq(), g.opt("shebang"), g.star(g.alt(stmt, "end", ";")), g.ref("last"), g.star("end"))
    if style == "java":
        top = g.alt(kind_, g.seq("imp", g.star("mod"), path, end), g.seq(g.star(note), "pkg", path, end), record, ";")
        start = g.star(top)
    if style == "php":
        start = g.seq("open_tag", g.star(g.alt(stmt, ";")), g.opt("close_tag"))
    g.rule("start", g.opt(start) if style != "php" else g.alt(start, g.seq()))
    return g.close()


def index_of(g):
    return g.seq("[", g.opt(g.ref("E")), "]")


def EPS_END(g, end):
    return end


def EMPTY_SEQ(g):
    return g.seq()


def lua_grammar() -> Grammar:
    g = Grammar()
    e, block = g.ref("E"), g.ref("block")
    args = g.alt(g.ref("group"), "s", g.ref("tab"))
    field = g.alt(g.seq("[", e, "]", "=", e), g.seq("id", "=", e), e)
    g.rule("group", g.seq("(", g.opt(e, g.star(",", e)), ")"))
    g.rule("tab", g.seq("{", g.opt(field, g.star(g.alt(",", ";"), g.opt(field))), "}"))
    typ = g.opt(":", g.ref("ty"))
    g.rule("ty", g.seq(g.alt("id", "s", "lit", g.seq("{", g.star(g.alt("id", ":", ",", "[", "]", "?", "|")), "}"), g.ref("tygroup")), g.star(g.alt(g.seq(".", "id"), "gen", "?", g.seq(g.alt("op", "|", "pm"), g.ref("ty")), g.seq("->", g.ref("ty"))))))
    g.rule("tygroup", g.seq("(", g.opt(g.ref("ty"), g.star(",", g.ref("ty"))), ")"))
    name = g.alt(g.seq("id", typ), "...")
    body = g.seq("(", g.opt(name, g.star(",", name)), ")", typ, block, "stop")
    prim = g.alt("id", g.seq("(", e, ")"))
    chain = g.seq(prim, g.star(g.alt(g.seq(".", "id"), g.seq("[", e, "]"), g.seq(":", "id", args), args)))
    unary = g.seq(g.star(g.alt("pm", "not", "#", "~", "pre")), g.alt("n", "s", "lit", "...", g.ref("tab"), g.seq("function", body), chain))
    g.rule("E", g.seq(unary, g.star(g.alt("op", "pm", "bool", "..", "pre"), unary)))
    exprs = g.seq(e, g.star(",", e))
    last = g.seq("return", g.opt(exprs), g.opt(";"))
    stmt = g.alt(
        ";", g.seq(chain, g.star(",", chain), g.opt(g.alt("=", "asg"), exprs)), g.seq("local", "id", typ, g.opt("op", "id", "op"), g.star(",", "id", typ), g.opt("=", exprs)), g.seq("local", "function", "id", g.opt("gen"), body),
        g.seq("function", "id", g.star(".", "id"), g.opt(":", "id"), g.opt("gen"), body), g.seq("if", e, "then", block, g.star("elseif", e, "then", block), g.opt("else", block), "stop"), g.seq("while", e, "do", block, "stop"),
        g.seq("for", "id", g.star(",", "id"), g.alt("in", "="), exprs, "do", block, "stop"), g.seq("repeat", block, "until", e), g.seq("do", block, "stop"), "break", g.seq("goto", "id"), g.seq("::", "id", "::"),
    )
    g.rule("block", g.seq(g.star(stmt), g.opt(last)))
    g.rule("start", g.seq(g.opt("shebang"), block))
    return g.close()


def ended(style: str) -> Grammar:
    """Ruby and Elixir: statements by lines, blocks ended by a word."""
    g = Grammar()
    e, body = g.ref("E"), g.ref("body")
    item = g.alt(g.seq(g.opt(g.alt("op", "pm")), e, g.opt(g.alt("=>", ":"), e)), g.seq(g.alt("id", "s", "kw", "if", "cls", "const", "do_", "else_"), ":", g.opt(e)), g.seq("pm", "id"))
    items = g.opt(item, g.star(",", g.opt(item)))
    g.rule("group", g.seq("(", g.star("end"), items, g.star("end"), ")"))
    lst = g.seq("[", items, "]")
    bars = g.opt("|", g.star(g.alt("id", ",", "pm", "=", "n", "s", "(", ")", "op")), "|")
    blk = g.seq("do_", g.star("end"), bars, body, "stop")
    cur = g.seq("{", g.star("end"), bars, g.alt(body, g.seq(items, g.star("end"))), "}")
    fn = g.seq("fn_", g.opt(e, g.star(",", e)), "->", body, g.star(g.plus("end"), e, g.star(",", e), "->", body), "stop") if style == "elixir" else g.seq("fn_", g.opt(g.ref("group")), g.alt(cur, blk))
    # the keys of a hash literal are no assignments
    pair = g.alt(g.seq(g.ref("K"), "=>", e), g.seq(g.alt("id", "s", "kw", "if", "cls", "const", "do_", "else_", "stop", "def", "lit"), ":", g.opt(e)), g.seq(g.alt("op", "pm"), e))
    hash_ = g.seq("{", g.star("end"), g.opt(pair, g.star(",", g.star("end"), g.opt(pair))), g.star("end"), "}")
    if style == "elixir":
        prim = [g.tok("id", "n", "lit", "atom", "const"), g.plus("s"), g.ref("group"), lst, g.seq(g.alt("%", g.seq("%", "const")), cur), cur, fn, g.seq("op", items, "op"), g.seq("@", "id")]
        ctl = g.seq(g.alt("if", "case"), e, g.star(",", item), "do_", g.ref("arms"), g.star("else_", g.ref("arms")), "stop")
        g.rule("arms", g.alt(body, g.seq(g.star("end"), g.plus(e, g.star(",", e), g.opt("when_", e), "->", body, g.star("end")))))
        prim.append(ctl)
    else:
        inner = g.seq(body, g.star(g.alt(g.seq("elsif", e, g.opt("then"), body), g.seq("else_", body), g.seq("when_", e, g.star(",", e), g.opt("then"), body), g.seq("rescue", g.opt(e, g.star(",", e)), g.opt("=>", "id"), body), g.seq("ensure", body))), "stop")
        prim = [g.tok("id", "n", "lit", "atom", "const"), g.plus("s"), g.ref("group"), lst, hash_, fn, g.seq("if", e, g.opt("then"), inner), g.seq("case", g.opt(e), inner), g.seq("while", e, g.opt("do_"), inner), g.seq("for", "id", "in", e, g.opt("do_"), inner), g.seq("begin", inner)]
    post = g.star(g.alt(g.seq(g.alt(".", "?.", "::"), g.star("end"), g.alt("id", "const", "kw", "cls", "if", g.ref("group"), g.seq("{", items, "}"))), g.ref("group"), lst, *([cur] if style == "ruby" else []), blk))
    unary = g.seq(g.star(g.alt("pm", "pre", "not", "amp", *(["pin"] if style == "elixir" else []))), g.alt(*prim), post)
    g.rule("K", g.seq(unary, g.star(g.alt("op", "pm", "..", "|"), unary)))
    g.rule("E", g.seq(unary, g.star(g.alt("op", "pm", "=", "asg", "bool", "..", "...", "=>", "<-", "->", "|", "in"), unary), g.opt("?", e, ":", e)))
    command = g.seq("id", g.opt("." , "id"), item, g.star(",", item), g.opt(blk))
    mod = g.star(g.alt("if", "while"), e) if style == "ruby" else g.seq()
    params = g.opt(g.ref("group"))
    name = g.seq(g.opt(g.alt("lit", "id"), "."), g.alt("id", "const", "op"), g.opt(g.alt("?", "pre", "=")))
    if style == "ruby":
        forms = [
            g.seq(e, g.star(",", e), g.opt("=", e, g.star(",", e)), mod), g.seq(command, mod), g.seq("ret", g.opt(e, g.star(",", e)), mod), g.seq("def", name, g.alt(params, g.seq("id", g.star(",", "id"))), inner), g.seq("def", name, params, "=", e),
            g.seq("cls", g.alt(g.seq("const", g.star("::", "const")), g.seq("op", "lit")), g.opt("op", e), inner), g.seq("kw", g.opt(item, g.star(",", item)), mod),
        ]
    else:
        when = g.opt("when_", e)
        dotted = g.seq("const", g.star(".", "const"))
        forms = [
            e, command, g.seq("def", g.alt("id", "const", g.seq("id", "id")), g.opt(g.alt("?", "pre")), params, when, g.alt(g.seq("do_", body, g.star(g.alt("rescue", "else_"), g.ref("arms")), "stop"), g.seq(",", "do_", ":", e), g.seq())),
            g.seq("cls", dotted, g.opt(",", item), "do_", body, "stop"), g.seq("imp", e, g.star(",", item)), g.seq("@", "id", g.opt(g.alt(item, command), g.star(",", item)), g.star(g.alt("::", "op", "|", "->"), e)),
        ]
    end = g.plus(g.alt("end", ";"))
    stmt = g.alt(*forms)
    g.rule("body", g.seq(g.star(g.alt("end", ";")), g.opt(stmt, g.star(end, stmt), g.star(g.alt("end", ";")))))
    g.rule("start", body)
    return g.close()


def shell_grammar() -> Grammar:
    g = Grammar()
    lst = g.ref("list")
    word = g.alt("w", "s", "=")
    redir = g.seq("redir", g.opt(g.alt(word, g.seq(g.opt("redir"), "(", g.star("end"), lst, ")"))))
    assign = g.seq("assign", g.opt(g.alt("w", "s", g.seq("(", g.star(g.alt("w", "s", "end", "assign")), ")"))))
    simple = g.alt(g.seq(g.plus(g.alt(assign)), g.star(g.alt(word, redir, assign))), g.seq(word, g.star(g.alt(word, redir, assign, "in", "{", "}", "pre"))))
    sep = g.plus(g.alt("end", ";", "&"))
    body = g.seq(g.star("end"), lst)
    g.rule("compound", g.alt(
        g.seq("if", body, "then", body, g.star("elif", body, "then", body), g.opt("else", body), "fi"), g.seq(g.alt("while"), body, "do", body, "done"), g.seq("for", "w", g.alt(g.seq(g.opt("in", g.star(word)), sep), g.seq()), "do", body, "done"), g.seq("for", "arith", g.star(g.alt("end", ";")), "do", body, "done"),
        g.seq("case", word, "in", g.star("end"), g.star(g.opt("("), word, g.star("pipe", word), ")", g.star("end"), g.opt(lst), g.opt(";;"), g.star("end")), "esac"), g.seq("{", body, "}"), g.seq("(", body, ")"), g.seq("w", "(", ")", g.star("end"), g.ref("compound")),
        g.seq("function", "w", g.opt("(", ")"), g.star("end"), g.ref("compound")), "arith", g.seq("test", g.star(redir)),
    ))
    cmd = g.seq(g.star("!"), g.alt(simple, g.seq(g.ref("compound"), g.star(redir)), redir))
    pipe = g.seq(cmd, g.star(g.alt("pipe", "andor"), g.star("end"), cmd))
    g.rule("list", g.seq(pipe, g.star(sep, pipe), g.opt(sep)))
    g.rule("start", g.seq(g.star("end"), g.opt(lst)))
    return g.close()


MODS = "public private protected static final abstract async export default native synchronized transient volatile strictfp"


@lru_cache(maxsize=None)
def languages() -> dict[str, tuple[Language, "Grammar", int]]:
    """(lexer, grammar, start) of each judged language."""
    js = words("const let var", "var") | words("function", "fun") | words("class", "cls") | words("if", "if") | words("else", "else_") | words("for", "for") | words("while", "while") | words("do", "do_") | words("return throw break continue debugger", "ret") | words("try", "try") | words("catch", "catch") | words("finally", "finally") | words("switch", "switch") | words("case", "case_") | words("import", "imp") | words("export", "export_") | words("from", "from_") | words("default", "default_") | words("new", "new") | words("typeof void delete await yield", "op_pre") | words("in", "in") | words("of", "of_") | words("instanceof", "op") | words("async static get set", "mod") | words("extends implements", "ext") | words("true false null undefined this super", "lit") | words("as", "as_")
    ts = js | words("interface enum namespace module", "cls") | words("type", "type_") | words("public private protected readonly abstract declare override", "mod") | words("keyof is satisfies infer asserts", "op_word")
    common = words("if", "if") | words("else", "else_") | words("for", "for") | words("while", "while") | words("do", "do_") | words("try", "try") | words("catch", "catch") | words("finally", "finally") | words("case", "case_") | words("switch", "switch") | words("new", "new") | words("return throw break continue", "ret") | words("true false null this super", "lit")
    java = common | words("record", "rec_") | words("class interface enum", "cls") | words(MODS + " sealed", "mod") | words("default", "default_") | words("extends implements throws permits", "ext") | words("import", "imp") | words("package", "pkg") | words("var", "var") | words("instanceof", "op") | words("synchronized", "lock_") | words("assert yield", "ret")
    csharp = common | words("class interface enum struct", "cls") | words("public private protected internal static readonly const abstract sealed virtual override async partial extern unsafe volatile params ref out required init file", "mod") | words("default", "default_") | words("using", "imp") | words("namespace", "pkg") | words("var", "var") | words("foreach", "foreach") | words("in", "in") | words("is as", "op") | words("where", "where") | words("get set add remove", "get_") | words("lock", "lock_") | words("await", "pre") | words("yield goto", "ret")
    c = {k: v for k, v in common.items() if k not in ("try", "catch", "finally", "new", "throw", "this", "super", "true", "false", "null")} | words("struct enum union", "cls") | words("static const extern inline volatile register unsigned signed restrict auto typedef", "mod") | words("default", "default_") | words("goto", "ret") | words("sizeof", "pre") | words("NULL", "lit")
    cpp = common | words("class struct enum union", "cls") | words("static const extern inline volatile register unsigned signed typedef virtual explicit friend constexpr mutable noexcept override final thread_local consteval", "mod") | words("public private protected", "acc") | words("auto", "var") | words("default", "default_") | words("goto co_return co_yield", "ret") | words("using", "imp") | words("namespace", "pkg") | words("template", "template_") | words("sizeof delete co_await typename", "pre") | words("nullptr", "lit")
    go = words("if", "if") | words("else", "else_") | words("for", "for") | words("switch select", "switch") | words("case", "case_") | words("default", "default_") | words("func", "fun") | words("struct interface", "cls") | words("type", "type_") | words("var", "var") | words("const", "const_") | words("package", "pkg") | words("import", "imp") | words("return break continue goto fallthrough", "ret") | words("range", "range_") | words("defer go", "defer_") | words("true false nil", "lit") | words("chan", "op_word")
    rust = words("if", "if") | words("else", "else_") | words("for", "for") | words("while", "while") | words("loop", "loop") | words("match", "switch") | words("fn", "fun") | words("struct enum trait impl mod union", "cls") | words("let", "var") | words("const static", "const_") | words("use", "imp") | words("return break continue", "ret") | words("pub mut ref async unsafe move extern dyn crate_", "mod") | words("in", "in") | words("as", "as_") | words("type", "type_") | words("where", "where") | words("true false self Self super crate", "lit")
    rust |= words("self Self super crate", "id")
    swift = common | words("class struct enum protocol extension actor", "cls") | words("func", "fun") | words("let var", "var") | words("import", "imp") | words("public private internal fileprivate open static final override mutating lazy weak async throws rethrows inout indirect convenience required nonisolated", "mod") | words("in", "in") | words("as is", "as_") | words("guard", "guard") | words("where", "where") | words("default", "default_") | words("nil self", "lit") | words("init deinit", "new") | words("get set willSet didSet", "get_") | words("try await", "pre") | words("repeat defer", "do_") | words("fallthrough", "ret")
    swift.pop("this"), swift.pop("null")
    kotlin = common | words("class interface object", "cls") | words("fun", "fun") | words("val var", "var") | words("import", "imp") | words("package", "pkg") | words("public private protected internal open abstract final override data sealed inner companion lateinit inline suspend operator infix tailrec enum annotation const vararg crossinline noinline reified external expect actual out", "mod") | words("in", "in") | words("as is", "as_") | words("when", "switch") | words("where", "where") | words("init constructor", "new") | words("get set", "get_") | words("by", "op_word")
    kotlin.pop("new"), kotlin.pop("switch"), kotlin.pop("case")
    scala = common | words("class trait object", "cls") | words("def", "fun") | words("val var type given", "var") | words("import", "imp") | words("package", "pkg") | words("public private protected abstract final override implicit lazy sealed case inline", "mod") | words("extends with", "ext") | words("match", "op_word") | words("yield", "yield_")
    scala.pop("case", None), scala.pop("switch")
    scala |= {"case": "mod"}
    dart = common | words("class mixin extension enum", "cls") | words("static abstract external covariant required async factory operator", "mod") | words("final const var late", "var") | words("default", "default_") | words("import export part library", "imp") | words("extends implements with on", "ext") | words("in", "in") | words("as is", "as_") | words("show hide", "mod") | words("await", "pre") | words("yield rethrow assert", "ret") | words("get set", "get_")
    php = common | words("class interface trait enum", "cls") | words("function fn", "fun") | words("public private protected static final abstract readonly global", "mod") | words("const", "const_") | words("default", "default_") | words("use require include require_once include_once", "imp") | words("namespace", "pkg") | words("foreach", "foreach") | words("as", "as_") | words("extends implements insteadof", "ext") | words("echo print", "ret") | words("instanceof and or xor", "op") | words("<?php", "open_tag") | words("?>", "close_tag") | words("clone", "pre") | words("match", "switch")
    php |= words("const", "var")
    lua = {w: w for w in "if then else elseif for while do repeat until function local return break goto in not".split()} | words("end", "stop") | words("and or", "bool") | words("nil true false", "lit")
    ruby = words("if unless", "if") | words("elsif", "elsif") | words("else", "else_") | words("end", "stop") | words("do", "do_") | words("while until", "while") | words("for", "for") | words("in", "in") | words("case", "case") | words("when", "when_") | words("then", "then") | words("def", "def") | words("class module", "cls") | words("begin", "begin") | words("rescue", "rescue") | words("ensure", "ensure") | words("return break next redo retry raise", "ret") | words("and or", "bool") | words("not defined?", "not") | words("nil true false self super __FILE__", "lit") | words("yield puts require require_relative attr_reader attr_writer attr_accessor private public protected include extend raise alias undef", "kw") | {"->": "fn_", "&": "pm", "&.": "?.", "|": "|", "<<": "op"}
    elixir = words("if unless", "if") | words("case cond with for receive try quote", "case") | words("else", "else_") | words("end", "stop") | words("do", "do_") | words("fn", "fn_") | words("def defp defmacro defmacrop defguard", "def") | words("defmodule defprotocol defimpl", "cls") | words("when", "when_") | words("rescue catch after", "rescue") | words("and or in", "op") | words("not", "not") | words("nil true false __MODULE__", "lit") | words("import alias use require", "imp") | {"&": "amp", "^": "pin", "|": "|", "<-": "<-", "<<": "op", ">>": "op"}
    c_comments = [SLASHES, BLOCK]
    raw = r'[rb]{1,2}#*"[\s\S]*?"#*|b?"(?:[^"\\]|\\[\s\S])*"'
    include = r"#\s*include\s*(?:<[^>\n]+>|\"[^\"\n]+\")"
    directive = r"#\s*(?:define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|warning|line)\b(?:[^\n\\]|\\[\s\S])*"
    L = Language
    defs = {
        "javascript": Script("javascript", c_comments, [DQ, SQ, BQ], js, lines=True, generic=False, idents=r"#?[^\W\d][\w$]*|\$[\w$]*", extra=[r"\A#![^\n]*"], unlexed="// <> :: -> =~ !~ := .= <- |> ||| &&& ~> .. ..< ..= //= !! ?: <<~"),
        "typescript": Script("typescript", c_comments, [DQ, SQ, BQ], ts, lines=True, idents=r"#?[^\W\d][\w$]*|\$[\w$]*", extra=[r"\A#![^\n]*"], unlexed="// <> :: -> =~ !~ := .= <- |> ||| &&& ~> .. ..< ..= //= !! ?: <<~"),
        "java": L("java", c_comments, [TRIPLE, DQ, CHAR], java, unlexed="// <> === !== ?. ?? => := =~ !~ .. ..< ..= ** **= //= !! ?: <<~ ??= <- |>"),
        "csharp": L("csharp", [*c_comments, r"(?m:^[ \t]*#[ \t]*(?:if|else|elif|endif|define|undef|region|endregion|pragma|nullable|warning|error|line)\b[^\n]*)"], [TRIPLE, r'[$@]{1,2}"(?:[^"\\]|\\.|"")*"', DQ, CHAR], csharp, unlexed="// <> === !== := =~ !~ ** **= //= !! ?: <<~ <- |> ..< ..="),
        "c": L("c", c_comments, [r'(?:u8|[uUL])?' + DQ, CHAR], c, generic=False, extra=[include, directive], unlexed="// <> === !== ?. ?? => := =~ !~ .. ..< ..= ** **= //= !! ?: <<~ ??= <- |> :: >>>"),
        "cpp": L("cpp", c_comments, [r'R"\((?:[\s\S]*?)\)"', r'(?:u8|[uUL])?' + DQ, CHAR], cpp, extra=[include, directive], unlexed="// <> === !== ?. ?? => := =~ !~ .. ..< ..= ** **= //= !! ?: <<~ ??= <- |> >>>"),
        "go": L("go", c_comments, [DQ, r"`[^`]*`", CHAR], go, lines=True, generic=False, unlexed="// <> === !== ?. ?? => -> =~ !~ .. ..< ..= ** **= //= !! ?: <<~ ??= |> :: >>>"),
        "rust": L("rust", c_comments, [raw, CHAR], rust, extra=[r"'[a-z_]\w*(?!')", r"(?<=\w)<[^<>;{}=]*\b(?:dyn |impl |Fn(?:Mut|Once)?\b)(?:->|[^<>;{}]|<[^<>;{}]*>)*>"], unlexed="// <> === !== ?. ?? := =~ !~ ** **= //= !! ?: <<~ ??= <- |> >>> ++ --"),
        "swift": L("swift", c_comments, [TRIPLE, DQ], swift, lines=True, ops="??", unlexed="// <> := =~ !~ ** **= //= !! ?: <<~ <- |> >>> ++ -- => ::"),
        "kotlin": L("kotlin", c_comments, [TRIPLE, DQ, CHAR], kotlin, lines=True, unlexed="// <> := =~ !~ ** **= //= <<~ <- |> >>> => ??"),
        "scala": L("scala", c_comments, [r'[a-z]{0,3}"""[\s\S]*?"""', r'[sfr]?' + DQ, CHAR], scala, lines=True, generic=False, unlexed="// <> =~ !~ ** **= //= <<~ ?. ?? ++ -- := >>>"),
        "dart": L("dart", c_comments, [TRIPLE, r"r?'''[\s\S]*?'''", "r?" + DQ, "r?" + SQ], dart, unlexed="// <> === !== := =~ !~ ** **= //= !! ?: <<~ <- |> :: ->"),
        "php": L("php", [SLASHES, BLOCK, r"#(?!\[)[^\n]*"], [r'"(?:[^"\\]|\\[\s\S])*"', r"'(?:[^'\\]|\\[\s\S])*'"], php, generic=False, idents=r"\$?[^\W\d]\w*|\$\$\w+", extra=[r"<\?php\b", r"<\?=", r"\?>"], unlexed="// := =~ !~ //= !! <<~ <- |> .. ..< ..="),
        "lua": L("lua", [DASHES], [DQ, SQ, r"\[\[[\s\S]*?\]\]", r"\[=\[[\s\S]*?\]=\]"], lua, generic=False, ops="~=", extra=[r"\A#![^\n]*"], unlexed="// <> === !== != ?. ?? => := =~ !~ ** && || ! ++ -- <<~ <=> |> <- ||| &&&"),
        "ruby": L("ruby", [HASH, r"(?m:^=begin[\s\S]*?^=end)"], [DQ, SQ, BQ, r"%[wiqQ][\[({][^\])}]*[\])}]", r"(?<=[=(,~ ])/(?![\s=])(?:[^/\\\n]|\\.)+/[imxo]*(?=[\s,).])"], ruby, lines=True, generic=False, extra=[r"\A#![^\n]*", r"(?<![:\w]):(?:\"[^\"\n]*\"|[A-Za-z_]\w*[?!=]?)"], idents=r"[^\W\d]\w*[?!]?(?![\w=])|[^\W\d]\w*|@@?\w+|\$\w+", ops="&.", unlexed="// := ?? //= ++ -- <- |> ~> ||| &&& !! ?: <<~ ..< ..= === >>>"),
        "elixir": L("elixir", [HASH], [TRIPLE, r"~[a-zA-Z](?:\"\"\"[\s\S]*?\"\"\"|\([^)]*\)|\[[^\]]*\]|\{[^}]*\}|/[^/]*/|\"[^\"]*\")\w*", DQ, SQ], elixir, lines=True, generic=False, extra=[r"\A#![^\n]*", r"(?<![:\w]):(?:\"[^\"\n]*\"|[A-Za-z_]\w*[?!]?)"], idents=r"[^\W\d]\w*[?!]?(?![\w=])|[^\W\d]\w*", ops="|> <- <> ++", unlexed="// := ?? //= -- ~> !! ?: <<~ ..< ..= >>> ?. -= += *= /="),
    }
    out = {k: (v, (g := braces(k)), g.ref("start")) for k, v in defs.items() if k not in ("lua", "ruby", "elixir")}
    out["lua"] = (defs["lua"], (g := lua_grammar()), g.ref("start"))
    for k in ("ruby", "elixir"):
        out[k] = (defs[k], (g := ended(k)), g.ref("start"))
    out["python"] = (Python(), (g := python_grammar()), g.ref("start"))
    sh = Shell("shell", [], [], {})
    out["shell"] = (sh, (g := shell_grammar()), g.ref("start"))
    return out


class Shell(Language):
    """Words with their quotes and expansions are one token."""

    PIECE = r"\\[\s\S]|'[^']*'|\"(?:[^\"\\`$]|\\[\s\S]|\$\((?:[^()\"']|\"[^\"]*\"|'[^']*'|\((?:[^()]|\([^()]*\))*\))*\)|\$\{[^}]*\}|\$|`[^`]*`)*\"|\$\(\((?:[^()]|\([^()]*\))*\)\)|\$\((?:[^()\"']|\"(?:[^\"\\]|\\[\s\S])*\"|'[^']*'|\((?:[^()]|\([^()]*\))*\))*\)|\$\{[^}]*\}|`[^`]*`|[^\s;&|<>()\"'`\\$#{}]|\$[\w@*#?$!-]?|(?<=[^\s;&|<>()])#|\{[^\s{};]*\}|(?<=[\w$}=\"'])[{}]"

    def __init__(self, *a):
        super().__init__(*a)
        self.rx = re.compile(r"(?:[ \t\r]+|\\\n|(?<![^\s;&|()])#[^\n]*)*+(" + CONFLICT + r"|\(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\)|\[\[(?=\s)[^\n]*?\s\]\]|\n+|;;|&&|\|\||\d*(?:>>|<<<|<<-?|>&|<&|>\||<|>)&?|&>|[;&|()]|[{}](?=[\s;]|$)|(?:" + self.PIECE + r")+|\S|\Z)")
        self.keywords = {w: w for w in "if then elif else fi for in do done case esac function { } !".split()} | {"while": "while", "until": "while"}
        self.assign = re.compile(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=")

    def _kind(self, t: str) -> str:
        if t in self.keywords:
            return self.keywords[t]
        if re.fullmatch(CONFLICT, t):
            return "bad"
        if t[0] == "\n":
            return "end"
        if t in ("&&", "||"):
            return "andor"
        if t == "|":
            return "pipe"
        if t in (";", ";;", "&", "(", ")"):
            return t
        if t.startswith("(("):
            return "arith"
        if t.startswith("[["):
            return "test"
        if re.fullmatch(r"\d*(?:>>|<<<|<<-?|>&|<&|>\||<|>)&?|&>", t):
            return "redir"
        if t in ("\"", "'", "`", "$("):
            return "bad"
        if self.assign.match(t):
            return "assign_full" if not t.endswith("=") else "assign"
        return "w"

    HERE = re.compile(r"<<-?\s*(['\"\\]?)(\w+)\1?([^\n]*)\n(?:[\s\S]*?\n)??[ \t]*\2(?=\n|$)")

    def prepare(self, text: str) -> str:
        """Documents in place count as blanks, their last line's end as that of the command."""
        return self.HERE.sub(lambda m: " " * (m.start(3) - m.start()) + m[3] + " " * (m.end() - m.end(3)), text.replace("\r\n", " \n"))

    def lex(self, text: str) -> tuple[list[str], list[int]]:
        out, at = [], []
        raw = [self.kind(t) for t in self.tokens(text)]
        first = True
        plain = set(self.keywords.values())
        for i, k in enumerate(raw):
            if k == "assign_full":
                new = ["assign", "w"] if first or out and out[-1] in ("assign", "w") else ["w"]
                out += new
                at += [i] * len(new)
                first = False
                continue
            # a reserved word counts only where a command may begin
            if k in plain and not first and not (k == "in" and len(out) >= 2) and k not in ("do", "{", "}"):
                k = "w"
            out.append(k)
            at.append(i)
            first = k in ("end", ";", "&", "andor", "pipe", "(", ")", "then", "else", "elif", "do", "{", "if", "while", "!", ";;", "fi", "done", "}")
        return out, at


def judge(language: str, text: str) -> tuple[str, int, int]:
    """("", -1, -1) for a text that its language's grammar accepts, else ("wrong", number of the token, its offset) or ("cut", number of tokens, length of the text)."""
    lang, g, start = languages()[language]
    body = text.removeprefix("﻿")
    kinds, places = lang.lex(body)
    at = g.parse(start, kinds)
    if at < 0:
        return "", -1, -1
    if at == len(kinds) or kinds[at] == "unended":
        return "cut", at, len(text)
    found = lang.scan(body)
    place = found[places[at]][0] if places[at] < len(found) else len(body)
    return "wrong", at, min(place, len(body)) + len(text) - len(body)


def check(language: str, text: str) -> tuple[str, int]:
    """("", -1) for a text that its language's grammar accepts, else ("wrong", number of the token) or ("cut", number of tokens)."""
    return judge(language, text)[:2]
