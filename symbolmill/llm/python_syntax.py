"""Lexer and grammar of Python 3: every statement and expression form, what may be assigned to, and the order of arguments and parameters."""

import re

from symbolmill.llm.derive import Grammar

WORDS = "if elif else for while try except finally with def class async await lambda return raise pass del assert import from as in is not yield and or".split()
SAME = {w: w for w in WORDS} | dict.fromkeys("break continue".split(), "jump") | dict.fromkeys("global nonlocal".split(), "scope") | dict.fromkeys("True False None".split(), "lit")
SAME |= {w: w for w in "match case type".split()}  # names but where a statement begins
SIGNS = {s: s for s in "( ) [ ] { } , : ; . = := -> ... @ * ** / ~ |".split()} | dict.fromkeys("+ -".split(), "pm") | dict.fromkeys("// % << >> & ^".split(), "bin") | dict.fromkeys("< > <= >= == !=".split(), "cmp")
SIGNS |= dict.fromkeys("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split(), "asg")
NAMES = ("id", "match", "case", "type")
INNER = r"(?:[^{{}}{q}\n\\]|\\[\s\S]|\{{(?:[^{{}}\n]|\{{[^{{}}\n]*\}})*\}}|\{{\{{|\}}\}})*"
TEXT = (
    r"[bBuUrRfF]{0,2}\"{3}(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*+(?:\"{3}|\Z)|[bBuUrRfF]{0,2}'{3}(?:[^\\']|\\[\s\S]|'(?!''))*+(?:'{3}|\Z)"
    + "|".join(["", *(rf"[rR]?[fF][rR]?{q}{INNER.format(q=q)}{q}" for q in "\"'")])
    + r"|[bBuUrRfF]{0,2}\"(?:[^\"\\\n]|\\[\s\S])*\"|[bBuUrRfF]{0,2}'(?:[^'\\\n]|\\[\s\S])*'"
)
NUMBER = r"(?:0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?![\w])|(?:0[xXoObB][\da-fA-F_]+|\d[\d_]*\.?)(?=(?:if|else|and|or|in|is|for|not)\b)"
TOKEN = re.compile(r"(?:[ \t\f]+|\\\n|#[^\n]*)*+(\n[ \t\f]*+(?:#[^\n]*)?|" + TEXT + "|" + NUMBER + r"|[^\W\d]\w*|\*\*=|//=|>>=|<<=|\.\.\.|:=|->|\*\*|//|<<|>>|<=|>=|==|!=|[-+*/%@&|^]=|\S|\Z)")
IDENT = re.compile(r"[^\W\d]\w*")


def _plain(text: str) -> str:
    """A line end and the text, with one character for each line end but for a blank before those of two."""
    return "\n" + text.replace("\r\n", " \n").replace("\r", "\n")


class Python:
    """Lines and indents become tokens. A text that ends inside brackets has no last line end, so that what follows is missing."""

    def __init__(self) -> None:
        self.known: dict[str, str] = {}

    def kind(self, t: str) -> str:
        k = self.known.get(t)
        if k is None:
            if len(self.known) > 300_000:
                self.known.clear()
            k = self.known[t] = self._kind(t)
        return k

    def _kind(self, t: str) -> str:
        if t in SAME:
            return SAME[t]
        if t in SIGNS:
            return SIGNS[t]
        if len(t) > 1 and re.search("[\"']", t):
            q = t.lstrip("bBuUrRfF")
            return "unended" if q[:3] in ('"""', "'''") and (len(q) < 6 or q[-3:] != q[:3]) else "s"
        if IDENT.fullmatch(t):
            return "id"
        return "n" if t[0].isdigit() or t[0] == "." and len(t) > 1 else t

    def scan(self, text: str) -> list[tuple[int, str]]:
        """(offset, token) of every token; the first is a line end in front of the text."""
        return [(max(m.start(1) - 1, 0), m[1]) for m in TOKEN.finditer(_plain(text))]

    def lex(self, text: str) -> tuple[list[str], list[int]]:
        """Kinds, and of each the number of the token of ``scan`` that it comes from."""
        toks = TOKEN.findall(_plain(text))
        out, at, stack, depth, known = [], [], [(0, 0)], 0, self.known
        n = len(toks)
        while n and not toks[n - 1]:
            n -= 1
        for i in range(n):
            t = toks[i]
            if t[0] == "\n":
                if depth or t[-1] != "\n" and "#" in t or i + 1 < n and toks[i + 1][0] == "\n":
                    continue
                if out and out[-1] not in ("NL", "IN", "DE"):
                    out.append("NL")
                    at.append(i)
                if i + 1 == n:
                    continue
                blanks = t.rsplit("\f", 1)[-1].lstrip("\n")
                indent = len(blanks.expandtabs()), len(blanks.expandtabs(1))
                if indent[0] > stack[-1][0]:
                    out.append("IN" if indent[1] > stack[-1][1] else "bad")
                    stack.append(indent)
                    at.append(i)
                while indent[0] < stack[-1][0]:
                    stack.pop()
                    out.append("DE" if indent[0] <= stack[-1][0] else "bad")
                    at.append(i)
                if indent[0] == stack[-1][0] and indent[1] != stack[-1][1]:  # tabs and blanks in a mixture that tab sizes decide
                    out.append("bad")
                    at.append(i)
                continue
            k = known.get(t) or self.kind(t)
            if k in ("(", "[", "{"):
                depth += 1
            elif k in (")", "]", "}"):
                depth = max(0, depth - 1)
            out.append(k)
            at.append(i)
        if depth or out and out[-1] == "unended":
            return out, at
        if out and out[-1] not in ("NL", "DE", "IN"):
            out.append("NL")
            at.append(n)
        closing = len(stack) - 1
        return out + ["DE"] * closing, at + [n] * closing


def listed(g: Grammar, item: int) -> int:
    """One or more items between commas, the last of which may be followed by one."""
    return g.seq(item, g.star(",", item), g.opt(","))


def python_grammar() -> Grammar:
    g = Grammar()
    e, d, stmt, suite, stars = (g.ref(x) for x in ("E", "D", "stmt", "suite", "stars"))
    name = g.alt(*NAMES)
    named = g.alt(g.seq(name, ":=", e), e)
    # comprehensions, arguments and subscripts
    comp = g.rule("comp", g.plus(g.opt("async"), "for", g.ref("targets"), "in", d, g.star("if", g.alt(d, g.ref("lambda")))))
    keyword, unpack = g.seq(name, "=", e), g.seq("**", e)
    g.rule("args0", g.opt(g.alt(g.seq(g.alt(named, g.seq("*", e)), g.opt(",", g.ref("args0"))), g.seq(keyword, g.opt(",", g.ref("args1"))), g.seq(unpack, g.opt(",", g.ref("args2"))))))
    g.rule("args1", g.opt(g.alt(g.seq(g.alt(keyword, g.seq("*", e)), g.opt(",", g.ref("args1"))), g.seq(unpack, g.opt(",", g.ref("args2"))))))
    g.rule("args2", g.opt(g.alt(keyword, unpack), g.opt(",", g.ref("args2"))))
    call = g.rule("call", g.seq("(", g.alt(g.seq(named, comp), g.ref("args0")), ")"))
    part = g.alt(g.seq(g.opt(e), ":", g.opt(e), g.opt(":", g.opt(e))), named, g.seq("*", e))
    index = g.rule("index", g.seq("[", listed(g, part), "]"))
    # atoms
    item = g.alt(named, g.seq("*", g.ref("A")))
    yields = g.seq("yield", g.opt(g.alt(g.seq("from", e), stars)))
    group = g.rule("group", g.seq("(", g.alt(g.seq(), yields, listed(g, item), g.seq(named, comp)), ")"))
    array = g.rule("array", g.seq("[", g.alt(g.seq(), listed(g, item), g.seq(named, comp)), "]"))
    pair = g.alt(g.seq(e, ":", e), g.seq("**", g.ref("A")))
    curly = g.rule("curly", g.seq("{", g.alt(g.seq(), listed(g, pair), g.seq(e, ":", e, comp), listed(g, item), g.seq(named, comp)), "}"))
    atom = g.alt(name, "n", g.plus("s"), "lit", "...", group, array, curly)
    post = g.alt(g.seq(".", name), call, index)
    # operators
    primary = g.seq(g.opt("await"), atom, g.star(post))
    unary = g.seq(g.star(g.alt("pm", "~")), primary)
    g.rule("A", g.seq(unary, g.star(g.alt("pm", "bin", "*", "/", "@", "**", "|"), unary)))
    compare = g.alt("cmp", "in", g.seq("not", "in"), g.seq("is", g.opt("not")))
    inverse = g.seq(g.star("not"), g.ref("A"), g.star(compare, g.ref("A")))
    g.rule("D", g.seq(inverse, g.star(g.alt("and", "or"), inverse)))
    g.rule("E", g.alt(g.seq(d, g.opt("if", d, "else", e)), g.ref("lambda")))
    g.rule("stars", listed(g, g.alt(e, g.seq("*", g.ref("A")))))
    # parameters: those without a default first; after a star any order
    for kind, noted in (("p", g.opt(":", e)), ("l", g.seq())):
        one, default = g.seq(name, noted), g.seq("=", e)
        last = g.seq("**", name, noted, g.opt(","))
        g.rule(kind + "k", g.opt(g.alt(last, g.seq(one, g.opt(default), g.opt(",", g.ref(kind + "k"))))))
        any_note = g.opt(":", g.opt("*"), e) if kind == "p" else g.seq()
        star = g.alt(g.seq("*", name, any_note, g.opt(",", g.ref(kind + "k"))), g.seq("*", ",", one, g.opt(default), g.opt(",", g.ref(kind + "k"))), last)
        g.rule(kind + "1", g.opt(g.alt(star, g.seq("/", g.opt(",", g.ref(kind + "1"))), g.seq(one, default, g.opt(",", g.ref(kind + "1"))))))
        g.rule(kind + "0", g.opt(g.alt(star, g.seq(one, default, g.opt(",", g.ref(kind + "1"))), g.seq(one, g.opt(",", g.alt(g.ref(kind + "0"), g.seq("/", g.opt(",", g.ref(kind + "0")))))))))
    g.rule("lambda", g.seq("lambda", g.ref("l0"), ":", e))
    # what may be assigned to
    place = g.seq(g.opt("await"), atom, g.star(post), g.alt(g.seq(".", name), index))
    target = g.rule("target", g.alt(name, place, g.seq("(", g.opt(g.ref("targets")), ")"), g.seq("[", g.opt(g.ref("targets")), "]")))
    g.rule("targets", listed(g, g.seq(g.opt("*"), target)))
    single = g.alt(name, place, g.seq("(", g.ref("target"), ")"))
    value = g.alt(yields, stars)
    # statements
    dotted = g.seq(name, g.star(".", name))
    alias = g.seq(dotted, g.opt("as", name))
    short = g.seq(name, g.opt("as", name))
    source = g.alt(g.seq(g.star(g.alt(".", "...")), dotted), g.plus(g.alt(".", "...")))
    type_names = g.opt("[", listed(g, g.seq(g.opt(g.alt("*", "**")), name, g.opt(":", e), g.opt("=", g.opt("*"), e))), "]")
    simple = g.alt(
        stars, g.seq(g.plus(g.ref("targets"), "="), value), g.seq(single, ":", e, g.opt("=", value)), g.seq(single, "asg", value), yields,
        g.seq("return", g.opt(stars)), g.seq("raise", g.opt(e, g.opt("from", e))), "pass", "jump", g.seq("del", g.ref("targets")), g.seq("assert", e, g.opt(",", e)), g.seq("scope", name, g.star(",", name)),
        g.seq("import", alias, g.star(",", alias)), g.seq("from", source, "import", g.alt("*", g.seq(short, g.star(",", short)), g.seq("(", listed(g, short), ")"))), g.seq("type", name, type_names, "=", e),
    )
    line = g.seq(simple, g.star(";", simple), g.opt(";"), "NL")
    g.rule("suite", g.alt(line, g.seq("NL", "IN", g.plus(stmt), "DE")))
    define = g.seq(g.opt("async"), "def", name, type_names, "(", g.ref("p0"), ")", g.opt("->", e), ":", suite)
    klass = g.seq("class", name, type_names, g.opt(call), ":", suite)
    other = g.opt("else", ":", suite)
    opened = g.seq(e, g.opt("as", target))
    handler = g.alt(g.seq(g.plus("except", g.opt(e, g.opt("as", name)), ":", suite)), g.plus("except", "*", e, g.opt("as", name), ":", suite))
    # patterns
    pattern = g.ref("pattern")
    several = listed(g, g.seq(g.opt("*"), pattern))
    number = g.seq(g.opt("pm"), "n", g.opt("pm", "n"))
    key = g.alt(number, g.plus("s"), "lit", dotted)
    fields = g.opt(listed(g, g.seq(g.opt(name, "="), pattern)))
    closed = g.alt(number, g.plus("s"), "lit", g.seq(dotted, g.opt("(", fields, ")")), g.seq("(", g.opt(several), ")"), g.seq("[", g.opt(several), "]"), g.seq("{", g.opt(listed(g, g.alt(g.seq(key, ":", pattern), g.seq("**", name)))), "}"))
    g.rule("pattern", g.seq(closed, g.star("|", closed), g.opt("as", name)))
    cases = g.seq("match", g.alt(stars, g.seq(name, ":=", e)), ":", "NL", "IN", g.plus("case", several, g.opt("if", named), ":", suite), "DE")
    compound = g.alt(
        g.seq("if", named, ":", suite, g.star("elif", named, ":", suite), other), g.seq("while", named, ":", suite, other), g.seq(g.opt("async"), "for", g.ref("targets"), "in", stars, ":", suite, other),
        g.seq("try", ":", suite, g.alt(g.seq(handler, other, g.opt("finally", ":", suite)), g.seq("finally", ":", suite))),
        g.seq(g.opt("async"), "with", g.alt(g.seq(opened, g.star(",", opened)), g.seq("(", listed(g, opened), ")")), ":", suite), define, klass, g.seq(g.plus("@", named, "NL"), g.alt(define, klass)), cases,
    )
    g.rule("stmt", g.alt(compound, line))
    g.rule("start", g.star(g.alt(stmt, "NL")))
    return g.close()
