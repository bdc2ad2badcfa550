"""Literal credentials in source code and configuration: their lines, and texts with only the credential replaced.

A line that holds both a cue (a word such as password, a provider's prefix, an address with a user) and a token that could
be a secret is cut into lexical tokens. Each token gets features of its shape and of its context, a linear-chain conditional
random field labels the tokens begin, inner or other, and the Viterbi spans are the characters to replace. Literals joined
by an operator are one value. The field is fitted on composed lines, whose credentials are known by construction, and on lines of
a bounded sample of rows in which a rough rule sees no credential; no label of a credential comes from a rule.
"""

import base64
import random
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolmill.llm.crf import BEGIN, IN, OUT, train, viterbi

#: Most rows of each table whose lines serve to fit the field.
TRAIN_ROWS = 800
#: Most pieces of lines of the sample that serve to fit the field, pieces of equal features being one.
TRAIN_LINES = 4000
#: Tokens of a piece: longer lines serve to fit the field in pieces; lines are labelled whole.
LONGEST = 40
#: Words near which a secret may stand, lower case; in the languages of the corpus.
CUES = (
    "pass|pwd|pw|use |secret|token|key|cred|bearer|basic |auth|login|sig=|senha|clave|contras|kennwort|wachtwoord|parola|пароль|密码|口令|private|://|connect|open|bind|sign|"
    "sk_|rk_|pk_|akia|asia|ghp_|gho_|ghs_|ghu_|ghr_|github_pat|glpat|xox|npm_|pypi-|aiza|sg.|eyj|hf_|dop_v1|shpat|ya29"
).split("|")
PREFIX = re.compile(
    r"(?:[sr]k_(?:live|test)_[0-9A-Za-z]{10,}|(?:AKIA|ASIA)[0-9A-Z]{12,}|gh[pousr]_[0-9A-Za-z]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeoprs]-[\w-]{10,}|npm_[0-9A-Za-z]{20,}|pypi-[\w-]{20,}"
    r"|AIza[\w-]{20,}|SG\.[\w-]{10,}\.[\w-]{10,}|eyJ[\w-]{5,}\.eyJ[\w-]{5,}\.[\w-]{5,}|hf_[0-9A-Za-z]{20,}|dop_v1_[0-9a-f]{20,}|shpat_[0-9a-f]{20,}|ya29\.[\w-]{20,}|sk-[0-9A-Za-z-]{20,})$"
)
STRONG = set("password passwd passphrase passcode passwort pass pwd pw secret token apikey bearer credential credentials authorization auth contrasena contraseña senha clave kennwort wachtwoord parola passe motdepasse пароль 密码".split())
#: Of these, words for what people choose and remember.
PASSWORDS = set("password passwd passphrase passcode passwort pass pwd pw contrasena contraseña senha kennwort wachtwoord parola motdepasse passe пароль 密码".split())
#: Words that make a key of what stands before ``key``.
BEFORE_KEY = set("api access private secret encryption signing server login client service master auth account shared session webhook deploy license crypt cipher hmac jwt storage admin".split())
NOT_SECRET = set("id ids kind type label hint column columns name names field count limit index size len length path file prefix suffix public hash sum checksum integrity digest sha sha1 sha256 md5 rev revision commit etag uuid guid version pattern regex placeholder title text msg message row image pixel".split())
PLACEHOLDER = re.compile(
    r"x{4,}|\*{3,}|\.{3,}|^<.*>$|^%\(|%\(\w+\)s|^\$\{|^\{\{|^\$\(|^@\w+@$|replace|^your|change[-_ ]?me|redact|dummy|example|placeholder|^todo|insert[-_ ]|^enter[-_ ]|not[-_]a[-_]|[-_]here$|^fake|^sample|^none$|^null$|^undefined$|^test$", re.I
)
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
VARIABLE = re.compile(r"\$\{?[A-Za-z_]\w*\}?$")
VERSION = re.compile(r"v?\d+(?:\.\d+)*$")
HEX = re.compile(r"[0-9a-fA-F]{16,}$")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zà-ɏ]+|[а-яё]+|\d+|[㐀-鿿]+")
HOST = re.compile(r"(?:[\w-]+\.)+[a-z]{2,}(?::\d+)?(?:/\S*)?$")
PLAIN = re.compile(r"[A-Za-z_]+\d{0,4}$|[A-Za-z_]+(?:[./-][A-Za-z_]+)*$")
ASSIGNED = re.compile(r"(?:=|:|:=|=>|->|:&=|:\w*=|\*=|=\[|\[\]=|:\?=)?[\[\(]{0,2}")
POINTER = re.compile(r"[*&][A-Za-z_]\w*$")
LINE = re.compile(r"\r\n|\r|\n")
JOIN = re.compile(r"([\"'`])[ \t]*(?:(?:\+|\.\.?|<>|~)[ \t]*(?:\\?(?:\r\n?|\n)[ \t]*)?|\\?(?:\r\n?|\n)[ \t]*(?:(?:\+|\.\.?|<>)[ \t]*)?)\1")
CONTINUED = re.compile(r"[\"'`][ \t]*(?:\+|\.\.?|<>|~)?[ \t]*\\?[ \t]*(?:\r\n?|\n)[ \t]*(?:\+|\.\.?|<>)?[ \t]*[\"'`][^\r\n]*")
TOKEN = re.compile(r"[A-Za-z0-9+/]{7,}={1,2}(?=[\"'`\s]|$)|(?:[\w+/!$%^*~#.\-]|&(?!\w+=))+|\s+|.", re.S)
COMMENT = re.compile(r"\s*(?://|#|--|/?\*|;|<!--|%)")
CALL = re.compile(r"(?:log_?in|connect|auth|open|sign_?in|bind)\w*\s*\(", re.I)
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
PEM_BODY = re.compile(r"-----(?:\\r|\\n|\s|[\"'+.,\\])*[A-Za-z0-9+/=]{30,}")
PEM_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")


def secretish(t: str) -> bool:
    """Whether a token could be a secret at all: six characters, and digits, odd marks or a wild mix of cases beside letters."""
    if len(t) < 6 or not re.search(r"[A-Za-z]", t):
        return False
    if re.search(r"\d", t) or re.search(r"[!#$%^*~+]", t):
        return True
    return len(t) >= 12 and len(re.findall(r"[a-z][A-Z]", t)) >= 3 and not PLAIN.match(t) or len(t) >= 20 and len(re.findall(r"[A-Z][a-z]|[a-z][A-Z]", t)) >= 7


def shape(t: str) -> str:
    """The class of a token's shape."""
    if t.isspace():
        return "space"
    if len(t) == 1 and not t.isalnum():
        return t
    if t.startswith("-----BEGIN") or t == "-----BEGIN":
        return "pem"
    if PLACEHOLDER.search(t) or len(t) >= 6 and len(set(t)) <= 2:
        return "placeholder"
    if PREFIX.match(t):
        return "prefix"
    if VARIABLE.match(t):
        return "variable"
    if VERSION.match(t):
        return "number"
    if UUID.match(t):
        return "uuid"
    if HEX.match(t):
        return "hex"
    if HOST.match(t) and not re.search(r"[A-Z].*\d|\d.*[A-Z]", t):
        return "host"
    if PLAIN.match(t) and not re.search(r"\d", t):
        return "plain" if not secretish(t) else "mixed"
    if not secretish(t):
        return "other"
    if re.match(r"[a-z]+(?:[-_.][a-z]+)+[-_.]\d+$", t):
        return "words"
    if re.match(r"[a-z]+(?:_[a-z]+)+\d+$|\$?[a-z_]+\d{1,3}$", t):
        return "name"
    return "long" if len(t) >= 20 else "mixed"


def cue(name: str) -> str:
    """What a name says of the value beside it: P a password, S another secret, W the bare word key, N something else about one, 0 nothing."""
    words = [w.lower() for w in WORD.findall(name)]
    if any(w in NOT_SECRET for w in words[-2:]):
        return "N"
    if any(w in PASSWORDS and (w != "pw" or k == 0 or len(words[k - 1]) > 1) for k, w in list(enumerate(words))[-2:]) or name.lower() in PASSWORDS:
        return "P"
    if any(w in STRONG for w in words) or name.lower() in STRONG:
        return "S"
    if "key" in words or "sig" in words:
        k = words.index("key") if "key" in words else -1
        return "S" if k > 0 and words[k - 1] in BEFORE_KEY or len(words) == 1 and k == 0 else "W"
    return "0"


def lex(window: str) -> tuple[list[str], list[int], list[int]]:
    """Tokens of a window, with the offsets at which each begins and ends in it; joined literals count as one."""
    joined, offsets, at = [], [], 0
    for m in JOIN.finditer(window):
        joined.append(window[at : m.start()])
        offsets.extend(range(at, m.start()))
        at = m.end()
    joined.append(window[at:])
    offsets.extend(range(at, len(window)))
    text = "".join(joined)
    tokens, starts, ends = [], [], []
    for m in TOKEN.finditer(text):
        if m.group().isspace() and LINE.search(m.group()):
            break
        tokens.append(m.group())
        starts.append(offsets[m.start()])
        ends.append(offsets[m.end() - 1] + 1)
    return tokens, starts, ends


def attributes(tokens: list[str]) -> list[tuple[str, str, str, str]]:
    """(shape, cue, link, extent) of each token: how the line ties it to a name, and whether it is all of its literal."""
    line = "".join(tokens)
    comment, call = bool(COMMENT.match(line)), bool(CALL.search(line) and re.search(r"[\"'`](?:[\w-]+\.)+\w+[\"'`]", line))
    braced = re.search(r"[(){}]", line) is not None and not comment  # code, where a value without quotes is an expression
    out: list[tuple[str, str, str, str]] = []
    quote, quoted_from, parts, literals = "", 0, 0, 0
    name, between, last = "", "", "0"
    shapes = [shape(t[1:] if POINTER.match(t) else t) for t in tokens]
    for k, t in enumerate(tokens):
        if t in "\"'`" and len(t) == 1:
            if not quote:
                quote, quoted_from = t, k
                literals += 1
                out.append((t, last, "open", "-") if name and ASSIGNED.fullmatch(between) and between[:1] in ("=", ":", "-") else (t, "-", "-", "-"))
                continue
            if t == quote:
                quote = ""
            out.append((shapes[k], "-", "-", "-"))
            continue
        if t.isspace() or len(t) == 1 and not t.isalnum():
            if not t.isspace() and t not in "-_/":
                between += t
            out.append((shapes[k], "-", "-", "-"))
            continue
        before = tokens[:k]
        tail = "".join(before[-4:])
        nxt = tokens[k + 1] if k + 1 < len(tokens) else ""
        link = "none"
        if re.search(r"//[\w.-]*:$", tail) and nxt == "@":
            link = "user"
        elif re.search(r"\b[Bb]asic\s+$", tail):
            link = "basic"
        elif re.search(r"(?:\b[Bb]earer|[\"'`](?:Token|ApiKey|token))\s+$", tail):
            link = "bearer"
        elif quote and re.search(r"[Kk]ey|[Tt]oken|[Ss]ecret|[Pp]assword", "".join(before[-3:-2])) and re.search(r":\s+$", tail):
            link = "header"
        elif re.search(r"[?&]$", "".join(before[-3:-2]) or "") and tail.endswith("="):
            link = "query"
        elif call and quote and literals >= 3:
            link = "hostcall"
        elif comment and re.search(r"\s\w+:$", tail):
            link = "pair"
        elif comment:
            link = "comment" if len(between.strip("\"'`")) <= 2 else "comment-far"
        elif ASSIGNED.fullmatch(between) and between[:1] in ("=", ":", "-") and name:
            link = "assign"
        elif quote and re.search(r"@\w+\s+[\"'`]$", tail):
            link = "assign"
        elif "(" in between or "," in between:
            link = "call"
        extent = "-"
        if quote:
            end = next((j for j in range(k + 1, len(tokens)) if tokens[j] == quote), None)
            parts = sum(1 for j in range(quoted_from + 1, end if end is not None else len(tokens)) if tokens[j].isspace())
            extent = "many" if parts else "all" if quoted_from == k - 1 and end == k + 1 else "part"
        else:
            rest = "".join(tokens[k + 1 :]).strip()
            extent = "bare" if braced else "end" if not rest or rest in (",", ";") or rest.startswith(("#", "//", "*/", "-->")) else "bare"
        out.append((shapes[k], last, link, extent))
        # a name binds the value after it until another name takes over
        if shapes[k] in ("plain", "name", "other", "host", "words") or not secretish(t) or POINTER.match(t) or shapes[k] == "variable" and not quote:
            said = cue(t.lstrip("$*&"))
            if comment:
                last = said if said != "0" or last == "0" else last
            elif quote and extent != "all" and link not in ("query",):
                last = said if said in "SPW" and nxt in ("=", ":", "") else last
            else:
                last = said if not (re.fullmatch(r"string|str|String|char|static|std|const|let|var|val|final|u8|Option", t.lstrip("*&")) and last in "SPW" and between) else last
            name, between = t, ""
    several(tokens, out)
    return out


def several(tokens: list[str], attrs: list[tuple[str, str, str, str]]) -> None:
    """Give the tokens of a value that marks or blanks divide the link of its first, and extents head and inner: a quoted value of a secret's name, and a password in an address. A quoted value of a password's name gets them whatever its form."""
    k = 0
    while k < len(tokens):
        if tokens[k] == ":" and re.search(r"//[\w.-]*:$", "".join(tokens[max(k - 5, 0) : k + 1])):
            end = k + 1
            while end < len(tokens) and not tokens[end].isspace() and tokens[end] not in "\"'`" and "/" not in tokens[end]:
                end += 1
            ats = [j for j in range(k + 2, end) if tokens[j] == "@"]
            if ats and ats[-1] > k + 2 and ats[-1] + 1 < len(tokens) and re.match(r"\w", tokens[ats[-1] + 1]):
                _spread(tokens, attrs, k + 1, ats[-1], "S", "user")
                k = ats[-1]
        elif len(tokens[k]) == 1 and tokens[k] in "\"'`":
            end = next((j for j in range(k + 1, len(tokens)) if tokens[j] == tokens[k]), None)
            if end is None:
                break
            inside = attrs[k + 1 : end]
            first = next((a for a in inside if a[2] != "-"), None)
            value = "".join(tokens[k + 1 : end])
            said = attrs[k][1] if attrs[k][2] == "open" else first[1] if first and first[2] == "assign" else ""
            if said in ("S", "P") and not any(a[0] in ("prefix", "pem") or a[2] in ("user", "basic", "bearer", "header", "query") for a in inside):
                if end > k + 2 and not any(t.isspace() for t in tokens[k + 1 : end]) and divided(value):
                    _spread(tokens, attrs, k + 1, end, said, "assign")
                elif said == "P" and (kind := remembered(value)):
                    _spread(tokens, attrs, k + 1, end, "P", "assign", kind)
            if "".join(tokens[k + 1 : end]).find("://") < 0:  # an address is looked at for its password
                k = end
        k += 1


def _spread(tokens, attrs, a: int, b: int, said: str, link: str, kind: str = "") -> None:
    for j in range(a, b):
        attrs[j] = (kind or attrs[j][0], said, link, "head" if j == a else "inner")


def remembered(value: str) -> str:
    """The form of a value that people choose: one word, or a phrase of several; nothing for settings, messages about secrets and placeholders."""
    words = [w.lower() for w in WORD.findall(value)]
    if PLACEHOLDER.search(value) or len(value) < 6 or any(w in STRONG or w in NOT_SECRET or w == "key" for w in words) or not re.search(r"[^\W\d_]", value):
        return ""
    if re.fullmatch(r"[^\W_]+", value):
        return "word"
    return "phrase" if re.fullmatch(r"[^\W_]{2,}(?: [^\W_]+){2,}", value) else ""


def divided(value: str) -> bool:
    """Whether a quoted value with marks in it could be a secret: no address, call, list or setting, whose parts are words and numbers."""
    return secretish(value) and not PLACEHOLDER.search(value) and "://" not in value and not re.fullmatch(
        r"[\w.+-]+@(?:[\w-]+\.)+[a-z]{2,}|[\w.:]+\(.*\)|[\[({<].*[\])}>]|\$?(?:[A-Za-z_]+\d{0,4}|\d+)(?:[:=,./;&|-]+(?:[A-Za-z_]+\d{0,4}|\d+))*[:=,./;&|-]*|[?&/.].*|.*[=:]", value
    )


def chain(tokens: list[str]) -> list[int]:
    """The tokens that the field labels: all but blanks."""
    return [k for k, t in enumerate(tokens) if not t.isspace()]


def features(tokens: list[str], attrs: list[tuple[str, str, str, str]]) -> list[list[str]]:
    """Feature names of each token of the chain."""
    rows, solid = [], chain(tokens)
    for j, k in enumerate(solid):
        s, c, link, extent = attrs[k]
        if link == "open":  # of use for the literal behind the quote alone
            c = link = "-"
        before = attrs[solid[j - 1]][0] if j else "^"
        after = attrs[solid[j + 1]][0] if j + 1 < len(solid) else "$"
        rows.append([f"s={s}", f"l={link}", f"sc={s},{c}", f"sl={s},{link}", f"cl={c},{link}", f"scl={s},{c},{link}", f"scle={s},{c},{link},{extent}", f"sle={s},{link},{extent}", f"b={before}", f"a={after}", f"n={min(len(tokens[k]), 24) // 4},{link}"])
    return rows


SECRET_SHAPES = {"prefix", "hex", "mixed", "long", "words", "name", "host", "other"}


def seed(tokens: list[str], attrs: list[tuple[str, str, str, str]]) -> list[int]:
    """Labels by rough rule: where it sees a credential, a line of the sample is no use as a line without one."""
    out = []
    for t, (s, c, link, extent) in zip(tokens, attrs):
        hit = (s == "prefix" or s == "pem") and extent != "inner"
        if extent not in ("head", "inner") and s in SECRET_SHAPES and link != "-" and not hit:
            wild = s in ("hex", "mixed", "long", "words")
            hit = (
                link == "user"
                or link in ("basic", "bearer", "header") and len(t) >= 8 and s not in ("host", "name")
                or link == "query" and c in "SPW" and wild
                or link == "hostcall" and wild and extent == "all"
                or link == "comment" and c in "SPW" and wild
                or link == "pair" and wild and len(t) >= 8
                or link == "assign" and c in "SP" and (wild or s == "name" and t[0].isupper()) and extent in ("all", "end")
            )
        out.append(BEGIN if hit or extent == "head" else IN if extent == "inner" else OUT)
    return out


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in CUES:
        a.add_word(w, w)
    a.make_automaton()
    return a


POSSIBLE = re.compile(r"(?=[^\s\"'`,;()\[\]{}<>]{6})[^\s\"'`,;()\[\]{}<>]*(?:\d|[!#$%^*~+]|[a-z][A-Z])|BEGIN|[\"'`](?=[^\s\"'`]{6})[^\s\"'`]*\d|(?i:pass|pwd|pw|contra|senha|kennwort|wachtwoord|parola|пароль|密码)[^\"'`\n]{0,60}[\"'`][^\"'`\n]{6}")


def windows(text: str, automaton: ahocorasick.Automaton) -> Iterator[tuple[int, int, str]]:
    """(line, offset, window) of each line that holds a cue and a possible secret; a window runs on over joined literals."""
    last, count, counted = -1, 1, 0
    simple = "\r" not in text
    for end, _ in automaton.iter(text.lower()) if len(text.lower()) == len(text) else automaton.iter("".join(c.lower() if len(c.lower()) == 1 else c for c in text)):
        if end < last:
            continue
        start = max(text.rfind("\n", 0, end), text.rfind("\r", 0, end) if not simple else -1) + 1
        stop = text.find("\n", end)
        stop = len(text) if stop < 0 else stop
        if not simple:
            other = text.find("\r", end, stop)
            stop = other if other >= 0 else stop
        last = stop
        whole = stop
        while True:  # literals joined over line ends
            k = whole
            while k > start and text[k - 1] in " \t+.<>~\\":
                k -= 1
            m = CONTINUED.match(text, k - 1) if k > start and text[k - 1] in "\"'`" else None
            if not m or m.end() <= whole:
                break
            whole = m.end()
        if not POSSIBLE.search(JOIN.sub("", text[start:whole]) if whole > stop else text[start:whole]):
            continue
        count += text.count("\n", counted, start) if simple else len(LINE.findall(text, counted, start))
        counted = start
        yield count, start, text[start:whole]


def spans(model: dict, text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(line, from, to) of each credential of a text: the first line of each, and the characters to replace."""
    found, until = [], -1
    for line, at, window in windows(text, automaton):
        if at < until:
            continue
        pem = PEM.search(window)
        tokens, starts, ends = lex(window)
        attrs = attributes(tokens)
        if not any(s in SECRET_SHAPES and link != "-" and (secretish(t) or link == "user") or s in ("pem", "prefix") or extent == "head" for t, (s, _, link, extent) in zip(tokens, attrs)):
            continue
        labels = [OUT] * len(tokens)
        for k, y in zip(chain(tokens), viterbi(model, features(tokens, attrs))):
            labels[k] = y
        for k in range(1, len(tokens) - 1):  # blanks between the words of a phrase
            if tokens[k].isspace() and attrs[k][3] == "inner" and labels[k - 1] != OUT and labels[k + 1] == IN:
                labels[k] = IN
        k = 0
        while k < len(labels):
            if labels[k] != BEGIN:
                k += 1
                continue
            j = k + 1
            while j < len(labels) and labels[j] == IN:
                j += 1
            a, b = at + starts[k], at + ends[j - 1]
            if a < until:  # inside a key block
                k = j
                continue
            if attrs[k][0] == "pem":
                if pem and PEM_BODY.match(text, at + pem.end() - 5):
                    stop = PEM_END.search(text, b)
                    b = stop.end() if stop else b
                    until = b
                    found.append((line, at + pem.start(), b))
            elif attrs[k][0] != "prefix" and (attrs[k][2:] == ("assign", "bare") or attrs[k][3] in ("bare", "end") and attrs[k][2] not in ("user", "comment", "pair") and re.search(r"[;|&{}()]", "".join(tokens[k:j]))):
                pass  # an operand of an expression
            elif (secretish(value := "".join(tokens[k:j])) or attrs[k][2] == "user" or attrs[k][0] in ("word", "phrase")) and not PLACEHOLDER.search(value):
                found.append((line, a, b))
                until = max(until, b)
            k = j
    return found


ENDINGS = ["com", "org", "net", "io", "dev", "internal", "local", "example"]


def composed(n: int = 1400, seed_: int = 41) -> list[tuple[str, str]]:
    """(line, credential or nothing) put together from the forms in which credentials and their look-alikes are written."""
    r = random.Random(seed_)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def word() -> str:
        return r.choice("amber basin cedar delta ember fjord grove haven inlet jolly kayak lumen maple nectar onyx prairie quartz ridge summit thicket".split())

    def rand(k: int, chars: str = letters) -> str:
        return "".join(r.choice(chars) for _ in range(k))

    def host() -> str:
        return f"{word()}.{word()}.{r.choice(ENDINGS)}"

    def number() -> int:
        return r.randrange(1000, 9999)

    def wild() -> str:
        """A credential as services make them, or as people do under rules."""
        return r.choice([
            lambda: rand(r.randrange(9, 44)) + "7k", lambda: word().title() + r.choice("!#%") + rand(4), lambda: word().title() + str(number()), lambda: f"{word()}-{word()}-{word()}-{r.randrange(10, 99)}",
            lambda: rand(r.choice([32, 40, 64]), "0123456789abcdef"), issued, lambda: word()[:2] + "3" + word() + str(r.randrange(10, 99)), lambda: word() + word().title() + r.choice("!%") + rand(3), lambda: rand(1) + "_" + rand(3) + r.choice("%!$") + rand(6),
        ])()

    def issued() -> str:
        """One that its prefix gives away."""
        return r.choice([lambda: "sk_live_" + rand(24), lambda: "AKIA" + rand(16, letters[26:]), lambda: "ghp_" + rand(36), lambda: f"xoxb-{r.randrange(10**10, 10**11)}-{rand(24)}", lambda: "npm_" + rand(36), lambda: f"SG.{rand(22)}.{rand(43)}"])()

    def marked() -> str:
        """One that marks divide into several tokens."""
        m = lambda: r.choice("@:?=,;()<>|&")
        return r.choice([
            lambda: rand(r.randrange(2, 7)) + r.choice("0123456789") + m() + rand(r.randrange(3, 9)) + "4x", lambda: word().title() + r.choice("@?()|") + str(number()), lambda: f"{m()}{rand(3)}7{m()}{rand(4)}{m()}{rand(3)}2k",
            lambda: rand(6) + "3" + m() + m() + rand(2), lambda: word()[:2].title() + "0" + word()[:2] + m() + word()[:3] + m() + rand(2) + "3",
        ])()

    def chosen() -> str:
        """One that people choose and remember."""
        return r.choice([lambda: word() + word()[:3], lambda: word() + str(r.randrange(1, 999)), lambda: word() + r.choice(["", "let", "ing"]) + word()[:2], lambda: " ".join(word() for _ in range(r.randrange(3, 6)))])()

    def harmless() -> str:
        return r.choice([
            lambda: "changeme", lambda: "your-api-key-here", lambda: "REPLACE_ME", lambda: "%(password)s", lambda: f"cannot read the {r.choice(['password', 'token'])} of {word()}", lambda: f"{word()}/{word()}", lambda: f"unit-{word()}-{word()}",
            lambda: "AKIA" + "X" * 16, lambda: "<token>", lambda: str(r.randrange(99999)), lambda: f"{word()}.{word()}", lambda: "X-Api-Key", lambda: "${SECRET}", lambda: f"https://{host()}:{number()}/{word()}", lambda: f"{word()}_{word()}",
            lambda: f"{r.choice(['enter', 'insert'])} a {r.choice(['new ', ''])}password", lambda: "private key file", lambda: "", lambda: f"https://{host()}:{number()}/{word()}?{word()[0]}={word()[0]}{r.randrange(9)}@{word()[0]}",
        ])()

    passwords = ["password", "db_password", "pwd", "passwort", "mot_de_passe", "contrasena", "smtp_pass", "userPassword", "PASSPHRASE", "admin_pw", "Passwd"]
    names = [*passwords, "apiKey", "API_KEY", "secret", "clientSecret", "auth_token", "signingKey", "access_key", "service_credential", "bearer"]
    tokens_ = names[len(passwords):]
    other = ["checksum", "rev", "revision", "tokenId", "key_column", "public_key", "row_id", "integrity", "label", "token_kind", "passwordHint", "sample", "last_seen"]
    quoted = [
        '{n} = "{v}"', "{n} = '{v}'", 'const {n} = "{v}";', '{n}: "{v}"', '"{n}": "{v}",', "{n} := `{v}`", 'private static final String {n} = "{v}";', 'let {n}: &str = "{v}";', "${n} = '{v}';", "'{n}' => '{v}',", 'const char *{n} = "{v}";',
        'static const char *{n} = "{v}";', 'static const std::string {n} = "{v}";',
    ]
    bare = ["{n}={v}", "  {n} = {v}"]
    scheme = ["mysql", "postgres", "amqp", "redis", "ftp", "https"]
    places = [
        lambda v: f"{r.choice(['//', '#', '--'])} {r.choice(['password', 'pass:', 'passwort', 'tmp key=', 'login: x / pass:'])} {v}", lambda v: f'url = "{r.choice(scheme)}://{word()}:{v}@{host()}:{number()}/{word()}"',
        lambda v: f'{r.choice(["connect", "open", "signIn", "bind", "auth"])}{word().title()}("{host()}", "{word()}", "{v}");', lambda v: f'login_{word()}("{host()}", \'{word()}\', \'{v}\')', lambda v: f'h = "Authorization: Bearer {v}"',
        lambda v: f'u = "https://{host()}/{word()}?{r.choice(["token", "key"])}={v}"', lambda v: f'callback = "https://{host()}/{word()}?sig={v}"', lambda v: f'h1 = "X-Api-Key: {v}"', lambda v: f"# tmp key={v}",
        lambda v: f"{r.choice(['#', '//', '--'])} use {word()}:{v} {r.choice(['until friday', 'for now', 'on staging', 'if it hangs'])}", lambda v: f"url = {r.choice(scheme)}://svc:{v}@{host()}:{number()}", lambda v: f"{word()}_url={r.choice(scheme)}://{word()}:{v}@{host()}/{word()}",
        lambda v: f'column-url: "{r.choice(scheme)}://{word()}:{v}@{host()}:{number()}/{word()}"', lambda v: f'{r.choice(["auth", "HEADER", "val header"])} = "Token {v}"', lambda v: f'@passphrase "{v}"',
    ]
    plain = ["conf", "extra", "blob", "fallback", "value", "TARGET", "entry1", "cfg_entry", "k", "data", "module.exports", "header.line"]
    out = []
    for _ in range(120):
        v = issued()
        out.append((r.choice([*quoted, *bare]).format(n=r.choice(plain), v=v), v))
        out.append((r.choice([*quoted, *bare]).format(n=r.choice(plain), v=r.choice([lambda: rand(r.randrange(40, 400)) + "7k/x+", lambda: rand(r.randrange(9, 30)) + "7k", lambda: rand(40, "0123456789abcdef"), harmless, chosen])()), ""))
        kind, quote, name = r.choice(["RSA ", "EC ", "OPENSSH ", ""]), r.choice(["\"", "'", "`", '"""', "[[", ""]), r.choice([*plain, *names])
        body = r.choice([f"\\n{rand(60)}\\n{rand(20)}", ""])
        out.append((f"{name} {r.choice(['=', ':', ':='])} {quote}-----BEGIN {kind}PRIVATE KEY-----{body}", "-----BEGIN"))
        out.append((f'<{r.choice(["p", "div", "td"])} class="{word()}-{r.randrange(99)}">{r.choice(["open", "key", "token", "sign"])} {word()}, {word()}_{word()}</p>', ""))
    out += [(place(v := wild()), v) for place in places for _ in range(80)]
    out += [(f'url = "{r.choice(scheme)}://{word()}:{(v := marked())}@{host()}:{number()}/{word()}"', v) for _ in range(80)]
    for _ in range(40):
        v = f"{word()}{word().title()}{r.choice('_-')}{rand(3)}"
        out.append((f'{word()} = "{r.choice(scheme)}://{word()}:{v}@{host()}:{number()}/{word()}"', v))
    for _ in range(60):
        v = base64.b64encode(f"{word()}:{rand(9)}".encode()).decode()
        out.append((f'{r.choice(["h1", "auth", "AUTHORIZATION", "column_h1"])}{r.choice([" = ", "=", ": "])}{(q := r.choice(['"', "'", ""]))}Basic {v}{q}', v))
    for _ in range(n):
        x, form = r.random(), r.choice([*quoted, *bare])
        if x < 0.3:
            out.append((form.format(n=r.choice(names), v=(v := wild())), v))
        elif x < 0.42:
            out.append((r.choice(quoted).format(n=r.choice(names), v=(v := marked())), v))
        elif x < 0.52:
            out.append((r.choice(quoted).format(n=r.choice(passwords), v=(v := chosen())), v))
        elif x < 0.56:  # what other names hold may be a word
            out.append((r.choice(quoted).format(n=r.choice(tokens_), v=r.choice([word, lambda: word() + str(r.randrange(999))])()), ""))
        elif x < 0.72:
            out.append((form.format(n=r.choice(names), v=harmless()), ""))
        elif x < 0.84:
            out.append((form.format(n=r.choice(other), v=r.choice([lambda: rand(r.choice([32, 40]), "0123456789abcdef"), lambda: rand(20) + "7k", harmless, chosen])()), ""))
        elif x < 0.9:
            out.append((r.choice(quoted).format(n=r.choice(names), v=r.choice([f"{word()}:{word()}{r.randrange(99)}", f"{word()}={r.randrange(99)},{word()}", f"{word()}_{word()}({r.randrange(99)})", f"{word()}@{host()}"])), ""))
        elif x < 0.95:
            out.append((f'if ({word()} > {r.randrange(99)}) {{ d.{r.choice(["token", "key", "secret"])}={word()[0]}-{r.randrange(9999)}; }}', ""))
        else:
            out.append((f'{word()}_{r.choice(["token", "key"])}("{word()}_{word()}{r.randrange(999)}", {r.randrange(9999)})', ""))
    return out


def gold(window: str, credential: str) -> list[int]:
    """Labels of a composed line's tokens: those that share a character with the credential, which stands where it occurs last."""
    tokens, starts, ends = lex(window)
    a = window.rfind(credential) if credential else len(window)
    b = a + len(credential)
    out, inside = [], False
    for x, y in zip(starts, ends):
        hit = x < b and y > a
        out.append((IN if inside else BEGIN) if hit else OUT)
        inside = hit
    return out


def fit(texts: list[str], lines: int = TRAIN_LINES) -> dict:
    """The field fitted on composed lines and on about ``lines`` pieces of those of ``texts`` in which the rough rule sees no credential."""
    a, rows, labels = _automaton(), [], []
    seen = set()

    def add(window: str, wanted: list[int] | None) -> int:
        tokens, _, _ = lex(window)
        attrs = attributes(tokens)
        if wanted is None:
            if any(seed(tokens, attrs)) or any(a[3] == "head" for a in attrs):
                return 0
            wanted = [OUT] * len(tokens)
        solid = chain(tokens)
        told, new = features(tokens, attrs), 0
        for k in range(0, len(solid), LONGEST):
            piece = solid[k : k + LONGEST]
            kind = (tuple(attrs[i] for i in piece), tuple(min(len(tokens[i]), 24) // 4 for i in piece), tuple(wanted[i] for i in piece))
            if kind not in seen:  # pieces of equal features teach nothing new
                seen.add(kind)
                rows.append(told[k : k + LONGEST])
                labels.append([wanted[i] for i in piece])
                new += 1
        return new

    sampled = 0
    for line, credential in composed():
        add(line, gold(line, credential))
    for t in texts:
        for _, _, w in windows(t, a):
            if sampled < lines:
                sampled += add(w, None)
    return train(rows, labels)


def _find(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, m = _automaton(), model.value
        for b in batches:
            kinds, ids, lines, froms, tos = [], [], [], [], []
            for kind, i, t in zip(b.column("kind").to_pylist(), b.column("record_id").to_pylist(), b.column("text").to_pylist()):
                for line, x, y in spans(m, t, a):
                    kinds.append(kind)
                    ids.append(i)
                    lines.append(line)
                    froms.append(x)
                    tos.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), *(pa.array(x, pa.int64()) for x in (ids, lines, froms, tos))], ["kind", "record_id", "line", "from", "to"])

    return run


def model_for(records: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """The field for ``records``, fitted on the ``rows`` texts of each kind whose ids hash lowest."""
    ids = records.select("kind", "record_id", F.xxhash64("kind", "record_id").alias("h"))
    some = None
    for kind in ("file", "symbol"):
        part = ids.filter(F.col("kind") == kind).orderBy("h", "record_id").limit(rows)
        some = part if some is None else some.unionByName(part)
    texts = records.join(F.broadcast(some.select("kind", "record_id").distinct()), ["kind", "record_id"], "left_semi").filter("text is not null").orderBy("kind", "record_id").limit(2 * rows).select("text")
    return fit([r["text"] for r in texts.collect()])


def find_secrets(records: DataFrame) -> DataFrame:
    """(kind, record_id, line, from, to) of each credential in ``records(kind, record_id, text)``; from/to count characters of the text.

    Null and empty texts have none. A record delivered again gives the same rows, which are kept once. Extra columns are
    ignored. Lines end at \\n, \\r\\n or \\r. A key block of several lines is one credential from its first line.
    """
    records = records.select("kind", F.col("record_id").cast("bigint").alias("record_id"), "text")
    model = records.sparkSession.sparkContext.broadcast(model_for(records))
    out = records.filter("text is not null").mapInArrow(_find(model), "kind string, record_id bigint, line bigint, `from` bigint, `to` bigint")
    return out.distinct()


def _redact(model, mark: str):
    def run(batches):
        a, m = _automaton(), model.value
        for b in batches:
            out, counts = [], []
            for t in b.column("text").to_pylist():
                found = spans(m, t, a) if t else []
                for _, x, y in reversed(found):
                    t = t[:x] + mark + t[y:]
                out.append(t)
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("record_id"), pa.array(out, pa.string()), pa.array(counts, pa.int32())], ["kind", "record_id", "text", "redacted"])

    return run


def redact_secrets(records: DataFrame, mark: str = "REDACTED") -> DataFrame:
    """(kind, record_id, text, redacted): every record's text with each credential, and nothing else, replaced by ``mark``.

    Nulls stay null with 0 redacted; rows stay as often as they are delivered.
    """
    records = records.select("kind", F.col("record_id").cast("bigint").alias("record_id"), "text")
    model = records.sparkSession.sparkContext.broadcast(model_for(records))
    return records.mapInArrow(_redact(model, mark), "kind string, record_id bigint, text string, redacted int")
