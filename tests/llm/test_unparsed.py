import glob
import random
import sysconfig
import warnings

import pytest

from symbolmill.llm.derive import Grammar
from symbolmill.llm.syntax import check, judge
from symbolmill.llm.unparsed import judged, rates

GOOD = {
    "python": "import a\nfrom .b import (c, d)\n\n@dec(1)\nasync def f(a, *b, c: int = 1, **d) -> int:\n    \"\"\"doc [\"\"\"\n    x = [i for i in a if i]\n    if a: return {**d, 'k': 1}\n    elif b:\n        pass\n    return a if b else lambda y: y\n",
    "javascript": "import { a } from './a'\nexport const f = async (x, y = 1) => {\n  for (const i of x) { g(`t ${i}`) }\n  return x\n    .map((z) => z * 2)\n}\nclass A extends B {\n  m(a) { return { a, b: 1 } }\n}\n",
    "typescript": "interface A { x: number; y?: string[] }\ntype Id = string | number\nexport function f<T>(a: T, b?: Map<string, number>): Promise<T> {\n  const c: number[] = [1, 2]\n  return a as T\n}\n",
    "java": "package a.b;\nimport java.util.*;\n@A(1)\npublic class X<T> extends Y implements Z {\n  private final List<Map<String, Integer>> m = new ArrayList<>();\n  int f(int... a) throws E { for (var x : m) { if (x > 1) return (int) x; else g(); } return a[0] + 1; }\n}\n",
    "go": "package a\nimport (\n\t\"fmt\"\n)\nfunc (s *S) F(a int, b []string) (int, error) {\n\tfor i, x := range b {\n\t\tfmt.Println(i, x)\n\t}\n\tif y := a; y > 1 {\n\t\treturn y, nil\n\t}\n\treturn 0, nil\n}\n",
    "rust": "use a::{b, c};\npub fn f<'a>(x: &'a str, mut y: Vec<u8>) -> Result<i64, E> {\n    let z = x.len()?;\n    for i in 0..3 { y.push(1); }\n    match z { 1 => a(), _ => { b() } }\n    Ok(z)\n}\n",
    "c": "#include <a.h>\nstatic const char *x = \"} \" \"b\";\nint f(int a, char **b) {\n  for (int i = 0; i < 3; i++) { a += b[i][0]; }\n  return a ? 1 : 2;\n}\n",
    "ruby": "require 'a'\nclass A < B\n  def f(x, y = 1)\n    x.each do |i|\n      puts i if i > 1\n    end\n    { a: 1, :b => 2 }\n  end\nend\n",
    "shell": "#!/bin/bash\nf() {\n  local a=\"$(g \"$1\" 'x )')\"\n  if [ \"$a\" -gt 1 ]; then\n    echo $((a + 1))\n  fi\n  for i in a b; do g $i; done\n}\nf x && g | h\n",
    "lua": "local a = require(\"b\")\nfunction M.f(x, ...)\n  for i, v in ipairs(x) do a[i] = v .. 'y' end\n  return { a = 1, [2] = 3 }\nend\n",
    "php": "<?php\nuse A\\B;\nclass K extends J {\n  public function f(?int $x = 1): array { foreach ($x as $k => $v) { echo $v; } return ['a' => 1]; }\n}\n",
}


@pytest.mark.parametrize("lang", GOOD)
def test_accepts_and_rejects(lang):
    text = GOOD[lang]
    assert check(lang, text) == ("", -1) and check(lang, "\ufeff" + text.replace("\n", "\r\n")) == ("", -1)
    at = text.index("\n", len(text) // 3) + 1
    assert check(lang, text[:at] + "<<<<<<< HEAD\n" + text[at:])[0] == "wrong"
    assert check(lang, text + ")")[0] == "wrong"
    assert check(lang, text.rstrip() + "\nfoo(1")[0] in ("cut", "wrong")
    others = [x for x in GOOD if x != lang and (lang, x) != ("typescript", "javascript")]
    assert [x for x in others if check(lang, GOOD[x])[0] == ""] == []


def test_derivatives_find_the_token():
    g = Grammar()
    g.rule("S", g.alt(g.seq("(", g.ref("S"), ")", g.ref("S")), g.seq()))
    start = g.ref("S")
    g.close()
    assert g.parse(start, list("(()())")) == -1
    assert g.parse(start, list("())")) == 2
    assert g.parse(start, list("((")) == 2
    small = Grammar(limit=10)
    small.rule("S", small.alt(small.seq("(", small.ref("S"), ")", small.ref("S")), small.seq()))
    s = small.ref("S")
    small.close()
    assert [small.parse(s, list("(" * k + ")" * k)) for k in range(20)] == [-1] * 20


def test_dataframe(spark):
    rows = [
        (1, "r", "a.py", "python", "def f(:\n"), (2, None, "a.py", None, "x = (1,\n"), (3, "r", "a.py", "python", ""), (4, "r", "a.py", "python", None), (5, "r", "a.vim", "vim", "(("), (6, "r", "a.txt", "unknown", "(("),
        (7, None, "a.h", None, "int f(void) { return 1; }\n"), (1, "r", "a.py", "python", "def f(:\n"), (8, "r", "a.go", "go", "package a\n" + "var x = 1\n" * 20_000),
    ]
    df = spark.createDataFrame(rows, "file_id bigint, repo string, path string, language string, content string").selectExpr("*", "1 as token", "2 as verdict")
    got = {r["file_id"]: r["verdict"] for r in judged(df).collect()}
    assert got == {1: "wrong", 2: "wrong", 3: "ok", 7: "ok", 8: "ok"} or got == {1: "wrong", 2: "cut", 3: "ok", 7: "ok", 8: "ok"}
    assert {(r["repo"], r["language"]): r["unparsed"] for r in rates(df).collect()} == {("r", "python"): 1, (None, "python"): 1, (None, "c"): 0, ("r", "go"): 0}
    assert judged(df.filter("false")).count() == 0


def compiles(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "x", "exec")
    except SyntaxError:
        return False
    return True


def test_standard_library_as_the_compiler_judges_it():
    """Every module that the compiler takes is accepted; with one token taken out or put in, most of what the compiler refuses is refused, and nothing else."""
    r = random.Random(2)
    modules = sorted(glob.glob(sysconfig.get_paths()["stdlib"] + "/*.py"))
    texts = [t for t in (open(p, encoding="utf-8", errors="replace").read() for p in modules) if compiles(t)]
    assert len(texts) > 100 and [i for i, t in enumerate(texts) if check("python", t)[0]] == []
    missed = false = broken = 0
    for t in texts:
        lines = t.split("\n")
        k = r.randrange(len(lines))
        lines[k] = r.choice([lines[k] + ")", lines[k].replace(":", "", 1), lines[k].replace("(", "", 1), " " + lines[k], lines[k] + " 1 2"])
        v = "\n".join(lines)
        ok, ours = compiles(v), check("python", v)[0] == ""
        broken += not ok
        missed += not ok and ours
        false += ok and not ours
    assert broken > 40 and false == 0 and missed == 0, (broken, missed, false)


LINES = [
    ("python", "x = [1, 2", "cut"), ("python", "if x:\n  y = (1,", "cut"), ("python", "if x:", "cut"), ("python", 'x = """a', "cut"), ("python", "x = 1 +* 2", "wrong"), ("python", "f(a=1, b)", "wrong"),
    ("python", "def f(a=1, b): pass", "wrong"), ("python", "1 = x", "wrong"), ("python", "f() = 2", "wrong"), ("python", "not = 1", "wrong"), ("python", "if x:\n\ty\n        z", "wrong"), ("python", "try:\n  x\nexcept A, e:\n  y", "wrong"),
    ("javascript", "const a = /a\\/b/g;\n", ""), ("javascript", 'x.replace(/[/"]+/g, "")\n', ""), ("javascript", "const t = `a ${b.map((x) => `<${x}>`).join('')} c`\n", ""), ("javascript", "const x = a / b / c\n", ""),
    ("javascript", "switch (a) { case 1: b(); break; default: c() }\n", ""), ("javascript", "async () => { for await (const x of y) {} }\n", ""), ("javascript", "class A { #p = 1; get v() { return this.#p } }\n", ""),
    ("go", "package a\nfunc F[T any](x T) T {\n\treturn x\n}\n", ""), ("go", "package a\ntype S[K comparable, V any] struct {\n\tm map[K]V\n}\n", ""), ("rust", "fn f() -> impl Fn(i32) -> i32 {\n    move |x| x + 1\n}\n", ""),
    ("rust", "fn f(x: Box<dyn Fn(u8) -> bool>) {}\n", ""), ("java", "class A { int f(Object o) { return switch (o) { case String s -> 1; default -> { yield 2; } }; } }\n", ""), ("kotlin", 'val x = when (y) { 1 -> "a"; else -> "b" }\n', ""),
    ("csharp", 'var x = y switch { 1 => "a", _ => "b" };\n', ""), ("php", '<?php $x = match($y) { 1 => "a", default => "b" };\n', ""), ("c", "int f(char *s) { switch (*s) { case 1: break; default: return 1; } return 0; }\n", ""),
    ("ruby", "x = y =~ /a\\/b/ ? 1 : 2\n", ""), ("shell", "for i do\n  case $i in\n    a) ;;\n    (b|c)\n    ;;\n  esac\ndone\nwhile read x; do echo $x; done < <(ls)\ncat <<EOF\nit's (\nEOF\n", ""),
]


@pytest.mark.parametrize("lang,text,verdict", LINES)
def test_forms(lang, text, verdict):
    assert check(lang, text)[0] == verdict


def test_place_of_the_token():
    for lang, text, token in (("python", "a = 1\r\nb = (2\r\nc = )\r\n", "c"), ("go", "package a\n\nfunc f) {\n}\n", ")"), ("shell", "cat <<E\nx\nE\nif a; then\n  b\n)\n", ")"), ("javascript", "a = /x/\nb = ]\n", "]")):
        verdict, _, offset = judge(lang, text)
        assert verdict == "wrong" and text[offset:].startswith(token), (lang, offset)
