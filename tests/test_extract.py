import random

import pytest

from symbolmill.operators.extract import Ends, extract, symbols_of

#: Hand-derived goldens: language -> (source, symbols as name type line-end, imports, exports).
GOLDEN = {
    "typescript": ("import { A } from './a'\nimport * as fs from 'fs'\nexport async function load(id) {\n  return A(id)\n}\nexport const twice = (x) => {\n  return x * 2\n}\nexport interface Shape {\n  area: number\n}\ntype Id = string;", "load function 3-5; twice function 6-6; Shape interface 9-11; Id type 12-12; twice variable 6-6", ["./a"], ["twice", "Shape"]),
    "python": ("from os import path\nimport re\n\ndef a(x):\n  pass\n\nclass C:\n  def m(self):\n    pass\nasync def t(y) -> int:\n  pass", "a function 4-6; C class 7-9", ["path", "re"], []),
    "go": ('package p\nimport (\n  "fmt"\n)\nfunc (s S) Run(a int) error {\n  return nil\n}\ntype S struct {\n}', "Run function 5-7; S type 8-9", ['\n  "fmt"\n'], []),
    "cpp": ("#include <vector>\nint foo(int x) {\n  return x;\n}\n\nint bar(int y);", "foo function 1-4; bar function 4-6", ["vector"], []),
    "csharp": ("using System;\nnamespace N.X {\npublic class P {\n  public int Age { get; set; }\n  public void Go(int a) {\n  }\n}\n}", "Go function 5-6; P class 3-7; Age variable 4-4", ["System"], ["N.X"]),
    "lua": ('local m = require("a.b")\nfunction M.go(x)\n  if x then\n    return 1\n  end\nend\nreturn { go = 1 }', "go function 2-6", ["a.b"], ["module"]),
    "rust": ("use std::fmt;\npub fn area(x: u32) -> u32 {\n  x\n}\npub trait Shape {\n}\nimpl Shape for Sq {}", "area function 2-4; Shape interface 5-6", ["std::fmt"], ["Sq"]),
    "java": ("class A {\n  void foo() {\n    return bar(1);\n  }\n  public int baz() {\n    return 2;\n  }\n}", "foo function 1-8; bar function 2-4; baz function 5-7; A class 1-8", [], []),
    "ruby": ("require 'json'\nclass A\n  def go\n    x\n  end\nend", "go function 2-6; A class 1-6", ["json"], []),
    "php": ("<?php\nuse A\\B;\nclass K extends J {\n  function m($x) {\n  }\n}", "m function 4-5; K class 3-6", ["A\\B"], []),
    "swift": ("import UIKit\nprotocol P {\n}\nfunc go(a: Int) {\n}", "go function 3-5; P interface 1-3", ["UIKit"], []),
    "kotlin": ("import a.b\ndata class U(val x: Int)\nprivate fun f(y: Int) {\n}", "f function 3-4; U class 1-4", ["a.b"], []),
    "scala": ("import a.b\ntrait T {\n  def f(x: Int) = x\n}", "f function 3-4; T interface 2-4", ["a.b"], []),
    "elixir": ("defmodule My.Mod do\n  alias Foo.Bar\n  def run(x) do\n    x\n  end\nend", "run function 3-5; My.Mod class 1-6", ["Foo.Bar"], []),
    "dart": ("import 'a.dart';\nabstract class A {\n  int f(int x) async {\n    return x;\n  }\n}", "f function 3-5; A class 2-6", ["a.dart"], []),
    "shell": ("source ./x.sh\nbuild() {\n  make\n}", "build function 2-4", [], []),
    "vim": ("function! A()\nendfunction", "", [], []),
}


@pytest.mark.parametrize("lang", GOLDEN)
def test_golden(lang):
    text, want, imports, exports = GOLDEN[lang]
    symbols, i, e = extract(text, lang)
    assert "; ".join(f"{n} {t} {a}-{b}" for n, t, a, b, _, _ in symbols) == want
    assert (i, e) == (imports, exports)
    assert all(code == "\n".join(text.split("\n")[a - 1 : b]) or t == "variable" for _, t, a, b, code, _ in symbols)


def test_dataframe(spark):
    rows = [(1, "a.py", None, GOLDEN["python"][0]), (2, "b.py", "python", None), (3, "c.py", "python", ""), (4, "d.txt", None, "def a(x):")]
    df = spark.createDataFrame(rows, "file_id bigint, path string, language string, content string").selectExpr("*", "1 as symbols", "2 as line")
    got = [(r["file_id"], r["ordinal"], r["name"]) for r in symbols_of(df).orderBy("file_id", "ordinal").collect()]
    assert got == [(1, 0, "a"), (1, 1, "C")]
    assert symbols_of(df.filter("false")).count() == 0


#: Further forms, worked out by hand from the grammar: optional words, skipped names, matches that begin in the blanks before a definition.
FORMS = [
    ("javascript", "async function go(a) {\n}\nconst f = async () => 1;\nexport abstract class B extends A implements I {\n}\nexport type T = 1;", "go function 1-2; f function 3-3; B class 4-5; T type 6-6", [], ["T"]),
    ("javascript", "import d, { a } from \"x\"\nimport { b } from 'y'\nimport 'z'\nexport default function main() {}", "main function 4-4", ["x", "y"], ["main"]),
    ("c", "static inline int add(int a)\n{\n  return a;\n}\nvoid if(int x) {\n}\nstruct __declspec(dllexport) P : public Q {\n};\nnamespace n {}", "add function 1-4; P class 7-8", [], ["n"]),
    ("rust", "pub async unsafe extern \"C\" fn f<T>(x: T) {\n}\nstruct S<T> {\n}\nimpl<T> a::Tr for S {}", "f function 1-2; S class 3-4", [], ["S"]),
    ("ruby", "def self.a?(x)\n  1\nend\nmodule M\nend\nclass A < B\nend", "a? function 1-3; M type 3-7; A class 5-7", [], []),
    ("kotlin", "override fun f<T>(a: T): Int {\n}\nsealed interface S\nobject O {\n}", "f function 1-2; S interface 2-5; O class 3-5", [], []),
    ("go", "import \"os\"\nfunc F() {\n}\ntype I interface {\n}\ntype N int", "F function 2-3; I type 4-5", ["os"], []),
    ("java", "import static a.B.c;\npublic enum E { X }\nsynchronized (x) {}\n<T> List<T> go(int[] a) throws E1, E2 {\n}", "go function 3-3; E class 2-2", ["a.B.c"], []),
    ("python", "class A(B, metaclass=C):\n  x = 1\n\n  y = 2\nasync def g(a,\n  b):\n  pass\ndef h() -> int:\n  pass", "g function 5-7; A class 1-4", [], []),
    ("php", "<?php\nrequire 'a.php';\nfunction f(array $a, $b = []) {\n}\ninterface I {}", "f function 3-4", ["'a.php'"], []),
    ("elixir", "defmodule A.B do\n  import C, only: [d: 1]\n  defp x do\n  end\nend", "x function 3-4; A.B class 1-5", ["C"], []),
    ("shell", "function a() {\n  b\n}\nc () { d; }", "a function 1-3; c function 4-4", [], []),
]


@pytest.mark.parametrize("lang,text,want,imports,exports", FORMS)
def test_forms(lang, text, want, imports, exports):
    symbols, i, e = extract(text, lang)
    assert "; ".join(f"{n} {t} {a}-{b}" for n, t, a, b, _, _ in symbols) == want
    assert (i, e) == (imports, exports)


def naive_end(block, lines, start):
    """Where a block ends, line by line and character by character."""
    n = len(lines)
    if block == "brace":
        depth = opened = 0
        for i in range(start, n + 1):
            for c in lines[i - 1]:
                depth += (c == "{") - (c == "}")
                opened |= c == "{"
                if opened and depth == 0 and c == "}":
                    return i
        return min(start + 50, n)
    if block == "indent":
        base = len(lines[start - 1]) - len(lines[start - 1].lstrip())
        for i in range(start + 1, n + 1):
            x = lines[i - 1]
            if x.strip() and len(x) - len(x.lstrip()) <= base:
                return i - 1
        return n
    for i in range(start, n + 1):
        if lines[i - 1].strip()[-1:] in (";", ","):
            return i
        if i < n and lines[i].strip() and lines[i].strip()[0] not in ".(":
            return i
    return min(start + 10, n)


def test_block_ends_equal_brute_force():
    r = random.Random(4)
    for _ in range(400):
        lines = ["".join(r.choice(["{", "}", "a", " ", ";", ",", ".x", "(", "    "]) for _ in range(r.randrange(7))) for _ in range(r.randrange(1, 70))]
        ends = Ends("\n".join(lines))
        for block in ("brace", "indent", "statement"):
            start = r.randrange(1, len(lines) + 1)
            assert ends.end(block, start) == naive_end(block, lines, start), (block, start, lines)
