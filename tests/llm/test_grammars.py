import json
import tomllib

import pytest

from riskloom.llm import syntax

PYTHON_OK = [
    "", "\n\n", "x = 1", "def f(a, /, b=1, *c, d, **e) -> int:\n    return a\n", "class A(B, metaclass=C):\n    x: int = 3\n    def m(self): return self.x\n",
    "match x:\n    case [1, *r] if r:\n        pass\n    case {'a': 1, **c}:\n        pass\n    case 1 | A.B(d=1) as e:\n        pass\nmatch = 3\nmatch(x)\n", "type A[T: int] = list[T]\ntype = 3\n",
    "with (open(a) as f, open(b) as g):\n    pass\nwith (a, b): pass\n", "async def f():\n    async with a as b, c:\n        await d\n    return [x async for x in y]\n",
    "f'{x!r:>{w}} {{}} {y=}' rf'{a[\"b\"]}'\n", "try:\n  a\nexcept* (B, C) as e:\n  pass\nelse:\n  d\nfinally:\n  f\n", "x = (\n  1,\n\n  # c\n  2)\nif x: y; z\nelse: w\n",
    "a, *b = c = yield_ = lambda *a, k=1: (yield_)\n", "@a.b(c)\n@d\nclass E: ...\n", "x = 1 if a else 2\nprint(*a, **b, sep='')\ndel a[0], b.c\nassert a, b\n",
    "for i, in x: break\nelse: pass\nwhile a: continue\n", "from . import a as b, c\nfrom ...d.e import (f, g,)\nimport h.i as j\n", "x = 0xff_ff + 1_0.5e-3j + 0b1 + 0o7\n",
    "def g():\n\tif x:\n\t\treturn\n\tyield\n", "global_ = not a in b is not c < d\nx = a if b else lambda: c\n", "\\\nx = 1\\\n + 2\n", "x: int\n(y) = 1\nz.a: b = c\n", "if (n := f(x)) > 1: pass\n",
]
PYTHON_BAD = [
    "print 'x'", "def f(:\n  pass", "x = (1,\ny = 2\n", "if a:\npass", "  x = 1\n y = 2", "x = 'abc", 'x = """abc\n', "return 1", "class A:\n  return 2\n", "break", "f() = 1", "a + b = c", "x = 012",
    "try:\n  a\nb = 1\n", "else:\n  x", "def f(a=1, b): pass", "<<<<<<< HEAD\nx = 1\n", "x = 5 5", "import a.b as", "f'{a'", "f'{}'", "'a' b'c'", "x = [1, 2}", "for x y: pass", "async x", "await x\n", "x\0y",
    "def f():\n", "@a\nx = 1\n", "match x:\n  pass\n", "except: pass", "lambda x: = 1", "x = $a", "f(a=1, b)", "a = yield = b", "del f()", "'\\x4'",
]
JAVASCRIPT_OK = [
    "", "#!/usr/bin/env node\nvar a", "'use strict'\nconst a = 1, b = `x${a}y${`n${1}`}`\n", "import a, { b as c, default as d } from 'e';\nexport * as f from 'g';\nexport default class {}\n",
    "a\n/b/g.test(c)", "x = /[/'\"]+\\//gi.test(y) ? a / b / c : d", "for (const [a, b] of c) { continue }\nfor (let i = 0, n = 3; i < n; i++);\nfor (k in o) break\n",
    "const { a, b: { c = 1 }, ...d } = e;\n[a, b] = [b, a];\n({ a, b = 2 } = c);\n", "async (a, { b } = {}) => { await a; };\nasync a => a;\n(a, b) => ({ a, b })\nconst f = async function* () { yield* a; for await (const x of y) {} }\n",
    "class A extends B { #p = 1; static #q; static { this.x = 1; } get a() { return this.#p } set a(v) {} static async *[b]() {} constructor() { super(); super.m() } 'k'() {} async = 1\n has(o) { return #p in o } }\n",
    "a?.b?.[c]?.(d) ?? e\na **= 2 ** -1\na ||= b\n", "label: for (;;) { if (a) continue label; else break label }\nswitch (a) { case 1: case 2: break; default: b() }\n",
    "try { a } catch { b } finally { c }\ntry { a } catch ({ message }) {}\n", "var let_ = 1, of = 2, get = 3, async = 4;\nof = get + async\nlet\nx = 1\n", "return_ = function () { return\n1 }\nif (a) b; else c\ndo x++; while (y) z\n",
    "new.target_\nnew A\nnew A.B(c).d\nnew (f())()\nimport('x').then(y)\nimport.meta.url\n".replace("new.target_\n", ""), "x = { a, 'b': 1, [c]: 2, d() {}, get e() { return 1 }, async *f() {}, ...g, 1: 2, get: 3, async: 4 }",
    "await x;\nexport const y = 1", "0x1f + 1_000n + .5 + 5. + 1e3", "/* a\n b */ x /* c */ = 1 // d", "if (a) { } /re/.test(b)", "a = b\n++c", "x = y => z => ({}).w, function* g() { const a = yield; yield b }",
    "(function () { return new.target })()", "for (var i = 0 in {}) ;".replace(" = 0", ""), "x = a ? (b, c) : d => e", "((a, b = 1, ...c) => a)(1)", "export { a as 'b c' } from 'd' with { type: 'json' }",
]
JAVASCRIPT_BAD = [
    "function (", "var a = ;", "if (a {", "{ a", "a }", "const a;", "return 1", "import a from", "import a", "x = 'abc", "x = `abc", "x = /abc", "a b", "<!DOCTYPE html>\n<p>", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n",
    "interface A { b: string }", "export interface A {}", "let x: number = 1", "function f(a: string) {}", "f() = 1", "1 = a", "class A { a( }", "({ a = 1 })", "for (const a b) {}", "a => { ", "break", "try { a }", "x = { a b }",
    "def f():\n  pass", "import json\nimport os", "set -eu\nif [ $x ]; then y; fi", "[project]\nname = 1 2", "new", "switch (a) { b }", "a ? b", "`${a`", "`${a b}`", "if (a) export default b", "case 1:", "-a ** b", "throw\na", "012abc", "x = /(/",
]


@pytest.mark.parametrize("text", PYTHON_OK)
def test_python_accepts(text):
    from riskloom.llm.grammar import python

    compile(text, "t", "exec", dont_inherit=True)
    assert python.check(text) == []


@pytest.mark.parametrize("text", PYTHON_BAD)
def test_python_refuses(text):
    from riskloom.llm.grammar import python

    with pytest.raises((SyntaxError, ValueError)):
        compile(text, "t", "exec", dont_inherit=True)
    assert python.check(text)


@pytest.mark.parametrize("text", JAVASCRIPT_OK)
def test_javascript_accepts(text):
    from riskloom.llm.grammar import javascript

    assert javascript.check(text) == []


@pytest.mark.parametrize("text", JAVASCRIPT_BAD)
def test_javascript_refuses(text):
    from riskloom.llm.grammar import javascript

    assert javascript.check(text)


@pytest.mark.parametrize("text", ["{}", " [1, 2.5e3, -0, \"\\u00e9\", null, true]\r\n", '{"a": {"b": []}}', "3", "", "{,}", "[1,]", '{"a" 1}', "{'a': 1}", "NaN", "[01]", '"\t"', "[1 2]", "{}{}", '{"a":1', "]", "[}", "tru", '"\\x"'])
def test_json_agrees(text):
    def no(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=no)
        valid = True
    except ValueError:
        valid = False
    assert (syntax.grammars()["json"](text) == []) == valid


def test_json_depth():
    check = syntax.grammars()["json"]
    assert check("[" * 200000 + "]" * 200000) == [] and check("[" * 200000)


@pytest.mark.parametrize("text", ["", "a = 1\n[b.c]\nd = [1, 'x', {e = true}]\n[[f]]\ng = 1979-05-27T07:32:00Z\n", "a = \"\"\"\nx\"\"\"\n'q' . r = 0x1F\n", "a = \n", "a = 1 b = 2\n", "[a\n", "a = 1\na = 2\n", "a = 'x\n", "= 1", "a = [1, 2", "[a]\n[a]\n"])
def test_toml_agrees(text):
    try:
        tomllib.loads(text)
        valid = True
    except tomllib.TOMLDecodeError:
        valid = False
    assert (syntax.grammars()["toml"](text) == []) == valid


@pytest.mark.parametrize(("text", "valid"), [("", True), ("[a]\nb = c\n  d\ne: f\n# g\n", True), ("b = c\n", False), ("[a]\nb = 1\nB = 2\n", False), ("[a]\n[a]\n", False), ("[a]\nnothing\n", False), ("[a]\n= 1\n", False)])
def test_ini(text, valid):
    assert (syntax.grammars()["cfg"](text) == []) == valid


def test_all_errors_and_the_first_cause():
    from riskloom.llm.grammar import javascript, python

    assert [line for line, _ in python.check("x = 1\ny = = 2\nz = 3\ndef (:\n  pass\nw = ]\n")] == [2, 4, 6]
    assert [line for line, _ in javascript.check("a = ;\nb();\nc d;\ne();\n")] == [1, 3]


def test_found_files(spark):
    schema = "file_id bigint, language string, content string, path string, ecosystem string, package string, errors string, line int"
    rows = [
        (1, " Python ", "x = ", "a.py", "e", "p", "", 1), (1, " Python ", "x = ", "a.py", "e", "p", "", 1), (2, "python", "", "b", "e", "p", "", 1), (3, "json", "", "c", "e", "p", "", 1),
        (4, "unknown", "x = (", "d", "e", "p", "", 1), (5, None, "x = (", "d", "e", "p", "", 1), (6, "JavaScript", None, "d", "e", "q", "", 1), (7, "cfg", "x", "d", "e", "q", "", 1),
        (8, "javascript", "f(" * 3000 + ")" * 3000 + ";\n" + "g();\n" * 20000, "d", "e", "q", "", 1),
    ]
    df = spark.createDataFrame(rows, schema)
    assert {r.file_id for r in syntax.invalid_files(df).collect()} == {1, 3, 7}
    rates = {(r.package, r.language): (r.files, r.invalid, r.accepted) for r in syntax.acceptance(df).collect()}
    assert rates == {("p", "python"): (2, 1, 0.5), ("p", "json"): (1, 1, 0.0), ("q", "cfg"): (1, 1, 0.0), ("q", "javascript"): (1, 0, 1.0)}
    assert syntax.invalid_files(df.limit(0)).count() == 0


def test_every_error_is_stored(spark):
    texts = {
        "python": "x = = 1\n" * 300, "javascript": "a = ;\n" * 300, "toml": "a = ?\n" * 300, "cfg": "[s]\n" + "=x\n" * 300,
        "json": "[" + ",\n".join(["x"] * 300) + "]",
    }
    df = spark.createDataFrame(list(enumerate(texts.items())), "file_id bigint, v struct<language: string, content: string>").select("file_id", "v.*")
    got = {r.file_id: r for r in syntax.invalid_files(df).collect()}
    for k, name in enumerate(texts):
        first = 2 if name == "cfg" else 1
        assert [e.line for e in got[k].errors] == list(range(first, first + 300)) and got[k].error_count == 300, name


def test_nesting_of_any_depth():
    from riskloom.llm.grammar import data, javascript, python

    for n in (900, 20000):
        assert javascript.check("x = " + "(" * n + "1" + ")" * n) == [] and javascript.check("x = " + "[" * n + "1" + "]" * (n - 1)) != []
        assert data.toml_errors("a = " + "[" * n + "1" + "]" * n) == [] and data.toml_errors("a = " + "{b = " * n + "1" + "}" * n) == []
        assert data.json_errors("[" * n + "]" * n) == [] and data.json_errors("[" * n + "]" * (n - 1)) != []
    for n in (150, 200, 201):  # the language itself ends at 200
        assert (python.check("x = " + "(" * n + "1" + ")" * n) == []) == (n <= 200)


TOML_OK = [
    "a.b = 1\na.c = 2\n[x]\n[x.y]\n[z]\n", "[a.b]\n[a]\nc = 1\n", "[[a]]\nb = 1\n[[a]]\nb = 2\n[a.c]\n[[a]]\n[a.c]\n", "a = {b.c = 1, b.d = 2}\n", "a = [1, [2,],\n # c\n]\n", "a = 1979-05-27 07:32:00.5Z\nb = 07:32:00\n",
    'a = """x""y"""\nb = \'\'\'z\'\'\'\n', '"a.b" = 1\na.b = 2\n', "a = 0x_".replace("_", "f") + "\n", "a = -inf\nb = 1_0.5e+3 # c\n", 'a = """b\\\n  \n c"""\n', "a = {}\nb = []\n[[c]]\n[c.d]\n",
]
TOML_BAD = [
    "a = 1\na = 2\n", "[a]\n[a]\n", "a = 1\n[a]\n", "a = 1\na.b = 2\n", "[a]\nb.c = 1\n[a.b]\n", "[[a]]\n[a]\n", "[a]\n[[a]]\n", "a = {b = 1}\na.c = 2\n", "a = {b = 1}\n[a.c]\n", "a = [1]\n[[a]]\n", "a = 1979-13-01\n", "a = 24:00:00\n",
    "[a.b]\nx = 1\n[a]\nb.y = 2\n", "a = 01\n", "a = 1.\n", "a = \\u0000\n", 'a = "\\ud800"\n', "a = {b = 1,}\n", "a = {b = 1\n}\n", "a = 1 b = 2\n", "= 1\n", "a = \n", "a\n", "[a\n", "a = # c\n", "a = [1 2]\n", "a = 1 # \x01\n", "a = 'b\nc'\n", "a.b.c = 1\na.b = 2\n",
]


@pytest.mark.parametrize("text", TOML_OK + TOML_BAD)
def test_toml_agrees_with_the_standard_parser(text):
    from riskloom.llm.grammar import data

    try:
        tomllib.loads(text)
        valid = True
    except tomllib.TOMLDecodeError:
        valid = False
    assert valid == (text in TOML_OK) == (data.toml_errors(text) == []), data.toml_errors(text)


@pytest.mark.parametrize("text", [
    "[a]\nb = 1\n", "[a]\nb = 1\n c\n\n d\n", "[a]\n[DEFAULT]\nx = 1\n[DEFAULT]\ny = 1\n", "[a]\n[a]\n", "b = 1\n", "[a]\nb\n", "[a]\nB = 1\nb: 2\n", "[a]\n= 1\n", "[DEFAULT]\nx = 1\n[DEFAULT]\nx = 2\n", "", "# c\n", "[]\nb = 1\n", "[a]\r\nb = 1\r\n",
    "[a]\nb = 1\x0cc\n", "[a] c\nb=1\n", " [a]\n b = 1\n  c\n", "[a]\n b = 1\nc\n", "<<<<<<< x\n[a]\n",
])
def test_ini_agrees_with_the_standard_parser(text):
    import configparser

    from riskloom.llm.grammar import data

    try:
        configparser.RawConfigParser().read_string(text)
        valid = True
    except configparser.Error:
        valid = False
    assert valid == (data.ini_errors(text) == []), data.ini_errors(text)
