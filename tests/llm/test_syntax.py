import ast
import json
import random

import pytest

from colligo.llm.parsing import check_syntax, rates
from colligo.llm.syntax import faults_of, first_cause, language_of

GOOD = {
    "csharp": [
        "", "// only a comment\n", "using System;\nnamespace A;\npublic sealed class B<T> : C, ID<T> where T : class, new() { private readonly int[] _x = { 1, 2 }; public int this[int i] => _x[i]; public B(int a) : base(a) { } ~B() { } public static B<T> operator +(B<T> a, B<T> b) => a; public static implicit operator int(B<T> b) => 1; event Action E { add { } remove { } } enum F : byte { G = 1, H } delegate void D(ref int x, out string y); }",
        "record P(int X, string? Y = null) { public required int Z { get; init; } = 3; }\nrecord struct Q(double A);\ninterface I { int M() => 3; static abstract int N(); }",
        'var x = a is { Length: > 3 and < 9 } s && o is not null ? (int)b : c?.D?[2] ?? throw new E("}");\nvar y = z switch { 1 or 2 => "a", int n when n > 3 => $"{n:N2} {{x}} {f("q")}", [1, .., var q] => null, (_, { A: 1 }) => "t", _ => default };',
        'await foreach (var (k, v) in M<int, List<string>>(x)) { yield return k; }\nusing var f = new Foo { A = 1, ["k"] = { 2, 3 } };\nfor (int i = 0, j = 1; i < 3; i++, j--) ;\nint Local<T>(T a) => 1;\nvar g = from q in xs where q.A > 1 orderby q.B descending select new { q.A, B = 2 };\ngoto end;\nend: return;',
        'Func<int, int> f = static x => x + 1; Action<string> h = async (a, b) => { await a; }; var t = (A: 1, 2); (int a, var b) = t; x = y < z && w > (v); if (a < b) { } var c = typeof(Dictionary<,>); c ??= d >> 2 >>> 1; e >>= 1; var r = xs[^1..]; var s = """raw "{" text"""; var u = @"c:\\d"; char k = \'{\';',
        '#region x\n#if DEBUG\n[assembly: A("b")]\n#endif\n#endregion\nclass C { unsafe void M(int* p) { fixed (byte* q = b) { *p = 1; p->X(); } lock (o) { } checked { } try { } catch (E e) when (e.X) { } finally { } do { } while (true); switch (x) { case 1: case > 2: break; default: return; } } }',
    ],
    "javascript": [
        "", "#!/usr/bin/env node\n'use strict'\nvar a = 1\nlet b = /[/\\]}]+/gi.test(a) ? `x ${a + `${b}`} y` : a / b / 2\n", "import d, { e as f, default as g } from 'm'; import * as n from \"o\"; import('p'); export default class extends A { #x = 1; static { } static async *m(a, { b = 2, ...c }, [d, , e] = []) { yield* f; } get y() { return this.#x } set y(v) { } 'q'() { } [z]() { } }\nexport { a as b }; export * as q from 'r'; export const k = 1;",
        "label: for (const [k, v] of Object.entries(o)) { if (k) continue label; else break }\nfor (var i = 0, n = 3; i < n; i++);\nfor (x in y) z()\ndo { w() } while (v)\nswitch (a) { case 1: default: b() }\ntry { } catch { } finally { }", "const f = async ({ a }, ...r) => ({ ...a, b, 'c': 1, get d() { return 1 }, async *e() { } }), g = x => y => z; (function () { })(); !function () { }(); new (foo())(); new.target; a?.b?.[c]?.(d) ?? e ** 2; x = y ? z : w; if (a) /re/.exec(b); 1_000n; 0x1F; .5e-3; a\n++b", "void 0!==a.b&&(c=a.b(1));if(!d){e.f(2);g=3}for(var p=0;p<j.length;p++)z(j[p],6);",
    ],
    "python": [],
    "json": ['{"a": [1, -2.5e3, true, null, "x\\u00e9\\n"], "b": {}}', " [ ] ", '"x"', "1", "﻿{}"],
    "yaml": ["", "# c\n", "a: 1\nb:\n- x\n- y: 2\n  z: [1, {q: r}]\n", "---\na: |\n  text: [\n   more\nb: >-\n  folded\n...\n---\nc: &x 'it''s'\nd: *x\n", "a: multi\n  line\nb: \"x\n  y\"\n? k\n: v\n", "{a: 1, \"b\": [\n 2]}\n", "url: http://x:80/y#z # note\n"],
    "markdown": ["# anything {{{ <<<<<<<"],
}
BAD = {
    "csharp": ["class A {", "class A { void M() { int x = ; } }", "class A { void M() { F(1, 2; } }", 'class A { string s = "abc; }', "class A { }\n}", "<<<<<<< HEAD\nclass A { }\n=======\nclass B { }\n>>>>>>> x\n", "class A { /* open", "import os\n", "class A { void M() { return return 4 +; } }", "#if X\nclass A { }", "PK\x03\x04\x00"],
    "javascript": ["function f() {", "var a = ;", "f(1, 2;", 'x = "abc', "class A { m( { } }", "let = = 3;", "<!DOCTYPE html>", "a b", "try { }", "`open", "if (a) { } }", "1 = 2;", "=======\n"],
    "python": ["def f(:\n  pass\n", "if x\n  pass\n", "if x:\npass\n", "x = (1,\n", 's = "abc\n', "print 'x'\n", "  x = 1\n", "try:\n  pass\n", "f(a=1, 2)\n", "1 = x\n", "x = 6184f5c\n", "class A:\n    def f(self):\n        x\n      y\n", "f'{'\n", "<<<<<<< HEAD\n"],
    "json": ["", "{", '{"a": 1,}', "{'a': 1}", '{"a" 1}', "[1 2]", "nul", '"a\nb"', "01", "{} {}", '{"a": NaN}', '"\\x"'],
    "yaml": ["a: b: c\n", "a: 1\n b: 2\n", "\ta: 1\n", "a: [1, 2\n", "a: 'x\n", "a: 1\nb\n", "- a\nb: 1\n", "a: @x\n", "a: \"\\d\"\n", "<<<<<<< HEAD\na: 1\n=======\n", "a:\n  - b\n  c: d\n"],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in GOOD.items() for t in ts])
def test_valid(language, text):
    assert faults_of(text, language) == []


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in BAD.items() for t in ts])
def test_invalid(language, text):
    assert faults_of(text, language)


def test_python_agrees_with_its_own_parser():
    import glob
    import sysconfig

    from colligo.llm.syntax.python import Python, refused

    files = sorted(glob.glob(sysconfig.get_paths()["stdlib"] + "/*.py"))
    rng, texts = random.Random(3), []
    for f in rng.sample(files, min(25, len(files))):
        with open(f, encoding="utf-8") as h:
            texts.append(h.read()[:40_000].rsplit("\n", 2)[0] + "\n")
    for t in list(texts):
        lines = t.split("\n")
        k = rng.randrange(len(lines))
        texts.append("\n".join([*lines[:k], lines[k] + rng.choice([" )", " (", " =", "'", ":"]), *lines[k + 1 :]]))
    disagree = [i for i, t in enumerate(texts) if bool(Python(t).parse()) != refused(t)]
    assert len(disagree) <= 1


def test_json_agrees_with_the_library():
    rng = random.Random(4)
    base = json.dumps({"a": [1, 2.5, "x", None, True, {"b": []}], "c": "é\n"})
    for _ in range(400):
        t = list(base)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(t))
            t[k] = rng.choice(["", t[k] * 2, '"', ",", "}", "1", " "])
        t = "".join(t)
        try:
            json.loads(t)
            valid = True
        except ValueError:
            valid = False
        assert (faults_of(t, "json") == []) == valid, t


def test_panic_mode_finds_later_faults_and_first_cause():
    text = "class A {\n  void M() { F(1; }\n  void N() { }\n  void O() { G(2; }\n}\n"
    assert [f.line for f in faults_of(text, "csharp")] == [2, 4]
    for text, language, cause in (("class A {", "csharp", "truncated"), ("a\n<<<<<<< x\n", "javascript", "merge conflict"), ("<html>", "csharp", "other language"), ("x = 'a\n", "python", "open string or comment"), ("PK\x03\x04\x01\x02", "csharp", "binary content"), ("using A;\n", "python", "other language")):
        assert first_cause(text, faults_of(text, language), language) == cause


def test_languages():
    assert language_of("C#", "x.py") == "csharp" and language_of(None, "a\\b.YML") == "yaml" and language_of(None, None) is None and language_of("klingon", "a.js") == "javascript" and language_of(None, "README") is None


def test_deep_nesting_is_not_called_invalid():
    assert faults_of("(" * 3000 + "1" + ")" * 3000 + "\n", "javascript") == []
    assert faults_of("[" * 50_000 + "]" * 50_000, "json") == []
    ast.parse("x = 1")


@pytest.mark.parametrize("language,before", [("javascript", "var x = ;\n"), ("javascript", "<<<<<<< ours\n"), ("csharp", "class A { int = ; }\n"), ("python", "x = = 1\n")])
def test_faults_before_deep_nesting_are_kept(language, before):
    open_, close, end = {"csharp": ("{", "}", ("class B { void C() ", "}\n")), "python": ("[", "]", ("y = ", "\n")), "javascript": ("{", "}", ("", "\n"))}[language]
    open_, close = open_ * 5000, close * 5000
    deep = end[0] + open_ + close + end[1]
    assert faults_of(deep, language) == []
    assert [f.line for f in faults_of(before + deep, language)][:1] == [1]
    assert faults_of(end[0] + open_, language) and faults_of(end[0] + open_ + close[1:] + ")" + end[1], language)


def test_too_deep_without_a_fault_is_not_judged(spark):
    df = spark.createDataFrame([(1, "r", "js", "a.js", "{" * 5000 + "}" * 5000), (2, "r", "js", "a.js", "x = 1")], "file_id bigint, repo string, language string, path string, raw_text string")
    checked = check_syntax(df)
    assert {r["file_id"]: (r["valid"], r["first_cause"]) for r in checked.collect()} == {1: (None, "not judged"), 2: (True, None)}
    row = rates(checked).first()
    assert (row["files"], row["invalid_files"], row["not_judged_files"], row["acceptance"]) == (2, 0, 1, 1.0)
    assert check_syntax(df, only_invalid=True).count() == 0


def test_deep_flow_collections():
    assert faults_of("[" * 3000 + "]" * 3000 + "\n", "yaml") == [] and faults_of("[" * 3000 + "]" * 2999 + "\n", "yaml")
    assert faults_of("[" * 3000 + "\n", "yaml")


def test_operator(spark):
    rows = [(1, "r", "CSharp", "a.cs", "class A {"), (2, "r", None, "a.py", "x = 1\n"), (3, "r", "json", "a.json", ""), (4, "s", None, "a.bin", "((("), (5, "s", "Markdown", None, "((("), (6, "s", "py", None, None), (1, "r", "CSharp", "a.cs", "class A {"), (None, None, "js", "a.js", "var x = ;")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "file_id bigint, repo string, language string, path string, raw_text string, valid string")
    got = {r["file_id"]: (r["language"], r["valid"]) for r in check_syntax(df).collect()}
    assert got == {1: ("csharp", False), 2: ("python", True), 3: ("json", False), 4: (None, True), 5: ("markdown", True), None: ("javascript", False)}
    assert check_syntax(df, only_invalid=True).count() == 4 and check_syntax(df.limit(0)).count() == 0
    assert {(r["repo"], r["language"]): (r["files"], r["invalid_files"]) for r in rates(check_syntax(df)).collect()}["r", "csharp"] == (2, 2)
