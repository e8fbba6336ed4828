"""Sources on small fixtures of our own."""

import json

import pytest

from colligo import Catalog, Engine
from colligo.sources import register_all
from colligo.sources.markdown import fence_blocks, headings, links, sections
from colligo.sources.projects import discover
from colligo.sources.text import lines_of, regions_of
from colligo.sources.typespec import http_graph, parse_specs

CS = '''using System;
using Lib.Core;
[assembly: InternalsVisibleTo("Other")]
namespace A.B
{
    /// <summary>Doc.</summary>
    [Serializable]
    public sealed class Cat : Animal, Lib.IPet
    {
        private readonly int _n = 3;
        public string Name { get; set; }
        public event EventHandler Moved;
        public Cat(string name = "x") : base(name) { Init(name, 1); }
        public static async Task<int> RunAsync(List<string> items, params int[] rest)
        {
            var x = await client.GetAsync("u", items[0]);
            if (x > 3) { throw new InvalidOperationException("bad"); } else { Log.Write("no; {"); }
            try { Do(); } catch (Exception ex) { throw; } catch (IOException) { Note(); }
            foreach (var i in items) Console.WriteLine(i);
            return x;
        }
        #region inner
        private void Quiet() => Log.Write("q");
        #endregion
        public enum Mood { Good, Bad = 3 }
    }
    internal struct Point { public int X; }
    public interface IPet { void Pet(); }
}
'''
PY = '''"""Doc."""
import os, sys as s
from a.b import c

class Calc(Base):
    """Adds."""
    total: int = 0

    def __init__(self, n=1, *args, key: str = "k", **more):
        self.n = n

    @staticmethod
    async def _add(a: int, b: "int") -> int:
        try:
            print(a, end="")
        except (ValueError, KeyError):
            raise
        except:
            pass
        return a + b

    class Inner:
        pass
'''
JS = '''import x from "y";
export class App extends Base {
  constructor(a, b = 2) { super(a); this.a = a; }
  async run(items) {
    const got = await this.load(items);
    if (got) { console.log("x"); } else { throw new Error("no"); }
    try { eval("1"); } catch (e) { debugger; }
    for (const i of items) { alert(i); }
  }
  static make() { return new App(1); }
}
class Hidden {}
function free() { return call(1, 2); }
'''


@pytest.fixture(scope="module")
def code_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("code")
    for name, text in (("src/Cat.cs", CS), ("py/calc.py", PY), ("js/app.js", JS), ("docs/read.md", "# T\n"), ("data.json", json.dumps([{"name": "a", "age": 42}, {"name": "b", "age": 7}]))):
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    (root / "empty").mkdir()
    (root / "node_modules" / "x").mkdir(parents=True)
    return str(root)


@pytest.fixture(scope="module")
def engine(spark, code_root):
    return Engine(spark, register_all(Catalog(spark), code_root))


def rows(engine, expression):
    return [tuple(r) for r in engine.collection(expression).sorted_rows().collect()]


def test_csharp(engine):
    assert rows(engine, "csharp.Types.Select({n = Name, k = Kind, m = Modifiers, b = BaseTypes, l = Line})") == [("Cat", "Class", 33, ["Animal", "Lib.IPet"], 8), ("Point", "Struct", 8, [], 27), ("IPet", "Interface", 1, [], 28)]
    assert rows(engine, "csharp.Types.First(Name == 'Cat').Methods.Name") == [("RunAsync",), ("Quiet",)]
    cat = engine.collection("csharp.Types").rows().where("Name = 'Cat'").first()
    assert cat["Constructors"][0]["Parameters"][0]["Defaulted"] and cat["Constructors"][0]["Name"] == ".ctor" and cat["Documented"] and cat["Decorators"] == ["Serializable"] and cat["NestedTypes"] == ["Mood"]
    assert [(f["Name"], f["Type"]["name"]) for f in cat["Fields"] + cat["Properties"] + cat["Events"]] == [("_n", "int"), ("Name", "string"), ("Moved", "EventHandler")]
    run = cat["Methods"][0]
    assert run["Modifiers"] == 1 | 16 | 256 and run["ReturnType"]["name"] == "Task" and run["ReturnType"]["generic"] and run["Parameters"][1]["Variadic"]
    got = rows(engine, "csharp.Statements.Select({k = Kind, t = TypeName, m = MemberName, a = Arguments, l = Line})")
    assert ("call", "client", "GetAsync", ['"u"', "items[0]"], 16) in got and ("await", None, None, [], 16) in got and ("declaration", None, "x", [], 16) in got
    assert ("throw", "InvalidOperationException", None, ['"bad"'], 17) in got and ("call", "Log", "Write", ['"no; {"'], 17) in got and ("call", "Console", "WriteLine", ["i"], 19) in got and ("using", "Lib.Core", None, [], 2) in got and ("attribute", "InternalsVisibleTo", None, ["Other"], 3) in got
    catches = rows(engine, "csharp.Statements.Where(ErrorHandler).Select({t = TypeName, g = Generic, r = Rethrows})")
    assert catches == [("Exception", True, True), ("IOException", False, False)]
    assert rows(engine, "csharp.Statements.Where(MemberName == 'Write' && Ancestors:any(item.Kind == 'else')).Select({l = Line})") == [(17,)]
    assert rows(engine, "csharp.Regions.Select({n = Name, s = StartLine, e = EndLine})") == [("inner", 22, 24)]
    assert ("Property", "Cat", "Name", "string Name") in rows(engine, "csharp.Api.Select({k = Kind, t = TypeName, m = MemberName, s = Signature})")
    assert rows(engine, "csharp.Types.Where(Methods:any(item.Name:endsWith('Async'))).Name") == [("Cat",)]


def test_python(engine):
    assert rows(engine, "python.Types.Select({n = Name, b = BaseTypes, d = Documented})") == [("Calc", ["Base"], True)]
    calc = engine.collection("python.Types").rows().first()
    assert [p["Name"] for p in calc["Constructors"][0]["Parameters"]] == ["self", "n", "args", "key", "more"] and calc["Methods"][0]["Modifiers"] == 2 | 16 | 256 and calc["NestedTypes"] == ["Inner"]
    got = rows(engine, "python.Statements.Select({k = Kind, t = TypeName, m = MemberName, g = Generic, r = Rethrows})")
    assert ("using", "os", None, False, False) in got and ("using", "a.b", None, False, False) in got and ("call", None, "print", False, False) in got and ("catch", "ValueError", None, False, True) in got and ("catch", None, None, True, False) in got


def test_javascript(engine):
    assert rows(engine, "javascript.Types.Select({n = Name, m = Modifiers, b = BaseTypes})") == [("App", 1, ["Base"]), ("Hidden", 0, [])]
    got = rows(engine, "javascript.Statements.Select({k = Kind, t = TypeName, m = MemberName})")
    for want in (("call", "this", "load"), ("call", "console", "log"), ("throw", "Error", None), ("call", None, "eval"), ("call", None, "debugger"), ("call", None, "alert"), ("declaration", None, "got"), ("call", None, "call")):
        assert want in got, want


def test_aggregates_paths_and_files(engine, code_root):
    assert {r[0] for r in rows(engine, "Code.Types.Name")} == {"Cat", "Point", "IPet", "Calc", "App", "Hidden"}
    assert rows(engine, f"Code([csharp, python], '{code_root}').Types.Count") == [(4,)]
    assert rows(engine, f"python.Types('{code_root}/py').Name") == [("Calc",)]
    engine.load("type Person = { name : string, age : int }\n")
    assert rows(engine, f"Parse('{code_root}/data.json', [Person]):age:gt(18).name") == [("a",)]
    with pytest.raises(TypeError):
        engine.collection("Parse('x.unknown', [Person])")


def test_json_needs_an_array(spark, tmp_path):
    from colligo.sources.json_source import read_json

    (tmp_path / "o.json").write_text('{"a": 1}')
    with pytest.raises(ValueError):
        read_json(spark, str(tmp_path / "o.json"))


def test_filesystem(engine):
    got = {r[0]: r[1:] for r in rows(engine, "filesystem.Folders.Select({p = Path, e = Empty, f = FileCount, s = SubfolderCount, d = Depth})")}
    assert got["empty"] == (True, 0, 0, 0) and got["src"] == (False, 1, 0, 0) and "node_modules" not in got
    files = {r[0]: r[1:] for r in rows(engine, "filesystem.DiskFiles.Select({p = Path, x = Extension, f = Folder, d = Depth})")}
    assert files["data.json"] == (".json", "", 0) and files["src/Cat.cs"] == (".cs", "src", 1)
    assert rows(engine, "filesystem.DiskFiles.Where(Depth < 1).Path") == [("data.json",)]


MD = "# One\ntext [a](u1) and [b](u2)\n```python tag=1\n# not\n[c](u3)\n```\n## Two ##\n![img](u4) [d](u5)\n~~~\nopen\n### Three"


def test_markdown(spark):
    df = spark.createDataFrame([(1, MD), (2, None), (3, "")], "id bigint, text string")
    get = lambda f: [tuple(r) for r in f(df, ["id"]).sorted_rows().collect()]
    assert get(headings) == [(1, "One", 1, 1), (1, "Two", 2, 7)]
    assert [r[1:4] for r in get(links)] == [("u1", "a", 2), ("u2", "b", 2), ("u5", "d", 8)]
    assert [(r[1], r[2], r[4], r[5]) for r in get(sections)] == [("One", 1, 1, 6), ("Two", 2, 7, 11)]
    blocks = get(fence_blocks)
    assert [(r[1], r[2], r[3], r[4], r[5]) for r in blocks] == [("python", "tag=1", 3, 6, "# not\n[c](u3)"), (None, None, 9, 11, "open\n### Three")]


def test_lines_and_regions(spark):
    df = spark.createDataFrame([(1, "a\r\nb\rc"), (2, ""), (3, None)], "id bigint, t string")
    assert [tuple(r) for r in lines_of(df, "t", ["id"]).sorted_rows().collect()] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "")]
    nested = spark.createDataFrame([(1, "#region A\nx\n  #region B\ny\n  #endregion\n#endregion\n#region open")], "id bigint, t string")
    assert [tuple(r)[:5] for r in regions_of(nested, "t", ["id"]).sorted_rows().collect()] == [(1, "B", 3, 5, "y"), (1, "A", 1, 6, "x\n  #region B\ny\n  #endregion")]


def test_projects(spark):
    manifests = [("a/A.csproj", '<Project><PropertyGroup><AssemblyName>Alpha</AssemblyName></PropertyGroup><ItemGroup><ProjectReference Include="..\\b\\B.csproj"/></ItemGroup></Project>'), ("b/B.csproj", "<Project/>"), ("j/package.json", '{"name": "jay", "dependencies": {"x": "1"}, "devDependencies": {"y": "2"}}'), ("p/pyproject.toml", '[project]\nname = "pea"\ndependencies = ["q>=1"]\n'), ("p/setup.py", "setup(name='no')"), ("q/setup.py", "setup(name='cue')"), ("p/x.txt", ""), (None, None), ("k/package.json", None)]
    found = sorted(tuple(r[c] for c in ("Name", "Path", "Language", "References")) for r in discover(spark.createDataFrame(manifests, "Path string, Text string")).collect())
    assert found == [("Alpha", "a/A.csproj", "csharp", ["B"]), ("B", "b/B.csproj", "csharp", []), ("cue", "q/setup.py", "python", []), ("jay", "j/package.json", "javascript", ["x", "y"]), ("k", "k/package.json", "javascript", []), ("pea", "p/pyproject.toml", "python", ["q"])]


SPEC = '''
import "@typespec/http";
using Http;
@service(#{ title: "Shop" }) namespace Shop;
model Item { @key itemId: string; name?: string = "x"; }
model Error { code: int32; }
enum Color { red, blue: "b" }
union Either { one: string, two: int32 }
scalar Id extends string;
@route("/shops") namespace Shops { @get op list(@query top?: int32): Item[] | Error; @put op replace(@path id: string, @body item: Item): Item; op plain(): void; }
@route("/things") interface Ops<T> { @get op all(): T[]; @delete op drop(@path id: string): void | Error; }
interface Things extends Ops<Item> {}
@autoRoute interface Auto<T> { @get op all(): T[]; @get op read(itemId: string): T; }
interface Items extends Auto<Item> {}
'''


def test_typespec(spark, tmp_path):
    graph = parse_specs([SPEC])
    assert [len(graph.rows[k]) for k in ("Models", "Interfaces", "Enums", "Unions", "Scalars", "Namespaces")] == [2, 4, 1, 1, 1, 2]
    assert graph.rows["Models"][0]["Properties"][1] == {"Name": "name", "Type": "string", "Optional": True, "Default": '"x"', "Decorators": []}
    http = http_graph(graph)
    got = {(o["Interface"], o["Name"]): (o["Verb"], o["Path"], [(p["Name"], p["In"]) for p in o["Parameters"]], [r["StatusCode"] for r in o["Responses"]]) for o in http["Operations"]}
    assert got == {
        (None, "list"): ("get", "/shops", [("top", "query")], ["200", "default"]), (None, "replace"): ("put", "/shops/{id}", [("id", "path"), ("item", "body")], ["200"]),
        ("Things", "all"): ("get", "/things", [], ["200"]), ("Things", "drop"): ("delete", "/things/{id}", [("id", "path")], ["204", "default"]), ("Items", "all"): ("get", "/items", [], ["200"]), ("Items", "read"): ("get", "/items/{itemId}", [("itemId", "path")], ["200"]),
    }
    (tmp_path / "a.tsp").write_text(SPEC)
    e = Engine(spark, register_all(Catalog(spark), str(tmp_path)))
    assert rows(e, "typespec-http.Operations.Where(Verb == 'put').Path") == [("/shops/{id}",)]
    assert rows(e, "typespec.Models.Where(Properties:any(item.Decorators:any(item.Name == 'key'))).Name") == [("Item",)]
    assert rows(e, "typespec-http.Services.Select({n = Name, c = Operations.Count})") == [("Things", 2), ("Items", 2), ("Shops", 2)]


def test_routes_of_interfaces_and_namespaces():
    spec = """
model Person { @key id: string; }
model Child extends Person { age: int32; }
@route("/v1") namespace V {
  @route("/own") interface A { @get op one(): Person; }
  interface B { @get op two(): Person; }
  @autoRoute interface C { @get op read(Id: string): Child[]; @get op all(): Child[]; }
  @autoRoute @route("/said") interface D { @get op all(): Person[]; }
}
"""
    got = {(o["Interface"], o["Name"]): o["Path"] for o in http_graph(parse_specs([spec]))["Operations"]}
    assert got == {("A", "one"): "/own", ("B", "two"): "/v1", ("C", "read"): "/children/{Id}", ("C", "all"): "/children", ("D", "all"): "/said"}


def test_python_that_does_not_parse_gives_what_does():
    from colligo.sources.code import parse_python

    text = "import a\n\nclass A:\n    def good(self):\n        print(1)\n\n    def bad(self:\n        x = = 1\n\n    def last(self):\n        print(2)\n\ndef f(\n\nclass B:\n    pass\n<<<<<<< x\nprint(3)\n"
    made = parse_python(text)
    assert [(t["Name"], t["Line"], [m["Name"] for m in t["Methods"]][:1]) for t in made["types"]] == [("A", 3, ["good"]), ("B", 15, [])]
    assert "last" in [m["Name"] for t in made["types"] for m in t["Methods"]] and [s["Line"] for s in made["statements"] if s["Kind"] == "call"] == [5, 11, 18]
    assert parse_python("")["types"] == [] and parse_python("((((")["types"] == []


def test_excluded_folders_whatever_their_case(spark, tmp_path):
    from colligo.sources import filesystem

    for folder in ("src/deep/deeper", "Packages/x", "TESTRESULTS", "src/BUILD", ".next", "venv/lib"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "a.txt").write_text("x")
    found = filesystem.source(spark, str(tmp_path), ["Folders", "DiskFiles"])
    assert sorted(r[0] for r in found["Folders"].rows("Path").collect()) == ["src", "src/deep", "src/deep/deeper", "venv", "venv/lib"]
    assert sorted(tuple(r) for r in found["DiskFiles"].rows("Path", "Depth").collect()) == [("src/deep/deeper/a.txt", 3), ("venv/lib/a.txt", 2)]


def test_languages_by_extension(spark):
    from pyspark.sql import functions as F

    from colligo.sources.text import language_of

    df = spark.createDataFrame([("x.sln",), ("a/.editorconfig",), ("a\\\\b.MD",), ("noext",)], "p string")
    assert [r[0] for r in df.select(language_of(F.col("p"))).collect()] == ["text", "editorconfig", "markdown", None]


def test_csharp_statements_of_all_kinds():
    from colligo.sources.code import parse_csharp

    text = """class A {
  void M() {
    using var held = Open();
    await foreach (Item one in Stream()) { Use(one); }
    for (int i = 0; i < 3; i++) Loop(i);
    for (;;) { break; }
    switch (mode) { case 1: One(); break; default: throw failed; }
    await using (var s = Open2()) { s.Read(); }
    throw new System.Exception("x");
  }
}
"""
    got = [(s["Line"], s["Kind"], s["TypeName"], s["MemberName"], s["Condition"], s["Expression"]) for s in parse_csharp(text)["statements"]]
    assert got == [
        (3, "declaration", None, "held", None, "Open()"), (3, "call", None, "Open", None, "Open()"), (4, "foreach", "Item", "one", "Stream()", None), (4, "call", None, "Use", None, "Use(one)"),
        (5, "for", None, None, "i < 3", None), (5, "call", None, "Loop", None, "Loop(i)"), (6, "for", None, None, None, None), (7, "switch", None, None, None, "mode"), (7, "call", None, "One", None, "One()"), (7, "throw", None, None, None, "failed"),
        (8, "using", None, None, None, "var s = Open2()"), (8, "call", "s", "Read", None, "s.Read()"), (9, "throw", "System.Exception", None, None, 'new System.Exception("x")'),
    ]
