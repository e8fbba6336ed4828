"""The rule language: parsing, declarations, commands, correlation."""

import pytest

from colligo import AmbiguousCollection, Catalog, Collection, Engine
from colligo.functions.values import RuleTypeError
from colligo.lang.ast import Binary, Conditional, Filter, Literal, Match, Member, Name
from colligo.lang.parser import parse_expression, parse_script
from colligo.lang.planner import UnknownName, glob_pattern
from colligo.lang.template import parts_of
from colligo.lang.tokenizer import RuleSyntaxError, tokenize


def test_tokens():
    kinds = [(t.kind, t.value) for t in tokenize("a-b 'x\\n' @'it''s' '''r\\n''' 1 2.5 => # note\n//more\nz")]
    assert kinds[:-1] == [("name", "a-b"), ("text", "x\n"), ("text", "it's"), ("text", "r\\n"), ("int", "1"), ("number", "2.5"), ("mark", "=>"), ("name", "z")]
    assert [t.value for t in tokenize("#\nhidden 'open\n#\nseen")][:-1] == ["seen"]
    with pytest.raises(RuleSyntaxError):
        tokenize("'never closed")


def test_precedence():
    assert parse_expression("a + b == c && d || e") == Binary("||", Binary("&&", Binary("==", Binary("+", Name("a"), Name("b")), Name("c")), Name("d")), Name("e"))
    assert parse_expression("a | b & c") == Binary("|", Name("a"), Binary("&", Name("b"), Name("c")))
    assert parse_expression("x ? 1 | 2") == Conditional(Name("x"), Literal(1), Literal(2))
    assert isinstance(parse_expression("x ? 'a' => 1 | _ => 2"), Match)
    assert parse_expression("C:p:!q(1).N") == Member(Filter(Filter(Name("C"), "p"), "q", (Literal(1),), True), "N")
    assert parse_expression("x:ct('a')").name == "contains"
    with pytest.raises(RuleSyntaxError):
        parse_expression("a == b == c")
    with pytest.raises(RuleSyntaxError):
        parse_expression("{a = 1, A = 2}")


def test_script_shapes():
    s = parse_script("import base\ntype A = { N : string, L : [int]?, }\ntype B = A & { M : bool }\nflags F = X | Y\ncollection Cs : [A]\nexport let a = Cs:p\npredicate p(A:q) : B => A.N == 'x'\nfunction f(A:N:equals('y'), m:string) => B { N = m }\ncommand go(c) = foreach c => '{item.N}' & other\nforeach Cs => 'x' => file.Write('o')\nRUN go(Cs)\n'bye'")
    assert s.imports == ["base"] and [t.name for t in s.types] == ["A", "B"] and s.types[1].base == "A" and s.exported == {"a"}
    assert s.predicates[0].guard[0].name == "q" and s.predicates[0].narrowed == "B" and s.functions[0].guard[1].name == "equals" and s.functions[0].params == (("A", "A"), ("m", "string"))
    assert s.commands[0].params == ("c",) and len(s.commands[0].parts) == 2 and len(s.statements) == 3


def test_templates():
    assert parts_of("{{a}} {b.c@red} \\@ {") == (("{a} ", None, None), ("", "b.c", "red"), (" @ {", None, None))


def test_globs():
    import re

    assert re.match(glob_pattern("**/test/*.cs"), "a/b/test/X.cs") and re.match(glob_pattern("**/test/*.cs"), "test/X.cs") and not re.match(glob_pattern("**/test/*.cs"), "test/a/X.cs")
    assert re.match(glob_pattern("**/Tests/**"), "src/Tests/Foo.cs") and re.match(glob_pattern("**/Tests/**"), "Tests/Foo.cs") and not re.match(glob_pattern("**/Tests/**"), "src/tests/Foo.cs")
    assert re.match(glob_pattern("src/**/*.cs"), "src/a.cs") and re.match(glob_pattern("src/"), "src") and not re.match(glob_pattern("src/*.cs"), "src/a/b.cs") and not re.match(glob_pattern("*.CS"), "a.cs")


TYPES = """
type Method = { Name : string, Line : int, Parameters : [string] }
type Type = { Name : string, Kind : string, Modifiers : int, Methods : [Method] }
flags Modifier = Public | Private | Static
predicate isPublic(Type) => Type.Modifiers:isSet(Public)
predicate named(Type:isPublic) => Type.Name:startsWith('A')
predicate named(Type) => Type.Name:startsWith('B')
predicate wordy(Method) => Method.Name.Words.Count > 1
predicate sealed(Type) : Sealed => Type.Kind == 'sealed'
function label(Type:Kind:equals('class'), s:string) => 'class ' + Type.Name + s
function label(Type, s:string) => '{Type.Kind} {Type.Name}' + s
function wrap(a:string, b:string, s:string) => a + s + b
let dots = wrap('<', '>')
"""


@pytest.fixture
def engine(spark):
    rows = [(1, "Ab", "class", 1, [("GetAll", 3, ["x"]), ("Run", 9, [])]), (2, "Ba", "struct", 2, [("Stop", 4, [])]), (3, "Ac", "class", 2, []), (4, "Bz", "sealed", 5, None)]
    schema = "id bigint, Name string, Kind string, Modifiers bigint, Methods array<struct<Name:string,Line:bigint,Parameters:array<string>>>"
    cat = Catalog(spark)
    cat.register("a", "Types", Collection.of(spark.createDataFrame(rows, schema), "Type", ["id"]))
    cat.register("a", "Bans", Collection.of(spark.createDataFrame([("ab", 1), ("bz", 3)], "Name string, Level int"), "Ban", ["Name"]))
    cat.register("b", "Types", Collection.of(spark.createDataFrame(rows[:1], schema), "Type", ["id"]))
    return Engine(spark, cat, arguments=["-x"]).load(TYPES)


def names(engine, expression):
    return [r["Name"] for r in engine.collection(expression).sorted_rows().collect()]


def test_predicates_overloads_and_flags(engine):
    assert names(engine, "a.Types:isPublic") == ["Ab", "Bz"]
    assert names(engine, "a.Types:!isPublic") == ["Ba", "Ac"]
    assert names(engine, "a.Types:named") == ["Ab", "Ba"]  # the guarded overload decides for public ones
    assert names(engine, "a.Types:Name:endsWith('C')") == ["Ac"]
    assert names(engine, "a.Types.Where(Methods:any(wordy))") == ["Ab"]
    assert names(engine, "a.Types.Where(Methods:none(Method.Line > 3))") == ["Ac", "Bz"]
    assert engine.value("Public | Static") == 5


def test_functions(engine):
    values = lambda e: [r[0] for r in engine.collection(e).sorted_rows().collect()]
    assert values("a.Types:label('!')") == ["class Ab!", "struct Ba!", "class Ac!", "sealed Bz!"]
    assert values("a.Types.Name.Select(dots)") == ["<Ab>", "<Ba>", "<Ac>", "<Bz>"]
    assert values("a.Types.Methods.Name") == ["GetAll", "Run", "Stop"]
    with pytest.raises(RuleTypeError):
        engine.collection("a.Types:!label('!')")


def test_correlation_across_collections_and_levels(engine):
    assert names(engine, "a.Types.Where(Bans:any(Ban.Name == Type.Name && Ban.Level > 1))") == ["Bz"]
    assert names(engine, "a.Types.Where(!Bans:any(Ban.Name == Type.Name))") == ["Ba", "Ac"]
    assert names(engine, "a.Types.Where(Name:in(Bans.Name))") == ["Ab", "Bz"]
    assert names(engine, "a.Types.Where(Methods:any(Method.Name.Length > Type.Name.Length + 2))") == ["Ab"]
    assert names(engine, "a.Types.Where(Bans.Where(Ban.Name == Type.Name).Count == 0)") == ["Ba", "Ac"]
    with pytest.raises(RuleTypeError, match="element of a list"):
        engine.collection("a.Types.Where(Methods:any(Bans:any(Ban.Name == Method.Name)) || Name == 'x')")


def test_collections_seen_from_list_elements(spark):
    types = spark.createDataFrame([("A", [("Get", ["c"]), ("Get", ["s"]), ("Put", ["c"])]), ("B", [("Get", ["c"])]), ("C", []), ("D", None), ("E", [("Put", None), None]), ("A", [("Get", ["c"]), ("Get", ["s"]), ("Put", ["c"])])], "Name string, Methods array<struct<Name:string,Parameters:array<string>>>")
    verbs = spark.createDataFrame([("Put",), ("put",), ("Post",), (None,)], "Name string")
    c = Catalog(spark)
    c.register("x", "Types", Collection.of(types, "Type", ["Name"]))
    c.register("x", "Verbs", Collection.of(verbs, "Verb", ["Name"]))
    e = Engine(spark, c).load("""
type Method = { Name : string, Parameters : [string] }
type Type = { Name : string, Methods : [Method] }
predicate content(Method) => Method.Parameters:any(item == 'c')
predicate sameName(Method2) => Method2.Name == Method.Name
predicate overloaded(Method) => Method:content && Type.Methods.Where(Parameters:!any(item == 'c')):any(sameName)
predicate verb(Method) => Verbs:any(Verb.Name == Method.Name)
predicate known(Type) => Verbs:any(Verb.Name == Type.Name)
""")
    assert names(e, "Types.Where(Methods:any(overloaded))") == ["A", "A"]
    assert names(e, "Types.Where(Methods:any(verb))") == ["A", "A", "E"]
    assert names(e, "Types.Where(Methods:any(content && Verbs:any(Verb.Name == Method.Name)) && Name != 'x')") == ["A", "A"]
    assert names(e, "Types.Where(!Methods:any(verb))") == names(e, "Types.Where(Methods:none(verb))") == ["B", "C", "D"]
    assert names(e, "Types.Where(Methods:all(verb))") == ["C", "D", "E"]
    assert names(e, "Types.Methods.Where(verb)") == ["Put", "Put", "Put"] and names(e, "Types:known") == []


def test_names(engine):
    with pytest.raises(AmbiguousCollection):
        engine.collection("Types")
    with pytest.raises(UnknownName):
        engine.collection("a.Types.Where(Nothing > 1)")
    with pytest.raises(RuleTypeError, match="circular"):
        engine.load("let p1 = q1\nlet q1 = p1\n").collection("p1")
    assert Engine(engine.spark, engine.catalog, lenient=True).collection("a.Types.Where(Type.Missing == nic)").df.count() == 4


def test_commands_and_assertions(engine, capsys, tmp_path):
    engine.load("""
command list = foreach a.Types:isPublic => '{Type.Name} of {Type.Kind@red}'
command guarded = foreach a.Types => '{Name}' : wants
predicate wants(Program) => Program.Args:contains('-x')
command never = 'no' : unwanted
predicate unwanted(Program) => Program.Args:contains('-y')
command save = foreach a.Types => SAVE('{Kind}.txt', '{Name}')
command both = list & guarded & both
command some(c) = foreach c => '{item.Name}'
ASSERT(a.Types:isPublic, 'public')
ASSERT_EMPTY(a.Types, 'nothing')
SOME(a.Types.Where(id == 2))
""".replace("SOME(", "RUN some("))
    assert engine.run(["list"]).lines() == ["Ab of class", "Bz of sealed"]
    assert engine.run(["both"]).lines() == ["Ab of class", "Bz of sealed", "Ab", "Ba", "Ac", "Bz"]
    assert engine.run(["never"]).lines() == [] and engine.run(["never"]).exit_code == 0
    files = engine.run(["save"]).files
    assert {f.path: f.text for f in files} == {"class.txt": "Ab\nAc\n", "struct.txt": "Ba\n", "sealed.txt": "Bz\n"}
    engine.write_files(engine.run(["save"]), str(tmp_path))
    assert (tmp_path / "class.txt").read_text() == "Ab\nAc\n"
    assert [(a.passed, a.message, a.count) for a in engine.test().assertions] == [(True, "public", 2), (False, "nothing", 4)]
    assert engine.value("[1 2] + [3 4]") is not None and engine.value("([1 2] + 3).Count") == 3
    with pytest.raises(ValueError):
        engine.run(["missing"])


def test_save_stays_inside_the_root(engine):
    engine.load("command out = foreach a.Types => SAVE('../{Name}', 'x')\n")
    with pytest.raises(ValueError, match="inside the root"):
        engine.run(["out"])


def test_checks_and_packages(spark, engine):
    e = Engine(spark, engine.catalog, packages={"base": "type Violation = { Severity : string, Message : string, File : string?, Line : int }\nfunction warn(Type, m:string) => Violation { Severity = 'warning', Message = m, Line = 7 }\n", "rules": "import base\nexport let r1 = a.Types.Where(Kind == 'class'):warn('{Type.Name} is a class')\nexport let r2 = a.Types.Where(Kind == 'struct'):warn('no structs')\n"})
    e.load("import rules\n")
    rows = [(r["Rule"], r["Message"]) for r in e.check().sorted_rows().collect()]
    assert rows == [("r1", "Ab is a class"), ("r1", "Ac is a class"), ("r2", "no structs")]
    assert e.format_violations(e.check()).sorted_rows().first()[0] == "(7): warning: Ab is a class"
    with pytest.raises(ValueError):
        e.load("import unknown\n")


def test_inheritance_and_objects(spark):
    e = Engine(spark).load("type A = { X : int }\ntype B = A & { Y : string }\nlet b = B { X = 1, Y = 'two' }\nlet o = { k = 'v', n = 2 }\n")
    assert e.program.types["B"].bases == ("A",) and [n for n, _ in e.program.types["B"].fields] == ["X", "Y"]
    assert e.value("o.Keys") == ["k", "n"] and e.value("o.Count") == 2 and e.value("o:containsKey('K')") is True and e.value("o.Get('k')") == "v" and e.value("b.Y") == "two"
    with pytest.raises(ValueError):
        e.load("type C = A & { x : string }\n")
    with pytest.raises(ValueError):
        e.load("flags F1 = P | Q\nflags F2 = Q | P\n")


def test_plans_are_joins(spark, sf):
    from colligo.plans import catalogue
    from tests.conftest import plan_of

    for name, kind in (("semi_correlated", "LeftSemi"), ("anti_correlated", "LeftAnti"), ("exists_in_or", "ExistenceJoin")):
        plan = plan_of(catalogue.QUERIES[name](spark, sf))
        assert kind in plan and "CartesianProduct" not in plan, name
    plan = plan_of(catalogue.QUERIES["group_then_aggregate"](spark, sf))
    assert "SortAggregate" not in plan and "ObjectHashAggregate" in plan
    for name, kind in (("any_sublist", "LeftSemi"), ("none_sublist", "LeftAnti"), ("outer_column_in_lambda", "LeftSemi"), ("nested_two_levels", "LeftSemi")):
        plan = plan_of(catalogue.QUERIES[name](spark, sf))
        assert kind in plan and "Aggregate" not in plan, name
    plan = plan_of(catalogue.QUERIES["nested_folds"](spark, sf))
    assert "collect_list" not in plan and plan.count("LeftOuter") == 2 and "SortAggregate" not in plan
    assert "TakeOrderedAndProject" in plan_of(catalogue.QUERIES["order_by_desc_topk"](spark, sf))
