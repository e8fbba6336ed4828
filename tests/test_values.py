"""One test per rule of the value semantics, on rows where plain SQL would differ."""

import pytest
from pyspark.sql import functions as F

from colligo.collection import Collection
from colligo.functions import values as V


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, "Foo", 0, 0.0, False, ["a", None, "B"], "12"), (2, None, None, None, None, None, "x"), (3, "", 5, 2.5, True, [], None), (4, "FOO", 7, 3.0, True, ["b"], "-3.5"), (5, "foo_bar", -1, -1.5, False, ["x", "Y", "x"], ""),
    ]
    return Collection.of(spark.createDataFrame(rows, "id bigint, s string, i bigint, d double, b boolean, xs array<string>, t string"), "Item", ["id"])


def ids(c):
    return [r["id"] for r in c.sorted_rows().collect()]


def values(c, expression):
    return [r[0] for r in c.select(expression).sorted_rows().collect()]


@pytest.mark.parametrize("expression,expected", [
    ("s == 'foo'", [1, 4]), ("s != 'foo'", [2, 3, 5]), ("s:equals('FOO')", [1, 4]), ("!s:equals('foo')", [2, 3, 5]), ("s:notEquals('foo')", [3, 5]), ("s == nic", [2]), ("s != nic", [1, 3, 4, 5]),
    ("s:startsWith('f')", [1, 4, 5]), ("s:!startsWith('f')", [2, 3]), ("s:endsWith('BAR')", [5]), ("s:contains('O_B')", [5]), ("s:containsAny(['' 'bar'])", [5]), ("s:matches('^F')", [1, 4]), ("s:sameAs('FooBar')", [5]), ("s:empty", [3]),
    ("s:in(['FOO' 'x'])", [1, 4]), ("s:!in(['foo'])", [2, 3, 5]), ("i < 3", [1, 2, 5]), ("i > 3", [3, 4]), ("i <= 0", [1, 2, 5]), ("i >= 0", [1, 2, 3, 4]), ("t > 0", [1]), ("t < 0", [4]), ("i == 5", [3]), ("i:equals(5)", [3]), ("i:greaterThan(0)", [3, 4]), ("i:!greaterThan(0)", [1, 2, 5]), ("d == 3", [4]),
    ("b", [3, 4]), ("!b", [1, 2, 5]), ("s", [1, 3, 4, 5]), ("i", [1, 3, 4, 5]), ("b == 'true'", [3, 4]), ("i:isSet(4)", [3, 4, 5]), ("i:isClear(4)", [1]), ("(i & 1) == 1", [3, 4, 5]), ("(i | 1) == 1", [1, 2]),
    ("xs:contains('b')", [1, 4]), ("xs:any(item == 'x')", [5]), ("xs:none(item == 'x')", [1, 2, 3, 4]), ("xs:all(item.Length == 1)", [1, 2, 3, 4, 5]), ("xs:empty", [3]), ("xs.Count == 3", [1, 5]), ("b && i > 5", [4]), ("b || i < 0", [3, 4, 5]),
])
def test_predicates(items, expression, expected):
    assert ids(items.where(expression)) == expected


@pytest.mark.parametrize("expression,expected", [
    ("s", ["Foo", "", "", "FOO", "foo_bar"]), ("s + '!'", ["Foo!", "!", "!", "FOO!", "foo_bar!"]), ("'n' + i", ["n0", "n", "n5", "n7", "n-1"]), ("i + 1", [1, 1, 6, 8, 0]), ("i - 1", [-1, -1, 4, 6, -2]), ("i + d", [0.0, 0.0, 7.5, 10.0, -2.5]),
    ("Text(s)", ["Foo", "null", "", "FOO", "foo_bar"]), ("Text(b)", ["false", "null", "true", "true", "false"]), ("Text(xs)", ["[a, null, B]", "null", "[]", "[b]", "[x, Y, x]"]), ("s.Length", [3, None, 0, 3, 7]), ("s.Upper", ["FOO", "", "", "FOO", "FOO_BAR"]), ("s.Words", [["foo"], None, [], ["foo"], ["foo", "bar"]]),
    ("xs.Count", [3, 0, 0, 1, 3]), ("xs.First", ["a", "", "", "b", "x"]), ("xs.Last", ["B", "", "", "b", "x"]), ("xs.Single", ["", "", "", "b", ""]), ("xs.ElementAt(1)", ["", "", "", "", "Y"]), ("xs.Where(item == 'x')", [[], None, [], [], ["x", "x"]]), ("xs.Select(item.Upper)", [["A", "B"], None, [], ["B"], ["X", "Y", "X"]]),
    ("xs.Distinct(item)", [["a", "B"], [], [], ["b"], ["x", "Y"]]), ("xs.OrderByDescending(item)", [["B", "a"], [], [], ["b"], ["Y", "x", "x"]]), ("xs.Sum(item.Length)", [2, 0, 0, 1, 3]), ("xs.Max(item.Length)", [1, 0, 0, 1, 1]), ("xs.Average(item.Length)", [1.0, 0.0, 0.0, 1.0, 1.0]), ("xs.Reduce('+', item, '-')", ["a-B", "", "", "b", "x-Y-x"]),
    ("i > 5 ? 'big' | i > 0 ? 'mid' | 'low'", ["low", "low", "mid", "big", "low"]), ("s ? 'foo' => 1 | '' => 2 | _ => 3", [1, 3, 2, 1, 3]), ("s ? 'foo' => 'one'", ["one", "", "", "one", ""]), ("s:Replace('O', '0')", ["F00", "", "", "F00", "f00_bar"]), ("s:Trim('_BAR')", ["Foo", "", "", "FOO", "foo"]), ("(xs + 'z').Last", ["z", "", "z", "z", "z"]),
])
def test_projections(items, expression, expected):
    assert values(items, expression) == expected


@pytest.mark.parametrize("text,expected", [("TaskCompletionSource", ["task", "completion", "source"]), ("taskCompletionSource", ["task", "completion", "source"]), ("task-completion_source", ["task", "completion", "source"]), ("TASK_COMPLETION", ["task", "completion"]), ("HTTPClient", ["http", "client"]), ("__init__", ["init"]), ("XMLHttpRequest2Go", ["xml", "http", "request2", "go"]), ("", [])])
def test_words(spark, text, expected):
    assert spark.createDataFrame([(text,)], "s string").select(V.words(V.Val(F.col("s"), V.STRING)).col).first()[0] == expected


def test_aggregates_count_null_as_zero(items):
    row = items.aggregate(s="Items.Sum(i)", lo="Items.Min(i)", hi="Items.Max(d)", mean="Items.Average(d)", n="Count").first()
    assert tuple(row) == (11, -1, 3.0, 0.8, 5)
    row = items.where("id > 99").aggregate(s="Items.Sum(i)", lo="Items.Min(i)", mean="Items.Average(d)", n="Count").first()
    assert tuple(row) == (0, 0, 0.0, 0)


def test_group_keys_ignore_case_and_keep_first_form(items):
    rows = items.group_by("s").select_record(k="Key", n="Count", ids="Items.Select(id)").sorted_rows().collect()
    assert [(r["k"], r["n"], r["ids"]) for r in rows] == [("Foo", 2, [1, 4]), ("", 2, [2, 3]), ("foo_bar", 1, [5])]


def test_distinct_keeps_first_item(items):
    assert ids(items.distinct("s")) == [1, 2, 5]
    assert ids(items.order_by("id", descending=True).distinct("s")) == [5, 4, 3]


def test_order_is_stable_and_case_free(items):
    assert ids(items.order_by("s")) == [2, 3, 1, 4, 5]
    assert ids(items.order_by("i", descending=True)) == [4, 3, 1, 2, 5]


def test_positions(items):
    assert ids(items.first()) == [1] and ids(items.last("b")) == [4] and ids(items.single("s == 'foo_bar'")) == [5]
    assert ids(items.single("s == 'foo'")) == [] and ids(items.element_at(2)) == [3] and ids(items.element_at(9)) == []


def test_union_keeps_order_and_repeats(items):
    assert ids(items.where("b") + items.where("i < 1")) == [3, 4, 1, 2, 5]


def test_subtraction_minds_case_and_keeps_missing(spark):
    c = Collection.of(spark.createDataFrame([(1, "a"), (2, "A"), (3, None)], "id bigint, Source string"), "X", ["id"])
    assert ids(c.without_sources(["a"])) == [2, 3]


def test_patterns_without_counterpart_are_refused(items):
    with pytest.raises(V.RuleTypeError):
        items.where("s:matches('(?<-x>a)')")


def test_numeric_filter_reaches_the_scan(spark, sf):
    from tests.conftest import plan_of

    c = Collection.of(spark.read.parquet(f"{sf}/orders.parquet"), "Order", ["o_orderkey"])
    plan = plan_of(c.where("o_totalprice > 300000").select("o_orderkey").rows())
    assert "GreaterThan(o_totalprice" in plan and "o_orderpriority" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_empty_collection(items):
    none = items.where("id > 99")
    assert ids(none) == [] and ids(none.distinct("s")) == [] and none.group_by("s").collect().rows().count() == 0


def test_pretty_json(spark):
    from colligo.functions import types as K
    from colligo.functions.values import Val, pretty_json

    df = spark.createDataFrame([(1, 2.5, None, "a\"b\\c\n", [], [("x", None)], True)], "i bigint, d double, n string, s string, e array<int>, l array<struct<k:string,v:bigint>>, b boolean")
    ty = K.from_spark(df.schema)
    item = F.struct(*df.columns)
    import json

    text = df.select(pretty_json(Val(item, ty)).alias("x")).first()[0]
    assert json.loads(text) == {"i": 1, "d": 2.5, "n": None, "s": "a\"b\\c\n", "e": [], "l": [{"k": "x", "v": None}], "b": True}
    assert text.split("\n")[:3] == ["{", '    "i": 1,', '    "d": 2.5,'] and '            "k": "x",' in text.split("\n")
