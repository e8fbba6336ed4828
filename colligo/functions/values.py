"""Value semantics of the rule language as Spark columns.

Two-valued logic, text compared without regard to case, numbers coerced without errors: each rule is stated once here and
used by every operator. No Python runs on the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from colligo.functions.types import BOOL, INT, NULL, NUMBER, STRING, Ty, common, list_of, record

NO_CONSTANT = object()


class RuleTypeError(TypeError):
    """A rule that cannot be planned for the types at hand."""


@dataclass(frozen=True)
class Val:
    """A column with its type; ``const`` is its value where that is known at plan time. ``positive`` of a test is a column
    that is true just where the test holds and may be null elsewhere: enough for a filter, and open to the scan."""

    col: Column
    ty: Ty
    const: Any = NO_CONSTANT
    positive: Column | None = None

    @property
    def is_const(self) -> bool:
        return self.const is not NO_CONSTANT


def literal(value: Any) -> Val:
    if value is None:
        return Val(F.lit(None), NULL, None)
    if isinstance(value, bool):
        return Val(F.lit(value), BOOL, value)
    if isinstance(value, int):
        return Val(F.lit(value).cast("bigint"), INT, value)
    if isinstance(value, float):
        return Val(F.lit(value), NUMBER, value)
    if isinstance(value, (list, tuple)):
        items = [literal(v) for v in value]
        return make_list(items)
    return Val(F.lit(str(value)), STRING, str(value))


def make_list(items: list[Val]) -> Val:
    elem = NULL
    for v in items:
        elem = common(elem, v.ty)
    if not items:
        return Val(F.array().cast("array<string>"), list_of(STRING), [])
    cols = [as_text(v) if elem.kind == "string" else v.col for v in items]
    const = [v.const for v in items] if all(v.is_const for v in items) else NO_CONSTANT
    return Val(F.array(*cols), list_of(elem), const)


# truth and equality
def truthy(v: Val) -> Column:
    if v.ty.kind == "bool":
        return F.lit(bool(v.const)) if v.is_const else F.coalesce(v.col, F.lit(False))
    return F.lit(v.const is not None) if v.is_const else v.col.isNotNull()


def boolean(col: Column, positive: Column | None = None) -> Val:
    return Val(col, BOOL, NO_CONSTANT, positive)


def condition(v: Val) -> Column:
    """A value as the condition of a filter, where null and false are one."""
    if v.positive is not None:
        return v.positive
    return v.col if v.ty.kind == "bool" and not v.is_const else truthy(v)


def as_text(v: Val) -> Column:
    """The text of a value as comparisons and concatenations see it; null stays null."""
    if v.ty.kind == "string":
        return v.col
    if v.ty.kind == "bool":
        return F.when(v.col.isNull(), F.lit(None)).when(v.col, F.lit("True")).otherwise(F.lit("False"))
    if v.ty.kind == "number":
        whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15)
        return F.when(whole, v.col.cast("bigint").cast("string")).otherwise(v.col.cast("string"))
    if v.ty.kind == "record" and v.ty.field("text"):
        return v.col[v.ty.field("text")[0]]
    if v.ty.kind in ("record", "list", "map"):
        return F.to_json(v.col)
    return v.col.cast("string")


def lowered(v: Val) -> Column:
    if v.is_const and isinstance(v.const, str):
        return F.lit(v.const.lower())
    return F.lower(as_text(v))


def equal(a: Val, b: Val) -> Column:
    if a.is_const and a.const is None:
        return b.col.isNull()
    if b.is_const and b.const is None:
        return a.col.isNull()
    if a.ty.numeric and b.ty.numeric:
        return a.col.eqNullSafe(b.col)
    if a.ty.kind == "bool" and b.ty.kind == "bool":
        return a.col.eqNullSafe(b.col)
    return lowered(a).eqNullSafe(lowered(b))


def number(v: Val) -> Column:
    """Any value as a number: null and text that is none are 0, booleans 0 or 1."""
    if v.ty.numeric:
        return F.coalesce(v.col, F.lit(0))
    if v.ty.kind == "bool":
        return F.when(F.coalesce(v.col, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    if v.ty.kind == "string":
        return F.coalesce(v.col.try_cast("double"), F.lit(0.0))
    return F.lit(0.0)


def compare(op: str, a: Val, b: Val) -> Column:
    """Ordering of two values as numbers. A bare column against a literal stays bare where 0 does not change the result,
    so that it can reach the scan."""
    def side(v: Val, other: Val) -> Column:
        if v.ty.numeric and other.is_const and isinstance(other.const, (int, float)) and not isinstance(other.const, bool):
            zero = {"<": 0 < other.const, ">": 0 > other.const, "<=": 0 <= other.const, ">=": 0 >= other.const}[op]
            if not zero:  # null, counted as 0, fails: as SQL's null does
                return v.col
        return number(v)

    x, y = side(a, b), number(b)
    out = x < y if op == "<" else x > y if op == ">" else x <= y if op == "<=" else x >= y
    return out


def _bits(v: Val) -> Column:
    if v.ty.kind == "int":
        return F.coalesce(v.col.cast("bigint"), F.lit(0).cast("bigint"))
    if v.ty.kind == "number":
        return F.coalesce(v.col.try_cast("bigint"), F.lit(0).cast("bigint"))
    if v.ty.kind == "bool":
        return number(v).cast("bigint")
    return F.coalesce(v.col.try_cast("bigint"), F.lit(0).cast("bigint")) if v.ty.kind == "string" else F.lit(0).cast("bigint")


def bit_and(a: Val, b: Val) -> Val:
    const = a.const & b.const if isinstance(a.const, int) and isinstance(b.const, int) else NO_CONSTANT
    return Val(_bits(a).bitwiseAND(_bits(b)), INT, const)


def bit_or(a: Val, b: Val) -> Val:
    const = a.const | b.const if isinstance(a.const, int) and isinstance(b.const, int) else NO_CONSTANT
    return Val(_bits(a).bitwiseOR(_bits(b)), INT, const)


def add(a: Val, b: Val) -> Val:
    """Lists are joined or appended to; text joins with anything; otherwise numbers are added."""
    if a.ty.kind == "list":
        if b.ty.kind == "list":
            return Val(F.concat(a.col, b.col), a.ty)
        item = as_text(b) if a.ty.elem.kind == "string" and b.ty.kind != "string" else b.col
        return Val(F.array_append(a.col, item), a.ty)
    if "string" in (a.ty.kind, b.ty.kind):
        const = f"{show(a.const)}{show(b.const)}" if a.is_const and b.is_const else NO_CONSTANT
        return Val(F.concat(F.coalesce(as_text(a), F.lit("")), F.coalesce(as_text(b), F.lit(""))), STRING, const)
    whole = a.ty.kind == "int" and b.ty.kind == "int"
    const = a.const + b.const if a.is_const and b.is_const and a.ty.numeric and b.ty.numeric else NO_CONSTANT
    return Val(number(a) + number(b), INT if whole else NUMBER, const)


def subtract(a: Val, b: Val) -> Val:
    whole = a.ty.kind == "int" and b.ty.kind == "int"
    return Val(number(a) - number(b), INT if whole else NUMBER)


def show(value: Any) -> str:
    """A plan-time value as a template prints it."""
    if value is None:
        return ""
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)


def template_text(v: Val) -> Column:
    """A value inside a template: null is empty, whole numbers have no fraction, objects are JSON."""
    if v.is_const and not isinstance(v.const, (list, dict)):
        return F.lit(show(v.const))
    return F.coalesce(as_text(v), F.lit(""))


def text_function(v: Val) -> Val:
    """``Text(x)``: null is 'null', lists are bracketed, booleans are lower-case."""
    if v.ty.kind == "list":
        parts = F.transform(v.col, lambda x: F.coalesce(text_function(Val(x, v.ty.elem)).col, F.lit("null")))
        return Val(F.when(v.col.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))), STRING)
    text = F.lower(as_text(v)) if v.ty.kind == "bool" else as_text(v)
    return Val(F.coalesce(text, F.lit("null")), STRING)


# keys
def key_text(v: Val) -> Column:
    """Key of groups and distinct values: text without regard to case, null as ''."""
    return F.lower(F.coalesce(as_text(v), F.lit("")))


def sort_key(v: Val) -> Column:
    """Sort key: numbers by value (null as 0), everything else as lower-case text (null as '')."""
    if v.ty.numeric:
        return F.coalesce(v.col, F.lit(0))
    if v.ty.kind == "other":
        return v.col
    return key_text(v)


# text
_WORD_BREAK = r"(?<=[^\p{Lu}_\-])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|[_\-]"


def words(v: Val) -> Val:
    """Words of an identifier, lower-case: at ``_`` and ``-``, before a capital, and before the last capital of a run."""
    parts = F.transform(F.split(as_text(v), _WORD_BREAK), lambda w: F.lower(w))
    return Val(F.filter(parts, lambda w: w != F.lit("")), list_of(STRING))


def normalized(v: Val) -> Val:
    if v.is_const and isinstance(v.const, str):
        return literal(v.const.replace("_", "").replace("-", "").lower())
    return Val(F.lower(F.regexp_replace(as_text(v), "[_-]", "")), STRING)


def trim_suffix(v: Val, suffix: Val) -> Val:
    text, end = as_text(v), F.coalesce(as_text(suffix), F.lit(""))
    cut = F.expr("true") & F.lower(text).endswith(F.lower(end)) & (F.length(end) > 0)
    return Val(F.when(cut, F.substring(text, F.lit(1), F.length(text) - F.length(end))).otherwise(text), STRING)


def replace_all(v: Val, old: Val, new: Val) -> Val:
    """All occurrences, whatever their case."""
    if old.is_const and old.const in ("", None):
        return Val(as_text(v), STRING)
    found = F.collate(as_text(v), "UTF8_LCASE")
    out = F.replace(found, F.collate(F.coalesce(as_text(old), F.lit("")), "UTF8_LCASE"), F.collate(F.coalesce(as_text(new), F.lit("")), "UTF8_LCASE"))
    return Val(F.collate(out, "UTF8_BINARY"), STRING)


def string_predicate(name: str, v: Val, args: list[Val]) -> Column | None:
    """A text predicate on a value that is not null; None if there is no such predicate."""
    a = args[0] if args else literal("")
    low, needle = lowered(v), F.coalesce(lowered(a), F.lit(""))
    if name == "equals":
        return low == needle
    if name == "notEquals":
        return low != needle
    if name == "startsWith":
        return low.startswith(needle)
    if name == "endsWith":
        return low.endswith(needle)
    if name == "contains":
        return low.contains(needle)
    if name == "containsAny":
        if a.is_const and isinstance(a.const, list):
            out = F.lit(False)
            for n in a.const:
                if n not in (None, ""):
                    out = out | low.contains(F.lit(str(n).lower()))
            return out
        return F.exists(F.filter(a.col, lambda x: x.isNotNull()), lambda x: (x != F.lit("")) & low.contains(F.lower(x)))
    if name == "matches":
        return F.rlike(as_text(v), F.lit(check_pattern(a.const)) if a.is_const else as_text(a))
    if name == "sameAs":
        return normalized(v).col == normalized(a).col
    if name == "empty":
        return F.length(as_text(v)) == 0
    return None


def check_pattern(pattern: Any) -> str:
    """A pattern that the JVM reads as it is meant; forms it lacks are refused while planning."""
    text = str(pattern)
    for form in ("(?<-", "(?'", "(?(", "\\k'"):
        if form in text or form == "(?<-" and "-" in text.partition("(?<")[2].partition(">")[0] and text.partition("(?<")[2][:1] not in ("=", "!"):
            raise RuleTypeError(f"the pattern {text!r} uses a form that has no counterpart")
    return text


def number_predicate(name: str, v: Val, args: list[Val]) -> Column | None:
    ops = {"greaterThan": ">", "lessThan": "<", "greaterOrEqual": ">=", "lessOrEqual": "<="}
    if name in ops and args:
        return compare(ops[name], v, args[0])
    if name == "equals" and args:
        return v.col == number(args[0])
    if name == "notEquals" and args:
        return v.col != number(args[0])
    if name == "isSet" and args:
        return _bits(v).bitwiseAND(_bits(args[0])) != 0
    if name == "isClear" and args:
        return _bits(v).bitwiseAND(_bits(args[0])) == 0
    return None


def member_of(v: Val, values: Val) -> Column:
    """``v:in(list)``: equality of any kind with one element."""
    if values.is_const and isinstance(values.const, list):
        if v.ty.numeric and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in values.const):
            return v.col.isin(values.const) if values.const else F.lit(False)
        texts = [show(x).lower() for x in values.const if x is not None]
        return lowered(v).isin(texts) if texts else F.lit(False)
    return F.exists(F.filter(values.col, lambda x: x.isNotNull()), lambda x: equal(v, Val(x, values.ty.elem)))


# lists
Lambda = Callable[[Val], Val]


def _items(xs: Val) -> Column:
    """The list without its null elements; null is the empty list."""
    return F.filter(F.coalesce(xs.col, F.array().cast(f"array<{_ddl(xs.ty.elem)}>")), lambda x: x.isNotNull())


def _ddl(ty: Ty) -> str:
    from colligo.functions.types import to_spark

    return to_spark(ty).simpleString()


def list_any(xs: Val, p: Lambda) -> Column:
    return F.coalesce(F.exists(F.filter(xs.col, lambda x: x.isNotNull()), lambda x: truthy(p(Val(x, xs.ty.elem)))), F.lit(False))


def list_none(xs: Val, p: Lambda) -> Column:
    return ~list_any(xs, p)


def list_all(xs: Val, p: Lambda) -> Column:
    return F.coalesce(F.forall(F.filter(xs.col, lambda x: x.isNotNull()), lambda x: truthy(p(Val(x, xs.ty.elem)))), F.lit(True))


def list_where(xs: Val, p: Lambda) -> Val:
    return Val(F.filter(xs.col, lambda x: x.isNotNull() & truthy(p(Val(x, xs.ty.elem)))), xs.ty)


def list_select(xs: Val, f: Lambda) -> Val:
    """Projected elements, null ones dropped."""
    kind: list[Ty] = []

    def project(x: Column) -> Column:
        out = f(Val(x, xs.ty.elem))
        kind.append(out.ty)
        return out.col

    mapped = F.transform(F.filter(xs.col, lambda x: x.isNotNull()), project)
    return Val(F.filter(mapped, lambda y: y.isNotNull()), list_of(kind[0]))


def list_flatten(xs: Val, f: Lambda) -> Val:
    """Member access on a list: lists inside are joined, null results dropped."""
    out = list_select(xs, f)
    if out.ty.elem.kind == "list":
        return Val(F.filter(F.flatten(out.col), lambda y: y.isNotNull()), out.ty.elem)
    return out


def list_count(xs: Val) -> Val:
    return Val(F.coalesce(F.size(xs.col), F.lit(0)).cast("bigint") if xs.ty.kind == "list" else F.lit(0), INT)


def list_fold(name: str, xs: Val, f: Lambda) -> Val:
    """Sum, Min, Max, Average: null elements are left out, a null value counts as 0; of nothing the result is 0."""
    kind: list[Ty] = []

    def value(x: Column) -> Column:
        v = f(Val(x, xs.ty.elem))
        kind.append(INT if v.ty.kind in ("int", "bool") else NUMBER)
        return number(v).cast("bigint" if kind[-1] is INT else "double")

    values = F.transform(F.filter(xs.col, lambda x: x.isNotNull()), value)
    zero = F.lit(0).cast("bigint") if kind[0] is INT else F.lit(0.0)
    if name == "Sum":
        return Val(F.coalesce(F.aggregate(values, zero, lambda a, x: a + x), zero), kind[0])
    if name == "Min":
        return Val(F.coalesce(F.array_min(values), zero), kind[0])
    if name == "Max":
        return Val(F.coalesce(F.array_max(values), zero), kind[0])
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return Val(F.coalesce(F.when(F.size(values) > 0, total / F.size(values)), F.lit(0.0)), NUMBER)


def list_order(xs: Val, f: Lambda, descending: bool = False) -> Val:
    """Stable order of a list by a key."""
    pairs = F.transform(_items(xs), lambda x, i: F.struct(sort_key(f(Val(x, xs.ty.elem))).alias("k"), i.alias("i"), x.alias("x")))
    sign = -1 if descending else 1

    def before(a: Column, b: Column) -> Column:
        return F.when(a["k"] < b["k"], F.lit(-sign)).when(a["k"] > b["k"], F.lit(sign)).otherwise(F.when(a["i"] < b["i"], F.lit(-1)).otherwise(F.when(a["i"] > b["i"], F.lit(1)).otherwise(F.lit(0))))

    return Val(F.transform(F.array_sort(pairs, before), lambda p: p["x"]), xs.ty)


def list_distinct(xs: Val, f: Lambda) -> Val:
    """The first element of each key, in order of appearance."""
    pairs = F.transform(_items(xs), lambda x: F.struct(key_text(f(Val(x, xs.ty.elem))).alias("k"), x.alias("x")))
    keys = F.transform(pairs, lambda p: p["k"])
    kept = F.filter(F.transform(pairs, lambda p, i: F.struct(p["x"].alias("x"), (F.array_position(keys, p["k"]) == i + 1).alias("first"))), lambda p: p["first"])
    return Val(F.transform(kept, lambda p: p["x"]), xs.ty)


def list_group(xs: Val, f: Lambda) -> Val:
    """Groups ``{Key, Items, Count}`` in order of first appearance."""
    kind: list[Ty] = []

    def pair(x: Column) -> Column:
        v = f(Val(x, xs.ty.elem))
        kind.append(v.ty)
        return F.struct(key_text(v).alias("k"), F.coalesce(as_text(v), F.lit("")).alias("shown"), x.alias("x"))

    pairs = F.transform(_items(xs), pair)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))

    def group(k: Column) -> Column:
        own = F.filter(pairs, lambda p: p["k"] == k)
        return F.struct(F.get(own, F.lit(0))["shown"].alias("Key"), F.transform(own, lambda p: p["x"]).alias("Items"), F.size(own).cast("bigint").alias("Count"))

    return Val(F.transform(keys, group), list_of(record([("Key", STRING), ("Items", xs.ty), ("Count", INT)], "Group")))


def list_reduce(xs: Val, op: Val, f: Lambda, separator: Val | None, seed: Val | None) -> Val:
    """``Reduce('+', …)``: text is joined, numbers are added; the type of the projected values decides."""
    if op.const != "+":
        raise RuleTypeError("Reduce knows the operator '+' only")
    projected = list_select(xs, f)
    if projected.ty.elem.kind == "string":
        texts = projected.col if seed is None else F.concat(F.array(as_text(seed)), projected.col)
        return Val(F.coalesce(F.array_join(texts, "" if separator is None else separator.const), F.lit("")), STRING)
    total = list_fold("Sum", projected, lambda v: v)
    return add(seed, total) if seed is not None else total


def list_at(xs: Val, index: Val) -> Val:
    return Val(F.get(xs.col, number(index).cast("int")), xs.ty.elem)


def list_last(xs: Val) -> Val:
    return Val(F.try_element_at(xs.col, F.lit(-1)), xs.ty.elem)


def list_single(xs: Val) -> Val:
    return Val(F.when(F.size(xs.col) == 1, F.get(xs.col, F.lit(0))), xs.ty.elem)


def list_contains(xs: Val, v: Val) -> Column:
    return list_any(xs, lambda x: boolean(equal(x, v)))


def pretty_json(v: Val, indent: int = 0) -> Column:
    """JSON over several lines, four blanks a level: every field in its order, missing values as null, an empty list as []."""
    pad, inner, ty = " " * indent, " " * (indent + 4), v.ty
    if ty.kind == "record":
        fields = [F.concat(F.lit(f'{inner}"{n}": '), pretty_json(Val(v.col[n], t), indent + 4)) for n, t in ty.fields]
        body = F.concat(F.lit("{\n"), F.concat_ws(",\n", *fields), F.lit(f"\n{pad}}}"))
    elif ty.kind in ("list", "map"):
        if ty.kind == "list":
            items = F.transform(v.col, lambda x: F.concat(F.lit(inner), pretty_json(Val(x, ty.elem), indent + 4)))
        else:
            items = F.transform(F.map_entries(v.col), lambda e: F.concat(F.lit(inner + '"'), _json_text(e["key"]), F.lit('": '), pretty_json(Val(e["value"], ty.elem), indent + 4)))
        opening, closing = "[]" if ty.kind == "list" else "{}"
        body = F.when(F.size(items) == 0, F.lit(opening + closing)).otherwise(F.concat(F.lit(opening + "\n"), F.array_join(items, ",\n"), F.lit("\n" + pad + closing)))
    elif ty.kind in ("int", "number"):
        body = as_text(v)
    elif ty.kind == "bool":
        body = F.when(v.col, F.lit("true")).otherwise(F.lit("false"))
    else:
        body = F.concat(F.lit('"'), _json_text(as_text(v)), F.lit('"'))
    return F.coalesce(F.when(v.col.isNotNull(), body), F.lit("null"))


def _json_text(text: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text
