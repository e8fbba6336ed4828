"""From expressions to Spark: names are resolved, predicates and functions inlined, correlated predicates become subqueries.

A value becomes a Column, a collection a DataFrame; nothing of the language is left at run time. A predicate over one
collection that looks into another becomes ``EXISTS`` with outer references, which Catalyst turns into semi, anti or
existence joins; aggregates over another collection become scalar subqueries.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from colligo.catalog import AmbiguousCollection, Catalog, UnknownCollection
from colligo.collection import Collection, Nested, NeedsLists, fold_column, fresh, joined_text
from colligo.functions import types as K
from colligo.functions import values as V
from colligo.functions.types import Ty
from colligo.functions.values import RuleTypeError, Val, boolean, condition, literal, truthy
from colligo.lang.ast import Binary, Call, Conditional, Filter, FunctionDecl, Guard, ListOf, Literal, Match, Member, Name, Node, Not, PredicateDecl, Record
from colligo.lang.parser import parse_expression
from colligo.lang.template import parts_of

TRANSFORMS = frozenset("Select Where OrderBy OrderByDescending Sum Min Max Average Distinct GroupBy Reduce Text First Last Single ElementAt Count".split())
QUANTIFIERS = frozenset(("any", "none", "all"))


#: Marks the scope of a function's body, where texts are templates.
TEMPLATES = "{}"


class UnknownName(LookupError):
    pass


class LooksOut(RuleTypeError):
    """An element of a list is compared with rows of another collection: no expression of its row can say that."""


class Scope:
    """What a name may mean: a row of a frame, an element of a list, bound parameters, or nothing."""

    def __init__(self, parent: Scope | None, ty: Ty | None, frame: Any, item: Callable[[bool], Column] | None, column: Callable[[str, bool], Column] | None, bindings: dict[str, Any] | None = None, inside_list: bool = False):
        # ``item`` and ``column`` make columns of this frame, or, told so, outer references to them
        self.parent, self.ty, self.frame, self._item, self._column = parent, ty, frame, item, column
        self.bindings = bindings or {}
        self.inside_list = inside_list
        #: Lists of the row that are not made, and the aggregates over them that the frame of the row is to get.
        self.nested: tuple[Nested, ...] = ()
        self.folds: dict[Nested, dict[str, Column]] | None = None

    @classmethod
    def empty(cls) -> Scope:
        return cls(None, None, object(), None, None)

    @classmethod
    def of_collection(cls, c: Collection, parent: Scope | None = None) -> Scope:
        def column(name: str, outer: bool) -> Column:
            return F.col(f"`{name}`").outer() if outer else F.col(f"`{name}`")

        if c.is_record:
            names = c.columns
            out = cls(parent, c.ty, object(), lambda outer: F.struct(*(column(n, outer).alias(n) for n in names)), column)
            out.nested, out.folds = c.nested, {} if c.nested and parent is None else None
            return out
        return cls(parent, c.ty, object(), lambda outer: column("value", outer), None)

    @classmethod
    def of_value(cls, v: Val, parent: Scope) -> Scope:
        return cls(parent, v.ty, parent.frame, lambda outer: v.col, None, inside_list=True)

    def bind(self, **bindings: Any) -> Scope:
        return Scope(self, None, self.frame, None, None, bindings)

    def as_item(self, v: Val) -> Scope:
        """A scope in which ``v`` is the item, in the same frame."""
        source = next((s for s in self.rows() if s.ty is v.ty), None)
        if source is not None and not source.inside_list:  # the row itself: its columns stay reachable from subqueries
            out = Scope(self, v.ty, source.frame, source._item, source._column)
            out.nested = source.nested
            return out
        return Scope(self, v.ty, self.frame, lambda outer: v.col, None, inside_list=True)

    def rows(self):
        s: Scope | None = self
        while s is not None:
            if s.ty is not None:
                yield s
            s = s.parent

    def bound(self, name: str) -> Any:
        s: Scope | None = self
        while s is not None:
            if name in s.bindings:
                return s.bindings[name], s
            s = s.parent
        return None

    def list_named(self, name: str) -> Nested | None:
        found = self.ty.field(name) if self.nested else None
        return next((n for n in self.nested if found and n.field == found[0]), None)

    def outer_column(self, name: str) -> Column:
        return self._column(name, True)

    def children(self, nested: Nested, frame: Any, planner: Planner) -> Collection:
        """A list that is not made, as a collection seen from this row."""
        if frame is not self.frame:
            raise NeedsLists
        return replace(nested.children, planner=planner, lazy=(nested, self, True))

    def value(self, frame: Any) -> Val:
        if self.nested:
            raise NeedsLists
        return Val(self._item(self._outer(frame)), self.ty)

    def member(self, name: str, frame: Any) -> Val | None:
        found = self.ty.field(name) if self.ty is not None and self.ty.kind == "record" else None
        if not found:
            return None
        if self.list_named(name) is not None:
            raise NeedsLists
        if self._column is not None:
            return Val(self._column(found[0], self._outer(frame)), found[1])
        return Val(self._item(self._outer(frame))[found[0]], found[1])

    def _outer(self, frame: Any) -> bool:
        """Whether a use in ``frame`` is an outer reference."""
        if frame is self.frame:
            return False
        if self.inside_list:
            raise LooksOut("a collection is compared with an element of a list here: this is possible in the terms of a filter (any, none, all joined by &&), or after the list was selected into a collection of its own")
        return True


class GroupScope(Scope):
    """Scope of a group: ``Key``, ``Items``, ``Count``; what is used becomes an aggregate."""

    def __init__(self, base: Collection, key: Val | None):
        super().__init__(None, K.record([("Key", K.STRING), ("Items", K.list_of(base.ty)), ("Count", K.INT)], "Group"), object(), lambda outer: F.lit(None), None)
        self.base, self.key = base, key
        self.aggregates: dict[str, Column] = {}
        self.uses_key, self.key_column = False, fresh("__g")

    def add(self, aggregate: Column) -> Column:
        name = fresh("__a")
        self.aggregates[name] = aggregate
        return F.col(name)

    def member(self, name: str, frame: Any) -> Any:
        low = name.lower()
        if low == "key" and self.key is not None:
            self.uses_key = True
            return Val(F.col(self.key_column), K.STRING)
        if low == "count":
            return GroupItems(self).fold("Count")
        if low == "items":
            return GroupItems(self)
        return None

    def value(self, frame: Any) -> Any:
        return GroupRow(self)


@dataclass(frozen=True)
class GroupRow:
    scope: GroupScope


@dataclass(frozen=True)
class GroupItems:
    """The items of a symbolic group, maybe filtered."""

    scope: GroupScope
    condition: Column | None = None

    def _if(self, c: Column) -> Column:
        return c if self.condition is None else F.when(self.condition, c)

    def fold(self, name: str, v: Val | None = None) -> Val:
        add = self.scope.add
        if name == "Count":
            return Val(add(F.count(self._if(F.lit(1)))), K.INT)
        x = v if self.condition is None else Val(F.when(self.condition, V.number(v)), K.NUMBER if v.ty.kind == "number" else K.INT)
        if self.condition is None:
            col, ty = fold_column(name, x)
            return Val(add(col), ty)
        # filtered: items outside the condition do not count at all
        whole, raw = v.ty.kind in ("int", "bool"), V.number(v)
        raw = raw.cast("bigint" if whole else "double")
        zero = F.lit(0).cast("bigint") if whole else F.lit(0.0)
        if name == "Average":
            return Val(add(F.coalesce(F.avg(self._if(raw)), F.lit(0.0))), K.NUMBER)
        made = {"Sum": F.sum, "Min": F.min, "Max": F.max}[name](self._if(raw))
        return Val(add(F.coalesce(made, zero)), K.INT if whole else K.NUMBER)

    def quantified(self, name: str, condition: Column) -> Val:
        c = self._if(condition)
        if name == "all":
            return boolean(self.scope.add(F.coalesce(F.bool_and(c), F.lit(True))))
        out = self.scope.add(F.coalesce(F.bool_or(c), F.lit(False)))
        return boolean(~out if name == "none" else out)

    def listed(self, v: Val | None = None) -> Val:
        """The items, or a value of each, as a list in their order."""
        base = self.scope.base
        v = v or base.item()
        from colligo.collection import _comparator

        pair = F.struct(*(F.col(o.column).alias(f"o{i}") for i, o in enumerate(base.order)), v.col.alias("x"))
        pairs = F.array_sort(F.collect_list(self._if(pair)), _comparator(base.order))
        return Val(self.scope.add(F.transform(pairs, lambda p: p["x"])), K.list_of(v.ty))

    def joined(self, v: Val, separator: str) -> Val:
        base = self.scope.base
        if self.condition is None:
            return Val(self.scope.add(joined_text(V.as_text(v), separator, base.order)), K.STRING)
        return Val(F.array_join(self.listed(Val(V.template_text(v), K.STRING)).col, separator), K.STRING)

    def inner(self) -> Scope:
        return Scope.of_collection(self.scope.base)


@dataclass(frozen=True)
class Closure:
    """A function or predicate waiting for the rest of its arguments."""

    name: str
    bound: tuple[Any, ...] = ()


@dataclass(frozen=True)
class One:
    """A value over the single row of a collection: what ``First`` and its kin give outside of any row."""

    row: Collection
    value: Val


@dataclass(frozen=True)
class Namespace:
    name: str
    path: str | None = None
    members: tuple[str, ...] | None = None


@dataclass
class Program:
    """Declarations that expressions may use."""

    types: dict[str, Ty] = field(default_factory=dict)
    flags: dict[str, int] = field(default_factory=dict)
    lets: dict[str, Node] = field(default_factory=dict)
    predicates: dict[str, list[PredicateDecl]] = field(default_factory=dict)
    functions: dict[str, list[FunctionDecl]] = field(default_factory=dict)
    methods: dict[tuple[str, str], Callable[[Val, list[Val]], Val]] = field(default_factory=dict)


class Planner:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, program: Program | None = None, lenient: bool = False, arguments: Sequence[str] = ()):
        self.spark = spark
        self.catalog = catalog or Catalog(spark)
        self.program = program or Program()
        self.lenient = lenient
        self.arguments = list(arguments)
        self.planning: list[str] = []
        self.planned: dict[str, Any] = {}
        self.frames: list[Any] = []

    # entry points
    def value(self, expression: str | Node, scope: Scope) -> Val:
        """An expression as a value; a collection becomes the list of its items."""
        node = parse_expression(expression) if isinstance(expression, str) else expression
        return self.as_value(self.evaluate(node, scope), scope)

    def collection(self, expression: str | Node, scope: Scope | None = None) -> Collection:
        node = parse_expression(expression) if isinstance(expression, str) else expression
        out = self.evaluate(node, scope or Scope.empty())
        return self.as_collection(out)

    def as_collection(self, out: Any) -> Collection:
        if isinstance(out, GroupedCollection):
            return out.materialised()
        if isinstance(out, One):
            c = replace(out.row, planner=self)
            return c.flatten(out.value) if out.value.ty.kind == "list" else c.project(out.value)
        if isinstance(out, Collection):
            return replace(out, planner=self)
        if isinstance(out, Val) and out.is_const and isinstance(out.const, list):
            return Collection.values(self.spark, out.const, self)
        if isinstance(out, Val):
            one = self.spark.range(1)
            c = Collection(one, K.record([]), (), self)
            return c.flatten(out) if out.ty.kind == "list" else c.project(out)
        raise RuleTypeError("a collection is needed here")

    def as_value(self, out: Any, scope: Scope) -> Val:
        if isinstance(out, Val):
            return out
        if isinstance(out, GroupItems):
            return out.listed()
        if isinstance(out, GroupRow):
            key = out.scope.member("Key", scope.frame)
            return Val(F.struct(key.col.alias("Key"), GroupItems(out.scope).listed().col.alias("Items"), GroupItems(out.scope).fold("Count").col.alias("Count")), out.scope.ty)
        if isinstance(out, Collection):
            if out.lazy or out.nested:
                raise NeedsLists
            return self.listed(out)
        if isinstance(out, One):
            return Val(out.row.df.select(out.value.col.alias("x")).scalar(), out.value.ty)
        if isinstance(out, Closure):
            return self.as_value(self.apply(out.name, list(out.bound), scope, item=True), scope)
        raise RuleTypeError("a value is needed here")

    def listed(self, c: Collection) -> Val:
        from colligo.collection import _comparator

        pair = F.struct(*(F.col(o.column).alias(f"o{i}") for i, o in enumerate(c.order)), c.item().col.alias("x"))
        return Val(c.scalar(F.transform(F.array_sort(F.collect_list(pair), _comparator(c.order)), lambda p: p["x"])), K.list_of(c.ty))

    # evaluation
    def evaluate(self, node: Node, scope: Scope) -> Any:
        if isinstance(node, Literal):
            if isinstance(node.value, str) and "{" in node.value and scope.bound(TEMPLATES):  # inside a function's body
                return self.template(node.value, scope, strict=False)
            return literal(node.value)
        if isinstance(node, Name):
            return self.name(node.name, scope)
        if isinstance(node, Member):
            return self.member(node, scope)
        if isinstance(node, Filter):
            return self.filter(node, scope)
        if isinstance(node, Call):
            return self.call(node, scope)
        if isinstance(node, Binary):
            return self.binary(node, scope)
        if isinstance(node, Not):
            return boolean(~truthy(self.value(node.operand, scope)))
        if isinstance(node, Conditional):
            test, yes, no = truthy(self.value(node.test, scope)), self.value(node.yes, scope), self.value(node.no, scope)
            ty = K.common(yes.ty, no.ty)
            return Val(F.when(test, self.cast(yes, ty)).otherwise(self.cast(no, ty)), ty)
        if isinstance(node, Match):
            return self.match(node, scope)
        if isinstance(node, ListOf):
            items = [self.evaluate(n, scope) for n in node.items]
            if items and any(isinstance(i, Collection) for i in items):
                return Collection.concat_all([self.as_collection(i) for i in items])
            return V.make_list([self.as_value(i, scope) for i in items])
        if isinstance(node, Record):
            return self.record(node, scope)
        raise RuleTypeError(f"no plan for {type(node).__name__}")

    @staticmethod
    def cast(v: Val, ty: Ty) -> Column:
        if v.ty.kind == "null" or v.ty.kind == ty.kind:
            return v.col
        return V.as_text(v) if ty.kind == "string" else v.col.cast(K.to_spark(ty))

    def match(self, node: Match, scope: Scope) -> Val:
        subject = self.value(node.subject, scope)
        results = [self.value(r, scope) for _, r in node.arms]
        ty = K.NULL
        for r in results:
            ty = K.common(ty, r.ty)
        out = None
        for (pattern, _), r in zip(node.arms, results):
            test = F.lit(True) if pattern is None else V.equal(subject, self.value(pattern, scope))
            out = F.when(test, self.cast(r, ty)) if out is None else out.when(test, self.cast(r, ty))
        return Val(out, ty)

    def record(self, node: Record, scope: Scope) -> Val:
        declared = self.program.types.get(node.type) if node.type else None
        if node.type and declared is None:
            raise UnknownName(f"no type {node.type}")
        given: dict[str, Val] = {}
        for n, e in node.fields:
            if declared is not None and not declared.field(n):
                raise RuleTypeError(f"{node.type} has no field {n}")
            given[declared.field(n)[0] if declared is not None else n] = self.text_value(e, scope)
        if declared is not None:
            cols = [((self.cast(given[n], t) if n in given else F.lit(None)).cast(K.to_spark(t)).alias(n)) for n, t in declared.fields]
            return Val(F.struct(*cols), declared)
        if not given:
            raise RuleTypeError("an object has a field at least")
        return Val(F.struct(*(v.col.alias(n) for n, v in given.items())), K.record([(n, v.ty) for n, v in given.items()]))

    def text_value(self, node: Node, scope: Scope) -> Val:
        """A value; a literal text is read as a template."""
        if isinstance(node, Literal) and isinstance(node.value, str) and "{" in node.value:
            return self.template(node.value, scope, strict=False)
        return self.value(node, scope)

    # names
    def name(self, name: str, scope: Scope) -> Any:
        """The order of resolution: bound parameters, the item by 'item' or its type, predicate, function, let, collection,
        flags, a field of the item, a namespace."""
        found = scope.bound(name)
        if found is not None:  # a parameter that is a row: inside a subquery it is a row outside
            return found[0].value(self.frame(scope)) if isinstance(found[0], Scope) else found[0]
        for s in scope.rows():
            if name == "item" or s.ty.is_a(name):
                return s.value(self.frame(scope))
        if name in self.program.predicates or name in self.program.functions:
            item = next(scope.rows(), None)
            if item is None:  # outside of any row, a predicate over a collection's name is that subset
                return self.let(name) if name in self.program.lets else Closure(name)
            return self.apply(name, [], scope, item=True)
        if name in self.program.lets:
            return self.let(name)
        if name in self.program.flags:
            return literal(self.program.flags[name])
        for s in scope.rows():
            nested = s.list_named(name)
            if nested is not None:
                return s.children(nested, scope.frame, self)
            v = s.member(name, self.frame(scope))
            if v is not None:
                return v
        if name.lower() == "empty" and (s := next(scope.rows(), None)) is not None:
            return self.predicate(s.value(self.frame(scope)), "empty", [], scope)
        if self.catalog.has(name):
            return self.adopted(self.catalog.find(name))
        if name in self.catalog.namespaces() or name in self.catalog.aggregates:
            return Namespace(name)
        if name == "Program":
            return Val(F.lit(None), K.record([("Args", K.list_of(K.STRING))], "Program"), {"Args": self.arguments})
        language = self.language_filter(name, scope)
        if language is not None:
            return language
        if self.lenient and next(scope.rows(), None) is not None:
            return literal(None)
        raise UnknownName(f"nothing is called {name}")

    def frame(self, scope: Scope) -> Any:
        return scope.frame

    def language_filter(self, name: str, scope: Scope) -> Val | None:
        """A bare name as the language of the item's file."""
        s = next(scope.rows(), None)
        file = s.member("File", scope.frame) if s is not None else None
        if file is not None and file.ty.kind == "record" and (lang := file.ty.field("Language")):
            return boolean(F.coalesce(F.lower(file.col[lang[0]]) == name.lower(), F.lit(False)))
        own = s.member("language", scope.frame) if s is not None else None
        return boolean(F.coalesce(F.lower(own.col) == name.lower(), F.lit(False))) if own is not None and own.ty.kind == "string" else None

    def let(self, name: str) -> Any:
        if name in self.planned:
            return self.planned[name]
        step = f"{name} as a set" if name in self.program.predicates else name
        if step in self.planning:
            raise RuleTypeError("circular reference: " + " -> ".join([*self.planning[self.planning.index(step) :], step]))
        self.planning.append(step)
        try:
            self.planned[name] = self.evaluate(self.program.lets[name], Scope.empty())
        finally:
            self.planning.pop()
        return self.planned[name]

    # members
    def member(self, node: Member, scope: Scope) -> Any:
        if isinstance(node.target, Name) and node.args is None and scope.bound(node.target.name) is None:
            # a field of a row with lists that are not made is asked of the row, which as a value would need them
            row = next((s for s in scope.rows() if s.nested and (node.target.name == "item" or s.ty.is_a(node.target.name))), None)
            if row is not None and (nested := row.list_named(node.name)) is not None:
                return row.children(nested, scope.frame, self)
            if row is not None and (found := row.member(node.name, scope.frame)) is not None:
                return found
        target = self.evaluate(node.target, scope)
        return self.member_of(target, node.name, node.args, scope)

    def member_of(self, target: Any, name: str, args: tuple[Node, ...] | None, scope: Scope) -> Any:
        if isinstance(target, GroupedCollection):
            return self.grouped_member(target, name, args or (), scope)
        if isinstance(target, One):
            inner = Scope.of_collection(target.row)
            return One(target.row, self.as_value(self.member_of(target.value, name, args, inner), inner))
        if isinstance(target, Namespace):
            return self.namespace_member(target, name, args, scope)
        if isinstance(target, Collection):
            return self.collection_member(replace(target, planner=self), name, args or (), scope)
        if isinstance(target, GroupRow):
            out = target.scope.member(name, scope.frame)
            if out is None:
                raise UnknownName(f"a group has Key, Items and Count, not {name}")
            return out
        if isinstance(target, GroupItems):
            return self.group_member(target, name, args or (), scope)
        if isinstance(target, Closure):
            target = self.as_value(target, scope)
        if target.ty.kind == "list":
            return self.list_member(target, name, args or (), scope)
        return self.value_member(target, name, args, scope)

    def namespace_member(self, ns: Namespace, name: str, args: tuple[Node, ...] | None, scope: Scope) -> Any:
        path = None
        if args:
            path = self.value(args[0], scope).const
        if name in self.catalog.aggregates and ns.members is None:  # csharp.Code('p')
            return Namespace(name, path, (ns.name,))
        if ns.name in self.catalog.aggregates or ns.members is not None:
            return self.adopted(self.catalog.union_of(name, ns.members, path if path is not None else ns.path))
        return self.adopted(self.catalog.at_path(ns.name, name, path) if path is not None else self.catalog.get(ns.name, name))

    def adopted(self, c: Collection) -> Collection:
        """A collection whose nested records carry the type names that its declared item type gives them."""
        return replace(c, ty=self.adopt(c.ty, c.ty.name), planner=self)

    def adopt(self, ty: Ty, name: str | None, depth: int = 0) -> Ty:
        declared = self.program.types.get(name or "")
        if ty.kind != "record" or declared is None or declared.kind != "record" or depth > 8:
            return ty
        fields = []
        for n, t in ty.fields:
            found = declared.field(n)
            if found and t.kind == "list" and found[1].kind == "list" and found[1].elem.name:
                t = K.list_of(self.adopt(t.elem, found[1].elem.name, depth + 1))
            elif found and t.kind == "record" and found[1].name:
                t = self.adopt(t, found[1].name, depth + 1)
            fields.append((n, t))
        return K.record(fields, name, declared.bases or ty.bases)

    def lambda_of(self, args: tuple[Node, ...], scope: Scope, index: int = 0) -> Callable[[Val], Val]:
        """An argument as a function of an element: the element itself if it is absent."""
        if index >= len(args):
            return lambda v: v
        return lambda v: self.value(args[index], Scope.of_value(v, scope))

    def list_member(self, xs: Val, name: str, args: tuple[Node, ...], scope: Scope) -> Any:
        f = self.lambda_of(args, scope)
        if name == "Count" and not args:
            return V.list_count(xs)
        if name == "Where":
            return V.list_where(xs, self.predicate_of(args[0], scope))
        if name == "Select":
            return V.list_select(xs, f)
        if name in ("OrderBy", "OrderByDescending"):
            return V.list_order(xs, f, name == "OrderByDescending")
        if name in ("Sum", "Min", "Max", "Average"):
            return V.list_fold(name, xs, f)
        if name == "Distinct":
            return V.list_distinct(xs, f)
        if name == "GroupBy":
            return V.list_group(xs, f)
        if name == "Reduce":
            more = [self.value(a, scope) for a in args[2:]]
            return V.list_reduce(xs, self.value(args[0], scope), self.lambda_of(args, scope, 1), more[0] if more else None, more[1] if len(more) > 1 else None)
        if name in ("First", "Last", "Single", "ElementAt"):
            if name == "ElementAt":
                return V.list_at(xs, self.value(args[0], scope))
            own = V.list_where(xs, self.predicate_of(args[0], scope)) if args else xs
            return V.list_at(own, literal(0)) if name == "First" else V.list_last(own) if name == "Last" else V.list_single(own)
        if name == "Text" and args:
            return Val(F.array_join(F.transform(xs.col, lambda x: self.template(args[0].value, Scope.of_value(Val(x, xs.ty.elem), scope)).col), "\n"), K.STRING)
        if xs.ty.elem.kind in ("record", "list") or name in ("Length", "Lower", "Upper", "Words", "Normalized"):
            return V.list_flatten(xs, lambda v: self.as_value(self.member_of(v, name, args or None, scope), scope))
        raise UnknownName(f"a list of {xs.ty.elem.kind} has no {name}")

    def value_member(self, v: Val, name: str, args: tuple[Node, ...] | None, scope: Scope) -> Any:
        if v.ty.kind == "record":
            if v.is_const and isinstance(v.const, dict) and name in v.const:
                return literal(v.const[name])
            found = v.ty.field(name)
            if found and args is None:
                return Val(v.col[found[0]], found[1])
            if (method := self.program.methods.get((v.ty.name or "", name))) is not None:
                return method(v, [self.value(a, scope) for a in args or ()])
            if name == "Count":
                return Val(F.when(v.col.isNull(), F.lit(0)).otherwise(F.lit(len(v.ty.fields))).cast("bigint"), K.INT)
            if name == "Keys":
                return literal([n for n, _ in v.ty.fields])
            if name == "Values":
                kept = V.make_list([Val(v.col[n], t) for n, t in v.ty.fields])
                return Val(F.filter(kept.col, lambda x: x.isNotNull()), kept.ty)
            if name == "Get" and args:
                return self.get_field(v, self.value(args[0], scope))
        if v.ty.kind == "map":
            if name == "Get" and args:
                key = self.value(args[0], scope)
                return Val(F.try_element_at(v.col, V.as_text(key)), v.ty.elem)
            if name == "Count":
                return Val(F.coalesce(F.size(v.col), F.lit(0)).cast("bigint"), K.INT)
            if name == "Keys":
                return Val(F.map_keys(v.col), K.list_of(K.STRING))
            if name == "Values":
                return Val(F.map_values(v.col), K.list_of(v.ty.elem))
            return Val(F.try_element_at(v.col, F.lit(name)), v.ty.elem)
        if v.ty.kind == "string" or v.ty.kind == "record" and v.ty.field("text"):
            text = V.as_text(v)
            if name == "Length":
                return Val(F.length(text).cast("bigint"), K.INT)
            if name in ("Lower", "Upper"):
                return Val(F.lower(text) if name == "Lower" else F.upper(text), K.STRING)
            if name == "Normalized":
                return V.normalized(v)
            if name == "Words":
                return V.words(v)
            if name in ("Trim", "Replace") and args:
                return self.text_change(v, name, args, scope)
        if v.ty.kind == "null" or self.lenient:
            return literal(None)
        raise UnknownName(f"{v.ty.name or v.ty.kind} has no {name}" + (f"; it has {', '.join(n for n, _ in v.ty.fields)}" if v.ty.fields else ""))

    def get_field(self, v: Val, key: Val) -> Val:
        if key.is_const:
            found = v.ty.field(str(key.const))
            return Val(v.col[found[0]], found[1]) if found else literal(None)
        ty = K.NULL
        for _, t in v.ty.fields:
            ty = K.common(ty, t)
        pairs = [x for n, t in v.ty.fields for x in (F.lit(n.lower()), self.cast(Val(v.col[n], t), ty))]
        return Val(F.try_element_at(F.create_map(*pairs), V.lowered(key)), ty)

    def text_change(self, v: Val, name: str, args: tuple[Node, ...], scope: Scope) -> Val:
        vals = [self.value(a, scope) for a in args]
        return V.trim_suffix(v, vals[0]) if name == "Trim" else V.replace_all(v, vals[0], vals[1])

    def group_member(self, items: GroupItems, name: str, args: tuple[Node, ...], scope: Scope) -> Any:
        inner = items.inner()
        if name == "Count":
            return items.fold("Count")
        if name == "Where":
            c = truthy(self.as_predicate(args[0], inner))
            return GroupItems(items.scope, c if items.condition is None else items.condition & c)
        if name in ("Sum", "Min", "Max", "Average"):
            return items.fold(name, self.value(args[0], inner) if args else items.scope.base.item())
        if name == "Select":
            return items.listed(self.value(args[0], inner))
        if name == "Text":
            return items.joined(self.template(args[0].value, inner), "\n")
        if name == "Reduce":
            v = self.value(args[1], inner) if len(args) > 1 else items.scope.base.item()
            if v.ty.kind == "string" and len(args) <= 3:
                return items.joined(v, self.value(args[2], scope).const if len(args) > 2 else "")
        listed = items.listed()
        return self.list_member(listed, name, args, scope)

    def collection_member(self, c: Collection, name: str, args: tuple[Node, ...], scope: Scope) -> Any:
        if c.lazy:
            if name not in ("Where", "Count", "Sum", "Min", "Max", "Average") or name not in ("Where", "Count") and not args:
                raise NeedsLists
            if name != "Where" and c.lazy[2] and c.lazy[1].folds is not None:
                return self.folded(c, name, args)
            if name != "Where":
                c = replace(c, df=c.df.where(c.link_to({})), lazy=None)
        elif name != "Where":
            c = c.full()
        inner = Scope.of_collection(c, scope)
        if name == "Where":
            return self.filtered(c, args[0], scope)
        if name == "Select":
            out = self.evaluate(args[0], inner)
            return c.project(self.as_value(out, inner))
        if name in ("OrderBy", "OrderByDescending"):
            return c.order_by(self.value(args[0], inner) if args else c.item(), name == "OrderByDescending")
        if name in ("Sum", "Min", "Max", "Average"):
            return c.fold(name, self.value(args[0], inner) if args else c.item())
        if name == "Count":
            return c.count()
        if name == "Distinct":
            return c.distinct(self.value(args[0], inner) if args else None)
        if name == "GroupBy":
            return GroupedCollection(c.group_by(self.value(args[0], inner) if args else c.item()), self)
        if name == "Reduce":
            op = self.value(args[0], scope).const
            v = self.value(args[1], inner) if len(args) > 1 else c.item()
            return c.reduce(op, v, self.value(args[2], scope).const if len(args) > 2 else "")
        if name == "Text":
            return c.joined(self.template(args[0].value, inner), "\n")
        if name in ("First", "Last", "Single"):
            base = self.filtered(c, args[0], scope) if args else c
            one = {"First": base.first, "Last": base.last, "Single": base.single}[name]()
            return self.lone(one, scope)
        if name == "ElementAt":
            return self.lone(c.element_at(int(self.value(args[0], scope).const)), scope)
        return c.flatten(self.as_value(self.member_of(inner.value(inner.frame), name, args or None, inner), inner))

    def folded(self, c: Collection, name: str, args: tuple[Node, ...]) -> Val:
        """An aggregate over a list that is not made: one more column of the row's frame."""
        nested, row, _ = c.lazy
        if name == "Count":
            col, ty = F.count(F.lit(1)), K.INT
        else:
            col, ty = fold_column(name, self.value(args[0], Scope.of_collection(nested.children)))
        out = fresh("__a")
        row.folds.setdefault(nested, {})[out] = col
        return Val(F.coalesce(F.col(out), F.lit(0).cast("bigint") if ty.kind == "int" else F.lit(0.0)), ty)

    def grouped_member(self, g: GroupedCollection, name: str, args: tuple[Node, ...], scope: Scope) -> Any:
        groups = g.groups
        if name == "Select":
            df, orders, v = groups._apply(lambda s: self.value(args[0], s))
            return Collection(df, K.record([]), orders, self).project(v)
        if name == "Count":
            keys = groups.base.df.groupBy(V.key_text(groups.key).alias("__key")).agg(F.count(F.lit(1)).alias("n"))
            return Collection(keys, K.record([("n", K.INT)]), (), self).count()
        return self.collection_member(g.materialised(), name, args, scope)

    @staticmethod
    def isolated(c: Collection, scope: Scope) -> tuple[Collection, Scope, dict[str, str]]:
        """A collection whose columns have fresh names, the scope of such a row, and the names: inside a subquery a name of the
        rows around must not be taken for one of its own."""
        if next(scope.rows(), None) is None:
            return c, Scope.of_collection(c, scope), {}
        x = fresh("__x")
        names = {n: f"{x}_{i}" for i, n in enumerate(c.own_columns)}
        # the alias is a barrier: names below it are out of reach
        df = c.df.select(*(F.col(f"`{n}`").alias(a) for n, a in names.items()), *(F.col(o.column) for o in c.order)).alias(x)

        def column(n: str, outer: bool) -> Column:
            return F.col(names[n]).outer() if outer else F.col(names[n])

        def whole(outer: bool) -> Column:
            return F.struct(*(column(n, outer).alias(n) for n in names)) if c.is_record else column("value", outer)

        inner = Scope(scope, c.ty, object(), whole, column if c.is_record else None)
        inner.nested = c.nested
        return replace(c, df=df), inner, names

    def filtered(self, c: Collection, node: Node, scope: Scope) -> Collection:
        """``C.Where(p)``, where ``p`` may look at the rows around."""
        if next(scope.rows(), None) is None and not c.nested:
            return self.restricted(c, node)
        alone, inner, names = self.isolated(c, scope)
        kept = alone.df.where(condition(self.as_predicate(node, inner)))
        # no look at the schema: outer names are not resolved yet
        return c.with_df(kept.select(*(F.col(a).alias(n) for n, a in names.items()), *(F.col(o.column) for o in c.order)) if names else kept)

    def restricted(self, c: Collection, node: Node) -> Collection:
        """A filter outside of any row. Of its terms, those that compare elements of a list with another collection are decided
        on the elements as rows, and come back as semi or anti joins by the content of the row: equal rows fare equally."""
        scope = Scope.of_collection(c)
        try:
            return c.with_df(c.df.where(condition(self.as_predicate(node, scope))))
        except LooksOut:
            if isinstance(node, Binary) and node.op == "&&":
                return self.restricted(self.restricted(c, node.left), node.right)
            negated = isinstance(node, Not)
            term = node.operand if negated else node
            if not isinstance(term, Filter) or term.name not in QUANTIFIERS or not term.args:
                raise
        target = self.as_value(self.evaluate(term.target, scope), scope)
        if target.ty.kind != "list":
            raise RuleTypeError(f"{term.name} is asked of a list here")
        keys = [fresh("__k"), fresh("__k")]
        content = [F.xxhash64(F.lit(k), *(F.col(f"`{n}`") for n in c.columns)) for k in ("a", "b")]
        x = fresh("__x")
        rows = c.df.select(*(F.col(f"`{n}`") for n in c.columns), *(h.alias(k) for h, k in zip(content, keys)), F.explode(target.col).alias(x)).where(F.col(x).isNotNull())

        def whole(outer: bool) -> Column:
            return F.col(x).outer() if outer else F.col(x)

        element = Scope(scope, target.ty.elem, scope.frame, whole, (lambda n, outer: whole(outer)[n]) if target.ty.elem.kind == "record" else None)
        held = self.as_predicate(term.args[0], element)
        hits = rows.where(~truthy(held) if term.name == "all" else condition(held)).select(*keys).distinct()
        kept = (term.name == "any") != (negated != term.negated)
        df = c.df.withColumns(dict(zip(keys, content))).join(hits, keys, "left_semi" if kept else "left_anti").drop(*keys)
        return c.with_df(df)

    @staticmethod
    def lone(one: Collection, scope: Scope) -> One | Val:
        """The item of a collection of one row at most: a scalar subquery inside rows, else the row itself."""
        if next(scope.rows(), None) is None:
            return One(one, one.item())
        return Val(one.df.select(one.item().col.alias("x")).scalar(), one.ty)

    # predicates
    def predicate_of(self, node: Node, scope: Scope) -> Callable[[Val], Val]:
        return lambda v: self.as_predicate(node, Scope.of_value(v, scope))

    def as_predicate(self, node: Node, inner: Scope) -> Val:
        """An argument of any, all, Where …: a predicate's name, a boolean field, or an expression over the item."""
        out = self.evaluate(node, inner)
        if isinstance(out, Closure):
            out = self.apply(out.name, list(out.bound), inner, item=True)
        return self.as_value(out, inner)

    def filter(self, node: Filter, scope: Scope) -> Any:
        # C:Prop:pred(args) is one filter when Prop is a property and no predicate
        if isinstance(node.target, Filter) and node.target.args is None and not node.target.negated and not self.is_callable(node.target.name):
            base = self.evaluate(node.target.target, scope)
            if isinstance(base, Collection) and base.is_record and (found := base.ty.field(node.target.name)) and found[1].kind != "bool":
                c = replace(base, planner=self)
                inner = Scope.of_collection(c, scope)
                test = self.predicate(inner.member(found[0], inner.frame), node.name, self.args(node.args, inner), inner)
                return c.with_df(c.df.where(~truthy(test) if node.negated else condition(test)))
            if isinstance(base, Val) and base.ty.kind == "record" and (found := base.ty.field(node.target.name)) and found[1].kind != "bool":
                test = self.predicate(Val(base.col[found[0]], found[1]), node.name, self.args(node.args, scope), scope)
                return boolean(~truthy(test)) if node.negated else test
        target = self.evaluate(node.target, scope)
        if isinstance(target, Collection):
            return self.filter_collection(replace(target, planner=self), node.name, node.args, node.negated, scope)
        if isinstance(target, GroupedCollection):
            return self.filter_collection(target.materialised(), node.name, node.args, node.negated, scope)
        if isinstance(target, GroupItems):
            if node.name in QUANTIFIERS:
                out = target.quantified(node.name, truthy(self.as_predicate(node.args[0], target.inner())) if node.args else F.lit(True))
                return boolean(~out.col) if node.negated else out
            target = target.listed()
        if isinstance(target, (Closure, One)):
            target = self.as_value(target, scope)
        if target.ty.kind == "list" and node.name in QUANTIFIERS:
            p = self.predicate_of(node.args[0], scope) if node.args else (lambda v: literal(True))
            out = boolean({"any": V.list_any, "none": V.list_none, "all": V.list_all}[node.name](target, p))
        else:
            if node.name in self.program.functions and node.name not in self.program.predicates:
                if node.negated:
                    raise RuleTypeError(f"{node.name} is a function and cannot be negated")
                return self.apply(node.name, [target, *self.template_args(node.args, scope.as_item(target))], scope.as_item(target), item=False)
            out = self.predicate(target, node.name, node.args if node.name in ("in", "contains", "any", "none", "all", "matches") else self.args(node.args, scope), scope)
            if out.ty.kind != "bool":
                return out
        return boolean(~truthy(out)) if node.negated else out

    def args(self, nodes: tuple[Any, ...] | None, scope: Scope) -> list[Any]:
        return [n if isinstance(n, Val) else self.as_value(self.evaluate(n, scope), scope) for n in nodes or ()]

    def template_args(self, nodes: tuple[Any, ...] | None, scope: Scope) -> list[Any]:
        return [n if isinstance(n, Val) else self.text_value(n, scope) for n in nodes or ()]

    def is_callable(self, name: str) -> bool:
        return name in self.program.predicates or name in self.program.functions

    def filter_collection(self, c: Collection, name: str, args: tuple[Any, ...] | None, negated: bool = False, scope: Scope | None = None) -> Any:
        """``C:name(args)``: rows that satisfy a predicate, or items mapped by a function."""
        scope = scope or Scope.empty()
        inner = Scope.of_collection(c, scope)
        if name in QUANTIFIERS or name in ("empty",) and not self.is_callable(name) and not (c.is_record and c.ty.field("empty")) or name == "contains" and not c.is_record:
            return self.collection_test(c, name, args, negated, scope, inner)
        if name in self.program.functions and name not in self.program.predicates:
            if negated:
                raise RuleTypeError(f"{name} is a function and cannot be negated")
            item = inner.value(inner.frame)
            out = self.apply(name, [item, *self.template_args(args, inner)], inner, item=False)
            return c.project(self.as_value(out, inner))
        if name in self.program.lets and name not in self.program.predicates:  # a closure held by a let
            held = self.let(name)
            if isinstance(held, Closure):
                return c.project(self.as_value(self.apply(held.name, [*held.bound, inner.value(inner.frame)], inner, item=False), inner))
        test = self.predicate(inner.value(inner.frame), name, list(args) if name in ("in",) and args else self.args(args, inner), inner)
        narrowed = next((p.narrowed for p in self.program.predicates.get(name, []) if p.narrowed), None)
        out = c.with_df(c.df.where(~truthy(test) if negated else condition(test)))
        if narrowed and not negated and out.is_record:
            declared = self.program.types.get(narrowed)
            bases = tuple(b for b in ((declared.bases if declared else ()) + ((c.ty.name,) if c.ty.name else ()) + c.ty.bases))
            out = out.named(narrowed, bases)
        return out

    def collection_test(self, c: Collection, name: str, args: tuple[Any, ...] | None, negated: bool, scope: Scope, inner: Scope) -> Val:
        """any, none, all, empty, contains over a collection: EXISTS with outer references to the rows around it."""
        c, inner, names = self.isolated(c, scope)
        df, link = c.df, c.link_to(names) if c.lazy else F.lit(True)
        if name == "contains":
            hidden = Scope(scope, None, inner.frame, None, None)
            probe = self.as_value(self.evaluate(args[0], hidden), hidden) if not isinstance(args[0], Val) else args[0]
            df, found = df.where(V.equal(inner.value(inner.frame), probe)), True
        elif name == "empty":
            df, found = df.where(link), False
        else:
            held = self.as_predicate(args[0], inner) if args else literal(True)
            test = truthy(held) if name == "all" else condition(held)
            df, found = df.where(link & (~test if name == "all" else test)), name == "any"
        col = df.exists() if found else ~df.exists()
        return boolean(~col if negated else col)

    def predicate(self, v: Val, name: str, args: Any, scope: Scope) -> Val:
        """``v:name(args)`` on one value; false on null, whose negation is true."""
        if name in self.program.predicates:
            return self.apply(name, [v, *self.args(tuple(args), scope)], scope.as_item(v), item=False)
        if name == "in":
            return self.in_predicate(v, args[0], scope)
        if v.ty.kind == "record" and (method := self.program.methods.get((v.ty.name or "", name))) is not None:
            return method(v, self.args(tuple(args), scope))
        if v.ty.kind == "list":
            if name == "contains":
                return boolean(V.list_contains(v, self.args(tuple(args), scope)[0]))
            if name == "empty":
                return boolean(F.coalesce(F.size(v.col) == 0, F.lit(False)))
        if name == "matches" and args and isinstance(args[0], Literal):  # braces of a pattern are its own
            args = [literal(args[0].value), *args[1:]]
        vals = self.args(tuple(args or ()), scope)
        if v.ty.kind == "record":
            found = v.ty.field(name)
            if found and not vals:
                return boolean(truthy(Val(v.col[found[0]], found[1])))
            if name in ("containsKey",):
                return boolean(F.lit(v.ty.field(str(vals[0].const)) is not None)) if vals[0].is_const else boolean(F.coalesce(V.lowered(vals[0]).isin([n.lower() for n, _ in v.ty.fields]), F.lit(False)))
            if name == "Get":
                return self.get_field(v, vals[0])
            if not v.ty.field("text"):
                language = self.language_filter(name, scope) if not vals else None
                if language is not None:
                    return language
                if self.lenient:
                    return boolean(F.lit(False))
                raise UnknownName(f"nothing is called {name}")
        if v.ty.kind == "map" and name == "containsKey":
            return boolean(F.coalesce(F.map_contains_key(v.col, V.as_text(vals[0])), F.lit(False)))
        if name in ("Trim", "Replace", "trim", "replace") and vals:
            return V.trim_suffix(v, vals[0]) if name.lower() == "trim" else V.replace_all(v, vals[0], vals[1])
        test = None
        if v.ty.numeric or v.ty.kind == "bool" and name in ("isSet", "isClear"):
            test = V.number_predicate(name, v, vals)
        if test is None and v.ty.kind in ("string", "record", "bool", "int", "number", "other"):
            test = V.string_predicate(name, v, vals)
        if test is None and v.ty.kind == "string":
            test = V.number_predicate(name, v, vals)
        if test is None:
            if v.ty.kind == "null":
                return boolean(F.lit(False))
            if isinstance(name, str) and self.is_callable(name):
                return self.apply(name, [v, *vals], scope, item=False)
            raise UnknownName(f"{v.ty.name or v.ty.kind} has no predicate {name}")
        # a test of null is false, so that its negation is true
        if name in ("lessThan", "lessOrEqual", "greaterThan", "greaterOrEqual", "isSet", "isClear"):
            return boolean(F.coalesce(test & v.col.isNotNull(), F.lit(False)), test & v.col.isNotNull())
        return boolean(F.coalesce(test, F.lit(False)), test)

    def in_predicate(self, v: Val, arg: Any, scope: Scope) -> Val:
        values = arg if isinstance(arg, Val) else self.evaluate(arg, scope)
        if isinstance(values, Collection):
            # membership in a projected collection: a semi join on the lower-case text; null is in nothing
            x = fresh("__x")
            df = values.df.select(values.item().col.alias(x)).alias(x)
            item = Val(F.col(x), values.ty)
            if values.ty.numeric and v.ty.numeric:
                test = item.col == v.col.outer()
            else:
                test = V.lowered(item) == V.lowered(v).outer()
            return boolean(F.coalesce(df.where(test).exists(), F.lit(False)))
        test = V.member_of(v, self.as_value(values, scope))
        return boolean(F.coalesce(test & v.col.isNotNull(), F.lit(False)))

    # functions
    def type_matches(self, declared: str, ty: Ty) -> bool:
        plain = declared.strip("[]")
        if declared.startswith("["):
            return ty.kind == "list" and self.type_matches(plain, ty.elem)
        if plain.lower() in ("object", "any", "item"):
            return True
        if ty.is_a(plain):
            return True
        if plain in ("string", "int", "number", "bool", "byte"):
            return ty.kind == plain or plain == "number" and ty.kind == "int"
        base = self.program.types.get(ty.name or "")
        return base is not None and plain in base.bases

    def guard(self, item: Val, guards: tuple[Guard, ...], scope: Scope) -> Column:
        """The condition of an overload: a chain of predicates, where a property's name moves on to its value."""
        out, current, moved = F.lit(True), item, False
        for g in guards:
            found = current.ty.field(g.name) if current.ty.kind == "record" else None
            if found and g.args is None and not self.is_callable(g.name) and found[1].kind != "bool" and not g.negated:
                current, moved = Val(current.col[found[0]], found[1]), True
                continue
            test = truthy(self.predicate(current, g.name, list(g.args) if g.name == "in" and g.args else self.args(g.args, scope), scope))
            out = out & (~test if g.negated else test)
            current, moved = item, False
        return out & truthy(current) if moved else out

    def apply(self, name: str, args: list[Any], scope: Scope, item: bool) -> Any:
        """A predicate or function applied; ``item``: the item of the scope is its first argument."""
        predicates, functions = self.program.predicates.get(name), self.program.functions.get(name)
        if name in self.planning:
            raise RuleTypeError("circular reference: " + " -> ".join([*self.planning[self.planning.index(name) :], name]))
        row = next(scope.rows(), None)
        if predicates:
            target = row.value(scope.frame) if item else args[0]
            self.planning.append(name)
            try:
                return self.apply_predicate(predicates, target, scope)
            finally:
                self.planning.pop()
        if not functions:
            raise UnknownName(f"nothing is called {name}")
        need = len(functions[0].params)
        if item and len(args) < need and row is not None:
            value = row.value(scope.frame)
            args = [value, *args] if functions[0].params[0][0] == functions[0].params[0][1] or not args else [*args, value]
        if len(args) < need:
            return Closure(name, tuple(args))
        self.planning.append(name)
        try:
            return self.apply_function(functions, args, scope)
        finally:
            self.planning.pop()

    def apply_predicate(self, overloads: list[PredicateDecl], target: Val, scope: Scope) -> Val:
        guarded = [p for p in overloads if p.guard and self.type_matches(p.param, target.ty)]
        plain = [p for p in overloads if not p.guard]
        typed = [p for p in plain if self.type_matches(f"[{p.param}]" if p.is_list else p.param, target.ty)]
        rest = typed[:1] or (plain[:1] if len(plain) == 1 or not guarded else [])
        plain_body = self.body(rest[0].body, rest[0].param, target, scope) if rest else literal(False)
        if rest and not guarded and target.ty.kind in ("record", "list"):
            return boolean(truthy(plain_body), condition(plain_body))
        out = truthy(plain_body)
        for p in reversed(guarded):
            out = F.when(self.guard(target, p.guard, scope), truthy(self.body(p.body, p.param, target, scope))).otherwise(out)
        if not rest and not guarded:
            raise RuleTypeError(f"{overloads[0].name} does not take {target.ty.name or target.ty.kind}")
        return boolean(F.coalesce(out & target.col.isNotNull() if target.ty.kind not in ("record", "list") else out, F.lit(False)))

    def body(self, node: Node, param: str, target: Val, scope: Scope) -> Val:
        inner = scope.as_item(target)
        return self.value(node, inner.bind(**{param: inner}))

    def apply_function(self, overloads: list[FunctionDecl], args: list[Any], scope: Scope) -> Any:
        first = args[0]
        ty = first.ty if isinstance(first, (Val, Collection)) else K.OTHER

        def run(f: FunctionDecl) -> Any:
            bindings = {p: a for (p, _), a in zip(f.params, args)} | {TEMPLATES: True}
            if not isinstance(first, Val) or isinstance(first, Closure):
                return self.evaluate(f.body, scope.bind(**bindings))
            item = scope.as_item(first)
            if f.params and first.ty.kind == "record":
                bindings[f.params[0][0]] = item
            return self.evaluate(f.body, item.bind(**bindings))

        guarded = [f for f in overloads if f.guard and self.type_matches(f.params[0][1], ty)]
        plain = [f for f in overloads if not f.guard]
        typed = [f for f in plain if self.type_matches(f.params[0][1], ty)] or plain or overloads
        if not guarded:
            return run(typed[0])
        results = [self.as_value(run(f), scope) for f in guarded]
        last = self.as_value(run(typed[0]), scope) if plain else literal(None)
        kind = last.ty
        for r in results:
            kind = K.common(kind, r.ty) if kind.kind != "record" else kind
        out = last.col if last.ty.kind != "null" else F.lit(None)
        for f, r in reversed(list(zip(guarded, results))):
            out = F.when(self.guard(first, f.guard, scope), self.cast(r, kind)).otherwise(out)
        return Val(out, results[0].ty if kind.kind == "null" else kind)

    def call(self, node: Call, scope: Scope) -> Any:
        name = node.name
        if name == "Text" and len(node.args) == 1:
            return V.text_function(self.value(node.args[0], scope))
        row = next(scope.rows(), None)
        if name == "Path" and row is not None:
            file = row.member("File", scope.frame)
            path = Val(file.col[file.ty.field("Path")[0]], K.STRING) if file is not None and file.ty.kind == "record" and file.ty.field("Path") else row.member("Path", scope.frame) or row.member("path", scope.frame)
            if path is None:
                raise UnknownName("the item has no path")
            return boolean(F.coalesce(F.regexp_replace(path.col, r"\\", "/").rlike(glob_pattern(self.value(node.args[0], scope).const)), F.lit(False)))
        if name == "Matches" and row is not None:
            v = row.value(scope.frame)
            text = v if v.ty.kind == "string" else next((row.member(n, scope.frame) for n in ("Text", "Content", "Source", "Name") if v.ty.field(n)), None)
            if text is None:
                raise UnknownName("the item has no text")
            return boolean(F.coalesce(F.rlike(V.as_text(text), F.lit(V.check_pattern(self.value(node.args[0], scope).const))), F.lit(False)))
        if name == "File":
            return self.file_bytes(str(self.value(node.args[0], scope).const))
        if name in ("Parse", "Load"):
            return self.parse_file(node, scope)
        if name in self.catalog.aggregates:
            members = None
            if node.args and isinstance(node.args[0], ListOf):
                members = tuple(n.name for n in node.args[0].items if isinstance(n, Name))
            path = self.value(node.args[1], scope).const if len(node.args) > 1 else None
            return Namespace(name, path, members)
        if self.is_callable(name):
            args = [self.call_argument(a, scope) for a in node.args]
            return self.apply(name, args, scope, item=False)
        found = scope.bound(name)
        if found is not None and isinstance(found[0], Closure):
            held = found[0]
            return self.apply(held.name, [*held.bound, *(self.call_argument(a, scope) for a in node.args)], scope, item=False)
        if name in self.program.lets and isinstance(held := self.let(name), Closure):
            return self.apply(held.name, [*held.bound, *(self.call_argument(a, scope) for a in node.args)], scope, item=False)
        if row is not None and node.args:  # a predicate of the item itself
            return self.predicate(row.value(scope.frame), name, list(node.args) if name == "in" else self.args(node.args, scope), scope)
        raise UnknownName(f"no function {name}")

    def call_argument(self, node: Node, scope: Scope) -> Any:
        if isinstance(node, Literal):
            return self.text_value(node, scope)
        return self.evaluate(node, scope)

    def file_bytes(self, path: str) -> Val:
        """The bytes of a constant path, 10 MB at most."""
        with open(path, "rb") as f:
            data = f.read(10_000_001)
        if len(data) > 10_000_000:
            raise RuleTypeError(f"{path} has more than 10 MB")
        return Val(F.lit(data), K.BINARY)

    def parse_file(self, node: Call, scope: Scope) -> Collection:
        path = str(self.value(node.args[0], scope).const)
        extension = path.rsplit(".", 1)[-1].lower() if "." in path else ""
        reader = self.catalog.readers.get(extension)
        if reader is None:
            raise RuleTypeError(f"no reader for files of the kind {extension!r}")
        ty = None
        if len(node.args) > 1:
            named = node.args[1].items[0] if isinstance(node.args[1], ListOf) else node.args[1]
            ty = self.program.types.get(named.name)
            if ty is None:
                raise UnknownName(f"no type {named.name}")
        return replace(reader(self.spark, path, ty), planner=self)

    # operators
    def binary(self, node: Binary, scope: Scope) -> Any:
        op = node.op
        if op == "&&":
            a, b = self.value(node.left, scope), self.value(node.right, scope)
            return boolean(truthy(a) & truthy(b), condition(a) & condition(b))
        if op == "||":
            a, b = self.value(node.left, scope), self.value(node.right, scope)
            return boolean(truthy(a) | truthy(b), condition(a) | condition(b))
        left, right = self.evaluate(node.left, scope), self.evaluate(node.right, scope)
        if op == "+" and isinstance(left, (Collection, GroupedCollection)) or op == "+" and isinstance(right, (Collection, GroupedCollection)):
            return self.as_collection(left).union(self.as_collection(right))
        if op == "-" and isinstance(left, Collection):
            if isinstance(right, Val) and right.is_const and isinstance(right.const, list):
                return left.without_sources([str(s) for s in right.const])
            raise RuleTypeError("a collection is reduced by a list of sources")
        a, b = self.as_value(left, scope), self.as_value(right, scope)
        if op == "==":
            return boolean(V.equal(a, b))
        if op == "!=":
            return boolean(~V.equal(a, b))
        if op in ("<", ">", "<=", ">="):
            out = V.compare(op, a, b)
            return boolean(F.coalesce(out, F.lit(False)), out)
        if op == "+":
            return V.add(a, b)
        if op == "-":
            return V.subtract(a, b)
        return V.bit_and(a, b) if op == "&" else V.bit_or(a, b)

    # templates
    def template(self, text: str, scope: Scope, strict: bool = True) -> Val:
        """A text with ``{expression}`` and ``{expression@style}`` places; ``{{`` and ``}}`` are braces."""
        cols: list[Column] = []
        const: list[str] | None = []
        for literal_text, expression, _ in parts_of(text):
            if expression is None:
                cols.append(F.lit(literal_text))
                if const is not None:
                    const.append(literal_text)
                continue
            try:
                v = self.value(expression, scope)
            except (LookupError, ValueError, RuleTypeError):
                if strict and not self.lenient:
                    raise
                v = literal("{" + expression + "}")  # an unresolved place stays as it is written
            cols.append(V.template_text(v))
            const = [*const, V.show(v.const)] if const is not None and v.is_const and not isinstance(v.const, (list, dict)) else None
        if not cols:
            return literal("")
        return Val(F.concat(*cols), K.STRING, "".join(const) if const is not None else V.NO_CONSTANT)


@dataclass(frozen=True)
class GroupedCollection:
    """``C.GroupBy(e)`` in a chain: symbolic until it is known what is used of it."""

    groups: Any
    planner: Planner

    def materialised(self) -> Collection:
        return replace(self.groups.collect(), planner=self.planner)


def glob_pattern(glob: str) -> str:
    """A glob over whole paths as an anchored pattern, case and all: ``**``, with a slash behind it or not, is any text, ``*``
    and ``?`` stay inside a folder; slashes at the end may be missing."""
    glob = glob.replace("\\", "/")
    out = []
    for m in re.finditer(r"(?P<any>\*\*/?)|(?P<some>\*)|(?P<one>\?)|(?P<end>/+$)|(?P<text>[^*?/]+|/)", glob):
        made = {"any": ".*", "some": "[^/]*", "one": "[^/]", "end": "/?" * len(m[0])}
        out.append(made.get(m.lastgroup) or re.escape(m[0]))
    return "(?s)^" + "".join(out) + "$"



__all__ = ["AmbiguousCollection", "Closure", "GroupedCollection", "Planner", "Program", "Scope", "UnknownCollection", "UnknownName"]
