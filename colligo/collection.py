"""A collection: a DataFrame of items with a type and an order. Every operator returns a new one; nothing runs before an action.

Record items are the columns of the frame; items that are plain values stand in the column ``value``. Order columns start
with ``__``. Expressions are texts of the rule language over the item (``item.Name``, ``Type.Name`` or just ``Name``).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colligo.functions import types as K
from colligo.functions import values as V
from colligo.functions.types import Ty

if TYPE_CHECKING:
    from colligo.lang.planner import Planner, Scope

_fresh = itertools.count()
VALUE = "value"


def fresh(prefix: str = "__o") -> str:
    return f"{prefix}{next(_fresh)}"


@dataclass(frozen=True)
class Order:
    column: str
    descending: bool = False

    def expression(self, reverse: bool = False) -> Column:
        c = F.col(self.column)
        return c.desc_nulls_last() if self.descending != reverse else c.asc_nulls_first()


class NeedsLists(Exception):
    """An expression needs the lists of ``nest`` as values."""


@dataclass(frozen=True)
class Nested:
    """A list of ``children`` that is not made: those whose ``right`` column equals the item's ``left`` column."""

    field: str
    children: Collection
    left: str
    right: str

    def folded(self, df: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
        """``df`` with aggregates of its children: partial aggregation, then one join."""
        k = fresh("__k")
        return df.join(self.children.df.groupBy(F.col(f"`{self.right}`").alias(k)).agg(*(c.alias(n) for n, c in aggregates.items())), F.col(f"`{self.left}`") == F.col(k), "left").drop(k)

    def listed(self, df: DataFrame) -> DataFrame:
        """``df`` with the list as a column; an empty list if there are no children. A list is one value: all children of one
        key stand in one row, so keys with children without bound should be asked for tests and folds, which make no list."""
        children = self.children.full()
        sort = [F.col(o.column) for o in children.order]
        body = F.struct(*(F.col(f"`{n}`").alias(n) for n in children.columns)).alias("x")
        lists = children.df.groupBy(F.col(f"`{self.right}`").alias("__k")).agg(F.array_sort(F.collect_list(F.struct(*(c.alias(f"s{i}") for i, c in enumerate(sort)), body))).alias("__x"))
        lists = lists.select("__k", F.transform("__x", lambda s: s["x"]).alias("__x"))
        empty = F.filter(F.array(F.lit(None).cast(lists.schema["__x"].dataType.elementType)), lambda x: F.lit(False))
        joined = df.join(lists, F.col(f"`{self.left}`") == F.col("__k"), "left")
        return joined.withColumn(self.field, F.coalesce(F.col("__x"), empty)).drop("__k", "__x")


@dataclass(frozen=True)
class Collection:
    """``nested``: lists that the type has and the frame has not, until an expression needs them. ``lazy``: this collection is
    such a list, seen from a row around it (its scope); True as long as nothing was filtered. The equality of the keys is still
    to be demanded (``link_to``)."""

    df: DataFrame
    ty: Ty
    order: tuple[Order, ...] = ()
    planner: Planner | None = None
    nested: tuple[Nested, ...] = ()
    lazy: tuple[Nested, Scope, bool] | None = None

    # making
    @classmethod
    def of(cls, df: DataFrame, item: str | None = None, order: Sequence[str] | None = None, planner: Planner | None = None, bases: tuple[str, ...] = ()) -> Collection:
        """A frame as a collection. Without ``order`` all orderable columns tell the order, so that it is the data's own."""
        ty = K.from_spark(df.schema, item).named(item, bases)
        names = list(order) if order is not None else [n for n, t in ty.fields if t.kind in ("int", "number", "string", "bool", "other")]
        made = [(fresh(), n) for n in names]
        return cls(df.withColumns({o: F.col(f"`{n}`") for o, n in made}) if made else df, ty, tuple(Order(o) for o, _ in made), planner)

    @classmethod
    def values(cls, spark: SparkSession, items: Iterable[Any], planner: Planner | None = None) -> Collection:
        """A collection of plan-time values in their order."""
        rows = list(items)
        kind = V.make_list([V.literal(v) for v in rows]).ty.elem if rows else K.STRING
        o = fresh()
        data = [(i, None if v is None else float(v) if kind.kind == "number" else V.show(v) if kind.kind == "string" else v) for i, v in enumerate(rows)]
        df = spark.createDataFrame(data, f"`{o}` int, {VALUE} {K.to_spark(kind).simpleString() if kind.kind != 'null' else 'string'}")
        return cls(df, kind if kind.kind != "null" else K.STRING, (Order(o),), planner)

    @classmethod
    def concat_all(cls, parts: Sequence[Collection]) -> Collection:
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    # looking inside
    @property
    def is_record(self) -> bool:
        return self.ty.kind == "record"

    @property
    def columns(self) -> list[str]:
        return [n for n, _ in self.ty.fields] if self.is_record else [VALUE]

    @property
    def own_columns(self) -> list[str]:
        """The columns that the frame has."""
        lists = {n.field for n in self.nested}
        return [c for c in self.columns if c not in lists]

    def full(self) -> Collection:
        """The same with its lists made."""
        if not self.nested:
            return self
        df = self.df
        for n in self.nested:
            df = n.listed(df)
        return replace(self, df=df, nested=())

    def with_df(self, df: DataFrame) -> Collection:
        return replace(self, df=df, lazy=self.lazy and (*self.lazy[:2], False))

    def link_to(self, names: dict[str, str]) -> Column:
        """For a list seen from a row around it: the equality of the keys, ``names`` being the columns' names of the moment."""
        nested, row, _ = self.lazy
        return F.col(f"`{names.get(nested.right, nested.right)}`") == row.outer_column(nested.left)

    def named(self, item: str, bases: tuple[str, ...] = ()) -> Collection:
        return replace(self, ty=self.ty.named(item, bases))

    def rows(self, *names: str) -> DataFrame:
        """The items without order columns, in no particular order; with ``names``, only these fields."""
        if names and not {n.field for n in self.nested} & set(names):
            return self.df.select(*(F.col(f"`{c}`") for c in names))
        return self.full().df.select(*(F.col(f"`{c}`") for c in names or self.columns))

    def sorted_rows(self) -> DataFrame:
        """The items in their order: for output only."""
        self = self.full()
        df = self.df.orderBy(*(o.expression() for o in self.order)) if self.order else self.df
        return df.select(*(F.col(f"`{c}`") for c in self.columns))

    def _planner(self) -> Planner:
        from colligo.lang.planner import Planner

        return self.planner or Planner(self.df.sparkSession)

    def _scope(self) -> Scope:
        from colligo.lang.planner import Scope

        return Scope.of_collection(self)

    def value_of(self, expression: Any) -> V.Val:
        """An expression over the item: text of the rule language, a Column, or a Val."""
        if isinstance(expression, V.Val):
            return expression
        if isinstance(expression, Column):
            return V.Val(expression, K.from_spark(self.df.select(expression.alias("x")).schema["x"].dataType))
        if self.nested:
            raise NeedsLists
        return self._planner().value(expression, self._scope())

    def values_of(self, **expressions: Any) -> tuple[Collection, dict[str, V.Val]]:
        """Expressions over the item, and the collection whose frame has what they use: lists of ``nest`` are made only where an
        expression needs one as a value; their folds become one aggregate, tests of them semi and anti joins."""
        if self.nested and all(isinstance(e, str) for e in expressions.values()):
            scope = self._scope()
            try:
                vals = {n: self._planner().value(e, scope) for n, e in expressions.items()}
                df = self.df
                for nested, aggregates in scope.folds.items():
                    df = nested.folded(df, aggregates)
                return replace(self, df=df), vals
            except NeedsLists:
                pass
        whole = self.full()
        return whole, {n: whole.value_of(e) for n, e in expressions.items()}

    def item(self) -> V.Val:
        return V.Val(F.struct(*(F.col(f"`{c}`").alias(c) for c in self.columns)), self.ty) if self.is_record else V.Val(F.col(VALUE), self.ty)

    # filters and projections
    def where(self, predicate: Any) -> Collection:
        if isinstance(predicate, str) and not self.nested:
            from colligo.lang.parser import parse_expression

            return self._planner().restricted(self, parse_expression(predicate))
        base, vals = self.values_of(p=predicate)
        return base.with_df(base.df.where(V.condition(vals["p"])))

    def filter(self, name: str, *args: Any, negated: bool = False) -> Collection:
        """``C:name(args)`` of the rule language."""
        return self._planner().filter_collection(self.full(), name, tuple(V.literal(a) for a in args) if args else None, negated)

    def project(self, value: V.Val, keep_null: bool = True) -> Collection:
        """Items replaced by a value over them."""
        orders = [F.col(o.column) for o in self.order]
        if value.ty.kind == "record":
            h = fresh("__r")
            df = self.df.select(value.col.alias(h), *orders)
            if not keep_null:
                df = df.where(F.col(h).isNotNull())
            df = df.select(*(F.col(h)[n].alias(n) for n, _ in value.ty.fields), *orders)
        else:
            col = value.col
            if keep_null and value.ty.kind == "string":
                col = F.coalesce(col, F.lit(""))
            df = self.df.select(col.alias(VALUE), *orders)
            if not keep_null:
                df = df.where(F.col(VALUE).isNotNull())
        return Collection(df, value.ty, self.order, self.planner)

    def select(self, expression: Any) -> Collection:
        """``C.Select(e)``: one value per item; a missing text is ''."""
        base, vals = self.values_of(v=expression)
        return base.project(vals["v"])

    def record(self, item: str | None = None, /, **fields: Any) -> Collection:
        """Items replaced by records of the given expressions."""
        base, vals = self.values_of(**fields)
        df = base.df.select(*(v.col.alias(n) for n, v in vals.items()), *(F.col(o.column) for o in self.order))
        return Collection(df, K.record([(n, v.ty) for n, v in vals.items()], item), self.order, self.planner)

    def extend(self, **fields: Any) -> Collection:
        """Fields added to the items."""
        base, vals = self.values_of(**fields)
        df = base.df.withColumns({n: v.col for n, v in vals.items()})
        kept = [(n, t) for n, t in self.ty.fields if n not in vals]
        return Collection(df, K.record([*kept, *((n, v.ty) for n, v in vals.items())], self.ty.name, self.ty.bases), self.order, self.planner, tuple(n for n in base.nested if n.field not in vals))

    def flatten(self, expression: Any) -> Collection:
        """Member access on a collection: lists become their elements, null results are dropped."""
        nested = next((n for n in self.nested if n.field == expression), None)
        if nested is not None:  # the children themselves, in the order of the items and their own
            c = nested.children.full()
            key, renamed = fresh("__k"), {o.column: fresh() for o in c.order}
            right = c.df.select(F.col(f"`{nested.right}`").alias(key), *(F.col(f"`{n}`").alias(n) for n in c.columns), *(F.col(a).alias(b) for a, b in renamed.items()))
            left = self.df.select(F.col(f"`{nested.left}`").alias("__left"), *(F.col(o.column) for o in self.order))
            df = left.join(right, F.col("__left") == F.col(key)).drop("__left", key)
            return Collection(df, c.ty, (*self.order, *(Order(renamed[o.column], o.descending) for o in c.order)), self.planner)
        self = self.full()
        v = self.value_of(expression)
        if v.ty.kind != "list":
            return self.project(v, keep_null=False)
        pos, el = fresh(), fresh("__e")
        orders = [F.col(o.column) for o in self.order]
        df = self.df.select(*orders, F.posexplode(v.col).alias(pos, el)).where(F.col(el).isNotNull())
        elem = v.ty.elem
        cols = [F.col(el)[n].alias(n) for n, _ in elem.fields] if elem.kind == "record" else [F.col(el).alias(VALUE)]
        return Collection(df.select(*cols, *orders, pos), elem, (*self.order, Order(pos)), self.planner)

    def template(self, text: str) -> Collection:
        """One text per item from a template with ``{path}`` places."""
        self = self.full()
        return self.project(self._planner().template(text, self._scope()))

    # order and position
    def order_by(self, expression: Any, descending: bool = False) -> Collection:
        key = fresh()
        base, vals = self.values_of(v=expression)
        df = base.df.withColumn(key, V.sort_key(vals["v"]))
        return replace(base, df=df, order=(Order(key, descending), *self.order), lazy=None)

    def limit(self, n: int) -> Collection:
        """The first ``n`` items in order (a top-k, not a sort of everything)."""
        return self.with_df(self.df.orderBy(*(o.expression() for o in self.order)).limit(n))

    def first(self, predicate: Any = None) -> Collection:
        base = self if predicate is None else self.where(predicate)
        return base.limit(1)

    def last(self, predicate: Any = None) -> Collection:
        base = self if predicate is None else self.where(predicate)
        return base.with_df(base.df.orderBy(*(o.expression(reverse=True) for o in base.order)).limit(1))

    def single(self, predicate: Any = None) -> Collection:
        """The item if there is exactly one, else none."""
        base = self if predicate is None else self.where(predicate)
        two = base.limit(2).df.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(F.lit(1))))  # of two rows at most
        return base.with_df(two.where("__n = 1").drop("__n"))

    def element_at(self, index: int) -> Collection:
        if index < 0:
            return self.with_df(self.df.limit(0))
        ordered = self.df.orderBy(*(o.expression() for o in self.order)).limit(index + 1)
        return self.with_df(ordered.orderBy(*(o.expression() for o in self.order)).offset(index))

    # groups and sets
    def distinct(self, expression: Any = None) -> Collection:
        """The first item of each key, in order of first appearance."""
        self = self.full()
        key = V.key_text(self.item() if expression is None else self.value_of(expression)) if expression is not None or not self.is_record else F.lower(F.to_json(self.item().col, {"ignoreNullFields": "false"}))
        if any(o.descending for o in self.order) or not self.order:
            rank = F.row_number().over(W.partitionBy("__k").orderBy(*(o.expression() for o in self.order) if self.order else F.lit(1)))
            return self.with_df(self.df.withColumn("__k", key).withColumn("__n", rank).where("__n = 1").drop("__n", "__k"))
        # a minimum by order keeps one row per key in each task before the shuffle
        names = [*self.columns, *(o.column for o in self.order)]
        first = _hashed(F.min_by(F.struct(*(F.col(f"`{n}`").alias(n) for n in names)), F.struct(*(F.col(o.column) for o in self.order)))).alias("r")
        picked = self.df.groupBy(key.alias("__k")).agg(first)
        return self.with_df(picked.select(*(F.col("r")[n].alias(n) for n in names)))

    def group_by(self, expression: Any) -> Groups:
        whole = self.full()
        return Groups(whole, whole.value_of(expression))

    def union(self, other: Collection) -> Collection:
        """All items of this one, then all of the other; the item type is this one's."""
        self, other = self.full(), other.full()
        branch = fresh()
        parts, orders = [], [Order(branch)]
        for i, c in enumerate((self, other)):
            names = {o.column: fresh() for o in c.order}
            parts.append(c.df.select(F.lit(i).alias(branch), *(F.col(f"`{n}`") for n in c.columns), *(F.col(a).alias(b) for a, b in names.items())))
            orders += [Order(names[o.column], o.descending) for o in c.order]
        df = parts[0].unionByName(parts[1], allowMissingColumns=True)
        ty = self.ty
        if self.is_record and other.is_record:
            known = {n for n, _ in self.ty.fields}
            ty = K.record([*self.ty.fields, *((n, t) for n, t in other.ty.fields if n not in known)], self.ty.name, self.ty.bases)
        return Collection(df, ty, tuple(orders), self.planner)

    __add__ = union

    def without_sources(self, sources: Sequence[str], field: str = "Source") -> Collection:
        """``C - [..]``: drops items whose source text is listed, case and all; items without a source stay."""
        found = self.ty.field(field) if self.is_record else None
        if not found or not sources:
            return self
        c = F.col(f"`{found[0]}`").cast("string")
        return self.with_df(self.df.where(c.isNull() | ~c.isin(list(sources))))

    # whole-collection values
    def scalar(self, aggregate: Column) -> Column:
        """A value over the whole collection, as a scalar subquery."""
        return self.df.select(aggregate.alias("x")).scalar()  # select, not agg: nothing may look at the schema yet

    def count(self) -> V.Val:
        return V.Val(F.coalesce(self.scalar(F.count(F.lit(1))), F.lit(0).cast("bigint")), K.INT)

    def fold(self, name: str, expression: Any) -> V.Val:
        col, ty = fold_column(name, self.value_of(expression))
        return V.Val(self.scalar(col), ty)

    def text(self, template: str, separator: str = "\n") -> V.Val:
        """All items as text, one template each, in order. The text is one value: all its parts stand in one row of one task, so it
        is for collections whose text one task can hold; ``template`` gives the lines as rows."""
        return self.joined(self._planner().template(template, self._scope()), separator)

    def joined(self, value: V.Val, separator: str) -> V.Val:
        return V.Val(F.coalesce(self.scalar(joined_text(V.as_text(value), separator, self.order)), F.lit("")), K.STRING)

    def reduce(self, op: str, expression: Any, separator: str = "") -> V.Val:
        if op != "+":
            raise V.RuleTypeError("Reduce knows the operator '+' only")
        v = self.value_of(expression)
        return self.joined(v, separator) if v.ty.kind == "string" else self.fold("Sum", v)

    def aggregate(self, **expressions: str) -> DataFrame:
        """One row of aggregates, as of one group: ``total="Items.Sum(x)"``, ``n="Count"``."""
        return Groups(self.full(), None).aggregate(**expressions)

    # correlation
    def exists(self) -> Column:
        return self.df.exists()

    def link(self, field: str, other: Collection, on: str, item: str | None = None) -> Collection:
        """A field with the one item of ``other`` that ``on`` finds (an N:1 lookup by equality), null if none."""
        self, other = self.full(), other.full()
        o = {n: fresh("__l") for n in other.columns}
        right = other.df.select(*(F.col(f"`{n}`").alias(a) for n, a in o.items()))
        left_key, right_key = (x.strip() for x in on.split("=="))
        whole = F.when(F.col(o[right_key]).isNotNull(), F.struct(*(F.col(a).alias(n) for n, a in o.items())))
        df = self.df.join(right, self.value_of(left_key).col == F.col(o[right_key]), "left").withColumn(field, whole).drop(*o.values())
        return Collection(df, K.record([*self.ty.fields, (field, other.ty.named(item or other.ty.name))], self.ty.name, self.ty.bases), self.order, self.planner)

    def nest(self, field: str, children: Collection, on: str, item: str | None = None) -> Collection:
        """A field with the list of ``children`` found by equality, in their order; an empty list if none. The list is made only
        where an expression needs it as a value."""
        left_key, right_key = (x.strip() for x in on.split("=="))
        elem = children.ty.named(item or children.ty.name)
        ty = K.record([*self.ty.fields, (field, K.list_of(elem))], self.ty.name, self.ty.bases)
        return replace(self, ty=ty, nested=(*self.nested, Nested(field, replace(children, ty=elem), self.ty.field(left_key)[0], children.ty.field(right_key)[0])))


def fold_column(name: str, v: V.Val) -> tuple[Column, Ty]:
    """An aggregate over rows: null values count as 0; of nothing the result is 0."""
    whole = v.ty.kind in ("int", "bool")
    x = V.number(v).cast("bigint" if whole else "double")
    zero = F.lit(0).cast("bigint") if whole else F.lit(0.0)
    if name == "Average":
        return F.coalesce(F.avg(V.number(v).cast("double")), F.lit(0.0)), K.NUMBER
    out = F.sum(x) if name == "Sum" else F.min(x) if name == "Min" else F.max(x)
    return F.coalesce(out, zero), K.INT if whole else K.NUMBER


def joined_text(text: Column, separator: str, order: Sequence[Order]) -> Column:
    """Texts of a group joined in the order of the items."""
    pairs = F.array_sort(F.collect_list(F.struct(*(F.col(o.column).alias(f"o{i}") for i, o in enumerate(order)), F.coalesce(text, F.lit("")).alias("x"))), _comparator(order))
    return F.array_join(F.transform(pairs, lambda p: p["x"]), separator)


def _comparator(order: Sequence[Order]):
    """Comparison of ``(o0, o1, …)`` structs that minds descending keys and nulls."""
    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i, o in reversed(list(enumerate(order))):
            x, y, s = a[f"o{i}"], b[f"o{i}"], -1 if o.descending else 1
            out = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), F.lit(-s)).when(y.isNull(), F.lit(s)).when(x < y, F.lit(-s)).when(x > y, F.lit(s)).otherwise(out)
        return out

    return compare


def _hashed(aggregate: Column) -> Column:
    """An aggregate whose state is a text or a struct, which alone makes Spark sort all rows of each task by the group's key.
    Beside a collecting aggregate, here of nothing, states are objects in a hash table; it is sorted only if it grows large."""
    return F.when(F.size(F.collect_list(F.lit(None).cast("int"))) == 0, aggregate)


@dataclass(frozen=True)
class Groups:
    """Groups ``{Key, Items, Count}``, kept symbolic: aggregates of the items become aggregates of the frame, and a list of
    items is made only where it is used."""

    base: Collection
    key: V.Val | None

    def aggregate(self, **expressions: str) -> DataFrame:
        c = self.select_record(**expressions)
        return c.rows()

    def _apply(self, build) -> tuple[DataFrame, tuple[Order, ...], Any]:
        from colligo.lang.planner import GroupScope

        scope = GroupScope(self.base, self.key)
        built = build(scope)
        df = self.base.df
        orders: list[Order] = []
        aggs = dict(scope.aggregates)
        if self.key is None:
            return df.agg(*(c.alias(n) for n, c in aggs.items()) or [F.count(F.lit(1)).alias("__n")]), (), built
        if not any(o.descending for o in self.base.order) and self.base.order:
            o = fresh()
            aggs[o] = _hashed(F.min(F.struct(*(F.col(x.column) for x in self.base.order))))
            orders.append(Order(o))
            shown = _hashed(F.min_by(F.coalesce(V.as_text(self.key), F.lit("")), F.struct(*(F.col(x.column) for x in self.base.order))))
        else:
            shown = _hashed(F.min(F.coalesce(V.as_text(self.key), F.lit(""))))
        if scope.uses_key:
            aggs[scope.key_column] = shown
        grouped = df.groupBy(V.key_text(self.key).alias("__key")).agg(*(c.alias(n) for n, c in aggs.items()) if aggs else [F.count(F.lit(1)).alias("__n")])
        return grouped, tuple(orders), built

    def select(self, expression: str) -> Collection:
        df, orders, v = self._apply(lambda s: self.base._planner().value(expression, s))
        return Collection(df, K.record([]), orders, self.base.planner).project(v)

    def select_record(self, **expressions: str) -> Collection:
        df, orders, vals = self._apply(lambda s: {n: self.base._planner().value(e, s) for n, e in expressions.items()})
        out = df.select(*(v.col.alias(n) for n, v in vals.items()), *(F.col(o.column) for o in orders))
        return Collection(out, K.record([(n, v.ty) for n, v in vals.items()], "Group"), orders, self.base.planner)

    def collect(self) -> Collection:
        """Groups with their lists of items, in order of first appearance."""
        return self.select_record(Key="Key", Items="Items", Count="Count").named("Group")

    def where(self, expression: str) -> Collection:
        """Groups that satisfy an expression over Key, Items and Count."""
        c = self.select_record(Key="Key", Items="Items", Count="Count", __keep=expression)
        kept = c.df.where(V.truthy(V.Val(F.col("__keep"), c.ty.field("__keep")[1]))).drop("__keep")
        return Collection(kept, K.record([f for f in c.ty.fields if f[0] != "__keep"], "Group"), c.order, c.planner)
