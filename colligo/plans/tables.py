"""The tables of a data directory as a catalog of collections, with the order and item name of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colligo.catalog import Catalog
from colligo.collection import Collection
from colligo.engine import Engine
from colligo.runtime import table

#: Table: (item name, order columns).
TABLES = {
    "region": ("Region", ["r_regionkey"]), "nation": ("Nation", ["n_nationkey"]), "customer": ("Customer", ["c_custkey"]), "supplier": ("Supplier", ["s_suppkey"]), "part": ("Part", ["p_partkey"]),
    "orders": ("Order", ["o_orderkey"]), "lineitem": ("Line", ["l_orderkey", "l_linenumber"]), "events": ("Event", ["event_id"]), "documents": ("Document", ["doc_id"]), "embeddings": ("Vector", ["vec_id"]),
    "source_files": ("SourceFile", ["file_id"]), "code_statements": ("Statement", ["stmt_id", "loaded_at"]), "fence_blocks": ("FenceBlock", ["block_id"]), "api_baseline": ("ApiEntry", ["entry_id", "exported_at"]), "api_current": ("ApiEntry", ["entry_id", "exported_at"]), "repositories": ("Repository", ["repo"]),
}

#: Types and predicates that the queries share.
PRELUDE = """
type Violation = { Severity : string, Message : string, Source : string }
flags Size = Tiny | Small | Middle | Large | Huge | Vast
predicate finished(Order) => Order.o_orderstatus == 'f'
predicate open(Order) => Order.o_orderstatus == 'O'
predicate costly(Order) => Order.o_totalprice > 300000
predicate returned(Line) => Line.l_returnflag == 'R'
predicate late(Line) => Line.l_quantity > 45
predicate english(Document) => Document.lang == 'en'
predicate long(Document:english) => Document.n_chars > 2000
predicate long(Document) => Document.n_chars > 1000
predicate Call(Statement) => Statement.kind == 'call'
predicate insideTry(Statement) => Statement.ancestors:any(item.kind == 'try')
function toWarning(Line, msg:string) => Violation { Severity = 'warning', Message = msg, Source = Line.l_orderkey + ':' + Line.l_linenumber }
function handle(Event:event_type:equals('purchase')) => 'sell'
function handle(Event:event_type:equals('error')) => 'alarm'
function handle(Event) => 'ignore'
function wrap(open:string, close:string, text:string) => open + text + close
let bracketed = wrap('[', ']')
"""


def catalog(spark: SparkSession, d: str) -> Catalog:
    out = Catalog(spark)
    for name, (item, order) in TABLES.items():
        out.register("db", name, lambda n=name, i=item, o=order: Collection.of(table(spark, d, n), i, o))
    return out


def engine(spark: SparkSession, d: str) -> Engine:
    return Engine(spark, catalog(spark, d)).load(PRELUDE)


def rows(spark: SparkSession, d: str, expression: str, value: str | None = None) -> DataFrame:
    """The items of an expression; a plain value's column gets the name ``value``, or the one given."""
    out = engine(spark, d).collection(expression).rows()
    return out.withColumnRenamed("value", value) if value else out


def values(spark: SparkSession, d: str, **expressions: str) -> DataFrame:
    """One row of values that belong to no row: whole-collection aggregates, positions, tests."""
    from colligo.lang.planner import Scope

    e = engine(spark, d)
    return spark.range(1).select(*(e.planner.value(x, Scope.empty()).col.alias(n) for n, x in expressions.items()))
