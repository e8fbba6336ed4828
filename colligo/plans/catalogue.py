"""Queries over the tables of a data directory, and the same in SQL.

Most are texts of the rule language; the SQL beside each states what it means.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colligo.collection import Collection
from colligo.operators.diff import table_diff
from colligo.plans.tables import engine, rows, values
from colligo.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def rule(name: str, expression: str, sql: str, value: str | None = None) -> None:
    """A query that is one expression of the rule language."""
    QUERIES[name] = lambda spark, d: rows(spark, d, expression, value)
    ORACLE[name] = sql


def value_row(name: str, expressions: dict[str, str], sql: str) -> None:
    """A query of one row: values over whole collections."""
    QUERIES[name] = lambda spark, d: values(spark, d, **expressions)
    ORACLE[name] = sql


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


FLAGSHIP_SQL = """SELECT 'warning' AS "Severity", 'order ' || o_orderkey || ' has no large line' AS "Message", 'orders:' || o_orderkey AS "Source" FROM orders o
WHERE lower(o_orderstatus) = 'f' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders without a line of more than 49 pieces, as violations: filter, negated correlated any, record."""
    e = engine(spark, d).load("predicate large(Line) => Line.l_orderkey == Order.o_orderkey && Line.l_quantity > 49\n")
    found = e.collection("orders:finished.Where(!lineitem:any(large))")
    return found.record("Violation", Severity="'warning'", Message="'order ' + o_orderkey + ' has no large line'", Source="'orders:' + o_orderkey").rows()


QUERIES["flagship_violations"], ORACLE["flagship_violations"] = flagship, FLAGSHIP_SQL

# filters
rule("filter_ci_equals", "customer:c_mktsegment:equals('building').Select({c_custkey = c_custkey, c_mktsegment = c_mktsegment})", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
rule("filter_chain_negated", "orders:finished:!costly.Select({o_orderkey = o_orderkey})", "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) = 'f' AND NOT o_totalprice > 300000")
rule("filter_not_equals_null", "documents.Where(project != 'lantern-rules').Select({doc_id = doc_id})", "SELECT doc_id FROM documents WHERE lower(project) IS DISTINCT FROM 'lantern-rules'")
rule("filter_null_target_negated", "documents:project:!startsWith('LANTERN').Select({doc_id = doc_id})", "SELECT doc_id FROM documents WHERE NOT coalesce(starts_with(lower(project), 'lantern'), false)")
rule("filter_boolean_property", "code_statements:rethrows.Select({stmt_id = stmt_id, line = line})", "SELECT stmt_id, CAST(line AS BIGINT) AS line FROM code_statements WHERE rethrows")
rule("filter_language", "source_files:python.Select({file_id = file_id})", "SELECT file_id FROM source_files WHERE lower(language) = 'python'")
rule("filter_glob_path", "source_files.Where(Path('src/**/*.cs')).Select({file_id = file_id})", "SELECT file_id FROM source_files WHERE regexp_matches(replace(path, '\\', '/'), '^src/.*[^/]*\\.cs$')")
rule("compare_coerced_text", "orders.Where(o_orderpriority.Words.First > 2).Select({o_orderkey = o_orderkey})", "SELECT o_orderkey FROM orders WHERE coalesce(try_cast(string_split(lower(o_orderpriority), '-')[1] AS DOUBLE), 0.0) > 2")

# text
rule("string_starts", "part:p_name:sw('R').Select({p_partkey = p_partkey, p_name = p_name})", "SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'r')")
rule("string_ends", "customer:c_name:ew('7').Select({c_custkey = c_custkey})", "SELECT c_custkey FROM customer WHERE ends_with(lower(c_name), '7')")
rule("string_contains", "part:p_type:ct('econ').Select({p_partkey = p_partkey})", "SELECT p_partkey FROM part WHERE contains(lower(p_type), 'econ')")
rule("string_contains_any", "part:p_name:ca(['RED' 'blue' '']).Select({p_partkey = p_partkey})", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue')")
rule("string_matches", "part:p_type:rx('^(SM|LA)').Select({p_partkey = p_partkey, p_type = p_type})", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^(SM|LA)')")
rule("string_same_as", "code_statements:member_name:sm('pull_request').Select({stmt_id = stmt_id})", "SELECT stmt_id FROM code_statements WHERE lower(regexp_replace(member_name, '[_-]', '', 'g')) = 'pullrequest'")
rule("string_words", "part.Select({p_partkey = p_partkey, words = p_brand.Replace('#', '_').Words})", "SELECT p_partkey, list_filter(string_split(lower(replace(p_brand, '#', '_')), '_'), lambda x: x <> '') AS words FROM part")
rule("string_trim_replace", "nation.Select({n_nationkey = n_nationkey, cut = n_name.Trim('_3'), swapped = n_name.Replace('nation', 'land')})", "SELECT n_nationkey, CASE WHEN ends_with(lower(n_name), '_3') THEN left(n_name, length(n_name) - 2) ELSE n_name END AS cut, replace(n_name, 'NATION', 'land') AS swapped FROM nation")
rule("string_normalized_length", "part.Select({p_partkey = p_partkey, n = p_name.Length, up = p_name.Upper, low = p_type.Lower, norm = p_brand.Normalized})", "SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS n, upper(p_name) AS up, lower(p_type) AS low, lower(regexp_replace(p_brand, '[_-]', '', 'g')) AS norm FROM part")
rule("text_function", "documents.Select({doc_id = doc_id, p = Text(project)})", "SELECT doc_id, coalesce(project, 'null') AS p FROM documents")
rule("null_literal", "fence_blocks.Where(tag == nic).Select({block_id = block_id})", "SELECT block_id FROM fence_blocks WHERE tag IS NULL")


@query("SELECT c_name || ' has ' || c_custkey || ' in {' || c_mktsegment || '}' AS message FROM customer")
def template_message(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).collection("customer").template("{c_name} has {Customer.c_custkey} in {{{c_mktsegment}}}").rows().withColumnRenamed("value", "message")


# numbers, flags, lists, conditions
rule("in_list", "orders:o_orderpriority:in(['1-URGENT' '2-high']).Select({o_orderkey = o_orderkey})", "SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '2-high')")
rule("not_in_list", "orders:o_orderpriority:!in(['1-urgent' '5-low']).Select({o_orderkey = o_orderkey})", "SELECT o_orderkey FROM orders WHERE NOT lower(o_orderpriority) IN ('1-urgent', '5-low')")
rule("flags_is_set", "part:p_size:isSet(Middle).Select({p_partkey = p_partkey, p_size = p_size})", "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE (p_size & 4) <> 0")
rule("flags_is_clear", "part:p_size:isClear(Tiny).Select({p_partkey = p_partkey})", "SELECT p_partkey FROM part WHERE (p_size & 1) = 0")
rule("bitwise_and_or", "part.Select({p_partkey = p_partkey, low = p_size & 7, high = p_size | 8})", "SELECT p_partkey, CAST(p_size & 7 AS BIGINT) AS low, CAST(p_size | 8 AS BIGINT) AS high FROM part")
rule("add_subtract", "part.Select({p_partkey = p_partkey, more = p_size + 10, less = p_retailprice - 100, said = 'size ' + p_size})", "SELECT p_partkey, CAST(p_size + 10 AS BIGINT) AS more, p_retailprice - 100 AS less, 'size ' || p_size AS said FROM part")
rule("ternary_nested", "orders.Select({o_orderkey = o_orderkey, class = o_totalprice > 300000 ? 'large' | o_totalprice > 100000 ? 'middle' | 'small'})", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS class FROM orders")
rule("match_expression", "orders.Select({o_orderkey = o_orderkey, word = o_orderstatus ? 'f' => 'final' | 'o' => 'open' | _ => 'pending'})", "SELECT o_orderkey, CASE lower(o_orderstatus) WHEN 'f' THEN 'final' WHEN 'o' THEN 'open' ELSE 'pending' END AS word FROM orders")
rule("list_ops_embedding", "embeddings.Select({vec_id = vec_id, n = embedding.Count, first = embedding.First, top = embedding.Max(item), low = embedding.Min(item)})", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, embedding[1] AS first, CAST(list_max(embedding) AS DOUBLE) AS top, CAST(list_min(embedding) AS DOUBLE) AS low FROM embeddings")
rule("list_append_concat", "source_files.Where(usings != nic).Select({file_id = file_id, n = (usings + ['x' 'y']).Count, last = (usings + 'z').Last})", "SELECT file_id, CAST(len(usings) + 2 AS BIGINT) AS n, 'z' AS last FROM source_files WHERE usings IS NOT NULL")
rule("list_where_select", "source_files.Select({file_id = file_id, own = usings.Where(item:sw('lanternworks')).Select(item.Upper)})", "SELECT file_id, list_transform(list_filter(usings, lambda x: x IS NOT NULL AND starts_with(lower(x), 'lanternworks')), lambda x: upper(x)) AS own FROM source_files")
rule("list_first_last_single", "code_statements.Distinct(stmt_id).Select({stmt_id = stmt_id, a = arguments.First, z = arguments.Last, s = arguments.Single, second = arguments.ElementAt(1)})", "SELECT stmt_id, arguments[1] AS a, arguments[-1] AS z, CASE WHEN len(arguments) = 1 THEN arguments[1] END AS s, arguments[2] AS second FROM (SELECT DISTINCT stmt_id, arguments FROM code_statements)")
rule("list_distinct_order", "source_files.Where(usings != nic).Select({file_id = file_id, names = usings.Distinct(item).OrderBy(item)})", "SELECT file_id, list_sort(list_distinct(list_transform(usings, lambda x: x))) AS names FROM source_files WHERE usings IS NOT NULL")
rule("list_contains", "code_statements:keywords:contains('CATCH').Select({stmt_id = stmt_id, line = line})", "SELECT stmt_id, CAST(line AS BIGINT) AS line FROM code_statements WHERE list_contains(list_transform(keywords, lambda x: lower(x)), 'catch')")
rule("object_keys", "region.Select({r_regionkey = r_regionkey, keys = Region.Keys, n = Region.Count, has = Region:containsKey('R_NAME')})", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, ['r_regionkey', 'r_name'] AS keys, CAST(2 AS BIGINT) AS n, true AS has FROM region")
rule("object_get_dynamic", "nation.Select({n_nationkey = n_nationkey, v = Nation.Get(n_regionkey > 2 ? 'n_name' | 'N_REGIONKEY')})", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_regionkey > 2 THEN n_name ELSE CAST(n_regionkey AS VARCHAR) END AS v FROM nation")

# functions
rule("record_function", "lineitem:returned:toWarning('line {l_linenumber} of {Line.l_orderkey} came back')", "SELECT 'warning' AS \"Severity\", 'line ' || l_linenumber || ' of ' || l_orderkey || ' came back' AS \"Message\", l_orderkey || ':' || l_linenumber AS \"Source\" FROM lineitem WHERE lower(l_returnflag) = 'r'")
rule("guarded_overloads", "events.Select({event_id = event_id, action = handle(Event)})", "SELECT event_id, CASE lower(event_type) WHEN 'purchase' THEN 'sell' WHEN 'error' THEN 'alarm' ELSE 'ignore' END AS action FROM events")
rule("constrained_predicate", "documents:long.Select({doc_id = doc_id})", "SELECT doc_id FROM documents WHERE CASE WHEN coalesce(lower(lang) = 'en', false) THEN n_chars > 2000 ELSE n_chars > 1000 END")
rule("curried_function", "nation.n_name.Select(bracketed)", "SELECT '[' || n_name || ']' AS value FROM nation")

# sets
rule("union_bag", "region.r_name + nation.n_name", "SELECT r_name AS value FROM region UNION ALL SELECT n_name FROM nation")
rule("union_filtered_branches", "(customer.Where(c_acctbal < 0) + customer:c_mktsegment:equals('machinery')).Select({c_custkey = c_custkey})", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'machinery'")
rule("distinct_by_key", "nation.Distinct(n_regionkey).Select({n_regionkey = n_regionkey, first = n_name})", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, arg_min(n_name, n_nationkey) AS first FROM nation GROUP BY n_regionkey")
rule("distinct_values_ci", "part.p_type.Distinct", "SELECT any_value(p_type) AS value FROM part GROUP BY lower(p_type)")
rule("distinct_union", "(customer.c_mktsegment + customer.c_mktsegment).Distinct", "SELECT DISTINCT c_mktsegment AS value FROM customer")


@query("SELECT stmt_id FROM code_statements WHERE source IS NULL OR NOT source IN (SELECT source FROM code_statements WHERE source IS NOT NULL ORDER BY source LIMIT 1)")
def subtract_by_source(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    first = e.collection("code_statements").df.agg(F.min("source")).first()[0]
    return e.collection("code_statements").without_sources([first]).rows().select("stmt_id")


# groups and aggregates
rule("group_count", "customer.GroupBy(c_mktsegment).Select({segment = Key, n = Count})", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY c_mktsegment")
rule("group_items", "nation.GroupBy(n_regionkey).Select({region = Key, names = Items.Select(n_name), n = Items.Count})", "SELECT CAST(n_regionkey AS VARCHAR) AS region, list(n_name ORDER BY n_nationkey) AS names, count(*) AS n FROM nation GROUP BY n_regionkey")
rule("group_then_aggregate", "lineitem.GroupBy(l_returnflag).Select({flag = Key, top = Items.Max(l_extendedprice), low = Items.Min(l_quantity), lines = Items.Sum(l_linenumber), returned = Items.Where(l_quantity > 40).Count, any = Items:any(l_discount > 0.09)})", "SELECT l_returnflag AS flag, max(l_extendedprice) AS top, min(l_quantity) AS low, CAST(sum(l_linenumber) AS BIGINT) AS lines, count(*) FILTER (l_quantity > 40) AS returned, bool_or(l_discount > 0.09) AS \"any\" FROM lineitem GROUP BY l_returnflag")
rule("group_null_key_ci", "documents.GroupBy(lang).Select({lang = Key.Lower, n = Count})", "SELECT lower(coalesce(lang, '')) AS lang, count(*) AS n FROM documents GROUP BY lower(coalesce(lang, ''))")
rule("group_text", "nation.GroupBy(n_regionkey).Select({region = Key, names = Items.Text('{n_name}!'), sum = Items.Reduce('+', n_nationkey)})", "SELECT CAST(n_regionkey AS VARCHAR) AS region, string_agg(n_name || '!', chr(10) ORDER BY n_nationkey) AS names, CAST(sum(n_nationkey) AS BIGINT) AS sum FROM nation GROUP BY n_regionkey")


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_linenumber), 6) AS mean FROM lineitem")
def sum_min_max_avg(spark: SparkSession, d: str) -> DataFrame:
    out = engine(spark, d).collection("lineitem").aggregate(n="Count", total="Items.Sum(l_linenumber)", low="Items.Min(l_quantity)", high="Items.Max(l_quantity)", mean="Items.Average(l_linenumber)")
    return out.withColumn("mean", F.round("mean", 6))


@query("SELECT round(avg(coalesce(len(usings), 0)), 6) AS mean, CAST(sum(coalesce(len(usings), 0)) AS BIGINT) AS total, min(coalesce(len(usings), 0)) AS low FROM source_files")
def average_counts_null_as_zero(spark: SparkSession, d: str) -> DataFrame:
    out = engine(spark, d).collection("source_files").aggregate(mean="Items.Average(usings.Count)", total="Items.Sum(usings.Count)", low="Items.Min(usings.Count)")
    return out.withColumn("mean", F.round("mean", 6))


value_row("reduce_numeric", {"n": "part.Reduce('+', p_size)"}, "SELECT CAST(sum(p_size) AS BIGINT) AS n FROM part")
value_row("reduce_text", {"names": "region.Reduce('+', r_name, ', ')"}, "SELECT string_agg(r_name, ', ' ORDER BY r_regionkey) AS names FROM region")
value_row("text_join", {"all": "nation.Text('{n_nationkey}={n_name}')"}, "SELECT string_agg(n_nationkey || '=' || n_name, chr(10) ORDER BY n_nationkey) AS \"all\" FROM nation")
value_row("count_empty", {"n": "customer.Where(c_name == 'nobody').Count", "s": "customer.Where(c_name == 'nobody').Sum(c_custkey)", "none": "customer.Where(c_name == 'nobody'):empty"}, "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, true AS none")

# order and position
@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def order_by_desc_topk(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).collection("orders.OrderByDescending(o_totalprice)").limit(10).rows().select("o_orderkey", "o_totalprice")


@query("SELECT n_name AS value FROM nation ORDER BY lower(n_name), n_nationkey LIMIT 7")
def order_by_text_topk(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).collection("nation.OrderBy(n_name).n_name").limit(7).rows()


value_row("first_last_single_elementat", {"a": "nation.First(n_regionkey == 2).n_name", "z": "nation.Last(n_regionkey == 2).n_name", "one": "region.Single(r_name == 'asia').r_regionkey", "none": "nation.Single(n_regionkey == 1).n_name", "third": "nation.ElementAt(2).n_name"}, "SELECT (SELECT arg_min(n_name, n_nationkey) FROM nation WHERE n_regionkey = 2) AS a, (SELECT arg_max(n_name, n_nationkey) FROM nation WHERE n_regionkey = 2) AS z, (SELECT CAST(max(r_regionkey) AS BIGINT) FROM region WHERE lower(r_name) = 'asia') AS one, CAST(NULL AS VARCHAR) AS none, (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 2) AS third")

# correlation: semi, anti and existence joins
rule("semi_correlated", "customer.Where(orders:any(Order.o_custkey == Customer.c_custkey && Order.o_totalprice > 300000)).Select({c_custkey = c_custkey})", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
rule("anti_correlated", "customer.Where(!orders:any(Order.o_custkey == Customer.c_custkey && Order.o_totalprice > 200000)).Select({c_custkey = c_custkey})", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
rule("exists_in_or", "customer.Where(c_acctbal < 0 || orders:any(Order.o_custkey == Customer.c_custkey && Order.o_totalprice > 400000)).Select({c_custkey = c_custkey})", "SELECT c_custkey FROM customer c WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
rule("in_projected_list", "customer.Where(c_custkey:in(orders:costly.o_custkey)).Select({c_custkey = c_custkey})", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
rule("not_in_projected_list", "api_baseline.Where(!ApiEntry.signature:in(api_current.signature)).Select({entry_id = entry_id, signature = signature})", "SELECT entry_id, signature FROM api_baseline b WHERE NOT coalesce(EXISTS (SELECT 1 FROM api_current c WHERE lower(c.signature) = lower(b.signature)), false)")
rule("flattened_membership_computed", "code_statements.Where((member_name + ''):in(api_current.member_name)).Select({stmt_id = stmt_id})", "SELECT stmt_id FROM code_statements s WHERE EXISTS (SELECT 1 FROM api_current a WHERE lower(a.member_name) = lower(coalesce(s.member_name, '')))")
rule("non_equi_exists", "supplier.Where(region:any(Region.r_regionkey < Supplier.s_nationkey && Region.r_regionkey + 20 > Supplier.s_nationkey)).Select({s_suppkey = s_suppkey})", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM region r WHERE r.r_regionkey < s.s_nationkey AND r.r_regionkey + 20 > s.s_nationkey)")


@query("SELECT f.block_id FROM fence_blocks f WHERE EXISTS (SELECT 1 FROM fence_blocks g WHERE lower(g.tag) = lower(f.tag) AND g.source IS DISTINCT FROM f.source)")
def duplicate_detection(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d).load("let others = fence_blocks.Select({otag = tag, osource = source})\n")
    return e.collection("fence_blocks.Where(others:any(otag != nic && otag == FenceBlock.tag && osource != FenceBlock.source))").rows().select("block_id")


rule("navigate_parent", "nation.Select({n_nationkey = n_nationkey, region = region.First(Region.r_regionkey == Nation.n_regionkey).r_name})", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")


@query("SELECT o_orderkey, c_name AS name, c_mktsegment AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def navigate_linked(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    linked = e.collection("orders").link("Customer", e.collection("customer"), "o_custkey == c_custkey")
    return linked.record(o_orderkey="o_orderkey", name="Customer.c_name", segment="Customer.c_mktsegment").rows()


def _orders_with_lines(spark: SparkSession, d: str) -> Collection:
    e = engine(spark, d)
    return e.collection("orders").nest("Lines", e.collection("lineitem"), "o_orderkey == l_orderkey", "Line")


def nested(name: str, predicate: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: _orders_with_lines(spark, d).where(predicate).rows("o_orderkey")
    ORACLE[name] = f"SELECT o_orderkey FROM orders o WHERE {sql}"


nested("any_sublist", "Lines:any(item.l_quantity > 49)", "EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)")
nested("none_sublist", "Lines:none(returned)", "NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND lower(l.l_returnflag) = 'r')")
nested("all_sublist", "Lines:all(Line.l_quantity < 40)", "NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND NOT l.l_quantity < 40)")
nested("where_then_any", "Lines.Where(returned):any(late)", "EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND lower(l.l_returnflag) = 'r' AND l.l_quantity > 45)")
nested("outer_column_in_lambda", "Lines:any(Line.l_extendedprice + 100000 > Order.o_totalprice)", "EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_extendedprice + 100000 > o.o_totalprice)")


@query("SELECT o_orderkey AS \"key\", l_partkey AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def flatten_member(spark: SparkSession, d: str) -> DataFrame:
    c = _orders_with_lines(spark, d)
    flat = c.flatten("Lines")
    return flat.rows().select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("value"))


@query("""SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49))""")
def nested_two_levels(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    c = e.collection("customer").nest("Orders", _orders_with_lines(spark, d), "c_custkey == o_custkey", "Order")
    return c.where("Orders:any(Order.Lines:any(Line.l_quantity > 49))").rows("c_custkey")


@query("SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS n, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS total, coalesce(max(l_quantity), 0) AS top FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def nested_folds(spark: SparkSession, d: str) -> DataFrame:
    return _orders_with_lines(spark, d).record(o_orderkey="o_orderkey", n="Lines.Count", total="Lines.Sum(l_linenumber)", top="Lines.Max(l_quantity)").rows()


# code collections
rule("statements_inside_try", "code_statements:Call:insideTry.Select({stmt_id = stmt_id})", "SELECT stmt_id FROM code_statements WHERE lower(kind) = 'call' AND len(list_filter(ancestors, lambda a: a.kind = 'try')) > 0")
rule("statements_by_kind", "code_statements.GroupBy(kind).Select({kind = Key, n = Count, methods = Items.Where(in_method).Count})", "SELECT kind, count(*) AS n, count(*) FILTER (in_method) AS methods FROM code_statements GROUP BY kind")
rule("bad_generic_catch", "code_statements:error_handler.Where(generic && !rethrows).Select({stmt_id = stmt_id, m = 'catch in ' + repo})", "SELECT stmt_id, 'catch in ' || repo AS m FROM code_statements WHERE error_handler AND coalesce(generic, false) AND NOT coalesce(rethrows, false)")
rule("files_without_statements", "source_files.Where(!code_statements:any(Statement.file_id == SourceFile.file_id)).Select({file_id = file_id})", "SELECT file_id FROM source_files f WHERE NOT EXISTS (SELECT 1 FROM code_statements s WHERE s.file_id = f.file_id)")


# sources in rows
@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def parse_json_fields(spark: SparkSession, d: str) -> DataFrame:
    from colligo.sources.json_source import with_json

    e = engine(spark, d).load("type Props = { k : int }\n")
    c = with_json(e.collection("events"), "props", e.program.types["Props"], "Props")
    return c.record(event_id="event_id", k="Props.k").rows()


@query(r"SELECT block_id, CAST(i AS BIGINT) AS number, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))[i] AS text FROM (SELECT DISTINCT block_id, content FROM fence_blocks), LATERAL (SELECT unnest(range(1, len(string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) + 1)) AS i)")
def lines_collection(spark: SparkSession, d: str) -> DataFrame:
    from colligo.sources.text import lines_of

    blocks = table(spark, d, "fence_blocks").select("block_id", "content").distinct()
    return lines_of(blocks, "content", ["block_id"]).rows().select("block_id", "number", "text")


@query("SELECT block_id, sha256(trim(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12))) AS hash FROM fence_blocks WHERE content IS NOT NULL")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    from colligo.sources.text import content_hash as hashed

    return table(spark, d, "fence_blocks").where(F.col("content").isNotNull()).select("block_id", hashed(F.col("content")).alias("hash"))


# programs
@query("""SELECT 'has customers' AS name, (SELECT count(*) FROM customer) > 0 AS passed, (SELECT count(*) FROM customer) AS count
UNION ALL SELECT 'no vast debts', (SELECT count(*) FROM customer WHERE c_acctbal < -5000) = 0, (SELECT count(*) FROM customer WHERE c_acctbal < -5000)""")
def assert_results(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d).load("ASSERT(customer, 'has customers')\nASSERT_EMPTY(customer.Where(c_acctbal < 0 - 5000), 'no vast debts')\n")
    return spark.createDataFrame([(a.message, a.passed, a.count) for a in e.test().assertions], "name string, passed boolean, count bigint")


@query("""SELECT 'costlyOrders' AS "Rule", 'warning' AS "Severity", 'order ' || o_orderkey AS "Message" FROM orders WHERE o_totalprice > 300000
UNION ALL SELECT 'debts', 'error', 'debt of ' || c_name FROM customer WHERE c_acctbal < 0""")
def check_union(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d).load("""
export let costlyOrders = orders:costly.Select(Violation { Severity = 'warning', Message = 'order {o_orderkey}', Source = 'o' })
export let debts = customer.Where(c_acctbal < 0).Select(Violation { Severity = 'error', Message = 'debt of {c_name}', Source = 'c' })
""")
    return e.check().rows().select("Rule", "Severity", "Message")


@query("SELECT event_id, CASE lower(event_type) WHEN 'purchase' THEN 'sell' WHEN 'error' THEN 'alarm' ELSE 'ignore' END AS action FROM events WHERE lower(event_type) <> 'view'")
def stream_route(spark: SparkSession, d: str) -> DataFrame:
    from colligo.streaming.stream import run_to_table

    e = engine(spark, d)
    return run_to_table(e, f"{d}/events.parquet", "events", "events.Where(event_type != 'view').Select({event_id = event_id, action = handle(Event)})", "Event")


# differences between two copies
@query(None)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return table_diff(table(spark, d, "api_baseline"), table(spark, d, "api_current"), "entry_id", ["signature", "type_name", "kind"], "exported_at")


def _latest_sql(name: str) -> str:
    values = ", ".join(f"regexp_replace({c}, '[\\s\\p{{Z}}\\x{{0B}}\\x{{85}}]+', '', 'g') AS {c}" for c in ("signature", "type_name", "kind"))
    return f"(SELECT entry_id, {values} FROM {name} WHERE entry_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY exported_at DESC NULLS LAST, signature DESC NULLS LAST, type_name DESC NULLS LAST, kind DESC NULLS LAST) = 1)"


ORACLE["p3_found"] = f"""
WITH b AS {_latest_sql('api_baseline')}, c AS {_latest_sql('api_current')}
SELECT entry_id, 'missing_in_current' AS difference FROM b ANTI JOIN c USING (entry_id)
UNION ALL SELECT entry_id, 'missing_in_baseline' FROM c ANTI JOIN b USING (entry_id)
UNION ALL SELECT b.entry_id, 'signature' FROM b JOIN c USING (entry_id) WHERE b.signature IS DISTINCT FROM c.signature
UNION ALL SELECT b.entry_id, 'type_name' FROM b JOIN c USING (entry_id) WHERE b.type_name IS DISTINCT FROM c.type_name
UNION ALL SELECT b.entry_id, 'kind' FROM b JOIN c USING (entry_id) WHERE b.kind IS DISTINCT FROM c.kind
"""

from colligo.plans import programs  # noqa: E402, F401  (registers its queries)
