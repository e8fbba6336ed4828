"""Queries over sources in rows — code, Markdown, paths — and over whole programs: commands, output, files, packages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colligo.catalog import Catalog
from colligo.collection import Collection
from colligo.engine import Engine
from colligo.plans.catalogue import ORACLE, QUERIES, query, rule, value_row
from colligo.plans.tables import PRELUDE, catalog, engine
from colligo.runtime import ensure_checkpoint_dir, table
from colligo.sources import register_all

# Lines of a Markdown file with the number of fence marks so far: a line is outside of fences if it is even and no mark itself.
_MD_LINES = r"""WITH l AS (SELECT file_id, i, string_split(t, chr(10))[i] AS x FROM (SELECT file_id, replace(replace(raw_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM source_files WHERE lower(path) LIKE '%.md' AND raw_text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i)),
m AS (SELECT *, regexp_matches(x, '^\s{0,3}(```|~~~)') AS fence, sum(regexp_matches(x, '^\s{0,3}(```|~~~)')::INT) OVER (PARTITION BY file_id ORDER BY i) AS marks FROM l),
h AS (SELECT *, NOT fence AND marks % 2 = 0 AND regexp_matches(x, '^\s{0,3}#{1,6}([ \t]|$)') AS heading FROM m)"""


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").where(F.lower("path").endswith(".md")).select("file_id", F.col("raw_text").alias("text"))


@query(_MD_LINES + r""" SELECT file_id, regexp_extract(x, '^\s{0,3}#{1,6}(?:[ \t]+(.*?))?[ \t]*#*[ \t]*$', 1) AS "Text", CAST(length(regexp_extract(x, '#+')) AS BIGINT) AS "Level", CAST(i AS BIGINT) AS "Line" FROM h WHERE heading""")
def markdown_headings(spark: SparkSession, d: str) -> DataFrame:
    from colligo.sources.markdown import headings

    return headings(_markdown(spark, d), ["file_id"]).rows()


@query(_MD_LINES + r""", s AS (SELECT *, sum(heading::INT) OVER (PARTITION BY file_id ORDER BY i) AS section FROM h)
SELECT file_id, regexp_extract(max(x) FILTER (heading), '^\s{0,3}#{1,6}(?:[ \t]+(.*?))?[ \t]*#*[ \t]*$', 1) AS "Heading", CAST(max(length(regexp_extract(x, '#+'))) FILTER (heading) AS BIGINT) AS "Level", coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT heading), '') AS "Content", CAST(min(i) AS BIGINT) AS "StartLine", CAST(max(i) AS BIGINT) AS "EndLine" FROM s WHERE section > 0 GROUP BY file_id, section""")
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    from colligo.sources.markdown import sections

    return sections(_markdown(spark, d), ["file_id"]).rows()


@query(_MD_LINES + r""", o AS (SELECT file_id, marks, min(i) AS a, max(i) FILTER (NOT fence) AS z, string_agg(x, chr(10) ORDER BY i) FILTER (NOT fence) AS body FROM m WHERE marks % 2 = 1 GROUP BY file_id, marks)
SELECT file_id, CAST(a AS BIGINT) AS "StartLine", coalesce(body, '') AS "Content", sha256(trim(coalesce(body, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12))) AS "ContentHash" FROM o""")
def markdown_fences(spark: SparkSession, d: str) -> DataFrame:
    from colligo.sources.markdown import fence_blocks

    return fence_blocks(_markdown(spark, d), ["file_id"]).rows("file_id", "StartLine", "Content", "ContentHash")


@query("SELECT doc_id, 'see ' || source AS \"Text\", 'https://example.invalid/' || doc_id AS \"Url\", CAST(2 AS BIGINT) AS \"Line\" FROM documents WHERE source IS NOT NULL")
def markdown_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of a Markdown text per document; images and fenced lines hold none."""
    from colligo.sources.markdown import links

    where = F.concat(F.lit("https://example.invalid/"), F.col("doc_id"))
    text = F.concat(F.lit("![no]("), where, F.lit(")\n[see "), F.col("source"), F.lit("]("), where, F.lit(' "title")\n```\n[not]('), where, F.lit(")\n```\n"))
    return links(table(spark, d, "documents").select("doc_id", text.alias("text")), ["doc_id"]).rows("doc_id", "Text", "Url", "Line")


# source code
_CODE_TYPES = r"""SELECT file_id, regexp_extract(t, '^\s*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly)\s+)*(?:class|interface|enum|struct|record)\s+(\w+)', 1) AS "Name", CAST(i AS BIGINT) AS "Line",
regexp_matches(t, '\b(public)\b') AS public, regexp_matches(t, '\b(abstract)\b') AS abstract FROM (SELECT file_id, i, string_split(replace(raw_text, chr(65279), ''), chr(10))[i] AS t FROM source_files, LATERAL (SELECT unnest(range(1, len(string_split(raw_text, chr(10))) + 1)) AS i) WHERE lower(path) LIKE '%.cs' AND raw_text IS NOT NULL)
WHERE regexp_matches(t, '^\s*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly)\s+)*(?:class|interface|enum|struct|record)\s+(\w+)')"""


@query(_CODE_TYPES)
def code_types_csharp(spark: SparkSession, d: str) -> DataFrame:
    from colligo.sources.code import MODIFIERS, parsed_files, types

    files = table(spark, d, "source_files").where(F.lower("path").endswith(".cs"))
    found = types(parsed_files(files, parts=["types"]), top_only=False).rows("file_id", "Name", "Line", "Modifiers")
    flag = lambda n: F.col("Modifiers").bitwiseAND(F.lit(MODIFIERS[n])) != 0
    return found.select("file_id", "Name", "Line", flag("public").alias("public"), flag("abstract").alias("abstract"))


@query(None)
def code_types(spark: SparkSession, d: str) -> DataFrame:
    from colligo.sources.code import parsed_files, types

    return types(parsed_files(table(spark, d, "source_files"), parts=["types"])).rows("file_id", "Name", "Kind", "Modifiers", "Line", "BaseTypes", "MethodNames")


@query(None)
def code_api(spark: SparkSession, d: str) -> DataFrame:
    from colligo.sources.code import api, parsed_files

    return api(parsed_files(table(spark, d, "source_files"), parts=["types"])).rows()


@query(None)
def code_members(spark: SparkSession, d: str) -> DataFrame:
    from colligo.sources.code import members, parsed_files

    return members(parsed_files(table(spark, d, "source_files"), parts=["types"])).rows()


def _statements(name: str, extension: str, kinds: tuple[str, ...]) -> None:
    """Statements that the parser finds, against the delivered listing: files without a listing (later scans) are left out."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        from colligo.sources.code import parsed_files, statements

        listed = table(spark, d, "code_statements").select("file_id").distinct()
        files = table(spark, d, "source_files").where(F.lower("path").endswith(extension)).join(listed, "file_id", "left_semi")
        found = statements(parsed_files(files, parts=["statements"])).where(" || ".join(f"Kind == '{k}'" for k in kinds))
        return found.rows("file_id", "Kind", "Line", "InMethod", "Generic", "ErrorHandler").groupBy("file_id", "Kind", "Line", "InMethod", "Generic", "ErrorHandler").agg(F.count(F.lit(1)).alias("n"))

    wanted = ", ".join(f"'{k}'" for k in kinds)
    QUERIES[name] = run
    ORACLE[name] = f"""SELECT file_id, kind AS "Kind", CAST(line AS BIGINT) AS "Line", in_method AS "InMethod", coalesce(generic, false) AS "Generic", coalesce(error_handler, false) AS "ErrorHandler", count(*) AS n FROM (SELECT DISTINCT s.stmt_id, s.file_id, s.kind, s.line, s.in_method, s.generic, s.error_handler FROM code_statements s JOIN source_files f USING (file_id)
WHERE lower(f.path) LIKE '%{extension}' AND s.kind IN ({wanted})) GROUP BY ALL"""


_statements("code_statements_csharp", ".cs", ("try", "catch", "throw", "if", "foreach", "await", "using"))
_statements("code_statements_javascript", ".js", ("try", "catch", "throw", "if"))
_statements("code_statements_python", ".py", ("throw", "using"))


# paths
@query("SELECT file_id, CASE lower(regexp_extract(replace(path, '\\', '/'), '\\.([^./]+)$', 1)) WHEN 'cs' THEN 'csharp' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'md' THEN 'markdown' WHEN 'json' THEN 'json' WHEN 'yml' THEN 'yaml' WHEN 'yaml' THEN 'yaml' WHEN 'sln' THEN 'text' WHEN 'editorconfig' THEN 'editorconfig' END AS language, '.' || lower(regexp_extract(replace(path, '\\', '/'), '\\.([^./]+)$', 1)) IN ('.md', '.json') AS plain FROM source_files")
def language_by_extension(spark: SparkSession, d: str) -> DataFrame:
    from colligo.sources.text import language_of

    language = language_of(F.col("path"))
    return table(spark, d, "source_files").select("file_id", language.alias("language"), F.coalesce(language.isin("markdown", "json"), F.lit(False)).alias("plain"))


@query("SELECT block_id, 'r' || block_id AS \"Name\", CAST(2 AS BIGINT) AS \"StartLine\", CAST(6 AS BIGINT) AS \"EndLine\", '#region inner' || chr(10) || 'x' || chr(10) || '#endregion' AS \"Content\" FROM (SELECT DISTINCT block_id FROM fence_blocks) UNION ALL SELECT block_id, 'inner', 3, 5, 'x' FROM (SELECT DISTINCT block_id FROM fence_blocks)")
def code_regions(spark: SparkSession, d: str) -> DataFrame:
    """Nested regions of a text made for each block."""
    from colligo.sources.text import regions_of

    text = F.concat(F.lit("a\n#region r"), F.col("block_id"), F.lit("\r\n  #region inner\nx\n#endregion\n#endregion\n#endregion stray\n"))
    blocks = table(spark, d, "fence_blocks").select("block_id", text.alias("text")).distinct()
    out = regions_of(blocks, "text", ["block_id"]).rows("block_id", "Name", "StartLine", "EndLine", "Content")
    return out.withColumn("Content", F.regexp_replace("Content", r"(?m)^\s+", ""))


@query("""SELECT n_nationkey, 'p' || n_nationkey AS "Name", CASE n_nationkey % 3 WHEN 0 THEN 'javascript' WHEN 1 THEN 'python' ELSE 'csharp' END AS "Language",
CASE n_nationkey % 3 WHEN 0 THEN ['left', 'right'] WHEN 1 THEN ['numbers'] ELSE ['p' || coalesce((SELECT max(m.n_nationkey) FROM nation m WHERE m.n_nationkey % 3 = 2 AND m.n_nationkey < n.n_nationkey), 0) ] END AS "References" FROM nation n""")
def projects(spark: SparkSession, d: str) -> DataFrame:
    """Manifests made for each nation; C# ones refer to the one before by its path, the first to one that is not there."""
    from colligo.sources.projects import discover

    n, before = F.col("n_nationkey"), F.col("n_nationkey") - 3
    path = F.concat(F.lit("src/p"), n)
    package = F.concat(F.lit('{"name": "p'), n, F.lit('", "dependencies": {"left": "1"}, "devDependencies": {"right": "2"}}'))
    toml = F.concat(F.lit('[project]\nname = "p'), n, F.lit('"\ndependencies = ["numbers>=2"]\n'))
    earlier = F.when(before >= 0, F.concat(F.lit("..\\p"), before, F.lit("\\Made"), before)).otherwise(F.lit("..\\p0"))
    csproj = F.concat(F.lit("<Project><PropertyGroup><AssemblyName>p"), n, F.lit('</AssemblyName></PropertyGroup><ItemGroup><ProjectReference Include="'), earlier, F.lit('.csproj"/></ItemGroup></Project>'))
    kind = n % 3
    manifests = table(spark, d, "nation").select(
        F.concat(path, F.when(kind == 0, F.lit("/package.json")).when(kind == 1, F.lit("/pyproject.toml")).otherwise(F.concat(F.lit("/Made"), n, F.lit(".csproj")))).alias("Path"),
        F.when(kind == 0, package).when(kind == 1, toml).otherwise(csproj).alias("Text"))
    found = discover(manifests)
    return found.select(F.regexp_extract("Path", r"p(\d+)/", 1).cast("int").alias("n_nationkey"), "Name", "Language", "References")


# namespaces, aggregates, paths
rule("collection_qualified", "db.customer.Where(db.orders:any(Order.o_custkey == Customer.c_custkey && Order.o_totalprice > 400000)).Select({c_custkey = c_custkey})", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")


def _two_namespaces(spark: SparkSession, d: str) -> Catalog:
    """Customers and suppliers as ``Parties`` of two namespaces, and the aggregate ``Trade`` of both; a path narrows by segment."""
    out = catalog(spark, d)

    def parties(name: str, key: str, label: str):
        def made(path: str | None = None) -> Collection:
            rows = table(spark, d, name).select(F.col(key).cast("bigint").alias("Id"), F.col(label).alias("Name"))
            return Collection.of(rows.where(F.col("Name").contains(path)) if path else rows, "Party", ["Id"])

        return made

    for space, (name, key, label) in {"buyers": ("customer", "c_custkey", "c_name"), "sellers": ("supplier", "s_suppkey", "s_name")}.items():
        make = parties(name, key, label)
        out.register_source(space, lambda _, path, names, m=make: {n: m(path) for n in names if n == "Parties"}, ["Parties"])
        out.register(space, "Parties", make)
    out.register_aggregate("Trade")
    return out


@query("SELECT CAST(c_custkey AS BIGINT) AS \"Id\", c_name AS \"Name\" FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 7 = 0")
def collection_aggregate(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark, _two_namespaces(spark, d)).load(PRELUDE)
    found = e.collection("Trade.Parties")
    return found.rows("Id", "Name").where("Id % 7 = 0")


@query("SELECT CAST(c_custkey AS BIGINT) AS \"Id\", c_name AS \"Name\" FROM customer WHERE contains(c_name, '11')")
def collection_at_path(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, _two_namespaces(spark, d)).load(PRELUDE).collection("buyers.Parties('11')").rows("Id", "Name")


@query("SELECT CAST(s_suppkey AS BIGINT) AS \"Id\", s_name AS \"Name\" FROM supplier WHERE contains(s_name, '1') UNION ALL SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '1')")
def collection_aggregate_members(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, _two_namespaces(spark, d)).load(PRELUDE).collection("Trade([sellers, buyers], '1').Parties").rows("Id", "Name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0")
def parse_declared_file(spark: SparkSession, d: str) -> DataFrame:
    """A file read by its extension with a declared type; fields of the file that the type does not name are not read."""
    e = Engine(spark, register_all(catalog(spark, d))).load(PRELUDE).load("type Buyer = { c_custkey : int, c_name : string, c_acctbal : number }\n")
    return e.collection(f"Parse('{d}/customer.parquet', [Buyer]).Where(c_acctbal < 0)").rows("c_custkey", "c_name")


# programs
def _printed(e: Engine, names: list[str] | None = None) -> DataFrame:
    """What a run prints: command and message."""
    out = e.run(names)
    parts = [p.messages.rows().select(F.lit(p.command).cast("string").alias("command"), F.col("value").alias("message")) for p in out.printed]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole


@query("SELECT 'report' AS command, 'order ' || o_orderkey || ' costs much' AS message FROM orders WHERE o_totalprice > 300000")
def command_foreach(spark: SparkSession, d: str) -> DataFrame:
    return _printed(engine(spark, d).load("command report = foreach orders:costly => 'order {o_orderkey} costs much'\ncommand other = foreach orders => 'no'\n"), ["report"])


@query("SELECT 'shout' AS command, upper(c_name) || '!' AS message FROM customer WHERE c_acctbal < 0")
def command_print_styled(spark: SparkSession, d: str) -> DataFrame:
    return _printed(engine(spark, d).load("command shout = foreach customer.Where(c_acctbal < 0) => PRINT('{c_name.Upper@red}!')\n"), ["shout"])


@query("SELECT CAST(NULL AS VARCHAR) AS command, n_name AS message FROM nation UNION ALL SELECT NULL, 'done' UNION ALL SELECT NULL, CAST((SELECT count(*) FROM customer) AS VARCHAR)")
def print_bare_expressions(spark: SparkSession, d: str) -> DataFrame:
    return _printed(engine(spark, d).load("nation.n_name\n'done'\ncustomer.Count\n"))


@query("SELECT 'both' AS command, 'a ' || r_name AS message FROM region UNION ALL SELECT 'both', 'b ' || n_name FROM nation WHERE n_regionkey = 1")
def command_composition(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d).load("command first = foreach region => 'a {r_name}'\ncommand second = foreach nation.Where(n_regionkey == 1) => 'b {n_name}'\ncommand both = first & second\n")
    return _printed(e, ["both"]).withColumn("command", F.lit("both"))


@query("SELECT 'guarded' AS command, 'deep ' || r_name AS message FROM region")
def command_guard(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark, catalog(spark, d), arguments=["deep"]).load(PRELUDE + "predicate deep(Program) => Program.Args:contains('deep')\npredicate flat(Program) => Program.Args:contains('flat')\ncommand a = foreach region => 'deep {r_name}' : deep\ncommand b = foreach region => 'flat {r_name}' : flat\ncommand guarded = a & b\n")
    return _printed(e, ["guarded"]).withColumn("command", F.lit("guarded"))


@query("SELECT 'dear' AS command, n_name || ' in region 3' AS message FROM nation WHERE n_regionkey = 3")
def command_parameters(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d).load("command dear(wanted) = foreach nation.Where(n_regionkey == wanted) => '{n_name} in region {n_regionkey}'\nRUN dear(3)\n")
    return _printed(e).withColumn("command", F.lit("dear"))


@query("SELECT 'nations/' || n_regionkey || '.txt' AS path, string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS text FROM nation GROUP BY n_regionkey")
def save_grouped_files(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d).load("command save = foreach nation => SAVE('nations/{n_regionkey}.txt', '{n_name}')\n")
    return e.run(["save"]).saved[0].rows("path", "text")


@query("SELECT '{' || chr(34) || 'message' || chr(34) || ':' || chr(34) || 'region ' || r_name || chr(34) || '}' AS json FROM region")
def output_as_json(spark: SparkSession, d: str) -> DataFrame:
    return _printed(engine(spark, d).load("command r = foreach region => 'region {r_name}'\n"), ["r"]).select(F.to_json(F.struct("message")).alias("json"))


@query("SELECT n_name AS message FROM nation ORDER BY n_nationkey LIMIT 4")
def output_limit(spark: SparkSession, d: str) -> DataFrame:
    return _printed(Engine(spark, catalog(spark, d), output_limit=4).load(PRELUDE + "command names = foreach nation => '{n_name}'\n"), ["names"]).select("message")


@query("SELECT 'error' AS severity, 'lib: ' || c_name AS message FROM customer WHERE c_acctbal < 0 AND c_nationkey = 3")
def imported_package(spark: SparkSession, d: str) -> DataFrame:
    packages = {"base": "export predicate poor(Customer) => Customer.c_acctbal < 0\n", "lib": "import base\nexport function toLib(Customer) => { severity = 'error', message = 'lib: {c_name}' }\n"}
    e = Engine(spark, catalog(spark, d), packages=packages).load(PRELUDE).load("import lib\nlet found = customer:poor.Where(c_nationkey == 3):toLib\n")
    return e.collection("found").rows("severity", "message")


@query(r"SELECT c_name || ': error: debt of ' || regexp_replace(CAST(c_acctbal AS VARCHAR), '\.0$', '') AS line FROM customer WHERE c_acctbal < -900")
def check_format(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d).load("export let debts = customer.Where(c_acctbal < 0 - 900).Select(Violation { Severity = 'error', Message = 'debt of {c_acctbal}', Source = c_name })\n")
    return e.format_violations(e.check()).rows().withColumnRenamed("value", "line")


@query("SELECT 'nation' AS step, (SELECT count(*) FROM nation) AS before, (SELECT count(*) FROM nation WHERE n_regionkey = 2) AS after")
def diagnostics_counts(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark, catalog(spark, d), diagnostics=True).load(PRELUDE + "command nation2 = foreach nation.Where(n_regionkey == 2) => '{n_name}'\n")
    e.run(["nation2"])
    return spark.createDataFrame([("nation", b, a) for _, b, a in e.observed], "step string, before bigint, after bigint")


# predicates of several shapes
def _program(name: str, declarations: str, expression: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return engine(spark, d).load(declarations).collection(expression).rows()

    QUERIES[name] = run
    ORACLE[name] = sql


_program("predicate_by_type", "predicate big(Order) => Order.o_totalprice > 350000\npredicate big(Customer) => Customer.c_acctbal > 9000\n", "customer:big.Select({id = c_custkey}) + orders:big.Select({id = o_orderkey})", "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice > 350000")
_program("predicate_subset", "predicate Rich(customer) => c_acctbal > 9000 && !(c_mktsegment == 'building')\n", "Rich.Select({c_custkey = c_custkey})", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 AND lower(c_mktsegment) <> 'building'")
_program("predicate_narrowing", "predicate caught(Statement) => Statement.kind == 'catch'\nfunction said(Statement) => { stmt_id = Statement.stmt_id, m = 'line {line}' }\n", "code_statements:caught:said", "SELECT stmt_id, 'line ' || line AS m FROM code_statements WHERE kind = 'catch'")
_program("list_element_in_collection", "let handled = code_statements.Where(error_handler && generic).Distinct(kind).Select({word = kind})\npredicate inHandled(Ancestor) => handled:any(word == Ancestor.kind)\n", "code_statements.Where(ancestors:any(inHandled)).Select({stmt_id = stmt_id, line = line})", "SELECT stmt_id, CAST(line AS BIGINT) AS line FROM code_statements WHERE EXISTS (SELECT 1 FROM (SELECT unnest(ancestors) AS a) WHERE lower(a.kind) IN (SELECT lower(kind) FROM code_statements WHERE error_handler AND generic))")
_program("bound_row_in_subquery", "predicate buys(Customer) => orders:any(Order.o_custkey == Customer.c_custkey && Order.o_totalprice > 350000)\n", "customer:buys.Select({c_custkey = c_custkey})", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 350000)")
rule("number_predicates", "orders:o_totalprice:gt(100000):o_totalprice:le(200000):o_custkey:ne(7).Select({o_orderkey = o_orderkey, few = o_totalprice:lt(150000), more = o_totalprice:ge(150000), same = o_orderkey:eq(3)})", "SELECT o_orderkey, o_totalprice < 150000 AS few, o_totalprice >= 150000 AS more, o_orderkey = 3 AS same FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000 AND o_custkey <> 7")
rule("string_empty", "source_files.Where(raw_text:empty).Select({file_id = file_id})", "SELECT file_id FROM source_files WHERE raw_text = ''")
rule("string_contains_found", "part:p_type:contains('Econ').Select({p_partkey = p_partkey})", "SELECT p_partkey FROM part WHERE contains(lower(p_type), 'econ')")
rule("glob_any_folder", "source_files.Where(Path('**/*Client*.*')).Select({file_id = file_id})", "SELECT file_id FROM source_files WHERE regexp_matches(replace(path, '\\', '/'), '^.*[^/]*Client[^/]*\\.[^/]*$')")
rule("glob_minds_case", "source_files.Where(!Path('SRC/**') && Path('src/**')).Select({file_id = file_id})", "SELECT file_id FROM source_files WHERE starts_with(replace(path, '\\', '/'), 'src/')")

# grouping, positions and texts over tables that grow
rule("group_items_orders", "orders.GroupBy(o_custkey).Select({customer = Key, keys = Items.Select(o_orderkey), n = Items.Count})", "SELECT CAST(o_custkey AS VARCHAR) AS customer, list(o_orderkey ORDER BY o_orderkey) AS keys, count(*) AS n FROM orders GROUP BY o_custkey")
rule("group_text_documents", "documents.GroupBy(project).Select({project = Key, n = Count, ids = Items.Where(n_chars > 20000).Select(doc_id)})", "SELECT coalesce(project, '') AS project, count(*) AS n, coalesce(list(doc_id ORDER BY doc_id) FILTER (n_chars > 20000), []) AS ids FROM documents GROUP BY coalesce(project, '')")
rule("distinct_skewed_key", "code_statements.Distinct(type_name).Select({first = stmt_id})", "SELECT min(stmt_id) AS first FROM code_statements GROUP BY lower(coalesce(type_name, ''))")

rule("navigate_first_large", "orders.Where(o_totalprice > 300000).Select({o_orderkey = o_orderkey, name = customer.First(Customer.c_custkey == Order.o_custkey).c_name})", "SELECT o_orderkey, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000")
rule("list_literal_collection", "[3 1 2 5].Where(item > 1)", "SELECT CAST(v AS BIGINT) AS value FROM (VALUES (3), (2), (5)) t(v)")
rule("literal_escapes", "region.Select({r_regionkey = r_regionkey, s = 'a\\tb\\'c\\\\d' + r_name})", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, 'a' || chr(9) || 'b''c' || chr(92) || 'd' || r_name AS s FROM region")
value_row("first_last_large", {"a": "orders.First(o_orderstatus == 'f').o_orderkey", "z": "orders.Last(o_orderstatus == 'f').o_orderkey", "third": "orders.ElementAt(2).o_orderkey", "one": "customer.Single(c_custkey == 7).c_name"}, "SELECT (SELECT min(o_orderkey) FROM orders WHERE lower(o_orderstatus) = 'f') AS a, (SELECT max(o_orderkey) FROM orders WHERE lower(o_orderstatus) = 'f') AS z, (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 2) AS third, (SELECT c_name FROM customer WHERE c_custkey = 7) AS one")


@query("SELECT 'deep' AS value UNION ALL SELECT 'wide'")
def program_arguments(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, catalog(spark, d), arguments=["deep", "wide"]).load(PRELUDE).collection("Program.Args").rows()


@query("SELECT n_nationkey || ': ' || n_name AS value FROM nation")
def sink_into_folder(spark: SparkSession, d: str) -> DataFrame:
    """A batch program whose output goes to a sink; the tasks write, the lines are read back."""
    where = f"{ensure_checkpoint_dir(spark)}/sink-{uuid.uuid4().hex}/"
    engine(spark, d).load(f"foreach nation => '{{n_nationkey}}: {{n_name}}' => file.Write('{where}')\n").run()
    return spark.read.text(where)


@query("SELECT event_id || ' ' || user_id AS value FROM events WHERE event_type = 'purchase'")
def stream_into_folder(spark: SparkSession, d: str) -> DataFrame:
    """A program over a stream: found to be one by its collection, run until nothing is left, its lines written by the tasks."""
    from colligo.streaming.stream import parquet_stream, register_stream, run_stream

    where = f"{ensure_checkpoint_dir(spark)}/sink-{uuid.uuid4().hex}/"
    e = Engine(spark, Catalog(spark))
    register_stream(e, "live", "Events", parquet_stream(spark, f"{d}/events.parquet"), "Event")
    e.load(f"foreach live.Events.Where(event_type == 'purchase') => '{{event_id}} {{user_id}}' => file.Write('{where}')\n")
    for running in run_stream(e, available_now=True):
        running.awaitTermination()
    return spark.read.text(f"{where}batch=*")


@query("SELECT 'all sources are empty: is the root right?' AS warning")
def empty_root_warning(spark: SparkSession, d: str) -> DataFrame:
    out = Catalog(spark)
    out.register("db", "customer", lambda: Collection.of(table(spark, d, "customer").where("false"), "Customer", ["c_custkey"]))
    result = Engine(spark, out).load("command names = foreach customer => '{c_name}'\n").run(["names"])
    return spark.createDataFrame([(w,) for w in result.warnings], "warning string")


@query("""SELECT '{' || chr(10) || '    "id": ' || r_regionkey || ',' || chr(10) || '    "name": "' || r_name || '",' || chr(10) || '    "none": null,' || chr(10) || '    "list": [' || chr(10) || '        "a"' || chr(10) || '    ],' || chr(10) || '    "yes": true' || chr(10) || '}' AS message FROM region""")
def print_objects_as_json(spark: SparkSession, d: str) -> DataFrame:
    return _printed(engine(spark, d).load("region.Select({id = r_regionkey, name = r_name, none = nic, list = ['a'], yes = r_regionkey >= 0})\n")).select("message")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 9000 AND ends_with(lower(c_mktsegment), 'ing') AND c_mktsegment <> 'MACHINERY'")
def type_method_and_text_field(spark: SparkSession, d: str) -> DataFrame:
    """A method that a source registers for its type, and an object that stands for its text in predicates and comparisons."""
    from colligo.functions.values import boolean

    e = engine(spark, d)
    e.program.methods["Buyer", "hasMoreThan"] = lambda v, args: boolean(v.col["c_acctbal"] > args[0].col)
    rows = table(spark, d, "customer").withColumn("Segment", F.struct(F.col("c_mktsegment").alias("text"), F.lit(1).alias("rank")))
    e.catalog.register("db", "buyers", lambda: Collection.of(rows, "Buyer", ["c_custkey"]))
    return e.collection("buyers:hasMoreThan(9000).Where(Buyer.Segment:endsWith('ING') && Buyer.Segment != 'machinery')").rows("c_custkey")


rule("function_as_transform", "events.Select(handle)", "SELECT CASE lower(event_type) WHEN 'purchase' THEN 'sell' WHEN 'error' THEN 'alarm' ELSE 'ignore' END AS value FROM events")


# specs
@query("SELECT 'Nation' || n_nationkey AS \"Name\", 'Geo.R' || n_regionkey AS \"Namespace\", 'Place' AS \"BaseModel\", ['id', 'name'] AS properties, CAST(1 AS BIGINT) AS keys FROM nation")
def typespec_models(spark: SparkSession, d: str) -> DataFrame:
    """A spec file made for each nation, parsed where its row is."""
    from colligo.sources.typespec import declared

    n = F.col("n_nationkey")
    text = F.concat(F.lit("import \"x\";\nnamespace Geo.R"), F.col("n_regionkey"), F.lit(";\n@doc(\"a nation\") model Nation"), n, F.lit(" extends Place {\n  @key id: string;\n  name?: string = \""), F.col("n_name"), F.lit("\";\n}\nenum Color { red }\n"))
    models = declared(table(spark, d, "nation").select(F.concat(n, F.lit(".tsp")).alias("Path"), text.alias("Text")), "Models")
    out = models.rows()
    keys = F.size(F.filter("Properties", lambda p: F.exists(p["Decorators"], lambda x: x["Name"] == "key"))).cast("bigint")
    return out.select("Name", "Namespace", "BaseModel", F.transform("Properties", lambda p: p["Name"]).alias("properties"), keys.alias("keys"))


SPEC = """
namespace Shop;
model Person { @key id: string; }
model Child extends Person { age: int32; }
@route("/v1") namespace V {
  @route("/own") interface A { @get op one(@query top?: int32): Person | Error; }
  interface B { @put op two(@path id: string, @body body: Person): void; }
  @autoRoute interface C { @get op read(id: string): Child[]; @post op add(@body child: Child): { @statusCode _: 201; @body made: Child }; }
}
"""


@query("""SELECT * FROM (VALUES ('A', 'one', 'get', '/own', ['200', 'default']), ('B', 'two', 'put', '/v1/{id}', ['204']), ('C', 'read', 'get', '/children/{id}', ['200']), ('C', 'add', 'post', '/children', ['201'])) t("Interface", "Name", "Verb", "Path", codes)""")
def typespec_http(spark: SparkSession, d: str) -> DataFrame:
    from colligo.sources.typespec import http_graph, parse_specs

    rows = [(o["Interface"], o["Name"], o["Verb"], o["Path"], [r["StatusCode"] for r in o["Responses"]]) for o in http_graph(parse_specs([SPEC]))["Operations"]]
    return spark.createDataFrame(rows, "Interface string, Name string, Verb string, Path string, codes array<string>")
