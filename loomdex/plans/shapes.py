"""Queries over files that differ in shape: a file for each order, a member for each of its lines, of a kind that its columns tell.

SQL computes what is expected from the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import emit, extract, reduce
from ..sources import version_control
from .fixtures import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: A row for each line: o the order, n the place in it, p the part, q the quantity; f the file.
LINES = (
    "l AS (SELECT l_orderkey AS o, l_partkey AS p, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS n, "
    "'src/o' || l_orderkey || '.x' AS f FROM lineitem)"
)


def orders(spark, d, line: Callable[[Column, Column, Column, Column], Column], head: str = "", tail: str = "") -> DataFrame:
    """(o, file_path, text): for each order the head, what ``line`` makes of order, place, part and quantity of its lines, and the tail."""
    of = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.struct("l_linenumber", F.col("l_partkey").alias("p"), F.col("l_quantity").cast("int").alias("q")).alias("x"))
    held = of.groupBy("o").agg(F.sort_array(F.collect_list("x")).alias("x"))  # an order's lines
    text = lambda x, i: line(F.col("o").cast("string"), (i + 1).cast("string"), x["p"].cast("string"), x["q"])
    return held.select("o", F.concat(F.lit("src/o"), F.col("o").cast("string"), F.lit(".x")).alias("file_path"), F.concat(F.lit(head), F.array_join(F.transform("x", text), ""), F.lit(tail)).alias("text"))


def filled(pattern: str, **values: Column) -> Column:
    """``pattern`` with values in the place of <o>, <n>, <p>, <q>."""
    out = F.lit(pattern)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"<{name}>"), value.cast("string"))
    return out


def by_kind(*patterns: str) -> Callable[[Column, Column, Column, Column], Column]:
    """Lines of the pattern that the quantity picks."""

    def line(o: Column, n: Column, p: Column, q: Column) -> Column:
        out = F.lit("")
        for k, pattern in enumerate(patterns):
            out = F.when(q % len(patterns) == k, filled(pattern, o=o, n=n, p=p, q=q)).otherwise(out)
        return out

    return line


@query(
    "ext5_routes_of_orders",
    f"WITH {LINES} SELECT f AS file_path, n::INTEGER + 1 AS line_no, CASE q % 3 WHEN 1 THEN 'GET' ELSE 'POST' END AS verb, CASE q % 3 WHEN 1 THEN '/p' || p ELSE '/o' || o || '/p' || p END AS pattern FROM l WHERE q % 3 > 0",
)
def ext5(spark, d):
    return extract.routes(orders(spark, d, by_kind("// nothing <p>\n", 'app.MapGet("p<p>/", h<n>);\n', '\tapp.MapPost("/o<o>/p<p>", x => x);\n'), "// an order\n"))


@query(
    "ext11a_registrations_of_orders",
    f"WITH {LINES} SELECT f AS file_path, n::INTEGER AS line_no, CASE q % 4 WHEN 1 THEN 'B' ELSE 'I' END || p AS service, CASE q % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'T' END || p AS implementation, "
    "CASE q % 4 WHEN 0 THEN 'scoped' WHEN 1 THEN 'singleton' ELSE 'transient' END AS lifetime FROM l WHERE q % 4 < 3",
)
def ext11a(spark, d):
    return extract.registrations(orders(spark, d, by_kind("services.AddScoped<I<p>, A<p>>();\n", "services.AddSingleton< B<p> >();\n", "s.AddTransient<I<p>,T<p>>();\n", "var x<p> = <q>;\n")))


@query(
    "ext11f_inheritance_of_orders",
    f'WITH {LINES}, x AS (SELECT *, lag(q % 3) OVER (PARTITION BY o ORDER BY n) AS b FROM l) SELECT CASE q % 3 WHEN 1 THEN \'C\' ELSE \'D\' END || o || \'_\' || n AS "from", '
    "CASE q % 3 WHEN 1 THEN 'I' ELSE 'C' END || o || '_' || (n - 1) AS \"to\", CASE q % 3 WHEN 1 THEN 'implements' ELSE 'inherits' END AS type FROM x WHERE q % 3 > 0 AND b = q % 3 - 1",
)
def ext11f(spark, d):
    """Classes that name the type before them; only where a type of that name is declared is there an edge."""

    def line(o, n, p, q):
        before = (n.cast("int") - 1).cast("string")
        kinds = ("interface I<o>_<n> { }\n", "class C<o>_<n> : I<o>_<b> { }\n", "public class D<o>_<n> : C<o>_<b>\n{ }\n")
        return F.when(q % 3 == 0, filled(kinds[0], o=o, n=n)).when(q % 3 == 1, filled(kinds[1], o=o, n=n, b=before)).otherwise(filled(kinds[2], o=o, n=n, b=before))

    return extract.inheritance_edges(extract.csharp_types(orders(spark, d, line))).select("from", "to", "type")


@query(
    "ext3_script_symbols_of_orders",
    f"WITH {LINES} SELECT f AS file_path, n::INTEGER AS line_no, CASE q % 4 WHEN 0 THEN 'class' ELSE 'function' END AS kind, CASE q % 4 WHEN 0 THEN 'K' WHEN 1 THEN 'f' ELSE 'g' END || p AS name, q % 4 = 0 AS is_public FROM l WHERE q % 4 <> 2",
)
def ext3(spark, d):
    lines = by_kind("export class K<p> {}\n", "async function f<p>() {}\n", "let y = <p>\n", "const g<p> = (x) => x\n")
    return extract.script_symbols(orders(spark, d, lines)).select("file_path", "line_no", "kind", "name", "is_public")


_WIRED = [("H<o>", "P<p>", "sends_request", 0.70), ("service:hosted", "W<p>", "hosted_service", 0.90), ("service:grpc", "G<p>", "grpc_endpoint", 0.95), ("service:signalr", "S<p>", "signalr_endpoint", 0.95), ("H<o>", "R<p>", "ef_entity", 0.90)]
_SIDE = lambda text: "'" + text.replace("<o>", "' || o || '").replace("<p>", "' || p || '") + "'"


@query(
    "ext11g_endpoints_of_orders",
    f"WITH {LINES}, e AS ("
    + " UNION ALL ".join(f"SELECT {_SIDE(a)} AS f2, {_SIDE(b)} AS t2, '{kind}' AS type, {weight}::DOUBLE AS weight, n::INTEGER + 2 AS line_no, f FROM l WHERE q % 6 = {i}" for i, (a, b, kind, weight) in enumerate(_WIRED))
    + ') SELECT f AS file_path, f2 AS "from", t2 AS "to", type, weight, line_no FROM e',
)
def ext11g(spark, d):
    """Hosted services, gRPC and SignalR endpoints, requests and entities, each on its line."""
    lines = by_kind("  bus.Send(new P<p>());\n", "  s.AddHostedService<W<p>>();\n", "  app.MapGrpcService<G<p>>();\n", '  app.MapHub<S<p>>("/hub");\n', "  DbSet<R<p>> rows;\n", "  // <q>\n")
    files = orders(spark, d, lines).withColumn("text", F.concat(F.lit("class H"), F.col("o").cast("string"), F.lit("\n{\n"), "text", F.lit("}\n")))
    return extract.wiring_edges(files).select("file_path", "from", "to", "type", "weight", "line_no")


@query("par2_diffs_of_orders", f"WITH {LINES} SELECT o, 'p' || p || '_' || n AS path, q % 5 AS added, q % 4 AS removed, 1 + q % 2 AS hunks FROM l")
def par2(spark, d):
    def line(o, n, p, q):
        head = filled("diff --git a/p<p>_<n> b/p<p>_<n>\n--- a/p<p>_<n>\n+++ b/p<p>_<n>\n@@ -1 +1 @@\n", n=n, p=p)
        return F.concat(head, F.repeat(F.lit("-old\n"), q % 4), F.repeat(F.lit("+new\n"), q % 5), F.when(q % 2 == 1, "@@ -9 +9 @@\n same\n").otherwise(""))

    found = version_control.unified_diffs(orders(spark, d, line).select(F.col("o").alias("diff"), "text"))
    return found.select(F.col("diff").alias("o"), "path", *[F.col(c).cast("int").alias(c) for c in ("added", "removed", "hunks")])


@query("par3_results_of_orders", f"WITH {LINES} SELECT o, 't' || p || '.' || n AS test, CASE q % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'not-run' END AS outcome FROM l")
def par3(spark, d):
    lines = by_kind('<UnitTestResult testName="t<p>.<n>" outcome="Passed" />\n', '<UnitTestResult duration="<q>" outcome="Failed" testName="t<p>.<n>"/>', ' <UnitTestResult testName="t<p>.<n>" outcome="Timeout"/>')
    return version_control.test_results(orders(spark, d, lines, "<Results>", "</Results>").select(F.col("o").alias("report"), "text")).withColumnRenamed("report", "o")


def reduced(spark, d, kind: str, line: Callable[[Column, Column, Column, Column], Column], head: str = "", tail: str = "") -> DataFrame:
    return orders(spark, d, line, head, tail).select("o", reduce.reduce_text(F.col("text"), kind).alias("reduced"))


def joined(expression: str, between: str = "''", head: str = "''", tail: str = "''") -> str:
    return f"WITH {LINES} SELECT o, {head} || string_agg({expression}, {between} ORDER BY n) || {tail} AS reduced FROM l GROUP BY o"


@query("red5_scss_of_orders", joined("'.l' || n || '{width:' || p || 'px;}'"))
def red5(spark, d):
    return reduced(spark, d, "scss", by_kind(".l<n> {\n  width : <p>px ; // note <q>\n}\n", "/* block\n <p> */.l<n> {  width : <p>px ; }\n"))


@query("red7_razor_of_orders", joined("'<div><b>@(p' || p || ')</b></div>'"))
def red7(spark, d):
    return reduced(spark, d, "razor", by_kind("<!-- c <q> -->\n<div>\n  <b>@( p<p> )</b>\n</div>\n", "<div>\n<b>@(p<p> )</b>\n</div>\n@* note\n<q> *@\n"))


@query("red8_yaml_of_orders", joined("'key' || n || ': ' || p", "chr(10) || chr(10)"))
def red8_yaml(spark, d):
    return reduced(spark, d, "yaml", by_kind("key<n>: <p>   \n# note <q>\n", "key<n>: <p>\n  # note <q>\n\n\n\n"))


@query("red8_xml_of_orders", joined("'<v n=\"' || n || '\">' || p || '</v>'", "''", "'<?xml version=\"1.0\"?><r>'", "'</r>'"))
def red8_xml(spark, d):
    return reduced(spark, d, "xml", by_kind(' <!-- c <q> -->\n <v n="<n>"><p></v>\n', '   <v n="<n>"><p></v>\n\n'), '<?xml version="1.0"?>\n<r>\n', "</r>\n")


@query("red8_sql_of_orders", joined("'SELECT ' || p || ' , ' || q || chr(10) || 'FROM t' || n || ' ;' || chr(10)"))
def red8_sql(spark, d):
    return reduced(spark, d, "sql", by_kind("SELECT <p>  ,  <q> -- note\n/* b <n> */\n\n\nFROM t<n> ;\n", "  SELECT <p> ,\t\t<q>\n  FROM t<n> ;  -- <q>\n"))


@query(
    "snk7_markdown_of_orders",
    f"WITH {LINES} SELECT o, count(*) AS entries, md5(string_agg('## l' || n || chr(10) || chr(10) || '```' || chr(10) || p || chr(10) || '```', chr(10) ORDER BY n)) AS markdown, "
    "md5(string_agg('{\"path\":\"l' || n || '\",\"content\":\"' || p || '\"}', chr(10) ORDER BY n)) AS json FROM l GROUP BY 1",
)
def snk7(spark, d):
    """A part for each order, an entry for each of its lines, in two formats."""
    lines = orders(spark, d, lambda o, n, p, q: F.concat(n, F.lit(" "), p, F.lit("\n"))).select("o", F.posexplode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("seq", "x"))
    rows = lines.select(F.col("o").alias("part"), "seq", F.concat(F.lit("l"), F.substring_index("x", " ", 1)).alias("path"), F.substring_index("x", " ", -1).alias("body"))
    digest = lambda kind: emit.emit(rows, kind).select(F.col("part").alias("o"), "entries", F.md5(F.col("text").cast("binary")).alias(kind))
    return digest("markdown").join(digest("json").drop("entries"), "o")


@query(
    "dif9_runner_filters",
    "SELECT c_nationkey, string_agg(DISTINCT 'FullyQualifiedName~' || k, '|' ORDER BY 'FullyQualifiedName~' || k) AS filter "
    "FROM (SELECT c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 'T\\(' || c_custkey % 40 || '\\)' ELSE 'A.B' || c_custkey % 40 || '\\=x' END AS k FROM customer) GROUP BY 1",
)
def dif9(spark, d):
    """A filter for each nation, of its customers' names with characters that need escaping."""
    n = (F.col("c_custkey") % 40).cast("string")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" T("), n, F.lit(")"))).otherwise(F.concat(F.lit("A.B"), n, F.lit("=x ")))
    return emit.runner_filters(table(spark, d, "customer").select("c_nationkey", name.alias("name")), "c_nationkey")


@query(
    "ses4_appended_ledger",
    "SELECT o_custkey AS ledger, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2, o_orderkey)::INTEGER AS line_no, '[proven] ' || o_orderstatus || ' (' || o_orderkey || ')' AS line FROM orders",
)
def ses4(spark, d):
    """The ledger of each customer: even orders first, then odd ones appended."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("ledger"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("claim"), F.col("o_orderkey").cast("string").alias("path"), F.lit("proven").alias("grade"))
    return emit.render_ledger(emit.appended_claims(o.where("seq % 2 = 0"), o.where("seq % 2 = 1"))).select("ledger", "line_no", "line")
