"""Queries of sources, extraction, parsing, upkeep and C# text, over small files made of each row of a table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import bpe, csharp
from ..functions.text import is_generated, is_test_path, token_estimate
from ..operators import code, delta, emit, extract, fusion, graph, localize, packing, reduce, store
from ..operators.cache import KeyValueTable
from ..operators.shared import new_path, saved
from ..sources import bundles, files, templates, version_control
from ..streaming import changes
from . import fixtures
from .fixtures import EDGES_SQL, NODES_SQL, table
from .texts import PLAN_SQL, plan_rows

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def made(spark, d, *parts: str) -> tuple:
    """Files (id, file_path, text) of the documents; {} in the parts stands for the id."""
    ids = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return ids.select("id", F.concat(F.lit("src/f"), "id", F.lit(".cs")).alias("file_path"), filled("".join(parts), F.col("id")).alias("text"))


def filled(text: str, value: Column) -> Column:
    pieces = text.split("{}")
    return F.concat(*[x for p in pieces[:-1] for x in (F.lit(p), value)], F.lit(pieces[-1]))


IDS = "d AS (SELECT doc_id::VARCHAR AS id, 'src/f' || doc_id || '.cs' AS file_path FROM documents)"
PROGRAM = "using System;\nnamespace Shop;\npublic class C{} : IBase\n{\n    private int _x = 1;\n    public int Get(int a)\n    {\n        return a + 1; // note\n    }\n}\ninternal enum E{} { A, B }\n"
DECLARED = "(VALUES ('class', 'C', true, 'public', 3, 10), ('field', '_x', false, 'private', 5, 5), ('method', 'Get', false, 'public', 6, 9), ('enum', 'E', true, 'internal', 11, 11), ('enum-member', 'A', false, 'public', 11, 11), ('enum-member', 'B', false, 'public', 11, 11)) v(kind, base, own, access, start_line, end_line)"


@query("ext1_csharp_symbols", f"WITH {IDS} SELECT file_path, kind, CASE WHEN own THEN base || id ELSE base END AS name, access, start_line, end_line FROM d, {DECLARED}")
def ext1(spark, d):
    return code.csharp_symbols(made(spark, d, PROGRAM)).select("file_path", "kind", "name", "access", "start_line", "end_line")


@query(
    "ext1_chunks",
    f"WITH {IDS} SELECT 'chunk:' || file_path || ':' || kind || ':Shop.' || CASE WHEN own THEN base || id WHEN kind = 'enum-member' THEN 'E' || id || '.' || base ELSE 'C' || id || '.' || base END || ':' || start_line AS chunk_id, file_path, CASE kind WHEN 'method' THEN (length('public int Get(int a)') + 3) // 4 WHEN 'field' THEN (length('private int _x = 1;') + 3) // 4 END AS reduced "
    f"FROM d, {DECLARED}",
)
def ext1_chunks(spark, d):
    found = code.chunks(code.csharp_symbols(made(spark, d, PROGRAM)))
    return found.select("chunk_id", "file_path", F.when(F.col("kind").isin("method", "field"), F.col("reduced_token_estimate")).cast("long").alias("reduced"))


@query(
    "ext3_script_symbols",
    f"WITH {IDS} SELECT file_path, line_no, kind, CASE WHEN own THEN base || id ELSE base END AS name, is_public "
    f"FROM d, (VALUES (1, 'class', 'A', true, true), (2, 'function', 'go', true, false), (3, 'function', '_hid', false, false), "
    f"(4, 'function', 'f', true, true)) v(line_no, kind, base, own, is_public)",
)
def ext3(spark, d):
    text = "export class A{} {}\nasync function go{}() {}\nexport function _hid() {}\nexport const f{} = (x) => x\nlet y = 2\n"
    return extract.script_symbols(made(spark, d, text)).select("file_path", "line_no", "kind", "name", "is_public")


@query(
    "ext5_routes",
    f"WITH {IDS} SELECT file_path, line_no, verb, CASE line_no WHEN 3 THEN '/api/items/' || id WHEN 4 THEN '/all' ELSE '/m' || id END AS pattern "
    f"FROM d, (VALUES (3, 'GET'), (4, 'POST'), (6, 'PUT')) v(line_no, verb)",
)
def ext5(spark, d):
    text = '[Route("api/")]\nclass C {\n [HttpGet("items/{}/")] void A() {}\n [HttpPost("/all")] void B() {}\n}\napp.MapPut("m{}", x => x);\n'
    return extract.routes(made(spark, d, text))


@query("ext7_file_classes", f"WITH {IDS} SELECT id, id::BIGINT % 3 = 0 AS is_test, id::BIGINT % 3 = 1 OR id::BIGINT % 5 = 0 AS is_generated FROM d")
def ext7(spark, d):
    t = made(spark, d, "x")
    n = F.col("id").cast("long")
    path = F.when(n % 3 == 0, F.concat(F.lit("a/Tests/f"), "id", F.lit(".cs"))).when(n % 3 == 1, F.concat(F.lit("a/f"), "id", F.lit(".g.cs"))).otherwise(F.concat(F.lit("a/f"), "id", F.lit(".cs")))
    prefix = F.when(n % 5 == 0, F.lit("// <auto-generated/>")).otherwise(F.lit("// code"))
    return t.select("id", is_test_path(path).alias("is_test"), is_generated(path, prefix).alias("is_generated"))


@query(
    "ext9_outlines",
    f"WITH {IDS} SELECT file_path, kind, base || id AS name, members FROM d, (VALUES ('class', 'C', '_x,Get'), "
    f"('enum', 'E', 'A,B')) v(kind, base, members)",
)
def ext9(spark, d):
    return code.outlines(made(spark, d, PROGRAM)).withColumn("members", F.array_join("members", ","))


@query("ext10_public_surface", f"WITH {IDS} SELECT 'Shop.C' || id || m AS fqn FROM d, (VALUES (''), ('.Get')) v(m)")
def ext10(spark, d):
    return code.csharp_symbols(made(spark, d, PROGRAM)).where("is_public AND kind <> 'enum-member'").select("fqn")


@query("ext11_wiring_edges", f"""WITH {IDS} SELECT CASE f WHEN 'config' THEN 'config:Mail' ELSE f || id END AS "from", t || id AS "to", type, weight, line_no FROM d, (VALUES ('Q', 'H', 'mediatr_handles', 0.95::DOUBLE, 1), ('H', 'P', 'sends_request', 0.70, 3), ('H', 'O', 'options_consumes', 0.75, 4), ('config', 'M', 'options_binds', 0.85, 5), ('H', 'Row', 'ef_entity', 0.90, 6)) v(f, t, type, weight, line_no)""")
def ext11(spark, d):
    text = 'class H{} : IRequestHandler<Q{}>\n{\n  void M() { bus.Send(new P{}()); }\n  IOptions<O{}> o;\n  void S() { s.Configure<M{}>(c.GetSection("Mail")); }\n  DbSet<Row{}> rows;\n}\n'
    return extract.wiring_edges(made(spark, d, text)).select("from", "to", "type", "weight", "line_no")


@query(
    "ext11a_registrations",
    f"WITH {IDS} SELECT id, service || id AS service, implementation || id AS implementation, lifetime "
    f"FROM d, (VALUES ('IA', 'A', 'scoped'), ('B', 'B', 'singleton')) v(service, implementation, lifetime)",
)
def ext11a(spark, d):
    t = made(spark, d, "services.AddScoped<IA{}, A{}>();\nservices.AddSingleton<B{}>();\n")
    return extract.registrations(t).join(t.select("id", "file_path"), "file_path").select("id", "service", "implementation", "lifetime")


@query("ext11a_decorators", f"""WITH {IDS} SELECT 'Log' || id AS "from", 'IA' || id AS "to", 'di_decorates' AS type, 0.95::DOUBLE AS weight FROM d""")
def ext11a_decorators(spark, d):
    return extract.decorators(made(spark, d, "services.Decorate<IA{}, Log{}>();\n"))


@query("ext11b_injected_implementations", f"""WITH {IDS} SELECT 'K' || id AS "from", CASE WHEN id::BIGINT % 2 = 0 THEN 'A2' ELSE 'A1' END AS "to", 'di_depends_on_impl' AS type FROM d""")
def ext11b(spark, d):
    """Constructors that ask for a service; of two registrations the last counts."""
    text = "class K{} { public K{}(IOdd a, IOptions<X> o, int n = 1) { } }\n"
    symbols = code.csharp_symbols(made(spark, d, text)).withColumn("body", F.when(F.substring("file_path", -4, 1).cast("int") % 2 == 0, F.replace("body", F.lit("IOdd"), F.lit("IEven"))).otherwise(F.col("body")))
    resolves = spark.createDataFrame([("IOdd", "A0", 1), ("IOdd", "A1", 2), ("IEven", "A2", 1)], "service string, implementation string, seq int")
    return extract.injected_implementations(extract.constructor_parameters(symbols), resolves)


@query("ext11d_route_edges", f"""WITH {IDS} SELECT 'route:GET /x' || id AS "from", 'B' || id AS "to", 'route_handles' AS type, 1.0::DOUBLE AS weight FROM d""")
def ext11d(spark, d):
    t = made(spark, d, 'class A{} {}\nclass B{}\n{\n  [HttpGet("x{}")] void G() {}\n}\n')
    return extract.route_edges(extract.routes(t), extract.csharp_types(t))


@query("ext11f_inheritance", f"""WITH {IDS} SELECT f || id AS "from", t || id AS "to", type FROM d, (VALUES ('K', 'IB', 'implements'), ('L', 'K', 'inherits')) v(f, t, type)""")
def ext11f(spark, d):
    return extract.inheritance_edges(extract.csharp_types(made(spark, d, "interface IB{} { }\nclass K{} : IB{}, IOther { }\nclass L{} : K{} { }\n")))


@query("ext11h_references", f"""WITH {IDS} SELECT 'U' || id AS "from", 'Base' AS "to", 'references' AS type, 0.15::DOUBLE AS weight FROM d""")
def ext11h(spark, d):
    t = made(spark, d, "class U{} { Base b; Unknown c; }\n").select("file_path", "text").unionByName(spark.createDataFrame([("base.cs", "class Base {}\n")], "file_path string, text string"))
    return extract.reference_uses(t, extract.csharp_types(t))


@query("ext11i_test_edges", f"""WITH {IDS} SELECT 'T' || id AS "from", t AS "to", 'tests' AS type FROM d, (VALUES ('IShop'), ('Shop1'), ('Shop2')) v(t)""")
def ext11i(spark, d):
    uses = made(spark, d, "x").select(F.concat(F.lit("T"), "id").alias("test"), F.explode(F.array(F.lit("IShop"), F.lit("Gone"))).alias("used"))
    resolves = spark.createDataFrame([("IShop", "Shop1"), ("IShop", "Shop2")], "service string, implementation string")
    return extract.test_edges(uses, resolves, spark.createDataFrame([("IShop",), ("Shop1",), ("Shop2",)], "node string")).select("from", "to", "type")


@query(
    "par1_change_log",
    f"WITH {IDS} SELECT id, \"commit\", CASE \"commit\" WHEN 1 THEN 'src/a' || id || '.cs' ELSE 'b.cs' END AS path FROM d, (VALUES (1), "
    f"(2)) v(\"commit\")",
)
def par1(spark, d):
    text = "\x012024-01-02\nsrc/a{}.cs\nreadme.md\n\n\x012024-01-01\nb.cs\n\x012023-01-01\nonly.md\n"
    return version_control.change_log(made(spark, d, text).select(F.col("id").alias("log"), "text")).select(F.col("log").alias("id"), "commit", "path")


@query(
    "par2_unified_diffs",
    f"WITH {IDS} SELECT id, path || id AS path, added, removed, hunks FROM d, (VALUES ('x', 2, 1, 1), "
    f"('y', 0, 1, 1)) v(path, added, removed, hunks)",
)
def par2(spark, d):
    text = "diff --git a/x{} b/x{}\n--- a/x{}\n+++ b/x{}\n@@ -1 +1,2 @@\n-a\n+b\n+c\ndiff --git a/y{} b/y{}\n--- a/y{}\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n"
    return version_control.unified_diffs(made(spark, d, text).select(F.col("id").alias("diff"), "text")).withColumnRenamed("diff", "id")


@query("par3_test_results", f"WITH {IDS} SELECT id, test || id AS test, outcome FROM d, (VALUES ('a', 'passed'), ('b', 'failed'), ('c', 'not-run')) v(test, outcome)")
def par3(spark, d):
    text = '<R><UnitTestResult testName="a{}" outcome="Passed" /><UnitTestResult outcome="Failed" testName="b{}"/><UnitTestResult testName="c{}" outcome="Timeout" /></R>'
    return version_control.test_results(made(spark, d, text).select(F.col("id").alias("report"), "text")).withColumnRenamed("report", "id")


@query(
    "par4_workflow_commands",
    f"WITH {IDS} SELECT id, command || id AS command, needs_secret, publishes FROM d, (VALUES ('make test', false, false), "
    f"('deploy ${{{{ secrets.KEY }}}} ', true, true)) v(command, needs_secret, publishes)",
)
def par4(spark, d):
    text = "steps:\n  - run: make test{}\n  - run: |\n      deploy ${{ secrets.KEY }} {}\n"
    found = version_control.workflow_commands(made(spark, d, text.replace("{{", "\1").replace("}}", "\2")).select(F.col("id").alias("workflow"), F.replace(F.replace("text", F.lit("\1"), F.lit("{{")), F.lit("\2"), F.lit("}}")).alias("text")))
    return found.withColumnRenamed("workflow", "id")


@query("par6_project_references", f"WITH {IDS} SELECT id, '../Lib' || id || '/Lib.csproj' AS reference FROM d")
def par6(spark, d):
    text = '<Project><ItemGroup><ProjectReference Include="..\\Lib{}\\Lib.csproj" /><PackageReference Include="X" /></ItemGroup></Project>'
    return version_control.project_references(made(spark, d, text).select(F.col("id").alias("project"), "text")).withColumnRenamed("project", "id")


KEPT = "id::BIGINT % 4 <> 1 AND id::BIGINT % 5 <> 2 AND id::BIGINT % 7 <> 3"


@query("fil_collection_filters", f"WITH {IDS} SELECT id FROM d WHERE {KEPT}")
def fil(spark, d):
    n = F.col("id").cast("long")
    folder = F.when(n % 4 == 1, "src/BIN/").otherwise("src/")
    name = F.when(n % 5 == 2, F.concat(F.lit("x"), "id", F.lit(".txt"))).otherwise(F.concat(F.lit("x"), "id", F.lit(".cs")))
    t = made(spark, d, "code {}").withColumn("path", F.concat(folder, name)).withColumn("text", F.when(n % 7 == 3, F.lit("a\0b")).otherwise(F.col("text")))
    return t.where(files.keep(F.col("path"), extensions=[".cs"], excluded_dirs=["bin"], text=F.col("text"))).select("id")


@query("fil_test_projects", f"WITH {IDS} SELECT id, id::BIGINT % 3 = 2 AS no_tests, id::BIGINT % 3 <> 0 AS no_unit_tests FROM d")
def fil_tests(spark, d):
    n = F.col("id").cast("long")
    path = F.concat(F.when(n % 3 == 0, "My.UnitTests/f").when(n % 3 == 1, "My.Benchmarks/f").otherwise("My.Core/f"), "id", F.lit(".cs"))
    return made(spark, d, "x").select("id", files.keep(path, without_tests=True).alias("no_tests"), files.keep(path, without_unit_tests=True).alias("no_unit_tests"))


@query("par5_ignore_globs", f"WITH {IDS} SELECT id, id::BIGINT % 3 = 0 OR id::BIGINT % 3 = 1 AS ignored FROM d")
def par5(spark, d):
    globs = files.ignore_globs("# build output\nout/**\n\n*.tmp\n")
    n = F.col("id").cast("long")
    path = F.when(n % 3 == 0, F.concat(F.lit("out/a/f"), "id")).when(n % 3 == 1, F.concat(F.lit("b/f"), "id", F.lit(".tmp"))).otherwise(F.concat(F.lit("b/f"), "id", F.lit(".cs")))
    return made(spark, d, "x").select("id", (~files.keep(path, globs=globs)).alias("ignored"))


@query("src9_template_filter", f"WITH {IDS} SELECT id, id::BIGINT % 3 = 2 AS taken FROM d")
def src9(spark, d):
    n = F.col("id").cast("long")
    path = F.when(n % 3 == 0, F.concat(F.lit("obj/f"), "id", F.lit(".cs"))).when(n % 3 == 1, F.concat(F.lit("a/f"), "id", F.lit(".g.cs"))).otherwise(F.concat(F.lit("a/f"), "id", F.lit(".cs")))
    return made(spark, d, "x").select("id", templates.chosen(path, "DotNet").alias("taken"))


def nation_files(spark, d) -> str:
    """A folder of text files: a folder for each region with the names of its nations."""
    root = new_path(spark, "tree")
    table(spark, d, "nation").select(F.col("n_name").alias("value"), F.col("n_regionkey").alias("region")).repartition(1).write.partitionBy("region").text(root)
    return root


LINES = "SELECT n_regionkey::VARCHAR AS region, count(*) AS lines, sum(length(n_name) + 1)::BIGINT AS bytes FROM nation {} GROUP BY 1"


def region_lines(found):
    region = F.regexp_extract("path", "region=([^/]+)/", 1)
    return found.groupBy(region.alias("region")).agg(F.sum(F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1).alias("lines"), F.sum("size").alias("bytes"))


@query("src1_folder_scan", LINES.format(""))
def src1(spark, d):
    return region_lines(files.scan(spark, nation_files(spark, d)).where(files.keep(F.col("path"), extensions=[".txt"])))


@query("src2_listed_files", LINES.format("WHERE n_regionkey IN (0, 2)"))
def src2(spark, d):
    found = files.scan(spark, nation_files(spark, d)).where("path RLIKE 'region=(0|2)/'").select("path")
    return region_lines(files.listed(spark, [r["path"] for r in found.collect()]))  # two files


@query(
    "src4_inventory",
    f"WITH {IDS}, t AS (SELECT id, file_path, 'class C' || id || ' {{}}' AS text "
    f"FROM d) SELECT file_path, sha256(text) AS content_hash, false AS is_test, id::BIGINT % 4 = 0 AS skipped FROM t",
)
def src4(spark, d):
    t = made(spark, d, "class C{} \1").withColumn("text", F.replace("text", F.lit("\1"), F.lit("{}")))
    size = F.when(F.col("id").cast("long") % 4 == 0, F.lit(6 << 20)).otherwise(F.length("text"))
    rows = t.select(F.col("file_path").alias("path"), size.alias("size"), F.lit(None).cast("timestamp").alias("modified"), F.col("text").cast("binary").alias("content"))
    kept, skipped = files.inventory(rows)
    both = kept.select("path", "content_hash", "is_test", F.lit(False).alias("skipped")).unionByName(skipped.join(rows, "path").select("path", F.sha2("content", 256).alias("content_hash"), F.lit(False).alias("is_test"), F.lit(True).alias("skipped")))
    return both.withColumnRenamed("path", "file_path")


@query("src7_store_round_trip", "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def src7(spark, d):
    path = new_path(spark, "store")
    store.save_store({"nation": table(spark, d, "nation"), "region": table(spark, d, "region")}, path, 3)
    return store.table_counts(store.open_store(spark, path, 3)).select(F.col("table_name").alias("name"), F.col("rows").alias("n"))


@query("snk4_replaced_table", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def snk4(spark, d):
    old = table(spark, d, "nation").select("n_nationkey", "n_name")
    return store.replace_all(old, table(spark, d, "nation").where("n_regionkey = 1"), new_path(spark, "replaced"))


PARTS_SQL = f"WITH RECURSIVE {PLAN_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY path) AS n FROM p), f AS (SELECT plan, path, n, cost, cost AS used, 1 AS part FROM o WHERE n = 1 UNION ALL SELECT o.plan, o.path, o.n, o.cost, CASE WHEN f.used > 0 AND f.used + o.cost > 9000 THEN o.cost ELSE f.used + o.cost END, f.part + CASE WHEN f.used > 0 AND f.used + o.cost > 9000 THEN 1 ELSE 0 END FROM f JOIN o ON o.plan = f.plan AND o.n = f.n + 1)"


@query("snk5_written_parts", PARTS_SQL + " SELECT plan, part, count(*) AS entries, sum(cost)::BIGINT AS tokens, count(*) AS lines FROM f GROUP BY 1, 2")
def snk5(spark, d):
    rows = plan_rows(spark, d).select("plan", F.col("path").alias("seq"), F.col("path").cast("string").alias("path"), F.lit("body").alias("body"), "cost")
    root = new_path(spark, "output")
    parts = emit.write_parts(rows, 9000, root, "json")
    written = spark.read.schema("plan string, part int, value string").json(root).groupBy("plan", "part").agg(F.sum(F.size(F.split("value", "\n"))).alias("lines"))
    return parts.join(written, ["plan", "part"])


@query("lkp5_routes", f"WITH {IDS} SELECT file_path, verb, '/' || lower(verb) || id AS pattern FROM d, (VALUES ('GET'), ('POST')) v(verb)")
def lkp5(spark, d):
    t = made(spark, d, 'app.MapGet("get{}", f);\napp.MapPost("post{}", f);\n')
    return store.list_routes(extract.routes(t), t).select("file_path", "verb", "pattern")


@query("lkp6_node_by_id", f"WITH {NODES_SQL} SELECT node, file_path FROM nodes WHERE node = 'n7'")
def lkp6(spark, d):
    return store.node_by_id(fixtures.nodes(spark, d), "n7")


@query("map1_workspace_map", f"""WITH {fixtures.SYMBOLS_SQL}, f AS (SELECT DISTINCT file_path FROM symbols), c AS (SELECT 'counts' AS section, unnest([1, 2, 3]) AS line_no, unnest([(SELECT 'files: ' || count(*) FROM f), (SELECT 'routes: ' || count(*) FROM nation), (SELECT 'symbols: ' || count(*) FROM symbols)]) AS line),
s AS (SELECT 'symbols' AS section, row_number() OVER (ORDER BY is_public DESC, lower(name), symbol_id::VARCHAR) AS line_no, name || ' (' || file_path || ')' AS line FROM (SELECT * FROM symbols ORDER BY is_public DESC, lower(name), symbol_id LIMIT 12)),
r AS (SELECT 'routes' AS section, row_number() OVER (ORDER BY lower(n_name)) AS line_no, 'GET ' || n_name AS line FROM nation QUALIFY row_number() OVER (ORDER BY lower(n_name)) <= 12) SELECT section, line_no::INTEGER AS line_no, line FROM c UNION ALL SELECT section, line_no::INTEGER, line FROM s UNION ALL SELECT section, line_no::INTEGER, line FROM r""")
def map1(spark, d):
    s = fixtures.symbols(spark, d)
    inside = s.select("file_path").distinct()
    routes = table(spark, d, "nation").select(F.lit("f1").alias("file_path"), F.col("n_nationkey").alias("line_no"), F.lit("GET").alias("verb"), F.col("n_name").alias("pattern"))
    return store.workspace_map(inside, s, routes, 12)


@query("agg4_route_count", f"WITH {IDS} SELECT 2 * count(*) AS routes FROM d")
def agg4(spark, d):
    return extract.routes(made(spark, d, 'app.MapGet("a{}", f);\napp.MapPost("b{}", f);\n')).agg(F.count(F.lit(1)).alias("routes"))


@query(
    "rnk2_exact_candidates",
    f"WITH {EDGES_SQL}, {NODES_SQL}, e AS (SELECT 'service' AS kind, t AS node, 0.95::DOUBLE AS score FROM edges "
    f"WHERE type = 'implements' AND f IN ('n1', 'n2') "
    f"UNION ALL SELECT 'focus', 'c5', 0.95) SELECT DISTINCT kind, node, file_path, score FROM e JOIN nodes USING (node)",
)
def rnk2(spark, d):
    edges = fixtures.edges(spark, d).withColumn("type", F.when(F.col("type") == "implements", "di_resolves_to").otherwise(F.col("type")))
    return localize.exact_candidates(edges, fixtures.nodes(spark, d), [("service", "n1"), ("service", "n2"), ("focus", "c5"), ("route", "n1")])


@query(
    "rnk15_nearest_symbols",
    f"WITH {fixtures.SYMBOLS_SQL}, n AS (SELECT DISTINCT name, CASE WHEN contains(lower(name), "
    f"'widget') THEN 1 ELSE 0 END + CASE WHEN contains(lower(name), 'cold') THEN 1 ELSE 0 END AS hits FROM symbols) SELECT name, hits "
    f"FROM n WHERE hits > 0 ORDER BY hits DESC, length(name), name LIMIT 8",
)
def rnk15b(spark, d):
    return fusion.nearest_symbols(fixtures.symbols(spark, d), "fix the cold widget")


@query("rnk15_entry_points", "SELECT DISTINCT 'src' || n_regionkey || '/main.py' AS file_path, 1 AS depth FROM nation")
def rnk15c(spark, d):
    names = table(spark, d, "nation").select(F.concat(F.lit("src"), F.col("n_regionkey"), F.when(F.col("n_nationkey") % 2 == 0, "/main.py").otherwise("/other.py")).alias("file_path")).distinct()
    both = names.unionByName(table(spark, d, "region").select(F.concat(F.lit("src"), F.col("r_regionkey"), F.lit("/main.py")).alias("file_path"))).distinct()
    return fusion.entry_points(both)


@query(
    "pck2_plan_seeds",
    f"WITH {EDGES_SQL}, {NODES_SQL}, s AS (SELECT node, 1.0::DOUBLE AS score FROM nodes WHERE file_path = 'r1' UNION ALL SELECT t, 1.0 "
    f"FROM edges WHERE type = 'implements' AND f = 'n4' UNION ALL SELECT node, 0.9 FROM nodes "
    f"WHERE lower(node) IN ('c9', 'n1')) SELECT node, max(score) AS score FROM s GROUP BY 1",
)
def pck2(spark, d):
    edges = fixtures.edges(spark, d).withColumn("type", F.when(F.col("type") == "implements", "route_handles").otherwise(F.col("type")))
    return localize.plan_seeds(edges, fixtures.nodes(spark, d), ["r1"], ["n4"], ["C9", "N1"])


@query(
    "pck4_tiers",
    "SELECT doc_id, CASE lang WHEN 'en' THEN 'full' WHEN 'fr' THEN 'skeleton' ELSE 'reduced' END AS auto, 'skeleton' AS fixed FROM documents",
)
def pck4(spark, d):
    role = F.when(F.col("lang") == "en", "config").when(F.col("lang") == "fr", "test").otherwise("exact-seed")
    return table(spark, d, "documents").select("doc_id", packing.tier(role).alias("auto"), packing.tier(role, "skeleton").alias("fixed"))


@query(
    "pck10_sketches",
    f"WITH {IDS} SELECT file_path, '// sketch of ' || file_path || ': outline only, bodies left out' || chr(10) || 'class C' || id || ': _x, Get' || chr(10) || 'enum E' || id || ': A, B' || chr(10) AS content "
    f"FROM d",
)
def pck10(spark, d):
    return code.sketched(made(spark, d, PROGRAM).withColumn("tokens", F.lit(7000)))


def _density_sql(budget: str, name: str) -> str:
    """Recursive packing by density: trivial rows free, the best row kept, others if they fit."""
    return f"{name}o AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY CASE WHEN always THEN 0 ELSE 1 END, -score / greatest(c, 1), path) AS n FROM {name}b), {name} AS (SELECT plan, path, n, c, always OR c <= {budget} AS kept, CASE WHEN always OR c <= {budget} THEN c ELSE 0 END AS used FROM {name}o WHERE n = 1 UNION ALL SELECT o.plan, o.path, o.n, o.c, o.always OR f.used + o.c <= {budget.replace('reserve', 'o.reserve')}, f.used + CASE WHEN o.always OR f.used + o.c <= {budget.replace('reserve', 'o.reserve')} THEN o.c ELSE 0 END FROM {name} f JOIN {name}o o ON o.plan = f.plan AND o.n = f.n + 1)"


_DENSE = f"{PLAN_SQL}, t AS (SELECT plan, path, score, cost, cost < 30 AS trivial, CASE WHEN cost < 30 THEN 0 ELSE cost + 30 END AS c FROM p), tb AS (SELECT plan, arg_min(path, (-score, path)) AS top FROM t WHERE NOT trivial GROUP BY 1), {{}} AS (SELECT t.plan, path, score, c, trivial OR path = top AS always FROM t JOIN tb ON tb.plan = t.plan)"


@query("pck6_density_packer", f"WITH RECURSIVE {_DENSE.format('fb')}, {_density_sql('9000', 'f')} SELECT path, c AS cost, kept FROM f")
def pck6(spark, d):
    rows = plan_rows(spark, d).select("plan", "path", "score", F.col("cost").alias("tokens"), (F.col("cost") < 30).alias("trivial"))
    return packing.pack_density(rows, 9000).select("path", "cost", "kept")


@query(
    "pck11_framed_packing",
    f"WITH RECURSIVE {_DENSE.format('fb')}, {_density_sql('9000', 'f')}, r AS (SELECT plan, 120 + 12 * sum(CASE WHEN kept THEN 1 ELSE 0 END) AS reserve "
    f"FROM f GROUP BY 1), gb AS (SELECT fb.*, reserve FROM fb "
    f"JOIN r ON r.plan = fb.plan), {_density_sql('(9000 - reserve)', 'g')} SELECT path, kept FROM g",
)
def pck11(spark, d):
    rows = plan_rows(spark, d).select("plan", "path", "score", F.col("cost").alias("tokens"), (F.col("cost") < 30).alias("trivial"))
    return packing.pack_framed(rows, 9000).select("path", "kept")


@query(
    "pck12_contents_levels",
    "WITH c AS (SELECT sum(ceil((length(source || '/' || doc_id) + 8) / 4.0)) AS files FROM documents), "
    "f AS (SELECT sum(ceil((length(source) + 8) / 4.0)) AS folders FROM (SELECT DISTINCT source "
    "FROM documents)) SELECT budget, CASE WHEN files <= budget THEN 'files' WHEN folders <= budget THEN 'folders' ELSE 'totals' END AS level "
    "FROM c, f, (VALUES (1), (1000), (100000000)) b(budget)",
)
def pck12b(spark, d):
    t = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("n_chars").alias("tokens"))
    return packing.contents_levels(t, [1, 1000, 100_000_000])


REDUCED = "'public class C' || id || ' : IBase' || chr(10) || '{' || chr(10) || 'private int _x = 1;' || chr(10) || 'public int Get(int a)' || chr(10) || '{' || chr(10) || '    return a + 1; ' || chr(10) || '}' || chr(10) || '}' || chr(10) || 'internal enum E' || id || ' { A, B }'"


@query("red3_csharp_reducer", f"WITH {IDS} SELECT id, {REDUCED} AS reduced FROM d")
def red3(spark, d):
    return code.reduced(made(spark, d, PROGRAM)).select("id", "reduced")


@query(
    "red3_aggressive",
    f"WITH {IDS} SELECT id, 'public class C' || id || ':IBase{{private int _x=1;public int Get(int a){{return a + 1;}}}}internal enum E' || id || '{{A,B}}' AS reduced "
    f"FROM d",
)
def red3b(spark, d):
    return code.reduced(made(spark, d, PROGRAM), csharp.Reduction(aggressive=True)).select("id", "reduced")


@query("red16_reduced_once", "SELECT n_nationkey, 'class R' || n_regionkey || ' { }' AS reduced FROM nation")
def red16(spark, d):
    """Equal texts are reduced once: 25 files of five texts."""
    t = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("class R"), "n_regionkey", F.lit(" { } // x")).alias("text"))
    return code.reduced(t).select("n_nationkey", "reduced")


@query("red4_generated_bodies", f"WITH {IDS} SELECT id, 'class M' || id || ' : Migration {{ void Up(MigrationBuilder b) {{ /* collapsed generated body */ }} void Z() {{ q(); }} }}' AS collapsed FROM d".replace("{{", "{").replace("}}", "}"))
def red4(spark, d):
    t = made(spark, d, 'class M{} : Migration \1 void Up(MigrationBuilder b) \1 b.Sql("}"); \2 void Z() \1 q(); \2 \2').withColumn("text", F.replace(F.replace("text", F.lit("\1"), F.lit("{")), F.lit("\2"), F.lit("}")))
    return code.per_file(t, "collapsed string", lambda text: [(csharp.collapse_generated(text),)], keep=("id",))


@query("red10_skeletons", f"WITH {IDS} SELECT file_path, 'using System;' || chr(10) || 'namespace Shop;' || chr(10) || 'public class C' || id || ' : IBase' || chr(10) || '{{' || chr(10) || '    private int _x = 1;' || chr(10) || '    public int Get(int a);' || chr(10) || '}}' || chr(10) || 'internal enum E' || id || ' {{ A, B }}' || chr(10) AS skeleton FROM d".replace("{{", "{").replace("}}", "}"))
def red10(spark, d):
    return code.skeletons(made(spark, d, PROGRAM))


@query("red10_public_skeletons", f"WITH {IDS} SELECT file_path, 'using System;' || chr(10) || 'namespace Shop;' || chr(10) || 'public class C' || id || ' : IBase' || chr(10) || '{{' || chr(10) || '    public int Get(int a);' || chr(10) || '}}' || chr(10) AS skeleton FROM d".replace("{{", "{").replace("}}", "}"))
def red10b(spark, d):
    return code.skeletons(made(spark, d, PROGRAM), public_only=True)


THIN = "class A\n{\n    int x = 1;\n    void M()\n    {\n        x = 2;\n    }\n    void N()\n    {\n        x = {};\n    }\n}\n"


@query("red11_thin_skeletons", f"WITH {IDS} SELECT file_path, 'class A' || chr(10) || '{{' || chr(10) || '    int x = 1;' || chr(10) || '    void M();' || chr(10) || '    void N()' || chr(10) || '    {{' || chr(10) || '        x = ' || id || ';' || chr(10) || '    }}' || chr(10) || '}}' AS skeleton FROM d".replace("{{", "{").replace("}}", "}"))
def red11(spark, d):
    return code.thin_skeletons(made(spark, d, THIN).withColumn("chosen", F.array(F.lit("A.N"))))


@query("red12_symbol_slices", f"WITH {IDS} SELECT file_path, 'class A {{' || chr(10) || 'void N()' || chr(10) || '    {{' || chr(10) || '        x = ' || id || ';' || chr(10) || '    }}' || chr(10) || '}}' AS slice FROM d".replace("{{", "{").replace("}}", "}"))
def red12(spark, d):
    return code.slices(made(spark, d, THIN).withColumn("name", F.lit("A.N")))


@query("red5_css_reducer", f"WITH {IDS} SELECT id, 'a{{color:red;}}b' || id || '{{}}' AS reduced FROM d".replace("{{", "{").replace("}}", "}"))
def red5(spark, d):
    t = made(spark, d, "a \1 color : red ; \2\n/* x */\nb{} \1 \2").withColumn("text", F.replace(F.replace("text", F.lit("\1"), F.lit("{")), F.lit("\2"), F.lit("}")))
    return t.select("id", reduce.reduce_text(F.col("text"), "css").alias("reduced"))


@query("red7_script_reducer", f"WITH {IDS} SELECT id, 'x=' || id || chr(10) || 'y(2)' AS reduced FROM d")
def red7(spark, d):
    return made(spark, d, "x=  {} // no\n\n\n  y( 2 )").select("id", F.regexp_replace(reduce.reduce_text(F.col("text"), "javascript"), "= ", "=").alias("reduced"))


@query("red9_markdown_reducer", f"WITH {IDS} SELECT id, '# Head' || id || chr(10) || 'a|b' || chr(10) || chr(10) || '[l](u)' AS reduced FROM d")
def red9(spark, d):
    return made(spark, d, 'Head{}\n====\na | b\n\n\n\n[l](u "t")').select("id", reduce.reduce_text(F.col("text"), "markdown").alias("reduced"))


@query(
    "ded1_shared_headers",
    f"WITH {IDS} SELECT id::BIGINT AS id, id::BIGINT % 3 AS kind, CASE id::BIGINT % 3 WHEN 0 THEN dense_rank() OVER (ORDER BY a) WHEN 1 THEN dense_rank() OVER (ORDER BY a) END AS header_id "
    f"FROM (SELECT id, CASE id::BIGINT % 3 WHEN 0 THEN min(id::BIGINT) OVER (PARTITION BY id::BIGINT % 3) WHEN 1 THEN min(id::BIGINT) OVER (PARTITION BY id::BIGINT % 3) ELSE 1e12 END AS a "
    f"FROM d)",
)
def ded1b(spark, d):
    """Two shared headers, numbered by first appearance, and headers of one file alone."""
    n = F.col("id").cast("long")
    head = F.when(n % 3 == 0, "// License of the first kind\n").when(n % 3 == 1, "/* License of the second kind */\n").otherwise(F.concat(F.lit("// Only of this one file "), "id", F.lit("\n")))
    t = made(spark, d, "x").select(n.alias("pos"), F.concat(head, F.lit("code")).alias("text"))
    return delta.header_dedup(t).select(F.col("pos").alias("id"), (F.col("pos") % 3).alias("kind"), "header_id")


@query(
    "dif3_changed_file_delta",
    f"WITH {IDS} SELECT 'C' || id AS fqn, CASE id::BIGINT % 3 WHEN 0 THEN 'removed' ELSE 'signature-changed' END AS kind, true AS breaking "
    f"FROM d WHERE id::BIGINT % 3 <> 2 UNION ALL SELECT 'D' || id, 'added', false FROM d WHERE id::BIGINT % 3 = 0",
)
def dif3(spark, d):
    before = made(spark, d, "public class C{} {}")
    n = F.col("id").cast("long")
    after = made(spark, d, "x").withColumn("text", F.when(n % 3 == 0, F.concat(F.lit("public class D"), "id", F.lit(" {}"))).when(n % 3 == 1, F.concat(F.lit("public class C"), "id", F.lit(" : B {}"))).otherwise(F.concat(F.lit("public class C"), "id", F.lit(" {}"))))
    return code.changed_file_delta(before.withColumn("text", F.concat(F.lit("public class C"), "id", F.lit(" {}"))), after)


@query("dif6_repairs", """WITH s AS (SELECT 'M' || n_nationkey AS name, 'T' || n_regionkey AS owner, 'int M' || n_nationkey || '(Kind' || n_nationkey % 2 || ' k)' AS signature FROM nation), t AS (SELECT 'T' || r_regionkey || 'able' AS name FROM region),
q AS (SELECT n_nationkey AS seq, n_nationkey % 4 AS c, 'T' || n_regionkey AS owner, 'M' || n_nationkey || 'x' AS asked FROM nation),
r AS (SELECT seq, 'CS1061' AS code, s.name AS candidate, row_number() OVER (PARTITION BY seq ORDER BY levenshtein(lower(s.name), lower(asked)), s.name) AS rank FROM q JOIN s USING (owner) WHERE c = 0
UNION ALL SELECT seq, 'CS0246', t.name, row_number() OVER (PARTITION BY seq ORDER BY levenshtein(lower(t.name), lower(q.owner || 'abl')), t.name) FROM q JOIN t ON contains(lower(t.name), lower(q.owner || 'a')) WHERE c = 1
UNION ALL SELECT seq, 'CS7036', s.signature, 1 FROM q JOIN s ON s.name || 'x' = q.asked WHERE c = 2
UNION ALL SELECT seq, 'CS0029', s.name, row_number() OVER (PARTITION BY seq ORDER BY s.name) FROM q JOIN s USING (owner) WHERE c = 3 AND contains(s.signature, 'Kind1'))
SELECT seq, code, candidate, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def dif6_repairs(spark, d):
    n = table(spark, d, "nation")
    k, owner = F.col("n_nationkey"), F.concat(F.lit("T"), "n_regionkey")
    members = n.select(F.lit("method").alias("kind"), F.concat(F.lit("M"), k).alias("name"), F.concat(F.lit("Shop."), owner).alias("containing_type"), F.concat(F.lit("Shop."), owner, F.lit(".M"), k).alias("fqn"), F.concat(F.lit("int M"), k, F.lit("(Kind"), k % 2, F.lit(" k)")).alias("signature"), F.lit(True).alias("is_public"))
    types = table(spark, d, "region").select(F.lit("class").alias("kind"), F.concat(F.lit("T"), "r_regionkey", F.lit("able")).alias("name"), F.lit(None).cast("string").alias("containing_type"), F.lit("x").alias("fqn"), F.lit("class").alias("signature"), F.lit(True).alias("is_public"))
    text = F.when(k % 4 == 0, F.concat(F.lit("'"), owner, F.lit("' does not contain a definition for 'M"), k, F.lit("x'"))).when(k % 4 == 1, F.concat(F.lit("The type or namespace name '"), owner, F.lit("abl' could not be found")))
    text = text.when(k % 4 == 2, F.concat(F.lit("There is no argument for the parameter 'k' of 'Shop."), owner, F.lit(".M"), k, F.lit("(Kind0)'"))).otherwise(F.concat(F.lit("Cannot convert type 'Shop."), owner, F.lit("' to 'Shop.Kind1'")))
    code_of = F.element_at(F.array(*[F.lit(c) for c in ("CS1061", "CS0246", "CS7036", "CS0029")]), (k % 4 + 1).cast("int"))
    return delta.repairs(n.select(k.alias("seq"), code_of.alias("code"), text.alias("message")), members.unionByName(types))


@query(
    "dif7_review_text",
    "WITH r AS (SELECT '1 files' AS section, 'f' || n_nationkey || ' +1 -' || n_regionkey AS line FROM nation "
    "UNION ALL SELECT '2 api', 'breaking removed: N' || n_nationkey FROM nation WHERE n_regionkey = 0 "
    "UNION ALL SELECT '3 callers', 'a.cs uses N' || n_nationkey FROM nation WHERE n_regionkey = 1) SELECT * FROM r",
)
def dif7(spark, d):
    n = table(spark, d, "nation")
    changed = n.select(F.concat(F.lit("f"), "n_nationkey").alias("path"), F.lit(1).alias("added"), F.col("n_regionkey").alias("removed"))
    gone = n.where("n_regionkey = 0").select(F.concat(F.lit("N"), "n_nationkey").alias("fqn"), F.lit("removed").alias("kind"), F.lit(True).alias("breaking"))
    return emit.review_text(changed, gone, n.where("n_regionkey = 1").select(F.lit("a.cs").alias("caller"), F.concat(F.lit("N"), "n_nationkey").alias("type")))


@query("dif9_covering_not_run", "SELECT 'T' || n_nationkey AS name FROM nation WHERE n_regionkey <> 2")
def dif9(spark, d):
    n = table(spark, d, "nation")
    return emit.covering_not_run(n.select(F.concat(F.lit("T"), "n_nationkey").alias("name")), n.where("n_regionkey = 2").select(F.concat(F.lit("T"), "n_nationkey", F.lit(".Works.Twice")).alias("test")))


@query(
    "ses1_session_delta",
    "SELECT conv_id, turn, CASE WHEN b IS NULL THEN 'new' WHEN b = coalesce(text, '') THEN 'unchanged' WHEN length(b) <= 200 THEN 'diff' ELSE 'whole' END AS state "
    "FROM (SELECT *, lag(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)",
)
def ses1(spark, d):
    return delta.session_delta(table(spark, d, "conversations"), ["conv_id"], "turn", "text", retained=200).select("conv_id", "turn", "state")


@query(
    "ses4_ledger",
    "SELECT row_number() OVER (PARTITION BY n_regionkey "
    "ORDER BY n_nationkey)::INTEGER AS line_no, n_regionkey AS ledger, '[proven] ' || n_name || ' (f' || n_nationkey || ')' AS line "
    "FROM nation",
)
def ses4(spark, d):
    return emit.render_ledger(table(spark, d, "nation").select(F.col("n_regionkey").alias("ledger"), F.col("n_nationkey").alias("seq"), F.lit("proven").alias("grade"), F.col("n_name").alias("claim"), F.concat(F.lit("f"), "n_nationkey").alias("path")))


@query(
    "pat1_detectors",
    f"WITH {IDS} SELECT pattern, n * count(*) AS matches, count(*) AS texts FROM d, (VALUES ('async', 2), ('exceptions', 1), "
    f"('logging', 1), ('dependency-injection', 1)) v(pattern, n) GROUP BY pattern, n",
)
def pat1(spark, d):
    t = made(spark, d, "async Task A{}() => await x.ConfigureAwait(false); try {} catch (E) {} ILogger<A> l; s.AddScoped<A>();")
    return delta.pattern_counts(t, delta.DETECTORS, "id").select("pattern", "matches", "texts")


@query(
    "grf10_focus",
    f"WITH {EDGES_SQL}, s AS (SELECT 'n3' AS node, 1.0::DOUBLE AS score UNION ALL SELECT t, 0.5 FROM edges WHERE f = 'n3' "
    f"UNION ALL SELECT f, 0.5 FROM edges WHERE t = 'n3') SELECT node, max(score) AS score FROM s GROUP BY 1",
)
def grf10(spark, d):
    seeds = spark.createDataFrame([("n3", 1.0)], "node string, score double")
    return graph.focus(fixtures.edges(spark, d), seeds, 1).select("node", "score")


@query(
    "grf10_budgeted_focus",
    f"WITH RECURSIVE {EDGES_SQL}, e AS (SELECT f, t FROM edges UNION SELECT t, f FROM edges), a AS (SELECT DISTINCT t AS node FROM e WHERE f = 'n3'), "
    "s AS (SELECT 'n3' AS node, 1.0::DOUBLE AS score UNION ALL SELECT node, 0.5 FROM a UNION ALL SELECT DISTINCT e.t, 0.25 FROM e JOIN a ON e.f = a.node), "
    "o AS (SELECT node, max(score) AS score, length(node) * 10 AS cost, row_number() OVER (ORDER BY node <> 'n3', max(score) DESC, node) AS i FROM s GROUP BY node), "
    "k AS (SELECT 0::BIGINT AS i, 0::BIGINT AS used, false AS kept UNION ALL SELECT o.i, CASE WHEN o.i = 1 OR used + cost <= 905 THEN used + cost ELSE used END, o.i = 1 OR used + cost <= 905 "
    "FROM k JOIN o ON o.i = k.i + 1) SELECT node, score, cost FROM o JOIN k USING (i) WHERE kept",
)
def grf10_budget(spark, d):
    """Two hops around a nation, as far as a budget of tokens goes; rows that do not fit are passed over."""
    seeds = spark.createDataFrame([("n3", 1.0)], "node string, score double")
    costs = fixtures.nodes(spark, d).select("node", (F.length("node") * 10).alias("cost"))
    return graph.focus(fixtures.edges(spark, d), seeds, 2, costs=costs, budget=905).select("node", "score", "cost")


@query("grf13_project_neighbours", "SELECT 'p' || n_regionkey || '/n' || n_nationkey || '.cs' AS file_path FROM nation WHERE n_regionkey IN (0, 2) ORDER BY 1 LIMIT 48")
def grf13(spark, d):
    inside = table(spark, d, "nation").select(F.concat(F.lit("p"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit(".cs")).alias("file_path"))
    first = inside.where("file_path LIKE 'p1/%'").agg(F.min("file_path")).first()[0]
    projects = table(spark, d, "region").select(F.concat(F.lit("p"), "r_regionkey").alias("project_dir"))
    links = spark.createDataFrame([("p1", "p2"), ("p0", "p1"), ("p3", "p4")], "from_dir string, to_dir string")
    return graph.project_neighbours(inside, projects, links, first).select("file_path")


@query("grf14_direct_callers", f"WITH {IDS} SELECT file_path AS caller, 'Base' AS type FROM d WHERE id::BIGINT % 2 = 0")
def grf14(spark, d):
    t = made(spark, d, "class K{} { Base b; }").withColumn("text", F.when(F.col("id").cast("long") % 2 == 0, F.col("text")).otherwise(F.lit("class X { }"))).select("file_path", "text")
    base = spark.createDataFrame([("base.cs", "class Base { }")], "file_path string, text string")
    both = t.unionByName(base)
    return code.direct_callers(code.csharp_symbols(base), both, base)


@query(
    "oth1_graph_view",
    "WITH f AS (SELECT DISTINCT 'r' || n_regionkey AS file_path FROM nation), "
    "g AS (SELECT 'r' || n_regionkey AS file_path, count(*) AS degree FROM nation "
    "GROUP BY 1) SELECT file_path, 10 AS tokens, round(degree / max(degree) OVER (), "
    "4) AS centrality, list_aggregate(list_sort((SELECT list('N' || n_nationkey) FROM nation n "
    "WHERE 'r' || n.n_regionkey = file_path))[1:3], 'string_agg', ',') AS types FROM f JOIN g USING (file_path)",
)
def oth1(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("file_path"), F.concat(F.lit("N"), "n_nationkey").alias("name"))
    links = n.select(F.col("file_path").alias("from_file"), F.lit("other").alias("to_file"))
    rows = n.select("file_path", F.lit(10).alias("tokens")).distinct()
    own = links.where("from_file <> to_file").select("from_file", F.col("from_file").alias("to_file"))
    view = graph.graph_view(rows, n, own, 3)
    return view.withColumn("types", F.array_join("types", ","))


@query(
    "oth3_subgraph",
    "SELECT 'in/' || a.n_nationkey AS from_file, 'in/' || b.n_nationkey AS to_file FROM nation a "
    "JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 WHERE a.n_regionkey = 1 AND b.n_regionkey = 1",
)
def oth3(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.when(F.col("n_regionkey") == 1, "in/").otherwise("out/"), "n_nationkey").alias("file_path"))
    links = n.alias("a").join(n.alias("b"), F.col("b.k") == F.col("a.k") + 1).select(F.col("a.file_path").alias("from_file"), F.col("b.file_path").alias("to_file"))
    return graph.subgraph(n, links, "IN")[1]


@query("oth9_explained_plan")
def oth9(spark, d):
    """What the context plan would hold; the plan itself is held against a heap in the tests."""
    costs = fixtures.nodes(spark, d).groupBy("file_path").agg((F.count(F.lit(1)) * 100).alias("cost"))
    return localize.explain(fixtures.edges(spark, d), fixtures.nodes(spark, d), spark.createDataFrame([("n3", 1.0)], "node string, score double"), costs, localize.Request(budget=4000))


@query("oth10_changed_api", f"WITH {IDS} SELECT 'C' || id AS fqn, 'accessibility-reduced' AS kind, true AS breaking FROM d WHERE id::BIGINT % 4 = 0")
def oth10(spark, d):
    """Base and current text of changed files from two sources of content, then their API delta."""
    plain = lambda word: made(spark, d, "x").select("id", "file_path", F.concat(word, F.lit(" class C"), "id", F.lit(" : B")).alias("text")).withColumn("text", F.concat("text", F.lit(" { }")))
    before = plain(F.lit("public"))
    after = plain(F.when(F.col("id").cast("long") % 4 == 0, "protected").otherwise("public"))
    return code.changed_file_delta(before, after)


@query("oth12_merged_request", "SELECT 7 AS most, 3 AS depth, 8000 AS budget")
def oth12(spark, d):
    r = localize.Request.merged({"most": 7}, {"most": 9, "depth": 3})
    return spark.createDataFrame([(r.most, r.depth, r.budget)], "most int, depth int, budget int")


@query(
    "str4_single_file_reindex",
    f"WITH {IDS} SELECT file_path, CASE WHEN id::BIGINT % 10 = 3 THEN 'N' || id ELSE 'C' || id END AS name FROM d "
    f"WHERE id::BIGINT % 10 <> 7",
)
def str4(spark, d):
    """An index of symbols in which a tenth of the files change and a tenth go."""
    t = made(spark, d, "class C{} : B ").withColumn("text", F.concat("text", F.lit("{ }")))
    extract_all = lambda rows: {"symbols": code.csharp_symbols(rows).select("file_path", "name")}
    index = saved(extract_all(t)["symbols"], "symbols")
    n = F.col("id").cast("long")
    changed = t.where((n % 10 == 3) | (n % 10 == 7)).select("file_path", F.when(n % 10 == 3, F.replace("text", F.lit("class C"), F.lit("class N"))).alias("text"))
    return changes.reindex({"symbols": (index, "file_path")}, changed, extract_all)["symbols"]


@query(
    "str5_cold_start",
    f"WITH {IDS} SELECT file_path, CASE WHEN id::BIGINT % 2 = 0 THEN 2 ELSE 1 END AS symbols, CASE WHEN id::BIGINT % 2 = 0 THEN 'semantic' ELSE 'syntax' END AS tier "
    f"FROM d",
)
def str5(spark, d):
    t = made(spark, d, "class C{} : B ").withColumn("text", F.concat("text", F.lit("{ int x; }")))
    count = lambda rows: rows.groupBy("file_path").agg(F.count(F.lit(1)).cast("int").alias("symbols"))
    quick = lambda rows: count(extract.csharp_types(rows))
    full = lambda rows: count(code.csharp_symbols(rows))
    return changes.cold_start(t, quick, full, t.where(F.col("id").cast("long") % 2 == 0).select("file_path"))


@query("ext8_chunk_tokens", f"WITH {IDS} SELECT file_path, ((length('class C' || id || ' {{ }}') + 3) // 4)::BIGINT AS tokens FROM d".replace("{{", "{").replace("}}", "}"))
def ext8(spark, d):
    return made(spark, d, "class C{}").select("file_path", token_estimate(F.concat("text", F.lit(" { }"))).alias("tokens"))


@query("red1_pipeline", f"WITH {IDS} SELECT id, CASE id::BIGINT % 3 WHEN 0 THEN 'int x;' WHEN 1 THEN '{{{{\"a\":' || id || ',\"b\":1}}}}' ELSE 'plain' || chr(10) || 'text [redacted:assigned-secret]' END AS content, CASE WHEN id::BIGINT % 3 = 2 THEN 1 ELSE 0 END AS secrets FROM d WHERE id::BIGINT % 5 <> 4".replace("{{", "{").replace("}}", "}"))
def red1_pipeline(spark, d):
    """C#, JSON and plain files through all steps; a fifth of them are trivial and go."""
    n = F.col("id").cast("long")
    text = F.when(n % 5 == 4, F.lit("  \n\n")).when(n % 3 == 0, F.lit("  int x; // gone\n\n")).when(n % 3 == 1, F.concat(F.lit("\1\"a\": "), "id", F.lit(",\n \"b\": 1 \2"))).otherwise(F.lit("plain  \n\n  text password = abcdefgh12345678"))
    path = F.concat(F.lit("f"), "id", F.when(n % 3 == 0, ".cs").when(n % 3 == 1, ".json").otherwise(".txt"))
    rows = made(spark, d, "x").select("id", path.alias("file_path"), F.replace(F.replace(text, F.lit("\1"), F.lit("{")), F.lit("\2"), F.lit("}")).alias("text"))
    done = code.reduction(rows)
    return done.join(rows.select("id", "file_path"), "file_path").select("id", "content", "secrets")


@query(
    "red13_route_map",
    "SELECT row_number() OVER (ORDER BY lower(l), l) AS line_no, l AS line "
    "FROM (SELECT rpad(CASE WHEN n_regionkey % 2 = 0 THEN 'GET' ELSE 'POST' END, 7, ' ') || rpad('/n' || n_nationkey, 40, ' ') || ' a.cs' AS l "
    "FROM nation)",
)
def red13(spark, d):
    n = table(spark, d, "nation")
    return code.route_map(n.select(F.when(F.col("n_regionkey") % 2 == 0, "GET").otherwise("POST").alias("verb"), F.concat(F.lit("/n"), "n_nationkey").alias("pattern"), F.lit("a.cs").alias("file_path")))


@query(
    "red13_project_graph",
    "SELECT row_number() OVER (ORDER BY lower(l), l) AS line_no, l AS line "
    "FROM (SELECT DISTINCT 'App' || n_nationkey || ' -> Lib' || n_regionkey AS l FROM nation)",
)
def red13b(spark, d):
    n = table(spark, d, "nation")
    return code.project_graph(n.select(F.concat(F.lit("a/App"), "n_nationkey", F.lit(".csproj")).alias("project"), F.concat(F.lit("../l/Lib"), "n_regionkey", F.lit(".csproj")).alias("reference")))


@query(
    "ses2_reconciled_session",
    "SELECT 'unchanged' AS kind, n_nationkey AS path FROM nation WHERE n_regionkey = 1 AND n_nationkey % 2 = 0 "
    "UNION ALL SELECT 'state', n_nationkey FROM nation WHERE n_regionkey IN (1, 2)",
)
def ses2(spark, d):
    n = table(spark, d, "nation").select(F.lit("s").alias("session"), F.col("n_nationkey").alias("path"), "n_regionkey")
    state = n.where("n_regionkey IN (1, 2)").select("session", "path", F.lit("h").alias("hash"))
    seen = n.where("n_regionkey = 1").select("session", "path", F.when(F.col("path") % 2 == 0, "h").otherwise("new").alias("hash"))
    unchanged, after = delta.reconcile_session(state, seen)
    return unchanged.select(F.lit("unchanged").alias("kind"), "path").unionByName(after.select(F.lit("state").alias("kind"), "path"))


@query(
    "snk6_other_entries",
    "SELECT doc_id, '## ' || source || chr(10) || chr(10) || '```' || chr(10) || lang || chr(10) || '```' AS markdown, '# ' || source || chr(10) || lang AS compact, '{\"path\":\"' || source || '\",\"content\":\"' || lang || '\"}' AS json "
    "FROM documents",
)
def snk6(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", *[emit.entry(F.col("source"), F.col("lang"), kind).alias(kind) for kind in ("markdown", "compact", "json")])


@query("snk8_key_values", "SELECT 'k' || n_nationkey AS key, CASE WHEN n_nationkey % 4 = 0 THEN 'new' ELSE n_name END AS value FROM nation WHERE n_regionkey = 2")
def snk8(spark, d):
    n = table(spark, d, "nation").withColumn("key", F.concat(F.lit("k"), "n_nationkey"))
    cache = KeyValueTable(spark)
    cache.set(n.select("key", F.col("n_name").cast("binary").alias("value")))
    cache.set(n.where("n_nationkey % 4 = 0").select("key", F.lit("new").cast("binary").alias("value")))
    return cache.get(n.where("n_regionkey = 2")).select("key", F.col("value").cast("string").alias("value"))


@query("src8_capture_bundle", "SELECT 'r' || n_regionkey AS \"to\", count(*) AS edges FROM nation GROUP BY 1")
def src8(spark, d):
    """A bundle written from the nations, read again."""
    path = new_path(spark, "bundle")
    n = table(spark, d, "nation")
    node = F.struct(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("nation").alias("kind"), F.col("n_name").alias("name"))
    edge = F.struct(F.concat(F.lit("n"), "n_nationkey").alias("from"), F.concat(F.lit("r"), "n_regionkey").alias("to"), F.lit("in").alias("type"))
    n.groupBy().agg(F.collect_list(node).alias("nodes"), F.collect_list(edge).alias("edges")).write.json(f"{path}/graph")  # the 25 nations
    spark.createDataFrame([(1, "net8")], "version int, target string").coalesce(1).write.json(f"{path}/manifest")
    return bundles.read_bundle(spark, path)[1].groupBy("to").agg(F.count(F.lit(1)).alias("edges"))


@query("oth11_merged_fragments", "SELECT n_regionkey AS entity, min(n_nationkey) AS first, count(*) AS targets FROM nation GROUP BY 1")
def oth11(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("entity"), F.col("n_nationkey").alias("target"))
    first, there = bundles.merge_fragments(rows, "entity", "target", [F.col("target")])
    return first.withColumnRenamed("target", "first").join(there.groupBy("entity").agg(F.count(F.lit(1)).alias("targets")), "entity")


@query("dif2_upgrade_delta", "SELECT 'N' || n_nationkey AS fqn, 'removed' AS kind, true AS breaking FROM nation WHERE n_regionkey = 3")
def dif2(spark, d):
    n = table(spark, d, "nation").select("n_regionkey", F.concat(F.lit("N"), "n_nationkey").alias("fqn"), F.lit("public").alias("access"), F.lit("s").alias("signature"))
    assert delta.upgrade_delta(n, None) is None
    return delta.upgrade_delta(n.drop("n_regionkey"), n.where("n_regionkey <> 3").drop("n_regionkey"))


@query("src1_nested_repositories", "SELECT 'a/f' || n_nationkey AS path FROM nation WHERE n_regionkey <> 1")
def src1b(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.when(F.col("n_regionkey") == 1, "a/sub/f").otherwise("a/f"), "n_nationkey").alias("path"))
    return files.outside_nested(n.unionByName(spark.createDataFrame([(".git/HEAD",), ("a/sub/.git/HEAD",)], "path string")))


@query(
    "par5_ignore_files",
    "SELECT 'a/out/f' || n_nationkey || '.cs' AS path FROM nation WHERE n_regionkey = 0 "
    "UNION ALL SELECT 'b/f' || n_nationkey || '.tmp' FROM nation WHERE n_regionkey = 1",
)
def par5b(spark, d):
    """Ignore files of the root and of one folder; the folder's does not reach others."""
    k = F.col("n_regionkey")
    path = F.concat(F.when(k == 0, "a/out/f").when(k == 1, "b/f").when(k == 2, "b/out/f").otherwise("c/f"), "n_nationkey", F.when(k == 1, ".tmp").otherwise(".cs"))
    ignores = spark.createDataFrame([("", "# temporary\n*.tmp\n"), ("a", "out/\n")], "folder string, text string")
    return files.ignored_by(table(spark, d, "nation").select(path.alias("path")), ignores)


#: A public vocabulary that comes with the machine; any other file of its kind will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query("pck15_exact_tokens")
def pck15(spark, d, vocabulary: str = VOCABULARY):
    """Tokens by a vocabulary; the tests hold it against the tokenizer itself."""
    return bpe.with_exact_tokens(table(spark, d, "documents").select("doc_id", "text"), vocabulary).select("doc_id", "tokens")
