import pytest
from loomdex.functions import stemmer, text
from loomdex.operators import delta, extract, packing, reduce, search, store
from loomdex.sources import files, version_control
from loomdex.streaming import changes
from pyspark.sql import functions as F

STEMS = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "formaliti": "formal", "triplicate": "triplic", "hopefulness": "hope", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "is": "is", "x1": "x1", "ÉTÉ": "été"}


@pytest.mark.parametrize("word", STEMS)
def test_stems(word):
    assert stemmer.stem(word) == STEMS[word]


def test_match_terms_keep_phrases():
    assert text.match_terms("order_id OrderIds") == [["order", "id"], ["order"], ["id"], ["orderids"], ["ids"]]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def test_identifier_parts(spark):
    assert one(spark, "OrderService", text.identifier_parts) == ["order", "service"]


def test_comments_and_tokens(spark):
    assert one(spark, "a /* one <b>two</b>\n * three */ b // four\n// five\nc", text.comments) == "one two three four five"
    assert one(spark, "ab cdefg, h", lambda c: text.approximate_tokens(c, 4.0)) == 1 + 2 + 1 + 1


def test_buckets(spark):
    for title, bucket in (("Merge branch x", "no-signal"), ("", "no-signal"), ("Bump a from 1.0 to 2.0", "dependency-bump"), ("ci: x", "config-ci"), ("Fix typo", "formatting"), ("add route", "route-api"), ("more tests", "test-only"), ("fix OrderService", "identifier-rich"), ("make it good", "nl-domain")):
        assert one(spark, title, text.title_bucket) == bucket


def test_reducers(spark):
    assert one(spark, "a { color : red ; }\n/* x */ b{}", lambda c: reduce.reduce_text(c, "css")) == "a{color:red;}b{}"
    assert one(spark, "x = 1 // no\n\n\n  y( 2 )", lambda c: reduce.reduce_text(c, "javascript")) == "x = 1\ny(2)"
    assert one(spark, "Head\n====\ntext | b\n\n\n\n[l](u \"t\")", lambda c: reduce.reduce_text(c, "markdown")) == "# Head\ntext|b\n\n[l](u)"
    assert one(spark, "password = 'abcdefgh12345678'", reduce.redact) == "[redacted:assigned-secret]"


def test_change_log_and_diffs(spark):
    log = "\x012024-01-02\nb.cs\nreadme.md\n\n\x012024-01-01\n" + "\n".join(f"f{i}.cs" for i in range(41))
    got = version_control.change_log(spark.createDataFrame([(1, log)], "log int, text string")).collect()
    assert [(r["commit"], r["path"], str(r["date"])[:10]) for r in got] == [(1, "b.cs", "2024-01-02")]
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n-a\n+b\n+c\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n"
    got = version_control.unified_diffs(spark.createDataFrame([(1, diff)], "diff int, text string")).collect()
    assert [(r["path"], r["added"], r["removed"], r["hunks"]) for r in got] == [("x", 2, 1, 1), ("y", 0, 1, 1)]
    tests = '<UnitTestResult testName="a" outcome="Passed" /><UnitTestResult testName="b" outcome="Timeout" />'
    assert [r["outcome"] for r in version_control.test_results(spark.createDataFrame([(1, tests)], "report int, text string")).collect()] == ["passed", "not-run"]
    flow = "steps:\n  - run: make\n  - run: |\n      echo ${{ secrets.KEY }}\n      npm publish\n"
    got = version_control.workflow_commands(spark.createDataFrame([(1, flow)], "workflow int, text string")).collect()
    assert [(r["command"].split("\n")[0], r["needs_secret"], r["publishes"]) for r in got] == [("make", False, False), ("echo ${{ secrets.KEY }}", True, True)]


def test_scan_and_filters(spark, tmp_path):
    (tmp_path / "bin").mkdir()
    (tmp_path / "A.cs").write_text("class A {}")
    (tmp_path / "ATests.cs").write_text("x")
    (tmp_path / "bin" / "B.cs").write_text("y")
    kept, skipped = files.inventory(files.scan(spark, str(tmp_path)))
    path = files.relative(F.col("path"), str(tmp_path))
    named = kept.withColumn("rel", path).where(files.keep(path, extensions=[".cs"], excluded_dirs=["BIN"], text=F.col("text")))
    assert {(r["rel"], r["is_test"]) for r in named.collect()} == {("A.cs", False), ("ATests.cs", True)} and skipped.count() == 0
    assert files.ignore_globs("# c\nbin/\n\n*.log") == ["bin/", "*.log"]


def test_extraction(spark):
    code = 'public interface IA { }\npublic class A : Base, IA { }\nclass Base {}\nservices.AddScoped<IA, A>();\napp.MapGet("items/", x);'
    src = spark.createDataFrame([("a.cs", code)], "file_path string, text string")
    assert {(r["from"], r["to"], r["type"]) for r in extract.inheritance_edges(extract.csharp_types(src)).collect()} == {("A", "IA", "implements"), ("A", "Base", "inherits")}
    assert [(r["verb"], r["pattern"]) for r in extract.routes(src).collect()] == [("GET", "/items")]
    assert [(r["service"], r["implementation"], r["lifetime"]) for r in extract.registrations(src).collect()] == [("IA", "A", "scoped")]
    script = spark.createDataFrame([("a.ts", "export class X {}\nconst f = (a) => a\nlet z = 3")], "file_path string, text string")
    assert [(r["kind"], r["name"], r["is_public"]) for r in extract.script_symbols(script).collect()] == [("class", "X", True), ("function", "f", False)]
    resolves = spark.createDataFrame([("IA", "A", 1), ("IA", "B", 2)], "service string, implementation string, seq int")
    uses = spark.createDataFrame([("T", "IA")], "test string, used string")
    nodes = spark.createDataFrame([("A",), ("B",), ("IA",)], "node string")
    assert {r["to"] for r in extract.test_edges(uses, resolves, nodes).collect()} == {"A", "B", "IA"}
    assert [r["to"] for r in extract.injected_implementations(spark.createDataFrame([("C", "IA")], "consumer string, service string"), resolves).collect()] == ["B"]


def test_coalescing(spark):
    rows = [("a", 1, "Created"), ("a", 2, "Deleted"), ("b", 1, "Deleted"), ("b", 2, "Created"), ("c", 1, "Created"), ("c", 2, "Changed"), ("d", 1, "Changed"), ("d", 2, "Deleted")]
    got = changes.coalesce_changes(spark.createDataFrame(rows, "path string, ts int, kind string").withColumn("seq", F.col("ts")), ["path"])
    assert {(r["path"], r["kind"]) for r in got.collect()} == {("b", "Changed"), ("c", "Created"), ("d", "Deleted")}


def test_packers_skip_and_continue(spark):
    rows = [("p", "a", 0.9, 50, False), ("p", "b", 0.8, 70, False), ("p", "c", 0.7, 40, False), ("p", "m", 0.1, 10, True)]
    got = packing.pack_plan(spark.createDataFrame(rows, "plan string, path string, score double, cost long, must_keep boolean"), 100)
    assert {r["path"] for r in got.collect() if r["kept"]} == {"m", "a", "c"}


def test_diffs_and_fallbacks(spark):
    old = "\n".join(f"line {i}" for i in range(20))
    got = spark.createDataFrame([(old, old.replace("line 7", "x")), (old, old), ("a", "b")], "a string, b string").select(delta.unified_diff("a", "b").alias("d")).collect()
    assert got[0]["d"].splitlines()[0].startswith("@@") and "+x" in got[0]["d"] and got[1]["d"] is None and got[2]["d"] is None
    assert search.bm25(spark.createDataFrame([(1, "x")], "chunk_id int, body string"), "", {"body": 1.0}).count() == 0
    assert store.find_symbols(spark.createDataFrame([(1, "a%b", True)], "symbol_id int, name string, is_public boolean"), "%", 5).count() == 1


def test_headers(spark):
    head = "// Copyright somebody 2020\n"
    rows = [(1, head + "a"), (2, head + "b"), (3, "c")]
    got = {r["pos"]: r["header_id"] for r in delta.header_dedup(spark.createDataFrame(rows, "pos int, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: None}


def test_wiring(spark):
    code = """public class PayHandler : IRequestHandler<Pay, bool> {
  public PayHandler(IOptions<PayOptions> o) { }
  void F() { mediator.Send(new Ship(1)); }
}
public class Db { DbSet<Order> Orders; }
public class Start { void C() { s.Configure<PayOptions>(c.GetSection("Pay")); s.AddHostedService<Worker>(); } }
class Pay { } class PayOptions { }"""
    src = spark.createDataFrame([("a.cs", code)], "file_path string, text string")
    got = {(r["from"], r["to"], r["type"]) for r in extract.wiring_edges(src).collect()}
    assert got == {("Pay", "PayHandler", "mediatr_handles"), ("PayHandler", "PayOptions", "options_consumes"), ("PayHandler", "Ship", "sends_request"), ("Db", "Order", "ef_entity"), ("config:Pay", "PayOptions", "options_binds"), ("service:hosted", "Worker", "hosted_service")}
    uses = {(r["from"], r["to"]) for r in extract.reference_uses(src, extract.csharp_types(src)).collect()}
    assert ("PayHandler", "Pay") in uses and ("Pay", "Pay") not in uses


def test_focus(spark):
    from loomdex.operators import graph

    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("d", "a", "r")], "from string, to string, type string")
    seeds = spark.createDataFrame([("a", 1.0)], "node string, score double")
    assert {(r["node"], r["score"]) for r in graph.focus(edges, seeds, 2, "out").collect()} == {("a", 1.0), ("b", 0.5), ("c", 0.25)}
    assert {r["node"] for r in graph.focus(edges, seeds, 1).collect()} == {"a", "b", "d"}
