import itertools
import random
from collections import Counter
import subprocess

import pytest
from loomdex.functions import csharp
from loomdex.operators import code, delta, graph, history, localize, manifests, packing, postings, search, store, substrings
from loomdex.operators.shared import new_path, numbered
from loomdex.sources import templates, version_control
from loomdex.streaming import changes
from pyspark.sql import functions as F

PROGRAM = '''using System;
// a { comment
namespace Shop.Core;

[Serializable]
public sealed class Order<T> : Base, IOrder where T : class
{
    private readonly int _a = 1, _b;
    public const string S = "x { ; y";
    public Order(int a, int b = 2) : base(a) { _a = a; }
    public string Name { get; set; } = "n";
    public int Total => _a + _b;
    [HttpGet("x")]
    public async Task<List<int>> Get(int id, Func<int, int> f)
    {
        if (id > 0) { return new() { 1 }; }
        return null;
    }
    public Func<int> F = () => { return 1; };
    ~Order() { }
    private class Inner { void M() {} }
}
internal enum Color { Red = 1, [Old] Green, Blue }
public interface IOrder { int Count(); }
public record Point(int X, int Y);
'''


def test_declarations():
    got = [(s[0], s[3], s[4], s[7], s[8]) for s in csharp.symbols(PROGRAM)]
    assert got == [
        ("class", "Shop.Core.Order", "public", 5, 22), ("field", "Shop.Core.Order._a", "private", 8, 8), ("field", "Shop.Core.Order.S", "public", 9, 9), ("constructor", "Shop.Core.Order.Order", "public", 10, 10),
        ("property", "Shop.Core.Order.Name", "public", 11, 11), ("property", "Shop.Core.Order.Total", "public", 12, 12), ("method", "Shop.Core.Order.Get", "public", 13, 18), ("field", "Shop.Core.Order.F", "public", 19, 19),
        ("class", "Shop.Core.Order.Inner", "private", 21, 21), ("method", "Shop.Core.Order.Inner.M", "private", 21, 21), ("enum", "Shop.Core.Color", "internal", 23, 23), ("enum-member", "Shop.Core.Color.Red", "public", 23, 23),
        ("enum-member", "Shop.Core.Color.Green", "public", 23, 23), ("enum-member", "Shop.Core.Color.Blue", "public", 23, 23), ("interface", "Shop.Core.IOrder", "public", 24, 24), ("method", "Shop.Core.IOrder.Count", "public", 24, 24),
        ("record", "Shop.Core.Point", "public", 25, 25),
    ]
    assert csharp.symbols(PROGRAM)[0][6] == "public sealed class Order<T> : Base, IOrder"
    assert csharp.symbols("") == [] and csharp.symbols("}}}{;") == [] and csharp.symbols("class A {")[0][1] == "A"


def test_literals_keep_their_text():
    text = 'var a = "// no"; // yes\nvar b = @"c:\\"; /* gone */ var c = """raw " // no""";'
    assert csharp.reduce_code(text) == 'var a = "// no"; \nvar b = @"c:\\";  var c = """raw " // no""";'
    assert csharp.reduce_code("#region x\nint a;\n#endregion\n#if A\n#endif", csharp.Reduction(namespaces=False)) == "int a;\n\n#if A\n#endif"
    assert csharp.reduce_code('if ( this.x == 1 )\n{ f( "a  b" ) ; }', csharp.Reduction(aggressive=True)) == 'if(x==1){f("a  b");}'


def test_skeletons_and_slices():
    assert "return null" not in csharp.skeleton(PROGRAM) and "_a" not in csharp.skeleton(PROGRAM, True) and "int Count();" in csharp.skeleton(PROGRAM, True)
    thin = csharp.thin_skeleton(PROGRAM, {"Shop.Core.Order.Get"})
    assert "return null;" in thin and "public int Total;" in thin and "private class Inner { void M() {} }" in thin
    assert csharp.symbol_slice(PROGRAM, "Inner.M") is None and csharp.symbol_slice(PROGRAM, "Order.Inner.M").endswith("void M() {}\n}\n}")
    assert csharp.sketch("a.cs", "enum E { " + ", ".join(f"M{i}" for i in range(50)) + " }").endswith("M39, ... (10 more)\n")


def test_small_and_large_files_of_a_sketch(spark):
    rows = spark.createDataFrame([("a.cs", "class A { int x; }", 10), ("b.cs", "class A { int x; }", 7000), ("c.txt", "no types", 9000), ("d.cs", None, 1)], "file_path string, text string, tokens int")
    got = {r["file_path"]: r["content"] for r in code.sketched(rows).collect()}
    assert got["a.cs"] == "class A { int x; }" and got["b.cs"].endswith("class A: x\n") and got["c.txt"] == "no types" and got["d.cs"] == ""


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def applied(old, lines):
    out, at = [], 0
    for line in lines:
        if line.startswith("@@"):
            first, _, size = line.split()[1][1:].partition(",")
            start = int(first) - (size != "0")
            out += old[at:start]
            at = start
        elif line[0] == "+":
            out.append(line[1:])
        else:
            assert old[at] == line[1:]
            out += [line[1:]] if line[0] == " " else []
            at += 1
    return out + old[at:]


def test_diffs_are_longest_and_give_the_new_text_back():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([f"l{rng.randrange(6)}" for _ in range(rng.randrange(30))] for _ in "ab")
        kept = delta.common_lines(a, b)
        assert len(kept) == lcs(a, b) and all(a[i] == b[j] for i, j in kept)
        assert applied(a, delta.hunks(a, b, kept)) == b


def test_diff_query_gives_the_new_text_back(spark, sf_dir):
    from loomdex import plans

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r["diff"] for r in plans.queries()["ses3_unified_diffs"](spark, sf_dir).collect()}
    assert set(got) == {d for d, t in texts.items() if t is not None}
    for d, diff in got.items():
        old = texts[d].splitlines()
        new = texts[d].replace(" the ", " a ").splitlines()
        if diff is not None:
            assert applied(old, diff.split("\n")) == new
        else:
            assert old == new or max(len(old), len(new)) > 2000 or len(old) + len(new) - 2 * lcs(old, new) > 0.6 * (len(old) + len(new))


def test_packers_equal_plain_loops(spark):
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(4)}" if rng.random() < 0.9 else None, f"f{i:03}", rng.random(), rng.randrange(60), rng.random() < 0.1) for i in range(120)]
    frame = spark.createDataFrame(rows, "plan string, path string, score double, cost long, must_keep boolean").repartition(5)
    want = {}
    for plan in {r[0] for r in rows}:
        used = 0
        for r in sorted((r for r in rows if r[0] == plan), key=lambda r: (not r[4], -r[2], r[1])):
            want[r[1]] = r[4] or used + r[3] <= 100
            used += r[3] * want[r[1]]
    assert {r["path"]: r["kept"] for r in packing.pack_plan(frame, 100).collect()} == want
    parts, prefix = {}, {}
    for plan in {r[0] for r in rows}:
        used, part, total = 0, 1, 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == plan), key=lambda r: r[1])):
            part, used = (part + 1, r[3]) if used > 0 and used + r[3] > 70 else (part, used + r[3])
            total += r[3]
            parts[r[1]], prefix[r[1]] = part, n == 0 or total <= 70
    assert {r["seq"]: r["part"] for r in packing.emit_parts(frame.select("plan", F.col("path").alias("seq"), "cost"), 70).collect()} == parts
    assert {r["path"]: r["kept"] for r in packing.emit_prefix(frame, 70, ["path"]).collect()} == prefix
    assert packing.pack_plan(frame.limit(0), 100).count() == 0


def test_review_and_freshness_below_their_bounds(spark):
    few = spark.createDataFrame([(f"f{i}",) for i in range(150)], "file_path string")
    assert {r["state"] for r in packing.review_bound(few).collect()} == {"review"}
    many = spark.createDataFrame([(f"f{i}",) for i in range(250)], "file_path string")
    assert [r["state"] for r in packing.review_bound(many).collect()] == ["listed"] * 200
    old, new = (spark.createDataFrame(rows, "path string, hash string") for rows in ([("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("d", "1")]))
    assert {(r["path"], r["state"]) for r in delta.freshness(old, new, "path", "hash").collect()} == {("b", "changed"), ("c", "removed"), ("d", "changed")}
    assert {r["state"] for r in delta.freshness(old, new, "path", "hash", most=2).collect()} == {"stale"}


def test_nearest_names_equal_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abC") for _ in range(rng.randrange(1, 7)))
    names, asked = {word() for _ in range(200)}, {word() for _ in range(20)} | {""}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {(a, n, r) for a in asked for r, (_, n) in enumerate(sorted((distance(a.lower(), n.lower()), n) for n in names)[:5], 1)}
    frame = lambda values, column: spark.createDataFrame([(v,) for v in values], f"{column} string")
    got = delta.nearest_names(frame([*asked, None, *asked], "asked"), frame([*names, None, *names], "name")).collect()
    assert {(r["asked"], r["name"], r["rank"]) for r in got} == want
    far = delta.nearest_names(frame(["abC", "x" * 40], "asked"), frame(["ab", "a" * 9, "c" * 30], "name")).collect()
    assert [(r["asked"][0], r["name"][0], r["rank"]) for r in sorted(far, key=lambda r: (r["asked"], r["rank"]))] == [("a", "a", 1), ("a", "a", 2), ("a", "c", 3), ("x", "a", 1), ("x", "a", 2), ("x", "c", 3)]
    assert delta.nearest_names(frame(["a"], "asked"), frame(["b"], "name").limit(0)).count() == 0


def test_names_are_compared_within_equal_keys(spark, sf_dir, monkeypatch):
    """No pair of the two tables is made but by an equal key."""
    plans = []
    monkeypatch.setattr(delta, "saved", lambda df, *a, f=delta.saved: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df, *a))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name"))
    delta.nearest_names(part.select(F.concat("name", F.lit("er")).alias("asked")), part)
    assert len(plans) > 3 and not any("CartesianProduct" in p or "NestedLoop" in p for p in plans)


def test_trigrams_find_what_a_scan_finds(spark):
    names = [None, "", "ab", "GetUserById", "get_user", "übergröße", "100%sure", "back\\slash", "🙂🙂🙂x", "aaa", "AAAA", *[f"name{i}Of{i % 7}" for i in range(60)]]
    rows = spark.createDataFrame([(i, n, i % 2 == 0) for i, n in enumerate(names)], "symbol_id long, name string, is_public boolean")
    index = substrings.build(rows, "name", ["symbol_id", "name", "is_public"])
    for fragment in ("user", "t_u", "et%by", "ERG", "RÖSS", "0%s", "\\sl", "🙂🙂🙂", "aaa", "e1_of", "", "a", "%", "none of them", "name5of5"):
        scan = [r["symbol_id"] for r in store.find_symbols(rows, fragment, 40).collect()]
        assert [r["symbol_id"] for r in store.find_symbols(rows, fragment, 40, index).collect()] == scan, fragment
    plan = substrings.find(spark, index, "byid")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(gram" in plan and "Location: InMemoryFileIndex" in plan and "/rows" not in plan


def test_lines_by_trigrams(spark):
    texts = ["a Licence\nthe LICENSE\nlicense", None, "", "x\nli cense", "100% sure\n1000 sure", "LICEN\nSE"]
    rows = spark.createDataFrame(list(enumerate(texts)), "file_path long, text string")
    index = substrings.build(rows, "text", ["file_path"], inline=False)
    for needle in ("license", "100%", "%", "sure", "absent"):
        scan = [tuple(r) for r in search.lines_with(rows, needle).collect()]
        assert [tuple(r) for r in search.lines_with(rows, needle, index=index).collect()] == scan


def test_stored_index_scores_as_the_scan_does(spark):
    rows = [(1, "a a a a b of the of the"), (2, "Ä b of thé"), (3, None), (4, ""), (5, "b b a"), (6, "of of the")]
    chunks = spark.createDataFrame([(k, t, f"n{k}") for k, t in rows], "chunk_id long, body string, name string")
    phrases, weights = [["a", "a"], ["b"], ["of", "the"]], {"body": 1.0, "name": 5.0}
    index = postings.build(chunks, "chunk_id", list(weights))
    plain = lambda found: [(r["chunk_id"], round(r["score"], 9)) for r in found.collect()]
    assert plain(postings.search(spark, index, "", weights, None, phrases)) == plain(search.bm25(chunks, "", weights, None, phrases=phrases))
    assert postings.search(spark, index, "...", weights).count() == 0
    changed = chunks.where("chunk_id = 5").withColumn("body", F.lit("a a"))
    after = postings.replace(index, changed, chunks.where("chunk_id = 6").select("chunk_id"))
    now = chunks.where("chunk_id NOT IN (5, 6)").unionByName(changed)
    assert plain(postings.search(spark, after, "", weights, None, phrases)) == plain(search.bm25(now, "", weights, None, phrases=phrases))
    # the old version is still what it was
    assert plain(postings.search(spark, index, "", weights, None, phrases)) == plain(search.bm25(chunks, "", weights, None, phrases=phrases))


def test_stems_are_a_field_of_their_own(spark):
    chunks = spark.createDataFrame([(1, "cats and ponies"), (2, "a pony")], "chunk_id long, body string")
    index = postings.build(chunks, "chunk_id", ["body"], stems=True)
    assert {(r["chunk_id"], r["term"]) for r in index.postings(spark).where("field = 'stems'").collect()} == {(1, "cat"), (1, "and"), (1, "poni"), (2, "a"), (2, "poni")}
    assert [r["chunk_id"] for r in postings.search(spark, index, "", {"stems": 0.7}, None, [["poni"]]).orderBy("chunk_id").collect()] == [1, 2]


def test_log_of_segments_and_blocks(spark, monkeypatch):
    """Changes upon changes, reopened versions, compaction and top blocks, each against the scan of what is there."""
    monkeypatch.setattr(postings, "BLOCK", 4)
    rng, weights = random.Random(4), {"body": 1.0, "name": 5.0}
    text = lambda: " ".join(rng.choices(["a", "b", "c", "dd", "e f", "rare"], [30, 9, 5, 3, 2, 1], k=rng.choice([0, 2, 9, 60])))
    now = {i: (text(), rng.choice(["n a", "b", None])) for i in range(300)}
    frame = lambda rows: spark.createDataFrame([(k, *v) for k, v in rows.items()], "chunk_id long, body string, name string")
    index = first = postings.build(frame(now), "chunk_id", ["body", "name"])
    phrases = [["rare"], ["dd"], ["e", "f"]]

    def check(held):
        plain = lambda found: [(r["chunk_id"], round(r["score"], 9)) for r in found.collect()]
        for asked in (phrases, [["rare"]], [["a"], ["nothing"]]):
            want = plain(search.bm25(frame(now), "", weights, None, phrases=asked))
            assert plain(postings.search(spark, held, "", weights, None, asked)) == want
            assert plain(postings.search(spark, held, "", weights, 7, asked)) == want[:7]
        assert {r["chunk_id"]: r["dl"] for r in held.lengths(spark).collect()} == {k: len(f"{b or ''} {n or ''}".split()) for k, (b, n) in now.items()}

    check(index)
    _, read = postings.top(spark, index, [["rare"], ["dd"]], weights, 3)
    assert 0 < read["read"] < read["blocks"]
    before = dict(now)
    for gone, changed in (({3, 4, 5}, range(6, 12)), ({6, 7}, (4, 8, 400)), ({1}, ())):
        fresh = {k: (text(), "new") for k in changed}
        index = postings.replace(index, frame(fresh), spark.createDataFrame([(k,) for k in gone], "chunk_id long"))
        now = {k: v for k, v in now.items() if k not in gone} | fresh
        check(index)
    assert postings.opened(spark, index.path) == index and postings.opened(spark, index.path, 0) == first
    check(postings.compacted(spark, index))
    now = before
    check(first)


def test_a_small_change_writes_little(spark, sf_dir, tmp_path):
    import os

    size = lambda path: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body"))
    index = postings.build(docs, "chunk_id", ["body"])
    after = postings.replace(index, docs.where("chunk_id IN (5, 6)"))
    assert [s.number for s in after.segments] == [0, 1] and after.segments[1].chunks == 0
    local = index.path.removeprefix("file:")
    assert size(f"{local}/{after.segments[1].folder}") < size(f"{local}/{after.segments[0].folder}") / 10


def test_localize_adds_neighbours_and_drops_copies(spark):
    rows = [(1, "alpha beta", "one", "a.cs"), (2, "alpha", "two", "b.cs"), (3, "alpha beta beta", "one", "copy.cs"), (4, "gamma", "three", "c.cs"), *[(10 + i, "alpha" + " filler" * (20 + i), "none", f"y{i}.cs") for i in range(5)], *[(30 + i, "filler text", "none", f"z{i}.cs") for i in range(9)]]
    chunks = spark.createDataFrame(rows, "chunk_id long, body string, name string, file_path string")
    index = postings.build(chunks, "chunk_id", ["body", "name"])
    edges = spark.createDataFrame([("b", "c", "implements")], "from string, to string, type string")
    nodes = spark.createDataFrame([("a", "a.cs"), ("b", "b.cs"), ("c", "c.cs")], "node string, file_path string")
    hashes = spark.createDataFrame([("a.cs", "h"), ("copy.cs", "h"), ("b.cs", "i"), ("c.cs", "k")], "file_path string, content_hash string")
    request = localize.Request(query="alpha")
    found = lambda **more: [r["file_path"] for r in localize.localize(chunks, chunks.select("file_path"), request, index, **more).collect()]
    plain = found()
    assert set(plain) == {"a.cs", "b.cs", "copy.cs"}  # the leading cluster
    assert set(found(graph_of=(edges, nodes))) == {*plain, "c.cs"}
    assert len({"a.cs", "copy.cs"} & set(found(hashes=hashes))) == 1


def test_searches_read_their_terms_alone(spark):
    chunks = spark.createDataFrame([(i, f"word{i} common") for i in range(50)], "chunk_id long, body string")
    index = postings.build(chunks, "chunk_id", ["body"])
    plan = postings.search(spark, index, "word7", {"body": 1.0}, None)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters" in plan and "term" in plan.split("PushedFilters")[1][:400]


def test_numbers_without_gaps(spark):
    rows = [(i * 7919 % 1000,) for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "x int").repartition(7), [F.desc("x")], "n").collect()
    assert {(r["x"], r["n"]) for r in got} == {(x, 1000 - x) for x in range(1000)}


def test_a_store_of_another_version_is_refused(spark):
    path = new_path(spark, "store")
    store.save_store({"a": spark.range(3).toDF("x")}, path, 2)
    assert store.open_store(spark, path, 2)["a"].count() == 3
    with pytest.raises(ValueError, match="version"):
        store.open_store(spark, path, 3)


def test_templates_fall_back_to_the_generic_one():
    assert templates.template("PYTHON").extensions[0] == ".py" and templates.template("none") == templates.TEMPLATES["generic"]
    assert templates.template("mine", {"Mine": templates.Template((".x",), ())}).extensions == (".x",)


def test_sources_of_a_repository(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True, text=True).stdout.strip()
    assert version_control.tracked(spark, str(tmp_path / "none")) is None
    git("init", "-q")
    (tmp_path / "a.cs").write_text("one\n")
    (tmp_path / ".gitignore").write_text("*.tmp\n")
    git("add", "."), git("commit", "-qm", "first")
    base = git("rev-parse", "HEAD")
    (tmp_path / "a.cs").write_text("one\ntwo\n")
    (tmp_path / "b.cs").write_text("new\n")
    git("add", "."), git("commit", "-qm", "second")
    (tmp_path / "c.cs").write_text("untracked\n")
    (tmp_path / "d.tmp").write_text("ignored\n")
    root = str(tmp_path)
    assert [r["path"] for r in version_control.tracked(spark, root).collect()] == [".gitignore", "a.cs", "b.cs", "c.cs"]
    assert sorted((r["commit"], r["path"]) for r in version_control.change_log(version_control.log_of(spark, root)).collect()) == [(1, "a.cs"), (1, "b.cs"), (2, "a.cs")]
    assert sorted((r["path"], r["added"]) for r in version_control.unified_diffs(version_control.diff_of(spark, root, base, "HEAD")).collect()) == [("a.cs", 1), ("b.cs", 1)]
    assert sorted(r["path"] for r in version_control.changed_paths(spark, root, base, "HEAD").collect()) == ["a.cs", "b.cs"]
    assert {r["file_path"]: r["text"] for r in version_control.content_at(spark, root, base, ["a.cs", "b.cs"]).collect()} == {"a.cs": "one\n"}


def test_coalesced_changes_equal_a_fold(spark, sf_dir):
    from loomdex import plans

    def fold(kinds):
        state = None
        for k in kinds:
            state = k if state in (None, "Nothing") else "Nothing" if (state, k) == ("Created", "Deleted") else "Changed" if (state, k) == ("Deleted", "Created") else "Created" if (state, k) == ("Created", "Changed") else k
        return state

    rows = sorted((r["user_id"], r["ts"], r["event_id"]) for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect())
    want = {}
    for user, group in itertools.groupby(rows, key=lambda r: r[0]):
        kinds = [("Created", "Deleted", "Changed", "Changed")[e % 4] for _, _, e in group]
        if fold(kinds) != "Nothing":
            want[user] = (fold(kinds), len(kinds))
    assert {r["user_id"]: (r["kind"], r["events"]) for r in plans.queries()["str2_coalesced_changes"](spark, sf_dir).collect()} == want
    assert changes.NOTHING == "Nothing"


def test_prefixes_over_ranges_equal_a_running_sum(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", None]), f"p{i:04}", rng.randrange(9), rng.choice([None, 0.5, 1.5])) for i in range(700)]
    frame = spark.createDataFrame(rows, "plan string, path string, cost long, score double").repartition(7)
    want, n, total = {}, Counter(), Counter()
    for plan, path, cost, _ in sorted(rows, key=lambda r: r[1]):
        n[plan] += 1
        total[plan] += cost
        want[path] = (n[plan], total[plan])
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    got = packing.prefixed(frame, [F.col("path")], "cost")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r["path"]: (r["n"], r["total"]) for r in got.collect()} == want
    plan = packing.emit_prefix(frame, 70, ["path"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_trees_tell_what_differs_from_where_it_does(spark, monkeypatch):
    monkeypatch.setattr(manifests, "LEAF_ROWS", 4)
    monkeypatch.setattr(manifests, "STEP", 3)
    rng = random.Random(9)
    old = {f"f{i}": rng.choice([None, "a", "b"]) for i in range(900)}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "path string, digest string")
    first = manifests.build(frame(old), "path", "digest")
    assert first.levels == 3
    plain = lambda found: sorted([tuple(r) for r in found.collect()], key=str)
    for new in (dict(old), {k: v for k, v in old.items() if k not in ("f3", "f5")} | {"f7": "x", "f8": None, "new": "a"}, {"other": "a"}, {k: v for k, v in old.items() if int(k[1:]) % 2}):
        second = manifests.build(frame(new), "path", "digest")
        want = plain(store.manifest_difference(frame(old), frame(new), "path", "digest"))
        assert plain(manifests.difference(spark, first, second)) == want
        assert plain(manifests.freshness(spark, first, second, 5)) == plain(delta.freshness(frame(old), frame(new), "path", "digest", 5))
    same, level, compared = manifests.differing(spark, first, manifests.build(frame(old), "path", "digest"))
    assert same is None and level == 0 and compared == 1
    one = manifests.build(frame(old | {"f9": "changed"}), "path", "digest")
    found, level, compared = manifests.differing(spark, first, one)
    assert found.count() == 1 and level == 3 and compared <= 1 + 3 * 8
    plan = manifests.within(spark, one, found, level)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "EqualTo(leaf" in plan


def test_a_history_adds_up(spark):
    rng = random.Random(5)
    rows = [(c, f"p{rng.randrange(6)}", rng.randrange(100)) for c in range(40) for _ in range(rng.randrange(1, 4))] + [(99, f"q{i}", 5) for i in range(50)]
    frame = lambda part: spark.createDataFrame(part, "commit long, path string, date long")
    held = history.started(frame(rows))
    for i in range(3):
        held = history.added(held, frame([r for r in rows if r[0] % 3 == i]))
    plain = lambda found: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in found.collect())
    for state in (held, history.merged(spark, held), history.replaced(held, frame(rows))):
        assert plain(history.cochanges(spark, state)) == plain(graph.cochanges(frame(rows)))
        assert state.days(spark).groupBy("path").agg(F.sum("changes").alias("n")).where("path = 'p1'").first()["n"] == sum(r[1] == "p1" for r in rows)
    assert len(held.segments) == 3 and not plain(history.cochanges(spark, history.replaced(held, frame([(1, "a", 1)]))))
