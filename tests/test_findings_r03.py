import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from loomdex.operators import emit, extract, graph, substrings
from loomdex.streaming import changes, stateful
from pyspark.sql import functions as F


def test_pairs_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS_A_TASK", 20)
    day = datetime.date(2024, 1, 1)
    rows = [(c, p, day + datetime.timedelta(c)) for c in range(9) for p in ["x", "y", "z", None, "x"][: 2 + c % 4]] + [(99, f"f{i}", day) for i in range(8)]
    pairs, paths, n = graph.pairs_and_paths(spark.createDataFrame(rows, "commit int, path string, date date"), 8)
    got = {(r["a"], r["b"]): (r["count"], r["last_seen"]) for r in pairs.collect()}
    assert got["x", "y"] == (9, day + datetime.timedelta(8)) and got["y", "z"] == (6, day + datetime.timedelta(7)) and len(got) == 3 + 28
    assert {r["path"]: r["c"] for r in paths.where("path < 'g' OR path > 'w'").collect()}["x"] == 9 and n.first()["n"] == 10
    # no sum of pairs stands before their shuffle
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "HashAggregate" not in plan[plan.index("Exchange") :]


def test_every_wiring_pattern_has_its_anchor(spark):
    text = "\n".join(["record H : IRequestHandler<Q>", " b.Publish( new N())", " s.Configure<O>(c.GetSection(\"sec\"))", " IOptionsMonitor<O> o", " AddHostedService<W>()", "class B : IPipelineBehavior<X, Y>", " DbSet<E> e", "class C : IEntityTypeConfiguration<E>", " MapGrpcService<G>()", " MapHub<S>()", " plain line"])
    files = spark.createDataFrame([("a.cs", text)], "file_path string, text string")
    got = {(r["type"], r["from"], r["to"]) for r in extract.wiring_edges(files).collect()}
    assert {t for t, _, _ in got} == {k for k, *_ in extract.WIRING} == set(extract.ANCHORS)
    assert ("sends_request", "H", "N") in got and ("options_binds", "config:sec", "O") in got and ("ef_entity", "B", "E") in got and ("mediatr_handles", "Q", "H") in got


def test_trigrams_of_texts_travel_as_lists(spark):
    texts = [(1, "Abcabc\n\U0001f600x"), (2, None), (3, "ab"), (4, "xbcA")]
    rows = spark.createDataFrame(texts, "id long, text string")
    index = substrings.build(rows, "text", ["id"], inline=False)
    got = sorted((r["gram"], x["id"]) for r in index.postings(spark).collect() for x in r["rows"])
    assert got == sorted({(t.lower()[i : i + 3], k) for k, t in texts if t for i in range(len(t) - 2)})
    assert {r["gram"]: r["n"] for r in index.counts(spark).collect()}["bca"] == 2


def test_events_of_a_workspace_are_dealt_out_by_their_paths(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    kinds = ["Created", "Changed", "Deleted"]
    # one workspace is never silent, so that its one span lasts over all micro-batches
    rows = [(1, at(i / 8), i, f"p{i % 50}", kinds[(i // 50 + i) % 3]) for i in range(400)] + [(2, at(i * 20), i, f"q{i % 3}", kinds[i % 3]) for i in range(12)]
    schema = "workspace long, ts timestamp, seq long, path string, kind string"
    frame = spark.createDataFrame(rows, schema)
    want = sorted(tuple(r) for r in changes.batches_of_changes(frame, "1 second").collect())
    out = str(tmp_path)
    for low, high in ((0, 20), (20, 35), (35, 999)):
        inside = frame.where((F.col("ts") >= F.lit(at(low))) & (F.col("ts") < F.lit(at(high))))
        (inside.unionByName(spark.createDataFrame([(9, at(9999), 0, "end", "Changed")], schema)) if high == 999 else inside).write.mode("append").parquet(f"{out}/in")
        stream = stateful.debounced_changes(spark.readStream.schema(schema).parquet(f"{out}/in"), datetime.timedelta(seconds=1))
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{out}/rows").collect()) == want and len({w[3] for w in want if w[0] == 1}) > 20
    # no state by workspace alone has paths or kinds
    state = spark.read.format("statestore").option("stateVarName", "spans").option("operatorId", "1").load(f"{out}/progress")
    assert [f.name for f in state.schema["key"].dataType] == ["workspace"]
    keys = spark.read.format("statestore").option("stateVarName", "events").option("operatorId", "0").load(f"{out}/progress").schema["key"].dataType
    assert [f.name for f in keys] == ["workspace", "bucket"]


def test_spans_merge_in_any_order():
    spans = np.array([(30, 31, 4), (0, 5, 1), (9, 9, 2), (14, 14, 1), (2, 3, 8), (40, 40, 1)], np.int64)
    assert stateful.merged(spans, 5).tolist() == [[0, 9, 11], [14, 14, 1], [30, 31, 4], [40, 40, 1]]


def test_parts_are_written_in_a_file_for_each_task(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i % 40}", i, f"f{i}\u2028", f"a\r\n{i}", 10 + i % 3) for i in range(800)], "plan string, seq long, path string, body string, cost long")
    parts = emit.write_parts(rows, 25, str(tmp_path / "lines"))
    held = spark.read.schema("plan string, part int, value string").json(str(tmp_path / "lines"))
    files = {}
    for r in held.withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect():
        files.setdefault((r["plan"], r["part"]), []).append((r["file"], r["value"]))
    entries = {(r["plan"], r["part"]): r["entries"] for r in parts.collect()}
    assert {k: len(v) for k, v in files.items()} == entries and len(entries) >= 400
    assert all(len({f for f, _ in v}) == 1 for v in files.values()) and len(list((tmp_path / "lines").glob("part-*"))) <= 4
    seqs = [[int(v.split("\r\n")[1].split("\n")[0]) for _, v in found] for found in files.values()]
    assert all(s == sorted(s) for s in seqs) and sorted(x for s in seqs for x in s) == list(range(800))
    emit.write_parts(rows.where("plan = 'p1'"), 250, str(tmp_path / "folders"), "json", folders=True)
    assert (tmp_path / "folders" / "plan=p1" / "part=1").is_dir()


class Held:
    """State of one key, and the calls for it."""

    def __init__(self):
        self.timers, self.calls, self.rows, self.map, self.value = [], 0, [], {}, None

    registerTimer = lambda self, at: self.timers.append(at)
    getListState = lambda self, *a: type("L", (), {"appendValue": lambda _, v: self.rows.append(v), "get": lambda _: iter(self.rows), "put": lambda _, v: self.rows.__setitem__(slice(None), v), "clear": lambda _: self.rows.clear()})()
    getMapState = lambda self, *a: type("M", (), {"getValue": lambda _, k: self.map.get(k), "updateValue": lambda _, k, v: self.map.update({k: v}), "iterator": lambda _: iter(list(self.map.items())), "removeKey": lambda _, k: self.map.pop(k), "exists": lambda _: bool(self.map)})()
    getValueState = lambda self, *a: type("V", (), {"exists": lambda _: self.value is not None, "get": lambda _: self.value, "update": lambda _, v: setattr(self, "value", v), "clear": lambda _: setattr(self, "value", None)})()


def test_sessions_of_a_bucket_share_timers_and_lists():
    schema = pa.schema([("session", pa.int64()), ("path", pa.string()), ("at", pa.int64()), ("seq", pa.int64()), ("text", pa.string())])
    held, delta = Held(), stateful.SessionDelta(200, 10_000_000, ["bigint", "string"], schema)
    delta.init(held)
    rows = [(i % 50, "f", i * 1000, i, "a" if i < 75 else "b") for i in range(100)]
    assert list(delta.handleInputRows((0,), iter([pd.DataFrame(rows, columns=schema.names)]), None)) == []
    assert held.timers == [1] and len(held.rows) == 1
    mark = lambda ms: type("T", (), {"getCurrentWatermarkInMs": lambda _: ms})()
    first = pd.concat(delta.handleExpiredTimer((0,), mark(60), None))
    assert len(first) == 60 and sorted(first["state"]) == ["new"] * 50 + ["unchanged"] * 10 and held.timers[1] == 61
    rest = pd.concat(delta.handleExpiredTimer((0,), mark(101), None))
    assert sorted(rest["state"]) == ["diff"] * 25 + ["unchanged"] * 15 and not held.rows and len(held.map) == 50
    assert list(delta.handleExpiredTimer((0,), mark(99_999), None)) == [] and not held.map and held.value is None
