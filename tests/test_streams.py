"""Stateful streams against their batch forms, micro-batch by micro-batch."""

import datetime
import random

import pytest
from loomdex.operators import delta
from loomdex.streaming import changes, stateful


ZERO = datetime.datetime(2024, 1, 1)
SCHEMA = "workspace long, ts timestamp, seq long, path string, kind string, old_path string"


def events(n, seed):
    """Events in time order, some of which come out of order by less than two seconds."""
    rng, at, out = random.Random(seed), 0.0, []
    for i in range(n):
        at += rng.choice([0.01, 0.1, 0.4, 0.5, 0.9, 4.0])
        kind = rng.choice(["Created", "Deleted", "Changed", "Renamed"])
        out.append((rng.randrange(3), ZERO + datetime.timedelta(seconds=at), i, f"p{rng.randrange(4)}", kind, f"p{rng.randrange(4)}" if kind == "Renamed" else None))
    return sorted(out, key=lambda r: r[1] + datetime.timedelta(seconds=rng.random() * 1.9))


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs a stream over rows, some at a time, and gives what it has written after each run."""

    def run(make, rows, schema, size, name="s"):
        out = str(tmp_path / name)
        for begin in range(0, len(rows), size):
            spark.createDataFrame(rows[begin : begin + size], schema).coalesce(1).write.mode("append").parquet(f"{out}/in")
            stream = make(spark.readStream.schema(schema).parquet(f"{out}/in"))
            stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
            yield spark.read.schema(stream.schema).parquet(f"{out}/rows")

    return run


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_renames_are_a_deletion_and_a_creation(spark):
    frame = spark.createDataFrame([(1, ZERO, 1, "new", "Renamed", "old"), (1, ZERO, 2, "x", "Changed", None)], SCHEMA)
    got = {(r["seq"], r["path"], r["kind"]) for r in changes.split_renames(frame).collect()}
    assert got == {(1, "old", "Deleted"), (1, "new", "Created"), (2, "x", "Changed")}


def test_stream_gives_the_batches_of_changes(spark, streamed):
    rows = events(160, 1)
    end = (9, ZERO + datetime.timedelta(days=1), 999, "end", "Changed", None)
    batch = rows_of(changes.batches_of_changes(changes.split_renames(spark.createDataFrame(rows, SCHEMA)).where("workspace < 9")))
    for size in (41, 200):
        held = None
        for held in streamed(lambda s: stateful.debounced_changes(changes.split_renames(s), late="2 seconds"), [*rows, end], SCHEMA, size, f"by{size}"):
            # what has been given so far is final
            assert set(rows_of(held)) <= set(batch)
        assert rows_of(held) == batch and len(batch) > 20


def test_a_batch_waits_for_silence_and_late_events_are_dropped(spark, streamed):
    at = lambda ms: ZERO + datetime.timedelta(milliseconds=ms)
    steps = [[(1, at(0), 1, "a", "Created", None)], [(1, at(400), 2, "a", "Changed", None)], [(2, at(5000), 3, "b", "Changed", None)], [(1, at(100), 4, "late", "Changed", None), (2, at(90000), 5, "c", "Deleted", None)]]
    seen = []
    for held in streamed(lambda s: stateful.debounced_changes(s.drop("old_path"), late="1 second"), [r for step in steps for r in step], SCHEMA, 1):
        seen.append({(r["path"], r["kind"], r["events"]) for r in held.collect()})
    assert seen[0] == seen[1] == set()  # still within the gap
    assert seen[2] == {("a", "Created", 2)}
    assert seen[-1] == {("a", "Created", 2), ("b", "Changed", 1)}


def test_session_deltas_are_those_of_the_batch_and_expire(spark, streamed):
    rng, rows = random.Random(2), []
    text = lambda: "\n".join(f"line {i} {rng.randrange(2)}" for i in range(rng.choice([3, 9, 40])))
    texts = [text() for _ in range(5)]
    for i in range(60):
        rows.append((rng.randrange(2), f"f{rng.randrange(3)}", ZERO + datetime.timedelta(seconds=i), i, rng.choice([None, *texts])))
    schema = "session long, path string, ts timestamp, seq long, text string"
    end = (9, "end", ZERO + datetime.timedelta(minutes=9), 99, "")
    batch = delta.session_delta(spark.createDataFrame(rows, schema), ["session", "path"], "seq", "text", retained=200)
    want = sorted((r["session"], r["path"], r["seq"], r["state"], r["diff"] or "") for r in batch.collect())
    held = None
    for held in streamed(lambda s: stateful.session_deltas(s, retained=200), [*rows, end], schema, 23):
        pass
    got = sorted((r["session"], r["path"], r["seq"], r["state"], r["diff"] or "") for r in held.collect())
    assert got == want and {w[3] for w in want} == {"new", "unchanged", "diff", "whole"} and any(w[4].startswith("@@") for w in want)
    # after a silence the same text is new again
    again = [(1, "f", ZERO, 1, "t"), (1, "f", ZERO + datetime.timedelta(seconds=30), 2, "t"), (1, "f", ZERO + datetime.timedelta(hours=2), 3, "t"), end[:2] + (ZERO + datetime.timedelta(hours=9),) + end[3:]]
    for held in streamed(lambda s: stateful.session_deltas(s, silence=datetime.timedelta(hours=1)), again, schema, 1, "again"):
        pass
    assert [r["state"] for r in held.where("session = 1").orderBy("seq").collect()] == ["new", "unchanged", "new"]


def test_deltas_yield_the_diff(spark):
    turns = spark.createDataFrame([(1, 1, "a\nb\nc"), (1, 2, "a\nB\nc"), (1, 3, "a\nB\nc"), (1, 4, "x" * 300), (1, 5, "y")], "session long, turn long, text string")
    got = {r["turn"]: (r["state"], r["diff"]) for r in delta.session_delta(turns, ["session"], "turn", "text", retained=100).collect()}
    assert got[2] == ("diff", "@@ -1,3 +1,3 @@\n a\n-b\n+B\n c") and got[3] == ("unchanged", None) and got[5] == ("whole", None)
