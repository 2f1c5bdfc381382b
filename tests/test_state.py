"""Keyed state that ends, against the batch jobs; late events, expired keys, batches of any size."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import traces
from corpuslab.streaming import jobs, stateful

START = datetime.datetime(2024, 1, 1)
AGENT = "trace_id long, seq long, ts timestamp, type string, step long, tool string, tools array<string>, confirm_id string, approved boolean, result string, error string, reason string, thought string"
KINDS = ("step_start", "thought", "action", "observation", "tool_start", "tool_done", "need_confirm", "confirm_result", "final", "stop", "unknown")


def files(spark, folder, schema, batches):
    """One file a batch, in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def agent_events(traces_n=12, length=40):
    rng, rows = random.Random(5), []
    for t in range(traces_n):
        asked = []
        for i in range(length):
            kind = "final" if i == length - 1 else rng.choice(KINDS)
            confirm = None
            if kind == "need_confirm":
                confirm = f"c{t}-{i}"
                asked.append(confirm)
            elif kind == "confirm_result":
                if not asked:
                    kind = "thought"
                else:
                    confirm = asked.pop(0)
            rows.append((t, i, START + datetime.timedelta(seconds=37 * i + t, milliseconds=i), kind, i if i % 5 else None, rng.choice(["a", "b", None]), ["a", "b", "a"], confirm, rng.choice([True, False, None]), rng.choice(["r", None]), rng.choice(["", "bad", None]), rng.choice(["limit", None]), "t" * rng.choice([0, 3, 600])))
    return sorted(rows, key=lambda r: (r[2], r[0]))


@pytest.mark.parametrize("batch", [7, 1000])
def test_streamed_spans_are_the_batch_spans(spark, tmp_path, batch):
    rows = agent_events()
    stream = files(spark, str(tmp_path / "in"), AGENT, [rows[i : i + batch * 20] for i in range(0, len(rows), batch * 20)])
    got = jobs.run_to_table(jobs.closed_spans(stream, "400 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    events = spark.createDataFrame(rows, AGENT).withColumn("ts", F.unix_micros("ts") / 1e6)
    want = traces.spans(events)
    shown = lambda df: sorted(repr([round(v, 3) if isinstance(v, float) else v for v in r]) for r in df.select(want.columns).collect())
    assert got.columns == want.columns
    found = shown(got)
    assert found == shown(want.where("status <> 'running'"))
    assert {r["kind"] for r in got.select("kind").distinct().collect()} == {"root", "step", "tool", "confirm"} and got.where("status = 'abandoned'").count() > 3


def test_idle_traces_are_given_up_and_forgotten(spark, tmp_path):
    at = lambda minutes: START + datetime.timedelta(minutes=minutes)
    row = lambda t, i, m, kind, tool="a", confirm=None: (t, i, at(m), kind, i, tool, None, confirm, None, None, None, None, "x")
    batches = [[row(1, 0, 0, "step_start"), row(1, 1, 1, "action"), row(1, 2, 2, "need_confirm", "b", "c")], [row(2, 0, 100, "step_start")], [row(2, 1, 101, "final")], [row(1, 3, 1, "final")], [row(3, 0, 300, "step_start")], [row(3, 1, 301, "thought")]]
    stream = files(spark, str(tmp_path / "in"), AGENT, batches)
    got = jobs.run_to_table(jobs.closed_spans(stream, "30 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    rows = {(r["trace_id"], r["span_id"]): (r["status"], r["end"] - START.replace(tzinfo=datetime.timezone.utc).timestamp()) for r in got.collect()}
    assert {k: v for k, v in rows.items() if k[0] == 1} == {(1, "step-0"): ("abandoned", 120.0), (1, "tool-1-0"): ("abandoned", 120.0), (1, "confirm-2"): ("abandoned", 120.0), (1, "root"): ("abandoned", 120.0)}  # the late final is dropped
    assert rows[2, "root"][0] == "ok" and rows[2, "step-0"][0] == "ok" and not any(k[0] == 3 for k in rows)


EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_users_are_forgotten(spark, tmp_path):
    rows = lambda day, ids, kind: [(i, START + datetime.timedelta(days=day, minutes=i), 1, kind, 3.0, "{}") for i in ids]
    batches = [rows(0, (1, 2), "error"), [(90, START + datetime.timedelta(days=30), 2, "click", 0.0, "{}")], [(91, START + datetime.timedelta(days=30, minutes=20), 2, "click", 0.0, "{}")], rows(40, (3, 4, 5), "error")]
    stream = lambda n: files(spark, str(tmp_path / n), EVENT, batches)
    run = lambda job, n: [tuple(r) for r in jobs.run_to_table(job, str(tmp_path / f"{n}-out"), str(tmp_path / f"{n}-state")).collect()]
    assert run(jobs.budget_crossings(stream("a"), 9.0, idle="7 days"), "a") == [(1, 5, 9.0)]  # anew after a week
    assert run(jobs.budget_crossings(stream("b"), 9.0, idle="90 days"), "b") == [(1, 3, 9.0)]
    assert run(jobs.breaker_trips(stream("c"), idle="7 days"), "c") == [(1, 5)]
    assert run(jobs.breaker_trips(stream("d"), idle="90 days"), "d") == [(1, 3)]


def test_traces_are_kept_by_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 2, raising=False)
    rows = agent_events(traces_n=40, length=12)
    lost = [(None, *r[1:]) for r in rows if r[0] == 3]
    rows = sorted(rows + lost, key=lambda r: (r[2], r[0] is None))
    third = len(rows) // 3
    stream = files(spark, str(tmp_path / "in"), AGENT, [rows[:third], rows[third : 2 * third], rows[2 * third :]])
    query = jobs.closed_spans(stream, "400 days").writeStream.format("memory").queryName("by_bucket").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 3  # what is kept and a timer twice, for two buckets and that of events without a trace
    got, want = spark.table("by_bucket"), traces.spans(spark.createDataFrame(rows, AGENT).where("trace_id is not null").withColumn("ts", F.unix_micros("ts") / 1e6))
    shown = lambda df: sorted(repr([round(v, 3) if isinstance(v, float) else v for v in r]) for r in df.select(want.columns).collect())
    assert shown(got.where("trace_id is not null")) == shown(want.where("status <> 'running'"))
    assert shown(got.where("trace_id is null").withColumn("trace_id", F.lit(3))) == shown(got.where("trace_id = 3")) != []


def test_idle_traces_of_one_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 1, raising=False)
    test_idle_traces_are_given_up_and_forgotten(spark, tmp_path)


class Listed:
    def __init__(self):
        self.rows, self.puts = [], 0

    def get(self):
        return iter(list(self.rows))

    def appendValue(self, row):  # noqa: N802
        self.rows.append(row)

    def put(self, rows):
        self.rows, self.puts = list(rows), self.puts + 1

    def clear(self):
        self.rows = []


def test_runs_keep_the_last_of_each_trace():
    rng, state, model = random.Random(3), Listed(), {}
    for i in range(200):
        runs = stateful.Runs(state)
        runs.read()
        ids, due = runs.all()
        assert dict(zip(ids.tolist(), due.tolist())) == {k: v[0] for k, v in model.items()}
        some = np.array(sorted(rng.sample(range(-50, 1000), 1 if i == 5 else 30)), np.int64)
        assert runs.get(some) == [model.get(t, (0, b""))[1] for t in some.tolist()]
        kept = [b"" if rng.random() < 0.3 else f"{t}:{i}".encode() * rng.choice([1, 5]) for t in some.tolist()]
        runs.write(some, some + i, kept)
        model.update({t: (t + i, k) for t, k in zip(some.tolist(), kept)})
        model = {t: v for t, v in model.items() if v[1]}
        assert len(state.rows) <= stateful.Runs.MOST
    assert state.puts < 40
    left = np.array(sorted(model), np.int64)
    for _ in range(stateful.Runs.MOST):
        runs = stateful.Runs(state)
        runs.read()
        runs.write(left, left, [b""] * len(left))
    assert state.rows == []
