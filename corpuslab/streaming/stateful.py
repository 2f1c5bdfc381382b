"""Keyed state that ends: budgets, breakers and traces as stateful processors with timers.

A key's state is dropped once the watermark has passed its last event by a stated time, so what is kept grows with
the keys of that time, not with all there ever were. Events of a key are taken in order within a batch; how
many files make a batch bounds what a key's batch can hold. Events behind the watermark are dropped by Spark.
Traces, of which there are many of few events, go by buckets: a processor's call with those of its states takes
milliseconds, however few events it is for."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

#: The state store that processors with timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ABANDONED = "not closed when its parent ended"
TIMED_OUT = "no event for too long"


def milliseconds(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def run(events: DataFrame, key: str, processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    """The rows that ``processor`` gives for events with a time ``ts``, by key."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return events.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")


class Ending(StatefulProcessor):
    """A processor whose keys end ``idle`` after their last event. ``begin`` makes states, ``events`` handles a batch in
    order, ``ended`` gives the last rows of a key, and ``clear`` forgets it."""

    columns: list[str] = []
    order = ["ts", "event_id"]

    def __init__(self, idle: str):
        self.idle = milliseconds(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "latest long")
        self.begin(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(self.order)
        known = self.seen.get()
        latest = max(known[0] if known else 0, int(batch["ts"].max().timestamp() * 1000))
        for due in self.handle.listTimers():
            self.handle.deleteTimer(due)
        self.handle.registerTimer(max(latest + self.idle, timerValues.getCurrentWatermarkInMs() + 1))
        self.seen.update((latest,))
        yield pd.DataFrame(self.events(key[0], batch), columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = self.ended(key[0], self.seen.get()[0] / 1000)
        self.seen.clear()
        self.clear()
        yield pd.DataFrame(rows, columns=self.columns)

    def ended(self, key, latest: float) -> list[tuple]:
        return []

    def close(self) -> None:
        pass


class Budget(Ending):
    """The event at which a user's cost reaches the limit, once while the user is known."""

    columns = ["user_id", "event_id", "so_far"]

    def __init__(self, limit: float, idle: str):
        super().__init__(idle)
        self.limit = limit

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "so_far double, crossed boolean")

    def clear(self) -> None:
        self.spent.clear()

    def events(self, key, batch: pd.DataFrame) -> list[tuple]:
        so_far, crossed = self.spent.get() or (0.0, False)
        out = []
        for event_id, value in zip(batch["event_id"], batch["value"].fillna(0.0)):
            so_far = round(so_far + value, 6)
            if not crossed and so_far >= self.limit:
                crossed = True
                out.append((key, event_id, so_far))
        self.spent.update((float(so_far), bool(crossed)))
        return out


class Breaker(Ending):
    """The event at which a user's breaker trips, once while the user is known."""

    columns = ["user_id", "event_id"]

    def __init__(self, max_failures: int, max_steps: int, idle: str):
        super().__init__(idle)
        self.max_failures, self.max_steps = max_failures, max_steps

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "failures long, steps long, tripped boolean")

    def clear(self) -> None:
        self.counts.clear()

    def events(self, key, batch: pd.DataFrame) -> list[tuple]:
        failures, steps, tripped = self.counts.get() or (0, 0, False)
        out = []
        for event_id, kind in zip(batch["event_id"], batch["event_type"]):
            failures = 0 if kind == "purchase" else failures + (kind == "error")
            steps += kind == "signup"
            if not tripped and (failures >= self.max_failures or steps >= self.max_steps):
                tripped = True
                out.append((key, event_id))
        self.counts.update((int(failures), int(steps), bool(tripped)))
        return out


def text(value) -> str | None:
    return None if value is None or value is pd.NA or value != value else str(value)


#: What traces are made of, by name.
EVENT = ("trace_id", "seq", "ts", "type", "step", "tool", "tools", "confirm_id", "approved", "result", "error", "reason", "thought")
#: Buckets that traces are dealt into by hash. A checkpoint holds for one number.
BUCKETS = 4096


def bucketed(events: DataFrame) -> DataFrame:
    """Events of traces with the bucket of their trace. Events without a trace are a trace of their own, in bucket -1."""
    trace = F.col("trace_id").cast("long")
    bucket = F.when(trace.isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64(trace), F.lit(BUCKETS)))
    return events.select(bucket.alias("bucket"), F.coalesce(trace, F.lit(0)).alias("trace_id"), *EVENT[1:])


class Trace:
    """One trace: its start and whether it ended, its latest event in milliseconds, its open step, by tool the starts or ends
    that have no partner yet, and by confirm_id the confirmations that wait. ``out`` takes the spans that close."""

    def __init__(self, key: int | None, kept: bytes, out: list[tuple]):
        self.key, self.out = key, out
        self.latest, self.start, self.ended, self.step_now, tools, waiting = json.loads(kept) if kept else (0, None, False, None, {}, {})
        self.open_tools, self.waiting = {tool: deque(queue) for tool, queue in tools.items()}, waiting

    def kept(self) -> bytes:
        tools = {tool: list(queue) for tool, queue in self.open_tools.items() if queue}
        return json.dumps((self.latest, self.start, self.ended, self.step_now, tools, self.waiting)).encode()

    def event(self, seq, at: float, kind, step, tool, tools, confirm_id, approved, result, error, reason, thought) -> None:
        self.start = at if self.start is None else min(self.start, at)
        self.latest = max(self.latest, int(at * 1000))
        if kind in ("step_start", "final", "stop"):
            self.end_step(at, "ok")
        if kind == "step_start":
            self.step_now = (int(seq), None if text(step) is None else f"step.{int(step)}", at, None)
        elif kind == "thought" and self.step_now:
            self.step_now = (*self.step_now[:3], None if text(thought) is None else text(thought)[:500])
        elif kind == "action":
            self.tool_event(text(tool) or "?", (True, int(seq), 0, at, self.parent(), None, None, False))
        elif kind == "tool_start":
            for sub, name in enumerate(tools if tools is not None else ()):
                self.tool_event(text(name) or "?", (True, int(seq), sub, at, self.parent(), None, None, False))
        elif kind in ("observation", "tool_done"):
            self.tool_event(text(tool) or "?", (False, int(seq), 0, at, "", text(result), text(error), False))
        elif kind == "need_confirm":
            self.waiting[text(confirm_id) or ""] = (text(tool) or "?", int(seq), at, self.parent())
        elif kind == "confirm_result":
            self.decide(text(confirm_id) or "", at, bool(approved) if text(approved) else False)
        elif kind in ("final", "stop"):
            self.abandon(at, ABANDONED)
            if not self.ended:
                self.ended = True
                why = text(reason) or "unknown"
                error, reason = (f"no final answer: {why}", why) if kind == "stop" else (None, "final_answer")
                self.give("root", None, "trace", "root", self.start, at, "error" if error else "ok", error, {"stop_reason": reason})

    def give(self, span_id, parent, name, kind, start, end, status, error, meta) -> None:
        self.out.append((self.key, span_id, parent, name, kind, start, end, status, error, meta, round((end - start) * 1000, 3)))

    def parent(self) -> str:
        return f"step-{self.step_now[0]}" if self.step_now else "root"

    def end_step(self, at: float, status: str, error: str | None = None) -> None:
        if self.step_now:
            seq, name, start, thought = self.step_now
            self.give(f"step-{seq}", "root", name, "step", start, at, status, error, None if thought is None else {"thought": thought})
            self.step_now = None

    def tool_event(self, tool: str, one: tuple) -> None:
        """A start or an end meets the first of the other kind of its tool, or waits. Those that wait are of one kind."""
        queue = self.open_tools.setdefault(tool, deque())
        if not queue or queue[0][0] == one[0]:
            queue.append(one)
            return
        first = queue.popleft()
        begin, end = (one, first) if one[0] else (first, one)
        if not begin[7]:
            error = end[6] or None
            self.give(f"tool-{begin[1]}-{begin[2]}", begin[4], f"tool.{tool}", "tool", begin[3], end[3], "error" if error else "ok", error, None if end[5] is None else {"result": end[5]})

    def decide(self, confirm_id: str, at: float, approved: bool) -> None:
        if confirm_id in self.waiting:
            tool, seq, start, parent = self.waiting.pop(confirm_id)
            self.give(f"confirm-{seq}", parent, f"confirm.{tool}", "confirm", start, at, "ok", None, {"approved": str(approved).lower()})

    def abandon(self, at: float, why: str) -> None:
        """Tools and confirmations that are open are given out; a tool's start stays in its queue for a late end."""
        for tool, queue in self.open_tools.items():
            for i, (begins, seq, sub, start, parent, *_, given) in enumerate(queue):
                if begins and not given:
                    self.give(f"tool-{seq}-{sub}", parent, f"tool.{tool}", "tool", start, at, "abandoned", why, None)
                    queue[i] = (*queue[i][:7], True)
        for tool, seq, start, parent in self.waiting.values():
            self.give(f"confirm-{seq}", parent, f"confirm.{tool}", "confirm", start, at, "abandoned", why, {"approved": "false"})
        self.waiting = {}

    def give_up(self) -> None:
        latest = self.latest / 1000
        self.end_step(latest, "abandoned", TIMED_OUT)
        self.abandon(latest, TIMED_OUT)
        if not self.ended:
            self.give("root", None, "trace", "root", self.start, latest, "abandoned", TIMED_OUT, None)


class Runs:
    """By trace, a long, when it is due and what is kept of it (nothing: it is forgotten), in a list state of runs sorted by trace;
    the last run that has a trace holds. A change adds a run. All become one once the later ones have as many traces as the
    first, or are MOST in number: a batch reads what its bucket keeps, and writes little more than it changes."""

    SCHEMA = "traces binary, due binary, ends binary, texts binary"
    MOST = 32

    def __init__(self, state: ListState):
        self.state = state
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]] = []

    def read(self) -> None:
        self.runs = [(*(np.frombuffer(part, np.int64) for part in numbers), bytes(texts)) for *numbers, texts in self.state.get()]

    def get(self, traces: np.ndarray) -> list[bytes]:
        """What is kept of these traces."""
        out = [b""] * len(traces)
        for ids, _, ends, texts in self.runs:
            at = np.minimum(np.searchsorted(ids, traces), len(ids) - 1)
            for i in np.flatnonzero(ids[at] == traces).tolist():
                out[i] = texts[ends[at[i] - 1] if at[i] else 0 : ends[at[i]]]
        return out

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """The traces that are kept, in order, and when each is due."""
        sizes = [np.diff(ends, prepend=0) for _, _, ends, _ in self.runs]
        ids, due, size = (np.concatenate(parts or [np.zeros(0, np.int64)]) for parts in ([r[0] for r in self.runs], [r[1] for r in self.runs], sizes))
        last = len(ids) - 1 - np.unique(ids[::-1], return_index=True)[1]
        last = last[size[last] > 0]
        return ids[last], due[last]

    def write(self, traces: np.ndarray, due: np.ndarray, kept: list[bytes]) -> None:
        """Takes what is kept of these traces, given in order, after ``read``."""
        whole = self.runs and (sum(len(run[0]) for run in self.runs[1:]) + len(traces) >= len(self.runs[0][0]) or len(self.runs) >= self.MOST)
        self.runs.append(self.run(traces, due, kept))
        if not whole:
            self.state.appendValue(self.row(self.runs[-1]))
            return
        traces, due = self.all()
        self.runs = [self.run(traces, due, self.get(traces))] if len(traces) else []
        if self.runs:
            self.state.put([self.row(self.runs[0])])
        else:
            self.state.clear()

    def run(self, traces: np.ndarray, due: np.ndarray, kept: list[bytes]) -> tuple:
        return traces, due, np.cumsum([len(text) for text in kept], dtype=np.int64), b"".join(kept)

    def row(self, run: tuple) -> tuple:
        return (*(numbers.tobytes() for numbers in run[:3]), run[3])


class Traces(StatefulProcessor):
    """Spans of the traces of a bucket as they close: root, steps, tools and confirmations, as ``traces.spans`` has them.

    A trace that has been idle too long is forgotten, and what is open is given out as abandoned at its last event, an open
    trace too. A bucket has a timer at or before the time that its first trace is due."""

    columns = ["trace_id", "span_id", "parent", "name", "kind", "start", "end", "status", "error", "meta", "dur_ms"]

    def __init__(self, idle: str):
        self.idle = milliseconds(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = Runs(handle.getListState("traces", Runs.SCHEMA))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["trace_id", "seq"])
        if batch["ts"].isna().any():
            raise ValueError("an event of a trace has no time")
        ids, begin = np.unique(batch["trace_id"].to_numpy(np.int64), return_index=True)
        at = batch["ts"].to_numpy("datetime64[us]").astype(np.int64) / 1e6
        events = zip(batch["seq"].tolist(), at.tolist(), *(batch[name].tolist() for name in EVENT[3:]))
        self.kept.read()
        out, kept, due, soonest = [], [], [], timerValues.getCurrentWatermarkInMs() + 1
        for trace, known, count in zip(ids.tolist(), self.kept.get(ids), np.diff(begin, append=len(batch)).tolist()):
            one = Trace(self.name(key, trace), known, out)
            for _ in range(count):
                one.event(*next(events))
            kept.append(one.kept())
            due.append(max(one.latest + self.idle, soonest))
        self.kept.write(ids, np.array(due, np.int64), kept)
        timers = list(self.handle.listTimers())
        if not timers or min(due) < min(timers):
            self.handle.registerTimer(min(due))
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.kept.read()
        ids, due = self.kept.all()
        over, out = due <= timerValues.getCurrentWatermarkInMs(), []
        for trace, known in zip(ids[over].tolist(), self.kept.get(ids[over])):
            Trace(self.name(key, trace), known, out).give_up()
        if over.any():
            self.kept.write(ids[over], due[over], [b""] * int(over.sum()))
        if not over.all():
            self.handle.registerTimer(int(due[~over].min()))
        yield pd.DataFrame(out, columns=self.columns)

    def name(self, key, trace: int) -> int | None:
        return None if key[0] < 0 else trace

    def close(self) -> None:
        pass
