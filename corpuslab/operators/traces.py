"""Agent events to spans, patches, summaries, trees and timelines.

Events are (trace_id, seq, ts as epoch seconds, type, step, tool, tools, confirm_id, approved, result, error, reason,
thought, answer). Spans are (trace_id, span_id, parent, name, kind, start, end, dur_ms, status, error, meta)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.sources.session import stored

ENDS = ("final", "stop")
THOUGHT_CHARS = 500
SPAN_FIELDS = ("parent", "name", "kind", "start", "end", "dur_ms", "status", "error")
ABANDONED = "not closed when its parent ended"



def steps(events: DataFrame) -> DataFrame:
    """Step spans: each from its step_start to the next step_start, final or stop, if there is one."""
    marks = events.where(F.col("type").isin("step_start", *ENDS))
    w = Window.partitionBy("trace_id").orderBy("seq")
    rows = marks.withColumns({"end_seq": F.lead("seq").over(w), "end": F.lead("ts").over(w)}).where("type = 'step_start'")
    return rows.select("trace_id", F.col("seq").alias("start_seq"), "end_seq", F.col("ts").alias("start"), "end", "step")


def tools(events: DataFrame) -> DataFrame:
    """Tool spans: the i-th start of a tool's name in a trace with its i-th end. Starts are `action` (one tool) and
    `tool_start` (several), ends `observation` and `tool_done`."""
    several = F.when(F.col("type") == "tool_start", F.col("tools")).otherwise(F.array("tool"))
    more = [c for c in ("open_step", "closing") if c in events.columns]
    starts = events.where(F.col("type").isin("action", "tool_start")).select("trace_id", "seq", "ts", *more, F.posexplode(several).alias("sub", "tool"))
    ends = events.where(F.col("type").isin("observation", "tool_done")).select("trace_id", "seq", "ts", "tool", "result", "error")
    nth = lambda *order: F.row_number().over(Window.partitionBy("trace_id", "tool").orderBy(*order))
    named = lambda d: d.withColumn("tool", F.coalesce("tool", F.lit("?")))
    starts = named(starts).withColumn("n", nth("seq", "sub")).select("trace_id", "tool", "n", F.col("seq").alias("start_seq"), "sub", F.col("ts").alias("start"), *more)
    ends = named(ends).withColumn("n", nth("seq")).select("trace_id", "tool", "n", F.col("seq").alias("end_seq"), F.col("ts").alias("end"), "result", "error")
    return starts.join(ends, ["trace_id", "tool", "n"], "left")


def confirms(events: DataFrame) -> DataFrame:
    """Confirmation spans by confirm_id; not decided is not approved, and both decisions are status ok."""
    more = [c for c in ("open_step", "closing") if c in events.columns]
    asked = events.where("type = 'need_confirm'").select("trace_id", "confirm_id", F.col("seq").alias("start_seq"), F.col("ts").alias("start"), "tool", *more)
    told = events.where("type = 'confirm_result'").select("trace_id", "confirm_id", F.col("seq").alias("end_seq"), F.col("ts").alias("end"), F.coalesce("approved", F.lit(False)).alias("approved"))
    return asked.join(told, ["trace_id", "confirm_id"], "left").withColumn("approved", F.coalesce("approved", F.lit(False)))


def roots(events: DataFrame) -> DataFrame:
    """Root spans. The first final or stop ends a trace and decides its status; none leaves it running."""
    first = F.min(F.when(F.col("type").isin(*ENDS), F.struct("seq", "ts", "type", "reason")))
    rows = events.groupBy("trace_id").agg(F.min("ts").alias("start"), first.alias("e"))
    stopped = F.col("e.type") == "stop"
    why = F.coalesce("e.reason", F.lit("unknown"))
    return rows.select(
        "trace_id", "start", F.col("e.seq").alias("end_seq"), F.col("e.ts").alias("end"),
        F.when(stopped, "error").when(F.col("e.type") == "final", "ok").otherwise("running").alias("status"),
        F.when(stopped, F.concat(F.lit("no final answer: "), why)).alias("error"),
        F.when(stopped, why).when(F.col("e.type") == "final", "final_answer").alias("stop_reason"),
    )


def placed(events: DataFrame) -> DataFrame:
    """Events with open_step, the place of the step open before them, and closing, the place and time of the first
    final or stop after them."""
    w = Window.partitionBy("trace_id").orderBy("seq")
    end = F.col("type").isin(*ENDS)
    mark = F.last(F.when((F.col("type") == "step_start") | end, F.struct("seq", "type")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    closing = F.first(F.when(end, F.struct("seq", "ts")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return events.withColumn("__mark", mark).withColumns({"open_step": F.when(F.col("__mark.type") == "step_start", F.col("__mark.seq")), "closing": closing}).drop("__mark")


def _map(key: str, value: str) -> Column:
    return F.when(F.col(value).isNotNull(), F.create_map(F.lit(key), F.col(value).cast("string")))


def spans(events: DataFrame) -> DataFrame:
    """All spans of the events: root, steps, tools and confirmations. A tool's or confirmation's parent is the step
    open at its start, else the root. One still open at the first final or stop after its start is
    abandoned there, whatever comes for it later. A span's id is its kind and the place of its event."""
    events = placed(events)
    none = F.lit(None).cast("string")

    def shape(rows: DataFrame, kind: str, name: Column, error: Column, meta: Column, *more: Column) -> DataFrame:
        ident = F.concat_ws("-", F.lit(kind), F.col("start_seq").cast("string"), *more)
        parent = F.when(F.col("open_step").isNotNull(), F.concat_ws("-", F.lit("step"), F.col("open_step").cast("string"))).otherwise("root") if kind != "step" else F.lit("root")
        return rows.select("trace_id", ident.alias("span_id"), parent.alias("parent"), F.concat(F.lit(f"{kind}."), name).alias("name"), F.lit(kind).alias("kind"), "start", "end_seq", "end", error.alias("error"), meta.alias("meta"), "closing")

    thoughts = events.where("type = 'thought'").groupBy("trace_id", F.col("open_step").alias("start_seq")).agg(F.max_by(F.left("thought", F.lit(THOUGHT_CHARS)), "seq").alias("thought"))
    step = steps(events).join(thoughts, ["trace_id", "start_seq"], "left").withColumn("closing", F.lit(None).cast(events.schema["closing"].dataType))
    rows = (
        shape(step, "step", F.col("step").cast("string"), none, _map("thought", "thought"))
        .unionByName(shape(tools(events), "tool", F.col("tool"), F.nullif("error", F.lit("")), _map("result", "result"), F.col("sub").cast("string")))
        .unionByName(shape(confirms(events), "confirm", F.coalesce("tool", F.lit("?")), none, _map("approved", "approved")))
    )
    left = F.col("closing").isNotNull() & (F.col("end_seq").isNull() | (F.col("end_seq") > F.col("closing.seq")))
    status = F.when(left, "abandoned").when(F.col("error").isNotNull(), "error").when(F.col("end_seq").isNull(), "running").otherwise("ok")
    meta = F.when(left & (F.col("kind") == "tool"), F.lit(None)).when(left & (F.col("kind") == "confirm"), F.create_map(F.lit("approved"), F.lit("false"))).otherwise(F.col("meta"))
    rows = rows.withColumns({"meta": meta, "status": status, "error": F.when(left, ABANDONED).otherwise(F.col("error")), "end": F.when(left, F.col("closing.ts")).otherwise(F.col("end"))})
    root = roots(events).select("trace_id", F.lit("root").alias("span_id"), none.alias("parent"), F.lit("trace").alias("name"), F.lit("root").alias("kind"), "start", "end", "status", "error", _map("stop_reason", "stop_reason").alias("meta"))
    out = rows.select(*root.columns).unionByName(root)
    return out.withColumn("dur_ms", F.round((F.col("end") - F.col("start")) * 1000, 3))


KNOWN = ("step_start", "thought", "action", "observation", "tool_start", "tool_done", "need_confirm", "confirm_result", *ENDS)


def extra_events(events: DataFrame) -> DataFrame:
    """Events of unknown types, which no span shows; none is dropped."""
    return events.where(~F.coalesce(F.col("type"), F.lit("")).isin(*KNOWN))


def merge_patches(records: DataFrame) -> DataFrame:
    """Span records (trace_id, span_id, pos, patch, fields..., meta) as one row a span: the last record that is no patch,
    or the first there is, overwritten by every later patch, nulls too; meta maps are joined, later keys winning.
    Repeated records of a span become one row."""
    by = ["trace_id", "span_id"]
    plain = ~F.coalesce("patch", F.lit(False))
    ranked = records.withColumn("__base", F.coalesce(F.max(F.when(plain, F.col("pos"))).over(Window.partitionBy(*by)), F.min("pos").over(Window.partitionBy(*by))))
    kept = ranked.where(F.col("pos") >= F.col("__base"))
    fields = [c for c in records.columns if c not in (*by, "pos", "patch", "meta")]
    rows = kept.groupBy(*by).agg(
        F.min("pos").alias("pos"),
        *(F.max_by(c, "pos").alias(c) for c in fields),
        F.sort_array(F.collect_list(F.struct("pos", F.map_entries(F.coalesce("meta", F.create_map().cast("map<string,string>"))).alias("m")))).alias("__m"),
    )
    entries = F.flatten(F.transform("__m", lambda x: x["m"]))
    last = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.map_from_entries(F.array(e))))
    return rows.withColumn("meta", last).drop("__m")


def summary(rows: DataFrame) -> DataFrame:
    """Per trace: duration from first start to last end and that of its root, spans, errors with and without the root,
    milliseconds measured for model calls and derived as steps less tools, and the root's status and stop reason."""
    of = lambda kind: F.round(F.sum(F.when(F.col("kind") == kind, F.coalesce("dur_ms", F.lit(0.0))).otherwise(0.0)), 3)
    root = F.col("kind") == "root"
    return rows.groupBy("trace_id").agg(
        F.round((F.max("end") - F.min("start")) * 1000, 3).alias("total_ms"),
        F.max(F.when(root, F.col("dur_ms"))).alias("root_ms"),
        F.count("*").alias("span_count"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if(F.col("error").isNotNull() & ~root).alias("child_errors"),
        of("llm").alias("llm_ms_measured"),
        F.round(F.greatest(of("step") - of("tool"), F.lit(0.0)), 3).alias("llm_ms_derived"),
        F.max(F.when(root, F.col("status"))).alias("status"),
        F.max(F.when(root, F.col("meta")["stop_reason"])).alias("stop_reason"),
    )


def by_kind(rows: DataFrame) -> DataFrame:
    """Per trace and kind, the root apart: spans, milliseconds, and percent of the trace's total (1 digit)."""
    total = summary(rows).select("trace_id", "total_ms")
    kinds = rows.where("kind <> 'root'").groupBy("trace_id", "kind").agg(F.count("*").alias("count"), F.round(F.sum(F.coalesce("dur_ms", F.lit(0.0))), 3).alias("ms"))
    return kinds.join(total, "trace_id").withColumn("pct", F.round(F.when(F.col("total_ms") > 0, F.col("ms") / F.col("total_ms") * 100).otherwise(0.0), 1)).drop("total_ms")


def tree(rows: DataFrame) -> DataFrame:
    """Spans with their depth and their place in depth-first order, children by start, then id, to any depth. Spans
    whose chain of parents reaches no root are left out. Each level is stored and joined to the next."""
    rows = stored(rows.select("trace_id", "span_id", "parent", "name", "start"))
    key = F.struct(F.col("start"), F.col("span_id"))
    level = rows.where("parent is null").select("trace_id", "span_id", "name", F.lit(0).alias("depth"), F.array(key).alias("path"))
    out, own = level, rows.where("parent is not null").select("trace_id", "parent", "span_id", "name", key.alias("key"))
    for d in count(1):
        above = level.select("trace_id", F.col("span_id").alias("parent"), "path")
        level = stored(own.join(above, ["trace_id", "parent"]).select("trace_id", "span_id", "name", F.lit(d).alias("depth"), F.concat("path", F.array("key")).alias("path")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("trace_id").orderBy("path"))).drop("path")


def timeline(rows: DataFrame) -> DataFrame:
    """Each span's offset from its trace's start and its width, in milliseconds."""
    start = F.min("start").over(Window.partitionBy("trace_id"))
    return rows.select("trace_id", "span_id", F.round((F.col("start") - start) * 1000, 3).alias("offset_ms"), F.coalesce("dur_ms", F.lit(0.0)).alias("width_ms"))


def newest(rows: DataFrame, keep: int) -> DataFrame:
    """The spans of the ``keep`` newest traces."""
    kept = rows.groupBy("trace_id").agg(F.max("start").alias("t")).orderBy(F.desc("t"), "trace_id").limit(keep)
    return rows.join(kept.select("trace_id"), "trace_id", "left_semi")


def integrity(rows: DataFrame) -> DataFrame:
    """Per kind: spans, and those without a duration."""
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("dur_ms").isNull()).alias("without_duration"))
