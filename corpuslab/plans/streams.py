"""Streaming jobs over `events`, run to the end of what is there; each is compared with its batch twin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.plans.operations import BREAKER
from corpuslab.plans.registry import Registry
from corpuslab.sources.session import shared_folder
from corpuslab.streaming import jobs

R = Registry()


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As a pattern, since a file stream takes a single file's path for a folder.
    return jobs.read_events(spark, f"{sf_dir}/events.parque[t]")


def _to_table(stream: DataFrame) -> DataFrame:
    folder = shared_folder(stream.sparkSession)
    return jobs.run_to_table(stream, f"{folder}/rows", f"{folder}/state")


#: Windows still open at the end of the input are not emitted: those that end after the watermark, the latest
#: event less ten minutes.
MARK = "(select max(ts) - interval 10 minute from events)"


@R.add(f"""with w as (select time_bucket(interval 1 hour, ts) as start, event_type, user_id % 4 as model, count(*) as calls, round(sum(value), 6) as cost from events
 group by all having time_bucket(interval 1 hour, any_value(ts)) + interval 1 hour <= {MARK})
select *, cast(sum(calls) over k as bigint) as calls_so_far, round(sum(cost) over k, 6) as cost_so_far from w window k as (partition by event_type, model order by start rows unbounded preceding)""")
def stream_window_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By kind and model (the user's number), each window with the totals so far."""
    keys = ("event_type", "model")
    rows = _stream(spark, sf_dir).withColumn("model", F.col("user_id") % 4)
    totals = jobs.running_totals(_to_table(jobs.rollup(rows, keys=keys)), keys)
    return totals.withColumn("start", F.col("start").cast("timestamp_ntz"))


@R.add(f"""with w as (select time_bucket(interval 1 hour, ts) - interval 1 hour * i as start, event_type from events, (select unnest([0, 1]) as i))
select start, event_type, count(*) as n from w group by all having start + interval 2 hour <= {MARK}""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to_table(jobs.sliding(_stream(spark, sf_dir))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@R.add(f"""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as island from g)
select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n, round(sum(value), 6) as value from s group by user_id, island having max(ts) + interval 30 minute <= {MARK}""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _to_table(jobs.sessions(_stream(spark, sf_dir)))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@R.add("select event_id, user_id, event_type, value from events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event twice, each kept once."""
    rows = _stream(spark, sf_dir)
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return _to_table(jobs.first_of_each(twice, "event_id")).select("event_id", "user_id", "event_type", "value")


@R.add("""with w as (select user_id, event_id, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 6) as so_far, value from events)
select user_id, event_id, so_far from w where so_far >= 500 and round(so_far - value, 6) < 500""")
def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to_table(jobs.budget_crossings(_stream(spark, sf_dir), 500.0))


@R.add(f"with {BREAKER} select user_id, arg_min(event_id, (ts, event_id)) as event_id from t where tripped group by user_id")
def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to_table(jobs.breaker_trips(_stream(spark, sf_dir)))


#: Traces of the stream: a user's day, whose events are numbered by event_id. Purchases end a trace, ask or decide.
STREAM_TRACE = """ev as (select user_id * 100 + day(ts) as trace_id, event_id as seq, ts, props ->> '$.k' as k, props,
  case event_type when 'signup' then 'step_start' when 'view' then 'action' when 'click' then 'observation' when 'error' then 'thought'
  else case event_id % 4 when 0 then 'need_confirm' when 1 then 'confirm_result' when 2 then 'final' else 'stop' end end as type, 't' || (event_id % 2) as tool, event_id // 8 as confirm_id, event_id % 3 = 0 as approved from events)"""
END = "type in ('final', 'stop')"


def span_events(rows: DataFrame) -> DataFrame:
    kinds = {"signup": "step_start", "view": "action", "click": "observation", "error": "thought"}
    kind = F.element_at(F.array(*map(F.lit, ("need_confirm", "confirm_result", "final", "stop"))), (F.col("event_id") % 4 + 1).cast("int"))
    for name, to in kinds.items():
        kind = F.when(F.col("event_type") == name, to).otherwise(kind)
    none = F.lit(None).cast("string")
    return rows.select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("trace_id"), F.col("event_id").alias("seq"), "ts", kind.alias("type"), F.get_json_object("props", "$.k").cast("long").alias("step"),
        F.concat(F.lit("t"), (F.col("event_id") % 2).cast("string")).alias("tool"), F.lit(None).cast("array<string>").alias("tools"), F.floor(F.col("event_id") / 8).cast("string").alias("confirm_id"),
        (F.col("event_id") % 3 == 0).alias("approved"), F.when(F.col("event_id") % 5 == 0, F.col("props")).alias("result"), F.when(F.col("event_id") % 7 == 0, "failed").alias("error"), none.alias("reason"), F.col("props").alias("thought"),
    )


@R.add(f"""with {STREAM_TRACE}, o as (select *, last_value(case when type = 'step_start' or {END} then struct_pack(s := seq, t := type) end ignore nulls) over (partition by trace_id order by seq rows between unbounded preceding and 1 preceding) as mark,
  first_value(case when {END} then struct_pack(s := seq, e := ts) end ignore nulls) over (partition by trace_id order by seq rows between 1 following and unbounded following) as closing from ev),
p as (select *, case when mark.t = 'step_start' then 'step-' || mark.s else 'root' end as parent from o),
st as (select *, lead(seq) over w as end_seq, lead(ts) over w as e from p where type = 'step_start' or {END} window w as (partition by trace_id order by seq)),
th as (select trace_id, mark.s as seq, arg_max(left(props, 500), o.seq) as thought from o where type = 'thought' and mark.t = 'step_start' group by all),
a as (select *, row_number() over (partition by trace_id, tool order by seq) as n from p where type = 'action'), b as (select *, row_number() over (partition by trace_id, tool order by seq) as n from ev where type = 'observation'),
rows as (select trace_id, 'step-' || seq as span_id, 'root' as parent, 'step.' || k as name, 'step' as kind, ts as s, end_seq, e, null as error, thought as meta, null as closing from st left join th using (trace_id, seq) where type = 'step_start'
 union all select a.trace_id, 'tool-' || a.seq || '-0', a.parent, 'tool.' || a.tool, 'tool', a.ts, b.seq, b.ts, case when b.seq % 7 = 0 then 'failed' end, case when b.seq % 5 = 0 then b.props end, a.closing from a left join b using (trace_id, tool, n)
 union all select q.trace_id, 'confirm-' || q.seq, q.parent, 'confirm.' || q.tool, 'confirm', q.ts, r.seq, r.ts, null, cast(coalesce(r.approved, false) as varchar), q.closing from p q left join ev r on r.type = 'confirm_result' and r.trace_id = q.trace_id and r.confirm_id = q.confirm_id where q.type = 'need_confirm'),
out as (select *, closing is not null and (end_seq is null or end_seq > closing.s) as given_up from rows),
root as (select trace_id, min(ts) as s, arg_min(ts, seq) filter ({END}) as e, arg_min(type, seq) filter ({END}) as t from ev group by trace_id)
select trace_id, span_id, parent, name, kind, round(epoch(s), 3) as start, round(epoch(case when given_up then closing.e else e end), 3) as "end", case when given_up then 'abandoned' when error is not null then 'error' else 'ok' end as status,
 case when given_up then 'not closed when its parent ended' else error end as error, case when given_up and kind = 'tool' then null when given_up and kind = 'confirm' then 'false' else meta end as meta from out where given_up or end_seq is not null
union all select trace_id, 'root', null, 'trace', 'root', round(epoch(s), 3), round(epoch(e), 3), case t when 'final' then 'ok' else 'error' end, case t when 'stop' then 'no final answer: unknown' end, case t when 'final' then 'final_answer' else 'unknown' end from root where t is not null""")
def stream_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans that have closed: steps, tools, confirmations, roots, and those abandoned at the end of a trace."""
    found = _to_table(jobs.closed_spans(span_events(_stream(spark, sf_dir)), "400 days"))
    value = F.get(F.map_values("meta"), F.lit(0))
    return found.select("trace_id", "span_id", "parent", "name", "kind", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "status", "error", value.alias("meta"))
