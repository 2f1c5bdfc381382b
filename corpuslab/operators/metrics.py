"""Evaluation: hits, recall, percentiles by stated rank rules, judge results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts of a group's range of values that are ranked apart.
RANGES = 64


def ranked_values(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Distinct values of each group with how many rows have them (c), are below (before) and are in all (n):
    percentiles by any rank rule follow from it.

    Rows are counted by value first. A group's values are then parted at approximate quantiles, ranked within
    each part, and raised by the exact counts of the parts below, so no task orders a whole group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    cuts = F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 1000).alias("__cuts")
    cuts = counts.groupBy(*by).agg(cuts)
    joined = counts.join(cuts, list(by)) if by else counts.crossJoin(cuts)
    parted = joined.withColumn("__part", F.size(F.filter("__cuts", lambda x: x < F.col(value)))).drop("__cuts")
    sizes = parted.groupBy(*by, "__part").agg(F.sum("c").alias("__size"))
    lower = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "__part", F.coalesce(F.sum("__size").over(lower), F.lit(0)).alias("__below"), F.sum("__size").over(Window.partitionBy(*by)).alias("n"))
    within = Window.partitionBy(*by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = parted.withColumn("__own", F.coalesce(F.sum("c").over(within), F.lit(0))).join(sizes, [*by, "__part"])
    return ranked.select(*by, value, "c", (F.col("__below") + F.col("__own")).alias("before"), "n")


def at_rank(value: str, index: Column) -> Column:
    """The value at a 0-based rank, as an aggregate over ``ranked_values``."""
    return F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("c")), F.col(value)))


def nearest_rank(value: str, p: float) -> Column:
    """Percentile at the half-even rounding of p / 100 * (n - 1), as an aggregate over ``ranked_values``."""
    at = F.bround(F.lit(p) / 100 * (F.col("n") - 1)).cast("long")
    return at_rank(value, F.least(F.col("n") - 1, F.greatest(F.lit(0), at)))


def floor_rank(value: str, q: float) -> Column:
    """Percentile at floor(n * q), as an aggregate over ``ranked_values``."""
    return at_rank(value, F.least(F.col("n") - 1, F.floor(F.col("n") * q)))


def hit_report(golden: DataFrame, found: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Per mode and question type, and per mode in all (type null): n, hit1, hit3, hit5 and mrr of golden
    (qid, expect_chunk, type) in ranked lists with a mode. ``modes`` are named, so that one which finds
    nothing counts too and the lists are made once."""
    wanted = golden.select("qid", F.col("expect_chunk").alias("doc_id"), "type", F.explode(F.array(*map(F.lit, sorted(modes))).cast("array<string>")).alias("mode"))
    hits = found.groupBy("mode", "qid", "doc_id").agg(F.min("rank").alias("rank"))
    joined = wanted.join(hits, ["mode", "qid", "doc_id"], "left")
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit{k}")
    rows = joined.groupingSets([[F.col("mode"), F.col("type")], [F.col("mode")]], "mode", "type")
    return rows.agg(F.count("*").alias("n"), hit(1), hit(3), hit(5), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def compare(report: DataFrame, metric: str, modes: Sequence[str]) -> DataFrame:
    """A metric of two modes by type, side by side, and their difference in points."""
    first, second = modes
    sides = report.groupBy("type").pivot("mode", list(modes)).agg(F.first(metric))
    return sides.withColumn("points", F.round((F.col(first) - F.col(second)) * 100, 4))


def multi_hit(golden: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """multi_all (1.0 if all expect_chunks are among the first k) and recall of each question that has some."""
    got = found.where(F.col("rank") <= k).groupBy("qid").agg(F.collect_set("doc_id").alias("got"))
    rows = golden.where(F.size("expect_chunks") > 0).join(got, "qid", "left")
    missed = F.size(F.array_except("expect_chunks", F.coalesce("got", F.array().cast(rows.schema["expect_chunks"].dataType))))
    n = F.size(F.array_distinct("expect_chunks"))
    return rows.select("qid", F.when(missed == 0, 1.0).otherwise(0.0).alias("multi_all"), F.round((n - missed) / n, 6).alias("recall"))


def keyword_hits(golden: DataFrame, hits: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """hit@k and MRR by the first rank whose text holds any expected keyword: golden (qid, expect_any), hits
    (qid, rank, text)."""
    held = F.exists("expect_any", lambda kw: F.contains("text", kw))
    first = golden.join(hits, "qid", "left").groupBy("qid").agg(F.min(F.when(held, F.col("rank"))).alias("rank"))
    hit = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit{k}") for k in ks]
    return first.agg(F.count("*").alias("n"), *hit, F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def summary(rows: DataFrame) -> DataFrame:
    """Totals of evaluation rows: means without nulls, share abstained, latency percentiles, costs in parts."""
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    cost = lambda c: F.round(F.sum(c), 6).alias(c)
    totals = rows.agg(
        F.count("*").alias("n"),
        *(mean(c) for c in ("recall", "multi_all", "faithfulness", "answer_relevancy", "context_recall")),
        F.round(F.avg(F.col("abstained").cast("double")), 6).alias("abstain_rate"),
        F.round(F.avg("cost_cny"), 6).alias("cost_avg"),
        *(cost(c) for c in ("cost_retrieve_cny", "cost_ask_cny", "cost_judge_cny", "cost_cny")),
    )
    spread = ranked_values(rows, "latency_ms").agg(nearest_rank("latency_ms", 50).alias("p50"), nearest_rank("latency_ms", 95).alias("p95"), F.max("latency_ms").alias("max"))
    return totals.crossJoin(spread)


def subset(golden: DataFrame, types: Sequence[str] | None = None, first: int | None = None, position: str = "qid") -> DataFrame:
    """Questions of the stated types, the first so many in order of ``position``."""
    kept = golden.where(F.col("type").isin(*types)) if types else golden
    return kept.orderBy(position).limit(first) if first else kept


def abstain_report(rows: DataFrame) -> DataFrame:
    """Per kind and in all (kind null): cases (expect, got, at_gate), share correct, abstentions that cost nothing."""
    right = (F.col("expect") == F.col("got")).cast("double")
    return rows.rollup("kind").agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.count_if("at_gate").alias("free"))


def citation_report(rows: DataFrame) -> DataFrame:
    """Share of answered, cited rows with a citation of nothing, and their mean faithfulness floor."""
    cited = rows.where(~F.col("abstained") & (F.size("used") + F.size("unsupported") > 0))
    wrong = (F.size("unsupported") > 0).cast("double")
    return cited.agg(F.count("*").alias("n"), F.round(F.avg(wrong), 6).alias("wrong_rate"), F.round(F.avg("floor"), 6).alias("floor"))


def latency_report(rows: DataFrame) -> DataFrame:
    """Per target and concurrency of (target, concurrency, ok, latency_s, wall_s, error): requests, ok, failed,
    rps, least, p50, p95, p99, largest and mean latency, distinct errors in order."""
    by = ["target", "concurrency"]
    spread = ranked_values(rows, "latency_s", *by).groupBy(*by).agg(*(F.round(nearest_rank("latency_s", p), 3).alias(f"p{p}_s") for p in (50, 95, 99)))
    n = F.count("*")
    totals = rows.groupBy(*by).agg(
        n.alias("requests"),
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.round(F.when(F.max("wall_s") > 0, n / F.max("wall_s")).otherwise(0.0), 2).alias("rps"),
        F.round(F.min("latency_s"), 3).alias("min_s"),
        F.round(F.max("latency_s"), 3).alias("max_s"),
        F.round(F.avg("latency_s"), 3).alias("mean_s"),
        F.sort_array(F.collect_set(F.when(~F.col("ok"), F.col("error")))).alias("errors"),
    )
    return totals.join(spread, by, "left")


def batch_summary(rows: DataFrame) -> DataFrame:
    """Per batch of (batch_id, ok, latency_s, wall_s, cost_cny, degraded): counts, serial seconds, speed-up (0 without
    wall time), cost and degraded ones of those that succeeded."""
    serial, wall = F.round(F.sum("latency_s"), 3), F.max("wall_s")
    return rows.groupBy("batch_id").agg(
        F.count("*").alias("count"),
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        serial.alias("serial_s"),
        F.round(F.when(wall > 0, serial / wall).otherwise(0.0), 2).alias("speedup"),
        F.round(F.sum(F.when(F.col("ok"), F.coalesce("cost_cny", F.lit(0.0))).otherwise(0.0)), 6).alias("cost_cny"),
        F.count_if(F.col("ok") & F.col("degraded")).alias("degraded_count"),
    )


def calibration(top: DataFrame) -> DataFrame:
    """Per kind of (kind, value): n, lowest, highest and median by nearest rank."""
    values = ranked_values(top, "value", "kind")
    return values.groupBy("kind").agg(F.max("n").alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"), nearest_rank("value", 50).alias("p50"))


# Judge texts.

#: List marks at a line's start (fixed value).
MARK = r"^\s*(?:[-*•]|\d{1,2}[.、)]|[①-⓿])\s*"
SHORT_ANSWER = 20


def lines(text: Column) -> Column:
    """A judge's lines without list marks and blanks."""
    cut = F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\r?\n"), lambda s: F.trim(F.regexp_replace(s, MARK, "")))
    return F.filter(cut, lambda s: s != "")


def statements(answers: DataFrame) -> DataFrame:
    """(qid, pos, statement) of (qid, answer, split_text): an answer of at most 20 characters without its
    citations is one statement; an empty answer is one row without any."""
    bare = F.trim(F.regexp_replace(F.coalesce("answer", F.lit("")), r"\[\d{1,2}\]", ""))
    parts = F.when(bare == "", F.array().cast("array<string>")).when(F.length(bare) <= SHORT_ANSWER, F.array(bare)).otherwise(lines(F.col("split_text")))
    return answers.select("qid", F.posexplode_outer(parts).alias("pos", "statement"))


def _starts(text: Column, *heads: str) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | text.startswith(h)
    return out


def verdict(text: Column) -> Column:
    """A judge's yes or no, or null. Its words, tried in this order."""
    t = F.lower(F.trim(text))
    return (
        F.when(_starts(t, "yes", "true", "是", "对", "支持"), True)
        .when(_starts(t, "no", "false", "否", "错", "不支持"), False)
        .when(t.contains("否") | t.startswith("不") | t.contains("不能"), False)
        .when(t.contains("是") | t.contains("对") | t.contains("支持"), True)
    )


def relevancy(text: Column) -> Column:
    """1.0 for SAME, 0.5 for PARTIAL, 0.0 for DIFFERENT, or null: by the text's start, else by what it holds,
    the worst first."""
    t = F.upper(F.trim(text))
    scale = {"SAME": 1.0, "PARTIAL": 0.5, "DIFFERENT": 0.0}
    out = F.when(F.lit(False), F.lit(0.0))
    for word, value in scale.items():
        out = out.when(t.startswith(word), value)
    for word, value in sorted(scale.items(), key=lambda x: x[1]):
        out = out.when(t.contains(word), value)
    return out


def verdict_mean(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean of non-null verdicts, 0.0 without any, with the numbers of valid and failed ones."""
    v = F.col(value).cast("double")
    return rows.groupBy(by).agg(F.round(F.coalesce(F.avg(v), F.lit(0.0)), 4).alias("mean"), F.count(v).alias("valid"), F.count_if(v.isNull()).alias("failed"))


def judge_metrics(faith: DataFrame, relevance: DataFrame, context: DataFrame) -> DataFrame:
    """Faithfulness, answer relevancy (its first three questions) and context recall of each question, from
    judge texts: (qid, pos, judge) each. A question with no row in one of them has 0.0 there."""
    f = verdict_mean(faith.withColumn("v", verdict(F.col("judge"))), "qid", "v").select("qid", F.col("mean").alias("faithfulness"))
    r = verdict_mean(relevance.where("pos < 3").withColumn("v", relevancy(F.col("judge"))), "qid", "v").select("qid", F.col("mean").alias("answer_relevancy"))
    c = verdict_mean(context.withColumn("v", verdict(F.col("judge"))), "qid", "v").select("qid", F.col("mean").alias("context_recall"))
    return f.join(r, "qid", "full").join(c, "qid", "full").na.fill(0.0)
