"""Scans of inputs, idempotent actions, circuit breakers, routing, order look-ups."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import scans

MAX_TASK_CHARS = 2000
# Signs of an injected instruction, and words that route a task.
INJECTION = (r"忽略(以上|上面|之前)(的)?(所有)?指令", r"ignore\s+(all\s+)?previous\s+instructions", r"你现在是|你现在扮演|system\s*:", r"不要(告诉|通知)用户")
ROUTES = {
    "escalate": ("投诉", "退款", "赔", "法务", "人工", "转人工"),
    "act": ("创建", "建单", "提交", "发起", "发送", "通知", "修改", "取消"),
    "retrieve": ("怎么", "如何", "是什么", "多少", "区别", "文档", "参数", "限制", "计费", "是否支持", "查一下", "查询"),
}
MAX_FAILURES, MAX_STEPS = 3, 6
MOST_ROWS = 1000


def input_reason(task: Column) -> Column:
    """Why a task is not taken: empty, too long or an injection; null if it is."""
    bad = F.lit(False)
    for pattern in INJECTION:
        bad = bad | task.rlike(f"(?iU){pattern}")
    return F.when(task.isNull() | (F.trim(F.regexp_replace(task, r"(?U)\s", "")) == ""), "empty").when(F.length(task) > MAX_TASK_CHARS, "too long").when(bad, "injection")


def idempotent(actions: DataFrame, order: str = "ts", key: str = "request_id", result: str = "result") -> DataFrame:
    """Actions with whether they repeat an earlier one of their request, and the first one's result. Actions are
    numbered by slices (see ``scans``), so one request may have any number of them. Equal actions that come first
    together are told apart at random."""
    order = [order] if isinstance(order, str) else list(order)
    rows = scans.prefix(scans.sliced(actions, key, order), key, order, {"__n": ("sum", F.lit(1))})
    first = rows.where("__n = 1").select(F.col(key).alias("__key"), F.col(result).alias("__first"))
    rows = rows.join(first, F.col(key).eqNullSafe(F.col("__key")))
    return scans.bare(rows.withColumn("duplicate", F.col("__n") > 1).withColumn("result", F.col("__first")).drop("__n", "__key", "__first"))


def business_id(prefix: str, request_id: Column) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(F.md5(request_id.cast("binary")), 1, 8)))


def breaker(events: DataFrame, key: str = "session", order: Sequence[str] = ("ts",), max_failures: int = MAX_FAILURES, max_steps: int = MAX_STEPS) -> DataFrame:
    """Events (session, outcome: step, failure or success) with the counts so far and whether the breaker has tripped:
    at so many failures since the last success, or so many steps. Once tripped it stays so.

    A session is scanned by slices (see ``scans``), so it may have any number of events. Failures since the last success
    are all failures so far less the most that a success so far has come after; both are prefix scans."""
    is_a = lambda kind: F.when(F.col("outcome") == kind, 1).otherwise(0)
    rows = scans.prefix(scans.sliced(events, key, order), key, order, {"steps": ("sum", is_a("step")), "__all": ("sum", is_a("failure"))})
    rows = scans.prefix(rows, key, order, {"__past": ("max", F.when(F.col("outcome") == "success", F.col("__all")).otherwise(0))})
    rows = rows.withColumn("failures", F.col("__all") - F.col("__past")).drop("__all", "__past")
    now = (F.col("failures") >= max_failures) | (F.col("steps") >= max_steps)
    return scans.bare(scans.prefix(rows, key, order, {"tripped": ("max", now)}))


def route(task: Column, routes: Mapping[str, Sequence[str]] = ROUTES) -> Column:
    """The first route any of whose words a task holds, else `answer`."""
    text, out = F.lower(F.coalesce(task, F.lit(""))), F.lit("answer")
    for name, words in reversed(list(routes.items())):
        held = F.lit(False)
        for word in words:
            held = held | F.contains(text, F.lit(word))
        out = F.when(held, name).otherwise(out)
    return out


def refused(spark: SparkSession, sql: str) -> str | None:
    """Why a text is no single query that only reads, by Spark's own parser; null if it is one."""
    jvm = spark._jvm
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except (Py4JJavaError, ParseException):
        return "no single SQL statement"
    acts = [jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{n}") for n in ("Command", "ParsedStatement", "CompoundPlanStatement")]
    left = [plan]
    while left:
        node = left.pop()
        if any(kind.isInstance(node) for kind in acts):
            return f"{node.nodeName()} does more than read"
        left += [nodes.apply(i) for nodes in (node.children(), node.innerChildren()) for i in range(nodes.size()) if hasattr(nodes.apply(i), "innerChildren")]
    return None


def select_only(df: DataFrame, sql: str, view: str = "orders", limit: int = 100) -> DataFrame:
    """The result of one read-only query over ``df`` as ``view``, cut to ``limit`` rows, 1 to MOST_ROWS. Whatever would
    write, define or set anything is refused before it is run, also behind WITH. No view of the session is touched."""
    bare = sql.strip().rstrip(";").strip()
    if why := refused(df.sparkSession, bare):
        raise ValueError(f"only a single SELECT is allowed: {why}")
    own = f"__{view}_{uuid.uuid4().hex}"
    df.createTempView(own)
    try:
        return df.sparkSession.sql(f"with `{view}` as (select * from {own}) select * from ({bare})").limit(min(max(1, limit), MOST_ROWS))
    finally:
        df.sparkSession.catalog.dropTempView(own)


def lookup(orders: DataFrame, ids: DataFrame, key: str = "order_id") -> DataFrame:
    """A row for each requested id, with the order's columns, and whether there is one."""
    return ids.select(key).distinct().join(orders.withColumn("__there", F.lit(True)), key, "left").withColumn("found", F.col("__there").isNotNull()).drop("__there")
