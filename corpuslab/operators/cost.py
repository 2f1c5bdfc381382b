"""Cost ledgers, caches, prices and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.operators import scans

# Prices per million tokens, rate of exchange, least cached prefix.
PRICES = (
    ("deepseek-flash", "deepseek", "USD", 2.0, 0.15, 0.003, 0.60, False),
    ("deepseek-v4-pro", "deepseek", "USD", 2.0, 0.66, 0.022, 1.98, False),
    ("glm-4.7-flash", "zhipu", "CNY", 1.0, 0.0, 0.0, 0.0, True),
    ("qwen-plus", "dashscope", "CNY", 1.0, 0.80, None, 2.00, False),
)
PRICE_SCHEMA = "model string, provider string, currency string, peak_multiplier double, in_miss double, in_hit double, out double, free boolean"
#: Models whose calls are priced; calls of others count as 0 (fixed values).
CALL_PRICED = ("deepseek-flash", "deepseek-v4-pro")
USD_CNY = 7.10
MIN_PREFIX = 64


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, PRICE_SCHEMA)


def is_peak(ts: Column) -> Column:
    """Monday to Friday, hours 1 to 4 and 6 to 10 of the session's time zone, which is to be UTC."""
    hour = F.hour(ts)
    return (F.weekday(ts) < 5) & (hour.between(1, 3) | hour.between(6, 9))


def fx() -> Column:
    return F.when(F.col("currency") == "USD", USD_CNY).otherwise(1.0)


def call_cost(calls: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """calls (model, ts, tin, tout, cached) with cost_cny (6 digits); unpriced models cost 0."""
    table = table if table is not None else prices(calls.sparkSession).where(F.col("model").isin(*CALL_PRICED))
    rate = table.select("model", "in_hit", "in_miss", F.col("out").alias("out_price"), "peak_multiplier", fx().alias("fx"))
    miss = F.greatest(F.col("tin") - F.col("cached"), F.lit(0))
    base = (F.col("cached") * F.col("in_hit") + miss * F.col("in_miss") + F.col("tout") * F.col("out_price")) / 1e6
    peak = F.when(is_peak(F.col("ts")), F.col("peak_multiplier")).otherwise(1.0)
    cost = F.round(F.coalesce(base * peak * F.col("fx"), F.lit(0.0)), 6)
    return calls.join(rate, "model", "left").withColumn("cost_cny", cost).drop("in_hit", "in_miss", "out_price", "peak_multiplier", "fx")


def ledger_summary(ledger: DataFrame, limit: float) -> DataFrame:
    """Total, by provider and by model (kind, name): cost (6 digits) and calls; with what remains of the limit and
    whether it is reached, on the total."""
    cost = F.round(F.sum(F.coalesce("cost_cny", F.lit(0.0))), 6)
    rows = ledger.groupingSets([[], [F.col("provider")], [F.col("model")]], "provider", "model").agg(cost.alias("cost_cny"), F.count("*").alias("calls"), F.grouping("provider").alias("gp"), F.grouping("model").alias("gm"))
    kind = F.when((F.col("gp") == 1) & (F.col("gm") == 1), "total").when(F.col("gp") == 0, "provider").otherwise("model")
    total = kind == "total"
    return rows.select(
        kind.alias("kind"),
        F.when(kind == "provider", F.col("provider")).when(kind == "model", F.col("model")).alias("name"),
        F.coalesce("cost_cny", F.lit(0.0)).alias("cost_cny"),
        "calls",
        F.when(total, F.round(F.greatest(F.lit(limit) - F.coalesce("cost_cny", F.lit(0.0)), F.lit(0.0)), 6)).alias("remaining"),
        F.when(total, F.coalesce("cost_cny", F.lit(0.0)) >= limit).alias("over_limit"),
    )


def cache_stats(ledger: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Per model of (model, tin, cached): prompt and cached tokens, hit rate in percent (2 digits), and what the cache
    saved at off-peak prices where the price of a hit is known (6 digits)."""
    table = table if table is not None else prices(ledger.sparkSession)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rows = ledger.groupBy("model").agg(zero("tin").alias("prompt_tokens"), zero("cached").alias("cached_tokens"))
    rate = F.when(F.col("prompt_tokens") > 0, F.col("cached_tokens") / F.col("prompt_tokens") * 100).otherwise(0.0)
    saved = F.col("cached_tokens") * (F.col("in_miss") - F.col("in_hit")) * fx() / 1e6
    joined = rows.join(table.select("model", "in_miss", "in_hit", "currency"), "model", "left")
    return joined.select("model", "prompt_tokens", "cached_tokens", F.round(rate, 2).alias("hit_rate"), F.round(F.coalesce(saved, F.lit(0.0)), 6).alias("saved_cny"))


def unit_prices(table: DataFrame, peak: bool) -> DataFrame:
    """Prices in CNY per million tokens (4 digits), unknown ones null; ratio of output to input (1 digit), null if free."""
    times = F.when(F.lit(peak), F.col("peak_multiplier")).otherwise(1.0) * fx()
    unit = lambda c: F.round(F.col(c) * times, 4)
    ratio = F.when(F.col("in_miss") > 0, F.round(F.col("out") / F.col("in_miss"), 1))
    return table.select("model", "provider", "free", unit("in_miss").alias("input_cny"), unit("in_hit").alias("cached_cny"), unit("out").alias("output_cny"), ratio.alias("out_in_ratio"))


def _priced(scenarios: DataFrame, table: DataFrame | None) -> DataFrame:
    table = table if table is not None else prices(scenarios.sparkSession)
    times = F.when(F.col("peak"), F.col("peak_multiplier")).otherwise(1.0) * fx()
    rate = table.select("model", "peak_multiplier", "currency", "in_miss", "in_hit")
    joined = scenarios.join(rate, "model").withColumn("miss", F.col("in_miss") * times).withColumn("unknown", F.col("in_hit").isNull())
    return joined.withColumn("hit", F.coalesce("in_hit", "in_miss") * times)


def breakeven(scenarios: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """scenarios (model, prefix, dynamic, calls, peak) with the cost of all calls without and with a cache, what that
    saves, and whether the prefix is long enough and its price known."""
    rows = _priced(scenarios, table)
    total = F.col("prefix") + F.col("dynamic")
    plain = F.col("calls") * total * F.col("miss") / 1e6
    cached = (total * F.col("miss") + (F.col("calls") - 1) * (F.col("dynamic") * F.col("miss") + F.col("prefix") * F.col("hit"))) / 1e6
    return rows.select(
        *scenarios.columns,
        F.round(plain, 6).alias("no_cache_cny"),
        F.round(cached, 6).alias("with_cache_cny"),
        F.round(plain - cached, 6).alias("saved_cny"),
        F.round(F.when(plain > 0, (plain - cached) / plain * 100).otherwise(0.0), 2).alias("saved_pct"),
        ((F.col("prefix") >= MIN_PREFIX) & ~F.col("unknown")).alias("eligible"),
    )


def calls_to_save(scenarios: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """scenarios (model, prefix, target, peak) with the calls that save the target, null where that cannot be."""
    rows = _priced(scenarios, table)
    each = F.when(~F.col("unknown"), F.col("prefix") * (F.col("miss") - F.col("hit")) / 1e6)
    calls = F.when(each > 0, F.floor(F.col("target") / F.nullif(each, F.lit(0.0))) + 1)
    return rows.select(*scenarios.columns, F.coalesce(each > 0, F.lit(False)).alias("feasible"), F.round(each, 8).alias("saved_per_call_cny"), calls.cast("long").alias("calls_needed"))


def running_budget(ledger: DataFrame, limit: float, tenant: str = "tenant", order: str = "ts", key: str = "id") -> DataFrame:
    """Each tenant's cost so far and whether its gate was still open when a call came: closed once the cost before it
    reaches the limit. There is no order across tenants. A tenant's calls are summed by slices (see ``scans``), so it
    may have any number of them."""
    spent = F.coalesce("cost_cny", F.lit(0.0))
    rows = scans.bare(scans.prefix(scans.sliced(ledger, tenant, [order, key]), tenant, [order, key], {"so_far": ("sum", spent)}))
    return rows.withColumn("so_far", F.round("so_far", 6)).withColumn("open", F.round(F.col("so_far") - spent, 6) < limit)


def traffic_report(traffic: DataFrame) -> DataFrame:
    """Per path of traffic lines (path, status, latency_s, response JSON text): requests, errors, mean latency, and the
    cost that the responses state; none or no object counts as 0."""
    cost = F.coalesce(F.get_json_object("response", "$.cost_cny").cast("double"), F.lit(0.0))
    return traffic.groupBy("path").agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), F.round(F.avg("latency_s"), 6).alias("mean_s"), F.round(F.sum(cost), 6).alias("cost_cny")
    )


def tool_rows(traffic: DataFrame) -> DataFrame:
    """A row for each tool call in the responses' traces: (request_id, pos, turn, tool, args, result, error)."""
    trace = F.from_json(F.get_json_object("response", "$.trace"), "array<struct<turn:int,tool:string,args:string,result:string,error:string>>")
    return traffic.select("request_id", F.posexplode(trace).alias("pos", "t")).select("request_id", "pos", "t.*")


def token_costs(texts: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Per model: tokens of all texts (label, n_chars, tokens), cost of a thousand such calls, characters a token, and
    by how many percent the dearest model's cost exceeds the cheapest one's that is not free."""
    table = table if table is not None else prices(texts.sparkSession)
    sums = texts.agg(F.sum("tokens").alias("tokens"), F.sum("n_chars").alias("chars"))
    cost = F.round(F.col("tokens") * F.col("in_miss") * fx() / 1e6 * 1000, 6)
    rows = table.crossJoin(sums).select("model", "tokens", F.round(F.col("chars") / F.col("tokens"), 2).alias("chars_per_token"), cost.alias("cost_per_1k"))
    w = Window.partitionBy(F.lit(1))
    least = F.min(F.when(F.col("cost_per_1k") > 0, F.col("cost_per_1k"))).over(w)
    return rows.withColumn("spread_pct", F.round((F.max("cost_per_1k").over(w) / least - 1) * 100, 2))


def task_usage(calls: DataFrame) -> DataFrame:
    """Per task: calls, cost (6 digits), latency (3 digits), prompt and completion tokens."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return calls.groupBy("task_id").agg(
        F.count("*").alias("calls"), F.round(total("cost_cny"), 6).alias("cost_cny"), F.round(total("latency_s"), 3).alias("latency_s"), total("tin").alias("prompt_tokens"), total("tout").alias("completion_tokens")
    )
