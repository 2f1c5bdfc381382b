"""Contexts, the abstention gate, answers and their citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import CITATION, ENTITY, collapse, matches

MIN_COSINE, MIN_BM25 = 0.40, 8.0
NO_ANSWER = "NO_ANSWER"
CONTEXT_CHARS, QUOTE_CHARS = 700, 120


def build_context(hits: DataFrame, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """(qid, context): the hits' texts in order of rank, white space collapsed, cut and numbered."""
    parts = F.array_sort(F.collect_list(F.struct("rank", F.left(collapse(F.coalesce("text", F.lit(""))), F.lit(max_chars)).alias("body"))))
    shown = F.transform(parts, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p["body"]))
    return hits.groupBy("qid").agg(F.array_join(shown, "\n\n").alias("context"))


def gate(queries: DataFrame, hits: DataFrame, min_cosine: float = MIN_COSINE, min_bm25: float = MIN_BM25) -> DataFrame:
    """Whether each query's first hit is good enough to answer from, and what it failed on: the vector score
    if there is one, else the BM25 score; no hits fail, no scores pass."""
    top = hits.where("rank = 1").select("qid", "vector_score", "bm25_score", F.lit(True).alias("hit"))
    cos, kw = F.col("vector_score"), F.col("bm25_score")
    failed = F.when(F.col("hit").isNull(), "no hits").when(cos.isNotNull(), F.when(cos < min_cosine, "vector")).when(kw < min_bm25, "bm25")
    return queries.join(top, "qid", "left").withColumn("failed_on", failed).withColumn("passed", F.col("failed_on").isNull()).drop("hit")


def parse_answer(text: Column) -> Column:
    """struct<abstained,answer,reason> of a generated text. An empty text abstains, and so does one whose first
    line is the mark, the lines after it being the reason."""
    whole = F.trim(F.coalesce(text, F.lit("")))
    head = F.trim(F.substring_index(whole, "\n", 1), F.lit("*·` \r\t"))
    rest = F.trim(F.when(F.locate("\n", whole) > 0, F.substr(whole, F.locate("\n", whole) + 1)).otherwise(""))
    out = lambda abstained, answer, reason: F.struct(F.lit(abstained).alias("abstained"), answer.alias("answer"), reason.alias("reason"))
    empty = F.coalesce(text, F.lit("")) == ""
    none = F.lit("")
    return (
        F.when(empty, out(True, none, F.lit("no output")))
        .when(head == NO_ANSWER, out(True, none, F.coalesce(F.nullif(rest, F.lit("")), F.lit("nothing relevant in the sources"))))
        .otherwise(out(False, whole, none))
    )


def citations(text: Column, n_docs: Column) -> Column:
    """struct<used,unsupported> of the numbers that an answer cites, each in the order of first occurrence."""
    named = F.array_distinct(F.transform(matches(text, r"\[(\d{1,2})\]", 1), lambda s: s.cast("int")))
    fits = lambda n: (n >= 1) & (n <= n_docs)
    return F.struct(F.filter(named, fits).alias("used"), F.filter(named, lambda n: ~fits(n)).alias("unsupported"))


def citation_rows(answers: DataFrame, hits: DataFrame, quote_chars: int = QUOTE_CHARS) -> DataFrame:
    """(qid, n, chunk, quote): a row for each used citation of answers (qid, abstained, used) that did not abstain."""
    used = answers.where(~F.col("abstained")).select("qid", F.explode("used").alias("n"))
    shown = hits.select("qid", F.col("rank").alias("n"), "doc_id", F.left(collapse(F.coalesce("text", F.lit(""))), F.lit(quote_chars)).alias("quote"))
    return used.join(shown, ["qid", "n"])


def ask(queries: DataFrame, hits: DataFrame, generated: DataFrame) -> DataFrame:
    """Answer records: gate, then the generated text (qid, text) parsed with its citations. A query that fails
    the gate abstains without its text."""
    gated = gate(queries, hits).join(hits.groupBy("qid").agg(F.count("*").cast("int").alias("hits_count")), "qid", "left")
    parsed = parse_answer(F.when(F.col("passed"), F.col("text")))
    rows = gated.join(generated.select("qid", "text"), "qid", "left").withColumn("p", parsed)
    rows = rows.withColumn("c", citations(F.col("p.answer"), F.coalesce("hits_count", F.lit(0))))
    reason = F.when(~F.col("passed"), F.concat(F.lit("gate: "), F.col("failed_on"))).otherwise(F.col("p.reason"))
    return rows.select("qid", F.coalesce("hits_count", F.lit(0)).alias("hits_count"), "p.abstained", "p.answer", reason.alias("abstain_reason"), "c.used", "c.unsupported")


def pick_score(rows: DataFrame) -> DataFrame:
    """Points of cross-source answers (qid, abstained, answer, sources array of the citations, unsupported): 0 if
    abstained, of fewer than two sources or with a citation of nothing; else for length, digits and citations."""
    n, cites = F.length("answer"), F.size("sources")
    digits = F.length(F.regexp_replace("answer", r"[^\p{Nd}]", ""))
    several = F.size(F.array_distinct("sources")) >= 2
    fit = ~F.col("abstained") & several & (F.size("unsupported") == 0)
    points = F.when(n.between(150, 600), 3.0).when(n < 150, 1.0).otherwise(1.5) + F.when(digits >= 4, 2.0).otherwise(0.0) + F.when(cites.between(2, 4), 2.0).otherwise(0.5) + 1.5
    return rows.withColumn("points", F.when(fit, points).otherwise(0.0))


def abstain_stability(runs: DataFrame) -> DataFrame:
    """Points of questions that repeated runs (question, abstained, at_model, reason) all abstain on: for the share
    that the model decided and for the mean length of the reasons."""
    grouped = runs.groupBy("question").agg(
        F.count("*").alias("n"),
        F.count_if("abstained").alias("n_abstain"),
        F.count_if("at_model").alias("n_model"),
        F.avg(F.length(F.coalesce("reason", F.lit("")))).alias("reason_chars"),
    )
    share = F.when(F.col("n_model") == F.col("n"), 4.0).when(F.col("n_model") == 0, 1.5).otherwise(0.5)
    points = share + F.when(F.col("reason_chars") >= 20, 1.5).otherwise(0.0)
    return grouped.withColumn("points", F.when(F.col("n_abstain") < F.col("n"), 0.0).otherwise(points))


#: What an entity's characters are among; an entity lies within one such run of a text.
RUN = r"[A-Za-z0-9_.\-%]+"


def floors(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """(conv_id, turn, floor) of answers (conv_id, turn, answer; one each): the share of an answer's distinct entities
    that earlier turns (conv_id, turn, text) of its conversation contain; 1.0 if it names none.

    No context is put together: of every run of entity characters the first turn is kept, an entity meets the runs that
    hold its first three characters, and the least first turn of those that contain it is compared. So a
    conversation costs as its different words do, not as the square of its turns. Shorter entities are numbers, so
    shorter parts begin with a digit. Runs and parts are many times their texts, whose size is all that Spark knows of
    them: they are joined by a shuffle, never broadcast."""
    plain = lambda c: F.regexp_replace(c, CITATION, " ")
    runs = turns.select("conv_id", "turn", F.explode(F.array_distinct(matches(plain("text"), RUN))).alias("run"))
    runs = runs.groupBy("conv_id", "run").agg(F.min("turn").alias("first"))
    parts = F.concat(*(matches(F.col("run"), rf"(?=({p}))", 1) for p in ("[A-Za-z0-9]..", r"\d.", r"\d")))
    runs = runs.select("conv_id", "run", "first", F.explode(F.array_distinct(parts)).alias("part"))
    named = answers.select("conv_id", "turn", F.explode_outer(F.array_distinct(matches(plain("answer"), ENTITY))).alias("name"))
    wanted = named.where("name is not null").select("conv_id", "name").distinct().withColumn("part", F.left("name", F.lit(3)))
    first = wanted.join(runs.hint("merge"), ["conv_id", "part"]).where(F.contains("run", "name")).groupBy("conv_id", "name").agg(F.min("first").alias("first"))
    found = named.join(first.hint("merge"), ["conv_id", "name"], "left").groupBy("conv_id", "turn").agg(F.count("name").alias("n"), F.count_if(F.col("first") < F.col("turn")).alias("held"))
    return found.select("conv_id", "turn", F.when(F.col("n") == 0, 1.0).otherwise(F.col("held") / F.col("n")).alias("floor"))
