"""Ranked-list algebra. Every list is a long table (qid, doc_id, rank, score), ranks from 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators import bm25, inverted, vectors

RRF_K = 60
MODES = ("vector", "bm25", "hybrid", "hybrid_rerank")


def rrf(lists: Sequence[DataFrame], topk: int, k: int = RRF_K, weights: Sequence[float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion: the sum of w / (k + rank). Ties go to the document that comes first in the
    earliest list. Returns qid, doc_id, rank, score and each list's own score, score_0, score_1 ..."""
    weights = weights or [1.0] * len(lists)
    parts = [
        d.select("qid", "doc_id", (F.lit(float(w)) / (k + F.col("rank"))).alias("part"), (F.lit(i * 1e9) + F.col("rank")).alias("first"), F.lit(i).alias("list"), F.col("score").alias("own"))
        for i, (d, w) in enumerate(zip(lists, weights))
    ]
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.unionByName(p)
    own = [F.max(F.when(F.col("list") == i, F.col("own"))).alias(f"score_{i}") for i in range(len(lists))]
    fused = joined.groupBy("qid", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"), F.min("first").alias("first"), *own)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "first", "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= topk).drop("first")


def minmax(found: DataFrame) -> DataFrame:
    """Scores of each query scaled to 0..1; all 1.0 where they span less than 1e-9."""
    w = Window.partitionBy("qid")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high - low < 1e-9, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))
    return found.withColumn("score", F.round(scaled, 6))


def search(docs: DataFrame, queries: DataFrame, mode: str = "hybrid", topk: int = 5, pool: int = 50, judged: DataFrame | None = None, index: inverted.Index | None = None) -> DataFrame:
    """Search docs (doc_id, text, vector) for queries (qid, question, vector) in one of MODES. Path scores
    are vector_score and bm25_score: 0.0 where a path that found something did not find the document,
    null where the path was not run or found nothing. hybrid_rerank applies judge texts (qid, order_text).
    ``index`` is the stored index of these docs, where there is one; without, texts are tokenised for this call."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    none = F.lit(None).cast("double")
    words = lambda k: bm25.topk(docs, queries, k) if index is None else inverted.topk(index, queries, k)
    if mode == "vector":
        found = vectors.topk(docs, queries, min(topk, pool))
        return found.select("*", F.round("score", 4).alias("vector_score"), none.alias("bm25_score"))
    if mode == "bm25":
        found = words(min(topk, pool))
        return found.select("*", none.alias("vector_score"), F.round("score", 4).alias("bm25_score"))
    lists = [vectors.topk(docs, queries, pool), words(pool)]
    fused = rrf(lists, pool)
    if mode == "hybrid_rerank":
        if judged is None:
            raise ValueError("hybrid_rerank needs judge texts")
        fused = rerank(fused, judged)
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    path = lambda s: F.round(F.when(F.max(s).over(w).isNotNull(), F.coalesce(F.col(s), F.lit(0.0))), 4)
    shown = fused.select("qid", "doc_id", "rank", F.round("score", 6).alias("score"), path("score_0").alias("vector_score"), path("score_1").alias("bm25_score"))
    return shown.where(F.col("rank") <= topk)


def assemble(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with what their chunk shows: source, title, section path joined by ` > `, and the parent's text
    for a child (its own where the parent is missing). chunks: chunk_id, parent_id, source, title,
    section_path, text."""
    own = chunks.select(F.col("chunk_id").alias("doc_id"), "parent_id", "source", "title", F.array_join("section_path", " > ").alias("path"), F.col("text").alias("own"))
    parents = chunks.select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"))
    joined = found.join(own, "doc_id").join(parents, "parent_id", "left")
    kept = [c for c in found.columns if c != "doc_id"]
    return joined.select("doc_id", *kept, "source", "title", "path", F.col("parent_text").isNotNull().alias("from_parent"), F.coalesce("parent_text", "own").alias("text"))


def parsed_order(text: Column, n: Column) -> Column:
    """The permutation of 1..n that a judge's text names as ``[a, b, ...]``, or null."""
    named = F.from_json(F.regexp_extract(F.coalesce(text, F.lit("")), r"\[[\d,\s]*\]", 0), "array<int>")
    return F.when(F.array_sort(named) == F.sequence(F.lit(1), F.greatest(n, F.lit(1))), named)


def rerank(found: DataFrame, judged: DataFrame, first: int = 20) -> DataFrame:
    """Each query's first ``first`` hits in the order that its judge text (qid, order_text) names, the rest
    after them. A text that is no exact permutation, or fewer than two candidates, changes nothing."""
    count = F.least(F.count("*").over(Window.partitionBy("qid")), F.lit(first)).cast("int")
    joined = found.withColumn("__n", count).join(judged.select("qid", "order_text"), "qid", "left")
    order = F.when(F.col("__n") >= 2, parsed_order(F.col("order_text"), F.col("__n")))
    place = F.when(order.isNotNull() & (F.col("rank") <= F.col("__n")), F.array_position(order, F.col("rank").cast("int")).cast("int")).otherwise(F.col("rank"))
    return joined.withColumn("rank", place.cast("int")).drop("__n", "order_text")


def variants(text: Column, n: int) -> Column:
    """At most n rewritten queries of a text, one a line, list marks trimmed, blank lines dropped."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.trim(F.trim(s), F.lit(" -*•\t")))
    return F.slice(F.filter(lines, lambda s: s != ""), 1, n)


def multi_query(docs: DataFrame, queries: DataFrame, n: int = 3, topk: int = 5, mode: str = "bm25", index: inverted.Index | None = None) -> DataFrame:
    """Queries (qid, question, variants_text[, vector]) searched as they are and in up to n variants, each
    cut to topk, fused by reciprocal rank. Lists tie in the order original, first variant, ..."""
    every = F.concat(F.array("question"), variants(F.col("variants_text"), n))
    more = [c for c in queries.columns if c == "vector"]
    spread = queries.select(F.col("qid").alias("own"), *more, F.posexplode(every).alias("pos", "question"))
    spread = spread.withColumn("qid", F.concat_ws("/", F.col("own").cast("string"), F.col("pos").cast("string")))
    found = search(docs, spread, mode, topk, index=index).join(spread.select("qid", "own", "pos"), "qid")
    part = F.lit(1.0) / (RRF_K + F.col("rank"))
    fused = found.groupBy("own", "doc_id").agg(F.round(F.sum(part), 9).alias("score"), F.min(F.col("pos") * 1e9 + F.col("rank")).alias("first"))
    return bm25.rank(fused.withColumnRenamed("own", "qid"), topk, "first")


def hypothetical(queries: DataFrame) -> DataFrame:
    """Queries (qid, question, hypothesis) with the hypothesis as question where there is one."""
    return queries.withColumn("question", F.coalesce(F.nullif(F.trim("hypothesis"), F.lit("")), F.col("question")))


def parent_dedup(hits: DataFrame, topk: int, key_chars: int = 200) -> DataFrame:
    """Of the first topk * 3 hits (qid, doc_id, rank, score, text), the best of each text start, cut to topk,
    with how many there were before and after."""
    pool = hits.where(F.col("rank") <= topk * 3).withColumn("key", F.left("text", F.lit(key_chars)))
    n = F.count("*").over(Window.partitionBy("qid"))
    best = pool.withColumn("before", n).withColumn("place", F.row_number().over(Window.partitionBy("qid", "key").orderBy("rank"))).where("place = 1")
    best = best.withColumn("after", n).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    return best.where(F.col("rank") <= topk).drop("key", "place")


def route_label(text: Column, sources: Sequence[str]) -> Column:
    """The first of ``sources`` that a classifier's text holds, else `general`."""
    out = F.lit("general")
    for s in reversed(sources):
        out = F.when(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(s)), F.lit(s)).otherwise(out)
    return out


def routed(hits: DataFrame, targets: DataFrame, topk: int) -> DataFrame:
    """hits (qid, doc_id, rank, score, source) with those of each query's target (qid, target) first, filled up
    with the others and cut to topk. A null or `general` target changes nothing but the cut."""
    joined = hits.join(targets.select("qid", "target"), "qid", "left")
    match = F.coalesce(F.col("source") == F.col("target"), F.lit(False))
    order = Window.partitionBy("qid").orderBy(F.desc(match), "rank")
    return joined.withColumn("place", F.row_number().over(order)).where(F.col("place") <= topk).withColumn("rank", F.col("place")).drop("place", "target")


def self_query(text: Column, sources: Sequence[str]) -> Column:
    """struct<semantic,source> of the JSON object in a text; null semantic if there is none, null source if
    it names none of ``sources``."""
    found = F.from_json(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0), "semantic string, source string")
    source = F.when(found["source"].isin(*sources), found["source"])
    return F.struct(F.nullif(F.trim(found["semantic"]), F.lit("")).alias("semantic"), source.alias("source"))


def overfetch(hits: DataFrame, source: str | None, topk: int, text_chars: int = 800) -> DataFrame:
    """With a source: the first min(4 * topk, 50) hits, filtered, then cut; without: the first topk. Texts cut."""
    need = min(4 * topk, 50) if source else topk
    kept = hits.where(F.col("rank") <= need)
    if source:
        kept = kept.where(F.col("source") == source)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("rank") <= topk)
    return kept.withColumn("text", F.left("text", F.lit(text_chars))) if "text" in hits.columns else kept


def postfilter(hits: DataFrame, source: str | None, topk: int) -> DataFrame:
    """The first topk hits, filtered after the cut; there may be fewer."""
    kept = hits.where(F.col("rank") <= topk)
    return kept.where(F.col("source") == source) if source else kept
