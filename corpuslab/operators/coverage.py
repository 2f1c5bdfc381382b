"""How many documents name the keywords of a dictionary, and how well the known levels cover them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators import matching

GAP_PERCENT = 30.0


def document_frequency(docs: DataFrame, dictionary: list[tuple[str, str]] | DataFrame, text_col: str = "text") -> DataFrame:
    """(category, keyword, docs, pct) of a dictionary of (category, keyword): documents that hold a keyword, letter case
    apart, and their share in percent (1 digit). Keywords in no document are left out. All keywords are found in one
    scan of a text (see ``matching.holding``), and only matches are counted."""
    spark = docs.sparkSession
    known = dictionary if isinstance(dictionary, DataFrame) else spark.createDataFrame(dictionary, "category string, keyword string")
    known = known.select("category", "keyword", F.lower("keyword").alias("word"))
    texts = docs.select(F.lower(F.coalesce(text_col, F.lit(""))).alias("text"))
    found = matching.counts(texts, known.select("word")).join(known, "word")
    total = docs.agg(F.count("*").alias("total"))
    return found.crossJoin(total).select("category", "keyword", "docs", F.round(F.col("docs") / F.col("total") * 100, 1).alias("pct")).orderBy(F.desc("pct"), "category", "keyword")


def with_levels(frequency: DataFrame, levels: DataFrame) -> DataFrame:
    """Frequencies with the level of each keyword (keyword, level), `none` where unknown."""
    return frequency.join(levels.select("keyword", "level"), "keyword", "left").withColumn("level", F.coalesce("level", F.lit("none")))


def coverage(levelled: DataFrame) -> DataFrame:
    """One row: keywords, covered (level not none) and strong ones, in percent (1 digit) and weighted by frequency."""
    covered = F.col("level") != "none"
    share = lambda a, b: F.round(F.when(b > 0, a / b * 100).otherwise(0.0), 1)
    weight = F.sum(F.when(covered, F.col("docs")).otherwise(0))
    return levelled.agg(
        F.count("*").alias("keywords"), F.count_if(covered).alias("covered"), F.count_if(F.col("level") == "strong").alias("strong"),
        share(F.count_if(covered), F.count("*")).alias("simple_pct"), share(weight, F.sum("docs")).alias("weighted_pct"),
    )


def gaps(levelled: DataFrame, least: float = GAP_PERCENT) -> DataFrame:
    """Frequent keywords (``least`` percent or more) without a level."""
    return levelled.where((F.col("level") == "none") & (F.col("pct") >= least))


def weak(levelled: DataFrame) -> DataFrame:
    return levelled.where(F.col("level") == "some")
