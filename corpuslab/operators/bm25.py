"""BM25 over a corpus, without a shuffle by term of the corpus.

Only terms that queries hold are taken from the texts, which are tokenised once, so a shuffle carries one
row per document and query term, and one for all else; frequencies and lengths are sums of these. The queries' terms are measured first: up to
BROADCAST_BYTES they go to the tasks, beyond it both sides are shuffled by term. The exploded corpus is
never broadcast, however small Spark takes its files to be."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.text import token_count, tokens
from corpuslab.sources.session import stored

K1, B = 1.5, 0.75
#: Scores are compared after rounding, so that the order of a sum decides no tie.
DIGITS = 6
#: Measured size of the queries' distinct terms up to which they are broadcast, and what one term takes besides its bytes.
BROADCAST_BYTES, TERM_BYTES = 32 << 20, 64


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, f) of every document."""
    terms = docs.select(id_col, F.explode_outer(tokens(F.col(text_col))).alias("term")).where("term is not null")
    return terms.groupBy(id_col, "term").agg(F.count("*").alias("f"))


def postings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, dl, term, f) of the tokens that ``wanted`` (term) holds, with a document's length, and a row of
    null term for what else it has, so every document is there.

    The texts are tokenised once; what no query holds is summed in place, and the rows are stored, as
    scores, averages and document frequencies all come from them."""
    terms = wanted.select("term").where("term is not null").distinct()
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + TERM_BYTES), F.lit(0))).first()[0]
    side = terms.withColumnRenamed("term", "held")
    side = F.broadcast(side) if size <= BROADCAST_BYTES else side.hint("merge")
    tokenised = docs.select("doc_id", tokens(F.col("text")).alias("terms"))
    rows = tokenised.select("doc_id", F.size("terms").alias("dl"), F.explode_outer("terms").alias("term"))
    rows = rows.join(side, F.col("term") == F.col("held"), "left")
    return stored(rows.groupBy("doc_id", "dl", F.col("held").alias("term")).agg(F.count("term").alias("f")))


def query_terms(queries: DataFrame, qid: str = "qid", text: str = "question") -> DataFrame:
    """(qid, term, qf): each query's terms and how often it has them."""
    return term_counts(queries, qid, text).select(F.col(qid).alias("qid"), "term", F.col("f").alias("qf"))


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, dl) of every document."""
    return docs.select("doc_id", token_count(F.col("text")).alias("dl"))


def index_stats(docs: DataFrame) -> DataFrame:
    """(term, df, idf) of the corpus: idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    terms = docs.select(F.explode_outer(F.array_distinct(tokens(F.col("text")))).alias("term")).where("term is not null")
    counts = terms.groupBy("term").agg(F.count("*").alias("df"))
    return counts.crossJoin(docs.agg(F.count("*").alias("n"))).select("term", "df", _idf().alias("idf"))


def _idf():
    return F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def scores(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, held: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, score) of all pairs that share a term: the sum of idf * f (k1 + 1) / (f + k1 (1 - b +
    b dl / avgdl)), weighted by how often the query has the term. All rows of ``docs`` are the corpus;
    ``held`` are its postings, of the queries' terms at least, where they are known."""
    wanted = query_terms(queries)
    held = postings(docs, wanted) if held is None else held
    tf = held.where("term is not null")
    about = docs.agg(F.count("*").alias("n")).crossJoin(held.agg(F.sum("f").alias("all"))).select("n", (F.col("all") / F.col("n")).alias("avgdl"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(about).select("term", _idf().alias("idf"), "avgdl")
    part = F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))) * F.col("qf")
    pairs = tf.join(wanted.join(idf, "term"), "term").select("qid", "doc_id", part.alias("part"))
    return pairs.groupBy("qid", "doc_id").agg(F.sum("part").alias("score"))


def topk(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, held: DataFrame | None = None) -> DataFrame:
    """The ranked list (qid, doc_id, rank, score) of the best k documents of each query, scores above 0
    only; ties by doc_id."""
    found = scores(docs, queries, k1, b, held).withColumn("score", F.round("score", DIGITS)).where("score > 0")
    return rank(found, k)


def rank(found: DataFrame, k: int, *ties: str) -> DataFrame:
    """(qid, doc_id, rank, score): the best k of each query by score, then ``ties``, then doc_id."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), *ties, "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "doc_id", "rank", "score")
