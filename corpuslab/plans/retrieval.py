"""Retrieval over `documents` and `embeddings` with the texts and vectors of `benchmark` as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.text import estimated_tokens, tokens
from corpuslab.operators import answer, fuse, inverted, matching, metrics, vectors
from corpuslab.plans.registry import Registry
from corpuslab.sources.session import stored
from corpuslab.sources.tables import table

R = Registry()

TOKENS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9_.:\-/]*'), lambda x: lower(rtrim(x, './:-_')))"
#: q(qid, question, vector), tok, and the full BM25 scores as all_scores(qid, doc_id, score).
BM25 = rf"""
q as (select item_id as qid, text as question from benchmark),
tok as materialized (select doc_id, {TOKENS} as terms from documents),
qt as (select qid, term, count(*) as qf from (select qid, unnest({TOKENS.replace('text', 'question')}) as term from q) group by all),
about as (select count(*) as n, avg(len(terms)) as avgdl from tok),
tf as materialized (select doc_id, dl, term, count(*) as f from (select doc_id, len(terms) as dl, unnest(terms) as term from tok)
  where term in (select term from qt) group by all),
idf as (select term, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf, avgdl from (select term, count(*) as df from tf group by term), about),
all_scores as materialized (select qid, doc_id, round(sum(idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qf), 6) as score
  from tf join idf using (term) join qt using (term) group by qid, doc_id)"""


def ranked(name: str, scores: str, k: int, ties: str = "") -> str:
    return f"{name} as materialized (select qid, doc_id, cast(rank as int) as rank, score from (select *, row_number() over (partition by qid order by score desc, {ties} doc_id) as rank from {scores} where score > 0) where rank <= {k})"


def bm25_list(k: int) -> str:
    return BM25 + ",\n" + ranked("bm", "all_scores", k)


def vector_list(k: int) -> str:
    return f"""v as (select vec_id, embedding::double[] as e from embeddings),
vs as materialized (select item_id as qid, d.vec_id as doc_id, round(list_cosine_similarity(qv.e, d.e), 6) as score
  from benchmark join v qv on qv.vec_id = item_id, v d),
vec as materialized (select qid, doc_id, cast(rank as int) as rank, score from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from vs) where rank <= {k})"""


def rrf_sql(lists: list[str], k: int, topk: int, weights: list[float]) -> str:
    parts = " union all ".join(f"select qid, doc_id, {w!r} / ({k} + rank) as part, {i} * 1e9 + rank as first, {i} as list, score as own from {x}" for i, (x, w) in enumerate(zip(lists, weights)))
    own = ", ".join(f"max(case when list = {i} then own end) as score_{i}" for i in range(len(lists)))
    return f"""parts as ({parts}),
fused as (select qid, doc_id, round(sum(part), 9) as score, min(first) as first, {own} from parts group by qid, doc_id),
rrf as materialized (select * exclude (first, rank), cast(rank as int) as rank from (select *, row_number() over (partition by qid order by score desc, first, doc_id) as rank from fused) where rank <= {topk})"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question, vector): a benchmark item and the embedding of its number."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return items.join(vecs, "qid", "left")


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


#: Stored indexes of this process, by application, data folder and corpus.
INDEXES: dict[tuple[str, str, str], inverted.Index] = {}


def stored_index(spark: SparkSession, sf_dir: str, name: str = "documents") -> inverted.Index:
    """The stored index of `documents` (or of `hybrid`, which also has the vectors that no text belongs to). It is
    written by the first query of an application that asks for it; the others read it. A table that has
    changed under its path needs another application or ``INDEXES.clear()``."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in INDEXES:
        INDEXES[key] = inverted.build(corpus(spark, sf_dir) if name == "documents" else hybrid_corpus(spark, sf_dir))
    return INDEXES[key]


def bm(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return inverted.topk(stored_index(spark, sf_dir), questions(spark, sf_dir), k)


def vec(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return vectors.topk(vecs(spark, sf_dir), questions(spark, sf_dir), k)


def with_source(found: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranked list with the documents' sources and texts."""
    return found.join(corpus(spark, sf_dir).select("doc_id", "source", "text"), "doc_id")


@R.add(f"select doc_id, cast(len({TOKENS}) as bigint) as n_tokens, cast(len(list_distinct({TOKENS})) as bigint) as n_terms from documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens(F.col("text"))
    return corpus(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_terms"))


@R.add(r"""select source, count(*) as docs, cast(sum(cast(floor(len(regexp_extract_all(coalesce(text, ''), '[\x{4e00}-\x{9fff}]')) * 0.6
 + len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) * 1.3) as bigint)) as bigint) as est_tokens from documents group by source""")
def est_tokens_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).groupBy("source").agg(F.count("*").alias("docs"), F.sum(estimated_tokens(F.col("text"))).alias("est_tokens"))


@R.add(rf"""with t as (select distinct doc_id, unnest({TOKENS}) as term from documents), n as (select count(*) as n from documents)
select term, count(*) as df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) as idf from t, n group by term""")
def bm25_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverted.statistics(stored_index(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@R.add(f"with {bm25_list(10)} select * from bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm(spark, sf_dir, 10)


@R.add()
def bm25_block_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, held, read): the postings of each question's terms in the stored index, and those that its first ten hits took."""
    return inverted.Search(stored_index(spark, sf_dir), questions(spark, sf_dir), 10).reads()


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, expect_chunk, lang): the lowest document that holds the item's text word for word. Items of fewer
    than 24 characters are left out."""
    items = table(spark, sf_dir, "benchmark").where("length(text) >= 24").select("item_id", F.col("text").alias("item"))
    held = holders(corpus(spark, sf_dir), items, stored_index(spark, sf_dir))
    found = held.groupBy("item_id").agg(F.min(F.struct("doc_id", "lang")).alias("d"))
    return found.select(F.col("item_id").alias("qid"), F.col("d.doc_id").alias("expect_chunk"), F.col("d.lang").alias("lang"))


def holders(docs: DataFrame, items: DataFrame, index: inverted.Index) -> DataFrame:
    """Pairs of an item (item_id, item) and a document (doc_id, lang, text) whose text contains it.

    Only documents with the item's rarest inner token, which ``index`` names, are compared. Tokens in the item's
    first and last run without spaces may be part of longer ones in a text, so they do not choose; items without
    others are looked for by an automaton, in one scan of the texts for each block of them."""
    edges = F.concat_ws(" ", F.regexp_extract("item", r"^\s*\S*", 0), F.regexp_extract("item", r"\S*\s*$", 0))
    terms = items.select("item_id", F.explode_outer(F.array_except(tokens(F.col("item")), tokens(edges))).alias("term"))
    # An item's terms that no text has are the rarest; such an item is in no text.
    named = terms.where("term is not null")
    chosen = named.join(inverted.frequencies(index, named.select("term").distinct()), "term", "left")
    rarest = chosen.groupBy("item_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    pairs = stored(inverted.holding(index, rarest.select("term").distinct()).join(rarest, "term").select("item_id", "doc_id").distinct())
    shown = docs.select("doc_id", "lang", "text")
    inner = pairs.join(items, "item_id").join(shown, "doc_id").where(F.contains("text", "item"))
    bare = items.join(terms.where("term is null").select("item_id").distinct(), "item_id", "left_semi").select(F.col("item_id").alias("key"), F.col("item").alias("word"))
    found = matching.holding(shown, bare).withColumnRenamed("key", "item_id").join(items, "item_id")
    return inner.unionByName(found.select(*inner.columns))


EXPECTED = """expected as (select item_id as qid, min(d.doc_id) as expect_chunk, arg_min(d.lang, d.doc_id) as lang
  from benchmark b join documents d on contains(d.text, b.text) where length(b.text) >= 24 group by item_id)"""


@R.add(
    f"""with {bm25_list(10)}, {EXPECTED},
r as (select e.qid, lang, rank from expected e left join bm on bm.qid = e.qid and bm.doc_id = e.expect_chunk)
select lang, count(*) as n, round(avg(case when rank <= 1 then 1.0 else 0.0 end), 6) as hit1, round(avg(case when rank <= 3 then 1.0 else 0.0 end), 6) as hit3,
 round(avg(case when rank <= 5 then 1.0 else 0.0 end), 6) as hit5, round(avg(coalesce(1.0 / rank, 0.0)), 6) as mrr from r group by rollup (lang)"""
)
def bm25_recall_mrr_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: tokenise, score, rank, and measure against the documents that hold each item."""
    golden = expected(spark, sf_dir).withColumnRenamed("lang", "type")
    report = metrics.hit_report(golden, bm(spark, sf_dir, 10).withColumn("mode", F.lit("bm25")), ["bm25"])
    return report.select(F.col("type").alias("lang"), "n", "hit1", "hit3", "hit5", "mrr")


@R.add(f"with {vector_list(10)} select * from vec")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec(spark, sf_dir, 10)


@R.add("""select vec_id, round(list_cosine_similarity(embedding::double[], c.centre), 6) as cosine, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm
from embeddings join (select label, list(a order by i) as centre from (select label, i, avg(x) as a from (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings) group by label, i) group by label) c using (label)""")
def cosine_to_label_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's norm and its cosine with the mean vector of its label."""
    rows = table(spark, sf_dir, "embeddings")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("a"))
    centres = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("centre"))
    shown = rows.join(centres, "label")
    return shown.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("centre")), 6).alias("cosine"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


def _fused(spark: SparkSession, sf_dir: str, k: int, weights: list[float]) -> DataFrame:
    return fuse.rrf([vec(spark, sf_dir, 50), bm(spark, sf_dir, 50)], 10, k, weights)


@R.add(f"with {bm25_list(50)}, {vector_list(50)}, {rrf_sql(['vec', 'bm'], 60, 10, [1.0, 1.0])} select * from rrf")
def rrf_hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, 60, [1.0, 1.0])


@R.add(f"with {bm25_list(50)}, {vector_list(50)}, {rrf_sql(['vec', 'bm'], 100, 10, [0.3, 0.7])} select * from rrf")
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, 100, [0.3, 0.7])


# The full join of texts and vectors gives rows without text no tokens, but they count in N and avgdl.
HYBRID_CORPUS = bm25_list(50).replace(f"select doc_id, {TOKENS} as terms from documents", f"select coalesce(doc_id, vec_id) as doc_id, {TOKENS} as terms from documents full join embeddings on doc_id = vec_id", 1)
HYBRID = f"""{HYBRID_CORPUS}, {vector_list(50)}, {rrf_sql(['vec', 'bm'], 60, 50, [1.0, 1.0])},
hybrid as materialized (select qid, doc_id, rank, round(score, 6) as score,
  cast(round(case when max(score_0) over (partition by qid) is not null then cast(coalesce(score_0, 0.0) as decimal(18, 6)) end, 4) as double) as vector_score,
  cast(round(case when max(score_1) over (partition by qid) is not null then cast(coalesce(score_1, 0.0) as decimal(18, 6)) end, 4) as double) as bm25_score from rrf)"""


def hybrid_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", "text").join(vecs(spark, sf_dir), "doc_id", "full")


def hybrid(spark: SparkSession, sf_dir: str, topk: int) -> DataFrame:
    return fuse.search(hybrid_corpus(spark, sf_dir), questions(spark, sf_dir), "hybrid", topk, index=stored_index(spark, sf_dir, "hybrid"))


@R.add(f"with {HYBRID} select * from hybrid where rank <= 5")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir, 5)


@R.add(f"""with {bm25_list(10)} select qid, doc_id, rank,
round(case when max(score) over (partition by qid) - min(score) over (partition by qid) < 1e-9 then 1.0
 else (score - min(score) over (partition by qid)) / (max(score) over (partition by qid) - min(score) over (partition by qid)) end, 6) as score from bm""")
def minmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.minmax(bm(spark, sf_dir, 10))


@R.add(f"""with {bm25_list(15)}, h as (select bm.*, left(text, 200) as key from bm join documents using (doc_id)),
b as (select *, count(*) over (partition by qid) as before, row_number() over (partition by qid, key order by rank) as place from h),
c as (select *, count(*) over (partition by qid) as after, row_number() over (partition by qid order by rank) as r from b where place = 1)
select qid, doc_id, cast(r as int) as rank, score, before, after from c where r <= 5""")
def parent_dedup_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.parent_dedup(with_source(bm(spark, sf_dir, 15), spark, sf_dir), 5).drop("text", "source")


SOURCES = ("src0", "src1", "src2")


@R.add(f"""with {bm25_list(50)}, h as (select bm.*, source, 'ask src' || cast(qid % 4 as varchar) as said from bm join documents using (doc_id)),
t as (select *, case when contains(said, 'src0') then 'src0' when contains(said, 'src1') then 'src1' when contains(said, 'src2') then 'src2' else 'general' end as target from h),
r as (select *, row_number() over (partition by qid order by (source = target) desc, rank) as place from t)
select qid, doc_id, cast(place as int) as rank, score, source from r where place <= 5""")
def routed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier texts stand in as `ask src<n>`; src3 is no known source, so it routes nowhere."""
    said = F.concat(F.lit("ask src"), (F.col("qid") % 4).cast("string"))
    targets = questions(spark, sf_dir).select("qid", fuse.route_label(said, SOURCES).alias("target"))
    return fuse.routed(with_source(bm(spark, sf_dir, 50), spark, sf_dir), targets, 5).select("qid", "doc_id", "rank", "score", "source")


@R.add(f"""with {bm25_list(50)}, h as (select bm.*, source from bm join documents using (doc_id)),
t as (select *, case when qid % 3 = 0 then 'src1' when qid % 3 = 1 then 'src2' end as target from h),
r as (select *, row_number() over (partition by qid order by coalesce(source = target, false) desc, rank) as place from t)
select qid, doc_id, cast(place as int) as rank, score, source from r where place <= 5""")
def self_query_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query texts with a JSON object that names a source, one of them unknown."""
    said = F.concat(F.lit('so: {"semantic": "x", "source": "'), F.when(F.col("qid") % 3 == 0, "src1").when(F.col("qid") % 3 == 1, "src2").otherwise("src99"), F.lit('"} .'))
    targets = questions(spark, sf_dir).select("qid", fuse.self_query(said, SOURCES)["source"].alias("target"))
    return fuse.routed(with_source(bm(spark, sf_dir, 50), spark, sf_dir), targets, 5).select("qid", "doc_id", "rank", "score", "source")


@R.add(f"""with {bm25_list(20)}, h as (select bm.*, source, left(text, 800) as t from bm join documents using (doc_id) where source = 'src0')
select qid, doc_id, cast(r as int) as rank, score, length(t) as n from (select *, row_number() over (partition by qid order by rank) as r from h) where r <= 5""")
def overfetch_filter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fuse.overfetch(with_source(bm(spark, sf_dir, 50), spark, sf_dir), "src0", 5)
    return found.select("qid", "doc_id", "rank", "score", F.length("text").cast("long").alias("n"))


@R.add(f"with {bm25_list(5)} select bm.* from bm join documents using (doc_id) where source = 'src0'")
def postfilter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.postfilter(with_source(bm(spark, sf_dir, 5), spark, sf_dir), "src0", 5).select("qid", "doc_id", "rank", "score")


def _variants_sql() -> str:
    spread = """q as (select own || '/' || pos as qid, question, own, pos from (
 select item_id as own, 0 as pos, text as question from benchmark union all
 select item_id, 1, right(text, 60) from benchmark union all select item_id, 2, left(text, 40) from benchmark where trim(left(text, 40)) <> ''))"""
    body = bm25_list(5).replace("q as (select item_id as qid, text as question from benchmark)", spread)
    return f"""with {body},
m as (select own as qid, doc_id, round(sum(1.0 / (60 + rank)), 9) as score, min(pos * 1e9 + rank) as first from bm join q using (qid) group by own, doc_id)
select qid, doc_id, cast(rank as int) as rank, score from (select *, row_number() over (partition by qid order by score desc, first, doc_id) as rank from m) where rank <= 5"""


@R.add(_variants_sql())
def multiquery_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variants a question: its last 60, and its first 40 characters; bullets and blank lines are trimmed."""
    text = F.concat(F.lit("- "), F.regexp_replace(F.right("question", F.lit(60)), "\n", " "), F.lit("\n\n* "), F.regexp_replace(F.left("question", F.lit(40)), "\n", " "))
    asked = questions(spark, sf_dir).select("qid", "question", text.alias("variants_text"))
    return fuse.multi_query(corpus(spark, sf_dir), asked, 3, 5, index=stored_index(spark, sf_dir))


@R.add(f"""with {bm25_list(5).replace("q as (select item_id as qid, text as question from benchmark)", "q as (select item_id as qid, case when item_id % 2 = 0 then left(text, 60) else text end as question from benchmark)")} select * from bm""")
def hyde_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even questions have a hypothetical text, odd ones a blank one."""
    asked = questions(spark, sf_dir).withColumn("hypothesis", F.when(F.col("qid") % 2 == 0, F.left("question", F.lit(60))).otherwise("  "))
    return inverted.topk(stored_index(spark, sf_dir), fuse.hypothetical(asked), 5)


@R.add(f"""with {bm25_list(8)}, n as (select qid, count(*) as n from bm group by qid)
select bm.qid, doc_id, cast(case when bm.qid % 3 = 0 and n >= 2 then n + 1 - rank else rank end as int) as rank, score from bm join n using (qid)""")
def rerank_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the questions have a judge that turns the list round, a third one that repeats a number, a third none."""
    found = bm(spark, sf_dir, 8)
    count = found.groupBy("qid").agg(F.count("*").cast("int").alias("n"))
    turned = F.array_join(F.sequence(F.col("n"), F.lit(1), F.lit(-1)), ", ")
    text = F.when(F.col("qid") % 3 == 0, F.concat(F.lit("order: ["), turned, F.lit("] done"))).when(F.col("qid") % 3 == 1, F.lit("[1, 1]"))
    return fuse.rerank(found, count.select("qid", text.alias("order_text")))


@R.add(f"""with {bm25_list(5)},
f as (select qid, list(text order by rank) as texts from bm join documents using (doc_id) group by qid)
select qid, md5(list_aggregate(list_transform(range(1, len(texts) + 1), lambda i: '[' || i || '] ' || left(trim(regexp_replace(texts[i], '\\s+', ' ', 'g')), 700)), 'string_agg', chr(10) || chr(10))) as context_md5 from f""")
def context_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = with_source(bm(spark, sf_dir, 5), spark, sf_dir)
    return answer.build_context(hits).select("qid", F.md5("context").alias("context_md5"))


@R.add(f"""with {HYBRID}, g as (select item_id as qid, vector_score, bm25_score from benchmark left join hybrid on item_id = qid and rank = 1)
select qid, coalesce(case when vector_score is not null then vector_score >= 0.40 when bm25_score is not null then bm25_score >= 8.0 end, false) as passed,
 case when vector_score is null and bm25_score is null then 'no hits' when vector_score < 0.40 then 'vector' when vector_score is null and bm25_score < 8.0 then 'bm25' end as failed_on from g""")
def abstain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.gate(questions(spark, sf_dir).select("qid"), hybrid(spark, sf_dir, 5)).select("qid", "passed", "failed_on")


@R.add(f"""with {bm25_list(5)}, {vector_list(5)}, {EXPECTED},
l as (select 'bm25' as mode, qid, doc_id, rank from bm union all select 'vector', qid, doc_id, rank from vec),
m as (select 'bm25' as mode union all select 'vector'),
r as (select m.mode, e.lang, rank from expected e cross join m left join l on l.mode = m.mode and l.qid = e.qid and l.doc_id = e.expect_chunk)
select mode, lang as type, count(*) as n, round(avg(case when rank <= 1 then 1.0 else 0.0 end), 6) as hit1, round(avg(case when rank <= 3 then 1.0 else 0.0 end), 6) as hit3,
 round(avg(case when rank <= 5 then 1.0 else 0.0 end), 6) as hit5, round(avg(coalesce(1.0 / rank, 0.0)), 6) as mrr from r group by grouping sets ((mode, lang), (mode))""")
def retrieval_metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hit_report(expected(spark, sf_dir).withColumnRenamed("lang", "type"), _two_modes(spark, sf_dir), ["bm25", "vector"])


def _two_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {"bm25": bm(spark, sf_dir, 5), "vector": vec(spark, sf_dir, 5)}
    return found["bm25"].withColumn("mode", F.lit("bm25")).unionByName(found["vector"].withColumn("mode", F.lit("vector")))


@R.add(f"""with {bm25_list(5)}, {vector_list(5)}, {EXPECTED},
l as (select 'bm25' as mode, qid, doc_id, rank from bm union all select 'vector', qid, doc_id, rank from vec),
m as (select 'bm25' as mode union all select 'vector'),
r as (select m.mode, e.lang, coalesce(1.0 / rank, 0.0) as rr from expected e cross join m left join l on l.mode = m.mode and l.qid = e.qid and l.doc_id = e.expect_chunk),
p as (select lang, round(avg(rr) filter (mode = 'bm25'), 6) as bm25, round(avg(rr) filter (mode = 'vector'), 6) as vector from r group by lang)
select lang as type, bm25, vector, round((bm25 - vector) * 100, 4) as points from p""")
def strategy_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = expected(spark, sf_dir).withColumnRenamed("lang", "type")
    report = metrics.hit_report(golden, _two_modes(spark, sf_dir), ["bm25", "vector"]).where("type is not null")
    return metrics.compare(report, "mrr", ["bm25", "vector"])


@R.add(f"""with {bm25_list(10)}, w as (select qid, list(doc_id order by rank) filter (rank in (1, 4)) as want from bm group by qid),
g as (select qid, list(doc_id) filter (rank <= 3) as got from bm group by qid)
select w.qid, case when len(list_intersect(want, got)) = len(want) then 1.0::double else 0.0::double end as multi_all, round(len(list_intersect(want, got)) / len(want), 6) as recall from w join g using (qid)""")
def multi_all_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected are the hits at ranks 1 and 4, of which the first three hold one or both."""
    found = bm(spark, sf_dir, 10)
    golden = found.where(F.col("rank").isin(1, 4)).groupBy("qid").agg(F.collect_list("doc_id").alias("expect_chunks"))
    return metrics.multi_hit(golden, found, 3)


def every_twentieth(docs: DataFrame) -> DataFrame:
    """Every vector whose number is divisible by 20, as a query against all."""
    return docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vector")


@R.add()
def ivf_recall_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vecs(spark, sf_dir)
    return vectors.sweep(docs, every_twentieth(docs), [8, 16], [1, 2, 4, 6])


@R.add()
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hits of each query in 12 of 16 clusters of the stored index: (qid, doc_id, rank, score, codes, vectors), the last two
    what the query took."""
    docs = vecs(spark, sf_dir)
    hits, read = vectors.probe_ivf(vectors.store_ivf(docs, 16), every_twentieth(docs), 10, 12)
    return hits.join(read, "qid")


@R.add()
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of ``ivf_search`` against exact search, and the bytes of vectors that it read, codes and vectors, over those of
    all vectors: a code is a quarter of its vector."""
    docs = vecs(spark, sf_dir)
    queries = every_twentieth(docs)
    hits, read = vectors.probe_ivf(vectors.store_ivf(docs, 16), queries, 10, 12)
    share = vectors.recall(hits, vectors.topk(docs, queries, 10), 10).agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 4).alias("recall"))
    took = read.agg(F.avg("codes").alias("codes"), F.avg("vectors").alias("vectors")).crossJoin(docs.agg(F.count("*").alias("n")))
    bytes_read = F.round((F.col("codes") / 4 + F.col("vectors")) / F.col("n"), 4)
    return share.crossJoin(took).select("queries", "recall", F.round(F.col("codes") / F.col("n"), 4).alias("codes_share"), F.round(F.col("vectors") / F.col("n"), 4).alias("vectors_share"), bytes_read.alias("bytes_share"))


@R.add()
def ivf_bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.bucket_stats(vectors.store_ivf(vecs(spark, sf_dir), 16).rows(), 16)


@R.add(f"""with {bm25_list(5)}, t as (select bm.qid, min(score) filter (rank = 1) as top from bm group by qid),
k as (select t.qid, top, case when e.qid is null then 'out' else 'in' end as kind from t left join expected_ids e using (qid)),
o as (select kind, top, row_number() over (partition by kind order by top) - 1 as rn, count(*) over (partition by kind) as n from k)
select kind, any_value(n) as n, min(top) as lowest, max(top) as highest, max(top) filter (rn = least(n - 1, greatest(0, cast(round_even(0.5 * (n - 1), 0) as bigint)))) as p50 from o group by kind""".replace("expected_ids e", "(select distinct item_id as qid from benchmark b join documents d on contains(d.text, b.text) where length(b.text) >= 24) e"))
def gate_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top scores of questions whose text a document holds, and of the others."""
    held = expected(spark, sf_dir).select("qid", F.lit("in").alias("kind"))
    top = bm(spark, sf_dir, 5).where("rank = 1").join(held, "qid", "left").select(F.coalesce("kind", F.lit("out")).alias("kind"), F.col("score").alias("value"))
    return metrics.calibration(top)


@R.add(f"""with {HYBRID}, top as (select * from hybrid where rank <= 5), n as (select qid, count(*) as n from top group by qid),
g as (select item_id as qid, coalesce(n, 0) as n, coalesce(case when vector_score is not null then vector_score >= 0.40 when bm25_score is not null then bm25_score >= 8.0 end, false) as passed,
  case when vector_score is null and bm25_score is null then 'no hits' when vector_score < 0.40 then 'vector' when vector_score is null and bm25_score < 8.0 then 'bm25' end as failed_on
  from benchmark left join top on item_id = top.qid and rank = 1 left join n on n.qid = item_id)
select qid, n::int as hits_count, not passed or qid % 3 <> 1 as abstained, case when not passed then 'gate: ' || failed_on when qid % 3 = 0 then 'no source' when qid % 3 = 2 then 'no output' else '' end as abstain_reason,
  case when passed and qid % 3 = 1 then 'See [2] and [9], also [2].' end as answer, case when passed and qid % 3 = 1 and n >= 2 then '2' else '' end as used,
  case when passed and qid % 3 = 1 then case when n >= 2 then '9' else '2,9' end else '' end as unsupported from g""")
def batch_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions searched, gated and answered: a third of the generators give an answer, a third none, a third nothing."""
    asked = questions(spark, sf_dir).select("qid")
    text = F.when(F.col("qid") % 3 == 0, "**NO_ANSWER**\nno source").when(F.col("qid") % 3 == 1, "See [2] and [9], also [2].").otherwise("")
    rows = answer.ask(asked, hybrid(spark, sf_dir, 5), asked.withColumn("text", text))
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<int>")), ",")
    return rows.select("qid", "hits_count", "abstained", "abstain_reason", F.when(~F.col("abstained"), F.col("answer")).alias("answer"), joined("used").alias("used"), joined("unsupported").alias("unsupported"))


@R.add("select vec_id as qid, true as near from embeddings order by md5('7-' || vec_id), vec_id limit 20")
def noisy_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty vectors by seed with a little noise added, and whether each still points where its own does."""
    docs = vecs(spark, sf_dir)
    made = vectors.noisy_queries(docs, 20, 0.02).withColumnRenamed("vector", "q")
    return made.join(docs, made["qid"] == docs["doc_id"]).select("qid", ((vectors.cosine(F.col("q"), F.col("vector")) > 0.9) & (F.abs(vectors.norm(F.col("q")) - 1) < 1e-5)).alias("near"))
