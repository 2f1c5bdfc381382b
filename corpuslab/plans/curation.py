"""Question sets made of `documents`, `benchmark`, `labels` and `conversations`.

A document stands in for a question: its source is one of three platforms by number, its type follows
from its number, and its first sentence is what it asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import answer, curate, metrics
from corpuslab.plans.registry import Registry
from corpuslab.sources.tables import table

R = Registry()

SOURCES = ("p0", "p1", "p2")
TYPES = tuple(curate.TARGETS)
TYPE = "case when doc_id % 10 < 4 then 'term' when doc_id % 10 < 7 then 'semantic' when doc_id % 10 = 7 then 'multi' when doc_id % 10 = 8 then 'boundary' else 'conflict' end"
GOLDEN = f"golden as (select doc_id, 'q' || doc_id as qid, left(text, 60) as question, 'p' || (doc_id % 7 % 3) as expect_source, {TYPE} as type from documents)"


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = F.col("doc_id") % 10
    kind = F.when(digit < 4, "term").when(digit < 7, "semantic").when(digit == 7, "multi").when(digit == 8, "boundary").otherwise("conflict")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("qid"), F.left("text", F.lit(60)).alias("question"),
        F.concat(F.lit("p"), (F.col("doc_id") % 7 % 3).cast("string")).alias("expect_source"), kind.alias("type"),
    )


@R.add(f"with {GOLDEN} select expect_source as source, type, count(*) as n, round(count(*) / (select count(*) from golden), 6) as share from golden group by cube (expect_source, type)")
def distribution_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.distribution(golden(spark, sf_dir))


@R.add(f"""with {GOLDEN}, t as (select count(*) as t from golden), s as (select unnest(['p0', 'p1', 'p2', 'p9']) as subject),
b as (select s.subject, round(count(golden.doc_id) / any_value(t), 6) as share from s left join golden on expect_source = s.subject, t group by s.subject)
select 'hard' as rule, null as subject, round(count(*) filter (type in ('multi', 'boundary', 'conflict')) / count(*), 6) as share from golden having count(*) filter (type in ('multi', 'boundary', 'conflict')) / count(*) < 0.3
union all select 'type', type, round(count(*) / any_value(t), 6) from golden, t group by type having count(*) / any_value(t) > 0.5
union all select case when share < 0.25 then 'source_low' else 'source_high' end, subject, share from b where share < 0.25 or share > 0.45""")
def skew_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.alarms(golden(spark, sf_dir), (*SOURCES, "p9"))


@R.add(f"with {GOLDEN}, g as (select source, type from (select unnest(['p0', 'p1', 'p2', 'p9']) as source) cross join (select unnest(['term', 'semantic', 'multi', 'boundary', 'conflict', 'rare']) as type)) select * from g where (source, type) not in (select expect_source, type from golden)")
def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.missing_cells(golden(spark, sf_dir), (*SOURCES, "p9"), (*TYPES, "rare"))


@R.add(f"""with {GOLDEN}, t(type, n) as (values ('term', 50.0), ('semantic', 30.0), ('multi', 15.0), ('boundary', 15.0), ('conflict', 10.0)), h as (select type, count(*) as have from golden group by type),
r as (select type, cast(round_even(n * 8.5, 0) as bigint) as target, coalesce(have, 0) as have from t left join h using (type)) select *, greatest(target - have, 0) as gap from r""")
def quota_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.gaps(golden(spark, sf_dir), scale=8.5)


@R.add(f"""with {GOLDEN}, have as (select type, count(*) as n from golden where doc_id % 50 = 0 group by type), t(type, n) as (values ('term', 50), ('semantic', 30), ('multi', 15), ('boundary', 15), ('conflict', 10)),
d as (select *, row_number() over (partition by type order by doc_id) as place from golden where doc_id % 50 <> 0)
select qid, d.type from d join t using (type) left join have using (type) where place <= greatest(t.n - coalesce(have.n, 0), 0)""")
def quota_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = golden(spark, sf_dir).withColumn("pos", F.col("doc_id"))
    return curate.fill_quota(rows.where("doc_id % 50 <> 0"), rows.where("doc_id % 50 = 0")).select("qid", "type")


NORMAL = "trim(regexp_replace(coalesce(text, ''), '\\s+', '', 'g'), '?？.。')"


@R.add(f"""with {GOLDEN}, n as (select doc_id, 'q' || doc_id as qid, {NORMAL} as q from documents), f as (select *, min(doc_id) over (partition by q) as first from n where doc_id % 4 <> 0)
select qid from f where doc_id = first and q not in (select q from n where doc_id % 4 = 0)""")
def draft_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as questions: a fourth of them is there already, the others are drafts."""
    rows = golden(spark, sf_dir).withColumns({"pos": F.col("doc_id"), "question": F.coalesce("text", F.lit(""))})
    return curate.fresh_drafts(rows.where("doc_id % 4 <> 0"), rows.where("doc_id % 4 = 0")).select("qid")


@R.add(f"with {GOLDEN} select qid, type, doc_id % 3 <> 0 as added from golden")
def append_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the questions is there already; all of them come again."""
    rows = golden(spark, sf_dir).select("qid", "type", (F.col("doc_id") % 3 != 0).alias("added"))
    return curate.append_unseen(rows.where("not added"), rows)


@R.add("""with d as (select doc_id, source, row_number() over (partition by source order by md5('42-' || doc_id), doc_id) as place from documents)
select doc_id, source, cast(place as int) as place from d order by place, source limit 60""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.stratified(table(spark, sf_dir, "documents").select("doc_id", "source"), 60, "doc_id")


@R.add("""with n as (select source, row_number() over (order by source) - 1 as i from (select distinct source from documents)),
r as (select d.source, doc_id, i, row_number() over (partition by d.source order by md5('42-' || doc_id), doc_id) as place from documents d join n using (source))
select cast(a.place as int) as place, a.source as source_a, a.doc_id as a, b.source as source_b, b.doc_id as b from r a join r b on a.i % 2 = 0 and b.i = a.i + 1 and a.place = b.place""")
def cross_source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.cross_pairs(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


@R.add("""with c as (select doc_id, trim(left(text, 40)) as q, case when doc_id % 4 = 0 then '有哪些？' when doc_id % 4 = 1 then '?' when doc_id % 4 = 2 then '' else '有哪些 <div？' end as tail, doc_id % 5 as kw from documents),
d as (select doc_id, trim(q || tail) as q, kw from c)
select doc_id, case when q = '' then 'empty' when length(q) < 10 then 'short' when length(q) > 60 then 'long' when not (ends_with(q, '？') or ends_with(q, '?')) then 'no question mark'
 when not regexp_matches(q, '(什么|如何|怎么|多少|哪|是否|会不会|有哪些|为什么|能否|几)') then 'asks nothing' when regexp_matches(q, '(className|<div|</?[a-z]+>|function\\s*\\(|=>|margin-|padding-|#[0-9a-fA-F]{6})') then 'code' when kw < 2 then 'few keywords' end as reason from d""")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(F.lit("有哪些？"), F.lit("?"), F.lit(""), F.lit("有哪些 <div？")), (F.col("doc_id") % 4 + 1).cast("int"))
    words = F.slice(F.array(*map(F.lit, "abcde")), 1, (F.col("doc_id") % 5).cast("int"))
    rows = table(spark, sf_dir, "documents").withColumn("q", F.concat(F.trim(F.left("text", F.lit(40))), tail))
    return rows.select("doc_id", curate.quality(F.col("q"), words).alias("reason"))



@R.add()
def keyword_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: its second word, its fourth and fifth run together, its sixth and seventh with a comma and
    another dash between, its eighth to tenth without what parts them, and a word that it does not hold."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x09-\x0D\x20]+"), lambda w: w != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.slice(words, 1, 10).alias("w"))
    at = lambda i: F.get("w", F.lit(i - 1))
    joined = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else at(p) for p in parts))
    kws = F.array_compact(F.array(at(2), joined(4, 5), joined(6, ", ", 7), F.translate(joined(6, "–", 7), "-", "~"), joined(8, 9, 10), F.lit("zzqqzz")))
    asked = rows.select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("qid"), F.col("doc_id").alias("expect_chunk"), kws.alias("expect_any"))
    return curate.repair_keywords(asked, rows.select(F.col("doc_id").alias("chunk_id"), "text")).select("qid", "expect_any")


@R.add(f"""with {GOLDEN}, v as (select *, doc_id % 13 <> 0 as there, doc_id % 5 = 0 as bad_member, doc_id % 6 = 0 as no_kw from golden)
select qid, there as kept, case when not there then 'no expect_chunk' when bad_member then 'missing members' when no_kw then 'no keywords' end as problem from v""")
def draft_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    name = d.cast("string")
    rows = golden(spark, sf_dir).select("qid", F.when(d % 13 == 0, F.concat(F.lit("x"), name)).otherwise(name).alias("expect_chunk"), F.array(F.when(d % 5 == 0, F.concat(F.lit("x"), name)).otherwise(name)).alias("expect_chunks"), F.when(d % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("k"))).alias("expect_any"))
    return curate.validated(rows, table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"))).select("qid", "kept", "problem")


@R.add(f"""with {GOLDEN}, used as (select doc_id as n from golden where doc_id % 4 = 1),
d as (select qid, row_number() over (order by doc_id) as k from golden where doc_id % 10 = 0), f as (select i, row_number() over (order by i) as k from range(1, (select count(*) * 2 + max(doc_id) from golden)) t(i) where i not in (select n from used))
select qid as draft, 'm' || case when i < 1000 then lpad(cast(i as varchar), 3, '0') else cast(i as varchar) end as qid from d join f using (k)""")
def fresh_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = golden(spark, sf_dir)
    used = rows.where("doc_id % 4 = 1").select(F.concat(F.lit("m"), F.when(F.col("doc_id") < 1000, F.lpad(F.col("doc_id").cast("string"), 3, "0")).otherwise(F.col("doc_id").cast("string"))).alias("qid"))
    drafts = rows.where("doc_id % 10 = 0").select(F.col("doc_id").alias("pos"), F.col("qid").alias("draft"))
    return curate.new_ids(drafts, used).select("draft", "qid")


@R.add("select doc_id from documents where length(text) between 80 and 1200 and doc_id % 5 <> 0 and doc_id % 7 <> 0")
def candidate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of fitting length that no question expects: those divisible by 5 or 7 are."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "text", F.lit("normal").alias("role"))
    asked = chunks.where("doc_id % 5 = 0").select(F.col("chunk_id").alias("expect_chunk"), F.array(((F.floor(F.col("doc_id") / 5)) * 7).cast("string")).alias("expect_chunks"))
    asked = asked.unionByName(chunks.where("doc_id % 7 = 0").select(F.col("chunk_id").alias("expect_chunk"), F.lit(None).cast("array<string>").alias("expect_chunks")))
    return curate.candidates(chunks, asked).select("doc_id")


@R.add("""select 'qid unique' as rule, cast(count(*) as bigint) as violations from (select text from documents group by text having count(*) > 1)
union all select 'chunk exists', count(*) from documents where doc_id % 11 = 0
union all select 'keyword in chunk', count(*) from documents where doc_id % 11 <> 0 and doc_id % 3 = 0
union all select 'multi has two', count(*) from documents where doc_id % 10 = 7 and doc_id % 2 = 1""")
def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as ids, so copies break the first rule; every eleventh chunk is missing, a third of the keywords is foreign."""
    d = F.col("doc_id")
    kw = F.when(d % 3 == 0, F.array(F.lit("zzqqzz"))).otherwise(F.array(F.left("text", F.lit(5))))
    rows = golden(spark, sf_dir).select(F.md5(F.col("text").cast("binary")).alias("qid"), d.alias("expect_chunk"), kw.alias("expect_any"), "type", F.array(d).alias("expect_chunks"))
    chunks = table(spark, sf_dir, "documents").where("doc_id % 11 <> 0").select(F.col("doc_id").alias("chunk_id"), "text", F.lit(True).alias("vectorize"))
    return curate.integrity(rows, chunks)


# Answers and judges.


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What assistants say, and two citations put after."""
    turns = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") % 4
    cited = F.concat("text", F.lit(" ["), (n + 1).cast("string"), F.lit("] and ["), (n * 3 + 1).cast("string"), F.lit("] ["), (n + 1).cast("string"), F.lit("]"))
    return turns.where("role = 'assistant'").withColumn("answer", cited)


ANSWERS = """t as (select *, coalesce(string_agg(text, ' ') over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), '') as before from conversations),
a as (select *, text || ' [' || (conv_id % 4 + 1) || '] and [' || (conv_id % 4 * 3 + 1) || '] [' || (conv_id % 4 + 1) || ']' as answer from t where role = 'assistant')"""


@R.add(f"""with {ANSWERS}, e as (select conv_id, turn, before, list_distinct(regexp_extract_all(regexp_replace(answer, '\\[\\d{{1,2}}\\]', ' ', 'g'), '[A-Za-z][A-Za-z0-9_.\\-]{{2,}}|\\d+(?:\\.\\d+)?%?')) as named from a)
select conv_id, turn, round(case when len(named) = 0 then 1.0 else len(list_filter(named, lambda x: contains(before, x))) / len(named) end, 6) as floor from e""")
def faithfulness_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the turns before an answer as its context."""
    return answer.floors(table(spark, sf_dir, "conversations"), answers(spark, sf_dir)).withColumn("floor", F.round("floor", 6))


@R.add(f"""with {ANSWERS}, n as (select conv_id, turn, list_distinct([conv_id % 4 + 1, conv_id % 4 * 3 + 1]) as named from a)
select conv_id, turn, list_sort(list_filter(named, lambda x: x <= 5)) as used, list_sort(list_filter(named, lambda x: x > 5)) as unsupported from n""")
def citations_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Both numbers rise with conv_id % 4, so sorted order is that of first occurrence.
    cited = answer.citations(F.col("answer"), F.lit(5))
    bigger = lambda c: F.transform(c, lambda x: x.cast("long"))
    return answers(spark, sf_dir).select("conv_id", "turn", cited.alias("c")).select("conv_id", "turn", bigger(F.col("c.used")).alias("used"), bigger(F.col("c.unsupported")).alias("unsupported"))


@R.add("""select conv_id, turn, conv_id % 3 <> 2 as abstained, case conv_id % 3 when 0 then 'no output' when 1 then 'lacks ' || turn else '' end as reason, case when conv_id % 3 = 2 then length(trim(text)) else 0 end as n_chars from conversations""")
def answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third empty texts, a third that give the mark and a reason, a third answers."""
    text = F.when(F.col("conv_id") % 3 == 0, "").when(F.col("conv_id") % 3 == 1, F.concat(F.lit("**NO_ANSWER** \nlacks "), F.col("turn").cast("string"))).otherwise(F.col("text"))
    parsed = table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.parse_answer(text).alias("p"))
    return parsed.select("conv_id", "turn", "p.abstained", "p.reason", F.length("p.answer").cast("long").alias("n_chars"))


@R.add("select source, round(coalesce(avg(case when doc_id % 6 <> 0 then quality end), 0.0), 4) as mean, count(case when doc_id % 6 <> 0 then quality end) as valid, cast(count(*) - count(case when doc_id % 6 <> 0 then quality end) as bigint) as failed from labels join documents using (doc_id) group by source")
def verdict_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as judge texts, every sixth of them unreadable."""
    said = F.when(F.col("doc_id") % 6 == 0, "maybe").when(F.col("quality") == 1, "Yes.").otherwise("NO, it is not")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return metrics.verdict_mean(rows.withColumn("v", metrics.verdict(said)), "source", "v")


@R.add("""with l as (select doc_id, case doc_id % 4 when 0 then 1.0 when 1 then 0.5 when 2 then 0.0 end as v from labels), g as (select doc_id % 10 as qid, v from l)
select qid, round(coalesce(avg(v), 0.0), 4) as mean, count(v) as valid, cast(count(*) - count(v) as bigint) as failed from g group by qid""")
def relevancy_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(F.lit("same"), F.lit("It is PARTIAL"), F.lit("not same but different"), F.lit("?")), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 10).alias("qid"), metrics.relevancy(said).alias("v"))
    return metrics.verdict_mean(rows, "qid", "v")


@R.add("""with l as (select conv_id, turn, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls from conversations where role = 'assistant'),
c as (select conv_id, turn, case when trim(text) = '' then 0 when length(trim(text)) <= 20 then 1 else len(ls) end as n from l) select conv_id, turn, cast(n as bigint) as n from c""")
def statement_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their lines as a judge's list."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    split = F.array_join(F.transform(F.split("text", "\n"), lambda s, i: F.concat(F.when(i % 2 == 0, "- ").otherwise(F.concat((i % 90 + 1).cast("string"), F.lit(". "))), s)), "\n")
    said = metrics.statements(rows.select(F.struct("conv_id", "turn").alias("qid"), F.col("text").alias("answer"), split.alias("split_text")))
    return said.groupBy("qid").agg(F.count("statement").alias("n")).select("qid.conv_id", "qid.turn", "n")


@R.add("""with k as (select doc_id % 3 as kind, doc_id, quality, toxic from labels) select case kind when 0 then 'out' when 1 then 'gap' when 2 then 'in' end as kind, count(*) as n, round(avg(case when quality = toxic then 1.0 else 0.0 end), 6) as accuracy, cast(count(*) filter (doc_id % 2 = 0) as bigint) as free from k group by rollup (kind)""")
def abstain_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("out"), F.lit("gap"), F.lit("in")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "labels").select(kind.alias("kind"), F.col("quality").alias("expect"), F.col("toxic").alias("got"), (F.col("doc_id") % 2 == 0).alias("at_gate"))
    return metrics.abstain_report(rows)


@R.add(f"""with {ANSWERS}, e as (select conv_id, before, conv_id % 4 * 3 + 1 > 5 as wrong, list_distinct(regexp_extract_all(regexp_replace(answer, '\\[\\d{{1,2}}\\]', ' ', 'g'), '[A-Za-z][A-Za-z0-9_.\\-]{{2,}}|\\d+(?:\\.\\d+)?%?')) as named from a where conv_id % 7 <> 0)
select count(*) as n, round(avg(case when wrong then 1.0 else 0.0 end), 6) as wrong_rate, round(avg(case when len(named) = 0 then 1.0 else len(list_filter(named, lambda x: contains(before, x))) / len(named) end), 6) as floor from e""")
def citation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = answers(spark, sf_dir)
    rows = said.withColumn("c", answer.citations(F.col("answer"), F.lit(5))).join(answer.floors(table(spark, sf_dir, "conversations"), said), ["conv_id", "turn"])
    rows = rows.select((F.col("conv_id") % 7 == 0).alias("abstained"), "c.used", "c.unsupported", "floor")
    return metrics.citation_report(rows)


@R.add("""with r as (select doc_id, quality::double as recall, case when doc_id % 3 = 0 then toxic::double end as multi_all, doc_id % 5 = 0 as abstained, doc_id % 97 * 1.5 as latency_ms, doc_id % 7 * 0.001 as cost from labels),
o as (select latency_ms as value, row_number() over (order by latency_ms) - 1 as rn, count(*) over () as n from r)
select count(*) as n, round(avg(recall), 6) as recall, round(avg(multi_all), 6) as multi_all, round(avg(case when abstained then 1.0 else 0.0 end), 6) as abstain_rate, round(avg(cost * 3), 6) as cost_avg, round(sum(cost * 3), 6)::double as cost_cny,
 (select max(value) filter (rn = cast(round_even(0.5 * (n - 1), 0) as bigint)) from o)::double as p50, (select max(value) filter (rn = cast(round_even(0.95 * (n - 1), 0) as bigint)) from o)::double as p95, max(latency_ms)::double as max from r""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as evaluation rows."""
    d = F.col("doc_id")
    cost, none = (d % 7) * 0.001, F.lit(None).cast("double")
    rows = table(spark, sf_dir, "labels").select(
        F.col("quality").cast("double").alias("recall"), F.when(d % 3 == 0, F.col("toxic").cast("double")).alias("multi_all"), (d % 5 == 0).alias("abstained"), ((d % 97) * 1.5).alias("latency_ms"),
        *(cost.alias(f"cost_{p}_cny") for p in ("retrieve", "ask", "judge")), (cost * 3).alias("cost_cny"), *(none.alias(c) for c in ("faithfulness", "answer_relevancy", "context_recall")),
    )
    return metrics.summary(rows).select("n", "recall", "multi_all", "abstain_rate", "cost_avg", "cost_cny", "p50", "p95", "max")


@R.add("""with d as (select doc_id, text, len(list_distinct([doc_id % 3, doc_id % 2])) as several, length(regexp_replace(text, '[^0-9]', '', 'g')) as digits from documents)
select doc_id, case when doc_id % 5 = 0 or several < 2 or doc_id % 7 = 0 then 0.0 else case when length(text) between 150 and 600 then 3.0 when length(text) < 150 then 1.0 else 1.5 end + case when digits >= 4 then 2.0 else 0.0 end + 2.0 + 1.5 end::double as points from d where text is not null""")
def demo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers that cite two sources, in a third of cases the same."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").alias("answer"), (d % 5 == 0).alias("abstained"), F.array(d % 3, d % 2).alias("sources"), F.when(d % 7 == 0, F.array(F.lit(9))).otherwise(F.array().cast("array<int>")).alias("unsupported"))
    return answer.pick_score(rows).select("doc_id", "points")


@R.add("""with g as (select doc_id % 40 as question, count(*) as n, count(*) filter (doc_id % 40 % 4 <> 0 or toxic = 0) as n_abstain, count(*) filter (doc_id % 40 % 3 = 0) as n_model, avg(length('reason number ' || doc_id)) as chars from labels group by 1)
select question, case when n_abstain < n then 0.0 else case when n_model = n then 4.0 when n_model = 0 then 1.5 else 0.5 end + case when chars >= 17 then case when chars >= 20 then 1.5 else 0.0 end else 0.0 end end::double as points from g""")
def abstain_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("doc_id") % 40
    rows = table(spark, sf_dir, "labels").select(q.alias("question"), ((q % 4 != 0) | (F.col("toxic") == 0)).alias("abstained"), (q % 3 == 0).alias("at_model"), F.concat(F.lit("reason number "), F.col("doc_id").cast("string")).alias("reason"))
    return answer.abstain_stability(rows).select("question", "points")
