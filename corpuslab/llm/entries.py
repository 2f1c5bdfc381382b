"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslab.llm.audit import filter_audit
from corpuslab.llm.decontaminate import contamination
from corpuslab.llm.embeddings import near_duplicates as near_vectors
from corpuslab.llm.langid import language_id
from corpuslab.llm.licenses import license_scan
from corpuslab.llm.packing import pack
from corpuslab.llm.pii import personal_data
from corpuslab.llm.resample import scored
from corpuslab.llm.sharding import shard_documents
from corpuslab.llm.simhash import near_duplicates
from corpuslab.llm.suffixes import removal
from corpuslab.llm.tokens import count_tokens
from corpuslab.llm.warc import round_trip

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def tokenizer() -> str:
    """The path of the tokenizer file that token counts are of."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op5_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, path or tokenizer()).drop("text")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OPERATORS = (
    op1_language_id,
    op2_personal_data,
    op3_embedding_dedup,
    op4_packing,
    op5_token_counts,
    op6_suffix_dedup,
    op7_decontamination,
    op8_sharding,
    op9_simhash,
    op10_license_scan,
    op11_warc,
    op12_filter_audit,
    op13_importance_resampling,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op3_embedding_dedup": """with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select vec_id as a, vec_id as b from v union select reach.a, links.b from reach join links on reach.b = links.a),
n as (select a, count(*) as n from links group by a), c as (select a, min(b) as c from reach group by a)
select vec_id, coalesce(n, 0) as n_links, c as component_id, vec_id = c as kept from v left join n on n.a = vec_id join c on c.a = vec_id""",
    "op7_decontamination": f"""with d as (select doc_id, {WORDS} as w from documents), b as (select item_id, {WORDS} as w from benchmark),
win as (select distinct item_id, least(10, len(w)) as size, array_to_string(w[i:i + 9], ' ') as s from (select *, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)),
place as (select doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') as s from (select doc_id, size, w, unnest(range(1, len(w) - size + 2)) as p from d, (select distinct size from win))),
found as (select doc_id, item_id, p, size from place join win using (size, s)),
hit as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(p, p + size)) as x from found) group by doc_id),
item as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as names from (select distinct doc_id, item_id::varchar as i from found) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join item using (doc_id)""",
    "op11_warc": """with p as (select page_id, coalesce(html, '') as h from pages), q as (select page_id, h, strlen(h) as b, max(page_id) over (partition by h) as top from p)
select page_id, b as payload_bytes, sha1(h) as payload_digest, case when b >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
  case when b >= 1000 and page_id < top then top end as refers_to from q""",
    "op12_filter_audit": r"""with recursive t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
f as (select doc_id, part, (case when len(w) < 50 then 'A' else '' end) || (case when 100 * len(list_distinct(w)) < 65 * len(w) then 'B' else '' end)
  || (case when 100 * len(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * len(x) then 'C' else '' end) || (case when regexp_matches(x, '[#$%&*|]') then 'D' else '' end)
  || (case when min(doc_id) over (partition by x) < doc_id then 'E' else '' end) as fails from t),
c as (select part, fails, count(*) as n, count(*) filter (where quality = 1) as good, count(*) filter (where toxic = 1) as bad from f left join labels using (doc_id) group by part, fails),
o as (select '' as s union all select s || l from o, (select unnest(['A', 'B', 'C', 'D', 'E']) as l) where not contains(s, l)), orders as (select s as filter_order from o where len(s) = 5),
g as (select part, fails, n, good, bad, filter_order, (select min(i) from range(1, 6) r(i) where contains(fails, filter_order[i])) as gone from c, orders),
s as (select part, filter_order, step, filter_order[step] as filter, sum(case when gone is null or gone > step then n else 0 end)::bigint as kept, sum(case when gone = step then n else 0 end)::bigint as removed,
  sum(case when gone < step and contains(fails, filter_order[step]) then n else 0 end)::bigint as redundant, sum(case when fails = filter_order[step] then n else 0 end)::bigint as unique_fails,
  sum(case when gone = step then good else 0 end)::bigint as good_lost, sum(case when gone = step then bad else 0 end)::bigint as toxic_lost
  from g, (select unnest(range(1, 6)) as step) group by part, filter_order, step)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, filter))::bigint as shapley from s""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
