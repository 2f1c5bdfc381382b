"""Corpus building over `pages` and `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.text import collapse, plain_text
from corpuslab.operators import chunk, parse
from corpuslab.plans.registry import Registry
from corpuslab.sources import tables
from corpuslab.sources.session import stored
from corpuslab.sources.tables import table

R = Registry()

PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>', ' ', 'gs'), '<style.*?</style>', ' ', 'gs'), '<[^>]+>', ' ', 'gs'), '\s+', ' ', 'g'))"
SOURCE = r"regexp_extract(url, '^https?://([^/]+)', 1)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as fetched: the host stands in as source, the body as HTML."""
    return table(spark, sf_dir, "pages").withColumn("source", F.regexp_extract("url", "^https?://([^/]+)", 1))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).select(parse.doc_id(F.col("url")).alias("doc_id"), "source", "url", F.col("html").alias("body"), F.lit("html").alias("kind"))
    return parse.parse(rows)


def as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` with paragraphs as sections and lines of pipes as code, so that every chunker has work."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    parts = F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")
    sections = F.transform(parts, lambda s, i: F.struct(F.concat(F.lit("s"), i.cast("string")).alias("heading"), F.array(F.concat(F.lit("s"), i.cast("string"))).alias("path"), s.alias("text")))
    code = F.transform(F.filter(parts, lambda s: F.contains(s, F.lit("|"))), lambda s: F.struct(F.lit("").alias("heading"), F.lit("").alias("lang"), s.alias("code")))
    return docs.withColumns({"sections": sections, "code_blocks": code, "doc_type": F.when(F.size(code) > 0, "reference").otherwise("tutorial")})


@R.add(f"select page_id, length({PLAIN}) as n_chars, md5({PLAIN}) as text_md5 from pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = plain_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5"))


@R.add(f"""select distinct page_id, regexp_extract(url, '^https?://[^/]+') || path as url from (select page_id, url, unnest(regexp_extract_all(html, 'href="(/[^"#?]*)"', 1)) as path from pages)
where not regexp_matches(path, '\\.(css|js|png|jpg|svg|ico|woff)$')""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.links(table(spark, sf_dir, "pages"), F.regexp_extract("url", "^https?://[^/]+", 0))


@R.add("""select source, url, substring(sha1(url), 1, 12) as doc_id from (select regexp_extract(url, '^https?://([^/]+)', 1) as source, regexp_replace(url, '#.*$', '') as url, page_id as pos from pages)
where not ends_with(url, '.html') group by all""")
def page_doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = pages(spark, sf_dir).select("source", F.col("page_id").alias("pos"), "url")
    return parse.normalise_urls(urls, ~F.col("url").endswith(".html")).drop("pos")


@R.add("""with l as (select regexp_extract(url, '^https?://([^/]+)', 1) as source, regexp_replace(url, '#.*$', '') as url from pages)
select source, url, substring(sha1(url), 1, 12) as doc_id from l group by all""")
def url_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index texts for each source, sitemaps made of its pages' URLs, read back. As sitemaps are, each is bounded:
    a source's URLs are dealt by hash, so that one of any number of pages has texts of about 20,000 at most."""
    entry = F.concat(F.lit("<url><loc>"), F.col("url"), F.lit("</loc></url>"))
    rows = pages(spark, sf_dir)
    parts = max(1, -(-rows.count() // 20_000))
    index = rows.groupBy("source", F.pmod(F.xxhash64("url"), F.lit(parts)).alias("part")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").alias("text"))
    return parse.normalise_urls(parse.discover(index, "sitemap")).drop("pos")


@R.add(r"""with t as (select page_id, url, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) as t,
 trim(regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 'is'), '<[^>]+>', '', 'g')) as h from pages)
select page_id, coalesce(nullif(t, ''), nullif(h, ''), split_part(url, '/', -1)) as title from t""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", parse.title(F.col("html"), F.col("url")).alias("title"))


@R.add(f"""select {SOURCE} as source, count(*) as pages, cast(count(*) filter (length({PLAIN}) >= 500) as bigint) as usable,
 cast(coalesce(floor(avg(length({PLAIN})) filter (length({PLAIN}) >= 500)), 0) as bigint) as avg_chars from pages group by 1""")
def usable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.page_stats(pages(spark, sf_dir))


@R.add(f"""select {SOURCE} as source, count(*) as total, cast(count(*) filter (page_id % 7 <> 0) as bigint) as ok, cast(count(*) filter (page_id % 7 = 0) as bigint) as failed,
 cast(coalesce(floor(avg(length(html)) filter (page_id % 7 <> 0)), 0) as bigint) as avg_bytes from pages group by rollup ({SOURCE})""")
def fetch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of the pages; every seventh fetch has failed."""
    manifest = pages(spark, sf_dir).select("source", F.when(F.col("page_id") % 7 == 0, 404).otherwise(200).alias("status"), F.length("html").alias("bytes"))
    return tables.fetch_summary(manifest)


@R.add()
def page_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("doc_id", "source", "url", "title", "doc_type", "n_chars", "n_tokens_est", "stats", "text", "reason")


@R.add()
def parse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.corpus_summary(parsed(spark, sf_dir))


@R.add()
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.reason_histogram(parsed(spark, sf_dir))


@R.add()
def sample_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.sample_document(parsed(spark, sf_dir).where("reason is null")).select("doc_id", "title", "n_chars")


URLS = "(select doc_id, 'doc/' || doc_id as url, md5(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) as digest from documents)"


@R.add(f"select doc_id, case when doc_id > first then 'same text as doc/' || first end as reason from (select doc_id, min(doc_id) over (partition by digest) as first from {URLS})")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.exact_dedup(_listed(spark, sf_dir), order="doc_id").select("doc_id", "reason")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), "text")


#: A document as a page: its words in one paragraph, so the page's text is the document's with white space collapsed.
GATED = r"""(select doc_id, source, n, case when length(replace(flat, ' ', '')) < 300 then 'too short (' || n || ' characters < 300)' when doc_id > first then 'same text as doc/' || first end as reason, flat as text
 from (select *, length(flat) as n, min(doc_id) over (partition by length(replace(flat, ' ', '')) < 300, replace(flat, ' ', '')) as first
  from (select doc_id, source, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[<>&]', ' ', 'g'), '[\x09-\x0D\x1C-\x20\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) as flat from documents)))"""


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages of one paragraph, parsed, with reject reasons: too short, or a copy of one accepted."""
    body = F.concat(F.lit("<html><body><p>"), F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&]", " "), F.lit("</p></body></html>"))
    url = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    pages = table(spark, sf_dir, "documents").select("doc_id", "source", url.alias("url"), body.alias("body"), F.lit("html").alias("kind"))
    parsed = stored(parse.parse(pages))
    accepted = parse.exact_dedup(parsed.where("reason is null"), order="doc_id")
    return accepted.unionByName(parsed.where("reason is not null"))


@R.add(f"select doc_id, source, reason from {GATED} where reason is not null")
def rejected_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).where("reason is not null").select("doc_id", "source", "reason")


@R.add(f"select trim(split_part(case when starts_with(reason, 'same') then 'same text' else reason end, '(', 1)) as reason, count(*) as n from {GATED} where reason is not null group by 1")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gated(spark, sf_dir).withColumn("reason", F.when(F.col("reason").startswith("same"), "same text").otherwise(F.col("reason")))
    return parse.reason_histogram(rows)


@R.add(f"""select source, cast(count(*) filter (reason is null) as bigint) as accepted, cast(count(*) filter (reason is not null) as bigint) as rejected,
 cast(coalesce(floor(avg(n) filter (reason is null)), 0) as bigint) as avg_chars from {GATED} group by rollup (source)""")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.corpus_summary(gated(spark, sf_dir)).select("source", "accepted", "rejected", "avg_chars")


@R.add("""with o as (select length(text) as n_chars, row_number() over (order by length(text)) - 1 as rn, count(*) over () as n from documents where text is not null)
select any_value(n) as n, max(n_chars) filter (rn = least(n - 1, floor(n * 0.1))) as p10, max(n_chars) filter (rn = least(n - 1, floor(n * 0.5))) as p50,
 max(n_chars) filter (rn = least(n - 1, floor(n * 0.9))) as p90, max(n_chars) as max from o""")
def length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.length_distribution(table(spark, sf_dir, "documents").select(F.length("text").cast("long").alias("n_chars")))


@R.add("""select doc_id, cast(i as int) as pos, md5(substring(text, 1 + i * 450, 500)) as piece_md5 from (select doc_id, text, unnest(range(0, cast(ceil(length(text) / 450.0) as bigint))) as i from documents)""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunk.chunk(table(spark, sf_dir, "documents"), "fixed", 500, 50)
    return docs.select("doc_id", F.posexplode("pieces").alias("pos", "p")).select("doc_id", "pos", F.md5(F.col("p").cast("binary")).alias("piece_md5"))


PARENTS = r"""p as (select doc_id, i, substring(text, 1 + i * 1800, 2000) as text from (select doc_id, text, unnest(range(0, cast(ceil(length(text) / 1800.0) as bigint))) as i from documents)),
r as (select doc_id || '-' || lpad(cast(i as varchar), 4, '0') as chunk_id, text from p where trim(text) <> ''),
c as (select chunk_id as parent_id, chunk_id || '-c' || lpad(cast(j as varchar), 2, '0') as chunk_id, substring(text, 1 + j * 900, 1000) as text
  from (select *, unnest(range(0, cast(ceil(length(text) / 900.0) as bigint))) as j from r where length(text) > 1000)),
chunks as (select chunk_id, case when length(text) > 1000 then 'parent' else 'normal' end as role, cast(null as varchar) as parent_id, text from r
  union all select chunk_id, 'child', parent_id, text from c where trim(text) <> '')"""


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.build(chunk.chunk(table(spark, sf_dir, "documents"), "fixed", 2000, 200))


@R.add(f"with {PARENTS} select chunk_id, role, parent_id, md5(text) as text_md5, cast(length(text) as int) as n_chars, role <> 'parent' as vectorize from chunks")
def chunk_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).select("chunk_id", "role", "parent_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("n_chars").cast("int").alias("n_chars"), "vectorize")


@R.add(f"with {PARENTS} select a.chunk_id, md5(coalesce(b.text, a.text)) as shown_md5 from chunks a left join chunks b on a.parent_id = b.chunk_id")
def small_to_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.resolve_parents(built(spark, sf_dir)).select("chunk_id", F.md5(F.col("shown").cast("binary")).alias("shown_md5"))


@R.add(f"""with {PARENTS} select cast(count(*) filter (role <> 'parent') > 0 as boolean) as ready, count(distinct split_part(chunk_id, '-', 1)) as n_docs, count(*) as n_chunks,
 cast(count(*) filter (role <> 'parent') as bigint) as n_vectorized, cast(count(*) filter (role = 'parent') as bigint) as n_parents, cast(count(*) filter (role = 'child') as bigint) as n_children, (select string_agg(distinct source, ',' order by source) from documents) as sources from chunks""")
def index_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.snapshot(built(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


@R.add("""with p as (select 'fixed' as strategy, substring(text, 1 + i * 450, 500) as t from (select text, unnest(range(0, cast(ceil(length(text) / 450.0) as bigint))) as i from documents)),
b as (select strategy, case when length(t) < 100 then '<100' when length(t) < 300 then '100–300' when length(t) < 500 then '300–500' when length(t) < 800 then '500–800' when length(t) < 1500 then '800–1500' else '>1500' end as bucket from p)
select strategy, bucket, count(*) as n, round(count(*) / sum(count(*)) over (partition by strategy), 6) as share from b group by 1, 2""")
def chunk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunk.chunk(table(spark, sf_dir, "documents"), "fixed", 500, 50)
    return chunk.histogram(docs.select(F.lit("fixed").alias("strategy"), F.explode("pieces").alias("text")))


def _pieces(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    docs = chunk.chunk(as_documents(spark, sf_dir), strategy)
    return docs.select("doc_id", F.posexplode("pieces").alias("pos", "p")).select("doc_id", "pos", F.length("p").alias("n_chars"), F.md5(F.col("p").cast("binary")).alias("piece_md5"))


@R.add()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, "recursive")


@R.add()
def chunk_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, "atomic")


@R.add()
def chunk_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, "structural")


@R.add("select doc_id, md5(regexp_replace(text, '\\s+', '', 'g')) as whole_md5 from documents where text is not null and regexp_matches(text, '\\S')")
def chunk_recursive_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the recursive chunks hold when laid end to end, white space apart: the whole text."""
    docs = chunk.chunk(as_documents(spark, sf_dir), "recursive", 500, 0).where(F.size("pieces") > 0)
    return docs.select("doc_id", F.md5(F.regexp_replace(F.array_join("pieces", ""), r"(?U)\s+", "").cast("binary")).alias("whole_md5"))


@R.add()
def chunk_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = as_documents(spark, sf_dir), None
    for strategy in chunk.STRATEGIES:
        part = chunk.audit(chunk.chunk(docs, strategy), strategy)
        out = part if out is None else out.unionByName(part)
    return out


@R.add(r"""with d as (select doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as parts from documents where text is not null),
c as (select doc_id, i, parts, substring(text, 1 + i * 450, 500) as piece from (select *, unnest(range(0, cast(ceil(length(text) / 450.0) as bigint))) as i from d)),
f as (select *, list_position(list_transform(parts, lambda x: contains(x, trim(left(piece, 30)))), true) as place from c)
select doc_id, i as pos, case when trim(left(piece, 30)) <> '' and place > 0 then 's' || (place - 1) else '' end as section from f""")
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraph of each window of 500 characters: the first that holds its first 30."""
    docs = chunk.chunk(as_documents(spark, sf_dir), "fixed", 500, 50)
    rows = docs.select("doc_id", "sections", F.posexplode("pieces").alias("pos", "piece"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_join(chunk.section_of(F.col("sections"), F.col("piece")), "/").alias("section"))


@R.add(r"""select page_id, regexp_extract(url, '^https?://[^/?#]+') || '/%C3%A4%20b%20c/' || page_id || '?q=ü x' as url from pages""")
def encoded_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with letters to encode and some that are encoded; queries stay as they are."""
    url = F.concat(F.regexp_extract("url", r"^https?://[^/?#]+", 0), F.lit("/ä b%20c/"), F.col("page_id").cast("string"), F.lit("?q=ü x"))
    return table(spark, sf_dir, "pages").select("page_id", parse.encoded_path(url).alias("url"))


@R.add()
def chunk_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strategies by the table function: (strategy, doc_id, pos, piece_md5)."""
    docs, found = as_documents(spark, sf_dir), None
    for strategy in chunk.STRATEGIES:
        part = chunk.pieces(docs, strategy).select(F.lit(strategy).alias("strategy"), "doc_id", "pos", F.md5(F.col("piece").cast("binary")).alias("piece_md5"))
        found = part if found is None else found.unionByName(part)
    return found
