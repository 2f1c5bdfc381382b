"""Raw pages to documents: URLs, parsing, length gate, exact dedup, summaries."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, urlsplit, urlunsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from corpuslab.functions import markup
from corpuslab.functions.text import estimated_tokens, matches, plain_text, squeezed, unescaped
from corpuslab.operators.matching import stretches
from corpuslab.operators.metrics import floor_rank, ranked_values
from corpuslab.sources.session import stored

MIN_CHARS = 300
#: A sitemap's places and a Markdown text's links (fixed values).
LOC, LINK = r"<loc>(.*?)</loc>", r"\((https?://[^)\s]+)\)"
#: File endings that are no pages (fixed values).
ASSETS = (".css", ".js", ".png", ".jpg", ".svg", ".ico", ".woff")
PARSED = (
    "title string, doc_type string, text string, raw_chars int, sections array<struct<heading:string,path:array<string>,text:string>>,"
    " tables array<struct<heading:string,markdown:string>>, code_blocks array<struct<heading:string,lang:string,code:string>>, reason string"
)


def discover(indexes: DataFrame, kind: str) -> DataFrame:
    """(source, pos, url) from index texts (source, text): the locations of a `sitemap`, else Markdown links."""
    return indexes.select("source", F.posexplode(matches(F.col("text"), LOC if kind == "sitemap" else LINK, 1)).alias("pos", "url"))


def normalise_urls(urls: DataFrame, keep: Column | None = None, drop_md: bool = False) -> DataFrame:
    """(source, url, doc_id) without fragments, optionally without a final .md, filtered, the first of each kept."""
    url = F.regexp_replace("url", "#.*$", "")
    rows = urls.withColumn("url", F.regexp_replace(url, r"\.md$", "") if drop_md else url)
    rows = rows.where(keep) if keep is not None else rows
    first = Window.partitionBy("source", "url").orderBy("pos")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.select("source", "pos", "url", doc_id(F.col("url")).alias("doc_id"))


def doc_id(url: Column) -> Column:
    return F.substring(F.sha1(url.cast("binary")), 1, 12)


def encoded_path(url: Column) -> Column:
    """A URL with its path percent-encoded; what is already encoded is kept."""

    def encode(value: str) -> str:
        parts = urlsplit(value)
        return urlunsplit(parts._replace(path=quote(parts.path, safe="/%")))

    @F.pandas_udf("string")
    def encoded(urls: pd.Series) -> pd.Series:
        return urls.map(encode, na_action="ignore")

    return encoded(url)


def page_stats(pages: DataFrame, least: int = 500) -> DataFrame:
    """Per source of (source, html): pages, usable ones (of ``least`` characters of text) and their mean length,
    rounded down."""
    n = F.length(plain_text(F.col("html")))
    usable = n >= least
    mean = F.floor(F.sum(F.when(usable, n)) / F.count_if(usable))
    return pages.groupBy("source").agg(F.count("*").alias("pages"), F.count_if(usable).alias("usable"), F.coalesce(mean, F.lit(0)).cast("long").alias("avg_chars"))


def links(pages: DataFrame, base: Column, prefix: str = "/") -> DataFrame:
    """(page_id, url): distinct absolute links of pages (page_id, html) whose path begins with ``prefix``, assets left out."""
    found = pages.select("page_id", base.alias("base"), F.explode(matches(F.col("html"), r'href="(/[^"#?]*)"', 1)).alias("path"))
    asset = F.lit(False)
    for end in ASSETS:
        asset = asset | F.col("path").endswith(end)
    return found.where(F.col("path").startswith(prefix) & ~asset).select("page_id", F.concat("base", "path").alias("url")).distinct()


def title(page: Column, url: Column, suffix: str | None = None) -> Column:
    """A page's <title> without the site's suffix, else its first h1, else the URL's last segment."""
    named = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)
    named = F.regexp_replace(named, rf"\s*[-|_]\s*(?:{suffix}).*$", "") if suffix else named
    h1 = F.regexp_replace(F.regexp_extract(page, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", "")
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(filled(named), filled(h1), F.substring_index(url, "/", -1))


def parse(pages: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """Pages (doc_id, source, url, body, kind) as documents with sections, tables and code, or a reject reason.

    kind is html, escaped (markup inside a script string) or markdown. A text of fewer than ``least``
    characters without white space is built anew with its code inlined, as a reference; if that is short
    too, the page is rejected. A row may come with a reason of its own, which stays. Pages are parsed a few MB at a time,
    however many rows a batch has."""
    given = [c for c in pages.columns if c in ("doc_id", "source", "url", "reason")]
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in given if c != "reason")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in stretches(batch.nbytes, batch.num_rows):
                part = batch.slice(at, end - at)
                read = lambda c: part.column(c).to_pylist() if c in part.schema.names else [None] * part.num_rows  # noqa: B023, E731
                made = [_parsed(*row, least) for row in zip(read("body"), read("markup"), read("kind"), read("url"), read("reason"))]
                shown = [pa.array(values, kind) for values, kind in zip(zip(*made), types)]
                kept = [c for c in part.schema.names if c not in ("body", "markup", "kind", "reason")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *shown], [*kept, *names])

    names, types = zip(*((f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(PARSED)))
    plain = F.when(F.col("kind") == "escaped", unescaped(F.col("body"))).otherwise(F.col("body")).alias("markup")
    docs = pages.select(*given, "body", plain, "kind").mapInArrow(run, f"{kinds}, {PARSED}")
    stats = F.struct(F.size("sections").alias("n_sections"), F.size("tables").alias("n_tables"), F.size("code_blocks").alias("n_code_blocks"))
    return docs.withColumn("n_chars", F.length("text")).withColumn("n_tokens_est", estimated_tokens(F.col("text"))).withColumn("stats", stats)


def _parsed(body: str | None, plain: str | None, kind: str, url: str | None, reason: str | None, least: int) -> tuple:
    def rejected(why: str) -> tuple:
        return None, None, None, None, [], [], [], why

    if isinstance(reason, str):
        return rejected(reason)
    if body is None:
        return rejected("file missing")
    items = markup.markdown_items(plain) if kind == "markdown" else markup.html_items(plain)
    for doc_type, inline in (("tutorial", False), ("reference", True)):
        built = markup.structure(items, inline)
        if doc_type == "tutorial":
            short = len(built["text"])
        if len("".join(built["text"].split())) >= least:
            h1 = next((i["text"] for i in items if i["type"] == "h" and i["level"] == 1), "")
            named = h1
            if kind != "markdown" and (m := markup.re.search(r"(?is)<title[^>]*>(.*?)</title>", body)):
                named = markup.html.unescape(m[1]).strip() or h1
            return named or (url or "").rsplit("/", 1)[-1], doc_type, built["text"], len(built["text"]), built["sections"], built["tables"], built["code_blocks"], None
    return rejected(f"too short ({short} characters < {least})")


def exact_dedup(docs: DataFrame, text_col: str = "text", order: str = "pos") -> DataFrame:
    """docs (url, ``order``, ``text_col``) with a reason for those whose text without white space came earlier:
    the winner's URL. Digests are grouped with map-side minima, so a hot text is no hot task, and those that
    occur again are stored: Spark sends a short list to the rows, and shuffles both sides by digest beyond that."""
    keyed = docs.withColumn("__digest", F.md5(squeezed(F.coalesce(text_col, F.lit(""))).cast("binary")))
    first = keyed.groupBy("__digest").agg(F.min(F.struct(F.col(order).alias("o"), F.col("url").alias("u"))).alias("__first"), F.count("*").alias("__n"))
    first = stored(first.where("__n > 1").drop("__n"))
    late = F.col(order) > F.col("__first.o")
    why = F.when(late, F.concat(F.lit("same text as "), F.col("__first.u")))
    return keyed.join(first, "__digest", "left").withColumn("reason", why).drop("__digest", "__first")


def corpus_summary(docs: DataFrame) -> DataFrame:
    """Per source and in all (source null) of (source, reason, n_chars, n_tokens_est, stats): accepted, rejected, mean
    length rounded down, tables, code blocks, tokens. Sources with nothing accepted are listed too."""
    good = F.col("reason").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(good, c)), F.lit(0)).cast("long")
    mean = F.coalesce(F.floor(F.sum(F.when(good, F.col("n_chars"))) / F.count_if(good)), F.lit(0)).cast("long")
    return docs.rollup("source").agg(
        F.count_if(good).alias("accepted"),
        F.count_if(~good).alias("rejected"),
        mean.alias("avg_chars"),
        total(F.col("stats.n_tables")).alias("tables"),
        total(F.col("stats.n_code_blocks")).alias("code_blocks"),
        total(F.col("n_tokens_est")).alias("tokens"),
    )


def reason_histogram(docs: DataFrame) -> DataFrame:
    """Reject reasons, each cut at its first bracket, and their numbers, most first."""
    head = F.trim(F.split("reason", r"[（(]")[0])
    return docs.where("reason is not null").groupBy(head.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def length_distribution(docs: DataFrame, value: str = "n_chars") -> DataFrame:
    """10th, 50th and 90th percentile by floor rank, and the largest."""
    at = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    return ranked_values(docs, value).agg(F.max("n").alias("n"), *(floor_rank(value, q).alias(p) for p, q in at.items()), F.max(value).alias("max"))


def sample_document(docs: DataFrame) -> DataFrame:
    """The document of most tables, of these the longest."""
    return docs.orderBy(F.desc("stats.n_tables"), F.desc("n_chars"), "doc_id").limit(1)
