"""Documents to chunks, and what the chunks are worth."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import chunks as cut
from corpuslab.operators.matching import stretches
from corpuslab.operators.metrics import floor_rank, ranked_values
from corpuslab.sources.session import stored

STRATEGIES = ("fixed", "recursive", "structural", "atomic")
PARENT_CHARS, CHILD_CHARS, CHILD_STEP = 1000, 1000, 900
#: Length classes, lower bound inclusive (fixed values).
BUCKETS = ((0, "<100"), (100, "100–300"), (300, "300–500"), (500, "500–800"), (800, "800–1500"), (1500, ">1500"))


def windows(text: Column, size: int, step: int) -> Column:
    """A text's windows of ``size`` characters, one each ``step``; the last may lie inside the one before."""
    starts = F.sequence(F.lit(1), F.length(text), F.lit(max(1, step)))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def chunk(docs: DataFrame, strategy: str, size: int = 500, overlap: int | None = None) -> DataFrame:
    """docs (doc_id, text[, sections, code_blocks]) with an array of chunks, `pieces`. ``overlap`` is a tenth of the size
    unless given. Fixed windows are expressions; the others work on Arrow batches."""
    overlap = size // 10 if overlap is None else overlap
    if strategy == "fixed":
        return docs.withColumn("pieces", windows(F.coalesce("text", F.lit("")), size, size - overlap))
    if strategy == "recursive":
        return docs.withColumn("pieces", _each(lambda text: cut.recursive(text, size, overlap))(F.coalesce("text", F.lit(""))))
    if strategy == "structural":
        texts = F.transform("sections", lambda s: F.coalesce(s["text"], F.lit("")))
        return docs.withColumn("pieces", _each(lambda parts: cut.structural(parts, size, overlap))(texts))
    if strategy == "atomic":

        atomic = _each(lambda text, blocks: cut.atomic(text, blocks, size, overlap))
        code = F.transform("code_blocks", lambda b: F.coalesce(b["code"], F.lit(""))) if "code_blocks" in docs.columns else F.array().cast("array<string>")
        return docs.withColumn("pieces", atomic(F.coalesce("text", F.lit("")), F.coalesce(code, F.array().cast("array<string>"))))
    raise ValueError(f"strategy {strategy!r} is none of {STRATEGIES}")


def _each(function: Callable):
    """``function`` of one row's values as a column function; STRETCH_BYTES of a batch are Python objects at a time."""

    @F.arrow_udf("array<string>")
    def apply(*columns: pa.Array) -> pa.Array:
        n, made = len(columns[0]), [pa.array([], pa.list_(pa.string()))]
        for at, end in stretches(sum(c.nbytes for c in columns), n):
            rows = zip(*(c.slice(at, end - at).to_pylist() for c in columns))
            made.append(pa.array([[] if row[0] is None else function(*row) for row in rows], pa.list_(pa.string())))
        return pa.concat_arrays(made)

    return apply


class Pieces:
    """A table function: the pieces of one text, a row each."""

    def eval(self, strategy: str, text: str, sections: list, code: list, size: int, overlap: int):  # noqa: A003
        if strategy == "fixed":
            made = [text[at : at + size] for at in range(0, len(text), max(1, size - overlap))]
        elif strategy == "recursive":
            made = cut.recursive(text, size, overlap)
        elif strategy == "structural":
            made = cut.structural(list(sections), size, overlap)
        else:
            made = cut.atomic(text, list(code), size, overlap)
        yield from enumerate(made)


def pieces(docs: DataFrame, strategy: str, size: int = 500, overlap: int | None = None) -> DataFrame:
    """``docs`` with pos and piece, a row for each piece of ``chunk``: the same pieces by a table function and a lateral
    join, for use from SQL and where the pieces of a text should not be held as one array. Texts without a piece have
    no row."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is none of {STRATEGIES}")
    overlap = size // 10 if overlap is None else overlap
    part = lambda c, field: F.transform(c, lambda s: F.coalesce(s[field], F.lit(""))) if c in docs.columns else F.array().cast("array<string>")
    plain = docs.withColumns({"__text": F.coalesce("text", F.lit("")), "__sections": part("sections", "text"), "__code": F.coalesce(part("code_blocks", "code"), F.array().cast("array<string>"))})
    cutter = F.udtf(Pieces, returnType="pos: int, piece: string", useArrow=True)
    given = [F.lit(strategy), *(F.col(c).outer() for c in ("__text", "__sections", "__code")), F.lit(size), F.lit(overlap)]
    return plain.lateralJoin(cutter(*given)).drop("__text", "__sections", "__code")


def build(docs: DataFrame) -> DataFrame:
    """docs with pieces to chunk rows: chunk_id (position among all pieces, blank ones too), role, parent_id, text,
    n_chars, vectorize, section_path. A chunk over PARENT_CHARS becomes a parent that is not vectorised and
    children of overlapping windows; blank children are skipped without renumbering."""
    kept = [c for c in ("doc_id", "source", "title", "url", "doc_type", "sections") if c in docs.columns]
    rows = docs.select(*kept, F.posexplode("pieces").alias("i", "text")).where(F.trim("text") != "")
    number = F.when(F.col("i") < 10000, F.lpad(F.col("i").cast("string"), 4, "0")).otherwise(F.col("i").cast("string"))
    rows = rows.withColumn("chunk_id", F.concat_ws("-", F.col("doc_id").cast("string"), number))
    path = section_of(F.col("sections"), F.col("text")) if "sections" in kept else F.array().cast("array<string>")
    rows = rows.withColumn("section_path", path).drop("sections", "i")
    long = F.length("text") > PARENT_CHARS
    none = F.lit(None).cast("string")
    own = rows.select("*", F.when(long, "parent").otherwise("normal").alias("role"), none.alias("parent_id"), (~long).alias("vectorize"))
    parts = rows.where(long).select("*", F.posexplode(windows(F.col("text"), CHILD_CHARS, CHILD_STEP)).alias("j", "part")).where(F.trim("part") != "")
    child = F.concat(F.col("chunk_id"), F.lit("-c"), F.when(F.col("j") < 100, F.lpad(F.col("j").cast("string"), 2, "0")).otherwise(F.col("j").cast("string")))
    children = parts.withColumn("parent_id", F.col("chunk_id")).withColumn("chunk_id", child).withColumn("text", F.col("part")).drop("j", "part")
    children = children.withColumn("role", F.lit("child")).withColumn("vectorize", F.lit(True))
    return own.unionByName(children).withColumn("n_chars", F.length("text"))


def section_of(sections: Column, text: Column) -> Column:
    """The path of the first section that holds the chunk's first 30 characters, else an empty one."""
    head = F.trim(F.left(text, F.lit(30)))
    found = F.get(F.filter(sections, lambda s: (head != "") & F.contains(s["text"], head)), F.lit(0))
    return F.coalesce(found["path"], F.array().cast("array<string>"))


def resolve_parents(chunks: DataFrame) -> DataFrame:
    """Chunks with the text to show: the parent's for a child, else their own."""
    parents = chunks.where("role = 'parent'").select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"))
    return chunks.join(parents, "parent_id", "left").withColumn("shown", F.coalesce("parent_text", "text")).drop("parent_text")


#: A table's separator row (fixed value).
SEPARATOR = r"^\s*\|[\s:|-]+\|\s*$"


def has_table(piece: Column) -> Column:
    return F.exists(F.split(piece, "\n"), lambda line: F.trim(line).startswith("|"))


def broken_table(piece: Column) -> Column:
    """Whether a chunk has table lines, but the next line after the first that is not blank is no separator row."""
    lines = F.transform(F.split(piece, "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    first = F.get(F.filter(lines, lambda x: F.trim(x["line"]).startswith("|")), F.lit(0))
    after = F.get(F.filter(lines, lambda x: (x["i"] > first["i"]) & (F.trim(x["line"]) != "")), F.lit(0))
    return first.isNotNull() & ~F.coalesce(after["line"].rlike(SEPARATOR), F.lit(False))


def broken_code(docs: DataFrame) -> DataFrame:
    """docs (pieces, code_blocks, doc_type) with code_n, the code blocks of 20 characters or more of reference
    documents, and code_bad, those of them that the pieces, joined by line ends, do not hold."""
    joined = F.array_join("pieces", "\n")
    known = F.filter(F.transform("code_blocks", lambda b: F.trim(b["code"], F.lit(" \n\t\r"))), lambda c: F.length(c) >= cut.LEAST_CODE)
    known = F.when(F.col("doc_type") == "reference", known).otherwise(F.array().cast("array<string>"))
    return docs.withColumn("code_n", F.size(known)).withColumn("code_bad", F.size(F.filter(known, lambda c: ~F.contains(joined, c))))


def crossings(docs: DataFrame) -> DataFrame:
    """docs (pieces, sections) with `cross`: the pieces that, laid end to end, reach into two sections or more, which
    lie two characters apart. Borders are looked up among sorted ends."""

    @F.pandas_udf("int")
    def crossing(pieces: pd.Series, sections: pd.Series) -> pd.Series:
        out = []
        for p, s in zip(pieces, sections):
            p, s = np.array(p, np.int64), np.array(s, np.int64)
            s = s[s > 0]
            piece_end, section_end = np.cumsum(p), np.cumsum(s + 2) - 2
            begun = np.searchsorted(section_end - s, piece_end, side="left")
            over = np.searchsorted(section_end, piece_end - p, side="right")
            out.append(int((begun - over >= 2).sum()))
        return pd.Series(out)

    return docs.withColumn("cross", crossing(F.transform("pieces", F.length), F.transform("sections", lambda s: F.coalesce(F.length(s["text"]), F.lit(0)))))


def audit(docs: DataFrame, strategy: str) -> DataFrame:
    """One row on the chunks of docs (pieces, sections, code_blocks, doc_type): number, length percentiles, shares of
    short ones (< 200), crossing ones and broken tables and code, number of oversized ones (> 1500). The documents
    are cut once, for a stored table of what is counted."""
    about = F.transform("pieces", lambda p: F.struct(F.length(p).alias("len"), has_table(p).alias("t"), broken_table(p).alias("b")))
    checked = stored(broken_code(crossings(docs)).select("code_n", "code_bad", "cross", about.alias("about")))
    per_doc = checked.agg(F.sum("code_n").alias("code_n"), F.sum("code_bad").alias("code_bad"), F.sum("cross").alias("cross"))
    pieces = checked.select(F.inline("about"))
    rows = pieces.agg(F.count("*").alias("n_chunks"), F.count_if(F.col("len") < 200).alias("short"), F.count_if(F.col("len") > 1500).alias("oversized"), F.count_if("t").alias("table_n"), F.count_if("b").alias("table_bad"))
    spread = ranked_values(pieces, "len").agg(floor_rank("len", 0.5).alias("p50"), floor_rank("len", 0.9).alias("p90"), F.max("len").alias("max"))
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    cross = F.lit(0.0) if strategy == "structural" else share("cross", "n_chunks")
    joined = rows.crossJoin(spread).crossJoin(per_doc)
    return joined.select(
        F.lit(strategy).alias("strategy"), "n_chunks", "p50", "p90", "max", share("short", "n_chunks").alias("short_rate"), "oversized", cross.alias("cross_rate"),
        share("table_bad", "table_n").alias("table_broken"), "table_n", share("code_bad", "code_n").alias("code_broken"), "code_n",
    )


def histogram(pieces: DataFrame) -> DataFrame:
    """Number and share of chunks (strategy, text) in each length class, by strategy."""
    n, label = F.length("text"), F.lit(None).cast("string")
    for low, name in BUCKETS:
        label = F.when(n >= low, name).otherwise(label)
    counts = pieces.groupBy("strategy", label.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("strategy")), 6))
