"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import spare, stored, stretches

WINDOW = 10
#: Words of benchmark text that one automaton may hold, which bounds its memory (measured: about 200 MB).
#: A larger benchmark is scanned for in blocks, one after another.
BLOCK_WORDS = 120_000
#: Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased; all else parts them.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
#: A word of the benchmark is a pair of characters in the automaton's texts, from two alphabets of DIGITS
#: each, so that no node has many children and no match starts inside a word; OTHER is any other word.
DIGITS, OTHER = 400, "\x01\x01"
FINDINGS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
HIT = "struct<n_words:bigint,starts:array<int>,ends:array<int>,items:array<string>>"


def normalise(text: bytes | None) -> list[bytes]:
    """The words of a text as UTF-8."""
    return (text or b"").translate(FOLD).split()


def _pair(i: int) -> str:
    return chr(2 + i // DIGITS) + chr(2 + DIGITS + i % DIGITS)


class Scanner:
    """The automaton, built once in each Python worker from items' words, each word a pair of characters."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.items, self.automaton = items, None

    def build(self) -> None:
        self.pairs: dict[bytes, str] = {}
        known: dict[str, set[str]] = {}
        for item, line in self.items:
            words = line.split()
            for w in words:
                if w not in self.pairs:
                    self.pairs[w] = _pair(len(self.pairs))
            text = "".join(map(self.pairs.__getitem__, words))
            for i in range(max(1, len(words) - WINDOW + 1)):
                known.setdefault(text[2 * i : 2 * (i + WINDOW)], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for window, found in known.items():
            self.automaton.add_word(window, (len(window) // 2, found))
        if known:
            self.automaton.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[int] | None, list[int] | None, list[str] | None]:
        """Words, the ranges of word positions that occurrences cover, and the items that occur, null without
        any. The text is normalised and scanned once; half a position in the scanned line is that of a word."""
        if self.automaton is None:
            self.build()
        words = normalise(text)
        if not words or not len(self.automaton):
            return len(words), None, None, None
        get = self.pairs.get
        hits = list(self.automaton.iter("".join([get(w, OTHER) for w in words])))
        if not hits:
            return len(words), None, None, None
        ends = [(e + 1) // 2 for e, _ in hits]
        return len(words), [e - n for e, (_, (n, _)) in zip(ends, hits)], ends, sorted(set().union(*(i for _, (_, i) in hits)))


def _parts(rows: Iterator) -> Iterator[tuple[str, bytes, int]]:
    """Items as (id, words, number of words); a long one in parts that hold its windows whole."""
    for item, text in rows:
        words = normalise(bytes(text))
        most = max(1, BLOCK_WORDS - WINDOW)
        for at in range(0, max(1, len(words) - WINDOW + 1), most):
            part = words[at : at + most + WINDOW - 1]
            if part:
                yield item, b" ".join(part), len(part)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of BLOCK_WORDS words at most, read one item at a time."""
    block, held = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.encode("text", "UTF-8")).where("text is not null and item_id is not null")
    for item, part, size in _parts(rows.toLocalIterator()):
        if block and held + size > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((item, part))
        held += size
    yield block


def _scanned(shared) -> Column:
    @F.arrow_udf(HIT)
    def scanned(texts: pa.Array) -> pa.Array:
        rows = [shared.value.scan(t) for part in stretches(texts) for t in part.to_pylist()]
        kinds = (("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string())))
        columns = [pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)]
        return pa.StructArray.from_arrays(columns, names=[n for n, _ in kinds])

    return scanned(F.encode("text", "UTF-8"))


def _hits(docs: DataFrame, benchmark: DataFrame, name: str) -> DataFrame:
    """``docs`` with the column ``name``: an array of HIT, one for each block that was scanned for or, of several,
    for each with an occurrence; null without any.

    One block, the usual case, needs no shuffle. More blocks are scanned for one after another: each pass
    broadcasts its automaton's items, writes the few texts with hits, by 128 bits of the text, and
    frees them, so neither driver nor worker holds two; the findings are then joined by text."""
    blocks = _blocks(benchmark)
    first, second = next(blocks), next(blocks, None)
    spread = docs.sparkSession.sparkContext.broadcast
    if second is None:
        return docs.withColumn(name, F.array(_scanned(spread(Scanner(first)))))
    found, keyed = None, docs.select(F.md5("text").alias("__text"), "text")
    for block in (b for some in ([first, second], blocks) for b in some):
        shared = spread(Scanner(block))
        some = stored(keyed.select("__text", _scanned(shared).alias("hit")).where("hit.items is not null").dropDuplicates(["__text"]))
        shared.destroy()
        found = some if found is None else found.unionByName(some)
    (key,) = spare(docs, "__text")
    found = found.groupBy("__text").agg(F.collect_list("hit").alias(name)).withColumnRenamed("__text", key)
    return docs.withColumn(key, F.md5("text")).join(found, key, "left").drop(key)


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside any occurrence of a window), n_items and
    items_sha256 of the items that occur, and contaminated (n_hit > 0). Columns of these names are
    replaced, all others stay.

    Null texts have no words, and null items no windows; an item that repeats counts once; repeated
    documents are judged each. An empty benchmark hits nothing; an empty table gives no rows."""
    (hits,) = spare(docs, "__hits")
    out = _hits(docs, benchmark, hits)
    all_of = lambda name: F.flatten(F.transform(F.filter(hits, lambda h: h["items"].isNotNull()), lambda h: h[name]))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    items = F.coalesce(F.array_sort(F.array_distinct(all_of("items"))), F.array().cast("array<string>"))
    return (
        out.withColumn("n_words", F.coalesce(F.get(hits, F.lit(0))["n_words"], words))
        .withColumn("n_hit", F.coalesce(_covered(all_of("starts"), all_of("ends")), F.lit(0).cast("long")))
        .withColumn("n_items", F.size(items).cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join(items, ",").cast("binary"), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
        .drop(hits)
    )


def _covered(starts: Column, ends: Column) -> Column:
    """Integers in the union of the ranges [start, end)."""
    ranges = F.array_sort(F.arrays_zip(starts.alias("s"), ends.alias("e")))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda a, r: F.struct((a["n"] + F.greatest(r["e"] - F.greatest(r["s"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], r["e"]).alias("to"))
    return F.aggregate(ranges, zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and the findings of ``scan`` for every document."""
    return scan(docs.select("doc_id", "text"), benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns.

    Null and empty texts stay, repeated rows are judged each; an empty table gives no rows."""
    own = [c for c in FINDINGS if c in docs.columns]
    aside = dict(zip(own, spare(docs, *(f"__{c}" for c in own))))
    clean = scan(docs.withColumnsRenamed(aside), benchmark).where(~F.col("contaminated")).drop(*FINDINGS)
    return clean.withColumnsRenamed({b: a for a, b in aside.items()}).select(*docs.columns)
