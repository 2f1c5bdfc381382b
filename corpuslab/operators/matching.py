"""Many words looked for in many texts: one automaton over a dictionary, one scan of each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of words that one automaton holds, of which it makes up to about thirty times as many; a larger dictionary takes
#: more scans. Bytes of text that are turned into Python strings at a time.
BLOCK_BYTES, STRETCH_BYTES = 4 << 20, 4 << 20


def stretches(size: int, rows: int) -> Iterator[tuple[int, int]]:
    """First row and end of the parts of a batch of ``size`` bytes that are Python objects at a time."""
    step = max(1, STRETCH_BYTES * rows // max(1, size))
    for at in range(0, rows, step):
        yield at, min(at + step, rows)


class Automaton:
    """Words by number, put together once in each Python worker."""

    def __init__(self, words: list[str]):
        self.words, self.made = words, None

    def held(self, text: str | None) -> list[int]:
        """The numbers of the words that a text holds, each once."""
        if self.made is None:
            self.made = ahocorasick.Automaton()
            for i, word in enumerate(self.words):
                if word:
                    self.made.add_word(word, i)
            if len(self.made):
                self.made.make_automaton()
        found = {i for _, i in self.made.iter(text)} if text and len(self.made) else set()
        if text is not None:
            found.update(i for i, word in enumerate(self.words[:1]) if not word)
        return sorted(found)


def _blocks(words: DataFrame) -> Iterator[list[str]]:
    """Distinct words, sorted, in blocks of BLOCK_BYTES at most, read one at a time; the empty one, if any, is first."""
    block, size = [], 0
    for (word,) in words.select("word").where("word is not null").distinct().orderBy("word").toLocalIterator():
        if block and size + len(word.encode()) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(word)
        size += len(word.encode())
    if block:
        yield block


def _scan(shared: Broadcast):
    @F.arrow_udf("array<int>")
    def scanned(column: pa.Array) -> pa.Array:
        rows = (shared.value.held(t) for at, end in stretches(column.nbytes, len(column)) for t in column.slice(at, end - at).to_pylist())
        return pa.array(rows, pa.list_(pa.int32()))

    return scanned


def _found(texts: DataFrame, words: DataFrame, text: str) -> DataFrame | None:
    """``texts`` with __word, a row for each distinct word (column word of ``words``) that a text holds."""
    spark, found = texts.sparkSession, None
    for block in _blocks(words):
        scanned = _scan(spark.sparkContext.broadcast(Automaton(block)))
        place = spark.createDataFrame(list(enumerate(block)), "__place int, __word string")
        part = texts.withColumn("__place", F.explode(scanned(F.col(text)))).join(F.broadcast(place), "__place").drop("__place")
        found = part if found is None else found.unionByName(part)
    return found


def holding(texts: DataFrame, words: DataFrame, text: str = "text") -> DataFrame:
    """Pairs of a row of ``texts`` and a row of ``words`` (key, word) whose word its text contains, as it is written:
    the columns of texts, and key. Texts are scanned once for each block of words; a text's words are found in one
    pass, however many there are. The empty word is in every text but null; null words are in none."""
    found = _found(texts, words, text)
    if found is None:
        return texts.limit(0).join(words.select("key").limit(0))
    return found.join(words.select("key", F.col("word").alias("__word")), "__word").drop("__word")


def counts(texts: DataFrame, words: DataFrame, text: str = "text") -> DataFrame:
    """(word, docs): the rows of ``texts`` that hold each distinct word of ``words``; words in none are left out."""
    found = _found(texts.select(text), words, text)
    if found is None:
        return texts.sparkSession.createDataFrame([], "word string, docs long")
    return found.groupBy(F.col("__word").alias("word")).agg(F.count("*").alias("docs"))
