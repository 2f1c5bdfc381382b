"""Language identification, word first: known words by per-language log frequency, unseen words by
the longest known character n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import spare, stored, stretches

#: Labelled documents that a model is fitted on, about; chosen by the hash of their id.
SAMPLE_ROWS = 20_000
#: Words and n-grams that a model keeps, and their least count. Each language has an equal share of them, its
#: most frequent first, so a rare language keeps its own beside a common one.
MOST_WORDS, MOST_GRAMS, LEAST_COUNT = 150_000, 50_000, 2
#: Lengths of n-grams, longest first; words are framed by spaces.
ORDERS = (5, 4, 3, 2, 1)
SMOOTHING = 0.5
#: Unseen words whose scores a Python worker remembers; beyond, it forgets them, which costs time only.
REMEMBERED = 200_000
UNDETERMINED = "und"
WORDS = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return WORDS.findall((text or "").lower())


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as the empty text, so it is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Model:
    """Log frequencies of words and n-grams by language, and the scoring of texts."""

    def __init__(self, languages: list[str], prior: list[float], words: dict[str, list[int]], grams: dict[str, list[int]]):
        self.languages, self.prior = languages, np.log(np.array(prior, float) + 1.0) if languages else np.zeros(0)
        self.words, self.word_logs = list(words), self._logs(words)
        parts = [{g: c for g, c in grams.items() if len(g) == n} for n in ORDERS]
        self.grams = {g: i for i, g in enumerate(g for part in parts for g in part)}
        self.gram_logs = np.concatenate([*map(self._logs, parts), np.zeros((1, len(languages)))])
        self.index: dict[str, int] = {}

    def _logs(self, counts: dict[str, list[int]]) -> np.ndarray:
        table = np.array(list(counts.values()), float).reshape(len(counts), len(self.languages))
        return np.log(table + SMOOTHING) - np.log(table.sum(axis=0) + SMOOTHING * len(table)) if counts else table

    def _start(self, room: int) -> None:
        """Known words only, with room for unseen ones."""
        self.index = {w: i for i, w in enumerate(self.words)}
        self.logs = np.concatenate([self.word_logs, np.zeros((room, len(self.languages)))])

    def unseen(self, words: list[str]) -> np.ndarray:
        """For each word the mean log frequencies of its longest n-grams that are known; even if none is."""
        rows, counts, get, none = [], [], self.grams.get, len(self.grams)
        for word in words:
            framed = f" {word} "
            for n in ORDERS:
                known = [r for i in range(len(framed) - n + 1) if (r := get(framed[i : i + n])) is not None]
                if known:
                    break
            known = known or [none]
            rows += known
            counts.append(len(known))
        counts = np.array(counts)
        return np.add.reduceat(self.gram_logs[rows], np.cumsum(counts) - counts, axis=0) / counts[:, None]

    def _learn(self, words: set[str]) -> None:
        """Rows of ``logs`` for all of ``words``; if there is no room, earlier unseen words are forgotten."""
        new = words.difference(self.index)
        if not self.index or len(self.index) + len(new) > len(self.logs):
            self._start(max(REMEMBERED, len(words)))
            new = words.difference(self.index)
        new = list(new)
        for at in range(0, len(new), 20_000):
            some, row = new[at : at + 20_000], len(self.index)
            self.logs[row : row + len(some)] = self.unseen(some)
            self.index.update(zip(some, range(row, row + len(some))))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text. The language has the largest sum of log frequencies over
        all words, the prior added once; the score is its mean share over the words, each word's
        shares adding to 1. Ties: the first label in order."""
        texts = [words_of(text) for text in texts]
        if self.languages:
            self._learn({w for words in texts for w in words})
        out = []
        for words in texts:
            if not words or not self.languages:
                out.append((UNDETERMINED, 0.0))
                continue
            logs = self.logs[list(map(self.index.__getitem__, words))]
            best = int(np.argmax(logs.sum(axis=0) + self.prior))
            share = np.exp(logs - logs.max(axis=1, keepdims=True))
            out.append((self.languages[best], float(np.mean(share[:, best] / share.sum(axis=1)))))
        return out


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of (doc_id, text, lang). Rows with a null text or language teach nothing.

    Fitted on about ``sample_rows`` rows, all where there are fewer; their whole texts are counted, once.
    The counts are summed by Spark, and each language's most frequent words and n-grams, a stated
    number in all, come to the driver. Ties: the first in order."""
    labelled = labelled.where("text is not null and lang is not null")
    docs = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rows, languages = sum(docs.values()), sorted(docs)
    if rows > sample_rows:
        grain = 1 << 30
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < int(grain * sample_rows / rows))
    words = labelled.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    words = stored(words)
    grams = words.select("lang", "n", F.explode(_grams(F.col("word"))).alias("word")).groupBy("word", "lang").agg(F.sum("n").alias("n"))
    return Model(languages, [docs[x] for x in languages], _most(words, languages, MOST_WORDS), _most(grams, languages, MOST_GRAMS))


def _grams(word: Column) -> Column:
    framed = F.concat(F.lit(" "), word, F.lit(" "))

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(framed) - n + 1)
        return F.when(F.length(framed) >= n, F.transform(starts, lambda i: F.substr(framed, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of, ORDERS))


def _most(counts: DataFrame, languages: list[str], most: int) -> dict[str, list[int]]:
    if not languages:
        return {}
    by = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"c{i}") for i, x in enumerate(languages)]
    table = stored(counts.groupBy("word").agg(F.sum("n").alias("n"), *by).where(F.col("n") >= LEAST_COUNT))
    share, found = max(1, most // len(languages)), {}
    for i in range(len(languages)):
        top = table.where(f"c{i} > 0").orderBy(F.desc(f"c{i}"), "word").limit(share).drop("n")
        found.update((r[0], list(r[1:])) for r in top.collect())
    return found


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        texts = (t for part in stretches(batch["text"]) for t in part.to_pylist())
        for lang, text in zip(batch["lang"].to_pylist(), texts):
            counts.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        langs, words, ns = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], names=["lang", "word", "n"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score of every whole text; columns of these names are replaced, all
    others stay. A text that is null or has no letter is `und` with score 0. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        found = [f for part in stretches(texts) for f in shared.value.predict(part.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang_pred", "score"])

    (made,) = spare(docs, "__found")
    out = docs.withColumn(made, predicted("text"))
    return out.withColumn("lang_pred", F.col(made)["lang_pred"]).withColumn("score", F.col(made)["score"]).drop(made)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by a model of those not held out.

    Languages are learned, not listed; a table without labelled rows gives `und` throughout. Repeated
    rows are predicted each; an empty table gives no rows."""
    model = train(docs.where(~is_held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")


def keep_known(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The documents whose language is determined with a score of ``least`` or more; all columns stay.

    A null text or one without a letter is not determined and goes; without labelled rows every row
    goes. Repeated rows are judged each; a tie of languages goes to the first label in order. An
    empty table gives no rows. ``lang`` null teaches nothing, a null doc_id is never learned from."""
    model = train(docs.where(~is_held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    said = [c for c in ("lang_pred", "score") if c in docs.columns]
    aside = dict(zip(said, spare(docs, *(f"__{c}" for c in said))))
    judged = predict(docs.withColumnsRenamed(aside), model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return judged.drop("lang_pred", "score").withColumnsRenamed({b: a for a, b in aside.items()}).select(*docs.columns)
