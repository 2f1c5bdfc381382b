"""Importance resampling towards a target: hashed n-gram counts by distinct lines, gains, and a Gumbel draw."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import spare, stored, stretches

BUCKETS, LONGEST = 10_000, 3
LEAST_WORDS, SHARE, SEED = 20, 5, 42
#: Bytes as they count: A-Z lower-cased, letters, digits and all of non-ASCII kept, what parts words 0.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)
#: Words up to this length are hashed side by side, one byte of each at a time; longer ones alone.
SHORT = 64
WEIGHED = "struct<n_words:bigint,n_features:bigint,weight:bigint>"


# CRC-32 of many words


def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


#: The CRC-32 of each byte's step (polynomial 0xEDB88320), and for each length up to SHORT and each of the four bytes
#: of a CRC what that byte becomes after so many zero bytes: CRC-32 is linear, so the parts are xor-ed.
STEP = _table()


def _shifts() -> np.ndarray:
    values = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [values]
    for _ in range(SHORT):
        values = STEP[values & 255] ^ (values >> 8)
        out.append(values)
    return np.stack(out)


SHIFT = _shifts().reshape(-1)


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What ``crc`` adds to the CRC-32 of its bytes followed by others of the given lengths (as zlib's combination)."""
    crc, left = crc.copy(), lengths.astype(np.int64)
    while True:
        at = np.minimum(left, SHORT) * 1024
        crc = SHIFT[at + (crc & 255)] ^ SHIFT[at + 256 + (crc >> 8 & 255)] ^ SHIFT[at + 512 + (crc >> 16 & 255)] ^ SHIFT[at + 768 + (crc >> 24)]
        left -= np.minimum(left, SHORT)
        if not left.any():
            return crc


def word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    order = np.argsort(-np.minimum(lengths, SHORT + 1), kind="stable")
    sizes, begins = lengths[order], starts[order]
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-sizes, -SHORT))  # those before are longer than SHORT
    for j in range(int(sizes[long]) if long < len(sizes) else 0):
        n = int(np.searchsorted(-sizes[long:], -j))
        some = crc[long : long + n]
        crc[long : long + n] = STEP[(some ^ data[begins[long : long + n] + j]) & 255] ^ (some >> 8)
    crc = ~crc
    for i in range(long):
        crc[i] = zlib.crc32(data[begins[i] : begins[i] + sizes[i]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


# Words and n-grams


@dataclass
class Words:
    """The words of texts: CRC-32 and length of each, and the text that each is of, rising."""

    crc: np.ndarray
    length: np.ndarray
    text: np.ndarray

    def take(self, at: np.ndarray) -> Words:
        return Words(self.crc[at], self.length[at], self.text[at])


def words_of(texts: pa.Array) -> Words:
    """The words of all ``texts``, none across two of them; null has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = FOLD[np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = data != 0
    begin, over = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    borders = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]  # where two texts touch, a word ends and another begins
    both = borders[solid[borders] & solid[borders + 1]]
    begin[both], over[both - 1] = True, True
    starts = np.flatnonzero(begin)
    lengths = np.flatnonzero(over) + 1 - starts
    return Words(word_crcs(data, starts, lengths), lengths, np.searchsorted(ends, starts, side="right") - 1)


def grams(words: Words, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, position, CRC-32) of all runs of k words, k from 1 to ``longest``, joined by spaces, of one text each."""
    crc, at = words.crc, np.arange(len(words.crc))
    yield 1, at, crc
    for k in range(2, longest + 1):
        fits = int(np.searchsorted(at, len(words.crc) - k + 1))
        inside = np.flatnonzero(words.text[at[:fits]] == words.text[at[:fits] + k - 1])
        at, crc = at[inside], crc[inside]
        spaced = ~(STEP[(~crc ^ 32) & 255] ^ (~crc >> np.uint32(8)))
        last = at + k - 1
        crc = shifted(spaced, words.length[last]) ^ words.crc[last]
        yield k, at, crc


@dataclass
class Cut:
    """Texts cut into lines. Distinct lines, with their words; the distinct line that each line is, the text it is of."""

    lines: pa.Array
    line: np.ndarray
    text: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Cut:
        parts = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
        coded = parts.flatten().dictionary_encode()
        return cls(coded.dictionary, coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy()))

    def across(self, words: Words) -> tuple[Words, np.ndarray]:
        """The first and last LONGEST - 1 words of every line in their order, as words of the texts, and the number
        of the line of each. An n-gram across lines consists of such words and has no gap; see ``crossing``."""
        edge = LONGEST - 1
        first = np.searchsorted(words.text, np.arange(len(self.lines)))
        count = np.bincount(words.text, minlength=len(self.lines))
        n = count[self.line]
        head, tail = np.minimum(n, edge), np.clip(n - edge, 0, edge)
        size = head + tail
        begin = np.cumsum(size) - size
        line = np.repeat(np.arange(len(self.line)), size)
        place = np.arange(len(line)) - begin[line]
        at = first[self.line[line]] + np.where(place < head[line], place, n[line] - size[line] + place)
        return Words(words.crc[at], words.length[at], self.text[line]), line


def crossing(words: Words, line: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, CRC-32) of the n-grams that begin in one line and end in another."""
    for k, at, crc in grams(words):
        over = line[at] != line[np.minimum(at + k - 1, len(line) - 1)]
        yield words.text[at[over]], crc[over]


# Counts, gains, weights


def line_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features by bucket of distinct lines (line, n), each line's counted once and multiplied by n."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        at = 0
        for part in stretches(batch.column("line")):
            n = batch.column("n").slice(at, len(part)).to_numpy().astype(np.float64)
            at += len(part)
            words = words_of(part)
            for _, place, crc in grams(words):
                total += np.bincount(crc % BUCKETS, n[words.text[place]], BUCKETS).astype(np.int64)
    yield _sparse(total)


def crossing_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features by bucket of n-grams across lines of texts."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in stretches(batch.column("text")):
            cut = Cut.of(part)
            for _, crc in crossing(*cut.across(words_of(cut.lines))):
                total += np.bincount(crc % BUCKETS, minlength=BUCKETS)
    yield _sparse(total)


def _sparse(total: np.ndarray) -> pa.RecordBatch:
    there = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket, n: the features of all ``texts`` (column text) by bucket.

    Texts are cut into lines; equal lines of the whole table become one row with the number of its occurrences, by
    sums on the map side before they are shuffled; each distinct line's features are counted once. N-grams across
    lines need no shuffle of texts. A task returns a row a bucket at most."""
    line = texts.where("text is not null").select(F.explode(F.split("text", "\n")).alias("line"))
    lines = line.groupBy("line").agg(F.count("*").alias("n"))
    kinds = "bucket int, n long"
    counted = lines.mapInArrow(line_counts, kinds).unionByName(texts.select("text").mapInArrow(crossing_counts, kinds))
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket: the logarithm of its share in ``target`` over that in ``docs``, in thousandths,
    rounded down; at most BUCKETS rows a table come to the driver."""
    s, t = (np.zeros(BUCKETS) for _ in range(2))
    for counts, table in ((s, docs), (t, target)):
        for bucket, n in bucket_counts(table).collect():
            counts[bucket] = n
    ratio = ((t + 1.0) * (s.sum() + BUCKETS)) / ((s + 1.0) * (t.sum() + BUCKETS))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weigh(texts: pa.Array, gain: np.ndarray) -> np.ndarray:
    """n_words, n_features and weight of each text: the weights of its lines, each distinct line's worked out once,
    and those of the n-grams across them."""
    cut = Cut.of(texts)
    words = words_of(cut.lines)
    here, n = len(cut.lines), len(texts)
    by_line = np.zeros(here)
    for _, at, crc in grams(words):
        by_line += np.bincount(words.text[at], gain[crc % BUCKETS], here)
    weight = np.bincount(cut.text, by_line[cut.line], n)
    for text, crc in crossing(*cut.across(words)):
        weight += np.bincount(text, gain[crc % BUCKETS], n)
    count = np.bincount(cut.text, np.bincount(words.text, minlength=here)[cut.line], n).astype(np.int64)
    features = sum(np.maximum(count - k, 0) for k in range(LONGEST))
    return np.stack([count, features, weight.astype(np.int64)])


def weighted(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_features and weight of every whole text; columns of these names are replaced, all
    others stay. Null texts have no words. An empty ``target`` or table is counted as such."""
    shared = docs.sparkSession.sparkContext.broadcast(gains(docs, target))

    @F.arrow_udf(WEIGHED)
    def weigher(texts: pa.Array) -> pa.Array:
        found = [weigh(part, shared.value) for part in stretches(texts)]
        rows = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        return pa.StructArray.from_arrays([pa.array(r) for r in rows], names=["n_words", "n_features", "weight"])

    (found,) = spare(docs, "__weighed")
    out = docs.withColumn(found, weigher("text"))
    return out.withColumns({c: F.col(found)[c] for c in ("n_words", "n_features", "weight")}).drop(found)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A draw from the Gumbel distribution in thousandths, rounded down, which depends on the id and ``seed`` only."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], column: str, where: str) -> DataFrame:
    """``rows`` with gapless numbers from 1, in ``order``, of those that ``where`` holds for (null for the others).

    Rows are dealt by ranges of the order, so no task holds more than its range; each numbers its own, and the
    counts of the ranges before are added. ``rows`` is read several times, so give a narrow stored table."""
    n, part, last = spare(rows, "__n", "__part", "__last")
    dealt = rows.where(where).repartitionByRange(*order).sortWithinPartitions(*order)
    low = (1 << 33) - 1
    dealt = stored(dealt.withColumn(n, F.monotonically_increasing_id()).withColumn(part, F.shiftright(n, 33)).withColumn(n, F.col(n).bitwiseAND(F.lit(low))))
    sizes = dealt.groupBy(part).agg(F.max(n).alias(last))
    before = sizes.selectExpr(part, f"coalesce(sum({last} + 1) over (order by {part} rows between unbounded preceding and 1 preceding), 0) as {last}")
    numbered = dealt.join(before, part).withColumn(column, (F.col(n) + F.col(last) + 1).cast("long")).drop(n, part, last)
    return numbered.unionByName(rows.where(f"not coalesce({where}, false)").withColumn(column, F.lit(None).cast("long")))


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document. Of those of ``least_words`` words or more,
    ``share`` in a hundred, rounded down, are drawn: the highest scores, ties to the smaller doc_id, numbered from 1;
    the others have no rank. Texts are read once more for the weights, for a narrow table; ranks are given on that."""
    rows = weighted(docs.select("doc_id", "text"), target)
    rows = stored(rows.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score")))
    drawn = share * rows.where(F.col("n_words") >= least_words).count() // 100
    out = ranked(rows, [F.desc("score"), F.asc("doc_id")], "rank", f"n_words >= {least_words}")
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, seed: int = SEED, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """The drawn documents, with all their columns, by doc_id: rows that repeat a drawn doc_id all stay, and those of a
    null doc_id do if one of them is drawn. An empty table gives no rows."""
    (key,) = spare(docs, "__drawn")
    drawn = scored(docs, target, seed, share, least_words).where("rank is not null").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(F.col(key)), "left_semi")
