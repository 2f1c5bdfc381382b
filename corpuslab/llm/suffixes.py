"""Suffix-array deduplication: bytes of strings that occur more than once are removed.

A string of LENGTH bytes is placed by an anchor, the least hash of the SHORT-byte strings inside it,
which is the same wherever the string occurs. Neighbouring strings with one anchor form a segment.
Only segments whose anchor occurs elsewhere are gathered; equal ones are counted, and those that
differ are sorted by a suffix array, whose adjacent common prefixes show the repeated strings. An
anchor of many segments is split by what lies around it, as often as needed, so no array grows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import checkpoint, stored, stretches

LENGTH, SHORT = 400, 64
#: The same in words, for passages that other documents hold too.
PASSAGE_WORDS, SHORT_WORDS = 51, 8
#: Bytes whose anchors are worked out at a time.
STRETCH = 1 << 17
#: Bytes of one suffix array, about, and distinct segments of one key that one may hold.
ARRAY_BYTES, MOST_SEGMENTS = 1 << 19, 256
#: Strings that share a part of a split segment, level by level. In a part of one, equal keys are equal strings.
WIDTHS = (42, 6, 1)
#: Places of an anchor that one task is to join at least, and anchors with more at most.
HOT_PLACES, MOST_HOT = 10_000, 10_000
#: Suffixes whose bytes are laid out at a time for sorting, and pairs that are compared at a time.
ROWS_SORTED, ROWS_COMPARED = 1 << 15, 1 << 13


def _hashes(data: np.ndarray, short: int) -> np.ndarray:
    """A 64-bit hash of each string of ``short`` symbols (a power of two), by doubling."""
    h, size = data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15), 1
    while size < short:
        h = h[:-size] * np.uint64(0xBF58476D1CE4E5B9) + h[size:]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        size *= 2
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, length: int = LENGTH, short: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a string of ``length`` symbols: the position of its anchor, the leftmost of those
    with the least leading hash bits, and the anchor's hash."""
    h, window = _hashes(data, short), length - short + 1
    low = np.uint64((1 << 20) - 1)
    least, size = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while size * 2 <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(h) - window + 1], least[window - size :])
    at = (least & low).astype(np.int64)
    return at, h[at]


def digest(data) -> tuple[int, int]:
    """128 bits that stand for a string, as two longs."""
    value = xxhash.xxh3_128_intdigest(data)
    return (value >> 64) - (1 << 63), (value & (2**64 - 1)) - (1 << 63)


def segments(texts: list[np.ndarray], length: int = LENGTH, short: int = SHORT) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, anchor hash, digest, start, starts) of every segment of texts of ``length`` symbols or more.
    A text longer than STRETCH is cut into overlapping stretches, which only splits segments."""
    some: list[tuple[int, int, np.ndarray]] = []
    held = 0
    for t, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), STRETCH):
            piece = text[at : at + STRETCH + length - 1]
            if len(piece) < length:
                continue
            some.append((t, at, piece))
            held += len(piece)
            if held >= STRETCH:
                yield from _segments(some, length, short)
                some, held = [], 0
    if some:
        yield from _segments(some, length, short)


def _segments(pieces: list[tuple[int, int, np.ndarray]], length: int, short: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    joined = np.concatenate([p for _, _, p in pieces])
    at, hashed = anchors(joined, length, short)
    sizes = np.array([len(p) for _, _, p in pieces])
    begins = np.cumsum(sizes) - sizes
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    new[begins[begins < len(at)]] = True
    lasts = begins + sizes - length + 1  # strings that start from here on cross into the next text
    new[lasts[lasts < len(at)]] = True
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(at)))
    owner = np.searchsorted(begins, starts, side="right") - 1
    inside = starts < lasts[owner]
    view, wide = memoryview(joined).cast("B"), joined.itemsize
    keys = hashed.view(np.int64)[starts]
    for s, n, o, key in zip(starts[inside].tolist(), counts[inside].tolist(), owner[inside].tolist(), keys[inside].tolist()):
        t, offset, _ = pieces[o]
        yield t, key, *digest(view[s * wide : (s + n + length - 1) * wide]), s - int(begins[o]) + offset, n


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each white-space-separated word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, text.split(), repeat(1)), np.uint64)


def word_anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(texts, anchor hashes) of the strings of PASSAGE_WORDS words: an anchor once for neighbours that share it."""
    some: list[tuple[int, np.ndarray]] = []
    held = 0
    for t, hashes in enumerate(map(word_hashes, texts)):
        for at in range(0, len(hashes) - PASSAGE_WORDS + 1, STRETCH):
            some.append((t, hashes[at : at + STRETCH + PASSAGE_WORDS - 1]))
            held += len(some[-1][1])
            if held >= STRETCH:
                yield _word_anchors(some)
                some, held = [], 0
    if some:
        yield _word_anchors(some)


def _word_anchors(pieces: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    at, hashed = anchors(np.concatenate([p for _, p in pieces]), PASSAGE_WORDS, SHORT_WORDS)
    sizes = np.array([len(p) for _, p in pieces])
    owner = np.repeat(np.arange(len(pieces)), sizes)[: len(at)]
    kept = np.arange(len(at)) < (np.cumsum(sizes) - PASSAGE_WORDS + 1)[owner]  # later strings cross into the next text
    kept[1:] &= (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    return np.array([t for t, _ in pieces])[owner[kept]], hashed[kept].view(np.int64)


def _by_prefix(windows: np.ndarray, positions: np.ndarray, offset: int) -> np.ndarray:
    """Positions in the order of their windows from ``offset`` on. Eight bytes at a time decide; ties are
    settled by all their bytes, in batches of bounded size."""
    depth = windows.shape[1]
    if offset >= depth or len(positions) < 2:
        return positions
    if len(positions) <= ROWS_SORTED:
        return positions[_row_order(windows[positions, offset:])]
    keys = np.ascontiguousarray(windows[positions, offset : offset + 8])
    keys = np.pad(keys, ((0, 0), (0, 8 - keys.shape[1]))).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    keys, positions = keys[order], positions[order]
    first = np.append(True, keys[1:] != keys[:-1])
    starts = np.append(np.flatnonzero(first), len(keys))
    group = np.cumsum(first, dtype=np.uint32)
    at = 0
    while at < len(starts) - 1:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + ROWS_SORTED, side="right")) - 1)
        a, b = starts[at], starts[to]
        if to == at + 1:
            positions[a:b] = _by_prefix(windows, positions[a:b], offset + 8)
        else:
            tied = np.flatnonzero(~(first[a:b] & np.append(first[a + 1 : b], True))) + a
            if len(tied):
                rows = np.concatenate([group[tied].astype(">u4").view(np.uint8).reshape(-1, 4), windows[positions[tied], offset + 8 :]], axis=1)
                positions[tied] = positions[tied][_row_order(rows)]
        at = to
    return positions


def _row_order(rows: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), kind="stable")


def two_stage(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffix array of bytes, exact to ``depth`` leading bytes (a shorter suffix sorts first).

    Stage one sorts directly only the suffixes smaller than their successors. Stage two scans the
    buckets of first bytes upwards and induces the others: each is placed, in the order of its
    successor, at the front of its bucket, runs of one byte round by round."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int32)
    wide = data.astype(np.int16)
    step = np.sign(np.append(wide[1:], -1) - wide).astype(np.int8)
    settled = np.flatnonzero(step)  # within a run of equal bytes the step at its end decides
    smaller = step[settled[np.searchsorted(settled, np.arange(n))]] > 0
    windows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(depth, np.uint8)), depth)
    direct = _by_prefix(windows, np.flatnonzero(smaller).astype(np.int32), 0)
    first = data[direct]
    bucket = [direct[a:b] for a, b in zip(np.searchsorted(first, np.arange(256)), np.searchsorted(first, np.arange(256), side="right"))]
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[n - 1]].append(np.array([n - 1], np.int32))
    out = []
    for c in range(256):
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int32)
        waiting[c].clear()
        parts = [level]
        while len(level):
            before = level[level > 0] - 1
            level = before[data[before] == c]
            parts.append(level)
        whole = np.concatenate([*parts, bucket[c]])
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[data[before] > c]
        if len(before):
            byte = data[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            cuts = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(byte))):
                waiting[byte[a]].append(before[a:b])
    return np.concatenate(out)


def repeated_starts(parts: list[bytes], starts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """Which of the first ``starts[i]`` positions of each part begin a string of ``length`` bytes that
    begins at another such position too, by common prefixes of neighbours in the suffix array."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(sizes) - sizes
    is_start = np.zeros(len(data) + 1, np.int32)
    np.add.at(is_start, begins, 1)
    np.add.at(is_start, begins + np.array(starts), -1)
    order = two_stage(data, length)
    order = order[np.cumsum(is_start)[order] > 0]
    windows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(length, np.uint8)), length)
    equal = np.zeros(max(len(order) - 1, 0), bool)
    for at in range(0, len(equal), ROWS_COMPARED):
        a, b = order[at : at + ROWS_COMPARED + 1][:-1], order[at + 1 : at + ROWS_COMPARED + 1]
        common = (windows[a] != windows[b]).argmax(axis=1)
        equal[at : at + len(a)] = (common == 0) & (windows[a, 0] == windows[b, 0])
    hit = np.zeros(len(data), bool)
    hit[order[1:][equal]] = True
    hit[order[:-1][equal]] = True
    return [np.flatnonzero(hit[b : b + n]) for b, n in zip(begins.tolist(), starts)]


def _runs(positions: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive integers as (first, count)."""
    if not len(positions):
        return []
    cuts = np.flatnonzero(np.append(True, np.diff(positions) > 1))
    return list(zip(positions[cuts].tolist(), np.diff(np.append(cuts, len(positions))).tolist()))


def _rows(columns: dict[str, str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "bigint": pa.int64(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, k in enumerate(columns.values())], names=list(columns))


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


PLACE = {"text_key": "binary", "start": "bigint", "starts": "bigint"}
SEGMENT = {"k1": "bigint", "k2": "bigint", "d1": "bigint", "d2": "bigint", **PLACE}
FOUND = {"words": "boolean", **SEGMENT, "inside": "bigint"}
CUT = {**SEGMENT, "bytes": "binary"}
CUT_ANY = {"words": "boolean", **CUT}
STRING = {"h1": "bigint", "h2": "bigint", "text_key": "binary"}


def _words_before(data: np.ndarray) -> np.ndarray:
    """The number of words that start before each byte, and in all."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    return np.cumsum(np.append(0, ~gap & np.append(True, gap[:-1])), dtype=np.int32)


def _find_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their segments in bytes, with the whole words inside each at least, and to the anchors only of
    those in words. k1 is the anchor; k2 is for later splits."""
    for batch in batches:
        at = 0
        for part in stretches(batch["bytes"], STRETCH):
            texts, keys = part.to_pylist(), batch["text_key"].slice(at, len(part)).to_pylist()
            at += len(part)
            data = [np.frombuffer(x, np.uint8) for x in texts]
            words = [_words_before(x) for x in data]
            rows = [(False, a, 0, d1, d2, keys[t], s, n, int(words[t][s + n + LENGTH - 1] - words[t][s]) - 1) for t, a, d1, d2, s, n in segments(data)]
            yield _rows(FOUND, rows)
            for owner, anchor in word_anchors(texts):
                none = pa.array(np.zeros(len(owner), np.int64))
                made = {"words": pa.array(np.ones(len(owner), bool)), "k1": pa.array(anchor), "text_key": pa.array(keys, pa.binary()).take(pa.array(owner))}
                yield pa.RecordBatch.from_arrays([made.get(name, none) for name in FOUND], names=list(FOUND))


def _passages(text: bytes, own: set[int]) -> Iterator[bytes]:
    """128 bits for each string of PASSAGE_WORDS words that is placed by one of ``own`` anchors."""
    hashes = word_hashes(text)
    for _, anchor, _, _, start, n in segments([hashes], PASSAGE_WORDS, SHORT_WORDS):
        if anchor in own:
            data, size = hashes[start : start + n + PASSAGE_WORDS - 1].tobytes(), 8 * PASSAGE_WORDS
            yield b"".join(xxhash.xxh3_128_digest(data[i : i + size]) for i in range(0, len(data) - size + 1, 8))


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the segments wanted of them, to a row for each with its bytes; of a text with anchors in words,
    rows of digests of the passages there."""
    for batch in batches:
        rows, held = [], 0
        for row in zip(*(batch[c] for c in ("text_key", "bytes", "wanted", "own"))):
            key, text, wanted, own = (x.as_py() for x in row)
            for w in wanted or []:
                s, n = w["start"], w["starts"]
                rows.append((False, w["k1"], w["k2"], w["d1"], w["d2"], key, s, n, text[s : s + n + LENGTH - 1]))
                held += len(rows[-1][-1])
                if held > ARRAY_BYTES:
                    yield _rows(CUT_ANY, rows)
                    rows, held = [], 0
            rows += [(True, 0, 0, 0, 0, key, 0, 0, found) for found in _passages(text, set(own or []))]
        if rows:
            yield _rows(CUT_ANY, rows)


def _split(width: int):
    """Segments to parts whose strings hold the anchor at one of ``width`` places. A part's key is what all its
    strings share, LENGTH - width + 1 bytes; its digest is of all its bytes."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in stretches(batch["bytes"], ARRAY_BYTES // 8):
                rows, first = [], part.offset - batch["bytes"].offset
                places = zip(*(batch[c].slice(first, len(part)).to_pylist() for c in PLACE))
                for (key, start, n), data in zip(places, part.to_pylist()):
                    anchor = int(anchors(np.frombuffer(data[:LENGTH], np.uint8))[0][0])
                    for r in range((anchor - n + 1) // width if anchor >= n else 0, anchor // width + 1):
                        a, b = max(0, anchor - r * width - width + 1), min(n, anchor - r * width + 1)
                        shared = data[anchor - r * width : anchor - r * width + LENGTH - width + 1]
                        own = data[a : b + LENGTH - 1]
                        rows.append((*digest(b"%d " % r + shared), *digest(own), key, start + a, b - a, own))
                yield _rows(CUT, rows)

    return split


def _sort_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments by key, in suffix arrays of whole keys, to the repeated starts of each."""

    def sorted_out(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([r[3] for r in rows], [r[2] for r in rows])
        return _rows(PLACE, [(key, start + a, n) for (key, start, _, _), hits in zip(rows, found) for a, n in _runs(hits)])

    held: list[tuple] = []
    size, last = 0, None
    for batch in batches:
        for k1, k2, *row in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "text_key", "start", "starts", "bytes"))):
            if (k1, k2) != last and size >= ARRAY_BYTES:
                yield sorted_out(held)
                held, size = [], 0
            last = k1, k2
            held.append(tuple(row))
            size += len(row[3])
    if held:
        yield sorted_out(held)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of digests to a row for each."""
    for batch in batches:
        keys, digests = batch["text_key"].to_pylist(), batch["bytes"].to_pylist()
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        owners = pa.array(np.repeat(np.arange(len(keys)), [len(d) // 16 for d in digests]))
        yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), batch["text_key"].take(owners)], names=list(STRING))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


KEY, KIND = ["k1", "k2"], ["k1", "k2", "d1", "d2"]


def _weighed(found: DataFrame) -> DataFrame:
    """Each kind of segment (equal digests) of ``found`` whose key has another segment: its number n, one of
    its places, whether its texts differ, and the number of kinds of its key."""
    kinds = found.groupBy(*KIND).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("one"), (F.min("text_key") < F.max("text_key")).alias("differ"))
    keys = kinds.groupBy(*KEY).agg(F.count("*").alias("kinds"), F.sum("n").alias("all"))
    return checkpoint(kinds.join(keys.where(F.col("all") > 1), KEY).select(*KIND, "n", "one", "differ", "kinds"))


def _of_often(found: DataFrame, often: DataFrame) -> DataFrame:
    """The rows of ``found`` whose anchor (words, k1) is in ``often`` (with its number n of places).

    An anchor of very many places, such as a run of one word, is split: it stands once for each part of its
    places, and its rows go to a part by their place. At most MOST_HOT anchors are split, so they are broadcast."""
    most = max(HOT_PLACES, -(-found.count() // MOST_HOT))
    hot = often.where(F.col("n") > most).select("words", "k1", F.ceil(F.col("n") / most).alias("parts"))
    dealt = found.join(F.broadcast(hot), ["words", "k1"], "left").withColumn("part", F.pmod(F.xxhash64("text_key", "start"), F.coalesce("parts", F.lit(1))))
    parts = often.select("words", "k1", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n") > most, F.ceil(F.col("n") / most) - 1).otherwise(0))).alias("part"))
    return dealt.join(parts, ["words", "k1", "part"], "left_semi").select(*found.columns)


def _equal(found: DataFrame, weighed: DataFrame) -> DataFrame:
    """Segments that occur more than once: every string of them starts elsewhere."""
    return found.join(weighed.where("n > 1").select(*KIND, "differ"), KIND)


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text_key, spans): for each text with a string of LENGTH bytes that also starts elsewhere, the starts of
    such strings as array<struct<start,starts>>; and (text_key) of the texts that hold PASSAGE_WORDS
    consecutive words which a different text holds too. Texts that occur twice count once in both."""
    long = docs.where(F.octet_length("text") >= 2 * PASSAGE_WORDS - 1).select("doc_id", text_key(F.col("text")).alias("text_key"), F.encode("text", "UTF-8").alias("bytes"))
    found = stored(long.select("text_key", "bytes").mapInArrow(_find_segments, _ddl(FOUND)))
    # Anchors that occur at another place, of words in another text: two places differ in 64 bits.
    short_key = F.xxhash64("text_key")
    place = F.when(F.col("words"), short_key).otherwise(F.xxhash64("text_key", "start")).alias("place")
    places = found.select("words", "k1", place).groupBy("words", "k1").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.count("*").alias("n"))
    often = stored(places.where("a <> b").select("words", "k1", "n"))
    in_bytes = _of_often(found.where("not words"), often.where("not words")).drop("words")
    in_bytes = stored(in_bytes.dropDuplicates([*KIND, "text_key", "start"]))
    weighed = _weighed(in_bytes)
    equal = stored(_equal(in_bytes, weighed).select(*PLACE, "inside", "differ"))
    spans = [equal.select(*PLACE)]
    # Different segments of one key, one of each kind.
    kind = weighed.where("kinds > 1").select(F.col("one.text_key").alias("text_key"), F.struct(*KIND, "one.start", "one.starts").alias("w"))
    kind = kind.groupBy("text_key").agg(F.collect_list("w").alias("wanted"))
    # Texts whose shared bytes hold a passage for certain; of anchors in words, those that another text has.
    sure = stored(equal.where(F.col("differ") & (F.col("inside") >= PASSAGE_WORDS)).select("text_key").distinct())
    of_words = _of_often(found.where("words").select("words", "k1", "text_key", "start"), often.where("words"))
    of_words = stored(of_words.select("k1", short_key.alias("short")))
    open_ones = of_words.join(sure.select(short_key.alias("short")), "short", "left_anti").select("k1").distinct()
    of_words = of_words.join(open_ones, "k1", "left_semi").groupBy("short").agg(F.collect_set("k1").alias("own"))
    # Of copies of a text, the document of the smallest id gives the bytes.
    one = long.groupBy("text_key").agg(F.min("doc_id").alias("one_id"))
    wanted = one.join(kind, "text_key", "left").withColumn("short", short_key).join(of_words, "short", "left")
    wanted = wanted.where("wanted is not null or own is not null").withColumnRenamed("text_key", "one_key").drop("short")
    same = (F.col("text_key") == F.col("one_key")) & F.col("doc_id").eqNullSafe(F.col("one_id"))
    cut = stored(long.join(wanted, same).select("text_key", "bytes", "wanted", "own").mapInArrow(_cut_segments, _ddl(CUT_ANY)))
    words = cut.where("words").select("text_key", "bytes")
    strings = words.mapInArrow(_strings, _ddl(STRING))
    again = strings.groupBy("h1", "h2").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a < b").select("h1", "h2")
    passages = sure.unionByName(strings.join(again, ["h1", "h2"], "left_semi").select("text_key"))
    cut = cut.where("not words").drop("words").dropDuplicates(KIND)  # rows repeated in id and text come twice
    for width in (*WIDTHS, None):
        cut = stored(cut.join(weighed.where("kinds > 1").select(*KEY, "kinds").distinct(), KEY))
        few = cut.where(F.col("kinds") <= MOST_SEGMENTS).select(*KEY, *PLACE, "bytes")
        few = few.repartition(*KEY).sortWithinPartitions(*KEY, "text_key", "start")
        spans.append(few.mapInArrow(_sort_segments, _ddl(PLACE)))
        many = cut.where(F.col("kinds") > MOST_SEGMENTS)
        if width is None or many.isEmpty():
            break
        parts = stored(many.select(*PLACE, "bytes").mapInArrow(_split(width), _ddl(CUT)))
        weighed = _weighed(parts.drop("bytes"))
        spans.append(_equal(parts, weighed).select(*PLACE))
        cut = parts.join(weighed.where("kinds > 1").select(*KIND, "one.text_key", "one.start"), [*KIND, "text_key", "start"], "left_semi")
    spans = reduce(DataFrame.unionByName, spans).groupBy("text_key").agg(F.collect_list(F.struct("start", "starts")).alias("spans"))
    return spans, passages.distinct()


RESULT = "struct<n_removed:bigint,n_spans:bigint,kept_sha256:string>"


def covered(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings starting at ``spans`` cover, as [from, to)."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["start"] + s["starts"] + LENGTH - 1) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _with_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with __bytes, __copied (the whole text occurs elsewhere), __spans and __shared (a passage of
    PASSAGE_WORDS words is in a different text)."""
    keyed = docs.withColumn("__key", text_key(F.coalesce("text", F.lit(""))))
    copies = keyed.where(F.octet_length("text") >= 2 * PASSAGE_WORDS - 1).groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select("__key", F.lit(True).alias("__copied"))
    spans, passages = repeated(docs.select("doc_id", "text"))
    passages = passages.select(F.col("text_key").alias("__key"), F.lit(True).alias("__shared"))
    facts = spans.withColumnsRenamed({"text_key": "__key", "spans": "__spans"}).join(copies, "__key", "full").join(passages, "__key", "full")
    return keyed.join(checkpoint(facts), "__key", "left").withColumn("__bytes", F.encode(F.coalesce("text", F.lit("")), "UTF-8")).drop("__key")


def removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and shares_passage of every document of (doc_id, text).

    A null text has no bytes, and a text of fewer than LENGTH bytes loses none. Copies of a long text
    lose all their bytes in one run. shares_passage tells that another document holds a passage of
    PASSAGE_WORDS or more consecutive white-space-separated words of this one, of whatever bytes.
    Repeated rows are documents of their own. An empty table gives no rows."""

    @F.arrow_udf(RESULT)
    def removed(texts: pa.Array, copied: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for text, whole, own in zip(texts, copied.to_pylist(), spans.to_pylist()):
            text = text.as_py()
            runs = [(0, len(text))] if whole and len(text) >= LENGTH else covered(own or [])
            digest, at = hashlib.sha256(), 0
            for a, b in runs:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            rows.append((sum(b - a for a, b in runs), len(runs), digest.hexdigest()))
        kinds = (("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    rows = _with_runs(docs.select("doc_id", "text"))
    long = F.size(F.split(F.trim(F.regexp_replace("text", r"[\x09-\x0D\x1C-\x20]+", " ")), " ")) >= PASSAGE_WORDS
    shares = F.coalesce(F.col("__shared") | (F.col("__copied") & long), F.lit(False)).alias("shares_passage")
    rows = rows.select("doc_id", F.octet_length("__bytes").cast("long").alias("n_bytes"), removed("__bytes", "__copied", "__spans").alias("r"), shares)
    return rows.select("doc_id", "n_bytes", "r.n_removed", "r.n_spans", "r.kept_sha256", "shares_passage")
