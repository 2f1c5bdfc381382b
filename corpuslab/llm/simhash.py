"""SimHash near-duplicates: fingerprints, exact search within a Hamming radius, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import checkpoint, connected_components, spare, stored, stretches, tiles

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 3
#: A fingerprint's bits are cut into radius + ALIKE pieces; within the radius, ALIKE pieces at least are equal.
ALIKE = 2
#: Rows of one bucket that one task compares at a time.
CHUNK_ROWS = 2048
#: Small blocks are compared together until they have as many rows.
TILE_ROWS = 512


def simhash(text: bytes | None, size: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text: A-Z lower-cased, words parted by ASCII white space, shingles of ``size``
    words with repeats (a shorter text: all its words), each hashed by XXH64; a bit is set if over
    half of the hashes have it. No words: 0. Given as a signed long."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """The SimHash of a text column as a long."""

    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(t, size) for part in stretches(texts) for t in part.to_pylist()], pa.int64())

    return hashed(F.encode(text, "UTF-8"))


def _planes(fingerprints: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: bit b of all fingerprints, side by side in 64-bit words."""
    bits = np.unpackbits(fingerprints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def within_radius(fingerprints: np.ndarray, radius: int = RADIUS, block: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """For each row, the later rows at ``radius`` or fewer differing bits; rows without any are left out.

    Bit planes are stored vertically. A block of rows is held against all others: each plane's
    differing bits go into carry-save counters of a few bits, one per pair, that start so that they
    overflow just beyond the radius. A row leaves the block once all its pairs have overflowed."""
    n, planes, digits = len(fingerprints), _planes(fingerprints), radius.bit_length()
    later = np.arange(planes.shape[1] * 64)
    for at in range(0, n, block):
        rows = np.arange(at, min(n, at + block))
        own = np.unpackbits(fingerprints[rows].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
        masks = np.where(own, np.uint64(2**64 - 1), np.uint64(0))
        over = np.packbits((later[None, :] <= rows[:, None]) | (later[None, :] >= n), axis=1, bitorder="little").view(np.uint64)
        first = 2**digits - 1 - radius
        counters = [np.full_like(over, 2**64 - 1 if first >> d & 1 else 0) for d in range(digits)]
        for b in range(64):
            carry = planes[b][None, :] ^ masks[b][:, None]
            for d in range(digits):
                counters[d], carry = counters[d] ^ carry, counters[d] & carry
            over |= carry
            if b % 8 == 7:
                left = ~(over == np.uint64(2**64 - 1)).all(axis=1)
                if not left.any():
                    break
                if not left.all():
                    rows, masks, over, counters = rows[left], masks[:, left], over[left], [c[left] for c in counters]
        else:
            found = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
            for i, links in zip(rows.tolist(), found):
                if len(js := np.flatnonzero(links)):
                    yield i, js


def _stars(fingerprints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one block of fingerprints as (member, root) of its own components."""
    values = np.unique(fingerprints)
    label = np.arange(len(values))
    for i, js in within_radius(values, radius):
        joined = np.unique(np.append(label[js], label[i]))
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def _compared(radius: int):
    """Blocks in sorted order, small ones joined into one comparison. Rows: key, lo, hi, fp."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in tiles(batches, ["key", "lo", "hi"], TILE_ROWS):
            src, dst = _stars(table["fp"].to_numpy(), radius)
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return compare


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links among distinct fingerprints (fp long) at ``radius`` or fewer differing bits, as (src, dst)
    that join the same components as all links do.

    Each fingerprint goes to one bucket per pair of pieces. A bucket of n rows is cut by hash into
    chunks of about CHUNK_ROWS, and every two chunks are compared in a task of their own, so neither
    a hot bucket nor its pairs gather anywhere."""
    width, at, pieces = 64 // (radius + ALIKE), 0, []
    for i in range(radius + ALIKE):
        bits = width + (i < 64 % (radius + ALIKE))
        pieces.append((at, bits))
        at += bits
    fp, keys = F.col("fp"), []
    for k, pair in enumerate(combinations(pieces, ALIKE)):
        key = F.lit(k).cast("long")
        for start, bits in pair:
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned(fp, start).bitwiseAND(F.lit(2**bits - 1).cast("long")))
        keys.append(key)
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK_ROWS)
    dealt = (
        rows.join(sizes, "key")
        .select("fp", "key", chunks.alias("chunks"), F.pmod(F.xxhash64("fp"), chunks).alias("chunk"))
        .select("fp", "key", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
        .select("fp", "key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    )
    blocks = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return blocks.mapInArrow(_compared(radius), "src long, dst long")


def components(rows: DataFrame, id_col: str, radius: int = RADIUS) -> DataFrame:
    """``rows`` (``id_col``, fp) with component_id: the smallest id whose fingerprint is reachable over links().

    Equal fingerprints are one node, so copies cost nothing; the row-to-node join is a plain
    equi-join that Spark can split where a fingerprint is hot."""
    distinct = checkpoint(rows.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    grouped = connected_components(links(distinct, radius))
    members = grouped.join(distinct.withColumnRenamed("fp", "node"), "node")
    least = members.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = members.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    labels = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    return rows.join(checkpoint(labels), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document of (doc_id, text).

    A null or wordless text has fingerprint zero, which links like any other. Equal texts share a
    component; each of several rows with one doc_id is judged by its own text and all are returned.
    Null ids are never a component_id unless all of a component's are. An empty table gives no rows."""
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return _grouped(docs.select("doc_id", "text")).select("doc_id", shown, "component_id")


def _grouped(docs: DataFrame, *more: Column, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    rows = docs.select("doc_id", fingerprint(F.col("text"), words).alias("fp"), *more)
    return components(checkpoint(rows), "doc_id", radius)


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The documents that stay when one of each component, that of the smallest doc_id, is kept, with
    all their columns.

    Null and wordless texts are one component. Of rows equal in doc_id and text any one stays; a
    doc_id given to different texts is judged by each. Documents without a doc_id stay where a whole
    component has none. An empty table gives no rows. What goes is listed by id and 128 bits of the
    text, and meets the texts by that key: they are shuffled once, at every size, as a list that is
    broadcast while it is short would grow out of that."""
    key = F.md5(F.coalesce("text", F.lit(""))).alias("key")
    grouped = _grouped(docs, key, words=words, radius=radius)
    counted = stored(grouped.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.first("component_id").alias("component_id")))
    goes = stored(counted.where("not (doc_id <=> component_id)").select("doc_id", "key"))
    again = stored(counted.where("doc_id <=> component_id and n > 1").select("doc_id", "key"))
    own, listed_id, listed = spare(docs, "__key", "__id", "__found")
    keyed, goes, again = docs.withColumn(own, key), *(x.toDF(listed_id, listed).hint("merge") for x in (goes, again))
    same = (F.col(own) == F.col(listed)) & F.col("doc_id").eqNullSafe(F.col(listed_id))
    stays = keyed.join(goes, same, "left_anti")
    if not again.isEmpty():
        once = stays.join(again, same, "left_anti")
        stays = once.unionByName(stays.join(again, same, "left_semi").dropDuplicates([own, "doc_id"]))
    return stays.select(*docs.columns)
