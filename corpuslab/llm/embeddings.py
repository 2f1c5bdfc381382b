"""Embedding near-duplicates: binary codes of randomly rotated vectors decide what is computed exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import checkpoint, connected_components, tiles

THRESHOLD = 0.98
SEED = 20_240_229
#: Chance that a pair just at the threshold meets in no bucket; closer pairs have less.
MISSED = 1e-9
#: Distinct vectors a bucket is to hold, about, and those that one task compares at a time.
BUCKET_ROWS, CHUNK_ROWS, TILE_ROWS = 64, 1024, 512
#: Half-width of the confidence interval of an estimate, in the units of its error bound.
CONFIDENCE = 4.0


def plan(distinct: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits, bands) for so many distinct vectors of one label: buckets of about BUCKET_ROWS, and as
    many bands as keep the chance of missing a pair at the threshold below MISSED."""
    bits = max(4, math.ceil(math.log2(max(1, distinct) / BUCKET_ROWS)))
    agree = (1.0 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1.0 - agree))


def rotations(dim: int, rows: int) -> np.ndarray:
    """``rows`` directions in ``dim`` dimensions: the rows of random rotations, one after another."""
    rng = np.random.default_rng([SEED, dim])
    blocks = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-rows // dim))]
    return np.concatenate(blocks)[:rows]


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the rotated unit vectors, packed, and the correction factor of each: the inner product
    of the rotated vector and its code's unit vector."""
    dim = vectors.shape[1]
    turned = unit(vectors) @ rotations(dim, dim).T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(dim)


def estimate(turned: np.ndarray, packed: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the cosines of rotated unit vectors (rows) with coded ones (columns), and
    each column's error bound at CONFIDENCE."""
    dim = turned.shape[1]
    signs = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
    known = (turned.astype(np.float32) @ signs.T) / (math.sqrt(dim) * factor[None, :]).astype(np.float32)
    bound = CONFIDENCE * np.sqrt(np.maximum(1.0 - factor**2, 0.0)) / factor / math.sqrt(max(dim - 1, 1))
    return known, bound


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def band_numbers(sides: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Each band's bits as a number."""
    return sides.reshape(len(sides), bands, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _coded(bits: int, bands: int):
    """Adds code, factor, sides (the bands' bits) and bands (as numbers) to batches with dim and vector."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                vectors = _matrix(part["vector"], dim)
                packed, factor = codes(vectors)
                sides = unit(vectors) @ rotations(dim, bits * bands).T >= 0
                number = band_numbers(sides, bits, bands)
                made = [pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(factor), pa.array([s.tobytes() for s in np.packbits(sides, axis=1)], pa.binary()), pa.array(list(number), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "code", "factor", "sides", "bands"])

    return code


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest row reachable from each of n rows by the links i-j."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (before == label).all():
            return label


def _linked(threshold: float, bits: int, bands: int):
    """Blocks of rows of a bucket to (src, dst, n): a vector, the smallest row it reaches here, and the
    vectors linked to it by pairs that meet here first."""

    def compare(table: pa.Table, group: np.ndarray, dim: int) -> pa.RecordBatch | None:
        n = table.num_rows
        vectors = unit(_matrix(table["vector"], dim))
        turned = vectors @ rotations(dim, dim).T
        packed = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(n, -1)
        factor, times = table["factor"].to_numpy(), table["times"].to_numpy()
        band, chunk, lo, hi = (table[c].to_numpy() for c in ("band", "chunk", "lo", "hi"))
        sides = np.frombuffer(b"".join(table["sides"].to_pylist()), np.uint8).reshape(n, -1)
        numbers = band_numbers(np.unpackbits(sides, axis=1, count=bits * bands), bits, bands)
        links, edges = np.zeros(n, np.int64), []
        for at in range(0, n, 256):
            rows = np.arange(at, min(n, at + 256))
            near, bound = estimate(turned[rows], packed, factor)
            pairs = (group[rows][:, None] == group[None, :]) & (near + bound[None, :] >= threshold)
            pairs &= np.where((lo == hi)[rows][:, None], rows[:, None] < np.arange(n)[None, :], (chunk == lo)[rows][:, None] & (chunk == hi)[None, :])
            i, j = np.nonzero(pairs)
            i = i + at
            for part in range(0, len(i), 100_000):
                a, b = i[part : part + 100_000], j[part : part + 100_000]
                exact = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= threshold
                a, b = a[exact], b[exact]
                first = (numbers[a] == numbers[b]).argmax(axis=1) == band[a]
                a, b = a[first], b[first]
                np.add.at(links, a, times[b])
                np.add.at(links, b, times[a])
                label = _stars(a, b, n)
                moved = np.flatnonzero(label != np.arange(n))
                edges.append(np.stack([moved, label[moved]]))
        if not (found := np.flatnonzero(links)).size:
            return None
        root = _stars(*np.concatenate(edges, axis=1), n)
        node = table["node"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(node[root[found]]), pa.array(links[found])], names=["src", "dst", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in tiles(batches, ["label", "dim", "band", "number", "lo", "hi"], TILE_ROWS):
            dims = table["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                here = dims == dim
                found = compare(table.filter(pa.array(here)), group[here], dim)
                if found is not None:
                    yield found

    return run


def is_valid(vector: Column) -> Column:
    """Whether a vector can be compared: not null, with finite components that are not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label).

    Rows of equal label and vector are one node, so copies cost nothing. Nodes fall into buckets, one
    for each band of rotated signs; the pairs of a bucket are estimated from the codes, and those
    whose confidence interval reaches the threshold are computed exactly. A pair counts in the first
    band that it shares; the bands' bits go along packed. A bucket is cut into chunks of bounded size whose pairs are tasks of their
    own; a task gives sums and star-shaped links, never all pairs.

    Null labels, null, zero and non-finite vectors, null vec_ids and vectors of other lengths link
    with nothing. A vec_id given to several vectors is taken for one node. An empty table gives no rows."""
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & is_valid(F.col("embedding"))
    rows = rows.select("vec_id", "label", F.col("embedding").alias("vector"), usable.alias("usable"))
    # 128 bits stand for a vector where rows are grouped and joined.
    key = ["label", "h1", "h2"]
    rows = rows.select("*", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(SEED), "vector").alias("h2"))
    same = rows.where("usable").groupBy(*key).agg(F.min("vec_id").cast("long").alias("node"), F.count("*").alias("times"), F.first("vector").alias("vector"))
    same = same.withColumn("dim", F.size("vector"))
    most = same.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, bands = plan(most, threshold)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in same.schema)
    coded = checkpoint(same.mapInArrow(_coded(bits, bands), f"{kinds}, code binary, factor double, sides binary, bands array<bigint>"))
    placed = coded.select("node", "label", "dim", F.posexplode("bands").alias("band", "number"))
    bucket = ["label", "dim", "band", "number"]
    chunks = F.ceil(F.col("size") / CHUNK_ROWS)
    sizes = placed.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1")
    dealt = (
        placed.join(sizes, bucket)
        .select("node", *bucket, chunks.alias("chunks"), F.pmod(F.xxhash64("node"), chunks).alias("chunk"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
        .select("node", "band", "number", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    )
    blocks = dealt.join(coded.select("node", "label", "dim", "vector", "times", "code", "factor", "sides"), "node").repartition(*bucket, "lo", "hi").sortWithinPartitions(*bucket, "lo", "hi")
    found = checkpoint(blocks.mapInArrow(_linked(threshold, bits, bands), "src bigint, dst bigint, n bigint"))
    counted = found.groupBy("src").agg(F.sum("n").alias("n")).withColumnRenamed("src", "node")
    roots = connected_components(found.select("src", "dst"))
    classes = coded.select("node", *key, "times").join(counted, "node", "left").join(roots, "node", "left")
    classes = classes.select(*key, (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component"))
    found = rows.where("usable").select("vec_id", *key).join(checkpoint(classes), key).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
