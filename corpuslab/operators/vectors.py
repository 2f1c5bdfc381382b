"""Vector search: exact, and by an inverted file of clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.functions.text import estimated_tokens
from corpuslab.operators.bm25 import DIGITS, rank
from corpuslab.operators.heap import Heap
from corpuslab.sources.session import shared_folder, stored

#: Query vectors that are broadcast at a time, and the bytes that they may take.
QUERY_BLOCK, QUERY_BYTES = 4096, 32 << 20
#: Vectors of a block, where blocks of queries and of vectors form a grid.
DOC_ROWS = 20_000
#: Rows of a file of a stored index; a larger cluster is several files. Candidates by code for each hit asked for.
FILE_ROWS, CANDIDATES = 1_000_000, 2


def embed(rows: DataFrame, embed_fn: Callable[[list[str]], list[list[float]]], text_col: str = "text", batch: int = 64) -> DataFrame:
    """``rows`` with the vectors that ``embed_fn`` gives for batches of texts, order kept and number checked."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list[list[float]] = []
            for at in range(0, len(frame), batch):
                texts = frame[text_col].iloc[at : at + batch].tolist()
                made = embed_fn(texts)
                if len(made) != len(texts):
                    raise ValueError(f"{len(made)} vectors for {len(texts)} texts")
                vectors += made
            yield frame.assign(vector=vectors)

    return rows.mapInPandas(run, f"{kinds}, vector array<float>")


def embedding_cost(rows: DataFrame, price: float, text_col: str = "text", by: str | None = None) -> DataFrame:
    """What embedding the texts takes, in all or for each ``by``: texts, estimated tokens, and their cost (6 digits) at ``price``
    a million tokens."""
    tokens = estimated_tokens(F.col(text_col))
    grouped = rows.groupBy(by) if by else rows.groupBy()
    sums = grouped.agg(F.count("*").alias("texts"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))
    return sums.withColumn("cost", F.round(F.col("tokens") * price / 1e6, 6))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    size = norm(v)
    return F.transform(v, lambda x: F.when(size == 0, x.cast("double")).otherwise(x.cast("double") / size))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0.0 if either is zero."""
    sizes = norm(a) * norm(b)
    return F.when(sizes == 0, F.lit(0.0)).otherwise(dot(a, b) / sizes)


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size == 0, 1.0, size)


def finite(docs: DataFrame) -> DataFrame:
    """The rows whose vector is not null and has finite components only; the others have no cosine with anything."""
    known = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return docs.where(F.col("vector").isNotNull() & known)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return _unit(np.array(vectors.tolist(), float))


def topk(docs: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK, doc_rows: int = DOC_ROWS) -> DataFrame:
    """The ranked list (qid, doc_id, rank, score) of the k nearest of docs (doc_id, vector) to each query
    (qid, vector) by cosine. A zero query finds nothing; ties by doc_id.

    Queries of a stated number and measured size are broadcast, and every task keeps the best k of all vectors it
    reads, which it gives out once. More queries than that stay distributed: blocks of queries and blocks of vectors
    form a grid, whose cells are compared each in a task, so neither side is ever in one place."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    qid_type = queries.schema["qid"].dataType.simpleString()
    schema = f"qid {qid_type}, doc_id {id_type}, score double"
    docs, queries = docs.select("doc_id", "vector").where("vector is not null"), queries.select("qid", "vector").where("vector is not null")
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    block = max(1, min(block, QUERY_BYTES // (8 * max(1, width))))
    if n <= block:
        rows = queries.collect()
        matrix = _unit(np.array([r["vector"] for r in rows], float)) if rows else np.zeros((0, 1))
        shared = docs.sparkSession.sparkContext.broadcast(([r["qid"] for r in rows], matrix))
        return rank(docs.mapInPandas(_nearest(shared, k), schema), k)
    across, down = -(-n // block), max(1, -(-docs.count() // doc_rows))
    spread = lambda rows, own, size, other, most: rows.select("*", F.pmod(F.xxhash64(own), F.lit(size)).alias(f"{own}_block"), F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias(f"{other}_block"))
    cells = ["qid_block", "doc_id_block"]
    left, right = spread(docs, "doc_id", down, "qid", across), spread(queries, "qid", across, "doc_id", down)

    def cell(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        heap, qids = Heap(len(asked), k), asked["qid"].tolist()
        if len(vectors) and len(asked):
            matrix = _matrix(asked["vector"])
            used = np.flatnonzero(matrix.any(axis=1))
            for at in range(0, len(vectors), 4096):
                some = vectors.iloc[at : at + 4096]
                heap.add(np.round(matrix[used] @ _matrix(some["vector"]).T, DIGITS), some["doc_id"].to_numpy(), used)
        return heap.rows(qids)

    return rank(left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInPandas(cell, schema), k)


def _nearest(queries, k: int):
    """``queries``: a broadcast (ids, matrix of unit vectors)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = queries.value
        used = np.flatnonzero(matrix.any(axis=1))
        heap = Heap(len(used), k)
        for frame in frames:
            if len(frame) and len(used):
                heap.add(np.round(matrix[used] @ _matrix(frame["vector"]).T, DIGITS), frame["doc_id"].to_numpy())
        yield heap.rows([ids[i] for i in used])

    return run


def train_ivf(docs: DataFrame, nlist: int = 64, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Cluster centres of docs (doc_id, vector): max(1, min(nlist, rows)) of them, first the vectors of
    least seeded hash, then Lloyd rounds over all rows. Each round is one pass that returns a sum and a
    count for each centre and task; an empty cluster takes the next vector by hash. Vectors that are not
    ``finite`` are in no cluster, as exact search finds none of them."""
    docs = finite(docs).select("doc_id", "vector")
    seeds = docs.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("doc_id").cast("string"))), "doc_id").limit(2 * nlist).collect()
    pool = _unit(np.array([r["vector"] for r in seeds], float)) if seeds else np.zeros((0, 1))
    n = max(1, min(nlist, len(pool)))
    centres, spare = pool[:n].copy(), iter(pool[n:])
    for _ in range(rounds if len(pool) else 0):
        parts = docs.mapInPandas(_cluster_sums(centres), "cluster int, total array<double>, n long")
        parts = parts.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        sums = parts.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("total"))
        filled = {r["cluster"]: np.array(r["total"]) / r["n"] for r in sums.collect()}
        for j in range(n):
            centres[j] = filled[j] if j in filled else next(spare, centres[j])
    return centres


def _distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(axis=1)[None, :] - 2.0 * vectors @ centres.T


def _cluster_sums(centres: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for frame in frames:
            if len(frame):
                vectors = _unit(np.array(frame["vector"].tolist(), float))
                nearest = _distances(vectors, centres).argmin(axis=1)
                np.add.at(total, nearest, vectors)
                count += np.bincount(nearest, minlength=len(centres))
        used = np.flatnonzero(count)
        if len(used):  # a task without rows has no arrays to tell their type by
            yield pd.DataFrame({"cluster": used.astype(np.int32), "total": list(total[used]), "n": count[used]})

    return run


def assign_ivf(docs: DataFrame, centres: np.ndarray) -> DataFrame:
    """docs (doc_id, vector) with the nearest centre of each, those that are not ``finite`` left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(cluster=_distances(_unit(np.array(frame["vector"].tolist(), float)), centres).argmin(axis=1).astype(np.int32))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return finite(docs.select("doc_id", "vector")).mapInPandas(run, f"doc_id {kind}, vector array<float>, cluster int")


@dataclass(frozen=True)
class Ivf:
    """A stored inverted file: a folder for each cluster, whose rows are doc_id, code, scale and vector."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    schema: str

    def rows(self, clusters: np.ndarray | None = None) -> DataFrame:
        """All rows, or those of some clusters: only their folders are read."""
        found = self.spark.read.schema(self.schema).parquet(f"{self.path}/vectors")
        return found if clusters is None else found.where(F.col("cluster").isin([int(c) for c in clusters]))


def store_ivf(docs: DataFrame, nlist: int = 64, rounds: int = 12, path: str | None = None) -> Ivf:
    """The inverted file of docs (doc_id, vector), written to a new folder (by default a shared one) by cluster. With each
    vector goes a code of one byte a component, a quarter of its size. A cluster of more than FILE_ROWS rows
    is dealt into several files by hash, so a hot one is no hot task."""
    spark, path = docs.sparkSession, path or shared_folder(docs.sparkSession)
    centres = train_ivf(docs, nlist, rounds)
    assigned = assign_ivf(docs, centres)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, code binary, scale double, vector array<float>, cluster int"

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                unit = _matrix(frame["vector"])
                scale = np.abs(unit).max(axis=1) / 127.0
                codes = np.round(unit / np.where(scale == 0, 1.0, scale)[:, None]).astype(np.int8)
                yield frame.assign(code=[c.tobytes() for c in codes], scale=scale)[["doc_id", "code", "scale", "vector", "cluster"]]

    sizes = {r["cluster"]: r["n"] for r in assigned.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # nlist rows at most
    files = F.create_map(*(F.lit(int(x)) for c, n in sizes.items() for x in (c, -(-n // FILE_ROWS)))) if sizes else F.create_map(F.lit(0), F.lit(1))
    dealt = assigned.mapInPandas(coded, schema).withColumn("file", F.pmod(F.xxhash64("doc_id"), F.try_element_at(files, F.col("cluster")).cast("long")))
    dealt.repartition("cluster", "file").drop("file").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("cluster").parquet(f"{path}/vectors")
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cluster int, centre array<double>").coalesce(1).write.json(f"{path}/centres")
    return open_ivf(spark, path, kind)


def open_ivf(spark: SparkSession, path: str, id_type: str = "bigint") -> Ivf:
    rows = spark.read.schema("cluster int, centre array<double>").json(f"{path}/centres").orderBy("cluster").collect()
    return Ivf(spark, path, np.array([r["centre"] for r in rows]), f"doc_id {id_type}, code binary, scale double, vector array<float>, cluster int")


def probe_ivf(index: Ivf, queries: DataFrame, k: int = 10, nprobe: int = 4) -> tuple[DataFrame, DataFrame]:
    """Two tables for queries (qid, vector): the ranked list of the k nearest in the nprobe clusters nearest to each query, and
    (qid, codes, vectors): how many codes were scanned and how many vectors read for it.

    Only the folders of probed clusters are read, and of these first the codes; the CANDIDATES * k best by code are then
    compared by their vectors, exactly. A query none of whose clusters holds a row is held against all. Queries go
    to the tasks in blocks of a stated number and size."""
    spark, kind = index.spark, index.schema.split(" ")[1].rstrip(",")
    qid_type = queries.schema["qid"].dataType.simpleString()
    queries = stored(finite(queries.select("qid", "vector")))
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    blocks = max(1, -(-n // max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * max(1, width))))))
    held = {r["cluster"]: r["n"] for r in index.rows().groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    filled = np.zeros(len(index.centres), bool)
    filled[list(held)] = True
    found, counts = [], []
    for part in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == part).collect()
        matrix = _unit(np.array([r["vector"] for r in rows], float)) if rows else np.zeros((0, index.centres.shape[1] if len(index.centres) else 1))
        used = np.flatnonzero(matrix.any(axis=1))
        ids, matrix = [rows[i]["qid"] for i in used], matrix[used]
        wanted = np.zeros((len(ids), len(index.centres)), bool)
        if len(ids):
            near = np.argsort(_distances(matrix, index.centres), axis=1, kind="stable")[:, : max(1, nprobe)]
            np.put_along_axis(wanted, near, True, axis=1)
            wanted[~(wanted & filled).any(axis=1)] = True
        shared = spark.sparkContext.broadcast((ids, matrix, wanted))
        codes = index.rows(np.flatnonzero(wanted.any(axis=0))).select("doc_id", "cluster", "code", "scale")
        best = codes.mapInPandas(_by_code(shared, k * CANDIDATES), f"qid {qid_type}, doc_id {kind}, score double, cluster int")
        found.append(best)
        sizes = np.array([held.get(c, 0) for c in range(len(index.centres))])
        counts += [(q, int(sizes[w].sum())) for q, w in zip(ids, wanted)]
    best = reduce(DataFrame.unionByName, found)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    best = stored(best.withColumn("place", place).where(F.col("place") <= k * CANDIDATES).select("qid", "doc_id", "cluster"))
    exact = index.rows().select("doc_id", "cluster", "vector").join(best, ["doc_id", "cluster"]).join(queries.withColumnRenamed("vector", "asked"), "qid")
    hits = rank(exact.select("qid", "doc_id", F.round(cosine(F.col("asked"), F.col("vector")), DIGITS).alias("score")), k)
    read = spark.createDataFrame(counts, f"qid {qid_type}, codes long").join(best.groupBy("qid").agg(F.count("*").alias("vectors")), "qid", "left")
    return hits, read.select("qid", "codes", F.coalesce("vectors", F.lit(0)).alias("vectors"))


def _by_code(shared, most: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix, wanted = shared.value
        heaps = Heap(len(ids), most)
        where: dict = {}
        for frame in frames:
            for cluster, rows in frame.groupby("cluster"):
                asked = np.flatnonzero(wanted[:, cluster])
                codes = np.frombuffer(b"".join(rows["code"]), np.int8).reshape(len(rows), -1) * rows["scale"].to_numpy()[:, None]
                heaps.add(matrix[asked] @ codes.T, rows["doc_id"].to_numpy(), asked)
                where.update(dict.fromkeys(rows["doc_id"], cluster))
            kept = set(heaps.ids[heaps.scores > -np.inf].tolist()) if heaps.scores.size else set()
            where = {d: c for d, c in where.items() if d in kept}
        out = heaps.rows(ids)
        yield out.assign(cluster=[int(where[d]) for d in out["doc_id"]]).astype({"cluster": "int32"})

    return run


def search_ivf(index: Ivf, queries: DataFrame, k: int = 10, nprobe: int = 4) -> DataFrame:
    """The ranked list of ``probe_ivf``."""
    return probe_ivf(index, queries, k, nprobe)[0]


def bucket_stats(index: DataFrame, nlist: int) -> DataFrame:
    """Least, largest and mean size (1 digit) of nlist clusters, empty ones among them."""
    every = index.sparkSession.range(nlist).select(F.col("id").cast("int").alias("cluster"))
    sizes = every.join(index.groupBy("cluster").agg(F.count("*").alias("n")), "cluster", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return sizes.agg(F.count("*").alias("nlist"), F.sum("n").alias("n"), F.min("n").alias("bucket_min"), F.max("n").alias("bucket_max"), F.round(F.avg("n"), 1).alias("bucket_avg"))


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Each query's share of its exact first k that was found too; 0 for k = 0."""
    ids = lambda d, name: d.where(F.col("rank") <= k).groupBy("qid").agg(F.collect_set("doc_id").alias(name))
    both = ids(exact, "want").join(ids(found, "got"), "qid", "left")
    share = F.size(F.array_intersect("want", F.coalesce("got", F.array().cast(both.schema["want"].dataType)))) / F.lit(float(k) if k else 1.0)
    return both.select("qid", share.alias("recall"))


def noisy_queries(docs: DataFrame, n: int, sigma: float, seed: int = 7) -> DataFrame:
    """n vectors of least seeded hash as queries (qid, vector), with normal noise added and normalised;
    sigma of 0 or less leaves them as they are. A vector's noise depends on the seed and its id alone."""
    picked = docs.where("vector is not null").orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("doc_id").cast("string"))), "doc_id").limit(n)
    picked = picked.select(F.col("doc_id").alias("qid"), F.col("vector").cast("array<float>").alias("vector"))
    if sigma <= 0:
        return picked

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for qid, vector in zip(frame["qid"], frame["vector"]):
                noise = np.random.default_rng([seed, int(qid)]).normal(0.0, sigma, len(vector))
                moved = np.array(vector, float) + noise
                made.append((moved / (np.linalg.norm(moved) or 1.0)).astype(np.float32))
            yield frame.assign(vector=made)

    return picked.mapInPandas(run, picked.schema)


def sweep(docs: DataFrame, queries: DataFrame, nlists: list[int], nprobes: list[int], k: int = 10, rounds: int = 12) -> DataFrame:
    """Mean recall@k of the inverted file against exact search for each nlist and nprobe. The exact lists and each
    index are stored once."""
    exact, out = stored(topk(docs, queries, k)), None
    for nlist in nlists:
        index = store_ivf(docs, nlist, rounds)
        for nprobe in nprobes:
            part = recall(search_ivf(index, queries, k, nprobe), exact, k)
            part = part.agg(F.round(F.avg("recall"), 4).alias("recall")).select(F.lit(nlist).alias("nlist"), F.lit(nprobe).alias("nprobe"), "recall")
            out = part if out is None else out.unionByName(part)
    return out
