"""What the training-data operators share: checkpoints, Arrow batch sizes, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder and read back, so that a lost
    executor costs no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names. Where it names none, a local session gets a new one, and
    a cluster, whose executors could not read the driver's disk, an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpuslab-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared checkpoint folder and read back: what
    ``checkpoint`` does, compressed and in columns, for wide or many rows."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of a stage's own, which ``df`` has not."""
    out = []
    for name in names:
        while name in df.columns:
            name = "_" + name
        out.append(name)
    return out


#: Bytes of text that a Python helper works on at a time.
STRETCH_BYTES = 4 << 20


def stretches(column: pa.Array, most: int = STRETCH_BYTES) -> Iterator[pa.Array]:
    """A column of texts in parts of at most ``most`` bytes (a longer text alone). Spark bounds the bytes of
    the batch itself; this bounds what is made of it in Python, whatever the number of rows."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield column.slice(at, to - at)
        at = to


def connected_components(edges: DataFrame) -> DataFrame:
    """Nodes of ``edges`` (src, dst; longs) with the smallest node reachable: (node, root).

    Alternates two star steps, as joins and map-side combined minima, until nothing changes: each
    node is linked to the smallest of its neighbourhood, so paths halve and every component ends as
    one star. Edges stay distributed and are checkpointed each round. Self-links are dropped."""
    star = checkpoint(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .where("u <> v")
        .distinct()
    )
    seen = None
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        star = checkpoint(small.select("e.u", "e.v").where("u <> v").distinct())
        now = star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    roots = star.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def tiles(batches: Iterator[pa.RecordBatch], by: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups of ``by``, each of ``rows`` rows at least but the last,
    with the number of each row's group. Only one table and what follows it in a batch are held."""

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for name in by:
            values = table[name].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return new

    held = None
    for batch in batches:
        fresh = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, fresh]) if held is not None else fresh
        if held.num_rows < rows:
            continue
        new, at = starts(held), 0
        for cut in np.flatnonzero(new).tolist():
            if cut - at >= rows:
                yield held.slice(at, cut - at).combine_chunks(), np.cumsum(new[at:cut])
                at = cut
        held = held.slice(at)
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.cumsum(starts(held))
