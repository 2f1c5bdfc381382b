"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import stored

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence of n tokens: FIXED + n + n**2 / ATTENTION.
FIXED, ATTENTION = 32.0, 16384.0
#: Pieces that one task packs together, about.
GROUP_PIECES = 20_000
PACKED = "doc_id {id}, copy int, piece int, start long, length long, bin_id long, capacity int, offset int"


def cost(capacity: int) -> float:
    """What a training step over one sequence costs, in tokens of linear work."""
    return FIXED + capacity + capacity * capacity / ATTENTION


def best_fit(lengths: list[int], capacities: tuple[int, ...] = LENGTHS) -> list[tuple[int, int, int]]:
    """(bin, offset, capacity) of each length, none above the largest capacity.

    For every permitted length in turn as the largest that may be opened, the pieces are packed in
    descending order: each goes into the open bin that it leaves least room in; where none holds
    it, the length of least cost per token among those that hold it is opened. Every bin is then
    downsized to the smallest permitted length that holds its contents. The choice of least total
    cost is kept, so the lengths are optimised jointly. Ties: the first piece, the oldest bin."""
    capacities = tuple(sorted(capacities))
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    best: tuple[float, list] | None = None
    for most in capacities:
        room: list[tuple[int, int]] = []
        used: list[int] = []
        placed = [(0, 0)] * len(lengths)
        for i in order:
            n = lengths[i]
            at = bisect_left(room, (n, -1))
            if at < len(room):
                left, b = room.pop(at)
            else:
                fits = [c for c in capacities if n <= c <= max(most, n)] or [next(c for c in capacities if c >= n)]
                left, b = min(fits, key=lambda c: cost(c) / c), len(used)
                used.append(0)
            placed[i] = (b, used[b])
            used[b] += n
            if left > n:
                insort(room, (left - n, b))
        sizes = [capacities[bisect_left(capacities, u)] for u in used]
        total = sum(map(cost, sizes))
        if best is None or total < best[0]:
            best = (total, [(b, o, sizes[b]) for b, o in placed])
    return best[1] if best else []


def pack(docs: DataFrame, length: str | None = None, capacities: tuple[int, ...] = LENGTHS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every piece of every document (doc_id, text) with its bin: doc_id, piece, start, length, bin_id, capacity, offset.

    Lengths are in the unit of the column ``length``, such as the token counts of ``tokens``, or else
    white-space-separated words of ``text``. A text longer than the largest permitted length is cut
    into pieces of that length and a rest; a text of length 0 or null is one piece in no bin (bin_id
    and offset null, capacity 0). The pieces are dealt at random, by hash, into groups of about
    ``group_pieces``, so a task never holds more however long the texts are; each group is packed on
    its own, which leaves a few unfilled bins a group. Bins depend on the rows only, not on how they
    are dealt to tasks. Repeated rows are packed each: copy tells them apart. An empty table gives no
    rows. The texts are read once, for a table of ids and lengths in the checkpoint folder."""
    most = max(capacities)
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S++")) if length is None else F.coalesce(F.col(length), F.lit(0))
    rows = docs.select("doc_id", n.cast("long").alias("n"), F.crc32(F.coalesce("text", F.lit(""))).alias("crc"))
    rows = stored(rows.groupBy("doc_id", "n", "crc").agg(F.count("*").alias("copies")))
    last = F.greatest(F.ceil(F.col("n") / most) - 1, F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    pieces = rows.select("doc_id", "n", "crc", F.explode(F.sequence(zero, F.col("copies") - 1)).alias("copy"))
    pieces = pieces.select("doc_id", "n", "crc", F.col("copy").cast("int").alias("copy"), F.explode(F.sequence(zero, last)).alias("piece"))
    start = F.col("piece") * most
    pieces = pieces.select("doc_id", "crc", "copy", F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.lit(most).cast("long"), F.col("n") - start).alias("length"))
    count = rows.agg(F.sum(F.col("copies") * (last + 1))).first()[0] or 0
    groups = max(1, -(-count // group_pieces))
    dealt = pieces.where("length > 0").withColumn("group", F.pmod(F.xxhash64("doc_id", "crc", "copy", "piece"), F.lit(groups)))

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "crc", "copy", "piece"))])
        found = best_fit(rows["length"].to_pylist(), capacities)
        bins = pa.array([(key[0].as_py() << 32) + b for b, _, _ in found], pa.int64())
        made = [bins, pa.array([c for _, _, c in found], pa.int32()), pa.array([o for _, o, _ in found], pa.int32())]
        rows = rows.select(["doc_id", "copy", "piece", "start", "length"])
        return pa.Table.from_arrays([*rows.columns, *made], names=[*rows.column_names, "bin_id", "capacity", "offset"])

    schema = PACKED.format(id=docs.schema["doc_id"].dataType.simpleString())
    none = pieces.where("length = 0").selectExpr("doc_id", "copy", "piece", "start", "length", "cast(null as long) as bin_id", "0 as capacity", "cast(null as int) as offset")
    return dealt.groupBy("group").applyInArrow(packed, schema).unionByName(none)
