"""Running values and numbers without a whole group, or everything, in one task.

Rows are dealt into slices by ranges of key and order. A slice scans its own rows, the slices before it
hand on one summary a key, and both are put together: sums and maxima are associative, so how the
rows are cut changes nothing. A key that holds a third of all rows is spread over a third of the slices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.sources.session import stored

SLICE = "__slice"


def sliced(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``rows``, stored, with the number of each one's slice. ``order`` is to tell the rows of a key apart; equal rows
    come in any order, but the same one for all that reads the slices."""
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    return stored(dealt.withColumn(SLICE, F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id()))


def bare(rows: DataFrame) -> DataFrame:
    return rows.drop(SLICE, "__place")


def prefix(rows: DataFrame, key: str, order: Sequence[str], wanted: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Sliced rows with running values: name -> (`sum` or `max`, column), over the rows of a key up to this one."""
    kinds = {"sum": F.sum, "max": F.max}
    values = rows.withColumns({f"__v_{name}": column for name, (_, column) in wanted.items()})
    within = Window.partitionBy(SLICE, key).orderBy("__place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = values.withColumns({f"__own_{name}": kinds[kind](f"__v_{name}").over(within) for name, (kind, _) in wanted.items()})
    totals = values.groupBy(F.col(key).alias("__key"), F.col(SLICE).alias("__at")).agg(*(kinds[kind](f"__v_{name}").alias(f"__t_{name}") for name, (kind, _) in wanted.items()))
    earlier = Window.partitionBy("__key").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__key", "__at", *(kinds[kind](f"__t_{name}").over(earlier).alias(f"__b_{name}") for name, (kind, _) in wanted.items()))
    joined = own.join(before, (F.col(SLICE) == F.col("__at")) & F.col(key).eqNullSafe(F.col("__key")))
    out = {}
    for name, (kind, _) in wanted.items():
        mine, past = F.col(f"__own_{name}"), F.col(f"__b_{name}")
        out[name] = F.coalesce(mine + past, mine, past) if kind == "sum" else F.greatest(mine, past)
    scratch = [f"__{p}_{name}" for name in wanted for p in ("v", "own", "b")]
    return joined.withColumns(out).drop("__key", "__at", *scratch)


def numbered(rows: DataFrame, order: Sequence[str], column: str, by: str | None = None) -> DataFrame:
    """``rows`` with gapless numbers from 1 in ``order``, within each ``by`` or over all."""
    key = by or "__every"
    keyed = rows if by else rows.withColumn(key, F.lit(0))
    out = bare(prefix(sliced(keyed, key, order), key, order, {column: ("sum", F.lit(1))}))
    return out if by else out.drop(key)
