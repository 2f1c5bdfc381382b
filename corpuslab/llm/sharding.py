"""Sharding by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corpuslab.llm.common import stored

#: Multiplier of the 64-bit congruential generator of jump consistent hashing (Lamping and Veach, 2014).
MULTIPLIER = 2862933555777941757
#: Jumps that are worked out at most. Their number is about ln(shards); more than this has a chance below 1e-30.
MOST_JUMPS = 64
WORD, HALF = 2**32, 2**16


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a long key; a null key counts as 0.

    The generator's k-th state is ``key * M**k + (M**(k-1) + ... + 1)`` modulo 2**64, whose factors
    are known beforehand, so each state's upper 31 bits come from one product, made of 16- and
    32-bit parts that cannot overflow a long. The jumps then run over the array of states."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key = F.coalesce(key.cast("long"), F.lit(0))
    high, low = F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(WORD - 1))
    draws, factor, term = [], 1, 0
    for _ in range(min(shards, MOST_JUMPS)):
        factor, term = factor * MULTIPLIER % 2**64, (term * MULTIPLIER + 1) % 2**64
        draws.append(_upper_bits(high, low, factor, term))
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jump(s: Column, draw: Column) -> Column:
        to = F.floor((s["j"] + 1).cast("double") * (F.lit(float(2**31)) / (draw + 1).cast("double")))
        return F.when(s["j"] < shards, F.struct(s["j"].alias("b"), to.alias("j"))).otherwise(s)

    return F.aggregate(F.array(*draws), start, jump, lambda s: s["b"]).cast("int")


def _upper_bits(high: Column, low: Column, factor: int, term: int) -> Column:
    """Upper 31 bits of (high * 2**32 + low) * factor + term modulo 2**64."""
    f1, f0 = divmod(factor, WORD)

    def times(x: Column, by: int) -> Column:  # x * by modulo 2**32, x below 2**32
        top, rest = divmod(by, HALF)
        return x * F.lit(rest) + (x * F.lit(top)).bitwiseAND(F.lit(HALF - 1)) * F.lit(HALF)

    top, rest = divmod(f0, HALF)
    crossed = low * F.lit(top)
    lower = low * F.lit(rest) + crossed.bitwiseAND(F.lit(HALF - 1)) * F.lit(HALF) + F.lit(term % WORD)
    upper = F.shiftright(lower, 32) + F.shiftright(crossed, 16) + F.lit(term // WORD)
    upper = upper + times(high, f0).bitwiseAND(F.lit(WORD - 1)) + times(low, f1).bitwiseAND(F.lit(WORD - 1))
    return F.shiftright(upper.bitwiseAND(F.lit(WORD - 1)), 1)


def stable_key(df: DataFrame, key: str) -> Column:
    """A column as a long to shard by: whole numbers as they are, all else (strings, UUIDs, dates) by the
    64-bit hash of its text. Null stays null."""
    whole = isinstance(df.schema[key].dataType, IntegralType)
    text = F.col(key).cast("string")
    return F.col(key).cast("long") if whole else F.when(text.isNotNull(), F.xxhash64(text))


def assign_shards(df: DataFrame, key: str, shards: int, column: str = "shard") -> DataFrame:
    """``df`` with each row's shard. Rows of equal keys share one, null keys count as 0; no shuffle. With
    one more shard only the rows that move into it change. A column of that name is replaced."""
    return df.withColumn(column, jump_hash(stable_key(df, key), shards))


def number_within(df: DataFrame, shard: str, order: list[str], column: str = "slot", group_rows: int = 4096) -> DataFrame:
    """``df`` with gapless numbers from 0 within each shard, in no one task.

    A shard is dealt into groups of about ``group_rows`` rows by the hash of ``order``, each group
    numbers its own rows, and the counts of the groups before it are added. Only rows equal in all
    of ``order`` stay together, and take numbers in any order. ``df`` is counted, summed up and read,
    so give a narrow stored table. Columns named __group, __n, __own or __before are refused."""
    if taken := {"__group", "__n", "__own", "__before"}.intersection(df.columns):
        raise ValueError(f"columns {sorted(taken)} are in use here")
    groups = max(1, -(-df.count() // (group_rows * 8)))
    dealt = df.withColumn("__group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    sizes = dealt.groupBy(shard, "__group").agg(F.count("*").alias("__n"))
    before = sizes.selectExpr(
        shard, "__group", f"sum(__n) over (partition by {shard} order by __group rows between unbounded preceding and 1 preceding) as __before"
    )
    own = dealt.selectExpr("*", f"row_number() over (partition by {shard}, __group order by {', '.join(order)}) - 1 as __own")
    slot = (F.coalesce("__before", F.lit(0)) + F.col("__own")).cast("long")
    return own.join(before, [shard, "__group"]).withColumn(column, slot).drop("__group", "__own", "__before")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per document under the law `key`: doc_id, size (UTF-8 bytes + 1), text_crc32, law,
    shard, slot, grown_shard (the shard were there one more). A null text has no bytes, a null
    doc_id counts as key 0; repeated rows get a slot each; an empty table gives no rows. The texts are
    read once, for a narrow table in the checkpoint folder; the slots are numbered on that."""
    key, text = stable_key(docs, "doc_id"), F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
    )
    rows = number_within(stored(rows), "shard", ["doc_id", "text_crc32", "size"])
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
