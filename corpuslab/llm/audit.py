"""Filter interaction audit: what each filter removes in every order, by counting paths through the lattice of filter sets."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import stored

FILTERS = "ABCDE"
#: Characters that part words (fixed values), and those that filter D looks for.
BLANKS, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


class Lattice:
    """The sets of n filters, as bit masks, with one edge for each filter that can still join a set.

    ``reaching[s]`` counts the orders in which the filters of s come first, summed over the edges into s from the
    empty set on; ``leaving[s]`` the orders of the rest, summed over the edges out of s from the full set back. So
    reaching[s] * leaving[t] orders run through the edge from s to t, which is the edge's Shapley weight."""

    def __init__(self, filters: str):
        self.filters, n = filters, len(filters)
        self.edges = [(s, i, s | 1 << i) for s in range(1 << n) for i in range(n) if not s >> i & 1]
        self.reaching, self.leaving = [1] + [0] * ((1 << n) - 1), [0] * ((1 << n) - 1) + [1]
        for s, _, t in self.edges:  # by rising s: all edges into s come before those out of it
            self.reaching[t] += self.reaching[s]
        for s, _, t in reversed(self.edges):
            self.leaving[s] += self.leaving[t]

    def weight(self, edge: int) -> int:
        s, _, t = self.edges[edge]
        return self.reaching[s] * self.leaving[t]

    def steps(self) -> list[tuple[int, str, int]]:
        """(edge, order, step) of every step of every order."""
        at, out = {(s, i): e for e, (s, i, _) in enumerate(self.edges)}, []
        for order in permutations(range(len(self.filters))):
            done = 0
            for step, i in enumerate(order, 1):
                out.append((at[done, i], "".join(self.filters[j] for j in order), step))
                done |= 1 << i
        return out


def text_failures(text: Column) -> list[Column]:
    """The conditions A to D, whether a text fails them: few words, repeated words, many capitals, symbols."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * capitals.cast("long") > 5 * F.char_length(text),
        text.rlike(SYMBOLS),
    ]


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part and failing (a bit for each filter, A the lowest) of every row.

    Texts are read once, for a narrow table in the checkpoint folder. They are told apart by SHA-256; the smallest
    doc_id of each is found by minima on the map side and joined to the rows, whose hot digests adaptive execution
    splits."""
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures(text))), F.lit(0))
    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    rows = stored(docs.select("doc_id", part, bits.alias("bits"), F.unhex(F.sha2(text, 256)).alias("digest")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    later = F.coalesce(F.col("first") < F.col("doc_id"), F.col("doc_id").isNull() & F.col("first").isNotNull())
    return rows.join(first, "digest", "left").select("doc_id", "part", (F.col("bits") + F.when(later, 16).otherwise(0)).alias("failing"))


def interactions(failing: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit of rows (part, failing, good, bad; the last two 0 or 1): one row per part, order of ``filters``
    and step, with COUNTS as ``filter_audit`` describes them.

    A part is summed up once, by mask, with sums on the map side; from then on it is at most 2^n masks. What passes a
    set of filters is the sum over masks apart from it, and what an edge removes the difference of its ends; a
    filter's edges, weighted, give its Shapley count, and every order reads its steps from the same edges."""
    lattice, size = Lattice(filters), 1 << len(filters)
    by_mask = failing.groupBy("part", "failing").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    parts = by_mask.groupBy("part").agg(F.collect_list(F.struct("failing", "n", "good", "bad")).alias("masks"))

    def over(kind: str, chosen) -> Column:
        """The sum of a count over a part's masks that are chosen."""
        return F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + F.when(chosen(m["failing"]), m[kind]).otherwise(0))

    def passing(kind: str) -> Column:
        return F.transform(sets, lambda s: over(kind, lambda m: m.bitwiseAND(s) == 0))

    sets = F.array(*map(F.lit, range(size)))
    sums = parts.select(
        "part",
        *(passing(kind).alias(kind) for kind in ("n", "good", "bad")),
        F.transform(sets, lambda s: over("n", lambda m: m == s)).alias("alone"),
    )
    fixed = [F.struct(*(F.lit(v).alias(c) for c, v in zip(("edge", "s", "i", "t", "weight"), (e, *edge, lattice.weight(e))))) for e, edge in enumerate(lattice.edges)]

    def counted(e: Column) -> Column:
        own = e["t"] - e["s"]
        removed = F.get("n", e["s"]) - F.get("n", e["t"])
        return F.struct(
            e["edge"].alias("edge"),
            e["i"].alias("i"),
            F.get("n", e["t"]).alias("kept"),
            removed.alias("removed"),
            (F.get("n", F.lit(0)) - F.get("n", own) - removed).alias("redundant"),
            F.get("alone", own).alias("unique_fails"),
            (F.get("good", e["s"]) - F.get("good", e["t"])).alias("good_lost"),
            (F.get("bad", e["s"]) - F.get("bad", e["t"])).alias("toxic_lost"),
            (removed * e["weight"]).alias("share"),
        )

    edges = sums.select("part", F.transform(F.array(*fixed), counted).alias("edges"))
    shares = F.transform(
        F.array(*map(F.lit, range(len(filters)))),
        lambda i: F.aggregate("edges", F.lit(0).cast("long"), lambda a, e: a + F.when(e["i"] == i, e["share"]).otherwise(0)),
    )
    by_edge = edges.select("part", shares.alias("shares"), "edges").select("part", "shares", F.inline("edges")).withColumn("shapley", F.get("shares", F.col("i")))
    steps = failing.sparkSession.createDataFrame(lattice.steps(), "edge int, filter_order string, step int")  # n! * n rows, whatever the input
    return by_edge.join(F.broadcast(steps), "edge").select("part", "filter_order", "step", *COUNTS)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source), order of the filters A to E (all 120) and step: documents kept after it, removed by
    it, redundant (failing its filter, removed before), unique_fails (failing its filter alone), good_lost and
    toxic_lost (removed by it, labelled quality or toxic 1), shapley (its filter's removals summed over all orders).

    Null texts are empty, null sources the part ''. Of equal texts all fail E but those of the smallest doc_id, which
    repeated rows of it share; a null doc_id comes last. A document with several label rows is good or toxic if one
    says so, one of a null doc_id neither; labels without a document count nowhere. An empty table gives no rows."""
    marks = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"))
    rows = judged(docs.select("doc_id", "text", "source")).join(marks, "doc_id", "left")
    return interactions(rows.select("part", "failing", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad")))
