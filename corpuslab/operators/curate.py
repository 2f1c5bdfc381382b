"""Question sets: distribution, alarms, quotas, dedup, repair, sampling, integrity."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Mapping, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators import scans

# Target numbers and hard types of a question set, limits of its alarms.
TARGETS = {"term": 50, "semantic": 30, "multi": 15, "boundary": 15, "conflict": 10}
HARD = ("multi", "boundary", "conflict")
LEAST_HARD, MOST_TYPE, LEAST_SOURCE, MOST_SOURCE = 0.30, 0.50, 0.25, 0.45
# Signs of code and of a question, and its ends.
CODE = r"(className|<div|</?[a-z]+>|function\s*\(|=>|margin-|padding-|#[0-9a-fA-F]{6})"
ASKS = r"(什么|如何|怎么|多少|哪|是否|会不会|有哪些|为什么|能否|几)"
MARKS = ("？", "?")


def distribution(golden: DataFrame, source: str = "expect_source") -> DataFrame:
    """Numbers by source and type, by each alone and in all (null stands for all), with the share of all rows."""
    cube = golden.cube(F.col(source).alias("source"), "type").agg(F.count("*").alias("n"))
    return cube.withColumn("share", F.round(F.col("n") / F.max("n").over(Window.partitionBy(F.lit(1))), 6))


def alarms(golden: DataFrame, sources: Sequence[str], hard: Sequence[str] = HARD, source: str = "expect_source") -> DataFrame:
    """(rule, subject, share) of the alarms that a set raises: too few hard questions, a type or source with too
    large a share, a source with too small a one. All limits are strict."""
    total = golden.agg(F.count("*").alias("total"), F.count_if(F.col("type").isin(*hard)).alias("hard"))
    share = lambda n: F.round(F.coalesce(F.col(n) / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)), 6)
    few = total.select(F.lit("hard").alias("rule"), F.lit(None).cast("string").alias("subject"), share("hard").alias("share")).where(F.col("share") < LEAST_HARD)
    counted = lambda c: golden.groupBy(F.col(c).alias("subject")).agg(F.count("*").alias("n"))
    types = counted("type").crossJoin(total).select(F.lit("type").alias("rule"), "subject", share("n").alias("share")).where(F.col("share") > MOST_TYPE)
    every = golden.sparkSession.createDataFrame([(s,) for s in sources], "subject string").join(counted(source), "subject", "left").na.fill(0, ["n"])
    by_source = every.crossJoin(total).select("subject", share("n").alias("share"))
    rule = F.when(F.col("share") < LEAST_SOURCE, "source_low").when(F.col("share") > MOST_SOURCE, "source_high")
    skewed = by_source.select(rule.alias("rule"), "subject", "share").where("rule is not null")
    return few.unionByName(types).unionByName(skewed)


def missing_cells(golden: DataFrame, sources: Sequence[str], types: Sequence[str], source: str = "expect_source") -> DataFrame:
    """(source, type) pairs without a question."""
    spark = golden.sparkSession
    grid = spark.createDataFrame([(s, t) for s in sources for t in types], "source string, type string")
    return grid.join(golden.select(F.col(source).alias("source"), "type").distinct(), ["source", "type"], "left_anti")


def gaps(golden: DataFrame, targets: Mapping[str, int] = TARGETS, scale: float = 1.0) -> DataFrame:
    """(type, target, have, gap): how many questions of each type are short of its target, which is scaled and
    rounded half to even; never below 0."""
    wanted = golden.sparkSession.createDataFrame([(t, float(n)) for t, n in targets.items()], "type string, n double")
    have = golden.groupBy("type").agg(F.count("*").alias("have"))
    rows = wanted.join(have, "type", "left").select("type", F.bround(F.col("n") * scale).cast("long").alias("target"), F.coalesce("have", F.lit(0)).alias("have"))
    return rows.withColumn("gap", F.greatest(F.col("target") - F.col("have"), F.lit(0).cast("long")))


def normal_question(text: Column) -> Column:
    """A question without white space, marks trimmed at both ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", ""), F.lit("?？.。"))


def fresh_drafts(drafts: DataFrame, existing: DataFrame) -> DataFrame:
    """Drafts (pos, question) that neither the existing set nor an earlier draft asks."""
    keyed = drafts.withColumn("__q", normal_question(F.col("question")))
    known = existing.select(normal_question(F.col("question")).alias("__q")).distinct()
    first = keyed.groupBy("__q").agg(F.min("pos").alias("__first"))
    return keyed.join(known, "__q", "left_anti").join(first, "__q").where(F.col("pos") == F.col("__first")).drop("__q", "__first")


def fill_quota(drafts: DataFrame, golden: DataFrame, targets: Mapping[str, int] = TARGETS) -> DataFrame:
    """The first drafts (pos, type) of each type, as many as it is short of; types without a target are dropped."""
    need = gaps(golden, targets).select("type", "gap")
    place = F.row_number().over(Window.partitionBy("type").orderBy("pos"))
    return drafts.join(need, "type").withColumn("__n", place).where(F.col("__n") <= F.col("gap")).drop("__n", "gap")


def validated(rows: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """rows (qid, expect_chunk, expect_chunks, expect_any) with `problem` and `kept`. A missing expect_chunk drops a
    row; a missing member of expect_chunks or no keyword is only reported."""
    known = chunk_ids.select(F.col("chunk_id").alias("expect_chunk"), F.lit(True).alias("__there")).distinct()
    members = rows.select("qid", F.explode("expect_chunks").alias("expect_chunk")).join(known, "expect_chunk", "left_anti")
    bad = members.groupBy("qid").agg(F.array_sort(F.collect_set("expect_chunk")).alias("__bad"))
    joined = rows.join(known, "expect_chunk", "left").join(bad, "qid", "left")
    problem = F.when(F.col("__there").isNull(), "no expect_chunk").when(F.size("__bad") > 0, "missing members").when(F.coalesce(F.size("expect_any"), F.lit(0)) <= 0, "no keywords")
    return joined.withColumn("problem", problem).withColumn("kept", F.col("__there").isNotNull()).drop("__there", "__bad")


def new_ids(drafts: DataFrame, used: DataFrame, start: int = 1, prefix: str = "m") -> DataFrame:
    """drafts (pos) with qid, in order of pos: the smallest free number at or after ``start`` + its place, each number
    once, three digits at least. Drafts and free numbers are both numbered by ranges (see ``scans``)."""
    n = drafts.count()
    taken = used.select("qid").where(F.col("qid").startswith(prefix))
    most = n + taken.count() + start
    every = drafts.sparkSession.range(start, most + 1).select("id", F.concat(F.lit(prefix), F.when(F.col("id") < 1000, F.lpad(F.col("id").cast("string"), 3, "0")).otherwise(F.col("id").cast("string"))).alias("qid"))
    free = scans.numbered(every.join(taken, "qid", "left_anti"), ["id"], "__n").drop("id")
    return scans.numbered(drafts.drop("qid"), ["pos"], "__n").join(free, "__n").drop("__n")


def append_unseen(golden: DataFrame, more: DataFrame) -> DataFrame:
    return golden.unionByName(more.join(golden.select("qid"), "qid", "left_anti"))


#: Characters that stand for one another or may be missing in a spelling (fixed values).
DASHES, COMMAS = "-~～—–", ",，"


def keyword_pattern(keyword: str) -> str:
    """A regular expression that finds a keyword in other spellings: white space anywhere, any dash for a dash,
    a comma or none for a comma."""
    either = lambda c: f"[{re.escape(DASHES)}]" if c in DASHES else f"[{COMMAS}]?" if c in COMMAS else re.escape(c)
    return r"\s*".join(map(either, keyword))


DROPPED = re.compile(rf"[\s{COMMAS}]+")


class Folded:
    """A text without white space and commas, all dashes alike, made once a keyword needs it, with the places of what was
    dropped. Other spellings of a keyword are what folds to the same; where one stands, the pattern decides."""

    def __init__(self, text: str):
        self.text, self.made = text, None

    @property
    def folded(self) -> str:
        if self.made is None:
            gone = [m.span() for m in DROPPED.finditer(self.text)]
            self.shifts = list(accumulate(end - start for start, end in gone))
            self.marks = [start - before for (start, _), before in zip(gone, [0, *self.shifts])]
            self.made = DROPPED.sub("", self.text).translate(dict.fromkeys(map(ord, DASHES), "-"))
        return self.made

    def place(self, at: int) -> int:
        """The place in the text of a character of the folded one."""
        runs = bisect_right(self.marks, at)
        return at + (self.shifts[runs - 1] if runs else 0)

    def spelling(self, keyword: str) -> str | None:
        """The keyword as the text spells it first, as it is written if the text has that."""
        if keyword in self.text:
            return keyword
        bare = Folded(keyword).folded
        pattern = re.compile(keyword_pattern(keyword))
        if not bare or keyword[0] in COMMAS or any(c.isspace() for c in keyword):  # a match may begin before what is left of it
            found = pattern.search(self.text)
            return found[0] if found else None
        at = self.folded.find(bare)
        while at >= 0:
            if found := pattern.match(self.text, self.place(at)):
                return found[0]
            at = self.folded.find(bare, at + 1)
        return None


def _spellings(texts: pd.Series, keywords: pd.Series) -> pd.Series:
    """Each text's keywords as it spells them, null where it does not; a text is folded once for all of them."""
    out = []
    for text, words in zip(texts, keywords):
        folded = Folded(text) if text is not None else None
        out.append([folded.spelling(w) if folded and w else None for w in words])
    return pd.Series(out, dtype=object)


def repair_keywords(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """golden (qid, expect_chunk, expect_any) with each keyword as its chunk (chunk_id, text) spells it; keywords that
    it does not hold are dropped, and so are questions that keep none. All keywords of all questions of a chunk
    are looked for in it at once; only chunks that a question names are read in Python."""
    asked = golden.select("expect_chunk", F.explode("expect_any").alias("kw")).where("kw <> ''").distinct()
    asked = asked.groupBy("expect_chunk").agg(F.collect_list("kw").alias("kws"))
    held = asked.join(chunks.select(F.col("chunk_id").alias("expect_chunk"), "text"), "expect_chunk")
    real = held.select("expect_chunk", F.map_from_arrays("kws", F.pandas_udf(_spellings, "array<string>")("text", "kws")).alias("real"))
    fixed = golden.join(real, "expect_chunk").withColumn("expect_any", F.filter(F.transform("expect_any", lambda w: F.try_element_at("real", w)), lambda w: w.isNotNull()))
    return fixed.where(F.size("expect_any") > 0).drop("real")


def candidates(chunks: DataFrame, golden: DataFrame, least: int = 80, most: int = 1200) -> DataFrame:
    """Chunks to ask about: no children, of fitting length, not expected by any question yet."""
    named = golden.select(F.explode(F.concat(F.array("expect_chunk"), F.coalesce("expect_chunks", F.array().cast("array<string>")))).alias("chunk_id")).distinct()
    fit = (F.col("role") != "child") & F.length("text").between(least, most)
    return chunks.where(fit).join(named, "chunk_id", "left_anti")


def seeded(key: Column | str, seed: int) -> Column:
    """A number-like text that orders rows at random by seed and key, the same everywhere."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")).cast("binary"))


def stratified(rows: DataFrame, n: int, key: str, source: str = "source", seed: int = 42) -> DataFrame:
    """n rows, from each source in turn, in seeded random order within a source. Only the first n rows of a source
    are ranked on."""
    place = F.row_number().over(Window.partitionBy(source).orderBy(seeded(key, seed), key))
    return rows.withColumn("place", place).where(F.col("place") <= n).orderBy("place", source).limit(n)


def cross_pairs(rows: DataFrame, key: str, source: str = "source", seed: int = 42) -> DataFrame:
    """(place, source_a, a, source_b, b): rows of two different sources, each row in one pair at most. Sources are
    taken two by two in order, and their rows by seeded rank, which is given by slices (see ``scans``): a source may hold
    any share of the rows. Rows beyond the other source's number have no partner."""
    names = scans.numbered(rows.select(F.col(source).alias("s")).distinct(), ["s"], "i").withColumn("i", F.col("i") - 1)
    ranked = scans.numbered(rows.select(F.col(source).alias("s"), F.col(key).alias("k"), seeded(key, seed).alias("draw")), ["draw", "k"], "place", by="s").drop("draw")
    sided = ranked.join(names, "s").withColumn("pair", F.floor(F.col("i") / 2))
    side = lambda odd, s, k: sided.where(F.col("i") % 2 == odd).select("pair", "place", F.col("s").alias(s), F.col("k").alias(k))
    return side(0, "source_a", "a").join(side(1, "source_b", "b"), ["pair", "place"]).drop("pair")


def quality(question: Column, keywords: Column, max_len: int = 60) -> Column:
    """The first reason why a question is no good, or null."""
    q = F.trim(F.coalesce(question, F.lit("")))
    ends = F.lit(False)
    for mark in MARKS:
        ends = ends | q.endswith(mark)
    return (
        F.when(q == "", "empty")
        .when(F.length(q) < 10, "short")
        .when(F.length(q) > max_len, "long")
        .when(~ends, "no question mark")
        .when(~q.rlike(ASKS), "asks nothing")
        .when(q.rlike(CODE), "code")
        .when(F.coalesce(F.size(keywords), F.lit(0)) < 2, "few keywords")
    )


def integrity(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rule, violations): qids unique, expected chunks there with a vector, keywords in the chunk, `multi` with two
    chunks or more."""
    repeated = golden.groupBy("qid").agg(F.count("*").alias("n")).where("n > 1")
    there = chunks.where("vectorize").select(F.col("chunk_id").alias("expect_chunk"), "text")
    absent = golden.join(there, "expect_chunk", "left_anti")
    unheld = golden.join(there, "expect_chunk").where(F.exists("expect_any", lambda kw: ~F.contains("text", kw)))
    thin = golden.where((F.col("type") == "multi") & (F.coalesce(F.size("expect_chunks"), F.lit(0)) < 2))
    rules = {"qid unique": repeated, "chunk exists": absent, "keyword in chunk": unheld, "multi has two": thin}
    out = None
    for rule, rows in rules.items():
        part = rows.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = part if out is None else out.unionByName(part)
    return out
