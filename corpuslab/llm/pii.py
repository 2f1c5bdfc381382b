"""Personal data: base patterns, and contexts learned from them, in DataFrame functions only.

Base spans come from four fixed patterns; secrets, long runs of hexadecimal digits, are seeds too. Their words to the left (lexical patterns) are then scored
on a graph of patterns and instances: a pattern is as good as the instances it introduces, an
instance as good as the patterns that introduce it, seeds being certain. Identifiers that no base
pattern knows are found where patterns of high confidence introduce them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import checkpoint, spare, stored

KINDS = ("email", "ip", "card", "phone")
#: All kinds: the base ones, and secrets, which are seeds of the method like them but no base spans.
SEEDS = (*KINDS, "secret")
#: Leftmost non-overlapping matches of the stated patterns. Look-behinds and possessive quantifiers
#: only save the search from trying starts and splits that cannot give another match, so that it
#: stays linear in long runs; \\G is the end of the match before.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![\p{L}0-9_-])(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,128}+(?![\p{L}0-9_-])",
}
#: What a text must hold for a pattern to be tried.
GATES = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "secret": r"[0-9a-f]{32}"}
PART = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: A candidate instance: groups of digits parted by spaces, brackets, dots or hyphens, as one; or else a run
#: of these characters with at least one digit or @.
GROUPS = r"(?<![\p{L}0-9@._%+/-])\+?\(?[0-9]++(?:[\x20().-]{1,3}+[0-9]++)++(?![\p{L}@_%+/]|[.-][\p{L}@])"
TOKEN = r"(?<![\p{L}0-9@._%+/-])[\p{L}._%+/-]*+[0-9@][\p{L}0-9@._%+/-]*+"
#: Digits that a candidate without @ must have.
LEAST_DIGITS = 4
#: Code points of a text that are rebuilt at a time when its spans are replaced.
PIECE = 1024
ROUNDS, LEAST_SUPPORT, LEAST_CONFIDENCE = 3, 5, 0.9


def _matches(text: Column, what: int, pattern: str, gate: str) -> Column:
    """array<struct<what,n,gap,size,match,tail>> of a pattern's matches: the number of each, the lengths of the
    text between it and the one before and of itself, and the last words of that text, white space as one space."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(matches.alias("match"), F.slice(between, 1, F.size(matches)).alias("left"))

    def row(z: Column, n: Column) -> Column:
        tail = F.substring_index(F.regexp_replace(z["left"], r"\s++", " "), " ", -3)
        sizes = F.length(z["left"]).alias("gap"), F.length(z["match"]).alias("size")
        return F.struct(F.lit(what).alias("what"), n.alias("n"), *sizes, z["match"].alias("match"), tail.alias("tail"))

    none = F.array().cast("array<struct<what:int,n:int,gap:int,size:int,match:string,tail:string>>")
    return F.when(text.rlike(gate), F.transform(both, row)).otherwise(none)


def _holds(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
        "card": F.length(digits).between(12, 19) & F.call_function("luhn_check", F.substr(digits, F.lit(1), F.lit(19))),
        "phone": F.length(digits).between(9, 15),
        "secret": F.lit(True),
    }[kind]


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null for a null text."""
    return F.unhex(F.md5(text))


def candidates(docs: DataFrame) -> DataFrame:
    """(key, start, end, instance, pattern, kind_no) of the seeds of each different text (base spans and
    secrets) and, with no kind, of identifier-like tokens that touch none. Code points, end exclusive.

    pattern: the two words to the left, lower-cased, as far as three matches back, an opening quote or bracket
    before the instance apart; null without two words or a letter in them. Every match becomes a row, and positions are running sums, so a text of any
    number of matches takes time in proportion; copies of a text are one from the map side on."""
    text = F.col("text")
    arrays = [_matches(text, k, PATTERNS[kind], GATES[kind]) for k, kind in enumerate(SEEDS)]
    arrays.append(_matches(text, len(SEEDS), f"{GROUPS}|{TOKEN}", "[0-9@]"))
    # The key is made beside the array, below the explode, or else it would be made for each match.
    rows = docs.where(text.isNotNull()).select(text_key(text).alias("key"), F.concat(*arrays).alias("all"))
    rows = rows.select("key", F.explode("all").alias("m")).select("key", "m.*")
    rows = stored(rows.dropDuplicates(["key", "what", "n"])).repartition("key")
    own = Window.partitionBy("key", "what").orderBy("n")
    before = lambda name, k: F.coalesce(F.lag(name, k).over(own), F.lit(""))
    left = F.substring_index(F.concat(before("tail", 2), before("match", 2), before("tail", 1), before("match", 1), "tail"), " ", -3)
    pattern = F.lower(F.regexp_extract(left, r"^(\S+ \S+) [\"'(\[<]?$", 1))
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(own.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    rows = rows.select("key", "what", (F.col("end") - F.col("size")).alias("start"), "end", F.col("match").alias("instance"), F.when(pattern.rlike(r"\p{L}"), pattern).alias("pattern"))
    match, token = F.col("instance"), F.col("what") == len(SEEDS)
    fine = token & (match.contains("@") | (F.length(F.regexp_replace(match, "[^0-9]", "")) >= LEAST_DIGITS))
    for k, kind in enumerate(SEEDS):
        fine = fine | ((F.col("what") == k) & _holds(kind, match))
    # A token touches a seed if one that starts before the token's end ends behind its start.
    place = F.struct(F.when(token, F.col("end")).otherwise(F.col("start")), ~token)
    reach = F.max(F.when(~token, F.col("end"))).over(Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.where(fine).withColumn("place", place).withColumn("reach", reach)
    rows = rows.where(~token | F.col("reach").isNull() | (F.col("reach") <= F.col("start")))
    return rows.select("key", "start", "end", "instance", "pattern", F.when(~token, F.col("what")).alias("kind_no"))


def _pattern_scores(edges: DataFrame) -> DataFrame:
    """Confidence and kind of the patterns of distinct edges (pattern, instance, kind_no or null).

    Seeds are certain, and instances of LEAST_CONFIDENCE or more count as support like seeds from the round after
    on. A round averages a pattern's instances, then joins an instance's patterns as
    independent evidence. Both sides are grouped with map-side sums over distinct edges, so copies of
    a passage count once and a hot pattern gathers in no task."""
    known = edges.groupBy("instance").agg(F.max("kind_no").alias("seed"))
    edges = checkpoint(edges.select("pattern", "instance").join(known, "instance"))
    scored = edges.select("pattern", "instance", "seed", F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0).alias("score"), F.col("seed").alias("kind_no"))
    numbers = range(len(SEEDS))
    first_most = lambda columns: (F.array_position(F.array(*columns), F.greatest(*columns)) - 1).cast("int")
    for _ in range(ROUNDS):
        patterns = scored.groupBy("pattern").agg(
            F.avg("score").alias("confidence"),
            F.count("kind_no").alias("support"),
            *(F.count_if(F.col("kind_no") == k).alias(f"n{k}") for k in numbers),
        )
        patterns = patterns.where(F.col("support") >= LEAST_SUPPORT).select("pattern", first_most([F.col(f"n{k}") for k in numbers]).alias("as_kind"), "confidence")
        patterns = checkpoint(patterns)
        doubt = F.sum(F.log(F.lit(1.001) - F.coalesce("confidence", F.lit(0.0))))
        best = [F.coalesce(F.max(F.when(F.col("as_kind") == k, F.col("confidence"))), F.lit(0.0)).alias(f"c{k}") for k in numbers]
        instances = edges.where("seed is null").join(patterns, "pattern").groupBy("instance").agg(doubt.alias("doubt"), *best)
        score = F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.exp(F.coalesce("doubt", F.lit(0.0)))))
        scored = edges.join(instances, "instance", "left").withColumn("score", score)
        learned = F.when(F.col("score") >= LEAST_CONFIDENCE, first_most([F.col(f"c{k}") for k in numbers]))
        scored = scored.select("pattern", "instance", "seed", "score", F.coalesce("seed", learned).alias("kind_no"))
    return patterns.where(F.col("confidence") >= LEAST_CONFIDENCE).withColumnRenamed("as_kind", "kind_no")


def spans_of(docs: DataFrame) -> DataFrame:
    """(key, start, end, kind_no, base) of every span of each different text: base ones, secrets, and those that
    contexts add, which touch none of these and no other added one."""
    rows = stored(candidates(docs))
    edges = rows.where("pattern is not null").groupBy("pattern", "instance").agg(F.max("kind_no").alias("kind_no"))
    patterns = stored(_pattern_scores(edges).select("pattern", F.col("kind_no").alias("as_kind")))
    base = rows.where("kind_no is not null").select("key", "start", "end", "kind_no", (F.col("kind_no") < len(KINDS)).alias("base"))
    added = rows.where("kind_no is null").join(patterns, "pattern").select("key", "start", "end", F.col("as_kind").alias("kind_no"), F.lit(False).alias("base"))
    return base.unionByName(added)


def _listed(spans: Column | str) -> Column:
    names = F.array(*map(F.lit, SEEDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind_no: int, span: Column) -> Column:
    return span["kind_no"] == kind_no


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every document of (doc_id, text).

    Null and empty texts have no spans; copies and repeated rows get the same ones; an empty table gives no
    rows. Spans are listed by start, then kind."""
    span = F.struct("start", "kind_no", "end")
    found = spans_of(docs).groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key")).join(stored(found), "key", "left")
    empty = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")
    rows = rows.select("doc_id", F.coalesce("base", empty).alias("base"), F.coalesce("spans", empty).alias("spans"))
    counts = [F.size(F.filter("base", partial(_of_kind, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def _cuts(spans: DataFrame) -> DataFrame:
    """(key, cuts): what goes from each PIECE of a text, as map<piece, array<struct<from,to,label>>>. Overlapping
    spans are one, of the first one's kind; a span over several pieces leaves its label in the first."""
    ordered = Window.partitionBy("key").orderBy("start", "kind_no", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
    spans = spans.withColumn("whole", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("start", "kind_no"))
    whole = spans.groupBy("key", "whole").agg(first.alias("first"), F.max("end").alias("end")).select("key", "first.start", "first.kind_no", "end")
    at = F.floor(F.col("start") / PIECE).cast("int")
    parts = whole.select("*", F.explode(F.sequence(at, F.floor((F.col("end") - 1) / PIECE).cast("int"))).alias("piece"))
    names = F.array(*(F.lit(f"<{kind.upper()}>") for kind in SEEDS))
    base = F.col("piece") * PIECE
    cut = F.struct(
        F.greatest(F.col("start") - base, F.lit(0)).alias("from"),
        F.least(F.col("end") - base, F.lit(PIECE)).alias("to"),
        F.when(F.col("piece") == at, F.get(names, "kind_no")).otherwise("").alias("label"),
    )
    parts = parts.select("key", "piece", cut.alias("cut")).groupBy("key", "piece").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    return parts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("piece", "cuts"))).alias("cuts"))


def _without(piece: Column, cuts: Column) -> Column:
    """A piece of a text with its cuts replaced by their labels."""
    until = lambda i: F.coalesce(F.get(cuts, i)["from"], F.length(piece))
    since = lambda i: F.coalesce(F.get(cuts, i - 1)["to"], F.lit(0))
    part = lambda i: F.concat(F.substr(piece, since(i) + 1, until(i) - since(i)), F.coalesce(F.get(cuts, i)["label"], F.lit("")))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(cuts)), part), "")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets, overlapping spans as one;
    n_chars, where present, is counted anew. All rows and columns stay.

    The texts are shuffled once, at every size, to meet what goes from them. Texts without spans, null and
    empty ones stay as they are; copies and repeated rows change alike; an
    empty table gives no rows."""
    key, listed, cuts = spare(docs, "__key", "__found", "__cuts")
    found = stored(_cuts(spans_of(docs.select("text")))).toDF(listed, cuts).hint("merge")
    joined = docs.withColumn(key, text_key(F.col("text"))).join(found, F.col(key) == F.col(listed), "left")
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    clean = F.array_join(F.transform(pieces, lambda p, i: F.coalesce(_without(p, F.try_element_at(F.col(cuts), i)), p)), "")
    out = joined.withColumn("text", F.when(F.col(cuts).isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
