"""Licence scans: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re
from bisect import bisect_right

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import spare, stretches
from corpuslab.llm.decontaminate import normalise
from corpuslab.llm.license_rules import rules

#: Base phrases and their labels (fixed values). They are always reported.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
BASE_STRENGTH = 0.6
FOUND = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double>"


class Intervals:
    """Intervals none of which lies inside another, by rising start and so by rising end: of those that start no later
    than a given one, the last reaches furthest, so one bisection tells whether any contains it."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def contain(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start)
        return i > 0 and self.ends[i - 1] >= end

    def add(self, more: list[tuple[int, int]]) -> None:
        every = sorted([*zip(self.starts, self.ends), *more], key=lambda x: (x[0], -x[1]))
        self.starts, self.ends = [], []
        for start, end in every:
            if not self.ends or end > self.ends[-1]:
                self.starts.append(start)
                self.ends.append(end)


class Signatures:
    """The compiled rules, made once in each Python worker."""

    def __init__(self):
        self.gate = None

    def _make(self) -> None:
        self.rules = [(label, strength, re.compile(f" (?:{pattern})(?= )")) for label, strength, _, pattern in rules()]
        by_keyword: dict[str, list[int]] = {}
        for i, (_, _, keyword, _) in enumerate(rules()):
            by_keyword.setdefault(keyword, []).append(i)
        self.gate = ahocorasick.Automaton()
        for phrase in BASE:
            self.gate.add_word(f" {phrase} ", (phrase, ()))
        for keyword, which in by_keyword.items():
            self.gate.add_word(f" {keyword}", (None, which))
        self.gate.make_automaton()

    def scan(self, text: bytes | None) -> tuple:
        """What FOUND names. One pass over the words finds base phrases and keywords; only the rules of
        keywords that occur are tried. A detection inside an interval of an earlier rule is dropped."""
        if self.gate is None:
            self._make()
        words = normalise(text)
        line = " " + b" ".join(words).decode("utf-8", "replace") + " "
        ends, bases, tried = [], [], set()
        for end, (phrase, which) in self.gate.iter(line):
            if phrase is None:
                tried.update(which)
            else:
                ends.append(end)
                bases.append(phrase)
        if not ends and not tried:
            return len(words), 0, None, None, "", "", 0.0
        kept = Intervals()
        labels = {BASE[b] for b in bases}
        doubt = 1.0 - BASE_STRENGTH * bool(bases)
        for i in sorted(tried):
            label, strength, pattern = self.rules[i]
            own = [m.span() for m in pattern.finditer(line)]
            own = [span for span in own if not kept.contain(*span)]
            if own:
                kept.add(own)
                labels.add(label)
                doubt *= 1.0 - strength
        first = last = None
        if ends:
            spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
            starts = np.searchsorted(spaces, ends) - [b.count(" ") + 1 for b in bases]
            first, last = int(starts.min()), int(starts.max())
        base = ",".join(sorted({BASE[b] for b in bases}))
        return len(words), len(ends), first, last, base, ",".join(sorted(labels)), round(1.0 - doubt, 6)


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score of every
    whole text; columns of these names are replaced, all others stay. No shuffle.

    n_base counts the places of all base phrases, first_word and last_word are their smallest and
    largest word positions (null without any). labels adds those of the rules. score joins the
    strengths of what was found as independent evidence; 0 where nothing was. A null text has no
    words; repeated rows are scanned each; an empty table gives no rows."""
    signatures = docs.sparkSession.sparkContext.broadcast(Signatures())

    @F.arrow_udf(FOUND)
    def scanned(texts: pa.Array) -> pa.Array:
        rows = [signatures.value.scan(t) for part in stretches(texts) for t in part.to_pylist()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    (found,) = spare(docs, "__found")
    out = docs.withColumn(found, scanned(F.encode("text", "UTF-8")))
    for name in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"):
        out = out.withColumn(name, F.col(found)[name])
    return out.drop(found)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id and the findings of ``scan`` for every document."""
    return scan(docs.select("doc_id", "text")).drop("text")
