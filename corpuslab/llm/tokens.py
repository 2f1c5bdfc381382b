"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import stretches

#: The byte-level pre-tokenizer's pattern (fixed values).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts a Python worker remembers; beyond, it starts anew, which costs time only.
REMEMBERED = 400_000
NONE = np.iinfo(np.int64).max


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


class Merges:
    """Vocabulary, merges and special strings of a tokenizer file (JSON, byte-level BPE)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.base = max(vocab.values()) + 1
        keys = left * self.base + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bytes = np.array([vocab[c] for _, c in sorted(byte_symbols().items())], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.pretoken = regex.compile(PRETOKEN)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where there is no merge."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merged_lengths(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each of ``words`` (none empty).

        The words are one ragged array of symbols. Each round takes every word's lowest rank, merges
        all its pairs of that rank, left to right without overlap, and drops the merged cells; words
        without a mergeable pair leave. A later merge never outranks the one that made its symbols,
        so this gives what merging one pair at a time gives."""
        lengths = np.array([len(w) for w in words], np.int64)
        out = lengths.copy()
        symbols = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        ids = np.arange(len(words))
        ranks = self._pair_ranks(symbols, lengths)
        while len(ids):
            starts = np.cumsum(lengths) - lengths
            lowest = np.minimum.reduceat(ranks, starts)
            if (lowest == NONE).any():
                out[ids[lowest == NONE]] = lengths[lowest == NONE]
                keep = lowest != NONE
                cells = np.repeat(keep, lengths)
                symbols, ranks, ids, lengths, lowest = symbols[cells], ranks[cells], ids[keep], lengths[keep], lowest[keep]
                if not len(ids):
                    break
            word = np.repeat(np.arange(len(ids)), lengths)
            hit = ranks == lowest[word]
            if (hit[1:] & hit[:-1]).any():  # a run such as aaa: every second pair is taken
                at = np.flatnonzero(hit)
                first = np.flatnonzero(np.append(True, np.diff(at) > 1))
                place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                hit[at[place % 2 == 1]] = False
            at = np.flatnonzero(hit)
            symbols[at] = self.made[ranks[at]]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            lengths = lengths - np.bincount(word[at], minlength=len(ids))
            fresh = np.zeros(len(symbols), bool)
            fresh[at] = True
            symbols, ranks, fresh = symbols[~gone], ranks[~gone], fresh[~gone]
            last = np.cumsum(lengths) - 1
            redo = fresh.copy()
            redo[:-1] |= fresh[1:]
            where = np.flatnonzero(redo)
            ranks[where] = self.rank(symbols[where], symbols[np.minimum(where + 1, len(symbols) - 1)])
            ranks[last] = NONE
        return out

    def _pair_ranks(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        ranks = self.rank(symbols, np.append(symbols[1:], 0)) if len(symbols) else np.zeros(0, np.int64)
        if len(symbols):
            ranks[np.cumsum(lengths) - 1] = NONE
        return ranks

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text. A special string inside a text is one token and parts its surroundings."""
        pieces, specials = [], []
        for text in texts:
            parts = self.cut.split(text or "") if self.cut else [text or ""]
            specials.append(len(parts) - 1)
            pieces.append([p for part in parts for p in self.pretoken.findall(part)])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({p for row in pieces for p in row}.difference(self.known))
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            self.known.update(zip(some, self.merged_lengths([p.encode() for p in some]).tolist()))
        size = self.known.__getitem__
        return [sum(map(size, row)) + n for row, n in zip(pieces, specials)]


class Tokenizer:
    """The file's content, read into ``Merges`` once in each Python worker."""

    def __init__(self, source: str):
        self.source, self.merges = source, None

    def counts(self, texts: list[str | None]) -> list[int]:
        self.merges = self.merges or Merges(self.source)
        return self.merges.counts(texts)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every whole
    text; columns of these names are replaced, all others stay. ``tokenizer`` is the path of a
    byte-level BPE file on the driver, whose content goes to the workers. A null text counts as
    empty (0 tokens); repeated rows are counted each; an empty table gives no rows. No shuffle."""
    with open(tokenizer, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(Tokenizer(file.read()))

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([n for part in stretches(texts) for n in shared.value.counts(part.to_pylist())], pa.int64())

    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("n_bytes", F.octet_length(text).cast("long")).withColumn("n_tokens", counted(text))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
