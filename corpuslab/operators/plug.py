"""Plug points: functions that call a model, run over batches inside the tasks. What they give is a column like any
other, so rankers, generators and judges of any kind feed the operators that take their output as input."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def _kinds(rows: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)


def each(rows: DataFrame, fn: Callable[..., list], inputs: Sequence[str], output: str, kind: str = "string", batch: int = 64) -> DataFrame:
    """``rows`` with the column ``output``: what ``fn`` gives for the lists of ``inputs`` of up to ``batch`` rows, one
    value for each. For generators, judges, and rewrites of a query (``kind`` array<string> for several)."""
    kept = [c for c in rows.columns if c != output]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values: list = []
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                made = fn(*(part[c].tolist() for c in inputs))
                if len(made) != len(part):
                    raise ValueError(f"{len(made)} values for {len(part)} rows")
                values += made
            yield frame[kept].assign(**{output: values})

    return rows.mapInPandas(run, f"{_kinds(rows, kept)}, `{output}` {kind}")


def per_query(found: DataFrame, fn: Callable[[str, list[str]], object], output: str, kind: str = "string", pool: int = 50) -> DataFrame:
    """(qid, ``output``): one call of ``fn(question, texts)`` for each query of found (qid, question, rank, text), its
    first ``pool`` texts in order of rank. For rerankers that see all candidates, and for answers from hits."""
    rows = found.where(found["rank"] <= pool).select("qid", "question", "rank", "text")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank", kind="stable")
        return pd.DataFrame({"qid": frame["qid"].iloc[:1].tolist(), output: [fn(frame["question"].iloc[0], frame["text"].tolist())]})

    return rows.groupBy("qid").applyInPandas(run, f"{_kinds(rows, ['qid'])}, `{output}` {kind}")


def strategy(queries: DataFrame, search: Callable[[DataFrame, int], DataFrame], rewrite: Callable[[DataFrame], DataFrame] | None = None, after: Callable[[DataFrame], DataFrame] | None = None, topk: int = 5, pool: int = 50) -> DataFrame:
    """A retrieval strategy of parts: the queries rewritten, searched for ``pool`` hits, and worked on after, cut to
    ``topk``. The parts are functions of DataFrames, so a strategy is one plan."""
    found = search(rewrite(queries) if rewrite else queries, pool)
    found = after(found) if after else found
    return found.where(found["rank"] <= topk)
