"""Replaced stores, day logs, compaction, table functions, bounded top-k and the stored inverted file."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import chunk, vectors
from corpuslab.sources import stores, tables


def rows_of(df):
    return sorted(map(tuple, df.collect()))


# Stores


def test_a_swap_replaces_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    stores.swap_in(spark.range(5), path)
    stores.swap_in(spark.read.parquet(path).where("id > 1"), path)  # rows come from what they replace
    assert rows_of(spark.read.parquet(path)) == [(2,), (3,), (4,)]
    broken = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error("lost")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        stores.swap_in(broken, path)
    assert rows_of(spark.read.parquet(path)) == [(2,), (3,), (4,)] and os.listdir(tmp_path) == ["t"]


@pytest.mark.parametrize("half", ["set aside", "not dropped", "without mark"])
def test_a_swap_that_stopped_half_way(spark, tmp_path, half):
    path = str(tmp_path / "t")
    stores.swap_in(spark.range(3), path)
    os.rename(path, f"{path}.old")
    if half == "not dropped":
        stores.swap_in(spark.range(4), str(tmp_path / "fresh"))
        os.rename(tmp_path / "fresh", path)
    elif half == "without mark":
        os.makedirs(path)
    stores.recovered(spark, path)
    assert spark.read.parquet(path).count() == (4 if half == "not dropped" else 3) and os.listdir(tmp_path) == ["t"]


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "m")
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "source string, n long")
    old.write.partitionBy("source").parquet(path)
    new = spark.createDataFrame([("b", 20), ("b", 21), ("d", 4)], "source string, n long")
    for _ in range(2):
        stores.replace_partitions(new, path)
        assert rows_of(spark.read.parquet(path).select("source", "n")) == [("a", 1), ("b", 20), ("b", 21), ("c", 3), ("d", 4)]
    broken = spark.createDataFrame([("a", 1)], "source string, n long").withColumn("n", F.raise_error("lost").cast("long"))
    with pytest.raises(Exception, match="lost"):
        stores.replace_partitions(broken, path)
    assert spark.read.parquet(path).count() == 5


def test_chunk_store_keeps_what_was_there(spark, tmp_path):
    store, meta = str(tmp_path / "s"), str(tmp_path / "m")
    make = lambda n: spark.range(n).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.col("id").cast("string").alias("doc_id"), F.lit("s").alias("source"), F.lit("normal").alias("role"), F.lit(True).alias("vectorize"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    about = {"strategy": "fixed", "size": 500, "backend": "none", "tokens": 7, "cost_cny": 0.25, "seconds": 1.5}
    row = tables.write_chunks(make(4), store, meta, about=about).first()
    assert (row["dim"], row["strategy"], row["cost_cny"]) == (2, "fixed", 0.25) and spark.read.json(meta).first()["tokens"] == 7
    broken = make(9).withColumn("chunk_id", F.when(F.col("doc_id") == "8", F.raise_error("lost")).otherwise(F.col("chunk_id")))
    with pytest.raises(Exception, match="lost"):
        tables.write_chunks(broken, store, meta)
    assert spark.read.parquet(store).count() == 4
    tables.write_chunks(spark.read.parquet(store).select(*make(1).columns), store, meta)
    assert spark.read.parquet(store).count() == 4


def test_only_wanted_days_are_listed(spark, tmp_path):
    for day in range(1, 31):
        (tmp_path / f"traffic-202401{day:02d}.jsonl").write_text(json.dumps({"path": "/chat", "status": day}) + "\n{bad\n")
    found = tables.read_traffic(spark, str(tmp_path), "/chat", ["20240103", "20240117", "20240231"])
    assert sorted(r["status"] for r in found.collect()) == [3, 17]
    assert sorted(f[-10:-6] for f in found.inputFiles()) == ["0103", "0117"]
    assert tables.read_traffic(spark, str(tmp_path), "/chat").count() == 30


def test_compaction_keeps_rows(spark, tmp_path):
    folder = tmp_path / "traces"
    folder.mkdir()
    for t in range(20):
        (folder / f"t{t}.jsonl").write_text("\n".join(json.dumps({"trace_id": f"t{t}", "span_id": f"s{i}", "meta": {"k": str(i)}}) for i in range(3)))
    out = tables.compact_traces(spark, str(folder), str(tmp_path / "out"), 20)
    shown = lambda d: sorted(repr(r) for r in d.collect())
    assert shown(out) == shown(tables.read_traces(spark, str(folder))) and len(out.inputFiles()) <= 3


# Table functions


def test_pieces_are_those_of_the_array_form(spark):
    docs = [(i, ("Satz eins. Noch einer，" * i) + "\n\n" + "| a | b |\n|---|---|\n| 1 | 2 |\n" * (i % 3)) for i in range(12)] + [(90, None), (91, "")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    parts = F.split(F.coalesce("text", F.lit("")), "\n\n")
    rows = rows.withColumns({"sections": F.transform(parts, lambda s: F.struct(s.alias("text"))), "code_blocks": F.transform(F.slice(parts, 1, 1), lambda s: F.struct(s.alias("code")))})
    for strategy in chunk.STRATEGIES:
        want = chunk.chunk(rows, strategy, 60, 7).select("doc_id", F.posexplode("pieces").alias("pos", "piece"))
        assert rows_of(chunk.pieces(rows, strategy, 60, 7).select("doc_id", "pos", "piece")) == rows_of(want) and want.count() > 12
    with pytest.raises(ValueError):
        chunk.pieces(rows, "other")


# Vectors


def data(n=600, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    made = rng.standard_normal((n, dim)).astype(np.float32)
    made[10] = made[20] = made[400]  # ties
    made[30] = 0
    return made


def frames(spark, made, step=7):
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(made)] + [(9999, None)], "doc_id long, vector array<float>").repartition(5)
    return docs, docs.where(f"doc_id % {step} = 3 or doc_id in (30, 400)").select(F.col("doc_id").alias("qid"), "vector")


def plain_topk(made, qids, k):
    unit = made.astype(float) / np.maximum(np.linalg.norm(made.astype(float), axis=1, keepdims=True), 1e-300)
    out = []
    for q in qids:
        if made[q].any():
            scores = np.round(unit @ unit[q], 6) + 0.0
            order = np.lexsort((np.arange(len(made)), -scores))[:k]
            out += [(q, int(d), r + 1, float(scores[d])) for r, d in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("block,doc_rows", [(4096, 20_000), (20, 150), (1, 1000)])
def test_topk_by_broadcast_and_by_grid(spark, block, doc_rows):
    made = data()
    docs, queries = frames(spark, made, 29)
    qids = [r["qid"] for r in queries.select("qid").collect()]
    got = [(q, d, r, s + 0.0) for q, d, r, s in rows_of(vectors.topk(docs, queries, 5, block, doc_rows))]
    assert got == plain_topk(made, qids, 5)
    assert vectors.topk(docs.limit(0), queries, 5, block).count() == 0 and vectors.topk(docs, queries.limit(0), 5, block).count() == 0


def test_a_task_gives_its_best_once():
    heap, rng = vectors.Heap(4, 3), np.random.default_rng(0)
    every, seen = np.round(rng.standard_normal((4, 500)), 1), np.zeros((4, 0))
    for at in range(0, 500, 37):
        heap.add(every[:, at : at + 37], np.arange(at, min(500, at + 37)))
    for q in range(4):
        best = np.lexsort((np.arange(500), -every[q]))[:3]
        assert heap.ids[q].tolist() == best.tolist() and len(heap.rows(list("abcd"))) == 12
    assert seen.shape == (4, 0)


def test_stored_inverted_file(spark, monkeypatch):
    monkeypatch.setattr(vectors, "FILE_ROWS", 40)
    made = data()
    docs, queries = frames(spark, made)
    index = vectors.store_ivf(docs, 8, rounds=4)
    assert index.rows().count() == 600 and index.rows(np.array([2])).select("cluster").distinct().count() == 1
    exact = vectors.topk(docs, queries, 5)
    hits, read = vectors.probe_ivf(index, queries, 5, 8)
    assert rows_of(vectors.recall(hits, exact, 5).agg(F.avg("recall") > 0.995)) == [(True,)]
    few, little = vectors.probe_ivf(index, queries, 5, 2)
    took = little.agg(F.avg("codes"), F.max("vectors")).first()
    assert took[0] < 0.5 * 600 and took[1] <= 5 * vectors.CANDIDATES and read.agg(F.min("codes")).first()[0] == 600
    assert 0.3 < vectors.recall(few, exact, 5).agg(F.avg("recall")).first()[0] <= 1.0
    assert few.where("qid = 30").count() == 0
    again = vectors.open_ivf(spark, index.path)
    assert rows_of(vectors.search_ivf(again, queries, 5, 2)) == rows_of(few)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 20)  # several blocks of queries
    assert rows_of(vectors.search_ivf(index, queries, 5, 2)) == rows_of(few)
    assert vectors.search_ivf(index, queries.limit(0), 5, 2).count() == 0
    sizes = {r["cluster"]: r["n"] for r in index.rows().groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    files = {}
    for f in index.rows().inputFiles():
        c = int(f.split("cluster=")[1].split("/")[0])
        files[c] = files.get(c, 0) + 1
    assert any(n > 80 and files[c] > 1 for c, n in sizes.items())


def test_vectors_without_a_direction_are_in_no_cluster(spark):
    docs, queries = frames(spark, data())
    odd = [None, [None] * 8, [None] + [0.5] * 7, [float("nan")] + [0.5] * 7, [float("inf")] + [0.5] * 7]
    width = docs.select(F.max(F.size("vector"))).first()[0]
    odd = [v and (v + [0.25] * width)[:width] for v in odd]
    more = docs.unionByName(spark.createDataFrame([(10_000 + i, v) for i, v in enumerate(odd)], "doc_id long, vector array<float>"))
    assert len(vectors.train_ivf(more.where("doc_id < 3").repartition(6), 2, rounds=1)) == 2  # tasks without rows
    index, plain = vectors.store_ivf(more, 4, rounds=2), vectors.store_ivf(docs, 4, rounds=2)
    assert index.rows().count() == plain.rows().count() and np.isfinite(index.centres).all()
    asked = queries.unionByName(spark.createDataFrame([(10_003, odd[3])], "qid long, vector array<float>"), allowMissingColumns=True)
    assert rows_of(vectors.search_ivf(index, asked, 5, 4)) == rows_of(vectors.search_ivf(plain, queries, 5, 4))
