"""Stored indexes, prefix scans, dictionaries, keyword repair and read-only queries against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import bm25, cost, curate, guards, inverted, matching, scans

RNG = random.Random(3)


# Inverted index


def corpus(n=400):
    common, rare = ["a", "b", "c", "d"], [f"w{i}" for i in range(60)]
    texts = [" ".join(RNG.choices(common, k=RNG.randint(0, 30)) + RNG.choices(rare, k=RNG.randint(0, 8))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, "模型 a 限流"), (9003, "a " * 50_000), (9004, texts[3])]


@pytest.mark.parametrize("bucket_docs,first", [(4, 1), (16, 16), (10_000, 1)])
def test_index_search_is_exact_whatever_it_leaves_out(spark, monkeypatch, bucket_docs, first):
    monkeypatch.setattr(inverted, "FIRST_BUCKETS", first)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    queries = spark.createDataFrame([(1, "w1 w2 a"), (2, "w3 w3 限流"), (3, "a b c d"), (4, "nowhere"), (5, None), (6, "w5")], "qid long, question string")
    index = inverted.build(docs, bucket_docs=bucket_docs)
    want = sorted(map(tuple, bm25.topk(docs, queries, 3).collect()))
    search = inverted.Search(index, queries, 3)
    assert sorted(map(tuple, search.hits().collect())) == want and {w[0] for w in want} == {1, 2, 3, 6}
    reads = {r["qid"]: (r["held"], r["read"]) for r in search.reads().collect()}
    assert all(read <= held for held, read in reads.values()) and reads[6][0] == docs.where("text rlike '\\\\bw5\\\\b'").count()
    if bucket_docs == 4:
        assert sum(r for _, r in reads.values()) < 0.95 * sum(h for h, _ in reads.values())
    again = inverted.opened(spark, index.path)
    assert (again.n, again.avgdl) == (index.n, index.avgdl) and sorted(map(tuple, inverted.topk(again, queries, 3).collect())) == want
    stats = {r["term"]: (r["df"], round(r["idf"], 9)) for r in inverted.statistics(index).collect()}
    assert stats == {r["term"]: (r["df"], round(r["idf"], 9)) for r in bm25.index_stats(docs).collect()}


def test_index_of_nothing(spark):
    empty = inverted.build(spark.createDataFrame([], "doc_id long, text string"))
    queries = spark.createDataFrame([(1, "a")], "qid long, question string")
    assert inverted.topk(empty, queries).count() == 0 and inverted.topk(inverted.build(spark.createDataFrame([(1, None)], "doc_id long, text string")), queries).count() == 0


def test_half_an_index_is_none(spark, tmp_path):
    (tmp_path / "blocks").mkdir()
    with pytest.raises(Exception, match="about"):
        inverted.opened(spark, str(tmp_path))


# Scans


def scan_rows():
    rows = [("hot", RNG.randint(0, 10**6), i, RNG.choice([0.5, 1.25, None])) for i in range(6000)] + [(RNG.choice(["x", "y", None]), RNG.randint(0, 50), 10_000 + i, 1.0) for i in range(300)]
    return rows


def test_prefix_scans_cut_a_hot_key(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one slice
    try:
        _prefix_scans_cut_a_hot_key(spark, scan_rows())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _prefix_scans_cut_a_hot_key(spark, rows):
    df = spark.createDataFrame(rows, "k string, ts long, id long, v double").repartition(5)
    sliced = scans.sliced(df, "k", ["ts", "id"])
    slices = [r["n"] for r in sliced.groupBy(scans.SLICE).agg(F.count("*").alias("n")).collect()]
    assert len(slices) >= 3 and max(slices) < 0.6 * len(rows)
    got = scans.bare(scans.prefix(sliced, "k", ["ts", "id"], {"s": ("sum", F.col("v")), "m": ("max", F.col("id")), "n": ("sum", F.lit(1))}))
    want, state = {}, {}
    for k, ts, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        s, m, n = state.get(k, (None, -1, 0))
        state[k] = (s if v is None else (s or 0.0) + v, max(m, i), n + 1)
        want[i] = state[k]
    assert {r["id"]: (r["s"], r["m"], r["n"]) for r in got.collect()} == want


def test_hot_tenants_and_sessions(spark):
    rows = [("hot", i, i, 0.25) for i in range(3000)] + [("cold", 1, 5000, None), ("cold", 2, 5001, 800.0)]
    got = {r["id"]: (r["so_far"], r["open"]) for r in cost.running_budget(spark.createDataFrame(rows, "tenant string, ts long, id long, cost_cny double"), 500.0).collect()}
    assert got[1998] == (499.75, True) and got[1999] == (500.0, True) and got[2000] == (500.25, False) and got[5001] == (800.0, True) and got[5000] == (0.0, True)
    kinds = [RNG.choice(["failure", "success", "success", "other"]) for _ in range(2500)]
    df = spark.createDataFrame([("s", i, k) for i, k in enumerate(kinds)], "session string, ts long, outcome string")
    failures, tripped, want = 0, False, []
    for k in kinds:
        failures = 0 if k == "success" else failures + (k == "failure")
        tripped = tripped or failures >= 3
        want.append((failures, tripped))
    assert [(r["failures"], r["tripped"]) for r in guards.breaker(df).orderBy("ts").collect()] == want and want[-1][1]


def test_numbers_without_one_task(spark):
    df = spark.createDataFrame([(i * 7 % 1000, i) for i in range(1000)], "a long, b long").repartition(4)
    assert {r["a"]: r["n"] for r in scans.numbered(df, ["a"], "n").collect()} == {i: i + 1 for i in range(1000)}
    drafts = spark.createDataFrame([(i, f"d{i}") for i in range(50)], "pos long, draft string")
    used = spark.createDataFrame([("m002",), ("m004",), ("other",)], "qid string")
    ids = [r["qid"] for r in curate.new_ids(drafts, used).orderBy("pos").collect()]
    assert ids[:4] == ["m001", "m003", "m005", "m006"] and ids[-1] == "m052"


# Dictionaries


def test_dictionary_of_thousands_in_one_scan(spark, monkeypatch):
    words = sorted({"".join(RNG.choice("abcd") for _ in range(RNG.randint(1, 6))) for _ in range(3000)} | {"限流", "ä"})
    texts = ["".join(RNG.choice("abcd ") for _ in range(RNG.randint(0, 60))) for _ in range(80)] + [None, "", "x限流xä"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    known = spark.createDataFrame(list(enumerate(words)), "key long, word string")
    want = sorted((i, k) for i, t in enumerate(texts) if t for k, w in enumerate(words) if w in t)
    assert sorted((r["i"], r["key"]) for r in matching.holding(df, known).collect()) == want
    monkeypatch.setattr(matching, "BLOCK_BYTES", 3000)
    assert sorted((r["i"], r["key"]) for r in matching.holding(df, known).collect()) == want
    empty = spark.createDataFrame([(1, ""), (2, None)], "key long, word string")
    assert matching.holding(df, empty).count() == len(texts) - 1 and matching.holding(df, empty.limit(0)).count() == 0


# Keywords


def plain_spelling(text, keyword):
    if keyword in text:
        return keyword
    found = re.search(curate.keyword_pattern(keyword), text)
    return found[0] if found else None


def test_keyword_repair_against_the_pattern(spark):
    alphabet = "ab1 -,–\n，　"
    texts = ["".join(RNG.choice(alphabet) for _ in range(RNG.randint(0, 40))) for _ in range(150)]
    keywords = [["".join(RNG.choice(alphabet) for _ in range(RNG.randint(1, 5))) for _ in range(6)] + ["ab", "", None, "ab"] for _ in texts]
    golden = spark.createDataFrame([(f"q{i}", i, k) for i, k in enumerate(keywords)] + [("none", 999, ["a"])], "qid string, expect_chunk long, expect_any array<string>")
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(500, None)], "chunk_id long, text string")
    got = {r["qid"]: r["expect_any"] for r in curate.repair_keywords(golden, chunks).collect()}
    want = {f"q{i}": [s for k in ks if k and (s := plain_spelling(t, k)) is not None] for i, (t, ks) in enumerate(zip(texts, keywords))}
    assert got == {q: w for q, w in want.items() if w}


# Read-only queries


@pytest.mark.parametrize(
    "sql",
    ["with a as (select 1 as x) insert into t select x from a", "insert into t values (1)", "create table u as select 1", "create or replace temp view orders as select 1", "select 1; select 2", "drop table t", "set x = 1", "from orders insert into t select 1", "cache table t", "describe t", "explain select 1", "", "no sql"],
)
def test_only_queries_run(spark, sql):
    df = spark.createDataFrame([(1, "x")], "order_id long, city string")
    spark.createDataFrame([(9,)], "mine long").createOrReplaceTempView("orders")
    with pytest.raises(ValueError):
        guards.select_only(df, sql)
    assert spark.table("orders").columns == ["mine"]


def test_read_only_queries(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "order_id long, city string")
    spark.createDataFrame([(9,)], "mine long").createOrReplaceTempView("orders")
    got = lambda sql, **k: [tuple(r) for r in guards.select_only(df, sql, **k).collect()]
    assert got("select city, count(*) as n from orders group by city order by n desc;") == [("y", 2), ("x", 1)]
    assert got("WITH a AS (SELECT * FROM orders WHERE order_id > 1) SELECT max(order_id) FROM a") == [(3,)]
    assert got("select order_id from orders where city = 'a;b' or order_id = (select max(order_id) from orders)") == [(3,)]
    assert len(got("select * from orders", limit=0)) == 1 and spark.table("orders").columns == ["mine"]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("__orders")]


# Strategies and running totals


def test_a_strategy_is_its_parts(spark):
    from corpuslab.operators import fuse, plug

    docs = spark.createDataFrame([(1, "red apple", "s"), (2, "green apple", "t"), (3, "red car", "t")], "doc_id long, text string, source string")
    index = inverted.build(docs)
    queries = spark.createDataFrame([(1, "fruit", "apple"), (2, "red", None)], "qid long, question string, hypothesis string")
    only_t = lambda found: fuse.postfilter(found.join(docs.select("doc_id", "source"), "doc_id"), "t", 10)
    got = plug.strategy(queries, lambda q, k: inverted.topk(index, q, k), fuse.hypothetical, only_t, topk=2, pool=3)
    assert sorted((r["qid"], r["doc_id"]) for r in got.collect()) == [(1, 2), (2, 3)]
    plain = plug.strategy(queries, lambda q, k: inverted.topk(index, q, k), topk=1)
    assert [(r["qid"], r["doc_id"]) for r in plain.collect()] == [(2, 1)]


def test_running_totals_of_windows(spark):
    from corpuslab.streaming import jobs

    rows = [(w, k, m, w + 1, 0.5 * w) for w in range(50) for k in ("a", None) for m in (1, 2)]
    df = spark.createDataFrame(rows, "start long, event_type string, model long, calls long, cost double")
    got = {(r["start"], r["event_type"], r["model"]): (r["calls_so_far"], r["cost_so_far"]) for r in jobs.running_totals(df, ("event_type", "model")).collect()}
    assert got == {(w, k, m): ((w + 1) * (w + 2) // 2, 0.25 * w * (w + 1)) for w, k, m, _, _ in rows}


def test_what_embedding_takes(spark):
    from corpuslab.operators import vectors

    df = spark.createDataFrame([("a b c",), ("模型",), (None,)], "text string")
    assert tuple(vectors.embedding_cost(df, 100_000.0).first()) == (3, 4, 0.4)


@pytest.mark.parametrize("doc_rows,query_bytes,count_tokens", [(32, 1, 10), (7, 200, 1), (2048, 32 << 20, 500_000)])
def test_a_task_searches_in_pieces_and_gives_its_best_once(spark, monkeypatch, doc_rows, query_bytes, count_tokens):
    for name, value in (("DOC_ROWS", doc_rows), ("QUERY_BYTES", query_bytes), ("COUNT_TOKENS", count_tokens), ("FIRST_BUCKETS", 1)):
        monkeypatch.setattr(inverted, name, value)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(["w1 w2 a", "w3 w3 限流", "a b c d", None, "w5", "a a w7"])], "qid string, question string")
    index = inverted.build(docs, bucket_docs=4)
    assert index.docs().count() == index.n == docs.count()
    search = inverted.Search(index, queries, 3)
    assert sorted(map(tuple, search.hits().collect())) == sorted(map(tuple, bm25.topk(docs, queries, 3).collect()))
    tasks = index.docs().rdd.getNumPartitions()
    assert search.found.where("score is not null").groupBy("qid").count().agg(F.max("count")).first()[0] <= 3 * tasks


def test_the_index_shuffles_no_tokens(spark):
    rows = spark.createDataFrame([(i, "a b c " * 200) for i in range(50)], "doc_id long, text string")
    index = inverted.build(rows)
    assert {(r["dl"], tuple(r["terms"]), tuple(r["counts"])) for r in index.docs().collect()} == {(600, ("a", "b", "c"), (200, 200, 200))}
    assert len(index.docs().inputFiles()) == rows.rdd.getNumPartitions()  # written where the texts are read
