"""The pipeline against its stages by brute force on the smallest tables."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages_and_run(spark):
    import corpus_pipeline
    from corpuslab.llm import decontaminate, entries, pii, simhash
    from corpuslab.llm.common import stored

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], FOLDER)))
    for d in seen[1:-1]:
        assert d.columns == columns
    ids = [sorted(r["doc_id"] for r in d.select("doc_id").distinct().collect()) for d in seen]
    assert ids[1] == ids[0]  # every text here is prose in one of the languages
    groups = simhash.near_duplicates(seen[1]).collect()
    assert ids[2] == sorted({r["component_id"] for r in groups})
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    bad = {r["doc_id"] for r in decontaminate.contamination(seen[2], bench).where("contaminated").collect()}
    assert bad and ids[3] == sorted(set(ids[2]) - bad)
    assert ids[4] == ids[3] and ids[5] == ids[4]
    left = pii.personal_data(seen[4]).selectExpr("sum(n_email + n_ip + n_card + n_phone)").first()[0]
    before = pii.personal_data(seen[3]).selectExpr("sum(n_email + n_ip + n_card + n_phone)").first()[0]
    assert before > 0 and left == 0
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(entries.tokenizer())
    counts = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) for r in seen[4].collect()}
    assert {r["doc_id"]: r["n"] for r in seen[5].groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()} == counts
    assert corpus_pipeline.run(spark, FOLDER).count() == seen[5].count()


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("name", ["op3_embedding_dedup", "op7_decontamination"])
def test_same_rows_as_sql(spark, name):
    import duckdb

    from corpuslab.llm import entries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    df = entries.queries()[name](spark, FOLDER)
    rel = con.sql(entries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(repr([r[c] for c in rel.columns]) for r in df.collect()) == sorted(repr(list(r)) for r in rel.fetchall())

ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, n_hit string, contaminated string, __key string, __found string, __hits string, __text string, __cuts string, label string"


def odd_documents(spark):
    prose = {"en": "the house and the garden are with a river near it", "de": "das haus und der garten sind mit dem fluss nah"}
    rows = [(i, " ".join([prose[k]] * 3 + [f"w{i}x{j}" for j in range(40)]), k) for i in range(40) for k in [("en", "de")[i % 2]]]
    base = rows[0][1]
    rows += [(100, base, "en"), (100, base, "en"), (101, None, None), (102, "", None), (None, base + " tail of this one", None), (None, None, None), (103, "call the house and the garden at user@mail.example.com now " + " ".join(f"v{j}" for j in range(30)), None), (104, "the house and " + "the garden " * 20000, None)]
    return spark.createDataFrame([(i, t, k, "s", len(t) if t else None, *("kept" for _ in range(10))) for i, t, k in rows], ODD)


def test_stages_on_odd_rows_and_columns(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and columns named like a stage's own: what is not a stage's
    decision stays as it is."""
    import corpus_pipeline
    from corpuslab.llm.common import stored

    docs = odd_documents(spark)
    spark.createDataFrame([(1, " ".join(f"w7x{j}" for j in range(12))), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        left = stored(stage(spark, left, str(tmp_path)))
        seen[name] = left.collect()
        if name != "pack":
            assert left.columns == docs.columns and all(set(r[5:]) == {"kept"} for r in seen[name])
        else:
            assert sum(r["length"] for r in seen[name]) > 40_000
    ids = {name: sorted(((r["doc_id"] if r["doc_id"] is not None else -1) for r in rows)) for name, rows in seen.items() if name != "pack"}
    assert ids["language"] == [-1, *range(40), 100, 100, 103, 104]  # null and empty texts go
    assert 0 in ids["near_duplicates"] and 100 not in ids["near_duplicates"] and set(ids["near_duplicates"]) >= {*range(40), 103, 104}
    assert set(ids["near_duplicates"]) - set(ids["benchmark_passages"]) == {7}
    assert ids["personal_data"] == ids["benchmark_passages"]
    shown = {r["doc_id"]: r for r in seen["personal_data"]}
    assert "<EMAIL>" in shown[103]["text"] and shown[103]["n_chars"] == len(shown[103]["text"]) and shown[1]["text"] == docs.where("doc_id = 1").first()["text"]


def test_stages_keep_nulls_that_reach_them(spark, tmp_path):
    """Stages after the first on null and empty texts and repeated rows, and every stage on an empty table."""
    import corpus_pipeline
    from corpuslab.llm import simhash

    docs = odd_documents(spark).where("doc_id >= 100 or doc_id is null")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    got = lambda name: sorted(((r["doc_id"] or -1, r["text"] or "") for r in stages[name](spark, docs, str(tmp_path)).collect()))
    every = sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.collect())
    assert got("benchmark_passages") == every
    assert [i for i, _ in got("personal_data")] == [i for i, _ in every]
    text = {r["doc_id"]: r["text"] for r in docs.where("text is not null").collect()}
    linked = ((simhash.simhash(text[100].encode()) ^ simhash.simhash(text[None].encode())) % 2**64).bit_count() <= simhash.RADIUS
    # Repeated rows and the empty texts are one each; so is the text without an id, unless it links with one that has.
    assert [i for i, _ in got("near_duplicates")] == [*([] if linked else [-1]), 100, 101, 103, 104]
    empty = docs.limit(0)
    assert all(stage(spark, empty, str(tmp_path)).count() == 0 for stage in stages.values())
