"""Readers and guarded writers on literal files."""

import hashlib
import json
import os
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from corpuslab.plans import files
from corpuslab.sources import tables


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")
    return str(path)


def test_tolerant_chunks(spark, tmp_path):
    good = {"chunk_id": "a-0000", "text": "x", "vector": [1.0, 2.0]}
    path = lines(tmp_path / "c.jsonl", [good, "", "   ", 'junk{"chunk_id": "b-0000", "text": "y", "vector": [3.0]}', "not json", {"chunk_id": "c-0000", "text": "z", "vector": []}, {"chunk_id": "d", "vector": None}])
    assert sorted(r["chunk_id"] for r in tables.read_chunks(spark, path).collect()) == ["a-0000", "b-0000"]


def test_ledger(spark, tmp_path):
    path = lines(tmp_path / "l.jsonl", [{"provider": "p", "model": "m", "in": 5, "cached": 2, "cost_cny": 0.5}, "", "{bad", {"model": "m", "hit": 7, "cost_cny": None}])
    rows = tables.read_ledger(spark, path).orderBy("cost_cny").collect()
    assert [(r["provider"], r["cost_cny"], r["cached"], r["cached_any"]) for r in rows] == [("?", 0.0, None, 7), ("p", 0.5, 2, 2)]


def test_traffic(spark, tmp_path):
    path = lines(tmp_path / "t.jsonl", [{"path": "/a/x", "status": 200, "response": "r"}, "{oops", {"path": "/b", "status": 500}])
    assert [r["path"] for r in tables.read_traffic(spark, path, "/a").collect()] == ["/a/x"]


def test_traces_and_notes(spark, tmp_path):
    (tmp_path / "tr").mkdir()
    lines(tmp_path / "tr" / "t1.jsonl", [{"trace_id": "t1", "span_id": "a", "meta": {"k": "v"}}])
    row = tables.read_traces(spark, str(tmp_path / "tr")).first()
    assert row["meta"] == {"k": "v"} and row["file"].endswith("t1.jsonl")
    (tmp_path / "notes" / "deep").mkdir(parents=True)
    (tmp_path / "notes" / "a.md").write_text("one\ntwo")
    (tmp_path / "notes" / "deep" / "b.txt").write_text("three")
    (tmp_path / "notes" / "c.csv").write_text("no")
    assert {(r["name"], r["text"]) for r in tables.read_notes(spark, str(tmp_path / "notes")).collect()} == {("a.md", "one\ntwo"), ("b.txt", "three")}


def test_bodies(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.html").write_text("<p>a</p>")
    manifest = spark.createDataFrame([("a.html", 200, None), ("gone.html", 200, None), ("b.html", 404, "HTTP 404"), (None, 200, None)], "path string, status int, error string")
    rows = {r["path"]: (r["body"], r["reason"]) for r in tables.read_bodies(spark, manifest, str(tmp_path / "raw")).collect()}
    assert rows["a.html"] == ("<p>a</p>", None) and rows["gone.html"][1] == "file missing" and rows["b.html"][1] == "fetch failed: HTTP 404" and rows[None][1].startswith("fetch failed")


def chunks(spark, n):
    return spark.range(n).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.col("id").cast("string").alias("doc_id"), F.lit("s").alias("source"), F.lit("normal").alias("role"), F.lit(True).alias("vectorize"))


def test_writes_and_shrink_guard(spark, tmp_path):
    store, meta = str(tmp_path / "store"), str(tmp_path / "meta")
    about = tables.write_chunks(chunks(spark, 5), store, meta).first()
    assert (about["ready"], about["n_chunks"], about["n_vectorized"], about["sources"]) == (True, 5, 5, ["s"])
    tables.write_chunks(chunks(spark, 5), store, meta)
    with pytest.raises(ValueError):
        tables.write_chunks(chunks(spark, 4), store, meta)
    tables.write_chunks(chunks(spark, 4), store, meta, force=True)
    assert spark.read.parquet(store).count() == 4 and spark.read.json(meta).first()["n_chunks"] == 4


def test_two_sinks_and_upsert(spark, tmp_path):
    docs = spark.createDataFrame([("a", "s", "u", "t", None), ("b", "s", "v", None, "short")], "doc_id string, source string, url string, text string, reason string")
    tables.write_parsed(docs, str(tmp_path / "ok"), str(tmp_path / "bad"))
    assert [r["doc_id"] for r in spark.read.json(str(tmp_path / "ok")).collect()] == ["a"]
    assert [r["reason"] for r in spark.read.json(str(tmp_path / "bad")).collect()] == ["short"]
    old = spark.createDataFrame([("s1", "a"), ("s2", "b")], "source string, url string")
    new = spark.createDataFrame([("s2", "c"), ("s3", "d")], "source string, url string")
    assert sorted(r["url"] for r in tables.upsert_manifest(old, new).collect()) == ["a", "c", "d"]


def test_fetch_summary(spark):
    rows = spark.createDataFrame([("a", 200, 10), ("a", 200, 15), ("a", 404, 99), ("b", 500, 1)], "source string, status int, bytes long")
    got = {r["source"]: (r["total"], r["ok"], r["failed"], r["avg_bytes"]) for r in tables.fetch_summary(rows).collect()}
    assert got == {"a": (3, 2, 1, 12), "b": (1, 0, 1, 0), None: (4, 2, 2, 12)}


def test_packed_files(spark, tmp_path):
    root = str(tmp_path / "packs")
    tables.write_files(spark.createDataFrame([("a/x.html", "<p>x</p>"), ("b/y.html", ""), ("c/z.html", None), ("d/n.md", "one\ntwo"), ("e/o.txt", "\n")], "path string, value string"), root)
    manifest = spark.createDataFrame([("a/x.html", 200, None), ("b/y.html", 200, None), ("c/z.html", 200, None), ("gone.html", 200, None), ("d/n.md", 404, "HTTP 404"), (None, 200, None), (None, 200, None), (None, 404, "HTTP 404")], "path string, status int, error string")
    rows = sorted(((r["path"], r["body"], r["reason"]) for r in tables.read_bodies(spark, manifest, root, packed=True).collect()), key=repr)
    assert rows == sorted([("a/x.html", "<p>x</p>", None), ("b/y.html", "", None), ("c/z.html", None, None), ("gone.html", None, "file missing"), ("d/n.md", "one\ntwo", "fetch failed: HTTP 404"), (None, None, "fetch failed: 200"), (None, None, "fetch failed: 200"), (None, None, "fetch failed: HTTP 404")], key=repr)
    assert {tuple(r) for r in tables.read_notes(spark, root, packed=True).collect()} == {("n.md", "one\ntwo"), ("o.txt", "\n")}
    assert {tuple(r) for r in tables.read_notes(spark, root, "?.{html}", whole_name=True, packed=True).collect()} == {("a/x.html", "<p>x</p>"), ("b/y.html", ""), ("c/z.html", None)}


def test_single_files_made_packs(spark, tmp_path):
    for name, text in (("a/x.html", "<p>\u00e9</p>\n"), ("b/deep/y.html", "y")):
        (tmp_path / "raw" / name).parent.mkdir(parents=True)
        (tmp_path / "raw" / name).write_text(text, encoding="utf-8")
    tables.write_files(tables.whole_files(spark, str(tmp_path / "raw")), str(tmp_path / "packs"))
    assert {tuple(r) for r in tables.whole_files(spark, str(tmp_path / "packs"), packed=True).collect()} == {("a/x.html", "<p>\u00e9</p>\n"), ("b/deep/y.html", "y")}


def written(spark):
    """The number of files in the session's shared folder."""
    return sum(len(files) for _, _, files in os.walk(urlsplit(spark.sparkContext.getCheckpointDir()).path))


def test_bodies_query_writes_no_file_a_page(spark, tmp_path):
    texts = ["<p>\u00e9</p>", "", None, "a\n<!-- end -->", "line\r\nline\n"]
    pages = [(i, f"u{i}", texts[i // 35 % 5]) for i in range(350)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2).write.parquet(str(tmp_path / "pages.parquet"))
    before = written(spark)
    got = {r["page_id"]: (r["reason"], r["body_md5"]) for r in files.bodies_read(spark, str(tmp_path)).collect()}
    assert written(spark) - before < 20
    digest = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    want = {i: ("fetch failed: HTTP 404", None) if i % 5 == 0 else ("fetch failed: 200", None) if i % 7 == 0 else (None, digest(t)) for i, _, t in pages}
    assert got == want


def test_notes_query_writes_no_file_a_conversation(spark, tmp_path):
    turns = [(i, turn, "user", [None, "", "a\nb", "\u00e9"][(i + turn) % 4]) for i in range(200) for turn in range(3)] + [(None, 0, "user", "xy"), (7, 1, "user", "again")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(2).write.parquet(str(tmp_path / "conversations.parquet"))
    before = written(spark)
    got = {r["name"]: (r["lines"], r["n_chars"]) for r in files.notes_read(spark, str(tmp_path)).collect()}
    assert written(spark) - before < 20
    want = {}
    for i, _, _, text in turns:
        name = None if i is None else f"{i}.md"
        lines, n = want.get(name, (0, 0))
        want[name] = (lines + 1, n + len(text or "") + 1)
    assert got == want
