"""WARC archives, the filter audit and importance resampling against plain versions: nulls, empty and long texts, ties, repeats, clashing columns."""

import gzip
import hashlib
import io
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from corpuslab.llm import audit, resample, warc

PAGES = "page_id long, url string, html string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(11)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# 11


def page_table():
    big, other = "<p>ä</p>" * 200, "<b>WARC/1.1\r\nContent-Length: 3\r\n\r\nabc</b>" * 60
    rows = [(1, "http://a/1", big), (7, "http://a/7", big), (3, None, big), (4, "http://a/4\r\nX: y", "short"), (5, "http://a/5", "short"), (6, "http://a/6", None), (8, "u", ""), (9, "u", other), (2, "u", other)]
    rows += [(20 + i, f"http://b/{i}", "x" * 999 + "y" * (i % 2)) for i in range(12)] + [(40, "u", "zé" * 700_000)]
    return rows


def plain_pages(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        top = max(p for p, _, h in rows if (h or "") == (html or ""))
        again = len(data) >= 1000 and page < top
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out)


def test_round_trip(spark, tmp_path):
    rows = page_table()
    df = spark.createDataFrame(rows, PAGES).withColumns({"__key": F.lit(1), "type": F.lit("x"), "__top": F.lit(2)}).repartition(3)
    assert rows_of(warc.round_trip(df)) == plain_pages(rows)
    assert warc.round_trip(df.limit(0)).count() == 0
    path = str(tmp_path / "plain")
    warc.write_warc(warc.page_records(df), path, compression="none", partitionBytes="2000")
    back = warc.read_warc(spark, f"file:{path}", fields="X-Page-Id,X-Refers-To-Page-Id")
    assert rows_of(warc.page_rows(back)) == plain_pages(rows)
    sent = {r["x_page_id"]: r for r in back.where("type <> 'warcinfo'").collect()}
    assert bytes(sent["9"]["payload"]).decode() == rows[7][2] and sent["4"]["target_uri"] == "http://a/4%0D%0AX: y"
    assert sent["2"]["refers_to"] == sent["9"]["record_id"] and sent["2"]["payload"] == b""


def test_repeated_and_null_page_ids(spark):
    big = "q" * 1000
    rows = [(5, "a", big), (5, "b", big), (None, "c", big), (None, "d", "e" * 2000), (None, "d", "e" * 2000), (5, "a", big)]
    got = [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()]
    assert sorted(got, key=str) == sorted([(5, "response", None)] * 3 + [(None, "revisit", 5)] + [(None, "response", None)] * 2, key=str)


def archive(packed):
    records = [{"type": "warcinfo", "payload": b"about"}]
    records += [{"type": "response" if i % 3 else "resource", "record_id": f"<r{i}>", "target_uri": f"http://h{i % 2}/{i}", "payload": bytes([65 + i]) * 400_000, "payload_digest": "d"} for i in range(6)]
    return b"".join((warc.member if packed else bytes)(warc.record(r)) for r in records)


@pytest.mark.parametrize("packed", [True, False])
def test_unwanted_payloads_are_not_decoded(packed, tmp_path, monkeypatch):
    data = archive(packed)
    (tmp_path / ("a.warc.gz" if packed else "a.warc")).write_bytes(data)
    (tmp_path / "orphan.txt").write_bytes(b"no archive")
    taken, inflated = [], []
    take = warc.Plain.take
    monkeypatch.setattr(warc.Plain, "take", lambda self, n: (taken.append(n), take(self, n))[1])
    begin = warc.Gunzip.begin
    monkeypatch.setattr(warc.Gunzip, "begin", lambda self: (inflated.append(self), begin(self))[1])
    reader = warc.Reader({"path": str(tmp_path), "payload": "response"})
    left = list(reader.pushFilters([ds.EqualTo(("type",), "response"), ds.StringStartsWith(("target_uri",), "http://h1"), ds.EqualTo(("payload_length",), 3), ds.Not(ds.IsNull(("date",)))]))
    assert len(left) == 2 and len(reader.tests) == 2
    got = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert [r["record_id"] for r in got] == ["<r1>", "<r5>"] and all(len(r["payload"]) == 400_000 for r in got)
    assert taken == [400_000] * 2
    if packed:
        assert inflated[0].inflated < 2 * 400_000 + 5 * warc.PIECE + 10_000  # whole only where wanted, else one piece
        assert gzip.decompress(data) == archive(False)  # any gzip reader can read it


def test_members_without_skip_lengths_and_other_writers_files():
    """Foreign archives: no extra field, folded header lines, a record with no HTTP head, a truncated file."""
    plain = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://x/\r\n y\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    data = gzip.compress(plain) + gzip.compress(plain.replace(b"resource", b"metadata"))
    got = list(warc.records(io.BytesIO(data), len(data)))
    assert [(f["WARC-Type"], f["WARC-Target-URI"], n, p) for _, f, n, p in got] == [("resource", "http://x/ y", 5, b"hello"), ("metadata", "http://x/ y", 5, b"hello")]
    kept = list(warc.records(io.BytesIO(data), len(data), keep=lambda f: f["WARC-Type"] == "metadata", decode=lambda kind: False))
    assert len(kept) == 1 and kept[0][3] is None
    assert got[1][0] == len(gzip.compress(plain))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-20]), len(data) - 20))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(plain[:-8]), len(plain) - 8))
    assert list(warc.records(io.BytesIO(b""), 0)) == []


def test_spark_pushes_filters_and_packs_files(spark, tmp_path, capsys):
    for i in range(6):
        (tmp_path / f"{i}.warc").write_bytes(archive(False))
    df = warc.read_warc(spark, str(tmp_path), payload="none", partitionBytes="6000000").where("type = 'response' and target_uri like 'http://h1%'").select("record_id")
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(type,response)" in plan and "StringStartsWith(target_uri,http://h1)" in plan and "Filter (" not in plan
    assert df.rdd.getNumPartitions() == 3
    assert sorted(r[0] for r in df.collect()) == ["<r1>"] * 6 + ["<r5>"] * 6


def test_only_committed_files_are_read(spark, tmp_path):
    path = str(tmp_path / "w")
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], PAGES)
    warc.write_warc(warc.page_records(df), path)
    (tmp_path / "w" / "records-lost.warc.gz").write_bytes(b"half a rec")
    read = lambda: sorted(r[0] for r in warc.read_warc(spark, path, fields="X-Page-Id").where("type = 'response'").select("x_page_id").collect())
    assert read() == ["1", "2"]
    warc.write_warc(warc.page_records(df.where("page_id = 1")), path)
    assert read() == ["1", "1", "2"]
    columns = [c.split(" ")[0] for c in warc.RECORD.split(", ")]
    warc.page_records(df.where("page_id = 2")).select(*columns).write.format("warc").option("path", path).mode("overwrite").save()
    assert read() == ["2"]
    writer = warc.Writer({"path": path}, False)
    batch = pa.RecordBatch.from_pylist([{"type": "resource", "payload": b"x"}])
    done = writer.write(iter([batch]))
    writer.abort([done, None])
    assert not os.path.exists(f"{path}/{done.files[0]}") and read() == ["2"]


# 12


def plain_audit(docs, labels):
    good = {d for d, q, t in labels if q == 1 and d is not None}
    bad = {d for d, q, t in labels if t == 1 and d is not None}
    first, fails, part = {}, {}, {}
    for i, (d, t, _, s, _) in enumerate(docs):
        t = t or ""
        if d is not None:
            first[t] = min(first.get(t, d), d)
    for i, (d, t, _, s, _) in enumerate(docs):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        later = t in first and (d is None or first[t] < d)
        tests = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), later)
        fails[i], part[i] = {f for f, x in zip("ABCDE", tests) if x}, s or ""
    out = []
    for p in set(part.values()):
        mine = [i for i in part if part[i] == p]
        rows, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in fails[i]]
                redundant = sum(f in fails[i] for i in mine) - len(gone)
                left = [i for i in left if f not in fails[i]]
                shapley[f] += len(gone)
                marked = [sum(docs[i][0] in which for i in gone) for which in (good, bad)]
                rows.append([p, "".join(order), step, len(left), len(gone), redundant, sum(fails[i] == {f} for i in mine), *marked])
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def audit_docs():
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(160):
        w = RNG.sample(vocab, RNG.randint(30, 120))
        if i % 3 == 0:
            w = w + w
        if i % 5 == 0:
            w[3] = "C$T"
        if i % 4 == 0:
            w = [x.upper() for x in w]
        rows.append((i, RNG.choice([" ", "\n", "  ", "\t\x0b"]).join(w), None, RNG.choice(["s", "t", None, ""]), None))
    rows += [(200 + i, rows[i][1], None, "s", None) for i in range(40)] + [(300, None, None, None, None), (301, "", None, "t", None), (302, "ä" * 5000, None, "t", None), (None, rows[0][1], None, "t", None), (303, "B " * 30_000, None, "t", None)]
    return rows


def test_audit_against_every_order(spark):
    docs = audit_docs()
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 340, 2)] + [(4, 1, None), (4, 0, 1), (999, 1, 1), (None, 1, 1)]
    frames = spark.createDataFrame(docs, DOCS).withColumns({"part": F.lit("z"), "digest": F.lit(1), "good": F.lit(5)}).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(*frames)
    assert got.columns == ["part", "filter_order", "step", *audit.COUNTS]
    assert rows_of(got) == plain_audit(docs, labels)
    assert audit.filter_audit(frames[0].limit(0), frames[1]).count() == 0
    assert rows_of(audit.filter_audit(frames[0], frames[1].limit(0))) == plain_audit(docs, [])


def test_repeated_rows_share_their_fate(spark):
    docs = [(1, "same text", None, "s", None)] * 3 + [(2, "same text", None, "s", None)]
    got = {r["step"]: r for r in audit.filter_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EABCD'").collect()}
    assert (got[1]["removed"], got[1]["kept"], got[2]["removed"], got[2]["redundant"]) == (1, 3, 3, 1)


@pytest.mark.parametrize("n", [1, 2, 4, 6])
def test_paths_through_the_lattice(n):
    lattice = audit.Lattice("ABCDEF"[:n])
    assert len(lattice.edges) == n * 2 ** (n - 1)
    for e, (s, _, t) in enumerate(lattice.edges):
        k = s.bit_count()
        assert lattice.weight(e) == math.factorial(k) * math.factorial(n - k - 1)
    assert lattice.reaching[-1] == lattice.leaving[0] == math.factorial(n) and len(lattice.steps()) == n * math.factorial(n)


# 13


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resample(docs, benchmark, share=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [d[1] for d in docs]), (t, [b[1] for b in benchmark])):
        for text in texts:
            for f in plain_features(text)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    rows, able = [], []
    for d, text, *_ in docs:
        n, features = plain_features(text)
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= least:
            able.append(rows[-1])
    for rank, row in enumerate(sorted(able, key=lambda r: (-r[3], r[0]))[: share * len(able) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, rows), key=str)


def resample_docs():
    vocab = ["alpha", "beta", "Γάμμα", "delta-9", "x" * 70, "y" * 200, "1", "ÉCOLE", "mid'dle", "a", "\x7f", "数据"]
    line = lambda: " ".join(RNG.choice(vocab) for _ in range(RNG.randint(0, 6)))
    common = [line() for _ in range(8)]
    rows = [(i, "\n".join(RNG.choice(common) if RNG.random() < 0.5 else line() for _ in range(RNG.randint(1, 14))), None, "s", None) for i in range(300)]
    rows += [(400, None, None, None, None), (401, "", None, None, None), (402, "\n\n\n", None, None, None), (403, "a\nb\nc\n\nd", None, None, None), (404, "z " * 20_000 + "\n" + "W" * 100_000, None, None, None), (405, "one", None, None, None)]
    return rows + [(500 + i, rows[3][1], None, "s", None) for i in range(80)]


def test_resample_against_a_plain_version(spark):
    docs = resample_docs()
    bench = [(i, d[1]) for i, d in enumerate(docs[:25])] + [(90, None), (91, "alpha beta\nalpha beta")]
    frame = spark.createDataFrame(docs, DOCS).withColumns({"rank": F.lit(1), "weight": F.lit("w"), "__n": F.lit(3), "line": F.lit(0)}).repartition(4)
    target = spark.createDataFrame(bench, "item_id long, text string")
    want = plain_resample(docs, bench)
    assert sorted((tuple(r) for r in resample.scored(frame, target).collect()), key=str) == want
    drawn = {r[0] for r in want if r[4]}
    kept = resample.resample(frame, target)
    assert {r["doc_id"] for r in kept.collect()} == drawn and kept.columns == frame.columns
    assert resample.scored(frame.limit(0), target).count() == 0
    assert sorted((tuple(r) for r in resample.scored(frame, target.limit(0)).collect()), key=str) == plain_resample(docs, [])


def test_repeated_ids_and_ties(spark):
    text = " ".join(f"w{i}" for i in range(30))
    frame = spark.createDataFrame([(1, text, None, None, None)] * 40 + [(None, text, None, None, None)] * 2, DOCS)
    got = resample.scored(frame, spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")).collect()
    assert len(got) == 42 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2]


def test_crcs_of_words_and_grams():
    texts = ["Ab cd\nef", None, "", "x" * 500 + " " + "y" * 64 + " " + "z" * 65, "q", "ä-ö"]
    words = resample.words_of(pa.array(["no", *texts, "no"]).slice(1, len(texts)))
    own = [plain_features(t) for t in texts]
    assert np.bincount(words.text, minlength=len(texts)).tolist() == [n for n, _ in own]
    found = sorted((int(words.text[a]), int(c)) for _, at, crc in resample.grams(words) for a, c in zip(at, crc))
    assert found == sorted((i, zlib.crc32(f.encode())) for i, (_, fs) in enumerate(own) for f in fs)
