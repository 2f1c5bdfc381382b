"""Seeds with spaces and brackets, whole groups of digits, and support by learned instances."""

from corpuslab.llm import pii


def spans(spark, rows):
    return {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_phones_with_spaces_teach_their_context(spark):
    rows = [(i, f"please dial desk +1 (555) 123-45{60 + i} today") for i in range(6)]
    rows += [(50, "please dial desk 555 123 4567 today"), (51, "we sold 555 123 4567 of them")]
    got = spans(spark, rows)
    assert got[0] == "phone:17:34" and got[50] == "phone:17:29" and got[51] == ""
    shown = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert shown[50] == "please dial desk <PHONE> today"


def test_context_holds_words_with_digits(spark):
    rows = [(i, f"send to room2024 user{i}@mail.example.com now") for i in range(6)] + [(50, "send to room2024 jo5577(at)nowhere now")]
    assert spans(spark, rows)[50] == "email:17:23"


def test_learned_instances_count_as_support(spark):
    """`reach me` learns from seeds and names ids; `write us` introduces only those ids, then names one of its own."""
    rows = [(i, f"please reach me user{i}@mail.example.com") for i in range(200)]
    rows += [(300 + i, f"please reach me jo557{i} now") for i in range(6)] + [(400 + i, f"please write us jo557{i} now") for i in range(6)]
    got = spans(spark, rows)
    assert got[300] == "email:16:22" and got[403] == "email:16:22"


def test_planted_identifiers_in_prose(spark):
    """Unseen identifiers planted in the documents behind contexts that seeds share: how many are found, and
    how much of what is added was planted."""
    import os
    import random

    import pytest

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    rng = random.Random(5)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").distinct().orderBy("text").collect()]
    contexts = {"email": ("his mailbox is", lambda i: f"user{i}@mail{i % 7}.example.com", lambda i: f"jo{5000 + i}(at)nowhere"), "phone": ("dial desk number", lambda i: f"+1 (555) 123-4{100 + i}", lambda i: f"555 123 4{100 + i}")}
    rows, planted = [], set()
    for i, text in enumerate(texts[:160]):
        words = text.split(" ")
        kind = ("email", "phone")[i % 2]
        lead, seed, unseen = contexts[kind]
        at = rng.randint(0, len(words))
        value = seed(i) if i < 100 else unseen(i)
        before = " ".join([*words[:at], lead, ""])
        rows.append((i, before + value + " and " + " ".join(words[at:])))
        if i >= 100:
            planted.add((i, f"{kind}:{len(before)}:{len(before) + len(value.split('(at)')[0])}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    every = {(i, s) for i, found in spans(spark, rows).items() for s in found.split(",") if s}
    base = {(i, s) for i, found in spans(spark, [(i, t) for i, t in rows if i < 100]).items() for s in found.split(",") if s}
    assert len(base) >= 100
    caught = planted & every
    assert len(caught) >= 0.95 * len(planted)
    kinds = {(r["doc_id"]): (r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]) for r in pii.personal_data(df).collect()}
    added = sum(len([s for s in found.split(",") if s]) for found in spans(spark, rows).values()) - sum(kinds.values())
    assert len(caught) / added >= 0.95


def test_identifiers_that_follow_each_other(spark):
    rows = [(i, f"mail or phone user{i}@a.example.com +1 (555) 123-45{60 + i}") for i in range(6)] + [(50, "mail or phone jo5577 x")]
    got = spans(spark, rows)
    assert got[0].startswith("email:14:") and "phone:" in got[0] and got[50] == "email:14:20"


def test_long_lists_of_numbers_take_linear_time(spark):
    import time

    text = ", ".join(str(4532015112830366 + 7 * i) for i in range(300_000))
    assert len(text) > 5_000_000
    df = spark.createDataFrame([(1, text), (2, "x a@b.cd y"), (3, None)], "doc_id long, text string")
    at = time.time()
    got = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    shown = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert time.time() - at < 120
    assert got[1]["n_card"] > 20_000 and shown[1].count("<CARD>") == got[1]["n_card"] and got[2]["spans"] == "email:2:8" and shown[2] == "x <EMAIL> y" and shown[3] is None
