"""Secrets as seeds of contexts: found as spans of the method, base columns as before."""

import hashlib
import random

from corpuslab.llm import pii

RNG = random.Random(9)
SCHEMA = "doc_id long, text string"


def words(n):
    return " ".join("".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(3, 7))) for _ in range(n))


def hexes(n=40):
    return "".join(RNG.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"


def test_secrets_and_what_their_contexts_introduce(spark):
    known = [(i, f'{words(6)} token = "{hexes()}" {words(3)}') for i in range(30)]
    other = [(100 + i, f"{words(4)} token = 'ghp_{i}XyZ{i * 7919 + 1000}' {words(2)}") for i in range(2)]
    plain = [(200, f"{words(5)} {hexes(31)} {words(2)}"), (201, words(50)), (202, None), (203, f"x{hexes()} {hexes()}y"), (204, "a" * 40 + " " + "1" * 40)]
    found = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(known + other + plain, SCHEMA)).collect()}
    for i, text in known:
        at = text.index('"') + 1
        assert found[i]["spans"] == f"secret:{at}:{at + 40}"
    for i, text in other:
        at = text.index("'") + 1
        assert found[i]["spans"] == f"secret:{at}:{text.index(chr(39), at)}"
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == nothing and r["n_email"] == r["n_card"] == r["n_ip"] == r["n_phone"] == 0 for i, r in found.items() if i < 200)
    assert all(found[i]["spans"] == "" for i in (200, 201, 202, 203)) and "secret" not in found[204]["spans"]


def test_secrets_are_redacted_with_the_base_spans_in_them(spark):
    secret = "ab4111111111111111" + "abcdef0123" * 2 + "0a"
    rows = spark.createDataFrame([(1, f'key "{secret}" mail a@b.cd'), (2, "no 12 more")], SCHEMA)
    assert [r["text"] for r in pii.redact(rows).orderBy("doc_id").collect()] == ['key "<SECRET>" mail <EMAIL>', "no 12 more"]
