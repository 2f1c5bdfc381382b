"""Keywords of licence rules never hide a match of their own pattern."""

from re import _parser

import pytest

from corpuslab.llm import licenses
from corpuslab.llm.license_rules import rules


def samples(parsed):
    """Texts that a parsed pattern matches: every branch, every listed letter, optional parts absent and present."""
    found = [""]
    for op, value in parsed:
        op = str(op)
        if op == "LITERAL":
            some = [chr(value)]
        elif op == "IN":
            some = [chr(v) for k, v in value if str(k) == "LITERAL"] or ["1"]
        elif op == "MAX_REPEAT":
            low, _, inner = value
            some = [""] * (low == 0) + [s * max(low, 1) for s in samples(inner)]
        elif op == "SUBPATTERN":
            some = samples(value[3])
        elif op == "BRANCH":
            some = [s for branch in value[1] for s in samples(branch)]
        else:
            assert op == "ASSERT_NOT", op
            some = [""]
        found = [a + b for a in found for b in some]
    return found


def test_every_sample_passes_its_gate():
    for label, _, keyword, pattern in rules():
        for text in samples(_parser.parse(pattern)):
            assert f" {keyword}" in f" {text} ", (label, keyword, text)


@pytest.mark.parametrize(
    "text, label",
    [
        ("licensed under the Apache Licence 2.0", "apache-2.0"),
        ("released under the ISC licence", "isc"),
        ("Licensed under the EUPL version 1.2", "eupl-1.2"),
        ("PSF hereby grants Licensee a nonexclusive, royalty-free, world-wide license", "python-2.0"),
        ("dual licenced under two", "dual-license"),
    ],
)
def test_passages_without_another_phrase(text, label):
    assert label in licenses.Signatures().scan(text.encode())[5].split(",")
