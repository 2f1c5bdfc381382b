"""Priority and containment of licence detections against a plain version; texts of very many matches."""

import random
import re
import time

from corpuslab.llm import licenses
from corpuslab.llm.decontaminate import normalise
from corpuslab.llm.license_rules import rules

NOTICE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file. Permission is hereby granted, free of charge, MIT License. GNU General Public License version 3 or later. CC BY-SA 4.0. "


def plain(text):
    """Every rule in its order on the whole text, every detection against every one kept before."""
    line = " " + b" ".join(normalise(text.encode())).decode() + " "
    labels, kept, doubt = {label for phrase, label in licenses.BASE.items() if f" {phrase} " in line}, [], 1.0
    if labels:
        doubt -= licenses.BASE_STRENGTH
    for label, strength, keyword, pattern in rules():
        if f" {keyword}" not in line:
            continue
        own = [m.span() for m in re.finditer(f" (?:{pattern})(?= )", line)]
        own = [s for s in own if not any(a <= s[0] and s[1] <= b for a, b in kept)]
        if own:
            kept += own
            labels.add(label)
            doubt *= 1 - strength
    return ",".join(sorted(labels)), round(1 - doubt, 6)


def test_against_every_pair():
    rng, words = random.Random(2), NOTICE.split()
    for _ in range(150):
        at = sorted(rng.randrange(len(words)) for _ in range(rng.randint(2, 8)))
        text = " ".join(" ".join(words[a:b]) + rng.choice(["", " or", " filler"]) for a, b in zip(at, at[1:]))
        found = licenses.Signatures().scan(text.encode())
        assert (found[5], found[6]) == plain(text)


def test_time_grows_with_the_matches():
    scan = licenses.Signatures()
    scan.scan(NOTICE.encode())
    began = time.time()
    found = scan.scan((NOTICE * (5_000_000 // len(NOTICE))).encode())
    assert time.time() - began < 60 and found[1] > 60_000 and "apache-2.0" in found[5]
    assert found[5] == scan.scan(NOTICE.encode() * 3)[5]


def test_intervals():
    rng, kept, every = random.Random(4), licenses.Intervals(), []
    for _ in range(60):
        more = [(a, a + rng.randint(1, 30)) for a in (rng.randrange(200) for _ in range(5))]
        kept.add(more)
        every += more
        for _ in range(20):
            a = rng.randrange(220)
            b = a + rng.randint(1, 30)
            assert kept.contain(a, b) == any(c <= a and b <= d for c, d in every)
