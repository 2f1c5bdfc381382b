"""Language identification against a plain version, one word and one language at a time."""

import math
import random

import pytest

from corpuslab.llm import langid

RNG = random.Random(8)


def plain_predict(model_words, model_grams, prior, languages, text):
    """Known words by their log frequencies; others by the mean of their longest known n-grams."""

    def log_share(counts, entry, k):
        return math.log(entry[k] + langid.SMOOTHING) - math.log(sum(c[k] for c in counts.values()) + langid.SMOOTHING * len(counts))

    def logs(word):
        if word in model_words:
            return [log_share(model_words, model_words[word], k) for k in range(len(languages))]
        framed = f" {word} "
        for n in langid.ORDERS:
            own = {g: c for g, c in model_grams.items() if len(g) == n}
            known = [own[framed[i : i + n]] for i in range(len(framed) - n + 1) if framed[i : i + n] in own]
            if known:
                return [sum(log_share(own, c, k) for c in known) / len(known) for k in range(len(languages))]
        return [0.0] * len(languages)

    words = langid.words_of(text)
    if not words or not languages:
        return "und", 0.0
    rows = [logs(w) for w in words]
    totals = [sum(r[k] for r in rows) + math.log(prior[k] + 1.0) for k in range(len(languages))]
    best = totals.index(max(totals))
    return languages[best], sum(math.exp(r[best]) / sum(map(math.exp, r)) for r in rows) / len(rows)


def test_predictions_word_by_word():
    letters = "abcdeß"
    word = lambda: "".join(RNG.choice(letters) for _ in range(RNG.randint(1, 7)))
    for _ in range(20):
        languages = ["aa", "bb", "cc"][: RNG.randint(1, 3)]
        counts = lambda: [RNG.randint(0, 30) for _ in languages]
        words = {word(): counts() for _ in range(30)}
        grams = {g: counts() for w in [word() for _ in range(40)] for n in langid.ORDERS for g in [f" {w} "[i : i + n] for i in range(max(0, len(w) + 3 - n))] if RNG.random() < 0.4}
        prior = counts()
        model = langid.Model(languages, prior, words, grams)
        texts = [" ".join(RNG.choice([word(), RNG.choice(list(words))]) for _ in range(RNG.randint(0, 12))) for _ in range(15)] + [None, "12 !", "ЖЖ", "A" * 5000]
        for text, (said, score) in zip(texts, model.predict(texts)):
            want, share = plain_predict(words, grams, prior, languages, text)
            assert score == pytest.approx(share) and (said == want or abs(score - share) < 1e-12)


def test_the_model_counts_what_it_is_taught(spark):
    """The counts behind a fitted model, all words and n-grams of two occurrences or more, by brute force."""
    vocab = {"xx": ["alpha", "beta", "gamma"], "yy": ["delta", "beta", "zeta"]}
    rows = [(i, " ".join(RNG.choice(vocab[k]) for _ in range(6)), k) for i in range(60) for k in [("xx", "yy")[i % 2]]] + [(100, None, "xx"), (101, "solo", None), (102, "", "yy")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    words, grams = {}, {}
    for _, text, lang in rows:
        for w in langid.words_of(text) if lang else []:
            words.setdefault(w, [0, 0])[lang == "yy"] += 1
            for n in langid.ORDERS:
                for g in (f" {w} "[i : i + n] for i in range(len(w) + 3 - n)):
                    grams.setdefault(g, [0, 0])[lang == "yy"] += 1
    kept = lambda counts: {k: c for k, c in counts.items() if sum(c) >= langid.LEAST_COUNT}
    texts = ["alpha beta", "zeta delta zeta", "alphabet", "qqq", "betazeta"]
    want = [plain_predict(kept(words), {g: c for g, c in kept(grams).items() if g.strip() or len(g) == 1}, [31 - 1, 31], ["xx", "yy"], t) for t in texts]
    assert [said for said, _ in model.predict(texts)] == [said for said, _ in want]
    assert set(model.words) == set(kept(words))
