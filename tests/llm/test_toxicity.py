"""Kneser-Ney probabilities against a plain computation, and results for odd texts."""

import random
from collections import Counter

import numpy as np
import pytest

from loomstat.llm import toxicity as tox


def model_of(texts: list[list[str]]) -> tox.KneserNey:
    points = [[tox._points(t) for t in side] for side in texts]
    symbols = np.unique(np.concatenate([p for side in points for p in side])).astype(np.int64)
    lookup = np.full(0x110000, tox.RARE, np.uint8)
    lookup[symbols] = np.arange(2, 2 + len(symbols))
    return tox.KneserNey(symbols, tuple(np.unique(np.concatenate([tox._grams(lookup[p]) for p in side]), return_counts=True) for side in points))


def plain(texts: list[list[str]], symbols: int):
    """probability(side, gram) from dictionaries of character tuples."""
    top = [Counter() for _ in texts]
    for side, some in enumerate(texts):
        for t in some:
            t = "\0" * (tox.ORDER - 1) + " ".join(t.lower().split())
            top[side].update(t[i - tox.ORDER + 1 : i + 1] for i in range(tox.ORDER - 1, len(t)))
    grams = [{tox.ORDER: c} for c in (*top, Counter(set(top[0]) | set(top[1])))]
    for g in grams:
        for j in range(tox.ORDER - 1, 0, -1):
            g[j] = Counter(x[1:] for x in set(g[j + 1]))

    def p(side, gram):
        if not gram:
            return 1 / symbols
        g = grams[side if len(gram) >= tox.OWN_ORDER else 2][len(gram)]
        after = {x: n for x, n in g.items() if x[:-1] == gram[:-1]}
        low = p(side, gram[1:])
        if not after:
            return low
        return (max(after.get(gram, 0) - tox.DISCOUNT, 0) + tox.DISCOUNT * len(after) * low) / sum(after.values())

    return p


def test_probabilities_are_kneser_ney():
    rng = random.Random(8)
    texts = [["".join(rng.choice(some) for _ in range(40)) for _ in range(6)] for some in ("abc de", "abx ye")]
    model = model_of(texts)
    p = plain(texts, len(model.symbols) + 2)
    number = {chr(c): i + 2 for i, c in enumerate(model.symbols)} | {"\0": tox.OUTSIDE}
    for text in ("abcde", "xyx ye", "zzz", "c a"):
        padded = "\0" * (tox.ORDER - 1) + text
        for i in range(tox.ORDER - 1, len(padded)):
            gram = padded[i - tox.ORDER + 1 : i + 1]
            coded = 0
            for c in gram:
                coded = coded << 8 | number.get(c, tox.RARE)
            for side in (0, 1):
                assert model.probability(side, tox.ORDER, np.array([coded]))[0] == pytest.approx(p(side, gram))
    # the next symbol's probabilities sum to 1, in a history that was seen and in one that wasn't
    for history in ("abc ", "zzzz"):
        coded = 0
        for c in history:
            coded = coded << 8 | number.get(c, tox.RARE)
        every = np.array([coded << 8 | s for s in range(1, len(model.symbols) + 2)] + [coded << 8])
        for side in (0, 1):
            assert model.probability(side, tox.ORDER, every).sum() == pytest.approx(1)


def test_evidence_is_that_of_the_best_passage(monkeypatch):
    model = model_of([["the river walks slowly by the house"], ["you idiot you moron you clown"]])
    text = "the house " * 30 + "idiot " + "the river " * 30
    grams = tox._grams(model.alphabet[tox._points(text)])
    ratios = model.ratios(grams)
    expected = max(ratios[i : i + tox.PASSAGE].mean() for i in range(len(ratios) - tox.PASSAGE + 1))
    assert model.evidence([text])[0] == pytest.approx(expected)
    assert model.evidence([None, "", "  \n", "a"])[:3].tolist() == [0, 0, 0]
    # cut in slices, with their few repeated characters, the passages are the same
    monkeypatch.setattr(tox, "STRETCH", 50)
    assert model.evidence(["x", text, "y"])[1] == pytest.approx(expected)


def test_clashing_columns_and_odd_labels(spark):
    docs = spark.createDataFrame([(i, "you idiot" if i % 2 else "the house", 9.0, "p") for i in range(40)] + [(None, None, 0.0, "")], "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 7), (None, 1), (5, None)], "doc_id long, toxic int")
    got = tox.scored(docs, tox.train(docs, labels)).collect()
    assert len(got) == 41 and all(r.predicted == (r.text == "you idiot") for r in got) and set(got[0].asDict()) == {"doc_id", "text", "score", "predicted"}
