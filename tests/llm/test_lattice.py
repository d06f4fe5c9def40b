"""The score columns of the lattice model against a plain computation over whole texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from loomstat.llm import lattice_lm


def test_scores_are_marginals(spark, monkeypatch):
    pieces = [f"<0x{b:02X}>" for b in range(256)] + ["▁", "▁a", "a", "b", "ab", "▁ab", "bab"]
    first = np.arange(1.0, len(pieces) + 1)
    first /= first.sum()
    monkeypatch.setattr(lattice_lm, "vocabulary_scores", lambda _: (pieces, first))
    far = "\U0001d538" * 30
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("ab a ab", "x"), ("bab AB é", "y"), (far, "x"), ("", "y"), (None, None), ("a b", "y"), ("b b bab a", "x"), (far + " a", "x"), ("abab " * 40, None)])]
    rows += [(9007199254740993, "ab bab", "x"), (None, "ab", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.score): r for r in lattice_lm.lattice_scores(docs, rounds=0).collect()}
    assert len(got) == len(rows) and {r.doc_id for r in got.values()} == {r[0] for r in rows}

    def marginal(word):
        text, sums = "▁" + word, [1.0]
        for j in range(1, len(text) + 1):
            total = sum(first[i] * sums[j - len(x)] for i, x in enumerate(pieces) if i >= 256 and j >= len(x) and text[j - len(x) : j] == x)
            if text[j - 1] not in pieces:
                total += math.prod(first[b] for b in text[j - 1].encode()) * sums[j - 1]
            sums.append(total)
        return sums[-1]

    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    words = lambda t: (t or "").lower().split()
    train = [r for r in rows if not held(r[0])]
    parts = sorted({r[2] for r in train}, key=str)
    counts = {p: Counter(w for r in train if r[2] == p for w in words(r[1])) for p in parts}
    shares = {p: sum(r[2] == p for r in train) for p in parts}
    for doc_id, text, _ in rows:
        if far in (text or ""):
            continue
        full = pieces_only = 0.0
        for p in parts:
            size = sum(counts[p].values()) + shares[p]
            a = b = shares[p] / len(train) * shares[p] / size
            for w in words(text):
                a *= max(counts[p][w] - lattice_lm.DISCOUNT, 0) / size + max(lattice_lm.DISCOUNT * len(counts[p]), 1.0) / size * marginal(w)
                b *= marginal(w)
            full, pieces_only = full + a, pieces_only + b
        if full > 1e-300 and pieces_only > 1e-300:
            near = [r for r in got.values() if r.doc_id == doc_id and r.score == pytest.approx(math.log10(full), rel=1e-5)]
            assert near and near[0].piece_score == pytest.approx(math.log10(pieces_only), rel=1e-5), (doc_id, text)
    assert all(math.isfinite(r.score) and math.isfinite(r.piece_score) for r in got.values())
    # fitted too, all stay finite
    assert all(math.isfinite(r.score) for r in lattice_lm.lattice_scores(docs).collect())
