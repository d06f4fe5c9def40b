"""run()'s rows, and what each stage hands on, against a plain recomputation."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from test_mixing import tilt, wanted

import corpus_pipeline
from loomstat.llm import token_output
from loomstat.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "If the farmer named Tom buys 12 apples and 7 pears and eats 4 of them how many are left for Tom"


def documents():
    """Rows, ids of toxic ones, ids of ones with a benchmark passage."""
    rng = random.Random(12)
    words = ["".join(rng.choice(["ba", "ren", "to", "li", "sun", "ka"]) for _ in range(rng.randint(2, 4))) for _ in range(250)]
    rows, toxic, leaked = [], set(), set()
    for i in range(240):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([20, 40, 90])))
        if i % 5 == 0:
            toxic.add(i)
            text += " you idiot moron you stupid idiot"
        elif i % 12 == 1:
            leaked.add(i)
            text += " " + ITEM.replace("Tom", "Ann").replace("12", "31")
        elif i % 12 == 7 and i > 20 and (i - 3) % 5:
            text = rows[i - 3][1]
        elif i % 12 == 9 and i > 20 and (i - 1) % 5 and (i - 1) not in leaked:
            text = rows[i - 1][1].rsplit(" ", 1)[0] + " changed"
        rows.append([i, text, "en", ["a", "b", None][i % 3], len(text)])
    rows += [[300, None, None, "a", None], [301, "", "en", "b", 0], [302, "two words", "en", "c", 9]]
    return rows, toxic, leaked


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def one_of_each(rows):
    """Rows whose id is the smallest of those reachable by links."""
    root, sets = {r[0]: r[0] for r in rows}, {r[0]: shingles(r[1]) for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [r for r in rows if find(r[0]) == r[0]]


def test_rows_of_all_stages(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    rows, toxic, leaked = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] in toxic)) for r in rows if r[0] < 200], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    between = {}
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df, name: between.setdefault(name, stored(df, name)))
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    handed = {name: [tuple(r) for r in df.collect()] for name, df in between.items()}

    expected = [tuple(r) for r in rows if r[0] not in toxic]
    assert Counter(handed["toxicity"]) == Counter(expected)
    fewer = one_of_each(expected)
    assert len(fewer) < len(expected) - 10 and Counter(handed["jaccard_join"]) == Counter(fewer)
    clean = [r for r in fewer if r[0] not in leaked]
    assert len(clean) < len(fewer) and Counter(handed["decontamination"]) == Counter(clean)

    sizes, taken, copies = defaultdict(list), Counter(), Counter(handed["mixing"])
    for r in clean:
        sizes[r[3]].append(len((r[1] or "").split()))
    target = wanted(sizes)
    root = {s: tilt(sizes[s], target[s]) for s in sizes}
    for r in clean:
        n, times = len((r[1] or "").split()), copies.pop(r, 0)
        taken[r[3]] += n * times
        assert times == 1 if n == 0 else times <= 3 and abs(times - min(3.0, math.exp(root[r[3]] * n))) < 2
    assert not copies
    assert all(abs(taken[s] - words) <= max(45, 0.02 * words) for s, words in target.items())

    encode, start, tokens = Tokenizer.from_file(token_output.default_vocabulary()).encode, 0, []
    for r in sorted(handed["mixing"], key=lambda r: r[0]):
        ids = np.array([*encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        tokens.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == tokens
