"""Entropy balancing against a dense solver, and words taken against their targets."""

import math
import random
from collections import Counter, defaultdict

import pytest

from loomstat.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def rows(seed=3):
    rng = random.Random(seed)
    out = [(i, " ".join(["w"] * rng.choice([1, 3, 10, 40, 200, 900])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    return [*out, (None, "x y", "a"), (None, "x y", "a"), (5, None, "b"), (6, "", "c"), (400, "", "empty"), (401, "one two", "tiny"), (16, "w " * 30, "b"), (32, "w " * 30, "b")]


def wanted(sizes):
    """Targets by filling, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, free, target = sum(map(sum, sizes.values())), set(names), {}
    while True:
        full = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * sum(sizes[s]) + 1e-9]
        if not full:
            return target | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        for s in full:
            target[s] = 3 * sum(sizes[s])
        left, free = left - sum(target[s] for s in full), free - set(full)


def tilt(sizes, target):
    """The root of the token constraint, by halving."""
    lo, hi = -5.0, math.log(3)
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(n * min(3, math.exp(mid * n)) for n in sizes) < target else (lo, mid)
    return (lo + hi) / 2


def test_rates_are_exponential_tilts_that_meet_the_targets(spark):
    data = rows()
    got = mixing.mixed(spark.createDataFrame(data, SCHEMA).repartition(5), named_source=True).collect()
    sizes = defaultdict(list)
    for _, text, source in data:
        sizes[source].append(len((text or "").split()))
    target = wanted(sizes)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sum(sizes[r.source])
        expected = min(3.0, math.exp(tilt(sizes[r.source], target[r.source]) * r.size)) if r.size else 0.0
        assert r.rate == pytest.approx(expected, rel=1e-6, abs=1e-9)
        assert 0 <= r.copies <= 3 and abs(r.copies - r.rate) < 2 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert len(got) == len(data)
    for source, words in target.items():
        assert abs(taken[source] - words) <= max(2.0, 0.01 * words), source
    again = mixing.mixed(spark.createDataFrame(data, SCHEMA).repartition(2), named_source=True).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_columns_to_keep(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1, 2, 3)], SCHEMA + ", bits int, salt int, place int").select("doc_id", "text", "source", "bits")
    with pytest.raises(ValueError):
        mixing.mixed(docs.withColumnRenamed("bits", "size"), keep=("size",))
    assert mixing.mixed(docs, keep=("text",)).collect()[0].text == "a b"
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
