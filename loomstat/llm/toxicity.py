"""Toxicity by class-conditional Kneser-Ney models.

Two character n-gram models of order `ORDER`, one of toxic and one of ordinary labelled texts. The highest order discounts its class's counts
by D, each lower order discounts continuation counts (the number of distinct characters that precede a gram); what a discount takes
goes to the next lower order. Down to order `OWN_ORDER` continuations are counted in the class, below it in both classes together, so
that an expression which neither class shows backs off to the same shared counts. Histories cross words.

A passage of `PASSAGE` characters is judged by the difference of its toxic and ordinary log-likelihoods over its length; a document by its most
toxic passage. One logistic curve over that difference, fitted on labelled rows that the counts don't use, makes the score.

Training takes at most `per_class` labelled rows of a class, by a hash of the id; that sample, and with it the model that is sent to
the tasks, is bounded by this parameter. Everything else reads every row and whole texts.

Defined results: null texts count as empty; a text without words has the score of no difference; texts shorter than a passage are one
passage; labels other than 0 and 1 or null aren't learnt from; with one class or none labelled, every score is 0; a document labelled twice counts twice.
Columns besides doc_id and text aren't read; columns that are already named score or predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, stored

ORDER, OWN_ORDER, DISCOUNT, PASSAGE, PER_CLASS, THRESHOLD = 5, 3, 0.75, 32, 6000, 0.7
#: Symbols are bytes: 0 stands outside the text, 1 for characters that aren't among the most frequent ones.
OUTSIDE, RARE, SYMBOLS = 0, 1, 256
STRETCH, MEMO = 1 << 20, 1 << 21


def fold(doc_id: Column, parts: int, salt: str = "") -> Column:
    """crc32 of the id as text, modulo parts (null id: that of the empty text)."""
    return F.pmod(F.crc32(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), F.lit(parts))


def _points(text: str) -> np.ndarray:
    """Code points with A-Z lower-cased and each run of white space as one space, none at the ends."""
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    space = (p == 32) | ((p >= 9) & (p <= 13))
    p = np.where(space, 32, np.where((p >= 65) & (p <= 90), p + 32, p))
    p = p[~(space & np.concatenate([[True], space[:-1]]))]
    return p[:-1] if len(p) and p[-1] == 32 else p


def _slices(text: str | None) -> Iterator[str]:
    """A text in slices of bounded length; each repeats the end of the one before, so that no passage with its history is lost."""
    text = text or ""
    yield text[:STRETCH]
    for at in range(STRETCH, len(text), STRETCH):
        yield text[max(0, at - 2 * PASSAGE - ORDER) : at + STRETCH]


def _grams(symbols: np.ndarray) -> np.ndarray:
    """The gram that ends at each symbol, as a number of one byte a symbol."""
    padded = np.concatenate([np.full(ORDER - 1, OUTSIDE, np.int64), symbols.astype(np.int64)])
    out = np.zeros(len(symbols), np.int64)
    for k in range(ORDER):
        out = (out << 8) | padded[k : k + len(symbols)]
    return out


@dataclass
class _Level:
    """Counts of one order: grams with their counts, and of each history the sum and the number of its grams."""

    keys: np.ndarray
    counts: np.ndarray
    histories: np.ndarray = field(init=False)
    sums: np.ndarray = field(init=False)
    kinds: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.histories, start = np.unique(self.keys >> 8, return_index=True)
        self.sums = np.add.reduceat(self.counts, start) if len(start) else self.counts
        self.kinds = np.diff(np.append(start, len(self.keys)))


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, (table[at] == keys if len(table) else np.zeros(len(keys), bool))


class KneserNey:
    """Both classes' models from (class, gram, count) of the highest order. symbols: the code points that have a symbol, sorted."""

    def __init__(self, symbols: np.ndarray, tables: tuple[tuple[np.ndarray, np.ndarray], ...]) -> None:
        self.symbols, self.tables = symbols, tables
        self.alphabet = np.full(0x110000, RARE, np.uint8)
        self.alphabet[symbols] = np.arange(2, 2 + len(symbols), dtype=np.uint8)
        both = np.union1d(tables[0][0], tables[1][0])
        self.levels = [self._ladder(*tables[0]), self._ladder(*tables[1]), self._ladder(both, np.ones(len(both), np.int64))]
        self.memo = (np.zeros(0, np.int64), np.zeros(0))

    @staticmethod
    def _ladder(keys: np.ndarray, counts: np.ndarray) -> dict[int, _Level]:
        out = {ORDER: _Level(keys, counts)}
        for j in range(ORDER - 1, 0, -1):
            # distinct grams of the order above that end in a gram: its distinct left characters
            keys, counts = np.unique(keys & ((1 << 8 * j) - 1), return_counts=True)
            out[j] = _Level(keys, counts)
        return out

    def probability(self, side: int, order: int, grams: np.ndarray) -> np.ndarray:
        """Of each gram's last symbol after the others, by the model of a class (side 2: the shared one)."""
        if order == 0:
            return np.full(len(grams), 1.0 / (len(self.symbols) + 2))
        level = self.levels[2 if order < OWN_ORDER else side][order]
        lower = self.probability(side, order - 1, grams & ((1 << 8 * (order - 1)) - 1))
        if not len(level.keys):
            return lower
        at, known = _found(level.keys, grams)
        count = np.where(known, level.counts[at], 0)
        h, seen = _found(level.histories, grams >> 8)
        return np.where(seen, (np.maximum(count - DISCOUNT, 0.0) + DISCOUNT * level.kinds[h] * lower) / level.sums[h], lower)

    def ratios(self, grams: np.ndarray) -> np.ndarray:
        """Toxic less ordinary log-probability; distinct grams are computed once and kept in a memo of bounded size."""
        distinct, back = np.unique(grams, return_inverse=True)
        at, known = _found(self.memo[0], distinct)
        values = np.where(known, self.memo[1][at], 0.0) if len(self.memo[0]) else np.zeros(len(distinct))
        new = distinct[~known]
        if len(new):
            values[~known] = fresh = np.log(self.probability(1, ORDER, new)) - np.log(self.probability(0, ORDER, new))
            if len(self.memo[0]) + len(new) > MEMO:
                self.memo = (new, fresh)
            else:
                keys = np.concatenate([self.memo[0], new])
                order = np.argsort(keys, kind="stable")
                self.memo = (keys[order], np.concatenate([self.memo[1], fresh])[order])
        return values[back]

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Of each text the largest difference of log-likelihoods over a passage's length."""
        out, points, of, held = np.full(len(texts), -np.inf), [], [], 0
        for i, text in enumerate(texts):
            for piece in _slices(text):
                points.append(_points(piece))
                of.append(i)
                held += len(points[-1])
                if held > STRETCH:
                    self._judge(points, of, out)
                    points, of, held = [], [], 0
        self._judge(points, of, out)
        return np.where(np.isfinite(out), out, 0.0)

    def _judge(self, points: list[np.ndarray], of: list[int], out: np.ndarray) -> None:
        grams = [_grams(self.alphabet[p]) for p in points]
        if not sum(map(len, grams)):
            return
        ratios = self.ratios(np.concatenate(grams))
        at = 0
        for g, i in zip(grams, of, strict=True):
            if len(g):
                sums = np.concatenate([[0.0], np.cumsum(ratios[at : at + len(g)])])
                width = min(PASSAGE, len(g))
                out[i] = max(out[i], float((sums[width:] - sums[:-width]).max()) / width)
                at += len(g)


@dataclass
class Model:
    """Bounded by the training sample: symbols, the two classes' highest-order counts, and the curve (intercept, slope); None: nothing to learn."""

    symbols: np.ndarray
    tables: tuple[tuple[np.ndarray, np.ndarray], ...]
    curve: tuple[float, float] | None = None


def _count(values: np.ndarray, side: np.ndarray, name: str) -> pd.DataFrame:
    """Distinct values with their numbers, by class."""
    parts = [(s, *np.unique(values[side == s], return_counts=True)) for s in (0, 1)]
    return pd.concat([pd.DataFrame({"toxic": s, name: v.astype(np.int64), "n": n.astype(np.int64)}) for s, v, n in parts])


def _stretches(batches: Iterator[pd.DataFrame], symbols_of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """symbols_of each text, some texts at a time, with their class."""
    parts, sides, held = [], [], 0
    for b in batches:
        for side, text in zip(b["toxic"], b["text"], strict=True):
            parts.append(symbols_of(_points(text or "")))
            sides.append(np.full(len(parts[-1]), side, np.int8))
            held += len(parts[-1])
            if held > STRETCH:
                yield np.concatenate(parts), np.concatenate(sides)
                parts, sides, held = [], [], 0
    if held:
        yield np.concatenate(parts), np.concatenate(sides)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Newton fit of one curve with both classes weighing the same; the slope isn't negative, so more evidence never lowers a score."""
    middle, scale = x.mean(), x.std() + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - middle) / scale])
    w, weight = np.zeros(2), np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    penalty = np.diag([0.0, ridge])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty + 1e-12 * np.eye(2), a.T @ (weight * (y - p)) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slope = max(0.0, float(w[1]) / scale)
    return float(w[0]) - slope * float(middle), slope


def _tables(per_gram: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Of each class the sorted grams with their counts. They come to the driver as packed arrays, a few rows a task: a Row object for each gram
    would take 50 times its size there."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for side, own in b.groupby("toxic"):
                yield pd.DataFrame({"toxic": [side], "grams": [own["value"].to_numpy("<i8").tobytes()], "counts": [own["n"].to_numpy("<i8").tobytes()]})

    rows, out = per_gram.mapInPandas(pack, "toxic int, grams binary, counts binary").collect(), []
    for side in (0, 1):
        grams, counts = (np.frombuffer(b"".join(r[c] for r in rows if r["toxic"] == side), "<i8") for c in ("grams", "counts"))
        order = np.argsort(grams)
        out.append((grams[order], counts[order]))
    return tuple(out)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """labels: doc_id, toxic; only its rows are learnt from. At most per_class rows of a class are used, four fifths for the counts."""
    ranked = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h"))
    picked = [ranked.where(F.col("toxic") == side).orderBy("h", "doc_id").limit(per_class) for side in (0, 1)]
    sample = picked[0].unionByName(picked[1]).select("doc_id", "toxic", fold(F.col("doc_id"), 5, "fit").alias("part"))
    # at most 2 * per_class short rows, hence the broadcast
    used = stored(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "part", "text"), "labelled")
    counted = used.where("part > 0").select("toxic", "text")

    def characters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        for values, side in _stretches(batches, lambda p: p):
            yield _count(values, side, "value")

    per_point = counted.mapInPandas(characters, "toxic int, value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    symbols = np.sort(np.array([r["value"] for r in per_point.orderBy(F.desc("n"), "value").limit(SYMBOLS - 2).collect()], np.int64))
    lookup = np.full(0x110000, RARE, np.uint8)
    lookup[symbols] = np.arange(2, 2 + len(symbols), dtype=np.uint8)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        for values, side in _stretches(batches, lambda p: _grams(lookup[p])):
            yield _count(values, side, "value")

    tables = _tables(counted.mapInPandas(grams, "toxic int, value long, n long").groupBy("toxic", "value").agg(F.sum("n").alias("n")))
    model = Model(symbols, tables)
    if not len(tables[0][0]) or not len(tables[1][0]):
        return model

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        own = KneserNey(symbols, tables)
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "x": own.evidence(list(b["text"]))})

    held = used.where("part = 0").mapInPandas(evidence, "toxic int, x double").toPandas()
    if held["toxic"].nunique() < 2:
        held = used.mapInPandas(evidence, "toxic int, x double").toPandas()
    held = held.sort_values(["toxic", "x"])
    model.curve = _logistic(held["x"].to_numpy(float), held["toxic"].to_numpy(float))
    return model


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Each row with score and predicted, other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        give_back()
        model = shared.value
        own = KneserNey(model.symbols, model.tables) if model.curve else None
        for b in batches:
            if own is None:
                yield pd.Series(np.zeros(len(b)))
            else:
                z = model.curve[0] + model.curve[1] * own.evidence(list(b))
                yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(z, -500.0, 500.0))))

    return docs.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows whose crc32 fold isn't the held-out one."""
    return labels.where(fold(F.col("doc_id"), 3) != 1)
