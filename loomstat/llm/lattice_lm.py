"""Language-model scores by subword lattices.

A word's lattice holds the pieces of an existing subword vocabulary that spell the word's start mark and its characters, with byte
pieces for characters outside. Pieces are drawn independently, so a word's lattice probability is the sum over all its segmentations,
found by a forward recursion; as pieces with the start mark begin words, these probabilities sum to 1 over all words. A further arc
spans each training word whole, with its discounted count; the discounts' mass goes to the other paths:
P(w) = max(c - D, 0) / N + D V / N * lattice(w), and P(end) = documents / N.

The document's probability is the marginal over components (values of a column of the training rows, by default lang; the most frequent
ones, the rest together): sum over components of their share times the product over the text's tokens. The component of a scored
row isn't read. Piece probabilities start from the vocabulary's own scores and are fitted for each component by expectation
maximisation over the lattices of all training words, with their counts in all training documents.

Recursions run over many words of one length at once, in log space throughout. Besides the score there is `piece_score`, the same marginal by the
vocabulary's pieces alone, without the arcs of whole training words.

Distribution: chunks of documents send each bucket of words its distinct words with their training counts; a bucket merges
them into its part of the vocabulary, scores each distinct word once, and answers the chunks. Expected piece counts are
summed by piece over all buckets, so what reaches the driver has the size of the subword vocabulary.

Defined results: null and empty texts are the end token alone; a null doc_id has the fold of the empty text; a null component is one
component; without training documents every count is 0, and scores come from the vocabulary's own. Other columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunk, answered, bucket_count, frame, pack_counts, packed, per_chunk, unpack_counts
from .common import discard, partitions, stored

FOLDS, HELD_OUT, ROUNDS, PRIOR, DISCOUNT, COMPONENTS, BATCH = 5, 1, 2, 2000.0, 0.6, 6, 4096
MARK, BASE = "▁", 0x9E3779B97F4A7C15


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary_scores(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces and their first probabilities. The file's scores are ranks, so rank r weighs 1 / (r + 2). Byte pieces are '<0x..>' and come first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i))]
    weights = {model.id_to_piece(i): 1.0 / 50_000 if model.is_byte(i) else 1.0 / (2.0 + abs(model.get_score(i))) for i in ids if MARK not in model.id_to_piece(i)[1:]}
    names = [f"<0x{b:02X}>" for b in range(256)]
    pieces = names + [p for p in weights if p not in set(names)]
    probabilities = np.array([weights.get(p, 1.0 / 50_000) for p in pieces])
    return pieces, probabilities / probabilities.sum()


class Lattice:
    """Sums over all segmentations, for all components together. probabilities: pieces by components."""

    def __init__(self, pieces: list[str], probabilities: np.ndarray) -> None:
        # hashes of all pieces and of their beginnings, the latter with number -1
        numbers: dict[int, int] = {}
        for i in range(256, len(pieces)):
            h = 0
            for c in pieces[i]:
                h = (h * BASE + ord(c) + 1) % 2**64
                numbers.setdefault(h, -1)
            numbers[h] = i
        self.hashes = np.array(sorted(numbers), np.uint64)
        self.numbers = np.array([numbers[h] for h in self.hashes.tolist()], np.int64)
        self.pieces, self.p, self.outside = len(pieces), probabilities, {}

    def _outside(self, char: str) -> int:
        """A number past the pieces for a character that only bytes spell."""
        if char not in self.outside:
            self.outside[char] = self.pieces + len(self.outside)
            spelt = np.prod(self.p[list(char.encode("utf-8", "surrogatepass"))], axis=0)
            self.p = np.vstack([self.p, spelt])
        return self.outside[char]

    def _arcs(self, texts: list[str]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(start, end) -> rows, piece numbers, by end; texts of one length. Rolling hashes go on while some piece begins like that."""
        n, arcs = len(texts[0]), {}
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(texts), n).astype(np.uint64)
        for i in range(n):
            rows, h = np.arange(len(texts)), np.zeros(len(texts), np.uint64)
            for j in range(i + 1, n + 1):
                h = h * np.uint64(BASE) + codes[rows, j - 1] + np.uint64(1)
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                known = self.hashes[at] == h
                k = np.where(known, self.numbers[at], -1)
                if j == i + 1 and (k < 0).any():
                    for x in np.unique(codes[rows[k < 0], i]).tolist():
                        k[(k < 0) & (codes[rows, i] == x)] = self._outside(chr(x))
                if (k >= 0).any():
                    arcs[i, j] = (rows[k >= 0], k[k >= 0])
                rows, h = rows[known], h[known]
                if not len(rows):
                    break
        return dict(sorted(arcs.items(), key=lambda x: (x[0][1], x[0][0])))

    def _groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            end, n = at + 1, len(words[order[at]])
            while end < len(order) and end - at < BATCH and len(words[order[end]]) == n:
                end += 1
            yield np.array(order[at:end]), [MARK + words[i] for i in order[at:end]]
            at = end

    def _forward(self, arcs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], n: int, texts: int) -> np.ndarray:
        """Natural logs of the sums over all segmentations up to each position: positions by texts by components."""
        log, logp = np.full((n + 1, texts, self.p.shape[1]), -np.inf), np.log(self.p)
        log[0] = 0.0
        for (i, j), (r, k) in arcs.items():
            log[j, r] = np.logaddexp(log[j, r], log[i, r] + logp[k])
        return log

    def logs(self, words: list[str]) -> np.ndarray:
        """Natural logs, words by components."""
        out = np.empty((len(words), self.p.shape[1]))
        for rows, texts in self._groups(words):
            arcs, n = self._arcs(texts), len(texts[0])
            out[rows] = self._forward(arcs, n, len(texts))[n]
        return out

    def expected(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """Expected piece counts, pieces by components. times: words by components."""
        size = len(self.p)
        sums = np.zeros((size, self.p.shape[1]))
        for rows, texts in self._groups(words):
            arcs, n, m = self._arcs(texts), len(texts[0]), self.p.shape[1]
            # in steps scaled by the forward sums, so that texts of any length fit
            alpha, weight, logp = self._forward(arcs, n, len(texts)), np.zeros((n + 1, len(texts), m)), np.log(self.p)
            weight[n] = times[rows]
            used, shares = [], []
            for (i, j), (r, k) in reversed(arcs.items()):
                p = weight[j, r] * np.exp(alpha[i, r] + logp[k] - alpha[j, r])
                weight[i, r] += p
                used.append(k)
                shares.append(p)
            used, shares = np.concatenate(used), np.concatenate(shares)
            size = max(size, len(self.p))
            sums.resize((size, m), refcheck=False)
            for c in range(m):
                sums[:, c] += np.bincount(used, shares[:, c], size)
        for char, x in self.outside.items():
            if x < size:
                for b in char.encode("utf-8", "surrogatepass"):
                    sums[b] += sums[x]
        return sums[: self.pieces]


def _held(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _words(text: bytes) -> list[bytes]:
    """Words of the lower-cased text. str.split() would also part at white space beyond ASCII, so bytes are split."""
    return text.translate(_LOWER).split()


def _by_bucket(distinct: Iterable[bytes], buckets: int) -> dict[int, list[bytes]]:
    """A chunk's distinct words by bucket, in order of their first places. The answers follow this order."""
    split: dict[int, list[bytes]] = {}
    for w in distinct:
        split.setdefault(zlib.crc32(w) % buckets, []).append(w)
    return split


SENT = "chunk long, bucket int, words binary, counts binary"


def _send(buckets: int, names: list[str | None]):
    """The chunk's distinct words by bucket, with their training counts in each component."""
    place = {n: i for i, n in enumerate(names)}

    def run(chunk: int, rows: Chunk) -> pd.DataFrame:
        number: dict[bytes, int] = {}
        tallies = [dict() for _ in range(len(names))]
        for doc_id, text, part in zip(rows.ids, rows.texts(), rows.table.column("part").to_pylist(), strict=True):
            found = _words(text)
            for w in found:
                if w not in number:
                    number[w] = len(number)
            if not _held(doc_id):
                tally = tallies[place.get(part, len(names) - 1)]
                for w in found:
                    tally[w] = tally.get(w, 0) + 1
        counts = np.zeros((len(number), len(names)), "<u4")
        for c, tally in enumerate(tallies):
            counts[[number[w] for w in tally], c] = list(tally.values())
        return pd.DataFrame([(chunk, b, b" ".join(ws), counts[[number[w] for w in ws]].tobytes()) for b, ws in _by_bucket(number, buckets).items()], columns=["chunk", "bucket", "words", "counts"])

    return run


def _merged(pdf: pd.DataFrame, components: int) -> tuple[dict[bytes, int], np.ndarray]:
    number: dict[bytes, int] = {}
    listed = [bytes(w).split(b" ") for w in pdf["words"]]
    for ws in listed:
        for w in ws:
            if w not in number:
                number[w] = len(number)
    total = np.zeros((len(number), components), np.int64)
    for ws, counts in zip(listed, pdf["counts"], strict=True):
        total[[number[w] for w in ws]] += np.frombuffer(counts, "<u4").reshape(-1, components)
    return number, total


def _vocabulary(components: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number, total = _merged(pdf, components)
        used = total.sum(axis=1) > 0
        words = [w for w, u in zip(number, used, strict=True) if u]
        return pd.DataFrame([(b" ".join(words), total[used].astype("<i8").tobytes(), len(words), (total > 0).sum(axis=0).tolist(), total.sum(axis=0).tolist())], columns=["words", "counts", "distinct", "kinds", "tokens"])

    return run


def _text(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass")


def fit(vocabulary: DataFrame, pieces: list[str], first: np.ndarray, components: int, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Piece probabilities by component after rounds of expectation maximisation. prior: pseudo-counts spread as the first probabilities say."""
    spark = vocabulary.sparkSession
    now = np.repeat(first[:, None], components, axis=1)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, now))  # of the subword vocabulary's fixed size

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = 0.0
            for b in batches:
                for words, counts in zip(b["words"], b["counts"], strict=True):
                    if len(words):
                        lattice = Lattice(*shared.value)
                        sums = sums + lattice.expected([_text(w) for w in bytes(words).split(b" ")], np.frombuffer(counts, "<i8").reshape(-1, components).astype(float))
            if not np.isscalar(sums):
                at = np.flatnonzero(sums.any(axis=1))
                yield pd.DataFrame({"piece": at, "n": sums[at].tolist()})

        spread = vocabulary.select("words", "counts").repartition(partitions(spark))
        each = spread.mapInPandas(expect, "piece int, n array<double>").groupBy("piece").agg(F.array(*[F.sum(F.get("n", F.lit(c))) for c in range(components)]).alias("n"))
        counts = np.repeat(prior * first[:, None], components, axis=1)
        for piece, n in each.toPandas().itertuples(index=False):
            counts[piece] += n
        now = counts / counts.sum(axis=0)
    return now


def _answer(shared, components: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number, total = _merged(pdf, components)
        pieces, probabilities, sizes, kinds = shared.value
        lattice = Lattice(pieces, probabilities).logs([_text(w) for w in number])
        whole = np.maximum(total - DISCOUNT, 0.0) / sizes
        with np.errstate(divide="ignore"):
            logs = np.logaddexp(np.log(whole), lattice + np.log(np.maximum(DISCOUNT * kinds, 1.0) / sizes))
        logs = np.hstack([logs, lattice]).astype("<f4")
        pooled, out = total.sum(axis=1).astype("<i8"), []
        for chunk, bucket, words in zip(pdf["chunk"], pdf["bucket"], pdf["words"], strict=True):
            at = [number[w] for w in bytes(words).split(b" ")]
            out.append((chunk, bucket, pack_counts(pooled[at]), logs[at].tobytes()))
        return pd.DataFrame(out, columns=["chunk", "bucket", "counts", "logs"])

    return run


def lattice_scores(docs: DataFrame, vocabulary: str | None = None, rounds: int = ROUNDS, component: str | None = "lang") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, piece_score for each row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (F.col(component).cast("string") if component in docs.columns else F.lit(None).cast("string")).alias("part"))
    chunks = packed(docs, "part")
    buckets = bucket_count(docs)
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    by_part = docs.where(fold != HELD_OUT).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    frequent = [(r["part"], r["n"]) for r in by_part.orderBy(F.desc("n"), "part").limit(COMPONENTS - 1).collect()]
    ends = docs.where(fold != HELD_OUT).count()
    names, shares = [p for p, _ in frequent], [float(n) for _, n in frequent]
    if ends > sum(shares) or not names:
        # the last component is for all other values
        names, shares = [*names, "\0other"], [*shares, ends - sum(shares)]
    shares = np.array(shares)
    sent = stored(per_chunk(chunks, _send(buckets, names), SENT), "chunk-words")
    k = len(names)
    known = stored(sent.groupBy("bucket").applyInPandas(_vocabulary(k), "words binary, counts binary, distinct long, kinds array<long>, tokens array<long>"), "vocabulary")
    sums = known.agg(F.coalesce(F.sum("distinct"), F.lit(0)), *[F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0)) for c in ("kinds", "tokens") for i in range(k)]).first()
    distinct, kinds, tokens = sums[0], np.array(sums[1 : k + 1], float), np.array(sums[k + 1 :], float)
    total, all_kinds = int(tokens.sum()) + ends, distinct + (1 if ends else 0)
    pieces, first = vocabulary_scores(vocabulary or default_vocabulary())
    probabilities = fit(known, pieces, first, k, rounds)
    discard(known)
    sizes = np.maximum(tokens + shares, 1.0)
    shared = spark.sparkContext.broadcast((pieces, probabilities, sizes, kinds))
    replies = sent.groupBy("bucket").applyInPandas(_answer(shared, k), "chunk long, bucket int, counts binary, logs binary")
    floor = math.log10(total + 0.5 * (all_kinds + 1))
    with np.errstate(divide="ignore"):
        prior = np.log(shares / ends) if ends else np.full(k, -math.log(k))
    end_logs = np.log(np.maximum(shares, 0.5) / sizes)

    def judge(_: int, rows: Chunk, reply: pd.DataFrame) -> pd.DataFrame:
        place: dict[bytes, int] = {}
        found = [_words(text) for text in rows.texts()]
        split, counts = _by_bucket(dict.fromkeys(w for ws in found for w in ws), buckets), [np.zeros(0)]
        for bucket, packed_counts in zip(reply["bucket"], reply["counts"], strict=True):
            for w in split[bucket]:
                place[w] = len(place)
            counts.append(unpack_counts(packed_counts, len(split[bucket])).astype(float))
        counts = np.concatenate(counts)
        logs = np.frombuffer(b"".join(reply["logs"]), "<f4").reshape(-1, 2 * k).astype(float)
        base = np.log10(counts + 0.5) - floor
        out = []
        for doc_id, words in zip(rows.ids, found, strict=True):
            at = np.array([place[w] for w in words], np.int64)
            sides = logs[at].sum(axis=0).reshape(2, k) + prior + end_logs
            score, by_pieces = (np.logaddexp.reduce(sides, axis=1) / math.log(10)).tolist()
            out.append((doc_id, _held(doc_id), len(at) + 1, int((counts[at] > 0).sum()) + (ends > 0), total, float(base[at].sum()) + math.log10(ends + 0.5) - floor, score, by_pieces))
        return frame(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "piece_score"], ("doc_id", "n_tokens", "n_known", "train_tokens"))

    return answered(chunks, replies, judge, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, piece_score double")
