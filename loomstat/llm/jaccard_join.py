"""Jaccard join of word-shingle sets with adaptive multi-match prefixes.

Sets are ordered by document frequency, rare first, then by hash. Two sets with similarity t or more share at least l tokens of
their l-prefixes, the first n - ceil(t n) + l tokens, for any l. Each set takes the l whose longer prefix costs least: posting-list
lengths of the prefix plus verifications expected to remain; a pair is verified when it shares as many prefix tokens as the
smaller l of the two asks for, given both sizes.

Steps: (1) A census of all shingles over chunks of documents gives frequencies; the census also counts each set's signature, so that copies
of one set don't count as other sets. A set with fewer than ceil(t n) shingles that some other set has can't link and goes no further.
(2) Of copies one stands for all. (3) Postings of the prefixes' shared tokens. A cheap round verifies each set against the hub it shares
most prefix tokens with, and connected components of the links found are built; this settles most of a group of near
copies in time linear in its size. (4) The join proper looks, in each posting list that still holds sets of different components, for the partners in larger
components of the sets outside its largest one; shared prefix tokens are counted, and a set's partners with enough are kept as one array for each
component, likeliest first. The arrays are verified from their front, a few partners first and then more at a time, each time only those between sets
that are still in different components: where one of the first partners links, the others are never formed as pairs, as they can't change a component.
Verification compares whole sets of 64-bit shingle hashes, exactly 100 * intersection >= 75 * union.

Defined results: null and empty texts have the empty set and link with nothing; with fewer than `width` words the whole sequence is the
only shingle; copies of a non-empty set are linked with each other; a null doc_id takes part, and names a component only if it has no other id.
Columns besides doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CENSUS, Chunk, answered, answers, bucket_count, counted_rows, frame, looked_up, pack_counts, packed, per_chunk, repeated_keys, squeeze, unpack_counts, wide_rows
from .common import discard, stored, unused
from .components import components

WIDTH, PERCENT, LONGEST = 5, 75, 32
CHUNK_MB = 12  # a task's arrays take about 15 times its chunk's text
KNOWN = 1 << 17  # words whose hashes a task keeps; all are hashed, some again
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, width: int = WIDTH) -> None:
        self.width, self.words = width, {}

    def __call__(self, text: bytes) -> np.ndarray:
        parts, known = text.translate(_LOWER).split(), self.words
        if not parts:
            return np.zeros(0, np.uint64)
        if len(known) > KNOWN:
            known.clear()
        for w in parts:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.array([known[w] for w in parts], np.uint64)
        if len(h) < self.width:
            return np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed=len(parts))], np.uint64)
        out = h[: len(h) - self.width + 1].copy()
        for k in range(1, self.width):
            out = out * _PRIME + h[k : len(h) - self.width + 1 + k]
        return np.unique(_mixed(out))


def needed(n: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """Tokens a set of n must share with any set it links with."""
    return -(-n * percent // 100)


def _signature(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes())


def _linking_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, sig for each row; tokens and frequencies too for one row of a set and chunk that may link with another set."""
    chunks = packed(docs, mb=CHUNK_MB)
    buckets = bucket_count(docs, mb=CHUNK_MB)

    def census(number: int, chunk: Chunk) -> pd.DataFrame:
        shingle, found, signatures = Shingler(width), [np.zeros(0, np.uint64)], []
        for s in map(shingle, chunk.texts()):
            if len(s):
                found.append(squeeze(s, buckets))
                signatures.append(_signature(s))
        del shingle
        every = np.concatenate(found)
        del found
        # a false match of signatures could make a set look like a mere copy, hence all 64 bits
        return pd.concat([counted_rows(number, every), wide_rows(number, *np.unique(np.array(signatures, np.uint64), return_counts=True), buckets)])

    replies = repeated_keys(per_chunk(chunks, census, CENSUS))

    def judge(_: int, chunk: Chunk, reply: pd.DataFrame) -> pd.DataFrame:
        table, counts = answers(reply)
        signatures, numbers = answers(reply, wide=True)
        copies = dict(zip(signatures.tolist(), numbers.tolist(), strict=True))
        out, seen, shingle = [], set(), Shingler(width)
        for doc_id, text in zip(chunk.ids, chunk.texts(), strict=True):
            s = shingle(text)
            n = len(s)
            if not n:
                out.append((doc_id, 0, None, None, None))
                continue
            sig = _signature(s)
            row = (doc_id, n, np.uint64(sig).astype(np.int64).item(), None, None)
            if sig not in seen:
                seen.add(sig)
                df = looked_up(squeeze(s, buckets), table, counts, 1)
                if (df > copies.get(sig, 1)).sum() >= needed(n, percent):
                    row = (*row[:3], s.tobytes(), pack_counts(df))
            out.append(row)
        return frame(out, ["doc_id", "n_shingles", "sig", "tokens", "df"], ("doc_id", "n_shingles", "sig"))

    judged = stored(answered(chunks, replies, judge, "doc_id long, n_shingles long, sig long, tokens binary, df binary"), "sets")
    discard(chunks)
    return judged


def chosen_length(df: np.ndarray, n: int, percent: int = PERCENT, longest: int = LONGEST) -> int:
    """The l of least estimated cost. df: frequencies in prefix order. A list is scanned for each prefix token; of the sets met, those
    expected to share l tokens or more are verified, at a cost of a set's length each."""
    base = n - needed(n, percent)
    best, cost = 1, None
    for l in (2**k for k in range(longest.bit_length())):
        if base + l > n:
            break
        scanned = float(df[: base + l].sum())
        estimate = scanned + n * scanned / (base + l) / l
        if cost is None or estimate < cost:
            best, cost = l, estimate
    return best


def _postings(sets: DataFrame, percent: int, longest: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sig, n, tokens, df in zip(b["sig"], b["n"], b["tokens"], b["df"], strict=True):
                t, f = np.frombuffer(tokens, np.uint64), unpack_counts(df, n)
                order = np.lexsort((t, f))
                t, f = t[order], f[order]
                l, base = chosen_length(f, n, percent, longest), n - needed(n, percent)
                # another set may have chosen a longer prefix than this one, hence all positions up to the longest
                last = min(n, base + l)
                at = np.arange(last)[f[:last] > 1]
                out.append(pd.DataFrame({"token": t[at].astype(np.int64), "sig": sig, "n": n, "over": at - base, "l": l}))
            if out:
                yield pd.concat(out)

    return sets.mapInPandas(run, "token long, sig long, n long, over long, l long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sets are similar enough. Where pairs are few, only the sets that they name are shuffled."""
    sets = sets.select("sig", "tokens")
    if pairs.count() <= FEW:
        sets = sets.join(F.broadcast(pairs.select(F.col("a").alias("sig")).union(pairs.select("b"))), "sig", "left_semi")
    left = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("sig").alias("b"), F.col("tokens").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep = []
            for x, y in zip(p["x"], p["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield p.loc[keep, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "a long, b long")


def _sized(percent: int, n: str, m: str):
    """Sets whose sizes alone rule a link out aren't compared."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m))


def least_shared(n: np.ndarray, m: int, l: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Tokens that similar sets of n and m must share within their l-prefixes. Of the two prefixes one ends first in the global order; all
    shared tokens up to there lie in both, and no more follow than that set has left."""
    overlap = -(-percent * (n + m) // (100 + percent))
    return np.maximum(l, overlap - np.maximum(needed(n, percent), needed(m, percent)) + l)


LIST = 2048  # sets in a block of a posting list
MEMBER = ("sig", "n", "over", "l", "root", "of")
PAIRS, HELD = 1 << 18, 1 << 22  # pairs of two blocks looked at together, bytes of partners sent on together
FIRST, MORE = 4, 16  # partners of a set in a component that are verified first; how many times as many each round after
FEW = 1 << 15  # pairs up to which the sets they name are picked by a broadcast


def _graded(percent: int):
    """Size class, a factor of 100 / percent wide and a hair more, so that rounding never parts sizes that may link by two classes."""
    return F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / percent * (1 + 1e-9)))).cast("int")


def _hub_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """For each set the hub that it shares most prefix tokens with. The hub of a posting list's size class is the set with the fewest rarer tokens
    before it: of near copies one that was changed least, which links with more of them than any other."""
    posts = posts.withColumn("grade", _graded(percent))
    least = F.struct("over", F.xxhash64("sig"))
    hubs = posts.groupBy("token", "grade").agg(F.min_by(F.struct("sig", "n"), least).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select("token", "grade", F.col("hub.sig").alias("hub"), F.col("hub.n").alias("m"))
    met = posts.join(hubs, ["token", "grade"]).where((F.col("sig") != F.col("hub")) & _sized(percent, "n", "m")).groupBy("sig", "hub").agg(F.count(F.lit(1)).alias("c"))
    best = met.groupBy("sig").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))
    return best.select(F.least("sig", "hub").alias("a"), F.greatest("sig", "hub").alias("b")).distinct()


def _met(minors: tuple, members: tuple, percent: int, roots: bool) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Of two blocks of a posting list: for each minor set the members of higher components that its size and both prefixes allow, with the
    number of prefix tokens that the two must share, and the members' roots if they are asked for. Pairs ruled out here reach no disk."""
    minors, members = (tuple(np.asarray(x, np.int64) for x in side) for side in (minors, members))
    sig, n, over, l, root, of = (x[None] for x in members)
    step = max(1, PAIRS // sig.size)
    for at in range(0, len(minors[0]), step):
        zsig, zn, zover, zl, zroot, zof = (x[at : at + step, None] for x in minors)
        least = np.minimum(l, zl)
        ok = ((of > zof) | ((of == zof) & (root > zroot))) & (100 * np.minimum(n, zn) >= percent * np.maximum(n, zn)) & (over < least) & (zover < least)
        for i in np.flatnonzero(ok.any(axis=1)).tolist():
            own = np.flatnonzero(ok[i])
            need = least_shared(n[0, own], int(zn[i, 0]), least[i, own], percent)
            yield int(zsig[i, 0]), sig[0, own].tobytes(), pack_counts(need), root[0, own].tobytes() if roots else b""


def _candidates(posts: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """z, root, partners: for each set outside the largest component of a posting list and each higher component it meets, the sets that share as many
    prefix tokens with it as they must, packed, those with most beyond that first. A pair of sets is in one row at most.

    A posting list that holds one component is left out. The others are parted by size class, a factor of 100 / percent wide, as
    sets more than a class apart can't link, and each part is cut by a hash into blocks of about LIST sets, one row each. Each set outside the largest
    component, in blocks as well, meets the blocks of its own and the two neighbouring classes; the join's key holds the block, so that a hot token's
    blocks are dealt over many tasks. What _met() leaves of a set's partners is then counted together."""
    # components are ordered by size; of a pair, the set of the lower component is outside the largest one in every list that holds both
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).cast("int").alias("of"))
    graded = roots.join(sizes, "root")
    joined = posts.join(graded, "sig", "left").withColumn("root", F.coalesce("root", "sig")).withColumn("of", F.coalesce("of", F.lit(1)))
    parts = joined.groupBy("token", "root").agg(F.max("of").alias("of"))
    major = parts.groupBy("token").agg(F.max_by("root", F.struct("of", "root")).alias("major"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("token", "major")
    lists = stored(joined.join(major, "token").withColumn("grade", _graded(percent)), "lists")
    # a table of its own, so that a hot token's rows needn't meet in one task for the join with it
    of_list = F.when(F.col("root") != F.col("major"), F.lit(1))
    cut = stored(lists.groupBy("token", "grade").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("blocks"), F.ceil(F.count(of_list) / LIST).cast("int").alias("zblocks")), "cuts")

    def packed_blocks(rows: DataFrame, blocks: str, prefix: str = "") -> DataFrame:
        """One row for each block of a list's part, with its sets as arrays."""
        member = F.struct("sig", F.col("n").cast("int").alias("n"), F.col("over").cast("int").alias("over"), F.col("l").cast("smallint").alias("l"), "root", "of")
        parted = rows.join(cut, ["token", "grade"]).withColumn("block", F.pmod(F.xxhash64("sig"), F.col(blocks)).cast("int"))
        # by the whole key: the planner would let the join's partitions by token and grade do
        key = ["token", "grade", "block"]
        gathered = parted.repartition(*key).groupBy(*key).agg(F.collect_list(member).alias("members"))
        return gathered.select(*key, *[F.col(f"members.{c}").alias(prefix + c) for c in MEMBER])

    minor = packed_blocks(lists.where(F.col("root") != F.col("major")), "zblocks", "z").drop("block")
    minor = minor.withColumn("grade", F.explode(F.array(F.col("grade") - 1, F.col("grade"), F.col("grade") + 1)))
    reach = minor.join(cut, ["token", "grade"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "zblocks")
    met = reach.join(packed_blocks(lists, "blocks"), ["token", "grade", "block"]).select(*["z" + c for c in MEMBER], *MEMBER)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, held = [], 0
            for row in b.itertuples(index=False, name=None):
                for found in _met(row[: len(MEMBER)], row[len(MEMBER) :], percent, True):
                    rows.append(found)
                    held += len(found[1])
                    if held > HELD:
                        yield pd.DataFrame(rows, columns=["z", "sig", "need", "root"])
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=["z", "sig", "need", "root"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        z, sizes = int(pdf["z"].iloc[0]), [len(x) // 8 for x in pdf["sig"]]
        sig = np.frombuffer(b"".join(pdf["sig"]), np.int64)
        need = np.concatenate([unpack_counts(x, n) for x, n in zip(pdf["need"], sizes, strict=True)])
        found, first, times = np.unique(sig, return_index=True, return_counts=True)
        enough = times >= need[first]
        found, beyond, root = found[enough], (times - need[first])[enough], np.frombuffer(b"".join(pdf["root"]), np.int64)[first[enough]]
        order = np.lexsort((found, -beyond, root))
        found, root = found[order], root[order]
        starts = np.flatnonzero(np.diff(root, prepend=root[:1] - 1))
        return pd.DataFrame({"z": z, "root": root[starts], "partners": [x.tobytes() for x in np.split(found, starts[1:])][: len(starts)]})

    counted = met.mapInPandas(meet, "z long, sig binary, need binary, root binary").groupBy("z").applyInPandas(count, "z long, root long, partners binary")
    out = stored(counted, "candidates")
    discard(lists, cut)
    return out


def _pairs_of(candidates: DataFrame, start: int, end: int | None) -> DataFrame:
    """The pairs a, b of each row's set and its partners from start to end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for z, partners in zip(rows["z"], rows["partners"], strict=True):
                own = np.frombuffer(partners, np.int64)[start:end]
                yield pd.DataFrame({"a": np.minimum(own, z), "b": np.maximum(own, z)})

    return candidates.mapInPandas(run, "a long, b long")


def _crossing_pairs(posts: DataFrame, roots: DataFrame, percent: int, only_best: bool) -> DataFrame:
    """Pairs of sets of different components that share as many prefix tokens as they must; only_best: of a set and a component, the likeliest."""
    return _pairs_of(_candidates(posts, roots, percent), 0, 1 if only_best else None)


def _still_apart(candidates: DataFrame, roots: DataFrame, start: int) -> DataFrame:
    """The rows with partners from start on whose set hasn't joined their component meanwhile."""
    own = roots.select(F.col("sig").alias("z"), F.col("root").alias("own"))
    theirs = roots.select(F.col("sig").alias("root"), F.col("root").alias("now"))
    more = candidates.where(F.octet_length("partners") > 8 * start).join(own, "z", "left").join(theirs, "root", "left")
    return more.where(F.coalesce("own", "z") != F.coalesce("now", "root")).select("z", "root", "partners")


def _joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """sig, root after further links a, b. Only the components that the links join are looked at, each as one node; a set in none is its own."""
    at_a = roots.select(F.col("sig").alias("a"), F.col("root").alias("ra"))
    at_b = roots.select(F.col("sig").alias("b"), F.col("root").alias("rb"))
    edges = links.join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    merged = components(edges).toDF("root", "new")
    kept = roots.join(merged, "root", "left").select("sig", F.coalesce("new", "root").alias("root"))
    added = merged.join(roots.select(F.col("sig").alias("root")), "root", "left_anti").select(F.col("root").alias("sig"), F.col("new").alias("root"))
    return kept.unionByName(added)


def similarity_classes(sets: DataFrame, percent: int = PERCENT, longest: int = LONGEST) -> DataFrame:
    """sig, root: the component of each set that links with another. sets: sig (distinct), n, tokens, df."""
    posts = stored(_postings(sets, percent, longest), "postings")
    pairs = stored(_hub_pairs(posts, percent), "pairs")
    links = stored(_verified(pairs, sets, percent), "links")
    named = stored(components(links).toDF("sig", "root"), "roots")
    discard(pairs, links)
    left, start, end = _candidates(posts, named, percent), 0, FIRST
    discard(posts)
    while not left.isEmpty():
        pairs = stored(_pairs_of(left, start, end), "pairs")
        links = stored(_verified(pairs, sets, percent), "links")
        if not links.isEmpty():
            before, named = named, stored(_joined_roots(named, links), "roots")
            discard(before)
        discard(pairs, links)
        start, end = end, end * MORE
        before, left = left, stored(_still_apart(left, named, start), "candidates")
        discard(before)
    discard(left)
    return named


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    judged = _linking_sets(docs, width, percent)
    sets = stored(judged.where("tokens IS NOT NULL").groupBy("sig").agg(F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"), F.first("df").alias("df")), "distinct-sets")
    rows = stored(judged.select("doc_id", "n_shingles", "sig"), "rows")
    discard(judged)
    roots = similarity_classes(sets, percent, longest)
    discard(sets)
    least = rows.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("least"))
    least = least.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = least.join(named, "root").select(F.col("sig").alias("s"), "component_id")
    out = rows.join(classes, F.col("sig") == F.col("s"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of docs whose id is their component's, all columns as they are; of rows with that id all stay."""
    name = unused("kept_id", docs)
    kept = jaccard_components(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
