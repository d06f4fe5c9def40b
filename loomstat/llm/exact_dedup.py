"""Exact deduplication over a cuckoo-filter index of live digests.

A CuckooIndex holds a cuckoo filter (16-bit fingerprints, four to a bucket, two candidate buckets by partial keys) and, for
each bucket, the keys stored there. A lookup asks the filter; a hit is verified against the content kept under the bucket, so
a false hit of the filter never drops a text. An insertion that finds no room after a bounded chain of evictions doubles
the filter and refills it from the stored keys. Deleting the last live row of a digest removes its fingerprint.

The corpus is deduplicated in two rounds. Each task first runs its own rows through an index whose stored content is the
normalised text itself, so that a group of copies leaves a task as one row with the ids it saw; a bounded index is emptied when
it is full, and later rounds put right what that splits. Then each digest range has an index of its own over SHA-256
digests with their lengths, which finds the row that stays. No task sees more than its range, and a group with a third
of all rows arrives pre-aggregated.

Defined results: null counts as empty; texts are equal when they are identical after replacing each run of white space by
one space; the smallest doc_id stays, null ids only where a group has no other; of rows with the same id and text, one
stays. Columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import frame
from .common import discard, exact, stored

SLOTS, KICKS = 4, 200
CONTENT_BYTES, IDS_IN_ROW, INDEX_KEYS = 48 << 20, 4096, 50_000


class CuckooIndex:
    """Digest -> content under a cuckoo filter. Digests are bytes of 16 or more, evenly distributed."""

    def __init__(self, buckets: int = 1024) -> None:
        self.resizes = 0
        self._empty(buckets)
        self.size = 0

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints: list[list[int]] = [[] for _ in range(buckets)]
        self.stored: list[dict[bytes, object]] = [{} for _ in range(buckets)]  # by the key's first bucket

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        fingerprint = int.from_bytes(digest[:2], "big") or 1
        first = int.from_bytes(digest[2:10], "big") & self.mask
        return fingerprint, first, self._other(first, fingerprint)

    def _other(self, bucket: int, fingerprint: int) -> int:
        return bucket ^ (fingerprint * 0x5BD1E995 & self.mask)

    def get(self, digest: bytes) -> object | None:
        """The content stored for the digest: asked only where the filter hits."""
        fingerprint, first, second = self._place(digest)
        if fingerprint in self.prints[first] or fingerprint in self.prints[second]:
            return self.stored[first].get(digest)
        return None

    def insert(self, digest: bytes, content: object) -> None:
        fingerprint, first, second = self._place(digest)
        if digest in self.stored[first]:
            self.stored[first][digest] = content
            return
        self.stored[first][digest] = content
        self.size += 1
        if not self._put(fingerprint, first, second):
            self._grow()

    def _put(self, fingerprint: int, first: int, second: int) -> bool:
        for bucket in (first, second):
            if len(self.prints[bucket]) < SLOTS:
                self.prints[bucket].append(fingerprint)
                return True
        bucket = first
        for kick in range(KICKS):
            slot = kick % SLOTS
            fingerprint, self.prints[bucket][slot] = self.prints[bucket][slot], fingerprint
            bucket = self._other(bucket, fingerprint)
            if len(self.prints[bucket]) < SLOTS:
                self.prints[bucket].append(fingerprint)
                return True
        return False

    def _grow(self) -> None:
        kept = [(d, c) for bucket in self.stored for d, c in bucket.items()]
        buckets = (self.mask + 1) * 2
        while True:
            self.resizes += 1
            self._empty(buckets)
            done = True
            for digest, content in kept:
                fingerprint, first, second = self._place(digest)
                self.stored[first][digest] = content
                done = done and self._put(fingerprint, first, second)
            if done:
                return
            buckets *= 2

    def delete(self, digest: bytes) -> bool:
        """Whether the digest was live. Its fingerprint goes only when the stored keys confirm the hit."""
        fingerprint, first, second = self._place(digest)
        if self.stored[first].pop(digest, None) is None:
            return False
        for bucket in (first, second):
            if fingerprint in self.prints[bucket]:
                self.prints[bucket].remove(fingerprint)
                break
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self.stored:
            yield from bucket.items()


def normalised(text: str | None) -> bytes:
    """UTF-8 with each run of white space as one space. bytes.split() parts at exactly that white space."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return raw
    body = b" ".join(raw.split())
    if not body:
        return b" "
    edge = b" \t\n\v\f\r"
    return (b" " if raw[0] in edge else b"") + body + (b" " if raw[-1] in edge else b"")


def local_groups(docs: DataFrame) -> DataFrame:
    """digest, bytes, row (unique), ids, least, docs: the groups of copies that each task sees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, rows = TaskContext.get().partitionId(), 0
        index, held = CuckooIndex(), 0

        def emit(groups: list[tuple[bytes, int, list]]) -> pd.DataFrame:
            nonlocal rows
            out = []
            for digest, size, ids in groups:
                known = [i for i in ids if i is not None]
                out.append((digest, size, (task << 34) + rows, ids, min(known) if known else None, len(ids)))
                rows += 1
            return frame(out, ["digest", "bytes", "row", "ids", "least", "docs"], ("bytes", "row", "least", "docs"))

        for b in batches:
            full: list[tuple[bytes, int, list]] = []
            for doc_id, no_id, text in zip(b["doc_id"].tolist(), b["no_id"].tolist(), b["text"], strict=True):
                doc_id = None if no_id else doc_id
                content = normalised(text)
                digest = hashlib.sha256(content).digest()
                hit = index.get(digest)
                if hit is not None and hit[0] == content:
                    hit[1].append(doc_id)
                    if len(hit[1]) >= IDS_IN_ROW:
                        full.append((digest, len(content), hit[1]))
                        index.delete(digest)
                        held -= len(content)
                    continue
                index.insert(digest, (content, [doc_id]))
                held += len(content)
                if held > CONTENT_BYTES:
                    full += [(d, len(c), ids) for d, (c, ids) in index.items()]
                    index, held = CuckooIndex(), 0
            if full:
                yield emit(full)
        left = [(d, len(c), ids) for d, (c, ids) in index.items()]
        for at in range(0, len(left), 20_000):
            yield emit(left[at : at + 20_000])

    return exact(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "no_id").mapInPandas(run, "digest binary, bytes long, row long, ids array<long>, least long, docs long")


def verdicts(groups: DataFrame) -> DataFrame:
    """digest, keep_id, keep_row, group_size: one index for each range of digests. A task takes its digests in sorted order, so its index is
    emptied, and what it found sent on, each time it holds `INDEX_KEYS` digests: no later row can ask for one of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, columns = CuckooIndex(), ["digest", "keep_id", "keep_row", "group_size"]

        def found() -> pd.DataFrame:
            out = [(d, None if o[0] else o[1], o[2], n) for d, (_, o, n) in index.items()]
            return frame(out, columns, ("keep_id", "keep_row", "group_size"))

        for b in batches:
            for digest, size, row, least, none, docs in zip(b["digest"], b["bytes"], b["row"], b["least"].tolist(), b["none"], b["docs"], strict=True):
                digest = bytes(digest)
                order = (1, 0, int(row)) if none else (0, least, int(row))
                hit = index.get(digest)
                if hit is None:
                    if index.size >= INDEX_KEYS:
                        yield found()
                        index = CuckooIndex()
                    index.insert(digest, [int(size), order, int(docs)])
                elif hit[0] != size:
                    raise ValueError("one SHA-256 digest for texts of different lengths")
                else:
                    hit[1] = min(hit[1], order)
                    hit[2] += int(docs)
        yield found()

    return exact(groups.select("digest", "bytes", "row", "least", "docs"), "least", "none").repartition("digest").sortWithinPartitions("digest").mapInPandas(run, "digest binary, keep_id long, keep_row long, group_size long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row."""
    groups = stored(local_groups(docs), "copies")
    found = verdicts(groups)
    joined = groups.join(found, "digest")
    least = F.when(F.col("row") == F.col("keep_row"), F.when(F.col("keep_id").isNull(), F.lit(0)).otherwise(F.array_position("ids", F.col("keep_id")).cast("int") - 1)).otherwise(F.lit(-1))
    opened = joined.select("keep_id", "group_size", F.lower(F.hex("digest")).alias("text_sha256"), least.alias("at"), F.posexplode("ids").alias("pos", "doc_id"))
    return opened.select("doc_id", "keep_id", "group_size", (F.col("pos") == F.col("at")).alias("kept"), "text_sha256")


def build_index(docs: DataFrame) -> DataFrame:
    """The persistent form of the index: digest, bytes and row of ids for each task's group; digests with several groups have several rows.
    keep_id of a digest is the least of its live ids: see live_digests()."""
    return local_groups(docs).select("digest", "bytes", "ids")


def live_digests(index: DataFrame) -> DataFrame:
    """digest, bytes, live (rows that hold it), keep_id (the least live id; null where all are)."""
    return index.groupBy("digest").agg(F.max("bytes").alias("bytes"), F.sum(F.size("ids")).alias("live"), F.min(F.array_min("ids")).alias("keep_id"))


def update_index(index: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """The index after rows came and went. A deleted row takes one live row of its id and text out; a row that isn't live is ignored. Each
    range of digests replays its insertions, then its deletions, through a CuckooIndex; a digest without live rows leaves it."""
    here, gone = F.lit(0).alias("kind"), F.lit(1).alias("kind")
    events = index.select("digest", "bytes", "ids", here).unionByName(build_index(inserted).withColumn("kind", here)).unionByName(build_index(deleted).withColumn("kind", gone))
    # one event for each id, so that a hot digest is a sorted stream and not a list
    events = events.select("digest", "bytes", "kind", F.explode("ids").alias("id"))
    events = exact(events, "id", "none").repartition("digest").sortWithinPartitions("digest", "none", "id", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        live, ids, current = CuckooIndex(), [], None

        def done() -> Iterator[pd.DataFrame]:
            if ids:
                yield pd.DataFrame([(current[0], current[1], list(ids))], columns=["digest", "bytes", "ids"])

        for b in batches:
            for digest, size, i, none, kind in zip(b["digest"], b["bytes"], b["id"].tolist(), b["none"], b["kind"], strict=True):
                key, i = (bytes(digest), int(size)), None if none else i
                if current != key or (len(ids) >= IDS_IN_ROW and kind == 0 and ids[-1] != i):
                    yield from done()
                    if current and current != key and live.get(current[0]) == 0:
                        live.delete(current[0])
                    ids, current = [], key
                if live.get(key[0]) is None:
                    if live.size >= INDEX_KEYS:
                        live = CuckooIndex()
                    live.insert(key[0], 0)
                if kind == 0:
                    ids.append(i)
                    live.insert(key[0], live.get(key[0]) + 1)
                elif ids and ids[-1] == i:
                    ids.pop()
                    live.insert(key[0], live.get(key[0]) - 1)
        if current:
            yield from done()

    return events.mapInPandas(run, "digest binary, bytes long, ids array<long>")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""
