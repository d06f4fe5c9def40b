"""Rows in chunks of bounded size, and a census of 64-bit keys over all chunks.

Python stages that need to ask the whole corpus about what they hold work in three steps: each chunk packs its keys into one row for each bucket
(a range of keys), each bucket merges what the chunks sent and answers each of them in one row, and each chunk reads its
answers. All between the steps are arrays packed into binary columns, so a shuffle moves few rows. A chunk names a key
once however often it holds it, so a key of a third of all rows reaches its bucket once for each chunk.

A chunk is one row: the ids and texts of neighbouring rows up to a size in bytes, whatever they hold, as a compressed Arrow stream. It is cut
from the rows as they are read, so neither a hot id nor a hot text makes a large one, and ids stay exact beside nulls.

A key is its bucket, taken from the upper bits, with its lower 40 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, partitions, stored


def frame(rows: list[tuple], columns: list[str] | tuple[str, ...], whole: tuple[str, ...] = ("doc_id",)) -> pd.DataFrame:
    """A frame whose `whole` columns are nullable integers; pandas by itself would turn integers beside nulls into doubles."""
    out = pd.DataFrame(rows, columns=list(columns), dtype=object)
    return out.assign(**{c: pd.array(out[c].tolist(), dtype="Int64") for c in whole})


LOW = np.uint64((1 << 40) - 1)


def _cut(docs: DataFrame, columns: tuple[str, ...], mb: int) -> DataFrame:
    """chunk, bytes, blob: rows of docs (doc_id, text with null as empty, further columns) in chunks of about mb MB of text, less where
    that would leave partitions without any."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    most = max(1 << 18, min(mb << 20, total // partitions(spark)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def blob() -> pa.RecordBatch:
            nonlocal number, held, size
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            row = {"chunk": pa.array([(task << 24) + number], pa.int64()), "bytes": pa.array([size], pa.int64()), "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())}
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            first = 0
            for i, n in enumerate(lengths.tolist()):
                if size and size + n > most:
                    if i > first:
                        held.append(batch.slice(first, i - first))
                    first = i
                    yield blob()
                size += n
            if first < len(lengths):
                held.append(batch.slice(first))
        if held:
            yield blob()

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *columns)
    return named.mapInArrow(run, "chunk long, bytes long, blob binary")


def dealt(docs: DataFrame, *columns: str, mb: int = 24) -> DataFrame:
    """The chunks dealt by their number. Within one plan the exchange is made once; another plan may cut other chunks, see packed()."""
    return _cut(docs, columns, mb).repartition("chunk")


def packed(docs: DataFrame, *columns: str, mb: int = 24) -> DataFrame:
    """The chunks as a table, for operators that read them in several plans."""
    return stored(_cut(docs, columns, mb), "chunks")


def bucket_count(docs: DataFrame, mb: int = 24) -> int:
    """Buckets for a census: one for mb MB of text, at least one for each shuffle partition."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-total // (mb << 20)))


class Chunk:
    """The rows of a blob. ids: None for null; data, sizes: the texts' UTF-8 bytes one after another."""

    def __init__(self, blob: bytes) -> None:
        self.table = pa.ipc.open_stream(pa.py_buffer(blob)).read_all()
        self.ids: list[int | None] = self.table.column("doc_id").to_pylist()
        text = pc.cast(self.table.column("text"), pa.large_binary())
        parts, sizes = [], []
        for piece in text.chunks:
            at = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset : piece.offset + len(piece) + 1]
            parts.append(np.frombuffer(piece.buffers()[2] or b"", np.uint8)[at[0] : at[-1]])
            sizes.append(np.diff(at))
        self.data = np.concatenate([np.zeros(0, np.uint8), *parts])
        self.sizes = np.concatenate([np.zeros(0, np.int64), *sizes])
        # the texts are held once
        self.table = self.table.drop_columns(["text"])

    def texts(self) -> Iterator[bytes]:
        ends = np.cumsum(self.sizes)
        for a, b in zip((ends - self.sizes).tolist(), ends.tolist(), strict=True):
            yield self.data[a:b].tobytes()


def chunks_of(pdf: pd.DataFrame) -> Iterator[tuple[int, Chunk]]:
    for number, blob in zip(pdf["chunk"], pdf["blob"], strict=True):
        yield int(number), Chunk(blob)


def per_chunk(chunks: DataFrame, run, schema: str) -> DataFrame:
    """run(number, chunk) -> frame of the schema, for each chunk."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        give_back()
        return next(run(number, chunk) for number, chunk in chunks_of(pdf))

    return chunks.select("chunk", "blob").groupBy("chunk").applyInPandas(each, schema)


def answered(chunks: DataFrame, replies: DataFrame, run, schema: str) -> DataFrame:
    """run(number, chunk, its rows of replies) -> frame of the schema, for each chunk."""

    def each(pdf: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        give_back()
        found = [run(number, chunk, reply) for number, chunk in chunks_of(pdf)]
        # replies come for chunks alone, so there is one
        return found[0] if found else reply.iloc[:0]

    return chunks.select("chunk", "blob").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(each, schema)


def squeeze(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and lower 40 bits of 64-bit keys, in one number."""
    return (((keys >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40)) | (keys & LOW)


def pack40(low: np.ndarray) -> bytes:
    return np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack40(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel()


def by_bucket(squeezed: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) over sorted squeezed keys."""
    if not len(squeezed):
        return
    least, most = int(squeezed[0] >> np.uint64(40)), int(squeezed[-1] >> np.uint64(40))
    cuts = np.searchsorted(squeezed, np.arange(least, most + 2, dtype=np.uint64) << np.uint64(40)).tolist()
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), least):
        if b > a:
            yield k, slice(a, b)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in the least of 2, 4 or 8 bytes that holds the largest of them exactly."""
    most = int(counts.max(initial=0))
    return counts.astype("<u2" if most < 2**16 else "<u4" if most < 2**32 else "<u8").tobytes()


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    """The n counts of pack_counts; their width follows from the length."""
    return np.frombuffer(blob, f"<u{len(blob) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


CENSUS = "chunk long, bucket int, keys binary, counts binary"


def census_rows(chunk: int, squeezed: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """Rows of CENSUS from a chunk's sorted distinct keys. Counts of 1 aren't written where a bucket has no other."""
    out = []
    for bucket, part in by_bucket(squeezed):
        c = counts[part]
        out.append((chunk, bucket, pack40(squeezed[part] & LOW), b"" if (c == 1).all() else pack_counts(c)))
    return pd.DataFrame(out, columns=["chunk", "bucket", "keys", "counts"])


def counted_rows(chunk: int, every: np.ndarray) -> pd.DataFrame:
    """Rows of CENSUS from a chunk's squeezed keys with their repetitions. They are sorted in place and counted a bucket at a time, so that no second array
    of their length is held."""
    every.sort()
    out = []
    for _, part in by_bucket(every):
        own = every[part]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out.append(census_rows(chunk, own[first], np.diff(first, append=len(own))))
    return pd.concat(out, ignore_index=True) if out else census_rows(chunk, every, np.zeros(0, np.int64))


def wide_rows(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pd.DataFrame:
    """Rows of CENSUS with whole 64-bit keys, in buckets below 0: for keys of which a false match would lose something."""
    of = (keys % np.uint64(buckets)).astype(np.int64)
    out = [(chunk, -1 - int(b), keys[of == b].astype("<u8").tobytes(), pack_counts(counts[of == b])) for b in np.unique(of)]
    return pd.DataFrame(out, columns=["chunk", "bucket", "keys", "counts"])


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, those of its keys that all chunks together hold at least twice, with their numbers. A chunk's keys are distinct, so its
    numbers add up by place; they are unpacked a chunk at a time, as all of them at once would take several times the bucket's size."""
    give_back()
    wide = pdf["bucket"].iloc[0] < 0
    size = 8 if wide else 5

    def keys(blob: bytes) -> np.ndarray:
        return np.frombuffer(blob, "<u8") if wide else unpack40(blob)

    every, at = np.empty(sum(map(len, pdf["keys"])) // size, np.uint64), 0
    for blob in pdf["keys"]:
        own = keys(blob)
        every[at : at + len(own)] = own
        at += len(own)
    every.sort()
    every = every[np.concatenate([np.ones(min(1, len(every)), bool), every[1:] != every[:-1]])]
    total = np.zeros(len(every), np.int64)
    for blob, c in zip(pdf["keys"], pdf["counts"], strict=True):
        own = keys(blob)
        total[np.searchsorted(every, own)] += unpack_counts(c, len(own)) if c else 1
    known, total = every[total > 1], total[total > 1]
    del every
    out = []
    for chunk, bucket, blob in zip(pdf["chunk"], pdf["bucket"], pdf["keys"], strict=True):
        if not len(known):
            continue
        own = keys(blob)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit = known[at] == own
        if hit.any():
            out.append((chunk, bucket, own[hit].tobytes() if wide else pack40(own[hit]), pack_counts(total[at[hit]])))
    return pd.DataFrame(out, columns=["chunk", "bucket", "keys", "counts"])


def repeated_keys(census: DataFrame) -> DataFrame:
    """CENSUS rows of the answers: keys that occur twice or more, with exact counts."""
    return census.groupBy("bucket").applyInPandas(_merge, CENSUS)


def answers(pdf: pd.DataFrame, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, counts) of one chunk's answers: squeezed keys, or the wide ones."""
    pdf = pdf[(pdf["bucket"] < 0) == wide].sort_values("bucket")
    if not len(pdf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = 8 if wide else 5
    keys, counts, at = np.empty(sum(map(len, pdf["keys"])) // size, np.uint64), np.empty(sum(map(len, pdf["keys"])) // size, np.int64), 0
    for b, k, c in zip(pdf["bucket"], pdf["keys"], pdf["counts"], strict=True):
        n = len(k) // size
        keys[at : at + n] = np.frombuffer(k, "<u8") if wide else unpack40(k) | (np.uint64(b) << np.uint64(40))
        counts[at : at + n] = unpack_counts(c, n)
        at += n
    # buckets are ranges of keys, sorted within; wide keys are dealt to buckets by remainder
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    return keys, counts


def looked_up(keys: np.ndarray, table: np.ndarray, values: np.ndarray, default: int) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), default, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], default)
