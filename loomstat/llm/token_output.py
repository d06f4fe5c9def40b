"""Token-id output: shard files of independent zstandard frames with a trailing seek table.

File: frame*, seek frame, footer. A frame holds the ids of up to `docs_per_frame` documents as little-endian uint32, compressed
on its own. The seek frame is a zstandard skippable frame (fixed magic 0x184D2A5E): for each frame its compressed size, raw
size, xxh64 of the compressed bytes, number of documents, then for each document its id, whether the id is null, and its
number of ids. The footer is another skippable frame of fixed length with the seek frame's size and xxh64 and the number of frames, so a
reader finds the table from the file's end, and a plain zstandard decoder skips both. A reader of one document reads the table and
decompresses the one frame that holds it.

Shards are ranges of (doc_id, text), so the shards in order are the documents in ascending id. A task writes to a name of its own
and renames the file when it is whole, so a task that runs twice leaves one whole file of the same bytes.

Encoding is that of the tokenizers library, which cuts this vocabulary's texts before a space that has no white space after it,
whatever stands around; pieces between such cuts are encoded once and their ids reused, from memos of bounded size.

Defined results: ids are those of the library's plain encode(text, add_special_tokens=False), so the name of a special token inside a text
is that token; null texts are empty and hold the end id alone; null ids come first; rows with equal ids follow by text.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import frame
from .common import KEPT, fresh_path, give_back, partitions, stored

#: Fixed values of the file format.
SKIPPABLE, MAGIC, VERSION = 0x184D2A5E, b"LMTS", 1
FRAME, DOC, FOOTER = "<QQQI", np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")]), "<IIQQI4sI"
FRAME_SIZE, FOOTER_SIZE = struct.calcsize(FRAME), struct.calcsize(FOOTER)
#: A half of the memo just fits a dict's table of 1 << 20 or, small, 1 << 18 places. The small one is for workers beside a JVM that earlier stages
#: have grown: on 158 MB of text it took 160 MB of a worker less and missed 4.0 instead of 2.2 million times.
MEMO, SMALL_MEMO, ROWS = 1_398_000, 349_000, 50_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Memo(dict):
    """What a function gave for a key. Full, it becomes the older half, whose keys come back when they are asked for again."""

    def __init__(self, compute: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.compute, self.half, self.older = compute, most // 2, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.half:
            # the keys of two halves are never held beside those of a third
            self.older.clear()
            self.older.update(self)
            self.clear()
        found = self.older.get(key)
        if found is None:
            found = self.compute(key)
        self[key] = found
        return found


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes. Pieces seen before come from bounded memos of what the library gave for them."""

    def __init__(self, vocabulary: str, memo: int = MEMO) -> None:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenize, self.id = self.tokenizer.model.tokenize, attrgetter("id")
        # texts that hold a special token's name go to the library whole
        named = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(named)).search if named else lambda _: None
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        # a space with white space after it, or at the end, isn't a cut
        self.uncut, self.cuts = re.compile(r" (?!\S)").search, re.compile(r" (?=\S)").split
        # the byte alphabet of byte-level vocabularies: printable Latin-1 stands for itself, other bytes follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.space = self.alphabet[32]
        #: by stretch between cuts, its leading space left out; by word of the library's own cutting
        self.spaced = Memo(lambda s: self._stretch(" " + s), memo)
        self.bare = Memo(self._word, memo // 8)

    def _word(self, word: str) -> bytes:
        # cut words go straight to the library's model, without its pipeline around them
        return array("I", map(self.id, self.tokenize(word.encode("utf-8").decode("latin-1").translate(self.alphabet)))).tobytes()

    def _stretch(self, stretch: str) -> bytes:
        # a text's first stretch may begin with what the library cuts off: 'stone is 's and tone
        if stretch[1:].isalpha() and (stretch[0] == " " or stretch[0].isalpha()):
            if stretch[0] == " " and stretch.isascii():
                return array("I", map(self.id, self.tokenize(self.space + stretch[1:]))).tobytes()
            return self._word(stretch)
        return b"".join([self.spaced[w[1:]] if w[0] == " " and w[1:].isalpha() else self.bare[w] for w in self.cut(stretch)])

    def __call__(self, text: str) -> bytes:
        if self.special(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = self.cuts(text) if self.uncut(text) else text.split(" ")
        return self._stretch(first) + b"".join(map(self.spaced.__getitem__, rest))


_ENCODERS: dict[tuple[str, int], Encoder] = KEPT.setdefault("token_output", {})


def encoder(vocabulary: str, memo: int = MEMO) -> Encoder:
    """One encoder for each worker process, so that its memos outlive a task; reading, or another operator's task, drops it."""
    if (vocabulary, memo) not in _ENCODERS:
        _ENCODERS[vocabulary, memo] = Encoder(vocabulary, memo)
    return _ENCODERS[vocabulary, memo]


def _connect(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path else "file://" + path)


def seek_table(frames: list[tuple[int, int, int, np.ndarray]]) -> bytes:
    """The seek frame and the footer. frames: compressed size, raw size, checksum, DOC records."""
    table = b"".join(struct.pack(FRAME, n, raw, check, len(docs)) for n, raw, check, docs in frames) + b"".join(docs.tobytes() for *_, docs in frames)
    body = struct.pack("<II", SKIPPABLE, len(table)) + table
    return body + struct.pack(FOOTER, SKIPPABLE, FOOTER_SIZE - 8, len(body), xxhash.xxh64_intdigest(table), len(frames), MAGIC, VERSION)


class Shard:
    """Reads one file: the table at once, frames when they are asked for."""

    def __init__(self, path: str) -> None:
        fs, name = _connect(path)
        self.file, self.path = fs.open_input_file(name), path
        end = self.file.size()
        self.file.seek(end - FOOTER_SIZE)
        _, _, size, digest, n, magic, version = struct.unpack(FOOTER, self.file.read(FOOTER_SIZE))
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError(f"{path}: not a token shard")
        self.file.seek(end - FOOTER_SIZE - size)
        table = self.file.read(size)[8:]
        if xxhash.xxh64_intdigest(table) != digest:
            raise ValueError(f"{path}: the seek table is damaged")
        self.frames, at = [], 0
        docs_at = n * FRAME_SIZE
        for i in range(n):
            packed, raw, check, docs = struct.unpack_from(FRAME, table, i * FRAME_SIZE)
            records = np.frombuffer(table, DOC, docs, docs_at)
            docs_at += docs * DOC.itemsize
            self.frames.append((at, packed, raw, check, records))
            at += packed

    def frame(self, i: int) -> np.ndarray:
        at, packed, raw, check, _ = self.frames[i]
        self.file.seek(at)
        z = self.file.read(packed)
        if xxhash.xxh64_intdigest(z) != check:
            raise ValueError(f"{self.path}: frame {i} is damaged")
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(z, max_output_size=raw), "<u4")

    def documents(self, wanted: Callable[[int | None], bool] = lambda _: True) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, ids) of the documents asked for, in order; frames without any aren't decompressed."""
        for i, (*_, records) in enumerate(self.frames):
            names = [None if r["null"] else int(r["id"]) for r in records]
            if not any(map(wanted, names)):
                continue
            ids, ends = self.frame(i), np.cumsum(records["n"])
            for name, end, n in zip(names, ends, records["n"], strict=True):
                if wanted(name):
                    yield name, ids[end - n : end]


def write_tokens(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int = 0, docs_per_frame: int = 128, level: int = 3, shards: int | None = None, memo: int = MEMO) -> DataFrame:
    """Writes the shard files and returns their manifest: shard (order), path, docs, tokens. The folder must be one that all executors share.
    memo: how many pieces' ids a worker keeps."""
    spark = docs.sparkSession
    folder, vocabulary = folder or fresh_path(spark, "tokens"), vocabulary or default_vocabulary()
    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(shards or partitions(spark), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    # ids beside nulls would reach pandas as doubles
    ordered = ordered.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        give_back("token_output")
        shard = TaskContext.get().partitionId()
        encode, packer = encoder(vocabulary, memo), zstandard.ZstdCompressor(level=level)
        fs, root = _connect(folder)
        fs.create_dir(root, recursive=True)
        final, own = f"{root}/shard-{shard:06d}.ids", f"{root}/.shard-{shard:06d}-{uuid.uuid4().hex}"
        end = struct.pack("<I", end_id)
        frames, n_docs, n_tokens, out = [], 0, 0, None
        for b in batches:
            for at in range(0, len(b), docs_per_frame):
                part = b.iloc[at : at + docs_per_frame]
                ids = [encode(x) + end for x in part["text"]]
                records = np.zeros(len(part), DOC)
                records["id"], records["null"], records["n"] = part["doc_id"].to_numpy(np.int64), part["no_id"].to_numpy(), [len(x) // 4 for x in ids]
                raw = b"".join(ids)
                z = packer.compress(raw)
                out = out or fs.open_output_stream(own)
                out.write(z)
                frames.append((len(z), len(raw), xxhash.xxh64_intdigest(z), records))
                n_docs, n_tokens = n_docs + len(part), n_tokens + len(raw) // 4
        if out is None:
            return
        out.write(seek_table(frames))
        out.close()
        fs.move(own, final)
        yield pd.DataFrame({"shard": [shard], "path": [f"{folder}/shard-{shard:06d}.ids"], "docs": [n_docs], "tokens": [n_tokens]})

    return stored(ordered.mapInPandas(write, "shard long, path string, docs long, tokens long"), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files. start counts over all shards.

    The manifest has a row for each file, so its running sum is small."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("before"))
    files = files.repartition(partitions(manifest.sparkSession), "path")

    columns = ("doc_id", "start", "n_tokens", "ids_crc32")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        for b in batches:
            for path, at in zip(b["path"], b["before"], strict=True):
                rows = []
                for name, ids in Shard(path).documents():
                    rows.append((name, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                    if len(rows) == ROWS:
                        yield frame(rows, columns, columns)
                        rows = []
                yield frame(rows, columns, columns)

    return files.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, **options: object) -> DataFrame:
    return read_tokens(write_tokens(docs, **options))

