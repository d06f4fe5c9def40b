"""Repeated-passage removal by run-length BWT indexes.

Every `length`-byte string of a document that also starts in a document with a smaller id is removed, wherever the two stand. Equal strings hold
the same `gram`-byte minimizer at the same place, so all windows with one minimizer occurrence form a segment, and segments
that could match share their minimizer's hash.

Steps: (1) A census over chunks of documents finds the minimizers that occur in two rows or more. (2) Chunks send the segments around those
to the minimizers' buckets, one of each content with its smallest document; a content seen again in its chunk is settled there.
(3) A bucket settles equal segments at once; where a minimizer has different segments it indexes them: a run-compressed Burrows-Wheeler
transform with suffix-array samples at run ends, and for each class of suffixes that agree in `length` bytes its smallest document. The segments
then stream through the index from right to left as matching statistics; a window whose match has `length` bytes and whose class
has a smaller document is marked. (4) Chunks read their answers and merge marked windows into removed runs.

Defined results: null texts count as empty; shorter texts lose nothing; a null doc_id counts as larger than all ids, and null ids as
equal; rows with equal doc_id don't remove from each other. Columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from .chunks import CENSUS, Chunk, answered, answers, bucket_count, by_bucket, census_rows, dealt, frame, looked_up, per_chunk, repeated_keys, squeeze

LENGTH, GRAM, LARGEST, NULL_ID = 50, 28, 1_000_000, 2**63 - 1
GATHERED = 1 << 18  # bytes of strings of different minimizers in one index: small tables are searched faster
BATCH = 1 << 16  # bytes hashed together: arrays of 8 times that stay in a core's cache
_B = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_B, n, 2**64))


_SINGLE = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


def rolling(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size the hash of every run of so many bytes. Doubling joins halves, so all sizes together cost log2 of the largest in steps."""
    outs: list[tuple[np.ndarray | None, int]] = [(None, 0) for _ in sizes]
    power, span = _SINGLE[data], 1
    while True:
        for i, size in enumerate(sizes):
            if size & span:
                out, have = outs[i]
                n = len(data) - have - span + 1
                outs[i] = (power[:n].copy() if out is None else out[:n] * _power(span) + power[have : have + n], have + span)
        if span * 2 > max(sizes):
            break
        n = len(power) - span
        power = power[:n] * _power(span) + power[span : span + n]
        span *= 2
    for out, _ in outs:
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return [out for out, _ in outs]


OFFSET = 6  # bits of a hash that give way to a place within its window


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of width hashes the place of its leftmost smallest one, by the hashes' upper bits."""
    if width > 1 << OFFSET:
        raise ValueError(f"a window holds {1 << OFFSET} hashes at most")
    value, span, parts, have = hashes >> np.uint64(OFFSET) << np.uint64(OFFSET), 1, [], 0
    while True:
        if width & span:
            parts.append((have, value))
            have += span
        if span * 2 > width:
            break
        value = np.minimum(value[: len(value) - span], value[span:] + np.uint64(span))
        span *= 2
    n = len(hashes) - width + 1
    best = parts[0][1][:n]
    for at, v in parts[1:]:
        best = np.minimum(best, v[at : at + n] + np.uint64(at))
    return np.arange(n) + (best & np.uint64((1 << OFFSET) - 1)).astype(np.int64)


class Segments:
    """The segments of many texts: start, number of windows, minimizer hash, text, and content hash where it is asked for.

    data, sizes: the texts' bytes one after another."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, length: int, gram: int, contents: bool = True) -> None:
        self.data, ends = data, np.cumsum(sizes)
        self.begins, self.length = ends - sizes, length
        parts, first = [], 0
        # texts in stretches of about BATCH bytes: the hashes of a stretch take many times its size
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(ends, self.begins[first] + BATCH, side="right")))
            parts.append(self._stretch(first, last, sizes[first:last], length, gram, contents))
            first = last
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
        self.start, self.windows, self.text, self.anchor, self.content = (np.concatenate([np.zeros(0, k), *(p[i] for p in parts)]) for i, k in enumerate(kinds))

    def _stretch(self, first: int, last: int, sizes: np.ndarray, length: int, gram: int, contents: bool) -> tuple[np.ndarray, ...]:
        begin = self.begins[first]
        data, ends = self.data[begin : begin + sizes.sum()], np.cumsum(sizes)
        if len(data) < length:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
        grams, *wide = rolling(data, gram, length) if contents else rolling(data, gram)
        place = minimizers(grams, length - gram + 1)
        of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[: len(place)]
        valid = np.arange(len(place)) + length <= ends[of]
        new = valid.copy()
        new[1:] &= (place[1:] != place[:-1]) | (of[1:] != of[:-1]) | ~valid[:-1]
        start, number = np.flatnonzero(new), np.cumsum(new)
        windows = np.bincount(number[valid], minlength=len(start) + 1)[1:]
        content = np.zeros(0, np.uint64)
        if contents:
            content = (wide[0][start] * np.uint64(_B) + wide[0][start + windows - 1]) * np.uint64(_B) + windows.astype(np.uint64)
        return start + begin, windows, of[start].astype(np.int64) + first, grams[place[start]], content

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.windows[i] + self.length - 1].tobytes()


class RunIndex:
    """Run-length BWT of strings with samples at run ends and the smallest document of each class of long matches."""

    def __init__(self, strings: list[bytes], docs: np.ndarray, length: int) -> None:
        sizes = np.array([len(s) + 1 for s in strings], np.int64)
        flat = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        ends = np.cumsum(sizes)
        flat[ends - 1] = 0
        self.text, self.length, n = flat, length, len(flat)
        # the first rank looks at up to 7 symbols at once, as 9 bits hold one
        span = min(7, length)
        rank = np.zeros(n, np.int64)
        for k in range(span):
            rank = rank << 9
            rank[: n - k] |= flat[k:] + 1 if k else flat + 1
        half, short, later = span, None, None
        while True:
            order = np.argsort(rank)
            placed = rank[order]
            changed = np.concatenate([[0], placed[1:] != placed[:-1]]).cumsum()
            rank = np.empty(n, np.int64)
            rank[order] = changed
            if span <= length:
                half, short = span, rank
            if changed[-1] == n - 1 or span > 2 * n:
                break
            later = np.zeros(n, np.int64)
            later[: max(0, n - span)] = rank[span:] + 1
            rank = rank * (n + 1) + later
            span *= 2
        suffixes = order
        # suffixes that agree in length symbols: two overlapping stretches of `half` agree
        first = short[suffixes]
        second = short[np.minimum(suffixes + length - half, n - 1)]
        same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        class_start = np.flatnonzero(np.concatenate([[True], ~same]))
        class_least = np.minimum.reduceat(np.repeat(docs, sizes)[suffixes], class_start)
        self.least = np.repeat(class_least, np.diff(class_start, append=n))  # of each row's class
        bwt = flat[suffixes - 1]
        starts = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.starts, self.symbols, self.runs = starts, bwt[starts], np.diff(np.concatenate([starts, [n]]))
        self.first, self.last = suffixes[starts], suffixes[starts + self.runs - 1]
        by_symbol = np.lexsort((starts, self.symbols))
        self.stride = n + 1
        self.keys = self.symbols[by_symbol] * self.stride + starts[by_symbol]
        self.by_symbol, lengths = by_symbol, self.runs[by_symbol]
        self.before = np.cumsum(lengths) - lengths  # rows of smaller symbols and earlier runs: the LF image of each run's start

    def _run(self, c: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Place in symbol order of the last run of c that starts at row or before; may be of another symbol."""
        return np.searchsorted(self.keys, c * self.stride + row, side="right") - 1

    def stream(self, patterns: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Matching statistics from right to left: (column, match length, smallest document of the match's class).

        patterns: rows of symbols, 0 where a row hasn't begun."""
        m = len(patterns)
        row, at, size = np.zeros(m, np.int64), np.full(m, self.first[0]), np.zeros(m, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, j]
            k = self._run(c, row)
            own = np.maximum(k, 0)
            inside = (k >= 0) & (self.symbols[self.by_symbol[own]] == c) & (row < self.starts[self.by_symbol[own]] + self.runs[self.by_symbol[own]])
            bad = np.flatnonzero(~inside & (c > 0))
            if len(bad):
                # the nearest runs of the symbol before and after; their ends' samples tell which agrees longer
                cb, kb = c[bad], k[bad]
                up, down = np.maximum(kb, 0), np.minimum(kb + 1, len(self.keys) - 1)
                up_ok, down_ok = (kb >= 0) & (self.symbols[self.by_symbol[up]] == cb), self.symbols[self.by_symbol[down]] == cb
                up_at, down_at = self.last[self.by_symbol[up]], self.first[self.by_symbol[down]]
                up_len = np.where(up_ok, self._agree(at[bad], up_at, size[bad]), -1)
                down_len = np.where(down_ok, self._agree(at[bad], down_at, size[bad]), -1)
                take_up = up_len >= down_len
                pick = np.where(take_up, up, down)
                run = self.by_symbol[pick]
                row[bad] = np.where(take_up, self.starts[run] + self.runs[run] - 1, self.starts[run])
                at[bad] = np.where(take_up, up_at, down_at)
                size[bad] = np.maximum(np.maximum(up_len, down_len), 0)
                own[bad] = pick
                lost = bad[~up_ok & ~down_ok]
            else:
                lost = bad
            step = c > 0
            run = self.by_symbol[own]
            row = np.where(step, self.before[own] + row - self.starts[run], row)
            at, size = np.where(step, at - 1, at), np.where(step, size + 1, 0)
            if len(lost):
                row[lost], at[lost], size[lost] = 0, self.first[0], 0
            yield j, size, self.least[row]

    def _agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Symbols in which the text agrees from a and from b on, up to most."""
        out, n = np.zeros(len(a), np.int64), len(self.text)
        live = np.flatnonzero(most > 0)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            ok = (x < n) & (y < n)
            ok &= self.text[np.minimum(x, n - 1)] == self.text[np.minimum(y, n - 1)]
            out[live[ok]] += 1
            live = live[ok & (out[live] < most[live])]
        return out


def _later(index: RunIndex, strings: list[bytes], docs: np.ndarray, length: int) -> np.ndarray:
    """For each string, bit o set where its window o is in an indexed string of a smaller document."""
    widest = max(map(len, strings))
    patterns = np.zeros((len(strings), widest), np.int64)
    for i, s in enumerate(strings):
        patterns[i, widest - len(s) :] = np.frombuffer(s, np.uint8).astype(np.int64) + 1
    lead = widest - np.array([len(s) for s in strings])
    masks = np.zeros(len(strings), np.uint64)
    for j, size, least in index.stream(patterns):
        hit = (size >= length) & (least < docs) & (j >= lead)
        masks[hit] |= np.uint64(1) << (j - lead[hit]).astype(np.uint64)
    return masks


def _blocks(strings: list[bytes], most: int) -> Iterator[slice]:
    first, held = 0, 0
    for i, s in enumerate(strings):
        held += len(s)
        if held > most:
            yield slice(first, i + 1)
            first, held = i + 1, 0
    if first < len(strings):
        yield slice(first, len(strings))


def _matches(strings: list[bytes], docs: np.ndarray, length: int, most: int = LARGEST) -> np.ndarray:
    """_later of all strings against all of them. Indexes of bounded size: the strings of a larger lot stream through one after another."""
    masks, blocks = np.zeros(len(strings), np.uint64), list(_blocks(strings, most))
    for own in blocks:
        index = RunIndex(strings[own], docs[own], length)
        for part in blocks:
            masks[part] |= _later(index, strings[part], docs[part], length)
    return masks


SEGMENTS = "chunk long, bucket int, anchors binary, contents binary, docs binary, sizes binary, bytes binary"
MARKS = "chunk long, contents binary, masks binary"
ALL = np.uint64(2**64 - 1)


def _settle(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        read = lambda c, kind: [np.frombuffer(x, kind) for x in pdf[c]]
        anchors, contents, docs, sizes = read("anchors", "<u8"), read("contents", "<u8"), read("docs", "<i8"), read("sizes", "<u2")
        counts = [len(c) for c in contents]
        anchor, content, doc, size = np.concatenate(anchors), np.concatenate(contents), np.concatenate(docs), np.concatenate(sizes).astype(np.int64)
        unpack = zstandard.ZstdDecompressor()
        blob = b"".join([unpack.decompress(x) for x in pdf["bytes"]])
        ends = np.cumsum(size)
        string = lambda i: blob[ends[i] - size[i] : ends[i]]
        order = np.lexsort((doc, content))
        first = np.flatnonzero(np.concatenate([[True], content[order][1:] != content[order][:-1]]))
        head = order[first]  # of each content, where its smallest document stands
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(order)]])))
        for i in np.flatnonzero(head[group] != np.arange(len(order))).tolist():
            if string(i) != string(head[group[i]]):
                raise ValueError("two segments share a 64-bit content hash: choose another hash base")
        masks = np.zeros(len(head), np.uint64)
        # minimizers with different contents; each batch holds whole groups of one minimizer
        by_anchor = np.argsort(anchor[head], kind="stable")
        a = anchor[head][by_anchor]
        cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        batch, held = [], 0

        def index() -> None:
            which = np.concatenate(batch)
            masks[which] = _matches([string(x) for x in head[which]], doc[head[which]], length)

        for lo, hi in zip(cuts, [*cuts[1:], len(a)], strict=True):
            if hi - lo > 1:
                more = int(size[head[by_anchor[lo:hi]]].sum())
                if batch and held + more > GATHERED:
                    index()
                    batch, held = [], 0
                batch.append(by_anchor[lo:hi])
                held += more
        if batch:
            index()
        answer = np.where(doc > doc[head][group], ALL, masks[group])
        out, at = [], 0
        for chunk, n in zip(pdf["chunk"], counts, strict=True):
            mine = slice(at, at + n)
            marked = answer[mine] != 0
            if marked.any():
                out.append((chunk, content[mine][marked].tobytes(), answer[mine][marked].tobytes()))
            at += n
        return pd.DataFrame(out, columns=["chunk", "contents", "masks"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (array of start, end) for each row."""
    chunks = dealt(docs, mb=12)
    buckets = bucket_count(docs, mb=12)

    def ids_of(chunk: Chunk) -> np.ndarray:
        return np.array([NULL_ID if i is None else i for i in chunk.ids], np.int64)

    def census(number: int, chunk: Chunk) -> pd.DataFrame:
        s = Segments(chunk.data, chunk.sizes, length, gram, contents=False)
        keys = squeeze(s.anchor, buckets)
        order = np.lexsort((s.text, keys))
        k, t = keys[order], s.text[order]
        once = np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])]) if len(k) else np.zeros(0, bool)
        return census_rows(number, *np.unique(k[once], return_counts=True))

    repeated = repeated_keys(per_chunk(chunks, census, CENSUS))

    def send(number: int, chunk: Chunk, reply: pd.DataFrame) -> pd.DataFrame:
        columns = ["chunk", "bucket", "anchors", "contents", "docs", "sizes", "bytes"]
        if not len(reply):
            return pd.DataFrame(columns=columns)
        s, ids, packer = Segments(chunk.data, chunk.sizes, length, gram), ids_of(chunk), zstandard.ZstdCompressor(level=1)
        keys = squeeze(s.anchor, buckets)
        shared = np.flatnonzero(looked_up(keys, *answers(reply), 0) > 1)
        # of each content the smallest document
        order = shared[np.lexsort((ids[s.text[shared]], s.content[shared]))]
        c = s.content[order]
        order = order[np.concatenate([[True], c[1:] != c[:-1]])] if len(c) else order
        order = order[np.lexsort((s.anchor[order], keys[order]))]
        out = []
        for bucket, part in by_bucket(keys[order]):
            at = order[part]
            sizes = s.windows[at] + length - 1
            out.append((number, bucket, s.anchor[at].tobytes(), s.content[at].tobytes(), ids[s.text[at]].tobytes(), sizes.astype("<u2").tobytes(), packer.compress(b"".join([s.bytes_of(i) for i in at]))))
        return pd.DataFrame(out, columns=columns)

    sent = answered(chunks, repeated, send, SEGMENTS)
    marks = sent.groupBy("bucket").applyInPandas(_settle(length), MARKS)

    def cut(_: int, chunk: Chunk, reply: pd.DataFrame) -> pd.DataFrame:
        s, ids = Segments(chunk.data, chunk.sizes, length, gram), ids_of(chunk)
        content, mask = (np.frombuffer(b"".join(reply[c]), "<u8") for c in ("contents", "masks"))
        order = np.argsort(content, kind="stable")
        content, mask = content[order], mask[order]
        delta = np.zeros(len(chunk.data) + 1, np.int32)
        if len(s.start):
            mine = ids[s.text]
            seen, group = np.unique(s.content, return_inverse=True)
            tops = np.full(len(seen), NULL_ID, np.int64)
            np.minimum.at(tops, group, mine)
            answer = np.zeros(len(s.start), np.uint64)
            if len(content):
                at = np.minimum(np.searchsorted(content, s.content), len(content) - 1)
                answer = np.where(content[at] == s.content, mask[at], answer)
            answer = np.where(mine > tops[group], ALL, answer)
            hit = np.flatnonzero(answer != 0)
            for o in range(length - gram + 1):
                on = hit[(o < s.windows[hit]) & ((answer[hit] >> np.uint64(o)) & np.uint64(1) == 1)]
                np.add.at(delta, s.start[on] + o, 1)
                np.add.at(delta, s.start[on] + o + length, -1)
        removed = np.cumsum(delta[:-1]) > 0
        out, ends = [], np.cumsum(chunk.sizes)
        for doc_id, begin, end in zip(chunk.ids, (ends - chunk.sizes).tolist(), ends.tolist(), strict=True):
            r, text = removed[begin:end], chunk.data[begin:end]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], r.view(np.int8), [0]])))
            spans = [{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)]
            kept = (text[~r] if spans else text).tobytes()
            out.append((doc_id, len(text), int(r.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans))
        return frame(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"], ("doc_id", "n_bytes", "n_removed", "n_spans"))

    return answered(chunks, marks, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")
