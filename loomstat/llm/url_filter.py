"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed, bit after bit, into Shift-And masks of as many 64-bit words as they need; one pass over the
bytes of a canonical URL simulates every rule at once. URLs of a batch advance together, a column of bytes at a time.

Canonical form: a dot, the host, a separator outside the byte alphabet, the path. `*` stands for any run of bytes within
the host or within the path, `?` for one byte.

Defined results: a null URL or one without `://` has an empty host and path; ties between rules of one length go to the
first; an empty rule list leaves each URL to the default verdict. Columns besides the id and the URL aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

SEPARATOR, PADDING = 256, 257
CELLS = 1 << 21  # bytes of URLs that advance together


@dataclass(frozen=True)
class Rule:
    """A host suffix with a path prefix, or with globs given, a free pattern."""

    verdict: str
    host: str = ""
    path: str = ""
    host_glob: str | None = None

    @property
    def name(self) -> str | None:
        return None if self.host_glob is not None else self.host + self.path

    @property
    def globs(self) -> tuple[str, str]:
        if self.host_glob is not None:
            return self.host_glob, "*"
        plain = "".join("\\" + c if c in "*?\\" else c for c in self.path)
        return f"*.{self.host}", plain + "*"


#: Fixed values of the production rules.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
#: Host labels that begin like these are blocked where no rule fits.
SUSPECT = ("spam-", "cheap-", "casino-", "adult-", "ads-", "free-")
SUSPECT_RULES = tuple(Rule("block", host_glob=f"*.{label}*") for label in SUSPECT)


def _symbols(glob: str) -> list[int | str]:
    out: list[int | str] = []
    chars = iter(glob)
    for c in chars:
        if c == "\\":
            out += next(chars, "\\").encode()
        elif c in "*?":
            if not (c == "*" and out and out[-1] == "*"):
                out.append(c)
        else:
            out += c.encode()
    return out


class Automaton:
    """Extended Shift-And over many globs: enter[w, c] has the bits whose position accepts c, stay[w, c] those that loop on c."""

    def __init__(self, globs: Sequence[tuple[str, str]]) -> None:
        bits: list[tuple[int | str | None, bool]] = []  # accepted symbol (None: the start), loops
        self.accept: list[int] = []
        for host, path in globs:
            bits.append((None, False))
            for s in [*_symbols(host), SEPARATOR, *_symbols(path)]:
                if s == "*":
                    bits[-1] = (bits[-1][0], True)
                else:
                    bits.append((s, False))
            self.accept.append(len(bits) - 1)
        n = max(1, -(-len(bits) // 64))
        self.start = np.zeros(n, np.uint64)
        self.enter = np.zeros((n, 258), np.uint64)
        self.stay = np.zeros((n, 258), np.uint64)
        self.stay[:, PADDING] = ~np.uint64(0)
        for i, (symbol, loops) in enumerate(bits):
            w, bit = i // 64, np.uint64(1) << np.uint64(i % 64)
            if symbol is None:
                self.start[w] |= bit
            elif symbol == "?":
                self.enter[w, :256] |= bit
            else:
                self.enter[w, symbol] |= bit
            if loops:
                self.stay[w, :256] |= bit

    def matches(self, texts: list[np.ndarray]) -> np.ndarray:
        """Boolean matrix, texts by globs. texts: arrays of symbols."""
        out = np.zeros((len(texts), len(self.accept)), bool)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(texts[order[end]]) <= CELLS:
                end += 1
            group = order[at:end]
            out[group] = self._run([texts[i] for i in group])
            at = end
        return out

    def _run(self, texts: list[np.ndarray]) -> np.ndarray:
        cells = np.full((max(map(len, texts), default=0), len(texts)), PADDING, np.uint16)
        for j, t in enumerate(texts):
            cells[: len(t), j] = t
        state = np.repeat(self.start[:, None], len(texts), axis=1)
        one, top = np.uint64(1), np.uint64(63)
        for row in cells:
            moved = state << one
            moved[1:] |= state[:-1] >> top
            state = (moved & self.enter[:, row]) | (state & self.stay[:, row])
        return np.stack([(state[i // 64] >> np.uint64(i % 64)) & one for i in self.accept], axis=1).astype(bool) if self.accept else np.zeros((len(texts), 0), bool)


def filter_urls(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules: Sequence[Rule] = RULES, fallback: Sequence[Rule] = SUSPECT_RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row. fallback: judged where no rule fits; their name isn't given as rule."""
    url = F.coalesce(F.col(url_column), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url_column}`, instr(`{url_column}`, '://') + 3)")).otherwise("")
    parts = pages.select(F.col(id_column).alias("page_id"), rest.alias("rest"))
    raw = F.regexp_extract("rest", "^[^/?#]*", 0)
    parts = parts.select("page_id", ascii_lower(raw).alias("host"), F.regexp_extract(F.expr("substring(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1)"), "^[^?#]*", 0).alias("path"))
    ordered = [*sorted(rules, key=lambda r: -len(r.host + r.path)), *fallback]
    globs, names, verdicts = [r.globs for r in ordered], [r.name for r in ordered], [r.verdict for r in ordered]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(globs)
        for b in batches:
            texts = [np.array([46, *h.encode(), SEPARATOR, *p.encode()], np.uint16) for h, p in zip(b["host"], b["path"], strict=True)]
            hits = automaton.matches(texts)
            first = np.where(hits.any(axis=1), hits.argmax(axis=1), -1) if hits.shape[1] else np.full(len(b), -1)
            yield b.assign(rule=[names[i] if i >= 0 else None for i in first], verdict=[verdicts[i] if i >= 0 else default for i in first])

    kind = dict(parts.dtypes)["page_id"]
    return parts.mapInPandas(judge, f"page_id {kind}, host string, path string, rule string, verdict string")


ORACLE = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
named AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
judged AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM named)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN ('.' || host) LIKE '%.spam-%' OR ('.' || host) LIKE '%.cheap-%' OR ('.' || host) LIKE '%.casino-%' OR ('.' || host) LIKE '%.adult-%'
    OR ('.' || host) LIKE '%.ads-%' OR ('.' || host) LIKE '%.free-%' THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
