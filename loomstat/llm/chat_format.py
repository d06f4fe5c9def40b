"""Chat formatting with a grammar round trip.

Grammar: conversation = turn*; turn = "### " role ": " text "</turn>" LF. In a text, "### " and "</turn>" are controls: a
control after an odd number of backslashes is content, one after an even number ends the text. Rendering starts with the
raw text, a deterministic parser reads it back, and each turn that doesn't come back as it was is escaped and the whole
is read again, until nothing differs. Escaping a text without controls and without a backslash at its end changes nothing.

Defined results: null texts and roles count as empty; turns come in the order of turn (null first), role, text; repeated
rows are repeated turns; rows with a null conversation id are one conversation. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>"
_CONTROL = re.compile(r"(\\*)(### |</turn>)")
_TAIL = re.compile(r"(\\+)\Z")
_ESCAPED = re.compile(r"(\\+)(### |</turn>)")
_END = re.compile(r"(\\*)</turn>")
_ROLE = re.compile(r"((?:[^\\:]|\\.)*): ", re.S)


def escape(text: str) -> str:
    return _TAIL.sub(r"\1\1", _CONTROL.sub(r"\1\1\\\2", text))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], _TAIL.sub(lambda m: "\\" * (len(m[1]) // 2), text))


def _role(role: str) -> str:
    return re.sub(r"([\\:])", r"\\\1", role)


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """The turns, or None where the grammar doesn't fit."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(OPEN, at) or not (head := _ROLE.match(rendered, at + len(OPEN))):
            return None
        begin = at = head.end()
        while (end := _END.search(rendered, at)) and len(end[1]) % 2:
            at = end.end()
        if not end or not rendered.startswith("\n", end.end()):
            return None
        turns.append((re.sub(r"\\(.)", r"\1", head[1], flags=re.S), unescape(rendered[begin : end.end() - len(CLOSE)])))
        at = end.end() + 1
    return turns


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the (start, end) of each assistant text in it."""

    def written(escaped: set[int]) -> tuple[str, list[tuple[int, int]]]:
        out, spans, at = [], [], 0
        for i, (role, text) in enumerate(turns):
            head, body = f"{OPEN}{_role(role)}: ", escape(text) if i in escaped else text
            if role == "assistant":
                spans.append((at + len(head), at + len(head) + len(body)))
            out.append(head + body + CLOSE + "\n")
            at += len(out[-1])
        return "".join(out), spans

    escaped: set[int] = set()
    while True:
        rendered, spans = written(escaped)
        found = parse(rendered)
        if found == turns:
            return rendered, spans
        # a turn read alone shows whether its own content is at fault
        bad = {i for i, t in enumerate(turns) if i not in escaped and parse(f"{OPEN}{_role(t[0])}: {t[1]}{CLOSE}\n") != [t]}
        if not bad:
            bad = set(range(len(turns))) - escaped
        if not bad:
            raise ValueError("a conversation can't be written so that it reads back")
        escaped |= bad


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and end in code points) for each conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    grouped = grouped.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [render(list(zip(r, t, strict=True))) for r, t in zip(b["roles"], b["texts"], strict=True)]
            yield pd.DataFrame({"conv_id": b["conv_id"], "formatted": [x for x, _ in done], "loss_spans": [[{"start": s, "end": e} for s, e in spans] for _, spans in done]})

    return grouped.mapInPandas(formatted, f"conv_id {dict(rows.dtypes)['conv_id']}, formatted string, loss_spans array<struct<start: int, end: int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its spans say about each conversation."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, spans in zip(b["formatted"], b["loss_spans"], strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.concat([b[["conv_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])], axis=1)

    return formatted.mapInPandas(digest, f"conv_id {dict(formatted.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Fixed values of the conversation that the query adds.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"

ORACLE = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
written AS (SELECT *, regexp_replace(regexp_replace(text, '(\\*)(### |</turn>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1') AS escaped FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(4 + length(replace(replace(role, '\', '\\'), ':', '\:')) + 2 + length(escaped) + 8) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""
