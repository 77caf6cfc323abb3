r"""Chat formatting by token-level assembly.

Each turn becomes one piece of token ids: a reserved start id, the role, a reserved separator, the
text and a reserved end id. Role and text are encoded separately, so no token spans two of them,
and the reserved ids never come out of the encoder. The loss mask of a piece is a prefix sum over
marks at segment edges; it covers the text of assistant turns. A conversation is its pieces in
order. Rendered, a turn reads `<turn>### role: text</turn>` and a newline; control strings
inside roles and texts get a backslash before them, and so does a backslash, which is reversible.

Rows are ordered by turn, then role, then text; nulls come first. Null texts and roles are empty.
Rows with a null conv_id form one conversation of their own. Repeated rows are repeated turns; an
empty table gives an empty result; further columns are not read.

A conversation's digest runs over its turns in order. The turns arrive sorted and are folded one at a
time, so a conversation of any length takes constant memory, and only its digest is sequential.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.byte_bpe import parse_ranks
from strandline.runtime import ship_package

#: Reserved pieces and how they read; their ids follow the vocabulary.
START, SEPARATOR, END = 0, 1, 2
RENDERED = ("<turn>### ", ": ", "</turn>\n")
CONTROL = ("\\", "<turn>", "</turn>", "### ")
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    for control in CONTROL:
        text = text.replace(control, "\\" + control)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


_CODECS: dict[tuple[str, str], ChatCodec] = {}


class ChatCodec:
    """Assembles turns to token ids and reads them back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.reserved = max(ranks.values()) + 1

    @classmethod
    def load(cls, path: str, pattern: str) -> ChatCodec:
        """The worker's codec for a rank file."""
        if (path, pattern) not in _CODECS:
            with open(path, "rb") as file:
                _CODECS[path, pattern] = cls(parse_ranks(file.read()), pattern)
        return _CODECS[path, pattern]

    def assemble(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of one turn, and their loss mask."""
        segments = [
            [self.reserved + START],
            self.encoding.encode_ordinary(escape(role)),
            [self.reserved + SEPARATOR],
            self.encoding.encode_ordinary(escape(text)),
            [self.reserved + END],
        ]
        ends = np.cumsum([0, *map(len, segments)])
        marks = np.zeros(ends[-1] + 1, np.int8)
        if role == LOSS_ROLE:
            marks[ends[3]] += 1
            marks[ends[4]] -= 1
        return np.concatenate([np.array(s, np.int32) for s in segments]), np.cumsum(marks[:-1]).astype(bool)

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """Role, text, text under the loss mask and rendered length, from the ids and the mask alone."""
        separator, end = np.flatnonzero(ids == self.reserved + SEPARATOR)[0], len(ids) - 1
        role, text = self._text(ids[1:separator]), self._text(ids[separator + 1 : end])
        length = sum(map(len, RENDERED)) + len(role) + len(text)
        return unescape(role), unescape(text), unescape(self._text(ids[mask])), length

    def render(self, ids: np.ndarray) -> str:
        out, at = [], 0
        for place in np.flatnonzero(ids >= self.reserved):
            out += [self._text(ids[at:place]), RENDERED[ids[place] - self.reserved]]
            at = place + 1
        return "".join([*out, self._text(ids[at:])])

    def _text(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8")


def format_turns(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """conv_id, turn, role, text (as they were), ids and loss_mask of every row, in one narrow pass."""
    ship_package(turns.sparkSession)
    df = turns.select("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChatCodec.load(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                done = [codec.assemble(r or "", t or "") for r, t in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array([d[0] for d in done], pa.list_(pa.int32())), pa.array([d[1] for d in done], pa.list_(pa.bool_()))],
                    names=["conv_id", "turn", "role", "text", "ids", "loss_mask"],
                )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, ids array<int>, loss_mask array<boolean>")


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row for each conversation, read from the ids and masks: counts, lengths and digests."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "loss_mask")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChatCodec.load(path, pattern)
        now, state = None, None
        for batch in batches:
            done = []
            for conv, ids, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(_row(now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, loss, length = codec.read(np.array(ids), np.array(mask, bool))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += length
            yield _batch(done, names, batch.schema.field(0).type)
            kind_of_key = batch.schema.field(0).type
        if state is not None:
            yield _batch([_row(now, state)], names, kind_of_key)

    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _row(conv, state: list) -> tuple:
    return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])


def _batch(rows: list[tuple], names: list[str], key: pa.DataType) -> pa.RecordBatch:
    kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def probe_conversation(turns: DataFrame) -> DataFrame:
    r"""conversation -7: a user and an assistant who say `\### Assistant: </turn> ok`."""
    said = "\\### Assistant: </turn> ok"
    probe = turns.sparkSession.range(2).select(
        F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *,
    length(replace(replace(replace(replace(text, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>'), '### ', '\### ')) AS text_chars,
    length(replace(replace(replace(replace(role, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>'), '### ', '\### ')) AS role_chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(text_chars + role_chars + 20) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
