r"""Chat formatting by columnar byte assembly.

The template of a turn is ``### role: text</turn>`` and a line feed. Inside texts and roles a backslash stands
before every backslash and before every control string (``### `` and ``</turn>``; in roles also before the colon),
so what a text says can't end a turn or begin one, and undoing the escapes gives the text back exactly.

Per Arrow batch, numpy computes the segment lengths, their cumulative offsets and scatter indices, and headers,
contents and ends are copied into one preallocated buffer that becomes the Arrow string column as it is.

Rows are clustered by conversation with their turns in order. A conversation that reaches over batches has several
rows, numbered by ``part``, so one conversation of any length is streamed and never held whole.

Defined cases: null texts and roles are empty; a null conv_id is a conversation of its own; equal turns are ordered
by role and text; repeated rows are repeated turns; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens

#: The template's control strings.
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
LEARNED = "assistant"
FORMATTED = "conv_id long, part int, formatted string, loss_starts array<int>, loss_ends array<int>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:(?:\\.|<(?!/turn>))[^\\<]*)*)</turn>\n", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def escape(column: pa.Array) -> pa.Array:
    for plain in ("\\", "</turn>", OPEN):
        column = pc.replace_substring(column, plain, "\\" + plain)
    return column


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """out[at[i] : at[i] + lengths[i]] = data[starts[i] : starts[i] + lengths[i]] for all i at once."""
    ends = np.cumsum(lengths)
    k = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    out[np.repeat(at, lengths) + k] = data[np.repeat(starts, lengths) + k]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all turns, the n + 1 offsets of turns, and where each text begins and ends."""
    coded = roles.dictionary_encode()
    heads = [(OPEN + re.sub(r"([\\:])", r"\\\1", r) + AFTER_ROLE).encode() for r in coded.dictionary.to_pylist()]
    code = coded.indices.to_numpy(zero_copy_only=False)
    head_lengths = np.array([len(h) for h in heads], dtype=np.int64)
    head_starts = np.concatenate(([0], np.cumsum(head_lengths)))[:-1].astype(np.int64)
    body, offsets = tokens.text_buffers(escape(texts))
    end = np.frombuffer(CLOSE.encode(), dtype=np.uint8)
    lengths = np.stack([head_lengths[code], np.diff(offsets), np.full(len(code), len(end))], axis=1)
    at = np.concatenate(([0], np.cumsum(lengths.ravel())))
    out = np.empty(int(at[-1]), dtype=np.uint8)
    begins = at[:-1].reshape(-1, 3)
    _scatter(out, begins[:, 0], np.frombuffer(b"".join(heads), dtype=np.uint8), head_starts[code], lengths[:, 0])
    _scatter(out, begins[:, 1], body, offsets[:-1], lengths[:, 1])
    _scatter(out, begins[:, 2], end, np.zeros(len(code), dtype=np.int64), lengths[:, 2])
    return out, np.append(begins[:, 0], at[-1]), begins[:, 1], begins[:, 2]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = object(), 0
    for whole in batches:
        for a, b in tokens.chunks(whole.column(2)):
            batch = whole.slice(a, b - a)
            ids = batch.column(0)
            roles, texts = batch.column(1).fill_null(""), batch.column(2).fill_null("")
            out, turns, begins, ends = assemble(roles, texts)
            known = ids.fill_null(0).to_numpy(zero_copy_only=False)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate(([True], (known[1:] != known[:-1]) | (null[1:] != null[:-1]))))
            stop = np.append(first[1:], len(batch))
            learned = pc.equal(roles, LEARNED).to_numpy(zero_copy_only=False)
            marks = np.concatenate(([0], np.cumsum(learned)))
            offset = np.repeat(turns[first], stop - first)
            spans = np.concatenate(([0], marks[stop])).astype(np.int32)
            keys = [None if null[i] else int(known[i]) for i in first]
            parts = np.zeros(len(first), dtype=np.int32)
            parts[0] = part + 1 if keys[0] == last else 0
            last, part = keys[-1], int(parts[-1])
            formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(turns[first], turns[-1]).astype(np.int32)), pa.py_buffer(out))
            lists = [pa.ListArray.from_arrays(pa.array(spans), pa.array((x - offset)[learned].astype(np.int32))) for x in (begins, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, type=pa.int64()), pa.array(parts), formatted, *lists],
                names=["conv_id", "part", "formatted", "loss_starts", "loss_ends"],
            )


def format_chats(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, part, formatted, loss_starts, loss_ends), clustered by conversation.

    The spans are byte ranges of ``formatted`` under the loss mask: each assistant text, without header and end.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_format, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation; anything but whole turns is an error."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a turn at {at}: {formatted[at : at + 40]!r}")
    return turns


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    now, done = None, []

    def over() -> None:
        done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

    for batch in batches:
        for row in batch.to_pylist():
            if not row["part"]:
                if now:
                    over()
                now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(row["formatted"]):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
            raw = row["formatted"].encode()
            for a, b in zip(row["loss_starts"], row["loss_ends"]):
                text = unescape(raw[a:b].decode())
                now[3] += len(text)
                now[4].update(text.encode())
            now[5] += len(row["formatted"])
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, x)) for x in done], schema=kind)
            done = []
    if now:
        over()
        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, x)) for x in done], schema=kind)


def read_chats(formatted: DataFrame) -> DataFrame:
    """Digests of conversations read back from the formatted column, whose rows must be clustered as format_chats
    leaves them."""
    return formatted.mapInArrow(_read, DIGESTS)
