r"""Chat formatting by columnar byte assembly.

Template: a turn is ``### <role>: `` + text + `` </turn>`` + newline. Backslashes in roles and texts
become ``\\``, and the opening characters of control strings are broken by a backslash (``###``
becomes ``\###``, ``</turn>`` becomes ``\</turn>``), so no text can forge a turn and
unescaping gives the text back exactly. Roles escape the colon and the newline too.

Segment lengths, cumulative offsets and scatter indices of a whole Arrow batch are computed in
numpy and headers and contents land in one preallocated buffer. Rows of a conversation are
shuffled together and sorted inside the partition; a conversation is written in pieces of at
most ``PIECE`` rows, so even one that holds a third of all rows is streamed and never gathered.

Defined results: null texts and null roles are empty; rows of a null conversation id form one
conversation; equal turn numbers are ordered by role, then text; repeated rows are all kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = b"### ", b": ", b" </turn>\n"
TRAINED_ROLE = "assistant"
# Rows of one Arrow batch and so of one output piece.
PIECE = 4096

_TEXT = re.compile(r"\\|###|</turn>")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_ROLE = re.compile(r"[\\:\n<#]")


def escape_text(text: str) -> str:
    return _TEXT.sub(lambda m: "\\" + m[0], text) if "\\" in text or "###" in text or "</turn>" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\\" + m[0], role)


def copy_segments(out: np.ndarray, at: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """Scatter the segments ``data[starts : starts + lengths]`` to the offsets ``at`` of ``out``."""
    total = int(lengths.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(at, lengths) + inside] = data[np.repeat(starts, lengths) + inside]


def _bytes_of(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = pa.array(strings, type=pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[: len(strings) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def assemble(roles: list[str], texts: list[str]) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer; byte offset of each turn, and the code points before and in its content."""
    roles, texts = [escape_role(r) for r in roles], [escape_text(t) for t in texts]
    role_data, role_at, role_len = _bytes_of(roles)
    text_data, text_at, text_len = _bytes_of(texts)
    lengths = np.stack([
        np.full(len(roles), len(OPEN)), role_len, np.full(len(roles), len(MIDDLE)), text_len,
        np.full(len(roles), len(CLOSE)),
    ], axis=1)
    offsets = np.concatenate([[0], np.cumsum(lengths.ravel())])
    places = offsets[:-1].reshape(lengths.shape)
    buffer = pa.allocate_buffer(int(offsets[-1]))
    out = np.frombuffer(buffer, dtype=np.uint8)
    for column, constant in ((0, OPEN), (2, MIDDLE), (4, CLOSE)):
        out[places[:, column, None] + np.arange(len(constant))] = np.frombuffer(constant, dtype=np.uint8)
    copy_segments(out, places[:, 1], role_data, role_at, role_len)
    copy_segments(out, places[:, 3], text_data, text_at, text_len)
    content = np.array([len(t) for t in texts], dtype=np.int64)
    head = np.array([len(OPEN) + len(r) + len(MIDDLE) for r in roles], dtype=np.int64)
    return buffer, np.append(places[:, 0], offsets[-1]), head, content


def format_chats(rows: DataFrame) -> DataFrame:
    """``conv_id, piece, formatted, loss`` from ``conv_id, turn, role, text``.

    ``loss`` lists the trained spans of the piece as code points ``[start, end)``: the assistant
    texts in their escaped form.
    """
    session = rows.sparkSession
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PIECE))
    clean = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    )
    ordered = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, piece = object(), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, roles, texts = (batch.column(k).to_pylist() for k in (0, 2, 3))
            buffer, offsets, head, content = assemble(roles, texts)
            cuts = [0, *[i for i in range(1, n) if ids[i] != ids[i - 1]], n]
            bounds = pa.array(offsets[cuts], type=pa.int64())
            formatted = pa.LargeStringArray.from_buffers(len(cuts) - 1, bounds.buffers()[1], buffer).cast(pa.string())
            pieces, spans = [], []
            for a, b in zip(cuts, cuts[1:]):
                piece = piece + 1 if ids[a] == last else 0
                last = ids[a]
                pieces.append(piece)
                size = head[a:b] + content[a:b] + len(CLOSE)
                start = np.cumsum(size) - size + head[a:b]
                spans.append([
                    {"start": int(s), "end": int(s + c)}
                    for s, c, r in zip(start, content[a:b], roles[a:b]) if r == TRAINED_ROLE
                ])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[a] for a in cuts[:-1]], type=pa.int64()), pa.array(pieces, type=pa.int64()), formatted,
                    pa.array(spans, type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["conv_id", "piece", "formatted", "loss"],
            )

    return ordered.mapInArrow(run, "conv_id long, piece long, formatted string, loss array<struct<start:long,end:long>>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted piece, unescaped."""
    out, at = [], 0
    while at < len(formatted):
        colon = _find(formatted, ": ", at + len(OPEN))
        end = _find(formatted, " </turn>\n", colon + 2)
        out.append((unescape(formatted[at + len(OPEN) : colon]), unescape(formatted[colon + 2 : end])))
        at = end + len(CLOSE)
    return out


def _find(text: str, what: str, at: int) -> int:
    """The next ``what`` whose marker character is not escaped."""
    while True:
        at = text.index(what, at)
        mark = at + 1 if what[0] == " " else at
        back = mark
        while back > 0 and text[back - 1] == "\\":
            back -= 1
        if (mark - back) % 2 == 0:
            return at
        at += 1


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the output: turns and trained text, as counts and sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, started = None, False

        def close():
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

        def pack(done):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for batch in batches:
            done = []
            for conv, piece, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if piece == 0:
                    if started:
                        done.append(close())
                    state, started = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                for role, said in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    trained = unescape(text[span["start"] : span["end"]])
                    state[3] += len(trained)
                    state[4].update(trained.encode())
                state[5] += len(text)
            if done:
                yield pack(done)
        if started:
            yield pack([close()])

    return formatted.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


HARD_TEXT = "\\### Assistant: </turn> ok"


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"),
    )
    return digests(format_chats(rows.unionByName(extra)))
