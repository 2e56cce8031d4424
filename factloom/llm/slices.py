"""Arrow texts as bytes: slices of bounded size, runs of wanted bytes, and their dictionaries.

Arrow batches are bounded in bytes by ``spark.sql.execution.arrow.maxBytesPerBatch``; a slice holds
about ``SLICE_BYTES`` of text, or one text if that is longer, so that is what a task has in work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 * 2**20


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the offsets of each; a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with the bytes and offsets of their texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, offsets = text_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
            last = max(last, first + 1)
            begin, end = offsets[first], offsets[last]
            yield batch.slice(first, last - first), raw[begin:end], offsets[first : last + 1] - begin
            first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of ``inside`` that lie in one text."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets] = True
    outside = ~inside
    before = np.append(True, outside[:-1])[: len(inside)]
    after = np.append(outside[1:], True)[: len(inside)]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def dictionary(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes and distinct values of the byte strings that ``data`` holds one after the other."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    coded = pa.Array.from_buffers(pa.large_binary(), len(lengths), buffers).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary
