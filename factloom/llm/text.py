"""Helpers shared by the text operators: words, Arrow passes over documents, 64-bit hashing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Texts may be long, so a batch holds few rows: memory is bounded by this many texts, not by a partition.
BATCH_ROWS = 256


def small_batches(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def per_document(
    docs: DataFrame,
    fn: Callable[[list[str]], Sequence],
    fields: str,
    carry: Sequence[str],
    text: str = "text",
) -> DataFrame:
    """One Arrow pass: ``fn`` turns the texts of a batch (null read as empty) into ``fields``.

    The carried columns come back untouched in one struct ``row``, so no name can clash.
    """
    small_batches(docs)
    row = F.struct(*[docs[c].alias(c) for c in carry])
    source = docs.select(row.alias("row"), docs[text].alias("text"))
    made = T.StructType.fromDDL(fields)
    schema = T.StructType([T.StructField("row", source.schema["row"].dataType), *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = fn([t or "" for t in batch.column(1).to_pylist()])
                arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["row", *made.names])

    return source.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RNG = np.random.default_rng(20240607)
MULTIPLIERS = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
_LOWER_VALUES = _BYTE_VALUES[LOWER_BYTES]
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of one text, A-Z lower-cased, in order of appearance."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SEPARATOR[raw]
    turn = np.diff(inside)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    power, inverse = powers(len(raw))
    prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_LOWER_VALUES[raw] * power[: len(raw)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def shingle_hashes(data: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of one text.

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    words = word_hashes(data)
    n = len(words)
    if n == 0:
        return words
    if n < size:
        total = np.sum(words * MULTIPLIERS[:n], dtype=np.uint64, keepdims=True)
        return mix(total + MULTIPLIERS[200 + n : 201 + n])
    total = words[: n - size + 1] * MULTIPLIERS[0]
    for k in range(1, size):
        total = total + words[k : n - size + 1 + k] * MULTIPLIERS[k]
    return np.unique(mix(total))
