"""Spelling variants: words one edit apart, found by Gram products of letter-count blocks.

One edit moves a word's letter counts by a squared distance of 1 (a letter more or less) or 2 (another
letter), never further. Words are therefore cut into cells of one length and one rough letter count
(of classes of letters), and only a cell and those one move away are compared: blocks of the same
or the next length. A block holds at most about ``BLOCK_WORDS`` words; a product of two blocks' count
matrices gives all squared distances at once, and pairs at the wanted distance are verified letter by
letter. A cell of many words is dealt by hash into many blocks, so no task grows with the vocabulary, and
every pair of blocks is one row. All words are compared; nothing is capped.

Defined results: null and empty texts have no words; a null id counts as the text ''; equal words are
counted together, rows sharing an id one by one; a tie between forms goes to the smallest word; words
of any length take part; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.slices import dictionary, runs, slices, text_bytes
from factloom.session import pin

BLOCK_WORDS = 2048
BLOCK_BYTES = 4 * 2**20
# Candidates are verified so many letters at a time.
VERIFY_BYTES = 8 * 2**20
PAIRS_PER_TASK = 1000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Columns of the count matrices: a-z, then U+00C0 to U+00FF.
_COLUMN = np.zeros(256, dtype=np.int64)
_COLUMN[97:123] = np.arange(26)
_COLUMN[192:256] = 26 + np.arange(64)
COLUMNS = 90
_CRC_STEP = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], dtype=np.uint32)
SHORT = 64


def latin_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, one Latin-1 byte each; the runs'
    lengths and text numbers."""
    lead = raw == 0xC3
    tail = np.append(False, lead[:-1])[: len(raw)]
    inside = _LETTER[raw] | lead | tail
    starts, ends, text = runs(inside, offsets)
    kept = inside & ~lead
    upto = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(kept, out=upto[1:])
    letters = np.where(tail, raw + np.uint8(0x40), _LOWER[raw])[kept]
    return letters, upto[ends] - upto[starts], text


def shifted(crc: np.ndarray, most: int) -> np.ndarray:
    """For each checksum the terms that it adds to those of texts of 0 to ``most`` further bytes.

    The checksum is linear: ``crc32(a + b) = shifted(crc32(a))[len(b)] ^ crc32(b)``.
    """
    out = np.empty((most + 1, len(crc)), dtype=np.uint32)
    out[0] = crc
    for k in range(most):
        out[k + 1] = _CRC_STEP[out[k] & np.uint32(255)] ^ (out[k] >> np.uint32(8))
    return out


def word_counts(docs: DataFrame, drop_every: int = 0, min_letters: int = 6) -> DataFrame:
    """``word, n``: occurrences of the lower-cased runs of letters of ``docs(doc_id, text)``.

    With ``drop_every`` a run whose checksum ``crc32('<doc_id>:<run>')`` it divides loses the letter at
    the checksum modulo its length, as a reproducible source of misspellings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in slices(batches, 1):
            letters, lengths, text = latin_runs(raw, offsets)
            codes, values = dictionary(letters, lengths)
            words = [v.decode("latin-1") for v in values.to_pylist()]
            found: Counter[str] = Counter()
            lost = np.zeros(len(codes), dtype=bool)
            if drop_every and words:
                encoded = [w.encode() for w in words]
                crcs = np.array([zlib.crc32(e) for e in encoded], dtype=np.uint32)
                sizes = np.array([len(e) for e in encoded])
                heads = [b"%s:" % (b"" if d is None else str(d).encode()) for d in part.column(0).to_pylist()]
                shift = shifted(np.array([zlib.crc32(h) for h in heads], dtype=np.uint32), SHORT)
                size = sizes[codes]
                draw = shift[np.minimum(size, SHORT), text] ^ crcs[codes]
                for k in np.flatnonzero(size > SHORT):
                    draw[k] = zlib.crc32(heads[text[k]] + encoded[codes[k]])
                lost = draw % np.uint32(drop_every) == 0
                for k in np.flatnonzero(lost):
                    word = words[codes[k]]
                    at = int(draw[k]) % len(word)
                    found[word[:at] + word[at + 1 :]] += 1
            plain = np.bincount(codes[~lost], minlength=len(words))
            for k in np.flatnonzero(plain):
                found[words[k]] += int(plain[k])
            rows = [(w, n) for w, n in found.items() if len(w) >= min_letters]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())],
                    ["word", "n"],
                )

    made = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


# Rough counts are taken over the code points modulo CLASSES; the last class follows from the length.
CLASSES = 6
_CELL = [f"c{k}" for k in range(CLASSES)]
_TO = [f"to{k}" for k in range(CLASSES)]


def _moves() -> list[tuple[int, ...]]:
    """How a single edit moves (length, counts of all classes but the last): not at all, a letter more of
    some class, a letter of one class for one of another. Opposite moves are the same pair of cells."""
    unit = np.eye(CLASSES, dtype=int)
    steps = [np.zeros(CLASSES, dtype=int)]
    steps += [np.append(1, u[:-1]) for u in unit]
    steps += [np.append(0, (unit[i] - unit[j])[:-1]) for i in range(CLASSES) for j in range(i + 1, CLASSES)]
    return [tuple(int(x) for x in step) for step in steps]


def celled(words: DataFrame) -> DataFrame:
    """``word, n`` with the word's cell: its length and its letters with code points 0, 1, ... modulo ``CLASSES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = [np.frombuffer(w.encode("latin-1"), dtype=np.uint8) for w in batch.column(0).to_pylist()]
                counts = np.array([np.bincount(r % CLASSES, minlength=CLASSES) for r in raw], dtype=np.int32)
                cell = [counts.sum(axis=1, dtype=np.int32), *counts[:, :-1].T]
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, cell)], ["word", "n", *_CELL])

    return words.select("word", "n").mapInArrow(run, "word string, n long, " + ", ".join(f"{c} int" for c in _CELL))


def letter_counts(points: np.ndarray) -> np.ndarray:
    """How often each word, a row of code points, has each letter; as floats that hold all squares exactly."""
    at = np.arange(len(points))[:, None] * COLUMNS + _COLUMN[points]
    counts = np.bincount(at.ravel(), minlength=len(points) * COLUMNS).reshape(len(points), COLUMNS)
    return counts.astype(np.float32 if points.shape[1] <= 2000 else np.float64)


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether the words of each row differ by exactly one letter, replaced or missing in ``short``."""
    length = short.shape[1]
    if long.shape[1] == length:
        return (short != long).sum(axis=1) == 1
    same = np.hstack([short == long[:, :length], np.zeros((len(short), 1), dtype=bool)])
    first = np.argmin(same, axis=1)
    rest = np.ones((len(short), length + 1), dtype=bool)
    rest[:, :length] = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1)[:, ::-1]
    return rest[np.arange(len(short)), first]


def near_in_blocks(left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of two blocks, or twice of one (``right`` None), that are one edit apart.

    A block is a matrix of code points; ``right`` has words as long as those of ``left`` or one letter longer.
    """
    a = letter_counts(left)
    b = a if right is None else letter_counts(right)
    other = left if right is None else right
    # One product gives |a|^2 - 2 ab + |b|^2; all numbers are whole, so it is exact.
    squares = [(x * x).sum(axis=1, keepdims=True) for x in (a, b)]
    distance = np.hstack([a, squares[0], np.ones_like(squares[0])]) @ np.hstack(
        [-2 * b, np.ones_like(squares[1]), squares[1]]
    ).T
    i, j = np.divmod(np.flatnonzero(distance.ravel() == 2 - (other.shape[1] - left.shape[1])), len(other))
    if right is None:
        i, j = i[i < j], j[i < j]
    step = max(1, VERIFY_BYTES // other.shape[1])
    fine = [one_edit(left[i[k : k + step]], other[j[k : k + step]]) for k in range(0, len(i), step)]
    fine = np.concatenate(fine) if fine else np.zeros(0, dtype=bool)
    return i[fine], j[fine]


def _best(at: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words met, how many near words each has here, and the commonest of them (words are in order)."""
    order = np.lexsort((other, -n[other], at))
    first = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1])) if len(at) else order
    return at[order[first]], np.diff(np.append(first, len(at))), other[order[first]]


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a column of blocks, their counts, the blocks' offsets and all code points."""
    held = column.flatten()
    words, n = held.field(0), held.field(1).to_numpy()
    raw, _ = text_bytes(words)
    lead = raw == 0xC3
    tail = np.append(False, lead[:-1])[: len(raw)]
    sizes = column.value_lengths().to_numpy()
    return words, n, np.append(0, np.cumsum(sizes)), np.where(tail, raw + np.uint8(0x40), raw)[~lead]


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best``: for words with others one edit apart, how many and the commonest."""
    placed = pin(celled(words))
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.lit(BLOCK_BYTES) / F.col("c0"))))
    cells = pin(placed.groupBy(*_CELL).agg(F.ceil(F.count("*") / F.first(most)).cast("int").alias("blocks")))
    blocks = pin(
        placed.join(cells, _CELL)
        .withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
        .groupBy(*_CELL, "block")
        .agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("held"))
    )
    moves = F.array(*[F.struct(*[F.lit(x).alias(f"m{k}") for k, x in enumerate(m)]) for m in _moves()])
    to = [(F.col(c) + F.col(f"move.m{k}")).alias(t) for k, (c, t) in enumerate(zip(_CELL, _TO))]
    target = [F.col(c).alias(t) for c, t in zip(_CELL, _TO)]
    home = F.lit(True)
    for c, t in zip(_CELL, _TO):
        home = home & (F.col(c) == F.col(t))
    met = pin(
        blocks.select(*_CELL, "block", F.explode(moves).alias("move"))
        .select(*_CELL, "block", *to)
        .join(cells.select(*target, "blocks"), _TO)
        .withColumn("to_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .filter(~home | (F.col("block") <= F.col("to_block")))
    )
    # Rows are small and the work on each is not, so tasks are dealt by rows instead of bytes.
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), met.count() // PAIRS_PER_TASK)
    pairs = (
        met.join(blocks.withColumnRenamed("held", "left"), [*_CELL, "block"])
        .join(blocks.select(*target, F.col("block").alias("to_block"), F.col("held").alias("right")), [*_TO, "to_block"])
        .withColumn("same", home & (F.col("block") == F.col("to_block")))
        .repartition(tasks, *_CELL, "block", *_TO, "to_block")
        .select("left", "right", "same", "c0", "to0")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (left, nl, lo, lp), (right, nr, ro, rp) = _flat(batch.column(0)), _flat(batch.column(1))
            long = [np.repeat(batch.column(c).to_numpy(), np.diff(o)) for c, o in ((3, lo), (4, ro))]
            starts = [np.append(0, np.cumsum(x)) for x in long]
            out: list[list[np.ndarray]] = [[], [], []]
            n = np.concatenate([nl, nr])
            for k, same in enumerate(batch.column(2).to_pylist()):
                block = [
                    p[s[o[k]] : s[o[k + 1]]].reshape(o[k + 1] - o[k], -1)
                    for p, s, o in ((lp, starts[0], lo), (rp, starts[1], ro))
                ]
                i, j = near_in_blocks(block[0], None if same else block[1])
                i, j = i + lo[k], j + (lo[k] if same else ro[k] + len(nl))
                for column, values in zip(out, _best(np.concatenate([i, j]), np.concatenate([j, i]), n)):
                    column.append(values)
            word, near, best = (np.concatenate(x) for x in out)
            if len(word):
                names = pa.concat_arrays([left, right])
                columns = [names.take(pa.array(word)), pa.array(near), pa.array(n[best]), names.take(pa.array(best))]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n_near", "best_n", "best"])

    found = pairs.mapInArrow(run, "word string, n_near long, best_n long, best string")
    chosen = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), chosen.alias("chosen"))
        .select("word", "n_near", (-F.col("chosen.minus")).alias("best_n"), F.col("chosen.best").alias("best"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of the chain ``word -> form``; chains have no cycles.

    Every round doubles the steps taken.
    """
    state = pin(forms.select("word", F.col("form").alias("root")))
    while True:
        far = state.select(F.col("word").alias("root"), F.col("root").alias("far"))
        state = pin(state.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), "far"))
        if state.filter("far is not null").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def spelling_variants(words: DataFrame, min_count: int = 5, times: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the words of ``words(word, n)`` seen ``min_count`` times or more.

    A word's form is its commonest near word if that is at least ``times`` as common; its root is where following
    forms ends.
    """
    words = pin(words.filter(F.col("n") >= min_count))
    near = words.join(near_words(words), "word", "left")
    has = F.col("best_n") >= times * F.col("n")
    known = pin(
        near.select(
            "word",
            F.when(has, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has, F.col("best_n")).alias("form_n"),
        )
    )
    ends = roots(known.filter("form is not null"))
    return known.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(word_counts(docs, drop_every=199))
