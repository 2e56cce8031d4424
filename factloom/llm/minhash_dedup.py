"""Near-duplicate components by HyperMinHash sketches.

A document's set is its distinct word shingles. Its sketch has ``REGISTERS`` buckets; each keeps the
smallest hash as leading-zero count and ten mantissa bits, 16 bits in all. Empty buckets of a short
text take the next full one's value. Bands of compressed registers propose candidates, a Jaccard
estimate corrected for chance collisions discards the hopeless, and full shingle sets decide.

No group of candidates is ever paired with itself:

1. equal sets are one representative (smallest id) from the start;
2. in each band group every member is compared with the group's smallest id only;
3. once those links have formed components, the members of groups that still hold several are
   joined on their rarest shingles, which every pair at the threshold must share, and only
   across components. Afterwards every two members of a group are linked through the graph,
   have been compared or cannot reach the threshold, so no link is lost.

A pair of similarity 0.8 misses all ``BANDS`` bands with probability 3e-6, one of 0.85 with 7e-9.

Defined results: documents without words (null and empty texts) have an empty set, link with
nothing and are kept; rows that share an id count as one document; rows with a null id are kept,
with a null component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.text import MULTIPLIERS, mix, per_document, shingle_hashes, small_batches
from factloom.session import broadcast_if_small, pin

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
EMPTY = 65535
PARITY_BITS = 1024
# Standard errors by which an estimate may fall short of the threshold.
SLACK = 6.0
# Of values within one cell of the compressed scale: mean of 2 ** floor(log2 x) / x.
_CELL = 1 / (2 * np.log(2))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Compressed registers of a sorted set of 64-bit hashes, empty ones as ``EMPTY``."""
    registers = np.full(REGISTERS, EMPTY, dtype=np.uint16)
    if len(hashes):
        spread = (hashes >> np.uint64(32)) * np.uint64(REGISTERS)
        bucket = (spread >> np.uint64(32)).astype(np.int64)
        # Hashes are sorted, so the first of a bucket has its smallest fraction.
        first = np.append(True, bucket[1:] != bucket[:-1])
        fraction = (spread[first] & np.uint64(0xFFFFFFFF)).astype(np.float32)
        bits = np.maximum(fraction, 1).view(np.uint32) >> np.uint32(23 - MANTISSA)
        registers[bucket[first]] = (bits - np.uint32(127 << MANTISSA)).astype(np.uint16)
    return registers


def filled(registers: np.ndarray) -> np.ndarray:
    """Registers with empty buckets taking the value of the next full one, in a circle."""
    out = registers.copy()
    for row in out:
        full = np.flatnonzero(row != EMPTY)
        if 0 < len(full) < len(row):
            row[:] = row[full[np.searchsorted(full, np.arange(len(row))) % len(full)]]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands, one row of keys for each row of registers."""
    values = filled(registers).astype(np.uint64).reshape(len(registers), BANDS, ROWS)
    total = np.sum((values + np.uint64(1)) * MULTIPLIERS[:ROWS], axis=2, dtype=np.uint64)
    return mix(total + MULTIPLIERS[100 : 100 + BANDS]).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, less the matches that compression makes by chance."""
    used = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & used).sum(axis=1)
    rate_a, rate_b = size_a / REGISTERS, size_b / REGISTERS
    chance = _CELL / 2**MANTISSA * rate_a * rate_b / np.maximum(rate_a + rate_b, 1e-9) ** 2
    expected = chance * used.sum(axis=1)
    return (same - expected) / np.maximum(used.sum(axis=1) - expected, 1)


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each of ``PARITY_BITS`` hash classes, whether the set holds an odd number; as 64-bit integers."""
    counts = np.bincount((hashes & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n, f1, f2, regs``: size, two fingerprints and sketch of each set."""

    def run(texts: list[str]):
        n, f1, f2, regs = [], [], [], []
        for text in texts:
            hashes = shingle_hashes(text.encode(), shingle)
            n.append(len(hashes))
            f1.append(int(np.sum(mix(hashes), dtype=np.uint64).view(np.int64)))
            f2.append(int(np.bitwise_xor.reduce(mix(hashes ^ MULTIPLIERS[50])).view(np.int64)) if len(hashes) else 0)
            regs.append(sketch(hashes).tobytes())
        return [n, f1, f2, pa.array(regs, type=pa.binary())]

    made = per_document(docs, run, "n long, f1 long, f2 long, regs binary", ["doc_id"])
    return made.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n", "f1", "f2", "regs")


def banded(reps: DataFrame) -> DataFrame:
    """``key, doc``: the bands of each representative."""
    small_batches(reps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.stack([np.frombuffer(r, dtype=np.uint16) for r in batch.column(1).to_pylist()])
                doc = np.repeat(np.array(batch.column(0).to_pylist(), dtype=np.int64), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(regs).ravel()), pa.array(doc)], ["key", "doc"])

    return reps.select("doc_id", "regs").mapInArrow(run, "key long, doc long")


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose estimated similarity is not clearly below the threshold."""
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("regs").alias(f"r{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "ra", "rb")
    t = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (
                    np.stack([np.frombuffer(r, dtype=np.uint16) for r in batch.column(k).to_pylist()]) for k in (4, 5)
                )
                na, nb = (np.array(batch.column(k).to_pylist(), dtype=float) for k in (2, 3))
                used = ((ra != EMPTY) | (rb != EMPTY)).sum(axis=1)
                floor = t - SLACK * np.sqrt(t * (1 - t) / np.maximum(used, 1))
                fine = (np.minimum(na, nb) >= t * np.maximum(na, nb)) & (estimate(ra, rb, na, nb) >= floor)
                kept = batch.select([0, 1]).filter(pa.array(fine))
                if kept.num_rows:
                    yield kept

    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    small_batches(docs)
    pairs = pin(pairs)
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = pin(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(broadcast_if_small(wanted, 64), "doc_id", "left_semi")
        .dropDuplicates(["doc_id"])
    )
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, np.ndarray] = (None, np.zeros(0, dtype=np.uint64))
        for batch in batches:
            fine = []
            for a, ta, tb in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if known[0] != a:
                    known = a, shingle_hashes((ta or "").encode(), shingle)
                other = shingle_hashes((tb or "").encode(), shingle)
                common = len(np.intersect1d(known[1], other, assume_unique=True))
                fine.append(100 * common >= percent * (len(known[1]) + len(other) - common) and common > 0)
            kept = batch.select([0, 1]).filter(pa.array(fine, type=pa.bool_()))
            if kept.num_rows:
                yield kept

    return pin(both.mapInArrow(run, "a long, b long"))


def sharing_rare(members: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs of ``members(doc, comp)`` from different components that can still reach the threshold.

    Two sets of that similarity share one of the ``n - ceil(t * n) + 1`` rarest shingles of each, with
    rarity counted among the members, so texts that share only widespread passages never meet. Where many
    do meet, the parities of their sets bound the difference from below and end hopeless pairs inside the join.
    """
    members = pin(members)
    small_batches(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(
        broadcast_if_small(members.select("doc"), 64), "doc", "left_semi"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sets = [shingle_hashes((t or "").encode(), shingle) for t in batch.column(1).to_pylist()]
                columns = [batch.column(0), pa.array([x.view(np.int64) for x in sets]), pa.array(map(parity, sets))]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "shingles", "parity"])

    per_doc = pin(
        texts.dropDuplicates(["doc"]).mapInArrow(run, "doc long, shingles array<long>, parity array<long>")
    )
    made = per_doc.select("doc", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    shared = made.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    needed = F.floor((percent * F.col("n") + 99) / 100)
    place = Window.partitionBy("doc").orderBy("df", "shingle")
    prefix = (
        made.join(shared, "shingle")
        .select(
            "doc", "n", "shingle", F.row_number().over(place).alias("place"),
            F.count("*").over(Window.partitionBy("doc")).alias("n_shared"),
        )  # Shingles of one document only come first in the order and match nothing.
        .filter(F.col("place") + F.col("n") - F.col("n_shared") <= F.col("n") - needed + 1)
        .join(members, "doc")
        .join(per_doc.select("doc", "parity"), "doc")
    )
    prefix = pin(prefix.select("shingle", "doc", "n", "n_shared", "comp", "parity"))
    largest = (
        prefix.groupBy("shingle", "comp")
        .agg(F.count("*").alias("c"))
        .groupBy("shingle")
        .agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.count("*").alias("n_comps"))
        .filter("n_comps > 1")
    )
    mixed = prefix.join(largest, "shingle")
    side = lambda c: [F.col(a).alias(f"{c}_{a}") for a in ("doc", "comp", "n", "n_shared", "parity")]
    minor = mixed.filter("comp <> major").select("shingle", *side("x"))
    others = mixed.select("shingle", *side("y"))
    # What a document has alone is in no intersection, so that holds at most the smaller shared part;
    # a bit that differs between two parities stands for at least one shingle that only one set has.
    common = F.least("x_n_shared", "y_n_shared")
    total = F.col("x_n") + F.col("y_n")
    bits = [F.bit_count(F.get("x_parity", k).bitwiseXOR(F.get("y_parity", k))) for k in range(PARITY_BITS // 64)]
    able = (100 * common >= percent * (total - common)) & ((100 + percent) * sum(bits) <= (100 - percent) * total)
    return (
        minor.join(others, "shingle")
        .filter((F.col("x_comp") != F.col("y_comp")) & able)
        .select(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``."""
    sets = pin(sketches(docs, shingle))
    identity = ["n", "f1", "f2"]
    same = (
        sets.filter("n > 0 and doc_id is not null")
        .groupBy(*identity)
        .agg(F.min("doc_id").alias("rep"), F.min_by("regs", "doc_id").alias("regs"))
    )
    reps = pin(same.select(F.col("rep").alias("doc_id"), *identity, "regs"))
    bands = banded(reps)
    groups = bands.groupBy("key").agg(F.min("doc").alias("least"), F.count("*").alias("size")).filter("size > 1")
    members = pin(bands.join(groups, "key").select("key", "doc", "least", "size"))
    stars = pin(members.filter("doc <> least").select(F.col("least").alias("a"), F.col("doc").alias("b")).distinct())
    first = verified(likely(stars, reps, percent), docs, shingle, percent)
    roots = components(first)
    placed = pin(
        members.filter("size > 2")
        .join(roots.withColumnRenamed("node", "doc"), "doc", "left")
        .select("key", "doc", F.coalesce("root", "doc").alias("comp"))
    )
    shares = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    largest = (
        shares.groupBy("key")
        .agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.count("*").alias("n_comps"))
        .filter("n_comps > 1")
    )
    undecided = placed.join(largest, "key").select("doc", "comp").distinct()
    rest = sharing_rare(undecided, docs, shingle, percent).join(stars, ["a", "b"], "left_anti")
    second = verified(likely(rest, reps, percent), docs, shingle, percent)
    # Sets with one id (rows that share it) are one document, so ids link their representatives too.
    shared = sets.filter("n > 0").join(same.select(*identity, "rep"), identity).filter("doc_id is not null")
    aliases = (
        shared.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")
    )
    final = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(second).union(aliases))
    where = (
        same.select(*identity, "rep")
        .join(final.withColumnRenamed("node", "rep"), "rep", "left")
        .select(*identity, F.coalesce("root", "rep").alias("component"))
    )
    return (
        sets.select("doc_id", *identity)
        .join(where, identity, "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def without_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, with the columns it came with."""
    found = near_duplicates(docs, shingle, percent)
    dropped = found.filter(~F.col("kept")).select("doc_id").distinct()
    once = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).union(docs.filter("doc_id is null"))
    return once.join(broadcast_if_small(dropped, 64), "doc_id", "left_anti").select(*docs.columns)


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=3, percent=85)
