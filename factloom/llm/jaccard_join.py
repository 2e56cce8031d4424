"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact sorted-array intersection.

A document's set is its distinct word shingles. Sets that can reach the similarity lie in the same or in
neighbouring bands of size. The hash range is cut into as many classes for each band as two such sets can
differ in, and some more: at least as many classes as the surplus must then agree, so every pair meets in the tile of a
(band, class, content of the class). ``CLASSES`` of the classes are used. Sets of up to about 300 shingles have no
more, so none of their pairs can be missed; larger ones miss every tile with a probability below 1e-16 at the
threshold, and less above it.

1. equal sets are one node from the start;
2. every node is compared with one other, that which is the smallest of most of its tiles: first components;
3. tiles that still hold several components are cut into blocks of ``BLOCK_SETS`` members, those of the tile's largest
   component apart from the rest, and each pair of blocks but those of the largest component is one row: the parities of the sets in ``BITS`` hash classes differ in no more bits than the sets differ in
   shingles, which bounds the overlap of each pair of different components from above;
4. the sorted hash arrays of the pairs left are intersected.

No tile is held by one task, and pairs inside a component, which cannot change the result, are not made.

Defined results: documents without words (null and empty texts) have an empty set and link with nothing; rows that
share an id are linked with each other; rows with a null id have a null component and link nothing; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.slices import slices
from factloom.llm.text import MULTIPLIERS, mix, shingle_hashes
from factloom.session import broadcast_if_small, pin

CLASSES = 64
BITS = 1024
BLOCK_SETS = 256
PAIRS_PER_TASK = 10_000
PAIRS_AT_ONCE = 200_000
# Bands grow by this factor: few sets then lie near the end of one and need the next band's tiles too.
BAND_GROWTH = 1.5
ROUNDS = 4


def most_apart(total: int, percent: int) -> int:
    """In how many shingles two sets of ``total`` shingles together can differ at the similarity."""
    return (100 - percent) * total // (100 + percent)


class Bands:
    """Ranges of set sizes; a partner's size lies in the same or the next one."""

    def __init__(self, percent: int):
        self.percent = percent
        self.ends = [1]

    def ends_upto(self, n: int) -> np.ndarray:
        while self.ends[-1] < n:
            # A range reaches at least as far as the largest partner of its smallest size.
            first = self.ends[-1] + 1
            self.ends.append(max(int(self.ends[-1] * BAND_GROWTH), 100 * first // self.percent))
        return np.array(self.ends)

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """``(band, classes, difference)`` of the bands in which a set of ``n`` shingles can have a partner."""
        largest = 100 * n // self.percent
        ends = self.ends_upto(largest)
        out = []
        for band in range(int(np.searchsorted(ends, n)), int(np.searchsorted(ends, largest)) + 1):
            apart = most_apart(2 * int(ends[band]), self.percent)
            if apart:
                out.append((band, apart + 4 + apart // 4, apart))
        return out


def tile_keys(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the tiles of a sorted set.

    Two sets that agree in an empty class would meet only in emptiness; where a set has so many empty classes that
    its agreements might all be such, it takes further hash ranges too, and at last the empty classes themselves.
    Its partner then either has as many or shares a class with content.
    """
    keys = []
    for band, classes, apart in bands.of(len(hashes)):
        for turn in range(ROUNDS):
            spread = hashes if turn == 0 else np.sort(mix(hashes ^ MULTIPLIERS[turn]))
            place = ((spread >> np.uint64(32)) * np.uint64(classes)) >> np.uint64(32)
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            content = np.add.reduceat(mix(spread + MULTIPLIERS[60]), first)
            used = place[first]
            label = MULTIPLIERS[70:71] * np.uint64(band) + MULTIPLIERS[71:72] * np.uint64(turn)
            salted = mix(label + MULTIPLIERS[72] * (used + np.uint64(1)))
            keys.append(mix(content + salted)[used < CLASSES])
            if classes - len(first) < classes - apart:
                break
        else:
            empty = np.setdiff1d(np.arange(min(classes, CLASSES), dtype=np.uint64), used)
            keys.append(mix(MULTIPLIERS[73] + mix(label + MULTIPLIERS[72] * (empty + np.uint64(1)))))
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.uint64)


def parities(hashes: np.ndarray) -> bytes:
    """For each of ``BITS`` hash classes, whether the set has an odd number in it."""
    counts = np.bincount((hashes & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def profiles(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``doc_id, n, f1, f2, bits, keys``: size, two fingerprints, parities and tiles of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for part, raw, offsets in slices(batches, 1):
            n, f1, f2, bits, keys = [], [], [], [], []
            for k in range(part.num_rows):
                hashes = shingle_hashes(raw[offsets[k] : offsets[k + 1]].tobytes(), shingle)
                n.append(len(hashes))
                f1.append(int(np.sum(mix(hashes), dtype=np.uint64).view(np.int64)))
                f2.append(int(np.sum(mix(hashes ^ MULTIPLIERS[50]), dtype=np.uint64).view(np.int64)))
                bits.append(parities(hashes))
                keys.append(tile_keys(hashes, bands).view(np.int64))
            columns = [pa.array(c) for c in (n, f1, f2)]
            columns += [pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *columns], ["doc_id", "n", "f1", "f2", "bits", "keys"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = rows.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, bits binary, keys array<long>")
    return made.withColumn("row", F.monotonically_increasing_id())


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose sorted hash arrays overlap enough.

    A node's text is looked up by its id; of rows sharing the id the one with the node's fingerprints is taken.
    """
    pairs = pin(pairs)
    wanted = nodes.join(
        pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node"
    ).select("node", "doc_id", "f1", "f2")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        broadcast_if_small(pin(wanted), 64), "doc_id"
    )

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in slices(batches, 1):
            f1, f2 = (part.column(c).to_pylist() for c in (2, 3))
            fine = []
            for k in range(part.num_rows):
                hashes = shingle_hashes(raw[offsets[k] : offsets[k + 1]].tobytes(), shingle)
                one = int(np.sum(mix(hashes), dtype=np.uint64).view(np.int64))
                two = int(np.sum(mix(hashes ^ MULTIPLIERS[50]), dtype=np.uint64).view(np.int64))
                fine.append((one, two) == (f1[k], f2[k]))
            yield part.select([0, 1]).filter(pa.array(fine, pa.bool_()))

    texts = texts.select("node", "text", "f1", "f2").mapInArrow(own, "node long, text string")
    texts = pin(texts.dropDuplicates(["node"]))
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, np.ndarray] = (None, np.zeros(0, dtype=np.uint64))
        for batch in batches:
            fine = []
            nodes = batch.column(0).to_pylist()
            for k in range(batch.num_rows):
                if known[0] != nodes[k]:
                    known = nodes[k], shingle_hashes(batch.column(2)[k].as_buffer().to_pybytes(), shingle)
                other = shingle_hashes(batch.column(3)[k].as_buffer().to_pybytes(), shingle)
                common = len(np.intersect1d(known[1], other, assume_unique=True))
                fine.append(100 * common >= percent * (len(known[1]) + len(other) - common) and common > 0)
            yield batch.select([0, 1]).filter(pa.array(fine, pa.bool_()))

    return pin(both.mapInArrow(run, "a long, b long"))


def _words(bits: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(bits.to_pylist()), dtype=np.uint64).reshape(len(bits), BITS // 64)


def _can(n_a: np.ndarray, n_b: np.ndarray, differing: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap of ``(n_a + n_b - differing) / 2``, which is no less than the real one, would be enough."""
    return (100 + percent) * differing.astype(np.int64) <= (100 - percent) * (n_a + n_b)


def bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose bitmaps allow the similarity."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"w{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "wa", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                differing = np.bitwise_count(_words(batch.column(4)) ^ _words(batch.column(5))).sum(axis=1)
                fine = _can(batch.column(2).to_numpy(), batch.column(3).to_numpy(), differing, percent)
                yield batch.select([0, 1]).filter(pa.array(fine))

    return both.mapInArrow(run, "a long, b long")


def tile_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``members(key, node, comp, n, bits)`` of one tile, of different components, that the bitmaps allow."""
    largest = (
        members.groupBy("key", "comp")
        .agg(F.count("*").alias("size"))
        .groupBy("key")
        .agg(F.max_by("comp", F.struct("size", "comp")).alias("major"), F.max("size").alias("most"), F.sum("size").alias("all"))
        .select(
            "key", "major",
            F.ceil(F.col("most") / BLOCK_SETS).cast("int").alias("major_blocks"),
            F.ceil((F.col("all") - F.col("most")) / BLOCK_SETS).cast("int").alias("minor_blocks"),
        )
    )
    count = F.when(F.col("minor"), F.col("minor_blocks")).otherwise(F.col("major_blocks"))
    blocks = pin(
        members.join(largest, "key")
        .withColumn("minor", F.col("comp") != F.col("major"))
        .withColumn("block", F.pmod(F.xxhash64("node"), count).cast("int"))
        .groupBy("key", "minor", "block", "major_blocks", "minor_blocks")
        .agg(F.collect_list(F.struct("node", "comp", "n", "bits")).alias("held"))
    )
    target = lambda minor, first, end: F.transform(
        F.sequence(first, F.col(end) - 1), lambda k: F.struct(F.lit(minor).alias("to_minor"), k.alias("to_block"))
    )
    targets = F.concat(target(True, F.col("block"), "minor_blocks"), target(False, F.lit(0), "major_blocks"))
    met = blocks.filter("minor").select("key", "block", "held", F.explode(targets).alias("to"))
    met = met.select("key", "block", F.col("held").alias("left"), "to.to_minor", "to.to_block")
    work = blocks.filter("minor").agg(F.sum(F.col("minor_blocks") - F.col("block") + F.col("major_blocks"))).first()[0]
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), (work or 0) // PAIRS_PER_TASK)
    right = blocks.select(
        "key", F.col("minor").alias("to_minor"), F.col("block").alias("to_block"), F.col("held").alias("right")
    )
    both = (
        met.join(right, ["key", "to_minor", "to_block"])
        .repartition(tasks, "key", "block", "to_minor", "to_block")
        .select("left", "right")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (node_a, comp_a, n_a, bits_a), (node_b, comp_b, n_b, bits_b) = (
                [held.field(f) if f == 3 else held.field(f).to_numpy() for f in range(4)]
                for held in (batch.column(0).flatten(), batch.column(1).flatten())
            )
            words_a, words_b = _words(bits_a), _words(bits_b)
            rows, columns = (c.value_lengths().to_numpy().astype(np.int64) for c in batch.columns)
            # The pairs of all rows' blocks, numbered one row after the other.
            ends = np.cumsum(rows * columns)
            first_a, first_b = np.cumsum(rows) - rows, np.cumsum(columns) - columns
            for start in range(0, int(ends[-1]), PAIRS_AT_ONCE):
                pair = np.arange(start, min(start + PAIRS_AT_ONCE, int(ends[-1])))
                row = np.searchsorted(ends, pair, side="right")
                inside = pair - (ends[row] - rows[row] * columns[row])
                i, j = first_a[row] + inside // columns[row], first_b[row] + inside % columns[row]
                other = (comp_a[i] != comp_b[j]) & (node_a[i] != node_b[j])
                i, j = i[other], j[other]
                differing = np.bitwise_count(words_a[i] ^ words_b[j]).sum(axis=1)
                fine = _can(n_a[i], n_b[j], differing, percent)
                a, b = node_a[i[fine]], node_b[j[fine]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def jaccard_join(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``."""
    rows = pin(profiles(docs, shingle, percent))
    same = ["n", "f1", "f2"]
    linked = rows.filter("n > 0 and doc_id is not null")
    nodes = pin(
        linked.groupBy(*same).agg(F.min(F.struct("row", "doc_id")).alias("least")).select(
            F.col("least.row").alias("node"), F.col("least.doc_id").alias("doc_id"), *same
        )
    )
    own = nodes.select(F.col("node").alias("row"))
    held = pin(rows.join(broadcast_if_small(own, 32), "row", "left_semi").select(F.col("row").alias("node"), "n", "bits", "keys"))
    keys = held.select("node", F.explode("keys").alias("key"))
    groups = pin(
        keys.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("size")).filter("size > 1")
    )
    members = pin(keys.join(groups, "key").select("key", "node", "least"))
    shares = members.filter("node <> least").groupBy("node", "least").agg(F.count("*").alias("tiles"))
    stars = shares.groupBy(F.col("node").alias("b")).agg(F.max_by("least", F.struct("tiles", "least")).alias("a"))
    first = verified(bounded(stars.select("a", "b"), held, percent), nodes, docs, shingle, percent)
    roots = components(first)
    placed = pin(
        members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    )
    undecided = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    open_tiles = placed.join(undecided.select("key"), "key").join(held.select("node", "n", "bits"), "node")
    rest = tile_pairs(pin(open_tiles), percent)
    second = verified(rest, nodes, docs, shingle, percent)
    # Rows that share an id are one document, so ids link their nodes too.
    with_node = linked.select("doc_id", *same).join(nodes.select("node", *same), same)
    shared = with_node.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z")
    aliases = with_node.join(shared, "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
    final = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(second).union(aliases))
    grouped = pin(
        nodes.join(final, "node", "left").select("node", "doc_id", *same, F.coalesce("root", "node").alias("root"))
    )
    # A node's doc_id is that of its first row; the smallest id of a component may be in any row of it.
    ids = linked.groupBy(*same).agg(F.min("doc_id").alias("least"))
    named = grouped.join(ids, same)
    component = named.groupBy("root").agg(F.min("least").alias("component"))
    where = named.join(component, "root").select(*same, "component")
    return (
        rows.select("doc_id", *same)
        .join(where, same, "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
    )


def op12_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_join(docs, shingle=4, percent=85)
