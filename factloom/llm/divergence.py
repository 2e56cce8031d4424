"""Source divergence audit: how the word use of each source differs from its language's and from other sources'.

1. Exact document frequencies choose the terms of each language (counted per slice of text, then summed).
2. The terms are dealt by hash into shards of about ``SHARD_TERMS``; every shard gets a minimal perfect hash: a
   term's slot is the rank of the first bit, level by level, that it shares with no other term of its shard. The
   terms themselves are stored in slot order, so a lookup is verified by comparing strings.
3. The shards are broadcast in slices of at most ``BROADCAST_BYTES``, whatever the vocabulary's size, and the second
   pass over the texts, one for each slice, increments dense pages of slots for every (language, source) group.
   A task flushes its pages beyond ``MAX_PAGES``.
4. Smoothed shares follow in whole-number arithmetic. Pairs of sources are compared page by page in tiles of
   ``BLOCK_SOURCES`` x ``BLOCK_SOURCES`` dense rows, so neither a wide vocabulary nor many sources meet in one task.

Defined results: null languages and sources are read as '', null texts as empty; every row is a document, rows that
share an id too; a group without terms has the share of a zero count for every term; a language without
kept terms has distances of 0 and no terms; ties go to the smaller item in UTF-8 order; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.slices import dictionary, runs, slices, text_bytes
from factloom.llm.text import MULTIPLIERS, mix
from factloom.session import broadcast_if_small, pin

SHARD_TERMS = 4096
BROADCAST_BYTES = 64 * 2**20
# Bits of a level for each term that it has to place.
GAMMA = 2
PAGE = 4096
MAX_PAGES = 2048
BLOCK_SOURCES = 64

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def coded_terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text number and code of every term, in order, and the distinct terms."""
    inside = _LETTER[raw]
    starts, ends, text = runs(inside, offsets)
    codes, values = dictionary(_LOWER[raw[inside]], ends - starts)
    return text, codes.astype(np.int64), values.cast(pa.binary()).view(pa.string())


def term_hashes(terms: pa.Array, variant: int = 0) -> np.ndarray:
    """64-bit hashes of strings; variants are independent of each other."""
    raw, offsets = text_bytes(terms)
    lengths = np.diff(offsets)
    if not len(raw):
        return mix(lengths.astype(np.uint64) + MULTIPLIERS[variant])
    powers = np.full(int(lengths.max()) + 1, MULTIPLIERS[variant], dtype=np.uint64)
    powers = np.multiply.accumulate(powers)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], lengths)
    values = mix(raw.astype(np.uint64) + MULTIPLIERS[100 + variant]) * powers[place]
    prefix = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
    return mix(prefix[offsets[1:]] - prefix[offsets[:-1]] + lengths.astype(np.uint64))


def _spot(hashes: np.ndarray, level: int, sizes: np.ndarray | int) -> np.ndarray:
    return (mix(hashes + MULTIPLIERS[level]) % np.asarray(sizes, dtype=np.uint64)).astype(np.int64)


def perfect_hash(terms: pa.Array) -> tuple[int, list[np.ndarray], np.ndarray]:
    """``variant, levels, order``: bits of each level, and the terms' numbers in slot order."""
    variant = 0
    while len(np.unique(hashes := term_hashes(terms, variant))) < len(terms):
        variant += 1
    levels, order = [], []
    rest = np.arange(len(terms))
    while len(rest):
        at = _spot(hashes[rest], len(levels), GAMMA * len(rest))
        bits = np.bincount(at, minlength=GAMMA * len(rest)) == 1
        alone = bits[at]
        order.append(rest[alone][np.argsort(at[alone])])
        levels.append(bits)
        rest = rest[~alone]
    return variant, levels, np.concatenate(order)


class Slots:
    """Some shards' perfect hashes, laid out so that the rank of a term's bit among all bits is its slot."""

    def __init__(self, shards: list, first_slot: int):
        self.first_slot = first_slot
        self.variants = np.array([s.variant for s in shards])
        self.sizes = np.zeros((len(shards), max(len(s.sizes) for s in shards)), dtype=np.int64)
        for row, s in zip(self.sizes, shards):
            row[: len(s.sizes)] = s.sizes
        flat = np.append(0, np.cumsum(self.sizes))
        self.starts = flat[:-1].reshape(self.sizes.shape)
        self.bits = np.zeros(flat[-1], dtype=bool)
        for start, s in zip(self.starts[:, 0], shards):
            self.bits[start : start + sum(s.sizes)] = np.unpackbits(
                np.frombuffer(s.bits, dtype=np.uint8), count=sum(s.sizes)
            )
        self.terms = pa.array([t for s in shards for t in s.terms], pa.string())
        self.shards: dict[str, np.ndarray] = {}
        for k, s in enumerate(shards):
            self.shards.setdefault(s.lang, np.full(s.shards, -1))[s.shard] = k
        self.rank: np.ndarray | None = None

    def find(self, lang: str, terms: pa.Array) -> np.ndarray:
        """Slots of one language's terms, -1 for those that are not stored here."""
        slots = np.full(len(terms), -1, dtype=np.int64)
        if lang not in self.shards:
            return slots
        if self.rank is None:
            self.rank = np.cumsum(self.bits) - 1
        first = term_hashes(terms)
        shard = self.shards[lang][shard_of(first, len(self.shards[lang]))]
        for variant in np.unique(self.variants):
            hashes = first if variant == 0 else term_hashes(terms, int(variant))
            rest = np.flatnonzero((shard >= 0) & (self.variants[shard] == variant))
            for level in range(self.sizes.shape[1]):
                rest = rest[self.sizes[shard[rest], level] > 0]
                at = self.starts[shard[rest], level] + _spot(hashes[rest], level, self.sizes[shard[rest], level])
                hit = self.bits[at]
                slots[rest[hit]] = self.rank[at[hit]]
                rest = rest[~hit]
        found = np.flatnonzero(slots >= 0)
        same = pc.equal(self.terms.take(pa.array(slots[found])), terms.take(pa.array(found))).to_numpy(False)
        slots[found[~same]] = -1
        return slots


def shard_of(hashes: np.ndarray, shards: np.ndarray | int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.asarray(shards, dtype=np.uint64)).astype(np.int64)


def frequent_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """``lang, term`` for terms in at least ``min_docs`` rows of ``docs(lang, source, text)`` with that language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in slices(batches, 2):
            text, codes, terms = coded_terms(raw, offsets)
            if len(codes):
                langs = part.column(0).dictionary_encode()
                once = np.unique(text * len(terms) + codes)
                lang = langs.indices.to_numpy().astype(np.int64)[once // len(terms)]
                keys, n = np.unique(lang * len(terms) + once % len(terms), return_counts=True)
                columns = [langs.dictionary.take(pa.array(keys // len(terms))), terms.take(pa.array(keys % len(terms)))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], ["lang", "term", "n"])

    made = docs.mapInArrow(run, "lang string, term string, n long")
    return made.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term")


def hashed_shards(kept: DataFrame) -> DataFrame:
    """One row for each shard of ``kept(lang, term)``: its terms in slot order, the bits of its levels, the number of
    its first slot and the slice that it is broadcast with."""
    sizes = kept.groupBy("lang").agg(F.ceil(F.count("*") / SHARD_TERMS).cast("long").alias("shards"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                shard = shard_of(term_hashes(batch.column(1)), batch.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], ["lang", "term", "shards", "shard"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                terms = batch.column(3)[k].values
                variant, levels, order = perfect_hash(terms)
                bits = np.packbits(np.concatenate(levels)).tobytes()
                size = len(bits) + 8 * len(terms) + pc.sum(pc.binary_length(terms)).as_py()
                made = [[variant], [[len(x) for x in levels]], [bits], [terms.take(pa.array(order))], [len(terms)], [size]]
                types = (pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(k, 1).columns[:3], *[pa.array(m, t) for m, t in zip(made, types)]],
                    ["lang", "shard", "shards", "variant", "sizes", "bits", "terms", "n", "bytes"],
                )

    dealt = kept.join(sizes, "lang").select("lang", "term", "shards")
    held = (
        dealt.mapInArrow(deal, "lang string, term string, shards long, shard long")
        .groupBy("lang", "shard", "shards")
        .agg(F.sort_array(F.collect_list("term")).alias("terms"))
    )
    schema = "lang string, shard long, shards long, variant int, sizes array<long>, bits binary, terms array<string>"
    shards = pin(held.mapInArrow(build, schema + ", n long, bytes long"))
    # One row stands for thousands of terms here, and nothing but its sizes is read.
    before = Window.orderBy("lang", "shard").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    places = shards.select(
        "lang", "shard", start("n").alias("first_slot"), F.floor(start("bytes") / BROADCAST_BYTES).alias("slice")
    )
    return pin(shards.join(places, ["lang", "shard"]))


def recounted(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """``lang, source, slot, n``: how often each stored term occurs in each group of ``docs(lang, source, text)``."""
    spark = docs.sparkSession
    counts = None
    for (k,) in sorted(shards.select("slice").distinct().collect()):
        rows = shards.filter(F.col("slice") == k).orderBy("first_slot").collect()
        known = spark.sparkContext.broadcast(Slots(rows, rows[0].first_slot))
        part = docs.mapInArrow(_counter(known), "lang string, source string, slot long, n long")
        counts = part if counts is None else counts.union(part)
    if counts is None:
        return spark.createDataFrame([], "lang string, source string, slot long, n long")
    return counts.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n"))


def _counter(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: Slots = known.value
        groups: dict[tuple[str, str], int] = {}
        rows: dict[int, int] = {}
        pages = np.zeros((16, PAGE), dtype=np.int64)
        per_group = len(slots.terms) // PAGE + 1

        def flush() -> Iterator[pa.RecordBatch]:
            names = [pa.array(x, pa.string()) for x in zip(*groups)]
            for key, row in rows.items():
                at = np.flatnonzero(pages[row])
                group = pa.array(np.full(len(at), key // per_group))
                slot = at + key % per_group * PAGE + slots.first_slot
                yield pa.RecordBatch.from_arrays(
                    [*[x.take(group) for x in names], pa.array(slot), pa.array(pages[row, at])],
                    ["lang", "source", "slot", "n"],
                )

        for part, raw, offsets in slices(batches, 2):
            text, codes, terms = coded_terms(raw, offsets)
            if not len(codes):
                continue
            langs = part.column(0).dictionary_encode()
            lang = langs.indices.to_numpy().astype(np.int64)
            pairs, place = np.unique(lang[text] * len(terms) + codes, return_inverse=True)
            found = np.full(len(pairs), -1, dtype=np.int64)
            for k, name in enumerate(langs.dictionary.to_pylist()):
                own = slice(*np.searchsorted(pairs, [k * len(terms), (k + 1) * len(terms)]))
                found[own] = slots.find(name, terms.take(pa.array(pairs[own] % len(terms))))
            slot = found[place]
            text, slot = text[slot >= 0], slot[slot >= 0]
            keys = zip(part.column(0).to_pylist(), part.column(1).to_pylist())
            group = np.array([groups.setdefault(key, len(groups)) for key in keys])
            touched, place = np.unique(group[text] * per_group + slot // PAGE, return_inverse=True)
            if len(rows) + len(touched) > MAX_PAGES:
                yield from flush()
                rows.clear()
                pages[:] = 0
            at = np.array([rows.setdefault(int(key), len(rows)) for key in touched], dtype=np.int64)
            if len(rows) > len(pages):
                pages = np.vstack([pages, np.zeros((2 * len(rows) - len(pages), PAGE), dtype=np.int64)])
            if len(slot):
                np.add.at(pages, (at[place], slot % PAGE), 1)
        yield from flush()

    return run


def share(n: str, total: str, terms: str) -> Column:
    """``1 + floor(10^9 (n + 5) / (total + 5 terms))``, exact for any counts."""
    above = f"cast(1000000000 as decimal(10,0)) * cast({n} + 5 as decimal(20,0))"
    return F.expr(f"1 + cast(({above}) div cast({total} + 5 * {terms} as decimal(20,0)) as bigint)")


def source_distances(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: summed differences of shares between the sources of each language.

    ``cells(lang, source, place, p)`` holds the shares of terms that occur; all others of the ``terms`` of a row of
    ``groups(lang, source, terms, p0)`` have its ``p0``.
    """
    sources = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK_SOURCES).cast("int").alias("blocks"))
    placed = groups.join(sources, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    last = F.greatest(F.ceil(F.col("terms") / PAGE), F.lit(1)) - 1
    frame = placed.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    page = cells.groupBy("lang", "source", F.floor(F.col("place") / PAGE).alias("page")).agg(
        F.collect_list(F.struct((F.col("place") % PAGE).alias("at"), "p")).alias("cells")
    )
    held = pin(
        frame.join(page, ["lang", "source", "page"], "left")
        .withColumn("width", F.least(F.lit(PAGE), F.col("terms") - F.col("page") * PAGE))
        .groupBy("lang", "page", "block", "blocks")
        .agg(F.sort_array(F.collect_list(F.struct("source", "p0", "width", "cells"))).alias("held"))
    )
    to = held.select("lang", "page", F.col("block").alias("to_block"), F.col("held").alias("right"))
    tiles = (
        held.withColumn("to_block", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
        .join(to, ["lang", "page", "to_block"])
        .select("lang", (F.col("block") == F.col("to_block")).alias("same"), F.col("held").alias("left"), "right")
    )

    def dense(held: list[dict]) -> np.ndarray:
        out = np.empty((len(held), held[0]["width"]), dtype=np.int64)
        for row, source in zip(out, held):
            row[:] = source["p0"]
            if source["cells"]:
                row[[c["at"] for c in source["cells"]]] = [c["p"] for c in source["cells"]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lang, same, left, right = (batch.column(c)[k].as_py() for c in range(4))
                a, b = dense(left), dense(right)
                out = []
                for i, row in enumerate(a):
                    value = np.abs(b - row).sum(axis=1)
                    out += [(left[i]["source"], r["source"], int(v)) for r, v in zip(right[i + 1 if same else 0 :], value[i + 1 if same else 0 :])]
                if out:
                    one, other, value = map(list, zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * 2 * len(out)), pa.array(one + other), pa.array(other + one), pa.array(value * 2)],
                        ["lang", "source", "item", "value"],
                    )

    found = tiles.mapInArrow(run, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (language, source) of ``docs(lang, source, text)``.

    Part ``pair``: the distance to each other source of the language. Part ``term``: the ``top`` terms whose
    share in the source exceeds their share in the language most.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    shards = hashed_shards(pin(frequent_terms(read, min_docs)))
    langs = pin(
        shards.groupBy("lang").agg(F.sum("n").alias("terms"), F.min("first_slot").alias("lang_slot"))
    )
    words = shards.select("lang", "first_slot", F.posexplode("terms").alias("k", "term")).select(
        "lang", (F.col("first_slot") + F.col("k")).alias("slot"), "term"
    )
    counts = pin(recounted(read, shards))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"))
    known = read.select("lang", "source").distinct()
    groups = pin(
        known.join(totals, ["lang", "source"], "left")
        .join(langs.join(whole, "lang"), "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_slot", "lang_total")])
        .withColumn("p0", F.when(F.col("terms") > 0, share("0", "total", "terms")).otherwise(F.lit(0)))
    )
    small = broadcast_if_small(groups, 256)
    cells = pin(
        counts.join(small, ["lang", "source"]).select(
            "lang", "source", "slot", (F.col("slot") - F.col("lang_slot")).alias("place"),
            share("n", "total", "terms").alias("p"), "terms", "lang_total",
        )
    )
    in_lang = counts.groupBy("lang", "slot").agg(F.sum("n").alias("lang_n")).join(words, ["lang", "slot"])
    terms = (
        cells.join(in_lang, ["lang", "slot"])
        .withColumn("value", F.col("p") - share("lang_n", "lang_total", "terms"))
        .filter("value > 0")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    )
    pairs = source_distances(cells, groups.select("lang", "source", "terms", "p0"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    pairs = ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    return pairs.union(ranked(terms).filter(F.col("rank") <= top))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents
), words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM docs
), found AS (
  SELECT r, lang, source, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM words
), kept AS (
  SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY lang, source, term
), grp AS (
  SELECT DISTINCT lang, source FROM docs
), size AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), total AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total
  FROM grp g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
), share AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * s.v) AS BIGINT) AS p
  FROM total t JOIN size s USING (lang) JOIN kept k USING (lang)
  LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), whole AS (
  SELECT k.lang, k.term,
    CAST(1 + (1000000000::HUGEINT * (k.n + 5)) // (sum(k.n) OVER (PARTITION BY k.lang) + 5 * s.v) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term) k JOIN size s USING (lang)
), distance AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM share a JOIN share b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source
  GROUP BY a.lang, a.source, b.source
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN distance d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
), term AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, s.p - w.q AS value
  FROM share s JOIN whole w USING (lang, term) WHERE s.n > 0 AND s.p > w.q
)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
) WHERE part = 'pair' OR rank <= 50
"""
