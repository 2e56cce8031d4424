"""Entity vectors fitted on triples: mini-batch gradient descent whose state lives in tables.

Parameters are one table ``(kind, id, vec, m, v)``: value and Adam moments of every entity,
relation and numeric relation, stored in buckets of (kind, id), so that no step shuffles them; there are as many
buckets as cores, or as the bytes need, and between steps a vector is one binary value. The negatives of many
batches do not depend on the parameters: they are drawn at once, and dealt with the positives, as ids, into the
groups of every batch. A step sends each group every vector that it needs once, however many of its positives use
it, and the group sends back one summed gradient for each. The next generation is written bucket by bucket; the
written table is the only link between steps.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import vectors as V
from factloom.functions.hashing import draw, md5int, unit
from factloom.functions.numeric import bin_row, random_vector, scale_values
from factloom.functions.ordered import dense_ids, number_copies, running_totals
from factloom.operators.sampling import corruption_candidates
from factloom.session import broadcast_if_small, drop_finished, path_exists, pin

ENTITY, RELATION, NUMBER, LOSS = 0, 1, 2, 3
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
CELLS_AT_ONCE = 4_000_000

# Slots (heads, tails, draws) of one group of positives, whose vectors a task holds at a time.
SLOTS_PER_GROUP = 50_000

# Files of a batch's slots.
BATCH_PARTS = 8

# Slots that are drawn in one pass and stored at a time; files of finished shuffles are dropped once for each quarter.
SLOTS_AT_ONCE = 100_000_000

# What a bucket of parameters holds at most.
BUCKET_BYTES = 16 * 2**20

SLOT_SCHEMA = (
    "grp int, pos_id long, rel long, numeric boolean, s array<struct<slot:int,side:int,id:long,x:double>>"
)
PARAM_SCHEMA = "kind int, id long, vec array<float>, m array<float>, v array<float>"
# The same between steps: the floats of a list as bytes, which are moved and stored as one value.
STATE_SCHEMA = "kind int, id long, vec binary, m binary, v binary"


@dataclass(frozen=True)
class FitConfig:
    """What is fitted and how. ``numeric`` is ``None`` (categorical triples only), ``interp`` or
    ``bins``; ``model`` is ``translation``, ``bilinear``, ``relation_scaled`` or ``dot``; ``draws`` of negatives are
    uniform over a relation's ``members``, or tails by ``frequency`` (to the power 0.75)."""

    model: str = "relation_scaled"
    dim: int = 200
    numeric: str | None = None
    transformer: str | None = "quantile"
    activation: str | None = "relu"
    n_bins: int = 20
    loss: str = "softplus"
    margin: float = 4.0
    p: int = 1
    negatives: int = 10
    lr: float = 1e-3
    draws: str = "members"
    batch_size: int = 100_000
    seed: int = 0

    @property
    def biased(self) -> bool:
        return self.model == "relation_scaled"

    @property
    def width(self) -> int:
        """Numbers per entity: the vector and, where used, its two biases."""
        return self.dim + 2 * self.biased

    @property
    def relation_width(self) -> int:
        return 2 * self.dim if self.biased else self.dim

    @property
    def number_width(self) -> int:
        return (2 * self.dim if self.numeric == "interp" else 0) + self.biased


# --- preparation -------------------------------------------------------------------------------


def training_rows(triples: DataFrame, config: FitConfig) -> DataFrame:
    """Positives ``(pos_id, head, rel, kind, tail_id, tail_val)``, copies kept, numeric tails
    scaled; with ``bins`` a numeric tail becomes the negative id of its bin."""
    cat = triples.filter("kind = 'cat'").select("head", "rel", "kind", "tail_id", F.lit(None).cast("double").alias("tail_val"))
    rows = cat
    if config.numeric:
        x = scale_values(triples, config.transformer)
        if config.numeric == "bins":
            tail = -1 - bin_row(F.col("x"), F.col("rel"), config.n_bins)
            num = x.select("head", "rel", "kind", tail.alias("tail_id"), F.lit(None).cast("double").alias("tail_val"))
        else:
            num = x.select("head", "rel", "kind", F.lit(None).cast("long").alias("tail_id"), F.col("x").alias("tail_val"))
        rows = cat.unionByName(num)
    key = ["head", "rel", "kind", "tail_id", "tail_val"]
    copies = number_copies(rows.select(*key), "_copy")
    pos_id = md5int(F.lit(config.seed), "head", "rel", "tail_id", "tail_val", "_copy")
    return copies.select(pos_id.alias("pos_id"), *key)


def batch_count(n: int, config: FitConfig) -> int:
    return max(1, -(-n // config.batch_size))


def start_params(rows: DataFrame, config: FitConfig) -> DataFrame:
    """Initial parameters of everything that occurs in the training rows."""
    ids = rows.select(F.explode(F.array("head", "tail_id")).alias("id")).filter("id is not null").distinct()
    how = {"translation": "xavier_uniform", "bilinear": "xavier_uniform", "dot": "xavier_uniform"}.get(config.model, "normal")
    vec = random_vector(F.col("id"), config.dim, how, config.seed, "ent")
    if config.model in ("translation", "bilinear"):
        vec = V.let(vec, _unit_length)
    if config.biased:
        vec = F.concat(vec, F.array(F.lit(0.0), F.lit(0.0)))
    parts = [ids.select(F.lit(ENTITY).alias("kind"), "id", vec.alias("vec"))]
    rels = rows.select(F.col("rel").cast("long").alias("id"), "kind").distinct()
    rel_how = {"translation": "xavier_uniform", "bilinear": "xavier_normal"}.get(config.model, "normal")
    rel_vec = random_vector(F.col("id"), config.dim, rel_how, config.seed, "rel")
    if config.model in ("translation", "bilinear"):
        rel_vec = V.let(rel_vec, _unit_length)
    if config.biased:  # offset, then diagonal uniform in (-1, 1)
        places = F.sequence(F.lit(0), F.lit(config.dim - 1))
        rel_vec = F.concat(
            rel_vec, F.transform(places, lambda i: 2 * unit(F.lit(config.seed), F.lit("diag"), F.col("id"), i) - 1)
        )
    parts.append(rels.select(F.lit(RELATION).alias("kind"), "id", rel_vec.alias("vec")))
    if config.numeric and config.number_width:
        number_how = {"translation": "xavier_uniform", "bilinear": "xavier_normal"}.get(config.model, "normal")
        cells = F.array().cast("array<double>")
        if config.numeric == "interp":
            cells = F.concat(
                random_vector(F.col("id"), config.dim, number_how, config.seed, "e1"),
                random_vector(F.col("id"), config.dim, number_how, config.seed, "e2"),
            )
        if config.biased:
            cells = F.concat(cells, F.array(F.lit(0.0)))
        parts.append(rels.filter("kind = 'num'").select(F.lit(NUMBER).alias("kind"), "id", cells.alias("vec")))
    zeros = F.transform("vec", lambda _: F.lit(0.0))
    params = parts[0]
    for part in parts[1:]:
        params = params.unionByName(part)
    return params.select("kind", "id", *[c.cast("array<float>").alias(n) for c, n in ((F.col("vec"), "vec"), (zeros, "m"), (zeros, "v"))])


def _unit_length(vec: Column) -> Column:
    return V.scale(vec, 1 / F.greatest(V.p_norm(vec, 2), F.lit(1e-12)))


def frequency_candidates(rows: DataFrame) -> DataFrame:
    """``(place, low, high, cand_id)``: the tails on a line, each as long as its count to the power 0.75 (in
    thousandths), cut into as many places of equal width as there are tails.

    A draw is a point of the line: an equi-join on its place and a comparison give the tail, so a draw costs
    two rows on average, whatever the frequencies are.
    """
    counts = rows.groupBy(F.col("tail_id").alias("cand_id")).agg(F.count(F.lit(1)).alias("n"))
    weights = counts.select(F.lit(0).alias("one"), "cand_id", F.round(F.pow("n", F.lit(0.75)) * 1000).cast("long").alias("weight"))
    line = pin(running_totals(weights, ["one"], ["cand_id"], {"high": "weight"}))
    line = line.withColumn("low", F.col("high") - F.col("weight"))
    width = F.ceil(F.col("high_total") / F.lit(max(1, line.count()))).cast("long")
    places = F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))
    return line.select(F.explode(places).alias("place"), "low", "high", "cand_id", width.alias("width"), F.col("high_total").alias("total"))


# --- one batch ---------------------------------------------------------------------------------


def batch_slots(positives: DataFrame, candidates: DataFrame, choices: DataFrame, config: FitConfig, epoch: int) -> DataFrame:
    """``(pos_id, head, rel, kind, slot, side, id, x)``: head (slot 0), tail (slot 1) and the drawn
    replacements (slots 2…) of every positive; ``side`` tells what a draw replaces."""
    slot = lambda number, side, id_, x: F.struct(
        number.cast("int").alias("slot"), side.cast("int").alias("side"), id_.alias("id"), x.alias("x")
    )
    null = F.lit(None).cast("double")
    base = ["pos_id", "head", "rel", "kind"]
    own = positives.select(
        *base,
        F.inline(
            F.array(
                slot(F.lit(0), F.lit(0), F.col("head"), null),
                slot(F.lit(1), F.lit(1), F.col("tail_id"), F.col("tail_val")),
            )
        ),
    )
    each = positives.select(*base, F.explode(F.sequence(F.lit(0), F.lit(config.negatives - 1))).alias("k"))
    if config.draws == "frequency":
        total, width = choices.first()
        point = draw(F.lit(total), F.lit(config.seed), F.lit(epoch), "pos_id", "k")
        drawn = (
            each.withColumn("_point", point)
            .withColumn("place", F.floor(F.col("_point") / F.lit(width)))
            .join(candidates, "place")
            .filter("low <= _point and _point < high")
            .withColumns({"side": F.lit(1), "cand_val": null})
        )
    else:
        drawn = (
            each.join(broadcast_if_small(choices, 64), "rel")
            .withColumn("position", draw(F.col("n_choices"), F.lit(config.seed), F.lit(epoch), "pos_id", "k"))
            .join(candidates, ["rel", "position"])
        )
    return own.unionByName(
        drawn.select(
            *base,
            (F.col("k") + 2).cast("int").alias("slot"),
            F.col("side").cast("int").alias("side"),
            F.col("cand_id").alias("id"),
            F.col("cand_val").alias("x"),
        )
    )


def grouped_positives(slots: DataFrame, groups: int, keep: Sequence[str] = (), n_slots: int | None = None) -> DataFrame:
    """``(grp, pos_id, rel, numeric, s)``: one row for each positive with its ``n_slots`` slots (counted if not given),
    as ids, dealt into groups; ``keep`` names further columns that depend on the positive."""
    if n_slots is None:
        n_slots = (slots.agg(F.max("slot")).first()[0] or 0) + 1
    # a slot comes once: plain columns are aggregated without lists of structs
    cells = [F.max(F.when(F.col("slot") == i, F.col(c))).alias(f"_{c}{i}") for i in range(n_slots) for c in ("side", "id", "x")]
    rows = slots.groupBy(*keep, "pos_id", "rel", "kind").agg(*cells)
    entry = lambda i: F.struct(F.lit(i).alias("slot"), *[F.col(f"_{c}{i}").alias(c) for c in ("side", "id", "x")])
    rows = rows.withColumn("s", F.array(*[entry(i) for i in range(n_slots)]))
    return rows.select(
        F.pmod(F.xxhash64("pos_id"), F.lit(groups)).cast("int").alias("grp"),
        "pos_id",
        F.col("rel").cast("long").alias("rel"),
        (F.col("kind") == "num").alias("numeric"),
        "s",
        *keep,
    )


def store_epoch_slots(
    positives: DataFrame, candidates: DataFrame, choices: DataFrame, config: FitConfig, epoch: int, batches: int, groups: int, path: str
) -> None:
    """Store ``grouped_positives`` of an epoch, a folder for each batch that ``positives`` has rows of.

    One pass over candidates and positives for all these steps; a batch is cut into ``BATCH_PARTS`` files.
    """
    batch = F.pmod(F.col("pos_id"), F.lit(batches)).cast("int")
    part = F.pmod(F.xxhash64("pos_id"), F.lit(BATCH_PARTS)).cast("int")
    slots = batch_slots(positives, candidates, choices, config, epoch).withColumns({"batch": batch, "part": part})
    rows = grouped_positives(slots.repartition("batch", "part"), groups, ["batch", "part"], config.negatives + 2)
    rows.drop("part").write.mode("overwrite").partitionBy("batch").parquet(path)


def group_vectors(rows: DataFrame, params: DataFrame, config: FitConfig, buckets: int | None = None) -> DataFrame:
    """``(grp, kind, id, vec)``: every parameter that a group needs, once. ``buckets``: how many ``params`` has; what is
    needed then moves once, to them, and neither side is sorted or sent to all tasks."""
    need = [F.transform("s", lambda e: F.struct(F.lit(ENTITY).alias("kind"), e["id"].alias("id")))]
    need.append(F.array(F.struct(F.lit(RELATION).alias("kind"), F.col("rel").alias("id"))))
    if config.numeric and config.number_width:
        need.append(F.array(F.struct(F.lit(NUMBER).alias("kind"), F.when(F.col("numeric"), F.col("rel")).alias("id"))))
    wanted = rows.select("grp", F.inline(F.concat(*need))).filter("id is not null")
    wanted = wanted.repartition(buckets, "kind", "id").distinct().hint("shuffle_hash") if buckets else wanted.distinct()
    return wanted.join(params.select("kind", "id", "vec"), ["kind", "id"]).select(F.col("grp").alias("grp"), "kind", "id", "vec")


def score_and_slopes(model: str, p: int, h, r, t):
    """Scores and their derivatives by head, relation and tail, for arrays of triples.

    Shapes: ``h`` and ``t`` (n, j, width), ``r`` (n, 1, relation width).
    """
    d = r.shape[-1] // 2 if model == "relation_scaled" else r.shape[-1]
    if model == "translation":
        gap = h + r - t
        if p == 1:
            return -np.abs(gap).sum(-1), -np.sign(gap), -np.sign(gap), np.sign(gap)
        norm = np.sqrt((gap * gap).sum(-1, keepdims=True))
        slope = -np.divide(gap, norm, out=np.zeros_like(gap), where=norm > 0)
        return -norm[..., 0], slope, slope, -slope
    if model == "bilinear":
        return (h * r * t).sum(-1), r * t, h * t, h * r
    if model == "dot":
        return (h * t).sum(-1), t + 0 * h, np.zeros_like(h), h + 0 * t
    offset, diag = r[..., :d], r[..., d:]
    gap = diag * h[..., :d] - t[..., :d] + offset
    score = -(gap * gap).sum(-1) + h[..., d] + t[..., d + 1]
    one, zero = np.ones_like(score)[..., None], np.zeros_like(score)[..., None]
    dh = np.concatenate([-2 * gap * diag, one, zero], -1)
    dt = np.concatenate([2 * gap, zero, one], -1)
    return score, dh, np.concatenate([-2 * gap, -2 * gap * h[..., :d]], -1), dt


def loss_and_slopes(loss: str, margin: float, scores):
    """Summed loss and its derivative by score; column 0 is the positive."""
    if loss == "softplus":
        signs = np.ones_like(scores)
        signs[:, 0] = -1
        z = signs * scores
        return np.logaddexp(0, z).sum(), signs / (1 + np.exp(-z))
    gap = margin + scores[:, 1:] - scores[:, :1]
    active = (gap > 0).astype(float)
    return (gap * active).sum(), np.concatenate([-active.sum(1, keepdims=True), active], 1)


def number_vectors(x, weights, dim: int, activation: str | None):
    """Interpolated vectors of values ``x`` (n, j) under ``weights`` (n, >= 2 dim), and where they
    pass a gradient on."""
    e1, e2 = weights[:, None, :dim], weights[:, None, dim : 2 * dim]
    raw = x[..., None] * e1 + (1 - x[..., None]) * e2
    if activation == "relu":
        return np.maximum(raw, 0), (raw > 0).astype(float)
    if activation == "sigmoid":
        out = 1 / (1 + np.exp(-raw))
        return out, out * (1 - out)
    if activation == "tanh":
        out = np.tanh(raw)
        return out, 1 - out * out
    return raw, np.ones_like(raw)


def _summed(ids: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    ids, grads = ids[order], grads[order]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return ids[starts], np.add.reduceat(grads, starts, axis=0)


def chunk_gradients(config: FitConfig, rel, numeric, ids, sides, xs, vecs, rel_vec, num_vec):
    """Summed gradients ``[(kind, ids, grads)]`` of a chunk of positives with their negatives."""
    d, w, last = config.dim, config.width, config.number_width - 1
    tails = (sides == 1) & numeric[:, None]  # slots that hold a numeric tail
    passes = None
    if config.numeric == "interp" and numeric.any():
        made, passes = number_vectors(xs, num_vec, d, config.activation)
        vecs = vecs.copy()
        vecs[..., :d] = np.where(tails[..., None], made, vecs[..., :d])
    if config.biased and config.numeric and numeric.any():
        bias = np.where(tails[..., None], num_vec[:, None, last : last + 1], vecs[..., d:])
        vecs = np.concatenate([vecs[..., :d], bias], -1)
    # triple 0 is the positive; triple j replaces one side by slot j + 1
    head_kept = np.concatenate([np.ones((len(ids), 1), bool), sides[:, 2:] == 1], 1)[..., None]
    drawn = np.concatenate([vecs[:, :1], vecs[:, 2:]], 1)
    tail_kept = np.concatenate([np.ones((len(ids), 1), bool), sides[:, 2:] == 0], 1)[..., None]
    h = np.where(head_kept, vecs[:, :1], drawn)
    t = np.where(tail_kept, vecs[:, 1:2], drawn)
    scores, dh, dr, dt = score_and_slopes(config.model, config.p, h, rel_vec[:, None, :], t)
    total, slope = loss_and_slopes(config.loss, config.margin, scores)
    slope = slope[..., None]
    dh, dr, dt = dh * slope, (dr * slope).sum(1), dt * slope
    by_slot = np.concatenate(
        [
            (dh * head_kept).sum(1, keepdims=True),
            (dt * tail_kept).sum(1, keepdims=True),
            (dh * ~head_kept + dt * ~tail_kept)[:, 1:],
        ],
        1,
    )
    out = [(LOSS, np.array([0]), np.array([[total]])), (RELATION, *_summed(rel, dr))]
    if config.numeric and config.number_width and numeric.any():
        parts = []
        if config.numeric == "interp":
            g = by_slot[..., :d] * passes * tails[..., None]
            parts += [(g * xs[..., None]).sum(1), (g * (1 - xs[..., None])).sum(1)]
        if config.biased:
            parts.append((by_slot[..., d:].sum(-1) * tails).sum(1)[:, None])
        out.append((NUMBER, *_summed(rel[numeric], np.concatenate(parts, 1)[numeric])))
    if config.numeric == "bins" and config.biased:  # a bin has no bias of its own
        by_slot[..., d:] *= ~tails[..., None]
    own = np.ones(ids.shape, bool) if config.numeric == "bins" else ~tails
    out.append((ENTITY, *_summed(ids[own], by_slot[own].reshape(-1, w))))
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, width: int, dtype=np.float32) -> np.ndarray:
    """Rows of a column of lists, or of bytes that hold numbers of ``dtype``; there are no nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_binary(column.type):
        if not len(column):
            return np.zeros((0, width))
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        held = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        return held.view(dtype).astype(float).reshape(len(column), width)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _group_gradients(config: FitConfig, step: int):
    """Gradients of one group's positives, summed for each parameter; the loss has the step as its id."""
    slots = config.negatives + 2

    def run(positives: pa.Table, vectors: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(positives.column("pos_id"))
        positives = positives.take(order).combine_chunks()
        n = positives.num_rows
        kinds = vectors.column("kind").to_numpy()
        widths = {ENTITY: config.width, RELATION: config.relation_width, NUMBER: config.number_width}
        ids, values, sums = {}, {}, {LOSS: np.zeros((1, 1))}
        for kind, width in widths.items():
            own = vectors.filter(pa.array(kinds == kind)).sort_by("id")
            ids[kind], values[kind] = own.column("id").to_numpy(), _matrix(own.column("vec"), width)
            sums[kind] = np.zeros(values[kind].shape)
            # what a slot without entity, or a relation without numbers, is looked up as
            values[kind] = np.vstack([values[kind], np.zeros((1, width))])
        cells = positives.column("s").combine_chunks().flatten()
        known = ~cells.field("id").is_null().to_numpy(zero_copy_only=False).reshape(n, slots)
        entity = cells.field("id").fill_null(0).to_numpy().reshape(n, slots)
        sides = cells.field("side").to_numpy().reshape(n, slots)
        xs = cells.field("x").fill_null(0.0).to_numpy(zero_copy_only=False).reshape(n, slots)
        rel = positives.column("rel").to_numpy()
        numeric = positives.column("numeric").to_numpy().astype(bool)
        place = np.where(known, np.searchsorted(ids[ENTITY], entity), len(ids[ENTITY]))
        rel_at = np.searchsorted(ids[RELATION], rel)
        has_number = np.isin(rel, ids[NUMBER])
        num_at = np.where(has_number, np.searchsorted(ids[NUMBER], rel), len(ids[NUMBER]))
        size = max(1, CELLS_AT_ONCE // (slots * config.width))
        for i in range(0, n, size):
            cut = slice(i, i + size)
            for kind, keys, grads in chunk_gradients(
                config, rel[cut], numeric[cut], entity[cut], sides[cut], xs[cut],
                values[ENTITY][place[cut]], values[RELATION][rel_at[cut]], values[NUMBER][num_at[cut]],
            ):
                sums[kind][keys if kind == LOSS else np.searchsorted(ids[kind], keys)] += grads
        ids[LOSS] = np.array([step])
        made = []
        for kind, grads in sums.items():
            columns = [pa.array(np.full(len(grads), kind, np.int32)), pa.array(ids[kind].astype(np.int64)), _bytes(grads)]
            made.append(pa.table(columns, names=["kind", "id", "grad"]))
        return pa.concat_tables(made)

    return run


def batch_gradients(rows: DataFrame, params: DataFrame, config: FitConfig, step: int, buckets: int | None = None) -> DataFrame:
    """``(kind, id, grad)``: one summed gradient from each group for each parameter that the group uses, its doubles as bytes."""
    vectors = group_vectors(rows, params, config, buckets)
    return rows.groupBy("grp").cogroup(vectors.groupBy("grp")).applyInArrow(
        _group_gradients(config, step), "kind int, id long, grad binary"
    )


def _lists(values: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.float32).ravel()))


def _bytes(values: np.ndarray) -> pa.BinaryArray:
    ends = np.arange(len(values) + 1, dtype=np.int32) * (values.shape[1] * values.itemsize)
    held = np.ascontiguousarray(values)
    return pa.BinaryArray.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(held)])


def _recoded(schema: str, recode):
    """Columns ``vec``, ``m``, ``v`` of every batch through ``recode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [recode(batch.column(c)) if c in ("vec", "m", "v") else batch.column(c) for c in ("kind", "id", "vec", "m", "v")]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "id", "vec", "m", "v"])

    return lambda params: params.select("kind", "id", "vec", "m", "v").mapInArrow(run, schema)


def _list_to_bytes(column: pa.ListArray) -> pa.BinaryArray:
    ends = column.offsets.to_numpy().astype(np.int32)
    held = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype(np.float32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(column), [None, pa.py_buffer((ends - ends[0]) * 4), pa.py_buffer(held)])


def _bytes_to_list(column: pa.BinaryArray) -> pa.ListArray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(np.float32)
    return pa.ListArray.from_arrays(pa.array((ends - ends[0]) // 4), pa.array(held))


packed = _recoded(STATE_SCHEMA, _list_to_bytes)
unpacked = _recoded(PARAM_SCHEMA, _bytes_to_list)


def _moved(config: FitConfig, step: int, entries: int, epoch: int, as_bytes: bool = False):
    """Next state of parameters that come in the order of their keys, once for each of their gradients."""
    made = (lambda values: _bytes(values.astype(np.float32))) if as_bytes else _lists
    rate, scale = config.lr / (1 - BETA1**step), (1 - BETA2**step) ** 0.5

    def moved(rows: pa.Table, kind: int) -> pa.RecordBatch:
        ids = rows.column("id").to_numpy()
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        known = pa.compute.is_valid(rows.column("grad")).to_numpy(zero_copy_only=False)
        first = rows.take(pa.array(starts))
        old = pa.compute.is_valid(first.column("vec")).to_numpy(zero_copy_only=False)
        if kind == LOSS:  # a stored loss has no gradient, a new one no state
            sums = np.zeros((len(ids), 1))
            sums[known] = _matrix(rows.column("grad").filter(pa.array(known)), 1, float)
            vec, m = np.add.reduceat(sums, starts, axis=0) / entries, np.full((len(starts), 1), float(epoch))
            vec[old], m[old] = (_matrix(first.column(c).filter(pa.array(old)), 1) for c in ("vec", "m"))
            v = np.zeros((len(starts), 0))
        else:
            width = {ENTITY: config.width, RELATION: config.relation_width, NUMBER: config.number_width}[kind]
            grads = np.zeros((len(ids), width))
            grads[known] = _matrix(rows.column("grad").filter(pa.array(known)), width, float)
            g = np.add.reduceat(grads, starts, axis=0) / entries
            vec, m, v = (_matrix(first.column(c), width) for c in ("vec", "m", "v"))
            m, v = BETA1 * m + (1 - BETA1) * g, BETA2 * v + (1 - BETA2) * g * g
            vec = vec - rate * m / (np.sqrt(v) / scale + EPSILON)
            if kind == ENTITY and config.model in ("translation", "bilinear"):
                bounded = (ids[starts] >= 0)[:, None]
                length = np.sqrt((vec * vec).sum(1, keepdims=True))
                vec = np.where(bounded, vec / np.maximum(length, 1e-12), vec)
        columns = [pa.array(np.full(len(starts), kind, np.int32)), pa.array(ids[starts]), *map(made, (vec, m, v))]
        return pa.RecordBatch.from_arrays(columns, ["kind", "id", "vec", "m", "v"])

    def by_kind(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        kinds = rows.column("kind").to_numpy()
        for kind in np.unique(kinds):
            yield moved(rows.filter(pa.array(kinds == kind)), int(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last key, of which the next batch may have more
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("kind", "id")]
            last = (keys[0] == keys[0][-1]) & (keys[1] == keys[1][-1])
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            same = held and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in ("kind", "id"))
            if held and not same:
                yield from by_kind(pa.Table.from_batches(held))
                held = []
            if cut:
                yield from by_kind(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from by_kind(pa.Table.from_batches(held))

    return run


def adam_update(params: DataFrame, gradients: DataFrame, config: FitConfig, step: int, entries: int, epoch: int) -> DataFrame:
    """Next generation: every row moves by Adam (rows without gradient by their moments alone);
    the batch loss is added as a row of kind LOSS, whose id is the step and whose ``m`` holds the epoch."""
    # Only losses are new; the outer join leaves every parameter in its bucket, beside the gradients of all groups.
    both = params.join(gradients.hint("shuffle_hash"), ["kind", "id"], "full").select("kind", "id", "vec", "m", "v", "grad")
    as_bytes = dict(params.dtypes)["vec"] == "binary"
    moved = _moved(config, step, entries, epoch, as_bytes)
    return both.sortWithinPartitions("kind", "id").mapInArrow(moved, STATE_SCHEMA if as_bytes else PARAM_SCHEMA)


# --- the fit -----------------------------------------------------------------------------------


def bucket_count(spark: SparkSession, rows: int, width: int) -> int:
    """Buckets for so many parameters: one for each core, more where a bucket would exceed ``BUCKET_BYTES``."""
    return max(spark.sparkContext.defaultParallelism, -(-rows * (12 * width + 32) // BUCKET_BYTES))


class Generations:
    """Generations of parameters as tables in buckets of (kind, id), two at a time, in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder, self.number = spark, folder, 0
        self.name = f"fit_{uuid.uuid4().hex}"
        self.buckets = buckets or spark.sparkContext.defaultParallelism

    def _table(self, number: int) -> str:
        return f"{self.name}_{number % 2}"

    def write(self, params: DataFrame) -> None:
        """Store the next generation, whose rows lie in buckets already; the one before the last is dropped."""
        self.number += 1
        table = self._table(self.number)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        if dict(params.dtypes)["vec"] != "binary":  # packed before the shuffle, so that the rows stay in their buckets
            params = packed(params).repartition(self.buckets, "kind", "id")
        params.write.mode("overwrite").bucketBy(self.buckets, "kind", "id").option(
            "path", f"{self.folder}/generation{self.number % 2}"
        ).saveAsTable(table)

    def read(self) -> DataFrame:
        return self.spark.table(self._table(self.number))

    def close(self) -> DataFrame:
        """The last generation as parameters, by its path; the catalogue entries are dropped (the files stay)."""
        for number in (0, 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(number)}")
        return unpacked(self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.folder}/generation{self.number % 2}"))


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARAM_SCHEMA).parquet(path)


def fit_vectors(
    triples: DataFrame,
    config: FitConfig,
    epochs: int,
    folder: str,
    config_id: str = "run",
    save_epochs: Sequence[int] = (),
    resume: bool = True,
) -> DataFrame:
    """Fit and return the parameters after ``epochs`` epochs.

    Working tables and stored epochs go to ``folder``, which all executors share. A stored epoch
    of the same ``config_id`` at or below ``epochs`` is continued from. Two generations of
    parameters exist at a time, so a lost executor only repeats the step in progress. Batches hold about
    ``config.batch_size`` positives each; negatives are drawn for as many batches at once as have ``SLOTS_AT_ONCE`` slots.
    """
    spark = triples.sparkSession
    work = f"{folder}/work/{config_id}"
    rows = pin(training_rows(triples, config))
    distinct = [F.approx_count_distinct(c).alias(c) for c in ("head", "tail_id")]
    size = rows.agg(F.count(F.lit(1)).alias("n"), *distinct).first()
    n_batches = batch_count(size["n"], config)
    positives = rows.withColumn("batch", F.pmod(F.col("pos_id"), F.lit(n_batches)).cast("int"))
    drawn = frequency_candidates(positives) if config.draws == "frequency" else corruption_candidates(positives)
    drawn.write.mode("overwrite").parquet(f"{work}/candidates")
    candidates = spark.read.parquet(f"{work}/candidates")
    if config.draws == "frequency":
        choices, candidates = candidates.select("total", "width").limit(1), candidates.drop("total", "width")
    else:
        choices = candidates.groupBy("rel").agg(F.count(F.lit(1)).alias("n_choices"))
    # one row per batch: as many as steps in an epoch
    sizes = {r["batch"]: r["count"] for r in positives.groupBy("batch").count().collect()}
    per_positive = config.negatives + (1 if config.loss == "softplus" else 0)

    done = stored_epoch(spark, folder, config_id, epochs) if resume else 0
    state = Generations(spark, work, bucket_count(spark, size["head"] + size["tail_id"], config.width))
    state.write(load_params(spark, folder, config_id, done) if done else start_params(positives, config))
    step, batches = done * len(sizes), sorted(sizes)
    slots_each = max(sizes.values(), default=0) * (config.negatives + 2)
    groups = max(spark.sparkContext.defaultParallelism, -(-slots_each // SLOTS_PER_GROUP))
    at_once, passed = max(1, SLOTS_AT_ONCE // max(1, slots_each)), 0
    for epoch in range(done + 1, epochs + 1):
        for first in range(0, len(batches), at_once):
            some = batches[first : first + at_once]
            own = positives if len(some) == len(batches) else positives.filter(F.col("batch").between(some[0], some[-1]))
            store_epoch_slots(own.drop("batch"), candidates, choices, config, epoch, n_batches, groups, f"{work}/slots")
            for batch in some:
                step += 1
                params = state.read()
                slots = spark.read.schema(SLOT_SCHEMA).parquet(f"{work}/slots/batch={batch}")
                gradients = batch_gradients(slots, params, config, step, state.buckets)
                entries = sizes[batch] * per_positive
                state.write(adam_update(params, gradients, config, step, entries, epoch))
                passed += slots_each
                if passed > SLOTS_AT_ONCE // 4:
                    del params, slots, gradients
                    drop_finished(spark)
                    passed = 0
        if epoch in save_epochs:
            save_params(unpacked(state.read()), folder, config_id, epoch)
    return state.close()


def epoch_loss(params: DataFrame, config: FitConfig, n_triples: int) -> DataFrame:
    """``(epoch, loss)``: the batch losses of an epoch over the number of training triples."""
    losses = params.filter(F.col("kind") == LOSS)
    return losses.groupBy(F.col("m")[0].cast("int").alias("epoch")).agg(
        (F.sum(F.col("vec")[0].cast("double")) / n_triples).alias("loss")
    )


def save_params(params: DataFrame, folder: str, config_id: str, epoch: int) -> None:
    """Store an epoch, then list it in the catalogue."""
    spark = params.sparkSession
    params.write.mode("overwrite").parquet(f"{folder}/params/config_id={config_id}/epoch={epoch}")
    row = spark.createDataFrame([(config_id, epoch)], "config_id string, epoch int")
    row.coalesce(1).write.mode("append").parquet(f"{folder}/catalogue")


def checkpoint_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """``(config_id, epoch)`` of every stored epoch."""
    path = f"{folder}/catalogue"
    if not path_exists(spark, path):
        return spark.createDataFrame([], "config_id string, epoch int")
    return spark.read.schema("config_id string, epoch int").parquet(path).distinct()


def stored_epoch(spark: SparkSession, folder: str, config_id: str, epoch: int) -> int:
    from factloom.operators.runs import resume_epoch

    return resume_epoch(checkpoint_catalogue(spark, folder), config_id, epoch).first()["epoch"]


def load_params(spark: SparkSession, folder: str, config_id: str, epoch: int) -> DataFrame:
    return _read(spark, f"{folder}/params/config_id={config_id}/epoch={epoch}")


def export_vectors(params: DataFrame, config: FitConfig) -> DataFrame:
    """``(entity_id, vec)`` without biases and bins."""
    ents = params.filter((F.col("kind") == ENTITY) & (F.col("id") >= 0))
    return ents.select(F.col("id").alias("entity_id"), F.slice("vec", 1, config.dim).cast("array<double>").alias("vec"))


# --- skip-gram on tables -----------------------------------------------------------------------


def skipgram_triples(walks: DataFrame, words: DataFrame, window: int) -> DataFrame:
    """(centre, context) pairs within a window as triples of one relation; a word has one id as
    centre and another as context. Pairs are bounded by walk length times window."""
    # words become numbers once for each place of a walk, not for each pair
    numbered = pin(walks.select("walk").withColumn("_walk", F.monotonically_increasing_id()))
    places = numbered.select("_walk", F.posexplode("walk").alias("_place", "word")).join(words.select("word", "word_id"), "word", "left")
    # a walk is a few words long; one that is not in ``words`` keeps its place
    ordered = F.array_sort(F.collect_list(F.struct("_place", "word_id")))
    coded = places.groupBy("_walk").agg(F.transform(ordered, lambda x: x["word_id"]).alias("walk"))
    size = F.size("walk")
    pairs = F.flatten(
        F.transform(
            "walk",
            lambda word, i: F.transform(
                F.filter(
                    F.sequence(F.greatest(i - window, F.lit(0)), F.least(i + window, size - 1)), lambda j: j != i
                ),
                lambda j: F.struct(word.alias("centre_id"), F.get(F.col("walk"), j).alias("context_id")),
            ),
        )
    )
    return (
        coded.select(F.inline(pairs))
        .filter("centre_id is not null and context_id is not null")
        .select(
            (F.col("centre_id") * 2).alias("head"),
            F.lit(0).alias("rel"),
            F.lit("cat").alias("kind"),
            (F.col("context_id") * 2 + 1).alias("tail_id"),
            F.lit(None).cast("double").alias("tail_val"),
        )
    )


def subsampled(walks: DataFrame, sample: float, seed: int) -> DataFrame:
    """Walks without some occurrences of frequent words: one of a share ``f`` stays with the
    probability ``sqrt(sample / f) + sample / f``. The draw depends on the walk's words, its copy's number and the place."""
    numbered = number_copies(walks.select("walk"), "_copy").withColumn("_walk", F.xxhash64("walk", "_copy"))
    tokens = pin(numbered.select("_walk", "_copy", F.hash("walk").alias("_hash"), F.posexplode("walk").alias("_place", "word")))
    total = tokens.count()
    counts = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") / F.lit(float(max(1, total)))
    chance = F.sqrt(sample / share) + sample / share
    kept = tokens.join(counts, "word").filter(unit(F.lit(seed), F.lit("keep"), "_walk", "_place") < chance)
    # a walk is a few words long
    words = F.array_sort(F.collect_list(F.struct("_place", "word")))
    whole = kept.groupBy("_walk", "_copy", "_hash").agg(words.alias("_words"))
    return whole.select(F.transform("_words", lambda x: x["word"]).alias("walk"))


def fit_skipgram_vectors(
    walks: DataFrame,
    size: int,
    epochs: int,
    seed: int,
    folder: str,
    window: int = 5,
    negatives: int = 5,
    lr: float = 0.025,
    sample: float | None = None,
    batch_size: int = 1_000_000,
) -> DataFrame:
    """``(word, vec)`` by skip-gram with negative sampling, for vocabularies of any size.

    Negatives are drawn by frequency to the power 0.75; with ``sample`` frequent words are thinned out. Every word
    of the walks gets a vector, also one that thinning leaves in no pair: its initial one.
    """
    words = pin(dense_ids(walks.select(F.explode("walk").alias("word")).distinct(), "word", "word_id"))
    config = FitConfig(model="dot", dim=size, negatives=negatives, lr=lr, draws="frequency", batch_size=batch_size, seed=seed)
    thinned = walks if sample is None else subsampled(walks, sample, seed)
    params = fit_vectors(skipgram_triples(thinned, words, window), config, epochs, folder, "skipgram", resume=False)
    vectors = export_vectors(params, config).filter("entity_id % 2 = 0").withColumnRenamed("entity_id", "_id")
    first = random_vector(F.col("word_id") * 2, size, "xavier_uniform", seed, "ent")
    joined = words.join(vectors, F.col("_id") == F.col("word_id") * 2, "left")
    return joined.select("word", F.coalesce("vec", first).alias("vec"))
