"""Quality rules: zstandard ratios of whole documents and of their chunks inside length-specific bands.

A repetitive text compresses too well, random text hardly at all. Both limits depend on the
length, since short inputs pay the frame header and long ones find more to refer to. They come from
the ratios of all documents that pass the word rules, by classes of half an octave of length: the median, and a width of
``TAILS`` median deviations that is neither below nor above its bounds. Medians stay put until junk makes up half of
a class. Every class is blended with its neighbours and with a fixed curve by numbers of documents, so that a small
class, or a small corpus, is judged by the same rule as a large one. Fixed outer bands hold everywhere; their floors
lie above what text in 64 symbols can reach.
Before the bands come plain word rules. Null and empty texts have no words and fail the word rules; copies
and ties are judged alike, as a document's verdict depends on its text only.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.text import WORD, per_document
from factloom.session import pin

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Upper end of the length in bytes, least and greatest ratio of the whole document.
BANDS = (
    (256, 1.1, 4.0),
    (512, 1.2, 4.0),
    (1024, 1.32, 4.0),
    (4096, 1.38, 4.5),
    (16384, 1.38, 5.0),
    (float("inf"), 1.38, 6.0),
)
CHUNK = 2048
LEAST_CHUNK = 128
# For chunks of half size on.
CHUNK_BAND = (1.38, 6.0)
LEVEL = 3
# Median deviations of the logarithms of ratios between median and limit, and the least and greatest factor of the limit.
LOW_TAIL = (12.0, 1.15, 1.3)
HIGH_TAIL = (12.0, 1.35, 1.6)
# Documents that the fixed curve, and neighbouring classes, count for, and the curve: ratio of prose in 128 bytes, its
# gain with each class, its end, and the median deviation.
PRIOR_WEIGHT = 20
PRIOR = (1.37, 0.09, 2.4, 0.03)
_STEPS = 500

_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
_RATIOS = "ratio double, low_chunk double, high_chunk double"
FIELDS = f"{_COUNTS}, kept boolean, {_RATIOS}"
_MEASURED = f"{_COUNTS}, {_RATIOS}, in_bands boolean, class int, parts array<struct<class:int,ratio:double>>"


def repeated_words(words: list[str]) -> int:
    """Words covered by three-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def chunks(data: bytes) -> list[bytes]:
    """Chunks of ``CHUNK`` bytes, the last one ending with the text; two halves of shorter texts."""
    n = len(data)
    if n < 2 * LEAST_CHUNK:
        return [data]
    size = min(CHUNK, (n + 1) // 2)
    return [data[i : i + size] for i in [*range(0, n - size, size), n - size]]


def size_class(length: int) -> int:
    return int(2 * math.log2(max(length, 1)))


def ratios(data: bytes, compressor) -> tuple[float, list[tuple[int, float]]]:
    """The whole ratio, and length and ratio of each chunk."""
    if not data:
        return 0.0, []
    whole = len(data) / len(compressor.compress(data))
    parts = chunks(data)
    if len(parts) == 1:
        return whole, [(len(data), whole)]
    return whole, [(len(part), len(part) / len(compressor.compress(part))) for part in parts]


def in_bands(length: int, whole: float, parts: list[tuple[int, float]]) -> bool:
    least, most = next((a, b) for end, a, b in BANDS if length < end)
    if not least <= whole <= most:
        return False
    return len(parts) == 1 or all(CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for n, r in parts if n >= CHUNK // 2)


def _judge(texts: list[str]):
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    out = []
    for text in texts:
        words = WORD.findall(text)
        repeats = repeated_words(words)
        failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
        data = text.encode()
        whole, parts = ratios(data, compressor)
        each = [r for _, r in parts] or [0.0]
        out.append((
            len(words), sum(map(len, words)), len(text) - len(text.translate(_SYMBOLS)),
            duplicate_lines(text), repeats, failed, whole, min(each), max(each), in_bands(len(data), whole, parts),
            size_class(len(data)), [{"class": size_class(n), "ratio": r} for n, r in parts],
        ))
    *columns, parts = zip(*out)
    kind = pa.list_(pa.struct([("class", pa.int32()), ("ratio", pa.float64())]))
    *plain, classes = columns
    return [*plain, pa.array(classes, pa.int32()), pa.array(parts, kind)]


def _centre(counts: Counter) -> tuple[float, float]:
    """Median and median deviation of the logarithms that ``counts`` holds in steps."""
    steps = np.array(sorted(counts), dtype=float)
    weights = np.array([counts[int(x)] for x in steps])

    def median(values: np.ndarray) -> float:
        order = np.argsort(values, kind="stable")
        ahead = np.cumsum(weights[order])
        return float(values[order][np.searchsorted(ahead, (ahead[-1] + 1) // 2)])

    middle = median(steps)
    return middle / _STEPS, median(np.abs(steps - middle)) / _STEPS


def class_limits(counts: dict[int, Counter]) -> dict[int, tuple[float, float]]:
    """Least and greatest ratio of each class, from its counts of ``round(_STEPS * ln(ratio))``."""
    size = {k: sum(c.values()) for k, c in counts.items()}
    centre = {k: np.array(_centre(c)) for k, c in counts.items()}
    first, gain, end, deviation = PRIOR
    out = {}
    for k in counts:
        total, weight = PRIOR_WEIGHT * np.array([math.log(min(end, first + gain * max(0, k - 14))), deviation]), PRIOR_WEIGHT
        for j in counts:
            if j != k:
                near = size[j] * 2.0 ** -abs(j - k)
                total, weight = total + near * centre[j], weight + near
        middle, spread = (size[k] * centre[k] + PRIOR_WEIGHT * total / weight) / (size[k] + PRIOR_WEIGHT)
        down, up = (min(max(n * spread, math.log(least)), math.log(most)) for n, least, most in (LOW_TAIL, HIGH_TAIL))
        out[k] = (math.exp(middle - down), math.exp(middle + up))
    return out


def limits(measured: DataFrame) -> tuple[dict[int, tuple[float, float]], dict[int, tuple[float, float]]]:
    """Limits of whole documents and of chunks; the counts reach the driver, some hundred for each of some sixty classes."""
    whole = F.array(F.struct(F.lit(0).alias("kind"), "class", "ratio"))
    parts = F.transform("parts", lambda x: F.struct(F.lit(1).alias("kind"), x["class"].alias("class"), x["ratio"].alias("ratio")))
    each = measured.filter("not base_failed").select(F.explode(F.concat(whole, parts)).alias("x")).select("x.*")
    found = each.groupBy("kind", "class", F.round(F.log("ratio") * _STEPS).cast("int").alias("step")).count().collect()
    counts = (defaultdict(Counter), defaultdict(Counter))
    for kind, k, step, n in found:
        counts[kind][k][step] += n
    return class_limits(counts[0]), class_limits(counts[1])


def _between(ratio: Column, of: Column, bounds: dict[int, tuple[float, float]]) -> Column:
    if not bounds:
        return F.lit(False)
    least, most = [F.create_map(*[F.lit(x) for k, v in sorted(bounds.items()) for x in (k, v[i])]) for i in (0, 1)]
    return F.coalesce(ratio.between(least[of], most[of]), F.lit(False))


def quality_rules(docs: DataFrame, carry, text: str = "text") -> DataFrame:
    """``row`` (the carried columns) with counts, ratios and the verdict ``kept`` of each document."""
    measured = pin(per_document(docs, _judge, _MEASURED, carry, text))
    of_whole, of_parts = limits(measured)
    kept = (
        ~F.col("base_failed")
        & F.col("in_bands")
        & _between(F.col("ratio"), F.col("class"), of_whole)
        & F.forall("parts", lambda x: _between(x["ratio"], x["class"], of_parts))
    )
    names = [name.split()[0] for name in FIELDS.split(", ")]
    return measured.withColumn("kept", kept).select("row", *names)


def passing(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that every rule keeps, with the columns they came with."""
    return quality_rules(docs, docs.columns, text).filter("kept").select("row.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs, ["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), *[
        name.split()[0] for name in FIELDS.split(", ")
    ])
