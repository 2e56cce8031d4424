r"""Personal data: pattern spans, and terms of the corpus that give protected values away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Each value found is a protected
entity, from its first text on. A term (a word, or words joined by hyphens, of any length; case does not
matter) that keeps company with an entity identifies it as well as the value does. With counts of
distinct texts over the whole corpus, so that copies count once, term ``t`` discloses entity ``e`` if the smoothed
posterior ``n(e, t) / n(t) * s / (s + SMOOTHING) >= MIN_POSTERIOR`` and ``t`` raises the odds of ``e`` by
``MIN_BITS`` bits. The evidence ``s`` is 1 for each text where ``t`` stands within ``NEAR`` characters of
``e`` and ``FAR_WEIGHT`` for each other text that holds both. Such terms are spans of kind ``term`` wherever
they occur, and ``sanitised`` replaces every span by the general name of its kind.

DataFrame functions only. A position is the running sum of the lengths of gaps and matches
before it, summed over one row per match, so texts may be long and full of matches.

Defined results: null texts are empty; texts without spans have zero counts, an empty span list and
the hash of the empty string; rows equal in id and text get equal results; a null id is an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import BROADCAST_BYTES, broadcast_if_small, pin

# Possessive and anchored forms of the contract's patterns: the same matches in linear time. A match
# starts where the run of its first class starts, or where the match before ended (\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
SMOOTHING = 0.25
NEAR = 40
FAR_WEIGHT = 0.25
MIN_POSTERIOR = 0.7
MIN_BITS = 1.0
BROADCAST_TERMS = BROADCAST_BYTES // 256

_BEFORE = r"(?<![\p{L}\p{M}\p{N}@._%+-])"
_AFTER = r"(?![\p{L}\p{M}\p{N}@_%+]|[.-][\p{L}\p{N}])"
TERM = _BEFORE + r"\p{L}[\p{L}\p{M}]*+(?:-\p{L}[\p{L}\p{M}]*+)*+" + _AFTER
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = F.translate(match, " -", "")
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _pieces(text: Column, pattern: Column) -> Column:
    """Gaps and the matches that follow them; the last gap is followed by null."""
    pairs = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)))
    return pairs.cast("array<struct<gap:string,match:string>>")


def _positions(rows: DataFrame, found: Column) -> DataFrame:
    """``doc_id, h, kind, match, start, stop, around`` from one array of pieces for each row.

    ``around`` is the text within ``NEAR`` characters before and after, with the match's ends, words cut
    off at the outer ends left out.
    """
    each = rows.select("doc_id", "h", F.explode(found).alias("x")).select("doc_id", "h", "x.*")
    once = each.groupBy("doc_id", "h", "kind", "i").agg(*[F.first(c).alias(c) for c in ("gap", "match", "head", "tail")])
    order = Window.partitionBy("doc_id", "h", "kind").orderBy("i")
    stop = F.sum(F.col("gap") + F.length("match")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = F.concat("tail", F.substring("match", 1, 1))
    after = F.concat(F.right("match", F.lit(1)), F.coalesce(F.lead("head").over(order), F.lit("")))
    return (
        once.withColumn("stop", stop)
        .withColumn("around", F.array(before, after))
        .filter("match is not null")
        .withColumn("start", F.col("stop") - F.length("match"))
        .drop("head", "tail")
    )


def _listed(kind: str, text: Column, pattern: Column) -> Column:
    k = F.lit(KINDS.index(kind))
    long = lambda x: F.length(x["gap"]) > NEAR
    head = lambda x: F.when(long(x), F.regexp_replace(F.left(x["gap"], F.lit(NEAR)), r"\S++$", "")).otherwise(x["gap"])
    tail = lambda x: F.when(long(x), F.regexp_replace(F.right(x["gap"], F.lit(NEAR)), r"^\S++", "")).otherwise(x["gap"])
    return F.transform(
        # The last gap stays where a match comes before it.
        F.filter(_pieces(text, pattern), lambda x, i: x["match"].isNotNull() | (i > 0)),
        lambda x, i: F.struct(
            k.alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["match"].alias("match"),
            head(x).alias("head"), tail(x).alias("tail"),
        ),
    )


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("h", F.xxhash64("text"))


def base_spans(rows: DataFrame) -> DataFrame:
    """Spans of the four patterns that pass their checks."""
    text = F.col("text")
    # Cheap tests keep most texts away from most patterns.
    needs = {"email": text.contains("@"), "ip": text.contains("."), "phone": text.contains("+")}
    nothing = F.array().cast("array<struct<kind:int,i:int,gap:int,match:string,head:string,tail:string>>")
    found = F.concat(*[
        F.when(needs.get(kind, F.lit(True)) & text.rlike("[0-9@]"), _listed(kind, text, F.lit(p))).otherwise(nothing)
        for kind, p in PATTERNS.items()
    ])
    spans = _positions(rows, found)
    keep = F.lit(False)
    for k, kind in enumerate(PATTERNS):
        keep = keep | ((F.col("kind") == k) & valid(kind, F.col("match")))
    return spans.filter(keep)


def _terms(rows: DataFrame, *columns: str) -> DataFrame:
    """Distinct terms of each row, as written; ``folded`` is what counts."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))
    return rows.select(*columns, F.explode(found).alias("term")).withColumn("folded", F.lower("term"))


def _entity() -> Column:
    """One number for a value, however it is written."""
    kind, match = F.col("kind"), F.col("match")
    email, ip = KINDS.index("email"), KINDS.index("ip")
    plain = F.when(kind == email, F.lower(match)).when(kind == ip, match).otherwise(F.translate(match, " -().+", ""))
    return F.xxhash64(kind, plain)


def evidence(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``e, n_e, folded, n_et, s`` of the pairs of entity and term whose evidence can reach ``MIN_POSTERIOR``."""
    seen = spans.select("h", _entity().alias("e"), "around")
    entities = seen.select("h", "e").distinct().groupBy("e").agg(F.count("*").alias("n_e"))
    entities = pin(entities)
    near = seen.select("h", "e", F.explode("around").alias("text"))
    near = _terms(near, "h", "e").select("h", "e", "folded").distinct().join(entities, "e")
    # What is near in the only text of an entity is all there is to count. The others need the far terms too.
    held = pin(seen.select("h", "e").distinct().join(entities.filter("n_e > 1"), "e"))
    texts = rows.join(broadcast_if_small(held.select("h").distinct(), 64), "h", "left_semi")
    words = _terms(texts, "h").select("h", "folded").distinct()
    together = words.join(held, "h").select("e", "n_e", "folded", F.lit(1).alias("both"), F.lit(0).alias("near"))
    one = F.when(F.col("n_e") == 1, 1).otherwise(0)
    pairs = near.select("e", "n_e", "folded", one.alias("both"), F.lit(1).alias("near")).union(together)
    s = F.lit(FAR_WEIGHT) * F.col("n_et") + F.lit(1 - FAR_WEIGHT) * F.col("n_near")
    summed = pairs.groupBy("e", "folded").agg(
        F.first("n_e").alias("n_e"), F.sum("both").alias("n_et"), F.sum("near").alias("n_near")
    )
    # n(e, t) / n(t) is 1 at most, so no term is lost here.
    return summed.withColumn("s", s).filter(F.col("s") / (F.col("s") + SMOOTHING) >= MIN_POSTERIOR)


def _text_counts(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``folded, n_t``: the number of distinct texts holding each known term, and ``n``, that of all of them."""
    copies = pin(rows.groupBy("h").agg(F.count("*").alias("copies")))
    several = broadcast_if_small(copies.filter("copies > 1"), 64)
    share = rows.join(several, "h", "left").withColumn("share", 1 / F.coalesce("copies", F.lit(1)))
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))
    words = share.select("share", F.explode(found).alias("folded"))
    fits = known.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    if fits:
        words = words.join(F.broadcast(known), "folded", "left_semi")
    counts = words.groupBy("folded").agg(F.round(F.sum("share")).alias("n_t"))
    if not fits:
        counts = counts.join(known, "folded", "left_semi")
    return counts.crossJoin(F.broadcast(copies.agg(F.count("*").alias("n"))))


def disclosing_terms(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``folded`` of every term that discloses some entity, by counts of distinct texts over all rows."""
    pairs = pin(evidence(rows, spans))
    counts = _text_counts(rows, pairs.select("folded").distinct())
    posterior = F.col("n_et") / F.col("n_t") * F.col("s") / (F.col("s") + SMOOTHING)
    rate = F.col("n_e") / (F.col("n") + 1)
    bits = F.log2(posterior / (1 - posterior) * (1 - rate) / rate)
    told = pairs.join(counts, "folded").filter((posterior >= MIN_POSTERIOR) & (bits >= MIN_BITS))
    return told.select("folded").distinct()


def term_pattern(terms: Column) -> Column:
    return F.concat(F.lit(_BEFORE + "(?:"), F.array_join(terms, "|"), F.lit(")" + _AFTER))


def rows_with_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, h, terms`` of the rows holding such terms, each list sorted and as written there."""
    held = _terms(rows, "doc_id", "h").join(broadcast_if_small(terms, 256), "folded")
    lists = pin(held.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("term")).alias("terms")))
    size = lists.agg(F.sum(F.length(F.array_join("terms", "  ")) * 2 + 128)).first()[0] or 0
    return F.broadcast(lists) if size <= BROADCAST_BYTES else lists


def all_spans(rows: DataFrame) -> DataFrame:
    """``doc_id, h, kind, match, start, stop`` of pattern and term spans."""
    spans = pin(base_spans(rows).select("doc_id", "h", "kind", "match", "start", "stop", "around"))
    base = spans.drop("around")
    lists = rows_with_terms(rows, pin(disclosing_terms(rows, spans)))
    marked = rows.join(lists, (rows["h"] == lists["h"]) & rows["doc_id"].eqNullSafe(lists["doc_id"])).select(
        rows["doc_id"], rows["h"], rows["text"], lists["terms"]
    )
    more = _positions(marked, _listed("term", F.col("text"), term_pattern(F.col("terms"))))
    return base.union(more.select(*base.columns))


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, a count for each kind, the base spans' hash and all spans, for each row of ``docs``."""
    rows = keyed(docs)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    shown = F.concat_ws(":", name, F.col("start"), F.col("stop"))
    entry = F.struct("kind", "start", "stop", shown.alias("shown"))
    lists = (
        all_spans(rows)
        .groupBy("doc_id", "h")
        .agg(
            *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
            F.sort_array(F.collect_list(entry)).alias("list"),
        )
    )
    joined = rows.select("doc_id", "h").join(
        lists.withColumnsRenamed({"doc_id": "id", "h": "k"}), F.expr("h = k and doc_id <=> id"), "left"
    )
    listed = F.coalesce("list", F.array().cast(lists.schema["list"].dataType))
    text_of = lambda items: F.array_join(F.transform(items, lambda x: x["shown"]), ",")
    return joined.select(
        "doc_id",
        *[F.coalesce(f"n_{kind}", F.lit(0).cast("long")).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(text_of(F.filter(listed, lambda x: x["kind"] < len(PATTERNS))).cast("binary"), 256).alias("base_sha256"),
        text_of(listed).alias("spans"),
    )


def _masked(text: Column, kind: str, pattern: Column) -> Column:
    mark = f"[{kind.upper()}]"
    return F.array_join(
        F.transform(
            _pieces(text, pattern),
            lambda x: F.concat(
                x["gap"],
                F.when(x["match"].isNull(), "").when(valid(kind, x["match"]), mark).otherwise(x["match"]),
            ),
        ),
        "",
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """All rows and columns, with spans of ``text`` replaced by their kind, kind after kind.

    ``n_chars``, where there is one, is counted again.
    """
    rows = keyed(docs)
    spans = pin(base_spans(rows).select("h", "kind", "match", "around"))
    lists = rows_with_terms(rows, pin(disclosing_terms(rows, spans)))
    lists = lists.withColumnsRenamed({"doc_id": "_id", "h": "_h", "terms": "_terms"})
    inner = docs.select(F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("_row"))
    out = inner.join(
        lists, F.xxhash64(F.coalesce("_row.text", F.lit(""))).eqNullSafe(F.col("_h")) & F.expr("_row.doc_id <=> _id"), "left"
    ).select("_row", "_terms", F.col("_row.text").alias("_text"))
    out = out.withColumn(
        "_text",
        F.when(F.col("_terms").isNull(), F.col("_text")).otherwise(
            F.regexp_replace("_text", term_pattern(F.col("_terms")), F.lit("[TERM]"))
        ),
    )
    for kind, pattern in PATTERNS.items():
        out = out.withColumn("_text", _masked(F.col("_text"), kind, F.lit(pattern)))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[new.get(c, F.col(f"_row.{c}")).alias(c) for c in docs.columns])


def op5_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
