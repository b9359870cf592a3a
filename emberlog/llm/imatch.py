"""Operator 1: I-Match fingerprints with randomised lexicons, in built-in functions only.

Terms are hashed to a fixed number of slots whose document frequencies are counted over
all documents. A text keeps the terms whose inverse document frequency lies in a band,
sorts the distinct ones and hashes those of each lexicon subset: ``DRAWS`` disjoint
random subsets at each of ``SCALES`` rates, a quarter of the one before, so that texts
of any length have some subsets with few of their terms.

The likeness of two fingerprints is the share of equal hashes among the subsets that
either text fills; a scale counts by the share of its subsets that both leave empty,
since where every subset is full any difference shows in all of them.

A slot's frequency is that of all terms in it. With 2^20 slots and some hundred
distinct terms a document this adds a share of about 3e-4 to each, whatever the number
of documents, which lies below the band. The lexicon is one bit per slot, 128 KiB.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SLOTS = 1 << 20
# The band as document-frequency shares: idf from ln(50) to ln(2000).
IDF_BAND = (math.log(50), math.log(2000))
SCALES, DRAWS = 6, 16
DRAW_BIT, SCALE_BIT = 20, 24
SMALLEST_WEIGHT = 1e-3
EMPTY = 42
NOT_TERM = r"[^\p{L}\p{N}]+"


def term_hashes(text: Column) -> Column:
    words = F.split(F.lower(text), NOT_TERM)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def slot_of(term: Column) -> Column:
    return term.bitwiseAND(SLOTS - 1)


def lexicon(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """One row with ``bits``: a bit per slot, set if its frequency lies in the band."""
    spark = docs.sparkSession
    total = docs.count()
    slots = docs.select(
        F.explode(F.array_distinct(F.transform(term_hashes(F.col("text")), slot_of))).alias("slot")
    )
    idf = F.log(F.lit(float(max(1, total))) / F.col("documents"))
    cells = (
        slots.groupBy("slot")
        .agg(F.count(F.lit(1)).alias("documents"))
        .where(idf.between(*band))
        .groupBy(F.shiftright("slot", 6).alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits"))
        .collect()
    )
    held = dict((row["cell"], row["bits"]) for row in cells)
    bits = [held.get(n, 0) for n in range(SLOTS // 64)]
    return spark.createDataFrame([(bits,)], "bits array<long>")


def kept_terms(terms: Column, bits: Column) -> Column:
    """Sorted distinct term hashes in the band."""

    def in_band(term: Column) -> Column:
        slot = slot_of(term)
        cell = F.element_at(bits, (F.shiftright(slot, 6) + 1).cast("int"))
        return F.getbit(cell, slot.bitwiseAND(63).cast("int")) == 1

    return F.sort_array(F.array_distinct(F.filter(terms, in_band)))


def or_whole(kept: Column, terms: Column, text: Column) -> Column:
    """The kept terms; if there are none, all of the text's, or the text itself."""
    every = F.sort_array(F.array_distinct(terms))
    whole = F.when(F.size(terms) == 0, F.array(F.xxhash64(text))).otherwise(every)
    return F.when(F.size(kept) == 0, whole).otherwise(kept)


def with_fingerprint(df: DataFrame, text: str, name: str, bits: Column) -> DataFrame:
    """Adds ``name``: SCALES * DRAWS hashes of 15 bits, EMPTY for a subset without terms."""
    terms = [f"__terms{n}" for n in range(SCALES)]
    out = df.withColumn("__bits", bits)
    out = out.withColumn("__all", term_hashes(F.col(text)))
    out = out.withColumn("__kept", kept_terms(F.col("__all"), F.col("__bits")))
    whole = or_whole(F.col("__kept"), F.col("__all"), F.col(text))
    out = out.withColumn(terms[0], whole).drop("__bits", "__all", "__kept")
    for scale in range(1, SCALES):
        mask = ((1 << 2 * scale) - 1) << SCALE_BIT
        out = out.withColumn(terms[scale], rarer(F.col(terms[scale - 1]), mask))
    hashes = [subset_hashes(F.col(column)) for column in terms]
    return out.withColumn(name, F.concat(*hashes)).drop(*terms)


def rarer(terms: Column, mask: int) -> Column:
    return F.filter(terms, lambda t: t.bitwiseAND(F.lit(mask)) == 0)


def subset_hashes(terms: Column) -> Column:
    """A hash of the terms of each draw; that of no terms is the hash's seed, EMPTY."""

    def hashed(draw: Column) -> Column:
        own = F.filter(
            terms, lambda t: F.shiftrightunsigned(t, DRAW_BIT).bitwiseAND(DRAWS - 1) == draw
        )
        return F.xxhash64(own).bitwiseAND(0x7FFF).cast("short")

    return F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), hashed)


def as_text(fingerprint: Column) -> Column:
    return F.lower(
        F.array_join(F.transform(fingerprint, lambda h: F.lpad(F.hex(h), 4, "0")), "")
    )


def likeness(a: str, b: str) -> Column:
    """1 for equal fingerprints, also if both are without terms."""
    equal, filled = F.lit(0.0), F.lit(0.0)
    for scale in range(SCALES):
        pair = F.arrays_zip(
            F.slice(a, scale * DRAWS + 1, DRAWS).alias("a"),
            F.slice(b, scale * DRAWS + 1, DRAWS).alias("b"),
        )
        either = F.size(F.filter(pair, lambda p: (p["a"] != EMPTY) | (p["b"] != EMPTY)))
        both = F.size(F.filter(pair, lambda p: (p["a"] == p["b"]) & (p["a"] != EMPTY)))
        weight = (F.lit(DRAWS) - either) / F.lit(float(DRAWS)) + SMALLEST_WEIGHT
        equal, filled = equal + both * weight, filled + either * weight
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(F.least(equal / filled, F.lit(1.0)))


def with_next(docs: DataFrame, *following: str) -> DataFrame:
    """``docs`` with ``next_<c>``: the column of the next row in descending doc_id, of
    the first row after the last. Rows of equal ids are ordered by a hash of their text,
    NULL ids come last.

    Rows are dealt to ranges of ids whose bounds are ids of the table, and the row at a
    bound is given to the range before too, so no range needs to see another one.
    """
    spark = docs.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [n / ranges for n in range(1, ranges)] or [0.5]
    found = docs.agg(
        F.percentile_approx("doc_id", shares, 10 * ranges).alias("bounds"),
        F.max("doc_id").alias("most"),
    ).first()
    bounds = sorted(set(found["bounds"] or []), reverse=True) if ranges > 1 else []
    ids = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<long>")
    own = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(
        F.size(F.filter(ids, lambda b: b >= F.col("doc_id")))
    )
    place = F.array_position(ids, F.col("doc_id")).cast("int")
    targets = F.array(
        F.struct(own.alias("range"), F.lit(0).alias("guest")),
        F.struct(F.when(place > 0, place - 1).alias("range"), F.lit(1).alias("guest")),
        F.struct(
            F.when(F.col("doc_id") == F.lit(found["most"]), len(bounds)).alias("range"),
            F.lit(2).alias("guest"),
        ),
    )
    dealt = docs.withColumn(
        "__to", F.explode(F.filter(targets, lambda t: t["range"].isNotNull()))
    ).select("*", "__to.range", "__to.guest")
    inside = Window.partitionBy("range").orderBy(
        "guest", F.desc_nulls_last("doc_id"), F.xxhash64("text")
    )
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = dealt
    row = F.struct(*following)
    out = out.withColumn("__next", F.coalesce(F.lead(row).over(inside), F.first(row).over(whole)))
    return out.where("guest = 0").select(
        *docs.columns, *[F.col(f"__next.{c}").alias(f"next_{c}") for c in following]
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) with the edited text and both fingerprints.

    The edited text has the last floor(n / 2) code points replaced by the first as many
    of the next document. A NULL text counts as empty; of a text without a term in
    the band all terms are hashed, of one without terms the text. Rows and ids may repeat.
    Other columns are not read. No rows give none.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bits = lexicon(plain).select("bits").scalar()
    known = with_next(with_fingerprint(plain, "text", "sketch", bits), "text", "sketch")
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.char_length("text") - half),
        F.substring("next_text", F.lit(1), half),
    )
    return with_fingerprint(known.withColumn("edited", edited), "edited", "edited_sketch", bits)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    return fingerprints(docs).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )
