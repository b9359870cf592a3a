"""Operator 4: SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits are cut into two halves. Of up to three differing bits one
half holds at most one, so two linked fingerprints share a half exactly or but for one
bit. Each distinct fingerprint is indexed under both halves and under every variant of
a half with one bit wildcarded: 66 keys. Fingerprints that meet at a key are verified
bit by bit. A key that many share is verified in blocks, which keep only what connects
their members, so neither pairs nor memory grow with the square of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import join_hot, map_batches, written
from emberlog.llm.components import components

SHINGLE = 3
SEED = 42
MOST_BITS = 3
HALF = 32
# Fingerprints of a key that are verified against each other in one step.
BLOCK = 1000
# Hashes whose bits are counted at a time.
HASHES = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half of the shingles' XXH64; words end at ASCII white space."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    count = max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[:count].tolist(), ends[-count:].tolist())
    return majority(
        np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in spans), "<u8", count)
    )


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; of no hashes zero."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES):
        part = hashes[at : at + HASHES].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """The carried columns and ``fp``, the fingerprint as a signed 64-bit integer."""

    def make():
        def convert(batch: pa.RecordBatch) -> dict:
            out = {name: batch.column(n) for n, name in enumerate(carried)}
            texts = batch.column(len(carried)).to_pylist()
            codes = np.array([fingerprint(t) for t in texts], np.uint64)
            return out | {"fp": codes.view(np.int64)}

        return convert

    types = dict(docs.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in carried) + "fp long"
    return map_batches(docs.select(*carried, "text"), make, schema)


def variant_keys(codes: DataFrame) -> DataFrame:
    """(key, fp): the two halves and their one-wildcard variants. A key holds the half's
    number, the wildcard's place (32 for none) and the remaining bits."""
    variants = []
    for half, value in enumerate(
        (F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", HALF))
    ):
        for place in range(HALF + 1):
            kept = value.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << place)))
            tag = F.lit((half * (HALF + 1) + place) << HALF)
            variants.append(kept.bitwiseOR(tag))
    return codes.select(F.explode(F.array(*variants)).alias("key"), "fp")


def links_within(members: np.ndarray, bits: int) -> list[tuple]:
    """(smallest, other) for every component that ``members`` form at ``bits`` bits."""
    links, rest = [], np.sort(members.view(np.uint64))
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ frontier.pop()) <= bits
            found, rest = rest[near], rest[~near]
            frontier.extend(found)
            links.extend((root.view(np.int64), x) for x in found.view(np.int64))
    return links


def block_links(shared: DataFrame, bits: int, block: int) -> DataFrame:
    """Links among the fingerprints of each key. A key's members are dealt to blocks by
    a hash, and every two blocks are verified together."""
    blocks = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            F.least(other, F.col("own")).alias("i"), F.greatest(other, F.col("own")).alias("j")
        ),
    )
    dealt = (
        shared.withColumn("blocks", blocks)
        .withColumn("own", own)
        .select("key", "fp", F.explode(met).alias("met"))
        .groupBy("key", "met")
        .agg(F.collect_list("fp").alias("members"))
        .select("members")
    )

    def make():
        def convert(batch: pa.RecordBatch) -> dict:
            links: set[tuple] = set()
            values = batch.column(0)
            flat, ends = values.flatten().to_numpy(), np.cumsum(values.value_lengths())
            for members in np.split(flat, ends[:-1]):
                links.update(links_within(members, bits))
            return {"a": [a for a, _ in links], "b": [b for _, b in links]}

        return convert

    return map_batches(dealt, make, "a long, b long")


def link_fingerprints(codes: DataFrame, bits: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints ``fp`` as all pairs within
    ``bits`` bits would. Right for up to three bits."""
    keyed = variant_keys(codes)
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    total = codes.count() * 2 * (HALF + 1)
    shared = join_hot(keyed, counts, "key", total).withColumnRenamed("n", "members")
    return block_links(written(shared, "variants"), bits, block).distinct()


def group(rows: DataFrame, order: str = "doc_id") -> DataFrame:
    """``rows`` (with ``fp``) and ``least``, the smallest ``order`` of all rows that links
    reach from it. ``rows`` should be a written table: it is read several times."""
    codes = written(rows.groupBy("fp").agg(F.min(order).alias("least")), "fingerprints")
    roots = components(link_fingerprints(codes.select("fp")))
    named = codes.join(roots, codes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("least"))
    classes = written(named.drop("least").join(smallest, "root"), "classes")
    return rows.join(classes.select("fp", "least"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row per row of ``docs``.

    NULL and empty texts have fingerprint zero and are linked like any other. Repeated
    rows fall into one component. NULL doc_ids are never a component's name unless all
    of its are NULL. Columns besides doc_id and text are not read. No rows give none.
    """
    rows = written(fingerprints(docs, "doc_id"), "simhash")
    return group(rows).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least").alias("component_id"),
    )


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that remain when one of each group stays: that with the
    smallest doc_id, of repeated rows one."""
    columns, number = docs.columns, "__row"
    while number in columns:
        number += "_"
    kept = docs.select(*columns, F.monotonically_increasing_id().alias(number))
    kept = written(kept, "numbered")
    rows = written(fingerprints(kept, number, "doc_id"), "simhash")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(number).alias("row"))
    grouped = group(rows.withColumn("order", order), "order")
    survivors = grouped.select(F.col("least.row").alias(number)).distinct()
    return kept.join(survivors, number, "left_semi").select(*columns)
