"""Operator 9: concatenate and cut.

All documents' ids, each with an end id, form one stream that is cut every
``length`` ids. Pass 1 encodes the texts where they lie and writes the ids with their
place inside the partition; pass 2 adds up the partitions' totals, which gives every
document its place in the stream, and cuts it at the windows it meets.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import map_batches, written
from emberlog.llm.encoding import ID_BYTES, encoder

SEQUENCE = 2048
END_ID = 1
GROUP = 1024
# Parts whose bases are broadcast, 12 bytes each; more are joined by a shuffle.
MOST_BROADCAST_PARTS = 500_000


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, before, doc_id, ids): ids with the end id; ``before`` counts the ids of
    the rows before it in its partition."""

    def make():
        part, before = TaskContext.get().partitionId(), [0]
        pieces, end = encoder(tokenizer), struct.pack("<I", end_id)

        def convert(batch: pa.RecordBatch) -> dict:
            ids = [(pieces.encode(t) if t else b"") + end for t in batch.column(1).to_pylist()]
            starts = []
            for one in ids:
                starts.append(before[0])
                before[0] += len(one) // ID_BYTES
            return {
                "part": [part] * len(ids),
                "before": starts,
                "doc_id": batch.column(0),
                "ids": ids,
            }

        return convert

    return map_batches(
        docs.select("doc_id", "text"), make, "part int, before long, doc_id long, ids binary"
    )


def part_bases(totals: DataFrame) -> DataFrame:
    """(part, base): sum of ``total`` of all parts before it, by prefix sums in two
    levels, so that no task sees more than a thousandth of the parts."""
    grouped = totals.withColumn("block", F.floor(F.col("part") / GROUP))
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    blocks = grouped.groupBy("block").agg(F.sum("total").alias("block_total"))
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block", F.coalesce(F.sum("block_total").over(over), F.lit(0)).alias("block_base")
    )
    return (
        grouped.withColumn("inner", F.coalesce(F.sum("total").over(inside), F.lit(0)))
        .join(blocks, "block")
        .select("part", (F.col("block_base") + F.col("inner")).alias("base"))
    )


def small_bases(totals: DataFrame) -> DataFrame:
    """:func:`part_bases`, written, and broadcast while they are few: there is one per
    task that wrote the rows."""
    bases = written(part_bases(totals), "bases")
    return F.broadcast(bases) if bases.count() <= MOST_BROADCAST_PARTS else bases


def pack(
    docs: DataFrame, tokenizer: str, length: int = SEQUENCE, end_id: int = END_ID
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, ids.

    Every sequence but the last is full. A NULL or empty text is its end id alone;
    repeated rows are packed each; NULL ids stay NULL. Columns besides doc_id and text
    are not read. No documents give no pieces. A document of any length is cut into as
    many pieces as it meets windows.
    """
    size = length
    rows = written(encoded(docs, tokenizer, end_id), "packing")
    n = F.octet_length("ids").cast("long") / F.lit(ID_BYTES)
    counted = rows.withColumn("doc_tokens", n.cast("long"))
    totals = counted.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    first = F.col("base") + F.col("before")
    placed = counted.join(small_bases(totals), "part").withColumn("first", first)
    pieces = placed.withColumn(
        "sequence_id",
        F.explode(
            F.sequence(
                F.floor(F.col("first") / size),
                F.floor((F.col("first") + F.col("doc_tokens") - 1) / size),
            )
        ),
    )
    begin = F.greatest(F.col("first"), F.col("sequence_id") * size)
    finish = F.least(F.col("first") + F.col("doc_tokens"), (F.col("sequence_id") + 1) * size)
    cut = pieces.withColumns(
        {
            "start": begin - F.col("first"),
            "length": finish - begin,
            "offset": begin - F.col("sequence_id") * size,
        }
    )
    piece = F.substring(
        F.col("ids"),
        (F.col("start") * ID_BYTES + 1).cast("int"),
        (F.col("length") * ID_BYTES).cast("int"),
    )
    return cut.withColumn("ids", piece).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "ids",
    )
