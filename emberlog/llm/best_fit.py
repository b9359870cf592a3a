"""Operator 13: best-fit packing by the linear grouping scheme.

Pass 1 encodes the texts where they lie, cuts only documents longer than a sequence, and
writes the pieces, each with its number among those of its length in its partition. The
counts per length, at most one for each length of a sequence, decide the packing
(``grouping``). It says for every length which of its pieces, in the order of their
numbers, go to which sequences and where; pass 2 looks each piece up in that table.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import map_batches, written
from emberlog.llm.encoding import ID_BYTES, encoder
from emberlog.llm.grouping import Pattern, pack_lengths
from emberlog.llm.packing import SEQUENCE

END_ID = 0
# (partition, length) pairs that are broadcast, 16 bytes each; more are shuffled.
MOST_BROADCAST_BASES = 500_000

PIECES = (
    "part int, nth long, doc_id long, piece int, start long, length int, "
    "ids_crc32 long, ids binary"
)


def pieces(docs: DataFrame, tokenizer: str, sequence: int, end_id: int) -> DataFrame:
    """(part, nth, doc_id, piece, start, length, ids_crc32, ids); ``nth`` counts the
    earlier pieces of the same length in the partition."""

    def make():
        part, seen = TaskContext.get().partitionId(), {}
        encoding, end = encoder(tokenizer), struct.pack("<I", end_id)
        size = sequence * ID_BYTES

        def convert(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {
                k: [] for k in ("nth", "doc_id", "piece", "start", "length", "ids_crc32", "ids")
            }
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = (encoding.encode(text) if text else b"") + end
                for piece, at in enumerate(range(0, len(ids), size)):
                    some = ids[at : at + size]
                    length = len(some) // ID_BYTES
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    out["nth"].append(nth)
                    out["doc_id"].append(doc_id)
                    out["piece"].append(piece)
                    out["start"].append(at // ID_BYTES)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(some))
                    out["ids"].append(some)
            return {"part": [part] * len(out["ids"]), **out}

        return convert

    return map_batches(docs.select("doc_id", "text"), make, PIECES)


RUNS = "length int, first long, last long, sequence_base long, times long, place int"


def runs(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of a length go, by their numbers from ``first`` to ``last``: to
    one of ``times`` sequences from ``sequence_base`` on, from offset ``place`` on.

    There are no more than the patterns have lengths, whatever the number of pieces."""
    out, reached, base = [], {}, 0
    for pattern in patterns:
        place = 0
        for length, n in pattern.entries:
            first = reached.get(length, 0)
            reached[length] = first + n * pattern.count
            out.append((length, first, reached[length] - 1, base, pattern.count, place))
            place += n * length
        base += pattern.count
    return out


def pack_best_fit(
    docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids.

    Documents of at most ``sequence`` tokens, the end id included, are whole; longer ones
    are cut into pieces of that many, of which the last may be shorter. A NULL or empty
    text is its end id alone; repeated rows are packed each; NULL ids stay NULL. Columns
    besides doc_id and text are not read. No documents give no pieces.
    """
    spark = docs.sparkSession
    rows = written(pieces(docs, tokenizer, sequence, end_id), "pieces")
    counts = written(rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # At most one row for each length of a sequence.
    histogram = counts.groupBy("length").agg(F.sum("n")).collect()
    patterns = pack_lengths({length: n for length, n in histogram}, sequence)
    where = F.broadcast(spark.createDataFrame(runs(patterns), RUNS))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = counts.select(
        "part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    if counts.count() <= MOST_BROADCAST_BASES:
        bases = F.broadcast(bases)
    numbered = rows.join(bases, ["part", "length"]).withColumn(
        "number", F.col("base") + F.col("nth")
    )
    placed = numbered.join(where, "length").where("number BETWEEN first AND last")
    turn = F.col("number") - F.col("first")
    slot = F.floor(turn / F.col("times"))
    return placed.select(
        "doc_id",
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        (F.col("sequence_base") + turn % F.col("times")).alias("sequence_id"),
        (F.col("place") + slot * F.col("length")).cast("long").alias("offset"),
        "ids",
    )
