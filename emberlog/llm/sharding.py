"""Operator 7: byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Equal texts form a group that stays together. A partial partition is a vector of shard
sizes; a single group is one with one filled shard. The two partial partitions with the
largest spread are combined oppositely ordered, the largest of one onto the smallest of
the other, until one is left. Every task does so with its own groups, in batches, and
what remains of each batch, one vector, is combined in turn, level by level: nowhere is
more held than a batch.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import map_batches, written

SHARDS = 40
ROW_BYTES = 16
# Partial partitions that one combination holds. The more, the evener: large groups need
# many small ones beside them.
BATCH = 20_000


def difference(sizes: np.ndarray) -> np.ndarray:
    """Shard of each part of each partial partition.

    ``sizes`` has a row per partial partition and a column per part. The result has the
    same shape and says to which combined shard each part goes.
    """
    count, shards = sizes.shape
    # A node: its sizes in descending order; leaves and pairs say where parts come from.
    nodes: list[np.ndarray] = []
    made: list[tuple] = []
    heap: list[tuple[int, int]] = []

    def add(vector: np.ndarray, origin: tuple) -> None:
        order = np.argsort(-vector, kind="stable")
        nodes.append(vector[order])
        made.append((*origin, order))
        heapq.heappush(heap, (-int(vector.max() - vector.min()), len(nodes) - 1))

    for row in sizes:
        add(row, ())
    while len(heap) > 1:
        (_, left), (_, right) = heapq.heappop(heap), heapq.heappop(heap)
        add(nodes[left] + nodes[right][::-1], (left, right))
        nodes[left] = nodes[right] = np.zeros(0, np.int64)
    result = np.zeros((count, shards), np.int32)
    if not count:
        return result
    # From the last node down: the shard that each sorted place of a node ends in.
    goes: list[np.ndarray | None] = [None] * len(made)
    goes[-1] = np.arange(shards)
    for number in range(len(made) - 1, -1, -1):
        *origin, order = made[number]
        shard = np.empty(shards, np.int64)
        shard[order] = goes[number]
        goes[number] = None
        if origin:
            goes[origin[0]], goes[origin[1]] = shard, shard[::-1]
        else:
            result[number] = shard
    return result


def deal_groups(groups: DataFrame, shards: int, batch_size: int) -> DataFrame:
    """(name, size) to (cell, name, size, part): the part of its cell's partition that
    a group falls into. A cell is one batch of one task."""

    def make():
        task, cells = TaskContext.get().partitionId(), [0]

        def convert(batch: pa.RecordBatch) -> dict:
            size = batch.column(1).to_numpy()
            part, cell = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for at in range(0, len(size), batch_size):
                own = size[at : at + batch_size]
                vectors = np.zeros((len(own), shards), np.int64)
                vectors[:, 0] = own
                part[at : at + batch_size] = difference(vectors)[:, 0]
                cell[at : at + batch_size] = (task << 24) + cells[0]
                cells[0] += 1
            return {"cell": cell, "name": batch.column(0), "size": size, "part": part}

        return convert

    schema = "cell long, name binary, size long, part int"
    return map_batches(groups.select("name", "size"), make, schema, batch_size)


def combine_cells(sizes: DataFrame, shards: int, batch_size: int) -> DataFrame:
    """(cell, sizes array) to (cell, into, moved, combined): batches of cells combined;
    ``moved`` gives the part of ``into`` for each part of the cell, ``combined`` the
    sizes of ``into``, in one row of it."""

    def make():
        task, made = TaskContext.get().partitionId(), [0]

        def convert(batch: pa.RecordBatch) -> dict:
            cells = batch.column(0).to_pylist()
            vectors = np.array(batch.column(1).to_pylist(), np.int64).reshape(-1, shards)
            out: dict[str, list] = {c: [] for c in ("cell", "into", "moved", "combined")}
            for at in range(0, len(cells), batch_size):
                own = vectors[at : at + batch_size]
                moved = difference(own)
                total = np.zeros(shards, np.int64)
                np.add.at(total, moved, own)
                out["cell"] += cells[at : at + batch_size]
                out["into"] += [(task << 24) + made[0]] * len(own)
                out["moved"] += moved.tolist()
                out["combined"] += [total.tolist()] + [None] * (len(own) - 1)
                made[0] += 1
            return out

        return convert

    schema = "cell long, into long, moved array<int>, combined array<long>"
    return map_batches(sizes.select("cell", "sizes"), make, schema, batch_size)


def shard_groups(groups: DataFrame, shards: int = SHARDS, batch_size: int = BATCH) -> DataFrame:
    """(name, shard) of (name, size) groups."""
    dealt = written(deal_groups(groups, shards, batch_size), "dealt")
    sums = dealt.groupBy("cell", "part").agg(F.sum("size").alias("size"))
    by_part = F.map_from_entries(F.collect_list(F.struct("part", "size")))
    cells = (
        sums.groupBy("cell")
        .agg(by_part.alias("held"))
        .select(
            "cell",
            F.transform(
                F.sequence(F.lit(0), F.lit(shards - 1)),
                lambda p: F.coalesce(F.try_element_at("held", p), F.lit(0).cast("long")),
            ).alias("sizes"),
        )
    )
    cells = written(cells, "cells")
    # cell and part of every group's cell, in terms of the last combination.
    names = cells.select("cell", F.col("cell").alias("now"), F.sequence(F.lit(0), F.lit(shards - 1)).alias("parts"))
    while (count := cells.count()) > 1:
        width = max(1, -(-count // batch_size))
        joined = written(combine_cells(cells.coalesce(width), shards, batch_size), "combined")
        moves = joined.select(F.col("cell").alias("now"), "into", "moved")
        names = names.join(moves, "now").select(
            "cell",
            F.col("into").alias("now"),
            F.transform("parts", lambda p: F.element_at("moved", p + 1)).alias("parts"),
        )
        names = written(names, "names")
        cells = joined.where("combined IS NOT NULL").select(
            F.col("into").alias("cell"), F.col("combined").alias("sizes")
        )
    return dealt.join(names, "cell").select(
        "name", F.element_at("parts", F.col("part") + 1).alias("shard")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, batch_size: int = BATCH) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): a row per row.

    Rows of equal texts share a shard; NULL texts are equal to each other and of no
    bytes (crc32 0). Sizes are near equal as far as the largest group allows. Slots
    number a shard's rows from 0 without a gap, by where the row was read. Rows and ids
    may repeat or be NULL. Other columns are not read. No rows give none.
    """
    text = F.col("text").cast("binary")
    name = F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("name")
    rows = written(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            name,
            # Where the row was read: a group's rows lie in as many blocks as they did.
            F.spark_partition_id().alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ),
        "sized",
    )
    groups = rows.groupBy("name").agg(F.sum("size").alias("size"))
    placed = rows.join(shard_groups(groups, shards, batch_size), "name").drop("name")
    placed = written(placed, "placed")
    # Rows are numbered inside (block, shard) and blocks added up before: no window
    # holds more than a block.
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = counts.select(
        "shard", "block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base")
    )
    number = F.row_number().over(Window.partitionBy("block", "shard").orderBy("line"))
    return (
        placed.withColumn("number", number - 1)
        .join(bases, ["block", "shard"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("number")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
