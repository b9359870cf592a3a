"""Operator 6: token-id files in patched frame-of-reference blocks.

A segment is one self-contained image of many documents' ids:

    magic "PFR1" | u32 documents | u32 blocks | u64 ids
    documents x u64   end of each document in the segment's ids
    blocks x u64      where each block starts, counted from the first block
    blocks            u32 minimum | u8 width | u16 outliers | u16 values
                      packed low bits, least significant first
                      outliers x u16 positions, outliers x u32 high parts

A block's minimum is subtracted; ``width`` bits hold what a chosen share of its values
need, and the rest go to the exception list with their higher bits. Segments are rows
of Parquet files, which brings Spark's commit of finished tasks only; a reader finds a
document by the segment's bases and the block index.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import map_batches, written
from emberlog.llm.encoding import ID_BYTES, encoder
from emberlog.llm.packing import END_ID, small_bases

MAGIC = b"PFR1"
HEADER = "<4sIIQ"
BLOCK_HEADER = "<IBHH"
BLOCK_IDS = 4096
PERCENTILE = 98.0
# A segment closes after the document that brings it to so many ids.
SEGMENT_IDS = 500_000


def pack_bits(values: np.ndarray, width: int) -> bytes:
    if width == 0:
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, count: int) -> np.ndarray:
    if width == 0:
        return np.zeros(count, np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little")
    weights = np.uint32(1) << np.arange(width, dtype=np.uint32)
    return bits.reshape(count, width).astype(np.uint32) @ weights


def write_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    least = int(ids.min())
    over = (ids - np.uint32(least)).astype(np.uint32)
    width = int(np.percentile(over, percentile, method="higher")).bit_length()
    high = (over.astype(np.uint64) >> np.uint64(width)).astype(np.uint32)
    at = np.flatnonzero(high)
    low = over & np.uint32((1 << width) - 1)
    return b"".join(
        (
            struct.pack(BLOCK_HEADER, least, width, len(at), len(ids)),
            pack_bits(low, width),
            at.astype("<u2").tobytes(),
            high[at].astype("<u4").tobytes(),
        )
    )


def read_block(data: bytes, at: int) -> np.ndarray:
    least, width, outliers, count = struct.unpack_from(BLOCK_HEADER, data, at)
    at += struct.calcsize(BLOCK_HEADER)
    size = (count * width + 7) // 8
    values = unpack_bits(data[at : at + size], width, count)
    at += size
    where = np.frombuffer(data, "<u2", outliers, at)
    high = np.frombuffer(data, "<u4", outliers, at + 2 * outliers)
    values[where] |= (high.astype(np.uint64) << np.uint64(width)).astype(np.uint32)
    return values + np.uint32(least)


def write_segment(documents: list[bytes]) -> bytes:
    """``documents``: each one's ids as little-endian unsigned 32-bit integers."""
    ids = np.frombuffer(b"".join(documents), "<u4")
    ends = np.cumsum([len(d) // ID_BYTES for d in documents], dtype=np.uint64)
    blocks = [write_block(ids[i : i + BLOCK_IDS]) for i in range(0, len(ids), BLOCK_IDS)]
    starts = np.cumsum([0, *map(len, blocks)][:-1] if blocks else [], dtype=np.uint64)
    head = struct.pack(HEADER, MAGIC, len(documents), len(blocks), len(ids))
    return b"".join(
        (head, ends.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), *blocks)
    )


class Segment:
    """Reader of one image; any document is decoded from only the blocks it meets."""

    def __init__(self, data: bytes):
        magic, documents, blocks, self.ids = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        self.data = data
        self.ends = np.frombuffer(data, "<u8", documents, struct.calcsize(HEADER)).astype(np.int64)
        at = struct.calcsize(HEADER) + 8 * documents
        self.starts = np.frombuffer(data, "<u8", blocks, at).astype(np.int64)
        self.first_block = at + 8 * blocks

    def block(self, number: int) -> np.ndarray:
        return read_block(self.data, self.first_block + int(self.starts[number]))

    def bounds(self, number: int) -> tuple[int, int]:
        return int(self.ends[number - 1]) if number else 0, int(self.ends[number])

    def document(self, number: int) -> np.ndarray:
        start, end = self.bounds(number)
        if start == end:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK_IDS, (end - 1) // BLOCK_IDS
        ids = np.concatenate([self.block(b) for b in range(first, last + 1)])
        return ids[start - first * BLOCK_IDS : end - first * BLOCK_IDS]

    def documents(self) -> list[np.ndarray]:
        """All of them, each block decoded once."""
        blocks = [self.block(b) for b in range(len(self.starts))]
        ids = np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)
        return np.split(ids, self.ends[:-1]) if len(self.ends) else []


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """The written segments: (part, segment, before, doc_ids, image), in ascending
    doc_id over parts, segments and the documents in them; ``before`` counts the ids
    of the earlier segments of the part."""

    def make():
        part, end = TaskContext.get().partitionId(), struct.pack("<I", end_id)
        pieces, told = encoder(tokenizer), {"segment": 0, "before": 0}

        def convert(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {
                k: [] for k in ("part", "segment", "before", "doc_ids", "image")
            }
            ids: list[bytes] = []
            names: list[int | None] = []
            held = 0

            def close() -> None:
                nonlocal ids, names, held
                out["part"].append(part)
                out["segment"].append(told["segment"])
                out["before"].append(told["before"])
                out["doc_ids"].append(names)
                out["image"].append(write_segment(ids))
                told["segment"] += 1
                told["before"] += held
                ids, names, held = [], [], 0

            columns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, text in zip(*columns):
                one = (pieces.encode(text) if text else b"") + end
                ids.append(one)
                names.append(doc_id)
                held += len(one) // ID_BYTES
                if held >= SEGMENT_IDS:
                    close()
            if ids:
                close()
            return out

        return convert

    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    schema = "part int, segment int, before long, doc_ids array<long>, image binary"
    return written(map_batches(ordered, make, schema), "token-files")


def read_token_files(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from the images; ``start`` counts
    the ids of all documents before."""

    def make():
        def convert(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {
                k: [] for k in ("part", "doc_id", "local", "n_tokens", "ids_crc32")
            }
            columns = [batch.column(i) for i in range(4)]
            for part, before, names, image in zip(*(c.to_pylist() for c in columns)):
                segment = Segment(image)
                for number, ids in enumerate(segment.documents()):
                    out["part"].append(part)
                    out["doc_id"].append(names[number])
                    out["local"].append(before + segment.bounds(number)[0])
                    out["n_tokens"].append(len(ids))
                    out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
            return out

        return convert

    schema = "part int, doc_id long, local long, n_tokens long, ids_crc32 long"
    rows = map_batches(segments.select("part", "before", "doc_ids", "image"), make, schema)
    rows = written(rows, "token-rows")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    return rows.join(small_bases(totals), "part").select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode, write and read back; a row per document.

    NULL and empty texts are their end id alone. NULL doc_ids come first, repeated rows
    are each kept, in the order of doc_id and then of a hash of the text. Columns
    besides doc_id and text are not read. An empty table gives no rows.
    """
    return read_token_files(write_token_files(docs, tokenizer, end_id))
