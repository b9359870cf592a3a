"""Operator 11: hard negatives by Kronecker-packed products.

Vectors are whole numbers. The components of several candidates are biased to be
non-negative and put into separate fields of one wide integer; one multiplication by the
biased component of an anchor multiplies all of them at once. The fields are as wide as
the largest possible sum, so adding up over the components never carries from one into
the next, and the exact inner products are read from the fields once the biases are
subtracted. While the fields fit the 53 bits of a double's significand the integers are
kept there and the products are a matrix product; larger numbers use Python's integers.

Candidates are cut into blocks where they lie. Anchors are cut into blocks too and
broadcast in rounds of bounded size; every candidate block meets the anchor blocks of a
round by an equality join on their numbers, or on the label where only rows of the same
label matter. A task keeps the best few candidates of each anchor of the round and
passes on only them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import map_batches, written
from emberlog.llm.packing import small_bases

# Rows of a block; fewer where the session's Arrow batches are smaller.
BLOCK_ROWS = 1000
# Anchor blocks that one broadcast holds.
ROUND_BYTES = 16 << 20
# Candidate rows of a task, if there are more than two tasks a core would take.
TASK_ROWS = 250_000
# Bits of a double that hold a whole number exactly.
SIGNIFICAND = 53
WIDE_FIELDS = 8
LONG = np.iinfo(np.int64)
# Rows of a block that are looked through at once.
STEP = 100


def packed_scores(candidates: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products, one row per candidate and one column per anchor, exact; those
    without room in 64 bits are the nearest number with room."""
    width = min(candidates.shape[1], anchors.shape[1])  # beyond it one side has zeros
    if width == 0 or not len(candidates) or not len(anchors):
        return np.zeros((len(candidates), len(anchors)), np.int64)
    c, a = candidates[:, :width], anchors[:, :width]
    low_c, low_a = int(c.min()), int(a.min())
    high_c, high_a = int(c.max()), int(a.max())
    largest = width * max(-low_c, high_c, 1) * max(-low_a, high_a, 1)
    bits = max(1, (width * (high_c - low_c) * (high_a - low_a)).bit_length())
    narrow = bits <= SIGNIFICAND and largest < 1 << 62
    kind = np.float64 if narrow else object
    fields = SIGNIFICAND // bits if narrow else WIDE_FIELDS
    whole = np.int64 if narrow else object
    c, a = c.astype(whole), a.astype(whole)
    biased = np.zeros((-(-len(c) // fields) * fields, width), whole)
    biased[: len(c)] = c - low_c
    wide = biased[0::fields].astype(kind)
    for field in range(1, fields):
        wide = wide + biased[field::fields].astype(kind) * (1 << (field * bits))
    sums = (wide @ (a - low_a).astype(kind).T).astype(whole)
    out = np.empty((len(biased), len(a)), whole)
    mask = (1 << bits) - 1
    for field in range(fields):
        out[field::fields] = (sums >> (field * bits)) & mask
    # sum(c a) = sum((c - lc)(a - la)) + lc sum(a) + la sum(c) - width lc la
    out = out[: len(c)]
    out += low_a * c.sum(axis=1)[:, None] + low_c * a.sum(axis=1)[None, :]
    out -= width * low_c * low_a
    if not narrow:
        out = np.clip(out, LONG.min, LONG.max).astype(np.int64)
    return out


class Best:
    """For each of some slots the ``most`` candidates of highest score, ties by id."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.score = np.full((slots, most), LONG.min, np.int64)
        self.ident = np.zeros((slots, most), np.int64)
        self.held = np.zeros(slots, np.int64)

    def least(self) -> np.ndarray:
        """Scores below it cannot enter a slot."""
        return np.where(self.held == self.most, self.score[:, -1], LONG.min)

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(slot):
            return
        met = np.unique(slot)
        row, column = np.nonzero(np.arange(self.most) < self.held[met][:, None])
        slot = np.concatenate((slot, met[row]))
        score = np.concatenate((score, self.score[met][row, column]))
        ident = np.concatenate((ident, self.ident[met][row, column]))
        order = np.lexsort((ident, ~score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = place < self.most
        slot, place = slot[kept], place[kept]
        self.score[slot, place], self.ident[slot, place] = score[kept], ident[kept]
        np.maximum.at(self.held, slot, place + 1)


class Block:
    """Rows of a block as arrays."""

    def __init__(self, row: dict, side: str):
        self.parts = np.frombuffer(row[side + "parts"], row[side + "kind"])
        self.parts = self.parts.reshape(row[side + "rows"], row[side + "width"])
        self.ids = np.frombuffer(row[side + "ids"], np.int64)
        self.labels = np.frombuffer(row[side + "labels"], np.int64)


BLOCK = (
    "part int, place int, kind string, rows int, width int, "
    "runs array<struct<label: long, first: int, n: int>>, "
    "ids binary, labels binary, parts binary, keys binary, scores binary"
)


def blocks(rows: DataFrame, positives: int) -> DataFrame:
    """Blocks of (vec_id, label, parts, key, scores) rows, which are sorted by label in
    their partitions; the rows of a label are then a run of the block."""

    def make():
        from pyspark import TaskContext

        part, places = TaskContext.get().partitionId(), [0]

        def convert(batch: pa.RecordBatch) -> dict:
            ids, labels, keys = (
                batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)
                for i in (0, 1, 3)
            )
            lists = batch.column(2)
            lengths = np.diff(lists.offsets.to_numpy())
            width = int(lengths.max())
            parts = np.zeros((len(ids), width), np.int64)
            parts[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
            least, most = int(parts.min(initial=0)), int(parts.max(initial=0))
            kind = next(
                k for k in ("<i2", "<i4", "<i8")
                if np.iinfo(k).min <= least and most <= np.iinfo(k).max
            )
            scores = np.zeros((len(ids), positives + 1), np.int64)
            for n, values in enumerate(batch.column(4).to_pylist()):
                scores[n, 0] = len(values)
                scores[n, 1 : len(values) + 1] = values
            firsts = np.flatnonzero(np.diff(labels, prepend=labels[0] - 1))
            counts = np.diff(firsts, append=len(labels))
            runs = [
                {"label": int(labels[f]), "first": int(f), "n": int(n)}
                for f, n in zip(firsts, counts)
            ]
            places[0] += 1
            values = {
                "part": part, "place": places[0] - 1, "kind": kind, "rows": len(ids),
                "width": width, "runs": runs, "ids": ids.tobytes(), "labels": labels.tobytes(),
                "parts": parts.astype(kind).tobytes(), "keys": keys.tobytes(),
                "scores": scores.tobytes(),
            }
            return {name: [value] for name, value in values.items()}

        return convert

    columns = rows.select("vec_id", "label", "parts", "key", "scores")
    return written(map_batches(columns, make, BLOCK, BLOCK_ROWS), "vector-blocks")


def numbered(made: DataFrame) -> DataFrame:
    """Blocks with ``block``, their number from 0 over all partitions."""
    totals = made.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
    return made.join(small_bases(totals), "part").withColumn(
        "block", F.col("base") + F.col("place")
    )


def by_label(made: DataFrame) -> DataFrame:
    """A block for each run of one label."""
    size = F.substring("kind", 3, 1).cast("int") * F.col("width")

    def cut(column: str, row_bytes: Column) -> Column:
        first = (F.col("run.first") * row_bytes + 1).cast("int")
        return F.substring(F.col(column), first, (F.col("run.n") * row_bytes).cast("int"))

    one = made.withColumn("run", F.explode("runs"))
    return one.withColumns(
        {
            "label": F.col("run.label"),
            "rows": F.col("run.n"),
            "parts": cut("parts", size),
            "ids": cut("ids", F.lit(8)),
            "labels": cut("labels", F.lit(8)),
            "keys": cut("keys", F.lit(8)),
            "first": F.col("run.first"),
        }
    ).drop("run", "runs", "scores")


def _named(made: DataFrame, side: str, *columns: str) -> DataFrame:
    return made.select(*[F.col(c).alias(side + c) for c in columns])


SHAPE = ("kind", "rows", "width", "ids", "labels", "parts")
LISTS = "key long, slot int, ident long, score long"


def _best_lists(
    pairs: DataFrame,
    slots: int,
    most: int,
    chosen: Callable[[dict, Block, Block, np.ndarray, Best], None],
) -> DataFrame:
    """(key, slot, ident, score): for each anchor and slot the best candidates that the
    task met; ``chosen`` adds those of a pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, tuple[np.ndarray, Best]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                candidates, anchors = Block(row, "c_"), Block(row, "a_")
                name = row["a_block"], row["a_first"]
                if name not in state:
                    keys = np.frombuffer(row["a_keys"], np.int64)
                    state[name] = keys, Best(len(keys) * slots, most)
                scores = packed_scores(candidates.parts, anchors.parts)
                chosen(row, candidates, anchors, scores, state[name][1])
        for keys, best in state.values():
            at, place = np.nonzero(np.arange(most) < best.held[:, None])
            columns = keys[at // slots], at % slots, best.ident[at, place], best.score[at, place]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32()) + (pa.int64(),) * 2)],
                names=["key", "slot", "ident", "score"],
            )

    return pairs.mapInArrow(run, LISTS)


def _ranked(lists: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "ident")
    return lists.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def _rounds(anchor_blocks: DataFrame) -> list[tuple[int, int]]:
    """First and last block number of each round, ROUND_BYTES or one block at most."""
    size = F.octet_length("parts") + F.octet_length("scores") + 3 * F.octet_length("ids")
    count, largest = anchor_blocks.agg(F.count(F.lit(1)), F.max(size)).first()
    step = max(1, ROUND_BYTES // max(1, largest or 1))
    return [(first, min(first + step, count) - 1) for first in range(0, count, step)]


def _in_rounds(anchor_blocks: DataFrame, one_round: Callable[[int, int], DataFrame]) -> DataFrame | None:
    parts = [written(one_round(*bounds), "best") for bounds in _rounds(anchor_blocks)]
    return reduce(DataFrame.unionByName, parts) if parts else None


def nearest_of_label(
    candidate_blocks: DataFrame, anchor_blocks: DataFrame, positives: int
) -> DataFrame | None:
    """(key, positive, positive_id, positive_score): the best other rows of an anchor's
    own label, numbered from 1."""

    def chosen(row: dict, candidates: Block, anchors: Block, scores: np.ndarray, best: Best):
        for start in range(0, len(scores), STEP):
            some = scores[start : start + STEP]
            at, slot = np.nonzero(some >= best.least())
            score, at = some[at, slot], at + start
            other = candidates.ids[at] != anchors.ids[slot]
            for n in np.flatnonzero(~other):
                # One id may name different vectors, of which only one is the anchor.
                mine, yours = candidates.parts[at[n]], anchors.parts[slot[n]]
                width = max(len(mine), len(yours))
                other[n] = not np.array_equal(
                    np.pad(mine, (0, width - len(mine))), np.pad(yours, (0, width - len(yours)))
                )
            best.add(slot[other], score[other], candidates.ids[at[other]])

    labelled = by_label(anchor_blocks)
    sides = _named(by_label(candidate_blocks), "c_", "label", *SHAPE)

    def one_round(first: int, last: int) -> DataFrame:
        some = labelled.where(F.col("block").between(first, last))
        few = _named(some, "a_", "label", "block", "first", "keys", *SHAPE)
        pairs = sides.join(F.broadcast(few), F.col("c_label") == F.col("a_label"))
        return _best_lists(pairs, 1, positives, chosen)

    lists = _in_rounds(anchor_blocks, one_round)
    if lists is None:
        return None
    return _ranked(lists, positives).select(
        "key",
        F.col("place").alias("positive"),
        F.col("ident").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )


def share_of(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """score * percent / 100 rounded up or down, without leaving 64 bits."""
    whole, rest = np.divmod(score, 100)
    rest = rest * percent
    return whole * percent + (-(-rest // 100) if up else rest // 100)


def between_shares(
    candidate_blocks: DataFrame,
    anchor_blocks: DataFrame,
    positives: int,
    negatives: int,
    least_percent: int,
    most_percent: int,
) -> DataFrame | None:
    """(key, positive, rank, negative_id, negative_score): for each positive the best
    rows of another label whose score lies between two shares of the positive's."""

    def chosen(row: dict, candidates: Block, anchors: Block, scores: np.ndarray, best: Best):
        table = np.frombuffer(row["a_scores"], np.int64).reshape(len(anchors.ids), -1)
        known = np.arange(positives) < table[:, :1]
        low = np.where(known, share_of(table[:, 1:], least_percent, True), LONG.max)
        high = np.where(known, share_of(table[:, 1:], most_percent, False), LONG.min)
        for start in range(0, len(scores), STEP):
            some = scores[start : start + STEP]
            floor = np.maximum(low, best.least().reshape(low.shape))
            at, anchor = np.nonzero((some >= floor.min(axis=1)) & (some <= high.max(axis=1)))
            differs = candidates.labels[at + start] != anchors.labels[anchor]
            at, anchor = at[differs], anchor[differs]
            score = some[at, anchor]
            for n in range(positives):
                fits = (score >= floor[anchor, n]) & (score <= high[anchor, n])
                idents = candidates.ids[at[fits] + start]
                best.add(anchor[fits] * positives + n, score[fits], idents)

    sides = _named(candidate_blocks, "c_", *SHAPE)

    def one_round(first: int, last: int) -> DataFrame:
        some = anchor_blocks.where(F.col("block").between(first, last))
        some = some.withColumn("first", F.lit(0))
        few = _named(some, "a_", "block", "first", "keys", "scores", *SHAPE)
        meeting = sides.withColumn("met", F.explode(F.sequence(F.lit(first), F.lit(last))))
        pairs = meeting.join(F.broadcast(few), F.col("met") == F.col("a_block"))
        return _best_lists(pairs, positives, negatives, chosen)

    lists = _in_rounds(anchor_blocks, one_round)
    if lists is None:
        return None
    return _ranked(lists, negatives).select(
        "key",
        (F.col("slot") + 1).alias("positive"),
        F.col("place").alias("rank"),
        F.col("ident").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )


RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, "
    "positive_score long, negative_score long"
)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    least_percent: int = 50,
    most_percent: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and ``parts``, an array of whole numbers; ``anchors``
    is a condition on it. Each anchor's positives are its best other rows of the same
    label, each positive's negatives the best rows of another label with a score between
    the two percentages of the positive's; higher scores first, ties by smaller id.

    Rows with a NULL vec_id, label, vector or component take no part. Rows that repeat
    as a whole count once; rows that share only the id are different ones. A shorter
    vector counts as ended by zeros, an empty one scores 0 with everything. Scores are
    exact; one without room in 64 bits is the nearest number with room. Columns besides
    these are not read. An empty table, no anchors or one label give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("parts").cast("array<long>").alias("parts"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    rows = rows.where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND parts IS NOT NULL"
        " AND NOT exists(parts, x -> x IS NULL)"
    ).dropDuplicates()
    rows = written(
        rows.select(
            "*", F.lit(0).cast("long").alias("key"), F.array().cast("array<long>").alias("scores")
        ),
        "vectors",
    )

    def sorted_by_label(df: DataFrame) -> DataFrame:
        tasks = 2 * spark.sparkContext.defaultParallelism
        tasks = max(tasks, -(-df.count() // TASK_ROWS))
        ordered = df.repartitionByRange(tasks, "label", "vec_id")
        return ordered.sortWithinPartitions("label", "vec_id")

    candidate_blocks = blocks(sorted_by_label(rows), 0)
    starts = written(
        rows.where("anchor").withColumn("key", F.monotonically_increasing_id()), "anchors"
    )
    anchor_blocks = numbered(blocks(starts.sortWithinPartitions("label"), 0))
    found = nearest_of_label(candidate_blocks, anchor_blocks, positives)
    if found is None:
        return spark.createDataFrame([], RESULT)
    found = written(found, "positives")
    scores = found.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("positive", "positive_score"))).alias("best")
    )
    limited = starts.drop("scores").join(scores, "key")
    limited = limited.withColumn("scores", F.col("best.positive_score"))
    limited_blocks = numbered(blocks(limited.sortWithinPartitions("label"), positives))
    worst = between_shares(
        candidate_blocks, limited_blocks, positives, negatives, least_percent, most_percent
    )
    if worst is None:
        return spark.createDataFrame([], RESULT)
    return (
        worst.join(found, ["key", "positive"])
        .join(starts.select("key", F.col("vec_id").alias("anchor_id")), "key")
        .selectExpr(
            "anchor_id", "positive_id", "cast(rank AS int) AS rank",
            "negative_id", "positive_score", "negative_score",
        )
    )


def whole_numbers(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``embeddings`` with ``parts``, floor(scale * x) of each component of
    ``embedding``; rows without a label or vector, or with a NULL or non-finite
    component, are left out."""
    usable = (
        "label IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding,"
        " x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
    )
    parts = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return embeddings.where(usable).select("vec_id", "label", parts.alias("parts"))
