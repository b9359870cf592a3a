from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import negatives
from emberlog.llm.negatives import hard_negatives, packed_scores, whole_numbers

SCHEMA = "vec_id long, embedding array<float>, label int, positive_id string, key string"
FIELDS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
LONG = 2**63


def plain(c, a):
    return [
        [max(-LONG, min(LONG - 1, sum(int(x) * int(y) for x, y in zip(u, v)))) for v in a]
        for u in c
    ]


@pytest.mark.parametrize("largest", [0, 1, 5, 300, 10**6, 10**9, 2**40, 2**62])
@pytest.mark.parametrize("shift", [0, 7, -(2**30)])
def test_packed_products_are_exact(largest, shift):
    rng = random.Random(largest)

    def matrix(rows, width):
        top = min(largest, 2**62)
        values = [[rng.randint(-top, top) + shift for _ in range(width)] for _ in range(rows)]
        return np.array(values, np.int64).reshape(rows, width)

    c, a = matrix(7, 5), matrix(4, 5)
    assert packed_scores(c, a).tolist() == plain(c, a)
    assert packed_scores(c, matrix(4, 0)).tolist() == [[0] * 4] * 7
    assert packed_scores(c[:, :3], a).tolist() == plain(c[:, :3], a[:, :3])


def brute(rows, positives=5, negatives_=3):
    usable = []
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        parts = tuple(math.floor(256 * float(np.float32(x))) for x in vector)
        if (vec_id, label, parts) not in usable:
            usable.append((vec_id, label, parts))
    out = []
    for row in usable:
        if row[0] % 50:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(row[2], other[2])), other[0], other[1])
            for other in usable
            if other != row
        )
        for score, positive, _ in [s for s in scored if s[2] == row[1]][:positives]:
            fits = [
                s for s in scored if s[2] != row[1] and -50 * score <= -100 * s[0] <= -95 * score
            ]
            for rank, (worst, negative, _) in enumerate(fits[:negatives_], 1):
                out.append((row[0], positive, rank, negative, -score, -worst))
    return sorted(out)


def found(spark, rows, **more):
    vectors = whole_numbers(spark.createDataFrame(rows, SCHEMA).repartition(3))
    result = hard_negatives(vectors, F.col("vec_id") % 50 == 0, **more)
    assert result.columns == FIELDS
    return sorted(tuple(r) for r in result.collect())


def vectors(n, labels, seed, scale=1.0):
    rng = random.Random(seed)
    return [
        (i, [rng.gauss(0.1, scale) for _ in range(8)], rng.choice(labels), "x", None)
        for i in range(n)
    ]


def test_equal_to_brute_force_with_ties_and_a_hot_label(spark):
    rows = vectors(300, [0, 0, 0, 1, 2], 1)
    rows += [(300 + i, rows[i % 3][1], i % 2, None, None) for i in range(150)]
    assert found(spark, rows) == brute(rows)


def test_small_rounds_blocks_and_other_shares(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 1)
    monkeypatch.setattr(negatives, "ROUND_BYTES", 1)
    rows = vectors(400, list(range(7)), 2)
    assert found(spark, rows, positives=2, negatives=4) == brute(rows, 2, 4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(120, [3, None, 4], 3, 50.0)
    rows += [
        (50, rows[50][1], rows[50][2], "x", None),  # a repeated anchor
        (100, [1.0] * 8, 3, None, None),  # another vector of the same id
        (None, [1.0] * 8, 3, None, None),
        (200, None, 3, None, None),
        (250, [1.0, None], 3, None, None),
        (300, [nan] + [0.0] * 7, 4, None, None),
        (350, [inf] + [0.0] * 7, 4, None, None),
        (400, [], 3, None, None),
        (450, [0.5, 2.0], 4, None, None),
        (500, [0.0] * 8, 4, None, None),
        (501, [3e4] * 8, 3, None, None),
        (550, [-2e9] * 8, 4, None, None),
    ]
    assert found(spark, rows) == brute(rows)


def test_nothing_to_find(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1, None, None)]) == []
    assert found(spark, [(50 * i, [1.0], 1, None, None) for i in range(4)]) == []
