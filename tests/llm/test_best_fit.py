from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emberlog.llm import best_fit, grouping
from emberlog.llm.best_fit import pack_best_fit
from emberlog.llm.grouping import least_sequences, pack_lengths

PATH = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = "doc_id piece start length ids_crc32 sequence_id offset ids".split()


def one_by_one(lengths, capacity):
    """Plain best fit, longest first: how many sequences it takes."""
    rooms: list[int] = []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(capacity - length)
    return len(rooms)


def packed(lengths, capacity, **more):
    patterns = pack_lengths(dict(Counter(lengths)), capacity, **more)
    held: Counter = Counter()
    for pattern in patterns:
        assert 0 < pattern.used <= capacity and pattern.count > 0
        for length, n in pattern.entries:
            held[length] += n * pattern.count
    assert held == Counter(lengths)
    return sum(pattern.count for pattern in patterns)


@pytest.mark.parametrize("seed", range(30))
def test_whole_and_no_worse_than_plain_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100, 257])
    top = rng.choice([capacity, capacity // 2, capacity // 3])
    lengths = [rng.randint(1, max(1, top)) for _ in range(rng.randint(0, 400))]
    count = packed(lengths, capacity, groups=rng.choice([1, 3, 20]))
    assert least_sequences(Counter(lengths), capacity) <= count <= one_by_one(lengths, capacity)


def test_bulk_best_fit_is_best_fit():
    for seed in range(40):
        rng = random.Random(seed)
        lengths = [rng.choice([3, 4, 7, rng.randint(1, 50)]) for _ in range(rng.randint(1, 300))]
        patterns = grouping.best_fit([], dict(Counter(lengths)), 50)
        assert sum(p.count for p in patterns) == one_by_one(lengths, 50)


def test_configurations_beat_best_fit_where_lengths_must_be_mixed():
    # Of each of these three fit a sequence only in the right mix.
    rng = np.random.default_rng(3)
    lengths = [int(n) for n in rng.integers(600, 760, 3000)]
    assert packed(lengths, 2048) < 0.95 * one_by_one(lengths, 2048)


def test_few_sizes_are_packed_best():
    assert packed([512] * 401, 2048) == 101
    assert packed([1024] * 10 + [2048] * 3, 2048) == 8
    assert packed([1] * 5000, 2048) == 3
    assert packed([683] * 300 + [682] * 600, 2048) == 300


def check(rows, docs, sequence):
    tokenizer = Tokenizer.from_file(PATH)
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t in docs]
    wanted: Counter = Counter()
    for (doc_id, _), one in zip(docs, ids):
        for piece, at in enumerate(range(0, len(one), sequence)):
            wanted[doc_id, piece, at, tuple(one[at : at + sequence])] += 1
    got: Counter = Counter()
    sequences = defaultdict(list)
    for row in rows:
        some = tuple(np.frombuffer(row.ids, "<u4").tolist())
        assert row.length == len(some) and row.ids_crc32 == zlib.crc32(row.ids)
        got[row.doc_id, row.piece, row.start, some] += 1
        sequences[row.sequence_id].append((row.offset, row.length))
    assert got == wanted
    for held in sequences.values():
        place = 0
        for offset, length in sorted(held):
            assert offset == place
            place += length
        assert place <= sequence
    lengths = [len(one[at : at + sequence]) for one in ids for at in range(0, len(one), sequence)]
    assert len(sequences) <= one_by_one(lengths, sequence)


@pytest.mark.parametrize("bases", [0, 500_000])
def test_every_piece_once(spark, documents, monkeypatch, bases):
    monkeypatch.setattr(best_fit, "MOST_BROADCAST_BASES", bases)
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    result = pack_best_fit(documents, PATH, sequence=128)
    assert result.columns == COLUMNS
    check(result.collect(), docs, 128)


def test_one_length_in_a_third_of_all_rows(spark):
    texts = [(n, "same words again" if n % 3 else "stone " * (n % 90)) for n in range(900)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    check(pack_best_fit(docs, PATH, sequence=64).collect(), texts, 64)


def test_no_documents(nothing):
    assert pack_best_fit(nothing, PATH).collect() == []
