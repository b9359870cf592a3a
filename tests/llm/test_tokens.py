"""Token counts, token files and packing against the tokenizers library."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emberlog.llm import encoding, packing, token_files, transducer

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "B", "the", " ", "  ", "\n", "\t", " '", "'s", "'re", "'r", "'ll", "'v", "1", "23",
    "é", "ñ", "中文", "　", "\xa0", "\x1c", "\x85", "!", "??", "<|endoftext|>",
    "<|EndOfText|>", "'", "'d've", "ing", "tion", "😀", "é", "A", "_", "-", "\r\n", "²",
    "ſ", "İ", "Σ", "ß", "​", "<|startoftext|>",
]


@pytest.fixture(scope="module")
def library():
    tokenizers = {path: Tokenizer.from_file(path) for path in (WORD, BYTE)}
    return lambda path, text: tokenizers[path].encode(text or "", add_special_tokens=False).ids


def packed_ids(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_counts_of_any_text(library, monkeypatch):
    monkeypatch.setattr(transducer, "CHUNK_CHARS", 7)
    monkeypatch.setattr(transducer, "MOST_TRANSITIONS", 2000)
    rng, machine = random.Random(1), transducer.Transducer(BYTE)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(4000)]
    texts += ["a" * n for n in range(0, 150, 7)] + ["-=*" * n for n in range(0, 60, 5)]
    texts += ["".join(rng.choices("etaoinshr", k=n)) for n in range(1, 300, 9)]
    assert [machine.count(t) for t in texts] == [len(library(BYTE, t)) for t in texts]


def test_chunk_maps_compose_in_any_order():
    machine = transducer.Transducer(BYTE)
    text = "some words, and'll more  of\nthem without_any_break_at_all end"
    maps = [machine.chunk_map(text[i : i + 9], i == 0) for i in range(0, len(text), 9)]
    left = maps[0]
    for one in maps[1:]:
        left = machine.compose(left, one)
    right = maps[-1]
    for one in reversed(maps[:-1]):
        right = machine.compose(one, right)
    assert left[1] == right[1] == machine.count(text)


def test_ids_of_any_text(library, monkeypatch):
    monkeypatch.setattr(encoding, "MOST_PIECES", 50)
    rng, pieces = random.Random(2), encoding.Pieces(WORD)
    for _ in range(4000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 12)))
        assert pieces.encode(text) == packed_ids(library(WORD, text)), repr(text)


def test_token_counts(documents, nothing, library):
    got = transducer.token_counts(documents, BYTE, limit=50).collect()
    texts = [r["text"] for r in documents.select("doc_id", "text").collect()]
    wanted = [
        (len((t or "").encode()), len(library(BYTE, t)), len(library(BYTE, t)) > 50) for t in texts
    ]
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted(wanted)
    assert transducer.token_counts(nothing, BYTE).collect() == []


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for ids in (
        np.array([7]), np.array([5] * 300), np.array([0, 2**32 - 1]), rng.integers(0, 49_408, 4096),
        np.where(rng.random(1000) < 0.01, 2**31, rng.integers(0, 60, 1000)),
    ):
        ids = ids.astype(np.uint32)
        for percentile in (0.0, 50.0, 98.0, 100.0):
            block = token_files.write_block(ids, percentile)
            assert (token_files.read_block(block, 0) == ids).all()


def test_outliers_are_patched():
    ids = np.array([10] * 990 + [40_000] * 10, np.uint32)
    assert len(token_files.write_block(ids)) < 200 < len(token_files.write_block(ids, 100.0))


def test_segment_finds_one_document(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 16)
    documents = [packed_ids(range(n, 3 * n)) for n in (1, 40, 3, 16, 0, 5)]
    segment = token_files.Segment(token_files.write_segment(documents))
    for n, one in enumerate(documents):
        assert segment.document(n).astype("<u4").tobytes() == one
    assert [d.astype("<u4").tobytes() for d in segment.documents()] == documents


def test_token_files(documents, nothing, library, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 300)
    got = token_files.token_files(documents, WORD).collect()
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == [
        sum(r["n_tokens"] for r in by_start[:n]) for n in range(len(by_start))
    ]
    ids = [r["doc_id"] for r in by_start]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    wanted = [
        (r["doc_id"], zlib.crc32(packed_ids([*library(WORD, r["text"]), 1])))
        for r in documents.collect()
    ]
    assert sorted(map(str, wanted)) == sorted(str((r["doc_id"], r["ids_crc32"])) for r in got)
    assert token_files.token_files(nothing, WORD).collect() == []


def test_packing(documents, nothing, library):
    pieces = packing.pack(documents, WORD, length=64).collect()
    by_sequence = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == sum(q["length"] for q in by_sequence.get(p["sequence_id"], []))
        assert p["ids_crc32"] == zlib.crc32(p["ids"]) and len(p["ids"]) == 4 * p["length"]
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    fill = [sum(p["length"] for p in by_sequence[s]) for s in sorted(by_sequence)]
    assert sorted(by_sequence) == list(range(len(fill)))
    assert set(fill[:-1]) == {64} and 0 < fill[-1] <= 64
    stream = b"".join(p["ids"] for s in sorted(by_sequence) for p in by_sequence[s])
    texts = [packed_ids([*library(WORD, r["text"]), 1]) for r in documents.collect()]
    assert len(stream) == sum(map(len, texts))
    whole = [p for p in pieces if p["length"] == p["doc_tokens"]]
    assert all(p["ids"] in texts for p in whole) and len(whole) > 20
    starts = sorted(p["length"] for p in pieces if p["doc_id"] == 104)
    assert sum(starts) == len(library(WORD, documents.where("doc_id = 104").first()["text"])) + 1
    assert packing.pack(nothing, WORD).collect() == []


def test_bases_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 4)
    totals = spark.createDataFrame([(n, n * n) for n in range(23)], "part int, total long")
    got = {r["part"]: r["base"] for r in packing.part_bases(totals).collect()}
    assert got == {n: sum(k * k for k in range(n)) for n in range(23)}


def test_an_unbroken_text_keeps_the_transducer_small(monkeypatch):
    """States are dropped inside one text, and its count is the library's."""
    monkeypatch.setattr(transducer, "MOST_TRANSITIONS", 5000)
    monkeypatch.setattr(transducer, "STEP", 100)
    monkeypatch.setattr(transducer, "MOST_ALLOWED", 1000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, machine = Tokenizer.from_file(path), transducer.Transducer(path)
    rng = random.Random(2)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(150_000))
    mixed = "".join(rng.choice("abXY01-_é'") for _ in range(90_000))
    for text in (letters, mixed, letters[:70_000] + " " + mixed[:3000]):
        assert machine.count(text) == len(library.encode(text).ids)
        assert machine.transitions <= 5100 and len(machine.merges.allowed) <= 1000
    assert all(len(piece) <= transducer.LONGEST_MACRO for piece in machine.macros)


def test_long_pieces_of_letters_and_digits(monkeypatch):
    monkeypatch.setattr(encoding, "LONG", 50)
    path = public_tokenizers.path("word_bpe_49k.json")
    library, pieces = Tokenizer.from_file(path), encoding.Pieces(path)
    rng = random.Random(3)
    for kind in ("abc012", "aZ9+/=", "éa1<|endoftext|>", "a1 "):
        text = "".join(rng.choice(kind) for _ in range(4000))
        ids = np.frombuffer(pieces.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
    assert all(len(piece) <= encoding.LONGEST_PIECE for piece in pieces)
