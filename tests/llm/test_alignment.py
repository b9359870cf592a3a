from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from emberlog.llm import alignment
from emberlog.llm.alignment import align_documents, aligned_texts, pair_counts
from emberlog.llm.encoding import byte_characters

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
ODD = [
    "a",
    " ",
    "  two  spaces \n\n and\ttabs  ",
    "don't we'll I'M 3,000.50 x=y;z ...",
    "naïve İstanbul ﬁ 中文字 日本語 🙂👍🏽 é",
    "a b   c \x1c d \x85 e \x00 f",
    "<|endoftext|> <s> </s> <unk> <0x41> <|startoftext|>",
    "holds▁the mark",
    "▁",
    "x" * 3000,
    "word " * 500,
    "the river and the stone",
]


def brute(texts):
    """The definition, over whole texts and every pair of tokens."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {c: n for n, c in byte_characters().items()}
    rows = []
    for text in texts:
        whole = b" " + (text or "").encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        parts_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        parts_b = [
            bytes([int(b.id_to_piece(i)[3:5], 16)])
            if b.is_byte(i)
            else b.id_to_piece(i).replace("▁", " ").encode()
            for i in ids_b
        ]
        if not text or b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            rows.append(None)
            continue
        ends_a = [sum(map(len, parts_a[: n + 1])) for n in range(len(parts_a))]
        ends_b = [sum(map(len, parts_b[: n + 1])) for n in range(len(parts_b))]
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, last = [], 0
        for cut in cuts:
            mine = [str(i) for i, e in zip(ids_a, ends_a) if last < e <= cut]
            yours = [str(i) for i, e in zip(ids_b, ends_b) if last < e <= cut]
            groups.append(",".join(mine) + "|" + ",".join(yours))
            last = cut
        links = [(ids_a[ends_a.index(c)], ids_b[ends_b.index(c)]) for c in cuts]
        rows.append((len(ids_a), len(ids_b), groups, links))
    counts = Counter(link for row in rows if row for link in row[3])
    highest: Counter = Counter()
    for (_, id_b), n in counts.items():
        highest[id_b] = max(highest[id_b], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = row
        best = sum(counts[link] == highest[link[1]] for link in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        total = sum(counts[link] for link in links)
        out.append((n_a, n_b, len(groups), len(links), best, total, digest))
    return out, counts


def measured(docs):
    result = align_documents(docs, A, B)
    assert result.columns == COLUMNS
    return Counter(tuple(r) for r in result.collect())


def expected(pairs):
    return Counter((doc_id, *row) for (doc_id, _), row in zip(pairs, brute([t for _, t in pairs])[0]))


@pytest.mark.parametrize("hot_pairs, hot_texts", [(1 << 20, 1000), (5, 1)])
def test_equal_to_the_definition(spark, documents, monkeypatch, hot_pairs, hot_texts):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot_pairs)
    monkeypatch.setattr(alignment, "HOT_TEXTS", hot_texts)
    odd = spark.createDataFrame(list(enumerate(ODD, 1000)), "doc_id long, text string")
    docs = documents.select("doc_id", "text").where("doc_id IS NULL OR doc_id <> 104")
    docs = docs.unionByName(odd).unionByName(odd.where("doc_id > 1010"))
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert measured(docs) == expected(pairs)


def test_small_chunks_and_a_text_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 3)
    pairs = [(n, ODD[3] if n % 3 else ODD[n % len(ODD)]) for n in range(300)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    assert measured(docs) == expected(pairs)


def test_groups_and_pair_counts_are_kept(spark):
    pairs = [(n, text) for n, text in enumerate(ODD * 2)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    aligned = aligned_texts(docs, A, B)
    for row in aligned.collect():
        digest = hashlib.sha256(row.groups.encode()).hexdigest() if row.n_a else ""
        assert row.copies == 2 and row.groups_sha256 == digest
    counts = {(r.id_a, r.id_b): r.n for r in pair_counts(aligned).collect()}
    assert counts == brute(t for _, t in pairs)[1]


def test_very_long_texts(spark):
    texts = [(1, "stone river " * 200_000), (2, "y" * 300_000)]
    rows = align_documents(spark.createDataFrame(texts, "doc_id long, text string"), A, B).collect()
    wanted = [len(Tokenizer.from_file(A).encode(" " + t).ids) for _, t in texts]
    assert [r.n_a for r in sorted(rows)] == wanted


def test_no_documents(nothing):
    assert align_documents(nothing, A, B).collect() == []
