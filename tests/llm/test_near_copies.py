"""The near-duplicate stage against all pairs of five-word shingle sets."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberlog.llm import minhash, simhash
from emberlog.llm.components import components


def jaccard(a: str, b: str) -> float:
    sets = []
    for text in (a, b):
        words = text.lower().split()
        sets.append({tuple(words[n : n + 5]) for n in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(rng: random.Random, text: str, changes: int) -> str:
    words = text.split()
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"other{rng.randrange(1000)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_stage_links_all_similar_texts(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(4)
    texts = []
    for n in range(25):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 400])))
        texts += [base, edited(rng, base, 1), edited(rng, base, max(1, len(base.split()) // 50))]
        texts.append(edited(rng, base, len(base.split()) // 8))
    base = " ".join(f"v{n}" for n in range(300))
    texts += [edited(rng, base, 3) for _ in range(40)]
    texts += ["two words", "Two  words", "three other words", "", "", "  "]
    root = list(range(len(texts)))

    def find(n: int) -> int:
        return n if root[n] == n else find(root[n])

    far = 0
    for a in range(len(texts)):
        for b in range(a):
            empty = [not texts[n].strip() for n in (a, b)]
            if all(empty) or not any(empty) and jaccard(texts[a], texts[b]) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
                prints = [np.uint64(simhash.fingerprint(texts[n])) for n in (a, b)]
                far += int(np.bitwise_count(prints[0] ^ prints[1])) > simhash.MOST_BITS
    assert far > 20
    rows = [(n, t or None) for n, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    wanted = sorted({find(n) for n in range(len(texts))})
    assert sorted(r["doc_id"] for r in kept.collect()) == wanted
    assert corpus_pipeline.one_of_each(spark, docs.limit(0), "").collect() == []


def shared_words(rng: random.Random, base: list[str], kept: int) -> str:
    """A text that has the first ``kept`` words of a boilerplate and its own rest."""
    return " ".join(base[:kept] + [f"o{rng.randrange(10**9)}" for _ in range(len(base) - kept)])


def test_a_boilerplate_family_costs_in_proportion_to_its_members(spark, monkeypatch):
    """Texts of one family, far from similar, no longer form one group to verify."""
    rng = random.Random(8)
    base = [f"b{n}" for n in range(200)]
    texts = [shared_words(rng, base, rng.randint(100, 125)) for _ in range(1500)]
    sample = [jaccard(*rng.sample(texts, 2)) for _ in range(200)]
    assert 0.3 < min(sample) and max(sample) < 0.5
    members = []
    plain = minhash.group_links

    def counted(rows, kind, size):
        if kind is minhash.Sets:
            members.append(rows.groupBy("root").count().agg(F.max("count"), F.sum("count")).first())
        return plain(rows, kind, size)

    monkeypatch.setattr(minhash, "group_links", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert corpus_pipeline.one_of_each(spark, docs, "").count() == 1500
    largest, all_of_them = members[0]
    assert (largest or 0) < 30 and (all_of_them or 0) < 150


def test_recall_of_planted_pairs(spark):
    """Pairs of just enough similarity: at least 0.99 are found."""
    rng = random.Random(9)
    texts, planted = [], 0
    for _ in range(1500):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 150, 300]))]
        a = " ".join(words)
        b = edited(rng, a, 1)
        at = len(words)
        while jaccard(a, b) > 0.85:
            at -= len(words) // 60
            b = edited(rng, " ".join(words[:at]), 1)
        if jaccard(a, b) >= 0.8:
            planted += 1
            texts += [a, b]
    assert planted > 1000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()}
    missed = sum(n in kept for n in range(1, len(texts), 2))
    assert missed <= 0.01 * planted


def test_links_of_a_hot_node_are_not_gathered(spark):
    """Components of a star and a chain, with links enough for hot nodes."""
    rows = [(0, n) for n in range(1, 4000)] + [(n, n + 1) for n in range(10_000, 10_300)]
    links = spark.createDataFrame(rows, "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {n: 0 for n in range(1, 4000)} | {n: 10_000 for n in range(10_001, 10_301)}


def test_operator_4_links_sets_that_share_no_minhash_key(spark):
    rng = random.Random(11)
    base = " ".join(f"w{n}" for n in range(600))
    texts = [base, base + " end", "first " + base, base.replace("w300 ", "")]
    texts += [" ".join(f"x{rng.randrange(9000)}" for _ in range(200)) for _ in range(5)]
    texts += ["", None]
    prints = [simhash.majority(minhash.shingles(t)) for t in texts]
    assert all((prints[0] ^ p).bit_count() <= simhash.MOST_BITS for p in prints[1:4])
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    rows = minhash.signatures(docs, "row").cache()
    codes = [r["code"] for r in rows.orderBy("row").collect()]
    # Each set has a key of its own.
    apart = rows.withColumn("keys", F.when(F.size("keys") > 0, F.array("code")).otherwise(F.array()))
    found = minhash.grouped_codes(minhash.written(apart, "apart"), docs, "row").collect()
    assert {(r["code"], r["root"]) for r in found} == {
        (c, min(codes[:4])) for c in codes[:4] if c != min(codes[:4])
    }
