"""The registered queries over the smallest tables, whole."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from emberlog.llm.queries import QUERIES

COLUMNS = {
    1: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    2: "doc_id held_out lang_pred score",
    3: "doc_id held_out score predicted",
    4: "doc_id fingerprint component_id",
    5: "doc_id contaminated item_id coverage items",
    6: "doc_id start n_tokens ids_crc32",
    7: "doc_id size text_crc32 law shard slot grown_shard",
    8: "page_id url text n_chars",
    9: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    10: "doc_id n_bytes n_tokens over_limit",
    11: "anchor_id positive_id rank negative_id positive_score negative_score",
    12: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    13: "doc_id piece start length ids_crc32 sequence_id offset",
}


def test_every_operator_is_registered_once():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_reads_its_whole_table(spark, name):
    number = int(re.match(r"op(\d+)_", name)[1])
    got = QUERIES[name](spark, entry.SMALLEST)
    assert got.columns == COLUMNS[number].split()
    if number == 11:
        rows = spark.read.parquet(f"{entry.SMALLEST}/embeddings.parquet")
        anchors = {r[0] for r in rows.where("vec_id % 50 = 0").select("vec_id").collect()}
        assert {r["anchor_id"] for r in got.select("anchor_id").collect()} <= anchors
        return
    table, key = ("pages", "page_id") if number == 8 else ("documents", "doc_id")
    source = spark.read.parquet(f"{entry.SMALLEST}/{table}.parquet")
    ids = [r[0] for r in got.select(key).collect()]
    assert set(ids) == {r[0] for r in source.select(key).collect()}
    assert number in (9, 13) or len(ids) == source.count()
