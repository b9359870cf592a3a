"""Texts without a term in the band are equal only to those of the same terms."""

from __future__ import annotations

from emberlog.llm import imatch


def test_texts_without_terms_in_the_band(spark):
    texts = ["This.", "Thtion.", "this", "!!", "??", "", None, "the common words of all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprint_report(docs).collect()}
    assert prints[0] == prints[2] and prints[5] == prints[6]
    assert len({prints[n] for n in (0, 1, 3, 4, 5, 7)}) == 6
