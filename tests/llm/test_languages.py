"""Rare languages among many rows, and more languages than a mask word has bits."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from emberlog.llm import language


def test_rare_language_among_many_rows(spark):
    many = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.lit("the river and the stone").alias("text"), F.lit("en").alias("lang")
    )
    rare = spark.createDataFrame([(70_001, "größe über straße schön", "de")], many.schema)
    for seed in range(3):
        own = rare.withColumn("doc_id", F.col("doc_id") + seed)
        model = language.fit(many.unionByName(own), most_rows=500)
        assert model.languages == ["en", "de"]
        assert model.decide("größe über straße")[0] == "de"
        assert model.decide("the stone and the river")[0] == "en"


def test_more_languages_than_bits_of_a_word(spark):
    rng, rows, samples = random.Random(5), [], {}
    for n in range(70):
        letters = [chr(0x4E00 + 20 * n + k) for k in range(20)]
        text = " ".join("".join(rng.choices(letters, k=4)) for _ in range(30 + n))
        samples[f"l{n:02}"] = text
        rows.append((n, text, f"l{n:02}"))
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 70 and model.masks.shape[1] == 2
    assert all(model.decide(text)[0] == name for name, text in samples.items())
