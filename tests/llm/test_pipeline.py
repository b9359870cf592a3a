"""The pipeline on a small corpus with every kind of document that it rejects."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import sentence


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder = random.Random(8), tmp_path_factory.mktemp("corpus")
    rows, labels = [], []
    for n in range(300):
        lang = "en" if n % 2 else "de"
        text = sentence(rng, lang, 60)
        if n % 10 == 0:
            text = text.replace(" ", " dimwitted ", 1).replace(".", " blithering.")
        rows.append((n, text, lang, "s", len(text)))
        labels.append((n, 1, int(n % 10 == 0)))
    item = "how many apples does the farmer keep if every basket holds twelve of them today"
    rows = [(*row, 0.5) for row in rows]
    rows += [
        (900, None, None, None, None, None),
        (901, "12 !! 34", "en", None, None, None),
        (902, rows[1][1], "en", "s", None, None),
        (902, rows[1][1], "en", "s", None, None),
        (903, sentence(rng, "en", 50) + f" {item}. " + sentence(rng, "en", 50), "en", None, None, None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    return str(folder), {r[0]: r[1] for r in rows}


def test_stages(spark, corpus):
    folder, texts = corpus
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), "test-stage")
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert docs.columns == columns or name == "packing"
    toxic = {n for n in range(300) if n % 10 == 0}
    assert set(texts) - set(kept["language"]) == {900, 901}
    assert kept["language"].count(902) == 2
    dropped = set(kept["language"]) - set(kept["toxicity"])
    assert len(dropped & toxic) >= 0.9 * len(toxic) and len(dropped - toxic) <= 6
    assert 902 not in kept["near_duplicates"] and 1 in kept["near_duplicates"]
    assert len(set(kept["toxicity"]) - {902} - set(kept["near_duplicates"])) == 0
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {903}
    assert set(kept["packing"]) == set(kept["decontamination"])
    pieces = docs.collect()
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    tokens = sum(
        len(library.encode(texts[n], add_special_tokens=False).ids) + 1
        for n in kept["decontamination"]
    )
    assert sum(p["length"] for p in pieces) == tokens
    assert max(p["offset"] + p["length"] for p in pieces) <= 2048


def test_run_is_the_stages_in_turn(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0])
    assert got.count() > 200 and len(corpus_pipeline.STAGES) == 5



def test_a_named_run_goes_on_after_the_last_finished_stage(spark, corpus, monkeypatch):
    calls, fails = [], ["third"]

    def stage(name):
        def made(spark, docs, sf_dir):
            calls.append(name)
            if name in fails:
                raise RuntimeError("lost")
            return docs.where(f"doc_id <> {len(name)}")

        return name, made

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage(n) for n in ("first", "second", "third")])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, corpus[0], "one-run")
    fails.clear()
    got = corpus_pipeline.run(spark, corpus[0], "one-run")
    assert calls == ["first", "second", "third", "third"]
    assert got.count() == corpus_pipeline.run(spark, corpus[0], "one-run").count() == 303
    assert calls == ["first", "second", "third", "third"]
