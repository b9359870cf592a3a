"""The queries of the operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.alignment import align_documents
from emberlog.llm.best_fit import pack_best_fit
from emberlog.llm.common import table
from emberlog.llm.extraction import main_text
from emberlog.llm.imatch import fingerprint_report
from emberlog.llm.language import languages
from emberlog.llm.negatives import hard_negatives, whole_numbers
from emberlog.llm.packing import pack
from emberlog.llm.sharding import shard_documents
from emberlog.llm.simhash import near_duplicates
from emberlog.llm.templates import contamination
from emberlog.llm.token_files import token_files
from emberlog.llm.toxicity import toxicity
from emberlog.llm.transducer import token_counts

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return token_files(documents, public_tokenizers.path(WORD_TOKENIZER))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pack(documents, public_tokenizers.path(WORD_TOKENIZER)).drop("ids")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return token_counts(documents, public_tokenizers.path(BYTE_TOKENIZER))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    embeddings = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives(whole_numbers(embeddings), F.col("vec_id") % 50 == 0)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    byte_tokenizer = public_tokenizers.path(BYTE_TOKENIZER)
    return align_documents(documents, byte_tokenizer, public_tokenizers.path(PIECE_TOKENIZER))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pack_best_fit(documents, public_tokenizers.path(WORD_TOKENIZER)).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_imatch": op1_imatch,
    "op2_language": op2_language,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_decontamination": op5_decontamination,
    "op6_token_files": op6_token_files,
    "op7_sharding": op7_sharding,
    "op8_main_text": op8_main_text,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_alignment": op12_alignment,
    "op13_best_fit": op13_best_fit,
}

ORACLES: dict[str, str] = {
    "op11_hard_negatives": """
        WITH usable AS (
            SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS parts,
                CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
                list_dot_product(a.parts, r.parts)::BIGINT AS score
            FROM usable a JOIN usable r ON a.vec_id <> r.vec_id
            WHERE a.vec_id % 50 = 0
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score
            FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, p.positive_id,
            (row_number() OVER best)::INTEGER AS rank,
            s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
        FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
            AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
        WINDOW best AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
        QUALIFY row_number() OVER best <= 3
    """,
}
