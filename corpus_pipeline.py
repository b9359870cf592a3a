"""The corpus pipeline: from raw documents to packed training sequences.

Every stage works on all rows that the one before kept; its result is written and read
again. What the first four reject is gone: texts of no known language, toxic texts, all
but one document of each group of near copies, and texts that hold benchmark items.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import language, toxicity
from emberlog.llm.common import table, written
from emberlog.llm.minhash import distinct_documents
from emberlog.llm.packing import pack
from emberlog.llm.templates import clean
from emberlog.session import checkpoint_root

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"
# A text is of no known language if fewer of its n-grams, corrected for false
# positives, belong to the best one.
LEAST_KNOWN = 0.3


def free_names(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, lengthened where ``docs`` has a column called so."""
    free = []
    for name in names:
        while name in docs.columns:
            name += "_"
        free.append(name)
    return tuple(free)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of a language learned from ``docs``; NULL texts and texts without letters
    have none and go, as do all rows if no row has a language. Repeated rows stay."""
    model = language.fit(language.training_rows(docs))
    names = free_names(docs, *language.RESULTS)
    found = language.identify(docs, model, *docs.columns, names=names)
    known = (F.col(names[0]) != language.UNDETERMINED) & (F.col(names[1]) >= LEAST_KNOWN)
    return found.where(known).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is not toxic; NULL and empty texts stay, as does everything if
    the labels lack one of the two classes."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    names = free_names(docs, *toxicity.RESULTS)
    found = toxicity.score(docs, model, *docs.columns, names=names)
    return found.where(F.col(names[1]) == 0).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return distinct_documents(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; NULL and empty texts stay, as does everything
    without a benchmark. Rows that share a doc_id go together."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path(TOKENIZER)).drop("ids")


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("packing", packed),
]

# No stage can be said in SQL.
ORACLE_SQL: str | None = None


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a run wrote the whole of ``path``; it says so beside it, last."""
    try:
        return not spark.read.schema("done boolean").parquet(f"{path}.done").isEmpty()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def run(spark: SparkSession, sf_dir: str, run_name: str | None = None) -> DataFrame:
    """The packed rows. With a ``run_name`` each stage is written under that name in the
    shared folder, and a run that is repeated goes on after the last finished stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        if run_name is None:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
            continue
        path = f"{checkpoint_root(spark)}/run-{run_name}/{name}"
        if not finished(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
            spark.range(1).selectExpr("true AS done").write.mode("overwrite").parquet(f"{path}.done")
        docs = spark.read.parquet(path)
    return docs
