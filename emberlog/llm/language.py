"""Operator 2: language identification by language-bitmask n-gram filters.

One Bloom filter answers for all languages: each of its positions holds a mask with a
bit per language, in as many 64-bit words as they need, and the AND of an n-gram's positions is the set of languages that
contain it. A text's hits are counted per language, corrected for the hits that the
filter's fill alone would give, and the largest share decides.

The filter's size, the n-grams it takes and the rows it is fitted on per language are
parameters; none grows with the data. Its n-grams are three characters, the middle one
a letter; other characters count as one blank.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import crc32_mod, map_batches, worker_cache, written

POSITIONS = 1 << 18
PROBES = 3
GRAMS_PER_LANGUAGE = 20_000
# Labelled rows of a language the filter is fitted on; more are thinned out by a hash of
# their id.
MOST_TRAINING_ROWS = 20_000
# An n-gram belongs to a language in which its share is at least this part of its
# largest share in any: documents with foreign passages would fill the filter else.
LEAST_SHARE = 0.25
MASK_BITS = 64
UNDETERMINED = "und"
RESULTS = ("lang_pred", "score")
# Characters worked on at a time, so that memory does not follow a text's length.
BLOCK_CHARS = 1 << 18


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> list[np.ndarray]:
    """Hashes of a text's n-grams, one per letter, in blocks."""
    letters = worker_cache(("letters",), letter_table)
    found = []
    padded = f" {(text or '').lower()} "
    for at in range(0, len(padded) - 2, BLOCK_CHARS):
        block = padded[at : at + BLOCK_CHARS + 2].encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(block, "<u4")
        known = letters[codes]
        codes = np.where(known, codes, 32).astype(np.uint64)
        code = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
        found.append(mix(code[known[1:-1]]))
    return found


def mix(code: np.ndarray) -> np.ndarray:
    code = (code ^ (code >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    code = (code ^ (code >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return code ^ (code >> np.uint64(33))


def probes(hashes: np.ndarray, positions: int = POSITIONS) -> list[np.ndarray]:
    return [
        ((hashes >> np.uint64(20 * n)) % np.uint64(positions)).astype(np.int64)
        for n in range(PROBES)
    ]


@dataclass
class Filter:
    languages: list[str]
    masks: np.ndarray
    false_positive: np.ndarray

    def decide(self, text: str | None) -> tuple[str, float]:
        """The language and the corrected share of the n-grams that it contains."""
        hits, total = np.zeros(len(self.languages)), 0
        for hashes in grams(text):
            total += len(hashes)
            first, *others = probes(hashes)
            held = self.masks[first]
            for places in others:
                held &= self.masks[places]
            for n in range(len(self.languages)):
                word, bit = divmod(n, MASK_BITS)
                hits[n] += np.count_nonzero(held[:, word] >> np.uint64(bit) & np.uint64(1))
        if not total or not self.languages:
            return UNDETERMINED, 0.0
        share = (hits / total - self.false_positive) / (1 - self.false_positive)
        best = int(np.argmax(share))
        return self.languages[best], float(min(1.0, max(0.0, share[best])))


def build_filter(rows: list[tuple[str, int]], languages: list[str]) -> Filter:
    """From (language, n-gram hash); languages in the order that wins ties."""
    words = max(1, -(-len(languages) // MASK_BITS))
    masks = np.zeros((POSITIONS, words), np.uint64)
    fill = np.zeros(len(languages))
    by_language: dict[str, list[int]] = {}
    for name, gram in rows:
        by_language.setdefault(name, []).append(gram)
    for n, language in enumerate(languages):
        word, bit = divmod(n, MASK_BITS)
        hashes = np.array(by_language.get(language, []), np.int64)
        for places in probes(hashes.view(np.uint64)):
            masks[np.unique(places), word] |= np.uint64(1 << bit)
        fill[n] = np.count_nonzero(masks[:, word] >> np.uint64(bit) & np.uint64(1)) / POSITIONS
    return Filter(languages, masks, fill**PROBES)


def fit(labelled: DataFrame, most_rows: int = MOST_TRAINING_ROWS) -> Filter:
    """A filter from (doc_id, text, lang), of about ``most_rows`` rows of each language
    at most. Rows without text or lang are left out."""
    usable = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select(
        "doc_id", "text", "lang"
    )
    rows = usable.groupBy(F.col("lang").alias("__lang")).agg(F.count(F.lit(1)).alias("__rows"))
    rows = rows.where(F.col("__rows") > most_rows).collect()
    if rows:
        many = usable.sparkSession.createDataFrame(
            [(r["__lang"], most_rows / r["__rows"]) for r in rows], "__lang string, __part double"
        )
        scale = 1 << 40
        drawn = F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < F.col("__part") * scale
        usable = usable.join(F.broadcast(many), usable.lang == F.col("__lang"), "left").where(
            F.col("__part").isNull() | drawn
        )

    def make():
        def convert(batch: pa.RecordBatch) -> dict:
            sums: dict[str, dict[int, int]] = {}
            for text, language in zip(*(batch.column(n).to_pylist() for n in range(2))):
                own = sums.setdefault(language, {})
                for hashes in grams(text):
                    values, counts = np.unique(hashes, return_counts=True)
                    for value, count in zip(values.view(np.int64).tolist(), counts.tolist()):
                        own[value] = own.get(value, 0) + count
            rows = [(name, g, c) for name, own in sums.items() for g, c in own.items()]
            return {
                "lang": [r[0] for r in rows],
                "gram": [r[1] for r in rows],
                "n": [r[2] for r in rows],
            }

        return convert

    counted = written(
        map_batches(usable.select("text", "lang"), make, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n")),
        "grams",
    )
    totals = (
        counted.groupBy("lang")
        .agg(F.sum("n").alias("total"))
        .orderBy(F.desc("total"), "lang")
        .collect()
    )
    if not totals:
        return build_filter([], [])
    total = counted.sparkSession.createDataFrame(
        [(row["lang"], row["total"]) for row in totals], "lang string, total long"
    )
    per_gram, per_lang = Window.partitionBy("gram"), Window.partitionBy("lang")
    chosen = (
        counted.join(F.broadcast(total), "lang")
        .withColumn("share", F.col("n") / F.col("total"))
        .withColumn("most", F.max("share").over(per_gram))
        .where(F.col("share") >= LEAST_SHARE * F.col("most"))
        .withColumn("rank", F.row_number().over(per_lang.orderBy(F.desc("n"), "gram")))
        .where(F.col("rank") <= GRAMS_PER_LANGUAGE)
        .select("lang", "gram")
        .collect()
    )
    return build_filter([(r["lang"], r["gram"]) for r in chosen], [r["lang"] for r in totals])


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows whose language may be learned from."""
    return docs.where(crc32_mod("doc_id", 3) != 1)


def identify(
    docs: DataFrame, model: Filter, *carried: str, names: tuple[str, str] = RESULTS
) -> DataFrame:
    """The carried columns, lang_pred and score of each row, from its text alone.

    ``names`` are the results' names, for tables that have columns called so.
    """

    read = [*carried] if "text" in carried else [*carried, "text"]

    def make():
        def convert(batch: pa.RecordBatch) -> dict:
            out = {name: batch.column(n) for n, name in enumerate(carried)}
            found = [model.decide(t) for t in batch.column(read.index("text")).to_pylist()]
            return out | {names[0]: [f[0] for f in found], names[1]: [f[1] for f in found]}

        return convert

    types = dict(docs.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in carried)
    schema += f"`{names[0]}` string, `{names[1]}` double"
    return map_batches(docs.select(*read), make, schema)


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``docs``.

    A NULL text, and one without a letter, is ``und`` with score 0; so is every text if
    no row has a language to learn. Ties go to the language with more text. A row with
    a NULL doc_id is neither learned from nor held out. Rows may repeat; no rows give
    none. Columns other than doc_id, text and lang are not read.
    """
    model = fit(training_rows(docs))
    found = identify(docs, model, "doc_id")
    held_out = F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
