"""Operator 3: toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text.
A window of a text is compressed with each; it is the nearer to toxic text the more
bytes the toxic dictionary saves. A document is scored by its windows' savings above
thresholds that are calibrated on the labelled rows.

A dictionary's content is trained as segments: words and beginnings of words, chosen
by the bytes they save times the documents they occur in. The toxic
dictionary holds those of ordinary text too, in the same place before the window, so
that the difference of two lengths is due to what only toxic text has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import crc32_mod, map_batches, worker_cache, written

WINDOW_BYTES = 96
STRIDE_BYTES = 76
# Labelled rows per class that the dictionaries and thresholds are fitted on; more are
# thinned out by a hash of their id.
MOST_ROWS_PER_CLASS = 3_000
SHORTEST, LONGEST, LONGEST_WORD = 4, 9, 14
TOXIC_SEGMENTS, ORDINARY_SEGMENTS = 200, 3_000
# A toxic segment occurs in so many toxic documents at least, a count and a share, and
# there so many times as often as in ordinary ones.
LEAST_DOCUMENTS, LEAST_PART, LEAST_RATIO = 4, 0.01, 20.0
# Segments of each kind that are looked at, the most useful ones.
CANDIDATES = 20_000
THRESHOLDS = (2, 3, 4, 5, 6)
MIN_MATCH = 4
# What a match costs, and the length beyond which a toxic segment is worth no more.
MATCH_BYTES, STEM_BYTES = 2.5, 8
RESULTS = ("score", "predicted")
LARGEST_SAVING, SHARE_SCALE = 12, 100

SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")


def segments(text: str) -> set[str]:
    """The words between blanks, and their beginnings and endings with one blank."""
    found = set()
    for word in set(WORD.findall(text.lower())):
        whole = f" {word} "
        found.add(whole[:LONGEST_WORD])
        for size in range(SHORTEST, min(len(whole) - 1, LONGEST)):
            found.add(whole[:size])
            found.add(whole[-size:])
    return found


def marks(text: str) -> list[int]:
    """Two min-hashes of the word shingles, which near copies mostly share."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    shingles = {" ".join(words[n : n + 3]) for n in range(max(1, len(words) - 2))}
    return [min(xxh64_intdigest(s, seed) >> 1 for s in shingles) for seed in (1, 2)]


def windows(text: str | None) -> list[bytes]:
    data = SPACE.sub(" ", f" {text or ''} ").lower().encode()
    last = max(1, len(data) - (WINDOW_BYTES - STRIDE_BYTES))
    return [data[at : at + WINDOW_BYTES] for at in range(0, last, STRIDE_BYTES)]


def compressor(content: bytes):
    import zstandard as zstd

    parameters = zstd.ZstdCompressionParameters(
        format=zstd.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
        window_log=16,
        hash_log=14,
        chain_log=14,
        search_log=5,
        min_match=MIN_MATCH,
        target_length=32,
        strategy=zstd.STRATEGY_LAZY,
    )
    if len(content) < 8:
        return zstd.ZstdCompressor(compression_params=parameters)
    return zstd.ZstdCompressor(
        dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT),
        compression_params=parameters,
    )


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    # Per threshold the share of ordinary text's windows over it.
    false_rates: np.ndarray
    weights: np.ndarray

    def compressors(self):
        build = lambda: (compressor(self.ordinary), compressor(self.toxic))
        return worker_cache(("toxicity", self.ordinary, self.toxic), build)

    def measures(self, text: str | None) -> np.ndarray:
        """Windows, the largest saving, and per threshold the windows that reach it."""
        plain, toxic = self.compressors()
        parts = windows(text)
        saved = [len(plain.compress(w)) - len(toxic.compress(w)) for w in parts]
        over = np.bincount(np.clip(saved, 0, THRESHOLDS[-1]), minlength=THRESHOLDS[-1] + 1)
        above = over[::-1].cumsum()[::-1]
        largest = min(max(0, *saved), LARGEST_SAVING)
        return np.array([len(parts), largest, *above[list(THRESHOLDS)]], float)

    def features(self, measures: np.ndarray) -> np.ndarray:
        """1, the largest saving, and for each threshold logarithms of the windows, and
        of their share, beyond those that ordinary text of this length has."""
        windows = measures[..., :1]
        beyond = (measures[..., 2:] - windows * self.false_rates).clip(0)
        return np.concatenate(
            [
                np.ones_like(windows),
                measures[..., 1:2],
                np.log1p(beyond),
                np.log1p(SHARE_SCALE * beyond / windows),
            ],
            axis=-1,
        )

    def score(self, text: str | None) -> float:
        total = self.features(self.measures(text)) @ self.weights
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def fit_weights(features: np.ndarray, labels: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; classes count alike, and no saving counts
    against a text: columns with a negative weight are left out one after the other."""
    weights = np.zeros(features.shape[1])
    if labels.all() or not labels.any():
        # Nothing tells the classes apart, so nothing is called toxic.
        weights[0] = -4.0
        return weights
    share = labels.mean()
    own = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    used = np.arange(features.shape[1])
    while True:
        x, found = features[:, used], np.zeros(len(used))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ found, -30, 30)))
            slope = x.T @ (own * (labels - p)) - penalty * found
            curve = (x * (own * p * (1 - p))[:, None]).T @ x
            step = np.linalg.solve(curve + penalty * np.eye(len(used)), slope)
            found = found + step
            if np.abs(step).max() < 1e-6:
                break
        worst = 1 + int(np.argmin(found[1:])) if len(used) > 1 else 0
        if not worst or found[worst] >= 0:
            weights[used] = found
            return weights
        used = np.delete(used, worst)


def choose(segments: list[tuple[float, int, str]], most: int) -> list[str]:
    """The most useful segments, of equal ones the longest, without those that only
    repeat or extend another; the best last, as it lies nearest to what is compressed."""
    kept: list[str] = []
    for *_, segment in sorted(segments, reverse=True):
        if len(kept) == most:
            break
        if not any(segment in other or other in segment for other in kept):
            kept.append(segment)
    return kept[::-1]


def labelled_sample(
    docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS_PER_CLASS
) -> DataFrame:
    """(text, toxic) of the labelled rows that are learned from, at most about
    ``most_rows`` of each class, near copies once."""
    usable = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(crc32_mod("doc_id", 5) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    sizes = {row["toxic"]: row["count"] for row in usable.groupBy("toxic").count().collect()}
    share = F.create_map(
        *[F.lit(x) for c in (0, 1) for x in (c, min(1.0, most_rows / max(1, sizes.get(c, 0))))]
    )
    scale = 1 << 20
    thinned = usable.where(
        F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share[F.col("toxic")] * scale
    )
    # At most about 2 * most_rows rows of two numbers, whatever the labels' number.
    rows = (
        docs.select("doc_id", "text")
        .where("text IS NOT NULL")
        .join(F.broadcast(thinned), "doc_id")
        .select("text", F.col("toxic").cast("int").alias("toxic"))
    )

    def make():
        def convert(batch: pa.RecordBatch) -> dict:
            found = [marks(t) for t in batch.column(0).to_pylist()]
            return {
                "text": batch.column(0),
                "toxic": batch.column(1),
                "one": [f[0] for f in found],
                "two": [f[1] for f in found],
            }

        return convert

    marked = map_batches(rows, make, "text string, toxic int, one long, two long")
    return (
        marked.dropDuplicates(["toxic", "one"])
        .dropDuplicates(["toxic", "two"])
        .select("text", "toxic")
    )


def train_dictionaries(sample: DataFrame) -> tuple[bytes, bytes]:
    def make():
        def convert(batch: pa.RecordBatch) -> dict:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(*(batch.column(n).to_pylist() for n in range(2))):
                for segment in segments(text):
                    counts.setdefault(segment, [0, 0])[toxic] += 1
            return {
                "segment": list(counts),
                "ordinary": [c[0] for c in counts.values()],
                "toxic": [c[1] for c in counts.values()],
            }

        return convert

    schema = "segment string, ordinary long, toxic long"
    counted = written(
        map_batches(sample.select("text", "toxic"), make, schema)
        .groupBy("segment")
        .agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")),
        "segments",
    )
    sizes = {row["toxic"]: row["count"] for row in sample.groupBy("toxic").count().collect()}
    toxic_docs, ordinary_docs = (max(1, sizes.get(c, 0)) for c in (1, 0))
    rate = F.col("toxic") / toxic_docs
    base = (F.col("ordinary") + 0.5) / ordinary_docs
    # What marks a word stands at its beginning.
    distinctive = F.col("segment").startswith(" ") & (F.col("toxic") >= max(LEAST_DOCUMENTS, LEAST_PART * toxic_docs)) & (
        rate >= LEAST_RATIO * base
    )

    def best(condition, documents: str, longest: int) -> list[tuple[float, int, str]]:
        size = F.octet_length("segment")
        worth = (F.least(size, F.lit(longest)) - MATCH_BYTES) * F.col(documents)
        rows = counted.where(condition).select(worth.alias("worth"), size.alias("size"), "segment")
        top = rows.orderBy(F.desc("worth"), F.desc("size"), "segment").limit(CANDIDATES)
        return [(row["worth"], row["size"], row["segment"]) for row in top.collect()]

    # The common beginning of toxic words is worth more than each of their endings.
    toxic = choose(best(distinctive, "toxic", STEM_BYTES), TOXIC_SEGMENTS)
    ordinary = choose(best(F.col("ordinary") > 1, "ordinary", 99), ORDINARY_SEGMENTS)
    plain = "".join(ordinary).encode()
    return plain, "".join(toxic).encode() + plain


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Dictionaries, then the weights of the windows' savings, from labelled rows."""
    sample = written(labelled_sample(docs, labels), "labelled")
    unknown = np.zeros(len(THRESHOLDS))
    model = Model(*train_dictionaries(sample), unknown, unknown)

    def make():
        def convert(batch: pa.RecordBatch) -> dict:
            found = [model.measures(t).tolist() for t in batch.column(0).to_pylist()]
            return {"toxic": batch.column(1), "measures": found}

        return convert

    schema = "toxic int, measures array<double>"
    rows = map_batches(sample.select("text", "toxic"), make, schema).collect()
    measures = np.array([row["measures"] for row in rows], float).reshape(-1, 2 + len(THRESHOLDS))
    labels_seen = np.array([row["toxic"] for row in rows], int)
    ordinary = measures[labels_seen == 0].sum(0)
    model.false_rates = ordinary[2:] / max(1.0, ordinary[0])
    model.weights = fit_weights(model.features(measures), labels_seen)
    return model


def score(
    docs: DataFrame, model: Model, *carried: str, names: tuple[str, str] = RESULTS
) -> DataFrame:
    """The carried columns, score and predicted of each row, from its text alone.

    ``names`` are the results' names, for tables that have columns called so.
    """

    def make():
        def convert(batch: pa.RecordBatch) -> dict:
            out = {name: batch.column(n) for n, name in enumerate(carried)}
            texts = batch.column(read.index("text")).to_pylist()
            found = [model.score(t) for t in texts]
            return out | {names[0]: found, names[1]: [int(f >= 0.5) for f in found]}

        return convert

    read = [*carried] if "text" in carried else [*carried, "text"]
    types = dict(docs.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in carried)
    schema += f"`{names[0]}` double, `{names[1]}` int"
    return map_batches(docs.select(*read), make, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    A NULL text counts as empty, one window of a blank. Labels that are NULL or neither
    0 nor 1 are not used; a document with several has the largest. Without labels of
    both classes no text is called toxic. A row with a NULL doc_id is not held out. Rows may repeat; no rows give none. Other columns are not
    read.
    """
    found = score(docs, fit(docs, labels), "doc_id")
    held_out = F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")
