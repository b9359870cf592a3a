"""Operator 5: benchmark decontamination by templates.

Numbers, names and units of a text become typed placeholders, so a question keeps its
template when its parameters are changed. Windows of template words are hash-joined
with those of the benchmark items; the slots behind the placeholders must then map
consistently: on one alignment of an item with a document, windows count whose slots
have the values that stand for the item's equal slots at over half of their places.
Windows that match word for word count in any case.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import map_batches, worker_cache, written

WINDOW = 5
# A document is contaminated by an item of which it has this share of the windows, or
# so many words in a row.
COVERAGE = 0.8
RUN_WORDS = 13
# A window must have so many words besides placeholders.
LEAST_WORDS = 3
# Item windows that are broadcast; more are joined by a shuffle.
MOST_BROADCAST_WINDOWS = 500_000
# Contaminated documents' ids that are broadcast, 8 bytes each; more by a shuffle.
MOST_BROADCAST_KEYS = 1_000_000
# Bits of the sketch of item windows that documents' windows are first held against.
SKETCH_BITS = 1 << 23
MOST_WORDS = 400_000

# Unit names after a number.
UNITS = frozenset(
    """
    mm cm m km in ft yd mi mg g kg t lb oz ml l dl gal s sec min h hr hrs ms w kw kwh v
    hz j cal kcal pa bar mph kmh percent degrees degree celsius fahrenheit meter meters
    metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot
    feet yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters
    litre litres second seconds minute minutes hour hours day days week weeks month
    months year years dollar dollars euro euros cent cents
    """.split()
)
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+(?:[.,:/]\d+)*|[.!?\n%$€£]")
# The same tokens of a text in ASCII, without a look at each character's category.
ASCII_TOKEN = re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)*|[0-9]+(?:[.,:/][0-9]+)*|[.!?\n%$]")

WORD, NAME, NUMBER, UNIT, END = range(5)


class Words(dict):
    """token -> (hash << 3 | kind), kept up to a bound."""

    def __missing__(self, token: str) -> int:
        lower = token.lower()
        if token[0].isdigit():
            kind = NUMBER
        elif token in ".!?\n":
            kind = END
        elif lower in UNITS or token in "%$€£":
            kind = UNIT
        else:
            kind = NAME if token[:1].isupper() and not token.isupper() else WORD
        data = lower.encode()
        code = (zlib.crc32(data) << 28 ^ zlib.crc32(data[::-1] + b"~")) << 3 & (1 << 62) - 1
        value = code | kind
        if len(self) < MOST_WORDS:
            self[token] = value
        return value


def template(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, slots, plain) per word: the word's or its placeholder's hash; what stands
    behind a placeholder, 0 for a word; the word's own hash."""
    words = worker_cache(("template words",), Words)
    text = text or ""
    tokens = (ASCII_TOKEN if text.isascii() else TOKEN).findall(text)
    codes = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    kinds = codes & 7
    after_end = np.concatenate([[True], kinds[:-1] == END])
    after_number = np.concatenate([[False], kinds[:-1] == NUMBER])
    slot = (
        (kinds == NUMBER)
        | ((kinds == NAME) & ~after_end)
        | ((kinds == UNIT) & after_number)
    )
    plain = codes & ~np.int64(7)
    held = np.where(slot, kinds + 1, plain)
    stays = kinds != END
    return held[stays], np.where(slot, plain | 1, 0)[stays], plain[stays]


def windows(codes: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """A hash per window; a shorter text is one window of its own length."""
    if not len(codes):
        return np.zeros(0, np.int64)
    span = min(width, len(codes))
    values = folded(codes.view(np.uint64))
    return mixed([values[n : len(values) - span + 1 + n] for n in range(span)], span)


def folded(values: np.ndarray) -> np.ndarray:
    return values ^ (values >> np.uint64(29))


def mixed(steps: Iterable[np.ndarray], seed: int) -> np.ndarray:
    """A hash per column of the steps, which are folded."""
    total = None
    for step in steps:
        if total is None:
            total = np.full(len(step), seed, np.uint64)
        total ^= step
        total *= np.uint64(0xA24BAED4963EE407)
        total ^= total >> np.uint64(32)
    return total.view(np.int64)


# An odd number and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the codes of each span, from sums over the whole text: the work does not
    depend on the lengths of the spans."""
    mixed_codes = (codes.view(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed_codes = (mixed_codes ^ mixed_codes >> np.uint64(32)) * np.uint64(0xA24BAED4963EE407)
    powers = np.full(len(codes) + 1, BASE, np.uint64)
    inverses = np.full(len(codes) + 1, INVERSE, np.uint64)
    powers[0] = inverses[0] = 1
    powers, inverses = np.cumprod(powers), np.cumprod(inverses)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed_codes * powers[:-1])])
    return (sums[ends] - sums[starts]) * inverses[starts]


def wide_windows(
    codes: np.ndarray, slots: np.ndarray, widest: int | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, places, starts, widths) of windows with too few plain words, each widened
    to its right and to its left until it has enough; those wider than ``widest`` and
    those that the text ends before are left out."""
    size = len(codes)
    known = np.concatenate([[0], np.cumsum(slots == 0)])
    places = np.arange(max(0, size - WINDOW + 1))
    places = places[known[places + WINDOW] - known[places] < LEAST_WORDS]
    right = np.searchsorted(known, known[places] + LEAST_WORDS)
    left = np.searchsorted(known, known[places + WINDOW] - LEAST_WORDS, "right") - 1
    found = []
    for side, starts, ends in ((1, places, right), (2, left, places + WINDOW)):
        widths = ends - starts
        held = (starts >= 0) & (ends <= size) & (widths <= (widest or size))
        hashes = spans(codes, starts[held], ends[held])
        seeds = (widths[held] | side << 32).astype(np.uint64)
        steps = [folded(seeds), folded(hashes)]
        found.append((mixed(steps, 0), places[held], starts[held], widths[held]))
    return tuple(np.concatenate(column) for column in zip(*found))


def text_windows(
    text: str | None, widest: int | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, places, starts, widths, slots): of the template's windows, of those that
    had to be widened, then of the plain words' windows where they differ, with width 0.
    ``slots`` are those of the text's words."""
    codes, slots, plain = template(text)
    hashes = windows(codes)
    if not len(hashes):
        return hashes, hashes, hashes, hashes, slots
    span = min(WINDOW, len(codes))
    places = np.arange(len(hashes))
    known = np.concatenate([[0], np.cumsum(slots == 0)])
    words = known[span:] - known[:-span]
    enough = words >= min(LEAST_WORDS, span)
    differ = np.flatnonzero(words < span)
    words_own = folded(plain.view(np.uint64))
    own = mixed([words_own[differ + n] for n in range(span)], span)
    wide = [np.zeros(0, np.int64)] * 4
    if not enough.all():
        wide = wide_windows(codes, slots, widest)
    return (
        np.concatenate([hashes[enough], wide[0], own]),
        np.concatenate([places[enough], wide[1], differ]),
        np.concatenate([places[enough], wide[2], differ]),
        np.concatenate([np.full(int(enough.sum()), span), wide[3], np.zeros(len(differ), np.int64)]),
        slots,
    )


def sketch_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = hashes.view(np.uint64)
    return (
        (values % np.uint64(SKETCH_BITS)).astype(np.int64),
        ((values >> np.uint64(32)) % np.uint64(SKETCH_BITS)).astype(np.int64),
    )


def make_sketch(batches) -> np.ndarray:
    bits = np.zeros(SKETCH_BITS, bool)
    for hashes in batches:
        for places in sketch_places(hashes):
            bits[places] = True
    return np.packbits(bits)


def window_rows(
    texts: DataFrame, key: str, sketch: np.ndarray | None, widest: int | None = None
) -> DataFrame:
    """(key, row, window, place, slots, words, width) of every row; with a sketch only the
    windows that it may hold. ``row`` is a hash of the text, as keys may repeat; ``slots``
    are those of the window's own five words, however far it was widened."""

    def make():
        bits = None if sketch is None else np.unpackbits(sketch).view(bool)

        def convert(batch: pa.RecordBatch) -> dict:
            columns = ("key", "row", "window", "place", "slots", "words", "width")
            out: dict[str, list] = {c: [] for c in columns}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes, places, _, widths, slots = text_windows(text, widest)
                if not len(hashes):
                    continue
                words = int(places.max()) + 1
                if bits is not None:
                    first, second = sketch_places(hashes)
                    held = bits[first] & bits[second]
                    hashes, places = hashes[held], places[held]
                    widths = widths[held]
                if len(hashes):
                    data = text.encode("utf-8", "surrogatepass")
                    row = zlib.crc32(data) << 31 ^ zlib.crc32(data[::-1] + b"~")
                    out["key"].extend([name] * len(hashes))
                    out["row"].extend([row] * len(hashes))
                    out["window"].extend(hashes.tolist())
                    out["place"].extend(places.tolist())
                    # Windows of plain words have no slots to be held against others.
                    ends = places + np.where(widths > 0, WINDOW, 0)
                    out["slots"].extend(slots[a:b] for a, b in zip(places, ends))
                    out["words"].extend([words] * len(hashes))
                    out["width"].extend(widths.tolist())
            return out

        return convert

    schema = (
        "key long, row long, window long, place long, slots array<long>, words long, width long"
    )
    return map_batches(texts.select(key, "text"), make, schema)


def item_sketch(items: DataFrame) -> np.ndarray:
    """A sketch of fixed size of all items' windows, OR-ed over the tasks."""

    def make():
        def convert(batch: pa.RecordBatch) -> dict:
            places = np.unique(np.concatenate(sketch_places(batch.column(0).to_numpy())))
            bits = np.zeros(SKETCH_BITS // 8, np.uint8)
            np.bitwise_or.at(bits, places // 8, (128 >> (places % 8)).astype(np.uint8))
            cells = bits.view(np.int64)
            held = np.flatnonzero(cells)
            return {"cell": held, "bits": cells[held]}

        return convert

    cells = (
        map_batches(items.select("window"), make, "cell long, bits long")
        .groupBy("cell")
        .agg(F.bit_or("bits").alias("bits"))
        .collect()
    )
    sketch = np.zeros(SKETCH_BITS // 64, np.int64)
    for row in cells:
        sketch[row["cell"]] = row["bits"]
    return sketch.view(np.uint8)


def unusual_pairs() -> Column:
    """The pairs of an alignment whose value does not stand for the item's slot at over
    half of its places."""
    pairs = F.col("pairs")

    def usual(pair: Column) -> Column:
        same = F.filter(pairs, lambda p: p["i"] == pair["i"])
        return F.size(F.filter(same, lambda p: p["d"] == pair["d"])) * 2 > F.size(same)

    return F.filter(pairs, lambda p: ~usual(p))


def kept_places() -> Column:
    """Places of the windows ``found`` of an alignment that match word for word or have
    no unusual pair."""
    kept = F.filter(
        F.col("found"),
        lambda w: F.forall(w["pairs"], lambda p: p["d"] == p["i"])
        | ~F.arrays_overlap(w["pairs"], F.col("unusual")),
    )
    kept = F.when(F.size("unusual") == 0, F.col("found")).otherwise(kept)
    return F.sort_array(F.array_distinct(F.transform(kept, lambda w: w["item_place"])))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, item_id, coverage, run): items and the rows that they contaminate.

    An item of fewer words than a window is matched as a whole by a text that is no
    longer. Of an alignment count the windows that match word for word and those whose
    slots follow its majority mapping; rows of one key are aligned by themselves.
    """
    items = written(
        window_rows(benchmark.selectExpr("item_id AS key", "text"), "key", None), "items"
    )
    items = items.where("key IS NOT NULL")
    count, widest = items.agg(F.count(F.lit(1)), F.max("width")).first()
    texts = docs.selectExpr(f"`{key}` AS key", "text")
    found = window_rows(texts, "key", item_sketch(items), widest or WINDOW)
    found = written(found.drop("words", "width"), "windows")
    right = items.select(
        "window",
        F.col("key").alias("item_id"),
        F.col("row").alias("item_row"),
        F.col("place").alias("item_place"),
        F.col("slots").alias("item_slots"),
        F.col("words").alias("item_windows"),
    )
    if count <= MOST_BROADCAST_WINDOWS:
        right = F.broadcast(right)
    both = F.transform(
        F.arrays_zip("slots", "item_slots"),
        lambda s, n: F.struct(
            (F.col("item_place") + n).alias("at"),
            s["slots"].alias("d"),
            s["item_slots"].alias("i"),
        ),
    )
    pairs = F.filter(both, lambda p: (p["d"] != 0) & (p["i"] != 0))
    aligned = (
        found.join(right, "window")
        .withColumn("pairs", pairs)
        .withColumn("shift", F.col("place") - F.col("item_place"))
        .groupBy("key", "row", "item_id", "item_row", "shift", "item_windows")
        .agg(F.collect_set(F.struct("item_place", "pairs")).alias("found"))
        .withColumn("pairs", F.array_distinct(F.flatten(F.col("found.pairs"))))
        .withColumn("unusual", unusual_pairs())
        .withColumn("places", kept_places())
    )
    # The longest row of consecutive places: a place less its rank is constant in it.
    ranked = F.transform("places", lambda p, n: p - n)
    longest = F.array_max(
        F.transform(
            F.array_distinct(ranked), lambda r: F.size(F.filter(ranked, lambda x: x == r))
        )
    )
    return (
        aligned.where(F.size("places") > 0)
        .withColumn("run", longest)
        .groupBy("key", "item_id", "item_windows")
        .agg(
            F.max("run").alias("run"),
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"),
        )
        .withColumn("coverage", F.col("held") / F.col("item_windows"))
        .withColumn("run", F.col("run") + WINDOW - 1)
        .where((F.col("coverage") >= COVERAGE) | (F.col("run") >= RUN_WORDS))
        .select("key", "item_id", "coverage", "run")
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, item_id, coverage, items): a row per row of ``docs``.

    ``item_id`` is the item with the largest coverage, the smallest id of equal ones.
    NULL and empty texts have no window and are clean, as is everything if the
    benchmark is empty; items with NULL id or text are not used. Rows with the same
    doc_id share one verdict, that of their windows together. Other columns are not
    read. No rows give none.
    """
    verdicts = (
        matches(docs, benchmark)
        .groupBy("key")
        .agg(
            F.min(F.struct((-F.col("coverage")).alias("less"), "item_id")).alias("best"),
            F.count(F.lit(1)).alias("items"),
        )
        .select("key", "best.item_id", (-F.col("best.less")).alias("coverage"), "items")
    )
    ids = docs.select("doc_id")
    return ids.join(verdicts, ids.doc_id.eqNullSafe(verdicts.key), "left").select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        "item_id",
        "coverage",
        F.coalesce("items", F.lit(0)).alias("items"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    found = written(matches(docs, benchmark).select("key").distinct(), "contaminated")
    if found.count() <= MOST_BROADCAST_KEYS:
        found = F.broadcast(found)
    return docs.join(found, docs.doc_id.eqNullSafe(found.key), "left_anti")
