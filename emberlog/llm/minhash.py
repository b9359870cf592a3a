"""Near copies by word shingles: one document of each group of similar texts stays.

Texts are sets of the hashes of their five-word shingles; two are linked if the sets'
Jaccard similarity is 0.8 or more. Candidates come from two sides: operator 4 links the
sets' SimHash fingerprints that are within its three bits, exactly, and as sets of
similarity 0.8 mostly differ in more bits than that, distinct sets also meet at ``BANDS``
MinHash keys of ``ROWS`` minima: at similarity s a pair misses all of them with probability
(1 - s^ROWS)^BANDS, 1.1e-4 at 0.8 and 7e-11 at 0.9. Keys are loose, half of the pairs at
0.54 share one, so the members of a key are first compared by a sketch of all minima, a
byte each: fewer than LEAST_AGREEING equal ones, and a pair is out (at 0.8 five in a
million, at 0.5 all but three in a million). What the sketches connect is verified with
the whole sets.

Both steps compare the members of a group alike. A group of more than one block is first
compared with its first member, which settles a group of near copies in one pass; only
members that are not like it are compared with all, in blocks. Blocks keep only what
connects their members, so links grow with a group and not with its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import join_hot, map_batches, worker_cache, written
from emberlog.llm.components import components
from emberlog.llm.simhash import link_fingerprints, majority

SHINGLE = 5
LEAST_SIMILARITY = 0.8
ROWS, BANDS = 6, 30
SEED = 42
# A candidate group is verified in blocks of so many texts and shingles on average.
BLOCK, BLOCK_SHINGLES = 1000, 500_000
# Of the ROWS * BANDS bytes of two sketches so many must be equal. Their number is that of
# the equal minima, binomial with the similarity, and one in 256 of the others.
LEAST_AGREEING = 120
# Hashes whose minima are taken at a time.
HASHES = 1 << 12


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 of a text's shingles; a shorter text is one shingle,
    one without words has none. Words end at ASCII white space."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    count = max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[:count].tolist(), ends[-count:].tolist())
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), "<u8", count)
    return np.unique(hashes)


def mixers() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(SEED).integers(0, 1 << 64, (2, ROWS * BANDS, 1), np.uint64)
    return drawn[0], drawn[1] | np.uint64(1)


def minima(held: np.ndarray) -> np.ndarray:
    """The least of the set under each of the mixed hashes; the set is not empty."""
    flips, odd = worker_cache(("minhash", ROWS, BANDS), mixers)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(held), HASHES):
        mixed = (held[at : at + HASHES] ^ flips) * odd
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * odd).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """A key per band of minima."""
    from xxhash import xxh64_intdigest

    bands = least.reshape(BANDS, ROWS)
    return [signed(xxh64_intdigest(band.tobytes(), n)) for n, band in enumerate(bands)]


def signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


def signatures(docs: DataFrame, *carried: str) -> DataFrame:
    """The carried columns, ``code`` that stands for the set of shingles, its SimHash
    fingerprint ``fp``, its keys and its sketch; a set without members has none of these."""

    def make():
        from xxhash import xxh64_intdigest

        def convert(batch: pa.RecordBatch) -> dict:
            out = {name: batch.column(n) for n, name in enumerate(carried)}
            sets = [shingles(t) for t in batch.column(len(carried)).to_pylist()]
            least = [minima(s) if len(s) else None for s in sets]
            return out | {
                "code": [signed(xxh64_intdigest(s.tobytes(), SEED)) for s in sets],
                "fp": [signed(majority(s)) if len(s) else None for s in sets],
                "keys": [[] if m is None else band_keys(m) for m in least],
                "sketch": [b"" if m is None else (m >> np.uint64(24)).astype(np.uint8).tobytes()
                           for m in least],
            }

        return convert

    types = dict(docs.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in carried)
    schema += "code long, fp long, keys array<long>, sketch binary"
    return map_batches(docs.select(*carried, "text"), make, schema)


def shingle_sets(docs: DataFrame, *carried: str) -> DataFrame:
    """The carried columns and ``held``, the text's shingles as signed integers."""

    def make():
        def convert(batch: pa.RecordBatch) -> dict:
            out = {name: batch.column(n) for n, name in enumerate(carried)}
            texts = batch.column(len(carried)).to_pylist()
            return out | {"held": [shingles(t).view(np.int64) for t in texts]}

        return convert

    types = dict(docs.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in carried) + "held array<long>"
    return map_batches(docs.select(*carried, "text"), make, schema)


class Sets:
    """The members' whole sets."""

    def __init__(self, held: pa.Array):
        ends = np.cumsum(held.value_lengths().to_numpy())
        values, dense = np.unique(held.flatten().to_numpy(), return_inverse=True)
        self.sets = np.split(dense, ends[:-1])
        self.inside = np.zeros(len(values), bool)

    def near(self, one: int, rest: np.ndarray) -> np.ndarray:
        own = self.sets[one]
        lengths = np.array([len(self.sets[n]) for n in rest])
        # Only sets of like size can be similar.
        fit = np.minimum(lengths, len(own)) >= LEAST_SIMILARITY * np.maximum(lengths, len(own)) - 1e-9
        near = np.zeros(len(rest), bool)
        if fit.any():
            self.inside[own] = True
            spans = lengths[fit]
            met = self.inside[np.concatenate([self.sets[n] for n in rest[fit]])]
            common = np.add.reduceat(met.astype(np.int64), np.cumsum(spans) - spans)
            self.inside[own] = False
            near[fit] = common >= LEAST_SIMILARITY * (spans + len(own) - common) - 1e-9
        return near


class Sketches:
    """The members' sketches, a row of bytes each."""

    def __init__(self, held: pa.Array):
        self.bytes = np.frombuffer(b"".join(held.to_pylist()), np.uint8).reshape(len(held), -1)

    def near(self, one: int, rest: np.ndarray) -> np.ndarray:
        return (self.bytes[rest] == self.bytes[one]).sum(axis=1) >= LEAST_AGREEING


def links_within(codes: np.ndarray, members: Sets | Sketches) -> list[tuple[int, int]]:
    """(smallest, other) for every component that the members form."""
    order = np.argsort(codes, kind="stable")
    links, rest = [], order[1:]
    root, frontier = order[0], [order[0]]
    while len(rest):
        if not frontier:
            root, rest = rest[0], rest[1:]
            frontier = [root]
            continue
        near = members.near(frontier.pop(), rest)
        frontier.extend(rest[near])
        links.extend((int(codes[root]), int(codes[n])) for n in rest[near])
        rest = rest[~near]
    return links


LINKS = "a long, b long"


def group_links(members: DataFrame, kind: type[Sets] | type[Sketches], size: Column) -> DataFrame:
    """(a, b): links that connect the codes of each group as all its similar pairs would.
    ``members`` is a written table of root, code and held, a member once in a group;
    ``size`` is the number of blocks that a group fills, as an aggregate."""

    def verify(group: pa.Table) -> pa.Table:
        codes, at = np.unique(group.column("code").to_numpy(), return_index=True)
        held = group.column("held").combine_chunks().take(pa.array(at))
        links = links_within(codes, kind(held)) if len(codes) > 1 else []
        columns = [pa.array([link[n] for link in links], pa.int64()) for n in range(2)]
        return pa.table(columns, names=["a", "b"])

    counts = members.groupBy("root").agg(
        F.ceil(size).cast("int").alias("blocks"),
        F.count(F.lit(1)).alias("n"),
        F.min("code").alias("first"),
    )
    # Groups of one block are most. No more than one group for each block's rows is larger.
    large = written(counts.where("blocks > 1"), "large-groups")
    small = members.join(F.broadcast(large.select("root")), "root", "left_anti")
    links = small.groupBy("root").applyInArrow(verify, LINKS)
    if large.isEmpty():
        return links

    of_large = members.join(F.broadcast(large), "root")
    firsts = of_large.where("code = first").select("root", F.col("held").alias("first_held"), "n")
    total = large.agg(F.sum("n")).first()[0]
    rows = of_large.select("root", "code", "held", "blocks", "first")

    def compare():
        def convert(batch: pa.RecordBatch) -> dict:
            held, first = batch.column(2), batch.column(5)
            near = [
                bool(kind(pa.concat_arrays([held[n : n + 1], first[n : n + 1]])).near(1, np.array([0]))[0])
                for n in range(batch.num_rows)
            ]
            out = {name: batch.column(n) for n, name in enumerate(("root", "code", "held", "blocks", "first"))}
            return out | {"near": near}

        return convert

    types = dict(members.dtypes)
    schema = f"root {types['root']}, code long, held {types['held']}, blocks int, first long, near boolean"
    beside = join_hot(rows, firsts, "root", total).select(*rows.columns, "first_held")
    compared = written(map_batches(beside, compare, schema), "compared")
    settled = compared.where("near AND code <> first").selectExpr("first AS a", "code AS b")
    others = compared.where("NOT near")
    left = written(
        others.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("left")),
        "unlike",
    )
    # Every member that is not like the first meets every member, block by block.
    mine = F.pmod(F.xxhash64("code", F.lit(1)), F.col("left")).cast("int")
    yours = F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int")
    numbers = F.sequence(F.lit(0), F.col("blocks") - 1)
    one_side = others.join(F.broadcast(left), "root").select(
        "root", "code", "held", mine.alias("i"), F.explode(numbers).alias("j")
    )
    other_side = compared.join(F.broadcast(left), "root").select(
        "root", "code", "held", F.explode(F.sequence(F.lit(0), F.col("left") - 1)).alias("i"),
        yours.alias("j"),
    )
    met = one_side.unionByName(other_side).groupBy("root", "i", "j")
    return links.unionByName(settled).unionByName(met.applyInArrow(verify, LINKS))


def fingerprint_links(codes: DataFrame) -> DataFrame:
    """(a, b): links that connect the codes whose fingerprints operator 4 connects.
    ``codes`` is a written table with a row per code; NULL fingerprints have no links."""
    known = codes.where("fp IS NOT NULL").select("fp", "code")
    of_print = known.groupBy("fp").agg(F.min("code").alias("first"), F.count(F.lit(1)).alias("n"))
    of_print = written(of_print, "fingerprints")
    equal = join_hot(known, of_print.where("n > 1"), "fp", codes.count())
    links = written(link_fingerprints(of_print.select("fp")), "fingerprint-links")
    firsts = of_print.select(F.col("fp").alias("a"), "first")
    ends = links.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(firsts, "a")
    near = join_hot(links, ends, "a", links.count()).select(F.col("first").alias("a"), "b")
    near = near.join(of_print.selectExpr("fp AS b", "first"), "b")
    return near.selectExpr("a", "first AS b").unionByName(
        equal.where("code <> first").selectExpr("first AS a", "code AS b")
    )


def grouped_codes(rows: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(code, root) for every code that is linked to a smaller one. ``rows`` has the
    key and signatures of ``docs``; both should be written tables."""
    codes = rows.groupBy("code").agg(
        F.min(key).alias("one"),
        F.first("fp").alias("fp"),
        F.first("keys").alias("keys"),
        F.first("sketch").alias("held"),
    )
    codes = written(codes, "codes")
    keyed = codes.select("code", F.explode("keys").alias("root"))
    shared = keyed.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    total = codes.agg(F.sum(F.size("keys"))).first()[0] or 0
    # Most keys are met by one code only: sketches go along with the others' rows alone.
    meeting = join_hot(keyed, shared, "root", total).select("root", "code")
    meeting = written(meeting.join(codes.select("code", "held"), "code"), "band-members")
    likely = group_links(meeting, Sketches, F.count(F.lit(1)) / BLOCK)
    likely = likely.unionByName(fingerprint_links(codes))
    found = written(components(written(likely.distinct(), "likely")), "candidates")
    both = found.select("node", "root").unionByName(
        found.select(F.col("root").alias("node"), "root").distinct()
    )
    wanted = both.join(codes, both.node == codes.code).select("root", "code", "one")
    texts = docs.select(F.col(key).alias("one"), "text").join(wanted, "one")
    members = written(shingle_sets(texts, "root", "code"), "shingles")
    size = F.greatest(
        F.count(F.lit(1)) / BLOCK, F.sum(F.size("held")) / BLOCK_SHINGLES
    )
    verified = written(group_links(members, Sets, size), "verified")
    return components(verified).selectExpr("node AS code", "root")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that remain when one of each group stays: that with the
    smallest doc_id, of repeated rows one.

    Texts without a word, NULL ones too, are one group. NULL doc_ids come last.
    """
    columns, number = docs.columns, "__row"
    while number in columns:
        number += "_"
    kept = docs.select(*columns, F.monotonically_increasing_id().alias(number))
    kept = written(kept, "numbered")
    rows = written(signatures(kept, number, "doc_id"), "minhash")
    roots = grouped_codes(rows, kept, number)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(number).alias("row"))
    codes = rows.groupBy("code").agg(F.min(order).alias("least"))
    survivors = (
        codes.join(roots, "code", "left")
        .groupBy(F.coalesce("root", "code"))
        .agg(F.min("least").alias("least"))
        .select(F.col("least.row").alias(number))
    )
    return kept.join(survivors, number, "left_semi").select(*columns)
