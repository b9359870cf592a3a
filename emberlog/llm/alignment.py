"""Operator 12: cross-tokenizer alignment over distinct texts.

Texts are shuffled by their full text, so that each distinct one is tokenised and aligned
once, whatever the number of its copies; counts of linked id pairs are weighted by that
number, and the measures of a text are joined back to the ids of its documents.

Long texts are cut into chunks at a single space between two characters that are no white
space: no token of either tokenizer reaches over it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import map_batches, worker_cache, written
from emberlog.llm.encoding import byte_characters

# Python's white space includes all of the tokenizers', so these places are safe for both.
CHUNK_START = re.compile(r"(?<=\S)(?= \S)")
CHUNK_CHARS = 20_000
# A pair or text of this share of all rows is hot; there are no more hot ones than that.
HOT_PAIRS = 1 << 20
HOT_TEXTS = 1000

BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


# Fixed value: how the byte-level pre-tokenizer splits a text.
PRE_TOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# Latin, Greek and Cyrillic letters, in which tables of letters of any age agree.
LAST_AGREED = "\u052f"


class ByteTokens:
    """Ids of a byte-level vocabulary and their bytes.

    Where every merge makes the id next to the one before, ids are ranks, and tiktoken
    finds the same tokens several times faster; chunks with other letters than those
    above go to the tokenizers library all the same."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        letters = {c: b for b, c in byte_characters().items()}
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        tokens = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items()}
        self.bytes = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        made = [vocabulary["".join(pair)] for pair in merges]
        plain = model["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True
        }
        ranked = plain and made == list(range(256, 256 + len(made))) and not model["normalizer"]
        ranked = ranked and {bytes([n]) for n in range(256)} <= set(tokens.values())
        self.quick = ranked and tiktoken.Encoding(
            "ranks", pat_str=PRE_TOKENS, mergeable_ranks={t: i for i, t in tokens.items()},
            special_tokens={},
        )

    def encode(self, text: str) -> list[int]:
        if self.quick and (text.isascii() or max(text) <= LAST_AGREED):
            return self.quick.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Ids of a sentencepiece model and their bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            found = BYTE_PIECE.fullmatch(piece) if self.library.is_byte(i) else None
            self.bytes.append(
                bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode()
            )

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text)


class Aligner:
    """Aligns texts chunk by chunk; a chunk ends where neither tokenizer reaches over."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.lengths_a = np.array([len(t) for t in self.a.bytes], np.int64)
        self.lengths_b = np.array([len(t) for t in self.b.bytes], np.int64)
        # How an id is written inside a group and at the end of its side of it.
        count_a, count_b = len(self.a.bytes), len(self.b.bytes)
        self.written = [f"{i}{end}".encode() for i in range(count_a) for end in ",|"]
        self.written += [f"{i}{end}".encode() for i in range(count_b) for end in ",;"]
        self.written = np.array(self.written, object)
        self.pieces_b = np.array(self.b.bytes, object)
        self.first_b = 2 * count_a

    def chunk(self, chunk: str) -> tuple[int, int, np.ndarray, bytes] | None:
        """Numbers of A's and B's tokens, the linked pairs and the groups of a chunk, which
        begins with a space that B adds by itself. None if the joined bytes of either
        tokenizer's tokens are not the chunk's."""
        whole = chunk.encode()
        a = np.array(self.a.encode(chunk), np.int64)
        b = np.array(self.b.encode(chunk[1:]), np.int64)
        # Ranks of single bytes make every text; only others have to be compared.
        if not self.a.quick and b"".join([self.a.bytes[i] for i in a]) != whole:
            return None
        if b"".join(self.pieces_b[b].tolist()) != whole:
            return None
        end_a, end_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        ends = np.zeros(len(whole) + 1, np.int8)
        ends[end_a] = 1
        ends[end_b] += 2
        last_a, last_b = ends[end_a] == 3, ends[end_b] == 3
        pairs = a[last_a] << 32 | b[last_b]
        # Groups come in order, in each A's tokens before B's.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        through_a, through_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.append(0, through_b)[group_a]] = 2 * a + last_a
        order[np.arange(len(b)) + through_a[group_b]] = self.first_b + 2 * b + last_b
        return len(a), len(b), pairs, b"".join(self.written[order].tolist())

    def text(self, text: str) -> tuple[int, int, np.ndarray, list[bytes]] | None:
        """The same of a whole text, the groups in parts."""
        n_a, n_b, pairs, groups = 0, 0, [], []
        for chunk in chunks(" " + text):
            found = self.chunk(chunk)
            if found is None:
                return None
            n_a, n_b = n_a + found[0], n_b + found[1]
            pairs.append(found[2])
            groups.append(found[3])
        groups[-1] = groups[-1][:-1]
        return n_a, n_b, np.concatenate(pairs), groups


def chunks(text: str) -> Iterator[str]:
    start = 0
    while start < len(text):
        cut = CHUNK_START.search(text, start + CHUNK_CHARS)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


ALIGNED = (
    "copies long, text_key binary, n_a long, n_b long, n_groups long, "
    "groups_sha256 string, pairs array<long>, times array<int>, groups string"
)


def text_key(text: str) -> Column:
    """NULL for a text without characters."""
    return F.when(F.length(text) > 0, F.unhex(F.sha2(text, 256)))


def aligned_texts(
    docs: DataFrame, tokenizer_a: str, tokenizer_b: str, keep_groups: bool = True
) -> DataFrame:
    """A row per distinct text that is not empty: its key, how many documents have it, its
    numbers of tokens and groups, the linked id pairs (A's id in the upper 32 bits) with
    the times each occurs, and the groups as text if they are to be kept. A text whose
    joined bytes differ has none of them."""

    def make():
        key = ("aligner", tokenizer_a, tokenizer_b)
        aligner = worker_cache(key, lambda: Aligner(tokenizer_a, tokenizer_b))

        def convert(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {
                k: []
                for k in ("copies", "text_key", "n_a", "n_b", "n_groups", "groups_sha256", "groups")
            }
            pairs, times = [], []
            nothing = 0, 0, np.zeros(0, np.int64), []
            for text, key, copies in zip(*(c.to_pylist() for c in batch.columns)):
                n_a, n_b, links, groups = aligner.text(text) or nothing
                met, often = np.unique(links, return_counts=True)
                pairs.append(met)
                times.append(often)
                for name, value in zip(out, (copies, key, n_a, n_b, len(links))):
                    out[name].append(value)
                written_groups = b"".join(groups)
                digest = hashlib.sha256(written_groups).hexdigest() if groups else ""
                out["groups_sha256"].append(digest)
                out["groups"].append(written_groups.decode() if keep_groups else None)
            ends = np.cumsum([0, *map(len, pairs)])
            for name, parts, kind in (("pairs", pairs, "int64"), ("times", times, "int32")):
                flat = np.concatenate(parts or [np.zeros(0)]).astype(kind)
                out[name] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            return out

        return convert

    texts = docs.where(F.length("text") > 0).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    texts = texts.select("text", text_key("text"), "copies")
    return written(map_batches(texts, make, ALIGNED), "aligned-texts")


def each_pair(aligned: DataFrame, *columns: str) -> DataFrame:
    zipped = F.explode(F.arrays_zip("pairs", "times"))
    return aligned.select(*columns, zipped.alias("link")).select(
        *columns, F.col("link.pairs").alias("pair"), F.col("link.times").alias("times")
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, id_a, id_b, n, texts, best): links of an id pair in the corpus, copies
    included, the distinct texts with it, and whether no pair of that B id has more."""
    counts = (
        each_pair(aligned, "copies")
        .groupBy("pair")
        .agg(
            F.sum(F.col("times") * F.col("copies")).alias("n"),
            F.count(F.lit(1)).alias("texts"),
        )
        .select(
            "pair",
            F.shiftright("pair", 32).cast("int").alias("id_a"),
            F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("id_b"),
            "n",
            "texts",
        )
    )
    counts = written(counts, "pair-counts")
    # At most one row for each id of B.
    highest = counts.groupBy("id_b").agg(F.max("n").alias("highest"))
    return written(
        counts.join(F.broadcast(highest), "id_b").select(
            *counts.columns, (F.col("n") == F.col("highest")).alias("best")
        ),
        "pairs",
    )


def link_sums(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """(text_key, n_links, n_best, count_sum) per distinct text, in partial sums.

    Pairs in at least one of HOT_PAIRS of all (text, pair) rows, hence no more than
    HOT_PAIRS, are broadcast; rows of the others, none of them frequent, are shuffled."""
    rows = counts.agg(F.sum("texts")).first()[0] or 0
    hot = F.col("texts") * HOT_PAIRS >= rows
    links = each_pair(aligned, "text_key")
    values = counts.where(hot).select("pair", "n", "best")
    known = links.join(F.broadcast(values), "pair", "left")
    others = known.where("n IS NULL").select("text_key", "pair", "times")
    others = others.join(counts.where(~hot).select("pair", "n", "best"), "pair")
    return reduce_links(known.where("n IS NOT NULL")).unionByName(reduce_links(others))


def reduce_links(links: DataFrame) -> DataFrame:
    return links.groupBy("text_key").agg(
        F.sum("times").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align_documents(docs: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256.

    A document whose text is NULL or empty, or whose tokens of either tokenizer do not
    join to a space and the text, has zeros and an empty groups_sha256. Repeated rows and
    NULL ids are each kept. Columns besides doc_id and text are not read. No documents
    give no rows.
    """
    aligned = aligned_texts(docs, tokenizer_a, tokenizer_b, keep_groups=False)
    sums = link_sums(aligned, pair_counts(aligned))
    nothing = [F.lit(0).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    own = aligned.select("text_key", "copies", "n_a", "n_b", "n_groups", "groups_sha256", *nothing)
    added = [F.lit(0).cast("long").alias(c) for c in ("copies", "n_a", "n_b", "n_groups")]
    both = own.unionByName(sums.select("*", *added, F.lit(None).alias("groups_sha256")))
    measures = both.groupBy("text_key").agg(
        *[F.sum(c).alias(c) for c in ("copies", *MEASURES)],
        F.max("groups_sha256").alias("groups_sha256"),
    )
    return joined_back(docs, written(measures, "text-measures"))


def joined_back(docs: DataFrame, measures: DataFrame) -> DataFrame:
    """Measures of a text for each document with it. Texts that one of HOT_TEXTS of all
    rows have, hence no more than HOT_TEXTS, are broadcast; the others have few copies."""
    rows = measures.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") * HOT_TEXTS >= rows
    values = measures.drop("copies")
    keyed = written(docs.select("doc_id", text_key("text").alias("text_key")), "text-keys")
    known = keyed.join(F.broadcast(values.where(hot)), "text_key", "left")
    done = F.col("n_a").isNotNull() | F.col("text_key").isNull()
    others = known.where(~done).select("doc_id", "text_key")
    others = others.join(values.where(~hot), "text_key")
    return known.where(done).unionByName(others).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in MEASURES],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
