"""Operator 10: byte-level BPE token counts by a finite-state transducer.

Pre-tokenisation and merging are compiled, as texts need it, into one deterministic
transducer over characters. A transition carries the change of the token count, so
after each character the sum is the count of the text so far.

State inside a pre-token. The encoding of a prefix ends in exactly one token, and a
token ``t`` may follow ``s`` only if the two bytes strings joined encode to [s, t].
So the last token of a longer prefix follows from the last tokens of the prefixes
before it, and of these only as many matter as the longest suffix that still begins
some token: a finite state.

A piece of white space and what follows it up to the next white space always begins
in the start state. Its way through the transducer is kept as one macro transition, so
frequent pieces cost one look-up and only new ones are walked character by character.

A chunk of a text maps an entry state to an exit state and a count. Once a
non-space is followed by a space the entry state is forgotten, so a chunk's map is
(head, count, exit): the characters up to that point, to be run from the entry
state, and what follows. Maps compose associatively and are folded pairwise.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from emberlog.llm.common import map_batches, worker_cache

CHUNK_CHARS = 65_536
# Transitions a worker keeps before it starts compiling anew, some 400 bytes each, and
# characters between two looks at their number.
MOST_TRANSITIONS = 800_000
STEP = 4096
# Pieces kept, and the characters of the longest; pairs of tokens known to follow each
# other or not to.
MOST_MACROS, LONGEST_MACRO = 600_000, 64
MOST_ALLOWED = 500_000

# The contractions that the byte-level pre-tokenizer splits off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
# Characters with the White_Space property: Python counts four separators besides.
WHITE_SPACE = "".join(
    c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f"
)

PIECE = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
SYNC = re.compile(f"(?<=[^{WHITE_SPACE}])[{WHITE_SPACE}]")


def character_class(char: str) -> str:
    if char in WHITE_SPACE:
        return "W"
    category = unicodedata.category(char)[0]
    return category if category in "LN" else "O"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Merges:
    """The vocabulary as bytes; which tokens may follow each other."""

    def __init__(self, model: dict):
        byte_of = byte_alphabet()

        def raw(token: str) -> bytes:
            return bytes(byte_of[c] for c in token)

        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.rank = {(raw(a), raw(b)): n for n, (a, b) in enumerate(pairs)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        self.beginnings = {t[:n] for t in self.tokens for n in range(1, len(t))}
        self.allowed: dict[tuple[bytes, bytes], bool] = {}

    def encode(self, text: bytes) -> list[bytes]:
        """Plain merging, lowest rank first, for the few bytes of two tokens."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranks = [self.rank.get(pair, len(self.rank)) for pair in zip(parts, parts[1:])]
            best = min(ranks)
            if best == len(self.rank):
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: bytes, token: bytes) -> bool:
        found = self.allowed.get((left, token))
        if found is None:
            if len(self.allowed) >= MOST_ALLOWED:
                self.allowed.clear()
            found = self.allowed[left, token] = self.encode(left + token) == [left, token]
        return found

    # A pre-token's state: (suffix, history). `history` has for the prefix that ends
    # before the suffix, and for each one that ends in it, its last token (None for
    # the empty prefix) and its count less that of the whole.
    EMPTY = (b"", ((None, 0),))

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        suffix, history = state
        suffix += bytes([byte])
        for at in range(len(suffix)):
            token, (left, count) = suffix[at:], history[at]
            if token in self.tokens and (left is None or self.may_follow(left, token)):
                break
        else:
            raise ValueError("the merges leave a byte without a token")
        more = count + 1
        history = [(t, n - more) for t, n in history] + [(token, 0)]
        keep = next(
            (n for n in range(len(suffix), 0, -1) if suffix[-n:] in self.beginnings), 0
        )
        suffix, history = suffix[len(suffix) - keep :], history[len(history) - keep - 1 :]
        # A prefix after which no token goes on any more is never asked for again.
        for at in range(1, keep):
            if suffix[at:] not in self.beginnings:
                history[at] = (None, 0)
        return (suffix, tuple(history)), more

    def run(self, state: tuple, text: str) -> tuple[tuple, int]:
        total = 0
        for byte in text.encode():
            state, more = self.step(state, byte)
            total += more
        return state, total


START = ("start",)


class State(dict):
    """character -> (next state, change of the count), filled when first needed."""

    __slots__ = ("key", "machine")

    def __init__(self, key: tuple, machine: Transducer):
        self.key, self.machine = key, machine

    def __missing__(self, char: str) -> tuple[State, int]:
        found = self[char] = self.machine.transition(self.key, char)
        self.machine.transitions += 1
        return found


class Macros(dict):
    """piece -> its count from the start state; later pieces are walked each time."""

    __slots__ = ("machine",)

    def __missing__(self, piece: str) -> int:
        count = self.machine.walk(START, piece)[1]
        if len(self) < MOST_MACROS and len(piece) <= LONGEST_MACRO:
            self[piece] = count
        return count


class Transducer:
    """Keys: ("start",); ("word", class, bpe); ("quote",) after a lone apostrophe that
    may begin a contraction; ("begun", letters) inside one; ("space", bpe of the run
    without its last character, last character, bpe of the run, count between them)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.merges = Merges(described["model"])
        specials = [t["content"] for t in described["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.macros = Macros()
        self.macros.machine = self
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, State] = {}
        self.transitions = 0

    def state(self, key: tuple) -> State:
        return self.states.setdefault(key, State(key, self))

    def begin(self, char: str) -> tuple[tuple, int]:
        """A new pre-token with ``char`` first."""
        kind = character_class(char)
        bpe, more = self.merges.run(Merges.EMPTY, char)
        if char == "'":
            return ("quote",), more
        if kind == "W":
            return ("space", Merges.EMPTY, char, bpe, more), more
        return ("word", kind, bpe), more

    def transition(self, key: tuple, char: str) -> tuple[State, int]:
        key, more = self.next_key(key, char)
        return self.state(key), more

    def next_key(self, key: tuple, char: str) -> tuple[tuple, int]:
        kind, merges = character_class(char), self.merges
        if key[0] == "word" and kind == key[1]:
            bpe, more = merges.run(key[2], char)
            return ("word", kind, bpe), more
        if key[0] == "quote":
            if "'" + char in CONTRACTIONS:
                whole = merges.run(Merges.EMPTY, "'" + char)[1]
                return ("start",), whole - merges.run(Merges.EMPTY, "'")[1]
            if any(c.startswith("'" + char) for c in CONTRACTIONS):
                return ("begun", char), merges.run(Merges.EMPTY, char)[1]
            if kind == "O":
                bpe, more = merges.run(merges.run(Merges.EMPTY, "'")[0], char)
                return ("word", "O", bpe), more
        if key[0] == "begun":
            if "'" + key[1] + char in CONTRACTIONS:
                apart = sum(merges.run(Merges.EMPTY, part)[1] for part in ("'", key[1]))
                return ("start",), merges.run(Merges.EMPTY, "'" + key[1] + char)[1] - apart
            return self.next_key(("word", "L", merges.run(Merges.EMPTY, key[1])[0]), char)
        if key[0] == "space":
            _, _, last, run, between = key
            if kind == "W":
                bpe, more = merges.run(run, char)
                return ("space", run, char, bpe, more), more
            if last == " ":
                bpe, more = merges.run(Merges.EMPTY, " " + char)
                return ("word", kind, bpe), more - between
            following, more = self.begin(char)
            return following, merges.run(Merges.EMPTY, last)[1] - between + more
        return self.begin(char)

    # Maps of chunks: (head, count, key of the exit state); no key if all is head. A key
    # alone builds its state again, so nothing else of the states has to be kept.

    def walk(self, key: tuple, text: str) -> tuple[tuple, int]:
        total, state = 0, self.state(key)
        for at in range(0, len(text), STEP):
            if self.transitions > MOST_TRANSITIONS:
                self.clear()
                state = self.state(state.key)
            for char in text[at : at + STEP]:
                state, more = state[char]
                total += more
        return state.key, total

    def chunk_map(self, text: str, first: bool) -> tuple[str, int, tuple | None]:
        found = None if first else SYNC.search(text)
        if not first and not found:
            return text, 0, None
        at = found.start() if found else 0
        *before, last = PIECE.findall(text, at)
        key, total = self.walk(START, last)
        return text[:at], sum(map(self.macros.__getitem__, before)) + total, key

    def compose(self, left: tuple, right: tuple) -> tuple:
        if left[2] is None:
            return left[0] + right[0], right[1], right[2]
        key, total = self.walk(left[2], right[0])
        return left[0], left[1] + total + right[1], key if right[2] is None else right[2]

    def count_plain(self, text: str) -> int:
        maps = [
            self.chunk_map(text[at : at + CHUNK_CHARS], at == 0)
            for at in range(0, len(text), CHUNK_CHARS)
        ]
        while len(maps) > 1:
            paired = [self.compose(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)]
            maps = paired + maps[len(paired) * 2 :]
        return maps[0][1] if maps else 0

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's text counts one and cuts the text."""
        if self.special is None:
            return self.count_plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.count_plain, parts))


def counts(texts: Iterable[str | None], path: str) -> list[int]:
    machine = worker_cache(("transducer", path), lambda: Transducer(path))
    return [machine.count(text) if text else 0 for text in texts]


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = 512,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row; needs no shuffle.

    NULL texts count as empty: 0 bytes and 0 tokens. Ids may be NULL or repeat; each
    row gives a row. Other columns are not read, so their names cannot clash. An
    empty table gives an empty table.
    """

    def make():
        def convert(batch: pa.RecordBatch) -> dict:
            texts = batch.column(1).to_pylist()
            tokens = counts(texts, tokenizer)
            return {
                "doc_id": batch.column(0),
                "n_bytes": [len(t.encode()) if t else 0 for t in texts],
                "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens],
            }

        return convert

    return map_batches(
        docs.selectExpr(f"`{id_column}` AS doc_id", f"`{text_column}` AS text"),
        make,
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    )
