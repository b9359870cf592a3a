"""Token ids of whole texts as the tokenizers library gives them, word by word.

The word-end vocabulary never joins anything over white space, so a text's ids are
those of its white-space-separated pieces. A worker keeps the ids of the pieces it
has met; the library encodes each new one.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

from emberlog.llm.common import worker_cache

# Pieces a worker keeps, and the characters of the longest; others are encoded each time.
MOST_PIECES, LONGEST_PIECE = 600_000, 64
# Longer pieces are cut where a letter and a digit meet, over which nothing is joined.
LONG = 10_000
LETTER_DIGIT = re.compile("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
ID_BYTES = 4

# Python also splits at these four separators, which are no white space to the library.
SEPARATORS = re.compile("[\x1c-\x1f]")
OTHER_SPACES = re.compile("[ \t\n\r]+")
LETTERS = re.compile("([a-zß-öø-ÿ]+)([.,;:!?]*)")


def byte_characters() -> dict[int, str]:
    """For each byte (as a Latin-1 character) the one that a byte-level vocabulary uses."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


class Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.characters = byte_characters()

    def __missing__(self, piece: str) -> bytes:
        found = LETTERS.fullmatch(piece)
        if found and found[2]:
            ids = self[found[1]] + self[found[2]]
        elif found:
            # One run of lower-case letters: nothing to normalise or split.
            letters = piece.encode().decode("latin-1").translate(self.characters)
            tokens = self.model.tokenize(letters)
            ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        else:
            numbers = self.tokenizer.encode(piece, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(numbers)}I", *numbers)
        if len(self) < MOST_PIECES and len(piece) <= LONGEST_PIECE:
            self[piece] = ids
        return ids

    def of_long(self, piece: str) -> Iterator[bytes]:
        start = 0
        while start < len(piece):
            cut = LETTER_DIGIT.search(piece, start + LONG)
            end = cut.start() if cut else len(piece)
            yield self[piece[start:end]]
            start = end

    def encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            # Latin-1 letters are composed and have one lower-case form each; names of
            # special tokens are looked for before the case is changed.
            text = text if "<|" in text else text.lower()
        except UnicodeEncodeError:
            pass
        pieces = OTHER_SPACES.split(text) if SEPARATORS.search(text) else text.split()
        if len(text) > LONG and any(len(piece) > LONG for piece in pieces):
            long = (self.of_long(p) if len(p) > LONG else (self[p],) for p in pieces)
            return b"".join(chain.from_iterable(long))
        return b"".join(map(self.__getitem__, pieces))


def encoder(path: str) -> Pieces:
    return worker_cache(("pieces", path), lambda: Pieces(path))
