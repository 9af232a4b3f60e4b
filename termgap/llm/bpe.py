"""Byte-level BPE ids of whole texts through the tokenizers library, with each distinct piece encoded once per worker.

A byte-level BPE never merges across the pieces that its split pattern makes, so the ids of a text are the ids of its
pieces one after the other. Texts with characters for which Python's classes could differ from the pattern's, or with a
special token's string, go to the library whole.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache
from itertools import filterfalse

import numpy as np

#: Fixed value: the split pattern of the tokenizer, in Python's syntax for the characters of SAFE.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters whose class is the same for Python and for the pattern: letters, ASCII digits, punctuation, plain blanks.
SAFE = re.compile(r"[\t\n\r -~¡-±´-¸º»¿-ɏ‐-‧]*")
#: Pieces that a worker keeps; beyond, it starts anew.
KEPT_PIECES = 1_200_000


def _letters() -> dict[int, str]:
    """The library's name for each byte: itself if it is visible, else a letter from U+0100 on, in order of bytes."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(0x100 + i) for i, b in enumerate(rest)}


LETTERS = _letters()


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pieces: dict[str, bytes] = {}

    def _plain(self, text: str) -> bool:
        return SAFE.fullmatch(text) is not None and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
        cut: list[list[str] | None] = []
        new: set[str] = set()
        known = self.pieces.__contains__
        for text in texts:
            found = PIECE.findall(text) if self._plain(text) else None
            if found:
                new.update(filterfalse(known, found))
            cut.append(found)
        tokenize = self.library.model.tokenize
        for piece in new:
            ids = [t.id for t in tokenize(piece.encode().decode("latin-1").translate(LETTERS))]
            self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)
        ids_of = self.pieces.__getitem__
        return [
            b"".join(map(ids_of, found)) if found is not None
            else np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            for text, found in zip(texts, cut)
        ]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and tokenizer file."""
    return Encoder(path)


def slices(column, size: int = 512):
    """Python strings of an Arrow column, a bounded number at a time."""
    for at in range(0, len(column), size):
        yield at, column.slice(at, size).to_pylist()
