"""Public tokenizers of the ``tokenizers`` library, with each distinct piece of a text merged once.

Texts of Latin code points without special strings are split into the library's pieces here and each new piece goes
through the library's model; any other text goes through the library whole. Both give what the library gives.
"""

from __future__ import annotations

import hashlib
import os
import struct
from functools import lru_cache

import numpy as np
import public_tokenizers
import tokenizers

from .presplit import BYTE_BPE, SPACES, WORD_BPE, Pieces, is_latin


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is printable, else the next above 255."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


@lru_cache(maxsize=1)
def _library(name: str) -> tokenizers.Tokenizer:
    """The library's tokenizer: a worker that runs many tasks loads the file once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(name))


class Pretrained:
    """One tokenizer file: ids or counts of whole texts, without begin, end or added special tokens. A task has its own."""

    def __init__(self, name: str):
        self.library = _library(name)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words = self.library.normalizer is not None
        self._model = self.library.model
        self._packed = Pieces(lambda piece: struct.pack(f"<{len(found := self._merged(piece))}I", *[t.id for t in found]))
        self._counts = Pieces(lambda piece: len(self._merged(piece)))

    def _merged(self, piece: str):
        return self._model.tokenize(piece.encode().decode("latin-1").translate(_LETTERS))

    def _pieces(self, text: str) -> list[str] | None:
        if not is_latin(text) or any(s in text for s in self.specials):
            return None
        return WORD_BPE.findall(text.lower()) if self.words else BYTE_BPE.findall(text)

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        pieces = self._pieces(text)
        if pieces is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self._packed.__getitem__, pieces))

    def count(self, text: str) -> int:
        pieces = self._pieces(text)
        return len(self.library.encode(text, add_special_tokens=False).ids) if pieces is None else sum(map(self._counts.__getitem__, pieces))

    def normalised(self, text: str) -> str:
        """A text with the same count, equal for texts that differ only in what the tokenizer ignores.

        Special strings are found before anything is normalised, so a text that has one, or would get one, stays as it is.
        """
        if not self.words:
            return text
        found = SPACES.sub(" ", text.lower()) if is_latin(text) else self.library.normalizer.normalize_str(text)
        return text if any(s in found or s in text for s in self.specials) else found.strip(" ")


def version_digest(name: str) -> str:
    """Digest of the tokenizer: of the bytes of its file and of the library's version."""
    with open(public_tokenizers.path(name), "rb") as file:
        return hashlib.sha256(tokenizers.__version__.encode() + b"\0" + file.read()).hexdigest()
