"""Splitting texts into the pieces that public tokenizers merge separately.

Texts of Latin code points only, nearly all there are, are split by the standard regular expression module with
classes built from the Unicode tables; others by what the caller gives. Both split alike, the first several times
faster.
"""

from __future__ import annotations

import re
import unicodedata

#: Last code point of the Latin blocks for which the fast patterns hold; U+0130 lower-cases to two code points.
LAST_LATIN = 0x24F
_NOT_LATIN = re.compile("[^\x00-ɏ]|İ")
#: Fixed value: code points up to LAST_LATIN with the White_Space property.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"


def _category(first: str) -> str:
    """The inside of a character class: Latin code points whose general category begins with ``first``."""
    return "".join(re.escape(chr(c)) for c in range(LAST_LATIN + 1) if unicodedata.category(chr(c))[0] == first)


_L, _N = _category("L"), _category("N")
#: Fixed value: the contractions that come first in both patterns.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_BPE = re.compile(f"{_CONTRACTIONS}| ?[{_L}]+| ?[{_N}]+| ?[^{_SPACE}{_L}{_N}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
SPACES = re.compile(f"[{_SPACE}]+")
WORD_BPE = re.compile(f"{_CONTRACTIONS}|[{_L}]+|[{_N}]|[^{_SPACE}{_L}{_N}]+")


def is_latin(text: str) -> bool:
    return text.isascii() or _NOT_LATIN.search(text) is None


class Pieces(dict):
    """piece -> what ``make`` gives for it. The newest ``most`` pieces are kept, and those before them for as long again:
    of two generations the older one goes, but what was used meanwhile is in the newer one. A table belongs to a task and
    ends with it; 400,000 short pieces take some 70 MB."""

    def __init__(self, make, most: int = 200_000):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece):
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found
