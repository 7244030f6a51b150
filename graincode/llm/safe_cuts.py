"""Cuts of a text at which a byte-level splitter starts a new word whatever surrounds them.

A safe cut lies before a single space between two characters that are not white space. No added token holds a space, so the parts
can be encoded one by one, and equal parts give equal tokens.
"""

from __future__ import annotations

import re

#: All white space of Unicode, and some control characters that Python counts as such.
_WHITE = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_ASCII_PAIRS, _PAIRS = (tuple({p for w in _WHITE if ord(w) < top for p in (w + " ", " " + w)}) for top in (128, 0x110000))
_CUT = re.compile(r"(?<=\S) (?=\S)")


def parts(text: str) -> list[str]:
    """The parts between safe cuts; every part but the first stands for itself with a space before it."""
    odd = text[:1] == " " or text[-1:] == " " or any(p in text for p in (_ASCII_PAIRS if text.isascii() else _PAIRS))
    return _CUT.split(text) if odd else text.split(" ")
