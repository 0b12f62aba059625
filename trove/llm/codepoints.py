"""Codepoint-class arrays, built once per Python worker from the Unicode database."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE, MARK = 0, 1, 2, 3, 4
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """uint8 class of every code point: letter (L*), number (N*), mark (M*), white space, else other."""
    by_category = {"L": LETTER, "N": NUMBER, "M": MARK}
    table = np.fromiter((by_category.get(unicodedata.category(chr(cp))[0], OTHER) for cp in range(0x110000)), dtype=np.uint8, count=0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def decode(text: str) -> np.ndarray:
    """Code points of ``text`` as uint32 (lone surrogates keep their value)."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
