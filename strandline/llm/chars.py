"""Unicode classes as a lookup table over code points, for numpy code in Arrow workers."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

OTHER, LETTER, MARK, DIGIT, PUNCT, SYMBOL, SPACE, FORMAT = range(8)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """uint8 class of every code point; built once per Python worker."""
    kind = {"L": LETTER, "M": MARK, "N": DIGIT, "P": PUNCT, "S": SYMBOL, "Z": SPACE}
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    # Planes 4 to 13 hold no characters, 15 and 16 only private ones.
    for i in (*range(0x40000), *range(0xE0000, 0xE1000)):
        cat = unicodedata.category(chr(i))
        out[i] = FORMAT if cat == "Cf" else kind.get(cat[0], OTHER)
    for c in "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85":
        out[ord(c)] = SPACE
    return out


def points(text: str) -> np.ndarray:
    """Code points of ``text``; positions equal Python string positions."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
