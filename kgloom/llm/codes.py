"""Texts as arrays of code points, for operators that scan whole corpora with numpy."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@lru_cache(maxsize=1)
def content_table() -> np.ndarray:
    """For each code point its folded letter, digit or ideograph (case and width don't matter), or 0 for anything else."""
    table = np.zeros(0x110000, "u4")
    for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x323B0)):
        table[a:b] = np.arange(a, b)
    for a, b in ((0, 0x3400), (0xA000, 0xAC00), (0xD7B0, 0xD800), (0xF900, 0x20000)):
        for code in range(a, b):
            c = chr(code)
            if unicodedata.category(c)[0] in "LN":
                folded = unicodedata.normalize("NFKC", c).casefold()
                table[code] = ord(folded) if len(folded) == 1 else code
    return table


def content(text: str | None) -> np.ndarray:
    """The folded content characters of a text."""
    folded = content_table()[code_points(text or "")]
    return folded[folded > 0]


def token_mask(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lower-cased code points: where an ideograph U+4E00 to U+9FFF stands, and where one of a-z and 0-9 does."""
    return (codes >= 0x4E00) & (codes <= 0x9FFF), ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57))
