"""Problem 6: cutting oversized texts at natural boundaries with an overlap.

Boundaries of a text are kept as one sorted array of offsets, with the rank of each (line break, sentence
end, other mark or space). Token sizes are prefix sums over the text, so that a limit in tokens becomes an
offset; with the default of one token a character the prefix sum is the offset itself. A piece ends at a
line break or sentence end under the limit where there is one, else at the last other mark, found by binary search;
the next begins the overlap before that end. Without
any boundary among the new characters the cut is hard, at the limit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks after which a sentence is over, and closing marks that stay with it.
SENTENCE_END = "。！？；!?;…"
CLOSING = "”’」』）》〉】\"')]"

_LINE = re.compile(r"\n+")
_SENTENCE = re.compile(f"[{re.escape(SENTENCE_END)}]+[{re.escape(CLOSING)}]*|\\.(?=\\s)")
_OTHER = re.compile(r"[^\w]|_")
_BREAKS = re.compile(r"(?:\r\n?|\n){3,}")


def tidy(text: str | None) -> str:
    """Without white space at both ends; three or more line breaks in a row become two."""
    return _BREAKS.sub("\n\n", (text or "").strip())


def boundaries(text: str) -> tuple[list[int], list[int], list[int]]:
    """Sorted offsets just after a line break, a sentence end, and any mark or space at all."""
    return [m.end() for m in _LINE.finditer(text)], [m.end() for m in _SENTENCE.finditer(text)], [m.end() for m in _OTHER.finditer(text)]


def longest_stretch(text: str, marks: list[int]) -> int:
    """Characters of the longest run between two boundaries of any kind."""
    at, most = 0, 0
    for end in marks:
        most, at = max(most, end - 1 - at), end
    return max(most, len(text) - at)


def cut_points(text: str, limit: int, overlap: int, sizes: list[int] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pieces. kind: 'line', 'sentence', 'mark', 'hard', or 'end' for the last one.

    ``sizes``: prefix sums of token sizes, one entry more than characters; None counts characters.
    A line break or sentence end in the later half of the new characters is taken first, then one in the first
    half, and only without any of them another mark or space. Every piece ends beyond the one before it and
    repeats the whole overlap before its new characters, or all there is where that is less.
    """
    n, start, done, out = len(text), 0, 0, []
    total = (lambda i: i) if sizes is None else sizes.__getitem__
    at_most = (lambda i: min(n, i)) if sizes is None else (lambda t: min(n, bisect_right(sizes, t) - 1))
    ranked = list(zip(("line", "sentence", "mark"), boundaries(text), strict=True))
    while True:
        top = max(at_most(total(start) + limit), done + 1)
        if top >= n:
            return [*out, (start, n, "end")]
        end, kind = top, "hard"
        for kinds, least in ((ranked[:2], (done + top) // 2), (ranked[:2], done), (ranked[2:], done)):
            for name, marks in kinds:
                k = bisect_right(marks, top) - 1
                if k >= 0 and marks[k] > least:
                    end, kind = marks[k], name
                    break
            if kind != "hard":
                break
        out.append((start, end, kind))
        done = end
        start = max(0, end - overlap) if sizes is None else bisect_left(sizes, max(0, sizes[end] - overlap))


def split_oversized(
    df: DataFrame, *, key: str = "sequence", text: str = "text_chunk", keep: tuple[str, ...] = ("chapter_name",), limit: int = 800, overlap: int = 200, token_sizes: Callable[[str], list[int]] | None = None
) -> DataFrame:
    """One row per piece: key, kept columns, piece_no, start_at, end_at, cut_kind, longest_stretch, n_chars, piece.

    A text within the limit gives one piece. Null and blank texts give one empty piece, so that no row is lost.
    Repeated rows are cut each; extra columns are dropped before the texts are moved to Python. A text is
    handled by itself, so that neither order nor partitioning of the rows matters.
    ``token_sizes`` gives the prefix sums of a text for limits in tokens.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    cols = [key, *keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for *head, raw in batch[[*cols, text]].itertuples(index=False, name=None):
                whole = tidy(raw)
                stretch = longest_stretch(whole, boundaries(whole)[2])
                cuts = cut_points(whole, limit, overlap, token_sizes and token_sizes(whole))
                rows += [(*head, i, a, b, kind, stretch, len(whole), whole[a:b]) for i, (a, b, kind) in enumerate(cuts)]
            yield pd.DataFrame(rows, columns=[*cols, "piece_no", "start_at", "end_at", "cut_kind", "longest_stretch", "n_chars", "piece"])

    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in cols) + ", piece_no int, start_at int, end_at int, cut_kind string, longest_stretch int, n_chars int, piece string"
    return df.select(*cols, text).mapInPandas(run, schema)


def cut_report(df: DataFrame, *, key: str = "sequence", text: str = "text_chunk", limit: int = 800, overlap: int = 200) -> DataFrame:
    """Items over the limit with cut_type: 'forced' if some stretch of more than limit - overlap characters has no boundary."""
    pieces = split_oversized(df, key=key, text=text, keep=(), limit=limit, overlap=overlap)
    return (
        pieces.filter((F.col("piece_no") == 0) & (F.col("n_chars") > limit))
        .select(key, F.when(F.col("longest_stretch") > limit - overlap, "forced").otherwise("natural").alias("cut_type"))
        .distinct()
    )
