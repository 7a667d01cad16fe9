"""Tokenizers and term builders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ideographs and runs of a-z, 0-9; the light tokenizer of the corpus index.
LIGHT = r"[一-鿿]|[a-z0-9]+"


def light_tokens(c: Column | str) -> Column:
    """Ideographs and lower-case alphanumeric runs, in order, repeated ones kept; null gives an empty array."""
    text = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return F.regexp_extract_all(text, F.lit(LIGHT), F.lit(0))


def distinct_tokens(c: Column | str) -> Column:
    """``light_tokens`` without repeats, first-seen order."""
    return F.array_distinct(light_tokens(c))


def windows(c: Column, n: int) -> Column:
    """All substrings of n characters, in order; none for shorter text."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))


def trigrams(c: Column | str) -> Column:
    """X11: character trigrams of the ideograph spans of a text, span by span."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"[一-鿿]+"), F.lit(0)), lambda s: windows(s, 3)))


def adjacent_pairs(tokens: Column, least: int = 3, most: int = 12, numeric: bool = False) -> Column:
    """Neighbouring tokens joined, of 3 to 12 characters, pairs with a number skipped, without repeats."""
    n = F.size(tokens)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at(tokens, i).alias("a"), F.element_at(tokens, i + 1).alias("b")))).otherwise(F.array().cast("array<struct<a:string,b:string>>"))
    ok = lambda p: F.length(F.concat(p["a"], p["b"])).between(least, most) & (F.lit(numeric) | ~(p["a"].rlike("^[0-9]+$") | p["b"].rlike("^[0-9]+$")))
    return F.array_distinct(F.transform(F.filter(pairs, ok), lambda p: F.concat(p["a"], p["b"])))


def probe_terms(c: Column | str, most: int = 8) -> Column:
    """Distinct runs of 2-12 ideographs or 2-32 alphanumerics, the longest first, then by text; else the first 12 characters."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    runs = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[一-鿿]{2,12}|[a-z0-9]{2,32}"), F.lit(0)))
    best = F.slice(F.transform(F.array_sort(F.transform(runs, lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r")))), lambda x: x["r"]), 1, most)
    compact = F.regexp_replace(text, r"(?U)\s+", "")
    return F.when(F.size(best) > 0, best).when(compact != "", F.array(F.substring(compact, 1, 12))).otherwise(F.array().cast("array<string>"))


def fragments(c: Column | str, marks: str = "[，。；：？！、,.;:?!\\s（）()《》“”]+") -> Column:
    """Parts of a query between marks, of two characters or more, without repeats."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.array_distinct(F.filter(F.split(text, marks), lambda x: F.length(x) >= 2))


def loose(c: Column | str) -> Column:
    """Lower case, without white space and the marks of either script."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.regexp_replace(F.lower(text), r"(?U)[\s\p{P}\p{S}]+", "")


def either_contains(a: Column, b: Column) -> Column:
    """One text holds the other; empty ones hold nothing and are held by none."""
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Size of the intersection over that of the union; ``both_empty`` where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def collapse_contained(terms: Column) -> Column:
    """Terms in order, without those that an earlier other term contains."""
    return F.filter(terms, lambda x, i: ~F.exists(F.slice(terms, F.lit(1), i), lambda y: y.contains(x) & (y != x)))


def triple_key(*columns: str) -> Column:
    """Columns in lower case, without white space and with plain marks, joined by '|'; null is ''."""
    plain = lambda c: F.regexp_replace(F.translate(F.lower(F.coalesce(F.col(c), F.lit(""))), "，；：（）", ",;:()"), r"(?U)\s+", "")
    return F.concat_ws("|", *map(plain, columns))


def snippet(c: Column | str, limit: int = 160) -> Column:
    """Stripped text cut to ``limit`` characters; null is ''."""
    return F.substring(F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"(?U)^\s+|\s+$", ""), 1, limit)


def book_label(c: Column | str) -> Column:
    """A book name without its numeric prefix."""
    return F.regexp_replace(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), r"^[0-9]+\s*[-_－—]\s*", "")


def chapter_label(book: Column, chapter: Column) -> Column:
    """A chapter without the book's name in front of it; '' where it only repeats the book."""
    text = F.trim(F.coalesce(chapter, F.lit("")))
    rest = F.substring(text, F.length(book) + 1, F.length(text))
    return F.when((text == "") | (text == book), "").when((book != "") & text.startswith(book), F.regexp_replace(rest, r"^[\s·:：/_\-—]+", "")).otherwise(text)


def safe_name(c: Column) -> Column:
    """A file name in which anything but letters, digits and - _ . is '_'."""
    return F.regexp_replace(c, r"(?U)[^\w.\-]", "_")
