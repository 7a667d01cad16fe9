"""Books to sections, paragraphs, chunks and navigation groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.tokens import light_tokens


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): lines of each text, right-stripped, from 1. A null text has none."""
    split = F.split(F.col(text), "\r\n|\r|\n")
    return docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(split).alias("p", "l")).select(key, (F.col("p") + 1).alias("line_no"), F.regexp_replace("l", r"(?U)\s+$", "").alias("line"))


def sections(rows: DataFrame, key: str, heading: Column, fallback: str = "front") -> DataFrame:
    """Lines grouped under the heading before them: (key, section_no, title, n_lines, n_chars, first_line).

    Lines before the first heading form section 0 with the fallback title; sections without body lines have 0 of them.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    tagged = rows.withColumn("_h", F.coalesce(heading, F.lit(False)).cast("int")).withColumn("section_no", F.sum("_h").over(w))
    body = F.col("_h") == 0
    return tagged.groupBy(key, "section_no").agg(
        F.coalesce(F.max(F.when(~body, F.col("line"))), F.lit(fallback)).alias("title"),
        F.count_if(body & (F.col("line") != "")).alias("n_lines"),
        F.coalesce(F.sum(F.when(body, F.length("line"))), F.lit(0)).cast("long").alias("n_chars"),
        F.min("line_no").alias("first_line"),
    )


def paragraphs(rows: DataFrame, key: str, ends: str = "[。！？.!?：:”』」）)]$") -> DataFrame:
    """Wrapped lines joined until one ends with a terminal mark; a blank line always ends a paragraph."""
    w = Window.partitionBy(key).orderBy("line_no")
    closed = F.col("line").rlike(ends) | (F.col("line") == "")
    tagged = rows.withColumn("_p", F.sum(F.coalesce(F.lag(closed.cast("int")).over(w), F.lit(0))).over(w))
    joined = tagged.groupBy(key, "_p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "").alias("paragraph"), F.min("line_no").alias("first_line"))
    kept = joined.filter("paragraph != ''")
    return kept.withColumn("paragraph_no", F.row_number().over(Window.partitionBy(key).orderBy("first_line"))).select(key, "paragraph_no", "paragraph", "first_line")


def chunks(docs: DataFrame, key: str, text: str, size: int = 800, overlap: int = 80) -> DataFrame:
    """Y2: (key, chunk_no, start_at, end_at, chunk): at most ``size`` characters, cut back to a line break beyond half, with overlap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for k, t in zip(b[key].tolist(), b[text], strict=True):
                t, at, n = t or "", 0, 0
                while at < len(t):
                    end = min(len(t), at + size)
                    if end < len(t):
                        back = t.rfind("\n", at + size // 2, end)
                        end = back + 1 if back > 0 else end
                    piece = t[at:end].strip()
                    if piece:
                        out.append((k, n, at, end, piece))
                        n += 1
                    if end >= len(t):
                        break
                    at = max(end - overlap, at + 1)
            yield pd.DataFrame(out, columns=[key, "chunk_no", "start_at", "end_at", "chunk"])

    return docs.select(key, text).mapInPandas(run, f"`{key}` {dict(docs.dtypes)[key]}, chunk_no int, start_at int, end_at int, chunk string")


def merge_bodies(parts: DataFrame, key: str, order: str, text: str, least: int = 25, most: int = 400) -> DataFrame:
    """Pieces of a section in order, with the longest overlap of neighbours (25 to 400 characters) taken once."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        whole = ""
        for piece in rows.sort_values(order, kind="stable")[text].fillna(""):
            top = min(most, len(whole), len(piece))
            n = next((n for n in range(top, least - 1, -1) if whole.endswith(piece[:n])), 0)
            whole += piece[n:] if n or not whole else "\n" + piece
        return pd.DataFrame({key: [rows[key].iloc[0]], "merged": [whole], "pieces": [len(rows)]})

    return parts.select(key, order, text).groupBy(key).applyInPandas(fold, f"`{key}` {dict(parts.dtypes)[key]}, merged string, pieces int")


def section_nodes(docs: DataFrame, by: list[str], order: str) -> DataFrame:
    """Leaf count and first-row metadata of each section."""
    return docs.groupBy(*by).agg(F.count("*").alias("leaves"), F.min(order).alias("first_leaf"), F.min_by("chapter_title", order).alias("first_chapter"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"))


def top_terms(docs: DataFrame, by: list[str], key: str, words: list[str], n: int = 8) -> DataFrame:
    """Of each group the n keywords that most of its documents hold; ties by the list's order."""
    found = docs.select(*by, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(w).alias("word")) for i, w in enumerate(words)))).alias("k"), "text").filter(F.col("text").contains(F.col("k.word")))
    counts = found.groupBy(*by, "k").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "k.i")
    top = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    return top.select(*by, "place", F.col("k.word").alias("word"), "n")


def similarity_floor(docs: DataFrame, by: str, order: str) -> DataFrame:
    """M6: median of the non-zero token similarities of neighbours, kept within .12 and .32, 3 digits; .18 without any."""
    w = Window.partitionBy(by).orderBy(order)
    sets = docs.select(by, order, F.array_distinct(light_tokens("text")).alias("t")).withColumn("before", F.lag("t").over(w))
    union = F.size(F.array_union("t", "before"))
    sim = sets.withColumn("sim", F.when(F.col("before").isNotNull() & (union > 0), F.size(F.array_intersect("t", "before")) / union))
    mid = F.percentile(F.when(F.col("sim") > 0, F.col("sim")), 0.5)
    return sim.groupBy(by).agg(F.count("*").alias("sections"), F.coalesce(F.round(F.greatest(F.lit(0.12), F.least(F.lit(0.32), mid)), 3), F.lit(0.18)).alias("floor"))


def navigation_groups(docs: DataFrame, by: str, order: str, most: int = 12, floor: float = 0.18) -> DataFrame:
    """Neighbours of a book gathered until the group is full or the next one shares too few tokens with it.

    Order-dependent: one Python call a book.
    """

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        number, size, held, out = 0, 0, set(), []
        for t in rows["tokens"]:
            now = set(t)
            like = len(held & now) / max(1, len(held | now))
            if size and (size >= most or like < floor):
                number, size, held = number + 1, 0, set()
            size, held = size + 1, held | now
            out.append(number)
        return pd.DataFrame({by: rows[by], order: rows[order], "group_no": out})

    types = dict(docs.dtypes)
    return docs.select(by, order, F.array_distinct(light_tokens("text")).alias("tokens")).groupBy(by).applyInPandas(split, f"`{by}` {types[by]}, `{order}` {types[order]}, group_no int")
