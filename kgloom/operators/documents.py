"""Documents of a corpus from books: header fields, kinds of titles, parents and leaves, chunks over sections, anchors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.matching import scan
from kgloom.operators.rules import any_word, decide

#: Marks of titles, in the order they are tried.
FRONT, CATEGORY, FORMULA = ["凡例", "序", "目录", "附录"], ["门", "部", "类"], ["汤", "散", "丸", "饮", "丹", "膏", "煎"]


def header_book(text: Column, path: Column, file: Column) -> Column:
    """The book from a line '古籍：' or '书名：', else from the first part of a ``classic://`` path, else the file's stem without its number."""
    line = F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^[ \t　]*(?:古籍|书名)[：:][ \t　]*(.+)$", 1)), F.lit(""))
    first = F.nullif(F.regexp_extract(F.coalesce(path, F.lit("")), r"^classic://([^/]+)", 1), F.lit(""))
    stem = F.regexp_replace(F.regexp_extract(F.coalesce(file, F.lit("")), r"([^/]*?)(?:\.[^./]*)?$", 1), r"^[0-9]+\s*[-_－—]\s*", "")
    return F.coalesce(line, first, stem)


def header_chapter(text: Column, path: Column, page: Column) -> Column:
    """The chapter from a line '篇名：', else from the path's second part, else the page in four digits, else ''."""
    line = F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^[ \t　]*篇名[：:][ \t　]*(.+)$", 1)), F.lit(""))
    part = F.nullif(F.regexp_extract(F.coalesce(path, F.lit("")), r"^classic://[^/]+/([^/]+)", 1), F.lit(""))
    return F.coalesce(line, part, F.when(page != 0, F.lpad(page.cast("string"), 4, "0")), F.lit(""))


def title_kind(title: Column) -> Column:
    """front_matter, formula, category, entry (up to four characters), generic, or unknown without a title."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return decide([(t == "", "unknown"), (any_word(t, FRONT), "front_matter"), (F.exists(F.array(*map(F.lit, FORMULA)), lambda s: t.endswith(s)), "formula"), (any_word(t, CATEGORY), "category"), (F.length(t) <= 4, "entry")], "generic")


def outline(sections: DataFrame, book: str = "book_name", title: str = "title", leaves: str = "leaves") -> DataFrame:
    """Of each book its sections, leaves, mean leaves a section, sections by kind, and what sort of book it is."""
    kind = title_kind(F.col(title))
    agg = sections.groupBy(book).agg(F.count("*").alias("sections"), F.sum(leaves).alias("leaves"), *(F.count_if(kind == k).alias(k) for k in ("front_matter", "formula", "category", "entry")), F.avg((F.col(leaves) <= 1).cast("int")).alias("micro"))
    mean = F.col("leaves") / F.col("sections")
    sort = decide([((F.col("sections") >= 800) & (F.col("micro") >= 0.93), "micro_entry_book"), ((F.col("sections") >= 600) & (mean >= 2), "mixed_compendium"), ((F.col("sections") >= 300) & (F.col("micro") >= 0.88), "fine_grained_book"), ((F.col("sections") <= 120) & (mean >= 1.8), "coarse_book")], "default")
    return agg.withColumn("mean_leaves", F.round(mean, 4)).withColumn("archetype", sort).withColumn("micro", F.round("micro", 4))


def formula_titles(lines: DataFrame, key: str, mark: str, look: int = 4, most: int = 12) -> DataFrame:
    """(key, place, title): lines of up to 24 characters that end like a formula, with a line that starts with ``mark`` among the next four.

    ``lines`` are (key, line_no, line); each title counts once, the first ``most`` of a text stay.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    t = F.trim("line")
    follows = F.lit(False)
    for i in range(1, look + 1):
        follows = follows | F.coalesce(F.trim(F.lead("line", i).over(w)).startswith(mark), F.lit(False))
    ok = (F.length(t) <= 24) & ~t.startswith("卷") & ~t.startswith(mark) & F.exists(F.array(*map(F.lit, FORMULA)), lambda s: t.endswith(s))
    found = lines.withColumn("_f", follows).filter(ok & F.col("_f")).groupBy(key, t.alias("title")).agg(F.min("line_no").alias("line_no"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("line_no"))).filter(F.col("place") <= most).select(key, "place", "title")


def paragraph_chunks(paragraphs: Sequence[str], size: int, overlap: int) -> list[str]:
    """Whole paragraphs up to ``size`` characters a chunk; the next begins with the last ones of ``overlap`` characters or more."""
    out: list[str] = []
    held: list[str] = []
    n = 0
    for p in paragraphs:
        if held and n + 1 + len(p) > size:
            out.append("\n".join(held))
            back, kept = 0, []
            for q in reversed(held):
                kept.append(q)
                back += len(q)
                if back >= overlap:
                    break
            held = kept[::-1]
        held.append(p)
        n = sum(map(len, held)) + len(held) - 1
    return [*out, "\n".join(held)] if held else out


def chunk_paragraphs(docs: DataFrame, key: str, text: str, size: int = 1800, overlap: int = 220) -> DataFrame:
    """(key, chunk_no, chunk) of each text by its non-blank lines, text by text. A paragraph beyond ``size`` stays whole; blank and null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, c) for k, t in zip(b[key].tolist(), b[text], strict=True) for i, c in enumerate(paragraph_chunks([x.strip() for x in (t or "").splitlines() if x.strip()], size, overlap), 1)]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "chunk"])

    return docs.select(key, text).mapInPandas(run, f"`{key}` {dict(docs.dtypes)[key]}, chunk_no int, chunk string")


def numbered_sections(docs: DataFrame, book: str, order: str) -> DataFrame:
    """Sections of each book numbered from 1."""
    return docs.withColumn("section_no", F.row_number().over(Window.partitionBy(book).orderBy(order)))


def parents(sections: DataFrame, book: str, title: str, text: str, limit: int = 32_000) -> DataFrame:
    """A parent document a section (book, section_no, title, text): ids, path, and the labelled text of at most 32,000 characters."""
    number = F.lpad(F.col("section_no").cast("string"), 4, "0")
    body = F.concat_ws("\n", F.concat(F.lit("古籍："), F.col(book)), F.concat(F.lit("篇名："), F.coalesce(F.nullif(F.col(title), F.lit("")), F.col(book))), F.coalesce(F.col(text), F.lit("")))
    return sections.select(F.concat(F.lit("classic::"), F.col(book), F.lit("::"), number).alias("chunk_id"), F.lit(2).alias("level"), F.concat(F.lit("classic://"), F.col(book), F.lit("/"), number).alias("path"), F.concat(F.col(book), F.lit("::"), number).alias("section_key"), F.substring(body, 1, limit).alias("text"))


def leaves(sections: DataFrame, book: str, title: str, text: str, size: int = 1800, overlap: int = 220, limit: int = 8_000) -> DataFrame:
    """Leaf documents of each section by ``chunk_paragraphs``, with the id of their parent."""
    number = F.lpad(F.col("section_no").cast("string"), 4, "0")
    parent = F.concat(F.lit("classic::"), F.col(book), F.lit("::"), number)
    known = sections.select(parent.alias("parent"), F.col(book).alias("_b"), number.alias("_n"), F.coalesce(F.nullif(F.col(title), F.lit("")), F.col(book)).alias("_t"), F.col(text).alias("_x"))
    cut = chunk_paragraphs(known, "parent", "_x", size, overlap).join(known.drop("_x"), "parent")
    child = F.lpad(F.col("chunk_no").cast("string"), 2, "0")
    body = F.concat_ws("\n", F.concat(F.lit("古籍："), F.col("_b")), F.concat(F.lit("篇名："), F.col("_t")), F.col("chunk"))
    return cut.select(F.concat("parent", F.lit("::"), child).alias("chunk_id"), "parent", F.lit(3).alias("level"), F.concat(F.lit("classic://"), F.col("_b"), F.lit("/"), F.col("_n"), F.lit("-"), child).alias("path"), F.substring(body, 1, limit).alias("text"))


def body_chunks(sections: DataFrame, book: str, title: str, text: str, size: int = 800, overlap: int = 80) -> DataFrame:
    """(book, chunk_no, start_at, title, chunk): a book's sections as one text, joined by a blank line, cut every ``size`` - ``overlap`` characters.

    No task holds a book: running sums of lengths give each section its place, and a section gives each chunk that
    it reaches its piece. A chunk has the title of the section it shares most with, the first of equals.
    """
    body = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)^\s+|\s+$", ""), r"\n{3,}", "\n\n")
    rows = sections.select(book, "section_no", F.coalesce(F.col(title), F.lit("")).alias("title"), body.alias("body")).filter("body != ''")
    w = Window.partitionBy(book).orderBy("section_no")
    placed = rows.withColumn("end", F.sum(F.length("body") + 2).over(w)).withColumn("start", F.col("end") - F.length("body") - 2)
    last = F.max("end").over(Window.partitionBy(book)) - 2
    placed = placed.withColumn("total", last).withColumn("piece", F.when(F.col("end") - 2 < F.col("total"), F.concat("body", F.lit("\n\n"))).otherwise(F.col("body")))
    step = size - overlap
    reach = F.sequence(F.greatest(F.lit(0), F.floor((F.col("start") - size) / step) + 1).cast("long"), F.floor((F.col("start") + F.length("piece") - 1) / step).cast("long"))
    cut = placed.select(book, "section_no", "title", "start", "piece", "total", F.explode(reach).alias("chunk_no"))
    a, b = F.greatest(F.col("chunk_no") * step, F.col("start")), F.least(F.col("chunk_no") * step + size, F.col("start") + F.length("piece"))
    # a chunk that starts within the overlap before the end adds nothing to the chunk before it
    cut = cut.filter((F.col("chunk_no") == 0) | (F.col("chunk_no") * step + overlap < F.col("total"))).select(book, "chunk_no", "section_no", "title", (b - a).alias("n"), F.expr(f"substring(piece, cast(greatest(chunk_no * {step}, start) - start + 1 as int), cast(least(chunk_no * {step} + {size}, start + length(piece)) - greatest(chunk_no * {step}, start) as int))").alias("part")).filter("n > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_no", "part"))), lambda x: x["part"]), "")
    return cut.groupBy(book, "chunk_no").agg((F.col("chunk_no") * step).alias("start_at"), F.max_by("title", F.struct("n", (-F.col("section_no")).alias("s"))).alias("title"), joined.alias("chunk"))


def anchors(docs: DataFrame, key: str, text: str, width: int = 24) -> DataFrame:
    """(key, at, snippet): the head, the places at 20, 50 and 80 %, and the tail of each text of at least ``width`` characters, without white space."""
    squeezed = docs.select(key, F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+", "").alias("t")).filter(F.length("t") >= width)
    places = {"head": F.lit(1), "p20": F.floor(F.length("t") * 0.2) + 1, "p50": F.floor(F.length("t") * 0.5) + 1, "p80": F.floor(F.length("t") * 0.8) + 1, "tail": F.length("t") - (width - 1)}
    listed = F.array(*(F.struct(F.lit(n).alias("at"), F.substring(F.col("t"), F.least(p, F.length("t") - (width - 1)).cast("int"), F.lit(width)).alias("snippet")) for n, p in places.items()))
    return squeezed.select(key, F.explode(listed).alias("a")).select(key, "a.*")


def anchored(found: DataFrame, chunks: DataFrame, key: str, chunk_key: str, text: str) -> DataFrame:
    """Of each text how many of its anchors stand in some chunk, and in how many chunks, which tasks add up for each snippet."""
    squeezed = chunks.select(chunk_key, F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+", "").alias("t"))
    hits = scan(squeezed, found.select(F.col("snippet").alias("name")), chunk_key, "t", counted=True).withColumnRenamed("name", "snippet")
    return found.join(hits, "snippet", "left").groupBy(key).agg(F.count("n").alias("found"), F.count("*").alias("anchors"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("chunks"))
