"""Evidence items of all sources in one schema, their coverage, routing and source resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.text import norm
from kgloom.functions.tokens import snippet
from kgloom.operators.matching import contents, scan
from kgloom.operators.rules import any_word, decide


def items(source_type: str, rows: DataFrame, source: Column, text: Column, score: Column, limit: int = 300) -> DataFrame:
    """(source_type, source, snippet, score); rows without text are dropped, snippets cut."""
    return rows.select(F.lit(source_type).alias("source_type"), F.coalesce(source, F.lit("")).alias("source"), snippet(text, limit).alias("snippet"), F.coalesce(score, F.lit(0.0)).alias("score")).filter("snippet != ''")


def merge_items(parts: list[DataFrame]) -> DataFrame:
    """One item for each (source_type, source, snippet), with its best score and how often it came."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("source_type", "source", "snippet").agg(F.max("score").alias("score"), F.count("*").alias("times"))


def coverage(merged: DataFrame, by: str = "source_type") -> DataFrame:
    """Of each kind of evidence its items, sources, best score, and the gaps that are left."""
    agg = merged.groupBy(by).agg(F.count("*").alias("items"), F.countDistinct("source").alias("sources"), F.max("score").alias("best"), F.count_if(F.length("snippet") >= 20).alias("long_items"))
    gaps = F.filter(F.array(F.when(F.col("sources") < 5, "few_sources"), F.when(F.col("best") < 0.9, "weak"), F.when(F.col("long_items") == 0, "short")), lambda g: g.isNotNull())
    return agg.withColumn("gaps", F.array_join(gaps, "|"))


def flags(question: Column, words: dict[str, list[str]]) -> dict[str, Column]:
    """A boolean for each group of words."""
    return {name: any_word(question, w) for name, w in words.items()}


def route(question: Column, words: dict[str, list[str]]) -> Column:
    """Q1, Q4: where a question goes, by its flags: graph for relations, text for sources, both for comparisons."""
    f = flags(question, words)
    return decide([(f["source"], "text"), (f["compare"], "both"), (f["relation"], "graph")], "text")


def squeezed(c: Column | str) -> Column:
    """A text without white space; null is ''."""
    return F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"(?U)\s+", "")


def resolve_sources(rows: DataFrame, docs: DataFrame, key: str, length: int = 18, least: int = 8) -> DataFrame:
    """For rows (key, book, chapter, text) the document that holds the start of the text, as (key, tier, doc_id).

    The start is the first ``length`` characters without white space, or all of them if there are ``least``; shorter
    texts resolve nothing. The document's book must hold the row's. Tier 0: its chapter holds the row's, too; tier 1:
    whatever the chapter. Of the best tier the smallest doc_id stays. Starts meet documents in one scan, and are
    counted once for each book and chapter, so that a common start costs no pairs of rows and documents.
    """
    start = rows.select(key, "book", F.coalesce("chapter", F.lit("")).alias("chapter"), F.substring(squeezed("text"), 1, length).alias("start")).filter((F.length("start") >= least) & (F.col("book") != ""))
    found = scan(docs.select("doc_id", squeezed("text").alias("t")), start.select(F.col("start").alias("name")), "doc_id", "t").join(docs.select("doc_id", "book_name", F.coalesce("chapter_title", F.lit("")).alias("title")), "doc_id")
    held = found.groupBy(F.col("name").alias("start"), "book_name", "title").agg(F.min("doc_id").alias("doc_id"))
    met = start.join(held, "start").filter(F.col("book_name").contains(F.col("book")))
    tier = F.when((F.col("chapter") != "") & F.col("title").contains(F.col("chapter")), 0).otherwise(1)
    return met.groupBy(key).agg(F.min(F.struct(tier.alias("tier"), "doc_id")).alias("m")).select(key, "m.*")


#: Lengths of the starts that are tried, the longest first.
PROBE_LENGTHS = (220, 180, 140, 100, 80, 60, 40)


def unique_sections(rows: DataFrame, sections: DataFrame, key: str, lengths: tuple[int, ...] = PROBE_LENGTHS, least: int = 18) -> DataFrame:
    """For rows (key, book, text) the one section (book, title, text) of the book that holds the text's start.

    Starts of the given lengths are tried, the longest first; one counts if the sections that hold it have one title.
    Texts are compared without white space first (how 'strict'), then by content characters only ('loose'). Rows
    of fewer than ``least`` characters, or without such a start, give no row.
    """
    tries = []
    for order, (how, form) in enumerate((("strict", squeezed), ("loose", contents))):
        whole = rows.select(key, "book", form("text").alias("whole")).filter(F.length("whole") >= least)
        probe = F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.substring(F.col("whole"), F.lit(1), n))))
        probes = whole.select(key, "book", probe.alias("probe"))
        held = scan(sections.filter("title != ''").select(F.struct("book", "title").alias("place"), form("text").alias("t")), probes.select(F.col("probe").alias("name")), "place", "t")
        titles = held.groupBy(F.col("place.book").alias("book"), F.col("name").alias("probe")).agg(F.countDistinct("place.title").alias("n"), F.min("place.title").alias("title")).filter("n = 1")
        tries.append(probes.join(titles, ["book", "probe"]).select(key, F.struct(F.lit(-order).alias("order"), F.length("probe").alias("n_chars"), F.lit(how).alias("how"), "title").alias("m")))
    return tries[0].unionByName(tries[1]).groupBy(key).agg(F.max("m").alias("m")).select(key, "m.title", "m.how", "m.n_chars")


def book_listing(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Books in order of their name with tasks, size in KB, a processed flag, and the place among the unprocessed."""
    per = tasks.groupBy("book_name").agg(F.count("*").alias("tasks"), F.bround(F.sum(F.octet_length(F.coalesce("text_chunk", F.lit("")))) / 1024.0, 1).alias("kb"))
    flag = per.join(done.select("book_name").distinct().withColumn("_d", F.lit(1)), "book_name", "left").withColumn("processed", F.col("_d").isNotNull()).drop("_d")
    order = Window.orderBy("book_name")  # one row a book
    return flag.withColumn("ordinal", F.row_number().over(order)).withColumn("todo", F.when(~F.col("processed"), F.sum((~F.col("processed")).cast("int")).over(order)))


def numbered_ids(rows: DataFrame, by: str, order: str, prefix: str) -> DataFrame:
    """Ids prefix:group:0000001 by a counter in each group."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("emitted_id", F.concat_ws(":", F.lit(prefix), norm(by), F.lpad(n.cast("string"), 7, "0")))
