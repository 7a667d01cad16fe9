"""Benchmarks built from facts and graded results: capped selection, regrading, task, section and answer scores, run reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.evaluation import coverage, proportional, rouge_l, split_of
from kgloom.operators.governance import clean_name, clean_source
from kgloom.session import cut


def candidate_rows(facts: DataFrame, least: float = 0.9) -> DataFrame:
    """facts fit for questions: clean names of both ends, a clean source text that mentions the object, confidence of at least ``least``."""
    text = F.coalesce("best_source_text", F.lit(""))
    ok = clean_name(F.col("subject")) & clean_name(F.col("object")) & (F.col("subject") != F.col("object")) & (F.col("source_book") != "")
    return facts.filter(ok & (F.coalesce("best_confidence", F.lit(0.0)) >= least) & clean_source(text) & text.contains(F.col("object")))


def question_groups(rows: DataFrame) -> DataFrame:
    """Groups of a subject and predicate in a chapter with their objects, split and rank: most objects, then rows, book, subject, chapter, predicate."""
    g = rows.groupBy("subject", "predicate", "source_book", "source_chapter").agg(F.countDistinct("object").alias("objects"), F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("object")), 1, 5), "|").alias("answers"))
    return g.withColumn("rank_key", F.struct((-F.col("objects")).alias("a"), (-F.col("n")).alias("b"), "source_book", "subject", "source_chapter", "predicate")).withColumn("split", split_of(F.col("subject")))


def capped(rows: DataFrame, order: str, caps: Mapping[str, int]) -> DataFrame:
    """Rows taken in order unless a column's value is used up: no value of ``c`` more than ``caps[c]`` times. Adds ``taken``.

    Caps act on each other, so that rows are decided in rounds: one is refused once a value is used up by taken rows before
    it, and taken once all undecided rows before it could not use one up. Every round decides at least the first
    undecided row, most decide nearly all. ``order`` must be total; rows with null values have those values, too. The
    rows of one value are passed in order by one task, which keeps sums only.
    """
    state = cut(rows.withColumn("taken", F.lit(None).cast("boolean")))
    while True:
        refuse, take = F.lit(False), F.lit(True)
        for c, most in caps.items():
            before = Window.partitionBy(c).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
            used = F.coalesce(F.sum(F.coalesce(F.col("taken"), F.lit(False)).cast("int")).over(before), F.lit(0))
            open_ = F.coalesce(F.sum(F.col("taken").isNull().cast("int")).over(before), F.lit(0))
            refuse, take = refuse | (used >= most), take & (used + open_ < most)
        now = F.when(F.col("taken").isNotNull(), F.col("taken")).when(refuse, False).when(take, True)
        state = cut(state.withColumn("taken", now))
        if state.filter("taken is null").isEmpty():
            return state


def case_pairs(groups: DataFrame, key: str) -> DataFrame:
    """Two cases of each group: what are the answers, and where does it stand."""
    answer = F.struct(F.lit("answer").alias("family"), F.concat("subject", F.lit("的"), "predicate", F.lit("有哪些？")).alias("question"), F.col("answers").alias("expected"))
    source = F.struct(F.lit("source").alias("family"), F.concat("subject", F.lit("的"), "predicate", F.lit("见于何书何篇？")).alias("question"), F.concat_ws("/", "source_book", "source_chapter").alias("expected"))
    return groups.select(key, F.explode(F.array(answer, source)).alias("c")).select(key, "c.*")


def regraded(hits: DataFrame, cases: DataFrame, k: int = 3, qkey: str = "qid") -> DataFrame:
    """(qid, top1 and topk hits of subject, answer and book, success) from hits (qid, place, text, book) and cases (qid, family, subject, answers, books).

    Source questions succeed by the subject alone, others by subject and answer within the first, or first k, hits.
    Cases without hits fail.
    """
    met = cases.join(hits.filter(F.col("place") <= k), qkey, "left")
    held = {"subject": F.col("text").contains(F.col("subject")), "answer": F.exists("answers", lambda a: F.col("text").contains(a)), "book": F.exists("books", lambda b: F.col("book").contains(b))}
    agg = [F.coalesce(F.max(F.when((F.col("place") == 1) if top == "top1" else F.lit(True), v)), F.lit(False)).alias(f"{top}_{n}") for top in ("top1", "topk") for n, v in held.items()]
    out = met.groupBy(qkey, "family").agg(*agg)
    for top in ("top1", "topk"):
        out = out.withColumn(f"{top}_success", F.col(f"{top}_subject") & ((F.col("family") == "source") | F.col(f"{top}_answer")))
    return out


def confusion(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """E5: counts of expected and actual routes with each expected route's share of right ones."""
    counts = rows.groupBy(expected, actual).agg(F.count("*").alias("n"))
    total = Window.partitionBy(expected)
    right = F.sum(F.when(F.col(expected).eqNullSafe(F.col(actual)), F.col("n")).otherwise(0)).over(total)
    return counts.withColumn("accuracy", F.round(right / F.sum("n").over(total), 6))


def task_scores(submitted: DataFrame, gold: DataFrame, key: str = "case", weights: Sequence[float] = (0.2, 0.3, 0.4, 0.1)) -> DataFrame:
    """Per case the weighted sum of three proportional set scores (a, b, c) and the overlap of texts (d).

    The first submission (by seq) of a case counts; empty parts score 0; cases without gold are left out.
    """
    first = submitted.groupBy(key).agg(F.min_by(F.struct("a", "b", "c", "d"), "seq").alias("s"))
    both = first.join(gold.select(key, F.struct("a", "b", "c", "d").alias("g")), key)
    filled = lambda x, v: F.when(x, v).otherwise(0.0)
    parts = [filled(F.size(f"s.{p}") > 0, proportional(F.col(f"s.{p}"), F.col(f"g.{p}"))) for p in ("a", "b", "c")]
    parts.append(filled(F.coalesce(F.col("s.d"), F.lit("")) != "", rouge_l(F.col("s.d"), F.col("g.d"))))
    total = sum((w * p for w, p in zip(weights, parts, strict=True)), F.lit(0.0))
    return both.select(key, *(F.round(p, 6).alias(f"score_{n}") for p, n in zip(parts, "abcd", strict=True)), F.round(total, 6).alias("score"))


def section_scores(hits: DataFrame, cases: DataFrame, qkey: str = "qid") -> DataFrame:
    """Per case 1.5 for the book first and 1 within three, 1 for a section first and .5 within three, .75 and .5 for up to four keywords of the first and of the best of three.

    ``hits``: (qid, place, book, text, is_section); ``cases``: (qid, book, keywords). Cases without hits score 0.
    """
    met = cases.select(qkey, F.col("book").alias("wanted"), "keywords").join(hits.filter("place <= 3"), qkey, "left")
    n = F.size(F.filter("keywords", lambda w: F.coalesce(F.col("text"), F.lit("")).contains(w)))
    one = F.col("place") == 1
    most = lambda c, cond=None: F.coalesce(F.max(F.when(cond, c) if cond is not None else c).cast("int"), F.lit(0))
    right = (F.col("book") == F.col("wanted")).cast("int")
    agg = met.groupBy(qkey).agg(most(right, one).alias("book_1"), most(right).alias("book_3"), most(F.col("is_section").cast("int"), one).alias("section_1"), most(F.col("is_section").cast("int")).alias("section_3"), most(n, one).alias("words_1"), most(n).alias("words_3"))
    total = 1.5 * F.col("book_1") + F.col("book_3") + F.col("section_1") + 0.5 * F.col("section_3") + 0.75 * F.least("words_1", F.lit(4)) + 0.5 * F.least("words_3", F.lit(4))
    return agg.withColumn("score", F.round(total.cast("double"), 2))


def answer_score(answer: Column, books: Column, citations: Column, expected_books: Column, expected_words: Column, fallback: Column) -> Column:
    """2 from 300 characters or 1 from 120, 1.5 for an expected book among those named or cited, .75 for each of up to four expected words, less .5 for a fallback."""
    n = F.length(F.trim(F.coalesce(answer, F.lit(""))))
    named = F.array_union(books, F.transform(citations, lambda c: F.substring_index(c, "/", 1)))
    words = F.size(F.filter(expected_words, lambda w: F.coalesce(answer, F.lit("")).contains(w)))
    total = F.when(n >= 300, 2.0).when(n >= 120, 1.0).otherwise(0.0) + F.when(F.arrays_overlap(named, expected_books), 1.5).otherwise(0.0) + 0.75 * F.least(words, F.lit(4))
    return F.round(total - F.when(fallback, 0.5).otherwise(0.0), 2)


def path_quality(paths: DataFrame, cases: DataFrame, qkey: str = "qid") -> DataFrame:
    """Whether any expected node is on any path of a case; without expectation, whether there is a path at all."""
    nodes = paths.groupBy(qkey).agg(F.flatten(F.collect_set(F.split("path", "->"))).alias("nodes"))
    met = cases.join(nodes, qkey, "left")
    ok = F.when(F.size("expected") == 0, F.col("nodes").isNotNull()).otherwise(F.coalesce(F.arrays_overlap("nodes", "expected"), F.lit(False)))
    return met.select(qkey, ok.alias("ok"))


def condition_summary(rows: DataFrame, by: str, ok: Column, ms: str, backend: Column, notes: Column) -> DataFrame:
    """Of each condition its cases, passed ones, mean latency, and the share that fell back, by the word in backend or notes."""
    fell = F.lower(F.concat_ws(" ", backend, notes)).contains("fallback")
    return rows.groupBy(by).agg(F.count("*").alias("cases"), F.count_if(ok).alias("passed"), F.round(F.avg(ms), 4).alias("mean_ms"), F.round(F.avg(fell.cast("int")), 6).alias("fallback_rate"))


def category_summary(rows: DataFrame, by: list[str], ok: Column) -> DataFrame:
    """Of each combination of categories, and of each left out and of all, its cases and the share passed."""
    return rows.cube(*by).agg(F.count("*").alias("cases"), F.count_if(ok).alias("passed"), F.round(F.avg(F.coalesce(ok, F.lit(False)).cast("int")), 4).alias("rate"), F.grouping_id().alias("level"))


def rerun_jobs(report: DataFrame, prefixes: Sequence[str], limit: int, order: str) -> DataFrame:
    """The first failed cases whose issue begins with any of the prefixes."""
    issue = F.coalesce("issue", F.lit(""))
    return report.filter(~F.col("ok") & F.exists(F.array(*map(F.lit, prefixes)), lambda p: issue.startswith(p))).orderBy(order).limit(limit)


def merged_reports(runs: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Of several runs of a case and mode the last one, with how many there were."""
    rest = [c for c in runs.columns if c not in (*key, seq)]
    return runs.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("r"), F.count("*").alias("runs")).select(*key, "r.*", "runs")


def open_slots(plan: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Planned slots without a result that is ok and not empty."""
    return plan.join(done.filter(F.col("ok") & (F.trim(F.coalesce("answer", F.lit(""))) != "")), key, "left_anti")


def probe_summary(rows: DataFrame, by: str, ms: str) -> DataFrame:
    """Ok answers of each mode and their mean latency, a missing one counting 0."""
    return rows.groupBy(by).agg(F.count_if("ok").alias("ok"), F.round(F.avg(F.coalesce(F.col(ms), F.lit(0.0))), 4).alias("mean_ms"))


def frozen(rows: DataFrame, key: list[str], fields: Sequence[str], text: str, size: int = 80) -> DataFrame:
    """A run as one comparable line a question and mode: the fields, the answer's length, digest and first characters."""
    t = F.coalesce(F.col(text), F.lit(""))
    return rows.select(*key, *fields, F.length(t).alias("answer_len"), F.md5(t).alias("digest"), F.substring(t, 1, size).alias("start"))


def chunk_outcome(n: Column, error: Column, least: int = 1) -> Column:
    """What an attempt at a chunk came to: the error, 'low_yield' below ``least`` rows, or 'ok'."""
    return F.when(F.coalesce(error, F.lit("")) != "", error).when(F.coalesce(n, F.lit(0)) < least, "low_yield").otherwise("ok")


def keypoint_f1(text: Column, expected: Column, said: Column) -> Column:
    """F1 of expected keypoints found in a text and said ones that are expected; 0 without any."""
    recall, precision = F.coalesce(coverage(text, expected), F.lit(0.0)), F.coalesce(F.try_divide(F.size(F.array_intersect(said, expected)), F.size(said)), F.lit(0.0))
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
