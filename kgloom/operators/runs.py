"""Runs, logs, sessions and the lists made of them: replay, recovery, pending batches, log tails, folds, citations and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.rules import decide


def replay(rows: DataFrame, runs: DataFrame, cutoff: Column, key: list[str], include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """ST11, N7: rows of the runs published up to the cutoff, in order of publishing and line, the first row of each key.

    ``rows``: (run, line, key...); ``runs``: (run, published_at). Included runs count whenever they were published,
    excluded ones never; unpublished ones do not.
    """
    wanted = (F.col("published_at") <= cutoff) | (F.col("run").isin(*include) if include else F.lit(False))
    if exclude:
        wanted = wanted & ~F.col("run").isin(*exclude)
    chosen = runs.filter(F.coalesce(wanted, F.lit(False))).select("run", "published_at")
    order = F.struct(F.coalesce("published_at", F.lit("9999-01-01").cast("timestamp")).alias("at"), "run", "line")
    first = rows.join(F.broadcast(chosen), "run").groupBy(*key).agg(F.min(order).alias("first"), F.count("*").alias("deliveries"))
    return first.select(*key, F.col("first.run").alias("run"), F.col("first.line").alias("line"), "deliveries")


def best_attempts(attempts: DataFrame, key: list[str]) -> DataFrame:
    """ST12: of each chunk the attempt (attempt, rows) with the most rows, the first of equals; attempts without rows recover nothing."""
    return attempts.filter(F.size("rows") > 0).groupBy(*key).agg(F.max_by(F.struct("attempt", "rows"), F.struct(F.size("rows").alias("n"), (-F.col("attempt")).alias("a"))).alias("b"), F.count("*").alias("tried")).select(*key, "b.*", "tried")


def pending_batches(leaves: DataFrame, done: DataFrame, key: str, size: int) -> DataFrame:
    """ST14, ST7: leaves without a result, in batches of ``size`` by key."""
    rest = leaves.join(done.select(key).distinct(), key, "left_anti").select(key).distinct()
    bucket = F.substring(F.md5(F.col(key).cast("string")), 1, 2)  # numbered within parts, so that no task numbers all leaves
    place = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    return rest.withColumn("_p", bucket).withColumn("batch", F.concat_ws("-", "_p", F.floor((place - 1) / size).cast("string"))).drop("_p")


def tail(log: DataFrame, since: Column, seq: str = "seq") -> DataFrame:
    """ST15: log lines from a cursor on, each job's own, with the cursor to ask for next."""
    after = Window.partitionBy("job")
    return log.withColumn("next", F.max(seq).over(after) + 1).filter(F.col(seq) >= since)


def folded(events: DataFrame, by: str, order: list[str]) -> DataFrame:
    """ST17, ST6: events (kind, text, name) of a message folded: tokens appended, tools by name with their last result, notes once each, the last route; 'done' fills an empty content."""
    at = F.struct(*order)
    tokens = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "token", F.struct(at.alias("at"), "text")))), lambda x: x["text"]), "")
    tools = F.array_sort(F.collect_set(F.when(F.col("kind").isin("tool_start", "tool_end"), F.col("name"))))
    ended = F.array_sort(F.collect_set(F.when(F.col("kind") == "tool_end", F.col("name"))))
    done = F.max_by(F.when(F.col("kind") == "done", F.col("text")), F.when(F.col("kind") == "done", at))
    out = events.groupBy(by).agg(tokens.alias("content"), F.array_join(tools, "|").alias("tools"), F.array_join(F.array_except(tools, ended), "|").alias("open_tools"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "note", F.col("text")))), "|").alias("notes"), F.max_by(F.when(F.col("kind") == "route", F.col("text")), F.when(F.col("kind") == "route", at)).alias("route"), done.alias("_done"))
    return out.withColumn("content", F.when(F.col("content") == "", F.coalesce("_done", F.lit(""))).otherwise(F.col("content"))).drop("_done")


def compressed(messages: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """ST10: the first n messages of each session archived into one summary line, the others kept in order."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return messages.withColumn("turn", place).withColumn("part", F.when(F.col("turn") <= n, "archived").otherwise("kept"))


def sessions(messages: DataFrame, by: str, at: str) -> DataFrame:
    """Sessions with their messages, the latest first."""
    return messages.groupBy(by).agg(F.count("*").alias("messages"), F.max(at).alias("updated_at"))


def page(rows: DataFrame, order: list[Column], number: int, size: int, most: int = 100) -> DataFrame:
    """A page of a list, from 1; the size is kept within 1 and ``most``."""
    size = max(1, min(most, size))
    return rows.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def preview(cleaned: DataFrame, normalised: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of the cleaned rows, of the normalised ones where nothing was cleaned."""
    return page(normalised if cleaned.isEmpty() else cleaned, order, 1, n)


def run_summary(rows: DataFrame, log: DataFrame, run: str = "run") -> DataFrame:
    """Of each run its rows, distinct facts and last state."""
    counts = rows.groupBy(run).agg(F.count("*").alias("rows"), F.countDistinct("fact").alias("facts"))
    return counts.join(log.groupBy(run).agg(F.max_by("state", "seq").alias("state")), run, "full_outer").select(run, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("state", F.lit("unknown")).alias("state"))


def review_list(candidates: DataFrame, risky: Column) -> DataFrame:
    """Candidates (predicate, n, action): those for review by hand or at risk first, each part by count and predicate."""
    part = F.when((F.col("action") == "manual_review") | risky, 0).otherwise(1)
    return candidates.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "predicate")))


def recommended(books: DataFrame, n: int) -> DataFrame:
    """The n books (book, chars, sections, mentions) of the best score: mentions, sections, and up to 400 KB of text."""
    score = 3.0 * F.log1p("mentions") + F.log1p("sections") + F.least(F.col("chars") / 400_000.0, F.lit(1.0))
    return books.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "book").limit(n)


def ranked_intents(scores: Column, priority: Sequence[str]) -> Column:
    """(intent, score) pairs by score, then by a fixed priority, then by name."""
    places = F.create_map(*[x for i, p in enumerate(priority) for x in (F.lit(p), F.lit(i))])
    keyed = F.transform(scores, lambda s: F.struct((-s["score"]).alias("a"), F.coalesce(places[s["intent"]], F.lit(len(priority))).alias("b"), s["intent"].alias("intent"), s["score"].alias("score")))
    return F.transform(F.array_sort(keyed), lambda x: x["intent"])


#: Schemes of evidence paths in the order in which they are read.
SCHEMES = ("entity", "alias", "chapter", "book", "classic", "qa", "caseqa", "symptom")


def ordered_paths(paths: Column) -> Column:
    """Evidence paths without repeats, by scheme, then in the given order; unknown schemes last."""
    rank = F.create_map(*[x for i, p in enumerate(SCHEMES) for x in (F.lit(p), F.lit(i))])
    keyed = F.transform(F.array_distinct(paths), lambda p, i: F.struct(F.coalesce(rank[F.substring_index(p, "://", 1)], F.lit(len(SCHEMES))).alias("a"), i.alias("b"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda x: x["p"])


def path_matches(path: Column, prefix: Column, only_prefix: bool = False) -> Column:
    """one path is the start of the other, of the same scheme; with ``only_prefix`` only the given one of the path."""
    same = F.substring_index(path, "://", 1) == F.substring_index(prefix, "://", 1)
    forward = path.startswith(prefix)
    return same & (forward if only_prefix else forward | prefix.startswith(path))


def best_path(paths: Column, books: Column) -> Column:
    """of evidence paths the chapter, else the book, of the first preferred book that has one; else the first chapter, book or record."""
    of = lambda scheme, b: F.get(F.filter(paths, lambda p: p.startswith(F.concat(F.lit(scheme), F.lit("://"), b))), F.lit(0))
    preferred = F.filter(F.transform(books, lambda b: F.coalesce(of("chapter", b), of("book", b))), lambda x: x.isNotNull())
    return F.coalesce(F.get(preferred, F.lit(0)), *(of(s, F.lit("")) for s in ("chapter", "book", "qa", "caseqa")))


def readable_chapter(book: Column, chapter: Column) -> Column:
    """A chapter label that names something: not empty, not the book's name, not only a number or a file's part."""
    c = F.trim(F.coalesce(chapter, F.lit("")))
    return (c != "") & (c != F.coalesce(book, F.lit(""))) & ~c.rlike(r"^[0-9_\-]+$") & ~c.rlike(r"^(?:chunk|part|section)[-_0-9]*$")


def chapter_path(book: Column, chapter: Column) -> Column:
    """``chapter://book/chapter`` for a readable chapter, else ``book://book``; null without a book."""
    b = F.nullif(F.trim(F.coalesce(book, F.lit(""))), F.lit(""))
    return F.when(readable_chapter(b, chapter), F.concat(F.lit("chapter://"), b, F.lit("/"), F.trim(chapter))).otherwise(F.concat(F.lit("book://"), b))


def citations(books: Column, facts: Column, cases: Column, limit: int = 6, size: int = 80) -> Column:
    """Citations without repeats: book citations, then source and first characters of facts, then of cases, the first ``limit``."""
    line = lambda items: F.transform(items, lambda x: F.trim(F.concat_ws(" ", x["source"], F.substring(F.coalesce(x["snippet"], F.lit("")), 1, size))))
    return F.slice(F.array_distinct(F.filter(F.concat(books, line(facts), line(cases)), lambda c: c != "")), 1, limit)


def extract(relations: Column, chunks: Column, most: int = 4, few: int = 2, size: int = 120) -> Column:
    """Q17: a summary without a model: the first relations as 'predicate：target', then the first chunks cut short."""
    one = F.transform(F.slice(relations, 1, most), lambda r: F.concat(r["predicate"], F.lit("："), r["target"]))
    two = F.transform(F.slice(chunks, 1, few), lambda c: F.substring(c, 1, size))
    return F.concat_ws("\n", F.array_join(one, "；"), F.array_join(two, "\n"))


def confidence(value: Column, default: float = 0.7) -> Column:
    """A confidence within 0 and 1; what is no number, or missing, counts ``default``."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(value.try_cast("double"), F.lit(default))))


def remaining(done: Column, total: Column, seconds: Column) -> Column:
    """N7, ST4: time left as H:MM:SS at the pace so far; 'unknown' before anything is done."""
    left = F.ceil((total - done) * seconds / done)
    return F.when((done <= 0) | (seconds <= 0), "unknown").otherwise(F.format_string("%d:%02d:%02d", F.floor(left / 3600).cast("int"), F.floor(left % 3600 / 60).cast("int"), (left % 60).cast("int")))


def envelope(results: Column, empty_code: int) -> Column:
    """Q16: the code of a service's answer: 0 with results, else the given one."""
    return F.when(F.coalesce(F.size(results), F.lit(0)) > 0, 0).otherwise(empty_code)


def tuned_k(intent: Column, k: Column, least: dict[str, int]) -> Column:
    """At least so many results for an intent."""
    return F.greatest(k, decide([(intent == i, str(n)) for i, n in least.items()], "0").cast("int"))


def rotation(tasks: DataFrame, order: str, weights: dict[str, int]) -> DataFrame:
    """ST9: tasks given to providers in turn, each as often a round as its weight; a task's number decides, so that no state is kept."""
    seats = [name for name, w in weights.items() for _ in range(w)]
    return tasks.withColumn("provider", F.get(F.array(*map(F.lit, seats)), F.pmod(F.col(order), F.lit(len(seats))).cast("int")))
