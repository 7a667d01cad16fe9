"""Rule tables over facts: names and types, predicate families, hints, rewrites, deletions and their reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.tokens import chapter_label
from kgloom.operators.matching import scan
from kgloom.operators.rules import decide, tier, top_examples

MOST_RULES = 10_000


def mapped(c: Column, names: Mapping[str, str]) -> Column:
    """A value by a map of fixed values, itself where the map lacks it."""
    return F.coalesce(F.create_map(*[F.lit(x) for p in names.items() for x in p])[c], c) if names else c


def inferred_type(value: Column, raw: Column, *, allowed: Sequence[str], books: Sequence[str], properties: Sequence[str], processing: Sequence[str], suffixes: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """The raw type if it is allowed, else by the lists of books and properties, words of processing, and endings in order; null reads as ''."""
    value, raw = F.coalesce(value, F.lit("")), F.coalesce(raw, F.lit(""))
    rules = [(value.isin(*books), "book"), (value.isin(*properties), "property")]
    rules += [(value.contains(w), "processing_method") for w in processing] + [(value.endswith(s), t) for s, t in suffixes]
    return F.when(raw.isin(*allowed), raw).otherwise(decide(rules, default))


def families(rules: DataFrame) -> DataFrame:
    """(predicate, normalized, family, symmetric) of a rule table (predicate, normalized, family, parent, symmetric).

    A rule without a family has that of its parent, however far up; a cycle gives none. The table is checked to be
    small, and chains are followed on the driver.
    """
    rows = rules.select("predicate", "normalized", "family", "parent", "symmetric").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    known = {r.predicate: r for r in rows}

    def family(name: str) -> str | None:
        seen: set[str] = set()
        while name in known and name not in seen:
            seen.add(name)
            if known[name].family is not None:
                return known[name].family
            name = known[name].parent
        return None

    out = [(r.predicate, r.normalized or r.predicate, family(r.predicate), bool(r.symmetric)) for r in rows]
    return rules.sparkSession.createDataFrame(out, "predicate string, normalized string, family string, symmetric boolean")


def members(known: DataFrame) -> DataFrame:
    """(token, predicate): predicates that a token stands for: itself, its normalised name, or its family."""
    token = F.explode(F.array_distinct(F.filter(F.array("predicate", "normalized", "family"), lambda x: x.isNotNull())))
    return known.select("predicate", token.alias("token")).distinct()


def permitted(rows: DataFrame, known: DataFrame, allow: Sequence[str] = (), block: Sequence[str] = ()) -> DataFrame:
    """rows whose predicate is on the expanded allow list, if there is one, and not on the expanded block list. '@' in front is dropped."""
    expanded = members(known)
    named = lambda tokens: expanded.filter(F.col("token").isin([t.lstrip("@") for t in tokens])).select("predicate").union(rows.sparkSession.createDataFrame([(t.lstrip("@"),) for t in tokens], "predicate string")).distinct()
    out = rows.join(F.broadcast(named(allow)), "predicate", "left_semi") if allow else rows
    return out.join(F.broadcast(named(block)), "predicate", "left_anti") if block else out


def hinted(queries: DataFrame, known: DataFrame, key: str = "qid", text: str = "text") -> DataFrame:
    """(key, predicate): predicates whose tokens stand in a query, with all that the tokens stand for."""
    expanded = members(known).filter(F.length("token") >= 2)
    return scan(queries, expanded.select(F.col("token").alias("name")), key, text).join(expanded, F.col("name") == F.col("token")).select(key, "predicate").distinct()


def annotated(rows: DataFrame, known: DataFrame, tiers: DataFrame) -> DataFrame:
    """rows with normalised predicate, family, chapter label and tier; predicates without a rule keep their name and have no family."""
    with_rules = rows.join(F.broadcast(known), "predicate", "left").withColumn("normalized", F.coalesce("normalized", "predicate"))
    return tier(with_rules, tiers).withColumn("chapter", chapter_label(F.col("source_book"), F.col("source_chapter")))


def governed(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with the action of the first rule that fits, and what it sets.

    ``rules``: (ord, predicate, subject_type, object_type, object, same, action, new_predicate, new_subject_type,
    new_object_type); a null field fits all, ``same`` asks for predicate and object to be equal. Actions are 'delete',
    'rewrite' and, without a rule, 'keep'. The former predicate stays as ``was_predicate``. Rules are checked to be
    few and broadcast; distinct combinations are decided and joined back.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    by = ["predicate", "subject_type", "object_type", "object"]
    r = F.broadcast(rules.select(*(F.col(c).alias(f"r_{c}") for c in by), "ord", "same", "action", "new_predicate", "new_subject_type", "new_object_type"))
    fits = (~F.coalesce("same", F.lit(False))) | (F.col("predicate") == F.col("object"))
    for c in by:
        fits = fits & (F.col(f"r_{c}").isNull() | (F.col(f"r_{c}") == F.col(c)))
    chosen = rows.select(*by).distinct().join(r, fits).groupBy(*by).agg(F.min_by(F.struct("action", "new_predicate", "new_subject_type", "new_object_type"), "ord").alias("rule"))
    out = rows.join(chosen, by, "left").withColumn("was_predicate", F.col("predicate")).withColumn("action", F.coalesce("rule.action", F.lit("keep")))
    for c in ("predicate", "subject_type", "object_type"):
        out = out.withColumn(c, F.coalesce(F.col(f"rule.new_{c}"), F.col(c)))
    return out.drop("rule")


def dropped_evidence(marked: DataFrame, evidence: DataFrame) -> DataFrame:
    """evidence whose fact ids belong to deleted rows only; an id that a kept row has, too, stays."""
    ids = lambda rows: rows.select(F.explode("ids").alias("fact_id")).distinct()
    gone = ids(marked.filter("action = 'delete'")).join(ids(marked.filter("action != 'delete'")), "fact_id", "left_anti")
    return evidence.join(gone, "fact_id", "left_semi")


def patch_plan(marked: DataFrame) -> DataFrame:
    """Of each action and former predicate the rows, the predicates proposed, and the first three rows."""
    few = top_examples(marked, ["action", "was_predicate"], [F.col("row_id")], 3).groupBy("action", "was_predicate").agg(F.array_join(F.array_sort(F.collect_list("row_id")), "|").alias("rows"))
    counts = marked.groupBy("action", "was_predicate").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("predicate")), "|").alias("proposed"))
    return counts.join(few, ["action", "was_predicate"])


def dirty_export(rows: DataFrame, targets: DataFrame, books: int = 12, examples: int = 30) -> DataFrame:
    """Of each target (predicate, subject_type, object_type) its rows, its most frequent books with counts, and its first rows by confidence."""
    by = ["predicate", "subject_type", "object_type"]
    hit = rows.join(F.broadcast(targets.select(*by).distinct()), by)
    total = hit.groupBy(*by).agg(F.count("*").alias("n"))
    top = top_examples(hit.groupBy(*by, "source_book").agg(F.count("*").alias("m")), by, [F.desc("m"), F.col("source_book")], books)
    listed = top.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", F.concat_ws(":", "source_book", "m").alias("t")))), lambda x: x["t"]), "|").alias("books"))
    shown = top_examples(hit, by, [F.desc_nulls_last("best_confidence"), F.col("row_id")], examples).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "row_id"))), lambda x: x["row_id"].cast("string")), "|").alias("rows"))
    return total.join(listed, by).join(shown, by)


def disputes(rows: DataFrame, n: int = 5) -> DataFrame:
    """A10: of each predicate its rows, those whose object only repeats it, its most frequent objects, and how many type pairs it joins."""
    objects = top_examples(rows.groupBy("predicate", "object").agg(F.count("*").alias("m")), ["predicate"], [F.desc("m"), F.col("object")], n)
    listed = objects.groupBy("predicate").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "object"))), lambda x: x["object"]), "|").alias("objects"))
    pairs = F.countDistinct("subject_type", "object_type")
    return rows.groupBy("predicate").agg(F.count("*").alias("n"), F.count_if(F.col("object") == F.col("predicate")).alias("repeating"), pairs.alias("type_pairs")).join(listed, "predicate")


def clean_name(c: Column, *, least: int = 2, most: int = 24, share: float = 0.45) -> Column:
    """a name of 2 to 24 characters, enough of them ideographs, without marks of a sentence and without a number only."""
    text = F.trim(F.coalesce(c, F.lit("")))
    han = F.length(F.regexp_replace(text, "[^一-鿿]", ""))
    return F.length(text).between(least, most) & (han >= share * F.length(text)) & ~text.rlike(r"[\[\]{}<>|\\/，。；：！？\n\t]") & ~text.endswith("方论")


def clean_source(c: Column, *, least: int = 10, most: int = 160, share: float = 0.5) -> Column:
    """a source text of 10 to 160 characters, at least half of them ideographs, without markup."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.length(text).between(least, most) & (F.length(F.regexp_replace(text, "[^一-鿿]", "")) >= share * F.length(text)) & ~text.rlike(r"[\[\]{}<>|\\]")


def front_matter(text: Column, words: Sequence[str], head: int = 1200) -> Column:
    """any of the words stands in the head of a text, which then may have no facts."""
    part = F.substring(F.coalesce(text, F.lit("")), 1, head)
    return F.exists(F.array(*map(F.lit, words)), lambda w: part.contains(w)) if words else F.lit(False)


def accepted_empty(title: Column, text: Column, formula_endings: Sequence[str], words: Sequence[str]) -> Column:
    """a chunk without facts is fine if its title is no formula's and its head is front matter."""
    named = F.coalesce(title, F.lit(""))
    return ~F.exists(F.array(*map(F.lit, formula_endings)), lambda e: named.endswith(e)) & front_matter(text, words)


def wanted_title(title: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """a title that holds any of the included words, if there are any, and none of the excluded ones."""
    t = F.coalesce(title, F.lit(""))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: t.contains(w))
    return (has(include) if include else F.lit(True)) & (~has(exclude) if exclude else F.lit(True))


def under_paths(path: Column, prefixes: Sequence[str]) -> Column:
    """a path that starts with any of the prefixes; without prefixes, any path."""
    p = F.coalesce(path, F.lit(""))
    return F.exists(F.array(*map(F.lit, prefixes)), lambda x: p.startswith(x)) if prefixes else F.lit(True)


def selected_books(books: DataFrame, selectors: Sequence[str]) -> DataFrame:
    """F32: books (ordinal, book_name) by selectors in order: digits are an ordinal from 1, anything else a part of the name; none selects all."""
    if not selectors:
        return books.withColumn("selector", F.lit(0))
    tokens = [(i, t.strip()) for i, t in enumerate(selectors, 1) if t.strip()]
    hit = [F.when((F.col("ordinal") == int(t)) if t.isdigit() else F.col("book_name").contains(t), F.lit(i)) for i, t in tokens]
    return books.withColumn("selector", F.array_min(F.array(*hit))).filter("selector is not null")


def yield_diagnosis(blocks: DataFrame, low: int = 2) -> DataFrame:
    """Of each chunk (chunk, block, n) its JSON blocks, triples of the first and of all, and what went wrong, if anything."""
    per = blocks.groupBy("chunk").agg(F.count("block").alias("blocks"), F.coalesce(F.min_by("n", "block"), F.lit(0)).alias("first"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))
    return per.withColumn("diagnosis", decide([(F.col("blocks") == 0, "no_json"), (F.col("total") > F.col("first"), "first_block_only"), (F.col("total") >= low, "fine")], "low_yield"))
