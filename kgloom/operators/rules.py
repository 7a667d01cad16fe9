"""Ordered decision lists and rule tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decide(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """The label of the first rule whose condition is true; null conditions are false."""
    if not rules:
        return F.lit(default)
    out = F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    for condition, label in rules[1:]:
        out = out.when(F.coalesce(condition, F.lit(False)), label)
    return out.otherwise(F.lit(default))


def any_word(text: Column, words: Sequence[str]) -> Column:
    """The text holds any of the words."""
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: text.contains(w)) if words else F.lit(False)


def hit_count(text: Column, words: Sequence[str]) -> Column:
    """how many of the words the text holds."""
    return F.size(F.filter(F.array(*(F.lit(w) for w in words)), lambda w: text.contains(w))) if words else F.lit(0)


def first_substring_rule(value: Column, exact: dict[str, str], substrings: Sequence[tuple[str, str]]) -> Column:
    """Exact value, else the first rule in order whose key the value contains, else the value."""
    names = F.create_map(*[F.lit(x) for p in exact.items() for x in p])[value] if exact else F.lit(None)
    return F.coalesce(names, decide([(value.contains(k), v) for k, v in substrings]), value)


def tier(rows: DataFrame, rules: DataFrame, *, default: str = "review_needed") -> DataFrame:
    """F8: tier of each row by the first matching rule (ord, predicate, subject_type, object_type, tier); a null rule field matches all.

    The rule table is broadcast; it is checked to hold at most 10,000 rules. Distinct combinations are decided, then joined back.
    """
    if rules.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 tier rules")
    by = ["predicate", "subject_type", "object_type"]
    combos = rows.select(*by).distinct()
    r = F.broadcast(rules.select(*(F.col(c).alias(f"r_{c}") for c in by), "ord", "tier"))
    match = [(F.col(f"r_{c}").isNull() | (F.col(f"r_{c}") == F.col(c))) for c in by]
    found = combos.join(r, match[0] & match[1] & match[2], "left").groupBy(*by).agg(F.min_by("tier", "ord").alias("tier")).withColumn("tier", F.coalesce("tier", F.lit(default)))
    return rows.join(found, by)


def closure(seeds: Sequence[str], members: dict[str, Sequence[str]]) -> list[str]:
    """seeds with all they lead to through families, names and parents; a leading '@' is dropped. Sorted."""
    seen: set[str] = set()
    todo = [s.lstrip("@") for s in seeds]
    while todo:
        x = todo.pop()
        if x and x not in seen:
            seen.add(x)
            todo.extend(m.lstrip("@") for m in members.get(x, ()))
    return sorted(seen)


def top_examples(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The n first rows of each group as ``example``."""
    return rows.withColumn("example", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("example") <= n)


def diverse_sample(rows: DataFrame, by: list[str], spread: str, order: list[Column], n: int) -> DataFrame:
    """The best row of each ``spread`` value within a group, then the n best of those."""
    one = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by, spread).orderBy(*order))).filter("_k = 1").drop("_k")
    return one.withColumn("sample", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("sample") <= n)


def profile(rows: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """Of each group its size and its n most frequent values with counts, one pass over all groups."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("group_size", F.sum("n").over(Window.partitionBy(by)))
    return top_examples(ranked, [by], [F.desc("n"), F.col(value)], n)
