"""Joins of reference tables, labelled texts, option lists and small reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bridge(links: list[tuple[DataFrame, str, str]], start: str, end: str) -> DataFrame:
    """Distinct (start, end) pairs along a chain of many-to-many tables (table, left column, right column).

    Every step keeps distinct pairs only, so that a hub costs the pairs it makes and not the paths. Null keys join nothing.
    """
    table, left, right = links[0]
    out = table.select(F.col(left).alias(start), F.col(right).alias("_k")).na.drop().distinct()
    for table, left, right in links[1:]:
        step = table.select(F.col(left).alias("_k"), F.col(right).alias("_n")).na.drop().distinct()
        out = out.join(step, "_k").select(start, F.col("_n").alias("_k")).distinct()
    return out.withColumnRenamed("_k", end)


def labelled_text(labels: dict[str, str]) -> Column:
    """One line a column, the label always there even if the value is empty."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{label}："), F.coalesce(F.col(c).cast("string"), F.lit(""))) for label, c in labels.items()))


def options(text: Column) -> Column:
    """E18, X37: 'A:text；B:text' of either width as a map from letter to text; parts without a letter are dropped, the first of equal letters stays."""
    parts = F.transform(F.split(F.translate(F.coalesce(text, F.lit("")), "；：", ";:"), ";"), lambda p: F.trim(p))
    ok = F.filter(parts, lambda p: p.rlike("^[A-Za-z]:"))
    pairs = F.transform(ok, lambda p: F.struct(F.upper(F.substring(p, 1, 1)).alias("k"), F.trim(F.regexp_replace(p, "^.:", "")).alias("v")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(first)


def answer_texts(letters: Column, choices: Column) -> Column:
    """Texts of answer letters, unknown letters left out."""
    listed = F.filter(F.split(F.upper(F.coalesce(letters, F.lit(""))), ""), lambda x: x.rlike("^[A-Z]$"))
    return F.filter(F.transform(listed, lambda x: F.try_element_at(choices, x)), lambda x: x.isNotNull())


def expectation(found: Column, expected: Column) -> Column:
    """Share of expected values that are found, two digits, at most 1; 1 without any expectation and any find, else 0."""
    n = F.size(expected)
    return F.when(n == 0, F.when(F.size(found) > 0, 1.0).otherwise(0.0)).otherwise(F.round(F.least(F.size(F.array_intersect(found, expected)), n) / n, 2))


def backend_report(rows: DataFrame, by: list[str], ok: Column, ms: str, score: str) -> DataFrame:
    """Cases, ok ones, mean latency over the ok ones, mean score over all."""
    return rows.groupBy(*by).agg(F.count("*").alias("cases"), F.count_if(ok).alias("ok_cases"), F.round(F.avg(F.when(ok, F.col(ms))), 6).alias("mean_ms"), F.round(F.avg(score), 6).alias("mean_score"))


def attempts(tried: Column, good: Column, bad: Column) -> Column:
    """Attempts where they are counted, else successes and failures."""
    return F.sum(F.when(tried > 0, tried).otherwise(good + bad))


def match_rates(rows: DataFrame, by: str, before: str, after: str, gold: str) -> DataFrame:
    """Share of rows whose list equals the expected one, before and after a step, and whose list did not grow."""
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return rows.groupBy(by).agg(rate(F.col(before) == F.col(gold)).alias("before_rate"), rate(F.col(after) == F.col(gold)).alias("after_rate"), rate(F.size(after) <= F.size(before)).alias("reduced_rate"))


def resolve_spans(found: DataFrame, key: str = "qid") -> DataFrame:
    """Q2: of overlapping mentions (key, name, at) the longest stays, then the earliest. One Python call a text."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        order = sorted(zip(-rows["name"].str.len(), rows["at"], rows["name"], strict=True))
        kept: list[tuple[int, int, str]] = []
        for size, at, name in order:
            if all(at >= b or at - size <= a for a, b, _ in kept):
                kept.append((at, at - size, name))
        kept.sort()
        return pd.DataFrame({key: [rows[key].iloc[0]] * len(kept), "at": [a for a, *_ in kept], "name": [n for *_, n in kept]})

    types = dict(found.dtypes)
    return found.select(key, "at", "name").groupBy(key).applyInPandas(choose, f"`{key}` {types[key]}, `at` int, name string")
