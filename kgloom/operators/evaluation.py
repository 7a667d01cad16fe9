"""Retrieval metrics, significance and score reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.operators.records import dense_numbers


def ir_metrics(hits: DataFrame, relevant: DataFrame, queries: DataFrame, k: int, *, qkey: str = "qid", key: str = "doc_id") -> DataFrame:
    """Of each query hit@1, hit@k, reciprocal rank and NDCG over its first k hits.

    The ideal order of NDCG is that of the returned relevances, so that a single hit at the top scores 1
    however many relevant documents are missing (survey B16). Queries without hits score 0.
    """
    marked = hits.filter(F.col("place") <= k).join(relevant.select(qkey, key).distinct().withColumn("rel", F.lit(1)), [qkey, key], "left").na.fill(0, ["rel"])
    gain = F.col("rel") / F.log2(F.col("place") + 1.0)
    per = marked.groupBy(qkey).agg(F.max(F.when(F.col("place") == 1, F.col("rel"))).alias("hit_1"), F.max("rel").alias("hit_k"), F.max(F.when(F.col("rel") == 1, 1.0 / F.col("place"))).alias("rr"), F.sum(gain).alias("dcg"), F.sum("rel").alias("n"))
    ideal = F.expr("aggregate(sequence(1, greatest(cast(n as int), 1)), 0D, (s, i) -> s + 1 / log2(i + 1.0D))")
    scored = per.select(qkey, "hit_1", "hit_k", F.coalesce("rr", F.lit(0.0)).alias("rr"), F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))
    full = queries.select(qkey).join(scored, qkey, "left")
    return full.select(qkey, F.coalesce("hit_1", F.lit(0)).alias("hit_1"), F.coalesce("hit_k", F.lit(0)).alias("hit_k"), F.round(F.coalesce("rr", F.lit(0.0)), 6).alias("rr"), F.round(F.coalesce("ndcg", F.lit(0.0)), 6).alias("ndcg"))


def ablations(conditions: dict[str, DataFrame], relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Of each named condition, a list of hits, the means of the metrics over all queries."""
    out: DataFrame | None = None
    for name, hits in conditions.items():
        m = ir_metrics(hits, relevant, queries, k).agg(F.count("*").alias("cases"), *(F.round(F.avg(c), 6).alias(c) for c in ("hit_1", "hit_k", "rr", "ndcg"))).withColumn("condition", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def sign_test(wins: Column, losses: Column) -> Column:
    """M5: two-sided exact sign test; 1 without any difference.

    The sum of binomial terms is kept as the logarithm of the last term and the ratio of the sum to it, so that no
    number of cases makes it vanish.
    """
    n, k = wins + losses, F.least(wins, losses)
    ratio = lambda i: (n - i + 1) / i
    step = lambda acc, i: F.struct((acc["log"] + F.log(ratio(i))).alias("log"), (acc["rest"] / ratio(i) + 1.0).alias("rest"))
    first = F.struct((n * F.log(F.lit(0.5))).alias("log"), F.lit(1.0).alias("rest"))
    total = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), first, step, lambda a: F.exp(a["log"] + F.log(a["rest"])))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * total))


def paired(left: DataFrame, right: DataFrame, metrics: list[str], key: str = "qid") -> DataFrame:
    """Of each metric means, delta, wins, losses, ties and the sign test over common cases."""
    joined = left.select(key, *(F.col(m).alias(f"l_{m}") for m in metrics)).join(right.select(key, *(F.col(m).alias(f"r_{m}") for m in metrics)), key)
    rows = joined.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"l_{m}").cast("double").alias("l"), F.col(f"r_{m}").cast("double").alias("r")) for m in metrics))).alias("x")).select("x.*")
    agg = rows.groupBy("metric").agg(F.count("*").alias("cases"), F.avg("l").alias("left_mean"), F.avg("r").alias("right_mean"), F.count_if(F.col("l") > F.col("r")).alias("wins"), F.count_if(F.col("l") < F.col("r")).alias("losses"), F.count_if(F.col("l") == F.col("r")).alias("ties"))
    return agg.select("metric", "cases", F.round("left_mean", 6).alias("left_mean"), F.round("right_mean", 6).alias("right_mean"), F.round(F.col("left_mean") - F.col("right_mean"), 6).alias("delta"), "wins", "losses", "ties", F.round(sign_test(F.col("wins"), F.col("losses")), 6).alias("p_value"))


def bootstrap(diffs: DataFrame, by: str, value: str, draws: int = 5000, seed: int = 20240419) -> DataFrame:
    """M4: confidence interval of the mean of each group: sorted means at floor(.025 B) - 1 and floor(.975 B), 6 digits.

    One Python call a group; resampling goes over the distinct values with their counts, so that a group costs
    its distinct values, which are counted in Spark first, and not its rows.
    """
    counts = diffs.groupBy(by, value).agg(F.count("*").alias("n"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(value, kind="stable")
        n = int(rows["n"].sum())
        share = rows["n"].to_numpy() / n
        means = np.sort(np.random.default_rng(seed).multinomial(n, share, size=draws) @ rows[value].to_numpy(float) / n)
        low, high = means[max(0, int(0.025 * draws) - 1)], means[min(draws - 1, int(0.975 * draws))]
        return pd.DataFrame({by: [rows[by].iloc[0]], "mean": [round(float(rows[value].to_numpy(float) @ share), 6)], "low": [round(float(low), 6)], "high": [round(float(high), 6)]})

    return counts.groupBy(by).applyInPandas(run, f"`{by}` {dict(diffs.dtypes)[by]}, mean double, low double, high double")


def latency(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, median and p95 by interpolation, and p95 by nearest rank."""
    x = F.col(value)
    return rows.groupBy(*by).agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.percentile(x, 0.5), 6).alias("p50"), F.round(F.percentile(x, 0.95), 6).alias("p95"), F.round(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{value}`)"), 6).alias("p95_rank"))


def set_prf(predicted: DataFrame, gold: DataFrame, key: list[str], by: str) -> DataFrame:
    """Precision, recall and F1 of distinct keys in each group; an empty side scores 0."""
    p, g = predicted.select(by, *key).distinct().withColumn("_p", F.lit(1)), gold.select(by, *key).distinct().withColumn("_g", F.lit(1))
    both = p.join(g, [by, *key], "full_outer").groupBy(by).agg(F.count("_p").alias("predicted"), F.count("_g").alias("gold"), F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("hits"))
    precision, recall = F.coalesce(F.try_divide(F.col("hits"), F.col("predicted")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("hits"), F.col("gold")), F.lit(0.0))
    return both.withColumn("precision", F.round(precision, 6)).withColumn("recall", F.round(recall, 6)).withColumn("f1", F.round(F.try_divide(2.0 * F.col("hits"), F.col("predicted") + F.col("gold")), 6))


def composite(rows: DataFrame, key: str, weights: dict[str, float], lower: tuple[str, ...] = ()) -> DataFrame:
    """Weighted sum of ratios to the best of each measure; for ``lower`` ones the best is the smallest. Missing counts 0."""
    best = rows.agg(*(F.min(c).alias(f"b_{c}") if c in lower else F.max(c).alias(f"b_{c}") for c in weights))
    wide = rows.crossJoin(F.broadcast(best))  # one row
    parts = [F.coalesce(F.try_divide(F.col(f"b_{c}"), F.col(c)) if c in lower else F.try_divide(F.col(c), F.col(f"b_{c}")), F.lit(0.0)) * w for c, w in weights.items()]
    scored = wide.select(key, *weights, F.round(sum(parts, F.lit(0.0)), 6).alias("score"))
    return scored.withColumn("place", F.rank().over(Window.orderBy(F.desc("score"))))


def proportional(answers: Column, correct: Column, most: float = 1.0) -> Column:
    """Most * |answers and correct| / (|correct| + |answers without correct|), 0 for an empty denominator."""
    below = F.size(F.array_distinct(correct)) + F.size(F.array_except(answers, correct))
    return F.coalesce(F.try_divide(F.lit(most) * F.size(F.array_intersect(answers, correct)), below), F.lit(0.0))


def coverage(text: Column, expected: Column) -> Column:
    """Share of expected words that the text holds; null without any."""
    return F.when(F.size(expected) > 0, F.size(F.filter(expected, lambda w: text.contains(w))) / F.size(expected))


def split_of(subject: Column) -> Column:
    """Benchmark split by hash: int(sha1[:12], 16) % 10; 0 is debug, 1 and 2 dev, the rest test."""
    n = F.conv(F.substring(F.sha1(subject), 1, 12), 16, 10).cast("long") % 10
    return F.when(n == 0, "debug").when(n <= 2, "dev").otherwise("test")


def candidate_groups(facts: DataFrame, least: int = 2) -> DataFrame:
    """(subject, predicate) with several objects: counts, split, and the three smallest acceptable answers."""
    g = facts.groupBy("subject", "predicate").agg(F.countDistinct("object").alias("objects"), F.count("*").alias("rows"), F.countDistinct("source_book").alias("books"))
    few = facts.select("subject", "predicate", "object").distinct().withColumn("k", F.row_number().over(Window.partitionBy("subject", "predicate").orderBy("object"))).filter("k <= 3")
    lists = few.groupBy("subject", "predicate").agg(F.array_join(F.array_sort(F.collect_list("object")), "|").alias("answers"))
    return g.filter(F.col("objects") >= least).join(lists, ["subject", "predicate"]).withColumn("split", split_of(F.col("subject")))


def split_report(cases: DataFrame) -> DataFrame:
    """Cases a split, with the subjects that leak into other splits."""
    leaks = cases.groupBy("subject").agg(F.countDistinct("split").alias("s")).filter("s > 1").select("subject", F.lit(1).alias("leak"))
    return cases.join(leaks, "subject", "left").groupBy("split").agg(F.count("*").alias("cases"), F.countDistinct("subject").alias("subjects"), F.count("leak").alias("leaked"))


def distractors(cases: DataFrame, pool: DataFrame, n: int, ring: int, key: str = "case") -> DataFrame:
    """For each case n pool items that are no answer of it.

    The pool is put on a ring of numbered places in hash order. A case starts at the place its own hash gives
    and looks at ``ring`` items, which must be at least n plus its answers; so no product with the pool is formed.
    """
    places = dense_numbers(pool.select("item").distinct().withColumn("h", F.md5("item")), ["h", "item"]).drop("h")
    size = places.count()
    start = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 12), 16, 10).cast("long"), F.lit(max(1, size)))
    seats = cases.select(key, "answers", F.explode(F.sequence(F.lit(0), F.lit(ring - 1))).alias("i")).withColumn("place", ((start + F.col("i")) % max(1, size)))
    met = seats.join(places, "place").filter(~F.array_contains("answers", F.col("item")))
    order = Window.partitionBy(key).orderBy("i")
    return met.withColumn("option", F.row_number().over(order)).filter(F.col("option") <= n).select(key, "option", "item")


@F.pandas_udf(T.IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x or "", y or "") for x, y in zip(a, b, strict=True)])


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row, full = 0, (1 << len(a)) - 1
    for c in b:
        x = row | where.get(c, 0)
        row = x & ~((x - ((row << 1) | 1)) & full)
        row &= full
    return row.bit_count()


def rouge_l(a: Column, b: Column) -> Column:
    """F1 of the longest common subsequence; 0 where either side is empty."""
    n = F.length(F.coalesce(a, F.lit(""))) + F.length(F.coalesce(b, F.lit("")))
    return F.coalesce(F.try_divide(2.0 * _lcs(a, b), n), F.lit(0.0))
