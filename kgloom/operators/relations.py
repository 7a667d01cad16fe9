"""Relations of an entity: projection, clustering, fusion, neighbours, diversification."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def symmetric(facts: DataFrame) -> DataFrame:
    """Every fact seen from both ends: anchor, target, direction, target_type. A loop is seen once."""
    view = lambda a, b, d: F.struct(F.col(a).alias("anchor"), F.col(b).alias("target"), F.lit(d).alias("direction"), F.col(f"{a}_type").alias("anchor_type"), F.col(f"{b}_type").alias("target_type"))
    both = F.array(view("subject", "object", "out"), view("object", "subject", "in"))
    rest = [c for c in facts.columns if c not in ("subject", "object", "subject_type", "object_type")]
    out = facts.select(*rest, F.explode(both).alias("e")).select(*rest, "e.*")
    out = out.filter("anchor != '' and target != '' and not (anchor = target and direction = 'in')")
    return out.withColumn("target_type", F.when(F.col("target_type") == "", "other").otherwise(F.col("target_type")))


def relations_of(edges: DataFrame, entities: DataFrame, limit: int = 1000) -> DataFrame:
    """Up to ``limit`` relations a direction of each queried entity (qid, anchor), best confidence first."""
    joined = edges.join(entities, "anchor")
    order = Window.partitionBy("qid", "direction").orderBy(F.desc_nulls_last("best_confidence"), "row_id")
    return joined.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def clusters(relations: DataFrame, by: tuple[str, ...] = ("anchor",)) -> DataFrame:
    """Relations grouped by predicate, target and direction.

    evidence_count, avg (4 digits) and max confidence over non-null ones, distinct books and chapters, the
    five smallest books, and the representative text: highest confidence, then longest, then first.
    """
    keys = [*by, "predicate", "target", "direction"]
    text = F.coalesce("best_source_text", F.lit(""))
    rank = F.struct(F.coalesce("best_confidence", F.lit(-1.0)).alias("c"), F.length(text).alias("n"), (-F.col("row_id")).alias("r"))
    return relations.groupBy(*keys).agg(
        F.count("*").alias("evidence_count"),
        F.bround(F.avg("best_confidence"), 4).alias("avg_confidence"),
        F.max("best_confidence").alias("max_confidence"),
        F.countDistinct("source_book").alias("book_count"),
        F.countDistinct("source_book", "source_chapter").alias("chapter_count"),
        F.array_join(F.slice(F.array_sort(F.collect_set("source_book")), 1, 5), "|").alias("books"),
        F.max_by(text, rank).alias("best_text"),
        F.max_by("target_type", rank).alias("target_type"),
    )


def fuse(df: DataFrame, by: list[str], orders: dict[str, list[Column]], k: int = 20) -> DataFrame:
    """Reciprocal rank fusion of several orderings within each group, divided by the group's best.

    Orderings must be total. Adds rank_<name> and fusion (6 digits).
    """
    out = df.withColumns({f"rank_{n}": F.row_number().over(Window.partitionBy(*by).orderBy(*o)) for n, o in orders.items()})
    total = sum((1.0 / (F.lit(float(k)) + F.col(f"rank_{n}")) for n in orders), F.lit(0.0))
    out = out.withColumn("_sum", total)
    return out.withColumn("fusion", F.round(F.col("_sum") / F.max("_sum").over(Window.partitionBy(*by)), 6)).drop("_sum")


def cluster_orders() -> dict[str, list[Column]]:
    """The four orderings of relation clusters: support, confidence, spread over books, and length of the text."""
    tie = [F.col("predicate"), F.col("target"), F.col("direction")]
    return {
        "support": [F.desc("evidence_count"), *tie],
        "confidence": [F.desc_nulls_last("max_confidence"), F.desc_nulls_last("avg_confidence"), *tie],
        "spread": [F.desc("book_count"), F.desc("chapter_count"), *tie],
        "text": [F.desc(F.length("best_text")), *tie],
    }


def entity_lookup(edges: DataFrame, entities: DataFrame, top_k: int = 12) -> DataFrame:
    """Relations of each queried entity, clustered, fused, and the best ``top_k`` of each."""
    ranked = fuse(clusters(relations_of(edges, entities), ("qid", "anchor")), ["qid"], cluster_orders())
    order = Window.partitionBy("qid").orderBy(F.desc("fusion"), "predicate", "target", "direction")
    return ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top_k)


def best_neighbours(edges: DataFrame, priority: dict[str, int], fanout: int | None = 24) -> DataFrame:
    """The best edge to each neighbour of every node, then at most ``fanout`` neighbours a node.

    Order: predicate priority, confidence, direction, predicate, target. Predicates without a priority come last.
    """
    rank = F.coalesce(F.create_map(*[F.lit(x) for p in priority.items() for x in p])[F.col("predicate")], F.lit(999)) if priority else F.lit(999)
    order = [F.col("priority"), F.desc_nulls_last("best_confidence"), F.col("direction"), F.col("predicate"), F.col("row_id")]
    one = edges.withColumn("priority", rank).withColumn("_n", F.row_number().over(Window.partitionBy("anchor", "target").orderBy(*order))).filter("_n = 1").drop("_n")
    if fanout is None:
        return one
    near = Window.partitionBy("anchor").orderBy(F.col("priority"), F.desc_nulls_last("best_confidence"), F.col("target"))
    return one.withColumn("place", F.row_number().over(near)).filter(F.col("place") <= fanout)


def score(relations: DataFrame, query: Column, books: float = 80.0, text: float = 5.0, target: float = 18.0, predicate: float = 20.0) -> DataFrame:
    """Additive relation score: mentions of predicate, target, text and book in the query, capped support, confidence."""
    has = lambda c, w: F.when((F.col(c) != "") & query.contains(F.col(c)), F.lit(w)).otherwise(0.0)
    total = has("predicate", predicate) + has("target", target) + has("source_book", books) + F.when(F.col("best_text").contains(F.col("target")), text).otherwise(0.0)
    return relations.withColumn("score", F.round(total + F.least(F.col("evidence_count"), F.lit(5)) * 2.0 + F.coalesce("max_confidence", F.lit(0.0)), 6))


def diversify(ranked: DataFrame, by: str = "qid", top_k: int = 8, pull: float = 0.42) -> DataFrame:
    """Greedy selection a query: score plus novelty of predicate, direction and target type, damped by what is chosen.

    Order-dependent, so one Python call a query; a query has at most the ranked clusters of its entity.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes) + ", pick int"

    def select(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["fusion", "predicate", "target", "direction"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        seen: dict[str, dict[str, int]] = {"predicate": {}, "direction": {}, "target_type": {}}
        left, out = list(range(len(rows))), []
        while left and len(out) < top_k:
            def value(i: int) -> float:
                r = rows.loc[i]
                new = sum(w / (1 + seen[c].get(r[c], 0)) for c, w in (("predicate", 0.7), ("direction", 0.15), ("target_type", 0.15)))
                return (1 - pull) * float(r["fusion"]) + pull * new

            best = max(left, key=lambda i: (value(i), -i))
            left.remove(best)
            out.append(best)
            for c in seen:
                seen[c][rows.loc[best, c]] = seen[c].get(rows.loc[best, c], 0) + 1
        return rows.loc[out].assign(pick=range(1, len(out) + 1))

    return ranked.groupBy(by).applyInPandas(select, schema)
