"""Paths between questions' names: candidates, hydrated edges with their sources, and the small graph that evidence makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.tokens import chapter_label
from kgloom.operators.graph import both_ways, shortest_paths


def name_candidates(queries: DataFrame, names: DataFrame, pairs: DataFrame, most: int = 3) -> DataFrame:
    """(qid, name, place) of each queried text: the name itself if it is known, else its known aliases by support, at most ``most``."""
    exact = queries.join(names.select("name"), queries["text"] == names["name"]).select("qid", "name", F.lit(0).alias("tier"), F.lit(0).cast("long").alias("support"))
    alias = queries.join(both_ways(pairs), queries["text"] == F.col("name")).join(names.select(F.col("name").alias("other")), "other").select("qid", F.col("other").alias("name"), F.lit(1).alias("tier"), "support")
    every = exact.unionByName(alias).withColumn("_m", F.min("tier").over(Window.partitionBy("qid"))).filter("tier = _m")
    return every.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("support"), "name"))).filter(F.col("place") <= most).select("qid", "name", "place")


def path_query(ends: DataFrame, names: DataFrame, aliases: DataFrame, near: DataFrame, limit: int = 5, most: int = 3) -> DataFrame:
    """(qid, place, hops, path, score): the best paths between candidates of both ends of each (qid, start, finish).

    Up to three candidates an end make up to nine pairs a query, all searched at once; the fewest hops win. Texts
    that are no known name and no alias of one have no path.
    """
    one, two = (name_candidates(ends.select("qid", F.col(c).alias("text")), names, aliases, most).select("qid", F.col("name").alias(c)) for c in ("start", "finish"))
    tried = one.join(two, "qid").select(F.struct("qid", "start", "finish").alias("qid"), "start", "finish")
    found = shortest_paths(tried, near, limit).select(F.col("qid.qid").alias("qid"), "hops", "path", "score")
    best = found.withColumn("_m", F.min("hops").over(Window.partitionBy("qid"))).filter("hops = _m").drop("_m").distinct()
    return best.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "path"))).filter(F.col("place") <= limit)


def hydrated(paths: DataFrame, facts: DataFrame, types: DataFrame, keys: list[str], sign: str = "->") -> DataFrame:
    """Paths as names read with their edges: types of nodes, predicates, and the distinct sources.

    The edge of two neighbours is that with the best confidence as it stands, else the best of the other direction,
    marked '(逆向)'. Paths without an edge between some neighbours are left out.
    """
    nodes = paths.select(*keys, F.split("path", sign).alias("nodes"))
    hops = nodes.select(*keys, F.posexplode(F.expr("transform(sequence(1, size(nodes) - 1), i -> struct(nodes[i - 1] as a, nodes[i] as b))")).alias("i", "p")).select(*keys, "i", "p.*")
    best = facts.groupBy(F.col("subject").alias("a"), F.col("object").alias("b")).agg(F.max_by(F.struct("predicate", "source_book", chapter_label(F.col("source_book"), F.col("source_chapter")).alias("chapter")), F.struct(F.coalesce("best_confidence", F.lit(-1.0)).alias("c"), (-F.col("row_id")).alias("r"))).alias("edge"))
    back = best.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("edge").alias("back"))
    met = hops.join(best, ["a", "b"], "left").join(back, ["a", "b"], "left").filter("edge is not null or back is not null")
    edge = F.coalesce("edge", "back")
    named = met.select(*keys, "i", F.concat(edge["predicate"], F.when(F.col("edge").isNull(), "(逆向)").otherwise("")).alias("predicate"), F.concat_ws("/", edge["source_book"], edge["chapter"]).alias("source"))
    listed = F.array_sort(F.collect_list(F.struct("i", "predicate", "source")))
    edges = named.groupBy(*keys).agg(listed.alias("e"))
    kinds = nodes.select(*keys, F.posexplode("nodes").alias("i", "name")).join(types, "name", "left").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("entity_type", F.lit("entity")).alias("t")))), lambda x: x["t"]), "|").alias("types"))
    out = nodes.join(edges, keys).filter(F.size("e") == F.size("nodes") - 1).join(kinds, keys)
    return out.select(*keys, F.array_join("nodes", "|").alias("nodes"), "types", F.array_join(F.transform("e", lambda x: x["predicate"]), "|").alias("edges"), F.array_join(F.array_distinct(F.transform("e", lambda x: x["source"])), "|").alias("sources"))


def evidence_graph(edges: DataFrame, by: str, seq: str, most_nodes: int = 36, most_edges: int = 60) -> tuple[DataFrame, DataFrame]:
    """The small graph of each group of (source, target, predicate, evidence): its nodes and its edges, both with the totals before the caps.

    Nodes gather the evidence of their edges; of equal edges the last counts, a missing predicate is '相关'. Nodes
    come by evidence, edges in order of first appearance.
    """
    e = edges.filter("source != '' and target != ''").withColumn("predicate", F.when(F.coalesce("predicate", F.lit("")) == "", "相关").otherwise(F.col("predicate")))
    ends = e.select(by, F.explode(F.array("source", "target")).alias("node"), "evidence").groupBy(by, "node").agg(F.sum("evidence").alias("evidence"))
    total = Window.partitionBy(by)
    nodes = ends.withColumn("nodes", F.count("*").over(total)).withColumn("place", F.row_number().over(total.orderBy(F.desc("evidence"), "node"))).filter(F.col("place") <= most_nodes)
    one = e.groupBy(by, "source", "target", "predicate").agg(F.min(seq).alias("first"), F.max_by("evidence", seq).alias("evidence"))
    kept = one.withColumn("edges", F.count("*").over(total)).withColumn("place", F.row_number().over(total.orderBy("first"))).filter(F.col("place") <= most_edges)
    return nodes, kept


def labelled_nodes(nodes: DataFrame, by: str, center: Column, few: int = 34, many: int = 76) -> DataFrame:
    """Nodes (node, evidence, sources, degree) that get a label: by evidence + 2 sources + 1.5 degree, 1000 more for the center.

    A third of a graph's nodes is labelled, but at least ``few`` and at most ``many``.
    """
    value = F.col("evidence") + 2 * F.col("sources") + 1.5 * F.col("degree") + F.when(center, 1000.0).otherwise(0.0)
    w = Window.partitionBy(by)
    sized = nodes.withColumn("label_score", F.round(value, 4)).withColumn("_k", F.least(F.lit(many), F.greatest(F.lit(few), (F.count("*").over(w) / 3).cast("int"))))
    return sized.withColumn("place", F.row_number().over(w.orderBy(F.desc("label_score"), "node"))).filter(F.col("place") <= F.col("_k")).drop("_k")


#: What a relation loses for the tier of its types.
TIER_COSTS = {"polysemy": 6, "review_needed": 18, "likely_dirty": 30}


def full_score(query: Column, parts: Column, hinted: Column, priority: Column) -> Column:
    """The whole relation score of a row with predicate, normalized, family, target, best_text, source_book, source_chapter, book_count, evidence_count, direction and tier.

    50 for a hinted predicate, 20, 18 and 16 for predicate, normalised name and family in the query, 10 for the target in
    it and 18 for the target as a part of it, 5 for a part in the text, 160 for the book, 10 for the chapter, ten
    times the priority, capped support, 1 for an outgoing relation, less the tier's cost.
    """
    has = lambda c, w: F.when((F.coalesce(F.col(c), F.lit("")) != "") & query.contains(F.col(c)), F.lit(w)).otherwise(0)
    total = F.when(hinted, 50).otherwise(0) + has("predicate", 20) + has("normalized", 18) + has("family", 16) + has("target", 10) + has("source_book", 160) + has("source_chapter", 10)
    total += F.when(F.array_contains(parts, F.col("target")), 18).otherwise(0)
    total += F.when(F.exists(parts, lambda p: F.coalesce(F.col("best_text"), F.lit("")).contains(p)), 5).otherwise(0)
    total += F.bround(priority * 10).cast("int") + F.least(F.col("book_count"), F.lit(5)) + F.least(F.floor(F.log1p("evidence_count") * 4), F.lit(8))
    total += F.when(F.col("direction") == "out", 1).otherwise(0)
    for name, cost in TIER_COSTS.items():
        total -= F.when(F.col("tier") == name, cost).otherwise(0)
    return total.cast("int")
