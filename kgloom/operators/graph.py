"""Traversals over the fact graph and the alias graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.text import norm
from kgloom.operators.matching import scan
from kgloom.session import cut


def alias_edges(aliases: DataFrame, least: int = 2, most: int = 24) -> DataFrame:
    """Unordered alias pairs (a < b) of names of 2 to 24 characters with their support, the number of rows."""
    a, b = norm("entity"), norm("alias")
    ok = lambda c: F.length(c).between(least, most)
    return aliases.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter((F.col("a") != F.col("b")) & ok("a") & ok("b")).groupBy("a", "b").agg(F.count("*").alias("support"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """(name, other, ...) of unordered pairs (a, b, ...)."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    ends = F.array(F.struct(F.col("a").alias("name"), F.col("b").alias("other")), F.struct(F.col("b").alias("name"), F.col("a").alias("other")))
    return pairs.select(*rest, F.explode(ends).alias("e")).select("e.*", *rest)


def components(pairs: DataFrame) -> DataFrame:
    """(name, head) of every name in pairs (a, b); head is the smallest name of the component.

    Alternates large-star and small-star steps, which take O(log^2 n) rounds and never gather a component in one
    place: a step is a minimum per node and a join. Each round is cut; the loop ends only when the edges stay the same.
    """
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("name"), F.col("v").alias("head"))
    mark = None
    while True:
        sides = edges.select("u", "v").union(edges.select("v", "u"))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = sides.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("u").alias("name"), F.col("v").alias("head"))
    return stars.union(edges.select(F.col("v").alias("name"), F.col("v").alias("head")).distinct())


def component_summary(groups: DataFrame, top: int = 10) -> DataFrame:
    """Sizes of the largest components with the numbers of names and components in all."""
    sizes = groups.groupBy("head").agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("names"), F.count("*").alias("components"))
    return sizes.orderBy(F.desc("size"), "head").limit(top).crossJoin(total)  # total is one row


def alias_closure(queries: DataFrame, pairs: DataFrame, max_depth: int = 2, max_aliases: int = 8) -> DataFrame:
    """Aliases of each queried name (qid, name) within ``max_depth`` steps, best first.

    depth is the shortest one, support the largest of any step into the alias. Only queried names are expanded,
    so that a hub costs its own degree a query that reaches it.
    """
    steps = both_ways(pairs)
    reached = queries.select("qid", F.col("name").alias("start"), "name", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("support"))
    front, every = reached, reached
    for depth in range(1, max_depth + 1):
        front = front.join(steps.select("name", "other", F.col("support").alias("s")), "name").filter("other != start").groupBy("qid", "start", F.col("other").alias("name")).agg(F.max("s").alias("support")).withColumn("depth", F.lit(depth))
        every = every.unionByName(front)
    found = every.filter("depth > 0").groupBy("qid", "start", F.col("name").alias("alias")).agg(F.min("depth").alias("depth"), F.max("support").alias("support"))
    order = Window.partitionBy("qid").orderBy("depth", F.desc("support"), F.desc(F.length("alias")), "alias")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_aliases)


def expand_queries(queries: DataFrame, closure: DataFrame) -> DataFrame:
    """The query text followed by the aliases of its entity."""
    added = closure.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "alias"))), lambda x: x["alias"]).alias("aliases"))
    return queries.join(added, "qid", "left").withColumn("expanded", F.concat_ws(" ", "name", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "))).withColumn("expanded", F.trim("expanded")).drop("aliases")


def mentions(texts: DataFrame, names: DataFrame, key: str = "qid", text: str = "text") -> DataFrame:
    """Distinct (key, name, at) of known names inside texts; at is the first place, from 1.

    Null and empty texts mention nothing; of texts with one key each name's first place in any of them counts.
    """
    return scan(texts, names, key, text).groupBy(key, "name").agg(F.min("at").alias("at"))


def resolve(texts: DataFrame, names: DataFrame, key: str = "qid", text: str = "text", limit: int = 5) -> DataFrame:
    """Best names for each text by match score: exact, containment and its share, start, end, length, gap."""
    found = mentions(texts, names, key, text).join(texts.select(key, F.col(text).alias("t")), key)
    n, m = F.length("name"), F.length("t")
    gap = m - n
    score = (
        F.when(F.col("t") == F.col("name"), 100.0).otherwise(0.0)
        + F.lit(60.0)
        + 20.0 * n / m
        + F.when(F.col("at") == 1, 8.0).otherwise(0.0)
        + F.when(F.col("t").endswith(F.col("name")), 6.0).otherwise(0.0)
        + 0.4 * F.least(n, F.lit(24))
        - 2.0 * F.log1p(gap)
    )
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.desc(n), "name")
    return found.withColumn("score", F.round(score, 6)).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select(key, "place", "name", "at", "score")


def shortest_paths(pairs: DataFrame, near: DataFrame, limit: int = 5) -> DataFrame:
    """Shortest paths of up to three hops for each (qid, start, finish).

    ``near`` are the governed, fanout-capped steps (anchor, target, source_book), of which a path may use any.
    Levels are joined one by one, the third by meeting the steps into the finish; queries that met have their
    shortest paths and leave before the next level grows. Paths have no cycle. Score: 1 / hops + 0.05 for each of
    up to three source books.
    """
    step = cut(near.select("anchor", "target", F.col("source_book").alias("book")))  # read five times
    last = pairs.join(step, pairs["finish"] == step["target"]).select("qid", F.col("anchor").alias("node"), F.col("book").alias("last_book"))
    level = pairs.filter("start != finish").select("qid", "start", "finish", F.col("start").alias("node"), F.array("start").alias("nodes"), F.array().cast("array<string>").alias("books"))
    found: DataFrame | None = None
    for depth in range(3):
        met = level.join(last, ["qid", "node"]).select("qid", F.concat("nodes", F.array("finish")).alias("nodes"), F.concat("books", F.array("last_book")).alias("books"))
        found = met if found is None else found.unionByName(met)
        if depth == 2:
            break
        level = level.join(met.select("qid").distinct(), "qid", "left_anti")
        grown = level.join(step, F.col("node") == F.col("anchor")).filter((F.col("target") != F.col("finish")) & ~F.array_contains("nodes", F.col("target")))
        level = grown.select("qid", "start", "finish", F.col("target").alias("node"), F.concat("nodes", F.array("target")).alias("nodes"), F.concat("books", F.array("book")).alias("books"))
    hops = F.size("nodes") - 1
    best = found.withColumn("hops", hops).withColumn("_m", F.min("hops").over(Window.partitionBy("qid"))).filter("hops = _m")
    scored = best.select("qid", "hops", F.array_join("nodes", "->").alias("path"), F.round(1.0 / F.col("hops") + 0.05 * F.least(F.size(F.array_distinct("books")), F.lit(3)), 4).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "path")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def bridges(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Names next to both ends of each (qid, start, finish), the ends left out."""
    one = links.select(F.col("name").alias("start"), F.col("other").alias("via"))
    two = links.select(F.col("name").alias("finish"), F.col("other").alias("via"))
    met = pairs.join(one, "start").join(two, ["finish", "via"]).filter("via != start and via != finish")
    return met.select("qid", "via").distinct()


def chain(facts: DataFrame, first: str, second: tuple[str, ...], top_k: int = 5, formulas: int = 6) -> DataFrame:
    """Symptom to syndrome to formula, for all symptoms at once.

    A syndrome has the symptom by predicate ``first`` and its formulas by any of ``second``. Score .92 for a
    symptom-typed object, else .82; the best of equal pairs stays. Formula lists are cut per syndrome before the join.
    """
    pairs = facts.filter(F.col("predicate") == first).groupBy(F.col("object").alias("symptom"), F.col("subject").alias("syndrome")).agg(F.max(F.when(F.col("object_type") == "symptom", 0.92).otherwise(0.82)).alias("score"), F.max(F.coalesce("best_confidence", F.lit(0.0))).alias("confidence"))
    given = facts.filter(F.col("predicate").isin(*second)).select(F.col("subject").alias("syndrome"), F.col("object").alias("formula")).distinct()
    numbered = given.withColumn("k", F.row_number().over(Window.partitionBy("syndrome").orderBy("formula"))).filter(F.col("k") <= formulas)
    lists = numbered.groupBy("syndrome").agg(F.array_join(F.array_sort(F.collect_list("formula")), "|").alias("formulas"))
    order = Window.partitionBy("symptom").orderBy(F.desc("score"), F.desc("confidence"), "syndrome")
    top = pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top_k)
    return top.join(lists, "syndrome", "left").select("symptom", "place", "syndrome", "score", F.coalesce("formulas", F.lit("")).alias("formulas"))


def subgraph(queries: DataFrame, near: DataFrame, budget: int = 30) -> DataFrame:
    """Nodes around each queried name (qid, name) to depth 2, at most ``budget`` of them, near ones first."""
    step = near.select("anchor", "target", "place")
    one = queries.join(step, queries["name"] == step["anchor"]).select("qid", F.col("name").alias("start"), F.col("target").alias("node"), F.lit(1).alias("depth"), "place")
    two = one.drop("place").withColumnRenamed("node", "anchor").join(step, "anchor").select("qid", "start", F.col("target").alias("node"), F.lit(2).alias("depth"), "place")
    nodes = one.unionByName(two).filter("node != start").groupBy("qid", "node").agg(F.min(F.struct("depth", "place")).alias("d"))
    order = Window.partitionBy("qid").orderBy("d.depth", "d.place", "node")
    return nodes.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= budget).select("qid", "k", "node", F.col("d.depth").alias("depth"))


def degrees(facts: DataFrame) -> DataFrame:
    """Of each node its degree (both ends counted), evidence, and distinct books."""
    ends = facts.select(F.explode(F.array("subject", "object")).alias("name"), F.size("ids").alias("n"), "source_book").filter("name != ''")
    return ends.groupBy("name").agg(F.count("*").alias("degree"), F.sum("n").alias("evidence"), F.countDistinct("source_book").alias("books"))


def top_per_predicate(edges: DataFrame, n: int = 3) -> DataFrame:
    """The n best edges of each node and predicate, so that no predicate crowds out another."""
    order = Window.partitionBy("anchor", "predicate").orderBy(F.desc_nulls_last("best_confidence"), "row_id")
    return edges.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
