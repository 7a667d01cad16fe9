"""Problem 5: connected components by deterministic Borůvka hooking.

Names are numbered in the order of their code points, so that the smallest number of a component is its
smallest name. With edges weighed by their pair of labels, the smallest edge out of a component is the one to
its smallest neighbour. Hooking along it gives trees and, at the top of each, one pair that picked each
other; the smaller of the two is the root. Trees collapse by pointer doubling, edges are relabelled and
deduplicated, and the rounds go on until no edge is left. Every round at least halves the labels in play.
The labels of all rounds are put together from the last to the first, so that all rows are touched once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import norm
from kgloom.session import cut

#: Entries that stand in for a name where none is given.
STAND_INS = ("无", "無", "—", "——", "-", "--", "/", "未详", "未詳", "不详", "不詳", "同上", "同前", "待考", "阙", "缺", "阙如", "佚名", "未知", "暂无", "空", "n/a", "na", "none", "null", "nil", "unknown", "?", "？")


def name_pairs(df: DataFrame, left: str = "entity", right: str = "alias", stand_ins: tuple[str, ...] = STAND_INS) -> DataFrame:
    """Distinct (a, b) of two different real names each; a is the smaller one."""
    a, b = norm(left), norm(right)
    return (
        df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .filter((F.col("a") != "") & (F.col("a") != F.col("b")) & ~F.lower("a").isin(*stand_ins) & ~F.lower("b").isin(*stand_ins))
        .distinct()
    )


def number_names(pairs: DataFrame) -> DataFrame:
    """(name, id) of all names in ``pairs``; ids rise with the name. Cut, as the numbering may not be done anew."""
    return cut(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct().sort("name").withColumn("id", F.monotonically_increasing_id()))


def collapse(parent: DataFrame) -> DataFrame:
    """Pointer doubling of (c, p) until every p is a root. A root is no c, or its own p."""
    while True:
        up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        wide = parent.join(up, "p", "left").select("c", F.coalesce("pp", "p").alias("q"), "p")
        wide = cut(wide)
        parent = wide.select("c", F.col("q").alias("p"))
        if wide.filter(F.col("q") != F.col("p")).isEmpty():
            return parent


def boruvka(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the id edges (u, v); comp is the smallest node of the component.

    Repeated and reversed edges and loops change nothing; nulls make an edge void; no edges, no rows.
    """
    tidy = lambda e: e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()
    rounds: list[DataFrame] = []
    left = cut(tidy(edges.filter("u is not null and v is not null")))
    while not left.isEmpty():
        both = left.select(F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("n")), F.struct(F.col("v").alias("c"), F.col("u").alias("n")))).alias("e")).select("e.*")
        pick = cut(both.groupBy("c").agg(F.min("n").alias("p")))
        back = pick.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        hooked = pick.join(back, "p", "left").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        roots = collapse(cut(hooked))
        rounds.append(roots)
        on = lambda side: roots.select(F.col("c").alias(side), F.col("p").alias(f"{side}_root"))  # noqa: E731, B023
        left = cut(tidy(left.join(on("u"), "u").join(on("v"), "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))))
    if not rounds:
        return left.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    whole = rounds.pop()
    while rounds:
        later = whole.select(F.col("c").alias("p"), F.col("p").alias("root"))
        whole = cut(rounds.pop().join(later, "p", "left").select("c", F.coalesce("root", "p").alias("p")))
    return whole.select(F.col("c").alias("node"), F.col("p").alias("comp"))


def name_groups(df: DataFrame, left: str = "entity", right: str = "alias", stand_ins: tuple[str, ...] = STAND_INS) -> DataFrame:
    """(group_name, name): every name that some row joins to another one; group_name is the smallest of its group.

    Rows whose side is null, blank or a stand-in, and rows naming one thing twice, join nothing. Extra columns are ignored.
    """
    pairs = cut(name_pairs(df, left, right, stand_ins))
    names = number_names(pairs)
    code = lambda side: names.select(F.col("name").alias(side), F.col("id").alias(f"{side}_id"))
    groups = boruvka(pairs.join(code("a"), "a").join(code("b"), "b").select(F.col("a_id").alias("u"), F.col("b_id").alias("v")))
    head = names.select(F.col("id").alias("comp"), F.col("name").alias("group_name"))
    return groups.join(names.withColumnRenamed("id", "node"), "node").join(head, "comp").select("group_name", "name")
