"""Problem 3: one surviving record for each group of duplicates, chosen field by field.

Records are ranked by window ordering and the top one is kept. Spark puts a group limit before and after the
shuffle of such a window, so that a hot group is reduced to one row per task before it is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.text import blank, norm, strip_ws

#: Types that say nothing.
UNSETTLED = ("", "entity", "other", "unknown", "none", "null")


def signature_key(c: Column | str) -> Column:
    """A signature with plain separators: neither the form nor the spacing of the bars matters."""
    return norm(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)\s*[|｜‖∥¦│]{1,2}\s*", "||"))


def top(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; rows without a full key are left out."""
    for c in by:
        df = df.filter(F.col(c).isNotNull())
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_rank = 1").drop("_rank")


def usable_evidence(evidence: DataFrame) -> DataFrame:
    """The most trusted row of each fact_id: highest confidence, latest recorded_at (null earliest), smallest evidence_id."""
    rows = evidence.select("evidence_id", strip_ws("fact_id").alias("fact_id"), "source_text", "confidence", "recorded_at")
    rows = rows.filter(F.col("confidence").isNotNull() & ~F.isnan("confidence") & ~blank("source_text") & (F.col("fact_id") != ""))
    return top(rows, ["fact_id"], trust_order())


def trust_order() -> list[Column]:
    return [F.desc("confidence"), F.desc_nulls_last("recorded_at"), F.asc("evidence_id")]


def duplicate_groups(facts: DataFrame) -> DataFrame:
    """(sig, group_id, copies) of the signatures with two rows or more; blank signatures are no group."""
    return facts.select(signature_key("signature").alias("sig"), "row_id").filter("sig != ''").groupBy("sig").agg(F.min("row_id").alias("group_id"), F.count("*").alias("copies")).filter("copies > 1")


def best_evidence(facts: DataFrame, evidence: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(group_id, evidence_id, source_text, confidence): the most trusted evidence that a row of the group carries.

    A row carries its fact_id and those listed in fact_ids_text. Groups without usable evidence give no row.
    """
    groups = duplicate_groups(facts) if groups is None else groups
    carried = F.array_union(F.array(norm("fact_id")), F.split(F.coalesce("fact_ids_text", F.lit("")), r"[|｜\x1f]"))
    links = (
        facts.select(signature_key("signature").alias("sig"), F.explode(carried).alias("fact_id"))
        .join(groups.select("sig", "group_id"), "sig")
        .select("group_id", norm("fact_id").alias("fact_id"))
        .filter("fact_id != ''")
        .distinct()
    )
    ranked = links.join(usable_evidence(evidence), "fact_id")
    return top(ranked, ["group_id"], trust_order()).select("group_id", "evidence_id", "source_text", "confidence")


def surviving_facts(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per signature of two rows or more, built field by field.

    best_source_text and best_confidence come from the most trusted evidence, or, without any, from the row
    itself that has them with the highest confidence. Types are the settled ones of the most complete row,
    the rest comes from the latest row; the smaller row_id decides ties. Nulls never beat a value.
    """
    groups = duplicate_groups(facts)
    used = ["row_id", "subject", "predicate", "object", "source_book", "source_chapter", "dataset_scope", "fact_id", "subject_type", "object_type", "best_source_text", "best_confidence", "extracted_at"]
    rows = facts.select(signature_key("signature").alias("sig"), *used).join(groups, "sig")
    settled = lambda c: ~F.lower(norm(c)).isin(*UNSETTLED)
    filled = sum((settled(c).cast("int") for c in ("subject_type", "object_type")), F.lit(0)) + (~blank("best_source_text")).cast("int") + F.col("best_confidence").isNotNull().cast("int")
    newest = F.coalesce(F.col("extracted_at"), F.lit("0001-01-01").cast("timestamp"))
    whole, recent = F.struct(filled.alias("filled"), newest.alias("at"), (-F.col("row_id")).alias("id")), F.struct(newest.alias("at"), (-F.col("row_id")).alias("id"))
    pick = lambda c, order, ok: F.max_by(F.when(ok, norm(c)), F.when(ok, order)).alias(c)
    own = rows.groupBy("group_id").agg(
        F.first("copies").alias("copies"),
        F.max("sig").alias("signature"),
        *(pick(c, recent, ~blank(c)) for c in ("subject", "predicate", "object", "source_book", "source_chapter", "dataset_scope", "fact_id")),
        *(pick(c, whole, settled(c)) for c in ("subject_type", "object_type")),
        F.max_by(F.when(~blank("best_source_text"), F.struct("best_source_text", "best_confidence")), F.when(~blank("best_source_text"), F.struct(F.coalesce("best_confidence", F.lit(-1.0)).alias("c"), recent.alias("r")))).alias("own"),
        F.max("extracted_at").alias("extracted_at"),
    )
    proof = best_evidence(facts, evidence, groups)
    return own.join(proof, "group_id", "left").select(
        *[c for c in own.columns if c != "own"],
        F.coalesce("source_text", "own.best_source_text").alias("best_source_text"),
        F.coalesce("confidence", "own.best_confidence").alias("best_confidence"),
        "evidence_id",
    )
