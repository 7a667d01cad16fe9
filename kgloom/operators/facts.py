"""The fact store: merging, best evidence, upserts, entities, deletion and snapshot deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.text import norm

#: Types that any specific one replaces.
GENERIC_TYPES = ("", "entity", "other")
KEY = ["subject", "predicate", "object", "source_book", "source_chapter"]


def clean_facts(facts: DataFrame) -> DataFrame:
    """Facts with stripped text columns (null is '') and ``ids``, the fact ids that a row carries, in order."""
    text = [*KEY, "subject_type", "object_type", "dataset_scope", "fact_id"]
    listed = F.filter(F.transform(F.split(F.coalesce("fact_ids_text", F.lit("")), r"[|\x1f]"), norm), lambda x: x != "")
    out = facts.withColumns({c: norm(c) for c in text})
    return out.withColumn("ids", F.when(F.size(listed) > 0, F.array_distinct(listed)).otherwise(F.filter(F.array("fact_id"), lambda x: x != "")))


def ordered_ids(rows: DataFrame, by: list[str], seq: str = "row_id") -> DataFrame:
    """Distinct fact ids of each group in first-seen order. Ids are reduced before they are collected, so a hot group stays small."""
    first = rows.select(*by, seq, F.posexplode("ids").alias("pos", "id")).groupBy(*by, "id").agg(F.min(F.struct(seq, "pos")).alias("at"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("fact_ids"))


def merge_dedup(rows: DataFrame, seq: str = "row_id") -> DataFrame:
    """A3: one row per five-field key, the first by ``seq``; fact ids united in first-seen order, fact_id the first of them."""
    keep = [c for c in ("subject_type", "object_type") if c in rows.columns]
    head = rows.groupBy(*KEY).agg(F.min(seq).alias("first_row"), F.count("*").alias("n_rows"), *(F.min_by(c, seq).alias(c) for c in keep))
    return head.join(ordered_ids(rows, KEY, seq), KEY, "left").withColumn("fact_id", F.coalesce(F.get("fact_ids", F.lit(0)), F.lit("")))


def best_evidence(members: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per signature all fact ids sorted, and the text and confidence of the best evidence.

    Best is the highest confidence, then the smallest fact_id; members without evidence still count for the list.
    """
    links = members.select(norm("signature").alias("signature"), norm("fact_id").alias("fact_id")).filter("signature != '' and fact_id != ''").distinct()
    proof = evidence.filter("confidence is not null").select(norm("fact_id").alias("fact_id"), "confidence", norm("source_text").alias("source_text"), "evidence_id")
    top = proof.groupBy("fact_id").agg(F.max(F.struct("confidence", (-F.col("evidence_id")).alias("tie"), "source_text")).alias("e"))
    joined = links.join(top, "fact_id", "left")
    order = F.struct((-F.col("e.confidence")).alias("c"), F.col("fact_id"))
    return joined.groupBy("signature").agg(
        F.array_join(F.array_sort(F.collect_set("fact_id")), "|").alias("fact_ids"),
        F.min_by("fact_id", F.when(F.col("e").isNotNull(), order)).alias("best_fact_id"),
        F.min_by("e.source_text", F.when(F.col("e").isNotNull(), order)).alias("best_text"),
        F.max("e.confidence").alias("best_confidence"),
    )


def first_specific(value: str, seq: str, generic: tuple[str, ...] = GENERIC_TYPES) -> Column:
    """The first specific value; without any, the first value at all."""
    specific = ~F.col(value).isin(*generic)
    return F.coalesce(F.min_by(F.when(specific, F.col(value)), F.when(specific, F.col(seq))), F.min_by(value, seq))


def upsert(rows: DataFrame, seq: str = "row_id") -> DataFrame:
    """A5, K6: batch upsert per key. Types rise only from generic to specific; the scope only from 'sample' to 'runtime'."""
    return rows.groupBy(*KEY).agg(
        first_specific("subject_type", seq).alias("subject_type"),
        first_specific("object_type", seq).alias("object_type"),
        F.when(F.max((F.col("dataset_scope") == "runtime").cast("int")) == 1, "runtime").otherwise(F.min_by("dataset_scope", seq)).alias("dataset_scope"),
        F.count("*").alias("deliveries"),
    )


def entity_stream(rows: DataFrame, seq: str = "row_id") -> DataFrame:
    """(name, entity_type, seq) of subjects and objects."""
    return rows.select(F.explode(F.array(*(F.struct(F.col(s).alias("name"), F.col(f"{s}_type").alias("entity_type"), (F.col(seq) * 2 + k).alias("seq")) for k, s in enumerate(("subject", "object"))))).alias("e")).select("e.*").filter("name != ''")


def rebuild_entities(rows: DataFrame, seq: str = "row_id") -> DataFrame:
    """Every name once with its first specific type, else its first type; '' becomes 'other'."""
    typed = entity_stream(rows, seq).groupBy("name").agg(first_specific("entity_type", "seq").alias("entity_type"), F.count("*").alias("mentions"))
    return typed.withColumn("entity_type", F.when(F.col("entity_type") == "", "other").otherwise(F.col("entity_type")))


def store_stats(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """A1: one row of counts."""
    per_fact = facts.agg(
        F.count("*").alias("facts"), F.count_if(F.col("dataset_scope") == "runtime").alias("runtime_facts"), F.count_if(F.col("dataset_scope") != "runtime").alias("other_facts"), F.countDistinct("predicate").alias("predicates"), F.countDistinct("source_book").alias("books")
    )
    nodes = entity_stream(facts).agg(F.countDistinct("name").alias("nodes"))
    return per_fact.crossJoin(nodes).crossJoin(evidence.agg(F.count("*").alias("evidence")))  # one row each


def top_counts(rows: DataFrame, by: str, n: int) -> DataFrame:
    """A1: the n most frequent values, the smaller value first on ties."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(n)


def orphan_evidence(evidence: DataFrame, members: DataFrame) -> DataFrame:
    """Evidence whose fact_id no member has; rows without a fact_id count as orphans."""
    known = members.select(norm("fact_id").alias("fid")).distinct()
    return evidence.withColumn("fid", norm("fact_id")).join(known, "fid", "left_anti").drop("fid")


def delta_facts(new: DataFrame, old: DataFrame) -> DataFrame:
    """Facts of ``new`` whose key is not in ``old`` and that share no fact id with it."""
    fresh = new.join(old.select(*KEY).distinct(), KEY, "left_anti")
    seen = old.select(F.explode("ids").alias("id")).distinct()
    touched = fresh.select("row_id", F.explode("ids").alias("id")).join(seen, "id", "left_semi").select("row_id").distinct()
    return fresh.join(touched, "row_id", "left_anti")


def delta_profile(delta: DataFrame, by: tuple[str, ...] = ("predicate", "source_book", "subject_type", "dataset_scope")) -> DataFrame:
    """Counts of the delta by several columns in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in by)))
    return delta.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def delta_evidence(delta: DataFrame, evidence: DataFrame, old_evidence: DataFrame) -> DataFrame:
    """Distinct evidence rows that the delta's facts carry and the old store lacks."""
    ids = delta.select(F.explode("ids").alias("fid")).distinct()
    rows = evidence.withColumn("fid", norm("fact_id"))
    return rows.join(ids, "fid", "left_semi").join(old_evidence.select(norm("fact_id").alias("fid")).distinct(), "fid", "left_anti").select("evidence_id", F.col("fid").alias("fact_id"), "source_book").distinct()


def publish(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """K5: base and incoming united, base rows first, then merged as A3."""
    tag = lambda df, k: df.withColumn("rank", F.struct(F.lit(k).alias("side"), F.col("row_id")))
    return merge_dedup(tag(base, 0).unionByName(tag(incoming, 1)), "rank")


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key: str = "fact_id", seq: str = "evidence_id") -> DataFrame:
    """K7: incoming rows with a new key, the first of each key."""
    fresh = incoming.filter(F.col(key) != "").join(existing.select(key).distinct(), key, "left_anti")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(seq))).filter("_n = 1").drop("_n")


def delete_rows(facts: DataFrame, rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """K9: facts without the given edges (five-field key), and without all edges at the given names (name)."""
    left = facts.join(rows.select(*KEY).distinct(), KEY, "left_anti")
    if names is None:
        return left
    gone = names.select("name").distinct()
    return left.join(gone, F.col("subject") == F.col("name"), "left_anti").join(gone, F.col("object") == F.col("name"), "left_anti")


def restricted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the given ones, each row once."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def group_count(rows: DataFrame, by: list[str]) -> DataFrame:
    """A2: one row with the number of groups; rows with a null key form groups, too."""
    return rows.select(*by).distinct().agg(F.count("*").alias("groups"))


def delete_books(facts: DataFrame, evidence: DataFrame, books: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remaining facts, remaining evidence, and names that no fact mentions any more."""
    left = facts.filter(~F.col("source_book").isin(*books))
    carried = left.select(F.explode("ids").alias("fid")).distinct()
    proof = evidence.withColumn("fid", norm("fact_id")).join(carried, "fid", "left_semi").drop("fid")
    orphans = entity_stream(facts).select("name").distinct().join(entity_stream(left).select("name").distinct(), "name", "left_anti")
    return left, proof, orphans


def compare_snapshots(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Counts of both snapshots by a column, with the delta; values of one side only count 0 on the other."""
    count = lambda df, name: df.groupBy(by).agg(F.count("*").alias(name))
    both = count(before, "n_before").join(count(after, "n_after"), by, "full_outer").na.fill(0, ["n_before", "n_after"])
    return both.withColumn("delta", F.col("n_after") - F.col("n_before"))


def majority(rows: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """The most frequent value of each group; of equal ones the first seen."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("votes"), F.min(seq).alias("first"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("votes", (-F.col("first")).alias("f"))).alias(value), F.max("votes").alias("votes"))
