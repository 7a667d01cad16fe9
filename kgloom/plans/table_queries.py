"""Driver queries of table joins, option lists and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.text import norm
from kgloom.operators import records as Q
from kgloom.operators import tables as B
from kgloom.plans.graph_queries import q_mentions
from kgloom.plans.sqlparts import trim
from kgloom.session import table


def q_bridge(s: SparkSession, d: str) -> DataFrame:
    """Entity types to books of evidence, over names and fact ids."""
    clean = lambda t, *cols: table(s, d, t).select(*(F.nullif(norm(c), F.lit("")).alias(c) for c in cols))
    return B.bridge([(clean("entities", "entity_type", "name"), "entity_type", "name"), (clean("facts", "subject", "fact_id"), "subject", "fact_id"), (clean("evidence", "fact_id", "source_book"), "fact_id", "source_book")], "entity_type", "source_book")


def q_labelled(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "case_records").select("record_id", F.md5(B.labelled_text({"主诉": "chief_complaint", "史": "history", "舌": "tongue", "脉": "pulse"})).alias("digest"))


def q_options(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "case_records").select("record_id", F.concat(F.lit("A："), norm("tongue"), F.lit("；b:"), norm("pulse"), F.lit("； C："), norm("sex"), F.lit("；无"), F.lit(";A:again")).alias("t"))
    choices = B.options(F.col("t"))
    return c.select("record_id", F.array_join(B.answer_texts(F.lit("AcX"), choices), "|").alias("answers"), F.size(choices).alias("n"))


def q_expect(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "case_records")
    return c.select("record_id", B.expectation(Q.json_terms("symptom_text"), F.filter(F.array(F.col("chief_complaint")), lambda x: F.coalesce(x, F.lit("")) != "")).alias("score"))


def q_backend(s: SparkSession, d: str) -> DataFrame:
    return B.backend_report(table(s, d, "evidence"), ["source_book"], F.coalesce(F.col("confidence") >= 0.8, F.lit(False)), "confidence", "confidence")


def q_attempts(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "alias_relations")
    return a.groupBy("source_book").agg(B.attempts(F.col("support") - 1, F.col("support"), F.lit(1)).cast("long").alias("attempts"))


def q_rates(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "qa_records").select("collection", Q.json_terms("keyword_text").alias("before"), F.array_sort(Q.json_terms("keyword_text")).alias("after"))
    return B.match_rates(q.withColumn("gold", F.array_sort("after")), "collection", "before", "after", "gold")


def q_spans(s: SparkSession, d: str) -> DataFrame:
    return B.resolve_spans(q_mentions(s, d))


QUERIES = {"table_bridge": q_bridge, "labelled_texts": q_labelled, "choice_options": q_options, "expectation_score": q_expect, "backend_report": q_backend, "provider_attempts": q_attempts, "match_rates": q_rates, "span_resolution": q_spans}

_KW = "coalesce(CASE WHEN keyword_text <> '' THEN from_json(keyword_text, '[\"VARCHAR\"]') END, [])"
_SY = "coalesce(CASE WHEN symptom_text <> '' THEN from_json(symptom_text, '[\"VARCHAR\"]') END, [])"
SQL = {
    "table_bridge": f"""SELECT DISTINCT {trim('e.entity_type')} AS entity_type, {trim('v.source_book')} AS source_book FROM entities e JOIN facts f ON {trim('f.subject')} = {trim('e.name')} JOIN evidence v ON {trim('v.fact_id')} = {trim('f.fact_id')}
WHERE {trim('e.entity_type')} <> '' AND {trim('e.name')} <> '' AND {trim('f.fact_id')} <> '' AND {trim('v.source_book')} <> ''""",
    "labelled_texts": "SELECT record_id, md5('主诉：' || coalesce(chief_complaint, '') || chr(10) || '史：' || coalesce(history, '') || chr(10) || '舌：' || coalesce(tongue, '') || chr(10) || '脉：' || coalesce(pulse, '')) AS digest FROM case_records",
    "choice_options": f"SELECT record_id, {trim('tongue')} || '|' || {trim('sex')} AS answers, 3 AS n FROM case_records",
    "expectation_score": f"SELECT record_id, CASE WHEN coalesce(chief_complaint, '') = '' THEN CASE WHEN len({_SY}) > 0 THEN 1.0 ELSE 0.0 END ELSE list_contains({_SY}, chief_complaint)::INT::DOUBLE END AS score FROM case_records",
    "backend_report": "SELECT source_book, count(*) AS cases, count(*) FILTER (confidence >= 0.8) AS ok_cases, round(avg(confidence) FILTER (confidence >= 0.8), 6) AS mean_ms, round(avg(confidence), 6) AS mean_score FROM evidence GROUP BY source_book",
    "provider_attempts": "SELECT source_book, sum(CASE WHEN support - 1 > 0 THEN support - 1 ELSE support + 1 END)::BIGINT AS attempts FROM alias_relations GROUP BY source_book",
    "match_rates": f"SELECT collection, round(avg(({_KW} = list_sort({_KW}))::INT), 6) AS before_rate, 1.0::DOUBLE AS after_rate, 1.0::DOUBLE AS reduced_rate FROM qa_records GROUP BY collection",
}
