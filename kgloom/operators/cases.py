"""Structured search of case records: query profile, weighted fields, rerank by what a question states, fallback to vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.tokens import fragments
from kgloom.operators.corpus import bm25_fields, top_k
from kgloom.operators.rules import any_word, decide
from kgloom.operators.search import FORMULA

#: Weights of the fields of a case, and words by which a question shows what it asks.
WEIGHTS = {"question": 3.2, "answer": 1.4, "chief_complaint": 2.4, "history": 2.2, "tongue": 1.5, "pulse": 1.5, "symptom_text": 1.1, "syndrome_text": 1.1, "formula_text": 0.8, "age": 0.8}
HINTS = {"role": ["作用", "配伍"], "origin": ["出处", "出自", "原文"], "composition": ["组成", "哪些药"], "indication": ["主治", "可否"], "case": ["主诉", "患者", "医案", "何证"]}
SIGNS = ["痛", "热", "寒", "汗", "渴", "咳", "喘", "胁", "舌", "脉", "胃", "满", "木", "肿", "痒"]
STYLE = ["诊断", "医案", "患者", "主诉", "证"]


def profile(queries: DataFrame, text: str = "query") -> DataFrame:
    """Queries with formulas, symptom terms, stated age and sex, and the intent: case, origin, role, composition, indication, formula or generic."""
    q = F.coalesce(F.col(text), F.lit(""))
    flag = {k: any_word(q, w) for k, w in HINTS.items()}
    age = F.nullif(F.regexp_extract(q, r"([0-9]{1,3})岁", 1), F.lit(""))
    out = queries.withColumn("formulas", F.array_distinct(F.regexp_extract_all(q, F.lit(FORMULA), F.lit(0)))).withColumn("age_said", age)
    out = out.withColumn("symptoms", F.filter(fragments(q), lambda t: (F.length(t) <= 8) & F.exists(F.array(*map(F.lit, SIGNS)), lambda s: t.contains(s))))
    out = out.withColumn("sexes", F.filter(F.array(F.lit("男"), F.lit("女")), lambda s: q.contains(s)))
    named = F.size("formulas") > 0
    rules = [(flag["case"] | F.col("age_said").isNotNull(), "case"), (flag["origin"], "origin"), (flag["role"] & named, "formula_role"), (flag["composition"] & named, "formula_composition"), (flag["indication"] & named, "formula_indication"), (named, "formula")]
    return out.withColumn("intent", decide(rules, "generic"))


def segments(text: Column | str) -> Column:
    """Spans of up to eight ideographs, words, numbers, and ages, in order of kind, each once."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    spans = F.filter(F.regexp_extract_all(t, F.lit("[一-鿿]{2,}"), F.lit(0)), lambda x: F.length(x) <= 8)
    return F.array_distinct(F.concat(spans, F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]{2,}"), F.lit(0)), F.regexp_extract_all(t, F.lit("[0-9]{1,3}岁|[0-9]{1,3}"), F.lit(0))))


def search_cases(cases: DataFrame, queries: DataFrame, query_tokens: Column, *, key: str = "record_id", qkey: str = "qid", k: int = 5, over: int = 8) -> DataFrame:
    """Cases by BM25 over the weighted fields, ``over`` times as many as wanted, then reranked by what the question states.

    +2 for a case question, +3 if the stated age and +2 if a stated sex stands in the record, +1.5 for each symptom
    term, +1.2 if it reads like a case. ``queries`` come from ``profile``.
    """
    hits = bm25_fields(cases, queries, WEIGHTS, key=key, qkey=qkey, query_tokens=query_tokens, k=over * k).drop("place")
    body = F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in [*WEIGHTS, "sex"]))
    full = hits.join(cases.select(key, body.alias("body")), key).join(queries.select(qkey, "age_said", "sexes", "symptoms", "intent"), qkey)
    b = F.col("body")
    held = lambda c, w: w * F.size(F.filter(c, lambda x: b.contains(x))).cast("double")
    total = F.col("score") + F.when(F.col("intent") == "case", 2.0).otherwise(0.0) + F.when(F.col("age_said").isNotNull() & b.contains(F.col("age_said")), 3.0).otherwise(0.0)
    total += held("sexes", 2.0) + held("symptoms", 1.5) + F.when(any_word(b, STYLE), 1.2).otherwise(0.0)
    return top_k(full.select(qkey, key, F.round(total, 6).alias("score")), [qkey], [F.desc("score"), F.col(key)], k)


def answer_bonus(answer: Column) -> Column:
    """M7: for the length of an answer: .08 from 12 to 180 characters, .05 to 320, .02 beyond, -.04 below 12, 0 without one."""
    n = F.length(F.trim(F.coalesce(answer, F.lit(""))))
    return F.when(n == 0, 0.0).when(n < 12, -0.04).when(n <= 180, 0.08).when(n <= 320, 0.05).otherwise(0.02)


def overlap_bonus(query: Column, question: Column, answer: Column) -> Column:
    """M7: .03 for each token of the query that the question shares and .02 for the answer's, at most .25; ``query`` and others are token sets."""
    return F.least(0.03 * F.size(F.array_intersect(query, question)) + 0.02 * F.size(F.array_intersect(query, answer)), F.lit(0.25))
