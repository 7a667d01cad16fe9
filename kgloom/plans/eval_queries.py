"""Driver queries of evaluation, statistics and event sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import tokens as T
from kgloom.operators import corpus as C
from kgloom.operators import evaluation as E
from kgloom.operators import records as Q
from kgloom.operators.matching import common_runs
from kgloom.plans.corpus_queries import _ITEMS, FIELDS, bm25, docs, fields, items, light, search
from kgloom.plans.fact_queries import facts
from kgloom.plans.sqlparts import F as CF
from kgloom.plans.sqlparts import contents_sql
from kgloom.plans.text_queries import KEYWORDS
from kgloom.session import table


def relevant(s: SparkSession, d: str) -> DataFrame:
    """Documents that share 30 consecutive content characters with the passage of an item whose id is divisible by 20."""
    asked = table(s, d, "eval_items").filter("item_id % 20 = 0").select(F.col("item_id").alias("qid"), "passage")
    return common_runs(docs(s, d), asked).select("qid", "doc_id")


def metrics(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    gold, asked = relevant(s, d), items(s, d)
    other = C.bm25_fields(docs(s, d), asked, FIELDS, query_tokens=T.light_tokens("query"))
    return E.ir_metrics(search(s, d), gold, asked, 10), E.ir_metrics(other, gold, asked, 10)


def q_metrics(s: SparkSession, d: str) -> DataFrame:
    return metrics(s, d)[0]


def q_paired(s: SparkSession, d: str) -> DataFrame:
    return E.paired(*metrics(s, d), ["hit_1", "hit_k", "rr", "ndcg"])


def events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events")


def q_bootstrap(s: SparkSession, d: str) -> DataFrame:
    return E.bootstrap(events(s, d).select("event_type", F.round("value", 2).alias("value")), "event_type", "value")


def q_latency(s: SparkSession, d: str) -> DataFrame:
    return E.latency(events(s, d), ["event_type"], "value")


def q_prf(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "triple_records").filter("source_book is not null")
    return E.set_prf(t.select("source_book", "subject", "object", F.col("raw_predicate").alias("p")).na.drop(), t.select("source_book", "subject", "object", F.col("predicate").alias("p")).na.drop(), ["subject", "object", "p"], "source_book")


def q_composite(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "evidence").filter("confidence is not null")
    rows = e.groupBy("source_book").agg(F.round(F.avg("confidence"), 6).alias("quality"), F.countDistinct("fact_id").alias("yield"), F.count("*").alias("cost"))
    return E.composite(rows, "source_book", {"quality": 0.45, "yield": 0.35, "cost": 0.2}, lower=("cost",))


def q_proportional(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "qa_records")
    said = Q.json_terms("keyword_text")
    true = F.filter(F.array(*(F.lit(w) for w in KEYWORDS)), lambda w: F.coalesce("answer", F.lit("")).contains(w))
    return q.select("record_id", F.round(E.proportional(said, true, 3.0), 6).alias("score"))


def q_coverage(s: SparkSession, d: str) -> DataFrame:
    """Share of a query's terms that each of its hits holds."""
    hits = search(s, d).join(items(s, d), "qid").join(docs(s, d).select("doc_id", "text"), "doc_id")
    return hits.select("qid", "place", F.round(E.coverage(F.lower("text"), T.distinct_tokens("query")), 6).alias("coverage"))


def q_candidates(s: SparkSession, d: str) -> DataFrame:
    return E.candidate_groups(facts(s, d))


def q_split(s: SparkSession, d: str) -> DataFrame:
    return E.split_report(E.candidate_groups(facts(s, d)))


def q_distractors(s: SparkSession, d: str) -> DataFrame:
    cases = table(s, d, "case_records").select(F.col("record_id").alias("case"), Q.json_terms("symptom_text").alias("answers"))
    pool = cases.select(F.explode("answers").alias("item"))
    return E.distractors(cases, pool, 4, 12)


def q_rouge(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "qa_records").select("record_id", F.round(E.rouge_l(F.col("question"), F.col("answer")), 6).alias("rouge_l"))


def q_trailing(s: SparkSession, d: str) -> DataFrame:
    return Q.trailing_failures(events(s, d), "user_id", ["ts", "event_id"], F.col("event_type") != "error")


def q_segments(s: SparkSession, d: str) -> DataFrame:
    return Q.segments(events(s, d), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").groupBy("user_id", "segment").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))


def q_runs(s: SparkSession, d: str) -> DataFrame:
    return Q.runs(events(s, d), "user_id", ["ts", "event_id"], "event_type").groupBy("event_type").agg(F.count("*").alias("runs"), F.max("length").alias("longest"))


def q_latest(s: SparkSession, d: str) -> DataFrame:
    return Q.latest(events(s, d).withColumn("value", F.round("value", 6)), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], "value")


def q_rate(s: SparkSession, d: str) -> DataFrame:
    """ST4: events an hour and type."""
    return events(s, d).groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))


def q_sessions(s: SparkSession, d: str) -> DataFrame:
    """ST6: sessions of a user with gaps of at most six hours."""
    w = F.session_window("ts", "6 hours")
    return events(s, d).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("largest"))


def q_done(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "chunk_tasks")
    return Q.done_groups(t, t.filter("length(text_chunk) <= 1500"), "book_name", ["book_name", "sequence"])


def q_ablations(s: SparkSession, d: str) -> DataFrame:
    other = C.bm25_fields(docs(s, d), items(s, d), FIELDS, query_tokens=T.light_tokens("query"))
    return E.ablations({"text": search(s, d), "fields": other}, relevant(s, d), items(s, d), 10)


QUERIES = {
    "ablations": q_ablations,
    "ir_metrics": q_metrics,
    "paired_comparison": q_paired,
    "bootstrap_interval": q_bootstrap,
    "latency_summary": q_latency,
    "triple_prf": q_prf,
    "composite_ranking": q_composite,
    "proportional_score": q_proportional,
    "keyword_coverage": q_coverage,
    "candidate_groups": q_candidates,
    "split_report": q_split,
    "distractors": q_distractors,
    "rouge_l": q_rouge,
    "trailing_failures": q_trailing,
    "event_segments": q_segments,
    "event_runs": q_runs,
    "latest_status": q_latest,
    "hourly_rate": q_rate,
    "user_sessions": q_sessions,
    "completed_books": q_done,
}

_BM = bm25(10, "doc_id", "documents", light("text"), "items", light("query"))
_GOLD = f"""gp AS (SELECT DISTINCT qid, substring(p, i, 30) AS g FROM (SELECT item_id AS qid, {contents_sql('passage')} AS p FROM eval_items WHERE item_id % 20 = 0), range(1, 100000) r(i) WHERE i <= length(p) - 29),
gd AS (SELECT doc_id, {contents_sql('text')} AS t FROM documents), gold AS (SELECT DISTINCT qid, doc_id, 1 AS rel FROM gd JOIN gp ON contains(t, g))"""


def _ir(hits: str, name: str) -> str:
    return f"""{name}_m AS (SELECT h.qid, place, coalesce(rel, 0) AS rel FROM {hits} h LEFT JOIN gold g ON g.qid = h.qid AND g.doc_id = h.doc_id WHERE place <= 10),
{name}_p AS (SELECT qid, max(rel) FILTER (place = 1) AS hit_1, max(rel) AS hit_k, max(1.0::DOUBLE / place) FILTER (rel = 1) AS rr, sum(rel / log2(place + 1.0::DOUBLE)) AS dcg, sum(rel)::INT AS n FROM {name}_m GROUP BY qid),
{name} AS (SELECT items.qid, coalesce(hit_1, 0) AS hit_1, coalesce(hit_k, 0) AS hit_k, round(coalesce(rr, 0), 6) AS rr,
  round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))) ELSE 0.0 END, 6) AS ndcg FROM items LEFT JOIN {name}_p USING (qid))"""


_PAIR = " UNION ALL ".join(f"SELECT '{m}' AS metric, x.{m}::DOUBLE AS l, y.{m}::DOUBLE AS r FROM x JOIN y USING (qid)" for m in ("hit_1", "hit_k", "rr", "ndcg"))
_CAND = f"""g AS (SELECT subject, predicate, count(DISTINCT object) AS objects, count(*) AS rows, count(DISTINCT source_book) AS books, array_to_string(list_sort(list(DISTINCT object))[1:3], '|') AS answers FROM f GROUP BY subject, predicate HAVING count(DISTINCT object) >= 2),
c AS (SELECT *, ('0x' || substring(sha1(subject), 1, 12))::BIGINT % 10 AS h FROM g), k AS (SELECT * EXCLUDE (h), CASE WHEN h = 0 THEN 'debug' WHEN h <= 2 THEN 'dev' ELSE 'test' END AS split FROM c)"""
_SYM = "coalesce(CASE WHEN symptom_text <> '' THEN from_json(symptom_text, '[\"VARCHAR\"]') END, [])"

SQL = {
    "ablations": f"WITH {_ITEMS}, {_BM}, {fields(10)}, {_GOLD}, {_ir('b', 'x')}, {_ir('m', 'y')} "
    + " UNION ALL ".join(f"SELECT '{n}' AS condition, count(*) AS cases, round(avg(hit_1), 6) AS hit_1, round(avg(hit_k), 6) AS hit_k, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg FROM {t}" for n, t in (("text", "x"), ("fields", "y"))),
    "ir_metrics": f"WITH {_ITEMS}, {_BM}, {_GOLD}, {_ir('b', 'x')} SELECT * FROM x",
    "paired_comparison": f"""WITH {_ITEMS}, {_BM}, {fields(10)}, {_GOLD}, {_ir('b', 'x')}, {_ir('m', 'y')}, u AS ({_PAIR}),
a AS (SELECT metric, count(*) AS cases, avg(l) AS lm, avg(r) AS rm, count(*) FILTER (l > r) AS wins, count(*) FILTER (l < r) AS losses, count(*) FILTER (l = r) AS ties FROM u GROUP BY metric)
SELECT metric, cases, round(lm, 6) AS left_mean, round(rm, 6) AS right_mean, round(lm - rm, 6) AS delta, wins, losses, ties,
round(CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2.0 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))) END, 6) AS p_value FROM a""",
    "latency_summary": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.95), 6) AS p95_rank FROM events GROUP BY event_type",
    "triple_prf": """WITH p AS (SELECT DISTINCT source_book, subject, object, raw_predicate AS p, 1 AS a FROM triple_records WHERE source_book IS NOT NULL AND subject IS NOT NULL AND object IS NOT NULL AND raw_predicate IS NOT NULL),
g AS (SELECT DISTINCT source_book, subject, object, predicate AS p, 1 AS b FROM triple_records WHERE source_book IS NOT NULL AND subject IS NOT NULL AND object IS NOT NULL AND predicate IS NOT NULL),
c AS (SELECT source_book, count(a) AS predicted, count(b) AS gold, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS hits FROM p FULL JOIN g USING (source_book, subject, object, p) GROUP BY source_book)
SELECT *, round(coalesce(hits::DOUBLE / nullif(predicted, 0), 0), 6) AS precision, round(coalesce(hits::DOUBLE / nullif(gold, 0), 0), 6) AS recall, round(2.0::DOUBLE * hits / nullif(predicted + gold, 0), 6) AS f1 FROM c""",
    "composite_ranking": """WITH r AS (SELECT source_book, round(avg(confidence), 6) AS quality, count(DISTINCT fact_id) AS "yield", count(*) AS cost FROM evidence WHERE confidence IS NOT NULL GROUP BY source_book),
s AS (SELECT *, round(0.45::DOUBLE * quality / max(quality) OVER () + 0.35::DOUBLE * "yield" / max("yield") OVER () + 0.2::DOUBLE * min(cost) OVER () / cost, 6) AS score FROM r) SELECT *, rank() OVER (ORDER BY score DESC) AS place FROM s""",
    "proportional_score": f"""WITH a AS (SELECT record_id, coalesce(CASE WHEN keyword_text <> '' THEN from_json(keyword_text, '["VARCHAR"]') END, []) AS a, list_filter({KEYWORDS!r}, lambda w: contains(coalesce(answer, ''), w)) AS c FROM qa_records),
n AS (SELECT record_id, len(list_distinct(list_intersect(a, c))) AS hit, len(c) + len(list_filter(list_distinct(a), lambda x: NOT list_contains(c, x))) AS below FROM a)
SELECT record_id, round(coalesce(3.0::DOUBLE * hit / nullif(below, 0), 0), 6) AS score FROM n""",
    "keyword_coverage": f"""WITH {_ITEMS}, {_BM}, t AS (SELECT qid, list_distinct({light('query')}) AS t FROM items)
SELECT qid, place, round(CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda w: contains(lower(text), w)))::DOUBLE / len(t) END, 6) AS coverage FROM b JOIN t USING (qid) JOIN documents USING (doc_id)""",
    "candidate_groups": f"WITH {CF}, {_CAND} SELECT * FROM k",
    "split_report": f"WITH {CF}, {_CAND}, l AS (SELECT subject FROM k GROUP BY subject HAVING count(DISTINCT split) > 1) SELECT split, count(*) AS cases, count(DISTINCT subject) AS subjects, count(*) FILTER (subject IN (SELECT subject FROM l)) AS leaked FROM k GROUP BY split",
    "distractors": f"""WITH c AS (SELECT record_id AS "case", {_SYM} AS answers FROM case_records), p AS (SELECT DISTINCT unnest(answers) AS item FROM c),
r AS (SELECT item, row_number() OVER (ORDER BY md5(item), item) - 1 AS place FROM p), n AS (SELECT count(*) AS n FROM p),
s AS (SELECT "case", answers, i, (('0x' || substring(md5("case"), 1, 12))::BIGINT % n + i) % n AS place FROM c, n, range(12) t(i)),
m AS (SELECT "case", i, item FROM s JOIN r USING (place) WHERE NOT list_contains(answers, item))
SELECT * FROM (SELECT "case", row_number() OVER (PARTITION BY "case" ORDER BY i) AS option, item FROM m) WHERE option <= 4""",
    "trailing_failures": """WITH e AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
l AS (SELECT *, max(k) FILTER (ok) OVER (PARTITION BY user_id) AS last_ok FROM e)
SELECT user_id, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, count(*) FILTER (NOT ok AND k > coalesce(last_ok, 0)) AS trailing, round(count(*) FILTER (ok)::DOUBLE / count(*), 6) AS rate FROM l GROUP BY user_id""",
    "event_segments": """WITH m AS (SELECT *, lag(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM m) SELECT user_id, segment, count(*) AS events, round(sum(value), 4) AS value FROM s GROUP BY ALL""",
    "event_runs": """WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m), r AS (SELECT user_id, run, event_type, count(*) AS length FROM s GROUP BY ALL)
SELECT event_type, count(*) AS runs, max(length) AS longest FROM r GROUP BY event_type""",
    "latest_status": "SELECT user_id, event_type, round(arg_max(value, {'t': ts, 'e': event_id}), 6) AS value, count(*) AS entries FROM events GROUP BY ALL",
    "hourly_rate": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "user_sessions": """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS largest FROM c GROUP BY user_id""",
    "completed_books": "SELECT book_name, count(*) AS scheduled, count(*) FILTER (length(text_chunk) <= 1500) AS completed, count(*) - count(*) FILTER (length(text_chunk) <= 1500) AS pending, count(*) = count(*) FILTER (length(text_chunk) <= 1500) AS complete FROM chunk_tasks GROUP BY book_name",
}
