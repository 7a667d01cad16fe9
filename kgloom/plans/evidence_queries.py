"""Driver queries of recovery, selection and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import tokens as T
from kgloom.functions.text import norm
from kgloom.operators import evidence as V
from kgloom.operators import recovery as R
from kgloom.plans.corpus_queries import docs, search
from kgloom.plans.fact_queries import facts
from kgloom.plans.graph_queries import questions
from kgloom.plans.sqlparts import F as CF
from kgloom.plans.sqlparts import contents_sql, trim
from kgloom.session import table

WORDS = {"source": ["出自", "何书"], "compare": ["取舍", "与"], "relation": ["哪些药", "禁忌", "可否"]}
PARTS = ["subject", "predicate", "object"]


def q_recover(s: SparkSession, d: str) -> DataFrame:
    """Triples as models print them: plain, fenced, after thoughts with a trailing comma, as a Python literal."""
    t = table(s, d, "triple_records").na.fill("", PARTS)
    body = F.to_json(F.struct(*PARTS))
    literal = F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f"'{c}': '"), F.col(c), F.lit("'")) for c in PARTS)), F.lit("}"))
    text = F.when(F.col("triple_id") % 4 == 0, body).when(F.col("triple_id") % 4 == 1, F.concat(F.lit("结果如下\n```json\n["), body, F.lit("]\n```"))).when(F.col("triple_id") % 4 == 2, F.concat(F.lit('<think>{"no": 1}</think>{"triples": ['), body, F.lit(",]}"))).otherwise(literal)
    return R.recover(t.select("triple_id", text.alias("text")), "triple_id", "text", PARTS)


def q_mmr(s: SparkSession, d: str) -> DataFrame:
    pool = search(s, d, 30).join(docs(s, d).select("doc_id", "source", T.distinct_tokens("text").alias("tokens")), "doc_id")
    return R.mmr(pool)


def merged(s: SparkSession, d: str) -> DataFrame:
    f, e, q = facts(s, d), table(s, d, "evidence"), table(s, d, "qa_records")
    return V.merge_items(
        [
            V.items("relation", f, F.col("source_book"), F.col("best_source_text"), F.col("best_confidence")),
            V.items("document", e, F.col("source_book"), F.col("source_text"), F.col("confidence")),
            V.items("case", q, F.col("collection"), F.col("answer"), F.lit(0.5)),
        ]
    )


def q_items(s: SparkSession, d: str) -> DataFrame:
    return merged(s, d).withColumn("snippet", F.md5("snippet"))


def q_coverage(s: SparkSession, d: str) -> DataFrame:
    return V.coverage(merged(s, d))


def q_route(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("qid", V.route(F.col("text"), WORDS).alias("route"), *(v.alias(f"is_{k}") for k, v in V.flags(F.col("text"), WORDS).items()))


def q_sources(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "chunk_tasks").filter("sequence % 20 = 0").select("sequence", norm("book_name").alias("book"), F.col("chapter_name").alias("chapter"), F.col("text_chunk").alias("text"))
    return V.resolve_sources(rows, docs(s, d), "sequence")


def q_unique(s: SparkSession, d: str) -> DataFrame:
    """The chapter of every document whose id is divisible by 20, found again among all documents of its book."""
    every = docs(s, d).select("doc_id", norm("book_name").alias("book"), norm("chapter_title").alias("title"), "text").filter("book != ''")
    return V.unique_sections(every.filter("doc_id % 20 = 0"), every, "doc_id")


def q_books(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "chunk_tasks")
    return V.book_listing(t, t.filter("chunk_index >= 5"))


def q_ids(s: SparkSession, d: str) -> DataFrame:
    return V.numbered_ids(facts(s, d), "source_chapter", "row_id", "kg").select("row_id", "emitted_id")


QUERIES = {"json_recovery": q_recover, "mmr_selection": q_mmr, "evidence_items": q_items, "evidence_coverage": q_coverage, "question_routes": q_route, "source_resolution": q_sources, "unique_sections": q_unique, "book_listing": q_books, "numbered_ids": q_ids}

_SNIP = r"substring(regexp_replace(coalesce({0}, ''), '^[\s\x{{00a0}}\x{{3000}}]+|[\s\x{{00a0}}\x{{3000}}]+$', '', 'g'), 1, {1})"
_ITEMS = f"""u AS (SELECT 'relation' AS source_type, source_book AS source, {_SNIP.format('best_source_text', 300)} AS snippet, coalesce(best_confidence, 0) AS score FROM f
UNION ALL SELECT 'document', coalesce(source_book, ''), {_SNIP.format('source_text', 300)}, coalesce(confidence, 0) FROM evidence UNION ALL SELECT 'case', coalesce(collection, ''), {_SNIP.format('answer', 300)}, 0.5 FROM qa_records),
m AS (SELECT source_type, source, snippet, max(score)::DOUBLE AS score, count(*) AS times FROM u WHERE snippet <> '' GROUP BY ALL)"""
_Q = "q AS (SELECT record_id AS qid, min(coalesce(question, '')) AS text FROM qa_records WHERE CAST(right(record_id, 7) AS INT) % 20 = 0 GROUP BY record_id)"
_FLAG = {k: "(" + " OR ".join(f"contains(text, '{w}')" for w in v) + ")" for k, v in WORDS.items()}
_SQUEEZE = r"regexp_replace(coalesce({0}, ''), '[\s\x{{00a0}}\x{{3000}}]+', '', 'g')"

SQL = {
    "json_recovery": "SELECT triple_id, 0 AS seq, coalesce(subject, '') AS subject, coalesce(predicate, '') AS predicate, coalesce(object, '') AS object FROM triple_records",
    "evidence_items": f"WITH {CF}, {_ITEMS} SELECT source_type, source, md5(snippet) AS snippet, score, times FROM m",
    "evidence_coverage": f"""WITH {CF}, {_ITEMS}, a AS (SELECT source_type, count(*) AS items, count(DISTINCT source) AS sources, max(score) AS best, count(*) FILTER (length(snippet) >= 20) AS long_items FROM m GROUP BY source_type)
SELECT *, concat_ws('|', CASE WHEN sources < 5 THEN 'few_sources' END, CASE WHEN best < 0.9 THEN 'weak' END, CASE WHEN long_items = 0 THEN 'short' END) AS gaps FROM a""",
    "question_routes": f"WITH {_Q} SELECT qid, CASE WHEN {_FLAG['source']} THEN 'text' WHEN {_FLAG['compare']} THEN 'both' WHEN {_FLAG['relation']} THEN 'graph' ELSE 'text' END AS route, " + ", ".join(f"{v} AS is_{k}" for k, v in _FLAG.items()) + " FROM q",
    "source_resolution": f"""WITH h AS (SELECT sequence, {trim('book_name')} AS book, coalesce(chapter_name, '') AS chapter, substring({_SQUEEZE.format('text_chunk')}, 1, 18) AS head FROM chunk_tasks WHERE sequence % 20 = 0),
m AS (SELECT sequence, doc_id, CASE WHEN chapter <> '' AND contains(coalesce(chapter_title, ''), chapter) THEN 0 ELSE 1 END AS tier FROM h JOIN documents ON contains({_SQUEEZE.format('text')}, head) AND contains(book_name, book) WHERE length(head) >= 8 AND book <> '')
SELECT sequence, min(tier) AS tier, arg_min(doc_id, tier * 1000000000 + doc_id) AS doc_id FROM m GROUP BY sequence""",
    "unique_sections": f"""WITH d AS (SELECT doc_id, {trim('book_name')} AS book, {trim('chapter_title')} AS title, {_SQUEEZE.format('text')} AS s, {contents_sql('text')} AS l FROM documents WHERE {trim('book_name')} <> ''),
p AS (SELECT DISTINCT doc_id, book, 0 AS o, substring(s, 1, n) AS probe FROM d, unnest([220, 180, 140, 100, 80, 60, 40]) t(n) WHERE doc_id % 20 = 0 AND length(s) >= 18
  UNION SELECT DISTINCT doc_id, book, 1, substring(l, 1, n) FROM d, unnest([220, 180, 140, 100, 80, 60, 40]) t(n) WHERE doc_id % 20 = 0 AND length(l) >= 18),
m AS (SELECT p.doc_id, o, length(probe) AS n_chars, min(title) AS title FROM p JOIN d ON d.book = p.book AND title <> '' AND contains(CASE WHEN o = 0 THEN d.s ELSE d.l END, probe) GROUP BY p.doc_id, o, probe HAVING count(DISTINCT title) = 1)
SELECT doc_id, title, CASE WHEN o = 0 THEN 'strict' ELSE 'loose' END AS how, n_chars FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o, n_chars DESC) = 1""",
    "book_listing": """WITH p AS (SELECT book_name, count(*) AS tasks, round_even(sum(strlen(coalesce(text_chunk, ''))) / 1024.0::DOUBLE, 1) AS kb, bool_or(coalesce(chunk_index >= 5, false)) AS processed FROM chunk_tasks GROUP BY book_name)
SELECT *, row_number() OVER (ORDER BY book_name) AS ordinal, CASE WHEN NOT processed THEN sum((NOT processed)::INT) OVER (ORDER BY book_name)::BIGINT END AS todo FROM p""",
    "numbered_ids": f"WITH {CF} SELECT row_id, 'kg:' || source_chapter || ':' || lpad(row_number() OVER (PARTITION BY source_chapter ORDER BY row_id)::VARCHAR, 7, '0') AS emitted_id FROM f",
}
