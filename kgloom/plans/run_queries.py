"""Driver queries of benchmarks, runs, logs and the lists made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.text import norm
from kgloom.operators import benchmark as B
from kgloom.operators import records as Q
from kgloom.operators import runs as R
from kgloom.plans.corpus_queries import _ITEMS, bm25, docs, items, light, search
from kgloom.plans.fact_queries import facts
from kgloom.plans.graph_queries import SQL as GRAPH
from kgloom.plans.graph_queries import pairs, q_paths
from kgloom.plans.sqlparts import F as CF
from kgloom.plans.sqlparts import trim
from kgloom.session import table


def strings(*words: str) -> object:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def q_candidates(s: SparkSession, d: str) -> DataFrame:
    return B.candidate_rows(facts(s, d)).select("row_id")


def groups(s: SparkSession, d: str) -> DataFrame:
    return B.question_groups(facts(s, d).filter("subject != '' and predicate != ''"))


def q_groups(s: SparkSession, d: str) -> DataFrame:
    return groups(s, d).drop("rank_key")


def q_capped(s: SparkSession, d: str) -> DataFrame:
    return B.capped(groups(s, d), "rank_key", {"subject": 2, "source_book": 12}).filter("taken").select("subject", "predicate", "source_book", "source_chapter", "objects")


def q_pairs(s: SparkSession, d: str) -> DataFrame:
    g = groups(s, d).withColumn("k", F.concat_ws("|", "subject", "predicate", "source_book", "source_chapter"))
    return B.case_pairs(g, "k")


def q_regraded(s: SparkSession, d: str) -> DataFrame:
    hits = search(s, d, 5).join(docs(s, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), norm("book_name").alias("book")), "doc_id")
    cases = table(s, d, "eval_items").filter("item_id % 20 = 0").select(F.col("item_id").alias("qid"), F.when(F.col("item_id") % 40 == 0, "source").otherwise("answer").alias("family"), F.substring("question_text", 1, 2).alias("subject"), F.array(F.substring("passage", 2, 5)).alias("answers"), strings("云岭方录", "澄湖").alias("books"))
    return B.regraded(hits, cases)


def q_confusion(s: SparkSession, d: str) -> DataFrame:
    return B.confusion(table(s, d, "qa_records"), "bucket", "question_type")


def q_tasks(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "case_records")
    none = F.lit(None).cast("string").alias("d")
    sent = c.select(F.col("record_id").alias("case"), F.lit(1).alias("seq"), Q.json_terms("symptom_text").alias("a"), Q.json_terms("syndrome_text").alias("b"), Q.json_terms("formula_text").alias("c"), none)
    late = sent.select("case", F.lit(2).alias("seq"), strings("x").alias("a"), "b", "c", "d")
    gold = c.select(F.col("record_id").alias("case"), F.filter(F.array("chief_complaint", "tongue"), lambda x: x.isNotNull()).alias("a"), Q.json_terms("syndrome_text").alias("b"), F.array_union(Q.json_terms("formula_text"), strings("加味")).alias("c"), none)
    return B.task_scores(late.unionByName(sent), gold)


def q_sections(s: SparkSession, d: str) -> DataFrame:
    hits = search(s, d, 5).join(docs(s, d).select("doc_id", norm("book_name").alias("book"), F.coalesce("text", F.lit("")).alias("text"), F.col("chapter_title").isNotNull().alias("is_section")), "doc_id")
    cases = items(s, d).select("qid", F.lit("云岭方录").alias("book"), F.array(F.substring("query", 1, 2), F.substring("query", 3, 2), F.lit("脉")).alias("keywords"))
    return B.section_scores(hits, cases)


def q_answers(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "qa_records")
    cited = F.array(F.concat_ws("/", "collection", "bucket"))
    return q.select("record_id", B.answer_score(F.col("answer"), Q.json_terms("formula_text"), cited, strings("qa_main"), strings("日", "水煎", "服"), F.coalesce(F.col("question_type") == "taboo", F.lit(False))).alias("score"))


def q_path_quality(s: SparkSession, d: str) -> DataFrame:
    cases = pairs(s, d).select("qid", F.when(F.col("qid") % 60 == 0, strings()).when(F.col("qid") % 40 == 0, F.array("finish")).otherwise(strings("无名")).alias("expected"))
    return B.path_quality(q_paths(s, d), cases)


def q_conditions(s: SparkSession, d: str) -> DataFrame:
    return B.condition_summary(table(s, d, "evidence"), "source_book", F.coalesce(F.col("confidence") >= 0.8, F.lit(False)), "confidence", F.when(F.col("evidence_id") % 3 == 0, "local-Fallback"), F.coalesce("source_chapter", F.lit("")))


def q_categories(s: SparkSession, d: str) -> DataFrame:
    return B.category_summary(table(s, d, "qa_records").na.fill("", ["bucket", "question_type"]), ["bucket", "question_type"], F.length("answer") > 20)


def report(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "qa_records").select("record_id", F.coalesce(F.length("answer") > 30, F.lit(False)).alias("ok"), F.concat_ws(":", "question_type", "bucket").alias("issue"), "answer")


def q_rerun(s: SparkSession, d: str) -> DataFrame:
    return B.rerun_jobs(report(s, d), ["usage", "taboo:"], 25, "record_id")


def q_merged(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("seq"), F.round("value", 4).alias("value"))
    return B.merged_reports(e, ["user_id", "event_type"], "seq")


def q_slots(s: SparkSession, d: str) -> DataFrame:
    return B.open_slots(report(s, d).select("record_id"), report(s, d), ["record_id"])


def q_probe(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "evidence").select("source_book", F.coalesce(F.col("confidence") > 0.7, F.lit(False)).alias("ok"), "confidence")
    return B.probe_summary(e, "source_book", "confidence")


def q_frozen(s: SparkSession, d: str) -> DataFrame:
    return B.frozen(table(s, d, "qa_records"), ["record_id"], ["bucket"], "answer", 20)


def q_outcome(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "triple_records").groupBy(norm("source_chapter").alias("chapter")).agg(F.count_if(norm("source_text") != "").alias("n"), F.count_if(F.col("confidence").isNull()).alias("bad"))
    return t.select("chapter", B.chunk_outcome(F.col("n"), F.when(F.col("bad") > 1, "timeout"), 3).alias("outcome"))


def q_replay(s: SparkSession, d: str) -> DataFrame:
    f = facts(s, d).select(F.col("source_book").alias("run"), F.col("row_id").alias("line"), "subject", "predicate", "object", "extracted_at")
    return R.replay(f, f.groupBy("run").agg(F.max("extracted_at").alias("published_at")), F.lit("2025-05-30").cast("timestamp"), ["subject", "predicate", "object"], ["云岭方录"], ["荷滩妇笺"])


def q_attempts(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "triple_records").filter("source_text is not null")
    a = t.groupBy(norm("source_book").alias("book"), (F.col("triple_id") % 3).cast("int").alias("attempt")).agg(F.array_sort(F.collect_list("triple_id")).alias("rows"))
    return R.best_attempts(a, ["book"]).select("book", "attempt", F.size("rows").alias("n"), F.array_join("rows", "|").alias("rows"), "tried")


def q_pending(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "chunk_tasks")
    return R.pending_batches(t, t.filter("sequence % 3 = 0"), "sequence", 2)


def log(s: SparkSession, d: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for p in {"view": "token", "click": "tool_start", "purchase": "tool_end", "signup": "route", "error": "note"}.items() for x in p])
    e = table(s, d, "events")
    return e.select((F.col("user_id") % 50).alias("job"), F.col("event_id").alias("seq"), "ts", F.coalesce(kind[F.col("event_type")], F.lit("done")).alias("kind"), F.col("event_id").cast("string").alias("text"), F.concat(F.lit("t"), (F.col("event_id") % 4).cast("string")).alias("name"))


def q_tail(s: SparkSession, d: str) -> DataFrame:
    return R.tail(log(s, d), 9 * F.col("job") + 5000).select("job", "seq", "next")


def q_folded(s: SparkSession, d: str) -> DataFrame:
    return R.folded(log(s, d), "job", ["ts", "seq"]).withColumn("content", F.md5("content"))


def q_history(s: SparkSession, d: str) -> DataFrame:
    return R.compressed(log(s, d), "job", ["ts", "seq"], 10).groupBy("job", "part").agg(F.count("*").alias("n"), F.max("turn").alias("last"))


def q_page(s: SparkSession, d: str) -> DataFrame:
    return R.page(R.sessions(log(s, d), "job", "ts"), [F.desc("updated_at"), F.col("job")], 2, 15)


def q_preview(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "triple_records").select("triple_id")
    return R.preview(t.filter("false"), t, [F.col("triple_id")], 500)


def q_run_summary(s: SparkSession, d: str) -> DataFrame:
    f = facts(s, d).select(F.col("source_book").alias("run"), F.concat_ws("|", "subject", "predicate", "object").alias("fact"))
    e = table(s, d, "evidence").select(norm("source_book").alias("run"), F.col("evidence_id").alias("seq"), F.when(F.col("confidence") > 0.8, "done").otherwise("partial").alias("state"))
    return R.run_summary(f, e)


def q_review(s: SparkSession, d: str) -> DataFrame:
    c = facts(s, d).groupBy("predicate").agg(F.count("*").alias("n"), F.countDistinct("object_type").alias("kinds")).withColumn("action", F.when(F.length("predicate") > 3, "manual_review").otherwise("rename"))
    return R.review_list(c, F.col("kinds") > 4)


def q_recommended(s: SparkSession, d: str) -> DataFrame:
    b = docs(s, d).filter("trim(book_name) != ''").groupBy(F.col("book_name").alias("book")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.countDistinct("chapter_title").alias("sections"), F.count("*").alias("mentions"))
    return R.recommended(b, 12)


def q_paths_of(s: SparkSession, d: str) -> DataFrame:
    """Evidence paths of every fact, and the one to read."""
    f = facts(s, d)
    listed = F.array(F.concat(F.lit("qa://"), "predicate"), F.concat(F.lit("book://"), "source_book"), R.chapter_path(F.col("source_book"), F.col("source_chapter")), F.concat(F.lit("entity://"), "subject"), F.concat(F.lit("zz://"), "object"))
    paths = F.filter(listed, lambda x: x.isNotNull())
    return f.select("row_id", F.array_join(R.ordered_paths(paths), "|").alias("paths"), R.best_path(paths, F.array("source_book")).alias("best"), R.path_matches(F.get(paths, F.lit(1)), F.concat(F.lit("book://"), F.substring("source_book", 1, 2))).alias("near"))


def q_intents(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "qa_records")
    n = F.length(F.coalesce("answer", F.lit("")))
    pair = lambda i, v: F.struct(F.lit(i).alias("intent"), v.cast("double").alias("score"))
    return q.select("record_id", F.array_join(R.ranked_intents(F.array(pair("path", n % 3), pair("lookup", n % 2), pair("source", n % 3), pair("other", n % 4)), ["source", "lookup", "path"]), "|").alias("intents"))


def q_citations(s: SparkSession, d: str) -> DataFrame:
    """Citations and a short summary of each case."""
    c = table(s, d, "case_records")
    item = lambda a, b: F.array(F.struct(F.coalesce(a, F.lit("")).alias("source"), F.coalesce(b, F.lit("")).alias("snippet")))
    cited = R.citations(strings("书一", "书一"), item(F.col("collection"), F.col("answer")), item(F.col("tongue"), F.col("question")), 3, 10)
    relations = F.transform(Q.json_terms("symptom_text"), lambda t: F.struct(F.lit("见").alias("predicate"), t.alias("target")))
    return c.select("record_id", F.array_join(cited, "|").alias("citations"), R.extract(relations, F.array(F.coalesce("answer", F.lit(""))), 2, 1, 12).alias("summary"), R.envelope(relations, 20001).alias("code"), R.tuned_k(F.col("sex"), F.lit(3), {"男": 5}).alias("k"))


def q_numbers(s: SparkSession, d: str) -> DataFrame:
    """Confidences from text, and the time left at the pace so far."""
    e = table(s, d, "evidence").filter("evidence_id % 5 = 0")
    text = F.when(F.col("evidence_id") % 3 == 0, "n/a").when(F.col("evidence_id") % 3 == 1, "1.7").otherwise(F.col("confidence").cast("string"))
    return e.select("evidence_id", R.confidence(text).alias("confidence"), R.remaining(F.col("evidence_id") % 7, F.lit(9), F.lit(600)).alias("left"))


def q_rotation(s: SparkSession, d: str) -> DataFrame:
    return R.rotation(table(s, d, "chunk_tasks").select("sequence"), "sequence", {"one": 3, "two": 1})


QUERIES = {
    "provider_rotation": q_rotation,
    "benchmark_candidates": q_candidates,
    "question_groups": q_groups,
    "capped_selection": q_capped,
    "case_pairs": q_pairs,
    "regraded_hits": q_regraded,
    "route_confusion": q_confusion,
    "task_scores": q_tasks,
    "section_scores": q_sections,
    "answer_scores": q_answers,
    "path_quality": q_path_quality,
    "condition_summary": q_conditions,
    "category_summary": q_categories,
    "rerun_jobs": q_rerun,
    "merged_reports": q_merged,
    "open_slots": q_slots,
    "probe_summary": q_probe,
    "frozen_run": q_frozen,
    "chunk_outcomes": q_outcome,
    "run_replay": q_replay,
    "best_attempts": q_attempts,
    "pending_batches": q_pending,
    "log_tail": q_tail,
    "folded_messages": q_folded,
    "compressed_history": q_history,
    "session_page": q_page,
    "artifact_preview": q_preview,
    "run_summary": q_run_summary,
    "review_list": q_review,
    "recommended_books": q_recommended,
    "evidence_paths": q_paths_of,
    "ranked_intents": q_intents,
    "case_citations": q_citations,
    "confidence_numbers": q_numbers,
}


def _clean(x: str, a: int, b: int, share: float, bad: str) -> str:
    x = f"trim(coalesce({x}, ''))"
    return rf"(length({x}) BETWEEN {a} AND {b} AND length(regexp_replace({x}, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) >= {share} * length({x}) AND NOT regexp_matches({x}, '{bad}'))"


def _name(x: str) -> str:
    return f"({_clean(x, 2, 24, 0.45, chr(91) + r'\[\]{}<>|\\/，。；：！？\n\t' + chr(93))} AND NOT ends_with(trim({x}), '方论'))"


_GROUPS = """gr AS (SELECT subject, predicate, source_book, source_chapter, count(DISTINCT object) AS objects, count(*) AS n, array_to_string(list_sort(list(DISTINCT object))[1:5], '|') AS answers FROM f WHERE subject <> '' AND predicate <> '' GROUP BY ALL),
gs AS (SELECT *, ('0x' || substring(sha1(subject), 1, 12))::BIGINT % 10 AS h FROM gr)"""
_BM5 = bm25(5, "doc_id", "documents", light("text"), "items", light("query"))
_J = "coalesce(CASE WHEN {0} <> '' THEN from_json({0}, '[\"VARCHAR\"]') END, [])"
_UNIQ = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def _share(a: str, b: str) -> str:
    return f"coalesce(len(list_distinct(list_intersect({a}, {b})))::DOUBLE / nullif(len(list_distinct({b})) + len(list_distinct(list_filter({a}, lambda x: NOT list_contains({b}, x)))), 0), 0)"


_REPORT = "rp AS (SELECT record_id, coalesce(length(answer) > 30, false) AS ok, concat_ws(':', question_type, bucket) AS issue, answer FROM qa_records)"
_LOG = "lg AS (SELECT user_id % 50 AS job, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'token' WHEN 'click' THEN 'tool_start' WHEN 'purchase' THEN 'tool_end' WHEN 'signup' THEN 'route' WHEN 'error' THEN 'note' ELSE 'done' END AS kind, event_id::VARCHAR AS text, 't' || (event_id % 4) AS name FROM events)"
_READ = "(trim(source_chapter) <> '' AND trim(source_chapter) <> source_book AND NOT regexp_matches(trim(source_chapter), '^[0-9_\\-]+$') AND NOT regexp_matches(trim(source_chapter), '^(chunk|part|section)[-_0-9]*$'))"

SQL = {
    "provider_rotation": "SELECT sequence, CASE WHEN sequence % 4 = 3 THEN 'two' ELSE 'one' END AS provider FROM chunk_tasks",
    "benchmark_candidates": f"WITH {CF} SELECT row_id FROM f WHERE {_name('subject')} AND {_name('object')} AND subject <> object AND source_book <> '' AND coalesce(best_confidence, 0) >= 0.9 AND {_clean('best_source_text', 10, 160, 0.5, chr(91) + r'\[\]{}<>|\\' + chr(93))} AND contains(best_source_text, object)",
    "question_groups": f"WITH {CF}, {_GROUPS} SELECT * EXCLUDE (h), CASE WHEN h = 0 THEN 'debug' WHEN h <= 2 THEN 'dev' ELSE 'test' END AS split FROM gs",
    "case_pairs": f"""WITH {CF}, {_GROUPS}, k AS (SELECT *, concat_ws('|', subject, predicate, source_book, source_chapter) AS k FROM gr)
SELECT k, 'answer' AS family, subject || '的' || predicate || '有哪些？' AS question, answers AS expected FROM k UNION ALL SELECT k, 'source', subject || '的' || predicate || '见于何书何篇？', source_book || '/' || source_chapter FROM k""",
    "regraded_hits": f"""WITH {_ITEMS}, {_BM5}, cs AS (SELECT item_id AS qid, CASE WHEN item_id % 40 = 0 THEN 'source' ELSE 'answer' END AS family, substring(question_text, 1, 2) AS sj, substring(passage, 2, 5) AS aw FROM eval_items WHERE item_id % 20 = 0),
m AS (SELECT cs.qid, family, place, contains(coalesce(text, ''), sj) AS s, contains(coalesce(text, ''), aw) AS a, contains({trim('book_name')}, '云岭方录') OR contains({trim('book_name')}, '澄湖') AS b FROM cs LEFT JOIN (SELECT * FROM b WHERE place <= 3) h USING (qid) LEFT JOIN documents USING (doc_id)),
g AS (SELECT qid, family, """
    + ", ".join(f"coalesce(bool_or({v}) FILTER ({'place = 1' if t == 'top1' else 'place IS NOT NULL'}), false) AS {t}_{n}" for t in ("top1", "topk") for n, v in (("subject", "s"), ("answer", "a"), ("book", "b")))
    + " FROM m GROUP BY qid, family) SELECT *, top1_subject AND (family = 'source' OR top1_answer) AS top1_success, topk_subject AND (family = 'source' OR topk_answer) AS topk_success FROM g",
    "route_confusion": """WITH c AS (SELECT bucket, question_type, count(*) AS n FROM qa_records GROUP BY ALL)
SELECT *, round(sum(CASE WHEN bucket IS NOT DISTINCT FROM question_type THEN n ELSE 0 END) OVER (PARTITION BY bucket) / sum(n) OVER (PARTITION BY bucket), 6)::DOUBLE AS accuracy FROM c""",
    "task_scores": f"""WITH t AS (SELECT record_id AS "case", {_J.format('symptom_text')} AS a, list_filter([chief_complaint, tongue], lambda x: x IS NOT NULL) AS ga, {_J.format('syndrome_text')} AS b, {_J.format('formula_text')} AS c FROM case_records),
s AS (SELECT "case", CASE WHEN len(a) > 0 THEN {_share('a', 'ga')} ELSE 0 END AS x, CASE WHEN len(b) > 0 THEN {_share('b', 'b')} ELSE 0 END AS y, CASE WHEN len(c) > 0 THEN {_share('c', "list_concat(c, ['加味'])")} ELSE 0 END AS z FROM t)
SELECT "case", round(x, 6) AS score_a, round(y, 6) AS score_b, round(z, 6) AS score_c, 0.0::DOUBLE AS score_d, round(0.2::DOUBLE * x + 0.3::DOUBLE * y + 0.4::DOUBLE * z, 6) AS score FROM s""",
    "section_scores": f"""WITH {_ITEMS}, {_BM5}, m AS (SELECT qid, place, ({trim('book_name')} = '云岭方录')::INT AS r, (chapter_title IS NOT NULL)::INT AS c, len(list_filter([substring(query, 1, 2), substring(query, 3, 2), '脉'], lambda w: contains(coalesce(text, ''), w))) AS n FROM items LEFT JOIN (SELECT * FROM b WHERE place <= 3) h USING (qid) LEFT JOIN documents USING (doc_id)),
g AS (SELECT qid, coalesce(max(r) FILTER (place = 1), 0) AS book_1, coalesce(max(r) FILTER (place IS NOT NULL), 0) AS book_3, coalesce(max(c) FILTER (place = 1), 0) AS section_1, coalesce(max(c) FILTER (place IS NOT NULL), 0) AS section_3, coalesce(max(n) FILTER (place = 1), 0)::INT AS words_1, coalesce(max(n), 0)::INT AS words_3 FROM m GROUP BY qid)
SELECT *, round(1.5::DOUBLE * book_1 + book_3 + section_1 + 0.5::DOUBLE * section_3 + 0.75::DOUBLE * least(words_1, 4) + 0.5::DOUBLE * least(words_3, 4), 2) AS score FROM g""",
    "answer_scores": f"""SELECT record_id, round(CASE WHEN length(trim(coalesce(answer, ''))) >= 300 THEN 2.0::DOUBLE WHEN length(trim(coalesce(answer, ''))) >= 120 THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN collection = 'qa_main' OR list_contains({_J.format('formula_text')}, 'qa_main') THEN 1.5::DOUBLE ELSE 0 END
  + 0.75::DOUBLE * len(list_filter(['日', '水煎', '服'], lambda w: contains(coalesce(answer, ''), w))) - CASE WHEN question_type = 'taboo' THEN 0.5::DOUBLE ELSE 0 END, 2) AS score FROM qa_records""",
    "path_quality": GRAPH["shortest_paths"].rsplit("\nSELECT", 1)[0]
    + """, pa AS (SELECT qid, path FROM b QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) <= 5), pn AS (SELECT qid, flatten(list(string_split(path, '->'))) AS nodes FROM pa GROUP BY qid)
SELECT qid, CASE WHEN qid % 60 = 0 THEN nodes IS NOT NULL WHEN qid % 40 = 0 THEN coalesce(list_contains(nodes, finish), false) ELSE coalesce(list_contains(nodes, '无名'), false) END AS ok FROM pairs LEFT JOIN pn USING (qid)""",
    "condition_summary": "SELECT source_book, count(*) AS cases, count(*) FILTER (confidence >= 0.8) AS passed, round(avg(confidence), 4) AS mean_ms, round(avg((evidence_id % 3 = 0 OR contains(lower(coalesce(source_chapter, '')), 'fallback'))::INT), 6) AS fallback_rate FROM evidence GROUP BY source_book",
    "category_summary": """WITH q AS (SELECT coalesce(bucket, '') AS bucket, coalesce(question_type, '') AS question_type, length(answer) > 20 AS ok FROM qa_records)
SELECT bucket, question_type, count(*) AS cases, count(*) FILTER (ok) AS passed, round(avg(coalesce(ok, false)::INT), 4) AS rate, grouping(bucket, question_type) AS level FROM q GROUP BY CUBE (bucket, question_type)""",
    "rerun_jobs": f"WITH {_REPORT} SELECT * FROM rp WHERE NOT ok AND (starts_with(issue, 'usage') OR starts_with(issue, 'taboo:')) ORDER BY record_id LIMIT 25",
    "merged_reports": "SELECT user_id, event_type, round(arg_max(value, {'t': ts, 'e': event_id}), 4) AS value, count(*) AS runs FROM events GROUP BY ALL",
    "open_slots": f"WITH {_REPORT} SELECT record_id FROM rp WHERE record_id NOT IN (SELECT record_id FROM rp WHERE ok AND trim(coalesce(answer, '')) <> '')",
    "probe_summary": "SELECT source_book, count(*) FILTER (confidence > 0.7) AS ok, round(avg(coalesce(confidence, 0)), 4) AS mean_ms FROM evidence GROUP BY source_book",
    "frozen_run": "SELECT record_id, bucket, length(coalesce(answer, '')) AS answer_len, md5(coalesce(answer, '')) AS digest, substring(coalesce(answer, ''), 1, 20) AS start FROM qa_records",
    "chunk_outcomes": f"SELECT {trim('source_chapter')} AS chapter, CASE WHEN count(*) FILTER (confidence IS NULL) > 1 THEN 'timeout' WHEN count(*) FILTER ({trim('source_text')} <> '') < 3 THEN 'low_yield' ELSE 'ok' END AS outcome FROM triple_records GROUP BY 1",
    "run_replay": f"""WITH {CF}, r AS (SELECT source_book AS run, max(extracted_at) AS p FROM f GROUP BY 1), c AS (SELECT * FROM r WHERE (p <= TIMESTAMP '2025-05-30' OR run = '云岭方录') AND run <> '荷滩妇笺')
SELECT subject, predicate, object, run, row_id AS line, count(*) OVER (PARTITION BY subject, predicate, object) AS deliveries FROM f JOIN c ON run = source_book QUALIFY row_number() OVER (PARTITION BY subject, predicate, object ORDER BY coalesce(p, TIMESTAMP '9999-01-01'), run, row_id) = 1""",
    "best_attempts": f"""WITH a AS (SELECT {trim('source_book')} AS book, (triple_id % 3)::INT AS attempt, list(triple_id ORDER BY triple_id) AS r FROM triple_records WHERE source_text IS NOT NULL GROUP BY ALL)
SELECT book, attempt, len(r) AS n, array_to_string(r, '|') AS rows, count(*) OVER (PARTITION BY book) AS tried FROM a QUALIFY row_number() OVER (PARTITION BY book ORDER BY len(r) DESC, attempt) = 1""",
    "pending_batches": "WITH r AS (SELECT DISTINCT sequence, substring(md5(sequence::VARCHAR), 1, 2) AS p FROM chunk_tasks WHERE sequence % 3 <> 0) SELECT sequence, p || '-' || ((row_number() OVER (PARTITION BY p ORDER BY sequence) - 1) // 2) AS batch FROM r",
    "log_tail": f"WITH {_LOG}, n AS (SELECT job, seq, max(seq) OVER (PARTITION BY job) + 1 AS next FROM lg) SELECT * FROM n WHERE seq >= 9 * job + 5000",
    "folded_messages": f"""WITH {_LOG}, g AS (SELECT job, coalesce(string_agg(text, '' ORDER BY ts, seq) FILTER (kind = 'token'), '') AS content, list_sort(coalesce(list(DISTINCT name) FILTER (kind IN ('tool_start', 'tool_end')), [])) AS tl, coalesce(list(DISTINCT name) FILTER (kind = 'tool_end'), []) AS te,
  coalesce(array_to_string(list_sort(list(DISTINCT text) FILTER (kind = 'note')), '|'), '') AS notes, arg_max(text, {{'t': ts, 's': seq}}) FILTER (kind = 'route') AS route, arg_max(text, {{'t': ts, 's': seq}}) FILTER (kind = 'done') AS done FROM lg GROUP BY job)
SELECT job, md5(CASE WHEN content = '' THEN coalesce(done, '') ELSE content END) AS content, array_to_string(tl, '|') AS tools, array_to_string(list_filter(tl, lambda x: NOT list_contains(te, x)), '|') AS open_tools, notes, route FROM g""",
    "compressed_history": f"WITH {_LOG}, t AS (SELECT job, row_number() OVER (PARTITION BY job ORDER BY ts, seq) AS turn FROM lg) SELECT job, CASE WHEN turn <= 10 THEN 'archived' ELSE 'kept' END AS part, count(*) AS n, max(turn) AS last FROM t GROUP BY ALL",
    "session_page": f"WITH {_LOG} SELECT job, count(*) AS messages, max(ts) AS updated_at FROM lg GROUP BY job ORDER BY updated_at DESC, job LIMIT 15 OFFSET 15",
    "artifact_preview": "SELECT triple_id FROM triple_records ORDER BY triple_id LIMIT 100",
    "run_summary": f"""WITH {CF}, a AS (SELECT source_book AS run, count(*) AS rows, count(DISTINCT subject || '|' || predicate || '|' || object) AS facts FROM f GROUP BY 1),
b AS (SELECT {trim('source_book')} AS run, arg_max(CASE WHEN confidence > 0.8 THEN 'done' ELSE 'partial' END, evidence_id) AS state FROM evidence GROUP BY 1)
SELECT run, coalesce(rows, 0) AS rows, coalesce(facts, 0) AS facts, coalesce(state, 'unknown') AS state FROM a FULL JOIN b USING (run)""",
    "review_list": f"""WITH {CF}, c AS (SELECT predicate, count(*) AS n, count(DISTINCT object_type) AS kinds, CASE WHEN length(predicate) > 3 THEN 'manual_review' ELSE 'rename' END AS action FROM f GROUP BY predicate),
p AS (SELECT *, CASE WHEN action = 'manual_review' OR kinds > 4 THEN 0 ELSE 1 END AS part FROM c) SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, predicate) AS place FROM p""",
    "recommended_books": """WITH b AS (SELECT book_name AS book, sum(length(coalesce(text, '')))::BIGINT AS chars, count(DISTINCT chapter_title) AS sections, count(*) AS mentions FROM documents WHERE trim(book_name) <> '' GROUP BY 1)
SELECT *, round(3.0::DOUBLE * ln(1 + mentions) + ln(1 + sections) + least(chars / 400000.0::DOUBLE, 1.0), 6) AS score FROM b ORDER BY score DESC, book LIMIT 12""",
    "evidence_paths": f"""WITH {CF}, p AS (SELECT row_id, subject, object, predicate, source_book, CASE WHEN source_book = '' THEN NULL WHEN {_READ} THEN 'chapter://' || source_book || '/' || trim(source_chapter) ELSE 'book://' || source_book END AS cp FROM f),
q AS (SELECT *, list_filter(['entity://' || subject, CASE WHEN starts_with(cp, 'chapter') THEN cp END, 'book://' || source_book, CASE WHEN NOT starts_with(cp, 'chapter') AND cp <> 'book://' || source_book THEN cp END, 'qa://' || predicate, 'zz://' || object], lambda x: x IS NOT NULL) AS l FROM p)
SELECT row_id, array_to_string(l, '|') AS paths, CASE WHEN starts_with(cp, 'chapter') THEN cp ELSE 'book://' || source_book END AS best, true AS near FROM q""",
    "ranked_intents": """WITH q AS (SELECT record_id, length(coalesce(answer, '')) AS n FROM qa_records), i AS (SELECT record_id, unnest([{'i': 'path', 's': n % 3, 'p': 2}, {'i': 'lookup', 's': n % 2, 'p': 1}, {'i': 'source', 's': n % 3, 'p': 0}, {'i': 'other', 's': n % 4, 'p': 3}]) AS x FROM q)
SELECT record_id, string_agg(x.i, '|' ORDER BY x.s DESC, x.p) AS intents FROM i GROUP BY record_id""",
    "case_citations": f"""WITH c AS (SELECT *, list_filter(['书一', trim(concat_ws(' ', coalesce(collection, ''), substring(coalesce(answer, ''), 1, 10))), trim(concat_ws(' ', coalesce(tongue, ''), substring(coalesce(question, ''), 1, 10)))], lambda x: x <> '') AS l, {_J.format('symptom_text')} AS sy FROM case_records)
SELECT record_id, array_to_string({_UNIQ.format('l')}, '|') AS citations, array_to_string(list_transform(sy[1:2], lambda t: '见：' || t), '；') || chr(10) || substring(coalesce(answer, ''), 1, 12) AS summary, CASE WHEN len(sy) > 0 THEN 0 ELSE 20001 END AS code, CASE WHEN sex = '男' THEN 5 ELSE 3 END AS k FROM c""",
    "confidence_numbers": """WITH e AS (SELECT evidence_id, confidence, evidence_id % 7 AS d FROM evidence WHERE evidence_id % 5 = 0), r AS (SELECT *, ceil((9 - d) * 600 / nullif(d, 0)::DOUBLE)::BIGINT AS s FROM e)
SELECT evidence_id, CASE WHEN evidence_id % 3 = 0 THEN 0.7 WHEN evidence_id % 3 = 1 THEN 1.0 ELSE least(1, greatest(0, coalesce(confidence, 0.7))) END::DOUBLE AS confidence, CASE WHEN d <= 0 THEN 'unknown' ELSE printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) END AS left FROM r""".replace("AS left", 'AS "left"'),
}
