"""Driver queries of rule tables over facts and triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.text import norm
from kgloom.operators import governance as G
from kgloom.plans.evidence_queries import q_recover
from kgloom.plans.fact_queries import facts
from kgloom.plans.graph_queries import questions
from kgloom.plans.sqlparts import F as CF
from kgloom.plans.sqlparts import trim
from kgloom.plans.text_queries import TIERS, triples
from kgloom.session import table

#: Own rule tables of the queries.
FAMILIES = [("使用药材", None, "composition", None, False), ("推荐方剂", None, None, "治疗证候", False), ("治疗证候", None, None, "治疗疾病", False), ("治疗疾病", None, "therapy", None, False), ("常见症状", "症状", "manifestation", None, False), ("别名", None, None, None, True), ("功效", None, None, "功效", False)]
RULES = [(1, "别名", None, None, None, True, "delete", None, None, None), (2, None, None, "book", None, None, "delete", None, None, None), (3, "使用药材", None, "category", None, None, "rewrite", None, None, "herb"), (4, "推荐方剂", "syndrome", None, None, None, "rewrite", "治疗证候", None, None)]
ALLOWED, SUFFIXES = ["formula", "herb", "syndrome", "symptom", "disease"], [("汤", "formula"), ("散", "formula"), ("丸", "formula"), ("证", "syndrome"), ("病", "disease"), ("草", "herb")]
BOOKS, PROPERTIES, PROCESSING = ["云岭方录", "荷滩妇笺"], ["辛温", "甘平"], ["炒", "炙", "蒸"]
FRONT, ENDINGS = ["凡例", "自序", "目录"], ["汤", "散", "丸", "饮"]


def rules_of(s: SparkSession) -> DataFrame:
    return s.createDataFrame(RULES, "ord int, predicate string, subject_type string, object_type string, object string, same boolean, action string, new_predicate string, new_subject_type string, new_object_type string")


def families_of(s: SparkSession) -> DataFrame:
    return G.families(s.createDataFrame(FAMILIES, "predicate string, normalized string, family string, parent string, symmetric boolean"))


def governed(s: SparkSession, d: str) -> DataFrame:
    return G.governed(facts(s, d), rules_of(s))


def q_types(s: SparkSession, d: str) -> DataFrame:
    t = triples(s, d)
    kind = G.inferred_type(norm("subject"), G.mapped(F.col("raw_subject_type"), {"药材": "herb", "方剂": "formula"}), allowed=ALLOWED, books=BOOKS, properties=PROPERTIES, processing=PROCESSING, suffixes=SUFFIXES)
    return t.select("triple_id", kind.alias("kind"))


def q_annotated(s: SparkSession, d: str) -> DataFrame:
    tiers = s.createDataFrame(TIERS, "ord int, predicate string, subject_type string, object_type string, tier string")
    return G.annotated(facts(s, d), families_of(s), tiers).select("row_id", "normalized", "family", "symmetric", "chapter", "tier")


def q_permitted(s: SparkSession, d: str) -> DataFrame:
    return G.permitted(facts(s, d), families_of(s), ["@therapy", "composition", "别名"], ["推荐方剂"]).select("row_id", "predicate")


def q_hinted(s: SparkSession, d: str) -> DataFrame:
    asked = questions(s, d).select("qid", F.concat_ws(" ", "text", F.when(F.col("text").contains("治"), "therapy"), F.when(F.col("text").contains("药"), "使用药材")).alias("text"))
    return G.hinted(asked, families_of(s))


def q_governed(s: SparkSession, d: str) -> DataFrame:
    return governed(s, d).filter("action != 'keep'").select("row_id", "action", "was_predicate", "predicate", "subject_type", "object_type")


def q_dropped(s: SparkSession, d: str) -> DataFrame:
    return G.dropped_evidence(governed(s, d), table(s, d, "evidence").withColumn("fact_id", norm("fact_id"))).select("evidence_id")


def q_plan(s: SparkSession, d: str) -> DataFrame:
    return G.patch_plan(governed(s, d))


def q_dirty(s: SparkSession, d: str) -> DataFrame:
    f = facts(s, d)
    targets = f.filter("object_type in ('herb', 'syndrome') and subject_type != ''").select("predicate", "subject_type", "object_type")
    return G.dirty_export(f, targets, 4, 5)


def q_disputes(s: SparkSession, d: str) -> DataFrame:
    return G.disputes(facts(s, d))


def q_quality(s: SparkSession, d: str) -> DataFrame:
    return triples(s, d).select("triple_id", G.clean_name(F.col("subject")).alias("subject_ok"), G.clean_name(F.col("object")).alias("object_ok"), G.clean_source(F.col("source_text")).alias("source_ok"))


def q_chunks(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "chunk_tasks")
    return t.select("sequence", G.accepted_empty(F.col("chapter_name"), F.col("text_chunk"), ENDINGS, FRONT).alias("may_be_empty"), G.wanted_title(F.col("chapter_name"), ["卷", "方"], ["序"]).alias("wanted"), G.under_paths(F.col("book_path"), ["books/", "/data"]).alias("under"))


def q_selected(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "chunk_tasks").groupBy("book_name").agg(F.min("sequence").alias("first"))
    listed = names.select("book_name", F.expr("row_number() over (order by first)").alias("ordinal"))  # one row a book
    return G.selected_books(listed, ["3", "方", "1", " "])


def q_yield(s: SparkSession, d: str) -> DataFrame:
    """Blocks of a chunk: the recovered triples of ten triple ids each, one block a source book."""
    got = q_recover(s, d).join(triples(s, d).select("triple_id", norm("source_book").alias("book")), "triple_id")
    blocks = got.groupBy(F.floor(F.col("triple_id") / 10).cast("long").alias("chunk"), F.col("book").alias("block")).agg(F.count("*").alias("n"))
    return G.yield_diagnosis(blocks)


QUERIES = {
    "inferred_types": q_types,
    "annotated_relations": q_annotated,
    "permitted_relations": q_permitted,
    "hinted_predicates": q_hinted,
    "governed_rows": q_governed,
    "governed_evidence": q_dropped,
    "patch_plan": q_plan,
    "dirty_export": q_dirty,
    "predicate_disputes": q_disputes,
    "name_quality": q_quality,
    "chunk_acceptance": q_chunks,
    "selected_books": q_selected,
    "yield_diagnosis": q_yield,
}


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") t({names})"


_FAM = f"""fr AS (SELECT * FROM {_values(FAMILIES, 'predicate, normalized, family, parent, mirrored')}),
up AS (SELECT predicate, parent AS at, 1 AS n FROM fr WHERE family IS NULL UNION ALL SELECT up.predicate, fr.parent, n + 1 FROM up JOIN fr ON fr.predicate = up.at WHERE fr.family IS NULL AND n < 20),
fam AS (SELECT fr.predicate, coalesce(normalized, fr.predicate) AS normalized, coalesce(family, (SELECT any_value(g.family) FROM up JOIN fr g ON g.predicate = up.at WHERE up.predicate = fr.predicate AND g.family IS NOT NULL)) AS family, mirrored FROM fr),
mem AS (SELECT DISTINCT predicate, token FROM (SELECT predicate, predicate AS token FROM fam UNION ALL SELECT predicate, normalized FROM fam UNION ALL SELECT predicate, family FROM fam) WHERE token IS NOT NULL)"""
_TIER = "CASE " + " ".join(f"WHEN {' AND '.join(f'{c} = {v!r}' for c, v in zip(('predicate', 'subject_type', 'object_type'), r[1:4], strict=True) if v is not None)} THEN '{r[4]}'" for r in TIERS) + " ELSE 'review_needed' END"
_CHAP = r"CASE WHEN trim(source_chapter) = '' OR trim(source_chapter) = source_book THEN '' WHEN source_book <> '' AND starts_with(trim(source_chapter), source_book) THEN regexp_replace(substring(trim(source_chapter), length(source_book) + 1), '^[\s·:：/_\-—]+', '') ELSE trim(source_chapter) END"
_GOV = f"""r AS (SELECT * FROM {_values(RULES, 'ord, r_predicate, r_st, r_ot, r_object, same, action, np, ns, no')}),
g AS (SELECT row_id, min_by(r, r.ord) AS r FROM f JOIN r ON (r_predicate IS NULL OR r_predicate = predicate) AND (r_st IS NULL OR r_st = subject_type) AND (r_ot IS NULL OR r_ot = object_type) AND (NOT coalesce(same, false) OR predicate = object) GROUP BY row_id),
m AS (SELECT f.row_id, coalesce(r.action, 'keep') AS action, predicate AS was_predicate, coalesce(r.np, predicate) AS predicate, coalesce(r.ns, subject_type) AS subject_type, coalesce(r.no, object_type) AS object_type, ids FROM f LEFT JOIN g USING (row_id))"""
_Q = "q AS (SELECT record_id AS qid, min(coalesce(question, '')) AS text FROM qa_records WHERE CAST(right(record_id, 7) AS INT) % 20 = 0 GROUP BY record_id)"
_KIND = "CASE coalesce(raw_subject_type, '') WHEN '药材' THEN 'herb' WHEN '方剂' THEN 'formula' ELSE coalesce(raw_subject_type, '') END"
_CLEAN = r"(length({x}) BETWEEN {a} AND {b} AND length(regexp_replace({x}, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) >= {s} * length({x}) AND NOT regexp_matches({x}, '{bad}'){more})"


def _clean(x: str, a: int, b: int, share: float, bad: str, more: str = "") -> str:
    x = f"trim(coalesce({x}, ''))"
    return _CLEAN.format(x=x, a=a, b=b, s=share, bad=bad, more=f" AND NOT ends_with({x}, '{more}')" if more else "")


def _any(x: str, words: list[str], f: str = "contains") -> str:
    return "(" + " OR ".join(f"{f}({x}, '{w}')" for w in words) + ")"


SQL = {
    "inferred_types": f"""WITH t AS (SELECT triple_id, {trim('subject')} AS v, {_KIND} AS raw FROM triple_records)
SELECT triple_id, CASE WHEN raw IN {tuple(ALLOWED)} THEN raw WHEN v IN {tuple(BOOKS)} THEN 'book' WHEN v IN {tuple(PROPERTIES)} THEN 'property' WHEN {_any('v', PROCESSING)} THEN 'processing_method' {' '.join(f"WHEN ends_with(v, '{s}') THEN '{k}'" for s, k in SUFFIXES)} ELSE 'other' END AS kind FROM t""",
    "annotated_relations": f"WITH RECURSIVE {CF}, {_FAM} SELECT row_id, coalesce(normalized, f.predicate) AS normalized, family, mirrored AS \"symmetric\", {_CHAP} AS chapter, {_TIER.replace('predicate =', 'f.predicate =')} AS tier FROM f LEFT JOIN fam ON fam.predicate = f.predicate",
    "permitted_relations": f"WITH RECURSIVE {CF}, {_FAM} SELECT row_id, predicate FROM f WHERE (predicate IN (SELECT predicate FROM mem WHERE token IN ('therapy', 'composition', '别名')) OR predicate = '别名') AND predicate NOT IN (SELECT predicate FROM mem WHERE token = '推荐方剂') AND predicate <> '推荐方剂'",
    "hinted_predicates": f"WITH RECURSIVE {_FAM}, {_Q}, a AS (SELECT qid, concat_ws(' ', text, CASE WHEN contains(text, '治') THEN 'therapy' END, CASE WHEN contains(text, '药') THEN '使用药材' END) AS text FROM q) SELECT DISTINCT qid, predicate FROM a JOIN mem ON contains(text, token) AND length(token) >= 2",
    "governed_rows": f"WITH {CF}, {_GOV} SELECT row_id, action, was_predicate, predicate, subject_type, object_type FROM m WHERE action <> 'keep'",
    "governed_evidence": f"""WITH {CF}, {_GOV}, d AS (SELECT DISTINCT unnest(ids) AS id FROM m WHERE action = 'delete'), k AS (SELECT DISTINCT unnest(ids) AS id FROM m WHERE action <> 'delete')
SELECT evidence_id FROM evidence WHERE {trim('fact_id')} IN (SELECT id FROM d ANTI JOIN k USING (id))""",
    "patch_plan": f"WITH {CF}, {_GOV} SELECT action, was_predicate, count(*) AS n, array_to_string(list_sort(list(DISTINCT predicate)), '|') AS proposed, array_to_string(list_sort(list(row_id))[1:3], '|') AS rows FROM m GROUP BY ALL",
    "dirty_export": f"""WITH {CF}, h AS (SELECT * FROM f WHERE object_type IN ('herb', 'syndrome') AND subject_type <> ''),
b AS (SELECT predicate, subject_type, object_type, source_book, count(*) AS m FROM h GROUP BY ALL),
k AS (SELECT predicate, subject_type, object_type, string_agg(source_book || ':' || m, '|' ORDER BY m DESC, source_book) AS books FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY predicate, subject_type, object_type ORDER BY m DESC, source_book) <= 4) GROUP BY ALL),
e AS (SELECT predicate, subject_type, object_type, string_agg(row_id, '|' ORDER BY best_confidence DESC NULLS LAST, row_id) AS rows FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY predicate, subject_type, object_type ORDER BY best_confidence DESC NULLS LAST, row_id) <= 5) GROUP BY ALL)
SELECT * FROM (SELECT predicate, subject_type, object_type, count(*) AS n FROM h GROUP BY ALL) JOIN k USING (predicate, subject_type, object_type) JOIN e USING (predicate, subject_type, object_type)""",
    "predicate_disputes": f"""WITH {CF}, o AS (SELECT predicate, object, count(*) AS m FROM f GROUP BY ALL),
l AS (SELECT predicate, string_agg(object, '|' ORDER BY m DESC, object) AS objects FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY predicate ORDER BY m DESC, object) <= 5) GROUP BY predicate)
SELECT * FROM (SELECT predicate, count(*) AS n, count(*) FILTER (object = predicate) AS repeating, count(DISTINCT (subject_type, object_type)) AS type_pairs FROM f GROUP BY predicate) JOIN l USING (predicate)""",
    "name_quality": "SELECT triple_id, "
    + ", ".join(f"{_clean(c, 2, 24, 0.45, r'[\[\]{}<>|\\/，。；：！？\n\t]', '方论')} AS {n}" for c, n in (("subject", "subject_ok"), ("object", "object_ok")))
    + f", {_clean('source_text', 10, 160, 0.5, r'[\[\]{}<>|\\]')} AS source_ok FROM triple_records",
    "chunk_acceptance": f"""SELECT sequence, NOT {_any("coalesce(chapter_name, '')", ENDINGS, 'ends_with')} AND {_any("substring(coalesce(text_chunk, ''), 1, 1200)", FRONT)} AS may_be_empty,
{_any("coalesce(chapter_name, '')", ['卷', '方'])} AND NOT contains(coalesce(chapter_name, ''), '序') AS wanted, {_any("coalesce(book_path, '')", ['books/', '/data'], 'starts_with')} AS under FROM chunk_tasks""",
    "selected_books": """WITH b AS (SELECT book_name, row_number() OVER (ORDER BY min(sequence)) AS ordinal FROM chunk_tasks GROUP BY book_name)
SELECT *, CASE WHEN ordinal = 3 THEN 1 WHEN contains(book_name, '方') THEN 2 ELSE 3 END AS selector FROM b WHERE ordinal IN (1, 3) OR contains(book_name, '方')""",
    "yield_diagnosis": f"""WITH b AS (SELECT triple_id // 10 AS chunk, {trim('source_book')} AS block, count(*) AS n FROM triple_records GROUP BY ALL),
p AS (SELECT chunk, count(block) AS blocks, arg_min(n, block) AS first, sum(n)::BIGINT AS total FROM b GROUP BY chunk)
SELECT *, CASE WHEN blocks = 0 THEN 'no_json' WHEN total > first THEN 'first_block_only' WHEN total >= 2 THEN 'fine' ELSE 'low_yield' END AS diagnosis FROM p""",
}
