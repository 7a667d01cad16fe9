"""Driver queries of text functions, rules, sections and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import tokens as T
from kgloom.functions.text import norm
from kgloom.operators import records as Q
from kgloom.operators import rules as U
from kgloom.operators import sections as S
from kgloom.plans.corpus_queries import LIGHT, light, tri
from kgloom.plans.fact_queries import facts
from kgloom.plans.sqlparts import F as CF
from kgloom.plans.sqlparts import trim
from kgloom.session import table

#: Own rule tables of the queries.
TIERS = [(1, "使用药材", "formula", "herb", "in_schema"), (2, "常见症状", "syndrome", "symptom", "in_schema"), (3, "别名", None, None, "polysemy"), (4, None, "herb", "syndrome", "likely_dirty"), (5, None, None, "book", "likely_dirty"), (6, "推荐方剂", None, "formula", "in_schema")]
KEYWORDS = ["化痰", "养血", "止咳", "和中", "清里", "温里", "燥湿", "通窍", "利水", "宁神"]
SUBSTRINGS = [("症", "symptom"), ("证", "syndrome"), ("方", "formula"), ("药", "herb"), ("法", "therapy")]


def triples(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "triple_records")


def documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def q_labels(s: SparkSession, d: str) -> DataFrame:
    t = documents(s, d)
    return t.select("doc_id", T.book_label("book_name").alias("book"), T.chapter_label(F.coalesce("book_name", F.lit("")), F.col("chapter_title")).alias("chapter"), T.snippet("text", 40).alias("snippet"), T.safe_name(F.coalesce("chapter_title", F.lit(""))).alias("file"))


def q_tokens(s: SparkSession, d: str) -> DataFrame:
    t = documents(s, d)
    return t.select("doc_id", F.size(T.light_tokens("text")).alias("tokens"), F.size(T.distinct_tokens("text")).alias("distinct_tokens"), F.size(T.trigrams("text")).alias("trigrams"))


def q_terms(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "eval_items")
    return q.select("item_id", F.array_join(T.probe_terms("question_text"), "|").alias("probes"), F.array_join(T.fragments("question_text"), "|").alias("fragments"), T.loose("question_text").alias("loose"))


def q_pairs(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "eval_items")
    return q.select("item_id", F.array_join(T.adjacent_pairs(F.split(F.lower(F.coalesce("question_text", F.lit(""))), " "), 3, 12), "|").alias("pairs"))


def q_jaccard(s: SparkSession, d: str) -> DataFrame:
    """Token similarity of question and answer of each record."""
    q = table(s, d, "qa_records")
    return q.select("record_id", F.round(T.jaccard(T.distinct_tokens("question"), T.distinct_tokens("answer")), 6).alias("similarity"))


def q_clean(s: SparkSession, d: str) -> DataFrame:
    """Decision list with reason codes over triples, and the histogram of reasons."""
    t = triples(s, d)
    n = {c: norm(c) for c in ("subject", "predicate", "object", "source_text", "subject_type")}
    reason = U.decide(
        [
            ((n["subject"] == "") | (n["object"] == ""), "drop_missing_end"),
            (n["source_text"] == "", "drop_missing_source"),
            (n["subject"] == n["object"], "drop_self"),
            (n["predicate"] == "", "drop_missing_predicate"),
            (F.length(n["subject"]) > 24, "drop_long_name"),
            (F.col("confidence") < 0.5, "drop_low_confidence"),
            (n["subject_type"].isin("book", "chapter"), "drop_bibliographic"),
        ],
        "keep",
    )
    return t.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def q_predicates(s: SparkSession, d: str) -> DataFrame:
    """Predicates by exact name, else by the first substring rule."""
    value = F.coalesce("raw_predicate", F.lit(""))
    return triples(s, d).groupBy(U.first_substring_rule(value, {"uses herb": "herb"}, SUBSTRINGS).alias("mapped")).agg(F.count("*").alias("n"))


def tiered(s: SparkSession, d: str) -> DataFrame:
    rules = s.createDataFrame(TIERS, "ord int, predicate string, subject_type string, object_type string, tier string")
    return U.tier(facts(s, d), rules)


def q_tiers(s: SparkSession, d: str) -> DataFrame:
    return tiered(s, d).groupBy("predicate", "tier").agg(F.count("*").alias("n"))


def q_shortlist(s: SparkSession, d: str) -> DataFrame:
    """The most frequent combinations of one tier."""
    dirty = tiered(s, d).filter("tier = 'likely_dirty'").groupBy("predicate", "subject_type", "object_type").agg(F.count("*").alias("n"))
    return dirty.orderBy(F.desc("n"), "predicate", "subject_type", "object_type").limit(40)


def q_examples(s: SparkSession, d: str) -> DataFrame:
    got = U.top_examples(tiered(s, d), ["tier"], [F.desc_nulls_last("best_confidence"), F.col("row_id")], 6)
    return got.select("tier", "example", "row_id", "predicate")


def q_sample(s: SparkSession, d: str) -> DataFrame:
    got = U.diverse_sample(facts(s, d), ["predicate"], "source_book", [F.desc_nulls_last("best_confidence"), F.col("row_id")], 5)
    return got.select("predicate", "sample", "source_book", "row_id")


def q_profile(s: SparkSession, d: str) -> DataFrame:
    f = facts(s, d).withColumn("types", F.concat_ws("->", "subject_type", "object_type"))
    return U.profile(f, "predicate", "types", 10).select("predicate", "example", "types", "n", "group_size")


def q_noncanonical(s: SparkSession, d: str) -> DataFrame:
    """Predicates that are no canonical term."""
    terms = table(s, d, "canonical_terms").filter("term_kind = 'predicate'").select(F.col("term").alias("predicate"))
    return triples(s, d).select(F.coalesce("predicate", F.lit("")).alias("predicate")).join(terms, "predicate", "left_anti").groupBy("predicate").agg(F.count("*").alias("n"))


def q_pollution(s: SparkSession, d: str) -> DataFrame:
    """Chapters by class: empty, repeating the book, long, or plain."""
    f = facts(s, d)
    c = F.col("source_chapter")
    kind = U.decide([(c == "", "empty"), (c == F.col("source_book"), "repeats_book"), (F.length(c) >= 12, "long"), (c.rlike("^卷"), "volume")], "other")
    return f.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def q_lines(s: SparkSession, d: str) -> DataFrame:
    got = S.lines(table(s, d, "chunk_tasks"), "sequence", "text_chunk")
    return got.groupBy("sequence").agg(F.count("*").alias("lines"), F.max(F.length("line")).alias("longest"), F.count_if(F.col("line") == "").alias("blank"))


def q_sections(s: SparkSession, d: str) -> DataFrame:
    rows = S.lines(documents(s, d), "doc_id", "text")
    return S.sections(rows, "doc_id", F.col("line").rlike("^〔[^〕]+〕"))


def q_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return S.paragraphs(S.lines(table(s, d, "chunk_tasks"), "sequence", "text_chunk"), "sequence").select("sequence", "paragraph_no", "first_line", F.length("paragraph").alias("n_chars"), F.md5("paragraph").alias("digest"))


def q_chunks(s: SparkSession, d: str) -> DataFrame:
    return S.chunks(documents(s, d), "doc_id", "text")


def q_merged(s: SparkSession, d: str) -> DataFrame:
    """Chunks of every document put together again."""
    return S.merge_bodies(S.chunks(table(s, d, "chunk_tasks"), "sequence", "text_chunk", 400, 60), "sequence", "chunk_no", "chunk").select("sequence", "pieces", F.length("merged").alias("n_chars"))


def q_nodes(s: SparkSession, d: str) -> DataFrame:
    return S.section_nodes(documents(s, d).filter("book_name is not null"), ["book_name", "source"], "doc_id")


def q_topics(s: SparkSession, d: str) -> DataFrame:
    return S.top_terms(documents(s, d).filter("book_name is not null"), ["book_name"], "doc_id", KEYWORDS)


def q_floor(s: SparkSession, d: str) -> DataFrame:
    return S.similarity_floor(documents(s, d).filter("book_name is not null"), "book_name", "doc_id")


def q_navigation(s: SparkSession, d: str) -> DataFrame:
    return S.navigation_groups(documents(s, d).filter("book_name is not null"), "book_name", "doc_id").groupBy("book_name", "group_no").agg(F.count("*").alias("n"))


def q_slots(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "case_records")
    return c.select("record_id", *(v.alias(k) for k, v in Q.slots(F.coalesce("question", F.lit(""))).items()))


def q_buckets(s: SparkSession, d: str) -> DataFrame:
    """Question type by an ordered decision list."""
    q = F.coalesce("question", F.lit(""))
    kind = U.decide([(q.contains("出自"), "source"), (q.contains("禁忌"), "taboo"), (q.contains("取舍"), "compare"), (q.contains("哪些药"), "composition"), (q.contains("如何服用"), "usage"), (q.contains("可否"), "indication")], "other")
    return table(s, d, "qa_records").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("question_type", F.lit("")) == kind).alias("agrees"))


def q_terms_json(s: SparkSession, d: str) -> DataFrame:
    """Symptom terms of the cases from their JSON lists, counted."""
    c = table(s, d, "case_records")
    return c.select(F.explode(Q.json_terms("symptom_text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def q_search_text(s: SparkSession, d: str) -> DataFrame:
    """Labelled lines of a case, empty ones left out."""
    c = table(s, d, "case_records")
    line = lambda k: F.when(norm(k) != "", F.concat(F.lit(f"{k}: "), norm(k)))
    return c.select("record_id", F.md5(F.concat_ws("\n", *(line(k) for k in ("chief_complaint", "history", "tongue", "pulse", "sex")))).alias("digest"))


def q_exact(s: SparkSession, d: str) -> DataFrame:
    """First record of each exact pair, white space collapsed."""
    q = table(s, d, "qa_records").withColumn("h", Q.pair_hash("question", "answer"))
    return Q.first_of_each(q, ["h"], [F.col("record_id")]).groupBy("collection").agg(F.count("*").alias("kept"))


def q_eav(s: SparkSession, d: str) -> DataFrame:
    cols = ["collection", "age", "sex", "tongue", "pulse"]
    return Q.from_eav(Q.to_eav(table(s, d, "case_records"), "record_id", cols), "record_id", cols)


def q_probe(s: SparkSession, d: str) -> DataFrame:
    terms = s.createDataFrame([(w,) for w in KEYWORDS], "term string")
    return Q.shard_probe(table(s, d, "qa_records"), "collection", F.concat_ws("\n", "question", "answer"), terms)


def q_interleave(s: SparkSession, d: str) -> DataFrame:
    return Q.interleave(table(s, d, "chunk_tasks"), "book_name", "sequence")


def q_schedule(s: SparkSession, d: str) -> DataFrame:
    return Q.schedule(table(s, d, "chunk_tasks"), "book_name", "sequence", 1, 5).select("book_name", "sequence", "n")


def q_token_counts(s: SparkSession, d: str) -> DataFrame:
    return Q.token_counts(documents(s, d), "source", T.light_tokens("text"))


def q_required(s: SparkSession, d: str) -> DataFrame:
    return Q.required(triples(s, d), ["subject", "predicate", "object", "source_text"]).select("triple_id")


def q_ids(s: SparkSession, d: str) -> DataFrame:
    """Vertex ids, edge ranks and cleaning ids by sha1."""
    f = facts(s, d)
    parts = F.concat_ws("||", "subject", "predicate", "object", "source_book", "source_chapter")
    rank = F.conv(F.substring(F.sha1(F.when(F.col("fact_id") != "", F.col("fact_id")).otherwise(parts)), 1, 15), 16, 10).cast("long")
    return f.select("row_id", F.concat(F.lit("ent_"), F.sha1("subject")).alias("vid"), rank.alias("edge_rank"), F.substring(F.sha1(parts), 1, 16).alias("clean_id"))


def q_keys(s: SparkSession, d: str) -> DataFrame:
    """Triples by their normalised key."""
    return triples(s, d).groupBy(T.triple_key("subject", "raw_predicate", "object").alias("k")).agg(F.count("*").alias("n"), F.min("triple_id").alias("first"))


QUERIES = {
    "triple_keys": q_keys,
    "document_labels": q_labels,
    "token_statistics": q_tokens,
    "probe_terms": q_terms,
    "adjacent_terms": q_pairs,
    "pair_similarity": q_jaccard,
    "triple_cleaning": q_clean,
    "predicate_mapping": q_predicates,
    "boundary_tiers": q_tiers,
    "dirty_shortlist": q_shortlist,
    "tier_examples": q_examples,
    "diverse_sample": q_sample,
    "predicate_profile": q_profile,
    "noncanonical_predicates": q_noncanonical,
    "chapter_pollution": q_pollution,
    "chunk_lines": q_lines,
    "document_sections": q_sections,
    "wrapped_paragraphs": q_paragraphs,
    "text_chunks": q_chunks,
    "merged_bodies": q_merged,
    "section_nodes": q_nodes,
    "section_topics": q_topics,
    "similarity_floor": q_floor,
    "navigation_groups": q_navigation,
    "case_slots": q_slots,
    "question_buckets": q_buckets,
    "symptom_terms": q_terms_json,
    "case_search_text": q_search_text,
    "exact_pair_dedup": q_exact,
    "eav_pivot": q_eav,
    "shard_probe": q_probe,
    "interleave_tasks": q_interleave,
    "schedule_tasks": q_schedule,
    "source_tokens": q_token_counts,
    "required_fields": q_required,
    "graph_ids": q_ids,
}

_TIER = f"""WITH {CF}, rules(ord, p, st, ot, tier) AS (VALUES {', '.join('(' + ', '.join('NULL' if x is None else repr(x) for x in r) + ')' for r in TIERS)}),
t AS (SELECT f.*, coalesce((SELECT arg_min(tier, ord) FROM rules WHERE (p IS NULL OR p = predicate) AND (st IS NULL OR st = subject_type) AND (ot IS NULL OR ot = object_type)), 'review_needed') AS tier FROM f)"""
_MAPPED = f"CASE WHEN v = 'uses herb' THEN 'herb' {' '.join(f'WHEN contains(v, {k!r}) THEN {x!r}' for k, x in SUBSTRINGS)} ELSE v END"
_LINES = "l AS (SELECT {k}, generate_subscripts(x, 1) AS line_no, regexp_replace(unnest(x), '\\s+$', '') AS line FROM (SELECT {k}, regexp_split_to_array({t}, '\\r\\n|\\r|\\n') AS x FROM {d} WHERE {t} IS NOT NULL))"
_QTEXT = "coalesce(question, '')"


def _tok(x: str) -> str:
    return f"list_distinct({light(x)})"


_WS = r"[\s\x{00a0}\x{3000}]"


def _jac(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


_T = trim
_PUNCT = "translate(lower(coalesce({0}, '')), '，；：（）', ',;:()')"

SQL = {
    "triple_keys": "SELECT "
    + " || '|' || ".join(f"regexp_replace({_PUNCT.format(c)}, '[\\s\\x{{00a0}}\\x{{3000}}]+', '', 'g')" for c in ("subject", "raw_predicate", "object"))
    + " AS k, count(*) AS n, min(triple_id) AS first FROM triple_records GROUP BY 1",
    "document_labels": rf"""SELECT doc_id, regexp_replace(trim(coalesce(book_name, '')), '^[0-9]+\s*[-_－—]\s*', '') AS book,
CASE WHEN trim(coalesce(chapter_title, '')) = '' OR trim(chapter_title) = coalesce(book_name, '') THEN ''
  WHEN coalesce(book_name, '') <> '' AND starts_with(trim(chapter_title), book_name) THEN regexp_replace(substring(trim(chapter_title), length(book_name) + 1), '^[\s·:：/_\-—]+', '') ELSE trim(chapter_title) END AS chapter,
substring(regexp_replace(coalesce(text, ''), '^{_WS}+|{_WS}+$', '', 'g'), 1, 40) AS snippet, regexp_replace(coalesce(chapter_title, ''), '[^\p{{L}}\p{{N}}\p{{M}}_.\-]', '_', 'g') AS file FROM documents""",
    "token_statistics": f"SELECT doc_id, len({light('text')}) AS tokens, len(list_distinct({light('text')})) AS distinct_tokens, coalesce(len({tri('text')}), 0) AS trigrams FROM documents",
    "probe_terms": rf"""WITH r AS (SELECT item_id, coalesce(question_text, '') AS q, list_distinct(regexp_extract_all(lower(coalesce(question_text, '')), '[\x{{4e00}}-\x{{9fff}}]{{2,12}}|[a-z0-9]{{2,32}}')) AS runs FROM eval_items),
o AS (SELECT *, list_transform(list_sort(list_transform(runs, lambda x: {{'n': -length(x), 'r': x}}))[1:8], lambda x: x.r) AS best, regexp_replace(q, '{_WS}+', '', 'g') AS compact FROM r),
g AS (SELECT *, list_filter(regexp_split_to_array(q, '[，。；：？！、,.;:?!\s（）()《》“”]+'), lambda x: length(x) >= 2) AS fr FROM o)
SELECT item_id, coalesce(array_to_string(CASE WHEN len(best) > 0 THEN best WHEN compact <> '' THEN [compact[1:12]] ELSE [] END, '|'), '') AS probes,
  array_to_string(list_filter(fr, lambda x, i: list_position(fr, x) = i), '|') AS fragments, regexp_replace(lower(q), '[\s\p{{P}}\p{{S}}\x{{3000}}]+', '', 'g') AS loose FROM g""",
    "adjacent_terms": """WITH t AS (SELECT item_id, string_split(lower(coalesce(question_text, '')), ' ') AS t FROM eval_items),
p AS (SELECT item_id, list_transform(list_filter(list_transform(range(1, len(t)), lambda i: {'a': t[i], 'b': t[i + 1]}), lambda x: length(x.a || x.b) BETWEEN 3 AND 12 AND NOT regexp_full_match(x.a, '[0-9]+') AND NOT regexp_full_match(x.b, '[0-9]+')), lambda x: x.a || x.b) AS p FROM t)
SELECT item_id, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), '|') AS pairs FROM p""",
    "pair_similarity": f"SELECT record_id, round({_jac(_tok('question'), _tok('answer'))}, 6) AS similarity FROM qa_records",
    "triple_cleaning": f"""SELECT CASE WHEN {_T('subject')} = '' OR {_T('object')} = '' THEN 'drop_missing_end' WHEN {_T('source_text')} = '' THEN 'drop_missing_source' WHEN {_T('subject')} = {_T('object')} THEN 'drop_self'
WHEN {_T('predicate')} = '' THEN 'drop_missing_predicate' WHEN length({_T('subject')}) > 24 THEN 'drop_long_name' WHEN confidence < 0.5 THEN 'drop_low_confidence' WHEN {_T('subject_type')} IN ('book', 'chapter') THEN 'drop_bibliographic' ELSE 'keep' END AS reason, count(*) AS n FROM triple_records GROUP BY 1""",
    "predicate_mapping": f"SELECT {_MAPPED} AS mapped, count(*) AS n FROM (SELECT coalesce(raw_predicate, '') AS v FROM triple_records) GROUP BY 1",
    "boundary_tiers": f"{_TIER} SELECT predicate, tier, count(*) AS n FROM t GROUP BY ALL",
    "dirty_shortlist": f"{_TIER} SELECT predicate, subject_type, object_type, count(*) AS n FROM t WHERE tier = 'likely_dirty' GROUP BY ALL ORDER BY n DESC, predicate, subject_type, object_type LIMIT 40",
    "tier_examples": f"{_TIER} SELECT * FROM (SELECT tier, row_number() OVER (PARTITION BY tier ORDER BY best_confidence DESC NULLS LAST, row_id) AS example, row_id, predicate FROM t) WHERE example <= 6",
    "diverse_sample": f"""WITH {CF}, o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY predicate, source_book ORDER BY best_confidence DESC NULLS LAST, row_id) = 1)
SELECT * FROM (SELECT predicate, row_number() OVER (PARTITION BY predicate ORDER BY best_confidence DESC NULLS LAST, row_id) AS sample, source_book, row_id FROM o) WHERE sample <= 5""",
    "predicate_profile": f"""WITH {CF}, c AS (SELECT predicate, subject_type || '->' || object_type AS types, count(*) AS n FROM f GROUP BY ALL)
SELECT * FROM (SELECT predicate, row_number() OVER (PARTITION BY predicate ORDER BY n DESC, types) AS example, types, n, sum(n) OVER (PARTITION BY predicate)::BIGINT AS group_size FROM c) WHERE example <= 10""",
    "noncanonical_predicates": "SELECT coalesce(predicate, '') AS predicate, count(*) AS n FROM triple_records WHERE coalesce(predicate, '') NOT IN (SELECT term FROM canonical_terms WHERE term_kind = 'predicate') GROUP BY 1",
    "chapter_pollution": f"""WITH {CF} SELECT CASE WHEN source_chapter = '' THEN 'empty' WHEN source_chapter = source_book THEN 'repeats_book' WHEN length(source_chapter) >= 12 THEN 'long' WHEN starts_with(source_chapter, '卷') THEN 'volume' ELSE 'other' END AS kind, count(*) AS n FROM f GROUP BY 1""",
    "chunk_lines": f"WITH {_LINES.format(k='sequence', t='text_chunk', d='chunk_tasks')} SELECT sequence, count(*) AS lines, max(length(line)) AS longest, count(*) FILTER (line = '') AS blank FROM l GROUP BY sequence",
    "document_sections": f"""WITH {_LINES.format(k='doc_id', t='text', d='documents').replace(chr(92) + 's+$', _WS + '+$')},
h AS (SELECT *, CASE WHEN regexp_matches(line, '^〔[^〕]+〕') THEN 1 ELSE 0 END AS h FROM l), n AS (SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM h)
SELECT doc_id, section_no::BIGINT AS section_no, coalesce(max(line) FILTER (h = 1), 'front') AS title, count(*) FILTER (h = 0 AND line <> '') AS n_lines, coalesce(sum(length(line)) FILTER (h = 0), 0)::BIGINT AS n_chars, min(line_no) AS first_line FROM n GROUP BY ALL""",
    "wrapped_paragraphs": f"""WITH {_LINES.format(k='sequence', t='text_chunk', d='chunk_tasks')},
c AS (SELECT *, CASE WHEN regexp_matches(line, '[。！？.!?：:”』」）)]$') OR line = '' THEN 1 ELSE 0 END AS closed FROM l),
g AS (SELECT *, coalesce(lag(closed) OVER (PARTITION BY sequence ORDER BY line_no), 0) AS before FROM c), p AS (SELECT *, sum(before) OVER (PARTITION BY sequence ORDER BY line_no) AS p FROM g),
j AS (SELECT sequence, p, string_agg(line, '' ORDER BY line_no) AS paragraph, min(line_no) AS first_line FROM p GROUP BY ALL)
SELECT sequence, row_number() OVER (PARTITION BY sequence ORDER BY first_line) AS paragraph_no, first_line, length(paragraph) AS n_chars, md5(paragraph) AS digest FROM j WHERE paragraph <> ''""",
    "section_nodes": "SELECT book_name, source, count(*) AS leaves, min(doc_id) AS first_leaf, arg_min_null(chapter_title, doc_id) AS first_chapter, sum(length(coalesce(text, '')))::BIGINT AS n_chars FROM documents WHERE book_name IS NOT NULL GROUP BY book_name, source",
    "section_topics": f"""WITH k AS (SELECT unnest({KEYWORDS!r}) AS word, generate_subscripts({KEYWORDS!r}, 1) AS i), c AS (SELECT book_name, i, word, count(*) AS n FROM documents JOIN k ON contains(text, word) WHERE book_name IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT book_name, row_number() OVER (PARTITION BY book_name ORDER BY n DESC, i) AS place, word, n FROM c) WHERE place <= 8""",
    "similarity_floor": f"""WITH t AS (SELECT book_name, doc_id, list_distinct({light('text')}) AS t FROM documents WHERE book_name IS NOT NULL), b AS (SELECT *, lag(t) OVER (PARTITION BY book_name ORDER BY doc_id) AS p FROM t),
s AS (SELECT book_name, CASE WHEN p IS NOT NULL AND len(list_distinct(list_concat(t, p))) > 0 THEN len(list_intersect(t, p))::DOUBLE / len(list_distinct(list_concat(t, p))) END AS sim FROM b)
SELECT book_name, count(*) AS sections, coalesce(round(greatest(0.12::DOUBLE, least(0.32::DOUBLE, quantile_cont(sim, 0.5) FILTER (sim > 0))), 3), 0.18) AS floor FROM s GROUP BY book_name""",
    "case_slots": rf"""SELECT record_id, coalesce(nullif(regexp_extract({_QTEXT}, '([0-9]{{1,3}})岁', 1), ''), nullif(regexp_extract({_QTEXT}, '年([0-9]{{1,3}})', 1), '')) AS age, nullif(regexp_extract({_QTEXT}, '(男|女)', 1), '') AS sex,
coalesce(nullif(regexp_extract({_QTEXT}, '(舌[绛淡红紫])', 1), ''), nullif(regexp_extract({_QTEXT}, '(苔[白黄腻剥])', 1), '')) AS tongue, nullif(regexp_extract({_QTEXT}, '(脉[弦细涩缓沉浮滑数])', 1), '') AS pulse FROM case_records""",
    "question_buckets": f"""WITH k AS (SELECT coalesce(question_type, '') AS t, CASE WHEN contains({_QTEXT}, '出自') THEN 'source' WHEN contains({_QTEXT}, '禁忌') THEN 'taboo' WHEN contains({_QTEXT}, '取舍') THEN 'compare'
WHEN contains({_QTEXT}, '哪些药') THEN 'composition' WHEN contains({_QTEXT}, '如何服用') THEN 'usage' WHEN contains({_QTEXT}, '可否') THEN 'indication' ELSE 'other' END AS kind FROM qa_records)
SELECT kind, count(*) AS n, count(*) FILTER (t = kind) AS agrees FROM k GROUP BY kind""",
    "symptom_terms": "SELECT term, count(*) AS n FROM (SELECT unnest(from_json(symptom_text, '[\"VARCHAR\"]')) AS term FROM case_records WHERE symptom_text <> '') GROUP BY term",
    "case_search_text": "SELECT record_id, md5(concat_ws(chr(10), " + ", ".join(f"CASE WHEN {_T(k)} <> '' THEN '{k}: ' || {_T(k)} END" for k in ("chief_complaint", "history", "tongue", "pulse", "sex")) + ")) AS digest FROM case_records",
    "exact_pair_dedup": rf"""WITH h AS (SELECT *, sha1(trim(regexp_replace(coalesce(question, ''), '{_WS}+', ' ', 'g')) || chr(10) || trim(regexp_replace(coalesce(answer, ''), '{_WS}+', ' ', 'g'))) AS h FROM qa_records)
SELECT collection, count(*) AS kept FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY h ORDER BY record_id) = 1) GROUP BY collection""",
    "eav_pivot": "SELECT record_id, max(collection) AS collection, max(age) AS age, max(sex) AS sex, max(tongue) AS tongue, max(pulse) AS pulse FROM case_records GROUP BY record_id",
    "shard_probe": f"""WITH k AS (SELECT unnest({KEYWORDS!r}) AS term), h AS (SELECT collection, term FROM qa_records JOIN k ON contains(concat_ws(chr(10), question, answer), term))
SELECT collection, count(*) AS hits, count(DISTINCT term) AS terms, round(count(*) * 2.0::DOUBLE + 0.1::DOUBLE * least(count(DISTINCT term), 12), 6) AS score FROM h GROUP BY collection""",
    "interleave_tasks": "SELECT book_name, sequence, row_number() OVER (PARTITION BY book_name ORDER BY sequence) AS turn FROM chunk_tasks",
    "schedule_tasks": "SELECT book_name, sequence, n - 1 AS n FROM (SELECT *, row_number() OVER (PARTITION BY book_name ORDER BY sequence) AS n FROM chunk_tasks) WHERE n > 1 AND n <= 6",
    "source_tokens": f"SELECT source, count(*) AS rows, coalesce(sum(len({light('text')})), 0)::BIGINT AS tokens FROM documents GROUP BY source",
    "required_fields": f"SELECT triple_id FROM triple_records WHERE {_T('subject')} <> '' AND {_T('predicate')} <> '' AND {_T('object')} <> '' AND {_T('source_text')} <> ''",
    "graph_ids": f"""WITH {CF}, p AS (SELECT *, concat_ws('||', subject, predicate, object, source_book, source_chapter) AS parts FROM f)
SELECT row_id, 'ent_' || sha1(subject) AS vid, ('0x' || substring(sha1(CASE WHEN fact_id <> '' THEN fact_id ELSE parts END), 1, 15))::BIGINT AS edge_rank, substring(sha1(parts), 1, 16) AS clean_id FROM p""",
}
