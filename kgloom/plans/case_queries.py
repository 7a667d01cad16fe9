"""Driver queries of case search, paths with their edges, and documents built from books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import tokens as T
from kgloom.functions.text import norm
from kgloom.operators import cases as C
from kgloom.operators import corpus as R
from kgloom.operators import documents as D
from kgloom.operators import paths as P
from kgloom.operators import sections as S
from kgloom.operators import vectors as V
from kgloom.plans.corpus_queries import _W, docs, light
from kgloom.plans.fact_queries import edges, facts
from kgloom.plans.graph_queries import _ALIAS
from kgloom.plans.graph_queries import SQL as GRAPH
from kgloom.plans.graph_queries import near, pairs, q_paths, q_support
from kgloom.plans.sqlparts import F as CF
from kgloom.plans.sqlparts import SYM, trim
from kgloom.session import cut, table


def asked(s: SparkSession, d: str) -> DataFrame:
    """Questions of the cases whose number is divisible by 20, with their profile."""
    q = table(s, d, "case_records").filter("cast(right(record_id, 7) as int) % 20 = 0").select(F.col("record_id").alias("qid"), F.coalesce("question", F.lit("")).alias("query"))
    return C.profile(q.groupBy("qid").agg(F.min("query").alias("query")))


def q_profile(s: SparkSession, d: str) -> DataFrame:
    return asked(s, d).select("qid", "intent", "age_said", *(F.array_join(c, "|").alias(c) for c in ("formulas", "symptoms", "sexes")))


def q_segments(s: SparkSession, d: str) -> DataFrame:
    return asked(s, d).select("qid", F.array_join(C.segments("query"), "|").alias("segments"))


def found(s: SparkSession, d: str) -> DataFrame:
    return C.search_cases(table(s, d, "case_records"), asked(s, d), T.light_tokens("query"))


def q_cases(s: SparkSession, d: str) -> DataFrame:
    return found(s, d)


def q_case_ladder(s: SparkSession, d: str) -> DataFrame:
    """Structured hits for numbers divisible by 40, else the nearest of all questions by stand-in embeddings, for every third length."""
    known = asked(s, d)
    hits = cut(C.search_cases(table(s, d, "case_records"), known.filter("cast(right(qid, 7) as int) % 40 = 0"), T.light_tokens("query")).select("qid", "record_id", "score", "place"))
    c = table(s, d, "case_records").select(F.xxhash64("record_id").alias("vec_id"), "record_id", V.hashed_embedding(F.col("question")).alias("embedding"))
    rest = known.filter("length(query) % 3 = 0").join(hits.select("qid").distinct(), "qid", "left_anti").select("qid", V.hashed_embedding(F.col("query")).alias("embedding"))
    dense = V.search(c, rest, metric="cosine", k=5).join(c.select("vec_id", "record_id"), "vec_id").select("qid", "record_id", "score", "place")
    return R.ladder([("structured", hits), ("vectors", dense)]).groupBy("qid", "mode").agg(F.count("*").alias("n"))


def q_bonus(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "qa_records")
    sets = T.distinct_tokens("question"), T.distinct_tokens("answer")
    return q.select("record_id", C.answer_bonus(F.col("answer")).alias("quality"), F.round(C.overlap_bonus(T.distinct_tokens(F.lit("此方如何服用有何禁忌")), *sets), 6).alias("overlap"))


def ends(s: SparkSession, d: str) -> DataFrame:
    """Path questions whose start is an alias where the fact's number is divisible by 40."""
    a = q_support(s, d).groupBy(F.col("a").alias("start")).agg(F.min("b").alias("alias"))
    return pairs(s, d).join(a, "start", "left").select("qid", F.when(F.col("qid") % 40 == 0, F.coalesce("alias", "start")).otherwise(F.col("start")).alias("start"), "finish")


def known(s: SparkSession, d: str) -> DataFrame:
    f = facts(s, d)
    return f.select(F.explode(F.array("subject", "object")).alias("name")).filter("name != ''").distinct()


def q_candidates(s: SparkSession, d: str) -> DataFrame:
    return P.name_candidates(ends(s, d).select("qid", F.col("start").alias("text")), known(s, d), q_support(s, d))


def q_path_query(s: SparkSession, d: str) -> DataFrame:
    return P.path_query(ends(s, d), known(s, d), q_support(s, d), near(s, d))


def q_hydrated(s: SparkSession, d: str) -> DataFrame:
    kinds = table(s, d, "entities").select(norm("name").alias("name"), norm("entity_type").alias("t")).filter("t != ''").groupBy("name").agg(F.min("t").alias("entity_type"))
    return P.hydrated(q_paths(s, d).select("qid", "place", "path"), facts(s, d).filter("subject != '' and object != ''"), kinds, ["qid", "place"])


def relation_edges(s: SparkSession, d: str) -> DataFrame:
    return facts(s, d).filter("source_book != ''").select("source_book", "row_id", F.col("subject").alias("source"), F.col("object").alias("target"), F.when(F.col("row_id") % 7 != 0, F.col("predicate")).alias("predicate"), F.size("ids").alias("evidence"))


def q_graph_nodes(s: SparkSession, d: str) -> DataFrame:
    return P.evidence_graph(relation_edges(s, d), "source_book", "row_id")[0]


def q_graph_edges(s: SparkSession, d: str) -> DataFrame:
    return P.evidence_graph(relation_edges(s, d), "source_book", "row_id")[1]


def q_labelled(s: SparkSession, d: str) -> DataFrame:
    """Nodes of each chapter's graph; the chapter's smallest name is its center."""
    f = facts(s, d).filter("source_chapter != ''")
    ends = f.select("source_chapter", F.explode(F.array("subject", "object")).alias("node"), F.size("ids").alias("n"), "source_book").filter("node != ''")
    nodes = ends.groupBy("source_chapter", "node").agg(F.sum("n").alias("evidence"), F.countDistinct("source_book").alias("sources"), F.count("*").alias("degree"))
    center = nodes.groupBy("source_chapter").agg(F.min("node").alias("center"))
    return P.labelled_nodes(nodes.join(center, "source_chapter"), "source_chapter", F.col("node") == F.col("center"), 3, 8).select("source_chapter", "place", "node", "label_score")


def q_score(s: SparkSession, d: str) -> DataFrame:
    """Every relation against the question '<book>所载<target>，<predicate>如何'."""
    e = edges(s, d)
    rows = e.select("row_id", "direction", "predicate", F.col("predicate").alias("normalized"), F.lit("治疗").alias("family"), "target", F.coalesce("best_source_text", F.lit("")).alias("best_text"), "source_book", "source_chapter", F.lit(7).alias("book_count"), F.col("row_id").cast("int").alias("evidence_count"), F.when(F.col("row_id") % 3 == 0, "review_needed").otherwise("in_schema").alias("tier"))
    q = F.concat("source_book", F.lit("所载"), "target", F.lit("，"), "predicate", F.lit("如何"))
    return rows.select("row_id", "direction", P.full_score(q, T.fragments(q), F.col("predicate") == "别名", F.lit(0.6)).alias("score"))


def sections(s: SparkSession, d: str) -> DataFrame:
    """Documents with a book as its sections, numbered."""
    return D.numbered_sections(docs(s, d).filter("trim(book_name) != ''"), "book_name", "doc_id")


def q_header(s: SparkSession, d: str) -> DataFrame:
    t = docs(s, d)
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n 书名： "), "book_name", F.lit("\n篇名："), "chapter_title", F.lit(" \n"), "text")).otherwise(F.col("text"))
    path = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("classic://"), "book_name", F.lit("/"), "chapter_title"))
    return t.select("doc_id", D.header_book(text, path, F.concat(F.lit("x/012-"), "source", F.lit(".txt"))).alias("book"), D.header_chapter(text, path, F.col("page_number")).alias("chapter"))


def q_outline(s: SparkSession, d: str) -> DataFrame:
    per = docs(s, d).filter("trim(book_name) != ''").groupBy("book_name", F.coalesce("chapter_title", F.lit("")).alias("title")).agg(F.count("*").alias("leaves"))
    return D.outline(per)


def q_titles(s: SparkSession, d: str) -> DataFrame:
    """Last clauses of the lines as titles; lines with a pulse are the marks."""
    rows = S.lines(docs(s, d), "doc_id", "text").withColumn("line", F.when(F.col("line").contains("脉"), F.concat(F.lit("属性："), "line")).otherwise(F.substring_index(F.regexp_replace("line", "[。，；].*$", ""), "用", -1)))
    return D.formula_titles(rows, "doc_id", "属性：")


def q_paragraphs(s: SparkSession, d: str) -> DataFrame:
    got = D.chunk_paragraphs(docs(s, d), "doc_id", "text", 400, 60)
    return got.select("doc_id", "chunk_no", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


def q_parents(s: SparkSession, d: str) -> DataFrame:
    return D.parents(sections(s, d), "book_name", "chapter_title", "text", 3000).withColumn("text", F.md5("text"))


def q_leaves(s: SparkSession, d: str) -> DataFrame:
    return D.leaves(sections(s, d), "book_name", "chapter_title", "text", 400, 60).withColumn("text", F.md5("text"))


def q_body(s: SparkSession, d: str) -> DataFrame:
    return D.body_chunks(sections(s, d), "book_name", "chapter_title", "text").withColumn("chunk", F.md5("chunk"))


def q_anchors(s: SparkSession, d: str) -> DataFrame:
    """Anchors of every document in the chunks of all."""
    every = D.anchors(docs(s, d), "doc_id", "text")
    return D.anchored(every, D.chunk_paragraphs(docs(s, d), "doc_id", "text", 400, 60).select(F.struct("doc_id", "chunk_no").alias("chunk_id"), "chunk"), "doc_id", "chunk_id", "chunk")


QUERIES = {
    "case_profile": q_profile,
    "case_segments": q_segments,
    "case_search": q_cases,
    "case_ladder": q_case_ladder,
    "answer_bonuses": q_bonus,
    "name_candidates": q_candidates,
    "path_query": q_path_query,
    "hydrated_paths": q_hydrated,
    "evidence_graph_nodes": q_graph_nodes,
    "evidence_graph_edges": q_graph_edges,
    "labelled_nodes": q_labelled,
    "full_relation_score": q_score,
    "document_headers": q_header,
    "book_outlines": q_outline,
    "formula_titles": q_titles,
    "paragraph_chunks": q_paragraphs,
    "parent_documents": q_parents,
    "leaf_documents": q_leaves,
    "body_chunks": q_body,
    "anchor_matches": q_anchors,
}


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _uniq(x: str) -> str:
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


_FRAGS = "list_filter(regexp_split_to_array(query, '[，。；：？！、,.;:?!\\s（）()《》“”]+'), lambda x: length(x) >= 2)"
_CQ = f"""cq AS (SELECT record_id AS qid, min(coalesce(question, '')) AS query FROM case_records WHERE CAST(right(record_id, 7) AS INT) % 20 = 0 GROUP BY record_id),
cp AS (SELECT *, {_uniq(f"regexp_extract_all(query, '{C.FORMULA}')")} AS formulas, nullif(regexp_extract(query, '([0-9]{{1,3}})岁', 1), '') AS age_said,
  list_filter({_uniq(_FRAGS)}, lambda t: length(t) <= 8 AND len(list_filter({_list(C.SIGNS)}, lambda s: contains(t, s))) > 0) AS symptoms, list_filter(['男', '女'], lambda s: contains(query, s)) AS sexes FROM cq),
ci AS (SELECT *, CASE WHEN {_any('query', C.HINTS['case'])} OR age_said IS NOT NULL THEN 'case' WHEN {_any('query', C.HINTS['origin'])} THEN 'origin' WHEN {_any('query', C.HINTS['role'])} AND len(formulas) > 0 THEN 'formula_role'
  WHEN {_any('query', C.HINTS['composition'])} AND len(formulas) > 0 THEN 'formula_composition' WHEN {_any('query', C.HINTS['indication'])} AND len(formulas) > 0 THEN 'formula_indication' WHEN len(formulas) > 0 THEN 'formula' ELSE 'generic' END AS intent FROM cp)"""
_UNION = " UNION ALL ".join(f"SELECT record_id, '{f}' AS field, {w}::DOUBLE AS boost, {light(f)} AS t FROM case_records" for f, w in C.WEIGHTS.items())
_BODY = "concat_ws(chr(10), " + ", ".join(f"coalesce({c}, '')" for c in [*C.WEIGHTS, "sex"]) + ")"
_CASES = f"""ct AS (SELECT DISTINCT qid, unnest({light('query')}) AS term FROM ci), ce AS ({_UNION}), cs AS (SELECT field, count(*)::DOUBLE AS n, greatest(avg(len(t)), 1e-9) AS mean FROM ce GROUP BY field),
cf AS (SELECT record_id, field, boost, length, term, count(*) AS tf FROM (SELECT record_id, field, boost, len(t)::DOUBLE AS length, unnest(t) AS term FROM ce) WHERE term IN (SELECT term FROM ct) GROUP BY ALL),
cd AS (SELECT field, term, count(*) AS df FROM cf GROUP BY ALL), cw AS (SELECT record_id, term, boost * {_W} AS w FROM cf JOIN cd USING (field, term) JOIN cs USING (field)),
cr AS (SELECT qid, record_id, round(sum(w), 6) AS score FROM cw JOIN ct USING (term) GROUP BY qid, record_id QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, record_id) <= 40),
cb AS (SELECT qid, record_id, score, {_BODY} AS body, age_said, sexes, symptoms, intent FROM cr JOIN case_records USING (record_id) JOIN ci USING (qid)),
cx AS (SELECT qid, record_id, round(score + CASE WHEN intent = 'case' THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN age_said IS NOT NULL AND contains(body, age_said) THEN 3.0::DOUBLE ELSE 0 END
  + 2.0::DOUBLE * len(list_filter(sexes, lambda x: contains(body, x))) + 1.5::DOUBLE * len(list_filter(symptoms, lambda x: contains(body, x))) + CASE WHEN {_any('body', C.STYLE)} THEN 1.2::DOUBLE ELSE 0 END, 6) AS score FROM cb),
cc AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, record_id) AS place FROM cx QUALIFY place <= 5)"""
_ENDS = f"""en AS (SELECT qid, CASE WHEN qid % 40 = 0 THEN coalesce(alias, start) ELSE start END AS start, finish FROM pairs LEFT JOIN (SELECT a AS start, min(b) AS alias FROM al GROUP BY a) USING (start)),
kn AS (SELECT DISTINCT name FROM (SELECT subject AS name FROM f UNION ALL SELECT object FROM f) WHERE name <> '')"""


def _cand(column: str, name: str) -> str:
    return f"""{name} AS (SELECT qid, name, row_number() OVER (PARTITION BY qid ORDER BY support DESC, name) AS place FROM (SELECT * FROM (
  SELECT qid, {column} AS name, 0 AS tier, 0 AS support FROM en WHERE {column} IN (SELECT name FROM kn) UNION ALL SELECT qid, other, 1, support FROM en JOIN st ON st.name = {column} WHERE other IN (SELECT name FROM kn)) QUALIFY tier = min(tier) OVER (PARTITION BY qid)) QUALIFY place <= 3)"""


_PREFIX = GRAPH["shortest_paths"].split(", p0 AS")[0]
_PATHS = GRAPH["shortest_paths"].split(", p0 AS")[1].rsplit("\nSELECT", 1)[0]
_SEC = f"se AS (SELECT *, row_number() OVER (PARTITION BY book_name ORDER BY doc_id) AS section_no FROM documents WHERE trim(book_name) <> '')"
_KIND = f"CASE WHEN t = '' THEN 'unknown' WHEN {_any('t', D.FRONT)} THEN 'front_matter' WHEN {' OR '.join(f'ends_with(t, {s!r})' for s in D.FORMULA)} THEN 'formula' WHEN {_any('t', D.CATEGORY)} THEN 'category' WHEN length(t) <= 4 THEN 'entry' ELSE 'generic' END"
_BODYTEXT = r"regexp_replace(regexp_replace(coalesce(text, ''), '^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"

SQL = {
    "case_profile": f"WITH {_CQ} SELECT qid, intent, age_said, array_to_string(formulas, '|') AS formulas, array_to_string(symptoms, '|') AS symptoms, array_to_string(sexes, '|') AS sexes FROM ci",
    "case_segments": f"""WITH {_CQ}, sg AS (SELECT qid, list_concat(list_concat(list_filter(regexp_extract_all(query, '[一-鿿]{{2,}}'), lambda x: length(x) <= 8), regexp_extract_all(lower(query), '[a-z0-9]{{2,}}')), regexp_extract_all(query, '[0-9]{{1,3}}岁|[0-9]{{1,3}}')) AS l FROM ci)
SELECT qid, array_to_string({_uniq('l')}, '|') AS segments FROM sg""",
    "case_search": f"WITH {_CQ}, {_CASES} SELECT * FROM cc",
    "answer_bonuses": f"""WITH q AS (SELECT record_id, length(trim(coalesce(answer, ''))) AS n, list_distinct({light('question')}) AS a, list_distinct({light('answer')}) AS b, list_distinct({light("'此方如何服用有何禁忌'")}) AS x FROM qa_records)
SELECT record_id, CASE WHEN n = 0 THEN 0.0 WHEN n < 12 THEN -0.04 WHEN n <= 180 THEN 0.08 WHEN n <= 320 THEN 0.05 ELSE 0.02 END::DOUBLE AS quality, round(least(0.03::DOUBLE * len(list_intersect(x, a)) + 0.02::DOUBLE * len(list_intersect(x, b)), 0.25), 6) AS overlap FROM q""",
    "name_candidates": f"{_PREFIX}, {_ALIAS}, {_ENDS}, {_cand('start', 'cn')} SELECT qid, name, place FROM cn",
    "path_query": f"""{_PREFIX.replace('pairs AS (', 'pairs0 AS (').replace('FROM pairs ', 'FROM pairs0 ')}, {_ALIAS}, {_ENDS.replace('FROM pairs ', 'FROM pairs0 ')}, {_cand('start', 'c1')}, {_cand('finish', 'c2')},
pairs AS (SELECT {{'qid': c1.qid, 'start': c1.name, 'finish': c2.name}} AS qid, c1.name AS start, c2.name AS finish FROM c1 JOIN c2 USING (qid)), p0 AS{_PATHS},
pq AS (SELECT DISTINCT q.qid AS qid, hops, path, score FROM (SELECT qid AS q, hops, path, score FROM b QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) <= 5)),
pm AS (SELECT * FROM pq QUALIFY hops = min(hops) OVER (PARTITION BY qid))
SELECT qid, hops, path, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS place FROM pm QUALIFY place <= 5""",
    "hydrated_paths": f"""{_PREFIX}, p0 AS{_PATHS}, pp AS (SELECT qid, place, string_split(path, '->') AS nodes FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS place FROM b) WHERE place <= 5),
ch AS (SELECT *, CASE WHEN trim(source_chapter) = '' OR trim(source_chapter) = source_book THEN '' WHEN source_book <> '' AND starts_with(trim(source_chapter), source_book) THEN regexp_replace(substring(trim(source_chapter), length(source_book) + 1), '^[\\s·:：/_\\-—]+', '') ELSE trim(source_chapter) END AS chapter FROM f WHERE subject <> '' AND object <> ''),
be AS (SELECT subject AS a, object AS b, predicate, source_book, chapter FROM ch QUALIFY row_number() OVER (PARTITION BY subject, object ORDER BY coalesce(best_confidence, -1) DESC, row_id) = 1),
hp AS (SELECT qid, place, i, nodes[i] AS a, nodes[i + 1] AS b FROM pp, range(1, 4) t(i) WHERE i < len(nodes)),
ed AS (SELECT hp.qid, hp.place, i, coalesce(x.predicate, y.predicate || '(逆向)') AS predicate, CASE WHEN x.a IS NOT NULL THEN concat_ws('/', x.source_book, x.chapter) ELSE concat_ws('/', y.source_book, y.chapter) END AS source FROM hp LEFT JOIN be x ON x.a = hp.a AND x.b = hp.b LEFT JOIN be y ON y.a = hp.b AND y.b = hp.a WHERE x.a IS NOT NULL OR y.a IS NOT NULL),
eg AS (SELECT qid, place, count(*) AS n, string_agg(predicate, '|' ORDER BY i) AS edges, list(source ORDER BY i) AS sl FROM ed GROUP BY ALL),
ty AS (SELECT {trim('name')} AS name, min({trim('entity_type')}) AS t FROM entities WHERE {trim('entity_type')} <> '' GROUP BY 1),
nk AS (SELECT qid, place, string_agg(coalesce(t, 'entity'), '|' ORDER BY i) AS types FROM (SELECT qid, place, i, nodes[i] AS name FROM pp, range(1, 5) r(i) WHERE i <= len(nodes)) LEFT JOIN ty USING (name) GROUP BY ALL)
SELECT qid, place, array_to_string(nodes, '|') AS nodes, types, edges, array_to_string({_uniq('sl')}, '|') AS sources FROM pp JOIN eg USING (qid, place) JOIN nk USING (qid, place) WHERE n = len(nodes) - 1""",
    "evidence_graph_nodes": f"""WITH {CF}, e AS (SELECT source_book, subject AS source, object AS target, len(ids) AS evidence FROM f WHERE source_book <> '' AND subject <> '' AND object <> ''),
n AS (SELECT source_book, node, sum(evidence)::BIGINT AS evidence FROM (SELECT source_book, source AS node, evidence FROM e UNION ALL SELECT source_book, target, evidence FROM e) GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY source_book) AS nodes, row_number() OVER (PARTITION BY source_book ORDER BY evidence DESC, node) AS place FROM n QUALIFY place <= 36""",
    "evidence_graph_edges": f"""WITH {CF}, e AS (SELECT source_book, row_id, subject AS source, object AS target, CASE WHEN row_id % 7 = 0 OR predicate = '' THEN '相关' ELSE predicate END AS predicate, len(ids) AS evidence FROM f WHERE source_book <> '' AND subject <> '' AND object <> ''),
o AS (SELECT source_book, source, target, predicate, min(row_id) AS first, arg_max(evidence, row_id) AS evidence FROM e GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY source_book) AS edges, row_number() OVER (PARTITION BY source_book ORDER BY first) AS place FROM o QUALIFY place <= 60""",
    "labelled_nodes": f"""WITH {CF}, e AS (SELECT source_chapter, unnest([subject, object]) AS node, len(ids) AS n, source_book FROM f WHERE source_chapter <> ''),
g AS (SELECT source_chapter, node, round(sum(n) + 2 * count(DISTINCT source_book) + 1.5::DOUBLE * count(*) + CASE WHEN node = min(node) OVER (PARTITION BY source_chapter) THEN 1000.0::DOUBLE ELSE 0 END, 4) AS label_score FROM e WHERE node <> '' GROUP BY source_chapter, node),
k AS (SELECT *, row_number() OVER (PARTITION BY source_chapter ORDER BY label_score DESC, node) AS place, least(8, greatest(3, count(*) OVER (PARTITION BY source_chapter) // 3)) AS k FROM g)
SELECT source_chapter, place, node, label_score FROM k WHERE place <= k""",
    "full_relation_score": f"""WITH {CF}, {SYM}, q AS (SELECT *, source_book || '所载' || target || '，' || predicate || '如何' AS query FROM s), r AS (SELECT *, {_uniq(_FRAGS)} AS parts FROM q)
SELECT row_id, direction, (CASE WHEN predicate = '别名' THEN 50 ELSE 0 END + CASE WHEN predicate <> '' THEN 38 ELSE 0 END + CASE WHEN contains(query, '治疗') THEN 16 ELSE 0 END + 10 + CASE WHEN source_book <> '' THEN 160 ELSE 0 END + CASE WHEN source_chapter <> '' AND contains(query, source_chapter) THEN 10 ELSE 0 END
  + CASE WHEN list_contains(parts, target) THEN 18 ELSE 0 END + CASE WHEN len(list_filter(parts, lambda p: contains(coalesce(best_source_text, ''), p))) > 0 THEN 5 ELSE 0 END + 6 + 5 + least(floor(ln(1 + row_id::DOUBLE) * 4), 8) + CASE WHEN direction = 'out' THEN 1 ELSE 0 END - CASE WHEN row_id % 3 = 0 THEN 18 ELSE 0 END)::INT AS score FROM r""",
    "document_headers": r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND nullif(trim(book_name), '') IS NOT NULL AND chapter_title IS NOT NULL AND text IS NOT NULL THEN trim(book_name) WHEN doc_id % 3 = 1 AND chapter_title IS NOT NULL AND nullif(book_name, '') IS NOT NULL THEN book_name ELSE source END AS book,
CASE WHEN doc_id % 3 = 0 AND nullif(trim(chapter_title), '') IS NOT NULL AND book_name IS NOT NULL AND text IS NOT NULL THEN trim(chapter_title) WHEN doc_id % 3 = 1 AND nullif(chapter_title, '') IS NOT NULL AND nullif(book_name, '') IS NOT NULL THEN chapter_title WHEN page_number <> 0 THEN lpad(page_number::VARCHAR, 4, '0') ELSE '' END AS chapter FROM documents""",
    "book_outlines": f"""WITH p AS (SELECT book_name, trim(coalesce(chapter_title, '')) AS t, count(*) AS leaves FROM documents WHERE trim(book_name) <> '' GROUP BY book_name, coalesce(chapter_title, '')), k AS (SELECT *, {_KIND} AS kind FROM p),
a AS (SELECT book_name, count(*) AS sections, sum(leaves)::BIGINT AS leaves, count(*) FILTER (kind = 'front_matter') AS front_matter, count(*) FILTER (kind = 'formula') AS formula, count(*) FILTER (kind = 'category') AS category, count(*) FILTER (kind = 'entry') AS entry, avg((leaves <= 1)::INT) AS micro FROM k GROUP BY book_name)
SELECT * EXCLUDE (micro), round(micro, 4) AS micro, round(leaves::DOUBLE / sections, 4) AS mean_leaves, CASE WHEN sections >= 800 AND micro >= 0.93 THEN 'micro_entry_book' WHEN sections >= 600 AND leaves::DOUBLE / sections >= 2 THEN 'mixed_compendium' WHEN sections >= 300 AND micro >= 0.88 THEN 'fine_grained_book' WHEN sections <= 120 AND leaves::DOUBLE / sections >= 1.8 THEN 'coarse_book' ELSE 'default' END AS archetype FROM a""",
    "parent_documents": f"""WITH {_SEC}, n AS (SELECT *, lpad(section_no::VARCHAR, 4, '0') AS no FROM se)
SELECT 'classic::' || book_name || '::' || no AS chunk_id, 2 AS level, 'classic://' || book_name || '/' || no AS path, book_name || '::' || no AS section_key, md5(substring('古籍：' || book_name || chr(10) || '篇名：' || coalesce(nullif(chapter_title, ''), book_name) || chr(10) || coalesce(text, ''), 1, 3000)) AS text FROM n""",
    "body_chunks": f"""WITH {_SEC}, bd AS (SELECT book_name, section_no, coalesce(chapter_title, '') AS title, {_BODYTEXT} AS body FROM se), bp AS (SELECT *, sum(length(body) + 2) OVER w AS e FROM bd WHERE body <> '' WINDOW w AS (PARTITION BY book_name ORDER BY section_no)),
bt AS (SELECT book_name, string_agg(body, chr(10) || chr(10) ORDER BY section_no) AS whole, max(e) - 2 AS total FROM bp GROUP BY book_name),
bc AS (SELECT book_name, i AS chunk_no, i * 720 AS start_at, substring(whole, (i * 720 + 1)::INT, 800) AS chunk FROM bt, range(0, 100000) t(i) WHERE i * 720 < total AND (i = 0 OR i * 720 + 80 < total)),
bo AS (SELECT bc.book_name, chunk_no, title, section_no, least(start_at + 800, e - CASE WHEN e - 2 = total THEN 2 ELSE 0 END) - greatest(start_at, e - length(body) - 2) AS n FROM bc JOIN bp USING (book_name) JOIN bt USING (book_name))
SELECT book_name, chunk_no, start_at, title, md5(chunk) AS chunk FROM bc JOIN (SELECT * FROM bo WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY book_name, chunk_no ORDER BY n DESC, section_no) = 1) USING (book_name, chunk_no)""",
}
