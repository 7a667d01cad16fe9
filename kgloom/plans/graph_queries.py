"""Driver queries of graph traversal, resolution and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.text import norm
from kgloom.operators import graph as G
from kgloom.operators import relations as R
from kgloom.plans.fact_queries import PRIORITY, PROBES, edges, facts, probes
from kgloom.plans.sqlparts import F as CF
from kgloom.plans.sqlparts import SYM, trim
from kgloom.session import table

SYMPTOM, FORMULA = "常见症状", ("推荐方剂", "使用药材")


def pairs(s: SparkSession, d: str) -> DataFrame:
    """Path queries: the subject of every fact whose row_id is divisible by 20, and the object of the next row."""
    f = facts(s, d)
    a = f.filter("row_id % 20 = 0 and subject != ''").select(F.col("row_id").alias("qid"), F.col("subject").alias("start"))
    b = f.filter("row_id % 20 = 1 and object != ''").select((F.col("row_id") - 1).alias("qid"), F.col("object").alias("finish"))
    return a.join(b, "qid")


def near(s: SparkSession, d: str) -> DataFrame:
    return R.best_neighbours(edges(s, d), PRIORITY)


def names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "entities").select(norm("name").alias("name")).filter("name != ''").distinct()


def every_question(s: SparkSession, d: str) -> DataFrame:
    """Questions of all records that have an id."""
    q = table(s, d, "qa_records").select(F.col("record_id").alias("qid"), F.coalesce("question", F.lit("")).alias("text"))
    return q.filter("qid is not null").groupBy("qid").agg(F.min("text").alias("text"))


def questions(s: SparkSession, d: str) -> DataFrame:
    """Questions of the records whose number is divisible by 20."""
    return every_question(s, d).filter("cast(right(qid, 7) as int) % 20 = 0")


def queried(s: SparkSession, d: str) -> DataFrame:
    return probes(s, d).select("qid", F.col("anchor").alias("name"))


def q_support(s: SparkSession, d: str) -> DataFrame:
    return G.alias_edges(table(s, d, "alias_relations"))


def q_components(s: SparkSession, d: str) -> DataFrame:
    return G.components(q_support(s, d)).groupBy("head").agg(F.count("*").alias("size"))


def q_summary(s: SparkSession, d: str) -> DataFrame:
    return G.component_summary(G.components(q_support(s, d)))


def q_closure(s: SparkSession, d: str) -> DataFrame:
    return G.alias_closure(queried(s, d), q_support(s, d))


def q_expand(s: SparkSession, d: str) -> DataFrame:
    return G.expand_queries(queried(s, d), q_closure(s, d)).select("qid", "expanded")


def q_mentions(s: SparkSession, d: str) -> DataFrame:
    return G.mentions(questions(s, d), names(s, d))


def q_doc_mentions(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "text")
    return G.mentions(docs, names(s, d), "doc_id").groupBy("name").agg(F.count("*").alias("documents"))


def q_resolve(s: SparkSession, d: str) -> DataFrame:
    return G.resolve(questions(s, d), names(s, d))


def q_paths(s: SparkSession, d: str) -> DataFrame:
    return G.shortest_paths(pairs(s, d), near(s, d))


def q_bridges(s: SparkSession, d: str) -> DataFrame:
    links = edges(s, d).select(F.col("anchor").alias("name"), F.col("target").alias("other")).distinct()
    return G.bridges(pairs(s, d), links)


def q_chain(s: SparkSession, d: str) -> DataFrame:
    return G.chain(facts(s, d), SYMPTOM, FORMULA)


def q_subgraph(s: SparkSession, d: str) -> DataFrame:
    return G.subgraph(queried(s, d), near(s, d))


def q_degrees(s: SparkSession, d: str) -> DataFrame:
    return G.degrees(facts(s, d))


def q_top(s: SparkSession, d: str) -> DataFrame:
    return G.top_per_predicate(edges(s, d)).select("anchor", "predicate", "place", "target", "direction", "row_id")


def q_types(s: SparkSession, d: str) -> DataFrame:
    """Type of each queried name, 'entity' where it is unknown."""
    known = table(s, d, "entities").select(norm("name").alias("name"), norm("entity_type").alias("t")).filter("t != ''").groupBy("name").agg(F.min("t").alias("t"))
    return queried(s, d).join(known, "name", "left").select("qid", "name", F.coalesce("t", F.lit("entity")).alias("entity_type"))


QUERIES = {
    "alias_support": q_support,
    "alias_components": q_components,
    "alias_component_summary": q_summary,
    "alias_closure": q_closure,
    "alias_query_expansion": q_expand,
    "question_mentions": q_mentions,
    "document_mentions": q_doc_mentions,
    "entity_resolution": q_resolve,
    "shortest_paths": q_paths,
    "two_hop_bridges": q_bridges,
    "symptom_chain": q_chain,
    "subgraph": q_subgraph,
    "node_degrees": q_degrees,
    "edges_per_predicate": q_top,
    "entity_types": q_types,
}

_NEAR = f"""WITH {CF}, {SYM}, pr AS (
SELECT *, CASE predicate {' '.join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items())} ELSE 999 END AS priority FROM s),
one AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY anchor, target ORDER BY priority, best_confidence DESC NULLS LAST, direction, predicate, row_id) = 1),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY priority, best_confidence DESC NULLS LAST, target) AS place FROM one) WHERE place <= 24),
pairs AS (SELECT a.row_id AS qid, a.subject AS start, b.object AS finish FROM f a JOIN f b ON b.row_id = a.row_id + 1 WHERE a.row_id % 20 = 0 AND a.subject <> '' AND b.object <> ''),
{PROBES}"""
_ALIAS = f"""al AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS support FROM (SELECT {trim('entity')} AS a, {trim('alias')} AS b FROM alias_relations)
WHERE a <> b AND length(a) BETWEEN 2 AND 24 AND length(b) BETWEEN 2 AND 24 GROUP BY ALL), st AS (SELECT a AS name, b AS other, support FROM al UNION ALL SELECT b, a, support FROM al)"""
_COMP = f"""WITH RECURSIVE {_ALIAS}, reach AS (SELECT name, name AS other FROM st UNION SELECT reach.name, st.other FROM reach JOIN st ON reach.other = st.name),
g AS (SELECT name, min(other) AS head FROM reach GROUP BY name)"""
_CLOSURE = f"""WITH {CF}, {PROBES}, {_ALIAS},
one AS (SELECT qid, anchor AS start, other AS name, max(support) AS support, 1 AS depth FROM probes JOIN st ON st.name = anchor WHERE other <> anchor GROUP BY ALL),
two AS (SELECT qid, start, other AS name, max(st.support) AS support, 2 AS depth FROM one JOIN st ON st.name = one.name WHERE other <> start GROUP BY ALL),
e AS (SELECT qid, start, name AS alias, min(depth) AS depth, max(support) AS support FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL),
c AS (SELECT qid, start, alias, depth, support, row_number() OVER (PARTITION BY qid ORDER BY depth, support DESC, length(alias) DESC, alias) AS place FROM e QUALIFY place <= 8)"""
_NAMES = f"names AS (SELECT DISTINCT {trim('name')} AS name FROM entities WHERE {trim('name')} <> '')"
_QUESTIONS = "questions AS (SELECT record_id AS qid, min(coalesce(question, '')) AS text FROM qa_records WHERE CAST(right(record_id, 7) AS INT) % 20 = 0 GROUP BY record_id)"

SQL = {
    "alias_support": f"WITH {_ALIAS} SELECT * FROM al",
    "alias_components": f"{_COMP} SELECT head, count(*) AS size FROM g GROUP BY head",
    "alias_component_summary": f"{_COMP}, z AS (SELECT head, count(*) AS size FROM g GROUP BY head) SELECT head, size, (SELECT sum(size)::BIGINT FROM z) AS names, (SELECT count(*) FROM z) AS components FROM z ORDER BY size DESC, head LIMIT 10",
    "alias_closure": f"{_CLOSURE} SELECT qid, start, alias, depth, support, place FROM c",
    "alias_query_expansion": f"{_CLOSURE} SELECT p.qid, trim(concat_ws(' ', p.anchor, string_agg(c.alias, ' ' ORDER BY c.place))) AS expanded FROM probes p LEFT JOIN c USING (qid) GROUP BY p.qid, p.anchor",
    "question_mentions": f"WITH {_NAMES}, {_QUESTIONS} SELECT qid, name, instr(text, name) AS at FROM questions JOIN names ON contains(text, name)".replace(" AS at", ' AS "at"'),
    "document_mentions": f"WITH {_NAMES} SELECT name, count(*) AS documents FROM documents JOIN names ON contains(text, name) GROUP BY name",
    "entity_resolution": f"""WITH {_NAMES}, {_QUESTIONS}, m AS (
SELECT qid, name, instr(text, name) AS "at", round(CASE WHEN text = name THEN 100.0 ELSE 0.0 END + 60.0 + 20.0::DOUBLE * length(name) / length(text) + CASE WHEN starts_with(text, name) THEN 8.0 ELSE 0.0 END
  + CASE WHEN ends_with(text, name) THEN 6.0 ELSE 0.0 END + 0.4::DOUBLE * least(length(name), 24) - 2.0::DOUBLE * ln(1 + length(text) - length(name)), 6) AS score
FROM questions JOIN names ON contains(text, name))
SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, length(name) DESC, name) AS place, name, "at", score FROM m) WHERE place <= 5""",
    "shortest_paths": f"""{_NEAR}, p0 AS (SELECT * FROM pairs WHERE start <> finish),
h1 AS (SELECT qid, [start, finish] AS nodes, [source_book] AS books FROM p0 JOIN near ON anchor = start AND target = finish),
g1 AS (SELECT qid, start, finish, target AS n1, source_book AS b1 FROM p0 JOIN near ON anchor = start WHERE target <> finish AND target <> start),
h2 AS (SELECT qid, [start, n1, finish], [b1, source_book] FROM g1 JOIN near ON anchor = n1 AND target = finish),
g2 AS (SELECT qid, start, finish, n1, b1, target AS n2, source_book AS b2 FROM g1 JOIN near ON anchor = n1 WHERE target NOT IN (finish, start, n1)),
h3 AS (SELECT qid, [start, n1, n2, finish], [b1, b2, source_book] FROM g2 JOIN near ON anchor = n2 AND target = finish),
h AS (SELECT qid, nodes, books, len(nodes) - 1 AS hops FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)),
b AS (SELECT qid, hops, array_to_string(nodes, '->') AS path, round(1.0::DOUBLE / hops + 0.05::DOUBLE * least(len(list_distinct(books)), 3), 4) AS score FROM h QUALIFY hops = min(hops) OVER (PARTITION BY qid))
SELECT * FROM (SELECT qid, hops, path, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS place FROM b) WHERE place <= 5""",
    "two_hop_bridges": f"{_NEAR}, l AS (SELECT DISTINCT anchor, target FROM s) SELECT DISTINCT qid, a.target AS via FROM pairs JOIN l a ON a.anchor = start JOIN l b ON b.anchor = finish AND b.target = a.target WHERE a.target <> start AND a.target <> finish",
    "symptom_chain": f"""WITH {CF},
p AS (SELECT object AS symptom, subject AS syndrome, max(CASE WHEN object_type = 'symptom' THEN 0.92::DOUBLE ELSE 0.82::DOUBLE END) AS score, max(coalesce(best_confidence, 0)) AS confidence FROM f WHERE predicate = '{SYMPTOM}' GROUP BY ALL),
g AS (SELECT subject AS syndrome, list_sort(list(DISTINCT object))[1:6] AS fs FROM f WHERE predicate IN {FORMULA} GROUP BY subject)
SELECT symptom, place, syndrome, score, coalesce(array_to_string(fs, '|'), '') AS formulas FROM (SELECT *, row_number() OVER (PARTITION BY symptom ORDER BY score DESC, confidence DESC, syndrome) AS place FROM p) LEFT JOIN g USING (syndrome) WHERE place <= 5""",
    "subgraph": f"""{_NEAR}, o AS (SELECT qid, probes.anchor AS start, target AS node, 1 AS depth, place FROM probes JOIN near USING (anchor)),
t AS (SELECT qid, start, near.target AS node, 2 AS depth, near.place FROM o JOIN near ON near.anchor = o.node),
n AS (SELECT qid, node, min({{'d': depth, 'p': place}}) AS m FROM (SELECT * FROM o UNION ALL SELECT * FROM t) WHERE node <> start GROUP BY qid, node)
SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY m.d, m.p, node) AS k, node, m.d AS depth FROM n) WHERE k <= 30""",
    "node_degrees": f"WITH {CF}, e AS (SELECT subject AS name, len(ids) AS n, source_book FROM f UNION ALL SELECT object, len(ids), source_book FROM f) SELECT name, count(*) AS degree, sum(n)::BIGINT AS evidence, count(DISTINCT source_book) AS books FROM e WHERE name <> '' GROUP BY name",
    "edges_per_predicate": f"WITH {CF}, {SYM} SELECT * FROM (SELECT anchor, predicate, row_number() OVER (PARTITION BY anchor, predicate ORDER BY best_confidence DESC NULLS LAST, row_id) AS place, target, direction, row_id FROM s) WHERE place <= 3",
    "entity_types": f"WITH {CF}, {PROBES} SELECT qid, anchor AS name, coalesce(t, 'entity') AS entity_type FROM probes LEFT JOIN (SELECT {trim('name')} AS n, min({trim('entity_type')}) AS t FROM entities WHERE {trim('entity_type')} <> '' GROUP BY 1) ON n = anchor",
}
