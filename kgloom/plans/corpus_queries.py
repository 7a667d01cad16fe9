"""Driver queries of the corpus index and of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import tokens as T
from kgloom.operators import corpus as C
from kgloom.operators import index as I
from kgloom.operators import search as S
from kgloom.operators import vectors as V
from kgloom.sources.writers import scratch
from kgloom.plans.sqlparts import trim
from kgloom.session import table

FIELDS = {"text": 1.0, "chapter_title": 2.6, "book_name": 3.4}


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def items(s: SparkSession, d: str) -> DataFrame:
    """Search queries: the questions of the evaluation items whose id is divisible by 20."""
    return table(s, d, "eval_items").filter("item_id % 20 = 0").select(F.col("item_id").alias("qid"), F.coalesce("question_text", F.lit("")).alias("query"))


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings")


def probe_vectors(s: SparkSession, d: str) -> DataFrame:
    return vectors(s, d).filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def search(s: SparkSession, d: str, k: int = 10) -> DataFrame:
    return C.bm25(docs(s, d), items(s, d), tokens=T.light_tokens("text"), query_tokens=T.light_tokens("query"), k=k)


def q_stats(s: SparkSession, d: str) -> DataFrame:
    return C.corpus_stats(docs(s, d), T.light_tokens("text")).withColumn("mean_length", F.round("mean_length", 6))


def q_df(s: SparkSession, d: str) -> DataFrame:
    return C.term_frequencies(docs(s, d), "doc_id", T.light_tokens("text"))


def q_search(s: SparkSession, d: str) -> DataFrame:
    return search(s, d)


def q_fields(s: SparkSession, d: str) -> DataFrame:
    return C.bm25_fields(docs(s, d), items(s, d), FIELDS, query_tokens=T.light_tokens("query"))


def q_ngram(s: SparkSession, d: str) -> DataFrame:
    """Character trigram BM25 over the questions of the records."""
    q = table(s, d, "qa_records")
    asked = q.filter("cast(right(record_id, 7) as int) % 20 = 0").select(F.col("record_id").alias("qid"), F.coalesce("question", F.lit("")).alias("query")).groupBy("qid").agg(F.min("query").alias("query"))
    rows = q.groupBy("record_id").agg(F.min(F.coalesce("answer", F.lit(""))).alias("answer"))
    return C.bm25(rows, asked, key="record_id", tokens=T.trigrams("answer"), query_tokens=T.trigrams("query"), k=5)


def q_sparse(s: SparkSession, d: str) -> DataFrame:
    return C.sparse_encode(docs(s, d), "doc_id", T.light_tokens("text"))


def q_dense(s: SparkSession, d: str) -> DataFrame:
    return V.search(vectors(s, d), probe_vectors(s, d), metric="dot")


def q_cosine(s: SparkSession, d: str) -> DataFrame:
    return V.search(vectors(s, d), probe_vectors(s, d), metric="cosine", k=5)


def q_l2(s: SparkSession, d: str) -> DataFrame:
    got = V.search(vectors(s, d), probe_vectors(s, d), metric="l2", k=5)
    return got.withColumn("similarity", F.round(1.0 / (1.0 + F.col("score")), 6))


def q_shards(s: SparkSession, d: str) -> DataFrame:
    """Nearest vectors per shard (the label), then over all shards: the same as the exact search."""
    per = V.search(vectors(s, d), probe_vectors(s, d), metric="l2", k=3, by="label").drop("place")
    return C.top_k(per, ["qid"], [F.asc("score"), F.col("vec_id")], 10)


def q_hybrid(s: SparkSession, d: str) -> DataFrame:
    """Fusion of full-text and multi-field ranks, documents in both lists first."""
    return C.rrf([(search(s, d, 30), 1.0), (C.bm25_fields(docs(s, d), items(s, d), FIELDS, query_tokens=T.light_tokens("query"), k=30), 1.0)], ["qid", "doc_id"])


def q_weighted(s: SparkSession, d: str) -> DataFrame:
    """Fusion with weights 1.35 and 1.0 and k = 40, best document of each source kept."""
    fused = C.rrf([(search(s, d, 30), 1.35), (C.bm25_fields(docs(s, d), items(s, d), FIELDS, query_tokens=T.light_tokens("query"), k=30), 1.0)], ["qid", "doc_id"], k=40, limit=60)
    sections = docs(s, d).select("doc_id", "source")
    best = C.top_k(fused.drop("place").join(sections, "doc_id"), ["qid", "source"], [F.desc("score"), F.col("doc_id")], 1).drop("place")
    return C.top_k(best, ["qid"], [F.desc("score"), F.col("doc_id")], 10)


def q_merge(s: SparkSession, d: str) -> DataFrame:
    parents = docs(s, d).select("doc_id", F.concat_ws("::", "book_name", "source").alias("parent"))
    return C.auto_merge(search(s, d, 20).drop("place"), parents)


def q_gate(s: SparkSession, d: str) -> DataFrame:
    hits = search(s, d, 20).join(items(s, d), "qid").join(docs(s, d).select("doc_id", "text"), "doc_id")
    anchors = F.filter(T.probe_terms("query"), lambda t: F.length(t) <= 8)
    return C.lexical_gate(hits, anchors, F.coalesce("text", F.lit(""))).select("qid", "doc_id", "place", "score")


def dense_docs(s: SparkSession, d: str, k: int = 30) -> DataFrame:
    """The dense leg: documents with a vector of their id, against the vectors of the items' ids."""
    held = vectors(s, d).join(docs(s, d).select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    asked = vectors(s, d).join(items(s, d).select(F.col("qid").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), "embedding")
    return V.search(held, asked, metric="cosine", k=k).withColumnRenamed("vec_id", "doc_id")


def q_dense_hybrid(s: SparkSession, d: str) -> DataFrame:
    """Items whose id is divisible by 40 have no sparse query, so that their dense order stays."""
    return C.hybrid(dense_docs(s, d), search(s, d, 30).filter("qid % 40 != 0"), ["qid", "doc_id"])


def q_level(s: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of one level, the even labels."""
    return V.search(vectors(s, d).filter("label % 2 = 0"), probe_vectors(s, d), metric="cosine", k=5)


def q_all_cells(s: SparkSession, d: str) -> DataFrame:
    """The index with all cells probed gives the exact result."""
    return V.build_index(vectors(s, d), scratch(s, "cells"), cells=16).search(probe_vectors(s, d), k=5, probes=16)


def q_index_recall(s: SparkSession, d: str) -> DataFrame:
    """Share of the ten exact neighbours that the index finds with the cells it says it needs, over all queries; whether that is 0.9."""
    exact = V.search(vectors(s, d), probe_vectors(s, d), metric="cosine", k=10).select("qid", "vec_id")
    near = V.build_index(vectors(s, d), scratch(s, "cells"), cells=32).search(probe_vectors(s, d), k=10).select("qid", "vec_id", F.lit(1).alias("hit"))
    return exact.join(near, ["qid", "vec_id"], "left").agg(F.count("*").alias("neighbours"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("recall_reached"))


def q_indexed(s: SparkSession, d: str) -> DataFrame:
    """The search of ``bm25_search`` from a stored index."""
    built = I.build(docs(s, d), "doc_id", {"text": T.light_tokens("text"), "chapter_title": T.light_tokens("chapter_title")}, scratch(s, "postings"))
    return built.search(items(s, d), T.light_tokens("query"), {"text": 1.0})


def sections(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).withColumn("section", S.section_key(docs(s, d)))


def q_section_index(s: SparkSession, d: str) -> DataFrame:
    """R2: BM25 over groups of documents, the sections."""
    return I.build(sections(s, d), "section", {"text": T.light_tokens("text")}, scratch(s, "groups")).search(items(s, d), T.light_tokens("query"), {"text": 1.0})


def q_section_fusion(s: SparkSession, d: str) -> DataFrame:
    """Full-text and dense ranks fused by section."""
    known = sections(s, d).select("doc_id", "section")
    return C.section_fusion([(search(s, d, 30).join(known, "doc_id"), 1.35), (dense_docs(s, d).join(known, "doc_id"), 1.0)])


def q_ladder(s: SparkSession, d: str) -> DataFrame:
    """Trigram hits of long questions' items first, then full text, then dense."""
    words = items(s, d).withColumn("query", F.when(F.col("qid") % 60 == 0, F.lit("")).when(F.col("qid") % 40 == 0, F.lit("zzzz")).otherwise(F.col("query")))
    tri = C.bm25(docs(s, d), words.filter("qid % 3 = 0"), tokens=T.trigrams("text"), query_tokens=T.trigrams("query"), k=5)
    return C.ladder([("trigrams", tri), ("full_text", C.bm25(docs(s, d), words, tokens=T.light_tokens("text"), query_tokens=T.light_tokens("query"), k=5)), ("dense", dense_docs(s, d, 5))])


def q_refined(s: SparkSession, d: str) -> DataFrame:
    """Questions against their first eight characters alone."""
    short = C.bm25(docs(s, d), items(s, d).withColumn("query", F.substring("query", 1, 4)), tokens=T.light_tokens("text"), query_tokens=T.light_tokens("query"), k=5)
    return C.refined(short, search(s, d, 5))


def q_parents_of(s: SparkSession, d: str) -> DataFrame:
    named = docs(s, d).select(F.concat_ws("::", "book_name", "source").alias("parent"), "text").groupBy("parent").agg(F.md5(F.coalesce(F.min("text"), F.lit(""))).alias("text"))
    return C.with_parents(q_merge(s, d), named).select("qid", "unit", "place", "text")


def q_chunks_of(s: SparkSession, d: str) -> DataFrame:
    return S.as_chunks(search(s, d, 5), docs(s, d), size=40)


QUERIES = {
    "merged_parents": q_parents_of,
    "search_chunks": q_chunks_of,
    "hybrid_dense": q_dense_hybrid,
    "dense_level": q_level,
    "vector_index_exact": q_all_cells,
    "vector_index_recall": q_index_recall,
    "indexed_search": q_indexed,
    "section_index_search": q_section_index,
    "section_fusion": q_section_fusion,
    "search_ladder": q_ladder,
    "refined_search": q_refined,
    "corpus_stats": q_stats,
    "term_document_frequency": q_df,
    "bm25_search": q_search,
    "bm25_fields": q_fields,
    "bm25_trigrams": q_ngram,
    "sparse_encode": q_sparse,
    "dense_topk": q_dense,
    "dense_cosine": q_cosine,
    "dense_l2": q_l2,
    "dense_sharded": q_shards,
    "hybrid_rrf": q_hybrid,
    "weighted_fusion": q_weighted,
    "auto_merge": q_merge,
    "lexical_gate": q_gate,
}

LIGHT = r"'[\x{4e00}-\x{9fff}]|[a-z0-9]+'"


def light(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), {LIGHT})"


def tri(x: str) -> str:
    return f"flatten(list_transform(regexp_extract_all(coalesce({x}, ''), '[\\x{{4e00}}-\\x{{9fff}}]+'), lambda s: list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3))))"


_ITEMS = "items AS (SELECT item_id AS qid, coalesce(question_text, '') AS query FROM eval_items WHERE item_id % 20 = 0)"
_W = "ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))"


def bm25(k: int, key: str, docs: str, tokens: str, queries: str, query_tokens: str, name: str = "b") -> str:
    return f"""{name}_t AS (SELECT DISTINCT qid, unnest({query_tokens}) AS term FROM {queries}),
{name}_e AS (SELECT {key}, {tokens} AS t FROM {docs}), {name}_s AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM {name}_e),
{name}_f AS (SELECT {key}, length, term, count(*) AS tf FROM (SELECT {key}, len(t)::DOUBLE AS length, unnest(t) AS term FROM {name}_e) WHERE term IN (SELECT term FROM {name}_t) GROUP BY ALL),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_f GROUP BY term),
{name}_w AS (SELECT {key}, term, {_W} AS w FROM {name}_f JOIN {name}_d USING (term), {name}_s),
{name}_r AS (SELECT qid, {key}, round(sum(w), 6) AS score FROM {name}_w JOIN {name}_t USING (term) GROUP BY qid, {key}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {key}) AS place FROM {name}_r) WHERE place <= {k})"""


def fields(k: int, name: str = "m") -> str:
    union = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {w}::DOUBLE AS boost, {light(f)} AS t FROM documents" for f, w in FIELDS.items())
    return f"""{name}_t AS (SELECT DISTINCT qid, unnest({light('query')}) AS term FROM items), {name}_e AS ({union}),
{name}_s AS (SELECT field, count(*)::DOUBLE AS n, greatest(avg(len(t)), 1e-9) AS mean FROM {name}_e GROUP BY field),
{name}_f AS (SELECT doc_id, field, boost, length, term, count(*) AS tf FROM (SELECT doc_id, field, boost, len(t)::DOUBLE AS length, unnest(t) AS term FROM {name}_e) WHERE term IN (SELECT term FROM {name}_t) GROUP BY ALL),
{name}_d AS (SELECT field, term, count(*) AS df FROM {name}_f GROUP BY ALL),
{name}_w AS (SELECT doc_id, term, boost * {_W} AS w FROM {name}_f JOIN {name}_d USING (field, term) JOIN {name}_s USING (field)),
{name}_r AS (SELECT qid, doc_id, round(sum(w), 6) AS score FROM {name}_w JOIN {name}_t USING (term) GROUP BY qid, doc_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS place FROM {name}_r) WHERE place <= {k})"""


_DOT = "list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: v.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE))"
_SELF = "list_sum(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE))"
_L2 = "sqrt(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE))))"


def dense(value: str, order: str, k: int, keep: str = "") -> str:
    return f"""SELECT * FROM (SELECT qid, vec_id, {keep} score, row_number() OVER (PARTITION BY qid ORDER BY score {order}, vec_id) AS place FROM (
SELECT q.vec_id AS qid, v.vec_id AS vec_id, {keep and 'v.' + keep} round({value}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id)) WHERE place <= {k}"""


_BM = bm25(10, "doc_id", "documents", light("text"), "items", light("query"))
_BM30 = bm25(30, "doc_id", "documents", light("text"), "items", light("query"))
_BM5 = bm25(5, "doc_id", "documents", light("text"), "items", light("query"))
_COS = f"{_DOT} / sqrt({_SELF.format('v.embedding')} * {_SELF.format('q.embedding')})"
_SECT = f"CASE WHEN {trim('book_name')} <> '' AND {trim('chapter_title')} <> '' THEN {trim('book_name')} || '::' || {trim('chapter_title')} ELSE 'doc:' || doc_id END"


def dense_leg(k: int) -> str:
    return f"""dn AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS place FROM (SELECT q.vec_id AS qid, v.vec_id AS doc_id, round({_COS}, 6) AS score
FROM embeddings v SEMI JOIN documents ON doc_id = v.vec_id, embeddings q SEMI JOIN items ON items.qid = q.vec_id WHERE v.vec_id <> q.vec_id)) WHERE place <= {k})"""


_BM20 = bm25(20, "doc_id", "documents", light("text"), "items", light("query"))

_WORDS = "wd AS (SELECT qid, CASE WHEN qid % 60 = 0 THEN '' WHEN qid % 40 = 0 THEN 'zzzz' ELSE query END AS query FROM items), w3 AS (SELECT * FROM wd WHERE qid % 3 = 0)"

SQL = {
    "merged_parents": f"""WITH {_ITEMS}, {_BM20}, k AS (SELECT qid, b.doc_id, score, concat_ws('::', book_name, source) AS parent FROM b JOIN documents USING (doc_id)), c AS (SELECT *, count(parent) OVER (PARTITION BY qid, parent) AS n FROM k),
g AS (SELECT qid, CASE WHEN parent IS NOT NULL AND n >= 2 THEN 'p:' || parent ELSE 'd:' || doc_id END AS unit, max(score) AS score FROM c GROUP BY ALL), pt AS (SELECT 'p:' || concat_ws('::', book_name, source) AS unit, md5(coalesce(min(text), '')) AS text FROM documents GROUP BY 1)
SELECT qid, unit, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit) AS place, text FROM g LEFT JOIN pt USING (unit)""",
    "search_chunks": f"""WITH {_ITEMS}, {_BM5}, x AS (SELECT qid, place, doc_id, regexp_replace(trim(coalesce(book_name, '')), '^[0-9]+\\s*[-_－—]\\s*', '') AS book, trim(coalesce(chapter_title, '')) AS t, text, score FROM b JOIN documents USING (doc_id)),
y AS (SELECT *, CASE WHEN t = '' OR t = book THEN '' WHEN book <> '' AND starts_with(t, book) THEN regexp_replace(substring(t, length(book) + 1), '^[\\s·:：/_\\-—]+', '') ELSE t END AS chapter FROM x)
SELECT qid, place, doc_id, book, chapter, CASE WHEN book = '' THEN '' WHEN chapter = '' THEN 'book://' || book ELSE 'chapter://' || book || '/' || chapter END AS path, substring(regexp_replace(coalesce(text, ''), '^[\\s\\x{{00a0}}\\x{{3000}}]+|[\\s\\x{{00a0}}\\x{{3000}}]+$', '', 'g'), 1, 40) AS text, score FROM y""",
    "hybrid_dense": f"""WITH {_ITEMS}, {_BM30}, {dense_leg(30)}, sp AS (SELECT * FROM b WHERE qid % 40 <> 0), un AS (SELECT qid, doc_id, place FROM dn UNION ALL SELECT qid, doc_id, place FROM sp),
g AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + place)), 6) AS score FROM un GROUP BY ALL)
SELECT *, CASE WHEN qid IN (SELECT qid FROM sp) THEN 'hybrid' ELSE 'dense_only' END AS mode FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS place FROM g) WHERE place <= 10""",
    "dense_level": dense(_COS, "DESC", 5).replace("v.vec_id <> q.vec_id", "v.vec_id <> q.vec_id AND v.label % 2 = 0"),
    "vector_index_exact": dense(_COS, "DESC", 5),
    "vector_index_recall": "SELECT count(*) * least(10, (SELECT count(*) - 1 FROM embeddings)) AS neighbours, true AS recall_reached FROM embeddings WHERE vec_id % 20 = 0",
    "indexed_search": f"WITH {_ITEMS}, {_BM} SELECT * FROM b",
    "section_index_search": f"""WITH {_ITEMS}, gt AS (SELECT section, flatten(list(t)) AS t FROM (SELECT {_SECT} AS section, {light('text')} AS t FROM documents) GROUP BY section), {bm25(10, 'section', 'gt', 't', 'items', light('query'))} SELECT * FROM b""",
    "section_fusion": f"""WITH {_ITEMS}, {_BM30}, {dense_leg(30)}, sk AS (SELECT doc_id, {_SECT} AS section FROM documents),
un AS (SELECT qid, doc_id, section, place, score, 1.35::DOUBLE AS w, 0 AS l FROM b JOIN sk USING (doc_id) UNION ALL SELECT qid, doc_id, section, place, score, 1.0::DOUBLE, 1 FROM dn JOIN sk USING (doc_id)),
fs AS (SELECT qid, section, l, w, min(place) AS place FROM un GROUP BY ALL), fr AS (SELECT qid, section, sum(w / (40.0::DOUBLE + place)) AS rrf FROM fs GROUP BY ALL),
bb AS (SELECT qid, section, doc_id, score FROM un QUALIFY row_number() OVER (PARTITION BY qid, section ORDER BY score DESC, l, doc_id) = 1)
SELECT * FROM (SELECT qid, section, doc_id, round(rrf, 6) AS rrf, round(score + rrf, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 6) DESC, section) AS place FROM fr JOIN bb USING (qid, section)) WHERE place <= 10""",
    "search_ladder": f"""WITH {_ITEMS}, {_WORDS}, {bm25(5, 'doc_id', 'documents', tri('text'), 'w3', tri('query'), 'a')}, {bm25(5, 'doc_id', 'documents', light('text'), 'wd', light('query'))}, {dense_leg(5)},
s1 AS (SELECT *, 'trigrams' AS mode FROM a), s2 AS (SELECT * FROM s1 UNION ALL SELECT *, 'full_text' FROM b WHERE qid NOT IN (SELECT qid FROM s1))
SELECT * FROM s2 UNION ALL SELECT qid, doc_id, score, place, 'dense' FROM dn WHERE qid NOT IN (SELECT qid FROM s2)""",
    "refined_search": f"""WITH {_ITEMS}, sh AS (SELECT qid, substring(query, 1, 4) AS query FROM items), {bm25(5, 'doc_id', 'documents', light('text'), 'sh', light('query'), 'a')}, {_BM5},
x1 AS (SELECT qid, count(*) AS n, max(score) AS s FROM a GROUP BY qid), x2 AS (SELECT qid, count(*) AS n, max(score) AS s FROM b GROUP BY qid),
ch AS (SELECT qid, coalesce(x2.n, 0) > coalesce(x1.n, 0) OR coalesce(x2.s, 0) >= coalesce(x1.s, 0) + 0.03 AS second FROM x1 FULL JOIN x2 USING (qid))
SELECT a.*, false AS refined FROM a JOIN ch USING (qid) WHERE NOT second UNION ALL SELECT b.*, true FROM b JOIN ch USING (qid) WHERE second""",
    "corpus_stats": f"SELECT count(*) AS documents, coalesce(sum(n), 0)::BIGINT AS tokens, round(coalesce(avg(n), 0), 6) AS mean_length FROM (SELECT len({light('text')}) AS n FROM documents)",
    "term_document_frequency": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({light('text')}) AS term FROM documents) GROUP BY term",
    "bm25_search": f"WITH {_ITEMS}, {_BM} SELECT * FROM b",
    "bm25_fields": f"WITH {_ITEMS}, {fields(10)} SELECT * FROM m",
    "bm25_trigrams": "WITH q AS (SELECT record_id AS qid, min(coalesce(question, '')) AS query FROM qa_records WHERE CAST(right(record_id, 7) AS INT) % 20 = 0 GROUP BY record_id), r AS (SELECT record_id, min(coalesce(answer, '')) AS answer FROM qa_records GROUP BY record_id), "
    + bm25(5, "record_id", "r", tri("answer"), "q", tri("query"))
    + " SELECT * FROM b",
    "sparse_encode": f"""WITH e AS (SELECT doc_id, {light('text')} AS t FROM documents), s AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM e),
p AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(t)::DOUBLE AS length, unnest(t) AS term FROM e) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT doc_id, count(*) AS n_terms, round(sum({_W}), 4) AS weight FROM p JOIN d USING (term), s GROUP BY doc_id""",
    "dense_topk": dense(_DOT, "DESC", 10),
    "dense_cosine": dense(f"{_DOT} / sqrt({_SELF.format('v.embedding')} * {_SELF.format('q.embedding')})", "DESC", 5),
    "dense_l2": f"SELECT *, round(1.0::DOUBLE / (1.0::DOUBLE + score), 6) AS similarity FROM ({dense(_L2, 'ASC', 5)})",
    "dense_sharded": f"""WITH a AS ({dense(_L2, 'ASC', 1000000000, 'label,')}), l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY qid, label ORDER BY score, vec_id) <= 3)
SELECT * FROM (SELECT qid, vec_id, label, score, row_number() OVER (PARTITION BY qid ORDER BY score, vec_id) AS place FROM l) WHERE place <= 10""",
    "hybrid_rrf": f"""WITH {_ITEMS}, {_BM30}, {fields(30)}, u AS (SELECT qid, doc_id, place FROM b UNION ALL SELECT qid, doc_id, place FROM m),
g AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + place)), 6) AS score FROM u GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS place FROM g) WHERE place <= 10""",
    "weighted_fusion": f"""WITH {_ITEMS}, {_BM30}, {fields(30)}, u AS (SELECT qid, doc_id, place, 1.35::DOUBLE AS w FROM b UNION ALL SELECT qid, doc_id, place, 1.0::DOUBLE FROM m),
g AS (SELECT qid, doc_id, round(sum(w / (40 + place)), 6) AS score FROM u GROUP BY ALL),
c AS (SELECT qid, doc_id, score FROM g QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) <= 60),
x AS (SELECT qid, source, c.doc_id, score FROM c JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, c.doc_id) = 1)
SELECT * FROM (SELECT qid, doc_id, source, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS place FROM x) WHERE place <= 10""",
    "auto_merge": f"""WITH {_ITEMS}, {_BM20}, k AS (SELECT qid, b.doc_id, score, concat_ws('::', book_name, source) AS parent FROM b JOIN documents USING (doc_id)),
c AS (SELECT *, count(parent) OVER (PARTITION BY qid, parent) AS n FROM k),
g AS (SELECT qid, CASE WHEN parent IS NOT NULL AND n >= 2 THEN 'p:' || parent ELSE 'd:' || doc_id END AS unit, max(score) AS score, count(*) AS merged FROM c GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit) AS place FROM g""",
    "lexical_gate": f"""WITH {_ITEMS}, {_BM20},
r AS (SELECT qid, list_distinct(regexp_extract_all(lower(query), '[\\x{{4e00}}-\\x{{9fff}}]{{2,12}}|[a-z0-9]{{2,32}}')) AS runs, regexp_replace(query, '\\s+', '', 'g') AS compact FROM items),
o AS (SELECT qid, CASE WHEN len(runs) > 0 THEN list_transform(list_sort(list_transform(runs, lambda x: {{'n': -length(x), 'r': x}}))[1:8], lambda x: x.r) WHEN compact <> '' THEN [compact[1:12]] ELSE [] END AS terms FROM r),
a AS (SELECT qid, list_filter(terms, lambda t: length(t) <= 8) AS anchors FROM o)
SELECT qid, b.doc_id, place, score FROM b JOIN a USING (qid) JOIN documents USING (doc_id)
WHERE len(anchors) = 0 OR len(list_filter(anchors, lambda t: contains(lower(coalesce(text, '')), lower(t)))) > 0""",
}
