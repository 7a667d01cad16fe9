"""Driver queries of the training-data operators, with SQL where whole tables allow it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.llm import canonical, components, formatdup, leakage, packing, pairs, pii, splitter, survivor
from kgloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def qa_pairs(spark: SparkSession, d: str) -> DataFrame:
    cols = ["record_id", "question", "answer"]
    parts = [table(spark, d, t).select(F.lit(t).alias("source_table"), *cols) for t in ("qa_records", "case_records")]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(qa_pairs(spark, d)).select("source_table", "record_id", "defect").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_fields(table(spark, d, "triple_records"), table(spark, d, "canonical_terms")).select("triple_id", "raw_field", "canonical_term").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.best_evidence(table(spark, d, "facts"), table(spark, d, "evidence")).select("group_id", "evidence_id")


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivor.surviving_facts(table(spark, d, "facts"), table(spark, d, "evidence"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return components.name_groups(table(spark, d, "alias_relations"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitter.cut_report(table(spark, d, "chunk_tasks"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitter.split_oversized(table(spark, d, "chunk_tasks"))


def p6_cover(spark: SparkSession, d: str) -> DataFrame:
    """Every text put together again from its pieces, overlaps left out, and whether all pieces keep the limit and the overlap."""
    w = Window.partitionBy("sequence").orderBy("piece_no")
    rows = splitter.split_oversized(table(spark, d, "chunk_tasks"), keep=()).withColumn("before", F.coalesce(F.lag("end_at").over(w), F.lit(0)))
    fresh = F.substring(F.col("piece"), F.col("before") - F.col("start_at") + 1, F.length("piece"))
    kept = (F.length("piece") <= 800) & ((F.col("piece_no") == 0) | (F.col("before") - F.col("start_at") == F.least(F.lit(200), F.col("before"))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", fresh.alias("t")))), lambda x: x["t"]), "")
    return rows.groupBy("sequence").agg(F.md5(joined).alias("digest"), F.min(kept).alias("kept"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.copy_groups(table(spark, d, "qa_records"))


def p7_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.collapse_copies(table(spark, d, "qa_records"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents")).filter("n_parts > 1").select("doc_id").distinct()


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p8_parts(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its tokens, its parts, and whether the containers of all of them hold what they say and no more than they can."""
    packed = packing.pack_documents(table(spark, d, "documents"))
    true = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("held"))
    rows = packed.join(true, "container_id")
    return rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("parts"), F.min((F.col("held") <= 2048) & (F.col("held") == F.col("fill"))).alias("fits"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).filter("longest_run >= 30").select("item_id", "doc_id")


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_documents(leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(table(spark, d, "documents")).select("doc_id", "pii_type", "found_text").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p1_found, p2_found, p3_found, p3_survivors, p5_found, p6_found, p6_pieces, p6_cover, p7_found, p7_collapsed, p8_found, p8_containers, p8_parts, p9_found, p9_documents, p10_found, p10_redacted)
}

_TRIM = r"regexp_replace({}, '^[\s\x{{00a0}}\x{{3000}}]+|[\s\x{{00a0}}\x{{3000}}]+$', '', 'g')"


def _trim(x: str) -> str:
    return _TRIM.format(x)


_SIG = _trim(r"regexp_replace(signature, '[\s\x{3000}]*[|｜]{1,2}[\s\x{3000}]*', '||', 'g')")

_STAND_INS = ", ".join(repr(x) for x in components.STAND_INS)

_UNSETTLED = ", ".join(repr(x) for x in survivor.UNSETTLED)
_RECENT = "{'at': coalesce(extracted_at, TIMESTAMP '0001-01-01'), 'id': -row_id}"
_SETTLED = {c: f"lower({_trim(f"coalesce({c}, '')")}) NOT IN ({_UNSETTLED})" for c in ("subject_type", "object_type")}
_HAS_TEXT = f"{_trim("coalesce(best_source_text, '')")} <> ''"
_FILLED = f"({' + '.join(f'({v})::INT' for v in _SETTLED.values())} + ({_HAS_TEXT})::INT + (best_confidence IS NOT NULL)::INT)"


def _latest(c: str) -> str:
    value = _trim(f"coalesce({c}, '')")
    return f"arg_max({value}, {_RECENT}) FILTER ({value} <> '') AS {c}"


_FIELDS = ", ".join(_latest(c) for c in ("subject", "predicate", "object", "source_book", "source_chapter", "dataset_scope", "fact_id"))
_KINDS = ", ".join(f"arg_max({_trim(c)}, {{'filled': {_FILLED}, 'at': coalesce(extracted_at, TIMESTAMP '0001-01-01'), 'id': -row_id}}) FILTER ({ok}) AS {c}" for c, ok in _SETTLED.items())
_TIDY = r"regexp_replace(regexp_replace(coalesce(text_chunk, ''), '^[\s\x{3000}]+|[\s\x{3000}]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
_N_TOKENS = r"len(regexp_extract_all(lower(coalesce(text, '')), '[\x{4e00}-\x{9fff}]|[a-z0-9]+'))"

SQL: dict[str, str] = {
    "p3_survivors": f"""
WITH f AS (SELECT {_SIG} AS sig, * EXCLUDE (signature) FROM facts),
g AS (SELECT sig, min(row_id) AS group_id, count(*) AS copies FROM f WHERE sig <> '' GROUP BY sig HAVING count(*) > 1),
carried AS (
  SELECT DISTINCT group_id, {_trim('fid')} AS fid FROM (
    SELECT g.group_id, f.fact_id AS fid FROM f JOIN g USING (sig)
    UNION ALL SELECT g.group_id, unnest(string_split(coalesce(f.fact_ids_text, ''), '|')) FROM f JOIN g USING (sig))),
e AS (SELECT evidence_id, {_trim('fact_id')} AS fid, source_text, confidence, recorded_at FROM evidence WHERE confidence IS NOT NULL AND {_trim("coalesce(source_text, '')")} <> ''),
p AS (SELECT group_id, evidence_id, source_text, confidence FROM carried JOIN e USING (fid) WHERE fid <> '' QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY confidence DESC, recorded_at DESC NULLS LAST, evidence_id) = 1),
o AS (SELECT group_id, any_value(copies) AS copies, max(sig) AS signature, {_FIELDS}, {_KINDS},
  arg_max({{'t': best_source_text, 'c': best_confidence}}, {{'c': coalesce(best_confidence, -1), 'r': {_RECENT}}}) FILTER ({_HAS_TEXT}) AS own, max(extracted_at) AS extracted_at FROM f JOIN g USING (sig) GROUP BY group_id)
SELECT o.* EXCLUDE (own), coalesce(source_text, own.t) AS best_source_text, coalesce(confidence, own.c) AS best_confidence, evidence_id FROM o LEFT JOIN p USING (group_id)""",
    "p6_cover": f"SELECT sequence, md5({_TIDY}) AS digest, true AS kept FROM chunk_tasks",
    "p8_parts": f"SELECT doc_id, {_N_TOKENS} AS n_tokens, greatest(1, ceil({_N_TOKENS} / 2048.0))::BIGINT AS parts, true AS fits FROM documents",
    "p3_found": f"""
WITH f AS (SELECT {_SIG} AS sig, row_id, fact_id, fact_ids_text FROM facts),
g AS (SELECT sig, min(row_id) AS group_id FROM f WHERE sig <> '' GROUP BY sig HAVING count(*) > 1),
carried AS (
  SELECT DISTINCT group_id, {_trim('fid')} AS fid FROM (
    SELECT g.group_id, f.fact_id AS fid FROM f JOIN g USING (sig)
    UNION ALL SELECT g.group_id, unnest(string_split(coalesce(f.fact_ids_text, ''), '|')) FROM f JOIN g USING (sig))),
e AS (SELECT evidence_id, {_trim('fact_id')} AS fid, confidence, recorded_at FROM evidence WHERE confidence IS NOT NULL AND {_trim("coalesce(source_text, '')")} <> ''),
r AS (SELECT group_id, evidence_id, row_number() OVER (PARTITION BY group_id ORDER BY confidence DESC, recorded_at DESC NULLS LAST, evidence_id) AS k FROM carried JOIN e USING (fid) WHERE fid <> '')
SELECT group_id, evidence_id FROM r WHERE k = 1""",
    "p6_found": r"""
WITH t AS (SELECT sequence, regexp_replace(regexp_replace(coalesce(text_chunk, ''), '^[\s\x{3000}]+|[\s\x{3000}]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS x FROM chunk_tasks)
SELECT DISTINCT sequence, CASE WHEN list_max(list_transform(regexp_extract_all(x, '[\p{L}\p{N}\p{M}]+'), lambda s: length(s))) > 600 THEN 'forced' ELSE 'natural' END AS cut_type
FROM t WHERE length(x) > 800""",
    "p8_found": r"""
SELECT DISTINCT doc_id FROM documents WHERE len(regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}]|[a-z0-9]+')) > 2048""",
    "p5_found": f"""
WITH RECURSIVE p AS (SELECT DISTINCT {_trim('entity')} AS a, {_trim('alias')} AS b FROM alias_relations WHERE entity IS NOT NULL AND alias IS NOT NULL),
q AS (SELECT a, b FROM p WHERE a <> b AND lower(a) NOT IN ('', {_STAND_INS}) AND lower(b) NOT IN ('', {_STAND_INS})),
e AS (SELECT a, b FROM q UNION SELECT b, a FROM q),
reach AS (SELECT a AS name, a AS other FROM e UNION SELECT reach.name, e.b FROM reach JOIN e ON reach.other = e.a)
SELECT min(other) AS group_name, name FROM reach GROUP BY name""",
}
