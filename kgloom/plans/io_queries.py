"""Driver queries of sources, sinks and streams: what is written and read again, or streamed, equals the table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.functions.text import norm
from kgloom.operators import facts as O
from kgloom.plans.fact_queries import facts
from kgloom.plans.sqlparts import F as CF
from kgloom.plans.sqlparts import trim
from kgloom.session import table
from kgloom.sources import readers as R
from kgloom.sources import writers as W
from kgloom.streaming import pipelines as P

ROW = "row_id long, subject string, predicate string, object string, source_book string"
COLS = ["row_id", "subject", "predicate", "object", "source_book"]
RANKS = {"view": 0, "click": 0, "signup": 1, "purchase": 2, "error": 0}


def q_jsonl(s: SparkSession, d: str) -> DataFrame:
    path = W.scratch(s, "rows") + ".jsonl"
    W.append_jsonl(table(s, d, "facts").select(*COLS), path)
    return R.read_rows(s, path, ROW)


def q_array(s: SparkSession, d: str) -> DataFrame:
    """One array a file, in a folder each."""
    path = W.scratch(s, "array") + ".json"
    rows = table(s, d, "facts").select(F.to_json(F.struct(*COLS)).alias("j"), F.pmod("row_id", F.lit(64)).alias("k"))
    rows.groupBy("k").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).write.partitionBy("k").text(path)
    return R.read_json_array(s, f"{path}/*", ROW)


def q_lenient(s: SparkSession, d: str) -> DataFrame:
    """S3: broken lines are dropped."""
    path = W.scratch(s, "lenient")
    good = table(s, d, "facts").select(F.to_json(F.struct(*COLS)).alias("value"))
    good.union(s.range(5).select(F.lit('{"row_id": broken').alias("value"))).union(s.range(3).select(F.lit("  ").alias("value"))).write.text(path)
    return R.read_jsonl(s, path, ROW, strict=False)


def q_tsv(s: SparkSession, d: str) -> DataFrame:
    path = W.scratch(s, "tsv")
    e = table(s, d, "evidence").select(F.col("evidence_id").cast("string").alias("evidence_id"), "fact_id", "source_book")
    e.write.option("sep", "\t").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return R.read_tsv(s, path, ["evidence_id", "fact_id", "source_book"])


def q_csv(s: SparkSession, d: str) -> DataFrame:
    path = W.scratch(s, "csv")
    W.write_csv(table(s, d, "qa_records"), path, ["record_id", "collection", "bucket"])
    return s.read.option("header", True).schema("record_id string, collection string, bucket string").csv(path).na.fill("")


def q_split(s: SparkSession, d: str) -> DataFrame:
    """One folder a bucket; reading one of them prunes the others."""
    path = W.scratch(s, "split")
    q = table(s, d, "qa_records").withColumn("bucket", F.when(norm("bucket") == "", "none").otherwise(norm("bucket")))
    q.select("record_id", "bucket").write.partitionBy("bucket").parquet(path)
    return s.read.parquet(path).filter("bucket != 'none'").groupBy("bucket").agg(F.count("*").alias("n"))


def q_publish(s: SparkSession, d: str) -> DataFrame:
    """Two versions published, the second one is current and the first one still there."""
    root, f = W.scratch(s, "store"), table(s, d, "facts").select("row_id", "source_book")
    W.publish(f.filter("row_id % 2 = 0"), root)
    W.publish(f, root)
    count = lambda df, v: df.agg(F.lit(v).alias("version"), F.count("*").alias("n"))
    return count(W.current(s, root), "current").unionByName(count(W.current(s, root, 1), "backup"))


def q_decode(s: SparkSession, d: str) -> DataFrame:
    """Texts in either of two encodings come back as they were."""
    t = table(s, d, "chunk_tasks").select("sequence", "text_chunk")
    even = F.pandas_udf(lambda n, x: pd.Series([v.encode("utf-8-sig" if k % 2 else "gb18030") for k, v in zip(n, x, strict=True)]), T.BinaryType())
    return t.select("sequence", F.md5(R.decode(even("sequence", F.coalesce("text_chunk", F.lit(""))))).alias("digest"))


def q_count(s: SparkSession, d: str) -> DataFrame:
    path = W.scratch(s, "lines")
    table(s, d, "facts").select(F.when(F.col("row_id") % 10 == 0, " ").otherwise(F.col("subject")).alias("value")).write.text(path)
    return R.count_lines(s, path)


def q_answers(s: SparkSession, d: str) -> DataFrame:
    """Fields and items of answer lines."""
    path = W.scratch(s, "answers")
    table(s, d, "case_records").select(F.concat_ws("@", "record_id", F.concat_ws("；", F.coalesce("tongue", F.lit("")), F.coalesce("pulse", F.lit("")))).alias("value")).write.text(path)
    return R.read_answers(s, path, ["id", "items"]).select(F.get("id", F.lit(0)).alias("record_id"), F.size("items").alias("n"))


def q_evidence(s: SparkSession, d: str) -> DataFrame:
    return R.with_evidence(facts(s, d), table(s, d, "evidence")).select("row_id", "source_text", "confidence")


def q_name_map(s: SparkSession, d: str) -> DataFrame:
    return R.name_map(table(s, d, "facts"), "subject", "subject_type", "row_id")


def q_log(s: SparkSession, d: str) -> DataFrame:
    return R.latest_rows(table(s, d, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


def q_statements(s: SparkSession, d: str) -> DataFrame:
    return W.graph_statements(facts(s, d)).groupBy("kind", F.md5("statement").alias("digest")).agg(F.count("*").alias("n"))


def q_lexicon(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "entities").select(norm("name").alias("name"), norm("entity_type").alias("entity_type")).filter("name != '' and entity_type != ''")
    return W.lexicon(e)


def stream_path(d: str) -> str:
    return f"{d}/events.parquet"


def q_graph(s: SparkSession, d: str) -> DataFrame:
    path = W.scratch(s, "graph")
    W.write_graph(facts(s, d), path)
    return s.read.schema(", ".join(f"{c} string" for c in W.GRAPH_COLUMNS)).json(path).groupBy(*W.GRAPH_COLUMNS).agg(F.count("*").alias("n"))


def q_attached(s: SparkSession, d: str) -> DataFrame:
    f = facts(s, d).select("row_id", "source_book")
    return R.attached(f, f.filter("row_id % 3 = 0").drop("source_book")).groupBy("store").agg(F.count("*").alias("n"), F.count("source_book").alias("with_book"))


def q_discovered(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "qa_records")
    names = q.select(F.col("collection").alias("id"), F.col("collection").alias("name")).distinct()
    parts = q.select("collection", F.when(F.col("bucket") == "formula_qa", "VECTOR").otherwise("METADATA").alias("scope"), F.col("embedding_id").alias("segment"))
    return R.discovered(names, parts, "qa_", 2)


def q_delete_rows(s: SparkSession, d: str) -> DataFrame:
    f = facts(s, d)
    return O.delete_rows(f, f.filter("row_id % 7 = 0"), f.filter("row_id % 50 = 0").select(F.col("object").alias("name"))).select("row_id")


def q_restricted(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "fact_members")
    return O.restricted(m, m.filter("linked_at is null"), "signature").groupBy("signature").agg(F.count("*").alias("n"))


def q_group_count(s: SparkSession, d: str) -> DataFrame:
    return O.group_count(facts(s, d), ["subject", "predicate"])


def q_tail(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", "event_type")
    got = P.tailed(s, [e.filter("event_id % 3 = 0"), e.filter("event_id % 3 = 1"), e.filter("event_id % 3 = 2")])
    return got.groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


QUERIES = {
    "io_graph_rows": q_graph,
    "attached_stores": q_attached,
    "collection_discovery": q_discovered,
    "delete_rows": q_delete_rows,
    "restricted_members": q_restricted,
    "group_count": q_group_count,
    "stream_tail": q_tail,
    "io_jsonl": q_jsonl,
    "io_json_array": q_array,
    "io_jsonl_lenient": q_lenient,
    "io_tsv": q_tsv,
    "io_csv": q_csv,
    "io_partitioned": q_split,
    "io_publish_versions": q_publish,
    "io_decode": q_decode,
    "io_count_lines": q_count,
    "io_answer_file": q_answers,
    "facts_with_evidence": q_evidence,
    "name_map": q_name_map,
    "log_latest_rows": q_log,
    "graph_statements": q_statements,
    "lexicon_export": q_lexicon,
    "stream_latest_status": lambda s, d: P.latest(s, stream_path(d)),
    "stream_hourly_rate": lambda s, d: P.rates(s, stream_path(d)),
    "stream_first_only": lambda s, d: P.first_only(s, stream_path(d)),
    "stream_resume": lambda s, d: P.resumed(s, stream_path(d)),
    "stream_pending": lambda s, d: P.pending(s, stream_path(d), table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 66")),
    "stream_publish_queue": lambda s, d: P.coalesced(s, stream_path(d), RANKS),
    "stream_trailing_failures": lambda s, d: P.trailing_failures(s, stream_path(d)),
}

_ROWS = f"SELECT {', '.join(COLS)} FROM facts"
_Q = "'\"' || regexp_replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), '[\\r\\n]+', ' ', 'g') || '\"'"
_VID = "'\"ent_' || sha1({0}) || '\"'"
SQL = {
    "io_graph_rows": f"WITH {CF} SELECT subject, predicate, object, subject_type, object_type, source_book, source_chapter, count(*) AS n FROM f GROUP BY ALL",
    "attached_stores": f"WITH {CF} SELECT 'main' AS store, count(*) AS n, count(source_book) AS with_book FROM f UNION ALL SELECT 'backup', count(*) FILTER (row_id % 3 = 0), 0 FROM f",
    "collection_discovery": "SELECT collection AS id, collection AS name, max(embedding_id) FILTER (bucket = 'formula_qa') AS vector, max(embedding_id) FILTER (bucket IS DISTINCT FROM 'formula_qa') AS metadata FROM qa_records WHERE starts_with(collection, 'qa_') GROUP BY collection ORDER BY name LIMIT 2",
    "delete_rows": f"""WITH {CF}, g AS (SELECT DISTINCT subject, predicate, object, source_book, source_chapter FROM f WHERE row_id % 7 = 0), n AS (SELECT DISTINCT object AS name FROM f WHERE row_id % 50 = 0)
SELECT row_id FROM f ANTI JOIN g USING (subject, predicate, object, source_book, source_chapter) WHERE subject NOT IN (SELECT name FROM n) AND object NOT IN (SELECT name FROM n)""",
    "restricted_members": "SELECT signature, count(*) AS n FROM fact_members WHERE signature IN (SELECT signature FROM fact_members WHERE linked_at IS NULL) GROUP BY signature",
    "group_count": f"WITH {CF} SELECT count(*) AS groups FROM (SELECT DISTINCT subject, predicate FROM f)",
    "stream_tail": "SELECT event_id % 3 AS batch, count(*) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY 1",
    "io_jsonl": _ROWS,
    "io_json_array": _ROWS,
    "io_jsonl_lenient": _ROWS,
    "io_tsv": f"SELECT CAST(evidence_id AS VARCHAR) AS evidence_id, {trim('fact_id')} AS fact_id, {trim('source_book')} AS source_book FROM evidence",
    "io_csv": "SELECT record_id, collection, coalesce(bucket, '') AS bucket FROM qa_records",
    "io_partitioned": f"SELECT {trim('bucket')} AS bucket, count(*) AS n FROM qa_records WHERE {trim('bucket')} <> '' GROUP BY 1",
    "io_publish_versions": "SELECT 'current' AS version, count(*) AS n FROM facts UNION ALL SELECT 'backup', count(*) FROM facts WHERE row_id % 2 = 0",
    "io_decode": "SELECT sequence, md5(coalesce(text_chunk, '')) AS digest FROM chunk_tasks",
    "io_count_lines": "SELECT count(*) AS lines FROM facts WHERE row_id % 10 <> 0 AND trim(subject) <> ''",
    "io_answer_file": "SELECT record_id, (trim(coalesce(tongue, '')) <> '')::INT + (trim(coalesce(pulse, '')) <> '')::INT AS n FROM case_records",
    "facts_with_evidence": f"""WITH {CF}, e AS (SELECT {trim('fact_id')} AS fid, arg_max({{'t': source_text, 'c': confidence}}, evidence_id) AS e FROM evidence GROUP BY 1)
SELECT row_id, coalesce(best_source_text, e.t) AS source_text, coalesce(best_confidence, e.c) AS confidence FROM f LEFT JOIN e ON fid = coalesce(ids[1], fact_id)""",
    "name_map": f"SELECT {trim('subject')} AS subject, arg_max({trim('subject_type')}, row_id) AS subject_type FROM facts WHERE {trim('subject')} <> '' AND {trim('subject_type')} <> '' GROUP BY 1",
    "log_latest_rows": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "graph_statements": f"""WITH {CF}, n AS (SELECT name, min(type) AS type FROM (SELECT subject AS name, subject_type AS type FROM f UNION ALL SELECT object, object_type FROM f) WHERE name <> '' GROUP BY name),
u AS (SELECT 'vertex' AS kind, 'INSERT VERTEX entity(name, entity_type) VALUES ' || {_VID.format('name')} || ':(' || {_Q.format('name')} || ', ' || {_Q.format('type')} || ')' AS s FROM n
UNION ALL SELECT 'edge', 'INSERT EDGE relation(predicate, source_book, source_chapter) VALUES ' || {_VID.format('subject')} || '->' || {_VID.format('object')} || ':(' || {_Q.format('predicate')} || ', ' || {_Q.format('source_book')} || ', ' || {_Q.format('source_chapter')} || ')' FROM f WHERE subject <> '' AND object <> '')
SELECT kind, md5(s) AS digest, count(*) AS n FROM u GROUP BY ALL""",
    "lexicon_export": f"SELECT {trim('entity_type')} AS entity_type, count(DISTINCT {trim('name')}) AS n, array_to_string(list_sort(list(DISTINCT {trim('name')}))[1:20], '|') AS first_names FROM entities WHERE {trim('name')} <> '' AND {trim('entity_type')} <> '' GROUP BY 1",
    "stream_latest_status": "SELECT user_id, event_type, round(arg_max(value, {'t': ts, 'e': event_id}), 6) AS value, count(*) AS entries FROM events GROUP BY ALL",
    "stream_hourly_rate": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_first_only": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_resume": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS distinct_events FROM events GROUP BY ALL",
    "stream_pending": "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 66)",
    "stream_publish_queue": f"SELECT user_id, max(CASE event_type {' '.join(f'WHEN {k!r} THEN {v}' for k, v in RANKS.items())} END) AS rank, count(*) AS requests FROM events GROUP BY user_id",
    "stream_trailing_failures": """WITH e AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
l AS (SELECT *, max(k) FILTER (ok) OVER (PARTITION BY user_id) AS last_ok FROM e)
SELECT user_id, count(*) AS events, count(*) FILTER (NOT ok AND k > coalesce(last_ok, 0)) AS trailing FROM l GROUP BY user_id""",
}
