"""Driver queries over the fact store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.functions.text import norm
from kgloom.operators import facts as O
from kgloom.operators import relations as R
from kgloom.operators.matching import scan
from kgloom.plans.sqlparts import F as CF
from kgloom.plans.sqlparts import KEY, SYM, trim
from kgloom.session import table

CUTOFF = "2025-03-01 00:00:00"
BOOKS = ["云岭方录", "荷滩妇笺"]
#: Path priority of predicates, smaller first.
PRIORITY = {"推荐方剂": 1, "治疗证候": 2, "治疗疾病": 3, "使用药材": 4, "功效": 5}


def facts(spark: SparkSession, d: str) -> DataFrame:
    return O.clean_facts(table(spark, d, "facts"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return R.symmetric(facts(spark, d))


def old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots: facts extracted before the cutoff, and the others."""
    f = facts(spark, d)
    old = F.coalesce(F.col("extracted_at") < F.lit(CUTOFF).cast("timestamp"), F.lit(False))
    return f.filter(old), f.filter(~old)


def probes(spark: SparkSession, d: str) -> DataFrame:
    """Queried entities: the subject of every fact whose row_id is divisible by 20."""
    rows = facts(spark, d).filter("row_id % 20 = 0 and subject != ''")
    return rows.groupBy(F.col("subject").alias("anchor")).agg(F.min("row_id").alias("qid"))


PROBES = "probes AS (SELECT subject AS anchor, min(row_id) AS qid FROM f WHERE row_id % 20 = 0 AND subject <> '' GROUP BY subject)"

_OLD = f"old AS (SELECT * FROM f WHERE extracted_at < TIMESTAMP '{CUTOFF}'), new AS (SELECT * FROM f WHERE extracted_at >= TIMESTAMP '{CUTOFF}' OR extracted_at IS NULL)"
_DELTA = f"""fresh AS (SELECT * FROM new ANTI JOIN (SELECT DISTINCT {KEY} FROM old) o USING ({KEY})),
seen AS (SELECT DISTINCT unnest(ids) AS id FROM old),
touched AS (SELECT DISTINCT row_id FROM (SELECT row_id, unnest(ids) AS id FROM fresh) SEMI JOIN seen USING (id)),
delta AS (SELECT * FROM fresh ANTI JOIN touched USING (row_id))"""


def q_merge(s: SparkSession, d: str) -> DataFrame:
    return O.merge_dedup(facts(s, d)).select(*O.KEY, "first_row", "n_rows", "subject_type", "object_type", "fact_id", F.array_join("fact_ids", "|").alias("fact_ids"))


def q_best(s: SparkSession, d: str) -> DataFrame:
    return O.best_evidence(table(s, d, "fact_members"), table(s, d, "evidence"))


def q_upsert(s: SparkSession, d: str) -> DataFrame:
    return O.upsert(facts(s, d))


def q_entities(s: SparkSession, d: str) -> DataFrame:
    return O.rebuild_entities(facts(s, d))


def q_stats(s: SparkSession, d: str) -> DataFrame:
    return O.store_stats(facts(s, d), table(s, d, "evidence"))


def q_delta(s: SparkSession, d: str) -> DataFrame:
    old, new = old_new(s, d)
    return O.delta_facts(new, old).select("row_id", *O.KEY)


def q_delta_profile(s: SparkSession, d: str) -> DataFrame:
    old, new = old_new(s, d)
    return O.delta_profile(O.delta_facts(new, old))


def q_delta_evidence(s: SparkSession, d: str) -> DataFrame:
    old, new = old_new(s, d)
    e = table(s, d, "evidence")
    return O.delta_evidence(O.delta_facts(new, old), e, e.filter(F.col("recorded_at") < F.lit(CUTOFF).cast("timestamp")))


def q_publish(s: SparkSession, d: str) -> DataFrame:
    old, new = old_new(s, d)
    return O.publish(new, old).select(*O.KEY, "n_rows", "fact_id", F.array_join("fact_ids", "|").alias("fact_ids"))


def q_delete(s: SparkSession, d: str) -> DataFrame:
    left, proof, orphans = O.delete_books(facts(s, d), table(s, d, "evidence"), BOOKS)
    one = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return one(left, "facts").unionByName(one(proof, "evidence")).unionByName(one(orphans, "orphan_entities"))


def q_orphan_names(s: SparkSession, d: str) -> DataFrame:
    return O.delete_books(facts(s, d), table(s, d, "evidence"), BOOKS)[2]


def q_snapshot(s: SparkSession, d: str) -> DataFrame:
    old, new = old_new(s, d)
    return O.compare_snapshots(old, old.unionByName(new), "source_book")


def q_majority(s: SparkSession, d: str) -> DataFrame:
    return O.majority(facts(s, d).filter("subject_type != ''"), ["subject"], "subject_type", "row_id")


def q_insert(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "evidence").withColumn("fact_id", norm("fact_id"))
    old = F.coalesce(F.col("recorded_at") < F.lit(CUTOFF).cast("timestamp"), F.lit(False))
    return O.insert_or_ignore(e.filter(old), e.filter(~old)).select("evidence_id", "fact_id")


def q_relations(s: SparkSession, d: str) -> DataFrame:
    return R.relations_of(edges(s, d), probes(s, d), 20).select("qid", "anchor", "direction", "place", "predicate", "target", "target_type", "row_id")


def q_clusters(s: SparkSession, d: str) -> DataFrame:
    return R.clusters(edges(s, d))


def q_lookup(s: SparkSession, d: str) -> DataFrame:
    return R.entity_lookup(edges(s, d), probes(s, d)).select("qid", "anchor", "place", "predicate", "target", "direction", "evidence_count", "fusion", "rank_support", "rank_confidence", "rank_spread", "rank_text")


def q_diverse(s: SparkSession, d: str) -> DataFrame:
    return R.diversify(R.entity_lookup(edges(s, d), probes(s, d), 40)).select("qid", "pick", "predicate", "target", "direction", "fusion")


def q_score(s: SparkSession, d: str) -> DataFrame:
    got = R.clusters(edges(s, d).withColumn("source", F.col("source_book")), ("anchor", "source_book"))
    return R.score(got, F.concat("source_book", F.lit("载"), "anchor", F.lit("与"), "target")).groupBy("anchor").agg(F.max("score").alias("best_score"), F.count("*").alias("n"))


def q_neighbours(s: SparkSession, d: str) -> DataFrame:
    return R.best_neighbours(edges(s, d), PRIORITY).select("anchor", "target", "place", "priority", "predicate", "direction", "row_id")


def q_adjacent(s: SparkSession, d: str) -> DataFrame:
    """Names next to each name, both ways, without repeats."""
    f = facts(s, d).filter("subject != '' and object != ''")
    return f.select(F.col("subject").alias("name"), F.col("object").alias("other")).union(f.select("object", "subject")).distinct().groupBy("name").agg(F.count("*").alias("neighbours"))


def q_books(s: SparkSession, d: str) -> DataFrame:
    """books by a word of their name, without regard to case."""
    return facts(s, d).filter(F.lower("source_book").contains("方")).groupBy("source_book").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


def q_book_tier(s: SparkSession, d: str) -> DataFrame:
    return tiered_books(facts(s, d), s.createDataFrame([(1, "云岭方录"), (2, "方"), (3, "不存之书")], "qid int, book string"))


def tiered_books(f: DataFrame, wanted: DataFrame) -> DataFrame:
    """Facts of a book by exact name; by substring only where no exact one exists."""
    tier = F.when(F.col("source_book") == F.col("book"), 0).when(F.col("source_book").contains(F.col("book")), 1)
    books = f.select("source_book").distinct()
    held = scan(books, wanted.select(F.col("book").alias("name")), "source_book", "source_book").select("source_book", F.col("name").alias("book"))
    names = held.join(wanted.distinct(), "book").withColumn("tier", tier)
    best = names.withColumn("_m", F.min("tier").over(Window.partitionBy("qid"))).filter("tier = _m").drop("_m")
    return f.join(best, "source_book").groupBy("qid", "source_book", "tier").agg(F.count("*").alias("n"))


def q_top_predicates(s: SparkSession, d: str) -> DataFrame:
    return O.top_counts(facts(s, d), "predicate", 15)


def q_top_books(s: SparkSession, d: str) -> DataFrame:
    return O.top_counts(facts(s, d), "source_book", 10)


def q_orphans(s: SparkSession, d: str) -> DataFrame:
    return O.orphan_evidence(table(s, d, "evidence"), table(s, d, "fact_members")).select("evidence_id")


QUERIES = {
    "facts_merge_dedup": q_merge,
    "facts_best_evidence": q_best,
    "facts_upsert": q_upsert,
    "entities_rebuild": q_entities,
    "store_stats": q_stats,
    "stats_top_predicates": q_top_predicates,
    "stats_top_books": q_top_books,
    "orphan_evidence": q_orphans,
    "delta_facts": q_delta,
    "delta_profile": q_delta_profile,
    "delta_evidence": q_delta_evidence,
    "publish_merge": q_publish,
    "delete_books": q_delete,
    "delete_books_orphans": q_orphan_names,
    "snapshot_compare": q_snapshot,
    "majority_type": q_majority,
    "evidence_insert_or_ignore": q_insert,
    "entity_relations": q_relations,
    "relation_clusters": q_clusters,
    "entity_lookup": q_lookup,
    "entity_lookup_diverse": q_diverse,
    "relation_score": q_score,
    "path_neighbours": q_neighbours,
    "adjacent_names": q_adjacent,
    "books_by_keyword": q_books,
    "book_facts_tiered": q_book_tier,
}

GENERIC = "('', 'entity', 'other')"


def _first_specific(v: str, seq: str) -> str:
    return f"coalesce(arg_min({v}, {seq}) FILTER ({v} NOT IN {GENERIC}), arg_min({v}, {seq}))"


def _merged(source: str, seq: str) -> str:
    return f"""SELECT h.*, i.fact_ids, coalesce(i.first_id, '') AS fact_id FROM (
  SELECT {KEY}, min({seq}) AS first_row, count(*) AS n_rows, arg_min(subject_type, {seq}) AS subject_type, arg_min(object_type, {seq}) AS object_type FROM {source} GROUP BY {KEY}) h
LEFT JOIN (
  SELECT {KEY}, string_agg(id, '|' ORDER BY seen_at) AS fact_ids, arg_min(id, seen_at) AS first_id FROM (
    SELECT {KEY}, id, min({{'a': {seq}, 'b': pos}}) AS seen_at FROM (
      SELECT *, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM {source}) GROUP BY ALL) GROUP BY {KEY}) i USING ({KEY})"""


CLUSTER = """SELECT {by}, predicate, target, direction, count(*) AS evidence_count, round_even(avg(best_confidence), 4) AS avg_confidence, max(best_confidence) AS max_confidence,
  count(DISTINCT source_book) AS book_count, count(DISTINCT (source_book, source_chapter)) AS chapter_count,
  array_to_string(list_sort(list(DISTINCT source_book))[1:5], '|') AS books,
  arg_max(coalesce(best_source_text, ''), {{'c': coalesce(best_confidence, -1), 'n': length(coalesce(best_source_text, '')), 'r': -row_id}}) AS best_text,
  arg_max(target_type, {{'c': coalesce(best_confidence, -1), 'n': length(coalesce(best_source_text, '')), 'r': -row_id}}) AS target_type
FROM {source} GROUP BY {by}, predicate, target, direction"""

REL = f"""WITH {CF}, {SYM}, {PROBES}, rel AS (
SELECT qid, s.*, row_number() OVER (PARTITION BY qid, direction ORDER BY best_confidence DESC NULLS LAST, row_id) AS place FROM s JOIN probes USING (anchor))"""

_TIE = "predicate, target, direction"

SQL = {
    "facts_merge_dedup": f"WITH {CF} SELECT {KEY}, first_row, n_rows, subject_type, object_type, fact_id, fact_ids FROM ({_merged('f', 'row_id')})",
    "facts_best_evidence": f"""
WITH l AS (SELECT DISTINCT {trim('signature')} AS signature, {trim('fact_id')} AS fact_id FROM fact_members),
e AS (SELECT {trim('fact_id')} AS fact_id, max(confidence) AS confidence, arg_max({trim('source_text')}, {{'c': confidence, 'e': -evidence_id}}) AS source_text FROM evidence WHERE confidence IS NOT NULL GROUP BY 1)
SELECT signature, string_agg(fact_id, '|' ORDER BY fact_id) AS fact_ids, arg_min(fact_id, {{'c': -confidence, 'f': fact_id}}) FILTER (confidence IS NOT NULL) AS best_fact_id,
  arg_min(source_text, {{'c': -confidence, 'f': fact_id}}) FILTER (confidence IS NOT NULL) AS best_text, max(confidence) AS best_confidence
FROM l LEFT JOIN e USING (fact_id) WHERE signature <> '' AND fact_id <> '' GROUP BY signature""",
    "facts_upsert": f"""WITH {CF} SELECT {KEY}, {_first_specific('subject_type', 'row_id')} AS subject_type, {_first_specific('object_type', 'row_id')} AS object_type,
CASE WHEN bool_or(dataset_scope = 'runtime') THEN 'runtime' ELSE arg_min(dataset_scope, row_id) END AS dataset_scope, count(*) AS deliveries FROM f GROUP BY {KEY}""",
    "entities_rebuild": f"""WITH {CF}, t AS (
SELECT name, {_first_specific('entity_type', 'seq')} AS entity_type, count(*) AS mentions FROM (
  SELECT subject AS name, subject_type AS entity_type, row_id * 2 AS seq FROM f UNION ALL SELECT object, object_type, row_id * 2 + 1 FROM f) WHERE name <> '' GROUP BY name)
SELECT name, CASE WHEN entity_type = '' THEN 'other' ELSE entity_type END AS entity_type, mentions FROM t""",
    "store_stats": f"""WITH {CF} SELECT count(*) AS facts, count(*) FILTER (dataset_scope = 'runtime') AS runtime_facts, count(*) FILTER (dataset_scope <> 'runtime') AS other_facts,
count(DISTINCT predicate) AS predicates, count(DISTINCT source_book) AS books, (SELECT count(DISTINCT n) FROM (SELECT subject AS n FROM f UNION ALL SELECT object FROM f) WHERE n <> '') AS nodes,
(SELECT count(*) FROM evidence) AS evidence FROM f""",
    "stats_top_predicates": f"WITH {CF} SELECT predicate, count(*) AS n FROM f GROUP BY predicate ORDER BY n DESC, predicate LIMIT 15",
    "stats_top_books": f"WITH {CF} SELECT source_book, count(*) AS n FROM f GROUP BY source_book ORDER BY n DESC, source_book LIMIT 10",
    "orphan_evidence": f"SELECT evidence_id FROM evidence WHERE {trim('fact_id')} NOT IN (SELECT {trim('fact_id')} FROM fact_members)",
    "delta_facts": f"WITH {CF}, {_OLD}, {_DELTA} SELECT row_id, {KEY} FROM delta",
    "delta_profile": f"WITH {CF}, {_OLD}, {_DELTA} "
    + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM delta GROUP BY {c}" for c in ("predicate", "source_book", "subject_type", "dataset_scope")),
    "delta_evidence": f"""WITH {CF}, {_OLD}, {_DELTA} SELECT DISTINCT evidence_id, {trim('fact_id')} AS fact_id, source_book FROM evidence
WHERE {trim('fact_id')} IN (SELECT unnest(ids) FROM delta) AND {trim('fact_id')} NOT IN (SELECT {trim('fact_id')} FROM evidence WHERE recorded_at < TIMESTAMP '{CUTOFF}')""",
    "publish_merge": f"""WITH {CF}, {_OLD}, u AS (SELECT *, {{'s': 0, 'r': row_id}} AS k FROM new UNION ALL SELECT *, {{'s': 1, 'r': row_id}} FROM old)
SELECT {KEY}, n_rows, fact_id, fact_ids FROM ({_merged('u', 'k')})""",
    "delete_books": f"""WITH {CF}, l AS (SELECT * FROM f WHERE source_book NOT IN ('{"', '".join(BOOKS)}'))
SELECT 'facts' AS what, count(*) AS n FROM l
UNION ALL SELECT 'evidence', count(*) FROM evidence WHERE {trim('fact_id')} IN (SELECT unnest(ids) FROM l)
UNION ALL SELECT 'orphan_entities', count(*) FROM (SELECT subject FROM f UNION SELECT object FROM f EXCEPT (SELECT subject FROM l UNION SELECT object FROM l)) WHERE subject <> ''""",
    "delete_books_orphans": f"""WITH {CF}, l AS (SELECT * FROM f WHERE source_book NOT IN ('{"', '".join(BOOKS)}'))
SELECT subject AS name FROM (SELECT subject FROM f UNION SELECT object FROM f EXCEPT (SELECT subject FROM l UNION SELECT object FROM l)) WHERE subject <> ''""",
    "snapshot_compare": f"""WITH {CF}, {_OLD} SELECT source_book, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta
FROM (SELECT source_book, count(*) AS n FROM old GROUP BY ALL) a FULL JOIN (SELECT source_book, count(*) AS n FROM f GROUP BY ALL) b USING (source_book)""",
    "majority_type": f"""WITH {CF}, c AS (SELECT subject, subject_type, count(*) AS votes, min(row_id) AS first FROM f WHERE subject_type <> '' GROUP BY ALL)
SELECT subject, subject_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY votes DESC, first) AS k FROM c) WHERE k = 1""",
    "evidence_insert_or_ignore": f"""WITH e AS (SELECT *, {trim('fact_id')} AS fid FROM evidence), old AS (SELECT * FROM e WHERE recorded_at < TIMESTAMP '{CUTOFF}')
SELECT min(evidence_id) AS evidence_id, fid AS fact_id FROM e WHERE (recorded_at >= TIMESTAMP '{CUTOFF}' OR recorded_at IS NULL) AND fid <> '' AND fid NOT IN (SELECT fid FROM old) GROUP BY fid""",
    "entity_relations": f"{REL} SELECT qid, anchor, direction, place, predicate, target, target_type, row_id FROM rel WHERE place <= 20",
    "relation_clusters": f"WITH {CF}, {SYM} {CLUSTER.format(by='anchor', source='s')}",
    "entity_lookup": f"""{REL}, c AS ({CLUSTER.format(by='qid, anchor', source='(SELECT * FROM rel WHERE place <= 1000)')}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY evidence_count DESC, {_TIE}) AS rank_support,
  row_number() OVER (PARTITION BY qid ORDER BY max_confidence DESC NULLS LAST, avg_confidence DESC NULLS LAST, {_TIE}) AS rank_confidence,
  row_number() OVER (PARTITION BY qid ORDER BY book_count DESC, chapter_count DESC, {_TIE}) AS rank_spread,
  row_number() OVER (PARTITION BY qid ORDER BY length(best_text) DESC, {_TIE}) AS rank_text FROM c),
t AS (SELECT *, 1.0::DOUBLE / (20 + rank_support) + 1.0::DOUBLE / (20 + rank_confidence) + 1.0::DOUBLE / (20 + rank_spread) + 1.0::DOUBLE / (20 + rank_text) AS total FROM r),
n AS (SELECT *, round(total / max(total) OVER (PARTITION BY qid), 6) AS fusion FROM t)
SELECT * FROM (SELECT qid, anchor, row_number() OVER (PARTITION BY qid ORDER BY fusion DESC, {_TIE}) AS place, predicate, target, direction, evidence_count, fusion, rank_support, rank_confidence, rank_spread, rank_text FROM n) WHERE place <= 12""",
    "relation_score": f"""WITH {CF}, {SYM}, c AS ({CLUSTER.format(by='anchor, source_book', source='s').replace("count(DISTINCT source_book) AS book_count, ", "")}),
q AS (SELECT *, source_book || '载' || anchor || '与' || target AS query FROM c)
SELECT anchor, max(round((CASE WHEN predicate <> '' AND contains(query, predicate) THEN 20.0 ELSE 0.0 END + CASE WHEN target <> '' AND contains(query, target) THEN 18.0 ELSE 0.0 END
  + CASE WHEN source_book <> '' AND contains(query, source_book) THEN 80.0 ELSE 0.0 END + CASE WHEN contains(best_text, target) THEN 5.0 ELSE 0.0 END)::DOUBLE
  + least(evidence_count, 5) * 2.0 + coalesce(max_confidence, 0), 6)) AS best_score, count(*) AS n FROM q GROUP BY anchor""",
    "path_neighbours": f"""WITH {CF}, {SYM}, p AS (
SELECT *, CASE predicate {' '.join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items())} ELSE 999 END AS priority FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY anchor, target ORDER BY priority, best_confidence DESC NULLS LAST, direction, predicate, row_id) AS k FROM p)
SELECT * FROM (SELECT anchor, target, row_number() OVER (PARTITION BY anchor ORDER BY priority, best_confidence DESC NULLS LAST, target) AS place, priority, predicate, direction, row_id FROM o WHERE k = 1) WHERE place <= 24""",
    "adjacent_names": f"""WITH {CF}, a AS (SELECT subject AS name, object AS other FROM f WHERE subject <> '' AND object <> '' UNION SELECT object, subject FROM f WHERE subject <> '' AND object <> '')
SELECT name, count(*) AS neighbours FROM a GROUP BY name""",
    "books_by_keyword": f"WITH {CF} SELECT source_book, count(*) AS n, count(DISTINCT subject) AS subjects FROM f WHERE lower(source_book) LIKE '%方%' GROUP BY source_book",
    "book_facts_tiered": f"""WITH {CF}, q(qid, book) AS (VALUES (1, '云岭方录'), (2, '方'), (3, '不存之书')),
m AS (SELECT DISTINCT qid, source_book, CASE WHEN source_book = book THEN 0 ELSE 1 END AS tier FROM f JOIN q ON contains(source_book, book)),
b AS (SELECT * FROM m QUALIFY tier = min(tier) OVER (PARTITION BY qid))
SELECT qid, source_book, tier, count(*) AS n FROM f JOIN b USING (source_book) GROUP BY ALL""",
}
