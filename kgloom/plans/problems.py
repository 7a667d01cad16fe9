"""Driver queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgloom.operators.references import Reference, orphan_references, orphan_report
from kgloom.session import table


def references(spark: SparkSession, d: str) -> list[Reference]:
    """The three references of the test tables."""
    facts, evidence, members, entities = (table(spark, d, t) for t in ("facts", "evidence", "fact_members", "entities"))
    return [
        Reference("facts", facts, "subject", "extracted_at", "row_id", entities, "name", "created_at", "deleted_at"),
        Reference("evidence", evidence, "fact_id", "recorded_at", "evidence_id", facts, "fact_id", "extracted_at"),
        Reference("fact_members", members, "fact_id", "linked_at", "fact_id", evidence, "fact_id", "recorded_at"),
    ]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(references(spark, d))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(references(spark, d))


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x{{00a0}}\x{{3000}}]+|[\s\x{{00a0}}\x{{3000}}]+$', '', 'g')"


def _broken(tab: str, key: str, time: str, row_key: str, parent: str, parent_key: str, came: str, live: str) -> str:
    return f"""
SELECT DISTINCT '{tab}' AS source_table, {row_key} AS row_key,
  CASE WHEN p.k IS NULL THEN 'missing' WHEN NOT p.live THEN 'deleted' ELSE 'late' END AS ref_state,
  coalesce(strftime(c.{time}, '%Y-%m'), 'unknown') AS ref_month
FROM {tab} c LEFT JOIN (
  SELECT {_trim(parent_key)} AS k, bool_or({live}) AS live, min({came}) AS came, bool_or({came} IS NULL) AS unsure FROM {parent} GROUP BY 1
) p ON p.k = {_trim('c.' + key)}
WHERE {_trim('c.' + key)} <> '' AND (p.k IS NULL OR NOT p.live OR (NOT p.unsure AND p.came > c.{time}))"""


_FOUND = " UNION ALL ".join(
    (
        _broken("facts", "subject", "extracted_at", "CAST(row_id AS VARCHAR)", "entities", "name", "created_at", "deleted_at IS NULL"),
        _broken("evidence", "fact_id", "recorded_at", "CAST(evidence_id AS VARCHAR)", "facts", "fact_id", "extracted_at", "true"),
        _broken("fact_members", "fact_id", "linked_at", _trim("c.fact_id"), "evidence", "fact_id", "recorded_at", "true"),
    )
)

QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
SQL = {"p4_found": _FOUND, "p4_report": f"SELECT source_table, ref_month, ref_state, count(*) AS n_refs FROM ({_FOUND}) GROUP BY ALL"}
