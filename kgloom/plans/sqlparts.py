"""Pieces of SQL that several driver queries share."""


def trim(x: str) -> str:
    return f"trim(coalesce({x}, ''), ' ' || chr(12288) || chr(160) || chr(9) || chr(10))"


IDS = "list_filter(list_transform(string_split(coalesce(fact_ids_text, ''), '|'), lambda x: trim(x)), lambda x: x <> '')"

#: Clean facts, as operators.facts.clean_facts.
F = f"""f AS (
SELECT row_id, {trim('subject')} AS subject, {trim('predicate')} AS predicate, {trim('object')} AS object, {trim('subject_type')} AS subject_type,
  {trim('object_type')} AS object_type, {trim('source_book')} AS source_book, {trim('source_chapter')} AS source_chapter, {trim('dataset_scope')} AS dataset_scope,
  {trim('fact_id')} AS fact_id, best_source_text, best_confidence, extracted_at,
  CASE WHEN len({IDS}) > 0 THEN {IDS} WHEN {trim('fact_id')} <> '' THEN [{trim('fact_id')}] ELSE [] END AS ids
FROM facts)"""

KEY = "subject, predicate, object, source_book, source_chapter"

#: Facts seen from both ends, as operators.relations.symmetric; needs F.
SYM = """s AS (
SELECT row_id, predicate, source_book, source_chapter, best_source_text, best_confidence, subject AS anchor, object AS target, 'out' AS direction,
  subject_type AS anchor_type, CASE WHEN object_type = '' THEN 'other' ELSE object_type END AS target_type FROM f WHERE subject <> '' AND object <> ''
UNION ALL
SELECT row_id, predicate, source_book, source_chapter, best_source_text, best_confidence, object, subject, 'in', object_type,
  CASE WHEN subject_type = '' THEN 'other' ELSE subject_type END FROM f WHERE subject <> '' AND object <> '' AND subject <> object)"""

_WIDE, _NARROW = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")


def contents_sql(x: str) -> str:
    """As operators.matching.contents."""
    return f"regexp_replace(lower(translate(coalesce({x}, ''), '{_WIDE}', '{_NARROW}')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
