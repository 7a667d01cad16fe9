"""Rule tables: families, hints, rewrites and their edge cases."""

import pytest
from pyspark.sql import functions as F

from kgloom.operators import governance as G

RULE = "ord int, predicate string, subject_type string, object_type string, object string, same boolean, action string, new_predicate string, new_subject_type string, new_object_type string"
FAMILY = "predicate string, normalized string, family string, parent string, symmetric boolean"


def test_families_follow_parents_and_survive_cycles(frame):
    rows = [("a", None, None, "b", None), ("b", "B", None, "c", True), ("c", None, "f", None, None), ("x", None, None, "y", None), ("y", None, None, "x", None), ("z", None, None, "lost", None)]
    got = {r.predicate: (r.normalized, r.family, r.symmetric) for r in G.families(frame(rows, FAMILY)).collect()}
    assert got == {"a": ("a", "f", False), "b": ("B", "f", True), "c": ("c", "f", False), "x": ("x", None, False), "y": ("y", None, False), "z": ("z", None, False)}
    with pytest.raises(ValueError):
        G.families(frame([(str(i), None, None, None, None) for i in range(G.MOST_RULES + 1)], FAMILY))


def test_first_rule_wins_and_nulls_fit_all(frame):
    facts = frame([(1, "p", "s", "o", "p", ["i1", "i2"]), (2, "p", "s", "o", "x", ["i2"]), (3, "q", None, "o", "x", []), (4, None, "s", "o", None, None)], "row_id int, predicate string, subject_type string, object_type string, object string, ids array<string>")
    rules = frame([(2, "p", None, None, None, None, "rewrite", "r", None, "t"), (1, None, None, None, None, True, "delete", None, None, None)], RULE)
    marked = G.governed(facts, rules)
    assert {r.row_id: (r.action, r.predicate, r.object_type) for r in marked.collect()} == {1: ("delete", "p", "o"), 2: ("rewrite", "r", "t"), 3: ("keep", "q", "o"), 4: ("keep", None, "o")}
    proof = frame([(10, "i1"), (11, "i2"), (12, "i3")], "evidence_id int, fact_id string")
    assert [r.evidence_id for r in G.dropped_evidence(marked, proof).collect()] == [10]
    assert G.governed(facts.filter("false"), rules).count() == 0 and {r.action for r in G.governed(facts, rules.filter("false")).collect()} == {"keep"}


def test_selectors(frame):
    books = frame([(1, "甲方"), (2, "乙书"), (3, "丙方")], "ordinal int, book_name string")
    pick = lambda *t: {(r.ordinal, r.selector) for r in G.selected_books(books, t).collect()}
    assert pick() == {(1, 0), (2, 0), (3, 0)} and pick("2", "方") == {(2, 1), (1, 2), (3, 2)} and pick("9") == set()


def test_names_and_sources(frame):
    rows = frame([("桂枝汤", "此方以桂枝九克配芍药。"), ("x", None), (None, ""), ("桂枝，汤", "short"), ("某某方论", "<b>桂枝九克配芍药汤方</b>")], "n string, s string")
    assert [(r.a, r.b) for r in rows.select(G.clean_name(F.col("n")).alias("a"), G.clean_source(F.col("s")).alias("b")).collect()] == [(True, True), (False, False), (False, False), (False, False), (False, False)]


def test_yield(frame):
    rows = frame([(1, "a", 1), (1, "b", 5), (2, "a", 3), (3, "a", 1), (4, None, None)], "chunk int, block string, n int")
    assert {r.chunk: r.diagnosis for r in G.yield_diagnosis(rows).collect()} == {1: "first_block_only", 2: "fine", 3: "low_yield", 4: "no_json"}
