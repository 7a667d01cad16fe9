"""Recovery of rows from model output, selection, and evidence items."""

from pyspark.sql import functions as F

from kgloom.operators import evidence, recovery


def test_blocks_and_rows():
    rows = lambda t: [r for b in recovery.blocks(t) for r in recovery.rows_of(recovery.parse(b))]
    assert rows('x {"a": "1}"} y [{"a": 2}, 3]') == [{"a": "1}"}, {"a": 2}]
    assert rows('<think>{"a": 0}</think>```json\n{"triples": [{"a": 1,},]}\n```') == [{"a": 1}]
    assert rows("{'a': 'b', 'c': None}") == [{"a": "b", "c": None}]
    assert rows('{"a": "whole", "b": "cut') == [{"a": "whole"}]
    assert rows("") == rows(None) == rows("no braces") == rows("{]") == []


def test_recover_keeps_order_and_nulls(frame):
    df = frame([(1, '[{"s": "a"}, {"s": null, "o": 5}]', 9), (2, None, 9), (3, "", 9)], "k int, t string, seq int")
    assert [tuple(r) for r in recovery.recover(df, "k", "t", ["s", "o"]).orderBy("seq").collect()] == [(1, 0, "a", None), (1, 1, None, "5")]
    assert recovery.recover(df.filter("false"), "k", "t", ["s"]).count() == 0


def test_mmr_avoids_copies(frame):
    pool = frame([(1, 1, 1.0, ["a", "b"], "s"), (1, 2, 0.99, ["a", "b"], "s"), (1, 3, 0.9, ["c"], "t")], "qid int, doc_id int, score double, tokens array<string>, source string")
    assert {r.pick: r.doc_id for r in recovery.mmr(pool, 2).collect()} == {1: 1, 2: 3}


def test_items_merge(frame):
    rows = frame([("b", " x ", 0.5), ("b", "x", 0.9), (None, None, 0.1), ("c", "　", 1.0)], "source string, text string, score double")
    got = evidence.merge_items([evidence.items("k", rows, F.col("source"), F.col("text"), F.col("score"))]).collect()
    assert [tuple(r) for r in got] == [("k", "b", "x", 0.9, 2)]


def test_numbered_ids(frame):
    rows = frame([(2, "c"), (1, "c"), (3, None)], "row_id int, chapter string")
    assert {r.row_id: r.emitted_id for r in evidence.numbered_ids(rows, "chapter", "row_id", "kg").collect()} == {1: "kg:c:0000001", 2: "kg:c:0000002", 3: "kg::0000001"}
