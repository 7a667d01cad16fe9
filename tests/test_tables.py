"""Table joins, option lists and small reports."""

from pyspark.sql import functions as F

from kgloom.operators import tables


def test_bridge(frame):
    a = frame([("h", "1"), ("h", "1"), ("g", None), (None, "2")], "herb string, id string")
    b = frame([("1", "x"), ("1", "y"), ("2", "z")], "id string, code string")
    assert sorted(map(tuple, tables.bridge([(a, "herb", "id"), (b, "id", "code")], "herb", "code").collect())) == [("h", "x"), ("h", "y")]


def test_options_and_answers(frame):
    row = frame([("a：一；B: 二 ;none；b:三", "bax"), (None, None), ("", "A")], "t string, l string").select(tables.options(F.col("t")).alias("o"), tables.answer_texts(F.col("l"), tables.options(F.col("t"))).alias("a")).collect()
    assert [(r.o, r.a) for r in row] == [({"A": "一", "B": "二"}, ["二", "一"]), ({}, []), ({}, [])]


def test_expectation(frame):
    rows = frame([(["a", "b"], ["b", "c"]), ([], []), (["x"], []), ([], ["y"])], "f array<string>, e array<string>")
    assert [r.s for r in rows.select(tables.expectation(F.col("f"), F.col("e")).alias("s")).collect()] == [0.5, 0.0, 1.0, 0.0]


def test_spans(frame):
    found = frame([(1, "桂枝", 4), (1, "桂枝汤", 4), (1, "汤药", 6), (1, "甘草", 1), (2, "枣", 9)], "qid int, name string, at int")
    got = sorted((r.qid, r["at"], r.name) for r in tables.resolve_spans(found).collect())
    assert got == [(1, 1, "甘草"), (1, 4, "桂枝汤"), (2, 9, "枣")]
    assert tables.resolve_spans(found.filter("false")).count() == 0
