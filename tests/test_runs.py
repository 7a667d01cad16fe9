"""Capped selection against the plain greedy loop, grading, replay, folds and lists."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kgloom.operators import benchmark, runs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_capped_selection_equals_the_greedy_loop(frame, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("abcd" if rng.random() < 0.6 else "efghijk"), rng.choice(["x", "x", "y", "z", None])) for i in range(80)]
    used_s, used_b, want = Counter(), Counter(), []
    for i, s, b in rows:
        if used_s[s] < 3 and used_b[b] < 7:
            want.append(i)
            used_s[s] += 1
            used_b[b] += 1
    got = benchmark.capped(frame(rows, "i int, s string, b string"), "i", {"s": 3, "b": 7}).filter("taken").collect()
    assert sorted(r.i for r in got) == want
    assert benchmark.capped(frame([], "i int, s string, b string"), "i", {"s": 3}).count() == 0


def test_task_scores_take_the_first_submission(frame):
    form = "case string, seq int, a array<string>, b array<string>, c array<string>, d string"
    sent = frame([("1", 1, ["x", "y"], [], ["z"], "甲乙"), ("1", 2, ["x"], ["x"], ["x"], "甲"), ("9", 1, [], [], [], None)], form)
    gold = frame([("1", ["x"], ["q"], ["z"], "甲丙"), ("2", [], [], [], "")], "case string, a array<string>, b array<string>, c array<string>, d string")
    got = benchmark.task_scores(sent, gold).collect()
    assert [(r.case, r.score_a, r.score_b, r.score_c, r.score_d, round(r.score, 4)) for r in got] == [("1", 0.5, 0.0, 1.0, 0.5, 0.55)]


def test_cases_without_hits_fail(frame):
    hits = frame([(1, 1, "桂枝汤出自", "伤寒论"), (1, 2, "芍药", "他书")], "qid int, place int, text string, book string")
    cases = frame([(1, "answer", "桂枝", ["芍药"], ["伤寒"]), (2, "source", "麻黄", [], [])], "qid int, family string, subject string, answers array<string>, books array<string>")
    got = {r.qid: r for r in benchmark.regraded(hits, cases).collect()}
    assert (got[1].top1_success, got[1].topk_success, got[1].top1_book) == (False, True, True)
    assert (got[2].top1_success, got[2].topk_success) == (False, False)


def test_replay_order_and_cutoff(frame):
    rows = frame([("a", 1, "k"), ("b", 1, "k"), ("c", 5, "k"), ("c", 6, "m")], "run string, line int, key string")
    known = frame([("a", "2025-03-01"), ("b", "2025-01-01"), ("c", None)], "run string, at string").select("run", F.to_timestamp("at").alias("published_at"))
    cut = F.lit("2025-02-01").cast("timestamp")
    pick = lambda **o: sorted((r.key, r.run, r.deliveries) for r in runs.replay(rows, known, cut, ["key"], **o).collect())
    assert pick() == [("k", "b", 1)]
    assert pick(include=["c", "a"], exclude=["b"]) == [("k", "a", 2), ("m", "c", 1)]


def test_fold_fills_empty_content_only(frame):
    events = frame([(1, 1, "token", "甲", None), (1, 2, "token", "乙", None), (1, 3, "done", "丙", None), (2, 1, "tool_start", None, "t"), (2, 2, "done", "丁", None), (2, 3, "note", "n", None), (2, 4, "note", "n", None)], "m int, seq int, kind string, text string, name string")
    got = {r.m: r for r in runs.folded(events, "m", ["seq"]).collect()}
    assert (got[1].content, got[2].content, got[2].open_tools, got[2].notes, got[1].tools) == ("甲乙", "丁", "t", "n", "")


def test_paths_and_citations(frame):
    row = frame([(["qa://x", "book://b", "chapter://b/c", "book://b", "zz://y"],)], "p array<string>")
    got = row.select(runs.ordered_paths(F.col("p")).alias("o"), runs.best_path(F.col("p"), F.array(F.lit("n"), F.lit("b"))).alias("b"), runs.path_matches(F.lit("book://ab"), F.lit("book://abc")).alias("m"), runs.path_matches(F.lit("book://ab"), F.lit("book://abc"), True).alias("n")).first()
    assert got.o == ["chapter://b/c", "book://b", "qa://x", "zz://y"] and got.b == "chapter://b/c" and got.m and not got.n
    empty = frame([([],)], "p array<string>").select(runs.best_path(F.col("p"), F.array(F.lit("b"))).alias("b")).first()
    assert empty.b is None


def test_numbers(frame):
    rows = frame([("x",), (None,), ("1.5",), ("-2",), ("0.25",)], "t string").select(runs.confidence(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == [0.7, 0.7, 1.0, 0.0, 0.25]
    left = frame([(0, 9, 60), (3, 9, 1800), (9, 9, 60)], "d int, t int, s int").select(runs.remaining(F.col("d"), F.col("t"), F.col("s")).alias("l")).collect()
    assert [r.l for r in left] == ["unknown", "1:00:00", "0:00:00"]


def test_workbook(spark, tmp_path):
    import zipfile

    from kgloom.sources.readers import read_xlsx

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>题</t></si><si><r><t>答</t></r><r><t>案</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>3</v></c><c r="B2"><v>9</v></c></row><row><c r="C3" t="inlineStr"><is><t>好</t></is></c></row></sheetData></worksheet>')
    got = read_xlsx(spark, f"file://{tmp_path}/a.xlsx")
    assert got.columns == ["题", "答案"] and [tuple(r) for r in got.collect()] == [("3", None), (None, "好")]
