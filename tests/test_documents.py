"""Documents from books, case search helpers and the evidence graph, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from kgloom.operators import cases, documents, matching, paths
from kgloom.plans.case_queries import QUERIES


def test_paragraph_chunks_keep_whole_paragraphs():
    rng = random.Random(5)
    for _ in range(200):
        given = ["字" * rng.randint(1, 60) for _ in range(rng.randint(0, 12))]
        got = documents.paragraph_chunks(given, 100, 30)
        parts = [c.split("\n") for c in got]
        rebuilt = list(parts[0]) if parts else []
        for before, now in zip(parts, parts[1:], strict=False):
            k = next(k for k in range(1, len(before) + 1) if sum(map(len, before[-k:])) >= 30 or k == len(before))
            assert now[:k] == before[-k:] and len(now) > k
            rebuilt += now[k:]
        assert rebuilt == given


def test_chunks_of_texts(frame):
    df = frame([(1, "甲\n\n 乙 \n丙"), (2, None), (3, " \n ")], "k int, t string")
    assert [tuple(r) for r in documents.chunk_paragraphs(df, "k", "t", 3, 1).collect()] == [(1, 1, "甲\n乙"), (1, 2, "乙\n丙")]


def test_leaves_know_their_parents(frame):
    s = documents.numbered_sections(frame([("书", 1, "", "甲\n乙"), ("书", 2, "篇", None)], "b string, o int, t string, x string"), "b", "o")
    parents = {r.chunk_id: r.text for r in documents.parents(s, "b", "t", "x").collect()}
    leaves = documents.leaves(s, "b", "t", "x").collect()
    assert parents == {"classic::书::0001": "古籍：书\n篇名：书\n甲\n乙", "classic::书::0002": "古籍：书\n篇名：篇\n"}
    assert [(r.chunk_id, r.parent, r.path, r.text) for r in leaves] == [("classic::书::0001::01", "classic::书::0001", "classic://书/0001-01", "古籍：书\n篇名：书\n甲\n乙")]


def test_body_chunks_cover_the_book(frame):
    rng = random.Random(6)
    rows = [("书", i, f"篇{i}", "".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(0, 120)))) for i in range(1, 15)] + [("空", 1, "x", None)]
    got = documents.body_chunks(frame(rows, "b string, section_no int, t string, x string"), "b", "t", "x", 50, 10).orderBy("chunk_no").collect()
    whole = "\n\n".join(x for _, _, _, x in rows[:-1] if x)
    assert [r.chunk for r in got] == [whole[i : i + 50] for i in range(0, len(whole), 40) if i == 0 or i + 10 < len(whole)]
    assert all(r.start_at == 40 * r.chunk_no for r in got) and {r.b for r in got} == {"书"}


def test_formula_titles_look_ahead(frame):
    lines = ["桂枝汤", "x", "属性：一", "麻黄汤", "a", "b", "c", "d", "属性：二", "卷一汤", "属性：三", "桂枝汤", "属性：四"]
    df = frame([(1, i, x) for i, x in enumerate(lines, 1)], "k int, line_no int, line string")
    assert [(r.place, r.title) for r in documents.formula_titles(df, "k", "属性：").collect()] == [(1, "桂枝汤")]


def test_anchors(frame):
    docs = frame([(1, "".join(chr(0x4E00 + i) for i in range(100))), (2, "短"), (3, None)], "k int, t string")
    found = documents.anchors(docs, "k", "t", 10)
    assert found.count() == 5
    chunks = frame([(i, "".join(chr(0x4E00 + j) for j in range(20 * i, 20 * i + 30))) for i in range(4)], "c int, x string")
    assert [tuple(r) for r in documents.anchored(found, chunks, "k", "c", "x").collect()] == [(1, 4, 5, 5)]


def test_anchors_beyond_an_automaton(frame, monkeypatch, capsys):
    """The same counts with more anchors than one automaton holds, without a row for each character of a chunk."""
    monkeypatch.setattr(matching.scan, "__defaults__", (*matching.scan.__defaults__[:-1], 1))
    found = frame([(1, "head", "乙丙丁"), (1, "tail", "戊己庚"), (2, "head", "甲乙丙"), (3, "head", "丙丁戊")], "k int, at string, snippet string")
    chunks = frame([(1, "甲乙 丙丁戊"), (2, "乙丙丁甲乙丙"), (3, None), (4, "")], "c int, x string")
    got = documents.anchored(found, chunks, "k", "c", "x")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 2), (2, 1, 1, 2), (3, 1, 1, 1)]
    got.explain()
    assert "Generate" not in capsys.readouterr().out


def records_shuffled(df):
    """Rows that the shuffles of a frame write, all its rows made."""
    df.collect()

    def total(node):
        name, inner = node.nodeName(), node.children()
        if name.startswith("AdaptiveSparkPlan"):
            return total(node.executedPlan())
        if "QueryStage" in name:
            return total(node.plan())
        own = node.metrics().get("shuffleRecordsWritten").get().value() if node.metrics().contains("shuffleRecordsWritten") else 0
        return own + sum(total(inner.apply(i)) for i in range(inner.size()))

    return total(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("most_chars", [10_000, 1])
def test_anchors_in_many_chunks_are_added_up_in_tasks(frame, monkeypatch, most_chars):
    """Anchors that stand in every chunk leave a task as one row each, not one for each chunk."""
    monkeypatch.setattr(matching.scan, "__defaults__", (*matching.scan.__defaults__[:-1], most_chars))
    common = [chr(0x4E00 + 3 * i) + chr(0x4E01 + 3 * i) + chr(0x4E02 + 3 * i) for i in range(30)]
    found = frame([(i, "head", c) for i, c in enumerate(common)] + [(99, "head", "无此文")], "k int, at string, snippet string")
    chunks = frame([(i, 1, "".join(common)) for i in range(1000)], "d long, c int, x string").select(F.struct("d", "c").alias("c"), "x")
    got = documents.anchored(found, chunks, "k", "c", "x")
    assert sorted(map(tuple, got.collect())) == [(i, 1, 1, 1000) for i in range(30)] + [(99, 0, 1, 0)]
    assert records_shuffled(got) < 1000


@pytest.mark.parametrize("most_chars", [10_000, 1])
def test_anchors_count_keys_once(frame, monkeypatch, most_chars):
    """A key that stands in several rows is one chunk, a null key none; the others are counted as they are."""
    monkeypatch.setattr(matching.scan, "__defaults__", (*matching.scan.__defaults__[:-1], most_chars))
    rng = random.Random(7)
    names = ["甲乙", "乙丙", "丙丁", "丁甲", "甲甲"]
    rows = [(rng.choice([None, *range(60)]), "".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(0, 6)))) for _ in range(90)] + [(61, None), (None, "戊己"), (62, "己庚")]
    found = frame([(i, "head", n) for i, n in enumerate([*names, "戊己", "己庚", "庚辛"])], "k int, at string, snippet string")
    want = [(i, int(any(t and n in t for _, t in rows)), 1, len({k for k, t in rows if k is not None and t and n in t})) for i, n in enumerate([*names, "戊己", "己庚", "庚辛"])]
    for kind in ("int", "string", "struct<a:int,b:int>"):
        keyed = frame(rows, "c int, x string")
        key = F.when(F.col("c").isNotNull(), F.struct(F.lit(None).cast("int").alias("a"), F.col("c").alias("b"))) if kind.startswith("struct") else F.col("c").cast(kind)
        assert sorted(map(tuple, documents.anchored(found, keyed.select(key.alias("c"), "x"), "k", "c", "x").collect())) == want


def test_anchor_matches_asks_about_every_document(spark, frame, tmp_path):
    """Whatever its number, each document long enough for an anchor is asked about."""
    texts = {i: "".join(chr(0x4E00 + 50 * i + j) for j in range(40)) for i in (1, 7, 20, 33)}
    frame([*texts.items(), (2, texts[1]), (3, "短"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.found, r.anchors, r.chunks) for r in QUERIES["anchor_matches"](spark, str(tmp_path)).collect()}
    assert got == {1: (5, 5, 10), 2: (5, 5, 10), 7: (5, 5, 5), 20: (5, 5, 5), 33: (5, 5, 5)}


def test_headers(frame):
    rows = frame([("书名： 甲书\n篇名：\n文", "classic://乙/丙", "x/01-丁.txt", 3), ("文", "classic://乙/丙-01", None, 0), ("", None, "x/01_丁.txt", 7), (None, None, None, None)], "t string, p string, f string, n int")
    got = rows.select(documents.header_book(F.col("t"), F.col("p"), F.col("f")).alias("b"), documents.header_chapter(F.col("t"), F.col("p"), F.col("n")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("甲书", "丙"), ("乙", "丙-01"), ("丁", "0007"), ("", "")]


def test_case_profile_and_bonuses(frame):
    got = cases.profile(frame([(1, "患者45岁男，胃痛，桂枝汤可否"), (2, "桂枝汤的组成"), (3, None)], "qid int, query string")).collect()
    assert [(r.intent, r.age_said, r.sexes) for r in got] == [("case", "45", ["男"]), ("formula_composition", None, []), ("generic", None, [])] and got[0].symptoms[-1:] == ["胃痛"]
    lengths = frame([("x" * n,) for n in (0, 5, 12, 180, 181, 320, 321)] + [(None,)], "a string")
    assert [r.b for r in lengths.select(cases.answer_bonus(F.col("a")).alias("b")).collect()] == [0.0, -0.04, 0.08, 0.08, 0.05, 0.05, 0.02, 0.0]


def test_evidence_graph_caps_keep_totals(frame):
    rows = [(1, i, "甲", f"乙{i}", None if i % 2 else "治", i) for i in range(5)] + [(1, 9, "甲", "乙0", "治", 50), (1, 10, "", "丙", "治", 1)]
    nodes, edges = paths.evidence_graph(frame(rows, "g int, seq int, source string, target string, predicate string, evidence int"), "g", "seq", 3, 4)
    assert [(r.node, r.evidence, r.nodes) for r in nodes.orderBy("place").collect()] == [("甲", 60, 6), ("乙0", 50, 6), ("乙4", 4, 6)]
    assert [(r.target, r.predicate, r.evidence, r.edges) for r in edges.orderBy("place").collect()] == [("乙0", "治", 50, 5), ("乙1", "相关", 1, 5), ("乙2", "治", 2, 5), ("乙3", "相关", 3, 5)]
