"""Names and runs inside texts, against plain loops."""

import math
import random

import pytest

from kgloom.operators import evaluation, evidence, matching
from kgloom.session import shared_folder

ALPHABET = "甲乙丙丁Ab1"


def words(n, seed, least=0, most=12):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(least, most))) for _ in range(n)]


@pytest.mark.parametrize("most_chars", [10_000, 1])
def test_scan_by_automaton_and_by_join(spark, frame, most_chars):
    texts = [(i, t) for i, t in enumerate([*words(60, 1, 0, 40), None, "甲乙甲乙"])]
    names = sorted({w for w in words(40, 2, 1, 4)})
    got = matching.scan(frame(texts, "k int, t string"), frame([(n,) for n in [*names, "", None]], "name string"), "k", "t", most_chars)
    want = sorted((k, n, t.find(n) + 1) for k, t in texts if t for n in names if n in t)
    assert sorted(map(tuple, got.collect())) == want


def test_scan_of_long_names_beyond_an_automaton(frame, monkeypatch, capsys):
    """Starts of texts as names: substrings of a text are compared in place, no row is made of each of its characters."""
    monkeypatch.setattr(matching, "MOST_NAMES", 100)  # several passes
    texts = [*words(40, 3, 300, 600), "𠀀甲" * 200, "", "甲" * 700]
    names = sorted({t[a : a + n] for t in texts for a in (0, 7) for n in (1, 2, 3, 17, 64, 100, 220)} - {""})
    got = matching.scan(frame(list(enumerate(texts)), "k int, t string"), frame([(n,) for n in names], "name string"), "k", "t", 1)
    assert sorted(map(tuple, got.collect())) == sorted((k, n, t.find(n) + 1) for k, t in enumerate(texts) for n in names if n in t)
    got.explain()
    assert "Generate" not in capsys.readouterr().out


def test_scan_of_nothing(frame):
    empty = frame([], "name string")
    assert matching.scan(frame([(1, "甲")], "k int, t string"), empty, "k", "t").count() == 0
    assert matching.scan(frame([], "k int, t string"), frame([("甲",)], "name string"), "k", "t").count() == 0


@pytest.mark.parametrize("block_chars", [10_000, 40])
def test_common_runs_against_all_substrings(frame, block_chars):
    items = [(i, p) for i, p in enumerate([*words(12, 3, 10, 60), None, ""])]
    r = random.Random(4)
    docs = [(i, t) for i, t in enumerate([*words(20, 5, 0, 60), None])]
    for i, p in items[:12]:  # edited copies, other case and marks
        cut = p[r.randint(0, 5) :].lower()
        docs.append((100 + i, f"乙，{cut[:8]}。{cut[8:]} 丁"))
    got = matching.common_runs(frame(docs, "doc_id int, text string"), frame(items, "qid int, passage string"), least=7, block_chars=block_chars)
    clean = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())

    def longest(a, b):
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b):
                now.append(row[j] + 1 if x == y else 0)
            best, row = max(best, *now), now
        return best

    want = sorted((q, k, n) for q, p in items for k, t in docs if (n := longest(clean(p), clean(t))) >= 7)
    assert sorted(map(tuple, got.collect())) == want
    assert want


def test_source_resolution_tiers(frame):
    docs = frame([(1, "方录", "卷一", "前 文甲乙丙丁甲乙丙丁戊己"), (2, "方录", "卷二", "甲乙丙丁甲乙丙丁戊己"), (3, "他书", "卷一", "甲乙丙丁甲乙丙丁戊己"), (4, "方录", None, None)], "doc_id int, book_name string, chapter_title string, text string")
    rows = [(1, "方录", "卷二", "甲乙丙 丁甲乙丙丁"), (2, "方录", "无", "甲乙丙丁甲乙丙丁戊己"), (3, "方录", "卷一", "甲乙丙"), (4, "", "卷一", "甲乙丙丁甲乙丙丁"), (5, None, None, None)]
    got = evidence.resolve_sources(frame(rows, "k int, book string, chapter string, text string"), docs, "k")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 2), (2, 1, 1)]


def test_unique_sections(frame):
    base = "".join(chr(0x4E00 + i) for i in range(300))
    sections = frame([("书", "一", base[:100]), ("书", "二", base[:50] + base[150:250]), ("书", "二", base[:45]), ("另", "三", base)], "book string, title string, text string")
    rows = [(1, "书", base[:90]), (2, "书", base[:45]), (3, "书", base[:50] + "，" + base[150:190]), (4, "书", base[:10]), (5, "无", base), (6, "书", None)]
    got = evidence.unique_sections(frame(rows, "k int, book string, text string"), sections, "k")
    assert sorted(map(tuple, got.collect())) == [(1, "一", "strict", 90), (3, "二", "loose", 90)]


def test_sign_test_of_many_cases(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(600, 600), (3000, 2900), (5, 1), (0, 0), (2000, 1000)], "w long, l long")
    got = [r[0] for r in rows.select(evaluation.sign_test(F.col("w"), F.col("l"))).collect()]
    exact = lambda w, l: min(1.0, 2 * sum(math.comb(w + l, i) for i in range(min(w, l) + 1)) / 2 ** (w + l))  # noqa: E731, E741
    assert got == pytest.approx([exact(600, 600), exact(3000, 2900), exact(5, 1), 1.0, exact(2000, 1000)], rel=1e-9)


def test_cluster_without_shared_folder_is_an_error():
    class Context:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError):
        shared_folder(Session)
