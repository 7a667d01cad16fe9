"""Core operators on small fixtures: ties, nulls, empty tables, repeats."""

import pytest
from pyspark.sql import functions as F

from kgloom.functions import text as X
from kgloom.functions import tokens as T
from kgloom.operators import corpus, evaluation, facts, graph, records, relations, rules, sections
from kgloom.sources import readers, writers

FACT = "row_id long, subject string, predicate string, object string, subject_type string, object_type string, source_book string, source_chapter string, dataset_scope string, fact_id string, fact_ids_text string, best_source_text string, best_confidence double"


def fact(i, s, p, o, **k):
    base = {"subject_type": "", "object_type": "", "source_book": "b", "source_chapter": "c", "dataset_scope": "sample", "fact_id": f"f{i}", "fact_ids_text": "", "best_source_text": None, "best_confidence": None} | k
    return (i, s, p, o, *(base[c] for c in ("subject_type", "object_type", "source_book", "source_chapter", "dataset_scope", "fact_id", "fact_ids_text", "best_source_text", "best_confidence")))


@pytest.fixture
def store(frame):
    return lambda rows: facts.clean_facts(frame(rows, FACT))


def one(df, column):
    return df.first()[column]


def test_strip(frame):
    got = frame([("　 a b \n",), (None,), ("",)], "x string").select(X.strip_ws("x").alias("s"), X.norm("x").alias("n"), X.blank("x").alias("b")).collect()
    assert [(r.s, r.n, r.b) for r in got] == [("a b", "a b", False), (None, "", True), ("", "", True)]


def test_merge_keeps_first_and_order(store):
    rows = store([fact(2, "a", "p", "b", fact_ids_text="y|x", subject_type="herb"), fact(1, "a ", "p", "b", fact_ids_text="z"), fact(3, "a", "p", "b", fact_ids_text="x|w"), fact(4, "a", "p", None)])
    got = {r.object: r for r in facts.merge_dedup(rows).collect()}
    assert (got["b"].fact_ids, got["b"].fact_id, got["b"].n_rows, got["b"].subject_type) == (["z", "y", "x", "w"], "z", 3, "")
    assert got[""].n_rows == 1
    assert facts.merge_dedup(store([])).count() == 0


def test_merge_is_idempotent(store):
    rows = store([fact(i, "a", "p", str(i % 3), fact_ids_text=f"f{i}") for i in range(9)])
    once = facts.merge_dedup(rows)
    again = once.withColumn("row_id", F.col("first_row")).withColumn("ids", F.col("fact_ids"))
    assert sorted(map(str, facts.merge_dedup(again).select("object", "fact_ids").collect())) == sorted(map(str, once.select("object", "fact_ids").collect()))


def test_first_specific_type_wins(store):
    rows = store([fact(1, "a", "p", "b", subject_type="other"), fact(2, "a", "p", "b", subject_type="herb", dataset_scope="runtime"), fact(3, "a", "p", "b", subject_type="food")])
    got = facts.upsert(rows).first()
    assert (got.subject_type, got.dataset_scope, got.deliveries) == ("herb", "runtime", 3)
    kinds = {r.name: r.entity_type for r in facts.rebuild_entities(rows).collect()}
    assert kinds == {"a": "herb", "b": "other"}


def test_best_evidence(frame):
    members = frame([("s", "f1"), ("s", " f2"), ("s", "f2"), ("u", "f9"), (None, "f1"), ("v", None)], "signature string, fact_id string")
    proof = frame([(1, "f1", 0.5, "one"), (2, "f2", 0.9, "two"), (3, "f2 ", 0.9, "later"), (4, "f2", None, "no")], "evidence_id long, fact_id string, confidence double, source_text string")
    got = {r.signature: r for r in facts.best_evidence(members, proof).collect()}
    assert (got["s"].fact_ids, got["s"].best_fact_id, got["s"].best_text, got["s"].best_confidence) == ("f1|f2", "f2", "two", 0.9)
    assert (got["u"].best_fact_id, got["u"].best_confidence) == (None, None)


def test_delta_and_delete(store, frame):
    old = store([fact(1, "a", "p", "b", fact_ids_text="x")])
    new = store([fact(2, "a", "p", "b"), fact(3, "c", "p", "d", fact_ids_text="x"), fact(4, "e", "p", "f", fact_ids_text="q", source_book="other")])
    assert [r.row_id for r in facts.delta_facts(new, old).collect()] == [4]
    proof = frame([(1, "q", "b"), (2, "f2", "b")], "evidence_id long, fact_id string, source_book string")
    left, kept, gone = facts.delete_books(new, proof, ["other"])
    assert (left.count(), [r.evidence_id for r in kept.collect()], sorted(r.name for r in gone.collect())) == (2, [2], ["e", "f"])


def test_majority_ties_take_the_first(frame):
    rows = frame([(1, "k", "b"), (2, "k", "a"), (3, "k", "a"), (4, "k", "b"), (5, "m", None)], "seq int, k string, v string")
    assert {r.k: r.v for r in facts.majority(rows, ["k"], "v", "seq").collect()} == {"k": "b", "m": None}


def test_clusters_and_lookup(store, frame):
    rows = relations.symmetric(store([fact(1, "a", "p", "b", best_confidence=0.5, best_source_text="long text"), fact(2, "a", "p", "b", best_confidence=0.9, source_book="b2"), fact(3, "b", "q", "a"), fact(4, "a", "p", "a"), fact(5, "", "p", "x")]))
    got = {(r.anchor, r.predicate, r.target, r.direction): r for r in relations.clusters(rows).collect()}
    c = got["a", "p", "b", "out"]
    assert (c.evidence_count, c.avg_confidence, c.max_confidence, c.book_count, c.books) == (2, 0.7, 0.9, 2, "b|b2")
    assert ("a", "p", "a", "out") in got and ("a", "p", "a", "in") not in got
    found = relations.entity_lookup(rows, frame([(7, "a"), (8, "nobody")], "qid int, anchor string")).collect()
    assert {r.qid for r in found} == {7} and min(r.place for r in found) == 1 and max(r.fusion for r in found) == 1.0


def test_diversify_prefers_new_predicates(frame):
    rows = frame([(1, "p", "x", "out", "t", 1.0), (1, "p", "y", "out", "t", 0.8), (1, "q", "z", "in", "u", 0.5)], "qid int, predicate string, target string, direction string, target_type string, fusion double")
    got = {r.pick: r.target for r in relations.diversify(rows, top_k=2).collect()}
    assert got == {1: "x", 2: "z"}


def test_components_chain_star_and_none(frame):
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("z", f"y{i}") for i in range(20)] + [("q", "q")]
    got = {r.name: r.head for r in graph.components(frame(pairs, "a string, b string")).collect()}
    assert len(got) == 41 + 21 and {got[f"n{i:03}"] for i in range(41)} == {"n000"} and got["z"] == "y0"
    assert graph.components(frame([], "a string, b string")).count() == 0


def test_shortest_paths(store, frame):
    rows = store([fact(1, "a", "p", "b"), fact(2, "b", "p", "c"), fact(3, "c", "p", "d"), fact(4, "a", "p", "x"), fact(5, "x", "p", "c", source_book="o")])
    near = relations.best_neighbours(relations.symmetric(rows), {})
    pairs = frame([(1, "a", "b"), (2, "a", "c"), (3, "a", "d"), (4, "a", "nobody"), (5, "a", "a")], "qid int, start string, finish string")
    got = {}
    for r in graph.shortest_paths(pairs, near).collect():
        got.setdefault(r.qid, []).append((r.place, r.hops, r.path, r.score))
    assert got[1] == [(1, 1, "a->b", 1.05)]
    assert sorted(got[2]) == [(1, 2, "a->x->c", 0.6), (2, 2, "a->b->c", 0.55)]
    assert {p[1] for p in got[3]} == {3} and set(got) == {1, 2, 3}


def test_closure_depth_and_support(frame):
    pairs = frame([("a", "b", 2), ("b", "c", 1), ("a", "c", 5), ("c", "d", 1)], "a string, b string, support long")
    got = {r.alias: (r.depth, r.support) for r in graph.alias_closure(frame([(1, "a")], "qid int, name string"), pairs).collect()}
    assert got == {"b": (1, 2), "c": (1, 5), "d": (2, 1)}


def test_mentions(frame):
    texts = frame([(1, "甘草与桂枝汤"), (2, None), (3, ""), (4, "桂枝")], "qid int, text string")
    names = frame([("桂枝",), ("桂枝汤",), ("甘草",), ("",), ("桂枝",)], "name string")
    got = {(r.qid, r.name, r["at"]) for r in graph.mentions(texts, names).collect()}
    assert got == {(1, "甘草", 1), (1, "桂枝", 4), (1, "桂枝汤", 4), (4, "桂枝", 1)}
    assert graph.mentions(texts, frame([], "name string")).count() == 0


def test_bm25_empty_and_order(frame):
    docs = frame([(1, "ginger tea"), (2, "ginger ginger root"), (3, None), (4, "mint")], "doc_id int, text string")
    asked = frame([(9, "ginger"), (8, ""), (7, "absent")], "qid int, query string")
    got = corpus.bm25(docs, asked, tokens=T.light_tokens("text"), query_tokens=T.light_tokens("query")).collect()
    assert [(r.qid, r.doc_id, r.place) for r in got] == [(9, 2, 1), (9, 1, 2)]


def test_dense_blocks_equal_one_block(frame):
    rows = frame([(i, [float(i % 5), float(i % 3)], i % 2) for i in range(30)], "vec_id int, embedding array<float>, label int")
    asked = rows.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    pick = lambda b: sorted(map(tuple, corpus.dense_search(rows, asked, metric="l2", k=4, block=b).collect()))
    assert pick(3) == pick(1000)


def test_rrf_does_not_mind_the_order(frame):
    a = frame([(1, 10, 1), (1, 11, 2)], "qid int, doc_id int, place int")
    b = frame([(1, 11, 1), (1, 12, 2)], "qid int, doc_id int, place int")
    assert corpus.rrf([(a, 1.0), (b, 1.0)], ["qid", "doc_id"]).collect() == corpus.rrf([(b, 1.0), (a, 1.0)], ["qid", "doc_id"]).collect()


def test_auto_merge(frame):
    hits = frame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7)], "qid int, doc_id int, score double")
    parents = frame([(1, "P"), (2, "P"), (3, "Q")], "doc_id int, parent string")
    assert [(r.unit, r.score, r.merged) for r in corpus.auto_merge(hits, parents).orderBy("place").collect()] == [("p:P", 0.9, 2), ("d:3", 0.7, 1)]


def test_tokens(frame):
    row = frame([("桂枝汤 A1，桂",)], "t string").select(T.light_tokens("t").alias("l"), T.distinct_tokens("t").alias("d"), T.trigrams("t").alias("g"), T.probe_terms("t").alias("p"), T.fragments("t").alias("f"), T.loose("t").alias("o")).first()
    assert (row.l, row.d, row.g, row.p, row.f, row.o) == (["桂", "枝", "汤", "a1", "桂"], ["桂", "枝", "汤", "a1"], ["桂枝汤"], ["桂枝汤", "a1"], ["桂枝汤", "A1"], "桂枝汤a1桂")
    empty = frame([(None,), ("",), ("。",)], "t string").select(F.size(T.light_tokens("t")).alias("n"), F.size(T.trigrams("t")).alias("g"), F.size(T.probe_terms("t")).alias("p")).collect()
    assert [(r.n, r.g, r.p) for r in empty] == [(0, 0, 0), (0, 0, 0), (0, 0, 1)]


def test_collapse_and_jaccard(frame):
    row = frame([(["abc", "b", "abc", "x"], [], [])], "t array<string>, a array<string>, b array<string>").select(T.collapse_contained(F.col("t")).alias("c"), T.jaccard(F.col("a"), F.col("b")).alias("j"), T.jaccard(F.col("a"), F.col("b"), 0.0).alias("z")).first()
    assert (row.c, row.j, row.z) == (["abc", "abc", "x"], 1.0, 0.0)


def test_rules(frame):
    rows = frame([("p", "x", "y"), ("q", None, "y"), ("z", "x", "")], "predicate string, subject_type string, object_type string").na.fill("")
    table = frame([(2, "p", None, None, "second"), (1, None, "x", "y", "first"), (3, "q", None, None, "third")], "ord int, predicate string, subject_type string, object_type string, tier string")
    assert {r.predicate: r.tier for r in rules.tier(rows, table).collect()} == {"p": "first", "q": "third", "z": "review_needed"}
    assert rules.closure(["@fam"], {"fam": ["a", "@sub"], "sub": ["b", "fam"]}) == ["a", "b", "fam", "sub"]
    got = frame([(None,), ("药方",), ("x",)], "v string").select(rules.first_substring_rule(F.coalesce("v", F.lit("")), {}, [("方", "formula"), ("药", "herb")]).alias("m")).collect()
    assert [r.m for r in got] == ["", "formula", "x"]


def test_sections_and_paragraphs(frame):
    docs = frame([(1, "前言\n<篇名>一\n甲乙\n丙。\n丁\n\n戊"), (2, None), (3, "")], "k int, t string")
    rows = sections.lines(docs, "k", "t")
    got = [(r.k, r.section_no, r.title, r.n_lines) for r in sections.sections(rows, "k", F.col("line").startswith("<篇名>")).orderBy("k", "section_no").collect()]
    assert got == [(1, 0, "front", 1), (1, 1, "<篇名>一", 4), (3, 0, "front", 0)]
    assert [r.paragraph for r in sections.paragraphs(rows.filter("k = 1 and line_no > 2"), "k").orderBy("paragraph_no").collect()] == ["甲乙丙。", "丁", "戊"]


def test_chunks_merge_back(frame):
    text = "".join(chr(0x4E00 + (i * 7919) % 2000) + ("\n" if i % 90 == 89 else "") for i in range(2500))
    docs = frame([(1, text), (2, ""), (3, None)], "k int, t string")
    pieces = sections.chunks(docs, "k", "t", 400, 60)
    assert pieces.agg(F.max(F.length("chunk"))).first()[0] <= 400 and pieces.select("k").distinct().count() == 1
    merged = sections.merge_bodies(pieces, "k", "chunk_no", "chunk").first().merged
    assert merged.replace("\n", "") == text.replace("\n", "")


def test_records(frame):
    log = frame([(1, 1, "ok"), (1, 2, "error"), (1, 3, "error"), (2, 1, "error"), (3, 1, "ok")], "k int, n int, v string")
    got = {r.k: (r.successes, r.failures, r.trailing) for r in records.trailing_failures(log, "k", ["n"], F.col("v") == "ok").collect()}
    assert got == {1: (1, 2, 2), 2: (0, 1, 1), 3: (1, 0, 0)}
    assert sorted((r.k, r.run, r.v, r.length) for r in records.runs(log, "k", ["n"], "v").collect()) == [(1, 0, "ok", 1), (1, 1, "error", 2), (2, 0, "error", 1), (3, 0, "ok", 1)]
    assert records.sample_indices(10, 3) == [2, 4, 7] and records.sample_indices(2, 5) == [0, 1] and records.sample_indices(0, 2) == []


def test_evaluation(frame):
    hits = frame([(1, 5, 1), (1, 6, 2), (2, 7, 1)], "qid int, doc_id int, place int")
    gold = frame([(1, 6), (3, 9)], "qid int, doc_id int")
    got = {r.qid: (r.hit_1, r.hit_k, r.rr, r.ndcg) for r in evaluation.ir_metrics(hits, gold, frame([(1,), (2,), (3,)], "qid int"), 10).collect()}
    assert got == {1: (0, 1, 0.5, 0.63093), 2: (0, 0, 0.0, 0.0), 3: (0, 0, 0.0, 0.0)}
    signs = frame([(5, 1), (0, 0), (3, 3), (10, 0)], "w long, l long").select(F.round(evaluation.sign_test(F.col("w"), F.col("l")), 6).alias("p")).collect()
    assert [r.p for r in signs] == [0.21875, 1.0, 1.0, 0.001953]


def test_lcs():
    for a, b, n in (("", "", 0), ("abc", "", 0), ("abcde", "ace", 3), ("甘草桂枝", "桂枝甘草", 2), ("aaaa", "aa", 2)):
        assert evaluation.lcs_length(a, b) == n


def test_bootstrap_holds_the_mean(frame):
    r = evaluation.bootstrap(frame([("a", float(i % 7)) for i in range(200)], "k string, v double"), "k", "v", 500).first()
    assert r.low < r.mean < r.high


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"x": 1}\n\n{"x": 2}\n{broken\n', encoding="utf-8")
    assert sorted(r.x for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int", strict=False).collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int").collect()
    (tmp_path / "b.txt").write_bytes("甘草".encode("gb18030"))
    (tmp_path / "c.txt").write_bytes("﻿桂枝".encode())
    assert {r.book: r.text for r in readers.read_books(spark, str(tmp_path)).collect()} == {"b": "甘草", "c": "桂枝"}


def test_publish_versions(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert writers.publish(spark.range(3), root) == 1 and writers.publish(spark.range(5), root) == 2
    assert (writers.current(spark, root).count(), writers.current(spark, root, 1).count()) == (5, 3)
    assert writers.markdown(spark.range(1)).splitlines()[2] == "| 0 |"
