"""Exact and indexed nearest vectors, and the stored inverted index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.functions import tokens as T
from kgloom.operators import corpus, index, vectors
from kgloom.sources.writers import scratch


def rows(n, seed=3, dims=8):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=dims) + 3 * (i % 5 == 0)).round(3).tolist(), i % 3) for i in range(n)]


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
def test_exact_search_against_brute_force(frame, metric):
    data = rows(120)
    v = frame([*data, (500, None, 1), (501, data[7][1], 2)], "vec_id long, embedding array<double>, label int")
    asked = v.filter("vec_id % 10 = 7").select(F.col("vec_id").alias("qid"), "embedding")
    got = {(r.qid, r.place): r.vec_id for r in vectors.search(v, asked, metric=metric, k=5, block=3).collect()}
    m = {i: np.array(e) for i, e, _ in [*data, (501, data[7][1], 2)]}
    value = {"dot": lambda a, b: -a @ b, "cosine": lambda a, b: -(a @ b) / np.sqrt((a @ a) * (b @ b)), "l2": lambda a, b: np.sqrt(((a - b) ** 2).sum())}[metric]
    for q in [i for i in m if i % 10 == 7]:
        near = sorted((round(value(m[q], x), 6), i) for i, x in m.items() if i != q)[:5]
        assert [got[q, p] for p in range(1, 6)] == [i for _, i in near]


def test_groups_and_nothing(frame):
    v = frame(rows(30), "vec_id long, embedding array<double>, label int")
    asked = v.filter("vec_id < 3").select(F.col("vec_id").alias("qid"), "embedding")
    assert vectors.search(v, asked, k=2, by="label").groupBy("qid", "label").count().filter("count != 2").count() == 0
    assert vectors.search(v, asked.filter("false")).count() == 0 and vectors.search(v.filter("false"), asked).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_index_recall_and_level(spark, frame, metric):
    v = frame(rows(600), "vec_id long, embedding array<double>, label int")
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    built = vectors.build_index(v, scratch(spark, "cells"), cells=12, metric=metric, keep=("label",))
    assert spark.read.parquet(built.root).count() == 600
    exact = {(r.qid, r.vec_id) for r in vectors.search(v, asked, metric=metric, k=10).collect()}
    near = {(r.qid, r.vec_id) for r in built.search(asked, k=10).collect()}
    assert len(exact & near) >= 0.9 * len(exact) and built.probes <= 12
    assert {(r.qid, r.vec_id) for r in built.search(asked, k=10, probes=12).collect()} == exact
    level = vectors.search(v.filter("label = 1"), asked, metric=metric, k=3).select("qid", "vec_id", "place").collect()
    assert sorted(built.search(asked, k=3, probes=12, where=F.col("label") == 1).select("qid", "vec_id", "place").collect()) == sorted(level)


def test_stored_index_equals_direct_search(spark, frame):
    docs = frame([(1, "ginger tea"), (2, "ginger ginger root"), (3, None), (4, "mint tea")], "doc_id int, text string")
    asked = frame([(9, "ginger tea"), (8, ""), (7, "absent")], "qid int, query string")
    direct = corpus.bm25(docs, asked, tokens=T.light_tokens("text"), query_tokens=T.light_tokens("query"))
    built = index.build(docs, "doc_id", {"text": T.light_tokens("text")}, scratch(spark, "index"))
    assert sorted(map(tuple, built.search(asked, T.light_tokens("query"), {"text": 1.0}).collect())) == sorted(map(tuple, direct.collect()))


def test_ladder_and_hybrid(frame):
    a = frame([(1, 10, 1, 0.5)], "qid int, doc_id int, place int, score double")
    b = frame([(1, 11, 1, 0.9), (2, 12, 1, 0.4)], "qid int, doc_id int, place int, score double")
    assert sorted((r.qid, r.doc_id, r.mode) for r in corpus.ladder([("first", a), ("second", b)]).collect()) == [(1, 10, "first"), (2, 12, "second")]
    assert sorted((r.qid, r.mode) for r in corpus.hybrid(b, a, ["qid", "doc_id"]).collect()) == [(1, "hybrid"), (1, "hybrid"), (2, "dense_only")]
    assert sorted((r.qid, r.doc_id, r.refined) for r in corpus.refined(a, b).collect()) == [(1, 11, True), (2, 12, True)]


def test_embedding_stand_in(frame):
    got = frame([("桂枝 tea",), ("桂枝 tea",), ("",), (None,)], "t string").select(vectors.hashed_embedding(F.col("t"), 16).alias("e")).collect()
    assert got[0].e == got[1].e and abs(sum(x * x for x in got[0].e) - 1) < 1e-9 and got[2].e == got[3].e == [0.0] * 16
