"""Nearest vectors: exact search by blocks of queries, and an index of cells that reads only the cells a query probes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators.corpus import top_k


def score(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """M2: queries x vectors, six digits; the higher the nearer, so that distances are negative."""
    if metric == "l2":
        return -np.round(np.sqrt(np.maximum(((q[:, None, :] - v[None, :, :]) ** 2).sum(2), 0)), 6)
    s = q @ v.T
    if metric == "cosine":
        s = s / np.sqrt((q * q).sum(1)[:, None] * (v * v).sum(1)[None, :])
    return np.round(s, 6)


class Best:
    """The k best (score, key) of each query so far; ties go to the smaller key."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.scores, self.keys = k, np.full((n, 0), 0.0), np.zeros((n, 0), "i8")

    def add(self, rows: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        """Scores of some queries for some keys; -inf is none."""
        if self.scores.shape[1] < self.k:
            more = self.k - self.scores.shape[1]
            self.scores = np.hstack([self.scores, np.full((len(self.scores), more), -np.inf)])
            self.keys = np.hstack([self.keys, np.zeros((len(self.keys), more), "i8")])
        both, names = np.hstack([self.scores[rows], scores]), np.hstack([self.keys[rows], np.broadcast_to(keys, scores.shape)])
        kept = np.lexsort((names, -both), axis=1)[:, : self.k]
        self.scores[rows], self.keys[rows] = np.take_along_axis(both, kept, 1), np.take_along_axis(names, kept, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, j = np.nonzero(self.scores > -np.inf)
        return q, self.keys[q, j], self.scores[q, j]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("f8")


def search(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", qkey: str = "qid", metric: str = "dot", k: int = 10, by: str | None = None, block: int = 1024) -> DataFrame:
    """Exact nearest vectors of each query, itself left out; with ``by``, the nearest within each of its groups.

    Queries are a query set, taken in blocks of about ``block``; each block meets all vectors by matrix products,
    and every task gives at most k rows a query and group. Keys are integers. Null vectors are no candidates.
    """
    kinds = dict(vectors.dtypes)
    blocks = queries.count() // block + 1
    rows = vectors.filter(F.col("embedding").isNotNull()).select(key, "embedding", *([by] if by else []))
    schema = f"`{qkey}` {dict(queries.dtypes)[qkey]}, `{key}` {kinds[key]}, score double" + (f", `{by}` {kinds[by]}" if by else "")
    out: DataFrame | None = None
    for b in range(blocks):
        asked = queries.filter((F.pmod(F.xxhash64(qkey), F.lit(blocks)) == b) & F.col("embedding").isNotNull()).select(qkey, "embedding").toPandas()
        if not len(asked):
            continue
        found = rows.mapInPandas(_exact(vectors.sparkSession, asked, key, qkey, by, metric, k), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.sparkSession.createDataFrame([], schema)
    order = [F.asc("score") if metric == "l2" else F.desc("score"), F.col(key)]
    return top_k(out, [qkey, *([by] if by else [])], order, k)


def _exact(spark: SparkSession, asked: pd.DataFrame, key: str, qkey: str, by: str | None, metric: str, k: int):  # noqa: ANN202
    shared = spark.sparkContext.broadcast((asked[qkey].to_numpy(), _matrix(asked["embedding"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = shared.value
        best: dict[object, Best] = {}
        for batch in batches:
            for group, rows in batch.groupby(by) if by else ((None, batch),):
                for a in range(0, len(rows), 2048):
                    part = rows.iloc[a : a + 2048]
                    if len(part):
                        _add(best.setdefault(group, Best(len(names), k)), names, q, part[key].to_numpy(), _matrix(part["embedding"]), metric)
        for group, found in best.items():
            i, keys, s = found.rows()
            yield pd.DataFrame({qkey: names[i], key: keys, "score": -s if metric == "l2" else s} | ({by: [group] * len(i)} if by else {}))

    return run


def _add(best: Best, names: np.ndarray, q: np.ndarray, keys: np.ndarray, v: np.ndarray, metric: str, rows: np.ndarray | None = None) -> None:
    """Scores of a batch in steps that keep l2 differences small."""
    rows = np.arange(len(names)) if rows is None else rows
    step = len(rows) if metric != "l2" else max(1, 4_000_000 // max(1, v.size))
    for a in range(0, len(rows), max(1, step)):
        some = rows[a : a + step]
        s = score(v, q[some], metric)
        s[names[some][:, None] == keys[None, :]] = -np.inf
        best.add(some, s, keys)


def centroids(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of k-means on a bounded sample, started far apart."""
    rng = np.random.default_rng(seed)
    centres = [sample[rng.integers(len(sample))]]
    far = ((sample - centres[0]) ** 2).sum(1)
    for _ in range(min(cells, len(sample)) - 1):
        centres.append(sample[rng.choice(len(sample), p=far / far.sum())] if far.sum() > 0 else sample[rng.integers(len(sample))])
        far = np.minimum(far, ((sample - centres[-1]) ** 2).sum(1))
    c = np.stack(centres)
    for _ in range(rounds):
        own = nearest(sample, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(v: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row."""
    d = (c * c).sum(1)[None, :] - 2 * v @ c.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


@dataclass
class VectorIndex:
    """Vectors by cell, of unit length where the metric is cosine. Every row is in exactly one cell."""

    spark: SparkSession
    root: str
    key: str
    metric: str
    centres: np.ndarray
    probes: int

    def search(self, queries: DataFrame, *, qkey: str = "qid", k: int = 10, probes: int | None = None, where: Column | None = None, block: int = 1024) -> DataFrame:
        """Nearest vectors among those of the ``probes`` cells nearest to each query, and of rows that fit ``where``, such as a level.

        Without a number, as many cells as gave the recall asked for when the index was built. All cells together give the exact result. Tasks read the cells that any query of a block probes, and compare
        a vector only with the queries that probe its cell.
        """
        rows = self.spark.read.parquet(self.root)
        if where is not None:
            rows = rows.filter(where)
        blocks = queries.count() // block + 1
        schema = f"`{qkey}` {dict(queries.dtypes)[qkey]}, `{self.key}` {dict(rows.dtypes)[self.key]}, score double"
        out = self.spark.createDataFrame([], schema)
        for b in range(blocks):
            asked = queries.filter((F.pmod(F.xxhash64(qkey), F.lit(blocks)) == b) & F.col("embedding").isNotNull()).select(qkey, "embedding").toPandas()
            if len(asked):
                q = unit(_matrix(asked["embedding"])) if self.metric == "cosine" else _matrix(asked["embedding"])
                probed = nearest(q, self.centres, probes or self.probes)
                used = sorted(set(probed.ravel().tolist()))
                out = out.unionByName(rows.filter(F.col("cell").isin(*used)).select(self.key, "embedding", "cell").mapInPandas(self._probe(asked[qkey].to_numpy(), q, probed, qkey, k), schema))
        order = [F.asc("score") if self.metric == "l2" else F.desc("score"), F.col(self.key)]
        return top_k(out, [qkey], order, k)

    def _probe(self, names: np.ndarray, q: np.ndarray, probed: np.ndarray, qkey: str, k: int):  # noqa: ANN202
        shared = self.spark.sparkContext.broadcast((names, q, probed))
        key, metric = self.key, self.metric

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q, probed = shared.value
            best = Best(len(names), k)
            for batch in batches:
                for cell, rows in batch.groupby("cell"):
                    asking = np.flatnonzero((probed == cell).any(1))
                    if len(asking):
                        _add(best, names, q, rows[key].to_numpy(), _matrix(rows["embedding"]), "dot" if metric == "cosine" else metric, asking)
            i, keys, s = best.rows()
            yield pd.DataFrame({qkey: names[i], key: keys, "score": -s if metric == "l2" else s})

        return run


def needed_probes(sample: np.ndarray, centres: np.ndarray, metric: str, recall: float, k: int = 10, queries: int = 256) -> int:
    """The fewest cells that hold the given share of the k nearest neighbours, measured within the sample."""
    asked = sample[:queries]
    s = asked @ sample.T if metric != "l2" else 2 * asked @ sample.T - (sample * sample).sum(1)[None, :]
    s[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-s, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    own = nearest(sample, centres, 1)[:, 0]
    rank = np.argsort(nearest(asked, centres, len(centres)), axis=1, kind="stable")
    found = np.take_along_axis(rank, own[near], 1).ravel()
    return int(np.quantile(found, recall, method="higher")) + 1 if found.size else len(centres)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)


def build_index(vectors: DataFrame, root: str, *, key: str = "vec_id", metric: str = "cosine", cells: int = 64, sample_rows: int = 20_000, recall: float = 0.95, keep: tuple[str, ...] = ()) -> VectorIndex:
    """An index of all vectors, written by cell.

    Cells are fitted on at most ``sample_rows`` rows, the first by a hash of the key; how many of them a search has to probe
    for the given recall is measured there, too.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col("embedding").isNotNull()).select(key, "embedding", *keep)
    total = rows.count()
    low = -(2**63) + int(2**64 * min(1.0, 1.5 * sample_rows / max(1, total)))
    sample = rows.filter(F.xxhash64(key) <= F.lit(min(low, 2**63 - 1))).orderBy(F.xxhash64(key)).limit(sample_rows).select("embedding").toPandas()
    prepare = unit if metric == "cosine" else lambda m: m
    known = prepare(_matrix(sample["embedding"])) if len(sample) else np.zeros((1, 1))
    centres = centroids(known, cells)
    shared = spark.sparkContext.broadcast(centres)
    kinds = dict(vectors.dtypes)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = prepare(_matrix(b["embedding"]))
                yield b.assign(embedding=list(m), cell=nearest(m, shared.value, 1)[:, 0])

    schema = f"`{key}` {kinds[key]}, embedding array<double>, " + "".join(f"`{c}` {kinds[c]}, " for c in keep) + "cell int"
    rows.mapInPandas(assign, schema).write.mode("overwrite").partitionBy("cell").parquet(root)
    return VectorIndex(spark, root, key, metric, centres, needed_probes(known, centres, metric, recall))


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """A fixed stand-in for an embedding: signed counts of the text's tokens in ``dims`` places, of unit length; null and empty texts are zero."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            codes = np.array([zlib.crc32(w.encode()) for w in re.findall("[一-鿿]|[a-z0-9]+", (t or "").lower())], "i8")
            np.add.at(out[i], codes % dims, np.where(codes >> 16 & 1, 1.0, -1.0))
        return pd.Series(list(unit(out)))

    return run(text)
