"""Problem 8: documents packed into containers of fixed capacity, related ones together.

The corpus is cut into shards of bounded size where it lies, without moving texts. Each shard has an inverted
index with BM25 weights; document frequencies and the mean length are those of the whole corpus, counted in a
pass before, in a table of fixed size. The largest unused document is the seed of a container; its unused neighbours that fit are taken by
score until the container is full or none is left that shares a term, and what space is left takes the largest
documents that still fit. Only a document above the capacity is split: into full containers and a rest that is packed
like a document. Containers that a shard could not fill are opened again and packed across shards by size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.codes import code_points, token_mask
from kgloom.session import cut

K1, B = 1.5, 0.75
_SCHEMA = "container_id string, doc_id {kind}, part_no int, n_parts int, n_tokens int, fill int, open boolean"


def tokenize(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, term, count per doc): light tokens of the lower-cased texts. An ideograph is its own term, a word its hash."""
    lowered = [t.lower() for t in texts]
    codes = code_points("\x00".join(lowered)).astype("i8")
    han, word = token_mask(codes)
    first = word.copy()
    first[1:] &= ~word[:-1]
    doc = np.cumsum(codes == 0)
    if any("\x00" in t for t in lowered):
        doc = np.repeat(np.arange(len(lowered)), [len(t) + 1 for t in lowered])[: len(codes)]
    at = np.flatnonzero(first)
    hashed = np.zeros(0, "i8")
    if len(at):
        run = np.cumsum(first) - 1
        inside = np.flatnonzero(word)
        place = inside - at[run[inside]]
        with np.errstate(over="ignore"):
            mixed = (codes[inside].astype("u8") + np.uint64(7)) * (place.astype("u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
            hashed = (np.add.reduceat(mixed, np.searchsorted(inside, at)) >> np.uint64(2)).astype("i8") | (1 << 62)
    terms = np.concatenate([codes[han], hashed])
    docs = np.concatenate([doc[han], doc[at]])
    return docs, terms, np.bincount(docs, minlength=len(texts))


#: Cells of the table of document frequencies: one for each ideograph, the others shared by words. 4 bytes each, 16 MB.
HAN_CELLS, CELLS = 1 << 15, 1 << 22


def cells(terms: np.ndarray) -> np.ndarray:
    """The cell of each term. Words that meet in one cell count together, which lowers their weight a little."""
    word = HAN_CELLS + ((terms.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype("i8") % (CELLS - HAN_CELLS)
    return np.where(terms < 1 << 62, terms - 0x4E00, word)


@dataclass(frozen=True)
class Corpus:
    """Documents, mean length, and the document frequencies of all terms in a table of fixed size."""

    n: int
    mean: float
    df: np.ndarray

    def frequency(self, terms: np.ndarray) -> np.ndarray:
        return np.maximum(self.df[cells(terms)], 1).astype("i8")


class Shard:
    """Inverted BM25 index of some documents; without ``corpus`` they are all there are.

    Terms of an eighth of the documents or more have their weights in full rows, which add up faster than postings;
    a shard of bounded text has few of them.
    """

    def __init__(self, docs: np.ndarray, terms: np.ndarray, n: int, corpus: Corpus | None = None) -> None:
        names, term = np.unique(terms, return_inverse=True)
        pair, tf = np.unique(term.astype("i8") * n + docs, return_counts=True)
        self.term, self.doc, self.n = pair // n, pair % n, n
        length = np.bincount(docs, minlength=n)
        here = np.bincount(self.term, minlength=len(names))
        df, total, mean = (corpus.frequency(names), corpus.n, corpus.mean) if corpus else (here, n, length.mean())
        idf = np.log((total - df + 0.5) / (df + 0.5) + 1)
        self.start = np.concatenate([[0], np.cumsum(here)])
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.doc] / max(mean, 1)))
        common = np.flatnonzero(here >= max(2, n // 8))
        self.row = np.full(len(names), -1)
        self.row[common] = np.arange(len(common))
        self.full = np.zeros((len(common), n))
        held = self.row[self.term] >= 0
        self.full[self.row[self.term[held]], self.doc[held]] = self.weight[held]
        order = np.lexsort((self.term, self.doc))
        self.by_doc, self.doc_start = self.term[order], np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=n))])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents for the terms of the seed."""
        picked = self.by_doc[self.doc_start[seed] : self.doc_start[seed + 1]]
        rows = self.row[picked]
        total = self.full[rows[rows >= 0]].sum(0)
        picked = picked[rows < 0]
        size = self.start[picked + 1] - self.start[picked]
        at = np.arange(size.sum()) + np.repeat(self.start[picked] - np.cumsum(size) + size, size)
        return total + np.bincount(self.doc[at], self.weight[at], self.n)


class BySize:
    """Unused items by size; gives the largest that fits."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.sizes, self.stacks, self.count = sizes, [[] for _ in range(capacity + 1)], np.zeros(capacity + 1, "i8")
        self.used = np.zeros(len(sizes), bool)
        for i in range(len(sizes) - 1, -1, -1):
            self.stacks[sizes[i]].append(i)
        self.count += np.bincount(sizes, minlength=capacity + 1)

    def take(self, i: int) -> None:
        self.used[i] = True
        self.count[self.sizes[i]] -= 1

    def largest(self, room: int) -> int | None:
        fits = self.count[: room + 1]
        fits = fits.nonzero()[0]
        if not len(fits):
            return None
        stack = self.stacks[fits[-1]]
        while self.used[stack[-1]]:
            stack.pop()
        return stack[-1]


def fill_containers(sizes: np.ndarray, capacity: int, shard: Shard | None, owner: np.ndarray, keep: int = 64) -> list[list[int]]:
    """Items of each container. owner: the shard document that an item belongs to. No shard: by size alone.

    ``keep`` is how many neighbours are sorted at a time; the next ones follow while there is room.
    """
    left, out = BySize(sizes, capacity), []
    while (seed := left.largest(capacity)) is not None:
        left.take(seed)
        held, room = [seed], capacity - int(sizes[seed])
        if shard is not None and room > 0:
            score = shard.scores(int(owner[seed]))[owner]
            while len(fits := np.flatnonzero((score > 0) & ~left.used & (sizes <= room))):
                near = fits[np.argpartition(-score[fits], keep - 1)[:keep]] if len(fits) > keep else fits
                for i in near[np.lexsort((near, -score[near]))].tolist():
                    if sizes[i] <= room:
                        left.take(i)
                        held.append(i)
                        room -= int(sizes[i])
                score[near] = 0
        while (i := left.largest(room)) is not None:
            left.take(i)
            held.append(i)
            room -= int(sizes[i])
        out.append(held)
    return out


def pack_shard(name: str, ids: list, texts: list[str], capacity: int, least_fill: float, corpus: Corpus | None = None) -> pd.DataFrame:
    docs, terms, counts = tokenize(texts)
    parts = np.maximum(1, -(-counts // capacity))
    rows = [(f"{name}-{ids[d]}-{p}", ids[d], p, int(parts[d]), capacity, capacity, False) for d in np.flatnonzero(parts > 1) for p in range(int(parts[d]) - 1)]
    sizes = counts - (parts - 1) * capacity
    for k, held in enumerate(fill_containers(sizes, capacity, Shard(docs, terms, len(ids), corpus), np.arange(len(ids)))):
        fill = int(sizes[held].sum())
        rows += [(f"{name}-{k}", ids[i], int(parts[i]) - 1, int(parts[i]), int(sizes[i]), fill, fill < least_fill * capacity) for i in held]
    return pd.DataFrame(rows, columns=["container_id", "doc_id", "part_no", "n_parts", "n_tokens", "fill", "open"])


def count_corpus(df: DataFrame, text: str, shards: Callable) -> Corpus:
    """One pass over all texts; what reaches the driver is bounded by the cells of the table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n, tokens = np.zeros(CELLS, "i8"), 0, 0
        for _, texts in shards((b.assign(_k=0) for b in batches), "_k", text):
            docs, terms, counts = tokenize(texts)
            np.add.at(total, np.unique(cells(terms) * len(texts) + docs) // len(texts), 1)
            n, tokens = n + len(texts), tokens + int(counts.sum())
        on = np.flatnonzero(total)
        yield pd.DataFrame({"cell": np.append(on, [-1, -2]), "n": np.append(total[on], [n, tokens])})

    rows = df.select(text).mapInPandas(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    at, n = rows["cell"].to_numpy("i8"), rows["n"].to_numpy("i8")
    total, tokens = int(n[at == -1].sum()), int(n[at == -2].sum())
    table = np.zeros(CELLS, "u4")
    table[at[at >= 0]] = np.minimum(n[at >= 0], 2**32 - 1)
    return Corpus(total, tokens / max(1, total), table)


def pack_documents(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = 2048, shard_docs: int = 2048, shard_chars: int = 2_000_000, least_fill: float = 0.98, regroup: int = 512
) -> DataFrame:
    """(container_id, doc_id, part_no, n_parts, n_tokens, fill): every part of every document in one container.

    Part p of a split document holds its tokens from p * capacity on. Null and empty texts have no tokens and
    take no space, but are placed like others. Repeated rows are placed each. Extra columns are not read.
    """
    schema = _SCHEMA.format(kind=dict(df.dtypes)[key])

    def shards(batches: Iterator[pd.DataFrame], key: str, text: str) -> Iterator[tuple[list, list[str]]]:
        ids, texts, chars = [], [], 0
        for b in batches:
            for i, t in zip(b[key].tolist(), b[text], strict=True):
                ids.append(i)
                texts.append(t or "")
                chars += len(texts[-1])
                if len(ids) >= shard_docs or chars >= shard_chars:
                    yield ids, texts
                    ids, texts, chars = [], [], 0
        if ids:
            yield ids, texts

    corpus = df.sparkSession.sparkContext.broadcast(count_corpus(df, text, shards))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        for n, (ids, texts) in enumerate(shards(batches, key, text)):
            yield pack_shard(f"{task}.{n}", ids, texts, capacity, least_fill, corpus.value)

    def again(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "part_no"], kind="stable").reset_index(drop=True)
        sizes = rows["n_tokens"].to_numpy("i8")
        for k, held in enumerate(fill_containers(sizes, capacity, None, np.arange(len(rows)))):
            rows.loc[held, "container_id"] = f"r{group[0]}-{k}"
            rows.loc[held, "fill"] = int(sizes[held].sum())
        return rows.assign(open=False).drop(columns="g")

    placed = cut(df.select(key, text).mapInPandas(run, schema.replace("doc_id", f"`{key}`") if key != "doc_id" else schema))
    opened = placed.filter("open")
    groups = max(1, opened.count() // regroup)
    repacked = opened.withColumn("g", F.pmod(F.xxhash64("container_id"), F.lit(groups))).groupBy("g").applyInPandas(again, schema)
    return placed.filter("not open").unionByName(repacked).drop("open")


def fill_report(packed: DataFrame) -> DataFrame:
    """One row: containers, tokens, and the share of all space that is used."""
    each = packed.groupBy("container_id").agg(F.max("fill").alias("fill"))
    return each.agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("most"))
