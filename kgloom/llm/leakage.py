"""Problem 9: held-out evaluation passages that stand in corpus documents, whole, in part or edited.

Test items are few and come in blocks of bounded size; the corpus is not. It is read twice a block, and no text of
it is shuffled. First every n-gram of an item is counted by documents. Then, of each window of ``intact``
characters, the rarest n-gram becomes a seed; a window with an n-gram that no document has stands nowhere and needs
none. So whatever the counts are, each stretch of that length which a document shares with an item holds a seed:
an edited copy is met between its edits, also if an exact copy elsewhere makes other n-grams the rarer ones. Seeds
join documents to items, hits are extended to the shared stretches, and where these add up to a leak's least run
within the length of an item, Smith-Waterman aligns both texts: it scores the copy, edits included, and yields
the longest exact run.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.codes import code_points, content, content_table

MATCH, MISMATCH, GAP = 2, -1, -1
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_CHUNK = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Hasher:
    """Rolling hashes of n content characters each."""

    def __init__(self, n: int) -> None:
        self.n, self.up, self.down = n, _powers(_BASE, 1 << 12), _powers(pow(_BASE, -1, 1 << 64), 1 << 12)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if len(codes) > len(self.up) - 1:
            size = 1 << (len(codes) + 1).bit_length()
            self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        if len(codes) < self.n:
            return np.zeros(0, "u8")
        with np.errstate(over="ignore"):
            sums = np.zeros(len(codes) + 1, "u8")
            np.cumsum(codes.astype("u8") * self.up[: len(codes)], out=sums[1:])
            h = (sums[self.n :] - sums[: -self.n]) * self.down[: len(codes) - self.n + 1]
            return h ^ (h >> np.uint64(29))


class Seeds:
    """Sorted n-gram hashes with a table of bits in front."""

    def __init__(self, grams: np.ndarray) -> None:
        self.grams = np.sort(grams)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.grams & np.uint64((1 << 22) - 1)).astype("i8")] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes that are seeds, and which."""
        at = np.flatnonzero(self.bits[(hashes & np.uint64((1 << 22) - 1)).astype("i8")])
        k = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        ok = self.grams[k] == hashes[at]
        return at[ok], k[ok]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _CHUNK:
            yield first, i
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, len(texts)


def scan(texts: list[str], hasher: Hasher, seeds: Seeds) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of documents: (first document, content, offsets, document, place in the content, seed) with hits within one document."""
    table = content_table()
    for a, b in _chunks(texts):
        folded = table[code_points("".join(texts[a:b]))]
        ends = np.cumsum([len(t) for t in texts[a:b]])
        kept = np.concatenate([[0], np.cumsum(folded > 0)])
        offsets = np.concatenate([[0], kept[ends]])
        whole = folded[folded > 0]
        at, k = seeds.find(hasher(whole))
        doc = np.searchsorted(offsets, at, side="right") - 1
        ok = at + hasher.n <= offsets[doc + 1]
        yield a, whole, offsets, doc[ok], at[ok], k[ok]


def align(queries: list[np.ndarray], targets: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """Smith-Waterman of pairs, all at once: (score, end in query, end in target, longest exact run)."""
    n, rows, width = len(queries), max(map(len, queries)), max(map(len, targets))
    q, t = np.zeros((n, rows), "u4"), np.full((n, width), 0xFFFFFFFF, "u4")
    for i, (a, b) in enumerate(zip(queries, targets, strict=True)):
        q[i, : len(a)], t[i, : len(b)] = a, b
    above, run = np.zeros((n, width + 1), "i4"), np.zeros((n, width + 1), "i4")
    ramp = np.arange(width, dtype="i4") * -GAP
    best, best_q, best_t, longest = (np.zeros(n, "i4") for _ in range(4))
    for r in range(rows):
        same = t == q[:, r, None]
        step = np.maximum(np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH).astype("i4"), above[:, 1:] + GAP), 0)
        step = np.maximum.accumulate(step + ramp, axis=1) - ramp
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        above[:, 1:] = step
        top = step.argmax(1)
        score = step[np.arange(n), top]
        better = score > best
        best[better], best_q[better], best_t[better] = score[better], r + 1, top[better] + 1
        longest = np.maximum(longest, run.max(1))
    return list(zip(best.tolist(), best_q.tolist(), best_t.tolist(), longest.tolist(), strict=True))


def _windows(starts: np.ndarray, ends: np.ndarray, shared: np.ndarray, size: int, least: int) -> list[tuple[int, int]]:
    """Stretches of a document in which all of an item may stand, around shared stretches of ``least`` characters in all."""
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for a, b, n in zip(starts[order].tolist(), ends[order].tolist(), shared[order].tolist(), strict=True):
        if out and a <= out[-1][0] + size:
            out[-1][1], out[-1][2] = max(out[-1][1], b), out[-1][2] + n
        else:
            out.append([a, b, n])
    return [(a, b) for a, b, n in out if n >= least]


def rare_seeds(grams: list[np.ndarray], every: np.ndarray, counts: np.ndarray, window: int, n: int) -> list[np.ndarray]:
    """Places of the rarest n-gram of each window of each item; windows with an n-gram that no document has are left out."""
    span, out = max(1, window - n + 1), []
    for g in grams:
        if len(g) < span:
            out.append(np.zeros(0, "i8"))
            continue
        views = np.lib.stride_tricks.sliding_window_view(counts[np.searchsorted(every, g)], span)
        at = np.arange(len(views)) + span - 1 - views[:, ::-1].argmin(1)
        out.append(np.unique(at[views.min(1) > 0]))
    return out


class Items:
    """Passages of one block in one array with a zero around each, and the places of their seeds."""

    def __init__(self, keys: list, passages: list[np.ndarray], grams: list[np.ndarray], seeds: list[np.ndarray]) -> None:
        self.keys, self.passages = keys, passages
        self.flat = np.concatenate([np.zeros(1, "u4"), *(x for p in passages for x in (p, np.zeros(1, "u4")))])
        self.first = np.cumsum([1, *(len(p) + 1 for p in passages)])[:-1]
        gram = np.concatenate([np.zeros(0, "u8"), *(g[s] for g, s in zip(grams, seeds, strict=True))])
        place = np.concatenate([np.zeros(0, "i8"), *(s + f for s, f in zip(seeds, self.first, strict=True))])
        order = np.lexsort((place, gram))
        self.grams, begins = np.unique(gram[order], return_index=True)
        self.places, self.ptr = place[order], np.append(begins, len(gram))

    def shared(self, whole: np.ndarray, offsets: np.ndarray, doc: np.ndarray, at: np.ndarray, k: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Stretches that documents and items share around hits: (document, start in the text, start in ``flat``, length), each once."""
        size = self.ptr[k + 1] - self.ptr[k]
        a, d = np.repeat(at, size), np.repeat(doc, size)
        b = self.places[np.arange(size.sum()) + np.repeat(self.ptr[k] - np.cumsum(size) + size, size)]
        end = a + n
        live = np.arange(len(a))
        while len(live):
            x, y = a[live] - 1, b[live] - 1
            live = live[(x >= offsets[d[live]]) & (whole[x] == self.flat[y])]
            a[live] -= 1
            b[live] -= 1
        _, one = np.unique(np.stack([a, b]), axis=1, return_index=True)
        a, b, d, end = a[one], b[one], d[one], end[one]
        live = np.arange(len(a))
        while len(live):
            x = end[live]
            live = live[x < offsets[d[live] + 1]]
            live = live[whole[end[live]] == self.flat[b[live] + end[live] - a[live]]]
            end[live] += 1
        return d, a, b, end - a


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_key: str = "doc_id",
    doc_text: str = "text",
    item_key: str = "item_id",
    item_text: str = "passage",
    least_run: int = 30,
    least_score: int = 40,
    intact: int = 15,
    n: int = 8,
    block_chars: int = 2_000_000,
) -> DataFrame:
    """(item_id, doc_id, score, longest_run, item_chars, share): aligned pairs with score or run at least as given.

    A pair is aligned where stretches of ``intact`` or more characters that both texts share, within the length of
    the item, add up to ``least_run``; so are all pairs with one such run. share is the score over that of a full
    copy. Null and empty texts hold nothing; items with fewer content characters than ``intact`` are reported by
    no row; repeated documents or items give one row each pair of keys. Items are read one by one and searched in blocks
    of ``block_chars`` characters, which bounds what is broadcast to about 40 bytes a character.
    """
    if not n <= intact <= least_run:
        raise ValueError("n, intact and least_run must not decrease")
    out: DataFrame | None = None
    block: list[tuple] = []
    size = 0
    for r in chain(items.select(item_key, item_text).toLocalIterator(), (None,)):
        if r is not None:
            block.append((r[0], r[1]))
            size += len(r[1] or "")
        if size >= block_chars or r is None and (block or out is None):
            part = _find_block(docs.select(doc_key, doc_text), block, dict(items.dtypes)[item_key], item_key, doc_key, doc_text, least_run, least_score, intact, n)
            out = part if out is None else out.unionByName(part)
            block, size = [], 0
    return out


def _find_block(docs: DataFrame, block: list[tuple], item_type: str, item_key: str, doc_key: str, doc_text: str, least_run: int, least_score: int, intact: int, n: int) -> DataFrame:
    passages = [content(t) for _, t in block]
    grams = [Hasher(n)(p) for p in passages]
    every = np.unique(np.concatenate([np.zeros(0, "u8"), *grams]))
    shared = docs.sparkSession.sparkContext.broadcast

    everything = shared(every)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, seeds, total = Hasher(n), Seeds(everything.value), np.zeros(len(everything.value), "i8")
        for b in batches:
            for *_, doc, _, k in scan([t or "" for t in b[doc_text]], hasher, seeds):
                total += np.bincount(np.unique(doc * len(total) + k) % len(total), minlength=len(total))
        on = np.flatnonzero(total)
        yield pd.DataFrame({"gram": on, "n": total[on]})

    counts = np.zeros(len(every), "i8")
    if len(every):
        for r in docs.select(doc_text).mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["gram"]] = r["n"]
    table = shared(Items([k for k, _ in block], passages, grams, rare_seeds(grams, every, counts, intact, n)))
    schema = f"`{item_key}` {item_type}, `{doc_key}` {dict(docs.dtypes)[doc_key]}, score int, longest_run int, item_chars int, share double"

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: Items = table.value
        hasher, seeds, passages = Hasher(n), Seeds(known.grams), known.passages
        sizes = np.array([len(p) for p in passages])
        for b in batches:
            ids = b[doc_key].tolist()
            pairs: list[tuple[int, int, np.ndarray]] = []
            found: dict[tuple[int, int], list[int]] = {}

            def aligned(pairs: list[tuple[int, int, np.ndarray]], found: dict[tuple[int, int], list[int]]) -> None:
                pairs.sort(key=lambda p: len(p[2]))
                for a in range(0, len(pairs), 48):
                    part = pairs[a : a + 48]
                    for (i, d, _), (score, _, _, run) in zip(part, align([passages[p[0]] for p in part], [p[2] for p in part]), strict=True):
                        best = found.setdefault((i, d), [0, 0])
                        best[0], best[1] = max(best[0], score), max(best[1], run)

            for first, whole, offsets, doc, at, k in scan([t or "" for t in b[doc_text]], hasher, seeds) if len(known.grams) else ():
                d, a, at_flat, length = known.shared(whole, offsets, doc, at, k, n)
                long = length >= intact
                d, a, at_flat, length = d[long], a[long], at_flat[long], length[long]
                item = np.searchsorted(known.first, at_flat, side="right") - 1
                start = a - (at_flat - known.first[item])
                order = np.lexsort((start, d, item))
                edges = np.flatnonzero(np.diff(item[order] * len(ids) + d[order])) + 1
                for own in np.split(order, edges) if len(order) else ():
                    if length[own].sum() < least_run:
                        continue
                    i, doc_no = int(item[own[0]]), int(d[own[0]])
                    for x, y in _windows(start[own] - n, start[own] + sizes[i] + n, length[own], int(sizes[i]), least_run):
                        pairs.append((i, first + doc_no, whole[max(x, offsets[doc_no]) : min(y, offsets[doc_no + 1])]))
                if len(pairs) >= 480:
                    aligned(pairs, found)
                    pairs = []
            aligned(pairs, found)
            rows = [(known.keys[i], ids[d], score, run, len(passages[i]), score / (MATCH * len(passages[i]))) for (i, d), (score, run) in found.items() if run >= least_run or score >= least_score]
            yield pd.DataFrame(rows, columns=[item_key, doc_key, "score", "longest_run", "item_chars", "share"])

    pairs = docs.mapInPandas(search, schema)
    return pairs.groupBy(item_key, doc_key).agg(*(F.max(c).alias(c) for c in ("score", "longest_run", "item_chars", "share")))


def leaked_documents(leaks: DataFrame, *, least_run: int = 30) -> DataFrame:
    """(doc_id, item_ids, longest_run): every document that holds a leaked passage, with the items that leaked."""
    return leaks.filter(F.col("longest_run") >= least_run).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("longest_run").alias("longest_run"))
