"""Problem 7: records that differ by formatting only, collapsed into one each with the number of copies.

A record becomes a 128-bit digest of its canonical form. Every partition fills two blocked Bloom filters, of
digests seen once and of digests seen again; partial filters are merged block by block, a bit being set in
both sides' filters of once-seen digests going to the repeats. Only records that the merged filter of repeats
lets through are shuffled for exact grouping, all others are singletons at once. A false positive costs one
row in that shuffle and no correctness.

Bits grow with the records, 16 each, but a broadcast filter has at most 2^max_bits of them (2^27: 16 MB, 8 million
records). More records are written to the shared folder by range of their digests, without a shuffle, and
range after range gets a filter of its own: all ranges are as well filtered as a small table.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.session import cut, shared_folder

BLOCK_BITS = 1 << 20
PROBES = 7

_PART = re.compile(r"(?:^|(?<=[^\w]))([^\W\d_]{1,12}) ?[:\-–—]")
_LABEL_MARK = re.compile(r"[:\-–—]")
_INNER = re.compile(r"(?<=\d)[.:/~\-](?=\d)|(?<=\d),(?=\d{3}(?!\d))")


#: Marks inside numbers, as code between two private-use characters that no folded text keeps otherwise.
_OPEN, _CLOSE = "\ue000", "\ue001"
_DROPPED = regex.compile(rf"[^\p{{L}}\p{{N}}\p{{M}}{_OPEN}{_CLOSE}]+")


def plain(text: str) -> str:
    """Folded text without white space and marks; a mark inside a number stays."""
    return _DROPPED.sub("", _INNER.sub(lambda m: f"{_OPEN}{ord(m[0]):x}{_CLOSE}", text))


def canonical(text: str | None) -> str:
    """The text apart from white space, case, width, punctuation and the order of labelled parts; null is ''."""
    folded = unicodedata.normalize("NFKC", text or "").casefold().replace("\r", "\n")
    folded = "\n".join(line for line in ("".join(part.split()) for part in folded.split("\n")) if line)
    parts = [m.start(1) for m in _PART.finditer(folded)] if _LABEL_MARK.search(folded) else []
    if len(parts) < 2 or plain(folded[: parts[0]]):
        return plain(folded)
    ends = [*parts[1:], len(folded)]
    return "\x1f".join(sorted(plain(folded[a:b]) for a, b in zip(parts, ends, strict=True)))


def digests(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, d1, d2): the two halves of the digest of the canonical fields."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [xxhash.xxh3_128_intdigest("\x1e".join(canonical(x) for x in row)) for row in b[list(fields)].itertuples(index=False, name=None)]
            yield pd.DataFrame({key: b[key], "d1": np.array([x >> 64 for x in raw], "u8").view("i8"), "d2": np.array([x & (1 << 64) - 1 for x in raw], "u8").view("i8")})

    return df.select(key, *fields).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, d1 long, d2 long")


def positions(d1: np.ndarray, d2: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each digest, and its PROBES bits within that block."""
    a, b = d1.view("u8"), d2.view("u8") | np.uint64(1)
    step = np.arange(PROBES, dtype="u8")[:, None]
    return ((a >> np.uint64(40)) % np.uint64(blocks)).astype("i8"), ((a + step * b) >> np.uint64(17)) % np.uint64(BLOCK_BITS)


def fill(d1: np.ndarray, d2: np.ndarray, blocks: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each block, the bits of digests seen once, and of those seen again, packed."""
    order = np.lexsort((d2, d1))
    d1, d2 = d1[order], d2[order]
    new = np.append(True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]))[: len(d1)]
    twice = np.append(~new[1:], False)[: len(d1)][new]  # the row after the first one of a digest is the same digest
    block, bits = positions(np.ascontiguousarray(d1[new]), np.ascontiguousarray(d2[new]), blocks)
    order = np.argsort(block, kind="stable")
    ends = np.flatnonzero(np.diff(block[order])) + 1
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for own in np.split(order, ends) if len(order) else ():
        out[int(block[own[0]])] = _packed(bits[:, own]), _packed(bits[:, own[twice[own]]])
    return out


def _packed(bits: np.ndarray) -> np.ndarray:
    out = np.zeros(BLOCK_BITS // 8, "u1")
    flat = bits.ravel()
    np.bitwise_or.at(out, (flat >> np.uint64(3)).astype("i8"), np.uint8(128) >> (flat & np.uint64(7)).astype("u1"))
    return out


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] | b[0], a[1] | b[1] | (a[0] & b[0])


def _pack(part: int, found: dict[int, tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame([(part, k, zlib.compress(x.tobytes(), 1), zlib.compress(y.tobytes(), 1)) for k, (x, y) in found.items()], columns=["part", "block", "once", "again"])


def _merged(frames: Iterator[pd.DataFrame] | list[pd.DataFrame]) -> pd.DataFrame:
    read = lambda x: np.frombuffer(zlib.decompress(x), "u1")
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for f in frames:
        for k, x, y in zip(f["block"], f["once"], f["again"], strict=True):
            now = (read(x), read(y))
            found[k] = merge(found[k], now) if k in found else now
    return _pack(0, found)


def repeats_filter(hashed: DataFrame, blocks: int, fan_in: int = 64) -> dict[int, np.ndarray]:
    """The merged filter of digests seen again, by block. Partial filters are merged in a tree."""
    schema = "part int, block int, once binary, again binary"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: list[np.ndarray] = []

        def spend() -> None:
            if held:
                for k, now in fill(*np.concatenate(held, axis=1), blocks).items():
                    found[k] = merge(found[k], now) if k in found else now
                held.clear()

        for b in batches:
            held.append(np.stack([b["d1"].to_numpy("i8"), b["d2"].to_numpy("i8")]))
            if sum(h.shape[1] for h in held) >= 1 << 19:
                spend()
        spend()
        yield _pack(TaskContext.get().partitionId(), found)

    filters = hashed.select("d1", "d2").mapInPandas(partial, schema)
    parts = hashed.rdd.getNumPartitions()
    while parts > fan_in:
        filters = filters.groupBy((F.col("part") % (parts // fan_in + 1)).cast("int").alias("part"), "block").applyInPandas(lambda key, f: _merged([f]).assign(part=key[0]), schema)
        parts = parts // fan_in + 1
    last = filters.groupBy("block").applyInPandas(lambda f: _merged([f]), schema).select("block", "again")
    return {r["block"]: np.frombuffer(zlib.decompress(r["again"]), "u1") for r in last.toLocalIterator()}


def split_repeats(df: DataFrame, *, key: str = "record_id", fields: tuple[str, ...] = ("question", "answer"), max_bits: int = 27) -> DataFrame:
    """(key, d1, d2, maybe): maybe is false only for records that surely have no copy. Cut, ready to be used twice."""
    count = df.count()
    ranges = max(1, -(-count * 16 >> max_bits))
    hashed = digests(df, key, fields)
    if ranges == 1:
        return _marked(cut(hashed), max(1, count), max_bits)
    root = f"{shared_folder(df.sparkSession)}/digests-{uuid.uuid4().hex}"
    hashed.withColumn("range", F.pmod(F.shiftright("d2", 8), F.lit(ranges)).cast("int")).write.partitionBy("range").parquet(root)
    rows = df.sparkSession.read.schema(f"`{key}` {dict(df.dtypes)[key]}, d1 long, d2 long, range int").parquet(root)
    out: DataFrame | None = None
    for r in range(ranges):
        part = _marked(rows.filter(F.col("range") == r).drop("range"), -(-count // ranges), max_bits)
        out = part if out is None else out.unionByName(part)
    return out


def _marked(hashed: DataFrame, count: int, max_bits: int) -> DataFrame:
    blocks = max(1, min(1 << max_bits, 1 << (count * 16 - 1).bit_length()) // BLOCK_BITS)
    shared = hashed.sparkSession.sparkContext.broadcast(repeats_filter(hashed, blocks))

    @F.pandas_udf("boolean")
    def maybe(d1: pd.Series, d2: pd.Series) -> pd.Series:
        block, bits = positions(d1.to_numpy("i8"), d2.to_numpy("i8"), blocks)
        hit = np.zeros(len(d1), bool)
        for k in np.unique(block):
            own, again = block == k, shared.value.get(int(k))
            if again is not None:
                at = bits[:, own]
                hit[own] = ((again[at >> np.uint64(3)] >> (7 - (at & np.uint64(7)).astype("u1"))) & 1).all(0)
        return pd.Series(hit)

    done = cut(hashed.withColumn("maybe", maybe("d1", "d2")))
    shared.unpersist()
    return done


def collapse_copies(df: DataFrame, *, key: str = "record_id", fields: tuple[str, ...] = ("question", "answer"), max_bits: int = 27) -> DataFrame:
    """(group_id, copies): every record once; group_id is the smallest key among its copies.

    Null fields count as ''; blank records are copies of each other; rows repeated with one key count each.
    """
    marked = split_repeats(df, key=key, fields=fields, max_bits=max_bits)
    groups = marked.filter("maybe").groupBy("d1", "d2").agg(F.min(key).alias("group_id"), F.count("*").alias("copies")).drop("d1", "d2")
    return groups.unionByName(marked.filter("not maybe").select(F.col(key).alias("group_id"), F.lit(1).cast("long").alias("copies")))


def copy_groups(df: DataFrame, *, key: str = "record_id", fields: tuple[str, ...] = ("question", "answer"), max_bits: int = 27) -> DataFrame:
    """(group_id, key) of every record that has a copy under another key, the smallest of the group included."""
    rows = split_repeats(df, key=key, fields=fields, max_bits=max_bits).filter("maybe").select(key, "d1", "d2").distinct()
    groups = rows.groupBy("d1", "d2").agg(F.min(key).alias("group_id"), F.count("*").alias("copies")).filter("copies > 1")
    return rows.join(groups, ["d1", "d2"]).select("group_id", key)
