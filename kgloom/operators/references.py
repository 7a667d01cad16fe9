"""References to records that do not exist, by bitmaps of dictionary-encoded keys.

Keys of referring and target tables are numbered densely, range by range. Of every range of 2^15 keys and
every period there is one bitmap of the keys referred to; of every range there are bitmaps of the keys that
have a target row at all, of those with a live one, and, by period, of those whose first target row arrived
then. They are kept compressed: as sorted 16-bit positions while sparse, as plain bits otherwise. Broken
references are bitmap AND NOT bitmap; surviving bits are decoded and joined back to the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.functions.text import norm
from kgloom.session import cut

RANGE_BITS = 15
_SPARSE = 1 << (RANGE_BITS - 5)
_FINDING = T.ArrayType(T.StructType([T.StructField("state", T.StringType()), T.StructField("pos", T.IntegerType())]))


@dataclass(frozen=True)
class Reference:
    """One foreign key. Columns of ``child``: key, time, row_key. Columns of ``parent``: key, time and, or null, deleted."""

    name: str
    child: DataFrame
    key: str
    time: str
    row_key: str
    parent: DataFrame
    parent_key: str
    parent_time: str
    parent_deleted: str | None = None


def compress(raw: bytes) -> bytes:
    """A bitmap as sorted positions if that is shorter, else as it is; the first byte tells which."""
    on = np.flatnonzero(np.unpackbits(np.frombuffer(raw, "u1"), bitorder="little"))
    return b"A" + on.astype("<u2").tobytes() if len(on) < _SPARSE else b"B" + raw


def expand(packed: bytes | None) -> np.ndarray:
    """Booleans of all positions of a compressed bitmap; none for null."""
    out = np.zeros(1 << RANGE_BITS, bool)
    if packed is not None and packed[:1] == b"A":
        out[np.frombuffer(packed, "<u2", offset=1)] = True
    elif packed is not None:
        out = np.unpackbits(np.frombuffer(packed, "u1", offset=1), bitorder="little").astype(bool)
    return out


@F.pandas_udf(T.BinaryType())
def _compressed(raw: pd.Series) -> pd.Series:
    return raw.map(compress)


@F.pandas_udf(_FINDING)
def _broken(refs: pd.Series, period: pd.Series, known: pd.Series, live: pd.Series, arrivals: pd.Series) -> pd.Series:
    out = []
    for ref, at, have, alive, came in zip(refs, period, known, live, arrivals, strict=True):
        want, have, alive = expand(ref), expand(have), expand(alive)
        late = np.zeros_like(want)
        if at is not None and not pd.isna(at):
            for a in came if came is not None else ():
                if a["period"] >= at:
                    late |= expand(a["bits"])
        found = (("missing", want & ~have), ("deleted", want & have & ~alive), ("late", want & alive & late))
        out.append([{"state": s, "pos": int(p)} for s, bits in found for p in np.flatnonzero(bits)])
    return pd.Series(out)


def _bitmaps(ids: DataFrame, by: list[str], name: str) -> DataFrame:
    raw = ids.groupBy(*by).agg(F.bitmap_construct_agg(F.col("id").bitwiseAND((1 << RANGE_BITS) - 1)).alias("raw"))
    return raw.select(*by, _compressed("raw").alias(name))


def _children(refs: list[Reference]) -> DataFrame:
    """(tab, key, at, row_key) of all referring rows; a null or blank key refers to nothing."""
    parts = [r.child.select(F.lit(r.name).alias("tab"), norm(r.key).alias("key"), F.col(r.time).alias("at"), (norm(r.key) if r.row_key == r.key else F.col(r.row_key).cast("string")).alias("row_key")) for r in refs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("key != ''").withColumn("period", F.year("at") * 12 + F.month("at") - 1)


def _parents(refs: list[Reference]) -> DataFrame:
    parts = [r.parent.select(F.lit(r.name).alias("tab"), norm(r.parent_key).alias("key"), F.col(r.parent_time).alias("came"), (F.col(r.parent_deleted).isNull() if r.parent_deleted else F.lit(True)).alias("live")) for r in refs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("key != ''")


def dictionary(refs: list[Reference]) -> DataFrame:
    """One row per table and key: id, the periods it is referred to, and what is known of its target rows.

    Ids are dense within each sorted partition and start at a multiple of the range size.
    """
    child = _children(refs).select("tab", "key", F.struct("period").alias("ref"), F.lit(None).cast("timestamp").alias("came"), F.lit(None).cast("boolean").alias("live"), F.lit(0).alias("target"))
    parent = _parents(refs).select("tab", "key", F.lit(None).cast("struct<period:int>").alias("ref"), "came", "live", F.lit(1).alias("target"))
    rows = child.unionByName(parent.withColumn("came", F.col("came").cast("timestamp")))
    known = rows.groupBy("tab", "key").agg(
        F.collect_set("ref").alias("refs"),
        F.max("target").alias("target"),
        F.max("live").alias("live"),
        F.when(F.max(F.when((F.col("target") == 1) & F.col("came").isNull(), 1).otherwise(0)) == 0, F.min("came")).alias("came"),
    )
    return cut(known.sort("tab", "key").withColumn("id", F.monotonically_increasing_id()).withColumn("bucket", F.shiftright("id", RANGE_BITS)))


def broken_keys(known: DataFrame) -> DataFrame:
    """(tab, key, period, state, came) of the references that the bitmaps find broken; period is null where the row has no time."""
    refs = known.select("tab", "bucket", "id", F.explode("refs").alias("r")).select("tab", "bucket", "id", F.col("r.period").alias("period"))
    target = known.filter("target = 1")
    have = _bitmaps(target, ["tab", "bucket"], "known")
    alive = _bitmaps(target.filter("live"), ["tab", "bucket"], "live")
    month = target.filter("came is not null").withColumn("period", F.year("came") * 12 + F.month("came") - 1)
    came = _bitmaps(month, ["tab", "bucket", "period"], "bits").groupBy("tab", "bucket").agg(F.collect_list(F.struct("period", "bits")).alias("came"))
    joined = _bitmaps(refs, ["tab", "bucket", "period"], "refs").join(have, ["tab", "bucket"], "left").join(alive, ["tab", "bucket"], "left").join(came, ["tab", "bucket"], "left")
    bits = joined.select("bucket", "period", F.explode(_broken("refs", "period", "known", "live", "came")).alias("x"))
    found = bits.select((F.shiftleft("bucket", RANGE_BITS) + F.col("x.pos")).alias("id"), "period", F.col("x.state").alias("state"))
    return found.join(known.select("id", "tab", "key", "came"), "id").drop("id")


def orphan_references(refs: list[Reference]) -> DataFrame:
    """(source_table, row_key, ref_state, ref_month) of every broken reference, distinct.

    'missing' has no target row, 'deleted' only deleted ones, 'late' a first target row later than the
    referring row; the first that applies. Without a time on the referring row or on any target row nothing
    is late. Null and blank keys are no references. ref_month is 'yyyy-MM' or 'unknown'.
    """
    found = broken_keys(dictionary(refs)).withColumnRenamed("period", "p")
    rows = _children(refs)
    hit = rows.join(found, (rows["tab"] == found["tab"]) & (rows["key"] == found["key"]) & rows["period"].eqNullSafe(found["p"]))
    return (
        hit.filter((F.col("state") != "late") | (F.col("came") > F.col("at")))
        .select(rows["tab"].alias("source_table"), "row_key", F.col("state").alias("ref_state"), F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown")).alias("ref_month"))
        .distinct()
    )


def orphan_report(refs: list[Reference]) -> DataFrame:
    """(source_table, ref_month, ref_state, n_refs): broken references counted per table and period."""
    return orphan_references(refs).groupBy("source_table", "ref_month", "ref_state").agg(F.count("*").alias("n_refs"))
