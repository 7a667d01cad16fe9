"""Readers. Schemas are declared, never inferred; formats are read by Spark's own sources."""

from __future__ import annotations

import functools
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.functions.text import norm, strip_ws

#: Schema of published graph rows.
GRAPH_ROW = "subject string, predicate string, object string, subject_type string, object_type string, source_book string, source_chapter string, fact_id string, fact_ids array<string>"


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array (or object) a file; elements that are no objects are dropped."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.filter(F.coalesce(*(F.col(c).cast("string") for c in rows.columns)).isNotNull())


def read_jsonl(spark: SparkSession, path: str, schema: str, *, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines and a BOM are skipped. Strict reading fails on a broken line, else it is dropped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("r"))
    rows = parsed.select("r.*")
    return rows if strict else rows.filter(F.coalesce(*(F.col(c).cast("string") for c in rows.columns)).isNotNull())


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines for .jsonl, a JSON array for .json."""
    return read_jsonl(spark, path, schema) if path.rstrip("/").endswith(".jsonl") else read_json_array(spark, path, schema)


def with_evidence(rows: DataFrame, evidence: DataFrame, seq: str = "evidence_id") -> DataFrame:
    """Text and confidence of the first fact id, only where the row lacks them; the last evidence row of an id wins."""
    last = evidence.groupBy(norm("fact_id").alias("_f")).agg(F.max_by(F.struct("source_text", "confidence"), seq).alias("_e"))
    out = rows.withColumn("_f", F.coalesce(F.get("ids", F.lit(0)), F.col("fact_id"))).join(last, "_f", "left")
    return out.withColumn("source_text", F.coalesce("best_source_text", "_e.source_text")).withColumn("confidence", F.coalesce("best_confidence", "_e.confidence")).drop("_f", "_e")


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated text with a header, every cell stripped, a BOM in front of the header dropped."""
    rows = spark.read.option("sep", "\t").option("header", True).option("enforceSchema", True).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    return rows.select(*(strip_ws(c).alias(c) for c in columns))


def name_map(rows: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """The last non-empty value of each key."""
    return rows.filter((norm(key) != "") & (norm(value) != "")).groupBy(norm(key).alias(key)).agg(F.max_by(norm(value), seq).alias(value))


def decode(content: Column, codecs: tuple[str, ...] = ("utf-8-sig", "gb18030", "gbk")) -> Column:
    """Binary text by the first codec that decodes it; without any, UTF-8 with errors dropped. Null stays null."""

    @F.pandas_udf(T.StringType())
    def run(raw: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            if b is None:
                return None
            for codec in codecs:
                try:
                    return bytes(b).decode(codec)
                except UnicodeDecodeError:
                    continue
            return bytes(b).decode("utf-8", "ignore")

        return raw.map(one)

    return run(content)


def read_books(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, book, text) of text files of unknown encoding."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("book"), decode(F.col("content")).alias("text"))


def read_answers(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Lines of fields between '@', each a list of items between ';' of either width."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    cells = F.split("value", "@")
    items = lambda c: F.filter(F.transform(F.split(F.translate(c, "；", ";"), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return lines.select(*(items(F.coalesce(F.get(cells, F.lit(i)), F.lit(""))).alias(f) for i, f in enumerate(fields)))


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row with the number of non-blank lines."""
    return spark.read.text(path).agg(F.count_if(F.trim("value") != "").alias("lines"))


def attached(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("main", "backup")) -> DataFrame:
    """One table of two stores, each row with the store it is from; columns that one lacks are null."""
    return first.withColumn("store", F.lit(names[0])).unionByName(second.withColumn("store", F.lit(names[1])), allowMissingColumns=True)


def discovered(collections: DataFrame, segments: DataFrame, prefix: str, limit: int) -> DataFrame:
    """Collections (id, name) whose name begins with the prefix, with their vector and metadata segments (collection, scope, segment), by name."""
    scope = lambda s: F.max(F.when(F.col("scope") == s, F.col("segment"))).alias(s.lower())
    held = segments.groupBy("collection").agg(scope("VECTOR"), scope("METADATA"))
    return collections.filter(F.col("name").startswith(prefix)).join(held, F.col("id") == F.col("collection"), "left").drop("collection").orderBy("name").limit(limit)


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """One sheet of a small workbook as strings, columns by its first row; missing cells are null.

    A workbook is a zip of XML that one task reads whole; it is meant for lists made by hand.
    """
    raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as book:
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{main}t"))
        shared = [text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{main}si")] if "xl/sharedStrings.xml" in book.namelist() else []
        rows: list[dict[int, str]] = []
        for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{main}row"):
            cells: dict[int, str] = {}
            for c in row.iter(f"{main}c"):
                letters = re.match("[A-Z]+", c.get("r", "A"))[0]
                at = functools.reduce(lambda n, x: 26 * n + ord(x) - 64, letters, 0)
                value = c.find(f"{main}v")
                kind = c.get("t")
                found = text(c) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else value.text
                if found is not None:
                    cells[at] = found
            rows.append(cells)
    head = rows[0] if rows else {}
    names = [head[i] for i in sorted(head)]
    return spark.createDataFrame([tuple(r.get(i) for i in sorted(head)) for r in rows[1:]], ", ".join(f"`{n}` string" for n in names) or "empty string")


def latest_rows(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row of each key, as an append-only log is read."""
    w = Window.partitionBy(*key).orderBy(F.desc(seq))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
