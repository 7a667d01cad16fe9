"""Sinks. Publishing is by versions: a written one is switched on by a small pointer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """K1: a small text file, written beside its place and renamed into it."""
    temp, fs = _file(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temp, True)
    out.write(bytearray(text.encode()))
    out.close()
    target, _ = _file(spark, path)
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(temp, target)


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _file(spark, path)
    if not fs.exists(p):
        return None
    lines = spark.read.text(path, wholetext=True).select("value").head(2)
    return lines[0][0] if lines else ""


def publish(df: DataFrame, root: str) -> int:
    """Write the next version, then point to it; older versions stay as backups. Gives its number."""
    spark = df.sparkSession
    now = json.loads(read_text(spark, f"{root}/current.json") or '{"version": 0}')["version"]
    df.write.mode("overwrite").parquet(f"{root}/v{now + 1}")
    write_text(spark, f"{root}/current.json", json.dumps({"version": now + 1}))
    return now + 1


def current(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The published version of ``root``, or an older one."""
    now = version or json.loads(read_text(spark, f"{root}/current.json") or "{}")["version"]
    return spark.read.parquet(f"{root}/v{now}")


def quoted(c: Column) -> Column:
    """A string literal of the graph query language: backslashes and quotes escaped, line breaks as spaces."""
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), "[\r\n]+", " "), F.lit('"'))


def graph_statements(facts: DataFrame) -> DataFrame:
    """(kind, statement): one INSERT VERTEX a distinct name and one INSERT EDGE a fact."""
    vid = lambda c: F.concat(F.lit('"ent_'), F.sha1(c), F.lit('"'))
    names = facts.select(F.explode(F.array(*(F.struct(F.col(s).alias("name"), F.col(f"{s}_type").alias("type")) for s in ("subject", "object")))).alias("e")).select("e.*").filter("name != ''").groupBy("name").agg(F.min("type").alias("type"))
    vertex = names.select(F.lit("vertex").alias("kind"), F.concat(F.lit("INSERT VERTEX entity(name, entity_type) VALUES "), vid("name"), F.lit(":("), quoted(F.col("name")), F.lit(", "), quoted(F.col("type")), F.lit(")")).alias("statement"))
    edge = facts.filter("subject != '' and object != ''").select(
        F.lit("edge").alias("kind"),
        F.concat(F.lit("INSERT EDGE relation(predicate, source_book, source_chapter) VALUES "), vid("subject"), F.lit("->"), vid("object"), F.lit(":("), quoted(F.col("predicate")), F.lit(", "), quoted(F.col("source_book")), F.lit(", "), quoted(F.col("source_chapter")), F.lit(")")).alias("statement"),
    )
    return vertex.unionByName(edge)


def lexicon(entities: DataFrame) -> DataFrame:
    """(entity_type, n, first_names): names of each type counted, with the 20 smallest ones."""
    one = entities.groupBy("entity_type", "name").agg(F.lit(1).alias("x"))
    few = one.withColumn("k", F.row_number().over(Window.partitionBy("entity_type").orderBy("name"))).filter("k <= 20")
    lists = few.groupBy("entity_type").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("first_names"))
    return one.groupBy("entity_type").agg(F.count("*").alias("n")).join(lists, "entity_type")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """K2: fixed columns with a header."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


#: Columns of a graph file.
GRAPH_COLUMNS = ["subject", "predicate", "object", "subject_type", "object_type", "source_book", "source_chapter"]


def write_graph(facts: DataFrame, path: str) -> None:
    """K3: the seven columns of graph rows as JSON lines; null is ''."""
    facts.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in GRAPH_COLUMNS)).write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """K4: rows appended as JSON lines."""
    df.write.mode("append").json(path)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small report as a Markdown table; rows beyond ``limit`` are counted in a last line."""
    rows = df.take(limit + 1)
    more = df.count() - limit if len(rows) > limit else 0
    rows = rows[:limit]
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows), *([f"\n{more} more rows"] if more else [])])
