"""Structured question records, schedules, logs and event sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.text import norm
from kgloom.operators.matching import scan
from kgloom.session import cut


def json_terms(c: str) -> Column:
    """A JSON list column as an array; '' and broken lists are empty."""
    return F.coalesce(F.from_json(F.col(c), "array<string>"), F.array().cast("array<string>"))


def pair_hash(question: str, answer: str) -> Column:
    """sha1 of question and answer with white space collapsed."""
    squeeze = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", " "))
    return F.sha1(F.concat(squeeze(question), F.lit("\n"), squeeze(answer)))


def first_of_each(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def slots(question: Column) -> dict[str, Column]:
    """Age, sex, tongue and pulse by ordered patterns; null where none matches."""
    first = lambda *patterns: F.coalesce(*(F.nullif(F.regexp_extract(question, p, 1), F.lit("")) for p in patterns))
    return {"age": first(r"([0-9]{1,3})岁", r"年([0-9]{1,3})"), "sex": first(r"(男|女)"), "tongue": first(r"(舌[绛淡红紫])", r"(苔[白黄腻剥])"), "pulse": first(r"(脉[弦细涩缓沉浮滑数])")}


def to_eav(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, name, value) of non-null columns."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(key, pairs.alias("p")).select(key, "p.*").filter("value is not null")


def from_eav(eav: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The greatest value of each name as columns, one row a key."""
    return eav.groupBy(key).agg(*(F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns))


def shard_probe(rows: DataFrame, by: str, text: Column, terms: DataFrame) -> DataFrame:
    """Score of each shard: 2 for each row a term hits, and 0.1 for each of up to 12 distinct terms."""
    hits = scan(rows.select(by, text.alias("t")), terms.select(F.col("term").alias("name")), by, "t").withColumnRenamed("name", "term")
    return hits.groupBy(by).agg(F.count("*").alias("hits"), F.countDistinct("term").alias("terms")).withColumn("score", F.round(F.col("hits") * 2.0 + 0.1 * F.least("terms", F.lit(12)), 6))


def latest(log: DataFrame, key: list[str], order: list[Column], value: str) -> DataFrame:
    """A36, ST2: the last value of each key; ``order`` must be total."""
    return log.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("entries"))


def trailing_failures(log: DataFrame, key: str, order: list[str], ok: Column) -> DataFrame:
    """Successes, failures, rate and the failures since the last success of each key."""
    tagged = log.select(key, F.struct(*order).alias("at"), ok.alias("ok"))
    last = tagged.groupBy(key).agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_ok"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"))
    since = tagged.join(last.select(key, "last_ok"), key).filter(~F.col("ok") & (F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok")))).groupBy(key).agg(F.count("*").alias("trailing"))
    return last.drop("last_ok").join(since, key, "left").na.fill(0, ["trailing"]).withColumn("rate", F.round(F.col("successes") / (F.col("successes") + F.col("failures")), 6))


def segments(events: DataFrame, key: str, order: list[str], marker: Column) -> DataFrame:
    """Events numbered by the markers before them; a marker closes its segment."""
    w = Window.partitionBy(key).orderBy(*order)
    closed = F.sum(F.coalesce(F.lag(marker.cast("int")).over(w), F.lit(0))).over(w)
    return events.withColumn("segment", closed)


def runs(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Neighbouring rows of equal value as one run: (key, run, value, length)."""
    w = Window.partitionBy(key).orderBy(*order)
    change = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(0))
    return events.withColumn("_c", change).withColumn("run", F.sum("_c").over(w)).groupBy(key, "run", value).agg(F.count("*").alias("length"))


def interleave(tasks: DataFrame, by: str, order: str) -> DataFrame:
    """Round robin over books: the first task of each, then the second of each."""
    numbered = tasks.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    return numbered.sort("turn", by).select(by, order, "turn")


def schedule(tasks: DataFrame, by: str, order: str, skip: int, cap: int) -> DataFrame:
    """Tasks of each book without its first ``skip``, at most ``cap``."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return tasks.withColumn("n", n).filter((F.col("n") > skip) & (F.col("n") <= skip + cap)).withColumn("n", F.col("n") - skip)


def sample_indices(total: int, count: int) -> list[int]:
    """Evenly spaced positions round((n - 1) * i / (m + 1)), half to even; taken ones move up, then down; all if n <= m."""
    if total <= count:
        return list(range(max(0, total)))
    out: list[int] = []
    for i in range(1, count + 1):
        at = round((total - 1) * i / (count + 1))
        free = [x for x in range(at, total) if x not in out] or [x for x in range(at, -1, -1) if x not in out]
        out.append(free[0])
    return sorted(out)


def done_groups(tasks: DataFrame, done: DataFrame, group: str, key: list[str]) -> DataFrame:
    """A42, ST3, ST16: of each group scheduled, completed and pending tasks, and whether all are done."""
    flag = tasks.join(done.select(*key).distinct().withColumn("_d", F.lit(1)), key, "left")
    return flag.groupBy(group).agg(F.count("*").alias("scheduled"), F.count("_d").alias("completed")).withColumn("pending", F.col("scheduled") - F.col("completed")).withColumn("complete", F.col("pending") == 0)


def token_counts(rows: DataFrame, by: str, tokens: Column) -> DataFrame:
    """Rows and tokens of each group."""
    return rows.groupBy(by).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size(tokens)), F.lit(0)).cast("long").alias("tokens"))


def dense_numbers(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Rows numbered from 0 in a total order, range by range: no task holds more than its range, the driver one count a range."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = sorted(ranged.groupBy("_range").count().collect())
    starts, at = {}, 0
    for r in counts:
        starts[r["_range"]] = at
        at += r["count"]
    first = F.create_map(*[F.lit(x) for p in starts.items() for x in p])[F.col("_range")] if starts else F.lit(0)
    n = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(name, (first + n - 1).cast("long")).drop("_range")


def required(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows whose listed columns all hold text."""
    out = rows
    for c in columns:
        out = out.filter(norm(c) != "")
    return out
