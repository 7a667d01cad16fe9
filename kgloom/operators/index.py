"""A stored inverted index: postings by term, lengths by document, read by searches in place of the texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators.corpus import K1, B, idf, top_k

BUCKETS = 32


def bucket(term: Column | str) -> Column:
    """The folder of a term's postings."""
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, key: str, fields: dict[str, Column], root: str) -> InvertedIndex:
    """Write the index of ``docs`` to ``root``: fields are token arrays by name. Rows with one key are one document.

    Postings are written by bucket of their term, so that a search opens only the buckets of its terms; they hold
    the term's document frequency, which costs no second pass over texts. Documents without tokens count.
    """
    spark = docs.sparkSession
    part = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), t.alias("t")) for f, t in fields.items())))
    each = docs.select(key, part.alias("p")).select(key, "p.*")
    each.groupBy(key, "field").agg(F.sum(F.size("t")).alias("length")).write.mode("overwrite").parquet(f"{root}/lengths")
    lengths = spark.read.parquet(f"{root}/lengths")
    tf = each.select(key, "field", F.explode("t").alias("term")).groupBy("field", "term", key).agg(F.count("*").alias("tf"))
    tf = tf.withColumn("bucket", bucket("term"))
    df = tf.groupBy("field", "term").agg(F.count("*").alias("df"))
    tf.join(df, ["field", "term"]).join(lengths, [key, "field"]).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings")
    lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("length").alias("mean")).write.mode("overwrite").parquet(f"{root}/stats")
    return InvertedIndex(spark, root, key)


@dataclass
class InvertedIndex:
    spark: SparkSession
    root: str
    key: str

    def postings(self, terms: DataFrame) -> DataFrame:
        """Postings of some terms; only their buckets are read."""
        wanted = terms.select("term", bucket("term").alias("bucket")).distinct()
        return self.spark.read.parquet(f"{self.root}/postings").join(wanted, ["bucket", "term"], "left_semi")

    def search(self, queries: DataFrame, query_tokens: Column, boosts: dict[str, float], *, qkey: str = "qid", k: int = 10) -> DataFrame:
        """The k best documents of each query by BM25 over the boosted fields, ties by key. No text is read."""
        terms = queries.select(qkey, F.explode(F.array_distinct(query_tokens)).alias("term"))
        stats = self.spark.read.parquet(f"{self.root}/stats")  # one row a field
        weight = F.create_map(*[F.lit(x) for p in boosts.items() for x in p])[F.col("field")]
        found = self.postings(terms).filter(F.col("field").isin(*boosts)).join(F.broadcast(stats), "field")
        norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.greatest("mean", F.lit(1e-9)))
        scored = found.select(self.key, "term", (weight * idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / norm).alias("w"))
        total = scored.join(terms, "term").groupBy(qkey, self.key).agg(F.round(F.sum("w"), 6).alias("score"))
        return top_k(total, [qkey], [F.desc("score"), F.col(self.key)], k)
