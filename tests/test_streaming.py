"""Streams against sets larger than a broadcast would be let to hold."""

from kgloom.streaming import pipelines


def test_every_finished_user_counts(spark, tmp_path):
    n = 1_000_001
    path = f"{tmp_path}/events"
    spark.sql(f"SELECT id AS event_id, timestamp_seconds(id) AS ts, id AS user_id, 'view' AS event_type, 0D AS value, '' AS props FROM range({n + 1})").repartition(2).write.parquet(path)
    got = pipelines.pending(spark, path, spark.range(n).withColumnRenamed("id", "user_id"))
    assert [tuple(r) for r in got.collect()] == [(n, n)]
