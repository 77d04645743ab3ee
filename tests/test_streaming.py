"""The streaming extension on a stream of small files."""

from pyspark.sql import functions as F

from eventide.streaming import state


def _stream(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def _run(df, name, mode):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return df.sparkSession.table(name).collect()


def test_recent_history(spark, tmp_path):
    schema = "src bigint, dst bigint, t bigint, seq bigint"
    stream = _stream(spark, f"{tmp_path}/a", [[(1, d, d, d) for d in range(40)], [(1, 99, 50, 50), (2, 5, 51, 51)]], schema)
    rows = _run(state.recent_history(stream, 4), "recent", "update")
    last = max((r for r in rows if r.src == 1), key=lambda r: r.n)
    assert (last.n, last.recent) == (41, [37, 38, 39, 99])


def test_moments_and_windows(spark, tmp_path):
    schema = "ts timestamp, dst bigint, value double"
    rows = [("2024-01-01 00:00:00", 1, 1.0), ("2024-01-01 01:00:00", 1, 3.0)]
    df = spark.createDataFrame(rows, "ts string, dst bigint, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/b/0")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/b/*")
    got = _run(state.moments(stream), "moments", "complete")[0]
    assert (got.n, got["mean"], got.std) == (2, 2.0, 1.0)
    assert sum(r.n for r in _run(state.sliding_counts(stream), "sliding", "complete")) == 8
