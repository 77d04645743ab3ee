"""The streaming extension over the driver's events: each query drains them as a stream once and returns what it gave."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.session import shared_folder
from eventide.streaming import state

from .dialect import Statement as S
from .dialect import frame


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of (src, dst, t, seq, ts, value)."""
    path = f"{sf_dir}/events.parquet"
    raw = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, as the table may be one file
    ts = F.col("ts").cast("timestamp")
    return raw.select(F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("bigint").alias("dst"), F.unix_seconds(ts).alias("t"), F.col("event_id").alias("seq"), ts.alias("ts"), "value")


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """All rows that the stream gives until it has read what is there; in complete mode those of the last batch."""
    spark, folder = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _drained(state.recent_history(_events(spark, sf_dir)), "update")
    last = rows.groupBy("src").agg(F.max_by(F.struct("n", "recent"), "n").alias("x"))
    return last.select("src", "x.n", F.array_join(F.transform("x.recent", lambda d: d.cast("string")), ",").alias("recent"))


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _drained(state.sliding_counts(_events(spark, sf_dir)), "complete")
    return rows.select(F.unix_seconds("window.start").alias("since"), "dst", "n")


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _drained(state.moments(_events(spark, sf_dir)), "complete")
    return rows.select("n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    history = frame(spark, sf_dir, "SELECT * FROM {ix}")
    writer = state.features_per_batch(_events(spark, sf_dir), history, f"{folder}/rows")
    writer.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start().awaitTermination()
    return spark.read.schema("src bigint, t bigint, n_src bigint, last_t bigint").parquet(f"{folder}/rows")


QUERIES = {
    "p1_p5_recent_history": S("P1 P5", "", "SELECT src, count(*) AS n, array_to_string(list(dst ORDER BY t, seq)[-32:], ',') AS recent FROM {ix} GROUP BY src", recent_history),
    "p2_p3_sliding_counts": S("P2 P3", "", "SELECT t // 21600 * 21600 - 21600 * k AS since, dst, count(*) AS n FROM {ix}, (SELECT unnest(generate_series(0, 3)) AS k) w GROUP BY ALL", sliding_counts),
    "p4_moments": S("P4", "", "SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM {events}", moments),
    "p6_probes_before_events": S("P6", "", "SELECT DISTINCT a.src, a.t, (SELECT count(*) FROM {ix} e WHERE e.src = a.src AND e.t < a.t) AS n_src, (SELECT max(t) FROM {ix} e WHERE e.src = a.src AND e.t < a.t) AS last_t FROM {ix} a", probes),
}
