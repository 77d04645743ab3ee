"""Streaming analogues, an extension: incremental history, expiry windows, availability delay, running moments."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HISTORY = 32


def recent_history(stream: DataFrame, limit: int = HISTORY) -> DataFrame:
    """Per batch and source: events seen so far and the last ``limit`` destinations, oldest first.

    State is one bounded list per source; events of a batch are taken in time
    order, and the batches must come in time order, as prefixes do.
    """

    def update(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, held = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values(["t", "seq"])
        n, held = n + len(rows), (held + rows["dst"].tolist())[-limit:]
        state.update((n, held))
        yield pd.DataFrame({"src": [key[0]], "n": [n], "recent": [held]})

    return stream.groupBy("src").applyInPandasWithState(update, "src bigint, n bigint, recent array<bigint>", "n bigint, recent array<bigint>", "update", GroupStateTimeout.NoTimeout)


def sliding_counts(stream: DataFrame, width: str = "1 day", slide: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Events per destination in sliding windows; rows later than ``delay`` behind the newest are dropped, as data that was not available."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width, slide), "dst").agg(F.count(F.lit(1)).alias("n"))


def moments(stream: DataFrame, column: str = "value") -> DataFrame:
    """Running count, mean and population deviation; a deviation below 1e-6 counts as 1."""
    dev = F.stddev_pop(column)
    return stream.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.when(dev < 1e-6, 1.0).otherwise(dev).alias("std"))


def features_per_batch(stream: DataFrame, history: DataFrame, sink: str) -> Any:
    """A query that, per micro-batch, joins probes with what the stored history knows strictly before them."""

    def write(batch: DataFrame, number: int) -> None:
        probes = batch.select("src", "t").distinct()
        before = (F.col("h.src") == F.col("p.src")) & (F.col("h.t") < F.col("p.t"))
        seen = probes.alias("p").join(history.alias("h"), before, "left")
        seen.groupBy("p.src", "p.t").agg(F.count("h.t").alias("n_src"), F.max("h.t").alias("last_t")).write.mode("append").parquet(sink)

    return stream.writeStream.foreachBatch(write)
