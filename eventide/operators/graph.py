"""Graph operators: connected components, and co-occurrence with a bounded history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.session import shared_folder

MOST_ROUNDS = 60


def _cut(df: DataFrame) -> DataFrame:
    """Rows in the shared checkpoint folder, with the lineage cut."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(role, node, component) of the bipartite graph; the component is its smallest source.

    Sources and destinations are told apart, as their ids may coincide. Every round
    both sides take the smallest label around them; labels also jump to the label
    of their label, so long chains take logarithmic rounds.
    """
    pairs = _cut(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct())
    label = _cut(pairs.select("s").distinct().select("s", F.col("s").alias("c")))
    for _ in range(MOST_ROUNDS):
        of_d = pairs.join(label, "s").groupBy("d").agg(F.min("c").alias("c"))
        met = pairs.join(of_d, "d").groupBy("s").agg(F.min("c").alias("m"))
        jump = label.select(F.col("s").alias("m"), F.col("c").alias("mm"))
        new = _cut(met.join(jump, "m").select("s", F.least("m", "mm").alias("c")))
        changed = new.join(label.withColumnRenamed("c", "old"), "s").where("c != old").limit(1).count()
        label = new
        if not changed:
            of_d = pairs.join(label, "s").groupBy("d").agg(F.min("c").alias("c"))
            return label.select(F.lit("src").alias("role"), F.col("s").alias("node"), F.col("c").alias("component")).union(of_d.select(F.lit("dst"), "d", "c"))
    raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")


def insertions(events: DataFrame, limit: int) -> DataFrame:
    """(src, dst, t, k): the destinations as they enter the history of their source, numbered from 0.

    The history holds the last ``limit`` inserted destinations, first in first out:
    seeing one again while it is held changes nothing; once expired it may be
    inserted anew. A source that meets no more than ``limit`` destinations inserts
    each at its first event; only the others are walked through in their order.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, None] = {}
        rows = []
        for d, t in pdf.sort_values(["t", "seq"])[["dst", "t"]].itertuples(index=False):
            if d in held:
                continue
            rows.append((d, t, len(rows)))
            held[d] = None
            if len(held) > limit:
                del held[next(iter(held))]
        return pd.DataFrame(rows, columns=["dst", "t", "k"]).assign(src=pdf["src"].iloc[0])[["src", "dst", "t", "k"]]

    first = events.groupBy("src", "dst").agg(F.min(F.struct("t", "seq")).alias("f"))
    own = Window.partitionBy("src")
    numbered = first.select("src", "dst", F.col("f.t").alias("t"), (F.row_number().over(own.orderBy("f.t", "f.seq")) - 1).cast("bigint").alias("k"), F.count(F.lit(1)).over(own).alias("n"))
    wide = first.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("src")
    walked = events.select("src", "dst", "t", "seq").join(wide, "src", "left_semi").groupBy("src").applyInPandas(walk, "src bigint, dst bigint, t bigint, k bigint")
    return numbered.where(F.col("n") <= limit).drop("n").union(walked)


def paired(put: DataFrame, limit: int) -> DataFrame:
    """(a, b, t): each insertion with the ``limit`` of its source before it, at its own time, both ways.

    Insertions meet by the stretch of ``limit`` numbers that they or their
    successors lie in, so a source's rows are joined stretch by stretch.
    """
    stretch = F.floor(F.col("k") / limit)
    x = put.select("src", F.col("dst").alias("x"), F.col("k").alias("kx"), F.explode(F.array(stretch, stretch + 1)).alias("h"))
    y = put.select("src", F.col("dst").alias("y"), F.col("k").alias("ky"), "t", stretch.alias("h"))
    one = x.join(y, ["src", "h"]).where((F.col("ky") - F.col("kx")).between(1, limit) & (F.col("x") != F.col("y")))
    ways = F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in ("xy", "yx")])
    return one.select(F.explode(ways).alias("p"), "t").select("p.a", "p.b", "t")


def fifo_cooccurrence(events: DataFrame, limit: int) -> DataFrame:
    """(a, b, t): each destination new to its source's history with those in it, at the later insertion, in both directions."""
    return paired(insertions(events, limit), limit)


def interest_centres(history: DataFrame, key: str = "src", vector: str = "embedding", order: str = "t", centres: int = 2, rounds: int = 10) -> DataFrame:
    """(key, centre, weight, vector): cosine k-means of each key's history, started from its oldest and newest halves."""
    import numpy as np

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values(order)[vector].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = np.array([p.mean(0) for p in np.array_split(x, min(centres, len(x)))])
        for _ in range(rounds):
            near = (x @ (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).T).argmax(1)
            c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        return pd.DataFrame({key: pdf[key].iloc[0], "centre": range(len(c)), "weight": [float((near == i).mean()) for i in range(len(c))], vector: c.tolist()})

    kind = history.schema[key].dataType.simpleString()
    return history.groupBy(key).applyInPandas(cluster, f"{key} {kind}, centre int, weight double, {vector} array<double>")


def spread_ties(scores: DataFrame, key: str = "qid", place: str = "place", score: str = "s") -> DataFrame:
    """Scores made strictly descending in the order of ``place`` by the smallest steps of a double, per key."""
    import numpy as np

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf["row"]:
                last = np.inf
                for x in sorted(row, key=lambda r: r["place"]):
                    last = min(float(x["s"]), float(np.nextafter(last, -np.inf)))
                    out.append(last)
            rows = pdf.loc[pdf.index.repeat(pdf["row"].map(len)), ["k"]].reset_index(drop=True)
            yield rows.assign(place=[x["place"] for row in pdf["row"] for x in sorted(row, key=lambda r: r["place"])], s=out)

    kind = scores.schema[key].dataType.simpleString()
    lists = scores.groupBy(F.col(key).alias("k")).agg(F.collect_list(F.struct(F.col(place).alias("place"), F.col(score).alias("s"))).alias("row"))
    return lists.mapInPandas(spread, f"k {kind}, place bigint, s double").select(F.col("k").alias(key), F.col("place").alias(place), F.col("s").alias(score))
