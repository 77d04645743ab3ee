"""Point-in-time statistics of every interaction, from strictly earlier interactions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the buckets in which running totals over all events are summed up first.
BUCKET = 3600
#: Events of a destination that queries meet as one list.
STRETCH = 4096


def before(*keys: str) -> Window:
    """The window of strictly earlier events with the same keys."""
    return Window.partitionBy(*keys).orderBy("t").rangeBetween(Window.unboundedPreceding, -1)


def timeline(events: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(t, n_all, last_all, first_all) per distinct time: events strictly before it, the last of them, the first of all.

    Times are totalled within buckets, and buckets among themselves, so that no
    window runs over more rows than one bucket or the list of buckets has.
    """
    per_t = events.groupBy("t").agg(F.count(F.lit(1)).alias("n")).withColumn("b", F.floor(F.col("t") / bucket))
    inside = Window.partitionBy("b").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = per_t.groupBy("b").agg(F.sum("n").alias("n"), F.max("t").alias("last")).select("b", F.sum("n").over(across).alias("n_b"), F.max("last").over(across).alias("last_b"))
    first = events.agg(F.min("t").alias("first_all"))
    placed = per_t.select("t", "b", F.sum("n").over(inside).alias("n_in"), F.max("t").over(inside).alias("last_in")).join(buckets, "b").join(F.broadcast(first))
    return placed.select("t", (F.coalesce("n_in", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n_all"), F.coalesce("last_in", "last_b").alias("last_all"), "first_all")


def stats_features(events: DataFrame, recent: int = 32, digits: int = 6) -> DataFrame:
    """(seq, src, dst, t) and eight features of each interaction as known just before it.

    Events at the same time do not see each other. recent_hit is one over the
    distance, in events of the source, to its last event with the destination, if
    that is at most ``recent``. Two windows per side share one exchange each.
    """
    ordinal = F.row_number().over(Window.partitionBy("src").orderBy("t", "seq"))
    numbered = events.withColumn("k", ordinal)
    pair, src, dst = before("src", "dst"), before("src"), before("dst")
    seen = numbered.select(
        "seq", "src", "dst", "t",
        F.count(F.lit(1)).over(src).alias("n_src"), F.max("t").over(src).alias("last_src"),
        F.count(F.lit(1)).over(pair).alias("n_pair"), F.max("t").over(pair).alias("last_pair"), F.max("k").over(pair).alias("k_pair"),
        F.count(F.lit(1)).over(dst).alias("n_dst"), F.max("t").over(dst).alias("last_dst"),
    ).join(timeline(events), "t")
    span = F.greatest(F.coalesce("last_all", "first_all") - F.col("first_all"), F.lit(1))
    recency = lambda last: F.when(last.isNull(), 0.0).otherwise(F.exp(-(F.col("t") - last).cast("double") / span))
    all_log = F.log1p(F.greatest("n_all", F.lit(1)))
    back = F.col("n_src") - F.col("k_pair") + 1
    r: dict[str, Column] = {
        "pair_strength": F.log1p("n_pair"),
        "repeat_rate": F.col("n_pair") / F.greatest("n_src", F.lit(1)),
        "pair_recency": recency(F.col("last_pair")),
        "dst_popularity": F.log1p("n_dst") / all_log,
        "dst_recency": recency(F.col("last_dst")),
        "recent_hit": F.when(back <= recent, 1 / back).otherwise(0.0),
        "src_activity": F.log1p("n_src") / all_log,
        "src_recency": recency(F.col("last_src")),
    }
    return seen.select("seq", "src", "dst", "t", *(F.round(c, digits).alias(n) for n, c in r.items()))


def destination_views(ix: DataFrame, q: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(qid, src, t, seq): for the true candidate of each query, its events strictly before the query.

    Events of a destination are numbered in order of time and cut into lists of
    ``stretch``. A query counts the events before it and meets only the lists that
    have some, so that a row per query and list is shuffled, not one per query and
    event, and the lists of one destination go to different tasks.
    """
    n = int(ix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None)
    events = ix.select(F.col("dst").alias("c"), "t", "seq", "src", none.alias("qid"), F.lit(1).alias("is_event"))
    probes = q.where("pos = 0").select("c", "t", none.alias("seq"), none.alias("src"), "qid", F.lit(0).alias("is_event"))
    # Queries come before the events of their time, so the running count is of earlier ones.
    order = Window.partitionBy("c").orderBy("t", "is_event", "seq", "src").rowsBetween(Window.unboundedPreceding, 0)
    placed = events.union(probes).where("c IS NOT NULL AND t IS NOT NULL").withColumn("n", F.sum("is_event").over(order))
    lists = placed.where("is_event = 1").groupBy("c", F.floor((F.col("n") - 1) / stretch).alias("h")).agg(F.collect_list(F.struct("src", "t", "seq")).alias("list")).repartition(n, "c", "h")
    met = placed.where("is_event = 0 AND n > 0").select("c", "qid", F.col("t").alias("at"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / stretch))).alias("h"))
    each = met.repartition(n, "c", "h").join(lists.hint("shuffle_hash"), ["c", "h"]).select("qid", "at", F.explode("list").alias("e"))
    return each.where("e.t < at").select("qid", "e.src", "e.t", "e.seq")
