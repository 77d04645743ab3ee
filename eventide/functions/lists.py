"""List functions over the candidates of one query, as window expressions partitioned by the query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in(*keys: str) -> Window:
    return Window.partitionBy(*keys)


def average_rank(score: str, *keys: str) -> Column:
    """1-based descending rank, ties averaged."""
    return F.rank().over(_in(*keys).orderBy(F.desc(score))) + (F.count(F.lit(1)).over(_in(*keys, score)) - 1) / 2


def percentile(score: str, *keys: str, single: float = 0.5) -> Column:
    """Ascending mid-rank percentile in 0..1; ``single`` where a query has one candidate."""
    n = F.count(F.lit(1)).over(_in(*keys))
    return F.when(n == 1, single).otherwise((n - average_rank(score, *keys)) / (n - 1))


def softmax(score: str, *keys: str, temperature: float = 1.0) -> Column:
    e = F.exp((F.col(score) - F.max(score).over(_in(*keys))) / temperature)
    return e / F.sum(e).over(_in(*keys))


def min_max(score: str, *keys: str) -> Column:
    """Scaled to 0..1; a constant row is 0."""
    lo, hi = F.min(score).over(_in(*keys)), F.max(score).over(_in(*keys))
    return F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(0.0)


def robust_z(score: str, *keys: str) -> Column:
    """Distance to the median over 1.4826 times the median absolute deviation; 0 where that is at most 1e-6."""
    middle = F.percentile(score, F.lit(0.5)).over(_in(*keys))
    spread = F.expr(f"percentile({score}, 0.5)").over(_in(*keys))
    values = F.collect_list(score).over(_in(*keys))
    off = F.array_sort(F.transform(values, lambda x: F.abs(x - middle)))
    n = F.size(off)
    mad = (F.element_at(off, F.floor((n + 1) / 2).cast("int")) + F.element_at(off, F.floor(n / 2).cast("int") + 1)) / 2 * 1.4826
    return F.when(mad <= 1e-6, 0.0).otherwise((F.col(score) - spread) / mad)


def place(score: str, prior: str, candidate: str, position: str, *keys: str) -> Column:
    """Deterministic order: score, then prior descending, then candidate and position ascending."""
    return F.row_number().over(_in(*keys).orderBy(F.desc(score), F.desc(prior), F.asc(candidate), F.asc(position)))


def reciprocal_ranks(scores: DataFrame, score: str = "s", key: str = "qid", position: str = "pos") -> DataFrame:
    """(key, optimistic, tie_neutral): reciprocal ranks of the candidate at position 0 of each query."""
    own = F.max(F.when(F.col(position) == 0, F.col(score))).over(_in(key))
    marked = scores.select(key, position, F.col(score).alias("x"), own.alias("own"))
    above = F.count(F.when(F.col("x") > F.col("own"), 1))
    level = F.count(F.when((F.col("x") == F.col("own")) & (F.col(position) != 0), 1))
    return marked.groupBy(key).agg((1 / (1 + above)).alias("optimistic"), (1 / (1 + above + level / 2)).alias("tie_neutral"))
