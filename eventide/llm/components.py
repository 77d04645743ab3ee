"""Connected components of a graph given by its edges, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import release, stage

MOST_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge to another; the component is the smallest node reachable.

    Alternating large-star and small-star steps: every node hands its larger
    neighbours, then its smaller ones, to the smallest neighbour it knows, until
    only stars are left. A step is a minimum per node, pre-aggregated before the
    shuffle, and a join back, so no node's neighbours meet in one task. Loops and
    repeated edges change nothing; edges with a null end are ignored. The result is
    a staged table; of the rounds before it none is kept.
    """
    star = stage(_minor(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    for _ in range(MOST_ROUNDS):
        # A star forest: nobody points to two nodes, and nobody points to one that points on.
        ends = star.select("u", F.lit(1).alias("out"), F.lit(0).alias("met")).union(star.select("v", F.lit(0), F.lit(1)))
        tangled = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("met").alias("met")).where("out > 1 OR (out > 0 AND met > 0)")
        if tangled.isEmpty():
            return _renamed(star)
        star = stage(_small_star(_large_star(star)), star)
    raise RuntimeError(f"components not reached after {MOST_ROUNDS} rounds")


def merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """component, a staged table (node, component), after the links (a, b) between its nodes join some of its components; replaces it."""
    of = lambda s: component.select(F.col("node").alias(s), F.col("component").alias(f"of_{s}"))
    joined = components(links.join(of("a"), "a").join(of("b"), "b").where("of_a != of_b").select("of_a", "of_b"), "of_a", "of_b")
    above = joined.select(F.col("node").alias("component"), F.col("component").alias("above"))
    out = stage(component.join(above, "component", "left").select("node", F.coalesce("above", "component").alias("component")), component)
    release(joined)
    return out


def _renamed(star: DataFrame) -> DataFrame:
    out = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out._staged_at = star._staged_at  # the same table under other names
    return out


def _minor(pairs: DataFrame) -> DataFrame:
    """Distinct edges from the larger node to the smaller one."""
    return pairs.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _minor(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _minor(edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least))
