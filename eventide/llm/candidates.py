"""Candidate pairs from inverted lists, without all pairs of a list.

Entries are rows (token, node, size, ...): a node of that set size is on the list
of that token. Only DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of 64 bits in a sketch: bit i is the parity of the set's tokens whose hash falls on it.
SKETCH = 4


def meet_hubs(lists: DataFrame) -> DataFrame:
    """For every node the hub it shares most tokens with.

    The hub of a list is the member whose own lists are longest for its size: what
    the variants of a text have in common stands on long lists, what each has
    changed on short ones.
    """
    long = lists.groupBy("token").agg(F.count(F.lit(1)).alias("members"))
    weight = lists.join(long, "token").groupBy("node").agg((F.sum("members") / F.first("size")).alias("weight")).select("node", F.struct("weight", "node").alias("rank"))
    hubs = lists.join(weight, "node").groupBy("token").agg(F.max("rank").alias("rank")).select("token", F.col("rank.node").alias("hub"))
    met = lists.join(hubs, "token").where("node != hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("c"))
    return met.groupBy("node").agg(F.max(F.struct("c", "hub")).alias("best")).select(F.col("node").alias("a"), F.col("best.hub").alias("b"))


def meet_several(entries: DataFrame, several: int = 6) -> DataFrame:
    """For every node up to ``several`` partners in other components: those it shares most tokens with among as many members, drawn by hash, of each of its tokens' lists."""
    drawn = entries.withColumn("k", F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("node"), "node"))).where(F.col("k") <= several)
    partner = drawn.select("token", F.col("node").alias("partner"), F.col("component").alias("other"))
    met = entries.join(partner, "token").where("component != other").groupBy("node", "partner").agg(F.count(F.lit(1)).alias("c"))
    best = met.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("c"), "partner"))).where(F.col("k") <= several)
    return best.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b")).distinct()


def spanning_entries(lists: DataFrame, component: DataFrame) -> DataFrame:
    """The entries of the lists whose members lie in several components, with their component and the number of the list's members."""
    placed = lists.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_lists = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo != hi").select("token", "members")
    return placed.join(open_lists, "token")


def sketches_close(percent: int, numbers: int = SKETCH) -> Callable[[str, str], Column]:
    """Whether two bit sketches allow the similarity; their columns end in the same letters as those of the sizes."""

    def close(x: str, y: str) -> Column:
        differ = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(numbers)), F.lit(0))
        return (100 + percent) * differ <= (100 - percent) * (F.col(f"size_{x[-1]}") + F.col(f"size_{y[-1]}"))

    return close


def pairs_across(spanning: DataFrame, percent: int, carried: str, close: Callable[[str, str], Column], earlier: str | None = None) -> DataFrame:
    """Pairs of nodes in different components that share as many prefix tokens as the less demanding of them requires.

    Sets of sizes n >= m with enough in common share at least percent (n + m) / (100 + percent) tokens. So the smaller
    one needs only the prefix that this leaves it beside an equal partner, and a shared token counts only
    where enough can come with it: before it those of its set's entries that other components hold too, behind it all.
    ``close`` of the two nodes' columns ``carried`` leaves out pairs before they are counted.

    Where every entry requires one match, a pair may meet at the first token it shares alone: all it has in common lies there
    and behind it. ``earlier`` names the column of the tokens just before an entry; where they tell that another came first, the pair
    is left out. Then a pair may still come more than once.
    """
    if earlier is None:
        spanning = spanning.withColumn("before", F.row_number().over(Window.partitionBy("node").orderBy("place")) - 1)
    index = F.col("place") < F.col("size") - F.ceil(2 * percent * F.col("size") / (100 + percent)) + F.col("matches")
    column = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("node", "size", "matches", "place", earlier or "before", carried, "component")]
    x, y = spanning.select("token", *column("x")), spanning.where(index).select("token", *column("y"))
    order = (F.col("size_x") > F.col("size_y")) | ((F.col("size_x") == F.col("size_y")) & (F.col("node_x") > F.col("node_y")))
    sizes = 100 * F.col("size_y") >= percent * F.col("size_x")
    reach = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y"))
    if earlier is None:
        reach = reach + F.least("before_x", "before_y")
    enough = (100 + percent) * reach >= percent * (F.col("size_x") + F.col("size_y"))
    met = x.join(y, "token").where(order & sizes & enough & close(f"{carried}_x", f"{carried}_y") & (F.col("component_x") != F.col("component_y")))
    if earlier is not None:
        return met.where(~F.arrays_overlap(f"{earlier}_x", f"{earlier}_y")).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))
    grouped = met.groupBy(F.col("node_x").alias("a"), F.col("node_y").alias("b")).agg(
        F.count(F.lit(1)).alias("c"), F.first(F.least("matches_x", "matches_y")).alias("needed"),
        F.least(F.max(F.col("size_x") - F.col("place_x")), F.max(F.col("size_y") - F.col("place_y"))).alias("most"), F.first(F.col("size_x") + F.col("size_y")).alias("both"),
    )
    return grouped.where(F.expr(f"c >= needed AND {100 + percent} * most >= {percent} * both")).select("a", "b")
