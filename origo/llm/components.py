"""Connected components of links between ids, by large and small stars.

Links stay distributed. Each round links every node's larger neighbours, then
its smaller ones, to the least node around; the links shrink to stars around
the least node of each component in a number of rounds that grows with the
logarithm of the longest path. Rounds are checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from origo.llm.common import checkpointed, parts_for, redealt, released

_PART = 1 << 16


def _least(links: DataFrame) -> DataFrame:
    """For each node its least neighbour or itself; partial minima come first,
    so a node with very many neighbours is no heavy group."""
    return links.groupBy("a").agg(F.min("b").alias("m"))


def _each(links: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """A row a, b for each of these pairs of columns. One pass: a union would plan and
    run what leads to the links once for each."""
    rows = F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs]))
    return links.select(rows.alias("x")).select("x.a", "x.b")


def _large_star(links: DataFrame) -> DataFrame:
    both = _each(links, ("a", "b"), ("b", "a"))
    least = _least(both).select("a", F.least("a", "m").alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(redealt(least, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = down.join(redealt(_least(down), "a"), "a")
    return _each(joined, ("b", "m"), ("a", "m")).filter(F.col("a") != F.col("b"))


def _told(links: DataFrame) -> tuple[int, bool]:
    """How many links there are; and whether they are stars, which a round would leave
    as they are: no node has two links up, or one up and one down."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"))))
    nodes = links.select(ends.alias("x")).groupBy("x.node").agg(F.sum("x.up").alias("ups"), F.min("x.up").alias("least"))
    more = (F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("least") == 0))
    n, odd = nodes.agg(F.sum("ups"), F.count(F.when(more, 1))).first()
    return n or 0, odd == 0


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """`node, component` of every node with a link; a component's name is its
    least node. `links`: columns a, b."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a") != F.col("b")).alias("apart"))
    links = checkpointed(down.filter("apart").select("a", "b").distinct())
    n, stars = _told(links)
    for _ in range(most_rounds):
        if stars:
            break
        # As many partitions as the links need: rounds read them several times.
        links, old = checkpointed(_small_star(_large_star(links).distinct()).distinct().coalesce(parts_for(n, _PART))), links
        released(old)
        n, stars = _told(links)
    if not stars:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    leaves = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
