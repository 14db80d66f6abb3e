"""Connected components of a graph given by its links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantfuse.llm.shared import passing, written


def _are_stars(links: DataFrame) -> bool:
    """Whether every node that is the greater of a link is of this link only."""
    ends = links.select("node", F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select("other", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 0 and up + down > 1").count() == 0


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """(node, root): the least node that each linked node can reach.

    ``links`` has two columns of one ordered type; direction, repeats and links
    of a node to itself play no part. Nodes without links are not returned.
    ``most`` is a number that there are no more links than, if one is known.

    Each round points every node's greater neighbours at its least neighbour
    and then every node and its lesser neighbours at the least of them, until
    all stars stand alone; the number of rounds grows with the logarithm of a
    component's length. A node's least neighbour is summed within tasks before
    it moves, and joined from a written table, so that Spark can split the links
    of a node that has very many. No neighbour list is ever gathered.

    The links of each step are a table that is removed once the next is written.
    Unlike a checkpoint it is computed once, has no files of empty partitions, is
    read by as many tasks as it has bytes for, and has a size that Spark knows,
    so that a small graph is broadcast and the rounds cost little. No step makes
    more links than there were, so that their number bounds the files of each.
    """
    a, b = (F.col(name) for name in links.columns)
    links, drop = passing(
        links.where(a != b)
        .select(F.greatest(a, b).alias("node"), F.least(a, b).alias("other"))
        .distinct(),
        "links",
        most,
    )
    number = links.count()
    while not _are_stars(links):
        for star in _large_star, _small_star:
            links, drop = _stepped(star, links, drop, number)
    roots = links.select("node", F.col("other").alias("root")).union(
        links.select("other", "other").distinct()
    )
    roots = written(roots, "roots", 2 * number)
    drop()
    return roots


def _stepped(
    star: Callable[[DataFrame, DataFrame], DataFrame],
    links: DataFrame,
    drop: Callable[[], None],
    number: int,
) -> tuple[DataFrame, Callable[[], None]]:
    """The links after a star, in place of those before it."""
    both = links.union(links.select("other", "node")) if star is _large_star else links
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    least, drop_least = passing(least, "least", 2 * number)
    after = passing(star(links, least), "links", number)
    drop()
    drop_least()
    return after


def _large_star(links: DataFrame, least: DataFrame) -> DataFrame:
    """Each neighbour greater than a node goes to the node's least neighbour."""
    # Of the links (node, other) with node < other, other goes to the least.
    upward = links.select(F.col("other").alias("node"), F.col("node").alias("greater"))
    return (
        upward.join(least, "node")
        .select(F.col("greater").alias("node"), F.least("node", "least").alias("other"))
        .distinct()
    )


def _small_star(links: DataFrame, least: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours go to the least of them."""
    moved = links.join(least, "node").where(F.col("other") != F.col("least"))
    return least.toDF("node", "other").union(moved.select("other", "least")).distinct()
