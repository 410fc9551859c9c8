"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from floodsift.session import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; ``root`` is the smallest node of its component.

    ``edges`` has two bigint columns ``a`` and ``b``; loops and repeats are allowed. Alternates
    the large-star and small-star steps: each replaces the links of a node by links to the
    smallest node near it, so the table never grows beyond the edges and becomes a set of stars.
    Minima are aggregated map-side and joined back, so a node with most of the links is never
    gathered into one group. Every round is checkpointed.
    """
    links = settle(_tidy(edges.select("a", "b")))
    mark = _mark(links)
    while mark[0]:
        links = settle(_small_star(_large_star(links)))
        before, mark = mark, _mark(links)
        if mark == before:
            break
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def _tidy(links: DataFrame) -> DataFrame:
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    return links.where("a <> b").select(larger.alias("a"), smaller.alias("b")).distinct()


def _mark(links: DataFrame) -> tuple[int, int]:
    """Equal after a round only if the round changed nothing."""
    row = links.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h"),
    ).first()
    return row["n"], int(row["h"])


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _tidy(
        both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _tidy(moved.unionByName(least.select("a", F.col("m").alias("b"))))
