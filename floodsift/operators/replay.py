"""Answers of hash rows and sketches to ordered logs of operations.

An ``ops`` table has ``sketch_id``, ``seq`` (unique per sketch), ``kind`` and
``payload``. State is never replayed step by step: epochs and modes are running
values, and the answer to a query is the number of inserts before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from floodsift.functions.hashing import SketchShape, residue, row_buckets, wrap_counter
from floodsift.operators.lookup import attach, measure
from floodsift.operators.ordering import scan
from floodsift.operators.sketch import estimate


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def cms_replay(ops: DataFrame, shape: SketchShape) -> DataFrame:
    """``insert`` / ``query`` / ``clear``: the smallest counter over the rows per query."""
    epochs = scan(ops, ["sketch_id"], "seq", sums={"epoch": _is("clear").cast("bigint")})
    rows = epochs.where(~_is("clear")).select(
        "sketch_id", "epoch", "seq", "kind", F.inline(row_buckets(residue(F.col("payload")), shape))
    )
    counted = scan(
        rows,
        ["sketch_id", "epoch", "row", "bucket"],
        "seq",
        sums={"cnt": _is("insert").cast("bigint")},
    )
    return (
        counted.where(_is("query"))
        .groupBy("sketch_id", "seq")
        .agg(F.min(wrap_counter(F.col("cnt"), shape.counter_bits)).alias("count"))
    )


def hashtab_replay(ops: DataFrame, width: int, a: int = 1, b: int = 0) -> DataFrame:
    """The same for a single hash row."""
    return cms_replay(ops, SketchShape(depth=1, width=width, hash_params=((a, b),)))


def rolling_cms_replay(ops: DataFrame, shape: SketchShape) -> DataFrame:
    """``input`` / ``set_mode`` / ``change_roles`` on a rolling sketch.

    In UPDATE mode an input is inserted into the current generation; in QUERY
    mode it is looked up in the generation before, which no longer changes.
    """
    tagged = scan(
        ops,
        ["sketch_id"],
        "seq",
        sums={"generation": _is("change_roles").cast("bigint")},
        lasts={"mode": F.when(_is("set_mode"), F.col("payload"))},
    ).where(_is("input"))
    tagged = tagged.select(
        "sketch_id",
        "seq",
        "generation",
        (F.coalesce("mode", F.lit(0)) != 0).alias("querying"),
        residue(F.col("payload")).alias("residue"),
    )
    by = ["sketch_id", "generation"]
    inserts = tagged.where(~F.col("querying")).groupBy(*by, "residue").agg(
        F.count(F.lit(1)).alias("cnt")
    )
    queries = tagged.where("querying").withColumn("generation", F.col("generation") - 1)
    probes = queries.groupBy(*by, "residue").agg(F.count(F.lit(1)).alias("queries"))
    answers = estimate(inserts, probes, by, shape)
    return attach(
        queries, measure(answers, weight="queries"), [*by, "residue"], spread="seq"
    ).select("sketch_id", "seq", F.col("estimate").alias("count"))
