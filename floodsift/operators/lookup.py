"""Left joins of a large table to a small one whose size is known, not assumed.

A lookup table is unique on its keys and knows how many rows of the large table
each key stands for. It is broadcast while it is small. Beyond that the keys
that stand for many rows are broadcast (their number is bounded by the total),
and the rest, which cannot be skewed any more, is joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from floodsift.session import settle

BROADCAST_ROWS = 1_000_000
HOT_ROWS = 1_000_000
SPREAD = 1 << 20


def attach_in_place(large: DataFrame, table: DataFrame, on: Sequence[str], parts: int) -> DataFrame:
    """Left join of ``table``, unique on ``on``, that never moves a row of ``large``.

    The table is broadcast, or in ``parts`` by a hash of the key; then each part is met by the rows
    of that hash, and ``large`` is read once for every part.
    """
    if parts <= 1:
        return large.join(F.broadcast(table), list(on), "left")

    def part(rows: DataFrame, number: int) -> DataFrame:
        return rows.where(F.pmod(F.xxhash64(*on), F.lit(parts).cast("bigint")) == number)

    met = [part(large, k).join(F.broadcast(part(table, k)), list(on), "left") for k in range(parts)]
    return reduce(DataFrame.unionByName, met)


@dataclass(frozen=True)
class Lookup:
    table: DataFrame
    weight: str
    rows: int
    total: int

    def fits(self, limit: int = BROADCAST_ROWS) -> bool:
        return self.rows <= limit


def measure(table: DataFrame, weight: str, settled: bool = False) -> Lookup:
    """Settle ``table`` and measure it; ``weight`` counts the large table's rows per key."""
    table = table if settled else settle(table)
    size = table.agg(F.count(F.lit(1)).alias("rows"), F.sum(weight).alias("total")).first()
    return Lookup(table, weight, size["rows"], size["total"] or 0)


def attach(
    large: DataFrame,
    lookup: Lookup,
    on: Sequence[str],
    spread: str,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join of the lookup's columns; ``spread`` names a column of ``large`` that varies."""
    on = list(on)
    values = [c for c in lookup.table.columns if c not in on and c != lookup.weight]
    if lookup.fits(broadcast_rows):
        return large.join(F.broadcast(lookup.table.select(*on, *values)), on, "left")

    # At most total / hot_rows keys can be hotter than hot_rows.
    hot_rows = max(hot_rows, -(-lookup.total // broadcast_rows))
    found = F.struct(*values)
    hot = lookup.table.where(F.col(lookup.weight) > hot_rows).select(*on, found.alias("_hot"))
    cold = lookup.table.where(F.col(lookup.weight) <= hot_rows).select(
        *on, F.lit(0).cast("bigint").alias("_salt"), found.alias("_cold")
    )
    # Rows answered by the broadcast take salts that match nothing and spread evenly.
    salt = F.when(
        F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SPREAD).cast("bigint")) + 1
    ).otherwise(F.lit(0).cast("bigint"))
    return (
        large.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", salt)
        .join(cold, [*on, "_salt"], "left")
        .withColumn("_found", F.coalesce("_hot", "_cold"))
        .select(*large.columns, *[F.col(f"_found.{c}").alias(c) for c in values])
    )
