"""Running values and positions in long ordered streams.

A plain window over a stream puts a whole link in one task. Here a stream is cut
into slices, each slice is scanned on its own, and the totals of earlier slices
are carried in. The result is the same and no task sees more than one slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from floodsift.operators.lookup import attach, measure
from floodsift.session import settle

# A slice holds at most 2**20 rows; the totals of slices are one row per slice, and sliced again.
SLICE_BITS = 20
LEVELS = 2
SPINE_BITS = 16
PARTITION_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def scan(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    levels: int | None = 0,
) -> DataFrame:
    """Add values over the rows strictly before each row, per ``by`` in ``order``.

    ``order`` must be a non-negative integer, unique within ``by``. ``sums`` are
    running sums; ``lasts`` are the last non-null values. Slices are ranges of
    ``order``, so they need no sampling and stay the same when a task is retried.

    Slices of slices make a tree. Two levels, the usual number, keep every group within 2**20 rows
    for orders below 2**40, such as dense numbers; ``levels=None`` looks up the largest order and
    takes as many more as that needs, for byte offsets and other sparse numbers.
    """
    if levels is None:
        levels = levels_for(df.agg(F.max(order)).first()[0] or 0)
    levels = levels or LEVELS
    sums, lasts = dict(sums or {}), dict(lasts or {})
    inputs = {f"_in_{name}": value for name, value in {**sums, **lasts}.items()}
    out = _before(df.withColumns(inputs), list(by), order, list(sums), list(lasts), levels - 1)
    return out.drop(*inputs)


def levels_for(largest: int) -> int:
    """Levels of slices with which no group holds more than ``2**SLICE_BITS`` rows."""
    return max(LEVELS, -(-int(largest).bit_length() // SLICE_BITS))


def _before(
    rows: DataFrame, by: list[str], order: str, sums: list[str], lasts: list[str], levels: int
) -> DataFrame:
    slice_of = [] if levels == 0 else [f"_slice{levels}"]
    if slice_of:
        rows = rows.withColumn(slice_of[0], F.shiftright(F.col(order), SLICE_BITS))
    frame = (
        Window.partitionBy(*by, *slice_of)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = {name: F.coalesce(F.sum(f"_in_{name}").over(frame), F.lit(0)) for name in sums}
    local |= {name: F.last(f"_in_{name}", ignorenulls=True).over(frame) for name in lasts}
    if not slice_of:
        return rows.withColumns(local)

    totals = [F.sum(f"_in_{name}").alias(f"_in_{name}") for name in sums]
    totals += [_last_total(f"_in_{name}", order) for name in lasts]
    slices = rows.groupBy(*by, *slice_of).agg(*totals)
    carried = _before(slices, by, slice_of[0], sums, lasts, levels - 1).select(
        *by, *slice_of, *[F.col(name).alias(f"_carry_{name}") for name in sums + lasts]
    )
    joined = rows.withColumns(local).join(carried, [*by, *slice_of])
    total = {name: F.col(name) + F.col(f"_carry_{name}") for name in sums}
    total |= {name: F.coalesce(name, f"_carry_{name}") for name in lasts}
    return joined.withColumns(total).drop(*slice_of, *[f"_carry_{name}" for name in sums + lasts])


def _last_total(value: str, order: str) -> Column:
    return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order))).alias(value)


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Zero-based position of each row within ``by`` in the order of ``order``.

    ``[*by, *order]`` must identify a row. Rows are range-partitioned on all of
    these columns, so a link or an instant that holds most of the rows is spread
    over many tasks. The placed rows are settled, so ``df`` should be narrow: range
    bounds come from a sample and a second evaluation could cut elsewhere.
    """
    keys = [*by, *order]
    placed = settle(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_at", PARTITION_BITS))
    )
    slices = placed.groupBy(*by, "_slice").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    starts = measure(starts, weight="_rows")
    return attach(placed, starts, [*by, "_slice"], spread="_at").select(
        *df.columns, (F.col("_start") + F.col("_at") - F.col("_first")).alias(name)
    )


def spine(bounds: DataFrame, by: Sequence[str], last: str, name: str) -> DataFrame:
    """Rows ``0..last`` for each row of ``bounds``, made slice by slice.

    Slices are spread over a fixed number of tasks: they are tiny themselves, so
    that adaptive coalescing would put them, and all their rows, into one.
    """
    size = 1 << SPINE_BITS
    tasks = int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = bounds.withColumn(
        "_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright(last, SPINE_BITS)))
    )
    start = F.col("_slice") * size
    return slices.repartition(tasks, *by, "_slice").select(
        *by, F.explode(F.sequence(start, F.least(F.col(last), start + size - 1))).alias(name)
    )
