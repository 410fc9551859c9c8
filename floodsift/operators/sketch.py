"""Count-Min sketches as tables of counters.

Keys are grouped by residue before the hash rows are laid out: a group holds at
most 65,521 residues per dimension, however many packets there are, and the
layout of the rows then works on that bounded table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from floodsift.functions.hashing import DIMENSIONS, SketchShape, key_residues, row_buckets, wrap_counter
from floodsift.operators.lookup import attach_in_place
from floodsift.operators.packed import Packed, pack, read


def packet_residues() -> dict[int, Column]:
    return key_residues(*[F.col(c) for c in ("source_ip", "destination_ip", "destination_port", "total_length")])


def residue_counts(packets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Packets per ``by``, key dimension and residue."""
    keys = F.array(
        *[F.struct(F.lit(dim).alias("dim"), r.alias("residue")) for dim, r in packet_residues().items()]
    )
    return (
        packets.select(*by, F.inline(keys))
        .groupBy(*by, "dim", "residue")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def _rows(counted: DataFrame, shape: SketchShape) -> DataFrame:
    return counted.select("*", F.inline(row_buckets(F.col("residue"), shape)))


def build(counted: DataFrame, by: Sequence[str], shape: SketchShape) -> DataFrame:
    """Non-zero counters per ``by``, row and bucket from residue counts."""
    return (
        _rows(counted, shape)
        .groupBy(*by, "row", "bucket")
        .agg(wrap_counter(F.sum("cnt"), shape.counter_bits).alias("cnt"))
    )


def probe(
    sketch: DataFrame, probes: DataFrame, by: Sequence[str], shape: SketchShape
) -> DataFrame:
    """Ask a stored sketch: smallest counter over the rows per residue, 0 where never counted.

    ``probes`` is unique on ``by`` and ``residue``; its other columns are kept.
    """
    keys = [*by, "residue"]
    rest = [c for c in probes.columns if c not in keys]
    counters = sketch.select(*by, "row", "bucket", F.col("cnt").alias("_cnt"))
    found = _rows(probes, shape).join(counters, [*by, "row", "bucket"], "left")
    return found.groupBy(*keys).agg(
        F.min(F.coalesce("_cnt", F.lit(0).cast("bigint"))).alias("estimate"),
        *[F.first(c).alias(c) for c in rest],
    )


def _gather(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """All rows of a group in one task. A fixed number of tasks, because each row is about
    to become one per hash row and adaptive coalescing would go by the size before that."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *by)


def estimate(
    counted: DataFrame, probes: DataFrame, by: Sequence[str], shape: SketchShape
) -> DataFrame:
    """The answers of :func:`build` and :func:`probe` together, with one shuffle.

    Counted and probed residues of a group meet in one task, where the hash rows
    are laid out, summed and compared; neither the rows nor the counters travel.
    A group has at most 65,521 residues on either side.
    """
    keys = [*by, "residue"]
    rest = [c for c in probes.columns if c not in keys]
    learnt = counted.select(*keys, F.col("cnt").alias("_cnt"), F.lit(False).alias("_asked"))
    asked = probes.withColumn("_asked", F.lit(True))
    met = _gather(asked.unionByName(learnt, allowMissingColumns=True), by)
    counter = F.sum("_cnt").over(Window.partitionBy(*by, "row", "bucket"))
    found = _rows(met, shape).withColumn("_counter", wrap_counter(counter, shape.counter_bits))
    return found.where("_asked").groupBy(*keys).agg(
        F.min(F.coalesce("_counter", F.lit(0).cast("bigint"))).alias("estimate"),
        *[F.first(c).alias(c) for c in rest],
    )


def estimate_own(counted: DataFrame, by: Sequence[str], shape: SketchShape) -> DataFrame:
    """:func:`estimate` where the counted residues are the probed ones."""
    counter = F.sum("cnt").over(Window.partitionBy(*by, "row", "bucket"))
    cells = _rows(_gather(counted, by), shape)
    cells = cells.withColumn("_counter", wrap_counter(counter, shape.counter_bits))
    return cells.groupBy(*by, "residue").agg(F.min("_counter").alias("estimate"))


def hash_bucket_counts(keys: DataFrame, residue: Column, row: int, shape: SketchShape) -> DataFrame:
    """One hash row: how many rows of ``keys`` fall into each bucket."""
    buckets = row_buckets(residue, shape)[row]["bucket"]
    return keys.groupBy(buckets.alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"))


def hot_residues(windowed: DataFrame, shape: SketchShape, above: int) -> Packed:
    """One row per link and window with, for each dimension, the residues whose estimate exceeds
    ``above`` and the estimates, packed by residue."""
    group = ["link_id", "w", "dim"]
    estimates = estimate_own(residue_counts(windowed, ["link_id", "w"]), group, shape)
    packed = pack(estimates.where(F.col("estimate") > above), group, "residue", "estimate")
    columns = [F.max(F.when(F.col("dim") == dim, F.col("packed"))).alias(name) for dim, name in DIMENSIONS.items()]
    return Packed.measure(packed.groupBy("link_id", "w").agg(*columns), list(DIMENSIONS.values()))


def heavy_hitters(
    windowed: DataFrame, shape: SketchShape, above: int, top: int, broadcast_bytes: int = 256 << 20
) -> DataFrame:
    """Keys per link, window and dimension whose estimate exceeds ``above``, ranked.

    Estimates are taken by residue first. Packets then meet the hot residues of their window where
    they are read, and only keys with such a residue are grouped. Hot residues beyond
    ``broadcast_bytes`` are met in parts, and ``windowed`` is read once for each.
    """
    group = ["link_id", "w", "dim"]
    hot = hot_residues(windowed, shape, above)
    residues = packet_residues()
    met = attach_in_place(windowed, hot.table, ["link_id", "w"], -(-hot.bytes // broadcast_bytes))
    found = read(met, {f"_est_{name}": (name, residues[dim]) for dim, name in DIMENSIONS.items()})
    pairs = {
        1: (F.col("source_ip"), F.col("destination_ip")),
        2: (F.col("destination_port").cast("bigint"), F.col("destination_ip")),
        3: (F.col("source_ip"), F.col("total_length")),
    }
    keyed = F.array(
        *[
            F.struct(
                F.lit(dim).alias("dim"), low.alias("key_low"), high.alias("key_high"),
                F.col(f"_est_{DIMENSIONS[dim]}").alias("estimate"),
            )
            for dim, (low, high) in pairs.items()
        ]
    )
    keys = found.select("link_id", "w", F.inline(keyed)).where(F.col("estimate").isNotNull()).distinct()
    order = Window.partitionBy(*group).orderBy(F.desc("estimate"), "key_low", "key_high")
    return (
        keys.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select(*group, "rank", "key_low", "key_high", "estimate")
    )
