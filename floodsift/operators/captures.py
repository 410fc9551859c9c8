"""Positions, timestamps, comparison and decision streams of captures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from floodsift.operators.ordering import positions, scan
from floodsift.session import stage

DEFAULT_TIMESTAMP = "idx * 0.00005"
CAPTURE_ORDER = ("packet_id",)


def packet_ordinals(packets: DataFrame) -> DataFrame:
    """Add ``ordinal``, the zero-based position of each packet in its capture."""
    return scan(
        packets, ["link_id"], "packet_id", sums={"ordinal": F.lit(1).cast("bigint")}, levels=None
    )


def retimestamp(packets: DataFrame, expression: str = DEFAULT_TIMESTAMP) -> DataFrame:
    """Replace ``ts`` by ``expression``, seconds as a SQL expression over ``idx``."""
    numbered = packet_ordinals(packets).withColumnRenamed("ordinal", "idx")
    micros = F.round(F.expr(expression).cast("double") * 1_000_000).cast("bigint")
    return numbered.withColumn("ts", F.timestamp_micros(micros)).drop("idx")


def compare_captures(
    left: DataFrame, right: DataFrame, order: Sequence[str] = CAPTURE_ORDER
) -> DataFrame:
    """Per link: both packet counts and the first one-based position that differs.

    Packets are numbered in capture order unless ``order`` names other columns, which with
    ``link_id`` must identify a packet. Frames travel as SHA-256 digests, so payloads are not
    shuffled. ``first_difference`` is NULL for equal captures and, as for any prefix, where the
    shorter one ends first it is the position after its end.
    """

    def ordered(frames: DataFrame, digest: str) -> DataFrame:
        digests = stage(frames.select("link_id", *order, F.sha2("frame", 256).alias(digest)))
        if tuple(order) == CAPTURE_ORDER:
            return packet_ordinals(digests).drop(*order)
        return positions(digests, ["link_id"], order, "ordinal").drop(*order)

    paired = ordered(left, "left").join(ordered(right, "right"), ["link_id", "ordinal"], "full")
    return paired.groupBy("link_id").agg(
        F.count("left").alias("left_packets"),
        F.count("right").alias("right_packets"),
        F.min(F.when(~F.col("left").eqNullSafe(F.col("right")), F.col("ordinal") + 1)).alias(
            "first_difference"
        ),
    )


def expand_decisions(decisions: DataFrame, packets: DataFrame) -> DataFrame:
    """Verdicts from a run-length decision stream.

    ``x > 0`` passes the next ``x`` packets and 0 drops one. A decision is a
    5-bit number, so one row makes at most 31. Decisions beyond the last packet
    are ignored; packets beyond the last decision have no verdict yet.
    """
    covered = F.greatest(F.col("x"), F.lit(1)).cast("bigint")
    starts = scan(decisions, ["link_id"], "decision_seq", sums={"start": covered})
    each = starts.select(
        "link_id",
        (F.col("x") > 0).alias("pass"),
        F.explode(F.sequence(F.col("start"), F.col("start") + covered - 1)).alias("ordinal"),
    )
    return packet_ordinals(packets).join(each, ["link_id", "ordinal"]).select(
        "link_id", "packet_id", "ordinal", "pass"
    )
