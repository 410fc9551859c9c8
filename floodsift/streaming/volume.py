"""Tumbling volume of a packet stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from floodsift.functions.binary import micros
from floodsift.operators.volume import SECOND


def stream_volume(
    packets: DataFrame,
    anchor_us: int,
    window_us: int = SECOND,
    volume_threshold: int = 100_000,
    lateness: str = "0 seconds",
) -> DataFrame:
    """Volume and flag of each closed window that holds packets; use append mode.

    ``anchor_us`` is the time of the first packet; windows count from there.
    """
    windows = F.window(
        "ts", f"{window_us} microseconds", startTime=f"{anchor_us % window_us} microseconds"
    )
    start = micros(F.col("window.start"))
    return (
        packets.withWatermark("ts", lateness)
        .groupBy("link_id", windows)
        .agg(F.sum("total_length").alias("volume"))
        .select(
            "link_id",
            ((start - anchor_us) / window_us).cast("bigint").alias("w"),
            "volume",
            (F.col("volume") > volume_threshold).alias("over"),
        )
    )
