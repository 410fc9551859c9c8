"""Frame tables in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from floodsift.schemas import FRAMES

TIME_ORDER = ("link_id", "ts", "packet_id")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(path)


def stream_frames(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same table as a stream of newly arriving files."""
    return (
        spark.readStream.schema(FRAMES)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def in_time_order(df: DataFrame) -> DataFrame:
    """Range-partitioned and sorted by link and time; the packet number breaks ties."""
    return df.repartitionByRange(*TIME_ORDER).sortWithinPartitions(*TIME_ORDER)


def write_frames(frames: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write frames in time order."""
    in_time_order(frames).write.mode(mode).parquet(path)
