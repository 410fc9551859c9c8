"""Packet, frame, log and flow tables derived from the given tables.

``PACKETS`` and ``FRAMES`` are plain SQL that any engine can run. They include
runts, tagged frames, options, and packets that are not IPv4, so that every
branch of the decoders is met.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from floodsift.functions.hashing import SketchShape
from floodsift.operators.controller import FilterSettings
from floodsift.operators.framing import encode_beats, to_words
from floodsift.sources import traffic

PACKETS = """
SELECT concat('link-', CAST(user_id % 2 AS STRING)) AS link_id, event_id AS packet_id, ts,
  3232235520 + user_id AS source_ip,
  167772161 + event_id % 4 AS destination_ip,
  CASE WHEN event_id % 31 = 9 THEN 1
       WHEN event_type IN ('error', 'view') THEN 17 ELSE 6 END AS protocol,
  CASE WHEN event_id % 31 = 9 THEN 0
       WHEN event_type = 'click' THEN 80 WHEN event_type = 'view' THEN 443
       WHEN event_type = 'purchase' THEN 8443 WHEN event_type = 'signup' THEN 25
       ELSE 53 END AS destination_port,
  40 + CAST(floor(value) AS BIGINT) AS total_length
FROM {events}
"""

FRAMES = """
SELECT link_id, packet_id, ts,
  CASE WHEN packet_id % 37 = 4 THEN substr(h, 1, 24)
       WHEN packet_id % 41 = 6 THEN substr(h, 1, 60)
       WHEN packet_id % 43 = 8 THEN substr(h, 1, 78)
       ELSE h END AS frame_hex
FROM (SELECT link_id, packet_id, ts, concat(
    lpad(hex(2199023255552 + destination_ip % 256), 12, '0'),
    lpad(hex(2199023259648 + source_ip % 4096), 12, '0'),
    CASE WHEN packet_id % 10 = 3 THEN concat('8100', lpad(hex(packet_id % 4096), 4, '0')) ELSE '' END,
    CASE WHEN packet_id % 23 = 5 THEN '0806' WHEN packet_id % 29 = 11 THEN '86DD' ELSE '0800' END,
    CASE WHEN packet_id % 7 = 2 THEN '4600' ELSE '4500' END,
    lpad(hex(total_length), 4, '0'), lpad(hex(packet_id % 65536), 4, '0'), '4000', '40',
    lpad(hex(CAST(protocol AS BIGINT)), 2, '0'), '0000',
    lpad(hex(source_ip), 8, '0'), lpad(hex(destination_ip), 8, '0'),
    CASE WHEN packet_id % 7 = 2 THEN '01010100' ELSE '' END,
    CASE WHEN protocol = 17 THEN concat(lpad(hex(40000 + packet_id % 1000), 4, '0'),
             lpad(hex(CAST(destination_port AS BIGINT)), 4, '0'),
             lpad(hex(8 + packet_id % 90), 4, '0'), '0000')
         WHEN protocol = 6 THEN concat(lpad(hex(40000 + packet_id % 1000), 4, '0'),
             lpad(hex(CAST(destination_port AS BIGINT)), 4, '0'),
             lpad(hex(packet_id), 8, '0'), '00000000', '5002', '2000', '0000', '0000')
         ELSE '08000000' END,
    repeat('78', CAST(packet_id % 90 AS INT))) AS h FROM {packets})
"""

HASH_OPS = """
SELECT user_id % 2 AS sketch_id, event_id AS seq,
  CASE WHEN event_id % 300 = 299 THEN 'clear'
       WHEN event_id % 3 = 0 THEN 'query' ELSE 'insert' END AS kind,
  (user_id * 2654435761) % 4294967296 AS payload
FROM {events}
"""

ROLLING_OPS = """
SELECT user_id % 2 AS sketch_id, event_id AS seq,
  CASE WHEN event_id % 286 = 285 THEN 'change_roles'
       WHEN event_id % 50 = 49 THEN 'set_mode' ELSE 'input' END AS kind,
  CASE WHEN event_id % 286 = 285 THEN NULL
       WHEN event_id % 50 = 49 THEN CAST(floor(event_id / 50.0) AS BIGINT) % 2
       ELSE (user_id * 2654435761) % 4294967296 END AS payload
FROM {events}
"""

TICKS = """
SELECT event_id AS tick,
  CASE WHEN event_id % 10 < 3 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS sample
FROM {events}
"""

DECISIONS = """
SELECT concat('link-', CAST(user_id % 2 AS STRING)) AS link_id, event_id AS decision_seq,
  CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 5 END AS INT) AS x
FROM {events}
"""

# One flow per supplier, and per link a flood as strong as all its flows together.
FLOWS = """
SELECT concat('link-', CAST(s_nationkey % 4 AS STRING)) AS link_id,
  CAST(s_suppkey AS INT) AS flow_id,
  CASE WHEN s_suppkey % 2 = 0 THEN 6 ELSE 17 END AS protocol,
  2485377957888 + s_suppkey AS source_mac, 2485377892352 AS destination_mac,
  3232235776 + s_suppkey AS source_ip, CAST(167772161 + s_nationkey % 4 AS BIGINT) AS destination_ip,
  CAST(40000 + s_suppkey % 10000 AS INT) AS source_port,
  CAST(5000 + s_suppkey % 500 AS INT) AS destination_port,
  CAST(64 + (s_suppkey * 37) % 900 AS INT) AS size,
  CAST(20000 + (s_suppkey % 11) * 16000 AS BIGINT) AS rate
FROM {supplier}
"""

HOUR_US = 3_600_000_000
SHAPE = SketchShape(depth=8, width=1 << 14)
# Rows with their own (a, b) instead of the usual ones.
PARAMETRISED = SketchShape(depth=4, width=300, hash_params=((3, 7), (4099, 11), (65520, 1), (29, 65519)))
# The window and threshold make modes flip at every scale of the given tables.
SETTINGS = FilterSettings(window_us=6 * HOUR_US, volume_threshold=None, shape=SHAPE)
BIN_US = 6 * HOUR_US
TICK_WINDOW, TICK_THRESHOLD = 400, 1_380_000
HITTERS_ABOVE, HITTERS_TOP = 1, 5
FLOOD_SECONDS = (1, 2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as_instant(ts: str) -> F.Column:
    """A zone-free timestamp taken as UTC, whatever the session's time zone."""
    return F.expr(
        f"""timestamp_micros(unix_date(CAST({ts} AS DATE)) * 86400000000L + hour({ts}) * 3600000000L
        + minute({ts}) * 60000000L + CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT))"""
    )


def from_events(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, events=table(spark, sf_dir, "events"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark, sf_dir, PACKETS).withColumn("ts", _as_instant("ts"))


# Fixed instants (microseconds) that cut the month of the given events into the batches of a stream.
STREAM_CUTS = tuple(
    int(datetime(2024, 1, day, tzinfo=timezone.utc).timestamp()) * 1_000_000 for day in (8, 16, 23)
)
STREAM_BATCHES = len(STREAM_CUTS) + 1
FILE_ROWS = 250_000
DELAYED = "packet_id % 97 = 5"  # packets that come one batch late
MEAN_LENGTH, MONTH_WINDOWS = 90, 240


def stream_part(instant: str, delayed: bool = False) -> str:
    """SQL for the batch of a packet at ``instant`` (microseconds); of the ``delayed`` ones, the next."""
    part = " + ".join(f"CASE WHEN {instant} >= {cut} THEN 1 ELSE 0 END" for cut in STREAM_CUTS)
    late = f" + CASE WHEN {DELAYED} THEN 1 ELSE 0 END" if delayed else ""
    return f"least({part}{late}, {STREAM_BATCHES - 1})"


def stream_threshold(spark: SparkSession, sf_dir: str) -> int:
    """About the mean volume of a window, from the number of rows that the files state."""
    return table(spark, sf_dir, "events").count() * MEAN_LENGTH // MONTH_WINDOWS


def mean_volume(spark: SparkSession, sf_dir: str) -> int:
    """The mean volume of a window of both links over the month."""
    return (packets(spark, sf_dir).agg(F.sum("total_length")).first()[0] or 0) // MONTH_WINDOWS


MONTH_US = 30 * 24 * HOUR_US
SHORT_THRESHOLD = 200  # bytes of a short window, about two packets


def short_window(spark: SparkSession, sf_dir: str) -> int:
    """A window of about two packets of a link, so that some have none, whatever the scale."""
    return MONTH_US // max(table(spark, sf_dir, "events").count() // 4, 1)


def in_batches(rows: DataFrame, count: int, folder: str) -> DataFrame:
    """``rows`` again as a stream of files; every batch has the files of one value of ``part``.

    The files of a batch grow in number with the ``count`` of rows, not in size.
    """
    files = -(-count // (STREAM_BATCHES * FILE_ROWS))
    rows = rows.withColumn("file", F.pmod("packet_id", F.lit(files)))
    for number in range(STREAM_BATCHES):
        part = rows.where(F.col("part") == number).drop("part")
        part.repartition(files, "file").write.partitionBy("file").parquet(f"{folder}/{number}")
    stream = rows.sparkSession.readStream.schema(rows.drop("part", "file").schema)
    stream = stream.option("maxFilesPerTrigger", files).option("recursiveFileLookup", True)
    return stream.parquet(folder)


def packet_batches(spark: SparkSession, sf_dir: str, folder: str, delayed: bool = False) -> DataFrame:
    """The packets as a stream, in the order of time but for the ``delayed`` ones."""
    rows = packets(spark, sf_dir)
    return in_batches(rows.withColumn("part", F.expr(stream_part("unix_micros(ts)", delayed))), rows.count(), folder)


def frame_batches(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The frames as a stream, in the order of time."""
    rows = frames(spark, sf_dir)
    return in_batches(rows.withColumn("part", F.expr(stream_part("unix_micros(ts)"))), rows.count(), folder)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.sql(FRAMES, packets=packets(spark, sf_dir))
    return made.select("link_id", "packet_id", "ts", F.unhex("frame_hex").alias("frame"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_words(frames(spark, sf_dir))


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_beats(words(spark, sf_dir))


def parser_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as a parser hands them on: consumed prefix, end of range, error."""
    last_word = F.col("packet_id") % 5 == 0
    cut = words(spark, sf_dir).withColumn(
        "extract_range_end",
        (F.col("word_no") == 0) & ~(last_word & ~F.col("end_of_packet"))
        | (F.col("word_no") == 1) & last_word,
    )
    return cut.withColumns(
        {
            "octets_consumed": F.when(F.col("extract_range_end"), 7 + F.col("packet_id") % 3)
            .when(F.col("word_no") == 0, 64)
            .otherwise(0)
            .cast("int"),
            "error_drop": F.col("packet_id") % 3 == 1,
        }
    ).drop("packet_id", "word_no")


def flows(
    spark: SparkSession, sf_dir: str, attack_seconds: tuple[int, ...] = FLOOD_SECONDS
) -> DataFrame:
    base = spark.sql(FLOWS, supplier=table(spark, sf_dir, "supplier")).withColumns(
        {"sources": F.lit(1), "fill": F.lit("x"), "seconds": F.lit(None).cast("array<int>")}
    )
    flood = base.groupBy("link_id", "destination_mac", "destination_ip").agg(
        (F.max("flow_id") + 1).alias("flow_id"), F.sum("rate").alias("rate")
    )
    flood = flood.withColumns(
        {
            "protocol": F.lit(17),
            "source_mac": F.lit(traffic.mac_number(traffic.FLOOD_SOURCE_MAC)).cast("bigint"),
            "source_ip": F.lit(traffic.ip_number(traffic.FLOOD_SOURCE_IP)).cast("bigint"),
            "source_port": F.lit(traffic.FLOOD[2]),
            "destination_port": F.lit(traffic.FLOOD[1]),
            "size": F.lit(traffic.FLOOD[3]),
            "sources": F.lit(traffic.FLOOD_SOURCES),
            "fill": F.lit("X"),
            "seconds": F.array(*[F.lit(second) for second in attack_seconds]),
        }
    )
    return base.unionByName(flood)
