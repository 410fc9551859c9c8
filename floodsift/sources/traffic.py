"""Synthetic traffic from a table of flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from floodsift.functions.binary import hex_of
from floodsift.functions.headers import PROTOCOLS
from floodsift.operators.ordering import positions, scan
from floodsift.schemas import FLOWS

CHUNK_BITS = 12
TASK_PACKETS = 1 << 18

# The example scenario. One server, five clients and a reflected
# flood from 250 sources; rates in bit/s, sizes in payload bytes.
SERVER_IP = "192.168.1.100"
SERVER_MAC = "02:42:c0:a8:01:64"
CLIENTS = [
    ("192.168.1.101", "02:42:c0:a8:01:65"),
    ("192.168.1.102", "02:42:c0:a8:01:66"),
    ("192.168.1.103", "02:42:c0:a8:01:67"),
    ("192.168.1.104", "02:42:c0:a8:01:68"),
    ("192.168.1.105", "02:42:c0:a8:01:69"),
]
# protocol, destination port, source port, size, rate
CLIENT_FLOWS = [
    ("TCP", 5001, 40001, 120, 80_000),
    ("TCP", 5002, 40002, 120, 20_000),
    ("UDP", 6001, 40003, 512, 120_000),
    ("UDP", 6002, 40004, 512, 10_000),
    ("UDP", 6003, 40005, 256, 200_000),
]
FLOOD_SOURCE_IP = "198.51.100.1"
FLOOD_SOURCE_MAC = "de:ad:be:ef:00:00"
FLOOD_SOURCES = 250
FLOOD = ("UDP", 40006, 53, 1024, 500_000)
SCENARIO_SECONDS = 3


def mac_number(text: str) -> int:
    return int(text.replace(":", ""), 16)


def ip_number(text: str) -> int:
    value = 0
    for part in text.split("."):
        value = value * 256 + int(part)
    return value


def scenario_flows(
    spark: SparkSession, attack_seconds: tuple[int, ...] = (1, 2), link_id: str = "link-0"
) -> DataFrame:
    """The example scenario as a ``flows`` table."""
    ends = [(ip_number(ip), mac_number(mac), flow, 1, "x", None) for (ip, mac), flow in zip(CLIENTS, CLIENT_FLOWS)]
    ends.append(
        (ip_number(FLOOD_SOURCE_IP), mac_number(FLOOD_SOURCE_MAC), FLOOD, FLOOD_SOURCES, "X", list(attack_seconds))
    )
    rows = [
        (
            link_id, number, PROTOCOLS[protocol], source_mac, mac_number(SERVER_MAC), source_ip,
            ip_number(SERVER_IP), sport, dport, size, rate, sources, fill, seconds,
        )
        for number, (source_ip, source_mac, (protocol, dport, sport, size, rate), sources, fill, seconds)
        in enumerate(ends)
    ]
    return spark.createDataFrame(rows, FLOWS)


def numbered(active: DataFrame) -> DataFrame:
    """Add ``first_packet``: the packets of the link in earlier seconds and, in this one, of earlier flows."""
    placed = positions(active, ["link_id"], ["second", "flow_id"], "_place")
    return scan(placed, ["link_id"], "_place", sums={"first_packet": F.col("pps")}).drop("_place")


def generate_traffic(
    flows: DataFrame, duration: int = SCENARIO_SECONDS, rate_scale: int = 1, start_us: int = 0
) -> DataFrame:
    """Packets of all flows over ``duration`` seconds, evenly spaced within a second.

    A flow sends ``rate / rate_scale / 8 / size`` packets a second (whole
    divisions), in the seconds it names or in all. A flow with several sources
    uses them in rotation. Packets of a link are numbered without gaps, by second, flow and
    position. Large flows are cut into chunks before their packets
    are made, so one flow may hold most of the traffic.
    """
    second = F.explode(F.sequence(F.lit(0), F.lit(duration - 1)))
    pps = F.expr(f"((rate div {rate_scale}) div 8) div size")
    active = numbered(
        flows.withColumns({"second": second, "pps": pps}).where(
            "pps > 0 AND (seconds IS NULL OR array_contains(seconds, second))"
        )
    )

    # Chunks are tiny and their packets are not: spread them by the packets they make.
    total = active.agg(F.sum("pps")).first()[0] or 0
    tasks = max(flows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_PACKETS))
    size = 1 << CHUNK_BITS
    zero = F.lit(0).cast("bigint")
    chunks = active.withColumn(
        "chunk", F.explode(F.sequence(zero, F.shiftright(F.col("pps") - 1, CHUNK_BITS)))
    ).repartition(tasks, "link_id", "flow_id", "second", "chunk")
    first = F.col("chunk") * size
    length = F.lit(20) + _l4_header() + F.col("size")
    # What all packets of a flow share is made once a chunk: a packet costs four fields and two sums.
    chunks = chunks.withColumn("total_length", length.cast("bigint")).withColumns(_shared_parts())
    packets = chunks.withColumn(
        "n", F.explode(F.sequence(first, F.least(first + size, F.col("pps")) - 1))
    )

    rotated = F.col("sources") > 1
    packets = packets.withColumns(
        {
            "packet_id": F.col("first_packet") + F.col("n"),
            "ts": F.timestamp_micros(
                F.lit(start_us) + F.col("second") * 1_000_000 + F.expr("(n * 1000000) div pps")
            ),
            "source_ip": F.col("source_ip") + F.col("n") % F.col("sources"),
            "source_mac": F.col("source_mac") + F.when(rotated, F.col("n") % 256).otherwise(zero),
        }
    )
    return packets.select(
        "link_id",
        "packet_id",
        "ts",
        "source_ip",
        "destination_ip",
        "destination_port",
        "total_length",
        _frame().alias("frame"),
    )


def _halves(value: Column) -> Column:
    return F.shiftright(value, 16) + value.bitwiseAND(0xFFFF)


def _checksum(total: Column) -> Column:
    """Internet checksum of a sum of 16-bit words; two folds are enough below 2**32."""
    return F.lit(0xFFFF) - _halves(_halves(total.cast("bigint")))


def _is_tcp() -> Column:
    return F.col("protocol") == PROTOCOLS["TCP"]


def _l4_header() -> Column:
    return F.when(_is_tcp(), 20).otherwise(8)


def _shared_parts() -> dict[str, Column]:
    """Bytes and sums that packets have in common whose sources alone differ."""
    c = F.col
    segment = c("total_length") - 20
    fill = F.ascii(c("fill"))
    payload = F.expr("size div 2") * (fill * 257) + (c("size") % 2) * (fill * 256)
    to = _halves(c("destination_ip"))
    l4_sum = to + c("protocol") + segment + c("source_port") + c("destination_port") + payload
    start = F.concat(
        F.lit("0800" "4500"), hex_of(c("total_length"), 2), F.lit("0001" "0000" "40"), hex_of(c("protocol"), 1)
    )
    ends = F.concat(
        hex_of(c("destination_ip"), 4), hex_of(c("source_port"), 2), hex_of(c("destination_port"), 2)
    )
    before_sum = F.when(_is_tcp(), F.lit("00000000" "00000000" "5002" "2000")).otherwise(hex_of(segment, 2))
    after_sum = F.unhex(F.when(_is_tcp(), F.lit("0000")).otherwise(F.lit("")))
    return {
        "_to": F.unhex(hex_of(c("destination_mac"), 6)),
        "_start": F.unhex(start),
        "_ends": F.unhex(F.concat(ends, before_sum)),
        "_end": F.concat(after_sum, F.repeat(c("fill"), c("size")).cast("binary")),
        "_ip_sum": F.lit(0x4500 + 1 + (64 << 8)) + c("total_length") + c("protocol") + to,
        "_l4_sum": l4_sum + F.when(_is_tcp(), F.lit(0x5002 + 0x2000).cast("bigint")).otherwise(segment),
    }


def _frame() -> Column:
    """Ethernet, IPv4 without options, TCP SYN or UDP, and a constant payload."""
    c = F.col
    source = _halves(c("source_ip"))
    l4_sum = _checksum(c("_l4_sum") + source)
    return F.concat(
        c("_to"),
        F.unhex(hex_of(c("source_mac"), 6)),
        c("_start"),
        F.unhex(F.concat(hex_of(_checksum(c("_ip_sum") + source), 2), hex_of(c("source_ip"), 4))),
        c("_ends"),
        F.unhex(hex_of(F.when(~_is_tcp() & (l4_sum == 0), 0xFFFF).otherwise(l4_sum), 2)),
        c("_end"),
    )
