"""Table schemas. Unsigned 32-bit fields are BIGINT because INT is signed."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


FRAMES = _schema(
    link_id=T.StringType(), packet_id=T.LongType(), ts=T.TimestampType(), frame=T.BinaryType()
)

WORDS = _schema(
    link_id=T.StringType(),
    seq=T.LongType(),
    data=T.BinaryType(),
    end_of_packet=T.BooleanType(),
    end_of_packet_len=T.IntegerType(),
)

BEATS = _schema(link_id=T.StringType(), seq=T.LongType(), beat=T.BinaryType())

PACKETS = _schema(
    link_id=T.StringType(),
    packet_id=T.LongType(),
    ts=T.TimestampType(),
    source_ip=T.LongType(),
    destination_ip=T.LongType(),
    destination_port=T.IntegerType(),
    total_length=T.LongType(),
)

OPS = _schema(
    sketch_id=T.LongType(), seq=T.LongType(), kind=T.StringType(), payload=T.LongType()
)

TICKS = _schema(tick=T.LongType(), sample=T.LongType())

DECISIONS = _schema(link_id=T.StringType(), decision_seq=T.LongType(), x=T.IntegerType())

FLOWS = _schema(
    link_id=T.StringType(),
    flow_id=T.IntegerType(),
    protocol=T.IntegerType(),
    source_mac=T.LongType(),
    destination_mac=T.LongType(),
    source_ip=T.LongType(),
    destination_ip=T.LongType(),
    source_port=T.IntegerType(),
    destination_port=T.IntegerType(),
    size=T.IntegerType(),
    rate=T.LongType(),
    sources=T.IntegerType(),
    fill=T.StringType(),
    seconds=T.ArrayType(T.IntegerType()),
)
