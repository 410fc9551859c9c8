"""Frames to decoded layers, packet classes and feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from floodsift.functions import headers
from floodsift.functions.binary import padded_head

FEATURES = ("source_ip", "destination_ip", "destination_port", "total_length")


def _prefixed(prefix: str, fields: headers.Fields, gate: Column | None = None) -> headers.Fields:
    if gate is None:
        return {f"{prefix}_{name}": column for name, column in fields.items()}
    return {f"{prefix}_{name}": F.when(gate, column) for name, column in fields.items()}


def decode(frames: DataFrame) -> DataFrame:
    """Add ``eth_*``, ``ip_*``, ``tcp_*`` and ``udp_*`` columns.

    A layer is decoded only when the one below is good and names it; otherwise
    its columns are NULL. Ethernet is always decoded. ``packet_class`` is
    ``malformed``, ``unknown`` (not IPv4) or ``judged``.

    The error flags and the class leave through ``inline``: a filter on them then
    stays above the decoding instead of being pushed below it, which would write
    out every offset again and again in one expression.
    """
    h, size = F.col("_head"), F.col("_size")
    d = frames.withColumns({"_head": padded_head(F.col("frame")), "_size": F.length("frame")})
    d = d.withColumns(_prefixed("eth", headers.ethernet(h, size)))
    l3 = F.col("eth_header_len")
    is_ip = ~F.col("eth_error") & headers.carries(h, l3 - 2, headers.ETHERTYPES["IPV4"], 2)
    d = d.withColumn("_is_ip", is_ip)
    d = d.withColumns(_prefixed("ip", headers.ipv4(h, size, l3), F.col("_is_ip")))
    good = F.col("_is_ip") & ~F.col("ip_error")
    gates = {
        f"_is_{name}": good & headers.carries(h, l3 + 9, headers.PROTOCOLS[name.upper()], 1)
        for name in ("tcp", "udp")
    }
    d = d.withColumns({"l4_offset": l3 + F.col("ip_header_len"), **gates})
    for name, fields in (("tcp", headers.tcp), ("udp", headers.udp)):
        layer = fields(h, size, F.col("l4_offset"))
        d = d.withColumns(_prefixed(name, layer, F.col(f"_is_{name}")))
    flags = [f"{layer}_error" for layer in ("eth", "ip", "tcp", "udp")]
    checked = F.struct(*flags, _class().alias("packet_class"))
    fields = [c for c in d.columns if not c.startswith("_") and c not in flags]
    return d.select(*fields, F.inline(F.array(checked)))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _class() -> Column:
    short = F.col("eth_error") | _flag("ip_error") | _flag("tcp_error") | _flag("udp_error")
    return (
        F.when(short, "malformed").when(F.col("ip_error").isNull(), "unknown").otherwise("judged")
    )


def destination_port() -> Column:
    """The port of the transport that is present, 0 where there is none."""
    return F.coalesce(F.col("tcp_destination_port"), F.col("udp_destination_port"), F.lit(0))


def feature_columns() -> dict[str, Column]:
    return {
        "source_ip": F.col("ip_source_ip"),
        "destination_ip": F.col("ip_destination_ip"),
        "destination_port": destination_port(),
        "total_length": F.col("ip_total_length").cast("bigint"),
    }


def with_features(frames: DataFrame) -> DataFrame:
    """Frames with ``packet_class`` and the four features (NULL unless judged)."""
    judged = F.col("packet_class") == "judged"
    features = {name: F.when(judged, c) for name, c in feature_columns().items()}
    return decode(frames).select(
        *frames.columns, "packet_class", *[c.alias(n) for n, c in features.items()]
    )


def features(frames: DataFrame) -> DataFrame:
    """``packets``: one feature vector per well-formed IPv4 packet."""
    d = decode(frames).where("packet_class = 'judged'")
    return d.select(
        "link_id", "packet_id", "ts", *[c.alias(n) for n, c in feature_columns().items()]
    )


def malformed_report(frames: DataFrame) -> DataFrame:
    """Frames seen and dropped per link and layer."""
    d = decode(frames)
    errors = {"ethernet": "eth_error", "ipv4": "ip_error", "tcp": "tcp_error", "udp": "udp_error"}
    seen = F.array(
        *[
            F.struct(
                F.lit(layer).alias("layer"),
                F.col(column).isNotNull().cast("bigint").alias("frames"),
                _flag(column).cast("bigint").alias("malformed"),
            )
            for layer, column in errors.items()
        ]
    )
    return (
        d.select("link_id", F.inline(seen))
        .groupBy("link_id", "layer")
        .agg(F.sum("frames").alias("frames"), F.sum("malformed").alias("malformed"))
    )


def class_counts(frames: DataFrame) -> DataFrame:
    """Well-formed frames per link, EtherType class and IP protocol class."""
    d = decode(frames).where(~F.col("eth_error"))
    good = F.coalesce(~F.col("ip_error"), F.lit(False))
    kinds = {
        "ethertype_class": headers.ethertype_class(F.col("eth_ethertype")),
        "ethertype_code": headers.ethertype_code(F.col("eth_ethertype")),
        "protocol_class": F.when(good, headers.protocol_class(F.col("ip_protocol"))),
        "protocol_code": F.when(good, headers.protocol_code(F.col("ip_protocol"))),
    }
    return (
        d.withColumns(kinds).groupBy("link_id", *kinds).agg(F.count(F.lit(1)).alias("frames"))
    )


def payload_offsets(frames: DataFrame) -> DataFrame:
    """Where each layer starts and how many payload bytes follow the last good header."""
    d = decode(frames).withColumn("size", F.length("frame")).where("packet_class != 'malformed'")
    l3 = F.col("eth_header_len")
    l4 = F.when(F.col("ip_error").isNotNull(), F.col("l4_offset"))
    l4_header = F.coalesce("tcp_header_len", "udp_header_len", F.lit(0))
    payload = F.coalesce(l4 + l4_header, l3)
    return d.select(
        "link_id",
        "packet_id",
        l3.alias("l3_offset"),
        l4.alias("l4_offset"),
        payload.alias("payload_offset"),
        (F.col("size") - payload).alias("payload_bytes"),
    )
