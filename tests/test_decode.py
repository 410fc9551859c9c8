"""Decoding against a small model of the header layouts."""

import random
import struct
from datetime import datetime

from pyspark.sql import functions as F

from floodsift.functions import headers
from floodsift.operators.decode import decode, features, malformed_report, payload_offsets
from floodsift.schemas import FRAMES

NOW = datetime(2024, 1, 1)


def ethernet(ethertype=0x0800, vlan=None):
    tag = b"" if vlan is None else struct.pack(">HH", 0x8100, vlan)
    return bytes.fromhex("0242c0a80164") + bytes.fromhex("0242c0a80165") + tag + struct.pack(">H", ethertype)


def ipv4(protocol, total_length=100, ihl=5, src=0xC0A80165, dst=0xC0A80164):
    fixed = struct.pack(
        ">BBHHHBBHII", 0x40 | ihl, 0x1C, total_length, 0xBEEF, 0x6007, 64, protocol, 0xABCD, src, dst
    )
    return fixed + bytes(range(1, 41))[: ihl * 4 - 20]


def tcp(dport=443, offset=5):
    fixed = struct.pack(">HHIIBBHHH", 40001, dport, 0xFFFFFFFF, 7, offset << 4 | 5, 0xA5, 8192, 0x1234, 9)
    return fixed + b"\x01" * (offset * 4 - 20)


def udp(dport=53, length=20):
    return struct.pack(">HHHH", 53000, dport, length, 0xFACE)


def table(spark, frames):
    rows = [("link-0", n, NOW, frame) for n, frame in enumerate(frames)]
    return spark.createDataFrame(rows, FRAMES)


def one(spark, frame):
    return decode(table(spark, [frame])).first()


def test_plain_and_tagged_ethernet(spark):
    plain = one(spark, ethernet(0x86DD) + b"x" * 50)
    assert (plain.eth_dst_mac, plain.eth_src_mac) == (0x0242C0A80164, 0x0242C0A80165)
    assert (plain.eth_vlan_v, plain.eth_vlan, plain.eth_ethertype) == (False, 0, 0x86DD)
    assert (plain.eth_header_len, plain.eth_error, plain.packet_class) == (14, False, "unknown")
    tagged = one(spark, ethernet(0x0800, vlan=0xE123) + ipv4(17) + udp())
    assert (tagged.eth_vlan_v, tagged.eth_vlan, tagged.eth_ethertype) == (True, 0xE123, 0x0800)
    assert (tagged.eth_header_len, tagged.l4_offset, tagged.udp_destination_port) == (18, 38, 53)


def test_ethernet_runts_read_zeros_past_the_end(spark):
    short = one(spark, ethernet()[:12])
    assert (short.eth_error, short.eth_ethertype, short.packet_class) == (True, 0, "malformed")
    half = one(spark, ethernet()[:13])
    assert half.eth_ethertype == 0x0800 and half.eth_error
    tagged = one(spark, ethernet(0x0800, vlan=5)[:16])
    assert (tagged.eth_vlan_v, tagged.eth_vlan, tagged.eth_error) == (True, 5, True)
    empty = one(spark, b"")
    assert empty.eth_error and empty.eth_dst_mac == 0 and empty.ip_error is None


def test_ipv4_fields_and_options(spark):
    for ihl in (5, 6, 15):
        row = one(spark, ethernet() + ipv4(6, 1500, ihl) + tcp() + b"payload")
        assert (row.ip_version, row.ip_header_length, row.ip_header_len) == (4, ihl, ihl * 4)
        assert (row.ip_type_of_service, row.ip_total_length, row.ip_identification) == (0x1C, 1500, 0xBEEF)
        assert (row.ip_flags, row.ip_fragment_offset, row.ip_time_to_live) == (3, 7, 64)
        assert (row.ip_protocol, row.ip_header_checksum) == (6, 0xABCD)
        assert (row.ip_source_ip, row.ip_destination_ip) == (0xC0A80165, 0xC0A80164)
        assert (row.l4_offset, row.tcp_destination_port, row.packet_class) == (14 + ihl * 4, 443, "judged")


def test_ipv4_runts(spark):
    below_minimum = one(spark, ethernet() + ipv4(6)[:19])
    below_options = one(spark, ethernet() + ipv4(6, ihl=6)[:23])
    assert below_minimum.ip_error and below_options.ip_error
    assert below_minimum.tcp_error is None and below_minimum.packet_class == "malformed"
    assert not one(spark, ethernet() + ipv4(1)).ip_error


def test_tcp_fields_and_runts(spark):
    for offset in (5, 6, 15):
        row = one(spark, ethernet() + ipv4(6) + tcp(8443, offset))
        assert (row.tcp_source_port, row.tcp_destination_port) == (40001, 8443)
        assert (row.tcp_sequence_number, row.tcp_acknowledgment_number) == (0xFFFFFFFF, 7)
        assert (row.tcp_data_offset, row.tcp_reserved, row.tcp_flags) == (offset, 5, 0xA5)
        assert (row.tcp_window_size, row.tcp_checksum, row.tcp_urgent_pointer) == (8192, 0x1234, 9)
        assert (row.tcp_header_len, row.tcp_error, row.udp_error) == (offset * 4, False, None)
    assert one(spark, ethernet() + ipv4(6) + tcp()[:12]).tcp_error
    assert one(spark, ethernet() + ipv4(6) + tcp(offset=6)[:23]).packet_class == "malformed"


def test_udp_fields_and_runts(spark):
    row = one(spark, ethernet() + ipv4(17) + udp(6001, 8))
    assert (row.udp_source_port, row.udp_destination_port) == (53000, 6001)
    assert (row.udp_length, row.udp_checksum, row.udp_header_len, row.udp_error) == (8, 0xFACE, 8, False)
    assert one(spark, ethernet() + ipv4(17) + udp()[:6]).udp_error


def test_features_dispatch_on_protocol_and_skip_bad_packets(spark):
    frames = [
        ethernet() + ipv4(6, 60) + tcp(443),
        ethernet() + ipv4(17, 70) + udp(53),
        ethernet() + ipv4(1, 80) + b"\x08\x00\x12\x34\x56\x78",
        ethernet() + ipv4(132, 90) + b"\xff" * 20,
        ethernet(0x0806) + b"\x00" * 28,
        ethernet() + ipv4(6, 60) + tcp()[:19],
    ]
    rows = features(table(spark, frames)).orderBy("packet_id").collect()
    assert [(r.packet_id, r.destination_port, r.total_length) for r in rows] == [
        (0, 443, 60), (1, 53, 70), (2, 0, 80), (3, 0, 90)
    ]
    report = {r.layer: (r.frames, r.malformed) for r in malformed_report(table(spark, frames)).collect()}
    assert report == {"ethernet": (6, 0), "ipv4": (5, 0), "tcp": (2, 1), "udp": (1, 0)}


def test_random_truncation_agrees_with_the_model(spark):
    rng = random.Random(7)
    frames, expected = [], []
    for _ in range(300):
        vlan = rng.choice([None, rng.randrange(1 << 16)])
        ihl, protocol, offset = rng.choice([5, 6, 15]), rng.choice([1, 6, 17]), rng.choice([5, 6, 15])
        l2, l3 = ethernet(0x0800, vlan), ipv4(protocol, ihl=ihl)
        l4 = {1: b"", 6: tcp(offset=offset), 17: udp()}[protocol]
        frame = (l2 + l3 + l4)[: rng.randrange(len(l2 + l3 + l4) + 1)]
        frames.append(frame)
        good = len(frame) >= len(l2 + l3 + l4)
        expected.append(good)
    rows = decode(table(spark, frames)).select("packet_id", "packet_class").orderBy("packet_id").collect()
    got = [r.packet_class == "judged" for r in rows]
    assert got == expected


def test_payload_offsets(spark):
    frames = [ethernet(vlan=3) + ipv4(6, ihl=6) + tcp(offset=6) + b"abc", ethernet(0x0806) + b"\0" * 28]
    rows = payload_offsets(table(spark, frames)).orderBy("packet_id").collect()
    assert [tuple(r)[2:] for r in rows] == [(18, 42, 66, 3), (14, None, 14, 28)]


def test_layers_as_structs(spark):
    df = table(spark, [ethernet(vlan=7) + ipv4(6, ihl=6) + tcp(8080), ethernet() + ipv4(17) + udp(99)])
    rows = (
        df.withColumn("eth", headers.decode_ethernet(F.col("frame")))
        .withColumn("ip", headers.decode_ipv4(F.col("frame"), F.col("eth.header_len")))
        .withColumn("l4", F.col("eth.header_len") + F.col("ip.header_len"))
        .withColumn("tcp", headers.decode_tcp(F.col("frame"), F.col("l4")))
        .withColumn("udp", headers.decode_udp(F.col("frame"), F.col("l4")))
        .orderBy("packet_id")
        .collect()
    )
    assert (rows[0].eth.vlan, rows[0].ip.header_length, rows[0].tcp.destination_port) == (7, 6, 8080)
    assert (rows[1].eth.vlan_v, rows[1].ip.protocol, rows[1].udp.destination_port) == (False, 17, 99)
