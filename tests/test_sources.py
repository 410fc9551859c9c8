import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from floodsift.plans import inputs
from floodsift.sources import pcap
from floodsift.sources.frames import read_frames, write_frames


def capture_bytes(records, order="<", nanos=False):
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    out = [struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)]
    for us, frame in records:
        part = us % 1_000_000 * (1000 if nanos else 1)
        out.append(struct.pack(order + "IIII", us // 1_000_000, part, len(frame), len(frame)) + frame)
    return b"".join(out)


def as_read(df, link):
    rows = df.where(F.regexp_extract("link_id", r"([^/]+?)(\.[^./]*)?$", 1) == link).orderBy("packet_id")
    return [(r.us, bytes(r.frame)) for r in rows.withColumn("us", F.unix_micros("ts")).collect()]


def test_byte_orders_and_fractions(spark, tmp_path):
    records = [(1_700_000_000_123_456 + n * 7, bytes([n]) * n) for n in range(40)]
    for order, nanos, name in (("<", False, "a"), (">", False, "b"), ("<", True, "c"), (">", True, "d.x")):
        (tmp_path / f"{name}.pcap").write_bytes(capture_bytes(records, order, nanos))
    frames = pcap.read_captures(spark, str(tmp_path))
    for link in ("a", "b", "c", "d.x"):
        assert as_read(frames, link) == records


def test_ranges_are_exact_even_with_captures_and_zeros_as_payload(spark, tmp_path):
    rng = random.Random(8)
    inner = capture_bytes([(5_000_000 + n, rng.randbytes(rng.randrange(80))) for n in range(400)])
    records = []
    for n in range(120):
        kind = n % 4
        size = rng.randrange(20_000, 60_000)
        payload = [inner[:size], bytes(size), rng.randbytes(size), inner[24:] + bytes(size % 50)][kind]
        records.append((1_700_000_000_000_000 + n, payload[:65_000]))
    whole = capture_bytes(records)
    (tmp_path / "long.pcap").write_bytes(whole)
    (tmp_path / "short.pcap").write_bytes(capture_bytes(records[:1]))
    # A capture that ends in the middle of a record keeps the records before it.
    (tmp_path / "torn.pcap").write_bytes(whole[:-100])
    assert len(whole) > 8 * (300 << 10)
    frames = pcap.read_captures(spark, str(tmp_path), split_bytes=300 << 10)
    assert as_read(frames, "long") == records
    assert as_read(frames, "short") == records[:1]
    assert as_read(frames, "torn") == records[:-1]
    with pytest.raises(ValueError):
        pcap.read_captures(spark, str(tmp_path), split_bytes=1000)


def test_frames_read_are_neither_joined_nor_broadcast(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.pcap").write_bytes(capture_bytes([(n, b"x" * 60) for n in range(5)]))
    frames = pcap.read_captures(spark, str(tmp_path), link=F.lit("eth0"))
    plan = frames._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")]
    assert sorted((r.packet_id >> pcap.OFFSET_BITS, r.link_id) for r in frames.collect()) == [(0, "eth0")] * 5 + [(1, "eth0")] * 5


RECORDS = [(1_700_000_000_000_000 + n, bytes([n]) * (20 + n)) for n in range(5)]


def damaged(records, third):
    whole = capture_bytes(records)
    at = 24 + sum(16 + len(f) for _, f in records[:2])
    return whole[:at] + third + whole[at + 16 + len(records[2][1]) :], at


@pytest.mark.parametrize("third", [
    struct.pack("<IIII", 1, 2_000_000, 5, 5) + b"abcde",
    struct.pack("<IIII", 1, 0, 300_000, 300_000) + bytes(300_000),
    struct.pack("<IIII", 1, 0, 9, 5) + b"abcdefghi",
])
def test_damaged_records_raise_and_are_reported(spark, tmp_path, third):
    content, at = damaged(RECORDS, third)
    (tmp_path / "a.pcap").write_bytes(content)
    with pytest.raises(Exception, match=f"a.pcap: no possible record at byte {at}"):
        pcap.read_captures(spark, str(tmp_path)).count()
    assert as_read(pcap.read_captures(spark, str(tmp_path), raising=False), "a") == RECORDS[:2]
    assert [(r["at"], r["error"]) for r in pcap.capture_errors(spark, str(tmp_path)).collect()] == [
        (at, "no possible record")
    ]


def test_links_of_equal_names_and_rotated_files(spark, tmp_path):
    for folder in ("d1", "d2"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "eth0.pcap").write_bytes(capture_bytes(RECORDS))
    frames = pcap.read_captures(spark, str(tmp_path))
    assert frames.select("link_id", "packet_id").distinct().count() == 10
    assert frames.select("link_id").distinct().count() == 2
    (tmp_path / "d2" / "eth0.pcap").write_bytes(capture_bytes([(us + 100, f) for us, f in RECORDS]))
    one = pcap.read_captures(spark, str(tmp_path), link=F.lit("eth0")).orderBy("packet_id").collect()
    assert [r.ts for r in one] == sorted(r.ts for r in one) and len({r.packet_id for r in one}) == 10


def test_link_types_are_refused_by_name(spark, tmp_path):
    (tmp_path / "raw.pcap").write_bytes(capture_bytes(RECORDS)[:20] + struct.pack("<I", 101) + capture_bytes(RECORDS)[24:])
    with pytest.raises(Exception, match="link type 101"):
        pcap.read_captures(spark, str(tmp_path)).count()


def test_gzip_and_the_block_format(spark, tmp_path):
    (tmp_path / "g.gz").write_bytes(gzip.compress(capture_bytes(RECORDS, ">", True)))
    blocks = pcap._section() + b"".join(pcap._packet_block(us, f) for us, f in RECORDS)
    (tmp_path / "b.pcapng").write_bytes(blocks)
    (tmp_path / "t.pcapng").write_bytes(blocks[:-3])
    frames = pcap.read_captures(spark, str(tmp_path))
    assert as_read(frames, "g") == as_read(frames, "b") == RECORDS and as_read(frames, "t") == RECORDS[:-1]
    (tmp_path / "x.pcapng").write_bytes(blocks[:52] + b"\x01" + blocks[53:])
    assert pcap.capture_errors(spark, str(tmp_path)).select("error").distinct().count() == 1


def test_written_frames_come_back_in_time_order(spark, sf_dir, tmp_path):
    frames = inputs.frames(spark, sf_dir)
    path = str(tmp_path / "frames")
    write_frames(frames, path)
    back = read_frames(spark, path)
    assert back.schema == frames.schema or back.columns == frames.columns
    assert back.exceptAll(frames).isEmpty() and back.count() == frames.count()
    for part in sorted((tmp_path / "frames").glob("*.parquet")):
        keys = [(r.link_id, r.ts) for r in spark.read.parquet(str(part)).collect()]
        assert keys == sorted(keys)
