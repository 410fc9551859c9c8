import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from floodsift.operators import framing, ordering
from floodsift.schemas import FRAMES

SIZES = [0, 1, 63, 64, 65, 127, 128, 129, 192, 1500]


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(3)
    rows = [
        (f"link-{n % 2}", n, datetime(2024, 1, 1), rng.randbytes(size)) for n, size in enumerate(SIZES * 2)
    ]
    return spark.createDataFrame(rows, FRAMES)


def by_link(frames):
    links = {}
    for r in frames.orderBy("packet_id").collect():
        links.setdefault(r.link_id, []).append(bytes(r.frame))
    return links


def split(frame, size=64):
    words = [frame[i : i + size].ljust(size, b"\0") for i in range(0, len(frame), size)] or [bytes(size)]
    last = len(frame) - (len(words) - 1) * size
    return [(w, i == len(words) - 1, last if i == len(words) - 1 else 0) for i, w in enumerate(words)]


def collected(words, *order):
    links = {}
    for r in words.orderBy("link_id", *order).collect():
        links.setdefault(r.link_id, []).append((bytes(r.data), r.end_of_packet, r.end_of_packet_len))
    return links


def test_words_of_frames(frames):
    expected = {link: [w for f in fs for w in split(f)] for link, fs in by_link(frames).items()}
    words = framing.to_words(frames)
    assert collected(words, "seq") == expected
    seqs = words.groupBy("link_id").agg(F.min("seq"), F.max("seq"), F.count_distinct("seq")).collect()
    assert all(r[1] == 0 and r[2] + 1 == r[3] for r in seqs)


def test_frames_of_words_hold_back_the_unfinished_tail(frames):
    words = framing.to_words(frames).drop("packet_id", "word_no")
    back = framing.to_frames(words).orderBy("packet_no").collect()
    links = {}
    for r in back:
        links.setdefault(r.link_id, []).append(bytes(r.frame))
    assert links == by_link(frames)
    tail = words.groupBy("link_id").agg(F.max("seq").alias("seq"))
    cut = framing.to_frames(words.join(tail, ["link_id", "seq"], "left_anti"))
    assert cut.count() == len(SIZES) * 2 - 2


def test_beats_round_trip_but_for_empty_packets(frames):
    words = framing.to_words(frames.where(F.length("frame") > 0))
    beats = framing.encode_beats(words)
    assert collected(framing.decode_beats(beats), "seq") == collected(words, "seq")
    flags = [
        (r.seq, bytes(r.beat)[0]) for r in beats.where("link_id = 'link-1'").orderBy("seq").collect()
    ]
    # link-1 holds sizes 1, 64, 127, 129, 1500, twice.
    assert [f for _, f in flags[:7]] == [
        0x80 | 0x40 | 63, 0x80 | 0x40, 0x80, 0x40 | 1, 0x80, 0x00, 0x40 | 63
    ]


def test_empty_packet_encodes_as_a_full_word(frames):
    empty = framing.to_words(frames.where(F.length("frame") == 0).limit(1))
    word = framing.decode_beats(framing.encode_beats(empty)).first()
    assert (word.end_of_packet, word.end_of_packet_len) == (True, 64)


def test_realign_against_the_model(spark):
    rng = random.Random(42)
    rows, expected, seq, number = [], {}, 0, 0
    for _ in range(200):
        packet = rng.randbytes(rng.randint(4, 192))
        whole = rng.randint(0, max(0, len(packet) // 64 - 1))
        octets = rng.randint(2, min(30, (len(packet) - whole * 64) // 2))
        error = rng.randint(0, 2) == 0
        for i, (data, eop, length) in enumerate(split(packet)):
            consumed = 64 if i < whole else octets if i == whole else 0
            rows.append(("l", seq, data, eop, length, consumed, i == whole, error and i == whole))
            seq += 1
        if not error:
            expected[number] = split(packet[whole * 64 + 2 * octets :])
        number += 1
    words = spark.createDataFrame(
        rows,
        "link_id string, seq bigint, data binary, end_of_packet boolean, end_of_packet_len int, "
        "octets_consumed int, extract_range_end boolean, error_drop boolean",
    )
    got = {}
    for r in framing.realign(words).orderBy("packet_no", "word_no").collect():
        got.setdefault(r.packet_no, []).append((bytes(r.data), r.end_of_packet, r.end_of_packet_len))
    assert got == expected


@pytest.mark.parametrize("bits", [0, 1, 2, 4])
def test_packets_across_slices(spark, monkeypatch, bits):
    """Slices that end in, before and after a packet's end, and packets over many slices."""
    monkeypatch.setattr(ordering, "SLICE_BITS", bits)
    monkeypatch.setattr(ordering, "LEVELS", 12)
    rng, rows, expected = random.Random(bits), [], {}
    for link in ("a", "b"):
        packets = [rng.randbytes(rng.choice([0, 1, 64, 65, 128, 700, 2500])) for _ in range(40)]
        expected[link] = packets
        words = [w for p in packets for w in split(p)] + [(bytes(64), False, 0)] * 3
        rows += [(link, seq, *w) for seq, w in enumerate(words)]
    schema = "link_id string, seq bigint, data binary, end_of_packet boolean, end_of_packet_len int"
    words = spark.createDataFrame(rows, schema).repartition(3)
    got = {}
    for r in framing.to_frames(words).orderBy("packet_no").collect():
        got.setdefault(r.link_id, []).append(bytes(r.frame))
    assert got == expected
    short = framing.to_frames(words, longest=600).orderBy("packet_no").collect()
    assert all((r.frame is None) == (r.frame_len > 600) for r in short)
    assert {(r.link_id, r.packet_no, r.bytes) for r in framing.oversized(words, 600).collect()} == {
        (link, n, len(p)) for link, packets in expected.items() for n, p in enumerate(packets) if len(p) > 600
    }


def payload_exchanges(df, columns):
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    found = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    return sum(bool(re.search(rf"\b({columns})#", held)) for held in found)


def test_payload_is_exchanged_once_in_each_direction(frames, tmp_path):
    spark = frames.sparkSession
    framing.to_words(frames).write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    parsed = words.selectExpr(
        "*", "14 AS octets_consumed", "word_no = 0 AS extract_range_end", "false AS error_drop"
    ).drop("packet_id", "word_no")
    assert payload_exchanges(framing.to_words(frames), "frame|data") == 1
    for made in (framing.to_frames(words), framing.realign(parsed), framing.encode_beats(words)):
        assert payload_exchanges(made, "data|kept|frame|_held") == 1
    assert payload_exchanges(framing.oversized(words), "data|frame") == 0
