from datetime import datetime, timedelta

from pyspark.sql import functions as F

from floodsift.operators import captures
from floodsift.schemas import DECISIONS, FRAMES

START = datetime(2024, 1, 1)


def table(spark, payloads, link="l"):
    rows = [(link, n, START + timedelta(seconds=n), p) for n, p in enumerate(payloads)]
    return spark.createDataFrame(rows, FRAMES)


def compared(left, right):
    return [tuple(r) for r in captures.compare_captures(left, right).orderBy("link_id").collect()]


def test_compare(spark):
    a = table(spark, [b"1", b"2", b"3"])
    assert compared(a, a) == [("l", 3, 3, None)]
    assert compared(a, table(spark, [b"1", b"x", b"y"])) == [("l", 3, 3, 2)]
    assert compared(a, table(spark, [b"1", b"2"])) == [("l", 3, 2, 3)]
    assert compared(a, table(spark, [b"1"], "m")) == [("l", 3, 0, 1), ("m", 0, 1, 1)]


def test_exchanged_packets_differ_in_capture_order(spark):
    a = table(spark, [b"1", b"2", b"3"])
    swapped = a.withColumn("packet_id", F.when(F.col("packet_id") < 2, 1 - F.col("packet_id")).otherwise(2))
    assert compared(a, swapped) == [("l", 3, 3, 1)]
    by_time = captures.compare_captures(a, swapped, ("ts", "packet_id")).collect()
    assert [tuple(r) for r in by_time] == [("l", 3, 3, None)]


def test_retimestamp(spark):
    df = table(spark, [b"a", b"b", b"c"]).withColumn("packet_id", F.col("packet_id") * 10 + 5)
    by_default = captures.retimestamp(df).orderBy("packet_id").select(F.unix_micros("ts")).collect()
    assert [r[0] for r in by_default] == [0, 50, 100]
    shifted = captures.retimestamp(df, "idx*0.05 + 1").orderBy("packet_id").select(F.unix_micros("ts"))
    assert [r[0] for r in shifted.collect()] == [1_000_000, 1_050_000, 1_100_000]


def decided(spark, xs, packets):
    decisions = spark.createDataFrame([("l", n, x) for n, x in enumerate(xs)], DECISIONS)
    out = captures.expand_decisions(decisions, table(spark, [b""] * packets).drop("frame", "ts"))
    return [(r.ordinal, r["pass"]) for r in out.orderBy("ordinal").collect()]


def test_decisions(spark):
    t, f = True, False
    assert decided(spark, [2, 0, 0, 3], 6) == list(enumerate([t, t, f, f, t, t]))
    assert decided(spark, [1, 0], 4) == list(enumerate([t, f]))
    assert decided(spark, [31, 0], 3) == list(enumerate([t, t, t]))
