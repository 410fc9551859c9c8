import random

from pyspark.sql import functions as F

from floodsift.functions import hashing
from floodsift.functions.binary import ip_to_long, long_to_ip, swap_bytes

P = 65521


def _values(bits):
    rng = random.Random(bits)
    edges = [0, 1, P - 1, P, P + 1, (1 << bits) - 1]
    return edges + [rng.randrange(1 << bits) for _ in range(2000)]


def test_residues_of_32_48_and_64_bits(spark):
    for bits in (32, 48, 64):
        values = _values(bits)
        signed = [(v, v - (1 << 64) if v >= 1 << 63 else v) for v in values]
        df = spark.createDataFrame([(str(v), s) for v, s in signed], "text string, x bigint")
        rows = df.select("text", hashing.residue_unsigned(F.col("x")).alias("r")).collect()
        assert all(row.r == int(row.text) % P for row in rows)


def test_universal_hash(spark):
    values = _values(32)
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    hashed = hashing.universal_hash(hashing.residue(F.col("x")), 7, 1234)
    assert all(row.h == (7 * row.x + 1234) % P for row in df.select("x", hashed.alias("h")).collect())


def test_packed_key_residues_match_the_packed_integers(spark):
    rng = random.Random(1)
    rows = [
        (rng.randrange(1 << 32), rng.randrange(1 << 32), rng.randrange(1 << 16), rng.randrange(1 << 16))
        for _ in range(500)
    ] + [((1 << 32) - 1, (1 << 32) - 1, 65535, 65535)]
    df = spark.createDataFrame(rows, "sip bigint, dip bigint, dport int, len bigint")
    keys = hashing.key_residues(*[F.col(c) for c in df.columns])
    for row in df.select("*", *[c.alias(f"k{d}") for d, c in keys.items()]).collect():
        assert row.k1 == (row.sip | row.dip << 32) % P
        assert row.k2 == (row.dport | row.dip << 16) % P
        assert row.k3 == (row.sip | row.len << 32) % P


def test_counter_wrap(spark):
    df = spark.createDataFrame([(255,), (256,), (70000,)], "c bigint")
    wrapped = df.select(
        hashing.wrap_counter(F.col("c"), 8).alias("b8"),
        hashing.wrap_counter(F.col("c"), 16).alias("b16"),
        hashing.wrap_counter(F.col("c"), None).alias("exact"),
    )
    assert [tuple(r) for r in wrapped.collect()] == [
        (255, 255, 255), (0, 256, 256), (112, 4464, 70000)
    ]


def test_addresses_and_byte_order(spark):
    df = spark.createDataFrame([("255.1.0.254",), ("0.0.0.0",)], "t string")
    back = df.select("t", long_to_ip(ip_to_long(F.col("t"))).alias("b"), ip_to_long(F.col("t")).alias("n"))
    assert [(r.t, r.n) for r in back.collect() if r.t == r.b] == [("255.1.0.254", 4278255870), ("0.0.0.0", 0)]
    raw = [bytes([0x80, 0xFF, 0x01]), b"", bytes(range(256))]
    swapped = spark.createDataFrame([(r,) for r in raw], "b binary").select(swap_bytes(F.col("b")).alias("s"))
    assert [bytes(r.s) for r in swapped.collect()] == [r[::-1] for r in raw]
