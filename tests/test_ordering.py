import random

import pytest
from pyspark.sql import functions as F

from floodsift.operators import ordering
from floodsift.operators.lookup import Lookup, attach, measure


@pytest.fixture(params=[(20, 2), (3, 2), (2, 3)], ids=["one slice", "slices", "three levels"])
def slicing(request, monkeypatch):
    monkeypatch.setattr(ordering, "SLICE_BITS", request.param[0])
    monkeypatch.setattr(ordering, "LEVELS", request.param[1])


def test_scan_equals_a_plain_loop(spark, slicing):
    rng = random.Random(5)
    rows = []
    for link in ("a", "b"):
        for at in sorted(rng.sample(range(200), 70)):
            rows.append((link, at, rng.randrange(10), rng.choice([None, None, rng.randrange(100)])))
    expected, totals, lasts = {}, {}, {}
    for link, at, value, mark in rows:
        expected[link, at] = (totals.get(link, 0), lasts.get(link))
        totals[link] = totals.get(link, 0) + value
        lasts[link] = mark if mark is not None else lasts.get(link)
    df = spark.createDataFrame(rows, "link string, at bigint, value bigint, mark bigint")
    out = ordering.scan(
        df, ["link"], "at", sums={"total": F.col("value")}, lasts={"last_mark": F.col("mark")}
    )
    assert {(r.link, r.at): (r.total, r.last_mark) for r in out.collect()} == expected
    assert out.columns == [*df.columns, "total", "last_mark"]


def test_positions_with_one_hot_instant(spark):
    rng = random.Random(6)
    rows = [("hot", 7, n) for n in rng.sample(range(10_000), 900)]
    rows += [("hot", rng.randrange(7), n) for n in range(20_000, 20_100)]
    rows += [("cold", rng.randrange(50), n) for n in range(30_000, 30_050)]
    df = spark.createDataFrame(rows, "link string, ts bigint, id bigint")
    got = ordering.positions(df, ["link"], ["ts", "id"], "at").collect()
    for link in ("hot", "cold"):
        ordered = sorted((r.ts, r.id) for r in got if r.link == link)
        assert [(r.ts, r.id) for r in sorted((r for r in got if r.link == link), key=lambda r: r.at)] == ordered
        assert sorted(r.at for r in got if r.link == link) == list(range(len(ordered)))


def test_spine_crosses_slices(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SPINE_BITS", 2)
    df = spark.createDataFrame([("a", 0), ("b", 9)], "link string, last bigint")
    rows = ordering.spine(df, ["link"], "last", "w").collect()
    assert sorted((r.link, r.w) for r in rows) == [("a", 0)] + [("b", w) for w in range(10)]


@pytest.mark.parametrize("limit", [1000, 5])
def test_attach_gives_the_same_rows_by_broadcast_and_by_shuffle(spark, limit):
    # Key 0 stands for most rows; key 9 is unknown to the small table.
    keys = [0] * 400 + [n % 9 for n in range(90)] + [9] * 3
    large = spark.createDataFrame(list(enumerate(keys)), "id bigint, k int")
    small = large.where("k < 9").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    lookup = measure(small.withColumn("v", F.col("k") * 10), "n")
    assert (lookup.rows, lookup.total) == (9, 490)
    out = attach(large, lookup, ["k"], "id", broadcast_rows=limit, hot_rows=50)
    assert {(r.id, r.k, r.v) for r in out.collect()} == {
        (n, k, k * 10 if k < 9 else None) for n, k in enumerate(keys)
    }
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan) == (limit == 5)


def test_hot_keys_are_bounded_by_the_limit(spark):
    table = spark.range(100).selectExpr("id AS k", "id + 1 AS n", "id AS v")
    lookup = Lookup(table, "n", 100, 5050)
    large = spark.range(100).selectExpr("id", "id AS k")
    out = attach(large, lookup, ["k"], "id", broadcast_rows=10, hot_rows=1)
    assert {(r.k, r.v) for r in out.collect()} == {(n, n) for n in range(100)}


def test_no_group_is_large_for_sparse_orders(spark):
    # A link of byte offsets up to 10**14, in capture files numbered above them.
    assert ordering.levels_for(10**14) == 3 and ordering.levels_for((1 << 62) + 5) == 4
    rng = random.Random(8)
    ats = sorted({rng.randrange(10**14) for _ in range(400)} | {0, 10**14})
    df = spark.createDataFrame([("a", at) for at in ats], "link string, at bigint")
    out = ordering.scan(df, ["link"], "at", sums={"n": F.lit(1).cast("bigint")}, levels=None)
    assert [r.n for r in out.orderBy("at").collect()] == list(range(len(ats)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_slice2" in plan and "_slice1" in plan and "_slice3" not in plan
    for level in range(3):
        # Members of a group of any level differ in SLICE_BITS bits only.
        spans = {at >> ordering.SLICE_BITS * level for at in ats}
        groups = {}
        for s in spans:
            groups.setdefault(s >> ordering.SLICE_BITS, set()).add(s)
        assert max(map(len, groups.values())) <= 1 << ordering.SLICE_BITS
