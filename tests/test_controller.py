import random
import re
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from floodsift.functions.hashing import SketchShape
from floodsift.operators import captures, controller, decode, packed as packed_rows, sketch, volume
from floodsift.operators.controller import FilterSettings
from floodsift.plans import inputs
from floodsift.sources.traffic import generate_traffic, scenario_flows


def scenario(spark, seconds=(1, 2), scale=1):
    return generate_traffic(scenario_flows(spark, seconds), rate_scale=scale)


@pytest.mark.parametrize(
    "scale, threshold, seconds, count, passed, volumes",
    [
        (1, 100_000, (1, 2), 815, 754, [60_768, 124_940, 124_940]),
        (20, 5_000, (1, 2), 36, 33, [2_476, 5_632, 5_632]),
        (20, 5_000, (1,), 33, 33, [2_476, 5_632, 2_476]),
    ],
)
def test_scenario_goldens(spark, scale, threshold, seconds, count, passed, volumes):
    packets = scenario(spark, seconds, scale)
    settings = FilterSettings(volume_threshold=threshold)
    verdicts = controller.judge(packets, settings).join(packets, ["link_id", "packet_id"])
    rows = verdicts.collect()
    assert (len(rows), sum(r["pass"] for r in rows)) == (count, passed)
    assert [sum(r.total_length for r in rows if r.w == w) for w in range(3)] == volumes
    assert [any(r["mode"] for r in rows if r.w == w) for w in range(3)] == [False, False, True]
    dropped = [r for r in rows if not r["pass"]]
    assert all(r.destination_port == 40006 and r.score == 0 for r in dropped)
    if scale == 1:
        kept = {r.score for r in rows if r["mode"] and r["pass"]}
        assert kept == {6, 60, 87, 249, 291}


def test_filtered_scenario_equals_the_expected_capture(spark):
    settings = FilterSettings(volume_threshold=5_000)
    frames = scenario(spark, scale=20).select("link_id", "packet_id", "ts", "frame")
    filtered = controller.filter_frames(frames, settings)
    assert [tuple(r) for r in captures.compare_captures(filtered, scenario(spark, (1,), 20)).collect()] == [
        ("link-0", 33, 33, None)
    ]
    unfiltered = captures.compare_captures(frames, scenario(spark, (1,), 20)).first()
    assert (unfiltered.left_packets, unfiltered.right_packets) == (36, 33)
    # Both start alike; they part where the second flood begins.
    assert unfiltered.first_difference > 18


def naive_verdicts(packets, settings):
    """Every packet in every row of three sketches, one window after another."""
    prime, shape = 65521, settings.shape
    start = min(p.us for p in packets)
    windows = {}
    for p in packets:
        windows.setdefault((p.us - start) // settings.window_us, []).append(p)
    last = max(windows)
    threshold = settings.volume_threshold
    if threshold is None:
        threshold = sum(p.total_length for p in packets) // (last + 1)
    update, query, mode, out = {}, {}, False, {}
    for w in range(last + 1):
        for p in windows.get(w, []):
            keys = (
                p.source_ip | p.destination_ip << 32,
                p.destination_port | p.destination_ip << 16,
                p.source_ip | p.total_length << 32,
            )
            slots = [
                [(d, r, ((r + 1) * k % prime) % shape.width) for r in range(shape.depth)]
                for d, k in enumerate(keys)
            ]
            if mode:
                score = sum(min(query.get(s, 0) for s in rows) for rows in slots)
                out[p.packet_id] = (score, score > settings.discard_threshold)
            else:
                for rows in slots:
                    for s in rows:
                        update[s] = update.get(s, 0) + 1
                out[p.packet_id] = (None, True)
        over = sum(p.total_length for p in windows.get(w, [])) > threshold
        if not over:
            update, query = {}, update
        mode = over
    return out


@pytest.mark.parametrize("discard, width", [(0, 1 << 14), (2, 64)])
def test_judge_equals_the_naive_form(spark, sf_dir, discard, width):
    settings = replace(
        inputs.SETTINGS, discard_threshold=discard, shape=SketchShape(depth=3, width=width)
    )
    packets = inputs.packets(spark, sf_dir)
    rows = packets.withColumn("us", F.unix_micros("ts")).collect()
    expected = {}
    for link in ("link-0", "link-1"):
        expected |= naive_verdicts([r for r in rows if r.link_id == link], settings)
    got = controller.judge(packets, settings).collect()
    assert {r.packet_id: (r.score, r["pass"]) for r in got} == expected


LIMITS = [
    {"broadcast_rows": 1},
    {"broadcast_rows": 20},
    {"broadcast_rows": 200},
    {"broadcast_bytes": 300},
    {"broadcast_rows": 1, "broadcast_bytes": 300},
]


@pytest.mark.parametrize("limits", LIMITS, ids=str)
def test_any_limit_gives_the_same_verdicts_and_frames(spark, sf_dir, limits, monkeypatch):
    packets, frames = inputs.packets(spark, sf_dir), inputs.frames(spark, sf_dir)
    whole = {tuple(r) for r in controller.judge(packets, inputs.SETTINGS).collect()}
    kept = {r.packet_id for r in controller.filter_frames(frames, inputs.SETTINGS).collect()}
    monkeypatch.setattr(controller, "HOT_ROWS", 7)  # so that generations are copied
    small = replace(inputs.SETTINGS, **limits)
    assert {tuple(r) for r in controller.judge(packets, small).collect()} == whole
    assert {r.packet_id for r in controller.filter_frames(frames, small).collect()} == kept


def test_policies(spark, sf_dir):
    frames = inputs.frames(spark, sf_dir)

    def count(**policies):
        return controller.filter_frames(frames, replace(inputs.SETTINGS, **policies)).count()

    usual = count()
    # 71 malformed and 76 unknown frames at this scale.
    assert count(malformed_policy="forward") == usual + 71
    assert count(unknown_policy="drop") == usual - 76
    with pytest.raises(ValueError):
        FilterSettings(unknown_policy="maybe")


def test_generated_frames_are_as_long_as_they_say_and_checksummed(spark):
    def ones(data):
        data += b"\0" * (len(data) % 2)
        total = sum(int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data), 2))
        while total >> 16:
            total = (total >> 16) + (total & 0xFFFF)
        return total

    for r in scenario(spark).collect():
        frame = bytes(r.frame)
        assert len(frame) == 14 + r.total_length
        assert ones(frame[14:34]) == 0xFFFF
        pseudo = frame[26:34] + bytes([0, frame[23]]) + (r.total_length - 20).to_bytes(2, "big")
        assert ones(pseudo + frame[34:]) == 0xFFFF


def test_a_large_flow_is_cut_into_chunks(spark):
    flows = scenario_flows(spark, (0,)).where("sources > 1").withColumn("rate", F.lit(10_000 * 8 * 1024))
    made = generate_traffic(flows, duration=1)
    stats = made.agg(
        F.count(F.lit(1)), F.count_distinct("packet_id"), F.count_distinct("source_ip"), F.max("ts")
    ).first()
    assert tuple(stats) == (10_000, 10_000, 250, datetime(1970, 1, 1, 0, 0, 0, 999_900))


def test_one_shuffle_estimates_equal_a_stored_sketch(spark, sf_dir):
    by, shape = ["link_id", "dim"], SketchShape(depth=4, width=256, counter_bits=8)
    packets = inputs.packets(spark, sf_dir)
    counted = sketch.residue_counts(packets.where("packet_id % 3 > 0"), ["link_id"])
    probes = sketch.residue_counts(packets, ["link_id"]).withColumnRenamed("cnt", "packets")
    stored = sketch.probe(sketch.build(counted, by, shape), probes, by, shape)
    met = sketch.estimate(counted, probes, by, shape)
    rows = {tuple(r) for r in met.select(*stored.columns).collect()}
    assert rows == {tuple(r) for r in stored.collect()} and any(r.estimate == 0 for r in stored.collect())
    own = sketch.estimate_own(counted, by, shape)
    asked = sketch.estimate(counted, counted.drop("cnt"), by, shape)
    assert {tuple(r) for r in own.collect()} == {tuple(r) for r in asked.select(*own.columns).collect()}
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(link_id") - plan.count("residue") <= 1


def exchanges(df, column):
    """(columns, what is below) of every exchange that holds ``column``."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    found = re.findall(r"\((\d+)\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    return plan, [int(n) for n, columns in found if re.search(rf"\b{column}#", columns)]


@pytest.mark.parametrize("windows_too", [False, True])
@pytest.mark.parametrize("limit", ["below", "estimates", "between", "windows", "above"])
def test_frames_are_moved_once_and_only_those_of_query_windows(spark, sf_dir, limit, windows_too):
    frames = inputs.frames(spark, sf_dir)
    known = controller.learn(decode.features(frames), inputs.SETTINGS)
    few, many = sorted((known.estimates.values, known.windows.values))
    rows = {"below": 1, "estimates": few, "between": (few + many) // 2, "windows": many, "above": 1 << 20}[limit]
    settings = replace(inputs.SETTINGS, broadcast_rows=rows, broadcast_bytes=300 if windows_too else 256 << 20)
    plan, moved = exchanges(controller.filter_frames(frames, settings), "frame")
    assert len(moved) <= (len(re.findall("Union", plan)) and plan.count("Exchange\nInput"))
    assert len(moved) <= 1
    if rows < known.estimates.values or windows_too:
        # Below the exchange: only rows whose window was found with its QUERY bit set.
        below = plan[: plan.index(f"({moved[0]}) Exchange\nInput")]
        assert re.search(r"Condition : .*_windows|Condition : .*_found|Condition : .*\b1\) = 1", below)
    else:
        assert moved == []


def test_packets_are_moved_once_for_all_three_keys(spark, sf_dir):
    settings = replace(inputs.SETTINGS, broadcast_rows=1)
    _, moved = exchanges(controller.judge(inputs.packets(spark, sf_dir), settings), "packet_id")
    assert len(moved) == 1


def test_packed_values_are_read_by_position(spark):
    rng = random.Random(4)
    groups = {"dense": range(65_536), "few": [0, 63, 64, 4095, 4096, 65_535], "one": [17]}
    groups["some"] = sorted(rng.sample(range(65_536), 700))
    table = [(g, at, at * 3 - 5) for g, ats in groups.items() for at in ats]
    rows = spark.createDataFrame(table, "g string, at int, v long")
    asked = [(g, at) for g in [*groups, "none"] for at in {*rng.sample(range(65_536), 300), 0, 17, 63, 64, 65_535}]
    probes = spark.createDataFrame(asked, "g string, p int")
    packed = packed_rows.pack(rows, ["g"], "at", "v")
    found = packed_rows.read(probes.join(packed, "g", "left"), {"got": ("packed", F.col("p"))})
    held = {(g, at): v for g, at, v in table}
    assert {(r.g, r.p): r.got for r in found.collect()} == {k: held.get(k) for k in asked}
    measured = packed_rows.Packed.measure(packed, ["packed"])
    assert measured.values == len(table) and measured.bytes > 8 * len(table)


@pytest.mark.parametrize("limit", [256 << 20, 2000])
def test_heavy_hitters_group_hot_keys_only(spark, sf_dir, limit):
    packets = inputs.packets(spark, sf_dir)
    windowed = volume.with_window(packets, volume.link_anchors(packets), inputs.SETTINGS.window_us)
    shape = SketchShape(depth=3, width=64)
    got = sketch.heavy_hitters(windowed, shape, 2, 3, limit)
    whole = sketch.heavy_hitters(windowed, shape, 0, 10**6)
    first = {tuple(r) for r in whole.where("estimate > 2").collect() if r["rank"] <= 3}
    assert {tuple(r) for r in got.collect()} == first and first
    assert exchanges(got, "packet_id")[1] == []
