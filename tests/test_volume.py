from datetime import datetime, timedelta

import pytest

from floodsift.operators import volume

START = datetime(2024, 1, 1)


def series(spark, text):
    """A dense series of calm (c) and over (o) windows."""
    rows = [("l", w, 10 if flag == "o" else 1) for w, flag in enumerate(text.split())]
    return spark.createDataFrame(rows, "link_id string, w bigint, volume bigint")


GOLDENS = [
    ("c o o c c o o", "0011001", [0, 1, 1, 1, 2, 3, 3], {2: 0, 3: 0, 6: 4}),
    ("c o o c o o", "001101", [0, 1, 1, 1, 2, 2], {2: 0, 3: 0, 5: 1}),
    ("o o c", "011", [0, 0, 0], {1: None, 2: None}),
]


@pytest.mark.parametrize("text, modes, generations, baselines", GOLDENS)
def test_modes_generations_and_baselines(spark, text, modes, generations, baselines):
    state = volume.window_state(series(spark, text), 5)
    rows = state.orderBy("w").collect()
    assert "".join(str(int(r["mode"])) for r in rows) == modes
    assert [r.generation for r in rows] == generations
    assert {r.w: r.baseline_w for r in volume.baseline_windows(state).collect()} == baselines


def test_sparse_state_equals_dense_state(spark):
    observed = series(spark, "c o o c c o o c o c c o").where("w NOT IN (3, 4, 9)")
    sparse = volume.window_state(observed, 5).select("w", "mode", "generation")
    filled = observed.withColumn("packets", observed.volume)
    dense = volume.window_state(volume.dense(filled), 5).select("w", "mode", "generation")
    assert sparse.count() == 9
    assert sparse.subtract(dense).isEmpty()


def packets(spark, *events):
    rows = [
        ("l", n, START + timedelta(microseconds=int(us)), length) for n, (us, length) in enumerate(events)
    ]
    return spark.createDataFrame(rows, "link_id string, packet_id bigint, ts timestamp, total_length bigint")


def test_windows_are_half_open_anchored_and_dense(spark):
    df = packets(spark, (500_000, 3), (1_499_999, 4), (1_500_000, 5), (4_500_000, 6))
    rows = volume.window_report(df, volume_threshold=5).orderBy("w").collect()
    assert [(r.w, r.volume, r.over) for r in rows] == [
        (0, 7, True), (1, 5, False), (2, 0, False), (3, 0, False), (4, 6, True)
    ]


def test_negative_threshold_is_refused(spark):
    with pytest.raises(ValueError):
        volume.window_report(packets(spark, (0, 1)), volume_threshold=-1)


def test_bytes_per_bin_counts_from_the_first_packet_and_skips_other_protocols(spark):
    df = packets(spark, (2_000_000, None), (1_500_000, 7), (3_100_000, 8), (3_900_000, 9), (9_000_000, None))
    rows = volume.bytes_per_bin(df).collect()
    assert [(r.bin, r.bytes, r.start_us) for r in rows] == [(-1, 7, -1_000_000), (1, 17, 1_000_000)]


def test_tick_volume_reports_full_windows_only(spark):
    samples = [(t, None if t % 3 == 0 else t) for t in range(25)]
    ticks = spark.createDataFrame(samples, "tick bigint, sample bigint")
    rows = volume.tick_volume(ticks, 10, 27).orderBy("w").collect()
    expected = [sum(t for t in range(k * 10, k * 10 + 10) if t % 3) for k in range(2)]
    assert [(r.w, r.volume, r.over) for r in rows] == [(k, v, v > 27) for k, v in enumerate(expected)]
