"""Streams give what batch gives on the same packets."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from floodsift.functions.hashing import SketchShape
from floodsift.operators import controller, volume
from floodsift.operators.controller import FilterSettings
from floodsift.operators.decode import with_features
from floodsift.plans import catalog, inputs
from floodsift.schemas import PACKETS
from floodsift.streaming.rolling import RollingFilter
from floodsift.streaming.volume import stream_volume

START = datetime(2024, 1, 1)
SETTINGS = FilterSettings(volume_threshold=30, shape=SketchShape(depth=4, width=1 << 14))


def packet(link, number, second, source, length=10, port=80):
    at = START + timedelta(seconds=second)
    return (link, number, at, source, 1, port, length)


def traffic():
    """Two links over 14 seconds: calm, floods of one and two windows, and silence."""
    packets, number = [], 0
    for link, flooded, silent in (("a", (3, 4, 9), (6, 7)), ("b", (1, 2, 5, 12), (8,))):
        for second in range(14):
            if second in silent:
                continue
            for n in range(2):
                packets.append(packet(link, number, second + n / 4, 100 + n))
                number += 1
            for n in range(8 if second in flooded else 0):
                packets.append(packet(link, number, second + 0.5 + n / 100, 900 + n, 11, 53))
                number += 1
    return sorted(packets, key=lambda p: p[2])


def stored(spark, folder, batches):
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, PACKETS).coalesce(1).write.parquet(f"{folder}/in/{number:03d}")
    return (
        spark.readStream.schema(PACKETS)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .parquet(f"{folder}/in")
    )


def run(stream, folder, sink):
    query = stream.writeStream.foreachBatch(sink)
    query.option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()


def plain(verdicts):
    return {tuple(r) for r in verdicts.select(*controller.VERDICT).collect()}


def cut(rows, at):
    edges = [0, *at, len(rows)]
    return [rows[a:b] for a, b in zip(edges, edges[1:])]


def test_rolling_filter_equals_batch_with_empty_windows(spark, tmp_path):
    rows = traffic()
    batches = cut(rows, [17, 40, 43])
    rolling = RollingFilter(f"{tmp_path}/state", SETTINGS)
    run(stored(spark, tmp_path, batches), tmp_path, rolling)
    rolling.drain(spark.createDataFrame([], PACKETS), len(batches))
    expected = plain(controller.judge(spark.createDataFrame(rows, PACKETS), SETTINGS))
    assert plain(rolling.verdicts(spark)) == expected
    assert {p for *_, p in expected} == {True, False}
    assert rolling.late_packets(spark).isEmpty()


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = traffic()
    batches = [spark.createDataFrame(part, PACKETS) for part in cut(rows, [45])]
    rolling = RollingFilter(str(tmp_path), SETTINGS)
    for number, batch in enumerate(batches):
        rolling(batch, number)
        rolling(batch, number)
    rolling.drain(spark.createDataFrame([], PACKETS), len(batches))
    assert plain(rolling.verdicts(spark)) == plain(
        controller.judge(spark.createDataFrame(rows, PACKETS), SETTINGS)
    )


def test_late_packets_are_kept_apart_and_lateness_waits(spark, tmp_path):
    rows = [packet("a", n, n, 100) for n in range(5)]
    late = packet("a", 99, 1.5, 100)
    for lateness, found in ((0, [99]), (10_000_000, [])):
        rolling = RollingFilter(f"{tmp_path}/{lateness}", SETTINGS, lateness)
        rolling(spark.createDataFrame(rows, PACKETS), 0)
        rolling(spark.createDataFrame([late], PACKETS), 1)
        rolling.drain(spark.createDataFrame([], PACKETS), 2)
        assert [r.packet_id for r in rolling.late_packets(spark).collect()] == found
        judged = {r.packet_id for r in rolling.verdicts(spark).collect()}
        assert judged == set(range(5)) | ({99} - set(found))


def test_a_fast_clock_closes_nothing_elsewhere(spark, tmp_path):
    ahead = [packet("b", 100 + n, 3600 + n, 100) for n in range(3)]
    rows = [packet("a", n, n, 100) for n in range(6)]
    rolling = RollingFilter(str(tmp_path), SETTINGS)
    rolling(spark.createDataFrame(ahead + rows[:2], PACKETS), 0)
    rolling(spark.createDataFrame(rows[2:], PACKETS), 1)
    rolling.drain(spark.createDataFrame([], PACKETS), 2)
    assert rolling.late_packets(spark).isEmpty()
    assert {r.packet_id for r in rolling.verdicts(spark).collect()} == {*range(6), 100, 101, 102}


def test_a_wrong_time_moves_a_clock_by_a_bounded_jump(spark, tmp_path):
    rolling = RollingFilter(str(tmp_path), SETTINGS, jump_us=2_000_000)
    rolling(spark.createDataFrame([packet("a", 0, 0, 100), packet("a", 50, 5000, 100)], PACKETS), 0)
    rolling(spark.createDataFrame([packet("a", n, n + 1, 100) for n in range(1, 5)], PACKETS), 1)
    assert rolling.late_packets(spark).isEmpty()


def test_silent_links_are_closed_after_some_batches(spark, tmp_path):
    rolling = RollingFilter(str(tmp_path), SETTINGS, idle_batches=2)
    rolling(spark.createDataFrame([packet("a", 0, 0, 100), packet("b", 1, 0, 100)], PACKETS), 0)
    for n in (1, 2):
        rolling(spark.createDataFrame([packet("b", n + 1, n / 10, 100)], PACKETS), n)
    assert [(r.link_id, r.w) for r in rolling.windows(spark).collect()] == [("a", 0)]


def test_a_stream_needs_a_fixed_threshold(tmp_path):
    with pytest.raises(ValueError):
        RollingFilter(str(tmp_path), replace(SETTINGS, volume_threshold=None))


def test_stream_volume_equals_batch_for_closed_windows(spark, tmp_path):
    rows = traffic()
    stream = stored(spark, tmp_path, cut(rows, [10, 30]))
    anchor = int((rows[0][2] - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    found = stream_volume(stream, anchor, volume_threshold=30)
    query = found.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    query.option("checkpointLocation", f"{tmp_path}/log").start(f"{tmp_path}/out").awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    report = volume.window_report(spark.createDataFrame(rows, PACKETS), volume_threshold=30)
    expected = {
        (r.link_id, r.w, r.volume, r.over) for r in report.collect() if r.volume and r.w < 13
    }
    assert got == expected


def test_frame_stream_lets_through_what_batch_does(spark, sf_dir, tmp_path):
    frames = inputs.frames(spark, sf_dir)
    middle = frames.agg(F.expr("percentile_approx(packet_id, 0.5)")).first()[0]
    settings = replace(inputs.SETTINGS, volume_threshold=400)
    rolling = RollingFilter(str(tmp_path), settings)
    rolling.frames(frames.where(F.col("packet_id") <= middle), 0)
    rolling.frames(frames.where(F.col("packet_id") > middle), 1)
    rolling.frames(frames.limit(0), 2, close_all=True)
    got = {tuple(r) for r in rolling.surviving_frames(spark).collect()}
    expected = [tuple(r) for r in controller.filter_frames(frames, settings).collect()]
    assert got == set(expected) and len(got) == len(expected)


def test_packets_are_judged_when_they_come(spark, tmp_path):
    rows = traffic()
    rolling = RollingFilter(str(tmp_path), SETTINGS)
    seen = 0
    for number, part in enumerate(cut(rows, [30, 60])):
        rolling(spark.createDataFrame(part, PACKETS), number)
        seen += len(part)
        # Without lateness nothing waits, however many windows are open.
        assert rolling.verdicts(spark).count() == seen
        assert spark.read.parquet(f"{tmp_path}/waiting/slot={number % 2}").isEmpty()
    expected = plain(controller.judge(spark.createDataFrame(rows, PACKETS), SETTINGS))
    assert plain(rolling.verdicts(spark)) == expected


def test_windows_of_a_stream_equal_the_report(spark, tmp_path):
    rows = traffic()
    rolling = RollingFilter(str(tmp_path), SETTINGS, lateness_us=1_500_000)
    for number, part in enumerate(cut(rows, [25, 70])):
        rolling(spark.createDataFrame(part, PACKETS), number)
    rolling.drain(spark.createDataFrame([], PACKETS), 3)
    report = volume.window_report(spark.createDataFrame(rows, PACKETS), volume_threshold=30)
    got = rolling.windows(spark).select(*report.columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, report.collect()))
    assert plain(rolling.verdicts(spark)) == plain(controller.judge(spark.createDataFrame(rows, PACKETS), SETTINGS))


def test_uncommitted_output_is_not_read(spark, tmp_path):
    rolling = RollingFilter(str(tmp_path), SETTINGS)
    rolling(spark.createDataFrame([packet("a", 0, 0, 100)], PACKETS), 0)
    torn = spark.read.parquet(f"{tmp_path}/out/batch=0").where("kind = 'verdict'")
    torn.write.partitionBy("kind").parquet(f"{tmp_path}/out/batch=1")
    assert [r.packet_id for r in rolling.verdicts(spark).collect()] == [0]


def test_state_stays_small_over_many_batches(spark, tmp_path):
    """All that is kept besides the output: two slots of each table, whatever the number of batches."""
    rolling = RollingFilter(str(tmp_path), SETTINGS, lateness_us=3_000_000)
    sizes = []
    for number in range(16):
        rows = [packet("a", 10 * number + n, number + n / 20, 100 + (number * n) % 7) for n in range(6)]
        rolling(spark.createDataFrame(rows, PACKETS).coalesce(1), number)
        kept = [f for f in tmp_path.rglob("*.parquet") if f.relative_to(tmp_path).parts[0] not in ("out", "windows")]
        sizes.append((len(kept), sum(f.stat().st_size for f in kept)))
    # A slot has at most as many files as a batch has tasks; its size follows the lateness.
    assert max(n for n, _ in sizes[8:]) <= max(n for n, _ in sizes[4:8]) + 4
    assert max(size for _, size in sizes[8:]) <= 1.5 * max(size for _, size in sizes[4:8])
    assert rolling.verdicts(spark).count() > 60


def test_windows_of_the_stream_are_judged_by_the_mean_of_the_volumes(spark, tmp_path):
    # 483 packets of 440 bytes: the mean of the month's windows is 885; windows of 440 bytes are calm.
    rows = [(n, 6 * n, 0) for n in range(3)] + [(n, 100 + n % 4 * 180, 1) for n in range(3, 483)]
    events = spark.createDataFrame(rows, "event_id long, hour int, user_id long").selectExpr(
        "event_id", "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, hour) AS ts", "user_id",
        "'click' AS event_type", "400D AS value", "'' AS props",
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert inputs.mean_volume(spark, str(tmp_path)) == 483 * 440 // 240
    judged = catalog.stream_verdicts(spark, str(tmp_path)).where("link_id = 'link-0'").collect()
    assert [r["mode"] for r in judged] == [False] * 3
