"""Named queries over the given tables. Each takes (spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from floodsift.functions import hashing
from floodsift.functions.binary import ip_to_long, long_to_ip, micros, swap_bytes
from floodsift.operators import captures, controller, decode, framing, replay, sketch, volume
from floodsift.operators.lookup import measure
from floodsift.plans import inputs
from floodsift.session import settle, shared_folder, stage
from floodsift.sources import pcap
from floodsift.sources.frames import in_time_order, read_frames, write_frames
from floodsift.sources.traffic import generate_traffic
from floodsift.streaming.rolling import RollingFilter

Query = Callable[[SparkSession, str], DataFrame]


def _hex_frames(frames: DataFrame, *more: str) -> DataFrame:
    return frames.select(
        "link_id", "packet_id", micros(F.col("ts")).alias("ts_us"), F.hex("frame").alias("frame_hex"), *more
    )


def _hex_words(words: DataFrame, *keys: str) -> DataFrame:
    return words.select(*keys, F.hex("data").alias("data_hex"), "end_of_packet", "end_of_packet_len")


# --- sources and sinks ---------------------------------------------------------


def frames_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex_frames(inputs.frames(spark, sf_dir))


def frames_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    write_frames(inputs.frames(spark, sf_dir), path)
    return _hex_frames(read_frames(spark, path))


def captures_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames written as capture files, in both formats and two folders of equal names, and read back."""
    folder = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    frames = inputs.frames(spark, sf_dir)
    half = F.col("packet_id") % 2 == 0
    for blocks, part in ((False, frames.where(half)), (True, frames.where(~half))):
        name = F.concat(F.col("link_id"), F.lit("/blocks.pcapng" if blocks else "/records.pcap"))
        pcap.write_captures(part, folder, name, blocks).write.format("noop").mode("overwrite").save()
    link = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
    back = pcap.read_captures(spark, folder, split_bytes=300_000, link=link)
    return back.select("link_id", micros(F.col("ts")).alias("ts_us"), F.hex("frame").alias("frame_hex"))


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = in_time_order(generate_traffic(inputs.flows(spark, sf_dir)))
    features = ("source_ip", "destination_ip", "destination_port", "total_length")
    return _hex_frames(made, *features)


# --- framing ---------------------------------------------------------------------


def frames_to_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex_words(inputs.words(spark, sf_dir), "link_id", "seq")


def words_to_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = framing.to_frames(inputs.words(spark, sf_dir))
    return made.select("link_id", "packet_no", F.hex("frame").alias("frame_hex"))


def realign_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = framing.realign(inputs.parser_words(spark, sf_dir))
    return _hex_words(made, "link_id", "packet_no", "word_no")


def beats_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.beats(spark, sf_dir).select("link_id", "seq", F.hex("beat").alias("beat_hex"))


def beats_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex_words(framing.decode_beats(inputs.beats(spark, sf_dir)), "link_id", "seq")


def byte_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.frames(spark, sf_dir).select(
        "link_id", "packet_id", F.hex(swap_bytes(F.col("frame"))).alias("swapped_hex")
    )


def complete_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last word of each link has not arrived: its packet must be held back."""
    words = inputs.words(spark, sf_dir)
    ends = words.groupBy("link_id").agg(F.max("seq").alias("seq"))
    cut = words.join(ends, ["link_id", "seq"], "left_anti")
    made = framing.to_frames(cut)
    return made.groupBy("link_id").agg(
        F.count(F.lit(1)).alias("frames"), F.sum(F.length("frame")).alias("bytes")
    )


# --- header decode ---------------------------------------------------------------


def _layer(prefix: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        decoded = decode.decode(inputs.frames(spark, sf_dir))
        fields = {c: c.removeprefix(f"{prefix}_") for c in decoded.columns if c.startswith(f"{prefix}_")}
        present = decoded.where(F.col(f"{prefix}_error").isNotNull())
        return present.select(
            "link_id", "packet_id", *[F.col(c).alias(name) for c, name in fields.items()]
        )

    return query


def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.class_counts(inputs.frames(spark, sf_dir))


def l4_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode.decode(inputs.frames(spark, sf_dir)).where(~F.col("ip_error"))
    return decoded.select(
        "link_id",
        "packet_id",
        F.col("ip_protocol").alias("protocol"),
        F.coalesce("tcp_source_port", "udp_source_port", F.lit(0)).alias("source_port"),
        decode.destination_port().alias("destination_port"),
        F.coalesce("tcp_error", "udp_error", F.lit(False)).alias("error"),
    )


def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.features(inputs.frames(spark, sf_dir)).drop("ts")


def ip_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = inputs.packets(spark, sf_dir).select(
        "packet_id",
        long_to_ip(F.col("source_ip")).alias("source_text"),
        long_to_ip(F.col("destination_ip")).alias("destination_text"),
    )
    return text.withColumns(
        {
            "source_ip": ip_to_long(F.col("source_text")),
            "destination_ip": ip_to_long(F.col("destination_text")),
        }
    )


def payload_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.payload_offsets(inputs.frames(spark, sf_dir))


def malformed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.malformed_report(inputs.frames(spark, sf_dir))


# --- hashing ---------------------------------------------------------------------


def _source_residue() -> Column:
    return hashing.residue(F.col("source_ip"))


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    sip, dip = F.col("source_ip"), F.col("destination_ip")
    return inputs.packets(spark, sf_dir).select(
        "packet_id",
        hashing.residue(sip).alias("residue32"),
        hashing.residue(F.shiftleft(dip, 16) + F.col("destination_port")).alias("residue48"),
        hashing.residue_unsigned(F.shiftleft(sip, 32).bitwiseOR(dip)).alias("residue64"),
    )


def universal_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.packets(spark, sf_dir).select(
        "packet_id", hashing.universal_hash(_source_residue(), 7, 1234).alias("hash")
    )


def key_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = sketch.packet_residues()
    return inputs.packets(spark, sf_dir).select(
        "packet_id", *[keys[dim].alias(name) for dim, name in hashing.DIMENSIONS.items()]
    )


def hash_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = hashing.SketchShape(depth=1, width=512)
    return sketch.hash_bucket_counts(inputs.packets(spark, sf_dir), _source_residue(), 0, shape)


def counter_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-bit counters of one narrow row, next to the exact count."""
    shape = hashing.SketchShape(depth=1, width=16)
    exact = sketch.hash_bucket_counts(inputs.packets(spark, sf_dir), _source_residue(), 0, shape)
    return exact.withColumn("wrapped", hashing.wrap_counter(F.col("cnt"), 8))


# --- sketches --------------------------------------------------------------------


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = inputs.packets(spark, sf_dir)
    return volume.with_window(packets, volume.link_anchors(packets), inputs.SETTINGS.window_us)


def _learnt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Residue counts of learnt and of QUERY windows, by link and generation."""
    packets = inputs.packets(spark, sf_dir)
    anchors = volume.link_anchors(packets)
    windows = volume.volumes(volume.with_window(packets, anchors, inputs.SETTINGS.window_us))
    state = volume.window_state(settle(windows), None)
    state = state.select("link_id", "w", "mode", "generation", "packets")
    tagged = controller.tag(packets, anchors, measure(state, "packets"), inputs.SETTINGS)
    counts = settle(sketch.residue_counts(tagged, ["link_id", "generation", "mode"]))
    return counts.where(~F.col("mode")).drop("mode"), counts


def cms_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    learnt, _ = _learnt(spark, sf_dir)
    return sketch.build(learnt, ["link_id", "generation", "dim"], inputs.SHAPE)


def cms_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    learnt, counts = _learnt(spark, sf_dir)
    by = ["link_id", "generation", "dim"]
    sketches = sketch.build(learnt, by, inputs.SHAPE)
    probes = controller.asked_residues(counts).drop("packets")
    return sketch.probe(sketches, probes, by, inputs.SHAPE)


def cms_hash_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of all residues of a link from a sketch whose rows have their own hash parameters."""
    counted = sketch.residue_counts(inputs.packets(spark, sf_dir), ["link_id"])
    return sketch.estimate_own(counted, ["link_id", "dim"], inputs.PARAMETRISED)


def heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.heavy_hitters(
        _windowed(spark, sf_dir), inputs.SHAPE, inputs.HITTERS_ABOVE, inputs.HITTERS_TOP
    )


def hashtab_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.hashtab_replay(inputs.from_events(spark, sf_dir, inputs.HASH_OPS), width=512)


def cms_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = inputs.from_events(spark, sf_dir, inputs.HASH_OPS)
    return replay.cms_replay(ops, hashing.SketchShape(depth=4, width=512))


def rolling_cms_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = inputs.from_events(spark, sf_dir, inputs.ROLLING_OPS)
    return replay.rolling_cms_replay(ops, hashing.SketchShape(depth=4, width=1024))


# --- windows ---------------------------------------------------------------------


def bytes_per_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode.decode(inputs.frames(spark, sf_dir))
    length = F.when(~F.col("ip_error"), F.col("ip_total_length").cast("bigint"))
    narrow = decoded.select("link_id", "packet_id", "ts", length.alias("total_length"))
    return volume.bytes_per_bin(narrow, inputs.BIN_US)


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = inputs.SETTINGS
    return volume.window_report(
        inputs.packets(spark, sf_dir), settings.window_us, settings.volume_threshold
    )


def window_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select("link_id", "w", "volume", "over")


def window_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select("link_id", "w", "mode", "generation")


def baseline_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.baseline_windows(settle(_report(spark, sf_dir)))


def tick_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = inputs.from_events(spark, sf_dir, inputs.TICKS)
    return volume.tick_volume(ticks, inputs.TICK_WINDOW, inputs.TICK_THRESHOLD)


# --- the filter --------------------------------------------------------------------


def _judged(spark: SparkSession, sf_dir: str, discard_threshold: int = 0) -> DataFrame:
    settings = replace(inputs.SETTINGS, discard_threshold=discard_threshold)
    return controller.judge(inputs.packets(spark, sf_dir), settings)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)


def query_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("mode").select("packet_id", "score")


def filter_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controller.filter_metrics(_judged(spark, sf_dir))


def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controller.verdict_summary(_judged(spark, sf_dir))


def verdict_summary_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controller.verdict_summary(_judged(spark, sf_dir, discard_threshold=2))


def filtered_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = controller.filter_frames(inputs.frames(spark, sf_dir), inputs.SETTINGS)
    return _hex_frames(kept)


def scenario_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flood in two seconds, filtered, against the same traffic flooded in the first only."""
    settings = replace(inputs.SETTINGS, window_us=volume.SECOND)
    made = generate_traffic(inputs.flows(spark, sf_dir))
    # The filter reads frames twice and several fields of each: from a table, not from the generator.
    flooded = stage(made.select("link_id", "packet_id", "ts", "frame"))
    expected = generate_traffic(inputs.flows(spark, sf_dir, inputs.FLOOD_SECONDS[:1]))
    filtered = controller.filter_frames(flooded, settings)
    return captures.compare_captures(filtered, expected)


# --- captures ------------------------------------------------------------------------


def packet_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = inputs.packets(spark, sf_dir).select("link_id", "packet_id")
    return captures.packet_ordinals(packets)


def retimestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = inputs.packets(spark, sf_dir).select("link_id", "packet_id", "ts")
    made = captures.retimestamp(packets, "idx * 0.05 + 1")
    return made.select("link_id", "packet_id", micros(F.col("ts")).alias("ts_us"))


def compare_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture against what the filter let through."""
    frames = inputs.frames(spark, sf_dir)
    return captures.compare_captures(frames, controller.filter_frames(frames, inputs.SETTINGS))


def expand_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = inputs.from_events(spark, sf_dir, inputs.DECISIONS)
    packets = inputs.packets(spark, sf_dir).select("link_id", "packet_id")
    return captures.expand_decisions(decisions, packets)


# --- streams -------------------------------------------------------------------------


def _rolled(
    spark: SparkSession, sf_dir: str, frames: bool = False, delayed: bool = False, **settings: int
) -> RollingFilter:
    """The packets or frames through the rolling filter in four batches, and all windows closed."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    settings = settings or {"volume_threshold": inputs.stream_threshold(spark, sf_dir)}
    settings = replace(inputs.SETTINGS, **settings)
    rolling = RollingFilter(folder, settings)
    if frames:
        stream = inputs.frame_batches(spark, sf_dir, f"{folder}/in")
    else:
        stream = inputs.packet_batches(spark, sf_dir, f"{folder}/in", delayed)
    run = stream.writeStream.foreachBatch(rolling.frames if frames else rolling)
    run = run.option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    none = spark.createDataFrame([], stream.schema)
    if frames:
        rolling.frames(none, inputs.STREAM_BATCHES, close_all=True)
    else:
        rolling.drain(none, inputs.STREAM_BATCHES)
    return rolling


def stream_window_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with packets of each link, counted from its first packet, as the stream closed them."""
    return _rolled(spark, sf_dir).windows(spark).where("packets > 0").select("link_id", "w", "volume", "over")


def stream_idle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short windows without packets, which close, reset and rotate like any other."""
    window = inputs.short_window(spark, sf_dir)
    rolled = _rolled(spark, sf_dir, window_us=window, volume_threshold=inputs.SHORT_THRESHOLD)
    idle = rolled.windows(spark).where("packets = 0")
    return idle.select("link_id", "w", "mode", "generation")


def stream_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all packets, from four batches in the order of time."""
    rolled = _rolled(spark, sf_dir, volume_threshold=inputs.mean_volume(spark, sf_dir))
    return rolled.verdicts(spark).select(*controller.VERDICT)


def stream_late_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets whose window had closed when they came."""
    late = _rolled(spark, sf_dir, delayed=True).late_packets(spark)
    return late.select("link_id", "packet_id", "w")


def stream_frames_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in, surviving frames out."""
    return _hex_frames(_rolled(spark, sf_dir, frames=True).surviving_frames(spark))


QUERIES: dict[str, Query] = {
    "frames_scan": frames_scan,
    "frames_roundtrip": frames_roundtrip,
    "captures_scan": captures_scan,
    "generate_traffic": traffic,
    "frames_to_words": frames_to_words,
    "words_to_frames": words_to_frames,
    "realign_words": realign_words,
    "beats_encode": beats_encode,
    "beats_decode": beats_decode,
    "byte_swap": byte_swap,
    "complete_frames": complete_frames,
    "decode_ethernet": _layer("eth"),
    "decode_ipv4": _layer("ip"),
    "decode_tcp": _layer("tcp"),
    "decode_udp": _layer("udp"),
    "class_counts": class_counts,
    "l4_dispatch": l4_dispatch,
    "feature_vectors": feature_vectors,
    "ip_text_roundtrip": ip_text_roundtrip,
    "payload_offsets": payload_offsets,
    "malformed_report": malformed_report,
    "residues": residues,
    "universal_hash": universal_hash,
    "key_residues": key_residues,
    "hash_bucket_counts": hash_bucket_counts,
    "counter_wrap": counter_wrap,
    "cms_build": cms_build,
    "cms_query": cms_query,
    "cms_hash_params": cms_hash_params,
    "heavy_hitters": heavy_hitters,
    "hashtab_replay": hashtab_replay,
    "cms_replay": cms_replay,
    "rolling_cms_replay": rolling_cms_replay,
    "bytes_per_bin": bytes_per_bin,
    "window_volume": window_volume,
    "window_modes": window_modes,
    "baseline_window": baseline_window,
    "tick_volume": tick_volume,
    "verdicts": verdicts,
    "query_scores": query_scores,
    "filter_metrics": filter_metrics,
    "verdict_summary": verdict_summary,
    "verdict_summary_strict": verdict_summary_strict,
    "filtered_packets": filtered_packets,
    "scenario_filter": scenario_filter,
    "packet_ordinals": packet_ordinals,
    "retimestamp": retimestamp,
    "compare_captures": compare_captures,
    "expand_decisions": expand_decisions,
    "stream_window_volume": stream_window_volume,
    "stream_idle_windows": stream_idle_windows,
    "stream_verdicts": stream_verdicts,
    "stream_late_packets": stream_late_packets,
    "stream_frames_filter": stream_frames_filter,
}
