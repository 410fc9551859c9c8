"""Traffic volume in tumbling windows, and the mode and generation of each window.

Windows are numbered from the first packet of a link, half open, and judged by
the one before: a window after one over the threshold is in QUERY mode. A window
that closes calm moves the generation on.

An empty window is calm, so the generation of window ``w`` is ``w`` minus the
number of windows over the threshold before it. That needs the observed windows
only; a dense series is made just for reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from floodsift.functions.binary import micros
from floodsift.operators.lookup import Lookup, attach, measure
from floodsift.operators.ordering import scan, spine

SECOND = 1_000_000


def link_anchors(packets: DataFrame) -> Lookup:
    """First packet time of each link."""
    anchors = packets.groupBy("link_id").agg(
        F.min(micros(F.col("ts"))).alias("anchor_us"), F.count(F.lit(1)).alias("packets")
    )
    return measure(anchors, weight="packets")


def window_number(ts: Column, anchor_us: Column, window_us: int) -> Column:
    since = micros(ts) - anchor_us
    whole = since - F.pmod(since, F.lit(window_us).cast("bigint"))
    return (whole / F.lit(window_us)).cast("bigint")


def with_window(packets: DataFrame, anchors: Lookup, window_us: int) -> DataFrame:
    """Add the window number ``w``; rows of links without an anchor get NULL."""
    out = attach(packets, anchors, ["link_id"], spread="packet_id")
    w = window_number(F.col("ts"), F.col("anchor_us"), window_us)
    return out.withColumn("w", w).drop("anchor_us")


def volumes(windowed: DataFrame) -> DataFrame:
    """Bytes and packets of each observed window."""
    return windowed.groupBy("link_id", "w").agg(
        F.sum("total_length").alias("volume"), F.count(F.lit(1)).alias("packets")
    )


def thresholds(observed: DataFrame, volume_threshold: int | None) -> DataFrame:
    """Add ``threshold``: the given one, or the mean volume of all the link's windows."""
    if volume_threshold is not None:
        if volume_threshold < 0:
            raise ValueError("an empty window must stay calm: the threshold cannot be negative")
        return observed.withColumn("threshold", F.lit(volume_threshold).cast("bigint"))
    means = observed.groupBy("link_id").agg(
        F.expr("sum(volume) div (max(w) + 1)").alias("threshold"),
        F.count(F.lit(1)).alias("windows"),
    )
    return attach(observed, measure(means, weight="windows"), ["link_id"], spread="w")


def window_state(
    observed: DataFrame, volume_threshold: int | None, earlier: Lookup | None = None, levels: int = 0
) -> DataFrame:
    """Add ``over``, ``mode`` (true = QUERY) and ``generation`` to observed windows.

    ``earlier`` continues a series: per link the last observed window before
    (``earlier_w``, ``earlier_over``) and the count of those over (``earlier_overs``).
    ``levels`` is that of :func:`scan`; one will do for a few windows of each link.
    """
    flagged = thresholds(observed, volume_threshold).withColumn(
        "over", F.col("volume") > F.col("threshold")
    )
    scanned = scan(
        flagged,
        ["link_id"],
        "w",
        sums={"overs": F.col("over").cast("bigint")},
        lasts={"previous": F.struct("w", "over")},
        levels=levels,
    )
    if earlier is not None:
        scanned = attach(scanned, earlier, ["link_id"], spread="w")
        before = F.struct(F.col("earlier_w").alias("w"), F.col("earlier_over").alias("over"))
        scanned = scanned.withColumns(
            {
                "overs": F.col("overs") + F.coalesce("earlier_overs", F.lit(0)),
                "previous": F.coalesce("previous", F.when(F.col("earlier_w").isNotNull(), before)),
            }
        ).drop("earlier_w", "earlier_over", "earlier_overs")
    mode = (F.col("previous.w") == F.col("w") - 1) & F.col("previous.over")
    return scanned.withColumns(
        {"mode": F.coalesce(mode, F.lit(False)), "generation": F.col("w") - F.col("overs")}
    ).drop("threshold", "overs", "previous")


def dense(observed: DataFrame) -> DataFrame:
    """All windows of each link up to the last one, empty ones with volume 0."""
    bounds = observed.groupBy("link_id").agg(F.max("w").alias("last_w"))
    filled = spine(bounds, ["link_id"], "last_w", "w").join(observed, ["link_id", "w"], "left")
    return filled.fillna(0, ["volume", "packets"])


def observed_windows(packets: DataFrame, window_us: int) -> DataFrame:
    return volumes(with_window(packets, link_anchors(packets), window_us))


def window_report(
    packets: DataFrame, window_us: int = SECOND, volume_threshold: int | None = 100_000
) -> DataFrame:
    """Dense ``window_state`` of a packet table."""
    state = window_state(dense(observed_windows(packets, window_us)), volume_threshold)
    return state.select("link_id", "w", "volume", "over", "mode", "generation")


def baseline_windows(state: DataFrame) -> DataFrame:
    """For each QUERY window of a dense state the window it is judged against, if any."""
    learnt = state.where(~F.col("mode")).select(
        "link_id", F.col("generation").alias("read"), F.col("w").alias("baseline_w")
    )
    queried = state.where("mode").withColumn("read", F.col("generation") - 1)
    return queried.join(learnt, ["link_id", "read"], "left").select(
        "link_id", "w", "generation", "baseline_w"
    )


def bytes_per_bin(decoded: DataFrame, bin_us: int = SECOND) -> DataFrame:
    """IPv4 bytes per time bin, counted from the first packet of the capture.

    ``decoded`` has a row for every packet, with ``total_length`` NULL where the
    packet is not IPv4. Bins without IPv4 packets are not reported.
    """
    firsts = decoded.groupBy("link_id").agg(
        F.min_by(micros(F.col("ts")), F.col("packet_id")).alias("anchor_us"),
        F.count(F.lit(1)).alias("packets"),
    )
    binned = with_window(decoded, measure(firsts, weight="packets"), bin_us)
    return (
        binned.where(F.col("total_length").isNotNull())
        .groupBy("link_id", F.col("w").alias("bin"))
        .agg(F.sum("total_length").alias("bytes"))
        .withColumn("start_us", F.col("bin") * bin_us)
        .orderBy("link_id", "bin")
    )


def tick_volume(ticks: DataFrame, window: int, threshold: int) -> DataFrame:
    """Sum and flag of every full window of ``window`` ticks; idle ticks count as 0."""
    full = ticks.agg(
        (F.floor((F.max("tick") + 1) / F.lit(window)) - 1).cast("bigint").alias("last_w")
    ).where("last_w >= 0")
    sums = ticks.groupBy(F.expr(f"tick div {window}").alias("w")).agg(F.sum("sample").alias("volume"))
    filled = spine(full, [], "last_w", "w").join(sums, "w", "left").fillna(0, ["volume"])
    return filled.withColumn("over", F.col("volume") > threshold)
