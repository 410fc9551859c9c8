"""The volume-gated filter: learn in calm windows, judge in flooded ones."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from floodsift.functions.hashing import DIMENSIONS, SketchShape
from floodsift.operators.decode import features, with_features
from floodsift.operators.lookup import BROADCAST_ROWS, HOT_ROWS, Lookup, attach, attach_in_place
from floodsift.operators.packed import POSITION_BITS, Packed, pack, read
from floodsift.operators.sketch import estimate, packet_residues, residue_counts
from floodsift.operators.volume import SECOND, link_anchors, volumes, window_number, window_state, with_window
from floodsift.session import settle, stage

ESTIMATES = [f"est_{name}" for name in DIMENSIONS.values()]
VERDICT = ["link_id", "packet_id", "w", "mode", *ESTIMATES, "score", "pass"]


@dataclass(frozen=True)
class FilterSettings:
    """``volume_threshold=None`` takes the mean window volume of each link.

    ``broadcast_rows`` and ``broadcast_bytes`` bound what is sent to every executor.
    """

    window_us: int = SECOND
    volume_threshold: int | None = 100_000
    discard_threshold: int = 0
    shape: SketchShape = field(default_factory=SketchShape)
    malformed_policy: str = "drop"
    unknown_policy: str = "forward"
    broadcast_rows: int = BROADCAST_ROWS
    broadcast_bytes: int = 256 << 20

    def __post_init__(self) -> None:
        for policy in (self.malformed_policy, self.unknown_policy):
            if policy not in ("drop", "forward"):
                raise ValueError(f"a policy is 'drop' or 'forward', not {policy!r}")


@dataclass(frozen=True)
class Knowledge:
    """All that a verdict needs: where windows start, which are involved, and estimates by residue."""

    anchors: Lookup
    windows: Packed
    estimates: Packed


def tag(packets: DataFrame, anchors: Lookup, state: Lookup, settings: FilterSettings) -> DataFrame:
    """Add ``w``, ``mode`` and ``generation``, of any window."""
    windowed = with_window(packets, anchors, settings.window_us)
    return attach(windowed, state, ["link_id", "w"], "packet_id", settings.broadcast_rows)


def involved_windows(states: DataFrame) -> Packed:
    """QUERY windows and the learnt ones they are judged with, in blocks of 65,536 windows of a link.

    Every other window needs no lookup at all. A window takes eight bytes and a little more, and
    blocks without one have no row.
    """
    asked = states.where("mode").select("link_id", (F.col("generation") - 1).alias("generation")).distinct()
    needed = states.where(~F.col("mode")).join(asked, ["link_id", "generation"], "left_semi")
    rows = needed.select("link_id", "w", "generation", "mode").unionByName(
        states.where("mode").select("link_id", "w", "generation", "mode")
    )
    placed = rows.select(
        "link_id",
        F.shiftright("w", POSITION_BITS).alias("_block"),
        F.col("w").bitwiseAND((1 << POSITION_BITS) - 1).cast("int").alias("_at"),
        (F.col("generation") * 2 + F.col("mode").cast("int")).alias("_value"),
    )
    return Packed.measure(pack(placed, ["link_id", "_block"], "_at", "_value", "_windows"), ["_windows"])


def locate(
    packets: DataFrame, anchors: Lookup, windows: Packed, settings: FilterSettings
) -> DataFrame:
    """Add ``w``, and for packets of involved windows ``generation`` and ``mode``; no row is moved.

    Anchors and windows are broadcast. If they are more than the settings allow, ``packets`` is read
    once for every part of them.
    """
    starts = anchors.table.select("link_id", "anchor_us")
    out = attach_in_place(packets, starts, ["link_id"], -(-anchors.rows // BROADCAST_ROWS))
    w = window_number(F.col("ts"), F.col("anchor_us"), settings.window_us)
    out = out.withColumn("w", w).drop("anchor_us")
    out = out.withColumn("_block", F.shiftright("w", POSITION_BITS))
    parts = -(-windows.bytes // settings.broadcast_bytes)
    out = attach_in_place(out, windows.table, ["link_id", "_block"], parts)
    out = read(out, {"_found": ("_windows", F.col("w").bitwiseAND((1 << POSITION_BITS) - 1))})
    return out.withColumns(
        {"generation": F.shiftright("_found", 1), "mode": F.col("_found").bitwiseAND(1) == 1}
    ).drop("_block", "_windows", "_found")


def asked_residues(counts: DataFrame) -> DataFrame:
    """Packets of QUERY windows per residue, under the generation they ask."""
    return counts.where("mode").select(
        "link_id",
        (F.col("generation") - 1).alias("generation"),
        "dim",
        "residue",
        F.col("cnt").alias("packets"),
    )


def estimates_for(counts: DataFrame, shape: SketchShape) -> DataFrame:
    """Estimate per probed generation, dimension and residue.

    ``counts`` are the residue counts of learnt windows (``mode`` false) and of
    QUERY windows (``mode`` true). Generation ``g`` is asked by windows of ``g + 1``.
    """
    learnt = counts.where(~F.col("mode"))
    return estimate(learnt, asked_residues(counts), ["link_id", "generation", "dim"], shape)


def packed_estimates(counts: DataFrame, shape: SketchShape) -> Packed:
    """One row per link and asked generation, with the estimates of each dimension by residue."""
    found = estimates_for(counts, shape)
    by = ["link_id", "generation", "dim"]
    each = pack(found, by, "residue", "estimate").groupBy("link_id", "generation").agg(
        F.map_from_entries(F.collect_list(F.struct("dim", "packed"))).alias("_dims")
    )
    asked = asked_residues(counts).where(F.col("dim") == min(DIMENSIONS))
    weights = asked.groupBy("link_id", "generation").agg(F.sum("packets").alias("packets"))
    columns = {name: F.col("_dims")[dim].alias(name) for dim, name in DIMENSIONS.items()}
    rows = each.join(weights, ["link_id", "generation"]).select(
        "link_id", F.col("generation").alias("_read"), *columns.values(), "packets"
    )
    return Packed.measure(rows, list(columns), "packets")


def learn(packets: DataFrame, settings: FilterSettings) -> Knowledge:
    """Measure the windows and build what QUERY windows are judged with.

    Reads ``packets`` three times, a few columns each; the results are small.
    """
    anchors = link_anchors(packets)
    observed = settle(volumes(with_window(packets, anchors, settings.window_us)))
    windows = involved_windows(settle(window_state(observed, settings.volume_threshold)))
    located = locate(packets, anchors, windows, settings).where(F.col("mode").isNotNull())
    counts = settle(residue_counts(located, ["link_id", "generation", "mode"]))
    return Knowledge(anchors, windows, packed_estimates(counts, settings.shape))


def _score(rows: DataFrame) -> DataFrame:
    """Read the estimates of the three keys; a residue that was never counted has none."""
    residues = packet_residues()
    reads = {f"est_{name}": (name, residues[dim]) for dim, name in DIMENSIONS.items()}
    found = read(rows, reads).drop(*DIMENSIONS.values())
    zero = F.lit(0).cast("bigint")
    return found.withColumns({name: F.when(F.col("mode"), F.coalesce(name, zero)) for name in ESTIMATES})


def judged(tagged: DataFrame, estimates: Packed, settings: FilterSettings) -> DataFrame:
    """Estimates, score and ``pass`` of rows with ``mode`` and ``generation``.

    All three estimates of a generation are in one row, so packets meet them once. If the packed
    rows are too many to broadcast, packets of QUERY windows are moved once; a generation that very
    many packets ask is copied under several salts. Other packets stay where they are.
    """
    table = estimates.table.drop(estimates.weight)
    known = F.coalesce("mode", F.lit(False))
    asking = tagged.withColumns({"mode": known, "_read": F.when(known, F.col("generation") - 1)})
    if estimates.values <= settings.broadcast_rows and estimates.bytes <= settings.broadcast_bytes:
        scored = _score(asking.join(F.broadcast(table), ["link_id", "_read"], "left"))
    else:
        share = max(HOT_ROWS, -(-estimates.total // settings.broadcast_rows))
        copies = F.ceil(F.col(estimates.weight) / share).cast("int")
        hot = estimates.table.where(F.col(estimates.weight) > share).select(
            "link_id", "_read", copies.alias("_copies")
        )
        salted = estimates.table.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
        salt = F.pmod(F.xxhash64("packet_id"), F.coalesce("_copies", F.lit(1))).cast("int")
        queries = asking.where("mode").join(F.broadcast(hot), ["link_id", "_read"], "left")
        met = queries.withColumn("_salt", salt).drop("_copies").join(
            salted.drop(estimates.weight), ["link_id", "_read", "_salt"], "left"
        )
        scored = _score(met).drop("_salt")
        scored = scored.unionByName(asking.where(~F.col("mode")), allowMissingColumns=True)
    score = sum((F.col(name) for name in ESTIMATES[1:]), F.col(ESTIMATES[0]))
    return scored.withColumn("score", F.when(F.col("mode"), score)).withColumn(
        "pass", F.when(F.col("mode"), F.col("score") > settings.discard_threshold).otherwise(True)
    ).drop("generation", "_read")


def verdict_columns(packets: DataFrame, known: Knowledge, settings: FilterSettings) -> DataFrame:
    """Add window, mode, estimates, score and ``pass``; other columns are kept."""
    located = locate(packets, known.anchors, known.windows, settings)
    return judged(located, known.estimates, settings)


def judge(packets: DataFrame, settings: FilterSettings) -> DataFrame:
    """``verdicts``, one per packet. Estimates and score are NULL in UPDATE windows."""
    return verdict_columns(packets, learn(packets, settings), settings).select(*VERDICT)


def filter_frames(frames: DataFrame, settings: FilterSettings) -> DataFrame:
    """Whole frames that survive: judged ones by verdict, others by policy.

    Frames are read twice: for the narrow features, and to be let through. A frame is moved only if
    its window is in QUERY mode and the estimates are too many to broadcast, and then once.
    """
    narrow = stage(features(frames))
    known = learn(narrow, settings)
    kept = ["malformed"] * (settings.malformed_policy == "forward")
    kept += ["unknown"] * (settings.unknown_policy == "forward")
    wide = with_features(frames).where(F.col("packet_class").isin("judged", *kept))
    located = locate(wide, known.anchors, known.windows, settings)
    # Frames that are let through by policy ask nothing.
    asking = F.col("mode") & (F.col("packet_class") == "judged")
    survivors = judged(located.withColumn("mode", asking), known.estimates, settings)
    return survivors.where("pass").select(*frames.columns)


def filter_metrics(verdicts: DataFrame) -> DataFrame:
    """Inserts and queries asked for, packets in and out, per window."""
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return verdicts.groupBy("link_id", "w", "mode").agg(
        F.sum(F.when(F.col("mode"), zero).otherwise(one)).alias("inserts"),
        F.sum(F.when(F.col("mode"), one).otherwise(zero)).alias("queries"),
        F.count(F.lit(1)).alias("processed"),
        F.sum(F.col("pass").cast("bigint")).alias("output"),
    )


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """Packets learnt, passed and dropped per link and mode."""
    return verdicts.groupBy("link_id", "mode").agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum(F.col("pass").cast("bigint")).alias("passed"),
        F.sum((~F.col("pass")).cast("bigint")).alias("dropped"),
        F.coalesce(F.sum("score"), F.lit(0)).alias("score_sum"),
    )
