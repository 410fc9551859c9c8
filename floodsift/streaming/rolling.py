"""The volume-gated filter on a stream of packets, as a ``foreachBatch`` sink.

The mode of a window is known once the window before it has closed, and so is everything it is
judged with. Packets of such windows are judged, or learnt and passed, in the batch they come in;
only packets of windows that lie further ahead wait, for no longer than the lateness. What is
carried from batch to batch is small: a row per link, volumes of open windows, the residue counts of
generations that can still be asked, and the packets that wait.

A batch reads the state the batch before it wrote and writes its own to the other of two slots, so
nothing piles up, and a repeated batch finds its input unchanged. Verdicts, late packets and frames
forwarded by policy are one write; the number of the batch, written last, commits it. Readers
leave out batches that are not committed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from floodsift.functions.binary import micros
from floodsift.operators.controller import ESTIMATES, FilterSettings, judged, packed_estimates
from floodsift.operators.decode import with_features
from floodsift.operators.lookup import Lookup, attach, measure
from floodsift.operators.ordering import SPINE_BITS, spine
from floodsift.operators.sketch import residue_counts
from floodsift.operators.volume import volumes, window_number, window_state
from floodsift.schemas import FRAMES
from floodsift.session import settle

LINKS = (
    "link_id string, anchor_us bigint, latest_us bigint, closed_w bigint, "
    "quiet bigint, closed_over boolean, closed_overs bigint"
)
COUNTS = "link_id string, generation bigint, mode boolean, dim int, residue bigint, cnt bigint"
VOLUMES = "link_id string, w bigint, volume bigint, packets bigint"
DONE = "batch bigint"
TABLES = {"links": LINKS, "counts": COUNTS, "volumes": VOLUMES, "done": DONE}
WINDOWS = "link_id string, w bigint, volume bigint, packets bigint, over boolean, mode boolean, generation bigint"
VERDICT_COLUMNS = "mode boolean, " + ", ".join(f"{e} bigint" for e in ESTIMATES) + ", score bigint, pass boolean"


@dataclass
class RollingFilter:
    """``folder`` must be shared by all executors.

    Every link closes its windows by its own clock, so a link whose clock is ahead has no say
    elsewhere. A link is anchored at the first packet of the first batch that has one; an earlier
    packet that comes in a later batch is late. A link without packets in ``idle_batches`` batches
    in a row has its open windows closed. ``jump_us`` bounds by how much a batch may put a link's
    clock forward, so that a single wrong time cannot close the windows of the packets that follow
    it. ``late_policy`` says whether packets of closed windows are forwarded or dropped; they are
    kept apart in either case.
    """

    folder: str
    settings: FilterSettings
    lateness_us: int = 0
    idle_batches: int = 10
    jump_us: int | None = None
    late_policy: str = "forward"

    def __post_init__(self) -> None:
        if self.settings.volume_threshold is None:
            raise ValueError("a stream needs a fixed volume threshold")
        if self.late_policy not in ("drop", "forward"):
            raise ValueError(f"a policy is 'drop' or 'forward', not {self.late_policy!r}")

    # --- stored tables ---

    def _slot(self, table: str, batch_id: int) -> str:
        return f"{self.folder}/{table}/slot={batch_id % 2}"

    def _state(self, spark: SparkSession, table: str, batch_id: int, schema: T.StructType | str | None = None) -> DataFrame:
        """State after ``batch_id``; empty before the first batch."""
        schema = schema or TABLES[table]
        if batch_id < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self._slot(table, batch_id))

    def _keep(self, df: DataFrame, table: str, batch_id: int) -> None:
        columns = T.StructType.fromDDL(TABLES[table]).names if table in TABLES else df.columns
        df.select(*columns).write.mode("overwrite").parquet(self._slot(table, batch_id))

    def _out(self, spark: SparkSession, kind: str) -> DataFrame:
        """Rows of ``kind`` from all committed batches."""
        done = self._committed(spark)
        waiting = spark.read.parquet(self._slot("waiting", done)).schema
        names = {f.name for f in waiting.fields}
        more = [f for f in T.StructType.fromDDL(f"{VERDICT_COLUMNS}, batch bigint, kind string") if f.name not in names]
        found = spark.read.schema(T.StructType([*waiting.fields, *more])).parquet(f"{self.folder}/out")
        return found.where((F.col("batch") <= done) & (F.col("kind") == kind)).drop("batch", "kind")

    def _committed(self, spark: SparkSession) -> int:
        return spark.read.schema(DONE).parquet(f"{self.folder}/done").agg(F.max("batch")).first()[0]

    def verdicts(self, spark: SparkSession) -> DataFrame:
        """Judged packets with all their columns."""
        return self._out(spark, "verdict")

    def late_packets(self, spark: SparkSession) -> DataFrame:
        """Packets of windows that had closed; not judged."""
        return self._out(spark, "late").drop(*T.StructType.fromDDL(VERDICT_COLUMNS).names)

    def surviving_frames(self, spark: SparkSession) -> DataFrame:
        """Frames let through: judged ones, and those forwarded by policy."""
        parts = [self._out(spark, "verdict").where("pass"), self._out(spark, "forwarded")]
        if self.late_policy == "forward":
            parts.append(self._out(spark, "late"))
        first, *rest = [part.select(*FRAMES.names) for part in parts]
        for part in rest:
            first = first.unionByName(part)
        return first

    def windows(self, spark: SparkSession) -> DataFrame:
        """Every closed window, idle ones with volume 0."""
        found = spark.read.schema(f"{WINDOWS}, batch bigint").parquet(f"{self.folder}/windows")
        return found.where(F.col("batch") <= self._committed(spark)).drop("batch")

    # --- one batch ---

    def frames(self, batch: DataFrame, batch_id: int, close_all: bool = False) -> None:
        """Like a call, for a stream of raw frames."""
        wide = with_features(batch).persist(StorageLevel.MEMORY_AND_DISK)
        policies = {
            "malformed": self.settings.malformed_policy, "unknown": self.settings.unknown_policy
        }
        forwarded = [name for name, policy in policies.items() if policy == "forward"]
        others = wide.where(F.col("packet_class").isin(forwarded)).drop("packet_class")
        try:
            judged_too = wide.where("packet_class = 'judged'").drop("packet_class")
            self._advance(judged_too, batch_id, close_all, others)
        finally:
            wide.unpersist()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        held = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self._advance(held, batch_id, close_all=False)
        finally:
            held.unpersist()

    def drain(self, packets: DataFrame, batch_id: int) -> None:
        """Take the rest of a finite stream as batch ``batch_id`` and close every window."""
        self._advance(packets, batch_id, close_all=True)

    def _advance(self, batch: DataFrame, batch_id: int, close_all: bool, others: DataFrame | None = None) -> None:
        spark, before = batch.sparkSession, batch_id - 1
        links = self._met_links(batch, self._state(spark, "links", before))
        edges = Lookup(
            links.table.select("link_id", "anchor_us", "closed_w", "packets"),
            "packets", links.rows, links.total,
        )
        w = window_number(F.col("ts"), F.col("anchor_us"), self.settings.window_us)
        numbered = attach(batch, edges, ["link_id"], "packet_id").withColumn("w", w)
        late = numbered.where("w <= closed_w").drop("anchor_us", "closed_w")
        fresh = numbered.where("w > closed_w").drop("anchor_us", "closed_w")

        known = self._state(spark, "volumes", before).unionByName(volumes(fresh))
        open_windows = settle(
            known.groupBy("link_id", "w").agg(F.sum("volume").alias("volume"), F.sum("packets").alias("packets"))
        )
        lines = settle(self._closing_lines(links.table, open_windows, close_all))
        closed = self._closed_windows(open_windows, lines, links)
        links_now = self._moved_links(lines, closed)
        decided = self._decided(open_windows, closed, links_now)

        arrivals = self._state(spark, "waiting", before, fresh.schema).unionByName(fresh)
        tagged = attach(arrivals, decided, ["link_id", "w"], "packet_id", self.settings.broadcast_rows)
        ready = tagged.where(F.col("mode").isNotNull())
        counts = self._state(spark, "counts", before).unionByName(
            residue_counts(ready, ["link_id", "generation", "mode"])
        )
        if decided.table.where("mode").isEmpty():
            verdicts = ready.drop("generation").withColumn("pass", F.lit(True))
        else:
            counts = settle(counts)
            verdicts = judged(ready, packed_estimates(counts, self.settings.shape), self.settings)

        out = verdicts.withColumn("kind", F.lit("verdict"))
        out = out.unionByName(late.withColumn("kind", F.lit("late")), allowMissingColumns=True)
        if others is not None:
            out = out.unionByName(others.withColumn("kind", F.lit("forwarded")), allowMissingColumns=True)
        out.write.mode("overwrite").partitionBy("kind").parquet(f"{self.folder}/out/batch={batch_id}")
        columns = T.StructType.fromDDL(WINDOWS).names
        closed.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/windows/batch={batch_id}")

        self._keep(tagged.where(F.col("mode").isNull()).select(*fresh.columns), "waiting", batch_id)
        self._keep(links_now, "links", batch_id)
        still = open_windows.join(links_now.select("link_id", "closed_w"), "link_id").where("w > closed_w")
        self._keep(still, "volumes", batch_id)
        self._keep(self._askable(counts, links_now), "counts", batch_id)
        self._keep(spark.createDataFrame([(batch_id,)], DONE), "done", batch_id)

    def _met_links(self, batch: DataFrame, known: DataFrame) -> Lookup:
        """All links so far; a new one is anchored at its first packet."""
        met = batch.groupBy("link_id").agg(
            F.min(micros(F.col("ts"))).alias("first_us"),
            F.max(micros(F.col("ts"))).alias("last_us"),
            F.count(F.lit(1)).alias("packets"),
        )
        furthest = F.col("last_us")
        if self.jump_us is not None:
            furthest = F.least(furthest, F.coalesce("latest_us", "first_us") + self.jump_us)
        merged = known.join(met, "link_id", "full").select(
            "link_id",
            F.coalesce("anchor_us", "first_us").alias("anchor_us"),
            F.greatest("latest_us", furthest).alias("latest_us"),
            F.when(F.col("packets") > 0, 0).otherwise(F.col("quiet") + 1).cast("bigint").alias("quiet"),
            F.coalesce("closed_w", F.lit(-1).cast("bigint")).alias("closed_w"),
            F.coalesce("closed_over", F.lit(False)).alias("closed_over"),
            F.coalesce("closed_overs", F.lit(0).cast("bigint")).alias("closed_overs"),
            F.coalesce("packets", F.lit(0).cast("bigint")).alias("packets"),
        )
        return measure(merged, "packets")

    def _closing_lines(self, links: DataFrame, open_windows: DataFrame, close_all: bool) -> DataFrame:
        """Add ``line``, the last window of each link that is closed now, empty or not."""
        ends = open_windows.groupBy("link_id").agg(F.max("w").alias("end_w"))
        lined = links.join(ends, "link_id", "left")
        if close_all:
            line = F.col("end_w")
        else:
            since = F.col("latest_us") - self.lateness_us - F.col("anchor_us")
            size = F.lit(self.settings.window_us).cast("bigint")
            by_clock = ((since - F.pmod(since, size)) / size).cast("bigint") - 1
            line = F.when(F.col("quiet") >= self.idle_batches, F.greatest("end_w", by_clock)).otherwise(by_clock)
        lined = lined.withColumn("line", line).drop("end_w")
        return lined.withColumn("line", F.greatest("line", "closed_w"))

    def _closed_windows(self, open_windows: DataFrame, lines: DataFrame, links: Lookup) -> DataFrame:
        """State of every window between the old and the new line, idle ones too."""
        span = F.col("line") - F.col("closed_w")
        most = lines.agg(F.max(span)).first()[0] or 0
        moved = lines.where(span > 0)
        if most <= 1 << SPINE_BITS:
            every = moved.select("link_id", F.explode(F.sequence(F.col("closed_w") + 1, F.col("line"))).alias("w"))
        else:
            starts = moved.select("link_id", (F.col("closed_w") + 1).alias("_first"), (span - 1).alias("_last"))
            every = spine(starts, ["link_id"], "_last", "_n").join(starts, "link_id")
            every = every.select("link_id", (F.col("_first") + F.col("_n")).alias("w"))
        filled = every.join(open_windows, ["link_id", "w"], "left").fillna(0, ["volume", "packets"])
        earlier = lines.select(
            "link_id",
            F.col("closed_w").alias("earlier_w"),
            F.col("closed_over").alias("earlier_over"),
            F.col("closed_overs").alias("earlier_overs"),
            "packets",
        )
        known = Lookup(earlier, "packets", links.rows, links.total)
        levels = 1 if most <= 1 << SPINE_BITS else 0
        return settle(window_state(filled, self.settings.volume_threshold, known, levels))

    def _moved_links(self, lines: DataFrame, closed: DataFrame) -> DataFrame:
        news = closed.groupBy("link_id").agg(
            F.max_by("over", "w").alias("over"), F.sum(F.col("over").cast("bigint")).alias("overs")
        )
        return settle(
            lines.join(news, "link_id", "left").select(
                "link_id",
                "anchor_us",
                "latest_us",
                F.col("line").alias("closed_w"),
                "quiet",
                F.coalesce("over", "closed_over").alias("closed_over"),
                (F.col("closed_overs") + F.coalesce("overs", F.lit(0))).alias("closed_overs"),
            )
        )

    def _decided(self, open_windows: DataFrame, closed: DataFrame, links: DataFrame) -> Lookup:
        """Mode and generation of the windows closed now and of the first open one of each link."""
        columns = ["link_id", "w", "mode", "generation", "packets"]
        following = links.select(
            "link_id",
            (F.col("closed_w") + 1).alias("w"),
            F.col("closed_over").alias("mode"),
            (F.col("closed_w") + 1 - F.col("closed_overs")).alias("generation"),
        ).join(open_windows.select("link_id", "w", "packets"), ["link_id", "w"], "left")
        held = closed.where("packets > 0").select(*columns)
        return measure(held.unionByName(following.fillna(0, ["packets"]).select(*columns)), "packets")

    @staticmethod
    def _askable(counts: DataFrame, links: DataFrame) -> DataFrame:
        """Learnt counts of the generation of the first open window, and of the one it may ask."""
        following = links.select(
            "link_id", (F.col("closed_w") + 1 - F.col("closed_overs")).alias("next_generation")
        )
        return (
            counts.where(~F.col("mode"))
            .join(following, "link_id")
            .where(F.col("generation") >= F.col("next_generation") - 1)
            .groupBy("link_id", "generation", "mode", "dim", "residue")
            .agg(F.sum("cnt").alias("cnt"))
        )
