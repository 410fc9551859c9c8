"""Frames, 64-byte words and bus beats.

Words are put together in one exchange. A slice of a link is summed up without its payload: how many
packets end in it, and where the first one does. The words up to there belong to the packet that the
slice before left open, so they go with that slice, and every packet lies within one group. Groups
are sorted once, and packets are numbered and joined inside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from floodsift.functions.binary import be_int, cut, hex_of, zero_pad
from floodsift.operators import ordering
from floodsift.operators.lookup import BROADCAST_ROWS, attach_in_place
from floodsift.operators.ordering import scan
from floodsift.session import settle

WORD_BYTES = 64
LONGEST_PACKET = 1 << 16  # bytes; words of a packet beyond it are not held
# Bits of a beat's first byte.
SOP, EOP, EMPTY = 0x80, 0x40, 0x3F


def word_count(size: Column) -> Column:
    """Words of a frame of ``size`` bytes; an empty frame still has one."""
    return F.greatest(F.ceil(size / WORD_BYTES), F.lit(1)).cast("bigint")


def cut_words(frames: DataFrame, size: Column | None = None) -> DataFrame:
    """Cut ``frame`` into zero-padded words numbered ``word_no`` within the frame.

    ``size`` is the frame's length if it is known; then readers of the ends need no payload.
    """
    size = F.length("frame") if size is None else size
    words = frames.withColumns({"_size": size, "_words": word_count(size)}).withColumn(
        "word_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_words") - 1))
    )
    last = F.col("word_no") == F.col("_words") - 1
    rest = F.col("_size") - F.col("word_no") * WORD_BYTES
    return words.withColumns(
        {
            "data": zero_pad(cut(F.col("frame"), (F.col("word_no") * WORD_BYTES).cast("int"), WORD_BYTES), WORD_BYTES),
            "end_of_packet": last,
            "end_of_packet_len": F.when(last, rest.cast("int")).otherwise(0),
        }
    ).drop("frame", "_words", "_size")


def to_words(frames: DataFrame) -> DataFrame:
    """``words`` of all frames, in packet order, numbered by ``seq`` within each link."""
    numbered = scan(
        frames.select("link_id", "packet_id", "frame", F.length("frame").alias("_bytes")),
        ["link_id"],
        "packet_id",
        sums={"first_seq": word_count(F.col("_bytes"))},
        levels=None,
    )
    return (
        cut_words(numbered, F.col("_bytes"))
        .withColumn("seq", F.col("first_seq") + F.col("word_no"))
        .select("link_id", "seq", "packet_id", "word_no", "data", "end_of_packet", "end_of_packet_len")
    )


def packet_groups(words: DataFrame) -> DataFrame:
    """(link_id, _slice, ...) of every slice of words: what it says about the packets in it.

    ``_first_end``: where the first packet ends, if one does; ``_before``: packets that ended before
    the slice; ``_open``: the last slice before it in which one ended, -1 if none; ``_complete``:
    packets of the link that end at all. A row stands for up to 2**20 words.
    """
    ended = F.col("end_of_packet")
    slices = words.groupBy("link_id", F.shiftright("seq", ordering.SLICE_BITS).alias("_slice")).agg(
        F.sum(ended.cast("bigint")).alias("_ended"), F.min(F.when(ended, F.col("seq"))).alias("_first_end")
    )
    slices = settle(slices)
    scanned = scan(
        slices,
        ["link_id"],
        "_slice",
        sums={"_before": F.col("_ended")},
        lasts={"_open": F.when(F.col("_ended") > 0, F.col("_slice"))},
    )
    totals = slices.groupBy("link_id").agg(F.sum("_ended").alias("_complete"))
    return settle(
        scanned.join(totals, "link_id").withColumn("_open", F.coalesce("_open", F.lit(-1).cast("bigint"))).drop("_ended")
    )


def number_packets(words: DataFrame) -> DataFrame:
    """Add ``packet_no``, the ends of packets strictly before each word, ``word_at``, its place in
    the packet, and ``_group``, of which (link_id, _group) holds whole packets. Unfinished tails go.
    """
    slices = packet_groups(words)
    placed = words.withColumn("_slice", F.shiftright("seq", ordering.SLICE_BITS))
    placed = attach_in_place(placed, slices, ["link_id", "_slice"], -(-slices.count() // BROADCAST_ROWS))
    continued = F.coalesce(F.col("seq") <= F.col("_first_end"), F.lit(True))
    # The packets of a group are counted from the one after the first end in its slice.
    placed = placed.withColumns(
        {
            "_group": F.when(continued, F.col("_open")).otherwise(F.col("_slice")),
            "_base": F.col("_before") + F.when(continued, 0).otherwise(1),
        }
    )
    group = Window.partitionBy("link_id", "_group").orderBy("seq")
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    upto = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.coalesce(F.sum(F.col("end_of_packet").cast("bigint")).over(before), F.lit(0))
    start = F.coalesce(F.last(F.when(F.col("end_of_packet"), F.col("seq") + 1), True).over(before), F.first("seq").over(upto))
    numbered = placed.withColumns({"packet_no": F.first("_base").over(upto) + ended, "word_at": F.col("seq") - start})
    return numbered.where(F.col("packet_no") < F.col("_complete")).drop(
        "_slice", "_first_end", "_before", "_open", "_complete", "_base"
    )


def _whole_packets(words: DataFrame, longest: int, *more: Column) -> DataFrame:
    """One row per packet: ``frame``, NULL if it is longer than ``longest`` bytes, and ``frame_len``."""
    size = F.when(F.col("end_of_packet"), F.col("end_of_packet_len")).otherwise(WORD_BYTES)
    kept = F.when(
        F.col("end_of_packet"), F.substring("data", F.lit(1), F.col("end_of_packet_len"))
    ).otherwise(F.col("data"))
    held = F.when(F.col("word_at") * WORD_BYTES < longest, F.struct("seq", kept.alias("kept")))
    pieces = F.transform(F.array_sort(F.collect_list(held)), lambda w: w["kept"])
    length = F.sum(size.cast("bigint"))
    # Packets lie within a group, so this needs no exchange of its own.
    return number_packets(words).groupBy("link_id", "_group", "packet_no").agg(
        F.when(length <= longest, _join_binary(pieces)).alias("frame"), length.alias("frame_len"), *more
    ).drop("_group")


def _join_binary(pieces: Column) -> Column:
    return F.unhex(F.array_join(F.transform(pieces, F.hex), ""))


def to_frames(words: DataFrame, longest: int = LONGEST_PACKET) -> DataFrame:
    """Whole frames, numbered in order of arrival; the last word is cut at its length.

    A packet of more than ``longest`` bytes is reported: its frame is NULL, ``frame_len`` is its
    length, and its words beyond that are not held.
    """
    return _whole_packets(words, longest)


def realign(words: DataFrame, longest: int = LONGEST_PACKET) -> DataFrame:
    """Remove each packet's consumed prefix and re-cut the rest to full words.

    ``words`` carries a parser's ``octets_consumed`` (in 2-byte units),
    ``extract_range_end`` and ``error_drop``. Words before the one that ends the
    range are consumed whole. Packets in error give no output, nor do those of more
    than ``longest`` bytes, which :func:`oversized` lists.
    """
    ends = F.col("extract_range_end")
    packets = _whole_packets(
        words,
        longest,
        F.min(F.when(ends, F.col("word_at"))).alias("whole_words"),
        F.max(F.when(ends, F.col("octets_consumed"))).alias("octets"),
        F.max(F.when(ends, F.col("error_drop"))).alias("in_error"),
    )
    consumed = (F.col("whole_words") * WORD_BYTES + F.col("octets") * 2).cast("int")
    rest = packets.where(~F.col("in_error") & F.col("frame").isNotNull()).select(
        "link_id", "packet_no", cut(F.col("frame"), consumed, F.length("frame")).alias("frame")
    )
    return cut_words(rest)


def oversized(words: DataFrame, longest: int = LONGEST_PACKET) -> DataFrame:
    """(link_id, packet_no, bytes) of complete packets of more than ``longest`` bytes.

    Payload is not read: lengths follow from the places of the words that end packets.
    """
    narrow = words.select("link_id", "seq", "end_of_packet", "end_of_packet_len")
    size = F.col("word_at") * WORD_BYTES + F.col("end_of_packet_len")
    ends = number_packets(narrow).where("end_of_packet").select("link_id", "packet_no", size.alias("bytes"))
    return ends.where(F.col("bytes") > longest)


def decode_beats(beats: DataFrame) -> DataFrame:
    """Bus beats to words."""
    flags = be_int(F.col("beat"), 0, 1)
    eop = flags.bitwiseAND(EOP) != 0
    return beats.select(
        "link_id",
        "seq",
        cut(F.col("beat"), 1, WORD_BYTES).alias("data"),
        eop.alias("end_of_packet"),
        F.when(eop, F.lit(WORD_BYTES) - flags.bitwiseAND(EMPTY)).otherwise(0).alias("end_of_packet_len"),
    )


def encode_beats(words: DataFrame) -> DataFrame:
    """Words to bus beats; a word starts a packet when the one before it ended one."""
    chained = scan(words, ["link_id"], "seq", lasts={"ended": F.col("end_of_packet")})
    empty = F.when(
        F.col("end_of_packet"),
        (F.lit(WORD_BYTES) - F.col("end_of_packet_len")).bitwiseAND(EMPTY),
    ).otherwise(0)
    flags = (
        F.when(F.coalesce("ended", F.lit(True)), SOP).otherwise(0)
        + F.when(F.col("end_of_packet"), EOP).otherwise(0)
        + empty
    )
    return chained.select(
        "link_id", "seq", F.concat(F.unhex(hex_of(flags, 1)), F.col("data")).alias("beat")
    )
