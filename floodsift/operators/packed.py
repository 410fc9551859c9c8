"""Values under positions of 16 bits, packed into one row and read by rank.

A row holds the sorted positions of a group as a bitmap of 1,024 words of 64 bits, of which only
the words with a bit are stored, and the values in the order of their positions. The place of a
value is the number of positions before it: the words before its word (a bitmap of 16 words says
which are stored), the values before that word, and the bits before its own. All of it is read by
index, inside generated code, so a lookup costs the same however many values a row has.

A value costs eight bytes and a stored word twelve, so a group with a few values stays small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from floodsift.session import settle

POSITION_BITS = 16
ROW_BYTES, WORD_BYTES, VALUE_BYTES = 256, 12, 8


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.bitwiseAND(63).cast("int"))


def pack(rows: DataFrame, by: Sequence[str], position: str, value: str, name: str = "packed") -> DataFrame:
    """One row per ``by`` with a struct ``name`` of its values (bigint) by position (0 to 65,535).

    ``by`` and ``position`` identify a row. A group is at most 65,536 rows, brought together as
    words of up to 64 values.
    """
    pairs = F.collect_list(F.struct(F.col(position).alias("at"), F.col(value).cast("bigint").alias("value")))
    words = rows.groupBy(*by, F.shiftright(position, 6).cast("int").alias("_word")).agg(
        F.bit_or(_bit(F.col(position))).alias("_bits"), F.sort_array(pairs).alias("_pairs")
    )
    before = Window.partitionBy(*by).orderBy("_word").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.size("_pairs")).over(before), F.lit(0)).cast("int")
    entries = words.withColumn("_first", first).groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("_word", "_bits", "_first", "_pairs"))).alias("_e")
    )
    zero = F.lit(0).cast("bigint")
    stored = F.transform("_e", lambda e: e["_word"])
    tops = F.sequence(F.lit(0), F.lit(15))
    top = F.transform(
        tops,
        lambda k: F.aggregate(
            stored, zero, lambda a, w: a.bitwiseOR(F.when(F.shiftright(w, 6) == k, _bit(w)).otherwise(zero))
        ),
    )
    packed = F.struct(
        top.alias("top"),
        F.transform(tops, lambda k: F.size(F.filter(stored, lambda w: F.shiftright(w, 6) < k))).alias("top_first"),
        F.transform("_e", lambda e: e["_bits"]).alias("words"),
        F.transform("_e", lambda e: e["_first"]).alias("first"),
        F.flatten(F.transform("_e", lambda e: F.transform(e["_pairs"], lambda p: p["value"]))).alias("values"),
    )
    return entries.select(*by, packed.alias(name))


def packed_bytes(packed: Column) -> Column:
    return F.lit(ROW_BYTES) + WORD_BYTES * F.size(packed["words"]) + VALUE_BYTES * F.size(packed["values"])


def read(rows: DataFrame, reads: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Add the value at a position, NULL where there is none: ``{name: (packed column, position)}``."""

    def below(bits: Column, at: Column) -> Column:
        lower = F.call_function("shiftleft", F.lit(-1).cast("bigint"), at.bitwiseAND(63).cast("int"))
        return F.bit_count(bits.bitwiseAND(F.bitwise_not(lower)))

    def is_set(bits: Column, at: Column) -> Column:
        return bits.bitwiseAND(_bit(at)) != 0

    word = lambda n: F.shiftright(F.col(f"_{n}_at"), 6)
    steps = [
        lambda n, p: {f"_{n}_at": reads[n][1].cast("int")},
        lambda n, p: {f"_{n}_top": F.get(p["top"], F.shiftright(word(n), 6))},
        lambda n, p: {
            f"_{n}_word": F.get(
                p["top_first"], F.shiftright(word(n), 6)
            ) + below(F.col(f"_{n}_top"), word(n))
        },
        lambda n, p: {f"_{n}_bits": F.get(p["words"], F.col(f"_{n}_word"))},
        lambda n, p: {
            n: F.when(
                is_set(F.col(f"_{n}_top"), word(n)) & is_set(F.col(f"_{n}_bits"), F.col(f"_{n}_at")),
                F.get(
                    p["values"],
                    F.get(p["first"], F.col(f"_{n}_word")) + below(F.col(f"_{n}_bits"), F.col(f"_{n}_at")),
                ),
            )
        },
    ]
    out = rows
    for step in steps:
        new = {}
        for name, (packed, _) in reads.items():
            new |= step(name, F.col(packed))
        out = out.withColumns(new)
    return out.drop(*[f"_{n}_{k}" for n in reads for k in ("at", "top", "word", "bits")])


@dataclass(frozen=True)
class Packed:
    """A settled table of packed rows, measured: rows, values, bytes, and the sum of a weight."""

    table: DataFrame
    weight: str | None
    values: int
    bytes: int
    total: int

    @staticmethod
    def measure(table: DataFrame, columns: Sequence[str], weight: str | None = None) -> Packed:
        table = settle(table)
        zero = F.lit(0)
        values = sum((F.coalesce(F.size(F.col(c)["values"]), zero) for c in columns), zero)
        size = sum((F.coalesce(packed_bytes(F.col(c)), zero) for c in columns), zero)
        found = table.agg(
            F.sum(values).alias("values"),
            F.sum(size).alias("bytes"),
            (F.sum(weight) if weight else F.lit(0)).alias("total"),
        ).first()
        return Packed(table, weight, found["values"] or 0, found["bytes"] or 0, found["total"] or 0)
