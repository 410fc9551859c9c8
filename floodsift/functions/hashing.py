"""Residues and hash rows.

Every hash row sees a key only through its residue modulo a 16-bit prime. Two
keys with equal residues therefore collide in every row; accuracy is bounded by
the number of residues, not by the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# The prime and the powers of two reduced by it.
PRIME = 65521
POW16 = 15  # 2**16 mod PRIME
POW32 = 225  # 2**32 mod PRIME
POW64 = 50625  # 2**64 mod PRIME

# The key pairs of the filter, by dimension number.
DIMENSIONS = {1: "sipdip", 2: "dportdip", 3: "siplen"}


@dataclass(frozen=True)
class SketchShape:
    """Rows, buckets per row, (a, b) of each row and optional counter width."""

    depth: int = 8
    width: int = 1 << 14
    hash_params: tuple[tuple[int, int], ...] | None = None
    counter_bits: int | None = None

    @property
    def rows(self) -> tuple[tuple[int, int], ...]:
        if self.hash_params is None:
            return tuple((row + 1, 0) for row in range(self.depth))
        if len(self.hash_params) != self.depth:
            raise ValueError("one (a, b) pair per row is needed")
        return tuple(self.hash_params)


def residue(x: Column) -> Column:
    """``x mod PRIME`` for a BIGINT that holds an unsigned value below 2**63."""
    return F.pmod(x, F.lit(PRIME).cast("bigint"))


def residue_unsigned(x: Column) -> Column:
    """``x mod PRIME`` where a negative BIGINT stands for the unsigned ``x + 2**64``."""
    return F.pmod(residue(x) + F.when(x < 0, POW64).otherwise(0), F.lit(PRIME).cast("bigint"))


def universal_hash(x_residue: Column, a: Column | int, b: Column | int) -> Column:
    return residue(x_residue * a + b)


def bucket(hashed: Column, width: int) -> Column:
    return F.pmod(hashed, F.lit(width).cast("bigint")).cast("int")


def key_residues(
    source_ip: Column, destination_ip: Column, destination_port: Column, total_length: Column
) -> dict[int, Column]:
    """Residues of the packed keys; the first part of a pair is the low bits.

    The 64-bit key itself would not fit a signed BIGINT and is never built.
    """
    return {
        1: residue(source_ip + destination_ip * POW32),
        2: residue(destination_port + destination_ip * POW16),
        3: residue(source_ip + total_length.cast("bigint") * POW32),
    }


def row_buckets(x_residue: Column, shape: SketchShape) -> Column:
    """ARRAY<STRUCT<row, bucket>>, one element per hash row."""
    return F.array(
        *[
            F.struct(
                F.lit(row).alias("row"),
                bucket(universal_hash(x_residue, a, b), shape.width).alias("bucket"),
            )
            for row, (a, b) in enumerate(shape.rows)
        ]
    )


def wrap_counter(count: Column, bits: int | None) -> Column:
    """A counter of ``bits`` bits wraps around; ``None`` keeps it exact."""
    if bits is None:
        return count
    return F.pmod(count, F.lit(1 << bits).cast("bigint"))
