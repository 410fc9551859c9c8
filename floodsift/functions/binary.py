"""Fields of binary columns, byte order, and IPv4 addresses as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Ethernet with one tag (18) + longest IPv4 header (60) + longest TCP header (60),
# rounded up to a whole 16-bit field beyond it.
HEAD_BYTES = 142


def _zero() -> Column:
    return F.unhex(F.lit("00"))


def as_column(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def zero_pad(data: Column, size: Column | int) -> Column:
    """Extend ``data`` on the right with zero bytes to exactly ``size`` bytes."""
    return F.rpad(data, as_column(size), _zero())


def padded_head(frame: Column) -> Column:
    """The header part of a frame; bytes past the end of a short frame read as zero."""
    return zero_pad(F.substring(frame, 1, HEAD_BYTES), HEAD_BYTES)


def cut(data: Column, offset: Column | int, size: Column | int) -> Column:
    """``size`` bytes from a zero-based ``offset``."""
    return F.substring(data, as_column(offset) + F.lit(1), as_column(size))


def be(data: Column, offset: Column | int, size: int) -> Column:
    """Unsigned big-endian integer of up to 7 bytes at a zero-based byte offset."""
    return F.conv(F.hex(cut(data, offset, size)), 16, 10).cast("bigint")


def be_int(data: Column, offset: Column | int, size: int) -> Column:
    """Like :func:`be` for fields of at most 16 bits."""
    return be(data, offset, size).cast("int")


def hex_of(value: Column, size: int) -> Column:
    """Fixed-width hexadecimal text of a non-negative integer, ``size`` bytes long."""
    return F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")


def swap_bytes(data: Column) -> Column:
    """The bytes of ``data`` in reverse order."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))
    return F.unhex(F.array_join(F.reverse(pairs), ""))


def ip_to_long(text: Column) -> Column:
    part = F.split(text, r"\.")
    value = F.lit(0).cast("bigint")
    for position in range(4):
        value = value * 256 + F.get(part, F.lit(position)).cast("bigint")
    return value


def long_to_ip(value: Column) -> Column:
    parts = [F.shiftright(value, shift).bitwiseAND(255).cast("string") for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *parts)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP."""
    return F.unix_micros(ts)
