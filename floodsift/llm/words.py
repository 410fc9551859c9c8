"""Words and word shingles as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` refers to it.

    Inside a lambda an inlined expression would be evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The runs of characters other than ASCII white space; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def shingle_hashes(word_array: Column, size: int) -> Column:
    """XXH64 (seed 42) of every run of ``size`` words joined by a space, repeats included.

    A shorter text is one shingle; a text without words has none.
    """

    def of(run: Column) -> Column:
        count = F.size(run)
        return (
            F.when(count == 0, F.array().cast("array<bigint>"))
            .when(count < size, F.array(F.xxhash64(F.array_join(run, " "))))
            .otherwise(
                F.transform(
                    F.sequence(F.lit(0), count - size),
                    lambda at: F.xxhash64(F.concat_ws(" ", *[F.get(run, at + k) for k in range(size)])),
                )
            )
        )

    return let(word_array, of)
