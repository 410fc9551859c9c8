"""Importance resampling towards a target: weights from two tables of counts, drawn by a radix sort.

Features are runs of words, hashed into a fixed number of buckets. A bucket's gain is the log of
its smoothed frequency in the target over that in the documents, and the gains are an array that
every task reads by position. A document's weight is the sum over its features; Gumbel noise from a
hash of its id turns the largest scores into a draw without replacement.

The draw needs ranks. They come from a radix sort, least significant digit first: a pass counts
rows per digit and block, adds the counts up in the order of (digit, block), and sends every row
to its place, the start of its (digit, block) plus its rank there in the order so far. No pass
compares keys, samples them or needs an order of the whole table in one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from floodsift.session import stage

BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
CACHED_FEATURES = 500_000  # buckets remembered by a worker; all are forgotten when there are more
DIGIT_BITS = 12
BLOCK_BITS = 20  # a block is 2**20 places, so a group of a pass has at most as many rows
_SIGN = -(1 << 63)

# Upper case becomes lower case; digits, letters and bytes beyond ASCII stay; the rest is a blank.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


class _Buckets(dict):
    """Feature to bucket, worked out once."""

    def __init__(self, count: int):
        super().__init__()
        self.count = count

    def __missing__(self, feature: bytes) -> int:
        found = self[feature] = zlib.crc32(feature) % self.count
        return found


def _features(text: str | None, runs: tuple[int, int]) -> tuple[int, list[bytes]]:
    """Number of words, and all runs of ``runs`` consecutive words joined by a space."""
    words = (text or "").encode().translate(_WORD_BYTES).split()
    if runs == (1, 1):
        return len(words), words
    return len(words), [
        b" ".join(words[at : at + n])
        for n in range(runs[0], runs[1] + 1)
        for at in range(len(words) - n + 1)
    ]


def _bucketed(batches, column: int, runs: tuple[int, int], buckets: int):
    """(batch, row, number of words, buckets of its features) of every row."""
    known = _Buckets(buckets)
    for batch in batches:
        for row, text in enumerate(batch.column(column)):
            words, features = _features(text.as_py(), runs)
            yield batch, row, words, np.fromiter(map(known.__getitem__, features), np.int64, len(features))
            if len(known) > CACHED_FEATURES:
                known.clear()


def bucket_counts(
    docs: DataFrame, buckets: int = BUCKETS, runs: tuple[int, int] = (1, 1), text: str = "text"
) -> DataFrame:
    """(bucket, features) over all texts; buckets without features are left out."""

    def work(batches):
        total, held, size = np.zeros(buckets, np.int64), [], 0
        for _, _, _, found in _bucketed(batches, 0, runs, buckets):
            held.append(found)
            size += len(found)
            if size > 20 * buckets:
                total += np.bincount(np.concatenate(held), minlength=buckets)
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "features"])

    counted = docs.select(text).mapInArrow(work, "bucket long, features long")
    return counted.groupBy("bucket").agg(F.sum("features").alias("features"))


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed frequency in the target over that in the documents."""
    size = len(docs)
    more = (target + 1.0) * (float(docs.sum()) + size)
    less = (docs + 1.0) * (float(target.sum()) + size)
    return np.array([math.floor(1000 * math.log(a / b)) for a, b in zip(more, less)], np.int64)


def _array(counts: DataFrame, buckets: int) -> np.ndarray:
    """The counts as an array; at most ``buckets`` rows reach the driver."""
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row["bucket"]] = row["features"]
    return out


def weigh(
    docs: DataFrame,
    array: np.ndarray,
    key: str = "doc_id",
    runs: tuple[int, int] = (1, 1),
    text: str = "text",
) -> DataFrame:
    """(key, n_words, n_features, weight) of every row; a text without features weighs nothing."""

    def work(batches):
        out, last = [], None
        for batch, row, words, found in _bucketed(batches, 1, runs, len(array)):
            if last is not None and batch is not last:
                yield made(last, out)
                out = []
            out.append((words, len(found), int(array[found].sum())))
            last = batch
        if last is not None:
            yield made(last, out)

    def made(batch, out):
        columns = [pa.array(c, pa.int64()) for c in zip(*out)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *columns], names=[key, "n_words", "n_features", "weight"]
        )

    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, n_words long, n_features long, weight long"
    return docs.select(key, text).mapInArrow(work, schema)


def noise(key: str, seed: int = SEED) -> Column:
    """floor(1000 times a Gumbel variate) from 32 bits of a hash of the key; a null key counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))


def radix_ranks(rows: DataFrame, keys: Sequence[tuple[str, bool]], name: str = "rank") -> DataFrame:
    """Add the place of every row, from 0, in the order of long columns ``keys`` of (column, descending).

    Nulls come last. Rows equal in all keys take neighbouring places. Digits that are the same in
    all rows, found by one aggregate, cost no pass. The table is written once a pass, so ``rows``
    should be narrow; a block of a pass has at most 2**20 rows, or those of one task in the first.
    """
    names = rows.columns
    coded = []
    for k, (column, descending) in enumerate(keys):
        # As unsigned numbers the codes have the order of the values.
        value = F.col(column).cast("bigint").bitwiseXOR(F.lit(_SIGN))
        coded += [
            F.when(F.col(column).isNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias(f"_null{k}"),
            F.coalesce(F.bitwise_not(value) if descending else value, F.lit(0).cast("bigint")).alias(f"_key{k}"),
        ]
    order = [f"_{kind}{k}" for k in range(len(keys)) for kind in ("null", "key")]
    placed = stage(rows.select("*", *coded, F.monotonically_increasing_id().alias("_at")))
    seen = placed.agg(
        *[f(c).alias(f"{f.__name__}{c}") for c in order for f in (F.bit_or, F.bit_and)]
    ).first()
    shift_of_block = 33  # monotonically_increasing_id keeps the task above these bits
    for column in reversed(order):
        if seen[f"bit_or{column}"] is None:
            break
        varying = (seen[f"bit_or{column}"] ^ seen[f"bit_and{column}"]) & ((1 << 64) - 1)
        if not varying:
            continue
        low, high = (varying & -varying).bit_length() - 1, varying.bit_length()
        passes = -(-(high - low) // DIGIT_BITS)
        width = -(-(high - low) // passes)
        for shift in range(low, high, width):
            if varying >> shift & ((1 << width) - 1):
                placed = stage(_pass(placed, column, shift, width, shift_of_block))
                shift_of_block = BLOCK_BITS
    if shift_of_block == 33:  # no pass: all keys are equal, and any order of the rows will do
        placed = stage(_pass(placed, order[0], 0, 1, shift_of_block))
    return placed.select(*names, F.col("_at").alias(name))


def _pass(rows: DataFrame, column: str, shift: int, width: int, shift_of_block: int) -> DataFrame:
    """One stable counting sort: the rows with ``_at`` replaced by their next place."""
    digit = F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
    dealt = rows.withColumns({"_digit": digit, "_block": F.shiftrightunsigned("_at", shift_of_block)})
    counts = dealt.groupBy("_digit", "_block").agg(F.count(F.lit(1)).alias("_n"))
    # The digits are at most 2**DIGIT_BITS rows; the blocks of a digit are summed in its own group.
    digits = counts.groupBy("_digit").agg(F.sum("_n").alias("_n"))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = digits.select("_digit", earlier(Window.orderBy("_digit")).alias("_base"))
    starts = counts.select(
        "_digit", "_block", earlier(Window.partitionBy("_digit").orderBy("_block")).alias("_start")
    ).join(F.broadcast(bases), "_digit").select("_digit", "_block", (F.col("_base") + F.col("_start")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_digit", "_block").orderBy("_at")) - 1
    ranked = dealt.withColumn("_within", within).join(starts, ["_digit", "_block"])
    place = (F.col("_start") + F.col("_within")).alias("_at")
    return ranked.select(*[c for c in rows.columns if c != "_at"], place)


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    runs: tuple[int, int] = (1, 1),
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank): one row for each row of ``docs``.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred are drawn, those with
    the highest scores, ties to the smaller key; ``rank`` counts them from 1 and is null elsewhere.
    A null text is empty. A null key hashes as an empty one and comes after others in ties; rows
    that share a key share the noise, and among equal scores of one key any order may come out.
    Empty tables give no rows (documents) or equal frequencies (target). Other columns of either
    table are not looked at.
    """
    counted = [_array(bucket_counts(t, buckets, runs), buckets) for t in (docs, target)]
    scored = weigh(docs, gains(*counted), key, runs)
    scored = stage(scored.withColumn("score", F.col("weight") + noise(key, seed)))
    eligible = F.col("n_words") >= least_words
    drawn = scored.where(eligible).count() * percent // 100
    ranked = radix_ranks(scored.where(eligible), [("score", True), (key, False)], "_place")
    rank = F.when(F.col("_place") < drawn, F.col("_place") + 1).cast("bigint").alias("rank")
    names = scored.columns
    rest = scored.where(~eligible).select(*names, F.lit(None).cast("bigint").alias("rank"))
    return ranked.select(*names, rank).unionByName(rest)
