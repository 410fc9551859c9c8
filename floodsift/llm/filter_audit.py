"""What filters remove, alone, together and in every order.

Documents are counted per part and mask of failed filters: at most ``2**k`` cells a part. A walk in
Gray-code order then visits every set of filters by toggling one at a time. Each mask keeps a
counter of the active filters it fails; when the counter leaves or reaches zero, the cell leaves or
rejoins the running survivors, which are stored as the state of the set. A step of any order of the
filters is the difference of two states.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from floodsift.llm.words import let, words

MOST_FILTERS = 6  # 720 orders of 6 steps a part
MEASURES = ("docs", "good", "toxic")


def quality_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D; null is an empty text. A word is a run of other than ASCII blanks."""
    text = F.coalesce(text, F.lit(""))
    found = let(words(text), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("own")))
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": found["all"] < 50,
        "B": F.lit(100).cast("bigint") * found["own"] < F.lit(65).cast("bigint") * found["all"],
        "C": F.lit(100).cast("bigint") * capitals > F.lit(5).cast("bigint") * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def cells(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Column],
    copies: str | None = None,
    part: str = "source",
) -> DataFrame:
    """(part, mask, docs, good, toxic): documents per part and set of failed filters.

    Bit ``k`` of the mask is the ``k``-th of ``filters``, and the last that of ``copies``, the
    filter failed by a text that a document with a smaller id has anywhere in the table. A null
    part is an empty string. A document without an id is neither a copy nor the original of one,
    and has no labels. Of several labels of an id any 1 counts. Repeated rows count each.

    Equal texts meet as counts: a text that very many documents share is added up before it is
    shuffled, per part and labels, and what meets in one task is those sums.
    """
    mask = sum(
        (F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)) for k, failed in enumerate(filters.values())), F.lit(0)
    )
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        mask.alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("_text"),
        # Rows without an id join nothing; they are dealt by their text.
        F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("bigint")).alias("_deal"),
    )
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"),
    )
    marked = rows.join(marks.withColumn("_deal", F.lit(0).cast("bigint")), ["_id", "_deal"], "left").fillna(
        0, ["_good", "_toxic"]
    )
    kind = ["part", "mask", "_good", "_toxic"]
    count = F.count(F.lit(1)).alias("_n")
    if copies is None:
        counted = marked.groupBy(*kind).agg(count)
    else:
        counted = _with_copies(marked, kind, count, 1 << len(filters))
    return counted.groupBy("part", "mask").agg(
        F.sum("_n").alias("docs"),
        F.sum(F.col("_n") * F.col("_good")).alias("good"),
        F.sum(F.col("_n") * F.col("_toxic")).alias("toxic"),
    )


def _with_copies(marked: DataFrame, kind: list[str], count: Column, bit: int) -> DataFrame:
    """Counts per ``kind``, with ``bit`` set for the rows that repeat the text of a smaller id."""
    rows = marked.groupBy("_id", "_deal", "_text", *kind).agg(count)
    known = F.col("_id").isNotNull()
    zero = F.lit(0).cast("bigint")
    groups = rows.groupBy("_text", *kind).agg(
        F.sum("_n").alias("_n"),
        F.sum(F.when(known, zero).otherwise(F.col("_n"))).alias("_unknown"),
        F.min(F.when(known, F.struct("_id", "_n"))).alias("_least"),
    )
    first = F.min("_least._id").over(Window.partitionBy("_text"))
    originals = F.when(F.col("_least._id") == F.col("_first"), F.col("_least._n")).otherwise(zero)
    split = groups.withColumn("_first", first).select(
        *kind, "_n", (F.col("_unknown") + F.coalesce(originals, zero)).alias("_kept")
    )
    either = F.array(
        F.struct(F.col("mask"), F.col("_kept").alias("_n")),
        F.struct((F.col("mask") + F.lit(bit)).alias("mask"), (F.col("_n") - F.col("_kept")).alias("_n")),
    )
    others = [c for c in kind if c != "mask"]
    return split.select(*others, F.inline(either)).where(F.col("_n") > 0)


def walk(table: np.ndarray) -> np.ndarray:
    """Survivors of every set of filters, from ``(parts, 2**k masks, measures)`` counts."""
    parts, size, measures = table.shape
    masks = np.arange(size)
    active = np.zeros(size, np.int64)  # of each mask: how many active filters it fails
    running = table.sum(axis=1)
    states = np.empty_like(table)
    states[:, 0] = running
    chosen = 0
    for step in range(1, size):
        toggled = step & -step  # the bit in which Gray codes step - 1 and step differ
        chosen ^= toggled
        fails = (masks & toggled) != 0
        if chosen & toggled:
            active[fails] += 1
            running = running - table[:, fails & (active == 1)].sum(axis=1)
        else:
            active[fails] -= 1
            running = running + table[:, fails & (active == 0)].sum(axis=1)
        states[:, chosen] = running
    return states


def subset_states(counted: DataFrame, filters: Sequence[str]) -> DataFrame:
    """(part, states): for each part the survivors of all ``2**k`` sets, as rows of MEASURES by mask."""
    size = _size(filters)
    held = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("_cells"))

    def work(batches):
        for batch in batches:
            lists = batch.column(1)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            columns = [c.to_numpy(zero_copy_only=False) for c in flat.flatten()]
            table = np.zeros((batch.num_rows, size, len(MEASURES)), np.int64)
            for k, values in enumerate(columns[1:]):
                np.add.at(table[:, :, k], (owner, columns[0]), values)
            flat = walk(table).reshape(batch.num_rows, -1)
            out = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), size * len(MEASURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), out.cast(pa.list_(pa.int64()))], names=["part", "states"]
            )

    return held.mapInArrow(work, "part string, states array<long>")


def _size(filters: Sequence[str]) -> int:
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"{len(filters)} filters have too many orders; at most {MOST_FILTERS}")
    return 1 << len(filters)


def steps(states: DataFrame, filters: Sequence[str]) -> DataFrame:
    """One row per part, order of all filters and step, as differences of the states.

    kept, removed: after and at the step; redundant: fail its filter but were removed earlier;
    unique_fails: fail no other filter; good_lost, toxic_lost: removed here with that label;
    shapley: removed by its filter, summed over all orders.
    """
    k, size = len(filters), _size(filters)
    orders = list(permutations(range(k)))
    names = ["".join(filters[f] for f in order) for order in orders for _ in range(k)]
    filter_of = np.array(orders).reshape(-1)
    bits = 1 << np.array(orders)
    after = np.cumsum(bits, axis=1).reshape(-1)
    before = after - bits.reshape(-1)
    full = size - 1
    # How many orders put exactly the set s before a given filter outside it.
    ways = np.array([factorial(s.bit_count()) * factorial(max(k - 1 - s.bit_count(), 0)) for s in range(size)])

    def work(batches):
        for batch in batches:
            parts = batch.num_rows
            s = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(parts, size, len(MEASURES))
            docs = s[:, :, 0]
            alone = np.stack([docs[:, 0] - docs[:, 1 << f] for f in range(k)], 1)
            unique = np.stack([docs[:, full ^ (1 << f)] - docs[:, full] for f in range(k)], 1)
            shapley = np.zeros((parts, k), np.int64)
            for f in range(k):
                without = [x for x in range(size) if not x >> f & 1]
                lost = docs[:, without] - docs[:, [x | 1 << f for x in without]]
                shapley[:, f] = lost @ ways[without]
            lost = s[:, before] - s[:, after]
            columns = [
                docs[:, after],
                lost[:, :, 0],
                alone[:, filter_of] - lost[:, :, 0],
                unique[:, filter_of],
                lost[:, :, 1],
                lost[:, :, 2],
                shapley[:, filter_of],
            ]
            step = np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))
            for p in range(parts):
                keys = [pa.repeat(batch.column(0)[p], len(names)), pa.array(names), pa.array(step)]
                yield pa.RecordBatch.from_arrays(
                    [*keys, *[pa.array(np.ascontiguousarray(c[p])) for c in columns]],
                    names=["part", "filter_order", "step", *_COUNTS],
                )

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)
    return states.mapInArrow(work, schema)


_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The steps of the filters A to D of :func:`quality_filters` and E, copies, over whole texts.

    An empty table has no parts and so no rows; a part appears as soon as it has a document. Other
    columns of either table are not looked at.
    """
    filters = quality_filters(F.col("text"))
    names = [*filters, "E"]
    return steps(subset_states(cells(docs, labels, filters, "E", part), names), names)
