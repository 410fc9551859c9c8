"""Near duplicates by SimHash fingerprints within a Hamming distance.

The search is a generalised pigeonhole: correlated bits share a part, part ``i`` has its own
threshold ``T[i]``, and because the sum of ``T[i] + 1`` is the distance plus one, two fingerprints
within the distance are within ``T[i]`` in at least one part. Thresholds come from a dynamic
programme over estimated costs. They change the cost only, never the links found.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from floodsift.llm.components import components
from floodsift.llm.words import ascii_lower, shingle_hashes, words
from floodsift.session import stage

SAMPLE = 4096  # fingerprints from which costs are estimated
BLOCK_ROWS = 4096  # distinct fingerprints indexed in one block
CHUNK = 1 << 21  # candidate pairs compared at a time
HASHES_AT_ONCE = 1 << 17


def fingerprints(docs: DataFrame, keep: list[str], size: int = 3, lanes: int = 1) -> DataFrame:
    """The columns ``keep`` and fingerprints ``f0`` .. of 64 bits each.

    A bit is 1 if it is set in more than half of the hashes of the text's word shingles, repeats
    included. ``f0`` uses XXH64 itself; later lanes use values mixed from it. Null texts and texts
    without words have zero fingerprints.
    """
    hashes = shingle_hashes(words(ascii_lower(F.col("text"))), size)
    rows = docs.select(*keep, hashes.alias("_hashes"))
    schema = T.StructType(
        [f for f in rows.schema.fields if f.name != "_hashes"]
        + [T.StructField(f"f{k}", T.LongType()) for k in range(lanes)]
    )

    def reduce_batches(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            offsets = column.offsets.to_numpy()
            values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
            made = [pa.array(f.view(np.int64)) for f in _majorities(values, offsets, lanes)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *made], names=[f.name for f in schema.fields]
            )

    return rows.mapInArrow(reduce_batches, schema)


def _mixed(values: np.ndarray, lane: int) -> np.ndarray:
    """Another 64-bit hash of each value; lane 0 is the value itself."""
    if lane == 0:
        return values
    x = values + np.uint64(0x9E3779B97F4A7C15 * lane & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majorities(values: np.ndarray, offsets: np.ndarray, lanes: int) -> list[np.ndarray]:
    counts = np.zeros((lanes, len(offsets) - 1, 64), np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    values = values[offsets[0] : offsets[-1]]
    for start in range(0, len(values), HASHES_AT_ONCE):
        part, of = values[start : start + HASHES_AT_ONCE], rows[start : start + HASHES_AT_ONCE]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        for lane in range(lanes):
            bits = np.unpackbits(_mixed(part, lane).view(np.uint8), bitorder="little")
            sums = np.add.reduceat(bits.reshape(-1, 64), first, axis=0, dtype=np.int32)
            counts[lane, of[first]] += sums
    most = counts * 2 > np.diff(offsets)[None, :, None]
    packed = np.packbits(most, axis=2, bitorder="little")
    return [np.ascontiguousarray(packed[lane]).view(np.uint64).ravel() for lane in range(lanes)]


@dataclass(frozen=True)
class Parts:
    """Bits of each part, its threshold (-1: not probed) and how many of its bits name a block."""

    bits: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    block_bits: tuple[int, ...]


def choose_parts(sample: np.ndarray, rows: int, distance: int) -> Parts:
    """Group correlated bits and allocate thresholds by estimated cost for ``rows`` fingerprints."""
    sample = sample.astype(np.uint64)
    rng = np.random.default_rng(7)
    left, right = rng.integers(0, max(len(sample), 1), (2, 1 << 16))
    apart = sample[left] ^ sample[right] if len(sample) > 1 else np.zeros(1, np.uint64)
    bits = np.unpackbits(sample.view(np.uint8), bitorder="little").reshape(-1, 64).astype(float)
    spread = bits - bits.mean(axis=0) if len(bits) else np.zeros((1, 64))
    norms = np.sqrt((spread**2).sum(axis=0)) + 1e-9
    alike = np.abs(spread.T @ spread) / np.outer(norms, norms)
    best = None
    for count in range(2, min(distance + 1, 8) + 1):
        bits_of = _grouped(alike, count)
        costs = []
        for part in bits_of:
            mask = np.uint64(sum(1 << b for b in part))
            near = np.bitwise_count(apart & mask)
            ball, row = 0, [0.0]
            for t in range(min(distance, len(part), 5) + 1):
                ball += math.comb(len(part), t)
                share = max(float((near <= t).mean()), ball / 2 ** len(part))
                row.append(rows * ball * 4 + share * rows * rows / 2)
            costs.append(row)
        total, thresholds = _allocate(costs, distance + 1)
        if thresholds and (best is None or total < best[0]):
            best = total, bits_of, thresholds
    _, bits_of, thresholds = best
    wanted = max(0, math.ceil(math.log2(max(rows, 1) / BLOCK_ROWS)))
    return Parts(bits_of, thresholds, tuple(min(wanted, len(p)) for p in bits_of))


def _grouped(alike: np.ndarray, count: int) -> tuple[tuple[int, ...], ...]:
    """Parts of nearly equal width, each grown from a free bit by its most correlated free bits."""
    free, parts = list(range(64)), []
    for k in range(count, 0, -1):
        width, part = len(free) // k, [free.pop(0)]
        while len(part) < width:
            nearest = max(free, key=lambda b: (alike[part, b].mean(), -b))
            free.remove(nearest)
            part.append(nearest)
        parts.append(tuple(part))
    return tuple(parts)


def _allocate(costs: list[list[float]], units: int) -> tuple[float, tuple[int, ...]]:
    """Least sum of ``costs[i][u[i]]`` with the ``u`` adding up to ``units``; thresholds are u - 1."""
    best = {0: (0.0, ())}
    for row in costs:
        reached = {}
        for (used, (cost, chosen)), (u, extra) in itertools.product(best.items(), enumerate(row)):
            at = used + u
            if at <= units and (at not in reached or cost + extra < reached[at][0]):
                reached[at] = cost + extra, (*chosen, u - 1)
        best = reached
    return best.get(units, (math.inf, ()))


def _flips(width: int, most: int) -> np.ndarray:
    """All numbers of ``width`` bits with at most ``most`` ones."""
    found = [
        sum(1 << b for b in ones)
        for n in range(min(most, width) + 1)
        for ones in itertools.combinations(range(width), n)
    ]
    return np.array(found, np.int64)


def _part_values(values: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for k, b in enumerate(bits):
        out |= ((values >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def links(nodes: DataFrame, distance: int, lanes: int = 1, verify: int | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all links between distinct fingerprints.

    ``nodes`` has one row per fingerprint: ``node`` (bigint) and ``f0`` ... Two link if ``f0``
    differs in at most ``distance`` bits and, with ``verify``, all lanes together in at most that
    many. Each block compares all its candidates and returns a spanning forest of the links found,
    so a large group yields at most one edge per member and part. A block that holds more than its
    share is cut into slices of its index; every probe visits every slice.
    """
    spark = nodes.sparkSession
    lane_names = [f"f{k}" for k in range(lanes)]
    nodes = stage(nodes.select("node", *lane_names))
    rows = nodes.count()
    pick = min(1.0, SAMPLE / max(rows, 1))
    picked = nodes.where(F.pmod(F.xxhash64("node", F.lit("pick")), F.lit(1 << 30)) < pick * (1 << 30))
    sample = np.array([r[0] for r in picked.select("f0").limit(2 * SAMPLE).collect()], np.int64)
    parts = choose_parts(sample.view(np.uint64), rows, distance)

    def route(batches):
        for batch in batches:
            node = batch.column("node").to_numpy(zero_copy_only=False)
            words_ = [batch.column(n).to_numpy(zero_copy_only=False) for n in lane_names]
            f0 = words_[0].view(np.uint64)
            for i, (bits, t) in enumerate(zip(parts.bits, parts.thresholds)):
                if t < 0:
                    continue
                h = parts.block_bits[i]
                high = _part_values(f0, bits) >> (len(bits) - h)
                for flip in _flips(h, t):
                    block = ((high ^ flip) << 8) | i
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(block),
                            pa.array(np.full(len(node), flip == 0)),
                            pa.array(node),
                            *map(pa.array, words_),
                        ],
                        names=["block", "own", "node", *lane_names],
                    )

    lane_schema = ", ".join(f"{n} long" for n in lane_names)
    routed = nodes.mapInArrow(route, f"block long, own boolean, node long, {lane_schema}")
    sizes = routed.where("own").groupBy("block").agg(F.count(F.lit(1)).alias("held"))
    heavy = stage(
        sizes.where(F.col("held") > 4 * BLOCK_ROWS).select(
            "block", F.ceil(F.col("held") / (2 * BLOCK_ROWS)).cast("int").alias("slices")
        )
    )
    slices = F.coalesce("slices", F.lit(1))
    own_slice = F.pmod(F.xxhash64("node"), slices.cast("bigint")).cast("int")
    dealt = (
        routed.join(heavy, "block", "left")
        .withColumn("home", F.when(F.col("own"), own_slice).otherwise(-1))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop("slices", "own")
    )

    def match(key, table):
        a, b = _match_block(
            int(key[0].as_py()) & 255,
            int(key[0].as_py()) >> 8,
            int(key[1].as_py()),
            table.column("home").to_numpy(),
            table.column("node").to_numpy(),
            np.stack([table.column(n).to_numpy() for n in lane_names]).view(np.uint64),
            parts,
            distance,
            verify,
        )
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("block", "slice").applyInArrow(match, "a long, b long")


def _match_block(part, block, slice_, home, node, f, parts, distance, verify):
    """Spanning forest, as (node, smaller node), of the links between a slice and its probes."""
    bits, t, h = parts.bits[part], parts.thresholds[part], parts.block_bits[part]
    low_width = len(bits) - h
    value = _part_values(f[0], bits)
    low, moved = value & ((1 << low_width) - 1), np.bitwise_count(((value >> low_width) ^ block))
    inside = np.flatnonzero(home == slice_)
    inside = inside[np.argsort(low[inside], kind="stable")]
    keys = low[inside]
    root = np.arange(len(node))
    for flips in range(t + 1):
        probes = np.flatnonzero(moved == flips)
        masks = _flips(low_width, t - flips)
        for mask in masks:
            wanted = low[probes] ^ mask
            start = np.searchsorted(keys, wanted, "left")
            length = np.searchsorted(keys, wanted, "right") - start
            some = np.flatnonzero(length)
            for p, i in _expanded(probes[some], start[some], length[some], inside):
                fit = np.bitwise_count(f[0, p] ^ f[0, i]) <= distance
                p, i = p[fit], i[fit]
                if verify is not None and len(p):
                    fit = np.bitwise_count(f[:, p] ^ f[:, i]).sum(axis=0, dtype=np.int64) <= verify
                    p, i = p[fit], i[fit]
                root = _hook(root, p, i)
    linked = np.flatnonzero(root != np.arange(len(root)))
    return node[linked], node[root[linked]]


def _expanded(probes, start, length, inside):
    """(probe, indexed row) pairs in chunks of bounded size."""
    while len(probes):
        over = int(length.max()) > CHUNK
        if over:  # a probe with very many candidates is compared in pieces
            wide = length > CHUNK
            for p, s, n in zip(probes[wide], start[wide], length[wide]):
                for at in range(s, s + n, CHUNK):
                    rows = inside[at : min(at + CHUNK, s + n)]
                    yield np.full(len(rows), p), rows
            probes, start, length = probes[~wide], start[~wide], length[~wide]
            continue
        upto = np.searchsorted(np.cumsum(length), CHUNK, "right") or 1
        n = length[:upto]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[:upto], n)
        yield np.repeat(probes[:upto], n), inside[at]
        probes, start, length = probes[upto:], start[upto:], length[upto:]


def _hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the trees of every pair; every row then points at the root of its tree."""
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        root = root.copy()
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    size: int = 3,
    distance: int = 3,
    lanes: int = 1,
    verify: int | None = None,
) -> DataFrame:
    """(id, f0 .., component_id) for every row; ``component_id`` is the smallest id reachable.

    Null ids take part and have no say in the smallest id. Empty texts share the zero fingerprint
    and link like others. Repeated rows are kept. Columns of ``docs`` other than the id and
    ``text`` are not read.
    """
    lane_names = [f"f{k}" for k in range(lanes)]
    ids = docs.select(F.col(id_col).alias("_id"), F.col("text"))
    marked = stage(fingerprints(ids, ["_id"], size, lanes))
    node = F.col("f0") if lanes == 1 else F.xxhash64(*lane_names)
    marked = marked.withColumn("node", node)
    classes = stage(
        marked.groupBy("node", *lane_names).agg(F.min("_id").alias("first"))
    )
    rooted = stage(components(links(classes, distance, lanes, verify)))
    classed = classes.select("node", "first").join(rooted, "node", "left").select(
        "node", "first", F.coalesce("root", "node").alias("root")
    )
    smallest = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage(classed.join(smallest, "root").select("node", "component_id"))
    return marked.join(named, "node").select(
        F.col("_id").alias(id_col), *lane_names, "component_id"
    )
