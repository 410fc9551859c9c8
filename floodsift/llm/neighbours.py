"""Approximate nearest neighbours by collision counting.

Every vector is projected on random lines, one number a line, and each line is a sorted array. A
query expands a window around its own projection on every line, wider round by round;
a vector that falls into the windows of enough lines is verified with the exact inner product.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

LINES = 96
COLLISIONS = 70  # lines on which a vector must be inside the window
FIRST_WIDTH = 0.7  # of the first window, in standard deviations of the projections
GROWTH = 1.15  # of the windows, round by round
SPARE = 0.2  # share of a block's vectors verified at least
BLOCK = 8192  # vectors in a block
QUERIES = 1024  # queries in a block
SEED = 11


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def search_block(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, top: float, k: int, spare: float = SPARE):
    """For each query the exact inner products of the candidates found: (rows, scores) of the k best.

    Vectors are lifted by sqrt(top**2 - |v|**2) so that the nearest are those of largest inner
    product. Candidates verified are at least k and the spare share, unless there are fewer.
    """
    n, d = vectors.shape
    lift = np.sqrt(np.maximum(0, top * top - (vectors**2).sum(axis=1)))
    lines = np.random.default_rng(SEED).standard_normal((d + 1, LINES))
    at = vectors @ lines[:-1] + lift[:, None] * lines[-1]
    norms = np.maximum(np.sqrt((queries**2).sum(axis=1)), 1e-300)
    spots = (queries / norms[:, None] * top) @ lines[:-1]
    order = np.argsort(at.T, axis=1, kind="stable")
    arrays = np.take_along_axis(at.T, order, axis=1)
    kind = np.uint16 if n < 1 << 16 else np.uint32
    ranks = np.empty((LINES, n), kind)  # of the vectors, on every line
    np.put_along_axis(ranks, order, np.arange(n, dtype=kind)[None, :], axis=1)
    unit = at.std(axis=0) * FIRST_WIDTH + 1e-12
    enough = min(n, k + 1 + int(spare * n))
    widths, windows = [unit], {}
    moved, inside = np.empty((LINES, n), kind), np.empty((LINES, n), bool)

    def hits(q: int, turn: int) -> np.ndarray:
        """On how many lines each vector is in the query's window of this round."""
        while len(widths) <= turn:
            widths.append(widths[-1] * GROWTH)
        if turn not in windows:
            edges = [(a.searchsorted(x - w), a.searchsorted(x + w, "right")) for a, x, w in zip(arrays, spots.T, widths[turn])]
            windows[turn] = [np.array(e, np.int64).T for e in zip(*edges)]
        low, high = (e[q][:, None] for e in windows[turn])
        # Ranks are unsigned, so those before the window wrap round to beyond it.
        np.subtract(ranks, low.astype(kind), out=moved)
        np.less(moved, (high - low).astype(kind), out=inside)
        return np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)

    turn = 0
    for q in range(len(queries)):
        # Windows only widen, so the first round with enough is near that of the query before.
        found = np.flatnonzero(hits(q, turn) >= COLLISIONS)
        while len(found) < enough:
            turn += 1
            found = np.flatnonzero(hits(q, turn) >= COLLISIONS)
        while turn and len(found) >= enough:
            fewer = np.flatnonzero(hits(q, turn - 1) >= COLLISIONS)
            if len(fewer) < enough:
                break
            found, turn = fewer, turn - 1
        if len(found) > 4 * k:
            about = vectors[found] @ queries[q]
            if np.isfinite(about).all():
                # Far more than the rounding of either summation.
                slack = 1e-9 * top * norms[q]
                found = found[about >= -np.partition(-about, 4 * k)[4 * k] - slack]
        # Summed row by row in one order, so that equal vectors have equal scores.
        scores = (vectors[found] * queries[q]).sum(axis=1)
        best = np.lexsort((ids[found], -scores))[: k + 1]
        yield q, found[best], scores[best]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, spare: float = SPARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, largest inner product first.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; candidates all rows but those of
    the query's own id. Ties go to the smaller ``vec_id``. Vectors that are null, zero or hold null or
    non-finite components, and null ids, take no part; vectors are compared with those of their own
    length. Different vectors under one id are candidates each, and queries each, with ranks of their
    own; a query repeated with an equal vector counts once. An empty table gives no rows.

    Queries and vectors meet in blocks of bounded size, every query block with every vector block,
    and only k rows a query leave a block.
    """
    x = F.col("embedding")
    sound = (
        F.col("vec_id").isNotNull()
        & x.isNotNull()
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(x, lambda v: v != 0)
    )
    rows = vectors.select("vec_id", x.cast("array<double>").alias("v")).where(F.coalesce(sound, F.lit(False)))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, a: s + a * a))
    asked = F.col("vec_id") % every == 0
    sizes = rows.groupBy(F.size("v").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.max(size).alias("top"), F.count_if(asked).alias("queries")
    )
    parts = [
        _near(rows.where(F.size("v") == s["d"]), asked, s["n"], s["queries"], s["top"] * (1 + 1e-9), k, spare)
        for s in sizes.orderBy("d").collect()
        if s["queries"]
    ]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (
        reduce(DataFrame.unionByName, parts)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _near(rows: DataFrame, asked: Column, n: int, queries: int, top: float, k: int, spare: float) -> DataFrame:
    """(query_id, query, vec_id, score): the best of every block, for vectors of one length."""
    spread = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    blocks, query_blocks = -(-n // BLOCK), -(-queries // QUERIES)
    held = rows.select("vec_id", "v", spread(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))
    once = rows.where(asked).dropDuplicates(["vec_id", "v"])
    sent = once.select(
        "vec_id",
        "v",
        F.xxhash64("v").alias("query"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        spread(query_blocks).alias("q"),
    )

    def search(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(queries):
            return pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []})
        ids, names, marks = block["vec_id"].to_numpy(), queries["vec_id"].to_numpy(), queries["query"].to_numpy()
        # The query's own rows may be as good as its best ones.
        own = int(pd.Series(ids).value_counts().reindex(names).fillna(0).max())
        out = []
        for q, found, scores in search_block(ids, _matrix(block["v"]), _matrix(queries["v"]), top, k + max(own - 1, 0), spare):
            other = ids[found] != names[q]
            out.append(
                pd.DataFrame(
                    {"query_id": names[q], "query": marks[q], "vec_id": ids[found][other][:k], "score": scores[other][:k]}
                )
            )
        return pd.concat(out)

    schema = "query_id long, query long, vec_id long, score double"
    return held.groupBy("block", "q").cogroup(sent.groupBy("block", "q")).applyInPandas(search, schema)
