"""Toxicity by multiple-instance learning.

Sentences are the instances. A logistic model scores each; noisy-or, 1 - prod(1 - p), combines them
to the document's score, which is all that the labels speak about. The sentence scores then tell
where the offence is.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from floodsift.llm.language import remainder
from floodsift.session import stage

CELLS = 1 << 18  # hashed features
FIT_ROWS = 4000  # labelled documents of either label that the model is fitted on, at most about so many
STEPS = 60
RATE = 0.1
RIDGE = 1e-3  # pull towards the start
PREFIXES = (4, 6, 8)  # characters; words that share them share a feature
LEAST_DOCUMENTS = 3  # in which a feature occurs
SURE = 2.0  # standard errors of the log odds from which a feature starts with them
DECIDE = 0.7
OFFENDING = 0.5
_END = re.compile(r"(?<=[.!?])\s+|\n+")
_EDGE = re.compile(r"^\W+|\W+$")


def sentences(text: str | None) -> list[str]:
    return [s for s in _END.split(text or "") if s] or [""]


def cells(word: str) -> list[int]:
    """Features of a word: itself and its first characters."""
    w = _EDGE.sub("", word.lower())
    return [zlib.crc32(w.encode()) % CELLS] + [
        zlib.crc32(f"^{w[:n]}".encode()) % CELLS for n in PREFIXES if len(w) >= n
    ]


def _chosen(labelled: DataFrame, fit_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """About ``fit_rows`` rows of either label, by a hash of the key, and how many there are of each."""
    counts = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0)
    for label, n in counts.items():
        share = F.when(F.col("toxic") == label, int(min(1.0, fit_rows / n) * (1 << 20))).otherwise(share)
    return labelled.where(F.pmod(F.xxhash64("key", F.lit("fit")), F.lit(1 << 20)) < share), counts


def _start(document: np.ndarray, feature: np.ndarray, labels: np.ndarray, n: int) -> np.ndarray:
    """Log odds of the features that occur in surely more documents of label 1 than of label 0."""
    pairs = np.unique(document * n + feature)
    document, feature = pairs // n, pairs % n
    bad = np.bincount(feature, labels[document], n) + 0.5
    good = np.bincount(feature, 1 - labels[document], n) + 0.5
    odds = np.log(bad / (labels.sum() + 1)) - np.log(good / ((1 - labels).sum() + 1))
    return np.where(odds > SURE * np.sqrt(1 / bad + 1 / good), odds, 0.0)


def train(
    bags: list[list[str]], labels: np.ndarray, weights: np.ndarray, steps: int = STEPS
) -> tuple[np.ndarray, float]:
    """Feature weights and bias that minimise the noisy-or cross entropy, by Adam over all bags.

    Features of fewer than LEAST_DOCUMENTS documents are left out.
    """
    found, sizes, per_bag = [], [], []
    known: dict[str, list[int]] = {}
    for bag in bags:
        per_bag.append(len(bag))
        for s in bag:
            before = len(found)
            for w in set(s.split()):
                if w not in known:
                    known[w] = cells(w)
                found.extend(known[w])
            sizes.append(len(found) - before)
    cell = np.array(found, np.int64)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    bag_of = np.repeat(np.arange(len(per_bag)), per_bag)
    documents = np.bincount(np.unique(bag_of[sentence] * CELLS + cell) % CELLS, minlength=CELLS)
    frequent = documents[cell] >= LEAST_DOCUMENTS
    sentence = sentence[frequent]
    used, index = np.unique(cell[frequent], return_inverse=True)
    start = _start(bag_of[sentence], index, labels, max(len(used), 1)) if len(used) else np.zeros(0)
    w, b = start.copy(), -4.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(sentence, w[index], len(sizes)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(bag_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(per_bag)))
        score = np.clip(1 - none, 1e-6, 1 - 1e-9)
        # The loss's slope in z is p * (1 - y / score), because d(score)/dz = (1 - score) * p.
        slope = p * (1 - labels / score)[bag_of] * weights[bag_of]
        grad = np.append(np.bincount(index, slope[sentence], len(used)), slope.sum()) / weights.sum()
        grad[:-1] += RIDGE * (w - start)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    full = np.zeros(CELLS)
    full[used] = w
    return full, float(b)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """Fit on a bounded sample, in one task of bounded size.

    ``docs`` has ``key`` and ``text``, ``labels`` has ``key`` and ``toxic``, one row a key. The sample
    is chosen from the labels, so only its texts are read on.
    """
    rows, counts = _chosen(labels.where(F.col("toxic").isNotNull()), fit_rows)
    if not counts:
        return np.zeros(CELLS), -4.0
    share = {k: min(1.0, fit_rows / n) for k, n in counts.items()}
    rows = docs.join(F.broadcast(stage(rows)), "key")  # about fit_rows rows of either label

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key")
        y = (frame["toxic"] > 0).to_numpy(float)
        weights = np.array([1 / share[t] for t in frame["toxic"]])
        w, b = train([sentences(t) for t in frame["text"]], y, weights)
        return pd.DataFrame({"w": [w.astype("<f8").tobytes()], "b": [b]})

    model = rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(one, "w binary, b double").first()
    if model is None:
        return np.zeros(CELLS), -4.0
    return np.frombuffer(bytes(model["w"]), "<f8"), model["b"]


class Scorer:
    """Scores texts; remembers the weights of words it has seen, up to a bound."""

    def __init__(self, w: np.ndarray, b: float):
        self.w, self.b, self.known = w, b, {}

    def word(self, w: str) -> float:
        if len(self.known) > 500_000:
            self.known.clear()
        value = self.known[w] = float(self.w[cells(w)].sum())
        return value

    def __call__(self, text: str | None) -> tuple[float, list[int], list[float]]:
        """The document's score, the numbers of its offending sentences and their scores."""
        known, word = self.known, self.word
        z = [sum(known[w] if w in known else word(w) for w in set(s.split())) for s in sentences(text)]
        p = 1 / (1 + np.exp(-np.clip(np.array(z) + self.b, -30, 30)))
        score = -np.expm1(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())
        worst = np.flatnonzero(p >= OFFENDING)
        return float(min(1.0, max(0.0, score))), worst.tolist(), p[worst].tolist()


def score(docs: DataFrame, w: np.ndarray, b: float, keep: list[str]) -> DataFrame:
    """The columns ``keep``, score, predicted, and the offending sentences with their scores."""
    shared = docs.sparkSession.sparkContext.broadcast((w, b))
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes)
    schema = f"{kinds}, score double, predicted int, offending array<int>, offence array<double>"

    def run(batches):
        scorer = Scorer(*shared.value)
        for batch in batches:
            rows = [scorer(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            total, where, how = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(total, pa.float64()),
                    pa.array([int(t >= DECIDE) for t in total], pa.int32()),
                    pa.array(where, pa.list_(pa.int32())),
                    pa.array(how, pa.list_(pa.float64())),
                ],
                names=[*batch.schema.names[:-1], "score", "predicted", "offending", "offence"],
            )

    return docs.select(*keep, "text").mapInArrow(run, schema)


def detect(docs: DataFrame, labels: DataFrame, keep: list[str], fit_rows: int = FIT_ROWS) -> DataFrame:
    """Fit on labelled documents whose remainder modulo 3 is not 1 and score all.

    Null and empty texts are one empty sentence. Without labels every text scores about alike.
    """
    known = labels.where(remainder(3) != 1).groupBy(F.col("doc_id").alias("key")).agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").alias("key"), "text")
    return score(docs, *fit(texts, known, fit_rows), keep)
