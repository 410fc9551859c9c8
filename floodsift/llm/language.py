"""Language identification of documents in several languages.

A text's byte trigrams are drawn from a mixture of languages. Expectation maximisation estimates
each document's proportions; the set of languages is the one that a penalised likelihood selects.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CELLS = 1 << 16  # hashed trigrams
SMOOTHING = 0.05
FIT_ROWS = 60_000  # labelled documents of each language that the model is fitted on, at most about so many
ROUNDS = 15
PENALTY = 8.0  # nats a language must gain, times the logarithm of the number of trigrams
TEXTS_AT_ONCE = 512
UNKNOWN = "und"


def _slices(batches):
    """Batches of few texts; those that Spark sends may have 10,000 long ones."""
    for batch in batches:
        for first in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(first, TEXTS_AT_ONCE)


def _trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a text's byte trigrams and how often each occurs."""
    raw = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8).astype(np.uint32)
    codes = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    return np.unique((codes * np.uint32(2654435761)) >> np.uint32(16), return_counts=True)


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities, (CELLS, languages).

    ``labelled`` has ``key``, ``text`` and a non-null ``lang``. Of a language with
    more than ``fit_rows`` rows a share of about ``fit_rows``, chosen by a hash of the key, is used; of
    the others all rows are. A language's probabilities depend on its own rows only.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fit_rows).collect()
    share = F.lit(1 << 40)
    for lang, n in counts:
        share = F.when(F.col("lang") == lang, int(fit_rows / n * (1 << 40))).otherwise(share)
    if counts:
        rows = rows.where(F.pmod(F.xxhash64("key", F.lit("fit")), F.lit(1 << 40)) < share)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in _slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                cells, n = _trigrams(text)
                sums.setdefault(lang, np.zeros(CELLS, np.int64))[cells] += n
        for lang, n in sums.items():
            cells = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(cells), pa.string()), pa.array(cells), pa.array(n[cells])],
                names=["lang", "cell", "n"],
            )

    counts = rows.select("lang", "text").mapInArrow(count, "lang string, cell long, n long")
    table = counts.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    model = np.full((CELLS, len(langs)), SMOOTHING)
    if langs:
        model[table["cell"], table["lang"].map({x: i for i, x in enumerate(langs)})] += table["n"]
    return langs, model / model.sum(axis=0)


def _em(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        share = share * (p.T @ (n / (p @ share))) / n.sum()
    return share, float(n @ np.log(p @ share))


def proportions(text: str, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Selected languages, their proportions, and the posterior of the single best language.

    Starting from the best single language, the one that raises the likelihood most is added as
    long as it gains more than the penalty. The estimate with all languages bounds every gain.
    """
    cells, n = _trigrams(text)
    p = model[cells]
    single = n @ np.log(p)
    best = int(single.argmax())
    posterior = float(1 / np.exp(np.clip((single - single[best]) / 3, -700, 0)).sum())
    chosen, share, reached = [best], np.ones(1), float(single[best])
    price = PENALTY * np.log(n.sum() + 1)
    if p.shape[1] > 1:
        every, top = _em(p, n)
        while top - reached > price and len(chosen) < p.shape[1]:
            tried = [(_em(p[:, [*chosen, x]], n), x) for x in np.flatnonzero(every > 0.01) if x not in chosen]
            if not tried:
                break
            (parts, gained), extra = max(tried, key=lambda t: t[0][1])
            if gained - reached <= price:
                break
            chosen, share, reached = [*chosen, int(extra)], parts, gained
    return np.array(chosen), share, posterior


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, keep: list[str], with_text: bool = False) -> DataFrame:
    """The columns ``keep``, lang_pred, score, and languages with their proportions.

    ``with_text`` adds the text, of those that have a letter; it is sent to the workers anyway.

    ``lang_pred`` is the language of the largest proportion; ``score`` is that proportion times the
    posterior of the best language. Texts that are null or have no letter are ``und`` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        *keep, F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("_text")
    )
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes)
    kinds += ", text string" if with_text else ""
    schema = f"{kinds}, lang_pred string, score double, languages array<string>, proportions array<double>"

    def run(batches):
        table = shared.value
        for batch in _slices(batches):
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                if text is None or not langs:
                    out.append((UNKNOWN, 0.0, [], []))
                    continue
                chosen, share, posterior = proportions(text, table)
                down = np.argsort(-share, kind="stable")
                out.append((
                    langs[chosen[down[0]]],
                    float(min(1.0, share[down[0]] * posterior)),
                    [langs[i] for i in chosen[down]],
                    share[down].tolist(),
                ))
            made = list(zip(*out))
            kept = batch.num_columns - (not with_text)
            names = [*batch.schema.names[:-1], "text"][:kept]
            types = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], *[pa.array(c, t) for c, t in zip(made, types)]],
                names=[*names, "lang_pred", "score", "languages", "proportions"],
            )

    return rows.mapInArrow(run, schema)


def remainder(by: int):
    """CRC-32 of the document's id as text, modulo ``by``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % by


def identify(docs: DataFrame, keep: list[str], fit_rows: int = FIT_ROWS, with_text: bool = False) -> DataFrame:
    """Fit on the documents whose remainder modulo 5 is not 0 and predict all."""
    known = docs.where(remainder(5) != 0).select(F.col("doc_id").alias("key"), "text", "lang")
    langs, model = fit(known, fit_rows)
    return predict(docs, langs, model, keep, with_text)
