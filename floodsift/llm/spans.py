"""Removal of repeated runs of sentences, and of words, across a corpus.

Runs of whole sentences are compared as they are. For passages with fewer than two whole sentences,
runs of words are chosen by their hashes: of every few consecutive runs the one with the least hash,
so that a repeated passage has the same runs in all its places, wherever its sentences begin.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from floodsift.session import stage

SENTENCES = 3  # a span
PAIR_WORDS = 20  # two sentences of so many words are a span as well
RUN_WORDS = 20  # of a run that does not heed sentences
CHOICE = 8  # consecutive runs of which one at least is chosen; repeats of RUN_WORDS + CHOICE - 1 words are always found
KNOWN = 200_000  # words whose hashes are kept
_WORD = re.compile(r"\S+")
# The last character of a sentence; that it comes first lets the search skip all other characters.
_END = re.compile(r"[.!?\n](?:(?<=\n)(?=.)|(?<!\n)(?=\s))", re.S)


def sentences(text: str) -> list[str]:
    """Pieces that end after ., ! or ? before white space, or after a line feed; joined they are the text."""
    ends = [m.end() for m in _END.finditer(text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]


def span_hashes(parts: list[str], met: list[str] | None = None) -> list[tuple[int, int, int]]:
    """(hash, first piece, last piece) of every run; white space and case do not count, nor do blank pieces.

    The words of all pieces are added to ``met``.
    """
    real, norms, lengths = [], [], []
    for k, part in enumerate(parts):
        found = part.lower().split()
        if met is not None:
            met += found
        if found:
            real.append(k)
            norms.append(" ".join(found))
            lengths.append(len(found))
    out = []
    for k in range(len(real) - 1):
        if lengths[k] + lengths[k + 1] >= PAIR_WORDS:
            both = f"{norms[k]}\n{norms[k + 1]}"
            out.append((xxhash.xxh3_64_intdigest(both) - (1 << 63), real[k], real[k + 1]))
        if k + SENTENCES <= len(real):
            run = "\n".join(norms[k : k + SENTENCES])
            out.append((xxhash.xxh3_64_intdigest(run, 1) - (1 << 63), real[k], real[k + SENTENCES - 1]))
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (width - size)], x[width - size :])


def _polynomials(h: np.ndarray, width: int) -> np.ndarray:
    """The polynomial of every ``width`` neighbouring hashes, by those of 1, 2, 4, ... of them."""
    out, done, run, size = None, 0, h, 1
    base = 0x9E3779B97F4A7C15
    while size <= width:
        if width & size:
            if out is None:
                out = run
            else:  # the longer run comes first
                out = run[: len(h) - done - size + 1] * np.uint64(pow(base, done, 1 << 64)) + out[size:]
            done += size
        if 2 * size <= width:
            run = run[:-size] * np.uint64(pow(base, size, 1 << 64)) + run[size:]
        size *= 2
    return out


def word_runs(found: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the chosen runs of words in lower case, and at which word each starts.

    ``known`` keeps the hashes of words.
    """
    n = len(found) - RUN_WORDS + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    for w in set(found).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w, 2)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    x = _polynomials(h, RUN_WORDS)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    width = min(CHOICE, n)
    pad = np.full(width - 1, 0, np.uint64)
    most = ~_least(~np.concatenate([pad, _least(x, width), pad]), width)
    at = np.flatnonzero(most == x)
    return x[at].view(np.int64), at


def _hashed(batches):
    """The different hashes of every text, as one array a row, and whether any comes more than once."""
    known: dict[str, int] = {}
    for batch in batches:
        if len(known) > KNOWN:
            known = {}
        first, hashes, again, total = 0, [], [], 0
        for k, text in enumerate(batch.column(1)):
            text = text.as_py()
            # Pieces end at white space, so their words are those of the text.
            met: list[str] = []
            found = np.array([h for h, _, _ in span_hashes(sentences(text), met)], np.int64)
            of = [found, word_runs(met, known)[0]]
            single = [np.unique(x) for x in of]
            hashes.append(np.concatenate(single))
            again.append(any(len(x) < len(y) for x, y in zip(single, of)))
            total += len(hashes[-1])
            if total > 200_000 or k == batch.num_rows - 1:
                ends = np.cumsum([0, *map(len, hashes)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(hashes), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(hashes)), lists, pa.array(again)], names=["key", "spans", "again"]
                )
                first, hashes, again, total = k + 1, [], [], 0


def _kept(text: str, repeated: set[int], known: dict[str, int]) -> tuple[str, int, int]:
    parts = sentences(text)
    seen, gone, met = set(), set(), []
    for h, first, last in span_hashes(parts, met):
        if h in repeated or h in seen:
            gone.update(range(first, last + 1))
        seen.add(h)
    blank = {k for k, part in enumerate(parts) if not part.strip()}
    hs, at = word_runs(met, known)
    again = len(set(hs.tolist())) < len(hs)
    cut: list[tuple[int, int]] = []
    if again or not repeated.isdisjoint(hs.tolist()):
        starts = np.cumsum([0, *map(len, parts)])
        places = [m.span() for m in _WORD.finditer(text)]
        of = np.searchsorted(starts, [a for a, _ in places], "right") - 1
        before: dict[int, int] = {}
        for h, k in zip(hs.tolist(), at.tolist()):
            last = k + RUN_WORDS - 1
            # Words that one sentence repeats are its own, and so are runs that overlap.
            if h in repeated or before.get(h, len(parts)) < of[k]:
                if cut and k <= cut[-1][1] + 1:
                    cut[-1] = cut[-1][0], last
                else:
                    cut.append((k, last))
            before.setdefault(h, int(of[last]))
    if not cut:
        left = "".join(p for k, p in enumerate(parts) if k not in gone) if gone else text
        return left, len(parts) - len(blank), len(gone - blank)
    stays = np.ones(len(text), bool)
    for k in gone:
        stays[starts[k] : starts[k + 1]] = False
    touched = set(gone)
    for first, last in cut:
        begin, end = places[first][0], places[last][1]
        # One of the two blanks around the words is enough, but a line feed stays.
        after = places[last + 1][0] if last + 1 < len(places) else len(text)
        stays[begin : end if "\n" in text[end:after] else after] = False
        touched.update(of[first : last + 1].tolist())
    edges = np.flatnonzero(np.diff(np.r_[False, stays, False].astype(np.int8))).tolist()
    left = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return left, len(parts) - len(blank), len(touched - blank)


def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text, n_sentences, n_removed): texts without any non-first repeated span.

    The first span of a hash is the earliest in the document with the smallest id; every sentence of
    the others goes, and spans are judged on the input. So do the words of chosen runs, up to which
    at most CHOICE - 1 words of either end of a repeated passage may stay; within a document these
    count from one sentence to later ones. ``n_removed`` counts the sentences that lose anything. Null texts are empty, rows of one id count
    as one document, and a null id comes last. An empty table gives an empty one; other columns are
    not looked at. A text is hashed once, into an array that is written, however long it is; hashes
    are counted with map-side aggregation before anything is joined, and documents only meet the
    repeated hashes of their own.
    """
    last = (1 << 63) - 1
    keyed = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(id_col), F.lit(last)).cast("bigint").alias("key"),
        F.coalesce("text", F.lit("")).alias("_text"),
    )
    held = stage(keyed.select("key", "_text").mapInArrow(_hashed, "key long, spans array<long>, again boolean"))
    spans = held.select("key", F.explode("spans").alias("h"))
    counts = spans.groupBy("h").agg(F.min("key").alias("first"), F.max("key").alias("latest"))
    repeated = stage(counts.where("first < latest").select("h", "first"))
    hits = spans.join(repeated, "h").where("key > first").select("key", "h")
    # Texts that have no repeated hash, neither with others nor within, are not hashed again.
    within = held.where("again").select("key", F.lit(None).cast("bigint").alias("h"))
    own = hits.unionByName(within).groupBy("key").agg(F.collect_set("h").alias("hashes"))

    def clean(batches):
        known: dict[str, int] = {}
        for batch in batches:
            if len(known) > KNOWN:
                known = {}
            rows = [
                (text, sum(not part.isspace() for part in sentences(text) if part), 0)
                if hashes is None
                else _kept(text, set(hashes), known)
                for text, hashes in zip(batch.column("_text").to_pylist(), batch.column("hashes").to_pylist())
            ]
            texts, n, gone = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())],
                names=[id_col, "text", "n_sentences", "n_removed"],
            )

    kind = dict(docs.dtypes)[id_col]
    return keyed.join(own, "key", "left").select("_id", "_text", "hashes").mapInArrow(
        clean, f"`{id_col}` {kind}, text string, n_sentences long, n_removed long"
    )
