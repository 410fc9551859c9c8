"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

Best fit depends on lengths only, and there are at most ``capacity`` different ones. So the bins
are planned from the histogram of lengths, by runs of equal documents: a segment tree over the
remaining capacities finds the tightest open bins in logarithmic time, whole runs go in at once,
and the result is the one that placing all documents singly in descending order would give.
Documents then look up their place by their rank among those of their length.
"""

from __future__ import annotations

import itertools
import math
import os
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from floodsift.session import stage

CAPACITY = 4096
END_ID = 1
CACHED_WORDS = 400_000  # about 80 MB; when there are more, those of recent sampled texts stay
MARKS = b",.!?;:"
NOTED = 4  # of so many texts one has its words noted as recent
TEXTS_AT_ONCE = 256
SLICE_ROWS = 2_000


class SegmentTree:
    """Which remaining capacities have open bins; finds the smallest one of at least a size."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.width)

    def set(self, at: int, open_: bool) -> None:
        node = at + self.width
        self.any[node] = open_
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        node = least + self.width
        if self.any[node]:
            return least
        while node > 1:  # up to the first right neighbour that has something, then down its left edge
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.width
            node //= 2
        return None


def plan_bins(lengths: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first bin, documents a bin, first offset) for a histogram.

    Bins of equal remaining capacity are kept as runs of neighbouring numbers.
    """
    tree, runs, plan, bins = SegmentTree(capacity), {}, [], 0

    def keep(room: int, first: int, count: int) -> None:
        if room and count:
            runs.setdefault(room, []).append((first, count))
            tree.set(room, True)

    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, bins
                count = -(-left // (capacity // length))
                bins += count
            else:
                first, count = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
            fit = room // length
            full = min(count, left // fit)
            rest = left - full * fit if full < count else 0
            if full:
                plan.append((length, rank, first, fit, capacity - room))
                keep(room - fit * length, first, full)
            if rest:
                plan.append((length, rank + full * fit, first + full, rest, capacity - room))
                keep(room - rest * length, first + full, 1)
            unused = full + bool(rest)
            keep(room, first + unused, count - unused)
            rank, left = rank + full * fit + rest, left - full * fit - rest
    return np.array(plan, np.int64).reshape(-1, 5)


@lru_cache(maxsize=2)
def _tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))


_WORDS: dict[bytes, bytes] = {}
_RECENT: set[bytes] = set()
_TURN = itertools.count()


def token_ids(text: str | None, name: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit numbers.

    The tokenizer lower-cases, drops white space and never joins across it, so words are encoded
    once and looked up. Texts with control characters or the marks of special tokens are encoded
    whole.
    """
    raw = (text or "").encode()
    if b"<|" in raw or b"\x0b" in raw or b"\x0c" in raw:
        ids = _tokenizer(name).encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()
    found = raw.lower().split()
    if next(_TURN) % NOTED == 0:
        _RECENT.update(found)
    coded = list(map(_WORDS.get, found))
    if None in coded:
        if len(_WORDS) > CACHED_WORDS:
            recent = {w: _WORDS[w] for w in _RECENT if w in _WORDS}
            _WORDS.clear()
            _RECENT.clear()
            if len(recent) <= CACHED_WORDS // 2:
                _WORDS.update(recent)
        new = _learn({w for w, ids in zip(found, coded) if ids is None}, name)
        coded = [new[w] if ids is None else ids for w, ids in zip(found, coded)]
    return b"".join(coded)


@lru_cache(maxsize=1)
def _id_bytes(name: str) -> list[bytes]:
    """Every id of the tokenizer as bytes."""
    table = np.arange(max(_tokenizer(name).get_vocab().values(), default=-1) + 1, dtype="<u4").tobytes()
    return [table[at : at + 4] for at in range(0, len(table), 4)]


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself if printable, else the next free one."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def _coded(words: list[bytes], name: str) -> dict[bytes, bytes]:
    """Ids of words. One of letters only is a single piece for the model, so it needs no splitting."""
    tokenizer, letters, out, others = _tokenizer(name), _byte_letters(), {}, []
    tokenize, of_id = tokenizer.model.tokenize, _id_bytes(name)
    for w in words:
        if w.isalpha():
            piece = w.decode()
        else:
            text = w.decode()
            if not (text.isalpha() and unicodedata.is_normalized("NFC", text)):
                others.append(w)
                continue
            lower = "".join([c.lower() for c in text])
            if not (lower.isalpha() and unicodedata.is_normalized("NFC", lower)):
                others.append(w)
                continue
            piece = "".join([letters[b] for b in lower.encode()])
        out[w] = b"".join([of_id[t.id] for t in tokenize(piece)])
    for w, coded in zip(others, tokenizer.encode_batch([w.decode() for w in others], add_special_tokens=False)):
        out[w] = b"".join([of_id[i] for i in coded.ids])
    return out


def _learn(new: set[bytes], name: str) -> dict[bytes, bytes]:
    """Ids of words, which are added to those known. Marks after a letter are a piece of their own."""
    stems = {}
    for w in new:
        stem = w.rstrip(MARKS)
        marked = len(stem) < len(w) and stem and 97 <= stem[-1] <= 122
        stems[w] = (stem, w[len(stem) :]) if marked else (w,)
    out = _coded(list({p for ps in stems.values() for p in ps if p not in _WORDS}), name)
    _WORDS.update(out)
    for w, ps in stems.items():
        if len(ps) > 1:
            _WORDS[w] = out[w] = _WORDS[ps[0]] + _WORDS[ps[1]]
        elif w not in out:
            out[w] = _WORDS[w]
    return out


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", ids: bool = False
) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document, cut into pieces of ``capacity``.

    A document is its ids and the end id; a null text is empty and has the end id alone. With
    ``ids`` the piece's ids are returned too, as bytes. ``tokenizer`` is a file of the public
    tokenizers or a path.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches):
        for batch in batches:
            out = []
            for first in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(first, TEXTS_AT_ONCE)
                for key, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    coded = token_ids(text, tokenizer) + end
                    for piece, at in enumerate(range(0, len(coded), 4 * capacity)):
                        part = coded[at : at + 4 * capacity]
                        out.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part), part if ids else None))
                    if len(out) >= 8192:
                        yield made(batch, out)
                        out = []
            yield made(batch, out)

    def made(batch, out):
        columns = list(zip(*out)) or [()] * 6
        kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = [id_col, "piece", "start", "length", "ids_crc32", "ids"]
        n = 6 if ids else 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns[:n], kinds)], names=names[:n]
        )

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select(id_col, "text").mapInArrow(cut, schema + (", ids binary" if ids else ""))


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a table of pieces with a ``length`` of 1 to ``capacity``.

    The histogram has at most ``capacity`` rows; it and the plan are all that the driver sees.
    Ranks are counted in slices of hashed rows, so a frequent length is spread over many tasks.
    Equal rows get places of their own. An empty table gives an empty table.
    """
    spark = found.sparkSession
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_bins(histogram, capacity)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[order]
    starts = (plan[:, 0] << 48) | plan[:, 1]
    slices = spark.createDataFrame(
        [(k, math.ceil(n / SLICE_ROWS)) for k, n in histogram.items()], "length long, _slices long"
    )
    names = found.columns
    rows = found.join(F.broadcast(slices), "length").withColumn(
        "_slice", F.pmod(F.xxhash64(*names), F.col("_slices"))
    )
    counts = rows.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_slice").orderBy(*names)
    ranked = (
        rows.join(bases, ["length", "_slice"])
        .withColumn("_rank", F.col("_base") + F.row_number().over(within) - 1)
        .select(*names, "_rank")
    )
    where = names.index("length")

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (where, batch.num_columns - 1))
            row = np.searchsorted(starts, (length << 48) | rank, "right") - 1
            ahead = rank - plan[row, 1]
            sequence = plan[row, 2] + ahead // plan[row, 3]
            offset = plan[row, 4] + ahead % plan[row, 3] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{n}` {t}" for n, t in found.dtypes)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(stage(pieces(docs, tokenizer, capacity, id_col)), capacity)
