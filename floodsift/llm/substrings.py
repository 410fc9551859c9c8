"""Removal of byte strings that an earlier document holds as well.

Every string of ``SPAN`` bytes holds an anchor, a run of ``GRAM`` bytes with the least hash in it,
and equal strings have equal anchors. So anchors are counted over the corpus, and only around those
that several documents share is anything compared: the texts around an anchor are sorted by suffix
arrays in the task that owns it, which tells the smallest document of every string.

Documents are dealt to batches by their id and stay there, in a bucketed table. Batches send packed
columns to the tasks that own hash ranges and get packed answers; no row is sent for each anchor.
Of an anchor with very many different texts, each string goes to the owner of its own hash, so that no
task has all of them.
What a batch sends is distinct within it, so a passage of very many documents is sent once a batch.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from floodsift.llm.suffixes import suffix_arrays
from floodsift.session import shared_folder

SPAN = 50
GRAM = 24
STRINGS = SPAN - GRAM + 1  # with one anchor
BATCH_BYTES = 8 << 20
OWNED = 1 << 18  # anchors that a task owns, about
CONTEXTS = 4  # different texts around one anchor that are sorted together as they are
JOINED = 6  # different texts in one suffix array
HALF = STRINGS // 2  # strings that start so far before an anchor have it in their right part
CELLS = 1 << 18  # of a matrix of suffix arrays
CORE = 257  # the symbol for what all strings of a text hold
NO_ID = (1 << 63) - 1  # of documents without one
CROWD = 1024  # different texts around one anchor, about, that go to one owner
SETTLED, SORTED, SPLIT, SPREAD = 0, 1, 2, 3  # of an anchor: its document is known, its texts are sorted, they are split first, or each string goes to an owner of its own


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every window of ``width``."""
    span = 1
    while span * 2 <= width:
        x = op(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return op(x[:-rest], x[rest:]) if rest else x


def _different(x: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]][: len(x)]]


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of ``x`` are among the sorted values."""
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all strings of SPAN bytes."""
    if len(raw) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    h, spans = raw.astype(np.uint64) + np.uint64(1), {}
    size = 1
    while size <= GRAM:
        spans[size] = h
        h = h[:-size] * np.uint64(pow(base, size, 1 << 64)) + h[size:]
        size *= 2
    total, at = None, 0
    for size in sorted(spans, reverse=True):
        while GRAM - at >= size:
            part = spans[size][at : at + len(raw) - GRAM + 1]
            total = part if total is None else total * np.uint64(pow(base, size, 1 << 64)) + part
            at += size
    x = (total ^ (total >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    least = _sliding(x, STRINGS, np.minimum)
    pad = np.zeros(STRINGS - 1, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), STRINGS, np.maximum)
    p = np.flatnonzero(most == x)
    return p, x[p]


def _documents(table: pa.Table):
    for key, text in zip(table.column("key").to_pylist(), table.column("text").to_pylist()):
        raw = (text or "").encode()
        yield key, raw, *anchors(np.frombuffer(raw, np.uint8))


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t.type) for c, t in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)


def _split(owner: np.ndarray):
    """(owner, slice) of runs in a sorted array."""
    edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else []
    for a, b in zip(edges, np.r_[edges[1:], len(owner)] if len(owner) else []):
        yield int(owner[a]), slice(int(a), int(b))


_PACKED = pa.schema([("owner", pa.int32()), ("batch", pa.int32()), ("step", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
PACKED = "owner int, batch int, step int, a binary, b binary, c binary, d binary"


def _array(blob, kind) -> np.ndarray:
    return np.frombuffer(blob or b"", kind)


class Dealer:
    """Owners of hash ranges; ``bits`` is chosen so that an owner has about OWNED anchors."""

    def __init__(self, total_bytes: int):
        self.bits = max(4, math.ceil(math.log2(max(1, total_bytes / (STRINGS / 2 * OWNED)))))

    def owner(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def short(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _count(dealer: Dealer, batch: int, table: pa.Table) -> pa.Table:
    """The anchors of a batch: those of one document, and those of several."""
    found = [_different(h) for _, _, _, h in _documents(table)]
    h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
    rows = []
    for owner, at in _split(dealer.owner(h)):
        short, several = dealer.short(h[at]), n[at] > 1
        rows.append((owner, batch, 0, short[~several].tobytes(), short[several].tobytes(), None, None))
    return _rows(_PACKED, rows)


def _shared(table: pa.Table) -> pa.Table:
    """To every batch, which of its anchors other documents have as well."""
    sent = [(r["batch"], _different(np.concatenate([_array(r["a"], "<u4"), _array(r["b"], "<u4")])), _array(r["b"], "<u4")) for r in table.to_pylist()]
    values = np.sort(np.concatenate([x for _, x, _ in sent]))
    again = values[1:][values[1:] == values[:-1]]  # of several batches
    shared = _different(np.concatenate([again, *[b for _, _, b in sent]]))
    owner = table.column("owner")[0].as_py()
    return _rows(_PACKED, [(owner, batch, 0, x[_among(x, shared)].tobytes(), None, None, None) for batch, x, _ in sent])


class Batch:
    """The shared anchors of a batch and the distinct texts around them, always in the same order."""

    def __init__(self, dealer: Dealer, table: pa.Table, answers: pa.Table):
        told = [r for r in answers.to_pylist() if r["step"] == 0]
        wanted = np.concatenate([np.zeros(0, np.uint64)] + [
            (np.uint64(r["owner"]) << np.uint64(32)) | _array(r["a"], "<u4").astype(np.uint64) for r in told
        ])
        wanted.sort()
        self.docs, hs, texts, of, at = [], [], [], [], []
        for d, (key, raw, p, h) in enumerate(_documents(table)):
            self.docs.append((key, raw))
            name = (dealer.owner(h).astype(np.uint64) << np.uint64(32)) | dealer.short(h)
            told_of = _among(name, wanted)
            p, h = p[told_of], h[told_of]
            hs.append(h)
            at.append(p)
            of.append(np.full(len(p), d))
            texts += [
                xxhash.xxh3_64_intdigest(raw[max(0, q - STRINGS + 1) : q + SPAN], min(q, STRINGS - 1)) | 1
                for q in p.tolist()
            ]
        none = np.zeros(0, np.int64)
        self.of, self.at = np.concatenate([none, *of]), np.concatenate([none, *at])
        h, text = np.concatenate([np.zeros(0, np.uint64), *hs]), np.array(texts, np.uint64)
        # An anchor with too many texts in this batch alone is not told apart by them.
        order = np.lexsort((text, h))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])][: len(h)]
        anchor, n = np.unique(h[order][new], return_counts=True)
        many, crowd = anchor[n > CONTEXTS], n[n > CONTEXTS]
        text[np.isin(h, many)] = 0
        order = np.lexsort((text, h))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])][: len(h)]
        self.entry = np.empty(len(h), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.h, self.text = h[order][new], text[order][new]
        self.crowd = np.ones(len(self.h), np.int32)
        self.crowd[np.isin(self.h, many)] = crowd  # either is in the order of the anchors
        keys = np.array([k for k, _ in self.docs], np.int64)
        self.first = np.full(len(self.h), NO_ID)
        np.minimum.at(self.first, self.entry, keys[self.of] if len(self.of) else none)
        self.owner = dealer.owner(self.h)

    def ask(self, batch: int) -> pa.Table:
        rows = [
            (owner, batch, 1, self.h[s].tobytes(), self.text[s].tobytes(), self.first[s].tobytes(), self.crowd[s].tobytes())
            for owner, s in _split(self.owner)
        ]
        return _rows(_PACKED, rows)

    def told(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """State and smallest document of every entry."""
        state, doc = np.zeros(len(self.h), np.int8), np.full(len(self.h), NO_ID)
        by = {r["owner"]: r for r in answers.to_pylist() if r["step"] == 1}
        for owner, s in _split(self.owner):
            state[s], doc[s] = _array(by[owner]["a"], "i1"), _array(by[owner]["b"], "<i8")
        return state, doc

    def strings(self, state: np.ndarray):
        """(document, start, end, anchor, place of what all strings of the text hold, its length), in order."""
        for k in np.flatnonzero((state[self.entry] == SORTED) | (state[self.entry] == SPLIT)).tolist():
            d, p = int(self.of[k]), int(self.at[k])
            n, h = len(self.docs[d][1]), int(self.h[self.entry[k]])
            low, high = max(0, p - STRINGS + 1), min(n, p + SPAN)
            if state[self.entry[k]] == SORTED:
                yield d, low, high, h, p - low, GRAM
                continue
            # Strings that start HALF or more before the anchor share the text from there to its end;
            # the others share the text from the anchor on. Either is a narrower anchor.
            raw = self.docs[d][1]
            if p >= HALF and low + SPAN <= n:
                end = min(n, p - HALF + SPAN)
                yield d, low, end, xxhash.xxh3_64_intdigest(raw[p - HALF : p + GRAM], 3), p - HALF - low, HALF + GRAM
            begin = max(0, p - HALF + 1)
            if begin + SPAN <= n:
                yield d, begin, high, xxhash.xxh3_64_intdigest(raw[p : p - HALF + 1 + SPAN], 4), p - begin, SPAN - HALF + 1

    def spread(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, start and hash of every string around the anchors that are spread."""
        of, at, hs = [], [], []
        for k in np.flatnonzero(state[self.entry] == SPREAD).tolist():
            d, p = int(self.of[k]), int(self.at[k])
            raw = self.docs[d][1]
            for begin in range(max(0, p - STRINGS + 1), min(p, len(raw) - SPAN) + 1):
                of.append(d)
                at.append(begin)
                hs.append(xxhash.xxh3_64_intdigest(raw[begin : begin + SPAN], 5))
        return np.array(of, np.int64), np.array(at, np.int64), np.array(hs, np.uint64)

    def send(self, dealer: Dealer, batch: int, state: np.ndarray) -> pa.Table:
        least: dict[tuple[int, bytes, int], int] = {}
        for d, low, high, h, left, core in self.strings(state):
            key, raw = self.docs[d]
            name = h, raw[low:high], (high - low) | left << 8 | core << 16
            least[name] = min(key, least.get(name, NO_ID))
        names = sorted(least)
        hs = np.array([name[0] for name in names], np.uint64)
        rows = []
        for owner, s in _split(dealer.owner(hs)):
            mine = names[s]
            rows.append((
                owner, batch, 2, hs[s].tobytes(), np.array([least[x] for x in mine], "<i8").tobytes(),
                np.array([x[2] for x in mine], "<i4").tobytes(), b"".join(x[1] for x in mine),
            ))
        of, _, strings = self.spread(state)
        one, run = np.unique(strings, return_inverse=True)
        smallest = np.full(len(one), NO_ID)
        np.minimum.at(smallest, run, np.array([k for k, _ in self.docs], np.int64)[of])
        for owner, s in _split(dealer.owner(one)):
            rows.append((owner, batch, 3, one[s].tobytes(), smallest[s].tobytes(), None, None))
        return _rows(_PACKED, rows)


def _resolve(table: pa.Table) -> pa.Table:
    """For every anchor: its smallest document if all texts around it are equal, else how to compare them."""
    rows = table.to_pylist()
    h = np.concatenate([_array(r["a"], "<u8") for r in rows])
    text = np.concatenate([_array(r["b"], "<u8") for r in rows])
    doc = np.concatenate([_array(r["c"], "<i8") for r in rows])
    crowd = np.concatenate([_array(r["d"], "<i4") for r in rows]).astype(np.int64)
    order = np.lexsort((text, h))
    hs, ts = h[order], text[order]
    edge = np.r_[True, hs[1:] != hs[:-1]][: len(hs)]
    first = np.flatnonzero(edge)
    run = np.cumsum(edge) - 1
    different = np.add.reduceat(np.r_[True, (ts[1:] != ts[:-1]) | edge[1:]].astype(np.int64), first)
    state = np.where(different == 1, SETTLED, np.where(different <= CONTEXTS, SORTED, SPLIT))
    state[np.minimum.reduceat(ts, first) == 0] = SPLIT
    # Texts that batches have told apart are counted once, those of crowded anchors in every batch.
    texts = different + np.add.reduceat(np.where(ts == 0, crowd[order], 0), first)
    state[(state == SPLIT) & (texts > CROWD)] = SPREAD
    least = np.minimum.reduceat(doc[order], first)
    states, docs = np.empty(len(h), np.int8), np.empty(len(h), np.int64)
    states[order], docs[order] = state[run], least[run]
    out, at = [], 0
    for r in rows:
        n = len(r["a"]) // 8
        out.append((r["owner"], r["batch"], 1, states[at : at + n].tobytes(), docs[at : at + n].tobytes(), None, None))
        at += n
    return _rows(_PACKED, out)


def smallest_documents(texts: list[bytes], anchor: np.ndarray, doc: np.ndarray, left: np.ndarray, core: np.ndarray) -> np.ndarray:
    """(texts, STRINGS): the smallest document of the string that starts at each place of each text.

    All strings of a text hold its ``core`` bytes from ``left`` on, which are one symbol here. Texts of one
    anchor are joined and sorted by a suffix array; neighbours that agree in all symbols of a string are one
    string. Places without a whole string have NO_ID.
    """
    out = np.full((len(texts), STRINGS), NO_ID)
    left, core = left.tolist(), core.tolist()
    held = [(h, c, t[n : n + c], t) for h, c, t, n in zip(anchor.tolist(), core, texts, left)]
    names = sorted(range(len(texts)), key=held.__getitem__)
    distinct: list[list[list[int]]] = []  # of an anchor, of a text: the rows
    last = None
    for k in names:
        if last is None or held[k][:3] != held[last][:3]:
            distinct.append([[k]])
        elif texts[k] == texts[last] and left[k] == left[last]:
            distinct[-1][-1].append(k)
        else:
            distinct[-1].append([k])
        last = k
    by_count: dict[tuple[int, int], list[list[list[int]]]] = {}
    for group in distinct:
        by_count.setdefault((len(group), core[group[0][0]]), []).append(group)
    for (count, size), groups in by_count.items():
        if count == 1:  # all strings of a text that is alone
            for (rows,) in groups:
                out[rows, : max(0, len(texts[rows[0]]) - SPAN + 1)] = min(int(doc[k]) for k in rows)
            continue
        if count > JOINED:
            for group in groups:
                _count_strings(group, texts, doc, out)
            continue
        width = 2 * (SPAN - size) + 2  # of the longest text, whose core is one symbol, and a mark after it
        at_once = max(1, CELLS // (count * width))
        for start in range(0, len(groups), at_once):
            _compare(groups[start : start + at_once], count, width, size, texts, doc, left, out)
    return out


def _count_strings(group, texts, doc, out) -> None:
    """The same for very many texts that share an anchor: their strings are sorted one by one."""
    strings, of, at = [], [], []
    for t, rows in enumerate(group):
        raw = texts[rows[0]]
        n = max(0, len(raw) - SPAN + 1)
        strings += [raw[k : k + SPAN] for k in range(n)]
        of += [t] * n
        at += range(n)
    if not strings:
        return
    least = np.array([min(int(doc[k]) for k in rows) for rows in group])
    _, run = np.unique(np.array(strings, f"V{SPAN}"), return_inverse=True)
    smallest = np.full(run.max() + 1, NO_ID)
    np.minimum.at(smallest, run, least[of])
    answer = np.full((len(group), STRINGS), NO_ID)
    answer[of, at] = smallest[run]
    for t, rows in enumerate(group):
        out[rows] = answer[t]


def _compare(groups, count, width, core, texts, doc, left, out) -> None:
    span = SPAN - core + 1  # symbols of a string
    matrix = np.zeros((len(groups), count * width), np.int16)
    lengths = np.zeros((len(groups), count), np.int64)
    least = np.empty((len(groups), count), np.int64)
    for g, group in enumerate(groups):
        for t, rows in enumerate(group):
            raw, n, at = np.frombuffer(texts[rows[0]], np.uint8), left[rows[0]], t * width
            lengths[g, t] = len(raw) - core + 1
            matrix[g, at : at + n] = raw[:n]
            matrix[g, at : at + lengths[g, t]] += 1
            matrix[g, at + n] = CORE
            matrix[g, at + n + 1 : at + lengths[g, t]] += raw[n + core :]
            least[g, t] = min(int(doc[k]) for k in rows)
    order = suffix_arrays(matrix)
    text, place = order // width, order % width
    whole = place + span <= np.take_along_axis(lengths, text, axis=1)
    g, c = np.nonzero(whole)
    begin, text, place = order[g, c], text[g, c], place[g, c]
    if not len(g):
        return
    windows = np.lib.stride_tricks.sliding_window_view(matrix, span, axis=1)
    same = np.zeros(len(g), bool)
    for at in range(1, len(g), 1 << 16):
        s = slice(at, min(len(g), at + (1 << 16)))
        b = slice(s.start - 1, s.stop - 1)
        same[s] = (g[s] == g[b]) & (windows[g[s], begin[s]] == windows[g[b], begin[b]]).all(axis=1)
    first = np.flatnonzero(~same)
    smallest = np.repeat(np.minimum.reduceat(least[g, text], first), np.diff(np.r_[first, len(g)]))
    answer = np.full((len(groups), count, STRINGS), NO_ID)
    answer[g, text, place] = smallest
    for i, group in enumerate(groups):
        for t, rows in enumerate(group):
            out[rows] = answer[i, t]


def _spread(rows: list[dict]) -> list[tuple]:
    """To every batch, the smallest documents of its strings."""
    h = np.concatenate([np.zeros(0, np.uint64)] + [_array(r["a"], "<u8") for r in rows])
    one, run = np.unique(h, return_inverse=True)
    smallest = np.full(len(one), NO_ID)
    np.minimum.at(smallest, run, np.concatenate([np.zeros(0, np.int64)] + [_array(r["b"], "<i8") for r in rows]))
    out, at = [], 0
    for r in rows:
        n = len(r["a"]) // 8
        out.append((r["owner"], r["batch"], 3, zlib.compress(smallest[run[at : at + n]].tobytes(), 1), None, None, None))
        at += n
    return out


def _sort(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    answers = _spread([r for r in rows if r["step"] == 3])
    rows = [r for r in rows if r["step"] == 2]
    if not rows:
        return _rows(_PACKED, answers)
    texts: list[bytes] = []
    for r in rows:
        sizes = _array(r["c"], "<i4") & 255
        texts += [r["d"][e - n : e] for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist())]
    packed = np.concatenate([_array(r["c"], "<i4") for r in rows])
    anchor = np.concatenate([_array(r["a"], "<u8") for r in rows])
    doc = np.concatenate([_array(r["b"], "<i8") for r in rows])
    found, out, at = smallest_documents(texts, anchor, doc, packed >> 8 & 255, packed >> 16), [], 0
    for r in rows:
        n = len(r["c"]) // 4
        out.append((r["owner"], r["batch"], 2, zlib.compress(found[at : at + n].tobytes(), 1), None, None, None))
        at += n
    return _rows(_PACKED, out + answers)


def _remove(dealer: Dealer, table: pa.Table, answers: pa.Table, schema: pa.Schema) -> pa.Table:
    batch = Batch(dealer, table, answers)
    state, doc = batch.told(answers)
    keys = np.array([key for key, _ in batch.docs], np.int64)
    sizes = np.array([len(raw) for _, raw in batch.docs], np.int64)
    k = np.flatnonzero(state[batch.entry] == SETTLED)
    k = k[doc[batch.entry[k]] < keys[batch.of[k]]]
    d, p = batch.of[k], batch.at[k]
    cuts = [(d, np.maximum(0, p - STRINGS + 1), np.minimum(sizes[d], p + SPAN))]
    of, begin, strings = batch.spread(state)
    if len(strings):
        one, run = np.unique(strings, return_inverse=True)
        by = {r["owner"]: r["a"] for r in answers.to_pylist() if r["step"] == 3}
        smallest = np.concatenate([np.frombuffer(zlib.decompress(by[o]), "<i8") for o, _ in _split(dealer.owner(one))])
        gone = smallest[run] < keys[of]
        cuts.append((of[gone], begin[gone], begin[gone] + SPAN))
    if ((state == SORTED) | (state == SPLIT)).any():
        texts = [
            (d, low, (h, batch.docs[d][1][low:high], (high - low) | left << 8 | core << 16))
            for d, low, high, h, left, core in batch.strings(state)
        ]
        order = sorted({name for _, _, name in texts})
        names = {x: i for i, x in enumerate(order)}
        owner = dealer.owner(np.array([name[0] for name in order], np.uint64))
        by = {r["owner"]: r["a"] for r in answers.to_pylist() if r["step"] == 2}
        least = np.concatenate([np.zeros((0, STRINGS), np.int64)] + [
            np.frombuffer(zlib.decompress(by[o]), "<i8").reshape(-1, STRINGS) for o, _ in _split(owner)
        ])
        of, low = np.array([x[0] for x in texts], np.int64), np.array([x[1] for x in texts], np.int64)
        k, place = np.nonzero(least[[names[name] for _, _, name in texts]] < keys[of][:, None])
        cuts.append((of[k], low[k] + place, low[k] + place + SPAN))
    edge = np.cumsum(sizes + 1) - sizes - 1
    d, begin, end = (np.concatenate(x) for x in zip(*cuts))
    changes = np.zeros(int((sizes + 1).sum()), np.int32)
    np.add.at(changes, edge[d] + begin, 1)
    np.add.at(changes, edge[d] + end, -1)
    out = []
    for (key, raw), at in zip(batch.docs, edge.tolist()):
        change = changes[at : at + len(raw) + 1]
        gone = np.cumsum(change[:-1]) > 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if len(raw) else 0
        out.append((None if key == NO_ID else key, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return _rows(schema, [r[: len(schema)] for r in out])


def drop_repeated_strings(docs: DataFrame, id_col: str = "doc_id", kept_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) and, if asked for, the bytes that stay.

    A byte goes if it is in a string of SPAN bytes that also starts in a document with a smaller id.
    Strings are judged on the input and overlap. Null texts are empty. Rows of one id do not count
    against one another; a null id counts as larger than all others.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(12, math.ceil(total / BATCH_BYTES))
    dealer = Dealer(total)
    name = f"floodsift_batches_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    # Rows of one id may be very many; they are spread by their texts.
    deal = F.pmod(F.xxhash64("key", "text"), F.lit(batches)).cast("int").alias("batch")
    rows.select("key", "text", deal).repartition(batches, "batch").write.bucketBy(batches, "batch").option("path", path).saveAsTable(name)
    dealt = spark.table(name)
    by_batch, key_of = dealt.groupBy("batch"), lambda key: key[0].as_py()

    def count(key, table):
        return _count(dealer, key_of(key), table)

    def shared(table):
        return _shared(table)

    def ask(key, table, answers):
        return Batch(dealer, table, answers).ask(key_of(key))

    def resolve(table):
        return _resolve(table)

    def send(key, table, answers):
        batch = Batch(dealer, table, answers)
        return batch.send(dealer, key_of(key), batch.told(answers)[0])

    def sort(table):
        return _sort(table)

    kinds = [(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
    schema = pa.schema(kinds if kept_bytes else kinds[:-1])

    def remove(key, table, answers):
        return _remove(dealer, table, answers, schema)

    def answered(sent: DataFrame, how) -> DataFrame:
        made = sent.groupBy("owner").applyInArrow(how, PACKED)
        to = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
        made.write.parquet(to)
        return spark.read.schema(made.schema).parquet(to)

    first = answered(by_batch.applyInArrow(count, PACKED), shared)
    second = first.unionByName(answered(by_batch.cogroup(first.groupBy("batch")).applyInArrow(ask, PACKED), resolve))
    third = second.unionByName(answered(by_batch.cogroup(second.groupBy("batch")).applyInArrow(send, PACKED), sort))
    ddl = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if kept_bytes else "")
    return by_batch.cogroup(third.groupBy("batch")).applyInArrow(remove, ddl)
