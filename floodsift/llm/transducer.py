"""Byte-pair encoding as a stream: tokens leave as soon as nothing that follows can change them.

A merge list has a sufficient lookahead: whatever follows a text, the tokens that end so many
symbols before its end are those of the continued text. It is computed from the merges. Suppose two
texts share a beginning. Merges are applied in the order of their ranks, and the part on which both
agree shrinks only when its last token is the left side ``u`` of a merge ``(u, v)`` and ``v`` follows
in one of the texts only; it then loses ``u``. The token that follows the rest now begins with ``u``
in either text, so the next merge to shrink it has a higher rank and a right side whose leftmost
parts hold ``u``. The longest chain of such merges, counted in symbols, bounds the loss.

This needs every side of a merge to be a symbol or to be made by one earlier merge, and every token
to be made in one way. A list that breaks this has no lookahead here, and its pieces are held whole.
"""

from __future__ import annotations

import codecs
import heapq
import json
import os
import re
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CACHED = 250_000  # words, and pieces, of either generation that a worker remembers; about 130 MB in all
CACHED_LETTERS = 64  # longer ones are encoded each time
BATCH_IDS = 500_000  # ids of a batch that goes back to Spark; a document is never split
FEED = 1 << 16  # symbols read, or ids decoded, at a time


class Merges:
    """The merges of a tokenizer file, and what they say about stability."""

    def __init__(self, pairs: Iterable[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        self.rank = {(u, v): r for r, (u, v) in enumerate(pairs)}
        self.lookahead = self._lookahead()

    def _symbols(self, token: str) -> int:
        return len(token.removesuffix(self.suffix)) if self.suffix else len(token)

    def _lookahead(self) -> int | None:
        made: dict[str, int] = {}
        left: dict[str, str] = {}
        for (u, v), r in self.rank.items():
            if u + v in made:
                return None
            made[u + v], left[u + v] = r, u
        if any(made.get(side, -1) >= r for pair, r in self.rank.items() for side in pair):
            return None
        # For each left side: the ranks of its merges and the longest chain ending in one up to there.
        chains: dict[str, tuple[list[int], list[int]]] = {}
        longest = 0
        for (u, v), r in self.rank.items():
            before, part, until = 0, v, r - 1
            while True:
                if part in chains:
                    ranks, lengths = chains[part]
                    at = bisect_right(ranks, until)
                    before = max(before, lengths[at - 1] if at else 0)
                if part not in left:
                    break
                # The smaller part stood alone only until it was merged into this one.
                until, part = min(until, made[part]), left[part]
            ranks, lengths = chains.setdefault(u, ([], []))
            ranks.append(r)
            lengths.append(max(before + self._symbols(u), lengths[-1] if lengths else 0))
            longest = max(longest, lengths[-1])
        return longest

    def apply(self, symbols: list[str]) -> list[str]:
        """All merges in the order of their ranks, from the left."""
        return self._short(symbols) if len(symbols) <= 48 else self._long(symbols)

    def _short(self, tokens: list[str]) -> list[str]:
        rank, none = self.rank.get, len(self.rank)
        tokens = list(tokens)
        ranks = [rank(pair, none) for pair in zip(tokens, tokens[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            tokens[at] += tokens.pop(at + 1)
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank((tokens[at], tokens[at + 1]), none)
            if at:
                ranks[at - 1] = rank((tokens[at - 1], tokens[at]), none)
        return tokens

    def _long(self, tokens: list[str]) -> list[str]:
        """With a heap of neighbours, for long runs."""
        rank, n = self.rank, len(tokens)
        tokens = [*tokens, ""]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[pair], k, *pair) for k, pair in enumerate(zip(tokens, tokens[1:n])) if pair in rank]
        heapq.heapify(heap)
        while heap:
            _, k, u, v = heapq.heappop(heap)
            other = after[k] if tokens[k] == u else n
            if other == n or tokens[other] != v:
                continue  # one of the two has been merged since
            tokens[k], tokens[other] = u + v, ""
            after[k] = after[other]
            if after[k] < n:
                before[after[k]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] < n and (pair := (tokens[a], tokens[after[a]])) in rank:
                    heapq.heappush(heap, (rank[pair], a, *pair))
        return [t for t in tokens if t]


class Transducer:
    """Encodes one piece that arrives in parts; holds a bounded number of symbols."""

    def __init__(self, merges: Merges, hold: int | None = None):
        self.merges = merges
        look = merges.lookahead
        self.hold = None if look is None else max(hold or 4 * look, look + 1)
        self.pending = ""

    def feed(self, letters: str) -> Iterator[str]:
        """Take more letters; return the tokens that are certain by now."""
        if self.hold is None:
            self.pending += letters
            return
        for at in range(0, len(letters), self.hold):
            self.pending += letters[at : at + self.hold]
            # The last letter may yet take the end mark, so it counts as unknown.
            known = len(self.pending) - 1
            if known < self.hold:
                continue
            stable, out = known - self.merges.lookahead, 0
            for token in self.merges.apply(list(self.pending[:known])):
                if out + len(token) > stable:
                    break
                out += len(token)
                yield token
            self.pending = self.pending[out:]

    def finish(self) -> list[str]:
        """The tokens that are left once the piece has ended."""
        symbols, self.pending = list(self.pending), ""
        if symbols:
            symbols[-1] += self.merges.suffix
        return self.merges.apply(symbols)


class TextDecoder:
    """Ids to text, a run at a time: bytes wait until they make whole characters.

    With byte letters each letter of a token is a byte; a token with another letter gives its own
    bytes. Without, tokens are joined by spaces as they are written. Broken bytes become U+FFFD.
    """

    def __init__(self, tokens: list[bytes], joint: bytes):
        self.tokens, self.joint, self.begun = tokens, joint, False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        raw = self.joint.join(map(self.tokens.__getitem__, ids))
        if raw and self.begun:
            raw = self.joint + raw
        self.begun = self.begun or bool(raw)
        return self.state.decode(raw)

    def finish(self) -> str:
        self.begun = False
        return self.state.decode(b"", True)


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself if printable, else the next free one."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Recent(dict):
    """Values worked out when they are first asked for; the older of two generations is forgotten."""

    def __init__(self, work: Callable[[str], bytes], size: int = CACHED):
        super().__init__()
        self.work, self.size, self.older = work, size, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.work(key)
        if len(key) <= CACHED_LETTERS:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """A tokenizer file's special tokens and word rules around the transducer.

    The file's own normaliser and splitter make pieces of a word. Words of ASCII and Latin letters,
    which have one form and one lower case each, are split here.
    """

    # Split before normalising; only white space that every rule of the file takes as such.
    WORD = re.compile(r"[^ \t\r\n]+")
    LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
    PLAIN = re.compile(f"[!-~{LATIN}]+").fullmatch

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError(f"{path} is no plain byte-pair model")
        if model.get("dropout") or model.get("unk_token") or model.get("ignore_merges"):
            raise ValueError(f"{path} has options that are not supported")
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
            raise ValueError(f"{path} does not split into words and bytes")
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(pairs, model.get("end_of_word_suffix") or "")
        self.ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has special tokens that take their surroundings")
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        # The file's pattern, with its classes spelt out for ASCII; used if it is the known one.
        classes = {r"\p{L}": "a-z" + self.LATIN, r"\p{N}": "0-9"}
        pattern = steps[0]["pattern"].get("Regex", "")
        lowers = "Lowercase" in json.dumps(spec["normalizer"])
        drops = steps[0]["behavior"] == "Removed" and steps[0]["invert"]
        for name, plain in classes.items():
            pattern = pattern.replace(f"[{name}]", f"[{plain}]").replace(name, plain)
        self.plain = re.compile(pattern).findall if lowers and drops and "\\p" not in pattern else None
        self.words, self.parts = Recent(self.word), Recent(self.piece)
        by_id = {i: t for t, i in (self.ids | self.special).items()}
        names = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        bytewise = (spec["decoder"] or {}).get("type")
        if bytewise not in (None, "ByteLevel"):
            raise ValueError(f"{path} has another decoder")
        back = {c: b for b, c in byte_letters().items()}
        if bytewise:
            raw = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in names]
        else:
            raw = [t.encode() for t in names]
        self.raw, self.joint = raw, b"" if bytewise else b" "

    def pieces(self, word: str) -> list[str]:
        """The pieces of a word, in byte letters."""
        if self.plain and self.PLAIN(word):
            found = self.plain(word.lower())
            if word.isascii():
                return found
            letters = byte_letters()
            return ["".join([letters[b] for b in piece.encode()]) for piece in found]
        normalizer, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        text = normalizer.normalize_str(word) if normalizer else word
        return [piece for piece, _ in splitter.pre_tokenize_str(text)]

    def piece(self, piece: str) -> bytes:
        """The ids of a piece as 32-bit numbers; tokens without an id are left out."""
        machine, tokens = Transducer(self.merges), []
        for at in range(0, len(piece), FEED):
            tokens += machine.feed(piece[at : at + FEED])
        tokens += machine.finish()
        return array("i", [self.ids[t] for t in tokens if t in self.ids]).tobytes()

    def word(self, word: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.pieces(word)))

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.WORD.findall(text)))

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; null is empty."""
        text = text or ""
        if self.marks is None or not self.marks.search(text):
            return np.frombuffer(self._words(text), np.int32)
        parts = self.marks.split(text)
        raw = [
            np.array([self.special[p]], np.int32).tobytes() if k % 2 else self._words(p)
            for k, p in enumerate(parts)
        ]
        return np.frombuffer(b"".join(raw), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        machine = TextDecoder(self.raw, self.joint)
        parts = [machine.feed(ids[at : at + FEED].tolist()) for at in range(0, len(ids), FEED)]
        return "".join([*parts, machine.finish()])


@lru_cache(maxsize=2)
def codec(name: str) -> Codec:
    """The codec of a public tokenizer's file, or of a path. One a worker."""
    import public_tokenizers

    return Codec(name if os.path.isabs(name) else public_tokenizers.path(name))


def _typed(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def encode(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", decoded: str | None = None
) -> DataFrame:
    """(key, ids): the ids of every whole text, one row for each row of ``docs``.

    With ``decoded`` a column of that name has the text that the ids decode to, as :func:`decode`
    would add it. A null or empty text has no ids, an empty table gives an empty one, repeated rows
    and null keys stay as they are, and other columns of ``docs`` are not looked at. A long run of
    letters passes through the transducer, which holds ``4 * lookahead`` symbols however long the
    run is.
    """
    names = [key, "ids"] + [decoded] * bool(decoded)

    def work(batches):
        machine = codec(tokenizer)
        for batch in batches:
            first, ids, total = 0, [], 0
            for k, value in enumerate(batch.column(1)):
                ids.append(machine.encode(value.as_py()))
                total += len(ids[-1])
                if total >= BATCH_IDS or k == batch.num_rows - 1:
                    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))
                    columns = [batch.column(0).slice(first, len(ids)), lists]
                    if decoded:
                        columns.append(pa.array(map(machine.decode, ids), pa.string(), size=len(ids)))
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    first, ids, total = k + 1, [], 0

    schema = f"{_typed(docs, [key])}, ids array<int>" + (f", `{decoded}` string" if decoded else "")
    return docs.select(key, text).mapInArrow(work, schema)


def decode(coded: DataFrame, tokenizer: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the text of ``ids``; special tokens stay. Null ids are an empty list, an unknown id raises.

    A column that is called ``name`` already is replaced.
    """
    coded = coded.drop(name)
    at = coded.columns.index(ids)

    def work(batches):
        machine = codec(tokenizer)
        for batch in batches:
            lists = batch.column(at)
            first, texts, total = 0, [], 0
            for k in range(batch.num_rows):
                held = lists[k].values
                held = np.empty(0, np.int32) if held is None else held.to_numpy(zero_copy_only=False)
                texts.append(machine.decode(held))
                total += len(held)
                if total >= BATCH_IDS or k == batch.num_rows - 1:
                    part = batch.slice(first, len(texts))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name]
                    )
                    first, texts, total = k + 1, [], 0

    return coded.mapInArrow(work, f"{_typed(coded, coded.columns)}, `{name}` string")
