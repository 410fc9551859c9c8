"""The filter audit, the resampling and the streaming encoder against plain versions."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodsift.llm import filter_audit, multiset, resampling, transducer

TOKENIZER = "word_bpe_49k.json"
SCHEMA = "doc_id long, text string, source string, rank long, mask string, part int, ids string, score double"
WORDS = "the a of Data model learning token stream flood filter window sketch 17 42 é été 東京".split()


def awkward_rows():
    rng = random.Random(11)
    texts = [None, "", " \n\t ", "...", "A B C", "x\x00y <|endoftext|> z", "<|startoftext|>", "İSTANBUL ΟΔΟΣ ﬁ ½", "don't WE'LL 'S"]
    texts += [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 150))) for _ in range(60)]
    texts += [" ".join(f"w{k}" for k in range(80)) + mark for mark in ("", "#", " |")]
    texts += [" ".join(f"own{k % 900}" for k in range(40_000)), "ha" * 4000, "a" * 3001]
    rows = [(k, t, ("s0", "s1", None, "")[k % 4], 5, "m", 1, "i", 0.5) for k, t in enumerate(texts)]
    copies = [(1000 + k, rows[k % 30 + 9][1], ("s0", "s2")[k % 2], 5, "m", 1, "i", 0.5) for k in range(40)]
    repeated = [rows[10], rows[10], copies[1], (None, texts[10], "s0", 5, "m", 1, "i", 0.5), (None, None, None, 5, "m", 1, "i", 0.5)]
    return rows + copies + repeated


ROWS = awkward_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 2, int(k % 7 == 0)) for k in range(5, 1030, 3)] + [(5, 0, 1), (None, 1, 1), (8, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def plain_audit(rows, labels):
    fails, parts = [], {}
    for key, text, source, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": key is not None and any(r[0] is not None and r[0] < key and (r[1] or "") == t for r in rows),
        }
        marks = [m for m in labels if m[0] is not None and m[0] == key]
        fails.append((source or "", failed, any(m[1] == 1 for m in marks), any(m[2] == 1 for m in marks)))
    for part in {f[0] for f in fails}:
        inside = [f for f in fails if f[0] == part]
        removed_of = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = inside
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                removed_of[f] += len(gone)
                parts[part, "".join(order), step] = [
                    len(left), len(gone), sum(d[1][f] for d in inside) - len(gone),
                    sum(d[1][f] and sum(d[1].values()) == 1 for d in inside),
                    sum(d[2] for d in gone), sum(d[3] for d in gone),
                ]
        for (p, order, step), found in parts.items():
            if p == part:
                found.append(removed_of[order[step - 1]])
    return parts


def test_audit_equals_the_filters_applied_one_by_one(docs, labels, none):
    want = plain_audit(ROWS, [tuple(r) for r in labels.collect()])
    got = filter_audit.audit(docs, labels).collect()
    assert {tuple(r[:3]): list(r[3:]) for r in got} == want and len(got) == len(want)
    assert filter_audit.audit(none, labels).collect() == []
    unlabelled = filter_audit.audit(docs, labels.limit(0)).collect()
    assert len(unlabelled) == len(want) and all(r.good_lost == r.toxic_lost == 0 for r in unlabelled)


def test_walk_equals_every_subset_counted():
    table = np.random.default_rng(3).integers(0, 9, (4, 32, 3))
    states = filter_audit.walk(table)
    for chosen in range(32):
        free = [m for m in range(32) if m & chosen == 0]
        assert (states[:, chosen] == table[:, free].sum(axis=1)).all()


def test_any_few_filters_can_be_audited(spark, docs, labels):
    chosen = {k: v for k, v in filter_audit.quality_filters(docs["text"]).items() if k in "AD"}
    counted = filter_audit.cells(docs, labels, chosen, part="mask")
    found = filter_audit.steps(filter_audit.subset_states(counted, list(chosen)), list(chosen)).collect()
    assert sorted((r.part, r.filter_order, r.step) for r in found) == [("m", o, s) for o in ("AD", "DA") for s in (1, 2)]
    assert all(r.kept + r.removed == len(ROWS) for r in found if r.step == 1)
    with pytest.raises(ValueError):
        filter_audit.subset_states(counted, list("ABCDEFG"))


def plain_resample(rows, target, runs, buckets, percent, least):
    def features(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        made = [" ".join(w[k : k + n]) for n in range(runs[0], runs[1] + 1) for k in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(f.encode()) % buckets for f in made]

    def counts(texts):
        out = [0] * buckets
        for text in texts:
            for b in features(text)[1]:
                out[b] += 1
        return out

    s, t = counts([r[1] for r in rows]), counts(target)
    gain = [
        math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)
    ]
    out = []
    for key, text, *_ in rows:
        words, found = features(text)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((key, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, able[: len(able) * percent // 100]


@pytest.mark.parametrize("runs, buckets, percent, least", [((1, 1), 10_000, 10, 20), ((1, 2), 97, 55, 1)])
def test_resample_equals_the_plain_form(spark, docs, none, runs, buckets, percent, least):
    texts = ["Data model learning, flood filter.", None, "", "the window sketch 42 été"]
    target = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    want, drawn = plain_resample(ROWS, texts, runs, buckets, percent, least)
    got = resampling.resample(docs, target, runs=runs, buckets=buckets, percent=percent, least_words=least).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r[:5])
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(want, key=key)
    ranked = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(r[0], r[4]) for r in drawn]
    assert resampling.resample(none, target).collect() == []
    assert len(resampling.resample(docs, target.limit(0)).collect()) == len(ROWS)


@pytest.mark.parametrize("digit_bits, block_bits", [(12, 20), (3, 2)])
def test_radix_ranks_equal_a_sort(spark, monkeypatch, digit_bits, block_bits):
    monkeypatch.setattr(resampling, "DIGIT_BITS", digit_bits)
    monkeypatch.setattr(resampling, "BLOCK_BITS", block_bits)
    rng = random.Random(digit_bits)
    span = 1 << (9 if digit_bits == 3 else 63)
    rows = [(rng.choice([None, rng.randrange(-span, span), 3, -1]), rng.randrange(-20, 20), k) for k in range(300)]
    df = spark.createDataFrame(rows, "a long, b long, id long").repartition(3)
    got = resampling.radix_ranks(df, [("b", True), ("a", False)], "at").orderBy("at").collect()
    assert [r.at for r in got] == list(range(300)) and sorted(r.id for r in got) == list(range(300))
    order = [(-r.b, r.a is None, r.a or 0) for r in got]
    assert order == sorted(order)
    same = resampling.radix_ranks(df.selectExpr("1L AS a", "id"), [("a", False)], "at").collect()
    assert sorted(r.at for r in same) == list(range(300))
    assert resampling.radix_ranks(df.limit(0), [("a", False)], "at").collect() == []


def test_encoder_equals_the_library(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    coded = transducer.decode(transducer.encode(docs, TOKENIZER), TOKENIZER).collect()
    want = []
    for key, text, *_ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((key, ids, library.decode(ids, skip_special_tokens=False)))
    order = lambda r: (r[0] is None, r[0] or 0, len(r[1]))
    assert sorted((tuple(r) for r in coded), key=order) == sorted(want, key=order)
    at_once = transducer.encode(docs, TOKENIZER, decoded="decoded").collect()
    assert sorted((tuple(r) for r in at_once), key=order) == sorted(want, key=order)
    assert transducer.decode(transducer.encode(none, TOKENIZER), TOKENIZER).collect() == []
    nulls = docs.selectExpr("doc_id", "CAST(NULL AS array<int>) AS ids", "1 AS decoded").limit(2)
    assert [r.decoded for r in transducer.decode(nulls, TOKENIZER).collect()] == ["", ""]


def test_encoder_equals_the_library_on_random_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    library, machine = Tokenizer.from_file(public_tokenizers.path(TOKENIZER)), transducer.codec(TOKENIZER)
    letters = "aaabbceeinorstth  \n\t'.!,0129ABCXYZéàüßÉ́̈ΣςİıſÅ \x85\xa0​\x0b\x0c\x1f\x00東京한글Ⅷ½²😂❤️-_#@<|>"
    rng = random.Random(13)
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(50)))
        assert library.encode(text, add_special_tokens=False).ids == machine.encode(text).tolist()
    vocabulary = [t for t in machine.ids if t.isascii() and t.isalpha()]
    for _ in range(40):
        text = "".join(rng.choice(vocabulary) for _ in range(rng.randrange(900)))
        assert library.encode(text, add_special_tokens=False).ids == machine.encode(text).tolist()


def random_merges(rng):
    """A list as training makes it: every side is a letter or made before, every token once."""
    tokens, pairs = list("abc"), []
    for _ in range(rng.randrange(1, 25)):
        u, v = rng.choice(tokens), rng.choice(tokens)
        if u + v not in tokens and len(u + v) < 9:
            pairs.append((u, v))
            tokens.append(u + v)
    return pairs


def plain_merge(pairs, text):
    tokens = list(text)
    for u, v in pairs:
        at = 0
        while at + 1 < len(tokens):
            if (tokens[at], tokens[at + 1]) == (u, v):
                tokens[at : at + 2] = [u + v]
            at += 1
    return tokens


def test_the_lookahead_is_sufficient():
    rng = random.Random(7)
    early = 0
    for _ in range(400):
        pairs = random_merges(rng)
        merges = transducer.Merges(pairs)
        assert merges.lookahead is not None
        for _ in range(8):
            text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 120)))
            want = plain_merge(pairs, text)
            machine, out, at = transducer.Transducer(merges, hold=1), [], 0
            while at < len(text):
                step = rng.randrange(1, 9)
                out += machine.feed(text[at : at + step])
                at += step
                assert len(machine.pending) <= machine.hold + max(map(len, want)) + 9
            early += len(out)
            assert out + machine.finish() == want
            assert merges._long(list(text)) == merges._short(list(text)) == want
    assert early > 10_000


def test_lists_without_a_lookahead_are_held_whole():
    merges = transducer.Merges([("ab", "c"), ("a", "b")])
    assert merges.lookahead is None
    machine = transducer.Transducer(merges)
    assert list(machine.feed("abcab" * 500)) == [] and len(machine.finish()) == 500 * 2
    assert transducer.codec(TOKENIZER).merges.lookahead < 200


def test_decoder_waits_for_whole_characters():
    tokens = [bytes([b]) for b in range(256)]
    raw = "é東😂".encode() + b"\xff\xe6\x9d" + b"a" + b"\xf0\x9f"
    machine = transducer.TextDecoder(tokens, b"")
    parts = [machine.feed([b]) for b in raw] + [machine.finish()]
    assert "".join(parts) == raw.decode("utf-8", "replace")
    spaced = transducer.TextDecoder([b"a", b"", "é".encode()], b" ")
    assert spaced.feed([0, 2]) + spaced.feed([0]) + spaced.finish() == "a é a"


def test_fingerprints_take_insertions_and_deletions_in_any_order(spark):
    rows = [("one\ntwo", "three", "one\ntwo\nthree"), ("a", None, "a"), ("", "b\nc", "\nb\nc"), ("x\nx", "x", "x\nx\nx")]
    df = spark.createDataFrame(rows, "a string, b string, both string")
    lanes = lambda c: multiset._digest_lanes(multiset._paragraphs(F.col(c)))
    found = df.select(
        (multiset.insert(lanes("a"), F.col("b")) == multiset.insert(lanes("b"), F.col("a"))).alias("order"),
        (multiset.insert(lanes("a"), F.col("b")) == lanes("both")).alias("sum"),
        (multiset.delete(multiset.insert(lanes("a"), F.col("b")), F.col("b")) == lanes("a")).alias("back"),
        (multiset.delete(lanes("both"), F.col("a")) == lanes("b")).alias("rest"),
    ).collect()
    assert all(all(r) for r in found) and len(found) == len(rows)
