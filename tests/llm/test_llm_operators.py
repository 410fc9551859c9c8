"""The text operators against plain versions, on small tables with awkward rows."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from floodsift.llm import (
    components, language, lines, mix, multiset, neighbours, pack, simhash, spans, substrings, suffixes, toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, key string, length long, target double"
LONG = " ".join(f"word{k % 977}" for k in range(30_000))
PASSAGE = "One shared passage of plain words that goes on for quite a while. It has a second sentence with some more words in it. And a third one ends it."
TEXTS = [
    None, "", " \n\t ", "...", "a", "one two", PASSAGE, PASSAGE, f"Before it. {PASSAGE} After it.", LONG,
    "The line that many have, with a number 17 in it.\nan own line of this document here",
    "The line that many have, with a number 18 in it.\nyet another own line of that document",
    "short\nshort\nThe line that many have, with a number 18 in it.", "Été à la plage. Où est-ce ?", "x\x00y <|endoftext|> z",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (k, t, ("en", "fr", None)[k % 3], ("s0", "s1", None)[k % 3], "k", 7, 0.5) for k, t in enumerate(TEXTS)
    ]
    return spark.createDataFrame([*rows, rows[6], (None, PASSAGE, "en", "s0", "k", 7, 0.5)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_components(spark):
    edges = [(a, a + 1) for a in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    found = dict(rows_of(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {**{a: 0 for a in range(41)}, 100: 100, 101: 100}
    assert rows_of(components.components(spark.createDataFrame([], "a long, b long"))) == []


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    runs = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, none):
    near = simhash.near_duplicates(docs)
    got = near.select("doc_id", F.lpad(F.hex("f0"), 16, "0"), "component_id").collect()
    texts = dict(enumerate(TEXTS)) | {None: PASSAGE}
    assert len(got) == len(TEXTS) + 2
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    least = {k: k if k is not None else 99 for k in prints}
    for _ in prints:
        for a in prints:
            least[a] = min(least[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3)
    for k, f, c in got:
        assert int(f, 16) == prints[k] and c == least[k]
    assert rows_of(simhash.near_duplicates(none)) == []


@pytest.mark.parametrize("distance", [1, 3, 8])
def test_links_find_all_pairs_within_the_distance(spark, monkeypatch, distance):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(distance)
    seeds = rng.integers(0, 1 << 62, 40)
    values = {int(s) ^ sum(1 << int(b) for b in rng.integers(0, 62, rng.integers(0, 12))) for s in seeds for _ in range(8)}
    nodes = spark.createDataFrame([(v, v) for v in values], "node long, f0 long")
    found = dict(rows_of(components.components(simhash.links(nodes, distance))))
    least = {v: v for v in values}
    for _ in range(12):
        for a in values:
            least[a] = min(least[b] for b in values if (a ^ b).bit_count() <= distance)
    assert {v: found.get(v, v) for v in values} == least


def test_mix(docs, none):
    got = mix.mix(docs).select("doc_id", "source", "_size", "source_size", "target", "_copies").collect()
    assert len(got) == len(TEXTS) + 2 and all(0 <= r["_copies"] <= mix.CAP for r in got)
    by = {}
    for r in got:
        s = by.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        s[2], s[3] = s[2] + r["_size"], s[3] + r["_size"] * r["_copies"]
    assert all(s[0] == s[2] and s[1] <= 3 * s[0] + 1e-6 for s in by.values())
    assert sum(s[1] for s in by.values()) == pytest.approx(sum(s[0] for s in by.values()))
    assert rows_of(mix.mix(none)) == [] and mix.mixed(docs).columns == docs.columns


def test_mix_targets_share_the_excess(spark):
    sizes = [("sa", 100), ("sb", 4000), ("sc", 6000), ("z", 50)]
    got = {r[0]: r[2] for r in rows_of(mix.targets(spark.createDataFrame(sizes, "_source string, source_size long"), (5, 2, 1)))}
    # a and z are capped at three times their size; b and c share the rest by 2 and 1.
    assert got == {"sa": 300.0, "z": 150.0, "sb": pytest.approx(9700 * 2 / 3), "sc": pytest.approx(9700 / 3)}


def test_mix_comes_near_its_targets(spark):
    rows = [(k, " ".join(["w%d" % (j % (1 + k % 9)) for j in range(5 + k * 7 % 90)]), "s%d" % (k % 3)) for k in range(3000)]
    got = mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    sums = got.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("_size") * F.col("_copies")).alias("n")).collect()
    assert all(abs(r["t"] - r["n"]) <= 50 for r in sums)
    assert rows_of(got.orderBy("doc_id")) == rows_of(mix.mix(got.select("doc_id", "text", "source")).orderBy("doc_id"))


def naive_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(4))
def test_bins_are_those_of_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 400).tolist()
    plan = pack.plan_bins(dict(collections.Counter(lengths)), 64)
    ends = collections.Counter()
    for n in set(lengths):
        mine = sorted(r.tolist() for r in plan if r[0] == n)
        for k, (_, rank, first, fit, _) in enumerate(mine):
            until = mine[k + 1][1] if k + 1 < len(mine) else lengths.count(n)
            for at in range(until - rank):
                ends[first + at // fit] += n
    assert sorted(64 - e for e in ends.values()) == naive_best_fit(lengths, 64)


def test_pack(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = pack.pieces(docs, "word_bpe_49k.json", 64, ids=True)
    coded = collections.defaultdict(dict)
    for r in found.collect():
        coded[r["doc_id"]][r["start"]] = bytes(r["ids"])
    for k, t in (dict(enumerate(TEXTS)) | {None: PASSAGE}).items():
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        assert b"".join(v for _, v in sorted(coded[k].items())) == np.array(ids, "<u4").tobytes()
    packed = pack.pack(found.drop("ids"), 64).collect()
    places = collections.defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        end = 0
        for offset, n in sorted(held):
            assert offset == end
            end += n
        assert end <= 64
    assert len(places) == len(naive_best_fit([r["length"] for r in packed], 64))
    assert rows_of(pack.pack_documents(none, "word_bpe_49k.json")) == []


def test_language(spark, docs, none):
    texts = {"en": "the cat and the other thing with that", "fr": "le chat et une autre chose avec cela"}
    known = spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(list(texts.items()) * 5)], "key long, text string, lang string")
    langs, model = language.fit(known)
    half = " ".join([texts["en"], texts["fr"]] * 4)
    asked = spark.createDataFrame([(1, texts["en"]), (2, half), (3, "123"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.predict(asked, langs, model, ["doc_id"]).collect()}
    assert got[1]["lang_pred"] == "en" and got[1]["languages"] == ["en"]
    assert sorted(got[2]["languages"]) == ["en", "fr"] and min(got[2]["proportions"]) > 0.3
    assert all(got[k]["lang_pred"] == "und" for k in (3, 4, 5))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(docs, ["doc_id", "length"]).count() == len(TEXTS) + 2
    assert rows_of(language.identify(none, ["doc_id"])) == []


def test_lines(spark, docs, none):
    got = {r["doc_id"]: r for r in lines.drop_near_lines(docs).collect()}
    assert got[11]["text"] == "yet another own line of that document" and got[11]["_lines_removed"] == 1
    assert got[12]["text"] == "short\nshort" and got[10]["_lines_removed"] == 0 and got[0]["text"] is None
    assert got[7]["text"] == "" and lines.drop_near_lines(none).columns == [*none.columns, "_lines_removed"]
    assert rows_of(lines.drop_near_lines(none)) == []


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_join_and_distance(spark, edits):
    rng = np.random.default_rng(edits)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice(list("abé"), rng.integers(8, 40)))
        b = list(a)
        for _ in range(rng.integers(0, edits + 2)):
            at = int(rng.integers(0, len(b)))
            b[at : at + int(rng.integers(0, 2))] = rng.choice(list("abx"), rng.integers(0, 2)).tolist()
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    wanted = F.levenshtein("a", "b") <= edits
    assert df.where(lines.within_edits(F.col("a"), F.col("b"), edits) != wanted).count() == 0
    texts = df.select(F.col("a").alias("line")).union(df.select("b")).distinct().withColumn("h", F.xxhash64("line"))
    far = ~lines.may_be_near(lines.letters(F.col("a")), lines.letters(F.col("b")), edits)
    assert df.where(far & wanted).count() == 0
    every = texts.alias("x").join(texts.alias("y"), F.expr(f"x.h < y.h and levenshtein(x.line, y.line) <= {edits}"))
    assert {tuple(sorted(r)) for r in rows_of(lines.near_pairs(texts, edits))} == set(rows_of(every.select("x.h", "y.h")))


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((30, 16))
    vectors = (centres[rng.integers(0, 30, 1500)] + rng.standard_normal((1500, 16)) * 0.4).astype(np.float32)
    vectors[3] = vectors[20] = vectors[41]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(vectors)]
    odd = [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [None] * 16, 0), (None, [1.0] * 16, 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = collections.defaultdict(dict)
    for q, rank, v, score in rows_of(neighbours.nearest(table)):
        got[q][rank] = (v, score)
    exact = vectors.astype(float)
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        scores = exact @ exact[q]
        order = [v for v in np.lexsort((np.arange(1500), -scores)) if v != q][:20]
        assert sorted(found) == list(range(1, 21)) and q not in {v for v, _ in found.values()}
        assert all(s == pytest.approx(scores[v], rel=1e-12) for v, s in found.values())
        hits += len({v for v, _ in found.values()} & set(order))
    assert hits / (20 * len(got)) >= 0.9
    assert rows_of(neighbours.nearest(spark.createDataFrame(odd, table.schema))) == []


@pytest.mark.parametrize("equal", [60, 203, 503])
def test_ties_of_neighbours_go_to_the_smaller_id(spark, equal):
    rng = np.random.default_rng(equal)
    same, others = rng.standard_normal(24), rng.standard_normal((300, 24)) * 0.1
    rows = [(k, same.tolist()) for k in range(equal)] + [(1001 + k, v.tolist()) for k, v in enumerate(others)]
    got = collections.defaultdict(list)
    for q, rank, v, _ in sorted(rows_of(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))):
        got[q].append(v)
    for q in range(0, equal, 20):
        assert got[q] == [v for v in range(21) if v != q][:20]


def test_neighbours_of_repeated_ids_and_other_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.standard_normal(8).tolist()) for k in range(60)]
    rows += [(20, rng.standard_normal(8).tolist()), rows[40], rows[7]] + [(100 + k, rng.standard_normal(3).tolist()) for k in range(5)]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=70)
    got = collections.Counter()
    for q, _, v, score in rows_of(found):
        got[q, v, round(score, 9)] += 1
    want = collections.Counter()
    asked = {(q, tuple(x)) for q, x in rows if q % 20 == 0}
    for q, x in asked:
        want.update((q, v, round(float(np.dot(x, y)), 9)) for v, y in rows if v != q and len(x) == len(y))
    assert got == want


@pytest.mark.parametrize("symbols", [1, 2, 4, 30])
def test_suffix_arrays(symbols):
    for length in (1, 3, 40):
        text = np.random.default_rng(length).integers(0, symbols, (30, length))
        for row, got in zip(text.tolist(), suffixes.suffix_arrays(text).tolist()):
            assert got == sorted(range(length), key=lambda k: row[k:])


def plain_strings(texts):
    seen, out = set(), {}
    for key, text in texts:
        raw = (text or "").encode()
        gone, own = bytearray(len(raw)), set()
        for s in range(len(raw) - 49):
            if raw[s : s + 50] in seen:
                gone[s : s + 50] = b"\x01" * 50
            own.add(raw[s : s + 50])
        seen |= own
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[key] = (len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def in_one_process(texts, batches):
    """The same steps as on Spark, with the tables passed by hand."""
    def grouped(tables, by):
        rows = [r for t in tables for r in t.to_pylist()]
        found = {}
        for r in rows:
            found.setdefault(r[by], []).append(r)
        return {k: pa.Table.from_pylist(v, schema=substrings._PACKED) for k, v in found.items()}

    dealer = substrings.Dealer(sum(len(t or "") for _, t in texts))
    tables = [
        pa.table({"key": pa.array([k for k, _ in texts[b::batches]], pa.int64()), "text": [t or "" for _, t in texts[b::batches]]})
        for b in range(batches)
    ]
    empty, answers = substrings._PACKED.empty_table(), []
    told = lambda: grouped(answers, "batch")
    sent = [substrings._count(dealer, b, t) for b, t in enumerate(tables)]
    answers += [substrings._shared(t) for t in grouped(sent, "owner").values()]
    made = [substrings.Batch(dealer, t, told().get(b, empty)) for b, t in enumerate(tables)]
    sent = [x.ask(b) for b, x in enumerate(made)]
    answers += [substrings._resolve(t) for t in grouped(sent, "owner").values()]
    sent = [x.send(dealer, b, x.told(told().get(b, empty))[0]) for b, x in enumerate(made)]
    answers += [substrings._sort(t) for t in grouped(sent, "owner").values()]
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    schema = pa.schema([(n, pa.int64()) for n in names[:-1]] + [(names[-1], pa.string())])
    out = [substrings._remove(dealer, t, told().get(b, empty), schema) for b, t in enumerate(tables)]
    return {r["key"]: tuple(r.values())[1:] for t in out for r in t.to_pylist()}


@pytest.mark.parametrize("contexts, joined", [(16, 64), (2, 64), (2, 2), (1, 3)])
def test_substrings_with_many_contexts(monkeypatch, contexts, joined):
    monkeypatch.setattr(substrings, "CONTEXTS", contexts)
    monkeypatch.setattr(substrings, "JOINED", joined)
    rng = np.random.default_rng(contexts)
    words = [f"w{k}" for k in range(60)]
    shared = " ".join(rng.choice(words, 60))
    texts = []
    for k in range(60):
        at, end = sorted(rng.integers(0, len(shared), 2).tolist())
        noise = " ".join(rng.choice(words, rng.integers(0, 40)))
        texts.append((k, noise + shared[at:end] + "the the " * int(rng.integers(0, 20)) + noise[::-1] + shared[:at]))
    assert in_one_process(texts, 4) == plain_strings(texts)


def test_substrings(docs, none):
    got = {r[0]: tuple(r[1:]) for r in rows_of(substrings.drop_repeated_strings(docs))}
    assert got == plain_strings([*enumerate(TEXTS), (None, PASSAGE)])
    assert rows_of(substrings.drop_repeated_strings(none)) == []


def test_spans(docs, none):
    got = {r["doc_id"]: r for r in spans.drop_repeated_spans(docs).collect()}
    assert got[6]["n_removed"] == 0 and got[7]["text"] == "" and got[None]["n_removed"] == 3
    assert got[8]["text"].split() == ["Before", "it.", "After", "it."] and got[9]["text"] == LONG
    assert got[0]["text"] == "" and rows_of(spans.drop_repeated_spans(none)) == []


def test_toxicity(spark, docs, none):
    clean = ["the weather is fine today.", "we went to the sea.", "a book about trees.", "he cooks well."]
    rows, labels = [], []
    for k in range(200):
        text = " ".join(clean[(k + j) % 4] for j in range(3)) + (" you are a vile scum." if k % 5 == 0 else "")
        rows.append((k, text))
        labels.append((k, int(k % 5 == 0)))
    table = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    marked = spark.createDataFrame([*labels, (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.detect(table, marked, ["doc_id"]).collect()}
    assert all(got[k]["predicted"] == int(k % 5 == 0) for k in range(200))
    assert got[5]["offending"] == [3] and got[900]["predicted"] == 0 and 0 <= got[901]["score"] <= 1
    assert toxicity.detect(docs, marked.limit(0), ["doc_id"]).count() == len(TEXTS) + 2
    assert rows_of(toxicity.detect(none, marked, ["doc_id"])) == []


def test_multiset(spark, docs, none):
    ordered = [(None, PASSAGE)] + list(enumerate(TEXTS))
    got = collections.defaultdict(list)
    for r in multiset.compare(docs).collect():
        got[r["doc_id"]].append(r)
    assert len(got[6]) == 2 and sum(map(len, got.values())) == len(TEXTS) + 2
    for (k, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r = got[k][0]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (edited == text)
    assert got[6][0]["fingerprint"] == got[7][0]["fingerprint"] == got[None][0]["fingerprint"]
    assert got[6][0]["near_next"] == 1.0 and got[9][0]["near_edited"] > 0.6 > got[9][0]["near_next"]
    assert rows_of(multiset.compare(none)) == []


def test_fingerprints_are_sums_of_paragraphs(spark):
    texts = ["alpha beta gamma delta\nsecond paragraph of text here\nthird", "third\nalpha beta gamma delta\nsecond paragraph of text here"]
    got = multiset.compare(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert got[0]["fingerprint"] == got[1]["fingerprint"]
    edited = [t[: len(t) - len(t) // 4] + texts[1 - k][: len(t) // 4] for k, t in enumerate(texts)]
    again = multiset.compare(spark.createDataFrame(list(enumerate(edited)), "doc_id long, text string")).collect()
    whole = {r["doc_id"]: r["fingerprint"] for r in again}
    assert {r["doc_id"]: r["edited_fingerprint"] for r in got} == whole
