"""Rows near the limits of the text operators, against brute force."""

import numpy as np
import pytest

import corpus_pipeline
from floodsift.llm import pack, queries, simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def test_near_duplicates_are_those_of_the_exact_similarity(spark):
    rng = np.random.default_rng(1)
    texts = ["", None, "one two", "One two", "three four"]
    for g in range(120):
        base = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(40, 160))]
        texts.append(" ".join(base))
        for _ in range(1 + g % 2):
            other = list(base)
            for at in rng.choice(len(base), max(1, int(len(base) * rng.uniform(0.01, 0.04))), replace=False):
                other[at] = f"x{rng.integers(0, 5000)}"
            texts.append(" ".join(other))
    texts += [" ".join([*(f"c{k}" for k in range(90)), f"own{j}"]) for j in range(40)]
    sets, near = [shingles(t or "") for t in texts], 0
    least = list(range(len(texts)))
    pairs = []
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            share = both / (len(sets[a]) + len(sets[b]) - both)
            near += 0.75 < share < 0.85
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                pairs.append((a, b))
    for _ in range(8):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert near > 30
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(least))


def test_near_duplicates_have_like_fingerprints_as_well(spark):
    # Edits spread over a long text leave few shingles of five words, but change few bits.
    words = " ".join(["common words that come again and again"] * 60).split()
    other = list(words)
    other[10::40] = [f"x{k}" for k in range(len(other[10::40]))]
    texts = [" ".join(words), " ".join(other), "quite another text"]
    assert len(shingles(texts[0]) & shingles(texts[1])) < 0.8 * len(shingles(texts[0]) | shingles(texts[1]))
    docs = spark.createDataFrame([(n + 5, t) for n, t in enumerate(texts)], "doc_id long, text string")
    assert len({r["f0"] for r in simhash.near_duplicates(docs).collect()}) > 1
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == [5, 7]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain_lines(texts):
    seen, out = [], []
    for text in texts:
        kept = []
        for line in text.split("\n"):
            near = lambda x: x == line or plain_distance(x, line) <= min(2, min(len(x), len(line)) // 12)
            if not (line.strip() and any(near(x) for x in seen)):
                kept.append(line)
            seen.append(line)
        out.append("\n".join(kept))
    return out


def test_short_lines_go_as_well(spark, tmp_path):
    rng = np.random.default_rng(2)
    lines = ["All rights reserved.", "a", "", "  ", "Seite 1", "Seite 2"]
    for _ in range(40):
        line = "".join(rng.choice(list("abc "), rng.integers(3, 30)))
        lines += [line, line[:-1], line + "x", line[:4] + "y" + line[4:-1] + "z"]
    texts = ["\n".join(rng.choice(lines, 6)) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in queries.op4_line_edit_join(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(plain_lines(texts)))


def test_a_full_cache_of_words_keeps_the_recent_ones(monkeypatch):
    monkeypatch.setattr(pack, "CACHED_WORDS", 100)
    tokenizer = pack._tokenizer("word_bpe_49k.json")
    for n in range(200):
        text = f"the common words number{n} own{n * 7919}, own{n}x."
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(pack.token_ids(text, "word_bpe_49k.json"), "<u4").tolist() == ids
        assert len(pack._WORDS) < 120 and (n < 8 or b"common" in pack._RECENT | set(pack._WORDS))
    pack._WORDS["number0".encode()] = b"old"
    monkeypatch.setattr(pack, "CACHED_WORDS", 1)
    pack._RECENT.clear()
    pack.token_ids("quite", "word_bpe_49k.json")
    assert b"number0" not in pack._WORDS
    monkeypatch.setattr(pack, "CACHED_WORDS", 100)
    pack._WORDS.update({f"w{n}".encode(): b"" for n in range(101)})
    pack._RECENT.update([b"w7"])
    pack.token_ids("never met before", "word_bpe_49k.json")
    assert b"w7" in pack._WORDS and b"w8" not in pack._WORDS
    pack._WORDS.clear()
