"""Repeated passages that hold fewer than two whole sentences."""

import re

import numpy as np
import pytest

from floodsift.llm import spans


@pytest.mark.parametrize("seed", range(3))
def test_passages_without_whole_sentences_go(spark, seed):
    rng = np.random.default_rng(seed)
    own = iter(range(10**6))
    fresh = lambda n: " ".join(f"o{next(own)}" for _ in range(n))
    one = " ".join(f"p{x}" for x in rng.integers(0, 400, 55))
    edges = [f"q{x}" for x in rng.integers(0, 400, 55)]
    edges[25] += "."
    inside = " ".join(edges)
    texts = [
        f"{fresh(9)}. {one.capitalize()}. {fresh(9)}.", f"{fresh(9)} {inside} {fresh(9)}.", f"{fresh(30)}.\n{fresh(25)}",
        f"{fresh(9)}. {one}. {fresh(9)}.", f"{fresh(9)} {inside} {fresh(9)}.", f"{fresh(9)} {one} {fresh(9)}\n{fresh(3)}",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in spans.drop_repeated_spans(docs).collect()}
    assert all(got[k]["text"] == texts[k] and got[k]["n_removed"] == 0 for k in range(3))
    for k in range(3, 6):
        was, left = texts[k].split(), got[k]["text"].split()
        assert [w for w in left if w[0] == "o"] == [w for w in was if w[0] == "o"]
        assert len([w for w in left if w[0] != "o"]) <= 2 * (spans.CHOICE - 1) and got[k]["n_removed"] > 0


def test_hashes_are_those_of_plain_loops():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    for width in (1, 2, 5, 8, 20, 60):
        plain = np.zeros(61 - width, np.uint64)
        for k in range(width):
            plain = plain * np.uint64(0x9E3779B97F4A7C15) + h[k : k + 61 - width]
        assert (spans._polynomials(h, width) == plain).all()
        assert spans._least(h, width).tolist() == [min(h[k : k + width].tolist()) for k in range(61 - width)]
    for _ in range(200):
        text = "".join(rng.choice(list("aΣ .!?\n\r\x85\x1c"), rng.integers(0, 40)))
        parts, met = spans.sentences(text), []
        assert parts == re.split(r"(?<=[.!?])(?=\s)|(?<=\n)(?=.)", text, flags=re.S)
        spans.span_hashes(parts, met)
        assert met == text.lower().split()
