"""A short string that very many documents have between different neighbours."""

import numpy as np
import pytest

from floodsift.llm import substrings
from tests.llm.test_llm_operators import in_one_process, plain_strings


def crowded(n):
    rng = np.random.default_rng(n)
    noise = lambda: "".join(rng.choice(list("abcdefgh"), 60))
    return [(k, noise() + "All rights reserved, 2020 - 2024 by us." + (noise() if k % 5 else "x" * 60)) for k in range(n)]


@pytest.mark.parametrize("crowd", [3, 20, 100_000])
def test_rows_are_the_same_however_anchors_are_dealt(monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd, raising=False)
    texts = crowded(300) + [(1000 + k, t[20:110] + "q" * 30) for k, t in crowded(300)[::7]]
    assert in_one_process(texts, 4) == plain_strings(texts)


def test_no_owner_has_all_texts_of_an_anchor(monkeypatch):
    most, sort = [], substrings._sort
    count = lambda t: sum(len(r["c"]) // 4 for r in t.to_pylist() if r["step"] == 2)
    monkeypatch.setattr(substrings, "_sort", lambda t: most.append(count(t)) or sort(t))
    rng = np.random.default_rng(1)
    noise = lambda: "".join(rng.choice(list("abcdefgh"), 60))
    line = "All rights reserved, 2020 - 2024 by us and others."[:49]
    texts = [(k, noise() + line + noise()) for k in range(3000)]
    assert in_one_process(texts, 4) == plain_strings(texts)
    assert max(most) < len(texts) / 2


def near_copies(seed):
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(rng.choice(list("abcdéfgh"), n))
    base, found = word(1500), []
    for k in range(60):
        a = base
        for at in rng.integers(0, len(base), 12).tolist():
            a = a[:at] + word(int(rng.integers(0, 3))) + a[at + 1 :]
        found.append((k, a if k % 3 else a[: 700 + k]))
    return found


def test_what_all_strings_of_a_text_hold_is_sorted_as_one_symbol(monkeypatch):
    widths, sort = [], substrings.suffix_arrays
    monkeypatch.setattr(substrings, "suffix_arrays", lambda m: widths.append(m.shape[1]) or sort(m))
    docs = near_copies(5)
    assert in_one_process(docs, 4) == plain_strings(docs)
    del widths[:]
    assert in_one_process(docs[1:3], 2) == plain_strings(docs[1:3])
    assert widths and max(widths) < 2 * (substrings.SPAN + substrings.STRINGS)


def test_a_text_that_is_alone_with_its_anchor_is_not_sorted(monkeypatch):
    raw = bytes(range(40, 116))
    monkeypatch.setattr(substrings, "suffix_arrays", lambda m: 1 / 0)
    seen = substrings.smallest_documents([raw, raw], np.array([7, 7], np.uint64), np.array([5, 3]), np.array([26, 26]), np.array([24, 24]))
    assert (seen == 3).all()


def test_places_beyond_the_whole_strings_stay_open():
    raw = bytes(range(40, 110))
    seen = substrings.smallest_documents([raw, raw[:60]], np.array([7, 7], np.uint64), np.array([5, 3]), np.array([20, 20]), np.array([24, 24]))
    assert seen[0].tolist() == [3] * 11 + [5] * 10 + [substrings.NO_ID] * 6
    assert seen[1].tolist() == [3] * 11 + [substrings.NO_ID] * 16
