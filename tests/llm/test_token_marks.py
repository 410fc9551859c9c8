import numpy as np

from floodsift.llm import pack

NAME = "word_bpe_49k.json"


def test_words_with_several_marks_are_learnt_from_their_stem(monkeypatch):
    monkeypatch.setattr(pack, "_WORDS", {})
    encoded = []
    whole = pack._coded
    monkeypatch.setattr(pack, "_coded", lambda words, name: encoded.extend(words) or whole(words, name))
    text = "stem stem!! stem?! Stem... !! it's, 9.. é!!"
    want = pack._tokenizer(NAME).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(pack.token_ids(text, NAME), "<u4").tolist() == want
    assert b"stem!!" not in encoded and b"stem..." not in encoded


def test_words_forgotten_while_a_text_is_read_keep_their_ids(monkeypatch):
    monkeypatch.setattr(pack, "_WORDS", {})
    monkeypatch.setattr(pack, "CACHED_WORDS", 3)
    for text in ("one two three", "four five two", "one, two! six", "two one seven, eight!!"):
        want = pack._tokenizer(NAME).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(pack.token_ids(text, NAME), "<u4").tolist() == want
