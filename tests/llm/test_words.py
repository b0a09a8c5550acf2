import re

import numpy as np

from routestats.llm import words as w

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_equal_words_have_equal_hashes_and_others_not(mixed_texts):
    known = {}
    for text in mixed_texts:
        found = WORD.findall(text or "")
        hashes = w.word_hashes(text)
        assert len(hashes) == len(found)
        for word, value in zip(found, hashes.tolist(), strict=True):
            assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)


def test_folding_only_touches_ascii():
    assert w.word_hashes("ABC É", lower=True).tolist() == w.word_hashes("abc É").tolist()
    assert w.word_hashes("É", lower=True).tolist() != w.word_hashes("é", lower=True).tolist()


def test_chunks_give_the_same_hashes(monkeypatch):
    text = " ".join(["some", "words", "x" * 50, "\n\t", "end"] * 40) + "y" * 300
    whole = w.hashed_words(text)
    monkeypatch.setattr(w, "CHUNK_BYTES", 16)
    for one, two in zip(whole, w.hashed_words(text), strict=True):
        assert one.tolist() == two.tolist()


def test_runs_agree_for_short_and_long_sizes():
    hashes = w.word_hashes("a b c d e f g h i j a b c d e f g h i j k")
    for size in (1, 5, 8, 9, 10):
        found = w.runs(hashes, size)
        assert len(found) == 21 - size + 1
        assert found[0] == found[10] and len(set(found[:10].tolist())) == 10
    assert len(w.runs(hashes, 22)) == 0


def test_shingles():
    assert len(w.shingles(w.word_hashes(None), 5)) == 0
    assert len(w.shingles(w.word_hashes("a b"), 5)) == 1
    assert len(w.shingles(w.word_hashes("a b c d e f a b c d e"), 5)) == 6
    assert np.array_equal(w.shingles(w.word_hashes("a  b"), 5), w.shingles(w.word_hashes("\na b "), 5))
