import hashlib
import random
import re

import pytest

from routestats.llm import repeated_passages as rp

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    first, words = {}, [(d, WORD.findall(t or "")) for d, t in rows]
    for doc_id, w in words:
        if doc_id is not None:
            for i in range(len(w) - 49):
                key = tuple(w[i : i + 50])
                first[key] = min(doc_id, first.get(key, doc_id))
    out = []
    for doc_id, w in words:
        gone = set()
        for i in range(len(w) - 49):
            if doc_id is not None and first[tuple(w[i : i + 50])] < doc_id:
                gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_against_all_windows(docs_of, mixed_texts, clashing):
    rows = list(enumerate(mixed_texts))
    assert result(rp.remove_repeats(clashing(docs_of(rows)))) == brute(rows)


@pytest.mark.parametrize(("shard", "automaton"), [(200_000, 500_000), (300, 120)])
def test_overlapping_and_broken_passages(docs_of, monkeypatch, shard, automaton):
    """Parts of the same passages in many documents, broken at different places, repeated within one document."""
    monkeypatch.setattr(rp, "SHARD_WORDS", shard)
    monkeypatch.setattr(rp, "AUTOMATON_WORDS", automaton)
    rng = random.Random(5)
    long = ["p%d" % i for i in range(400)]
    rows = []
    for doc_id in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            low = rng.randrange(350)
            part = long[low : low + rng.randrange(20, 130)]
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = "broken"
            words += part + ["f%d" % rng.randrange(50) for _ in range(rng.randrange(4))]
        rows.append((doc_id, " ".join(words)))
    rows += [(100 + i, "the same word " * (20 * i)) for i in range(4)]
    assert result(rp.remove_repeats(docs_of(rows))) == brute(rows)


def test_exactly_fifty_words(docs_of):
    words = ["w%d" % i for i in range(50)]
    rows = [(1, " ".join(words)), (2, "a " + " ".join(words) + " b"), (3, " ".join(words[:49])), (4, " ".join(words[:49] + ["x"]))]
    found = {r[0]: r[2] for r in result(rp.remove_repeats(docs_of(rows)))}
    assert found == {1: 0, 2: 50, 3: 0, 4: 0}


def test_words_are_not_folded_and_copies_lose_all(docs_of):
    words = " ".join("Word%d" % i for i in range(60))
    rows = [(5, words), (3, words), (4, words.lower()), (9, words.replace(" ", "\n\t"))]
    found = {r[0]: r[2] for r in result(rp.remove_repeats(docs_of(rows)))}
    assert found == {3: 0, 4: 0, 5: 60, 9: 60}


def test_empty_table_null_ids_and_repeated_rows(docs_of):
    words = " ".join("w%d" % i for i in range(60))
    assert rp.remove_repeats(docs_of([(0, words)]).limit(0)).count() == 0
    rows = [(None, words), (7, words), (7, words), (8, words), (8, words + " more"), (9, None), (10, "")]
    assert result(rp.remove_repeats(docs_of(rows))) == brute(rows)
