import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from routestats.llm import fingerprints as fp

RANKS = (np.arange(fp.CLASSES) * 619) % fp.CLASSES


def slow_classes(data):
    out = []
    for i in range(len(data) - 63):
        counts = Counter(data[i : i + 64].tolist())
        out.append((fp._FULL - sum(int(fp._GAIN[: c + 1].sum()) for c in counts.values())) * (fp.CLASSES - 1) // fp._FULL)
    return out


def slow_selected(text):
    data = fp._bytes(text)
    if not len(data):
        return []
    rank = [int(RANKS[c]) for c in slow_classes(data)]
    points = Counter()
    for start in range(-63, len(rank)):
        points[min((rank[i], i) for i in range(max(0, start), min(len(rank), start + 64)))[1]] += 1
    return [bytes(data[i : i + 64]) for i in sorted(points) if points[i] >= fp.POPULAR]


def test_entropy_is_that_of_the_window():
    data = np.frombuffer(("some plain text, 0123456789 " * 3 + "aaaa" * 40).encode(), np.uint8)
    assert fp.entropy_classes(data).tolist() == slow_classes(data)
    window = data[:64].tolist()
    entropy = -sum(n / 64 * math.log2(n / 64) for n in Counter(window).values())
    assert abs(fp.entropy_classes(data)[0] - entropy / 6 * (fp.CLASSES - 1)) < 1.1


def test_selection_against_a_plain_loop(mixed_texts):
    texts = [t[:3000] if t else t for t in mixed_texts]
    seen = {}
    for text, hashes in zip(texts, fp.features(texts, RANKS), strict=True):
        want = slow_selected(text)
        assert len(hashes) == len(want)
        for feature, value in zip(want, hashes.tolist(), strict=True):
            assert seen.setdefault(feature, value) == value
    assert len(set(seen.values())) == len(seen)


def test_pieces_of_a_long_text_select_as_the_whole(monkeypatch):
    text = "".join(chr(97 + i * i % 23) + " é"[i % 3 % 2] for i in range(9000))
    whole = fp.features([text], RANKS)[0]
    monkeypatch.setattr(fp, "BUFFER_BYTES", 1000)
    assert fp.features([text], RANKS)[0].tolist() == whole.tolist()


def test_likeness(mixed_texts):
    prints = [fp.digest(f) for f in fp.features(mixed_texts, RANKS)]
    for one in prints:
        assert fp.likeness(one, one) == 1
        for two in prints[:12]:
            assert 0 <= fp.likeness(one, two) <= 1 and fp.likeness(one, two) == fp.likeness(two, one)
    assert fp.likeness("", "") == 1 and fp.likeness("", prints[0]) == (0 if prints[0] else 1)
    base, other = ("".join("%x" % (i * k % 7919) + " " for i in range(8000)) for k in (31, 57))
    a, b, c = (fp.digest(f) for f in fp.features([base, base[: len(base) // 2] + other, other], RANKS))
    assert fp.likeness(a, b) > 0.4 > 0.1 > fp.likeness(a, c)


def test_digest_is_chained():
    raw = fp.digest(np.arange(400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    counts, bits = fp._filters(raw)
    assert counts.tolist() == [160, 160, 80] and bits.shape == (3, 2048)
    assert fp.digest(np.empty(0, np.uint64)) == ""


@pytest.mark.parametrize("group_rows", [500, 4])
def test_next_documents_against_a_loop(docs_of, mixed_texts, monkeypatch, clashing, group_rows):
    monkeypatch.setattr(fp, "GROUP_ROWS", group_rows)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(mixed_texts)]
    df = clashing(docs_of(rows))
    ranks = fp.rarity(df)
    found = {r.doc_id: r for r in fp.compare_with_next(df).collect()}
    order = sorted(rows)
    assert len(found) == len(rows)
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after, row = text or "", after or "", found[doc_id]
        edit = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, other, next_ = (fp.digest(f) for f in fp.features([text, edit, after], ranks))
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        assert (row.fingerprint, row.edited_fingerprint) == (own, other)
        assert (row.near_edited, row.near_next) == (fp.likeness(own, other), fp.likeness(own, next_))


def test_rarity_counts_all_windows(docs_of):
    texts = ["a" * 100, "ab" * 80, "the quick brown fox jumps over the lazy dog " * 9, None, "x"]
    counts = Counter(c for t in texts for c in (slow_classes(fp._bytes(t)) if t else []))
    want = sorted(range(fp.CLASSES), key=lambda c: (counts.get(c, 1 << 60), c))
    assert np.argsort(fp.rarity(docs_of(texts))).tolist() == want


def test_empty_single_and_repeated_rows(docs_of):
    assert fp.compare_with_next(docs_of([(0, "a")]).limit(0)).count() == 0
    (row,) = fp.compare_with_next(docs_of([(0, "lonely text" * 20)])).collect()
    assert row.near_next == 1
    rows = fp.compare_with_next(docs_of([(3, "b"), (3, "a"), (3, "a"), (None, "n"), (9, None)])).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_chars) for r in rows if r.doc_id is not None) == [
        (False, 3, 1), (False, 3, 1), (False, 3, 1), (False, 9, 0)]
    assert len(rows) == 5
