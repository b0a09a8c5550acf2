import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from routestats.llm import repeated_bytes as rb
from routestats.llm import suffix_order as so


def brute(texts, length):
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, int)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i + 1] += 1
                gone[i + 1 + length] -= 1
        gone = np.cumsum(gone)[1:-1] > 0
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    letters = lambda n, kinds="abcdefgh ": "".join(rng.choice(kinds) for _ in range(n))
    passages = [letters(n) for n in (399, 400, 401, 900, 2500)]
    out = [letters(rng.randrange(1500)) for _ in range(25)]
    for _ in range(40):
        p = rng.choice(passages)
        low = rng.randrange(120)
        parts = [letters(rng.randrange(300)), p[low:] if rng.random() < 0.5 else p, letters(rng.randrange(300)), rng.choice(passages)[:430]]
        rng.shuffle(parts)
        out.append("".join(parts))
    out += [out[3], out[30], out[30], "", None, "short", "short", "a" * 3000, "ab" * 700, letters(20, "é") + "é" * 900,
            passages[3] + letters(50) + passages[3], "x" * 399, "y" * 400, "z" * 401]
    return out


@pytest.mark.parametrize("grams", [rb.GRAMS, (16, 100, 400)])
def test_whole_results_against_counting_all_windows(spark, docs_of, clashing, monkeypatch, texts, grams):
    monkeypatch.setattr(rb, "GRAMS", grams)
    if grams[0] == 16:  # common keys are cut by longer strings, and again
        monkeypatch.setattr(rb, "HOT_STRETCHES", 2)
        monkeypatch.setattr(rb, "CHUNK_BYTES", 700)
        monkeypatch.setattr(rb, "JOINED_BYTES", 900)
    found = rb.remove_repeated_bytes(clashing(docs_of(texts)), shard_bytes=20_000)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = [tuple(r) for r in found.orderBy("doc_id").collect()]
    assert rows == [(i, *r) for i, r in enumerate(brute(texts, rb.LENGTH))]


def test_null_and_repeated_ids_and_empty_table(spark, docs_of):
    text = "the same text again and again; " * 20
    rows = [(None, text), (None, "other"), (7, text + "x"), (7, text + "x"), (8, None), (8, "")]
    found = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans) for r in rb.remove_repeated_bytes(docs_of(rows)).collect())
    assert found == [(-1, 5, 0, 0), (-1, 620, 620, 1), (7, 621, 621, 1), (7, 621, 621, 1), (8, 0, 0, 0), (8, 0, 0, 0)]
    assert rb.remove_repeated_bytes(docs_of(["x"]).limit(0)).count() == 0


def test_equal_windows_lie_in_stretches_of_one_key():
    rng = np.random.default_rng(3)
    one = rng.integers(97, 101, 3000).astype(np.uint8)
    two = np.r_[rng.integers(97, 101, 777).astype(np.uint8), one[500:1700]]
    keys = []
    for data in (one, two):
        own = np.zeros(len(data) - 399, np.int64)
        for start, size, key, _, _ in rb.stretches(data, 64):
            for s, n, k in zip(start, size, key):
                own[s : s + n - 399] = k
        keys.append(own)
    assert (keys[0][500:1301] == keys[1][777:]).all() and (keys[0] != 0).all()


def naive(text, cap):
    order = sorted(range(len(text)), key=lambda i: text[i:])[::-1]
    out = []
    for before, i in zip([None, *order], order):
        n = 0
        while before is not None and n < cap and max(i, before) + n < len(text) and text[i + n] == text[before + n]:
            n += 1
        out.append((i, n))
    return out


@pytest.mark.parametrize("limit", [3, 60, so.QUEUE_RECORDS])
def test_suffixes_in_order_with_queues_on_disk(monkeypatch, limit):
    rng = random.Random(limit)
    for trial in range(120):
        for name, values in (("WIDE", (1, 4, 128)), ("STEP", (2, 5, 4096)), ("NARROW_STEP", (2, 7, 1024)), ("FEW", (1, 3, 16))):
            monkeypatch.setattr(so, name, rng.choice(values))
        kinds = rng.choice([1, 2, 3, 6, 80])
        text = [rng.randrange(kinds) for _ in range(rng.randrange(1, 160))]
        if trial % 2:
            low = rng.randrange(len(text))
            text += text[low:] + text[low:]
        shared_at_most, found = rng.choice([2, 9, 400]), []
        with so.Scratch(0 if limit < 100 else so.MEMORY_BYTES) as scratch:
            got = lambda pos, lcp: found.extend(zip(pos.tolist(), lcp.tolist()))  # noqa: B023, E731
            so.suffix_order(np.array(text, np.int32), kinds, shared_at_most, got, scratch, limit)
        # the order told is from the largest down: what one shares with the one told before
        assert [p for p, _ in found] == [p for p, _ in naive(text, shared_at_most)]
        assert found[1:] == naive(text, shared_at_most)[1:]


def test_symbols_of_some_hundred_suffixes_are_scanned_together():
    counts = np.array([500] * 60 + [5000] + [3] * 600)
    starts = so.ranges(counts)
    assert starts[0] == 0 and starts[-1] == len(counts) and 60 in starts and 61 in starts
    assert len(starts) <= 18  # four of the first to a range, the common one alone, the rare ones together


def test_files_of_a_sort_go_with_it(tmp_path, monkeypatch):
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    text = np.random.default_rng(1).integers(0, 5, 5000).astype(np.int32)
    with so.Scratch(0) as scratch:
        so.suffix_order(text, 5, 400, lambda pos, lcp: None, scratch, 100)
        assert any(tmp_path.iterdir())
    assert not any(tmp_path.iterdir())


def test_suffixes_that_share_enough_are_all_told(monkeypatch):
    def pairs(rows, need):
        out, before = set(), None
        for pos, lcp in rows:
            if lcp >= need:
                out |= {pos, before}
            before = pos
        return out

    rng, told, whole = random.Random(2), 0, 0
    for _ in range(500):
        for name, values in (("WIDE", (1, 4, 64)), ("STEP", (2, 5, 4096)), ("NARROW_STEP", (2, 5, 1024)), ("FEW", (1, 3, 16))):
            monkeypatch.setattr(so, name, rng.choice(values))
        kinds, need, found = rng.choice([1, 2, 3, 5, 50, 300]), rng.choice([2, 5, 12, 40]), []
        text = [rng.randrange(kinds) for _ in range(rng.randrange(1, 250))]
        for _ in range(rng.randrange(4)):
            low = rng.randrange(len(text))
            text += text[low : low + rng.randrange(60)] + [rng.randrange(kinds)]
        with so.Scratch() as scratch:
            got = lambda pos, lcp: found.extend(zip(pos.tolist(), lcp.tolist()))  # noqa: B023, E731
            so.suffix_order(np.array(text, np.int32), kinds, need, got, scratch, rng.choice([3, 1 << 20]), so.Needs(need))
        assert pairs(found, need) == pairs(naive(text, need), need)
        told, whole = told + len(found), whole + len(text)
    assert told < 0.8 * whole
