import dataclasses
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from routestats.llm import toxicity as tx

LABELS = "doc_id long, quality int, toxic int"
COMMON = ["w" + a + b for a in "abcdefgh" for b in "abcde"]


def test_held_out_accuracy(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = tx.score_toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 and len(r.evidence) == len(r.cosines) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.9
    assert not {e for r in rows for e in r.evidence} & {r.doc_id for r in held}


def random_index(random, examples=500, terms=40):
    rows = []
    for i in range(examples):
        at = np.sort(random.choice(terms, random.integers(0, 6), replace=False))
        rows.append((int(i * 7 % 1009), int(random.integers(2)), at.tolist(), random.integers(1, 4, len(at)).tolist()))
    idf = random.random(terms) + 0.1
    return tx.build_index(np.arange(terms), idf, rows, 0.3), rows, idf


def full_vectors(rows, idf):
    full = np.zeros((len(rows), len(idf)))
    for i, (_, _, at, number) in enumerate(rows):
        full[i, at] = (1 + np.log(number)) * idf[at]
    return full / np.linalg.norm(full, axis=1, keepdims=True)


@pytest.mark.parametrize(("block", "dense"), [(tx.BLOCK, tx.DENSE), (16, 1), (16, 10**6), (7, 8)])
def test_nearest_against_all_cosines(monkeypatch, block, dense):
    monkeypatch.setattr(tx, "BLOCK", block)
    monkeypatch.setattr(tx, "DENSE", dense)
    random = np.random.default_rng(6)
    index, rows, idf = random_index(random)
    rows = [r for r in rows if r[2]]
    full = full_vectors(rows, idf)
    queries = []
    for _ in range(60):
        at = np.sort(random.choice(len(idf), random.integers(1, 5), replace=False))
        queries.append((at, tx._weights(idf, at, random.integers(1, 4, len(at)))))
    for (at, query), (found, near, weight) in zip(queries, index.nearest(queries)):
        cosine = np.round(full[:, at] @ query, 12)
        order = [i for i in np.lexsort(([r[0] for r in rows], -cosine)) if cosine[i] > 0][: tx.NEIGHBOURS]
        assert index.ids[found].tolist() == [rows[i][0] for i in order]
        assert np.allclose(near, cosine[order])
        assert np.allclose(weight, full[order][:, at] @ (query * index.contrast[at]))


class Reads(np.ndarray):
    """An array that counts the values read of it."""

    total = 0

    def __getitem__(self, at):
        found = super().__getitem__(at)
        Reads.total += np.size(found)
        return np.asarray(found)


def test_only_shared_terms_are_weighed():
    rows = [(i, i % 2, [0, *range(1 + 50 * i, 51 + 50 * i)], [1] * 51) for i in range(8)]
    index = tx.build_index(np.arange(401), np.ones(401), rows, 0.3)
    (want,) = index.nearest([(np.array([0]), np.ones(1))])
    counts, begun = index.count.view(Reads), {name: getattr(index, name) for name in ("length", "contrast", "line", "common", "highest", "lists")}
    unit = {"unit": index.unit.view(Reads)} if hasattr(index, "unit") else {}
    index = dataclasses.replace(index, count=counts)
    index.__dict__.update(begun | unit)
    Reads.total = 0
    (found,) = index.nearest([(np.array([0]), np.ones(1))])
    assert all((a == b).all() for a, b in zip(want, found, strict=True)) and len(found[0]) == 8
    assert Reads.total == 8


def test_letters_beyond_the_first_plane_keep_their_hashes():
    def hashes(word):
        codes = np.array([ord(c.lower()) for c in word], np.uint64)
        powers = np.array([pow(tx._BASE, i, 1 << 64) for i in range(len(codes))], np.uint64)
        sums = np.cumsum(tx.mix(codes) * powers, dtype=np.uint64)
        first = [] if len(word) <= tx.STEM else [tx.mix(sums[tx.STEM - 1 : tx.STEM] + tx._STEM)[0]]
        return {int(x) for x in [tx.mix(sums[-1:] + tx._WHOLE)[0], *first]}

    words = ["Plain", "\U00020000\U00020001", "a\U00020000bcdE", "\U0001F600", "ÀÉ", "zz\U00020000"]
    want = set().union(*map(hashes, words))
    for text in (" ".join(words), "1".join(words[::-1])):
        assert {int(x) for x in tx.terms(text)[0].view(np.uint64)} == want


def test_bounds_hold():
    index, _, _ = random_index(np.random.default_rng(7))
    for line, highest in zip(index.common, index.highest):
        assert [line[low : low + tx.BLOCK].max() for low in range(0, len(line), tx.BLOCK)] == highest.tolist()
    listed = np.diff(index.lists[0])
    held = np.bincount(index.term, minlength=len(index.idf))
    assert (np.where(index.line >= 0, (index.common > 0).sum(axis=1)[index.line], listed) == held).all()


def plain_terms(text):
    """Words of letters, small, and the first four letters of longer ones."""
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        out[word] += 1
        if len(word) > tx.STEM:
            out[word[: tx.STEM], "stem"] += 1
    return out


def test_whole_score_against_plain_loops(spark, sf):
    folder = sf
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("text is null or not text rlike '[^\\\\x00-\\\\x7f]'")
    texts = {r.doc_id: plain_terms(r.text) for r in docs.collect()}
    label = {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1)}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    examples = {i: v for i, v in label.items() if i in texts and not held(i)}
    often = Counter(t for c in texts.values() for t in c)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) for t, n in often.items()}
    vocabulary = {t for i in examples for t in texts[i]}

    def vector(counts):
        weights = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items() if t in vocabulary}
        length = math.sqrt(sum(w * w for w in weights.values())) or 1
        return {t: w / length for t, w in weights.items()}

    vectors = {i: vector(texts[i]) for i in examples}
    number = Counter(examples.values())
    seen = {v: Counter(t for i in examples if examples[i] == v for t in texts[i]) for v in (0, 1)}
    frequency = lambda t, v: math.log((seen[v][t] + 0.5) / (number[v] + 1))
    contrast = {t: abs(frequency(t, 1) - frequency(t, 0)) ** tx.CONTRAST for t in vocabulary}
    share = number[1] / len(examples)
    known = [v for i, v in label.items() if not held(i)]
    rate = sum(known) / len(known)

    def calibrated(s):
        one = s * rate / share
        return one / (one + (1 - s) * (1 - rate) / (1 - share))

    rows = {r.doc_id: r for r in tx.score_toxicity(docs, labels).collect()}
    assert rows.keys() == texts.keys() and 0 < share < 1
    for i, counts in texts.items():
        query = vector(counts)
        cosine = {e: sum(w * query.get(t, 0) for t, w in v.items()) for e, v in vectors.items()}
        near = sorted((e for e in cosine if round(cosine[e], 12) > 0), key=lambda e: (-round(cosine[e], 12), e))[: tx.NEIGHBOURS]
        if not query:
            continue
        votes = {
            e: sum(w * query.get(t, 0) * contrast[t] for t, w in vectors[e].items()) / (1 - min(cosine[e], 1) + tx.NEAREST) for e in near
        }
        one = sum(v for e, v in votes.items() if examples[e]) + tx.PRIOR_VOTES * share
        want = calibrated(one / (sum(votes.values()) + tx.PRIOR_VOTES))
        assert abs(rows[i].score - want) < 1e-9, i
        assert np.allclose(rows[i].cosines, [cosine[e] for e in near[: tx.EVIDENCE]])


def test_examples_are_bounded_by_their_terms(spark, docs_of, monkeypatch):
    monkeypatch.setattr(tx, "EXAMPLE_TERMS", 40)
    texts = [" ".join("abcdefghij"[i % 10] * (j + 1) for j in range(4)) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], LABELS)
    index, _ = tx.fit_toxicity(docs_of(texts), labels, F.lit(True))
    assert np.bincount(index.labels.astype(int), np.diff(index.begin)).tolist() == [40, 40]


def test_terms():
    def names(text):
        return tx.terms(text)[0].tolist()

    assert names("Idiots, IDIOTS!") == names("idiots") and tx.terms("Idiots, IDIOTS!")[1].tolist() == [2, 2]
    assert len(set(names("idiots")) & set(names("idiotic"))) == 1  # the same first letters
    assert len(names("abcd")) == 1 and len(names("Éàü")) == 1 and names("ÉÀÜ") == names("éàü")
    assert names(None) == names("") == names("123 !!") == []
    long = " ".join("w" + "abcdefgh"[i % 8] * (i % 5 + 1) for i in range(50_000))
    assert sorted(names(long)) == sorted(set(names(" ".join(sorted(set(long.split()))))))
    assert len(names("x" * 2_000_000)) == 2


def test_long_words_have_one_hash_in_every_text():
    letters = np.array(list("acgt"))
    rng = np.random.default_rng(9)
    words = ["a" * 64 + "".join(letters[rng.integers(0, 4, 6)]) + chr(97 + i % 26) * (i // 26 % 7) for i in range(10_000)]
    alone = np.concatenate([tx.terms(" ".join(words[at : at + 100]))[0] for at in range(0, len(words), 100)])
    values, counts = tx.terms(" ".join(words))
    assert values.tolist() == np.unique(alone).tolist() and counts.sum() == 2 * len(words)
    assert len(values) == len(set(words)) + 1  # and the first letters, which all share
    huge = "ab" * 700_000
    assert set(tx.terms(huge)[0]) < set(tx.terms(f"one {huge} two")[0])
    assert len(set(tx.terms(f"{huge}x {huge}y {huge}")[0])) == 4
    at = len(tx._UP)
    one, two = "q" * at, "q" * at + "r"  # as long as a chunk, and longer
    assert len(tx.terms(f"{one} {two} {one}")[0]) == 3


def test_toxic_rows_are_found_at_each_size(spark, docs_of):
    """Toxic rows share one of several words, each far too rare for a cut by counts; all other words are everywhere."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    for size in (60, 400, 1600):
        rng = np.random.default_rng(size)
        toxic = [i % 4 == 0 for i in range(size)]
        slurs = [letters[i % 26] + "xy"[i // 26] + "urls" for i in range(size // 40)]
        texts = [" ".join([*rng.choice(COMMON, 30), slurs[i // 4 % len(slurs)] if toxic[i] else "mild"]) for i in range(size)]
        labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic)], LABELS)
        held = [r for r in tx.score_toxicity(docs_of(texts), labels).collect() if r.held_out]
        missed = [r.doc_id for r in held if r.predicted < toxic[r.doc_id]]
        false = [r.doc_id for r in held if r.predicted > toxic[r.doc_id]]
        assert sum(toxic[r.doc_id] for r in held) > 0
        assert len(missed) + len(false) <= len(held) // 20, (size, len(held), missed, false)


def test_all_terms_of_the_examples_are_kept(spark, docs_of):
    texts = [f"word{'abcdefgh'[i % 8]} only{'abcdefghijklmnopqrstuvwxyz'[i % 26]} rest" for i in range(50)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(50)], LABELS)
    index, _ = tx.fit_toxicity(docs_of(texts), labels, F.lit(True))
    assert index.vocabulary.tolist() == tx.terms(" ".join(texts))[0].tolist()
    assert len(index.term) == sum(len(tx.terms(t)[0]) for t in texts)


def test_calibration_moves_shares_to_the_population():
    index, _, _ = random_index(np.random.default_rng(8))
    assert abs(index.calibrated(index.share) - 0.3) < 1e-12
    assert index.calibrated(0.0) == 0 and index.calibrated(1.0) == 1


def test_rows_and_labels_of_every_kind(spark, docs_of, mixed_texts, clashing):
    texts = [f"{t} {'vile slurs' if i % 3 == 0 else 'fine talk'}" if t else t for i, t in enumerate(mixed_texts * 3)]
    df = clashing(docs_of([*enumerate(texts), (None, "vile slurs"), (3, texts[3])]))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(len(texts))] + [(None, 1, 1), (1, 1, None), (2, 1, 9), (999, 1, 1)], LABELS)
    rows = tx.score_toxicity(df, labels).collect()
    assert len(rows) == df.count()
    said = {r.doc_id: r for r in rows}
    for i, text in enumerate(texts):
        if text:
            assert said[i].predicted == (i % 3 == 0), (i, said[i])
    assert len({r.score for r in rows if r.doc_id is not None and not texts[r.doc_id]}) == 1
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.predicted for r in tx.score_toxicity(df, none).collect()} == {0}
    assert tx.score_toxicity(df.limit(0), labels).count() == 0
    assert tx.score_toxicity(df, labels).where(F.col("doc_id").isNull()).first().held_out is False
