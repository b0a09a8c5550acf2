import random
import re

import numpy as np
import pytest

from routestats.llm import near_duplicates as nd
from routestats.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    sets = {}
    for doc_id, text in rows:
        words = WORD.findall(fold(text))
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def result(df):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()}


def test_against_all_pairs(docs_of, mixed_texts, clashing):
    rows = list(enumerate(mixed_texts))
    assert result(nd.near_duplicates(clashing(docs_of(rows)))) == brute(rows)


@pytest.mark.parametrize("block_rows", [1024, 5])
def test_chains_and_groups_without_a_centre(docs_of, monkeypatch, block_rows):
    """Copies edited at random, so that members of a group are linked over others only; blocks of any size."""
    monkeypatch.setattr(nd, "BLOCK_ROWS", block_rows)
    rng, rows = random.Random(8), []
    for group in range(3):
        base = ["g%d_%d" % (group, i) for i in range(120)]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randrange(6)):
                words[rng.randrange(120)] = "e%d" % rng.randrange(10_000)
            rows.append(" ".join(words))
        base = base[:60]
        for step in range(12):  # each linked with the next, the ends far apart
            base = base[2:] + ["c%d_%d_%d" % (group, step, i) for i in range(2)]
            rows.append(" ".join(base))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert result(nd.near_duplicates(docs_of(rows))) == brute(rows)


def test_threshold_is_exact(docs_of):
    words = ["w%d" % i for i in range(104)]  # 100 shingles; a changed tail leaves k of them
    rows = [(0, " ".join(words))]
    for doc_id, same in ((1, 86), (2, 85)):  # 86 / 114 >= 0.75 > 85 / 115
        rows.append((doc_id, " ".join(words[: same + 4] + ["t%d_%d" % (doc_id, i) for i in range(100 - same)])))
    found = result(nd.near_duplicates(docs_of(rows)))
    assert found[1] == (100, 0, False) and found[2] == (100, 2, True)


def test_empty_table_null_ids_and_repeated_rows(docs_of):
    assert nd.near_duplicates(docs_of([(0, "a")]).limit(0)).count() == 0
    df = docs_of([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "A b c d e f"), (6, None), (7, "")])
    found = sorted(map(tuple, nd.near_duplicates(df).collect()), key=str)
    assert found == sorted(
        [(None, 2, None, True), (4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False), (6, 0, 6, True), (7, 0, 7, True)], key=str
    )
    kept = nd.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted([r[0] for r in kept.collect()], key=str) == [4, 6, 7]


def test_rows_without_an_id_of_their_own_are_alike_too(docs_of, clashing):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(None, text), (None, text + " more"), (3, "other words here for once"), (3, text), (2, text + " end"), (None, "alone in all the world"), (None, None)]
    kept = nd.drop_near_duplicates(clashing(docs_of(rows)))
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([rows[2], rows[4], rows[5], rows[6]], key=str)
    assert nd.drop_near_duplicates(docs_of(rows).limit(0)).count() == 0


def test_signatures_estimate_the_similarity():
    items = nd.text_shingles(" ".join("w%d" % i for i in range(2000)))
    one, two = items[:1600], items[400:]
    same = np.mean(nd.signature(one).astype(np.uint8) == nd.signature(two).astype(np.uint8))
    assert abs(same - 0.6) < 0.12
    assert nd.signature(items, nd.FINE_MINIMA)[: nd.MINIMA].tolist() == nd.signature(items).tolist()


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    edges += [(2000, i) for i in range(2001, 2400)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {x: find(x) for x in root if find(x) != x}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
