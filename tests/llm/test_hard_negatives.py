import numpy as np
import pytest
from pyspark.sql import functions as F

from routestats.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"
ASKS = "vec_id % 10 = 0"


def brute(rows, k=5, m=5, least=80):
    x = {i: [int(np.floor(256 * np.float64(np.float32(c)))) for c in v] for i, v, _ in rows}
    label = {i: b for i, _, b in rows}
    out = []
    for a in sorted(i for i in x if i % 10 == 0):
        score = {i: sum(p * q for p, q in zip(x[a], x[i])) for i in x if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if label[i] == label[a]][:k]:
            fits = [i for i in order if label[i] != label[a] and least * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, r + 1, n, score[p], score[n]) for r, n in enumerate(fits[:m])]
    return sorted(out)


@pytest.mark.parametrize(("block_bytes", "meet", "step"), [(hn.BLOCK_BYTES, hn.MEET, hn.STEP_ROWS), (400, 2, 3)])
def test_all_windows_against_plain_loops(spark, clashing, monkeypatch, block_bytes, meet, step):
    for name, value in (("BLOCK_BYTES", block_bytes), ("MEET", meet), ("STEP_ROWS", step)):
        monkeypatch.setattr(hn, name, value)
    random = np.random.default_rng(8)
    x = (random.standard_normal((8, 12))[random.integers(8, size=300)] + 0.6 * random.standard_normal((300, 12))).astype(np.float32)
    x[100:140] = x[10]  # a group of copies with all labels
    x[200:230] = np.round(x[200:230])
    rows = [(i, v.tolist(), 0 if i < 100 else int(random.integers(4))) for i, v in enumerate(x)]
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))
    found = hn.mine_negatives(df, F.expr(ASKS))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 100


def test_unusable_rows_few_partners_and_negative_scores(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.5], 2), (3, [0.9, 0.0], 2), (4, [0.1, 0.0], 2), (5, [-1.0, 0.0], 1),
            (6, [-0.9, 0.0], 2), (7, [1.0, 0.0], None), (8, None, 2), (9, [nan, 1.0], 2), (None, [1.0, 0.0], 2), (10, [0.0, 0.0], 3),
            (20, None, 1), (30, [1.0], 4)]
    found = hn.mine_negatives(spark.createDataFrame(rows, SCHEMA), F.expr(ASKS))
    want = brute([r for r in [*rows[:7], rows[11]]] + [(30, [1.0, 0.0], 4)])
    assert sorted(tuple(r) for r in found.collect()) == want
    assert hn.mine_negatives(spark.createDataFrame([], SCHEMA), F.expr(ASKS)).count() == 0
    assert hn.mine_negatives(spark.createDataFrame(rows[:2], SCHEMA), F.expr(ASKS)).count() == 0
    twice = spark.createDataFrame([*rows[:7], *rows[:3]], SCHEMA)
    assert hn.mine_negatives(twice, F.expr(ASKS)).where("anchor_id = positive_id").count() == 0


def test_products_are_exact_beyond_doubles():
    one = np.array([[1 << 24, (1 << 24) - 1]] * 2, np.int64).repeat(64, axis=1)
    assert hn.products(one, one)[0, 0] == sum(int(a) ** 2 for a in one[0])


def test_best_keeps_ties_by_smaller_id():
    best = hn.Best.none(2)
    best.add(np.array([0, 0, 1]), np.array([5, 5, 1]), np.array([9, 4, 7]))
    best.add(np.array([0, 0]), np.array([5, 6]), np.array([3, 8]))
    assert list(zip(best.slot.tolist(), best.score.tolist(), best.vec_id.tolist())) == [(0, 6, 8), (0, 5, 3), (1, 1, 7)]
    assert best.floors(3).tolist() == [5, np.iinfo(np.int64).min, np.iinfo(np.int64).min]
