import numpy as np
import pytest
from pyspark.sql import functions as F

from routestats.llm import neighbours as nb

ASKS = "vec_id % 10 = 0"


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def brute(ids, x, query, k):
    d = np.sqrt(((x - x[query]) ** 2).sum(axis=1))
    d[ids == ids[query]] = np.inf
    order = [i for i in np.lexsort((ids, d)) if np.isfinite(d[i])]
    return [(int(ids[i]), float(d[i])) for i in order[:k]]


@pytest.mark.parametrize(("spread", "block_rows"), [(0.4, 8192), (3.0, 300)])
def test_recall_against_all_distances(spark, clashing, monkeypatch, spread, block_rows):
    monkeypatch.setattr(nb, "BLOCK_ROWS", block_rows)
    random = np.random.default_rng(1)
    centres = random.standard_normal((20, 32))
    x = (centres[random.integers(20, size=1500)] + spread * random.standard_normal((1500, 32))).astype(np.float32)
    x[700:760] = x[3]  # many copies of one vector
    ids = np.arange(1500) * 3
    df = clashing(frame(spark, [(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)]))
    found = {}
    for row in nb.nearest_neighbours(df, F.expr(ASKS), 10).orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append((row.vec_id, row.score))
        assert row.rank == len(found[row.query_id])
    hit, x = 0, x.astype(np.float64)
    for query in np.flatnonzero(ids % 10 == 0):
        want = brute(ids, x, query, 10)
        got = found[int(ids[query])]
        assert len(got) == 10 and got == sorted(got, key=lambda r: (r[1], r[0]))
        assert all(abs(np.sqrt(((x[v // 3] - x[query]) ** 2).sum()) - s) < 1e-9 for v, s in got)
        hit += len({v for v, _ in want} & {v for v, _ in got})
    assert hit >= 0.95 * 10 * len(found)


def test_every_code_within_the_radius_is_found():
    random = np.random.default_rng(2)
    x = random.standard_normal((400, 24))
    codes = nb.fit_codes(x, 5)
    block = nb.Block(np.arange(400), x, codes)
    for query in range(20):
        part = codes.parts(x[query][None, :])[0]
        apart = np.bitwise_count(block.parts ^ part).sum(axis=1)
        for radius in (0, 3, 17, 40, 95, 130, 300):
            assert block.within(part, radius).tolist() == np.flatnonzero(apart <= radius).tolist()


def test_unusable_vectors_repeated_rows_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [0.0, 2.0], 1), (4, [1.0, 1.0], 1),
            (10, None, 1), (20, [0.0, 0.0], 1), (30, [nan, 1.0], 1), (40, [inf, 1.0], 1), (50, [None, 1.0], 1), (60, [], 1),
            (70, [1.0, 2.0, 3.0], 1), (None, [1.0, 0.5], 1), (80, [-1.0, 0.0], 1)]
    found = nb.nearest_neighbours(frame(spark, rows), F.expr(ASKS), 10).orderBy("query_id", "rank").collect()
    assert [tuple(r)[:3] for r in found if r.query_id == 0] == [(0, 1, 3), (0, 2, 5), (0, 3, 4), (0, 4, 80)]
    assert [r.score for r in found if r.query_id == 0] == [0, 0, 1, 2]
    assert {r.query_id for r in found} == {0, 80}
    assert nb.nearest_neighbours(frame(spark, rows).limit(0), F.expr(ASKS)).count() == 0
    assert nb.nearest_neighbours(frame(spark, rows[6:8]), F.expr(ASKS)).count() == 0
    assert nb.nearest_neighbours(frame(spark, rows[:1]), F.expr(ASKS)).count() == 0
