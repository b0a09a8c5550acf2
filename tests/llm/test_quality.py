import zlib

import numpy as np
from pyspark.sql import functions as F

from routestats.llm import quality as ql

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = ql.score_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_held_out_labels_teach_nothing(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(ql.held_out(F.col("doc_id"), 4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (dict(ql.score_quality(docs, x).select("doc_id", "score").collect()) for x in (labels, other))
    assert one == two


def test_pairs_order_documents():
    random = np.random.default_rng(3)
    good, bad = random.standard_normal((200, 4)) + [2, 0, 0, 0], random.standard_normal((60, 4))
    model = ql.fit_pairs(good, bad, 0.2)
    assert model.weights[0] > 5 * np.abs(model.weights[1:]).max()
    a, b = model.utility(good), model.utility(bad)
    assert (a[:, None] > b[None, :]).mean() > 0.9
    below = 0.8 * (a < model.cut).mean() + 0.2 * (b < model.cut).mean()
    assert abs(below - 0.2) < 0.03  # the cut is the quantile
    at_cut = model.mean + model.scale * model.weights * model.cut / (model.weights @ model.weights)
    assert abs(model.score(at_cut[None, :])[0] - ql.CUT_SCORE) < 1e-9
    assert (np.argsort(model.score(good)) == np.argsort(a)).all()


def test_gradient_vanishes_at_the_fit():
    random = np.random.default_rng(4)
    x = random.standard_normal((300, 3)) + [0.5, 0, -0.2]
    w = ql._logistic(x, np.full(300, 1 / 300), 0.01)
    p = 1 / (1 + np.exp(x @ w))
    assert np.abs(-(x * p[:, None]).mean(axis=0) + 0.01 * w).max() < 1e-7


def test_features_of_odd_texts(mixed_texts):
    for text in [*mixed_texts, "!!!", "\n\n", "a\n" * 5000, "1 2 3", "\ud800 x"]:
        row = ql.features(text)
        assert row.shape == (len(ql.FEATURES),) and np.isfinite(row).all()
    assert not ql.features(None).any() and not ql.features(" \n ").any()


def test_rows_and_labels_of_every_kind(spark, docs_of, mixed_texts, clashing):
    df = clashing(docs_of([*enumerate(mixed_texts), (None, "x y z"), (3, mixed_texts[3])]))
    ids = range(len(mixed_texts))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in ids] + [(None, 1, 0), (1, None, 0), (2, 7, 0), (2, 0, 0), (999, 1, 0)], LABELS)
    rows = ql.score_quality(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id is not None and not (mixed_texts[r.doc_id] or "").strip()}
    assert len(empty) == 1
    assert not next(r for r in rows if r.doc_id is None).held_out
    kept = ql.keep_quality(df, labels)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(r.doc_id for r in rows if r.predicted and r.doc_id is not None)
    for none in (labels.limit(0), labels.where("quality = 1")):
        assert {r.score for r in ql.score_quality(df, none).collect()} == {1.0}
    assert ql.score_quality(df.limit(0), labels).count() == 0


def test_every_training_row_counts(spark, docs_of):
    """More rows of a label than fit a block: mean, pairs, cut and slope are those of all rows."""
    texts = [f"one two{' three' * (i % 7)} {'x1 ' * (i % 11)}{'!' if i % 10 == 0 else '.'}" for i in range(9400)]
    docs = docs_of(texts)
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(len(texts))], LABELS)
    keep = ~ql.held_out(F.col("doc_id"), 4, 2)
    x = np.array([ql.features(text) for text in texts])
    ids = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2]
    model = ql.fit_quality(ql.described(docs), labels, keep)
    assert np.allclose(model.mean, x[ids].mean(axis=0), atol=1e-12)
    assert np.allclose(model.scale, np.maximum(x[ids].std(axis=0), 1e-6), atol=1e-12)
    bad = sum(i % 10 == 0 for i in ids)
    utility = np.sort(model.utility(x[ids]))
    assert abs(model.cut - utility[bad - 1 : bad + 1].mean()) < 1e-9


def test_cut_of_blocks_is_the_cut_of_all(monkeypatch):
    random = np.random.default_rng(6)
    good = np.round(random.standard_normal((3000, len(ql.FEATURES))), 1) + 0.3
    bad = np.round(random.standard_normal((500, len(ql.FEATURES))), 1)
    weights = 0.8 / len(good), 0.2 / len(bad)
    edges = range(0, 3001, 300)
    blocks = [(good[i : i + 300], bad[i // 6 : i // 6 + 50], 300, 50) for i in edges[:-1]]
    monkeypatch.setattr(ql, "BINS", 7)
    for few in (3, 10_000):
        monkeypatch.setattr(ql, "FEW_ROWS", few)
        for utility in (lambda rows: rows @ np.ones(rows.shape[1]), lambda rows: rows[:, 0], lambda rows: np.round(rows[:, 0])):
            rows = np.r_[utility(good), utility(bad)]
            order = np.argsort(rows, kind="stable")
            weight = np.repeat(weights, [len(good), len(bad)])[order]
            for share in (0.0, 0.01, 0.2, 0.5, 0.999, 1.0):
                below = min(np.searchsorted(np.cumsum(weight), share * (1 - 1e-9)), len(rows) - 1)
                want = rows[order][below : below + 2].mean()

                def gather(part, merge):
                    total = None
                    for block in blocks:
                        found = np.asarray(part(*block), float)
                        total = found if total is None else merge(total, found)
                    return total

                assert abs(ql._cut(gather, utility, weights, share) - want) < 1e-12


def test_a_rare_label_is_paired_in_every_block(spark, monkeypatch):
    monkeypatch.setattr(ql, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ql, "LEAST_ROWS", 4)
    width = len(ql.FEATURES)
    rows = [(i, int(i >= 3), [float(i)] * width) for i in range(1000)]
    blocks = ql.training_blocks(spark.createDataFrame(rows, "doc_id long, label int, x array<double>")).collect()
    assert len(blocks) == 20 and all(b.bad for b in blocks)
    good = [v for b in blocks for v in np.frombuffer(b.good).reshape(-1, width)[:, 0]]
    own = [v for b in blocks for v in np.frombuffer(b.bad).reshape(-1, width)[: b.own_bad, 0]]
    assert sorted(good) == list(range(3, 1000)) and sorted(own) == [0, 1, 2]
