import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from routestats.llm import mixing as mx


def drawn(seed, doc_id, source, mean):
    key = "n" if source is None else f"s{source}"
    draws = max(1, math.ceil(mean / mx.MAX_MEAN))
    total = 0
    for number in range(1, draws + 1):
        text = f"{seed}|{'null' if doc_id is None else doc_id}|{key}|{number}"
        u = int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52
        below = term = math.exp(-mean / draws)
        k = 0
        while u >= below and k < mx.TERMS:
            k += 1
            term *= mean / draws / k
            below += term
        total += k
    return total


def frame(spark):
    rows = [(i, "x" * (1 + i % 7), "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(3000)]
    rows += [(None, "abc", "en", "s1", 3), (9000, None, "en", "none", 0), (9001, "text", "en", None, 4), (9002, "ab", "en", "n", 2), (5, "twice", "en", "s0", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


def test_counts_against_plain_python(spark, clashing):
    df = clashing(frame(spark))
    sizes = Counter()
    for r in df.collect():
        sizes[r.source] += len(r.text or "")
    whole = sum(math.sqrt(n) for n in sizes.values())
    mean = {s: sum(sizes.values()) * math.sqrt(n) / whole / n if n else 1.0 for s, n in sizes.items()}
    found = {r.source: r["mean"] for r in mx.repetitions(df).collect()}
    assert found.keys() == mean.keys() and all(abs(found[s] - m) < 1e-9 for s, m in mean.items())
    want = Counter()
    for r in df.collect():
        want[tuple(r)] += drawn(mx.SEED, r.doc_id, r.source, mean[r.source])
    out = mx.mix_sources(df)
    assert out.columns == df.columns
    assert Counter(map(tuple, out.collect())) == +want


def test_targets_are_met(spark):
    df = frame(spark)
    weights = spark.createDataFrame([("hot", 1.0), ("s0", 1.0), ("s1", 30.0), ("absent", 5.0)], "source string, weight double")
    out = mx.mix_sources(df, weights, budget=200_000.0)
    got = {r.source: r.size for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("size")).collect()}
    assert set(got) - {"none"} == {"hot", "s0", "s1"}
    assert abs(got["hot"] / (200_000 / 32) - 1) < 0.1 and abs(got["s1"] / (200_000 * 30 / 32) - 1) < 0.05


def test_poisson_quantiles(spark):
    rows = [(u / 997, mean) for u in range(997) for mean in (0.0, 0.3, 1.0, 7.9)]
    df = spark.createDataFrame(rows, "u double, m double").select("u", "m", mx.poisson(F.col("u"), F.col("m")).alias("k"))
    for u, mean, k in df.collect():
        below = sum(math.exp(-mean) * mean**j / math.factorial(j) for j in range(k))
        assert below <= u + 1e-12 and u < below + math.exp(-mean) * mean**k / math.factorial(k) + 1e-12


@pytest.mark.parametrize("mean", [3.0, 8.0, 8.5, 60.0])
def test_counts_have_the_variance_of_their_mean(spark, mean):
    rows = spark.range(6000).select(mx.poisson_count(F.lit(mean), F.lit(1), F.col("id")).alias("n"))
    of = rows.agg(F.avg("n").alias("mean"), F.var_samp("n").alias("variance")).first()
    assert abs(of["mean"] / mean - 1) < 5 / math.sqrt(6000 * mean)
    assert abs(of["variance"] / mean - 1) < 0.1


def test_order_is_mixed_and_repeats(spark):
    df = frame(spark)
    one, two = ([r.doc_id for r in mx.mix_sources(df).collect()] for _ in range(2))
    assert one == two and one != sorted(one, key=lambda i: (i is None, i))
    assert mx.mix_sources(df, seed=1).count() != 0 and Counter(r.doc_id for r in mx.mix_sources(df, seed=1).collect()) != Counter(one)
    assert mx.mix_sources(df.limit(0)).count() == 0
    plan = mx.mix_sources(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
