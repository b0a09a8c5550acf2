"""Split, fit and predict (ML). Every fit is a distributed ``pyspark.ml`` estimator."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routestats.functions.scalars import HASH_DIGITS, key_hash
from routestats.session import materialize

_HASH_BITS = 4 * HASH_DIGITS
_STEP_BITS = 12  # at most 4096 counts reach the driver per narrowing pass
_TASK_ROWS = 1 << 17  # training rows of a task in boosting, which reads them as objects of a few hundred bytes
_MERGE_GROUPS = 8  # groups in which the triangles of all tasks are merged before the driver sees them

Fit = Callable[[DataFrame, Sequence[str], str, str], PipelineModel]


def hash_threshold(df: DataFrame, keys: Sequence[str], rank: int, seed: int) -> int:
    """The ``rank``-th smallest key hash (1-based), or any bound that admits exactly ``rank`` rows.

    The first pass counts rows per leading 12 hash bits; the counts combine on the map side. The
    hashes of the bin that holds the rank, one in 4096, are stored, and further passes read only those.
    """
    hashed = df.select(key_hash(keys, seed).alias("_h"))
    prefix, bits, needed = 0, 0, rank
    while bits < _HASH_BITS:
        if bits:
            hashed = hashed.where(F.shiftright("_h", _HASH_BITS - bits) == F.lit(prefix))
            hashed = materialize(hashed, "hash-bin") if bits == _STEP_BITS else hashed
        bits += _STEP_BITS
        cell = F.shiftright("_h", _HASH_BITS - bits)
        for row in sorted(hashed.groupBy(cell.alias("cell")).count().collect()):
            if row["count"] >= needed:
                break
            needed -= row["count"]
        prefix = row["cell"]
        if row["count"] == needed:
            break
    return ((prefix + 1) << (_HASH_BITS - bits)) - 1


def with_split(
    df: DataFrame, keys: Sequence[str], test: float = 0.2, seed: int = 42, name: str = "is_test"
) -> DataFrame:
    """ML03: mark ``ceil(test * n)`` rows as test rows, by key hash.

    Exact for a unique key, and the same under any partitioning. Rows that share a key share a
    hash, so copies never end up on both sides.
    """
    n = df.count()
    rank = math.ceil(test * n)
    bound = hash_threshold(df, keys, rank, seed) if rank else -1
    return df.withColumn(name, key_hash(keys, seed) <= F.lit(bound))


def split(df: DataFrame, keys: Sequence[str], test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """ML03: training and test rows."""
    marked = with_split(df, keys, test, seed, "_test")
    return marked.where(~F.col("_test")).drop("_test"), marked.where("_test").drop("_test")


def triangular_factor(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """R of the QR decomposition of the rows of ``cols``, a table far taller than wide.

    Each task keeps one triangle and takes its Arrow batches into it; the triangles of all tasks are merged in
    ``_MERGE_GROUPS`` groups, and the driver merges what these leave. Unlike sums of squares this keeps all digits.
    """
    width = len(cols)

    def reduced(parts):  # nested, so that it reaches the workers by value
        import numpy as np

        total = np.zeros((0, width))
        for part in parts:
            total = np.linalg.qr(np.concatenate([total, part]), mode="r")
        return total

    def rows_of(total, group):
        import pyarrow as pa

        # cells by row, so that a group's triangles come in one order
        return pa.RecordBatch.from_arrays(
            [pa.array([group]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["task", "cells"]
        )

    def per_task(batches):
        import numpy as np
        from pyspark import TaskContext

        tables = (np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) for b in batches if b.num_rows)
        yield rows_of(reduced(tables), TaskContext.get().partitionId())

    def per_group(batches):
        import numpy as np

        held = sorted((task, cells) for b in batches for task, cells in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True))
        if held:
            yield rows_of(reduced(np.reshape(cells, (-1, width)) for _, cells in held), held[0][0])

    schema = "task long, cells array<double>"
    triangles = df.select(*cols).mapInArrow(per_task, schema)
    merged = triangles.repartition(_MERGE_GROUPS, F.col("task") % _MERGE_GROUPS).mapInArrow(per_group, schema)
    return reduced(np.reshape(r.cells, (-1, width)) for r in sorted(merged.collect(), key=lambda r: r.task))


def solved(factor: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """Least-squares coefficients from the triangle of ``[1, features..., target]``: the constant comes first.

    Rank-revealing: a feature of which less than ``tolerance`` of its centred square is left beside the constant and
    the features before it (a constant, a copy) gets coefficient 0.
    """
    width = factor.shape[1] - 1
    basis, kept, above = [], [], []
    for k in range(width + 1):
        rest, shares = factor[:, k].astype(float), np.zeros(len(basis))
        for _ in range(2):  # the second time takes out what rounding left
            for i, direction in enumerate(basis):
                share = direction @ rest
                shares[i] += share
                rest = rest - share * direction
        centred = rest @ rest + (shares[1:] ** 2).sum()
        if k == width:
            break
        own, noise = rest @ rest, 1e-22 * (factor[:, k] @ factor[:, k])
        if own > (max(tolerance * centred, noise) if k else 0):
            basis.append(rest / math.sqrt(own))
            kept.append(k)
            above.append(np.append(shares, math.sqrt(own)))
    out, weights = np.zeros(width), shares.copy()
    for i in reversed(range(len(kept))):
        out[kept[i]] = weights[i] / above[i][i]
        weights[:i] -= out[kept[i]] * above[i][:i]
    return out


def _least_squares(rows: DataFrame, features: str, cols: Sequence[str], target: str, out: str) -> LinearRegressionModel:
    """The linear model of the vector column ``features`` with the components ``cols``, by QR."""
    factor = triangular_factor(rows.select(F.lit(1.0).alias("_one"), *cols, F.col(target).cast("double")), ["_one", *cols, target])
    solution = solved(factor) if len(factor) else np.zeros(len(cols) + 1)
    jvm = rows.sparkSession._jvm
    cells = rows.sparkSession.sparkContext._gateway.new_array(jvm.double, len(cols))
    for i, c in enumerate(solution[1:].tolist()):
        cells[i] = c
    vector = jvm.org.apache.spark.ml.linalg.DenseVector(cells)
    made = jvm.org.apache.spark.ml.regression.LinearRegressionModel(f"linReg_{uuid.uuid4().hex[:12]}", vector, float(solution[0]))
    return LinearRegressionModel._from_java(made).setFeaturesCol(features).setPredictionCol(out)


def _assembler(features: Sequence[str], out: str) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=f"{out}__x")


def fit_ols(train: DataFrame, features: Sequence[str], target: str, out: str) -> PipelineModel:
    """ML04: ordinary least squares. Compare predictions, not coefficients: with repeated or
    constant features the coefficients are not unique. By QR, which keeps the digits that the
    normal equations lose on nearly repeated features."""
    numbers = train.select(*[F.col(c).cast("double").alias(c) for c in features], target)
    return PipelineModel([_assembler(features, out), _least_squares(numbers, f"{out}__x", features, target, out)])


def fit_pca_regression(
    train: DataFrame, features: Sequence[str], target: str, out: str, variance: float = 0.95
) -> PipelineModel:
    """ML05-07: standardise, keep the leading components that together explain more than
    ``variance``, and fit least squares on them."""
    assembler = _assembler(features, out)
    rows = assembler.transform(train)
    scaler = StandardScaler(inputCol=f"{out}__x", outputCol=f"{out}__z", withMean=True, withStd=True).fit(rows)
    rows = scaler.transform(rows)
    pca = PCA(k=len(features), inputCol=f"{out}__z", outputCol=f"{out}__pc").fit(rows)
    kept, explained = 0, 0.0
    for share in pca.explainedVariance:
        kept, explained = kept + 1, explained + float(share)
        if explained > variance:
            break
    slicer = VectorSlicer(inputCol=f"{out}__pc", outputCol=f"{out}__kept", indices=list(range(kept)))
    rows = slicer.transform(pca.transform(rows))
    parts, cells = [f"_{i}" for i in range(kept)], vector_to_array(F.col(f"{out}__kept"))
    numbers = rows.select(*[cells[i].alias(c) for i, c in enumerate(parts)], target)
    return PipelineModel([assembler, scaler, pca, slicer, _least_squares(numbers, f"{out}__kept", parts, target, out)])


def _in_small_parts(rows: DataFrame) -> DataFrame:
    """``rows``, dealt anew if a partition has more than ``_TASK_ROWS``: a compact file gives one task millions of rows."""
    counts = rows.groupBy(F.spark_partition_id().alias("part")).count().agg(F.sum("count"), F.max("count"), F.count("*"))
    total, most, parts = counts.first()
    if (most or 0) <= _TASK_ROWS:
        return rows
    return rows.repartition(max(parts, math.ceil(total / _TASK_ROWS)))


def fit_gbt(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    out: str,
    trees: int = 100,
    depth: int = 3,
    rate: float = 0.1,
    seed: int = 42,
) -> PipelineModel:
    """ML08: gradient-boosted regression trees with squared loss. A task holds a bounded number of rows."""
    train = _in_small_parts(train)
    assembler = _assembler(features, out)
    gbt = GBTRegressor(
        featuresCol=f"{out}__x", labelCol=target, predictionCol=out, lossType="squared",
        maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, maxBins=128,
    )
    return PipelineModel([assembler, gbt.fit(assembler.transform(train))])


MODELS: dict[str, Fit] = {
    "linear_regression": fit_ols,
    "pca_regression": fit_pca_regression,
    "gradient_boosting": fit_gbt,
}


@dataclass
class ModelResults:
    """ML12: what a modelling run leaves behind."""

    features: list[str]
    target: str
    keys: list[str]
    models: dict[str, PipelineModel]
    train: DataFrame
    test: DataFrame
    predictions: DataFrame
    correlation: DataFrame | None = None

    @property
    def prediction_columns(self) -> dict[str, str]:
        return {name: f"pred_{name}" for name in self.models}


def fit_models(
    train: DataFrame, features: Sequence[str], target: str, models: Mapping[str, Fit] = MODELS
) -> dict[str, PipelineModel]:
    """ML09: fit every model on the same training rows."""
    rows = train.select(*features, target).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return {name: fit(rows, list(features), target, f"pred_{name}") for name, fit in models.items()}
    finally:
        rows.unpersist()


def prediction_table(
    models: Mapping[str, PipelineModel], df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str
) -> DataFrame:
    """ML10: key, features, actual value and one prediction column per model, without a join."""
    wide = df.select(*keys, *features, target)
    for model in models.values():
        wide = model.transform(wide)
    return wide.select(
        *keys, *features, F.col(target).alias(f"actual_{target}"), *[f"pred_{name}" for name in models]
    )


def predict(model: PipelineModel, name: str, df: DataFrame, out: str) -> DataFrame:
    """ML11: predictions of one fitted model on any rows; nothing is fitted again."""
    return model.transform(df).withColumnRenamed(f"pred_{name}", out).select(*df.columns, out)
