"""Queries for feature engineering, models and scores.

Every query makes its own fits. Those of least squares are checked in SQL by successive
orthogonalisation, principal components by Jacobi rotations of the correlations, boosted trees by a
search of the best splits, tree after tree.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routestats.operators import evaluate as ev
from routestats.operators import models as ml
from routestats.plans import cleaning, fare_model
from routestats.plans.fare_model import FEATURES, TARGET
from routestats.plans.schemas import ROUTE_KEYS
from routestats.queries.cleaning import ANALYSIS_DOUBLES, ANALYSIS_SQL, analysis, write_raw_files
from routestats.queries.registry import add
from routestats.queries.relational import hash_order
from routestats.queries.statistics import corr_sql, hist_sql
from routestats.queries.tables import LINE_KEY, sql, table
from routestats.session import materialize, scratch_path
from routestats.sources.tables import write_matrix, write_table

LINEAR: dict[str, ml.Fit] = {"linear_regression": ml.fit_ols}


def marked(spark: SparkSession, d: str) -> DataFrame:
    """The derived model frame with its test rows marked."""
    return fare_model.split_frame(analysis(spark, d, ordered=False))


def modelled(spark: SparkSession, d: str, models: Mapping[str, ml.Fit] = LINEAR) -> tuple[ml.ModelResults, str]:
    """A modelling run on the derived analysis table, and the folder its outputs are stored in."""
    outputs = scratch_path(spark, "outputs")
    results = fare_model.fit_split(marked(spark, d), models, save_to=f"{outputs}/modeling")
    fare_model.evaluate_results(results, f"{outputs}/evaluation")
    return results, outputs


def model_frame(spark: SparkSession, d: str) -> DataFrame:
    return fare_model.build_model_frame(analysis(spark, d, ordered=False)).select(*ROUTE_KEYS, *FEATURES, TARGET)


def _features(columns: list[str]) -> str:
    return " ".join(columns)


MODEL_DOUBLES = _features([*FEATURES[:-1], TARGET])

add("ml01_analysis_table", analysis, ANALYSIS_SQL, ANALYSIS_DOUBLES)
add("q07_analysis_table", lambda s, d: analysis(s, d).drop("route"), f"SELECT * EXCLUDE (route) FROM ({ANALYSIS_SQL})", ANALYSIS_DOUBLES)
add("ml02_model_frame", model_frame, sql("SELECT * FROM model_frame"), MODEL_DOUBLES)
_ROUTE_HASH = hash_order(ROUTE_KEYS)
_SPLIT_SQL = f"""SELECT YEAR, QUARTER, ORIGIN, DEST, (row_number() OVER (ORDER BY {_ROUTE_HASH})
    <= ceil(0.2 * count(*) OVER ()))::INT AS is_test FROM model_frame"""


def _split(spark: SparkSession, d: str) -> DataFrame:
    frame = materialize(model_frame(spark, d).select(*ROUTE_KEYS), "frame-keys")
    return ml.with_split(frame, ROUTE_KEYS).withColumn("is_test", F.col("is_test").cast("int"))


add("ml03_split", _split, sql(_SPLIT_SQL))


def fit_sql(frame: str, features: list[str] = FEATURES) -> str:
    """Least squares on the training rows by successive orthogonalisation, in plain aggregates.

    Each step takes one feature's remaining part out of all later features and of the target; a
    feature with nothing left (constant or a copy) is passed over. Gives all rows of ``frame`` with
    ``is_test`` and ``pred``.
    """
    train = "FILTER (WHERE NOT is_test) OVER ()"
    names = [*features, TARGET]
    centred = ", ".join(f"{c} - avg({c}) {train} AS r{i}" for i, c in enumerate(names))
    text = f"""SELECT *, {centred} FROM (SELECT *, row_number() OVER (ORDER BY {_ROUTE_HASH})
      <= ceil(0.2 * count(*) OVER ()) AS is_test FROM {frame})"""
    sizes = ", ".join(f"sum(r{i} * r{i}) {train} AS o{i}" for i in range(len(features)))
    text = f"SELECT *, {sizes} FROM ({text})"
    for k in range(len(features)):
        rest = range(k + 1, len(names))
        own = f"sum(r{k} * r{k}) {train}"
        parts = ", ".join(
            f"r{j} - CASE WHEN {own} > 1e-12 * o{k} THEN sum(r{j} * r{k}) {train} / ({own}) ELSE 0 END * r{k} AS r{j}"
            for j in rest
        )
        text = f"SELECT * EXCLUDE ({', '.join(f'r{j}' for j in (k, *rest))}), {parts} FROM ({text})"
    return f"(SELECT {', '.join([*ROUTE_KEYS, *names])}, is_test, {TARGET} - r{len(features)} AS pred FROM ({text}))"


_OLS_SQL = fit_sql("model_frame")
_OLS_TEST_SQL = f"""SELECT * EXCLUDE (is_test, pred, avg_fare), avg_fare AS actual_avg_fare,
      pred AS pred_linear_regression
    FROM {_OLS_SQL} WHERE is_test"""
_OLS_DOUBLES = _features([*FEATURES[:-1], "actual_avg_fare", "pred_linear_regression"])


add(
    "ml04_ols",
    lambda s, d: fare_model.fit_split(marked(s, d), LINEAR).predictions,
    sql(_OLS_TEST_SQL),
    _OLS_DOUBLES,
)
_TWO = ["load_factor", "market_distance"]


def _two_components(spark: SparkSession, d: str) -> DataFrame:
    """Two features reduced to their leading component."""
    rows = marked(spark, d)
    fit = {"pca_regression": partial(ml.fit_pca_regression, variance=0.3)}
    fitted = ml.fit_models(rows.where("not is_test"), _TWO, TARGET, fit)
    return ml.prediction_table(fitted, rows.where("is_test"), ROUTE_KEYS, _TWO, TARGET)


_TWO_SQL = f"""(SELECT *, (load_factor - avg(load_factor) {{t}}) / stddev_samp(load_factor) {{t}}
      + sign(corr(load_factor, market_distance) {{t}})
      * (market_distance - avg(market_distance) {{t}}) / stddev_samp(market_distance) {{t}} AS z
    FROM (SELECT *, row_number() OVER (ORDER BY {_ROUTE_HASH}) <= ceil(0.2 * count(*) OVER ()) AS is_test
          FROM model_frame))""".format(t="FILTER (WHERE NOT is_test) OVER ()")
add(
    "ml07_pca_two_features",
    _two_components,
    sql(
        f"""SELECT * EXCLUDE (is_test) FROM (SELECT YEAR, QUARTER, ORIGIN, DEST, load_factor, market_distance,
              avg_fare AS actual_avg_fare, is_test, avg(avg_fare) FILTER (WHERE NOT is_test) OVER ()
              + z * covar_pop(avg_fare, z) FILTER (WHERE NOT is_test) OVER ()
                / var_pop(z) FILTER (WHERE NOT is_test) OVER () AS pred_pca_regression FROM {_TWO_SQL})
            WHERE is_test"""
    ),
    _features([*_TWO, "actual_avg_fare", "pred_pca_regression"]),
)


def _pca_shares(spark: SparkSession, d: str, features: list[str] = FEATURES) -> DataFrame:
    """ML05, ML06: share of variance per component of the standardised training rows."""
    pca, slicer = _pca_model(marked(spark, d), features).stages[2:4]
    shares = [float(v) for v in pca.explainedVariance]
    kept = len(slicer.getIndices())
    rows = [(i, v, i < kept) for i, v in enumerate(shares)]
    return spark.createDataFrame(rows, "component int, share double, kept boolean")


def _pca_model(rows: DataFrame, features: list[str] = FEATURES):
    fit = {"pca_regression": ml.fit_pca_regression}
    return ml.fit_models(rows.where("not is_test"), features, TARGET, fit)["pca_regression"]


_TRAIN_SQL = f"""(SELECT * FROM model_frame QUALIFY row_number() OVER (ORDER BY {_ROUTE_HASH})
    > ceil(0.2 * count(*) OVER ()))"""


def jacobi_sql(train: str, cols: list[str], sweeps: int = 12) -> str:
    """CTEs down to ``axes(component, share, before, axis)``: the principal components of ``cols``, leading first.

    Cyclic Jacobi rotations of the correlation matrix, held as one list and turned by one pair of
    columns in each recursion; a constant column has no part in it.
    """
    d = len(cols)
    pairs = [(p, q) for p in range(d) for q in range(p + 1, d)]
    cells = ", ".join(
        f"CASE WHEN stddev_samp({x}) > 0 AND stddev_samp({y}) > 0 THEN {1.0 if x == y else f'corr({x}, {y})'} ELSE 0 END::DOUBLE"
        for x in cols
        for y in cols
    )
    unit = ", ".join(str(float(i == j)) for i in range(d) for j in range(d))

    def turned(m: str, down: str, over: str, i: str, j: str) -> str:
        """Column p and q (``over``) of the matrix turned; others as they are."""
        at = lambda k: f"{m}[{down.format(i=i, j=j, k=k)}]"
        return (
            f"CASE {over.format(i=i, j=j)} WHEN p THEN c * {at('p')} - s * {at('q')} WHEN q THEN s * {at('p')} + c * {at('q')}"
            f" ELSE {m}[{i} * {d} + {j} + 1] END"
        )

    columns = turned("{m}", f"{{i}} * {d} + {{k}} + 1", "{j}", f"(x // {d})", f"(x % {d})")
    rows = turned("b", f"{{k}} * {d} + {{j}} + 1", "{i}", f"(x // {d})", f"(x % {d})")
    return f"""turns AS (SELECT {[p for p, _ in pairs]} AS ps, {[q for _, q in pairs]} AS qs),
      jacobi(step, a, v) AS (
        SELECT 0, [{cells}], [{unit}]::DOUBLE[] FROM {train}
        UNION ALL
        SELECT step + 1, list_transform(range(0, {d * d}), lambda x: {rows}), v
        FROM (SELECT step, p, q, c, s, list_transform(range(0, {d * d}), lambda x: {columns.format(m="a")}) AS b,
                list_transform(range(0, {d * d}), lambda x: {columns.format(m="v")}) AS v
              FROM (SELECT *, t / sqrt(t * t + 1) AS s, 1 / sqrt(t * t + 1) AS c
                    FROM (SELECT *, CASE WHEN abs(apq) < 1e-300 THEN 0 WHEN w < 0 THEN -1 / (sqrt(w * w + 1) - w)
                            ELSE 1 / (w + sqrt(w * w + 1)) END AS t
                          FROM (SELECT *, CASE WHEN abs(apq) < 1e-300 THEN 0 ELSE (a[q * {d + 1} + 1] - a[p * {d + 1} + 1]) / (2 * apq) END AS w
                                FROM (SELECT *, a[p * {d} + q + 1] AS apq
                                      FROM (SELECT step, a, v, ps[step % {len(pairs)} + 1] AS p, qs[step % {len(pairs)} + 1] AS q
                                            FROM jacobi, turns WHERE step < {sweeps * len(pairs)}))))))),
      axes AS (
        SELECT (row_number() OVER (ORDER BY size DESC) - 1)::INTEGER AS component, size / sum(size) OVER () AS share,
          coalesce(sum(size) OVER (ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(size) OVER () AS before,
          list_transform(range(0, {d}), lambda i: v[i * {d} + k + 1]) AS axis
        FROM (SELECT v, k, greatest(a[k * {d + 1} + 1], 0) AS size
              FROM (SELECT a, v, unnest(range(0, {d})) AS k FROM jacobi WHERE step = {sweeps * len(pairs)})))"""


add(
    "ml06_pca_shares",
    _pca_shares,
    sql(f"SELECT * FROM (WITH RECURSIVE {jacobi_sql(_TRAIN_SQL, FEATURES)} SELECT component, share, before <= 0.95 AS kept FROM axes)"),
    "share",
)


def pca_fit_sql(frame: str, features: list[str] = FEATURES) -> str:
    """Least squares on the kept components, which don't correlate: each one's coefficient stands alone."""
    train = "FILTER (WHERE NOT is_test) OVER ()"
    scaled = ", ".join(
        f"CASE WHEN stddev_samp({c}) {train} > 0 THEN ({c} - avg({c}) {train}) / stddev_samp({c}) {train} ELSE 0 END" for c in features
    )
    names = ", ".join([*ROUTE_KEYS, *features, TARGET])
    return f"""(WITH RECURSIVE marked AS MATERIALIZED (
        SELECT *, row_number() OVER (ORDER BY {_ROUTE_HASH}) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM {frame}),
      {jacobi_sql("marked WHERE NOT is_test", features)},
      scaled AS MATERIALIZED (SELECT {names}, is_test, [{scaled}] AS z FROM marked),
      scores AS MATERIALIZED (
        SELECT {names}, is_test, component, list_sum(list_transform(list_zip(z, axis), lambda x: x[1] * x[2])) AS score
        FROM scaled, axes WHERE before <= 0.95),
      slopes AS (
        SELECT component, covar_pop({TARGET}, score) / var_pop(score) AS slope FROM scores WHERE NOT is_test GROUP BY component),
      level AS (SELECT avg({TARGET}) AS mean FROM marked WHERE NOT is_test)
      SELECT {names}, any_value(is_test) AS is_test, any_value(mean) + sum(slope * score) AS pred
      FROM scores JOIN slopes USING (component), level GROUP BY {names})"""


_PCA_SQL = pca_fit_sql("model_frame")
add(
    "ml07_pca_regression",
    lambda s, d: fare_model.fit_split(marked(s, d), {"pca_regression": ml.fit_pca_regression}).predictions,
    sql(f"""SELECT * EXCLUDE (is_test, pred, avg_fare), avg_fare AS actual_avg_fare, pred AS pred_pca_regression
        FROM {_PCA_SQL} WHERE is_test"""),
    _features([*FEATURES[:-1], "actual_avg_fare", "pred_pca_regression"]),
)
add(
    "ml06_pca_shares_two_features",
    lambda s, d: _pca_shares(s, d, _TWO),
    sql(
        f"""SELECT unnest([0, 1]) AS component, unnest([(1 + r) / 2, (1 - r) / 2]) AS share,
              unnest([true, (1 + r) / 2 <= 0.95]) AS kept
            FROM (SELECT abs(corr(load_factor, market_distance)) AS r FROM (SELECT * FROM model_frame
              QUALIFY row_number() OVER (ORDER BY {_ROUTE_HASH}) > ceil(0.2 * count(*) OVER ())))"""
    ),
    "share",
)


def _standardised(spark: SparkSession, d: str) -> DataFrame:
    """ML05: mean and standard deviation of each feature after standardising the training rows."""
    from pyspark.ml.functions import vector_to_array

    rows = marked(spark, d)
    assembler, scaler = _pca_model(rows).stages[:2]
    scaled = scaler.transform(assembler.transform(rows.where("not is_test")))
    values = vector_to_array(F.col(scaler.getOutputCol()))
    named = scaled.select(*[values[i].alias(c) for i, c in enumerate(FEATURES)])
    stats = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")) for c in FEATURES]
    return named.agg(F.array(*stats).alias("rows")).select(F.inline("rows"))


add(
    "ml05_standardise",
    _standardised,
    sql(
        f"""SELECT feature, 0.0::DOUBLE AS mean, CASE WHEN std > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS std FROM
          (SELECT unnest({FEATURES}) AS feature, unnest([{', '.join(f'stddev_samp({c})' for c in FEATURES)}]) AS std
           FROM {_TRAIN_SQL})"""
    ),
    "mean std",
)


def _boosted(spark: SparkSession, d: str) -> DataFrame:
    rows = marked(spark, d)
    fitted = ml.fit_models(rows.where("not is_test"), FEATURES, TARGET, {"gradient_boosting": ml.fit_gbt})
    held = rows.where("is_test").select(*ROUTE_KEYS, *FEATURES)
    return fare_model.predict_fares(held, fitted["gradient_boosting"], "gradient_boosting")


add("ml08_gradient_boosting", _boosted)
_FLAGS = {"returned": "l_returnflag = 'R'", "open": "l_linestatus = 'O'"}


def _group_means(spark: SparkSession, d: str) -> DataFrame:
    """Trees over two flags, deep enough to separate their groups: the first one gives the group means."""
    flags = [F.expr(e).cast("double").alias(name) for name, e in _FLAGS.items()]
    rows = table(spark, d, "lineitem").select(*LINE_KEY, *flags, "l_extendedprice")
    fit = {"gradient_boosting": partial(ml.fit_gbt, trees=3, depth=2)}
    fitted = ml.fit_models(rows, list(_FLAGS), "l_extendedprice", fit)
    return ml.prediction_table(fitted, rows, LINE_KEY, list(_FLAGS), "l_extendedprice")


add(
    "ml08_boosting_of_group_means",
    _group_means,
    f"""SELECT {', '.join(LINE_KEY)}, {', '.join(f'({e})::INT::DOUBLE AS {n}' for n, e in _FLAGS.items())},
          l_extendedprice AS actual_l_extendedprice,
          avg(l_extendedprice) OVER (PARTITION BY {', '.join(_FLAGS.values())}) AS pred_gradient_boosting
        FROM lineitem""",
    "actual_l_extendedprice pred_gradient_boosting",
)


def boosted_sql(source: str, keys: list[str], features: list[str], target: str, trees: int, depth: int, rate: float = 0.1) -> str:
    """Boosted trees on features of few values: the best split of every node by prefix counts and sums.

    A split's worth is what the squared sums of its sides, over their counts, add up to. The first
    tree counts in full, later ones fit twice the rest and count at ``rate``.
    """
    columns = ", ".join([*keys, *features, "y"])
    parts = [f"rows0 AS MATERIALIZED (SELECT {', '.join([*keys, *features])}, {target} AS y, 0.0::DOUBLE AS pred FROM {source})"]
    for t in range(trees):
        rest = "2 * (y - pred)" if t else "y"
        parts.append(f"n{t}_0 AS MATERIALIZED (SELECT *, {rest} AS r, 0 AS node FROM rows{t})")
        for level in range(depth):
            cells = " UNION ALL ".join(
                f"SELECT node, '{f}' AS f, {f} AS v, count(*) AS c, sum(r) AS s FROM n{t}_{level} GROUP BY ALL" for f in features
            )
            side = "OVER (PARTITION BY node, f ORDER BY v)"
            parts.append(f"""best{t}_{level} AS MATERIALIZED (
              SELECT node, arg_max(f, worth) AS f, arg_max(v, worth) AS v FROM (
                SELECT node, f, v, cl, n, sl * sl / cl + (total - sl) ** 2 / nullif(n - cl, 0) AS worth FROM (
                  SELECT node, f, v, sum(c) {side} AS cl, sum(s) {side} AS sl,
                    sum(c) OVER (PARTITION BY node, f) AS n, sum(s) OVER (PARTITION BY node, f) AS total FROM ({cells})))
              WHERE cl < n GROUP BY node)""")
            value = " ".join(f"WHEN '{f}' THEN x.{f}" for f in features)
            parts.append(f"""n{t}_{level + 1} AS MATERIALIZED (
              SELECT x.* EXCLUDE (node), 2 * x.node + 1 + coalesce(CASE b.f {value} END > b.v, false)::INT AS node
              FROM n{t}_{level} x LEFT JOIN best{t}_{level} b ON b.node = x.node)""")
        weight = rate if t else 1.0
        parts.append(f"""rows{t + 1} AS MATERIALIZED (
          SELECT {columns}, pred + {weight} * avg(r) OVER (PARTITION BY node) AS pred FROM n{t}_{depth})""")
    return f"(WITH {', '.join(parts)} SELECT * FROM rows{trees})"


_STEPS = {"fives": "floor(l_quantity / 5)", "discount": "round(l_discount * 100)", "tax": "round(l_tax * 100)"}


def _two_trees(spark: SparkSession, d: str) -> DataFrame:
    """Two trees over features of few values, which have the same bins everywhere."""
    steps = [F.expr(e).cast("double").alias(name) for name, e in _STEPS.items()]
    rows = table(spark, d, "lineitem").select(*LINE_KEY, *steps, "l_extendedprice")
    fit = {"gradient_boosting": partial(ml.fit_gbt, trees=2, depth=2)}
    fitted = ml.fit_models(rows, list(_STEPS), "l_extendedprice", fit)
    return ml.prediction_table(fitted, rows, LINE_KEY, list(_STEPS), "l_extendedprice")


_STEP_ROWS = f"(SELECT {', '.join(LINE_KEY)}, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in _STEPS.items())}, l_extendedprice FROM lineitem)"
add(
    "ml08_boosting_two_trees",
    _two_trees,
    f"""SELECT * EXCLUDE (y, pred), y AS actual_l_extendedprice, pred AS pred_gradient_boosting
        FROM {boosted_sql(_STEP_ROWS, LINE_KEY, list(_STEPS), "l_extendedprice", 2, 2)}""",
    _features([*_STEPS, "actual_l_extendedprice", "pred_gradient_boosting"]),
)
add("ml09_fit_all", lambda s, d: fare_model.fit_split(marked(s, d)).predictions)
add(
    "ml10_prediction_table",
    lambda s, d: modelled(s, d)[0].predictions,
    sql(_OLS_TEST_SQL),
    _OLS_DOUBLES,
)


def _stored_model(spark: SparkSession, d: str) -> DataFrame:
    """ML11: load one stored model and predict all rows, training rows included."""
    results, outputs = modelled(spark, d)
    rows = results.train.unionByName(results.test).select(*ROUTE_KEYS, *FEATURES)
    return fare_model.predict_fares(rows, model_path=f"{outputs}/modeling/models")


add(
    "ml11_predict_stored",
    _stored_model,
    sql(f"SELECT * EXCLUDE (is_test, pred, avg_fare), pred AS predicted_avg_fare FROM {_OLS_SQL}"),
    _features([*FEATURES[:-1], "predicted_avg_fare"]),
)


def _results(spark: SparkSession, d: str) -> DataFrame:
    """ML12: what a run leaves behind, part by part."""
    results, _ = modelled(spark, d)
    (column,) = results.prediction_columns.values()
    parts = {
        "train": (results.train, TARGET, None), "test": (results.test, TARGET, None),
        "predictions": (results.predictions, f"actual_{TARGET}", column),
    }
    rows = [
        df.agg(
            F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.avg(actual).alias("actual"),
            (F.avg(pred) if pred else F.lit(None).cast("double")).alias("predicted"),
        )
        for name, (df, actual, pred) in parts.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


add(
    "ml12_results",
    _results,
    sql(
        f"""SELECT * FROM (WITH p AS MATERIALIZED (SELECT * FROM {_OLS_SQL})
            SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS part, count(*) AS n, avg(avg_fare) AS actual,
              NULL::DOUBLE AS predicted FROM p GROUP BY is_test
            UNION ALL SELECT 'predictions', count(*), avg(avg_fare), avg(pred) FROM p WHERE is_test)"""
    ),
    "actual predicted",
)

_MODEL_COLUMNS = [*FEATURES, TARGET]
add(
    "q08_model_correlations",
    lambda s, d: modelled(s, d)[0].correlation,
    sql(corr_sql("model_frame", _MODEL_COLUMNS)),
    "corr",
)


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    results, _ = modelled(spark, d)
    path = scratch_path(spark, "matrix")
    write_matrix(results.correlation, path, _MODEL_COLUMNS, "csv")
    return spark.read.option("header", "true").csv(path)


_MATRIX_SQL = " UNION ALL ".join(
    f"SELECT '{x}' AS x, "
    + ", ".join(f"CASE WHEN NOT isnan(corr({x}, {y})) THEN corr({x}, {y}) END AS {y}" for y in _MODEL_COLUMNS)
    + " FROM model_frame"
    for x in _MODEL_COLUMNS
)
add("snk03_write_matrix", _matrix, sql(_MATRIX_SQL), _features(_MODEL_COLUMNS))


def _stored_predictions(spark: SparkSession, d: str) -> DataFrame:
    _, outputs = modelled(spark, d)
    return spark.read.parquet(f"{outputs}/modeling/test_predictions")


add("snk04_write_predictions", _stored_predictions, sql(_OLS_TEST_SQL), _OLS_DOUBLES)
add(
    "q08_run_modeling",
    lambda s, d: fare_model.run_modeling(analysis(s, d, ordered=False), models=LINEAR).predictions,
    sql(_OLS_TEST_SQL),
    _OLS_DOUBLES,
)

# --- scores: the "predictions" are arithmetic on the rows, so SQL can score them too --------------------

_GUESSES = {
    "flat": "l_quantity * 1500",
    "taxed": "l_quantity * 1500 * (1 + l_tax)",
    "cheap": "(l_quantity * 1000 + 500)",
}
_NAMES = {name: f"pred_{name}" for name in _GUESSES}


def guesses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        *LINE_KEY, "l_extendedprice", *[F.expr(e).alias(_NAMES[n]) for n, e in _GUESSES.items()]
    )


def _score_sql(expr: str) -> str:
    return f"""sqrt(avg((l_extendedprice - {expr}) ** 2)) AS RMSE,
      avg(abs(l_extendedprice - {expr}) / greatest(abs(l_extendedprice), 2.220446049250313e-16)) AS MAPE,
      1 - sum((l_extendedprice - {expr}) ** 2) / (var_pop(l_extendedprice) * count(*)) AS R2"""


_SCORES_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS model, {_score_sql(expr)} FROM lineitem" for name, expr in _GUESSES.items()
)
_SCORE_DOUBLES = "RMSE MAPE R2"
for number, score in enumerate(("RMSE", "MAPE", "R2"), 1):
    add(
        f"evl0{number}_{score.lower()}",
        lambda s, d, score=score: ev.metrics(guesses(s, d), "l_extendedprice", "pred_flat").select(score),
        f"SELECT {score} FROM (SELECT {_score_sql(_GUESSES['flat'])} FROM lineitem)",
        score,
    )
add(
    "evl04_metrics_table",
    lambda s, d: ev.evaluate(guesses(s, d), "l_extendedprice", _NAMES),
    _SCORES_SQL,
    _SCORE_DOUBLES,
)


def _stored_scores(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "scores")
    write_table(ev.evaluate(guesses(spark, d), "l_extendedprice", _NAMES), path)
    return spark.read.parquet(path)


add("snk05_write_metrics", _stored_scores, _SCORES_SQL, _SCORE_DOUBLES)
add(
    "evl05_residual_histogram",
    lambda s, d: ev.residual_histogram(guesses(s, d), "l_extendedprice", _NAMES),
    " UNION ALL ".join(
        f"""SELECT '{name}' AS model, * FROM
        ({hist_sql(f'(SELECT l_extendedprice - {expr} AS residual FROM lineitem)', 'residual', 40)})"""
        for name, expr in _GUESSES.items()
    ),
    "edge_lo edge_hi",
)
add(
    "evl06_actual_vs_predicted",
    lambda s, d: ev.actual_vs_predicted(guesses(s, d), "l_extendedprice", "pred_taxed"),
    f"""SELECT *, least(min(l_extendedprice) OVER (), min(pred_taxed) OVER ()) AS diag_lo,
          greatest(max(l_extendedprice) OVER (), max(pred_taxed) OVER ()) AS diag_hi FROM
        (SELECT l_extendedprice, {_GUESSES['taxed']} AS pred_taxed FROM lineitem)""",
    "l_extendedprice pred_taxed diag_lo diag_hi",
)
add(
    "evl07_rmse_bars",
    lambda s, d: ev.evaluate(guesses(s, d), "l_extendedprice", _NAMES).select("model", "RMSE"),
    f"SELECT model, RMSE FROM ({_SCORES_SQL})",
    "RMSE",
)
add(
    "srt03_best_model",
    lambda s, d: ev.best_model(ev.evaluate(guesses(s, d), "l_extendedprice", _NAMES)),
    f"SELECT * FROM ({_SCORES_SQL}) ORDER BY RMSE, model LIMIT 1",
    _SCORE_DOUBLES,
)


def metrics_sql(frame: str) -> str:
    """The scores of least squares on the test rows."""
    return f"""SELECT 'linear_regression' AS model, sqrt(avg((avg_fare - pred) ** 2)) AS RMSE,
          avg(abs(avg_fare - pred) / greatest(abs(avg_fare), 2.220446049250313e-16)) AS MAPE,
          1 - sum((avg_fare - pred) ** 2) / (var_pop(avg_fare) * count(*)) AS R2
        FROM {fit_sql(frame)} WHERE is_test"""


_RESIDUALS_SQL = f"(SELECT avg_fare - pred AS residual FROM {_OLS_SQL} WHERE is_test)"

add(
    "q09_evaluate_models",
    lambda s, d: fare_model.evaluate_results(modelled(s, d)[0]),
    sql(metrics_sql("model_frame")),
    _SCORE_DOUBLES,
)
add("q09_evaluate_all_models", lambda s, d: fare_model.evaluate_results(fare_model.fit_split(marked(s, d))))
add(
    "q09_residual_histogram",
    lambda s, d: s.read.parquet(f"{modelled(s, d)[1]}/evaluation/residuals"),
    sql(f"SELECT 'linear_regression' AS model, * FROM ({hist_sql(_RESIDUALS_SQL, 'residual', 40)})"),
    "edge_lo edge_hi",
)
add(
    "q09_actual_vs_predicted",
    lambda s, d: s.read.parquet(f"{modelled(s, d)[1]}/evaluation/actual_vs_predicted/linear_regression"),
    sql(
        f"""SELECT avg_fare AS actual_avg_fare, pred AS pred_linear_regression,
              least(min(avg_fare) OVER (), min(pred) OVER ()) AS diag_lo,
              greatest(max(avg_fare) OVER (), max(pred) OVER ()) AS diag_hi
            FROM {_OLS_SQL} WHERE is_test"""
    ),
    "actual_avg_fare pred_linear_regression diag_lo diag_hi",
)
add(
    "q53_report_metrics",
    lambda s, d: fare_model.report_tables(s, modelled(s, d)[1])["metrics"],
    sql(metrics_sql("model_frame")),
    _SCORE_DOUBLES,
)
add(
    "q53_report_predictions",
    lambda s, d: fare_model.report_tables(s, modelled(s, d)[1])["predictions"],
    sql(f"{_OLS_TEST_SQL} ORDER BY YEAR, QUARTER, ORIGIN, DEST LIMIT 50"),
    _OLS_DOUBLES,
)


def _full_run(spark: SparkSession, d: str, models: Mapping[str, ml.Fit]) -> DataFrame:
    raw, work = write_raw_files(spark, d), scratch_path(spark, "full-run")
    return fare_model.run_all(spark, raw, work, cleaning.Period(2025, 1), models)


add("q54_full_run", lambda s, d: _full_run(s, d, LINEAR), sql(metrics_sql("model_quarter")), _SCORE_DOUBLES)
add("q54_full_run_all_models", lambda s, d: _full_run(s, d, ml.MODELS))
