"""Queries for profiles, correlations and chart tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from routestats.operators import distribution as dist
from routestats.operators import profile
from routestats.queries.registry import add
from routestats.queries.relational import hash_order
from routestats.queries.tables import LINE_KEY, capacity, delays, fuel, sql, table


def describe_sql(source: str, cols: Sequence[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", avg({c}) AS mean, stddev_samp({c}) AS std,
        min({c})::DOUBLE AS "min", quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50,
        quantile_cont({c}, 0.75) AS q75, max({c})::DOUBLE AS "max" FROM {source}"""
        for c in cols
    )


DESCRIBE_DOUBLES = '"mean" std "min" q25 q50 q75 "max"'.replace('"', "")


def corr_sql(source: str, cols: Sequence[str], lower: bool = False) -> str:
    cells = []
    for i, x in enumerate(cols):
        for j, y in enumerate(cols):
            if not lower or i >= j:
                cells.append(f"SELECT '{x}' AS x, '{y}' AS y, corr({x}, {y}) AS c FROM {source}")
    return f"SELECT x, y, CASE WHEN NOT isnan(c) THEN c END AS corr FROM ({' UNION ALL '.join(cells)})"


def hist_sql(source: str, col: str, bins: int) -> str:
    """Bins found by comparing each value with the edges; meant for a different route to the result."""
    return f"""SELECT bin::INT AS bin, any_value(edge_lo) AS edge_lo, any_value(edge_hi) AS edge_hi,
      coalesce(sum(c), 0)::BIGINT AS n
    FROM (SELECT i AS bin, lo + i * ((hi - lo) / {bins}) AS edge_lo,
            CASE WHEN i = {bins - 1} THEN hi ELSE lo + (i + 1) * ((hi - lo) / {bins}) END AS edge_hi
          FROM (SELECT min({col})::DOUBLE AS lo, max({col})::DOUBLE AS hi FROM {source}), range({bins}) r(i))
    LEFT JOIN (SELECT {col} AS v, count(*) AS c FROM {source} WHERE {col} IS NOT NULL GROUP BY 1)
      ON v >= edge_lo AND (v < edge_hi OR (bin = {bins - 1} AND v <= edge_hi))
    GROUP BY bin"""


def auto_hist_sql(source: str, cols: Sequence[str]) -> str:
    """Bins of each column, as many as the automatic rule gives."""
    out = []
    for c in cols:
        out.append(
            f"""SELECT '{c}' AS "column", bin::INT AS bin, any_value(edge_lo) AS edge_lo, any_value(edge_hi) AS edge_hi,
              coalesce(sum(c), 0)::BIGINT AS n
            FROM (SELECT bin, bins, lo + bin * ((hi - lo) / bins) AS edge_lo,
                    CASE WHEN bin = bins - 1 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / bins) END AS edge_hi
                  FROM (SELECT lo, hi, bins, unnest(range(bins)) AS bin FROM (
                    SELECT lo, hi, greatest(1, ceil((hi - lo) / least((hi - lo) / (log2(n) + 1),
                      greatest(2 * iqr / power(n, 1.0::DOUBLE / 3), (hi - lo) / sqrt(n) / 2))))::BIGINT AS bins
                    FROM (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, count({c})::DOUBLE AS n,
                      quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM {source}))))
            LEFT JOIN (SELECT {c} AS v, count(*) AS c FROM {source} WHERE {c} IS NOT NULL GROUP BY 1)
              ON v >= edge_lo AND (v < edge_hi OR (bin = bins - 1 AND v <= edge_hi))
            GROUP BY bin"""
        )
    return " UNION ALL ".join(out)


def box_sql(source: str, key: str | None, cols: Sequence[str]) -> str:
    out = []
    group = f"{key}, " if key else ""
    known = f"AND {key} IS NOT NULL" if key else ""
    using = f"USING ({key})" if key else "ON true"
    for c in cols:
        out.append(
            f"""SELECT {group}'{c}' AS "column", count(*) AS n, any_value(q1) AS q1, any_value(m) AS median,
            any_value(q3) AS q3, least(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)), any_value(q1)) AS whisker_lo,
            greatest(max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)), any_value(q3)) AS whisker_hi
            FROM (SELECT {group}{c} AS v FROM {source} WHERE {c} IS NOT NULL {known})
            JOIN (SELECT {group}quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS m,
                    quantile_cont({c}, 0.75) AS q3 FROM {source} GROUP BY ALL) {using} GROUP BY ALL"""
        )
    return " UNION ALL ".join(out)


BOX_DOUBLES = "q1 median q3 whisker_lo whisker_hi"


def kde_sql(
    source: str, key: str, col: str, grid: int = 100, cut: float = 0.0, common: bool = False
) -> str:
    total = f"(SELECT count({col}) FROM {source} WHERE {key} IS NOT NULL)" if common else "n"
    return f"""SELECT {key}, i::INT AS point, a + i * (b - a) / {grid - 1} AS x,
      sum(w * exp(-0.5 * power((a + i * (b - a) / {grid - 1} - v) / h, 2))) / (any_value(t) * any_value(h) * sqrt(2 * pi()))
        AS density
    FROM (SELECT {key}, {col} AS v, count(*) AS w FROM {source} WHERE {col} IS NOT NULL AND {key} IS NOT NULL GROUP BY ALL)
    JOIN (SELECT {key}, h, lo - {cut} * h AS a, hi + {cut} * h AS b, {total} AS t FROM (
      SELECT {key}, count({col}) AS n, stddev_samp({col}) * power(count({col}), -0.2) AS h,
        min({col}) AS lo, max({col}) AS hi FROM {source} GROUP BY ALL HAVING stddev_samp({col}) > 0)) USING ({key}),
      range({grid}) r(i)
    GROUP BY {key}, i, a, b"""


# --- profiles -----------------------------------------------------------------------------------------

add(
    "prf01_shape",
    lambda s, d: profile.shape(table(s, d, "lineitem")),
    "SELECT count(*) AS rows, 11 AS columns FROM lineitem",
)
add(
    "prf02_missing_counts",
    lambda s, d: profile.missing_counts(delays(s, d).select("airport", "security_delay", "late_aircraft_delay")),
    sql(
        """SELECT unnest(['airport', 'security_delay', 'late_aircraft_delay']) AS "column",
          unnest([count(*) - count(airport), count(*) - count(security_delay), count(*) - count(late_aircraft_delay)])
          AS missing FROM delays"""
    ),
)
_DESCRIBED = ["l_quantity", "l_extendedprice", "l_tax"]
add(
    "prf03_describe",
    lambda s, d: profile.describe_exact(table(s, d, "lineitem"), _DESCRIBED),
    describe_sql("lineitem", _DESCRIBED),
    DESCRIBE_DOUBLES,
)

# --- correlation --------------------------------------------------------------------------------------

_CORR = ["arr_flights", "security_delay", "late_aircraft_delay", "constant"]
_CORR_SOURCE = "(SELECT *, 0.1::DOUBLE AS constant FROM delays)"
add(
    "st01_corr_matrix",
    lambda s, d: dist.corr_matrix(delays(s, d).withColumn("constant", F.lit(0.1)), _CORR),
    sql(corr_sql(_CORR_SOURCE, _CORR)),
    "corr",
)
# Values far from zero, missing in the first rows and in others of the second column: nothing may hang on the order.
_FAR = {
    "x": "CASE WHEN l_orderkey > 500 THEN 1e9 + l_extendedprice / 1000 END",
    "y": "CASE WHEN l_linenumber <> 3 THEN 1e9 + l_extendedprice / 1000 + l_quantity END",
    "z": "CASE WHEN l_linenumber <> 2 THEN l_quantity - 5e8 END",
}
add(
    "st01_large_offset",
    lambda s, d: dist.corr_matrix(
        table(s, d, "lineitem").orderBy("l_orderkey").select(*[F.expr(e).cast("double").alias(c) for c, e in _FAR.items()]), list(_FAR)
    ),
    corr_sql(f"(SELECT {', '.join(f'({e})::DOUBLE AS {c}' for c, e in _FAR.items())} FROM lineitem)", list(_FAR)),
    "corr",
)
add(
    "st02_lower_triangle",
    lambda s, d: dist.lower_triangle(dist.corr_matrix(delays(s, d).withColumn("constant", F.lit(0.1)), _CORR), _CORR),
    sql(corr_sql(_CORR_SOURCE, _CORR, lower=True)),
    "corr",
)

# --- distributions ------------------------------------------------------------------------------------

add(
    "st03_histogram",
    lambda s, d: dist.histogram(table(s, d, "lineitem"), "l_extendedprice", 60),
    hist_sql("lineitem", "l_extendedprice", 60),
    "edge_lo edge_hi",
)
add(
    "st03_histogram_on_edges",
    lambda s, d: dist.histogram(table(s, d, "lineitem"), "l_quantity", 49),
    hist_sql("lineitem", "l_quantity", 49),
    "edge_lo edge_hi",
)
add(
    "st04_box_stats",
    lambda s, d: dist.box_stats(table(s, d, "events"), "event_type", ["value"]),
    box_sql("events", "event_type", ["value"]),
    BOX_DOUBLES,
)
_BOXED = ["SEATS", "PASSENGERS", "DEPARTURES_PERFORMED"]
add(
    "st05_box_stats_global",
    lambda s, d: dist.box_stats(capacity(s, d), None, _BOXED),
    sql(box_sql("capacity", None, _BOXED)),
    BOX_DOUBLES,
)
add(
    "st06_kde",
    lambda s, d: dist.kde(table(s, d, "events"), "event_type", "value"),
    kde_sql("events", "event_type", "value"),
    "x density",
    digits=6,
)
_PAIRED = ["l_quantity", "l_extendedprice", "l_discount"]
_PAIR_ORDER = f"ORDER BY {hash_order(LINE_KEY)}, {', '.join(LINE_KEY)}"
add(
    "st07_pair_data",
    lambda s, d: dist.pair_data(table(s, d, "lineitem"), _PAIRED, 3000, LINE_KEY, hue="l_returnflag"),
    f"SELECT {', '.join(_PAIRED)}, l_returnflag FROM lineitem {_PAIR_ORDER} LIMIT 3000",
    " ".join(_PAIRED),
)
add(
    "st07_pair_histograms",
    lambda s, d: dist.pair_marginals(dist.pair_data(table(s, d, "lineitem"), _PAIRED, 3000, LINE_KEY), _PAIRED),
    f"""WITH sampled AS MATERIALIZED (SELECT {', '.join(_PAIRED)} FROM lineitem {_PAIR_ORDER} LIMIT 3000)
        {auto_hist_sql('sampled', _PAIRED)}""",
    "edge_lo edge_hi",
)
add(
    "st07_pair_densities",
    lambda s, d: dist.pair_marginals(
        dist.pair_data(table(s, d, "lineitem"), ["l_quantity"], 3000, LINE_KEY, hue="l_returnflag"),
        ["l_quantity"], hue="l_returnflag",
    ),
    f"""WITH sampled AS MATERIALIZED (SELECT l_quantity, l_returnflag FROM lineitem {_PAIR_ORDER} LIMIT 3000)
        SELECT 'l_quantity' AS "column", * FROM ({kde_sql('sampled', 'l_returnflag', 'l_quantity', 200, 3.0, True)})""",
    "x density",
    digits=6,
)
add(
    "st08_scatter_data",
    lambda s, d: dist.scatter_data(table(s, d, "lineitem"), "l_quantity", "l_tax", 5000, LINE_KEY),
    f"""WITH sampled AS MATERIALIZED (SELECT l_quantity, l_tax FROM lineitem {_PAIR_ORDER} LIMIT 5000)
        SELECT *, (SELECT least(min(l_quantity), min(l_tax)) FROM sampled) AS diag_lo,
          (SELECT greatest(max(l_quantity), max(l_tax)) FROM sampled) AS diag_hi FROM sampled""",
    "l_quantity l_tax diag_lo diag_hi",
)
add(
    "st09_series_data",
    lambda s, d: dist.series_data(fuel(s, d), "observation_date", "DJFUELUSGULF"),
    sql(
        """SELECT observation_date, price AS DJFUELUSGULF, (SELECT avg(price) FROM fuel) AS mean_line FROM fuel
           WHERE price IS NOT NULL"""
    ),
    "DJFUELUSGULF mean_line",
    dates="observation_date",
)
