"""The operators bound to the test tables with production parameters, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routestats.llm.derivatives import build_derivatives, page_responses
from routestats.llm.fingerprints import compare_with_next
from routestats.llm.hard_negatives import mine_negatives
from routestats.llm.mixing import MAX_MEAN, SEED, TEMPERATURE, TERMS, mix_sources
from routestats.llm.near_duplicates import near_duplicates
from routestats.llm.neighbours import nearest_neighbours
from routestats.llm.pieces import encode_documents, read_pieces
from routestats.llm.pseudonyms import pseudonymise
from routestats.llm.quality import score_quality
from routestats.llm.repeated_bytes import remove_repeated_bytes
from routestats.llm.repeated_passages import remove_repeats
from routestats.llm.toxicity import score_toxicity
from routestats.llm.vector_codes import ROUNDS, code_report

#: The key under which the queries, and they alone, make pseudonyms.
TEST_KEY = "pseudonyms-1"
WORDS = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(_table(spark, sf_dir, "documents"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op3_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_derivatives(page_responses(_table(spark, sf_dir, "pages")))


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_table(spark, sf_dir, "documents"), TEST_KEY)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), read_pieces())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(_table(spark, sf_dir, "embeddings"))


OP2_SQL = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
firsts AS (SELECT s, min(doc_id) AS head FROM windows GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (s) WHERE head < doc_id),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

OP8_SQL = rf"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w
  FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
coded AS (SELECT doc_id, dense_rank() OVER (ORDER BY s) AS s FROM shingled),
sizes AS (SELECT doc_id, count(*) AS n FROM coded GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM coded a JOIN coded b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * k >= 75 * (p.n + q.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT x AS node, x AS other FROM edges
  UNION SELECT r.node, e.y FROM reach r JOIN edges e ON e.x = r.other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id,
  coalesce(root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN roots r ON r.node = d.doc_id
"""

OP9_SQL = f"""
WITH sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source),
means AS (
  SELECT source, sum(size) OVER () * pow(size, {TEMPERATURE}) / sum(pow(size, {TEMPERATURE})) OVER () / size AS mean
  FROM sizes),
parts AS (SELECT source, greatest(ceil(mean / {MAX_MEAN}), 1)::BIGINT AS n, mean / greatest(ceil(mean / {MAX_MEAN}), 1) AS mean FROM means),
steps AS (
  SELECT source, n, list_transform(range(0, {TERMS}), lambda k: list_sum(list_transform(range(0, k + 1),
    lambda j: exp(j * ln(mean) - lgamma(j + 1) - mean)))) AS below FROM parts),
drawn AS (
  SELECT d.*, list_sum(list_transform(range(1, n + 1), lambda i: len(list_filter(below, lambda p: p <=
    ('0x' || substr(md5('{SEED}|' || doc_id || '|s' || d.source || '|' || i), 1, 13))::BIGINT / pow(2, 52)))))::BIGINT AS n
  FROM documents d JOIN steps s ON s.source = d.source)
SELECT doc_id, text, lang, source, n_chars FROM (SELECT *, unnest(range(0, n)) FROM drawn)
"""

OP11_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""

OP12_SQL = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (
  SELECT doc_id, f, substr(h, 2 * f + 1, 3200) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 1200)) AS f FROM bytes)),
windows AS MATERIALIZED (
  SELECT doc_id, f + p AS p, md5_number(substr(h, 2 * p + 1, 800)) AS s
  FROM (SELECT *, unnest(range(0, least(1200, len(h) // 2 - 399))) AS p FROM pieces WHERE len(h) >= 800)),
often AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
starts AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM windows SEMI JOIN often USING (s)),
runs AS (
  SELECT doc_id, min(p) AS low, max(p) + 400 AS high
  FROM (SELECT *, count(*) FILTER (before IS NULL OR p > before + 400) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM starts)
  GROUP BY doc_id, run),
cuts AS (
  SELECT doc_id, count(*) AS n_spans, sum(high - low) AS n_removed, list(low ORDER BY low) AS lows, list(high ORDER BY low) AS highs
  FROM runs GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, n_spans + 1),
    lambda i: h[CASE WHEN i = 0 THEN 1 ELSE 2 * highs[i] + 1 END : CASE WHEN i = n_spans THEN len(h) ELSE 2 * lows[i + 1] END]), '') END)) AS kept_sha256
FROM bytes LEFT JOIN cuts USING (doc_id)
"""


def _code_sql(rounds: int) -> str:
    """Distances to all entries by a join of components, then entries by the means of what is coded by them."""
    steps = [
        f"""
d{n} AS MATERIALIZED (
  SELECT c.vec_id, c.p, b.i, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS e
  FROM cells c JOIN b{n} b ON b.p = c.p AND b.j = c.j GROUP BY c.vec_id, c.p, b.i),
a{n} AS MATERIALIZED (SELECT vec_id, p, arg_min(i, (e, i)) AS i, min(e) AS e FROM d{n} GROUP BY vec_id, p),
m{n} AS (
  SELECT c.p, a.i, c.j, floor(sum(c.x) / count(*))::BIGINT AS x
  FROM cells c JOIN a{n} a ON a.vec_id = c.vec_id AND a.p = c.p GROUP BY c.p, a.i, c.j),
b{n + 1} AS MATERIALIZED (SELECT p, i, j, coalesce(m{n}.x, b{n}.x) AS x FROM b{n} LEFT JOIN m{n} USING (p, i, j)),"""
        for n in range(rounds + 1)
    ]
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (
  SELECT vec_id, d // (w // 4) AS p, d % (w // 4) AS j, v[d + 1] AS x
  FROM (SELECT vec_id, v, len(v) AS w, unnest(range(0, len(v))) AS d FROM kept)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM kept ORDER BY vec_id LIMIT 256),
b0 AS MATERIALIZED (SELECT p, i, j, x FROM cells JOIN seeds USING (vec_id)),
{"".join(steps)}
coded AS (
  SELECT vec_id, string_agg(printf('%02x', i), '' ORDER BY p) AS code, sum(e)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, i, j)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), books
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_fingerprints, op2_repeated_passages, op3_derivatives, op4_pseudonyms, op5_neighbours, op6_pieces,
              op7_quality, op8_near_duplicates, op9_mixing, op10_toxicity, op11_hard_negatives, op12_repeated_bytes,
              op13_vector_codes)
}

SQL: dict[str, str] = {
    "op2_repeated_passages": OP2_SQL,
    "op8_near_duplicates": OP8_SQL,
    "op9_mixing": OP9_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_repeated_bytes": OP12_SQL,
    "op13_vector_codes": _code_sql(ROUNDS),
}
