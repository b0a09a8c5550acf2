"""What the classifiers share: rows held out by a hash of the id, and the labelled rows, all or a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text, modulo ``parts``, is ``part``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def training_labels(labels: DataFrame, label: str, keep: Column) -> tuple[DataFrame, float]:
    """((doc_id, label) of all kept ids of label 0 or 1, the share of label 0 among them).

    A repeated id counts once, with its smallest label.
    """
    known = labels.where(keep & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    bad, n = known.agg(F.sum(1 - F.col("label")), F.count("*")).first()
    return known, (bad or 0) / max(1, n)


def training_sample(labels: DataFrame, label: str, keep: Column, rows: int) -> tuple[DataFrame, float]:
    """(at most ``rows`` labelled ids of each of label 0 and 1, the share of label 0 among all kept labels).

    The ids come in the order of a hash. A repeated id counts once, with its smallest label.
    """
    known, share = training_labels(labels, label, keep)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.where(F.col("label") == value).orderBy(*order).limit(rows) for value in (0, 1)]
    return parts[0].unionByName(parts[1]), share
