"""Sources mixed to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routestats.operators.scale import join_sized

#: Target weight of a source: its characters to this power; 1 keeps the corpus as it is, 0 makes sources equal.
TEMPERATURE = 0.5
SEED = 17
#: Terms of one inverted distribution, and its largest mean; a larger mean is the sum of several equal ones.
TERMS, MAX_MEAN = 40, 8.0

_BITS = 52


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 over the parts."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("long") / F.lit(float(1 << _BITS))


def poisson(u: Column, mean: Column) -> Column:
    """The smallest k with P(X <= k) > u for a Poisson X of the mean (at most MAX_MEAN); rounding ends at TERMS."""
    start = F.struct(
        u.alias("u"), mean.alias("mean"), F.exp(-mean).alias("p"), F.exp(-mean).alias("below"), F.lit(0).alias("k")
    )

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * acc["mean"] / k
        count = F.when(acc["u"] >= acc["below"], k).otherwise(acc["k"]).cast("int")
        return F.struct(
            acc["u"].alias("u"), acc["mean"].alias("mean"), p.alias("p"), (acc["below"] + p).alias("below"), count.alias("k")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["k"])


def poisson_count(mean: Column, *parts: Column) -> Column:
    """A Poisson number of any mean, drawn by the hash of the parts: independent Poissons of equal means up to MAX_MEAN
    have a sum that is one of their means' sum."""
    draws = F.greatest(F.ceil(mean / MAX_MEAN), F.lit(1)).cast("int")

    def drawn(number: Column) -> Column:
        return poisson(uniform(*parts, number), mean / draws)

    return F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), lambda total, number: total + drawn(number))


def repetitions(docs: DataFrame, weights: DataFrame | None = None, budget: float | None = None) -> DataFrame:
    """(source, mean): how often a document of each source is to appear on average.

    ``weights`` has (source, weight); without it a source's weight is its characters to the power TEMPERATURE.
    ``budget`` is the number of characters wanted, by default as many as there are. Texts are counted by their
    length; a source without characters has mean 1. A null source is a source of its own.
    """
    sized = docs.select("source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    sized = sized.groupBy("source").agg(F.sum("size").alias("size"))
    if weights is None:
        sized = sized.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(TEMPERATURE)))
    else:
        given = weights.select(F.col("source").alias("_of"), F.col("weight").cast("double").alias("weight"))
        sized = sized.join(given, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of").fillna(0.0, ["weight"])
    row = sized.agg(F.sum("weight"), F.sum("size")).first()
    whole, size = row[0] or 0.0, budget if budget is not None else float(row[1] or 0)
    mean = F.lit(size) * F.col("weight") / F.lit(whole) / F.col("size") if whole else F.lit(1.0)
    return sized.select("source", F.when(F.col("size") > 0, mean).otherwise(F.lit(1.0)).alias("mean"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, source, text and any other columns) with each row repeated, in a random order.

    A row appears Poisson(mean of its source) times: a hash of the seed, the id and the source is the uniform number
    whose quantile is taken, so the same row always gets the same count; rows alike in both get the same. A mean above
    8 is dealt to several numbers, hashed with their place, whose quantiles are added up. A hash of seed, id and copy deals every row to a
    partition and orders the partition, so the rows of a source, and the copies of a row, lie anywhere in the result.

    Null texts count no characters; a null id or source takes part like any other value. Source weights of zero
    leave the source out. An empty table gives an empty result.
    """
    def key(source: Column) -> Column:
        return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n")).alias("key")

    means = repetitions(docs, weights, budget).select(key(F.col("source")), "mean")
    # The whole row is one column, so that its names can't clash with those used here.
    doc = F.coalesce(docs["doc_id"].cast("string"), F.lit("null")).alias("doc")
    rows = join_sized(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key(docs["source"]), doc), means, ["key"])
    count = poisson_count(F.col("mean"), F.lit(seed), F.col("doc"), F.col("key"))
    copies = rows.select("row", "doc", F.explode(F.sequence(F.lit(0), count)).alias("copy")).where("copy > 0")
    order = F.md5(F.concat_ws("|", F.lit(f"{seed}|order"), "doc", F.col("copy").cast("string")).cast("binary"))
    return copies.select("row", order.alias("at")).repartition("at").sortWithinPartitions("at").select("row.*")
