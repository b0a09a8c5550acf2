"""Approximate nearest neighbours: multi-index hashing of learned rotated binary codes, reranked exactly."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routestats.llm.arrow import map_rows
from routestats.session import materialize

#: Vectors, in the order of a hash, on which rotations and radius are learned, and those that ask on it.
SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 400
#: Bits of a code (several rotations are learned if there are fewer dimensions) and of a substring.
CODE_BITS, PART_BITS = 256, 16
ROUNDS = 20
#: Share of the sample's true neighbours that the radius takes in. Nearer ones, in the full table, are closer.
WITHIN = 0.99
#: Indexed vectors of one block.
BLOCK_ROWS = 8192

_MASKS = np.argsort(np.bitwise_count(np.arange(1 << PART_BITS, dtype=np.uint16)), kind="stable").astype(np.uint16)
_BALL = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << PART_BITS, dtype=np.uint16))))


@dataclass(frozen=True)
class Codes:
    """Bits are the signs of the rotations of a vector, less the mean; ``radius`` is the search radius."""

    mean: np.ndarray
    rotations: np.ndarray
    radius: int

    def parts(self, vectors: np.ndarray) -> np.ndarray:
        """The code of each vector as numbers of PART_BITS bits."""
        bits = (vectors - self.mean) @ self.rotations >= 0
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % PART_BITS)))
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(axis=1))


def fit_codes(sample: np.ndarray, k: int) -> Codes:
    """Rotations by iterative quantisation: alternate between the signs and the rotation nearest to them."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    axes = np.linalg.svd(centred.T @ centred)[0]
    flat, learned, random = centred @ axes, [], np.random.default_rng(5)
    for _ in range(max(1, CODE_BITS // sample.shape[1])):
        turn = np.linalg.qr(random.standard_normal((sample.shape[1],) * 2))[0]
        for _ in range(ROUNDS):
            signs = np.where(flat @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(signs.T @ flat)
            turn = (u @ v).T
        learned.append(axes @ turn)
    codes = Codes(mean, np.concatenate(learned, axis=1), 0)
    parts, far = codes.parts(sample), [0]
    for q in range(min(SAMPLE_QUERIES, len(sample))):
        near = np.argsort(distances(sample, sample[q]), kind="stable")
        near = near[near != q][:k]
        far += np.bitwise_count(parts[near] ^ parts[q]).sum(axis=1).tolist()
    return Codes(mean, codes.rotations, int(np.quantile(far, WITHIN, method="higher")))


class Block:
    """Some vectors with an index from the values of each substring to the vectors that have it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes) -> None:
        self.ids, self.vectors, self.parts = ids, vectors, codes.parts(vectors)
        self.order = np.argsort(self.parts, axis=0, kind="stable")
        self.values, self.starts = [], []
        for j in range(self.parts.shape[1]):
            values, starts = np.unique(self.parts[self.order[:, j], j], return_index=True)
            self.values.append(values)
            self.starts.append(np.r_[starts, len(ids)])

    def _probe(self, j: int, value: int, within: int) -> np.ndarray:
        """The vectors whose j-th substring differs from the value in at most ``within`` bits."""
        values, starts = self.values[j], self.starts[j]
        if _BALL[within] < len(values):  # look up each value of the ball, or look through the values there are
            ball = np.sort(_MASKS[: _BALL[within]] ^ value)
            at = np.searchsorted(values, ball)
            at = at[values[np.minimum(at, len(values) - 1)] == ball]
        else:
            at = np.flatnonzero(np.bitwise_count(values ^ value) <= within)
        hit = np.zeros(len(values) + 1, np.int64)
        hit[at] = 1
        return self.order[np.repeat(hit[:-1] > 0, np.diff(starts)), j]

    def within(self, part: np.ndarray, radius: int) -> np.ndarray:
        """All vectors whose code differs in at most ``radius`` bits.

        By the pigeonhole principle, some of the first ``radius % m + 1`` of the m substrings differs in at most
        ``radius // m`` bits, or some other one in one bit less.
        """
        count = len(part)
        if radius >= count * PART_BITS:
            return np.arange(len(self.ids))
        most, rest = divmod(radius, count)
        seen = np.zeros(len(self.ids), bool)
        for j in range(count):
            allowed = most if j <= rest else most - 1
            if allowed >= 0:
                seen[self._probe(j, part[j], min(allowed, PART_BITS))] = True
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.parts[found] ^ part).sum(axis=1) <= radius]

    def nearest(self, query_id: int, query: np.ndarray, part: np.ndarray, radius: int, k: int) -> list[tuple[int, float]]:
        found = self.within(part, radius)
        found = found[self.ids[found] != query_id]
        score = distances(self.vectors[found], query)
        order = np.lexsort((self.ids[found], score))
        ids = self.ids[found][order]
        once = np.sort(np.unique(ids, return_index=True)[1])[:k]
        return list(zip(ids[once].tolist(), score[order][once].tolist(), strict=True))


def _searched(codes: Codes, radius: int, k: int):
    """A block's vectors come first; the queries that follow are answered one by one."""

    def search(rows: Iterable[tuple]) -> Iterator[tuple]:
        own, ids, vectors, block = None, [], [], None
        for number, kind, vec_id, vector in rows:
            if number != own:
                own, ids, vectors, block = number, [], [], None
            if kind == 0:
                ids.append(vec_id)
                vectors.append(np.array(vector, np.float64))
                continue
            if not ids:
                continue
            if block is None:
                block = Block(np.array(ids), np.stack(vectors), codes)
            query = np.array(vector, np.float64)
            part = codes.parts(query[None, :])[0]
            for other, score in block.nearest(vec_id, query, part, radius, k):
                yield vec_id, other, score

    return search


def usable(vector: Column) -> Column:
    """Whether a vector is there, not empty, not all zero, and has finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row of ``vectors`` that ``queries`` admits.

    ``vectors`` has (vec_id, embedding); other columns are ignored. The score is the Euclidean distance in double
    precision, ties go to the smaller vec_id; a query's own id is no candidate. All candidates are returned if there
    are fewer than k. Null, zero and empty vectors, those with null or non-finite components, with another length
    than most (of equals, the shortest) or without an id take no part; repeated rows and ids count once, with the
    smaller distance. An empty table gives an empty result.

    Codes, rotations and the radius are learned on a bounded sample. All vectors are indexed, in blocks; each query
    visits every block, where all codes within the radius are retrieved by their substrings and reranked. Queries
    that find fewer than k vectors anywhere look through all of them.
    """
    ddl = "query_id long, vec_id long, score double"
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
    ).where(F.col("vec_id").isNotNull())
    rows = rows.where(usable(F.col("vector"))).groupBy("vec_id", "vector").agg(F.max("asks").alias("asks"))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = materialize(rows.where(F.size("vector") == lengths[0]), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE_ROWS).select("vector").toArrow()
    codes = fit_codes(np.array(sample.column(0).to_pylist(), np.float64), k)

    total = rows.count()
    blocks = total // BLOCK_ROWS + 1
    indexed = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), "vec_id", "vector")
    asking = rows.where("asks").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(asked: DataFrame, radius: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
        sent = asked.select(every, F.lit(1).alias("kind"), "vec_id", "vector")
        dealt = indexed.unionByName(sent).repartition("block").sortWithinPartitions("block", "kind")
        return materialize(map_rows(dealt, _searched(codes, radius, k), schema, ddl), "found")

    found = search(asking, codes.radius)
    counts = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"))
    short = materialize(asking.join(counts.where(F.col("n") >= k), "vec_id", "left_anti"), "short")
    if short.take(1):
        wide = search(short, codes.parts(np.zeros((1, lengths[0]))).shape[1] * PART_BITS)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(wide)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
