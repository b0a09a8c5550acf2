"""Hard negatives: for each anchor and positive the best rows of other labels whose scores lie just below the positive's."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from routestats.llm.arrow import emit, map_rows, rows_of
from routestats.llm.vector_codes import finite, integers
from routestats.session import materialize

#: Positives of an anchor, negatives of a positive, and the percentage of the positive's score that a negative needs.
POSITIVES, NEGATIVES, LEAST = 5, 5, 80
#: Integer steps in one unit of a component.
SCALE = 256
#: Bytes of a block of rows or anchors, blocks of either kind that meet in one task on average at most.
BLOCK_BYTES, MEET = 1 << 18, 64
#: Rows scored at a time against a block of anchors.
STEP_ROWS = 1024


@dataclass
class Best:
    """The k best (score, then smaller id) of each slot, numbered by anchor and slot; memory is bounded by both."""

    k: int
    slot: np.ndarray
    score: np.ndarray
    vec_id: np.ndarray

    @classmethod
    def none(cls, k: int) -> Best:
        return cls(k, *(np.empty(0, np.int64) for _ in range(3)))

    def add(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        slot, score, vec_id = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.vec_id, vec_id)))
        order = np.lexsort((vec_id, -score, slot))
        slot = slot[order]
        first = np.searchsorted(slot, slot)
        keep = np.arange(len(slot)) - first < self.k
        order = order[keep]
        self.slot, self.score, self.vec_id = slot[keep], score[order], vec_id[order]

    def floors(self, slots: int) -> np.ndarray:
        """The score a row needs to enter each slot: that of the k-th, or the least number."""
        out = np.full(slots, np.iinfo(np.int64).min)
        full = np.searchsorted(self.slot, np.arange(slots), "right") - np.searchsorted(self.slot, np.arange(slots)) == self.k
        last = np.searchsorted(self.slot, np.arange(slots), "right") - 1
        out[full] = self.score[last[full]]
        return out


@dataclass(frozen=True)
class Rows:
    """Ids, labels and integer vectors (one a line) of a block."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    @classmethod
    def unpacked(cls, ids: bytes, labels: bytes, vectors: bytes) -> Rows:
        ids = np.frombuffer(ids, "<i8")
        return cls(ids, np.frombuffer(labels, "<i8"), np.frombuffer(vectors, "<i4").reshape(len(ids), -1).astype(np.int64))


def products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact integer inner products, in doubles where no sum can exceed their 53 bits."""
    if not one.size or not two.size:
        return np.zeros((len(one), len(two)), np.int64)
    if int(np.abs(one).max()) * int(np.abs(two).max()) * one.shape[1] < 1 << 53:
        return (one.astype(np.float64) @ two.astype(np.float64).T).astype(np.int64)
    return one @ two.T


def choose(best: Best, rows: Rows, anchors: Rows, limits: np.ndarray | None, least: int) -> None:
    """Add the rows of a block to the slots of a block of anchors.

    Without limits each anchor has one slot, for other rows of its label. With limits (anchor, slot: descending scores
    of positives, the last repeated) slot i is for rows of other labels with ``limits[i + 1] < score <= limits[i]``
    that some limit from i on admits; the last has no lower limit but that.
    """
    count, width = len(anchors.ids), 1 if limits is None else limits.shape[1]
    lowest = np.iinfo(np.int64).min
    if limits is not None:
        # 100 * score >= least * limit, as an integer bound; none is admitted above a negative limit
        needed = -((-least * limits) // 100)
        under = np.c_[limits[:, 1:], np.full(count, lowest)]
    for low in range(0, len(rows.ids), STEP_ROWS):
        part = slice(low, low + STEP_ROWS)
        score = products(anchors.vectors, rows.vectors[part])
        floor = best.floors(count * width).reshape(count, width)
        same = anchors.labels[:, None] == rows.labels[part]
        if limits is None:
            mask = same & (score >= floor) & (anchors.ids[:, None] != rows.ids[part])
            at, row = np.nonzero(mask)
            slot = np.zeros(len(at), np.int64)
        else:
            bound = np.maximum(needed, floor)
            at, row = np.nonzero(~same & (score <= limits[:, :1]) & (score >= bound.min(axis=1)[:, None]))
            found = score[at, row]
            slot = (found[:, None] <= limits[at]).sum(axis=1) - 1
            keep = (found > under[at, slot]) & (found >= bound[at, slot])
            at, row, slot = at[keep], row[keep], slot[keep]
        best.add(at * width + slot, score[at, row], rows.ids[part][row])


_PACKED = pa.schema([("part", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])
_PACKED_DDL = "part long, ids binary, labels binary, vectors binary"


def _packed(width: int, scale: int):
    """Blocks of rows with a number from their content, so that a task run again names them the same."""
    most = max(1, BLOCK_BYTES // (4 * max(width, 1)))

    def pack(rows: Iterable[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []

        def block() -> tuple:
            ids, labels, vectors = (list(c) for c in zip(*held, strict=True))
            data = integers(vectors, width, scale).astype("<i4").tobytes()
            return ids[0], np.array(ids, "<i8").tobytes(), np.array(labels, "<i8").tobytes(), data

        for row in rows:
            held.append(row)
            if len(held) == most:
                yield block()
                held = []
        if held:
            yield block()

    return pack


def _meetings(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int) -> DataFrame:
    """Every block of anchors beside every block of rows, dealt over a grid of cells of bounded size.

    A block of rows is copied once for each group of anchor blocks, and the other way round.
    """
    across, down = row_blocks // MEET + 1, anchor_blocks // MEET + 1
    group = lambda n: F.pmod(F.xxhash64("part", F.xxhash64("ids")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = rows.select(group(across).alias("across"), every(down).alias("down"), "ids", "labels", "vectors")
    two = anchors.select(every(across).alias("across"), group(down).alias("down"), *[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    return one.join(two, ["across", "down"]).select(*[f"a_{c}" for c in anchors.columns], "ids", "labels", "vectors")


def _scored(k: int, least: int, limited: bool):
    """(anchor, slot, score, vec_id): the best of each slot among the blocks of a task."""

    def score(rows: Iterable[tuple]) -> Iterator[tuple]:
        held: dict[tuple, tuple] = {}
        for part, ids, labels, vectors, *rest in rows:
            own = part, ids[:64], len(ids)
            if own not in held:
                if len(held) > 2 * MEET:  # what is best so far is all that counts: later parts merge
                    yield from _told(held)
                    held.clear()
                anchors = Rows.unpacked(ids, labels, vectors)
                limits = np.frombuffer(rest[0], "<i8").reshape(len(anchors.ids), -1) if limited else None
                held[own] = anchors, limits, Best.none(k)
            anchors, limits, best = held[own]
            choose(best, Rows.unpacked(*rest[-3:]), anchors, limits, least)
        yield from _told(held)

    return score


def _told(held: dict[tuple, tuple]) -> Iterator[tuple]:
    for anchors, limits, best in held.values():
        width = 1 if limits is None else limits.shape[1]
        yield from zip(
            anchors.ids[best.slot // width].tolist(), (best.slot % width).tolist(), best.score.tolist(), best.vec_id.tolist(), strict=True
        )


def _limited(width: int, scale: int, positives: int):
    """Anchor blocks with the descending scores of their positives, the last repeated."""
    pack = _packed(width, scale)

    def packed(rows: Iterable[tuple]) -> Iterator[tuple]:
        most = max(1, BLOCK_BYTES // (4 * max(width, 1)))
        held: list[tuple] = []

        def block() -> tuple:
            limits = np.array([(r[3] + [r[3][-1]] * positives)[:positives] for r in held], "<i8")
            return *next(iter(pack([r[:3] for r in held]))), limits.tobytes()

        for row in rows:
            held.append(row)
            if len(held) == most:
                yield block()
                held = []
        if held:
            yield block()

    return packed


def mine_negatives(
    rows: DataFrame, asks: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, scale: int = SCALE
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``rows`` (vec_id, embedding, label).

    Anchors are the rows that ``asks`` admits. A score is the inner product with the anchor of the integers
    ``floor(scale * x)``; higher comes first, ties by smaller vec_id. An anchor's positives are its first other rows of
    the same label; for each of them the first rows of other labels are returned whose score is at most the positive's
    and at least ``least`` per cent of it (so none for a negative score, where the per cent lie above).

    1. Rows and anchors are packed in blocks that meet in a grid of cells; a task keeps the best few of each anchor.
    2. The positives' scores are upper limits that cut an anchor's scores into disjoint slots. In a second pass over
       the grid each task keeps the best rows per slot, and those of all tasks are merged.
    3. The best rows below a limit are the merger of the slots from there on down; the lower limit cuts it.

    A row takes part if its label, its id and all components of its vector are there and finite. Vectors shorter than
    the longest are filled up with zeros; integers beyond 2**24 count as that. Rows that repeat an id are rows of their
    own, but not partners of each other; of those that are anchors the first by label, then vector, is one. Equal
    limits make an empty slot. Anchors without positives or positives without negatives have no rows. An empty table
    gives an empty result.
    """
    table = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"),
    )
    table = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")))
    width = table.agg(F.max(F.size("vector"))).first()[0] or 0
    asking = table.where("asks").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("of"))
    asking = materialize(asking.select("vec_id", "of.label", "of.vector"), "anchors")
    weight = lambda r: sum(map(len, r[1:]))
    packed = lambda df: map_rows(df.select("vec_id", "label", "vector"), _packed(width, scale), _PACKED, _PACKED_DDL, weight)
    blocks = materialize(packed(table), "row-blocks")
    anchors = materialize(packed(asking), "anchor-blocks")
    row_blocks = blocks.count()
    schema = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])
    ddl = "anchor_id long, slot long, score long, vec_id long"


    def searched(asked: DataFrame, k: int, limited: bool) -> DataFrame:
        score = _scored(k, least, limited)
        cells = _meetings(blocks, asked, row_blocks, asked.count())
        return cells.mapInArrow(lambda batches: emit(schema, score(rows_of(batches, 1))), ddl)

    near = searched(anchors, positives, False)
    place = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    near = near.withColumn("place", place).where(F.col("place") <= positives)
    chosen = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "score", "vec_id"))).alias("positives"))
    chosen = materialize(chosen, "positives")

    limited = asking.join(chosen, asking["vec_id"] == chosen["anchor_id"]).select(
        "vec_id", "label", "vector", F.col("positives.score").alias("limits")
    )
    with_limits = pa.schema([*_PACKED, ("limits", pa.binary())])
    anchors = materialize(
        map_rows(limited, _limited(width, scale, positives), with_limits, f"{_PACKED_DDL}, limits binary", weight), "limited-blocks"
    )
    below = searched(anchors, negatives, True)
    place = F.row_number().over(W.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    below = below.withColumn("place", place).where(F.col("place") <= negatives)
    slots = below.groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("slot", "place", "score", "vec_id"))).alias("below")
    )
    windows = chosen.select("anchor_id", F.explode("positives").alias("positive"))
    windows = windows.select("anchor_id", F.col("positive.vec_id").alias("positive_id"), F.col("positive.score").alias("positive_score"))
    # Slots ascend as scores descend: those within the limits come in order.
    inside = F.filter("below", lambda x: (x["score"] <= F.col("positive_score")) & (100 * x["score"] >= least * F.col("positive_score")))
    found = windows.join(slots, "anchor_id").select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(inside, 1, negatives)).alias("at", "negative")
    )
    return found.select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("negative.vec_id").alias("negative_id"),
        "positive_score", F.col("negative.score").alias("negative_score"),
    )
