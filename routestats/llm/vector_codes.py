"""Vector codes of one byte a part, learned and assigned through dictionaries of each dimension's values."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routestats.llm.arrow import map_rows, rows_of
from routestats.operators.scale import join_sized
from routestats.session import materialize

#: Integer steps in one unit of a component, parts of a vector, entries of a part's codebook, rounds of learning.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Integers are held within this size, so that no distance of up to 8192 components leaves 64 bits.
LARGEST = 1 << 24
#: Bytes of the integers of one block, rows of a block whose distances are held at a time.
BLOCK_BYTES, CHUNK_ROWS = 4 << 20, 512


@dataclass(frozen=True)
class Codebooks:
    """The entries (dimension, entry) of all parts; vectors of ``width`` components are cut into ``parts``."""

    entries: np.ndarray
    parts: int

    @property
    def width(self) -> int:
        return len(self.entries)

    def part(self, p: int) -> slice:
        size = self.width // self.parts
        return slice(p * size, (p + 1) * size)

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, as decimal numbers joined by commas."""
        numbers = [x for p in range(self.parts) for x in self.entries[self.part(p)].T.ravel().tolist()]
        return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


@dataclass(frozen=True)
class Block:
    """Vectors as places in one sorted dictionary of integers per dimension."""

    values: list[np.ndarray]  # of each dimension
    places: np.ndarray  # (dimension, row)

    @classmethod
    def of(cls, numbers: np.ndarray) -> Block:
        """From integers (row, dimension)."""
        found = [np.unique(column, return_inverse=True) for column in numbers.T]
        return cls([v for v, _ in found], np.array([at for _, at in found]).reshape(numbers.shape[::-1]).astype(np.uint32))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        small = self.places.astype("<u2") if self.places.shape[1] <= 1 << 16 else self.places
        return np.concatenate([[], *self.values]).astype("<i4").tobytes(), np.array([len(v) for v in self.values], "<i4").tobytes(), small.tobytes()

    @classmethod
    def unpacked(cls, rows: int, values: bytes, sizes: bytes, places: bytes) -> Block:
        ends = np.cumsum(np.frombuffer(sizes, "<i4"))
        small = np.frombuffer(places, "<u2" if rows <= 1 << 16 else "<u4")
        split = np.split(np.frombuffer(values, "<i4").astype(np.int64), ends)[: len(ends)]
        return cls(split, small.reshape(len(ends), rows))

    def nearest(self, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
        """(row, part): the nearest entry, ties to the lower, and its squared distance.

        Every dimension has a table (its distinct integer, entry) of squared differences; a row's distances to all
        entries of a part are the sum of one table line for each dimension.
        """
        rows = self.places.shape[1]
        code, apart = np.zeros((rows, books.parts), np.int64), np.zeros((rows, books.parts), np.int64)
        for p in range(books.parts):
            dims = range(*books.part(p).indices(books.width))
            if not len(dims):
                continue
            tables = [(self.values[d][:, None] - books.entries[d][None, :]) ** 2 for d in dims]
            narrow = sum(int(t.max()) for t in tables) < 1 << 31
            tables = [t.astype(np.int32 if narrow else np.int64) for t in tables]
            for low in range(0, rows, CHUNK_ROWS):
                total = tables[0][self.places[dims[0], low : low + CHUNK_ROWS]]
                line = np.empty_like(total)
                for d, table in zip(dims[1:], tables[1:], strict=True):
                    np.take(table, self.places[d, low : low + CHUNK_ROWS], axis=0, out=line)
                    total += line
                best = total.argmin(axis=1)
                code[low : low + CHUNK_ROWS, p] = best
                apart[low : low + CHUNK_ROWS, p] = total[np.arange(len(best)), best]
        return code, apart

    def sums(self, code: np.ndarray, books: Codebooks) -> np.ndarray:
        """(dimension, entry): the sum of the integers coded by the entry; the last rows count each part's vectors."""
        entries = books.entries.shape[1]
        out = np.zeros((books.width + books.parts, entries), np.int64)
        for p in range(books.parts):
            for d in range(*books.part(p).indices(books.width)):
                out[d] = np.bincount(code[:, p], self.values[d][self.places[d]], entries)  # exact below 2**53
            out[books.width + p] = np.bincount(code[:, p], minlength=entries)
        return out


def integers(vectors: list[list[float]], width: int, scale: int) -> np.ndarray:
    """floor(scale * x), held within LARGEST; missing places at the end are 0."""
    out = np.zeros((len(vectors), width))
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return np.clip(np.floor(out * scale), -LARGEST, LARGEST).astype(np.int64)


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


_BLOCKS = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("n", pa.int64()),
                     ("value", pa.binary()), ("size", pa.binary()), ("place", pa.binary())])
_BLOCKS_DDL = "ids array<long>, labels array<long>, n long, value binary, size binary, place binary"


def _blocks(width: int, scale: int):
    most = max(1, min(BLOCK_BYTES // (8 * max(width, 1)), 1 << 16))

    def cut(rows: Iterable[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []

        def block() -> tuple:
            ids, labels, vectors = (list(c) for c in zip(*held, strict=True))
            return ids, labels, len(ids), *Block.of(integers(vectors, width, scale)).packed()

        for row in rows:
            held.append(row)
            if len(held) == most:
                yield block()
                held = []
        if held:
            yield block()

    return cut


def _partial_sums(books: Codebooks):
    """One round's sums of a partition as (cell, total), cells numbered by dimension and entry."""

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((books.width + books.parts, books.entries.shape[1]), np.int64)
        for packed in rows_of(batches, 1):
            block = Block.unpacked(*packed)
            total += block.sums(block.nearest(books)[0], books)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], names=["cell", "total"])

    return added


def learned(blocks: DataFrame, books: Codebooks, rounds: int) -> Codebooks:
    """Codebooks after so many rounds: assign every vector, replace each used entry by the floors of its means.

    The driver sees one total for each dimension and entry.
    """
    packed = blocks.select("n", "value", "size", "place")
    for _ in range(rounds):
        sums = packed.mapInArrow(_partial_sums(books), "cell long, total long").groupBy("cell").agg(F.sum("total").alias("total"))
        sums = sums.toArrow()
        total = np.zeros((books.width + books.parts, books.entries.shape[1]), np.int64)
        total.ravel()[sums["cell"].to_numpy()] = sums["total"].to_numpy()
        count = np.repeat(total[books.width :], books.width // books.parts, axis=0)
        means = total[: books.width] // np.maximum(count, 1)
        books = Codebooks(np.where(count > 0, means, books.entries), books.parts)
    return books


def compress(
    vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks]:
    """Rows (vec_id, label, code, error) for ``vectors`` (vec_id, embedding, label; others ignored), and the codebooks.

    Components become integers ``floor(scale * x)``, a vector is cut into ``parts`` equal parts, and ``code`` (binary)
    has for each part the index of the nearest entry of its codebook by squared distance, ties to the lower index;
    ``error`` is the sum of these distances. Codebooks start as the ``entries`` (at most 256) vectors of smallest
    vec_id, with null ids last and ties in the order of the vectors, and are learned in so many rounds over all.

    1. Vectors are packed in blocks of bounded size: for each dimension a dictionary of the block's distinct integers,
       and every component as its place there. The blocks are written once.
    2. Each round tabulates the squared differences of the distinct integers to all entries; distances are gathered
       table lines added up. Tasks return one sum per dimension and entry.

    Null vectors and those with null or non-finite components are left out; zero vectors and repeated rows count.
    Vectors shorter than the longest are filled up with zeros, as is a length that the parts don't divide. Integers
    beyond 2**24 count as that. Vectors without components have code 0 and no error. An empty table gives an empty
    result and codebooks without entries.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    ).where(finite(F.col("vector")))
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    width = -(-(longest or 0) // parts) * parts
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    books = Codebooks(integers([r[0] for r in first], width, scale).T, parts)
    packed = rows.select("vec_id", "label", "vector")
    blocks = map_rows(packed, _blocks(width, scale), _BLOCKS, _BLOCKS_DDL, lambda r: 16 * r[2] + sum(map(len, r[3:])))
    blocks = materialize(blocks, "value-blocks")
    if longest is not None:
        books = learned(blocks, books, rounds)

    def coded(rows: Iterable[tuple]) -> Iterator[tuple]:
        for ids, labels, *packed in rows:
            code, apart = Block.unpacked(*packed).nearest(books) if width else [np.zeros((len(ids), parts), np.int64)] * 2
            small = code.astype(np.uint8)
            for row in zip(ids, labels, (c.tobytes() for c in small), apart.sum(axis=1).tolist(), strict=True):
                yield row

    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.binary()), ("error", pa.int64())])
    return map_rows(blocks, coded, schema, "vec_id long, label long, code binary, error long"), books


def code_report(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the vectors that ``compress`` keeps.

    ``code`` in hex digits; ``label_error`` is the error summed over the rows of equal labels, nulls together.
    """
    codes, books = compress(vectors)
    codes = materialize(codes, "codes").withColumn("_no_label", F.col("label").isNull())
    codes = codes.withColumn("label", F.coalesce("label", F.lit(0).cast("long")))
    keys = ["_no_label", "label"]
    totals = codes.groupBy(*keys).agg(F.sum("error").alias("label_error"))
    return join_sized(codes, totals, keys).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )
