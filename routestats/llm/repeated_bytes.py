"""Removal of byte strings that occur more than once, found by sorting the suffixes of shards of text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routestats.llm.arrow import emit, map_rows, rows_of
from routestats.llm.suffix_order import QUEUE_RECORDS, Needs, Scratch, suffix_order
from routestats.llm.words import mix, seeds
from routestats.session import materialize

#: Bytes of a repeated string.
LENGTH = 400
#: Bytes of the strings by which stretches of text meet; the next one for keys that more than HOT_STRETCHES share.
GRAMS, HOT_STRETCHES = (64, 240, LENGTH), 4096
#: Bytes up to which adjacent stretches that have a key for themselves are sorted as one.
JOINED_BYTES = 1 << 16
#: Bytes that one shard sorts, on average; bytes of a text hashed at a time.
SHARD_BYTES, CHUNK_BYTES = 2 << 20, 1 << 19

_PLACE_BITS = 20
_BYTE = seeds(51, 256)
_BASE = int(seeds(53, 1)[0]) | 1
_UP, _DOWN = (
    np.multiply.accumulate(np.r_[np.uint64(1), np.full(CHUNK_BYTES + 2 * LENGTH, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64))
)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def stretches(data: np.ndarray, gram: int, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, size, key, digest, recurs) of stretches whose windows are all windows of ``data``.

    A window's key is the smallest hash of ``gram`` bytes in it, and adjacent windows of one key are a stretch, so
    equal windows lie in stretches of one key. ``recurs``: the key's string begins at several places of the stretch.
    """
    for low in range(0, len(data) - length + 1, CHUNK_BYTES):
        part = data[low : low + CHUNK_BYTES + length - 1]
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[part] * _UP[: len(part)], dtype=np.uint64)))
        hashed = mix((sums[gram:] - sums[:-gram]) * _DOWN[: len(part) - gram + 1])
        place = np.arange(len(hashed), dtype=np.uint64)
        least = _least((hashed >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | place, length - gram + 1)
        key, place = least >> np.uint64(_PLACE_BITS), least & np.uint64((1 << _PLACE_BITS) - 1)
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        end = np.r_[start[1:], len(key)] + length - 1
        digest = mix((sums[end] - sums[start]) * _DOWN[start] + (end - start).astype(np.uint64))
        last = np.r_[start[1:], len(key)] - 1
        yield start + low, end - start, key[start].view(np.int64), digest.view(np.int64), place[start] != place[last]


_FOUND = "a long, b long, doc_id long, copies long, start long, size long, key long, digest long, recurs boolean"


def _cut(gram: int, length: int):
    """Batches of all stretches of the texts (a, b, doc_id, copies, packed)."""
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, held, count = zstandard.ZstdDecompressor(), [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], names=names)

        for *owner, packed in rows_of(batches, 64):
            for found in stretches(np.frombuffer(unpack.decompress(packed), np.uint8), gram, length):
                own = [pa.repeat(pa.scalar(x, pa.int64()), len(found[0])) for x in owner]
                held.append((*own, *(pa.array(c) for c in found)))
                count += len(found[0])
                if count >= 1 << 16:
                    yield batch()
                    held, count = [], 0
        if held:
            yield batch()

    return cut


def _taken(length: int):
    """(key, packed, sizes, keys, digests, copies) of the wanted stretches of each text.

    Adjacent stretches share all bytes but a window's. Those that have their keys alone meet no others, so they can
    stay together: one piece of text with several stretches.
    """

    def take(rows: Iterable[tuple]) -> Iterator[tuple]:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for packed, wanted in rows:
            data = unpack.decompress(packed)
            held: list[dict] = []

            def piece() -> tuple:
                low, high = held[0]["start"], held[-1]["start"] + held[-1]["size"]
                return held[0]["key"], pack.compress(data[low:high]), *([w[c] for w in held] for c in ("size", "key", "digest", "copies"))

            for w in sorted(wanted, key=lambda w: w["start"]):
                if held:
                    end = held[-1]["start"] + held[-1]["size"]
                    joined = held[-1]["alone"] and w["alone"] and w["start"] == end - length + 1
                    if not joined or w["start"] + w["size"] - held[0]["start"] > JOINED_BYTES:
                        yield piece()
                        held = []
                held.append(w)
            if held:
                yield piece()

    return take


def sorted_shard(rows: Iterable[tuple], length: int = LENGTH, limit: int = QUEUE_RECORDS) -> Iterator[tuple]:
    """(key, digest, starts, ends) of the windows in each stretch that also begin elsewhere.

    Rows are pieces of text (packed, sizes, keys, digests, copies) with their stretches; a piece that comes again is
    passed over. All pieces are one text, with a symbol of its own after each. Windows of a stretch that has copies
    recur with it; of the others those whose suffix shares ``length`` bytes with a neighbour in order.
    """
    unpack = zstandard.ZstdDecompressor()
    with Scratch() as scratch:
        path, pieces, total, seen = scratch.path(), [], 0, set()
        with open(path, "wb") as file:
            for packed, *stretches in rows:
                name = stretches[1][0], stretches[2][0]
                if name not in seen:
                    seen.add(name)
                    data = unpack.decompress(packed)
                    file.write(data)
                    pieces.append((len(data), stretches))
                    total += len(data)
        del seen
        if not pieces:
            return
        plain = np.memmap(path, np.uint8, "r")
        text = scratch.array(total + len(pieces), np.int32)
        at = 0
        for i, (size, _) in enumerate(pieces):
            text[at + i : at + i + size] = plain[at : at + size]
            text[at + i : at + i + size] += len(pieces)
            text[at + i + size] = i
            at += size
        again = scratch.array(len(text), np.uint8)
        before = -1

        def tell(pos: np.ndarray, lcp: np.ndarray) -> None:
            nonlocal before
            near = lcp >= length
            again[pos[near]] = 1
            again[np.concatenate(([before], pos[:-1]))[near]] = 1
            before = int(pos[-1])

        suffix_order(text, 256 + len(pieces), length, tell, scratch, limit, Needs(length))
        at = 0
        for piece_size, stretches in pieces:
            low = at
            for size, key, digest, copies in zip(*stretches, strict=True):
                windows = size - length + 1
                marked = again[low : low + windows] if copies < 2 else np.ones(windows, np.uint8)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], marked, [0])).astype(np.int8)))
                if len(edge):
                    yield key, digest, edge[0::2].tolist(), edge[1::2].tolist()
                low += windows
            at += piece_size + 1


_MARKS = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
_MARKS_DDL = "key long, digest long, starts array<long>, ends array<long>"


def recurring(texts: DataFrame, length: int = LENGTH, level: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(a, b, low, high), one row each, for texts (a, b: digest; doc_id; copies; packed): windows from low to below
    high recur.

    ``copies`` counts the places where the row's text occurs. Stretches of equal bytes are one class; classes whose
    key has one member that occurs once are nobody's equal and go no further.
    """
    found = materialize(texts.select("a", "b", "doc_id", "copies", "packed").mapInArrow(_cut(GRAMS[level], length), _FOUND), "stretches")
    keys = found.groupBy("key").agg(
        F.sum("copies").alias("met"), F.max("recurs").alias("any"), F.count("*").alias("n"),
        (F.min("digest") == F.max("digest")).alias("alone"),
    ).where("met > 1 or any")
    keys = materialize(keys.select("key", "alone", (~F.col("alone") & (F.col("n") > HOT_STRETCHES)).alias("hot")), "keys")
    met = materialize(found.join(keys, "key"), "met")
    wanted = materialize(met.groupBy("key", "digest").agg(
        F.sum("copies").alias("copies"), F.min(F.struct("a", "b", "doc_id", "start")).alias("at"),
        F.first("size").alias("size"), F.first("hot").alias("hot"), F.first("alone").alias("alone"),
    ).select("key", "digest", "copies", "size", "hot", "alone", "at.*"), "wanted")
    many = pa.list_(pa.int64())
    schema = pa.schema([("key", pa.int64()), ("packed", pa.binary()), ("size", many), ("keys", many), ("digests", many), ("copies", many)])
    take = _taken(length)

    def contents(of: DataFrame) -> DataFrame:
        """Each text is read once for all that is wanted of it."""
        cells = F.struct("key", "digest", "copies", "start", "size", "alone")
        lists = materialize(of.groupBy("a", "b", "doc_id").agg(F.collect_list(cells).alias("wanted")), "lists")
        same = (texts["a"] == lists["a"]) & (texts["b"] == lists["b"]) & texts["doc_id"].eqNullSafe(lists["doc_id"])
        rows = texts.join(lists, same).select("packed", "wanted")
        function = lambda batches: emit(schema, take(rows_of(batches, 16)), lambda r: len(r[1]))
        return rows.mapInArrow(function, "key long, packed binary, size array<long>, keys array<long>, digests array<long>, copies array<long>")

    last = level == len(GRAMS) - 1
    plain = wanted if last else wanted.where("not hot")
    total = plain.agg(F.sum("size")).first()[0] or 0
    dealt = contents(plain).repartition(total // shard_bytes + 1, "key").select("packed", "size", "keys", "digests", "copies")
    marks = map_rows(dealt, lambda rows: sorted_shard(rows, length), _MARKS, _MARKS_DDL, lambda r: 16 * len(r[2]))
    marks = marks.select("key", "digest", F.explode(F.arrays_zip("starts", "ends")).alias("of"))
    marks = materialize(marks.select("key", "digest", F.col("of.starts").alias("low"), F.col("of.ends").alias("high")), "marks")
    if not last and wanted.where("hot").take(1):
        first = lambda c: F.col(c)[0]  # noqa: E731  (a hot key has no stretch alone: pieces of one)
        hot = contents(wanted.where("hot")).select(
            first("keys").alias("a"), first("digests").alias("b"), F.lit(0).cast("long").alias("doc_id"),
            first("copies").alias("copies"), "packed",
        )
        hot = materialize(hot.dropDuplicates(["a", "b"]), "hot")
        deeper = recurring(hot, length, level + 1, shard_bytes)
        deeper = deeper.select(F.col("a").alias("key"), F.col("b").alias("digest"), "low", "high")
        marks = materialize(marks.unionByName(deeper), "all-marks")
    # Copies of a text are one from here on. Plain shuffles of written tables: a stretch of many texts can be split.
    owners = materialize(met.select("a", "b", "start", "key", "digest").distinct(), "owners")
    placed = owners.join(marks, ["key", "digest"])
    return placed.select("a", "b", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))


def _profile(rows: Iterable[tuple]) -> Iterator[tuple]:
    pack = zstandard.ZstdCompressor(level=1)
    for doc_id, text in rows:
        data = (text or "").encode("utf-8", "surrogatepass")
        sha = hashlib.sha256(data)
        a, b = np.frombuffer(sha.digest()[:16], "<i8").tolist()
        yield doc_id, len(data), a, b, sha.hexdigest(), pack.compress(data)


def _removed(length: int):
    """Of each row (doc_id, n_bytes, whole, packed, low, high) the bytes outside all windows that recur."""

    def remove(rows: Iterable[tuple]) -> Iterator[tuple]:
        unpack = zstandard.ZstdDecompressor()
        for doc_id, size, whole, packed, low, high in rows:
            if not low:
                yield doc_id, size, 0, 0, whole
                continue
            data, gone = unpack.decompress(packed), []
            for start, end in sorted(zip(low, high, strict=True)):
                if gone and start <= gone[-1][1]:
                    gone[-1][1] = max(end + length - 1, gone[-1][1])
                else:
                    gone.append([start, end + length - 1])
            kept, at = hashlib.sha256(), 0
            for start, end in gone:
                kept.update(data[at:start])
                at = end
            kept.update(data[at:])
            yield doc_id, size, sum(end - start for start, end in gone), len(gone), kept.hexdigest()

    return remove


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs`` (doc_id, text; others ignored).

    A byte of a text's UTF-8 form goes if it lies in a string of ``length`` bytes that also begins elsewhere, in this
    text or another; strings don't cross texts and are judged on the input. ``n_spans`` counts maximal removed runs.

    1. Each window of ``length`` bytes has a key, the smallest hash of some bytes in it; windows of a key that occurs
       once recur nowhere. Texts are cut into stretches of windows of one key.
    2. Stretches under the other keys are classes of equal bytes; one member of each is cut out of its text.
    3. Keys are dealt to shards of about ``shard_bytes``; the suffixes of a shard are put in order with their common
       prefixes by external induced sorting. A key that very many different stretches share is cut by longer strings
       first, up to the windows themselves, so no key can overfill a shard.
    4. The windows found are placed in all texts that hold their stretch, and bytes under them go.

    Null, empty and short texts lose nothing. Rows that repeat a text or a row lose everything from ``length`` bytes
    on, whatever their doc_id, null too. Very long texts are hashed in pieces and sorted with what they share only.
    An empty table gives an empty result. Texts are told apart by 128 bits of digest, stretches by 108.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("a", pa.int64()), ("b", pa.int64()),
                        ("whole", pa.string()), ("packed", pa.binary())])
    ddl = "doc_id long, n_bytes long, a long, b long, whole string, packed binary"
    profiles = map_rows(docs, _profile, schema, ddl, lambda r: 200 + len(r[5]))
    texts = profiles.where(F.col("n_bytes") >= length).withColumn("copies", F.lit(1).cast("long"))
    ranges = recurring(texts, length, 0, shard_bytes).groupBy("a", "b")
    ranges = materialize(ranges.agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high")), "ranges")
    held = profiles.join(ranges, ["a", "b"], "left").select("doc_id", "n_bytes", "whole", "packed", "low", "high")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string())])
    return map_rows(held, _removed(length), schema, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
