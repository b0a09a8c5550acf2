"""Improbable-feature digests: rare byte windows in chained Bloom filters, compared by their overlap."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routestats.llm.arrow import emit, rows_of
from routestats.llm.words import mix, seeds

#: Bytes of a feature, and the neighbouring windows among which the rarest one gains a point.
FEATURE_BYTES, NEIGHBOURS = 64, 64
#: Points from which a window is selected.
POPULAR = 16
#: Bits and features of one filter, bits set by a feature.
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: Classes of entropy; their frequencies over the corpus are the rarity table.
CLASSES = 1024
#: Bytes worked on at a time: short texts share a buffer, a longer one is taken in overlapping pieces of this size.
BUFFER_BYTES = 1 << 18
#: Rows that stand together when documents are compared with the next one, and the most such groups.
GROUP_ROWS, GROUPS = 500, 100_000

_UNIT = 1 << 20
_N = np.arange(FEATURE_BYTES + 1, dtype=np.float64)
#: Gain of sum(c * log2(c)) when a byte's count in the window reaches c, in fixed-point units so that sums are exact.
_GAIN = np.r_[0, np.round(np.diff(np.where(_N > 0, _N * np.log2(np.maximum(_N, 1)), 0)) * _UNIT)].astype(np.int64)
_FULL = int(_GAIN.sum())
_CODE = seeds(31, 256)
_BASE = int(seeds(32, 1)[0]) | 1


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(count, _BASE, np.uint64), np.full(count, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(BUFFER_BYTES + 2 * (FEATURE_BYTES + NEIGHBOURS))


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """The entropy class (0 to CLASSES - 1) of every FEATURE_BYTES window of ``data`` (uint8).

    The entropy of a window falls with the sum of c * log2(c) over the counts c of its bytes. Moving on by a byte
    changes two counts, which are known from how often the byte occurs just before or after itself.
    """
    n = len(data) - FEATURE_BYTES + 1
    before, after = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)
    for step in range(1, FEATURE_BYTES):
        same = (data[step:] == data[:-step]).view(np.uint8)
        before[step:] += same
        after[:-step] += same
    moved = np.empty(n, np.int64)
    moved[0] = _GAIN[np.minimum(before[:FEATURE_BYTES], np.arange(1, FEATURE_BYTES + 1))].sum()
    moved[1:] = _GAIN[before[FEATURE_BYTES:]] - _GAIN[after[: n - 1]]
    return ((_FULL - np.cumsum(moved)) * (CLASSES - 1) // _FULL).astype(np.int64)


def _rarest(rank: np.ndarray) -> np.ndarray:
    """For every run of NEIGHBOURS windows the key of its rarest: rank, then place."""
    key = (rank << 32) | np.arange(len(rank))
    rows = -(-len(key) // NEIGHBOURS) + 1
    padded = np.full(rows * NEIGHBOURS, np.iinfo(np.int64).max)
    padded[: len(key)] = key
    block = padded.reshape(rows, NEIGHBOURS)
    forward = np.minimum.accumulate(block, axis=1).ravel()
    backward = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: len(key)], forward[NEIGHBOURS - 1 : NEIGHBOURS - 1 + len(key)])


_NONE = 1 << 30


def _selected(data: np.ndarray, valid: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the selected windows; only ``valid`` windows take part.

    A run of neighbours also counts where it overhangs the ends of a text: NEIGHBOURS places without a window lie
    before and after, so runs of different texts never touch.
    """
    rank = np.full(len(valid) + NEIGHBOURS - 1, _NONE, np.int64)
    rank[NEIGHBOURS - 1 :] = np.where(valid, ranks[entropy_classes(data)], _NONE)
    best = _rarest(rank)
    best = best[best < (_NONE << 32)] & 0xFFFFFFFF
    places, points = np.unique(best, return_counts=True)
    at = places[points >= POPULAR] - (NEIGHBOURS - 1)
    sums = np.r_[np.uint64(0), np.cumsum(_CODE[data] * _UP[: len(data)], dtype=np.uint64)]
    return at, mix((sums[at + FEATURE_BYTES] - sums[at]) * _DOWN[at])


def _bytes(text: str | None) -> np.ndarray:
    """The UTF-8 bytes; a text too short for one window is filled up with zeros."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return np.r_[data, np.zeros(FEATURE_BYTES - len(data), np.uint8)] if 0 < len(data) < FEATURE_BYTES else data


def features(texts: list[str | None], ranks: np.ndarray) -> list[np.ndarray]:
    """The hashes of the selected windows of each text, in order of place."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    pending: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if not pending:
            return
        data = np.concatenate([d for _, d in pending])
        valid = np.ones(len(data) - FEATURE_BYTES + 1, bool)
        ends = np.cumsum([len(d) for _, d in pending])
        for end in ends[:-1]:
            valid[end - FEATURE_BYTES + 1 : end] = False
        at, hashes = _selected(data, valid, ranks)
        for (i, _), low, high in zip(pending, np.r_[0, ends[:-1]], ends, strict=True):
            found[i].append(hashes[np.searchsorted(at, low) : np.searchsorted(at, high)])
        pending.clear()

    size = 0
    for i, text in enumerate(texts):
        data = _bytes(text)
        if len(data) > BUFFER_BYTES:
            flush()
            size = 0
            _pieces(data, ranks, found[i])
        elif len(data):
            if size + len(data) > BUFFER_BYTES:
                flush()
                size = 0
            pending.append((i, data))
            size += len(data)
    flush()
    return [np.concatenate(f) if f else np.empty(0, np.uint64) for f in found]


def _pieces(data: np.ndarray, ranks: np.ndarray, found: list[np.ndarray]) -> None:
    """A long text in pieces: each sees NEIGHBOURS windows more on both sides, so every choice is as in the whole."""
    windows, step, side = len(data) - FEATURE_BYTES + 1, BUFFER_BYTES - 2 * NEIGHBOURS, NEIGHBOURS
    for low in range(0, windows, step):
        high = min(low + step, windows)
        start, stop = max(0, low - side), min(windows, high + side)
        part = data[start : stop + FEATURE_BYTES - 1]
        at, hashes = _selected(part, np.ones(stop - start, bool), ranks)
        own = (at + start >= low) & (at + start < high)
        found.append(hashes[own])


def digest(hashes: np.ndarray) -> str:
    """Chained Bloom filters in base64: per filter two bytes with its number of features, then its bits.

    A feature counts where it first occurs; a filter that holds FILTER_FEATURES is followed by the next one. No
    features give the empty string.
    """
    distinct = hashes[np.sort(np.unique(hashes, return_index=True)[1])]
    width = np.uint64(FILTER_BITS.bit_length() - 1)
    places = (distinct[:, None] >> (np.arange(HASHES, dtype=np.uint64) * width)) & np.uint64(FILTER_BITS - 1)
    out = []
    for at in range(0, len(places), FILTER_FEATURES):
        part, bits = places[at : at + FILTER_FEATURES], np.zeros(FILTER_BITS, np.uint8)
        bits[part] = 1
        out.append(len(part).to_bytes(2, "big") + np.packbits(bits).tobytes())
    return base64.b64encode(b"".join(out)).decode()


def _filters(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 2 + FILTER_BITS // 8)
    return raw[:, 0].astype(np.int64) * 256 + raw[:, 1], np.unpackbits(raw[:, 2:], axis=1).astype(np.float32)


def likeness(one: str, two: str) -> float:
    """How much of the smaller digest the other holds, from 0 (as by chance) to 1; 1 for equal digests, 0 for one empty.

    Each filter of the digest with fewer features takes the best overlap with a filter of the other: common bits
    above the number expected by chance, as a share of the most that could be. Filters weigh by their features.
    """
    if one == two:
        return 1.0
    if not one or not two:
        return 0.0
    (n, a), (m, b) = _filters(one), _filters(two)
    if (m.sum(), two) < (n.sum(), one):
        (n, a), (m, b) = (m, b), (n, a)
    set_a, set_b = a.sum(axis=1)[:, None], b.sum(axis=1)[None, :]
    most, chance = np.minimum(set_a, set_b), set_a * set_b / FILTER_BITS
    share = np.clip((a @ b.T - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    return float((share.max(axis=1) * n).sum() / n.sum())


def _class_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES, np.int64)
    for (text,) in rows_of(batches):
        data = _bytes(text)
        for low in range(0, len(data) - FEATURE_BYTES + 1, BUFFER_BYTES):
            total += np.bincount(entropy_classes(data[low : low + BUFFER_BYTES + FEATURE_BYTES - 1]), minlength=CLASSES)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["class", "n"])


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy class, 0 for the one with the fewest windows over all of ``docs`` (text).

    Classes without windows come last, ties by class. Only the CLASSES counts reach the driver.
    """
    counted = docs.select(F.col("text").cast("string")).mapInArrow(_class_counts, "class long, n long")
    count = np.zeros(CLASSES, np.int64)
    for row in counted.groupBy("class").agg(F.sum("n").alias("n")).collect():
        count[row[0]] = row[1]
    order = np.lexsort((np.arange(CLASSES), np.where(count > 0, count, np.iinfo(np.int64).max)))
    ranks = np.empty(CLASSES, np.int64)
    ranks[order] = np.arange(CLASSES)
    return ranks


def fingerprint(text: Column, ranks: np.ndarray) -> Column:
    """The digest of each text as a column; null and empty texts have the empty one."""

    @F.pandas_udf("string")
    def digests(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(f) for f in features(texts.tolist(), ranks)], dtype=object)

    return digests(text.cast("string"))


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) characters replaced by as many of the next text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_EDITS = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The rows of ``docs`` (doc_id, text; others ignored) follow each other by doc_id, the first one after the last; a
    lone row follows itself. A null text is empty, a null doc_id comes first, rows that repeat a doc_id follow each
    other by text. Equal texts have equal fingerprints; two empty ones are alike (1), an empty and another are not (0).
    An empty table gives an empty result.

    Documents are dealt to groups of neighbouring ids, whose bounds are estimated quantiles; the first document of a
    group also goes to the group before, so every pair of neighbours meets and texts are shuffled once.
    """
    ranks = rarity(docs)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    groups = min(GROUPS, rows.count() // GROUP_ROWS + 1)
    shares = [i / groups for i in range(1, groups)]
    found = rows.approxQuantile("place", shares, 0.25 / groups) if shares else []
    bounds = np.unique(np.array(found, np.float64))

    @F.pandas_udf("long")
    def group_of(places: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, places.to_numpy().astype(np.float64), side="right"))

    heads = rows.select("place").withColumn("group", group_of("place")).groupBy("group").agg(F.min("place")).collect()
    heads = sorted((tuple(r) for r in heads), key=lambda r: r[0])
    if not heads:
        return docs.sparkSession.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                                 "edited_fingerprint string, near_edited double, near_next double")  # fmt: skip
    firsts = np.array([place for _, place in heads], np.int64)
    before = np.array([heads[i - 1][0] for i in range(len(heads))], np.int64)

    @F.pandas_udf("long")
    def also_in(places: pd.Series) -> pd.Series:
        """The group before, for the first place of a group; else -1."""
        values = places.to_numpy()
        at = np.minimum(np.searchsorted(firsts, values), len(firsts) - 1)
        return pd.Series(np.where(firsts[at] == values, before[at], -1))

    placed = rows.withColumn("group", group_of("place")).withColumn("also", also_in("place"))
    own = F.array(F.struct(F.col("group"), F.lit(0).alias("tail")))
    both = F.array(F.struct(F.col("group"), F.lit(0).alias("tail")), F.struct(F.col("also").alias("group"), F.lit(1).alias("tail")))
    dealt = placed.select(F.explode(F.when(F.col("also") >= 0, both).otherwise(own)).alias("to"), "doc_id", "place", "text")
    dealt = dealt.select("to.group", "to.tail", "place", "doc_id", "text").repartition("group")
    ordered = dealt.sortWithinPartitions("group", "tail", "place", "text").select("group", "tail", "doc_id", "text")

    def compared(rows: list[tuple], known: str | None) -> Iterator[tuple]:
        """All rows but the last, with the one after each; ``known`` is the first one's fingerprint if it is there."""
        texts = [text for _, text in rows]
        edits = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        prints = [digest(f) for f in features((texts[1:] if known is not None else texts) + edits, ranks)]
        if known is not None:
            prints.insert(0, known)
        for i, edit in enumerate(edits):
            own, next_, other = prints[i], prints[i + 1], prints[len(rows) + i]
            sha = hashlib.sha256(edit.encode("utf-8", "surrogatepass")).hexdigest()
            yield rows[i][0], len(texts[i]), sha, own, other, likeness(own, other), likeness(own, next_)
        return prints[len(rows) - 1]

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        held, known, group, size, ended = [], None, None, 0, False
        for own, tail, doc_id, text in rows_of(batches, 64):
            if own != group:
                if len(held) > 1:
                    yield from compared(held, known)
                held, known, group, size, ended = [], None, own, 0, False
            if ended:
                continue
            held.append((doc_id, text))
            size += len(text)
            ended = tail == 1
            if size > BUFFER_BYTES and len(held) > 1:
                known = yield from compared(held, known)
                held, size = held[-1:], len(held[-1][1])
        if len(held) > 1:
            yield from compared(held, known)

    ddl = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")  # fmt: skip
    return ordered.mapInArrow(lambda b: emit(_EDITS, stream(b), lambda r: 200 + len(r[3]) + len(r[4])), ddl)
