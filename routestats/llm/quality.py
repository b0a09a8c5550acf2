"""Quality scores learned from preference pairs (Bradley-Terry), cut at a score quantile."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial, reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routestats.llm.arrow import map_rows, rows_of
from routestats.llm.labels import held_out, training_labels
from routestats.llm.words import hashed_words, runs
from routestats.session import materialize

#: Training rows of the more frequent label in a block, on average; documents are paired within their block. Rows of the
#: other label that a block has at least, on average: a rarer label's rows stand in several blocks.
BLOCK_ROWS, LEAST_ROWS = 4000, 64
#: Bins in which utilities are counted, and rows from which on the bin with the cut is counted again.
BINS, FEW_ROWS = 4096, 20_000
#: Preferred documents that each rejected one is paired with.
PARTNERS = 16
#: Weight of the squared length of the coefficients.
RIDGE = 1e-3
#: Score at the cut: documents from here on are predicted as label 1.
CUT_SCORE = 0.7

_SETS = [b"!?", b"|", b"#$%&*", b".,;:", b"0123456789", b"{}<>[]()=/\\_~^`@+", b"\"'-"]
_UPPER = slice(65, 91)
_LETTER = np.r_[65:91, 97:123, 128:256]
FEATURES = [
    "log_words", "word_bytes", "upper", "letters", *(f"set_{i}" for i in range(len(_SETS))), "entropy", "repeated_word",
    "repeated_run", "bare_words", "marked_words", "line_words", "repeated_line",
]


def features(text: str | None) -> np.ndarray:
    """Numbers that don't depend on the language: shares of kinds of bytes, and of words and lines that repeat.

    Square roots of shares, so that a small share of unusual content already shows. Empty texts have all zeros.
    """
    out = np.zeros(len(FEATURES))
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    words, start, end = hashed_words(text)
    if not len(words):
        return out
    count = np.bincount(data, minlength=256)
    total = (end - start).sum()
    letters = count[_LETTER].sum()
    share = count[count > 0] / len(data)
    letter = np.zeros(256, bool)
    letter[_LETTER] = True
    is_letter = np.r_[0, np.cumsum(letter[data])]
    inside = is_letter[end] - is_letter[start]
    phrases = runs(words, 4)
    line = np.r_[0, np.cumsum(data == 10)][start]
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    lines = np.bitwise_xor.reduceat(words * (2 * (np.arange(len(words)) - np.repeat(first, np.diff(np.r_[first, len(words)]))) + 1).astype(np.uint64), first)
    last = data[end - 1]
    out[:4] = np.log1p(len(words)) / 5, total / len(words) / 10, np.sqrt(count[_UPPER].sum() / max(1, letters)), letters / total
    for i, chars in enumerate(_SETS):
        out[4 + i] = np.sqrt(count[list(chars)].sum() / total)
    out[4 + len(_SETS) :] = (
        -(share * np.log2(share)).sum() / 8,
        np.sqrt(np.mean(words[1:] == words[:-1])) if len(words) > 1 else 0,
        np.sqrt(1 - len(np.unique(phrases)) / len(phrases)) if len(phrases) else 0,
        np.sqrt(np.mean(inside == 0)),
        np.sqrt(np.mean(~letter[last] & (last != 46) & (last != 44))),
        np.log1p(len(words) / len(lines)) / 5,
        np.sqrt(1 - len(np.unique(lines)) / len(lines)),
    )
    return out


@dataclass(frozen=True)
class QualityModel:
    """score = sigmoid(slope * (utility - cut) + logit(CUT_SCORE)) with utility = weights . (features - mean) / scale."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def utility(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean) / self.scale) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        x = self.slope * (self.utility(rows) - self.cut) + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


#: Sums (or another merger) over blocks of what a function gives for (preferred rows, rejected rows, own preferred, own
#: rejected). A block's own rows come first; the others are copies from other blocks, which only make pairs.
Gather = Callable[..., np.ndarray]


def _sums(x: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient, then Hessian, at ``w`` of the weighted sum of log(1 + exp(-x.w))."""
    p = 1 / (1 + np.exp(np.clip(x @ w, -35, 35)))
    gradient = -(x * (weight * p)[:, None]).sum(axis=0)
    return np.concatenate([gradient, ((x * (weight * p * (1 - p))[:, None]).T @ x).ravel()])


def _newton(sums: Callable[[np.ndarray], np.ndarray], size: int, ridge: float) -> np.ndarray:
    """Coefficients that minimise a loss plus the ridge, by Newton steps; ``sums`` gives gradient and Hessian."""
    w = np.zeros(size)
    for _ in range(50):
        found = sums(w)
        gradient = found[:size] + ridge * w
        hessian = found[size:].reshape(size, size) + ridge * np.eye(size)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1, 4 / max(np.abs(step).max(), 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logistic(x: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Coefficients that minimise the mean of log(1 + exp(-x.w)) plus the ridge."""
    return _newton(lambda w: _sums(x, weight, w), x.shape[1], ridge)


def _pair_sums(mean: np.ndarray, scale: np.ndarray, w: np.ndarray, good: np.ndarray, bad: np.ndarray, *own: int) -> np.ndarray:
    """The number of a block's pairs, then their gradient and Hessian."""
    if not len(good) or not len(bad):
        return np.zeros(1 + len(w) + len(w) ** 2)
    at = np.arange(max(len(bad), len(good) // PARTNERS + 1) * PARTNERS)
    pairs = ((good - mean) / scale)[(at * 7919) % len(good)] - ((bad - mean) / scale)[at // PARTNERS % len(bad)]
    return np.append(len(pairs), _sums(pairs, np.ones(len(pairs)), w))


def _cut(gather: Gather, utility: Callable[[np.ndarray], np.ndarray], weights: tuple[float, float], share: float) -> float:
    """The exact quantile of the weighted utilities: the mean of the first at which ``share`` is reached and the next.

    Utilities are counted in bins, the bin with the quantile again in finer ones, till few rows or one value are left.
    """
    own = lambda good, bad, n, m: (utility(good[:n]), utility(bad[:m]))
    least = lambda low, *block: min(u[u >= low].min(initial=np.inf) for u in own(*block))
    low = float(gather(partial(least, -np.inf), np.minimum))
    high = np.nextafter(-float(gather(lambda *block: min((-u).min(initial=np.inf) for u in own(*block)), np.minimum)), np.inf)
    target, before = share * (1 - 1e-9), 0.0
    while True:
        edges = np.unique(np.linspace(low, high, BINS + 1))
        bins = lambda u, edges=edges: np.bincount(np.searchsorted(edges, u[(u >= edges[0]) & (u < edges[-1])], "right") - 1, minlength=len(edges) - 1)
        count = gather(lambda *block, bins=bins: np.stack([bins(u) for u in own(*block)]), np.add)
        reached = before + np.cumsum(np.array(weights) @ count)
        at = min(int(np.searchsorted(reached, target)), int(np.flatnonzero(count.any(axis=0))[-1]))
        before = reached[at - 1] if at else before
        low, high = edges[at], edges[at + 1]
        if count[:, at].sum() <= FEW_ROWS or np.nextafter(low, np.inf) >= high:
            break

    def values(*block) -> np.ndarray:
        """(value, label place, how many) of the utilities in the last bin."""
        parts = [np.unique(u[(u >= low) & (u < high)], return_counts=True) for u in own(*block)]
        return np.concatenate([np.column_stack([u, np.full(len(u), place), n]) for place, (u, n) in enumerate(parts)])

    found = gather(values, lambda x, y: np.concatenate([x, y]))
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    weight = np.array(weights)[found[:, 1].astype(int)]
    reached = before + np.cumsum(weight * found[:, 2])
    at = min(int(np.searchsorted(reached, target)), len(reached) - 1)
    first = found[at, 0]
    if found[at, 2] > 1 and reached[at] - weight[at] >= target:  # it is not the last row of its value
        return float(first)
    following = found[at + 1, 0] if at + 1 < len(found) else float(gather(partial(least, high), np.minimum))
    return float(first if np.isinf(following) else (first + following) / 2)


def _fit(gather: Gather, share_bad: float) -> QualityModel:
    """Fit on all blocks; every pass over them returns sums of bounded size."""
    total = gather(lambda good, bad, n, m: np.concatenate([[n, m], good[:n].sum(axis=0) + bad[:m].sum(axis=0)]), np.add)
    n_good, n_bad = total[:2]
    mean = total[2:] / (n_good + n_bad)
    square = lambda good, bad, n, m: ((good[:n] - mean) ** 2).sum(axis=0) + ((bad[:m] - mean) ** 2).sum(axis=0)
    scale = np.maximum(np.sqrt(gather(square, np.add) / (n_good + n_bad)), 1e-6)

    def pair_mean(w: np.ndarray) -> np.ndarray:
        found = gather(partial(_pair_sums, mean, scale, w), np.add)
        return found[1:] / max(found[0], 1)

    w = _newton(pair_mean, len(mean), RIDGE)
    utility = lambda rows: ((rows - mean) / scale) @ w
    weights = ((1 - share_bad) / n_good, share_bad / n_bad)
    cut = _cut(gather, utility, weights, share_bad)

    def spread_sums(at: np.ndarray, good: np.ndarray, bad: np.ndarray, n: int, m: int) -> np.ndarray:
        x = np.concatenate([utility(good[:n]) - cut, cut - utility(bad[:m])])
        return _sums(x[:, None], np.repeat(weights, [n, m]), at)

    spread = _newton(lambda at: gather(partial(spread_sums, at), np.add), 1, RIDGE)[0]
    return QualityModel(mean, scale, w, cut, float(max(spread, 1e-3)))


def fit_pairs(good: np.ndarray, bad: np.ndarray, share_bad: float) -> QualityModel | None:
    """Fit on feature rows of preferred and rejected documents, as one block; ``share_bad`` is the quantile to cut at.

    None if there are no pairs.
    """
    if not len(good) or not len(bad):
        return None
    return _fit(lambda part, merge: part(good, bad, len(good), len(bad)), share_bad)


_BLOCKS = pa.schema([("block", pa.int64()), ("good", pa.binary()), ("bad", pa.binary()), ("own_good", pa.int64()), ("own_bad", pa.int64())])
_BLOCKS_DDL = "block long, good binary, bad binary, own_good long, own_bad long"


def _packed(rows: Iterable[tuple]) -> Iterator[tuple]:
    """One row per block of sorted rows (block, copy, label, x)."""
    for block, held in groupby(rows, key=lambda r: r[0]):
        parts, own = ([], []), [0, 0]
        for _, copy, label, x in held:
            parts[label].append(x)
            own[label] += copy == 0
        bad, good = (np.array(part, float).tobytes() for part in parts)
        yield block, good, bad, own[1], own[0]


def training_blocks(training: DataFrame) -> DataFrame | None:
    """All rows (doc_id, label, x) in blocks by a hash of the id, one row per block; None if a label is missing."""
    count = dict(training.groupBy("label").count().collect())
    if not count.get(0) or not count.get(1):
        return None
    blocks = -(-max(count.values()) // BLOCK_ROWS)
    bad, good = (min(blocks, -(-LEAST_ROWS * blocks // count[label])) for label in (0, 1))
    copies = F.sequence(F.lit(0), F.when(F.col("label") == 1, good).otherwise(bad) - 1)
    rows = training.select("doc_id", "label", "x", F.explode(copies).alias("copy"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) + F.col("copy"))
    rows = rows.withColumn("block", (F.col("block") % blocks).cast("long")).repartition(blocks // 8 + 1, "block")
    rows = rows.sortWithinPartitions("block", "copy", "doc_id").select("block", "copy", "label", "x")
    return materialize(map_rows(rows, _packed, _BLOCKS, _BLOCKS_DDL, lambda r: len(r[1]) + len(r[2])), "blocks")


def _gather(blocks: DataFrame) -> Gather:
    """Merges in the tasks, whose results the driver merges in the order of their first blocks."""

    def gather(part: Callable[..., np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def per_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
            for block, good, bad, *own in rows_of(batches, 1):
                yield block, np.asarray(part(*(np.frombuffer(x).reshape(-1, len(FEATURES)) for x in (good, bad)), *own), float)

        def per_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, total = None, None
            for block, found in per_block(batches):
                first, total = (block, found) if first is None else (first, merge(total, found))
            if first is not None:
                yield pa.RecordBatch.from_pydict({"first": [first], "shape": [list(total.shape)], "total": [total.tobytes()]})

        parts = blocks.mapInArrow(per_task, "first long, shape array<long>, total binary").collect()
        return reduce(merge, [np.frombuffer(r.total).reshape(r.shape) for r in sorted(parts, key=lambda r: r.first)])

    return gather


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of each row of ``docs``."""

    @F.pandas_udf("array<double>")
    def numbers(column: pd.Series) -> pd.Series:
        return pd.Series([features(text) for text in column])

    return docs.select("doc_id", numbers(F.col("text").cast("string")).alias("x"))


def fit_quality(rows: DataFrame, labels: DataFrame, keep: Column, label: str = "quality") -> QualityModel | None:
    """Learn from ``rows`` (doc_id, x: features) with all rows of ``labels`` (doc_id, label 0/1) that ``keep`` admits.

    Every pass runs over all blocks of training rows; the driver sees sums only. A repeated id counts once, with its
    smallest features. None if either label is missing: nothing can be compared.
    """
    known, share = training_labels(labels, label, keep)
    training = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "x").join(known, "doc_id")
    training = training.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x"))
    blocks = training_blocks(materialize(training, "training"))
    return None if blocks is None else _fit(_gather(blocks), share)


def quality_score(text: Column, model: QualityModel | None) -> Column:
    """The score (0 to 1) of a text; 1 for all if there is no model."""
    if model is None:
        return F.lit(1.0)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(x) for x in texts]).reshape(-1, len(FEATURES))), dtype=float)

    return score(text.cast("string"))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text; others ignored).

    Document utilities are learned from all training rows, in pairs of a document labelled 1 and one labelled 0, by
    logistic loss on the difference of their features. The cut is the quantile of the utilities that leaves the training labels' share of
    zeros below it; it gets the score 0.7. Rows whose crc32(doc_id) mod 4 is 2 are held out of all fitting; ids,
    languages, sources and labels are not features.

    Null and empty texts have zero features and the score that follows; equal texts have equal scores. Labels other
    than 0 and 1 are ignored. With one label only, or none, every score is 1. An empty table gives an empty result.
    """
    held = materialize(described(docs), "features")
    model = fit_quality(held, labels, ~held_out(F.col("doc_id"), 4, 2))

    @F.pandas_udf("double")
    def scored(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(rows.tolist(), float).reshape(-1, len(FEATURES))), dtype=float)

    rows = held.select("doc_id", (F.lit(1.0) if model is None else scored("x")).alias("score"))
    return rows.select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score reaches the cut, with all their columns."""
    keep = ~held_out(F.col("doc_id"), 4, 2)
    model = fit_quality(described(docs.where(keep)), labels, keep)
    return docs.where(quality_score(docs["text"], model) >= CUT_SCORE)
