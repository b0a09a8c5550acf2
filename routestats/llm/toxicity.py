"""Toxicity scores by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Every term of an example is in the index; a term found in no example adds nothing to a product with one and is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields
from functools import cached_property
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routestats.llm.arrow import map_rows, rows_of
from routestats.llm.labels import held_out, training_sample
from routestats.llm.words import mix, seeds
from routestats.session import materialize

#: Labelled rows of each label used as examples, taken in the order of a hash of the id, and the terms that those of a
#: label may have in all (at least one example is used): this bounds the index.
EXAMPLES, EXAMPLE_TERMS = 4000, 6_000_000
#: Letters of a word that make a term of their own, beside the whole word.
STEM = 4
#: Neighbours that vote, examples in a block, texts scored together.
NEIGHBOURS, BLOCK, BATCH = 32, 256, 64
#: Terms of more than one in DENSE examples have their lists as matrices of a block, others as lists of places.
DENSE = 16
#: Added to distances in votes; power of the contrast that weighs a shared term in a vote; votes for the examples' share
#: of label 1.
NEAREST, CONTRAST, PRIOR_VOTES = 0.1, 4, 8.0
#: Single precision is off by less than this in a cosine: who comes that near is reckoned again in double precision.
MARGIN = 1e-4
CUT_SCORE = 0.5
EVIDENCE = 3

_BASE = int(seeds(41, 1)[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WHOLE, _STEM = seeds(42, 2)
_PLANE = 1 << 16
#: Half the letters hashed at a time; a text is cut between words, a longer word is read in pieces.
_CHUNK = 1 << 18


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower, letter = np.arange(_PLANE, dtype=np.uint32), np.zeros(_PLANE, bool)
    for code in range(_PLANE):
        char = chr(code)
        letter[code] = char.isalpha()
        small = char.lower()
        if len(small) == 1:
            lower[code] = ord(small)
    return lower, letter


_LOWER, _LETTER = _tables()
#: The numbers of the letters in hashes.
_CODE = mix(_LOWER.astype(np.uint64))
_UP = np.full(2 * _CHUNK, _BASE, np.uint64)
_DOWN = np.full(2 * _CHUNK, _INVERSE, np.uint64)
_UP[0] = _DOWN[0] = 1
_UP, _DOWN = np.multiply.accumulate(_UP), np.multiply.accumulate(_DOWN)


def _long_run(codes: np.ndarray) -> np.ndarray:
    """The hashes of a word that is longer than a chunk, read in pieces."""
    total = np.zeros(1, np.uint64)
    for at in range(0, len(codes), len(_UP)):
        part = mix(codes[at : at + len(_UP)].astype(np.uint64)) * _UP[: len(codes) - at]
        total += part.sum(dtype=np.uint64) * np.full(1, pow(_BASE, at, 1 << 64), np.uint64)
    first = (mix(codes[:STEM].astype(np.uint64)) * _UP[:STEM]).sum(dtype=np.uint64)
    return np.r_[mix(total + _WHOLE), mix(np.full(1, first) + _STEM)]


def _term_hashes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    beyond = np.flatnonzero(codes >= _PLANE)
    plane = codes if not len(beyond) else np.minimum(codes, _PLANE - 1)
    letter = np.zeros(len(codes) + 2, bool)
    letter[1:-1] = _LETTER[plane]
    letter[beyond + 1] = True
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    start, end = edge[0::2], edge[1::2]
    found, low = [], 0
    while low < len(start):
        high = min(low + _CHUNK // 16, int(np.searchsorted(end, start[low] + len(_UP), "right")))
        if high == low:
            run = slice(start[low], end[low])
            found.append(_long_run(np.where(codes[run] < _PLANE, _LOWER[plane[run]], codes[run])))
            low += 1
            continue
        offset = start[low]
        s, e = start[low:high] - offset, end[low:high] - offset
        part = _CODE[plane[offset : end[high - 1]]]
        if len(beyond):
            own = beyond[np.searchsorted(beyond, offset) : np.searchsorted(beyond, end[high - 1])]
            part[own - offset] = mix(codes[own].astype(np.uint64))
        part *= _UP[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        back = _DOWN[s]
        found.append(mix((sums[e] - sums[s]) * back + _WHOLE))
        long = e - s > STEM
        found.append(mix((sums[s[long] + STEM] - sums[s[long]]) * back[long] + _STEM))
        low = high
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a text as sorted 64-bit hashes, and how often each occurs.

    A term is a word (a run of letters, folded to lower case) or the first STEM letters of a longer word.
    """
    hashes = _term_hashes(text) if text else np.empty(0, np.uint64)
    values, counts = np.unique(hashes.view(np.int64), return_counts=True)
    return values, counts


def _known(text: str | None, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into the sorted vocabulary of the text's terms, and their counts."""
    values, counts = terms(text)
    if not len(values) or not len(vocabulary):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
    hit = vocabulary[at] == values
    return at[hit], counts[hit]


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each low to below its high, one range after the other, and the ranges' lengths."""
    length = high - low
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - length), length), length


def _weights(idf: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The TF-IDF vector of a text, of length 1."""
    weights = (1 + np.log(counts)) * idf[at]
    return weights / max(np.sqrt((weights**2).sum()), 1e-300)


@dataclass(frozen=True)
class ToxicityIndex:
    """Examples by place, in blocks of BLOCK, and for each term the list of examples that hold it.

    The lists of rare terms are places and weights; those of common terms are, for each block, lines of a matrix, with
    the largest weight of every line and block.
    """

    vocabulary: np.ndarray  # sorted term hashes
    idf: np.ndarray  # the terms' weights
    ids: np.ndarray  # of the examples
    labels: np.ndarray
    begin: np.ndarray  # of each example's vector, among all; one more
    term: np.ndarray  # of the vectors, by example
    count: np.ndarray
    rate: float  # of label 1 in the population
    examples: tuple[int, int]  # of label 0 and 1, those without terms too
    empty_share: float  # of label 1 among examples without terms

    def __getstate__(self) -> dict:
        """Lists and matrices are made again where they are needed: sent is a third of them."""
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @property
    def share(self) -> float:
        """Of label 1 among the examples."""
        return self.examples[1] / max(1, sum(self.examples))

    @cached_property
    def length(self) -> np.ndarray:
        """Of each example's vector before it is made 1."""
        edges = zip(self.begin[:-1].tolist(), self.begin[1:].tolist(), strict=True)
        return np.array([max(np.sqrt((self._raw(low, high) ** 2).sum()), 1e-300) for low, high in edges])

    def _raw(self, low: int, high: int) -> np.ndarray:
        return (1 + np.log(self.count[low:high])) * self.idf[self.term[low:high]]

    @cached_property
    def unit(self) -> np.ndarray:
        """The examples' vectors, of length 1."""
        out = np.empty(len(self.term))
        for example, (low, high) in enumerate(zip(self.begin[:-1].tolist(), self.begin[1:].tolist(), strict=True)):
            out[low:high] = self._raw(low, high) / self.length[example]
        return out

    def weights(self, example: int) -> np.ndarray:
        """The vector of an example, of length 1."""
        return self.unit[self.begin[example] : self.begin[example + 1]]

    @cached_property
    def contrast(self) -> np.ndarray:
        """The terms' weights in votes."""
        bad = np.repeat(self.labels, np.diff(self.begin))
        seen = [np.bincount(self.term, x, len(self.vocabulary)) for x in (1 - bad, bad)]
        return _contrast(seen[1], seen[0], self.examples[1], self.examples[0]) ** CONTRAST

    @cached_property
    def line(self) -> np.ndarray:
        """The line of each common term, -1 for rare ones."""
        often = np.bincount(self.term, minlength=len(self.vocabulary)) * DENSE > len(self.ids)
        return np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)

    @cached_property
    def common(self) -> np.ndarray:
        """(line, place): weights of the common terms."""
        out = np.zeros((int(self.line.max(initial=-1)) + 1, len(self.ids)), np.float32)
        for place in range(len(self.ids)):
            line = self.line[self.term[self.begin[place] : self.begin[place + 1]]]
            out[line[line >= 0], place] = self.weights(place)[line >= 0]
        return out

    @cached_property
    def highest(self) -> np.ndarray:
        """(line, block): the largest weight."""
        return np.maximum.reduceat(self.common, np.arange(0, len(self.ids), BLOCK), axis=1)

    @cached_property
    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each rare term's list begins, among all (one more; a common term's is empty), places and weights."""
        held = np.where(self.line < 0, np.bincount(self.term, minlength=len(self.vocabulary)), 0)
        first = np.concatenate(([0], np.cumsum(held)))
        free, places, weights = first[:-1].copy(), np.zeros(first[-1], np.int32), np.zeros(first[-1], np.float32)
        for place in range(len(self.ids)):
            term = self.term[self.begin[place] : self.begin[place + 1]]
            rare = self.line[term] < 0
            at = free[term[rare]]
            places[at], weights[at] = place, self.weights(place)[rare]
            free[term[rare]] += 1  # a term stands once in a vector
        return first, places, weights

    @cached_property
    def remembered(self) -> dict[bytes, tuple]:
        return {}

    @cached_property
    def spots(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each term whether it is in the query that is compared now, and its place in the last query with it."""
        return np.zeros(len(self.vocabulary), bool), np.zeros(len(self.vocabulary), np.int32)

    def calibrated(self, share: float) -> float:
        """A share found among the examples as it is in the population, where the labels have other frequencies."""
        if not 0 < self.share < 1:
            return self.rate
        one = share * self.rate / self.share
        return one / (one + (1 - share) * (1 - self.rate) / (1 - self.share))

    def _products(self, at: np.ndarray, query: np.ndarray, examples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cosines of these examples, and the same sums with each term weighed by its contrast."""
        asked, spot = self.spots
        low, high = self.begin[examples], self.begin[examples + 1]
        asked[at], spot[at] = True, np.arange(len(at))
        term = np.concatenate([self.term[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)])
        shared = np.flatnonzero(asked.take(term, mode="clip"))
        asked[at] = False
        ends = np.cumsum(high - low)
        of, where = np.searchsorted(ends, shared, "right"), spot[term[shared]]
        part = query[where] * self.unit[shared + (high - ends)[of]]
        return tuple(np.bincount(of, x, len(examples)) for x in (part, part * self.contrast[at][where]))

    def candidates(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """For each (terms, weights) the examples that can be among its NEIGHBOURS nearest.

        Rare terms' lists are read first. What a block can still add is bounded by its largest weights of the common
        terms; it is read by the texts for which the bound reaches their NEIGHBOURS-th cosine so far. No cosine can be
        less than the part of it that has been read, so nobody is missed.
        """
        count, size = len(self.ids), len(queries)
        first, place, listed = self.lists
        near = np.zeros((size, count), np.float32)
        lines = np.zeros((size, len(self.common)), np.float32)
        for row, (at, query) in enumerate(queries):
            postings, length = _ranges(first[at], first[at + 1])
            near[row] = np.bincount(place[postings], listed[postings] * np.repeat(query, length), count)
            line = self.line[at]
            lines[row, line[line >= 0]] = query[line >= 0]
        k = min(NEIGHBOURS, count)
        floor = np.partition(near, -k, axis=1)[:, -k]
        reach = lines @ self.highest
        starts = np.arange(0, count, BLOCK)
        reach += np.maximum.reduceat(near, starts, axis=1)
        for block in range(len(starts)):
            own = slice(block * BLOCK, (block + 1) * BLOCK)
            asks = np.flatnonzero(reach[:, block] >= floor - MARGIN)
            if len(asks) == size:
                near[:, own] += lines @ self.common[:, own]
            elif len(asks):
                near[asks, own] += lines[asks] @ self.common[:, own]
        floor = np.partition(near, -k, axis=1)[:, -k]
        floor = np.maximum(floor - MARGIN, np.nextafter(np.float32(0), np.float32(1)))
        return [np.flatnonzero(line >= limit) for line, limit in zip(near, floor, strict=True)]

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each (terms, weights) the NEIGHBOURS examples of highest cosine above 0, ties by smaller id, their
        cosines, and what the shared terms weigh in a vote."""
        if not queries:
            return []
        out = []
        for (at, query), found in zip(queries, self.candidates(queries), strict=True):
            if len(found):
                cosine, weight = self._products(at, query, found)
                cosine = np.round(cosine, 12)
                best = np.lexsort((self.ids[found], -cosine))
                best = best[cosine[best] > 0][:NEIGHBOURS]
                out.append((found[best], cosine[best], weight[best]))
            else:
                out.append((found, np.empty(0), np.empty(0)))
        return out

    def score(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int], list[float]]]:
        """Of texts, given as term indexes and counts: the share of label 1 in the votes, the nearest examples and
        their cosines."""
        keys = [blake2b(at.tobytes() + counts.tobytes(), digest_size=16).digest() for at, counts in texts]
        known = {key: self.remembered[key] for key in keys if key in self.remembered}
        new = {key: (at, _weights(self.idf, at, n)) for key, (at, n) in zip(keys, texts, strict=True) if key not in known and len(at)}
        if not len(self.ids):
            new = {}
        for key, (found, cosine, weight) in zip(new, self.nearest(list(new.values())), strict=True):
            vote = weight / (1 - np.minimum(cosine, 1) + NEAREST)
            share = ((vote * self.labels[found]).sum() + PRIOR_VOTES * self.share) / (vote.sum() + PRIOR_VOTES)
            near = slice(0, EVIDENCE)
            known[key] = float(self.calibrated(share)), self.ids[found[near]].tolist(), cosine[near].tolist()
        if len(self.remembered) > 20_000:
            self.remembered.clear()
        self.remembered.update(known)
        return [known.get(key, (self.calibrated(self.empty_share), [], [])) for key in keys]


def _contrast(in_bad: np.ndarray, in_good: np.ndarray, bad: int, good: int) -> np.ndarray:
    """How far a term's frequencies under the labels lie apart: the logarithm of their ratio, half an example added."""
    return np.abs(np.log((in_bad + 0.5) / (bad + 1.0)) - np.log((in_good + 0.5) / (good + 1.0)))


_VECTORS = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("size", pa.int64()), ("terms", pa.binary()), ("number", pa.binary())])
_VECTORS_DDL = "doc_id long, label int, size long, terms binary, number binary"
#: Terms whose counts are added up together.
_CHUNK_TERMS = 1 << 14
_KNOWN = pa.schema([("doc_id", pa.int64()), ("known", pa.binary())])


def _packed(at: np.ndarray, counts: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    """Known terms and counts: steps between the terms, byte by byte of equal weight, then the counts alike."""
    numbers = np.concatenate([np.diff(at, prepend=0), counts]).astype("<i4")
    return pack.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(packed: bytes, unpack: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(unpack.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()
    half = len(numbers) // 2
    return np.cumsum(numbers[:half]), numbers[half:]


def examples_of(docs: DataFrame, sample: DataFrame) -> list[tuple]:
    """(doc_id, label, term hashes, counts) of the sampled documents, in the order of a hash of the id, as many of each
    label as have EXAMPLE_TERMS terms in all. The driver sees this bounded part only."""
    picked = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")

    def vectors(rows: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, value, text in rows:
            values, counts = terms(text)
            yield doc_id, value, len(values), values.tobytes(), counts.astype(np.int32).tobytes()

    held = map_rows(picked, vectors, _VECTORS, _VECTORS_DDL, lambda r: len(r[3]) + len(r[4]))
    held = materialize(held.dropDuplicates(["doc_id"]), "example-terms")
    chosen, total = [], {}
    for row in held.select("doc_id", "label", "size").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        before = total.get(row.label, 0)
        total[row.label] = before + row.size
        if not before or total[row.label] <= EXAMPLE_TERMS:
            chosen.append((row.doc_id,))
    chosen = held.sparkSession.createDataFrame(chosen, "doc_id long")
    table = held.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "terms", "number").toArrow()
    return [
        (doc_id, value, np.frombuffer(one.as_buffer(), np.int64), np.frombuffer(two.as_buffer(), np.int32))
        for doc_id, value, one, two in zip(*(table[c].to_pylist() for c in ("doc_id", "label")), table["terms"], table["number"], strict=True)
    ]


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic") -> tuple[ToxicityIndex, DataFrame]:
    """The index over at most EXAMPLES labelled rows of each label that ``keep`` admits, and (doc_id, known): the known
    terms of all ``docs``, packed and stored.

    A term weighs its inverse document frequency, counted over all of ``docs``. The driver sees the examples' vectors
    and one count for each of their terms.
    """
    sample, share_good = training_sample(labels, label, keep, EXAMPLES)
    rate = 1 - share_good if sample.take(1) else 0.0
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    examples = examples_of(docs, sample)
    vocabulary = np.unique(np.concatenate([e[2] for e in examples])) if examples else np.empty(0, np.int64)
    examples = [(doc_id, value, np.searchsorted(vocabulary, x), number) for doc_id, value, x, number in examples]
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def found(rows: Iterable[tuple]) -> Iterator[tuple]:
        pack = zstandard.ZstdCompressor(level=1)
        for doc_id, text in rows:
            yield doc_id, _packed(*_known(text, known.value), pack)

    stored = map_rows(docs, found, _KNOWN, "doc_id long, known binary", lambda r: len(r[1]))
    stored = materialize(stored, "known-terms")
    size = len(vocabulary)

    def frequencies(rows: Iterable[tuple]) -> Iterator[tuple]:
        unpack, total = zstandard.ZstdDecompressor(), np.zeros(size + 1, np.int64)
        for (held,) in rows:
            total[_unpacked(held, unpack)[0]] += 1
            total[-1] += 1
        for low in range(0, size + 1, _CHUNK_TERMS):
            yield low, total[low : low + _CHUNK_TERMS].tobytes()

    def added(rows: Iterable[tuple]) -> Iterator[tuple]:
        totals: dict[int, np.ndarray] = {}
        for low, counts in rows:
            counts = np.frombuffer(counts, np.int64)
            totals[low] = totals[low] + counts if low in totals else counts
        for low, counts in totals.items():
            yield low, counts.tobytes()

    chunks = pa.schema([("low", pa.int64()), ("counts", pa.binary())])
    counted = map_rows(stored.select("known"), frequencies, chunks, "low long, counts binary", lambda r: len(r[1]))
    counted = map_rows(counted.repartition("low"), added, chunks, "low long, counts binary", lambda r: len(r[1]))
    total = np.zeros(size + 1, np.int64)
    for low, counts in zip(*(c.to_pylist() for c in counted.toArrow().columns), strict=True):
        total[low : low + _CHUNK_TERMS] = np.frombuffer(counts, np.int64)
    idf = np.log((1 + total[-1]) / (1 + total[:-1]))
    return build_index(vocabulary, idf, examples, rate), stored


def build_index(vocabulary: np.ndarray, idf: np.ndarray, examples: list[tuple], rate: float) -> ToxicityIndex:
    """The index over examples (id, label, term indexes, counts); those without terms only give the empty rate."""
    number = (sum(1 - e[1] for e in examples), sum(e[1] for e in examples))
    bare = [e[1] for e in examples if not len(e[2])]
    empty = sum(bare) / len(bare) if bare else number[1] / max(1, sum(number))
    rows = []
    for doc_id, value, at, counts in examples:
        if len(at):
            at, counts = np.asarray(at, np.int32), np.asarray(counts, np.int32)
            rows.append((int(at[_weights(idf, at, counts).argmax()]), at.tobytes(), doc_id, value, at, counts))
    rows.sort(key=lambda r: r[:3])  # those with the same heaviest term share blocks
    begin = np.cumsum([0, *(len(r[4]) for r in rows)])
    term, counts = (np.concatenate([np.empty(0, np.int32), *(r[i] for r in rows)]) for i in (4, 5))
    ids, labels = (np.array([r[i] for r in rows], kind) for i, kind in ((2, np.int64), (3, np.float64)))
    return ToxicityIndex(vocabulary, idf, ids, labels, begin, term, counts, rate, number, empty)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, cosines) for each row of ``docs`` (doc_id, text; others ignored).

    Nearness is the TF-IDF cosine over all terms. The score is the share of label 1 in the votes of the nearest labelled
    examples, set right for the labels' frequency among all training rows; a vote is the inverse of the distance times
    the shared terms' products, each weighed by how differently the labels use the term. ``evidence`` has the nearest
    ids. Rows whose crc32(doc_id) mod 5 is 0 are held out of all fitting; ids, languages, sources and labels are not
    terms.

    Texts without a known term, null and empty ones too, get the share of label 1 among such examples. Very long texts
    are read in pieces; as examples they count by their terms. Equal texts have equal scores; ties of examples go to
    the smaller id. Labels other than 0 and 1 are ignored; without labels every score is 0. An empty table gives an
    empty result.
    """
    fitted, stored = fit_toxicity(docs, labels, ~held_out(F.col("doc_id"), 5, 0))
    index = docs.sparkSession.sparkContext.broadcast(fitted)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.list_(pa.int64())), ("cosines", pa.list_(pa.float64())),
    ])

    def scored(rows: Iterable[tuple]) -> Iterator[tuple]:
        model, rows, unpack = index.value, iter(rows), zstandard.ZstdDecompressor()
        while part := list(islice(rows, BATCH)):
            texts = [_unpacked(held, unpack) for _, held in part]
            for (doc_id, _), found in zip(part, model.score(texts), strict=True):
                yield doc_id, *found

    rows = map_rows(stored, scored, schema, "doc_id long, score double, evidence array<long>, cosines array<double>")
    return rows.select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"), "evidence", "cosines",
    )
