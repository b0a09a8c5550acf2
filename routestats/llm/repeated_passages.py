"""Removal of passages that an earlier document holds, located by sharded Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routestats.llm.arrow import map_rows, rows_of
from routestats.llm.words import mix, runs, seeds, signed, word_hashes
from routestats.session import materialize

#: Words of a passage, and of the phrases by which possible repeats are found.
WINDOW, PHRASE = 50, 8
#: Words of the documents of one shard, and of the patterns of one automaton (about 60 bytes a word).
SHARD_WORDS, AUTOMATON_WORDS = 200_000, 500_000

_ROW, _NEXT = seeds(21, 2)
_EMPTY = hashlib.sha256(b"").hexdigest()


def _words(text: str | None) -> list[bytes]:
    """``bytes.split`` divides at exactly the six ASCII white-space bytes."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of the sequence of words."""
    places = np.arange(len(hashes), dtype=np.uint64)
    return tuple(int(mix(hashes ^ mix(places + seed)).sum(dtype=np.uint64).view(np.int64)) for seed in seeds(22, 2))


def _phrases(hashes: np.ndarray) -> np.ndarray:
    """For each window its phrase: the smallest hash of PHRASE consecutive words in it.

    Equal windows have the same phrase, so windows that repeat are found where their phrase repeats.
    """
    return sliding_window_view(runs(hashes, PHRASE), WINDOW - PHRASE + 1).min(axis=1)


def _profile(rows: Iterable[tuple]) -> Iterator[tuple]:
    for doc_id, text in rows:
        words, hashes = _words(text), word_hashes(text)
        whole = hashlib.sha256(b" ".join(words)).hexdigest()
        phrases = signed(np.unique(_phrases(hashes))).tolist() if len(hashes) >= WINDOW else []
        yield doc_id, len(words), *_digest(hashes), whole, phrases


def _packed(rows: Iterable[tuple]) -> Iterator[tuple]:
    pack = zstandard.ZstdCompressor(level=1)
    for doc_id, text in rows:
        hashes = word_hashes(text)
        if len(hashes) >= WINDOW:
            yield doc_id, *_digest(hashes), len(hashes), pack.compress(b" ".join(_words(text)))


def _unpacked() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _hashes(packed: bytes, unpack: zstandard.ZstdDecompressor) -> np.ndarray:
    return word_hashes(unpack.decompress(packed).decode("utf-8", "surrogatepass"))


def _place(row: int, at: np.ndarray) -> np.ndarray:
    return mix(at.astype(np.uint64) * _NEXT + mix(np.array([row], np.int64).view(np.uint64) ^ _ROW))


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, doc_id, here, next) of every window whose phrase recurs.

    ``here`` combines the places where the document holds the window, ``next`` the places one word further on.
    """
    unpack, held, count = _unpacked(), [], 0
    names = ["window", "doc_id", "here", "next"]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)

    for doc_id, row, packed, recurring in rows_of(batches, 64):
        hashes = _hashes(packed, unpack)
        at = np.flatnonzero(np.isin(signed(_phrases(hashes)), np.array(recurring, np.int64)))
        if not len(at):
            continue
        window = runs(hashes, WINDOW)[at]
        order = np.argsort(window, kind="stable")
        window, at = window[order], at[order]
        first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        here, after = (np.bitwise_xor.reduceat(_place(row, at + i), first) for i in (0, 1))
        held.append((signed(window[first]), np.full(len(first), doc_id, np.int64), signed(here), signed(after)))
        count += len(first)
        if count >= 50_000:
            yield batch()
            held, count = [], 0
    if held:
        yield batch()


def _coded(hashes: np.ndarray) -> np.ndarray:
    """Each word as one code point of the 2**20 beyond the first plane: an automaton's letters are words."""
    return (np.uint64(0x10000) + (hashes >> np.uint64(44))).astype("<u4")


def _patterns(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(phrase, first, pattern): the recurring passages of a document that no smaller one holds.

    Adjacent windows belong to one passage if they always occur together: the places of the one, moved on by a word,
    are the places of the other.
    """
    unpack = _unpacked()
    for doc_id, packed, *windows in rows:
        hashes = _hashes(packed, unpack)
        known = np.array(windows, np.int64).T
        known = known[np.argsort(known[:, 0])]
        own = signed(runs(hashes, WINDOW))
        found = np.minimum(np.searchsorted(known[:, 0], own), len(known) - 1)
        at = np.flatnonzero(known[found, 0] == own)
        if not len(at):
            continue
        here, after = known[found[at], 1], known[found[at], 2]
        joined = (np.diff(at) == 1) & (after[:-1] == here[1:])
        starts = at[np.r_[True, ~joined]]
        ends = at[np.r_[~joined, True]] + WINDOW
        phrase, coded = signed(_phrases(hashes)[starts]), _coded(hashes)
        seen = set()
        for start, end, key in zip(starts.tolist(), ends.tolist(), phrase.tolist(), strict=True):
            pattern = coded[start:end].tobytes()
            if pattern not in seen:
                seen.add(pattern)
                yield key, doc_id, pattern


def _located(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Per document of a shard the words removed and the digest of the rest.

    A shard's documents come first; its patterns follow and are compiled into one automaton after another of bounded
    size, and each one reads all documents of the shard.
    """
    unpack = _unpacked()
    docs: list[tuple] = []
    automaton, size, shard = ahocorasick.Automaton(), 0, None

    def read() -> None:
        automaton.make_automaton()
        for doc_id, _, _, _, coded, covered in docs:
            for end, (length, first) in automaton.iter(coded):
                if first < doc_id:
                    covered[end - length + 1] += 1
                    covered[end + 1] -= 1

    def finished() -> Iterator[tuple]:
        if size:
            read()
        for doc_id, h1, h2, packed, _, covered in docs:
            gone = np.cumsum(covered[:-1]) > 0
            words = unpack.decompress(packed).split(b" ")
            kept = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
            yield doc_id, h1, h2, int(gone.sum()), hashlib.sha256(kept).hexdigest()

    for own, _, doc_id, h1, h2, data in rows:
        if own != shard:
            yield from finished()
            docs, automaton, size, shard = [], ahocorasick.Automaton(), 0, own
        if h1 is not None:
            coded = _coded(_hashes(data, unpack)).tobytes().decode("utf-32-le")
            docs.append((doc_id, h1, h2, data, coded, np.zeros(len(coded) + 1, np.int32)))
            continue
        key = data.decode("utf-32-le")
        held = automaton.get(key, None)
        automaton.add_word(key, (len(key), min(doc_id, held[1]) if held else doc_id))
        size += len(key)
        if size >= AUTOMATON_WORDS:
            read()
            automaton, size = ahocorasick.Automaton(), 0
    yield from finished()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs`` (doc_id long, text string, others ignored).

    A word goes if it lies in 50 consecutive words that also occur in a document with a smaller doc_id; windows are
    judged on the input. Windows are compared by 64-bit hashes of their words, unchanged.

    1. Documents with the same words are one class; all but the smallest doc_id go whole (from 50 words on).
    2. Each window has a phrase of 8 words; phrases of two or more classes recur.
    3. Windows with a recurring phrase are counted over all documents that hold one: those of two or more documents
       are confirmed, and adjacent ones that always occur together form one passage of the first document.
    4. Documents are dealt to shards of bounded size. A passage goes to the shards that hold its first phrase, is
       compiled into their Aho-Corasick automata, and every document of the shard is read through them.

    Null, empty and short texts lose nothing. A null doc_id is smaller than none and has none smaller: such rows are
    left as they are and serve as nobody's first. Rows that repeat a doc_id are judged each by itself against
    smaller ids. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
                        ("whole", pa.string()), ("phrases", pa.list_(pa.int64()))])
    ddl = "doc_id long, n_words long, h1 long, h2 long, whole string, phrases array<long>"
    profiles = materialize(map_rows(docs, _profile, schema, ddl, lambda row: 200 + 8 * len(row[5])), "profiles")
    able = profiles.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    classes = materialize(able.groupBy("h1", "h2").agg(F.min("doc_id").alias("head")), "classes")
    heads = able.join(classes, ["h1", "h2"]).where("doc_id = head")
    heads = materialize(heads.select("doc_id", "h1", "h2", "phrases"), "heads")
    spread = heads.select("doc_id", "h1", "h2", F.explode("phrases").alias("phrase"))
    recurring = spread.groupBy("phrase").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    # Written: a join of plain shuffles can be split at a hot phrase.
    recurring = materialize(recurring.select("phrase"), "recurring")
    having = spread.join(recurring, "phrase").groupBy("doc_id", "h1", "h2")
    having = having.agg(F.collect_set("phrase").alias("recurring"))
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n_words", pa.int64()),
                        ("packed", pa.binary())])
    packed = map_rows(docs, _packed, schema, "doc_id long, h1 long, h2 long, n_words long, packed binary",
                      lambda row: len(row[4]))
    texts = packed.join(having, ["doc_id", "h1", "h2"]).dropDuplicates(["doc_id", "h1", "h2"])
    texts = materialize(texts.withColumn("row", F.xxhash64("doc_id", "h1", "h2")), "texts")

    windows = texts.select("doc_id", "row", "packed", "recurring").mapInArrow(
        _windows, "window long, doc_id long, here long, next long"
    )
    confirmed = windows.groupBy("window").agg(
        F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"),
        F.bit_xor("here").alias("here"), F.bit_xor("next").alias("next"),
    ).where("doc_id < last")
    first = confirmed.groupBy("doc_id").agg(F.collect_list(F.struct("window", "here", "next")).alias("windows"))
    schema = pa.schema([("phrase", pa.int64()), ("first", pa.int64()), ("pattern", pa.binary())])
    passages = texts.select("doc_id", "packed").join(first, "doc_id").select(
        "doc_id", "packed", "windows.window", "windows.here", "windows.next"
    )
    ddl = "phrase long, first long, pattern binary"
    passages = materialize(map_rows(passages, _patterns, schema, ddl, lambda row: len(row[2])), "passages")

    words = texts.agg(F.sum("n_words")).first()[0] or 0
    texts = texts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(words // SHARD_WORDS + 1)))
    route = texts.select("shard", F.explode("recurring").alias("phrase")).distinct()
    routed = passages.join(route, "phrase").select(
        "shard", F.lit(1).alias("kind"), F.col("first").alias("doc_id"), F.lit(None).cast("long").alias("h1"),
        F.lit(None).cast("long").alias("h2"), F.col("pattern").alias("data"),
    )
    read = texts.select("shard", F.lit(0).alias("kind"), "doc_id", "h1", "h2", F.col("packed").alias("data"))
    dealt = read.unionByName(routed).repartition("shard").sortWithinPartitions("shard", "kind")
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()),
                        ("sha", pa.string())])
    located = map_rows(dealt, _located, schema, "doc_id long, h1 long, h2 long, n long, sha string")

    able = (F.col("n_words") >= WINDOW) & (F.col("head") < F.col("doc_id"))
    rows = profiles.select("doc_id", "n_words", "h1", "h2", "whole").join(classes, ["h1", "h2"], "left")
    rows = rows.join(located, ["doc_id", "h1", "h2"], "left")
    return rows.select(
        "doc_id", "n_words",
        F.when(able, F.col("n_words")).otherwise(F.coalesce("n", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(able, F.lit(_EMPTY)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
    )
