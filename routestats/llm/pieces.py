"""SentencePiece encoding by Viterbi over an Aho-Corasick automaton of the pieces, and decoding."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routestats.llm.arrow import rows_of

#: The vocabulary used by the queries; any other file of the same kind can be given.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: The sign that stands for a space inside pieces.
SPACE = "▁"
#: Fixed by the format: an unknown character scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Words kept by a task with their encodings (about 250 bytes each), and the letters that a kept word has at most.
KEPT_WORDS, KEPT_LETTERS = 200_000, 64
#: Letters from which on a word's scores are held as plain numbers, 12 bytes a letter.
LONG_WORD = 4096

_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: pieces and scores by id; ``kinds`` are n(ormal), b(yte), u(nknown) or c(ontrol)."""

    texts: list[str]
    scores: list[float]
    kinds: str
    prefix: bool = True
    known: dict[str, list[int]] = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self) -> tuple:
        return self.texts, self.scores, self.kinds, self.prefix

    def __setstate__(self, state: tuple) -> None:
        for name, value in zip(("texts", "scores", "kinds", "prefix"), state, strict=True):
            object.__setattr__(self, name, value)
        object.__setattr__(self, "known", {})

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        built = ahocorasick.Automaton()
        for number, (text, score, kind) in enumerate(zip(self.texts, self.scores, self.kinds, strict=True)):
            if kind == "n" and text and text not in built:
                built.add_word(text, (len(text), score, number))
        built.make_automaton()
        return built

    @cached_property
    def by_word(self) -> bool:
        """Whether no piece goes on from the end of a word into the next space, so words can be taken singly."""
        return not any(re.search(f"[^{SPACE}]{SPACE}", t) for t, k in zip(self.texts, self.kinds, strict=True) if k == "n")

    @cached_property
    def byte_ids(self) -> dict[int, int]:
        return {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == "b"}

    @cached_property
    def unknown(self) -> tuple[int, float]:
        """Id and score of an unknown character."""
        return self.kinds.index("u"), min(s for s, k in zip(self.scores, self.kinds, strict=True) if k == "n") - UNKNOWN_PENALTY

    @cached_property
    def characters(self) -> frozenset[str]:
        """The pieces of one character."""
        return frozenset(t for t, k in zip(self.texts, self.kinds, strict=True) if k == "n" and len(t) == 1)

    def best(self, word: str) -> list[int]:
        """The ids of the best segmentation of a string: the highest sum of scores, of equals the longest last piece.

        The automaton reports, for every position, the pieces that end there, longest first, by its output links;
        each relaxes the best score of the position. A character that is no piece itself may stand alone as unknown;
        its place is relaxed before the first piece that ends later is.
        """
        n, (unknown, penalty) = len(word), self.unknown
        score, piece = [0.0] + [-math.inf] * n, [unknown] * (n + 1)
        if n >= LONG_WORD:
            score, piece = array("d", [0.0]) + array("d", [-math.inf]) * n, array("i", [unknown]) * (n + 1)
        alone = [] if self.characters.issuperset(word) else [i for i, c in enumerate(word) if c not in self.characters]
        waiting = iter([*alone, n])
        place = next(waiting)
        for last, (length, gain, number) in self.automaton.iter(word):
            while place < last:
                if score[place] + penalty > score[place + 1]:
                    score[place + 1], piece[place + 1] = score[place] + penalty, unknown
                place = next(waiting)
            end = last + 1
            total = score[end - length] + gain
            if total > score[end]:
                score[end], piece[end] = total, number
        while place < n:
            if score[place] + penalty > score[place + 1]:
                score[place + 1], piece[place + 1] = score[place] + penalty, unknown
            place = next(waiting)
        ids: list[int] = []
        end = n
        while end > 0:
            start = end - (1 if piece[end] == unknown else len(self.texts[piece[end]]))
            if piece[end] == unknown and self.byte_ids:
                ids += [self.byte_ids[b] for b in reversed(word[start:end].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(piece[end])
            end = start
        return ids[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; spaces become SPACE, and one is put in front."""
        if not text:
            return np.empty(0, np.int32)
        written = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        words = _WORD.findall(written) if self.by_word else [written]
        for word in set(words).difference(self.known):
            if len(word) <= KEPT_LETTERS:
                self.known[word] = self.best(word)
        ids = np.fromiter(chain.from_iterable(self.known[w] if w in self.known else self.best(w) for w in words), np.int32)
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        return ids

    @cached_property
    def as_bytes(self) -> list[bytes]:
        """What each id stands for in a decoded text."""
        spell = {
            "n": lambda t: t.replace(SPACE, " ").encode("utf-8", "surrogatepass"), "b": lambda t: bytes([int(t[3:5], 16)]),
            "u": lambda _: " ⁇ ".encode(), "c": lambda _: b"",
        }
        return [spell[k](t) for t, k in zip(self.texts, self.kinds, strict=True)]

    def decode(self, ids: Iterable[int]) -> str:
        data = b"".join(map(self.as_bytes.__getitem__, ids))
        if self.prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


def read_pieces(path: str = MODEL_FILE) -> Pieces:
    """The vocabulary of a SentencePiece model file, read on the driver; its size bounds what tasks receive."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kind = lambda i: "u" if model.is_unknown(i) else "b" if model.is_byte(i) else "c" if model.is_control(i) or model.is_unused(i) else "n"
    return Pieces([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], "".join(map(kind, ids)))


_MODELS: dict[int, Pieces] = {}


def _shared(pieces: Pieces) -> Pieces:
    """One object per Python worker, so that tasks after another share the automaton and the known words."""
    key = hash((len(pieces.texts), tuple(pieces.texts[-100:]), tuple(pieces.scores[-100:]), pieces.prefix))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = pieces
    return _MODELS[key]


def encode_documents(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded_matches) for each row of ``docs`` (doc_id, text; others ignored).

    ``ids`` is the segmentation of the text with the highest sum of piece scores; ``decoded_matches`` says whether
    decoding it gives the text again, which only texts with the sign U+2581 or, without byte pieces, with unknown
    characters fail. A null or empty text has no ids and matches. Texts are encoded whole and row by row, so repeated
    rows and empty tables need nothing special; words are encoded once per task while they are remembered.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    kind = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_matches", pa.bool_())])

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _shared(sent.value)
        names, parts, same, size = [], [], [], 0
        for doc_id, text in rows_of(batches):
            ids = model.encode(text)
            names.append(doc_id)
            parts.append(ids)
            same.append(model.decode(ids.tolist()) == (text or ""))
            size += len(ids)
            if size > 500_000:
                yield batch(names, parts, same)
                names, parts, same, size = [], [], [], 0
        if names:
            yield batch(names, parts, same)

    def batch(names: list, parts: list[np.ndarray], same: list[bool]) -> pa.RecordBatch:
        lengths = np.array([len(p) for p in parts], np.int64)
        ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(np.concatenate(parts)))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(lengths), ids, pa.array(same)], schema=kind)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encoded, "doc_id long, n_pieces long, ids array<int>, decoded_matches boolean")


def decoded(ids: Column, pieces: Pieces) -> Column:
    """The text of an array of ids; null for null."""

    @F.pandas_udf("string")
    def decode(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else pieces.decode(a.tolist()) for a in arrays], dtype=object)

    return decode(ids)
