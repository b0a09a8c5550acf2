import os

import pytest
from pyspark.sql import functions as F

from routestats.llm import pieces as pc

pytestmark = pytest.mark.skipif(not os.path.exists(pc.MODEL_FILE), reason="the vocabulary is not here")


@pytest.fixture(scope="module")
def model():
    return pc.read_pieces()


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    """The library's own Viterbi over the same pieces: the file's kind set to unigram."""
    pytest.importorskip("google.protobuf")
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(pc.MODEL_FILE, "rb").read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    return SentencePieceProcessor(model_proto=proto.SerializeToString())


def slow(model, text):
    """The best sum by trying every piece at every place, over the whole text."""
    text = pc.SPACE + text.replace(" ", pc.SPACE)
    table = {t: (s, i) for i, (t, s, k) in enumerate(zip(model.texts, model.scores, model.kinds, strict=True)) if k == "n" and t}
    longest, (_, penalty) = max(map(len, table)), model.unknown
    best = [(0.0, 0, None)]
    for end in range(1, len(text) + 1):
        options = [(best[s][0] + table[text[s:end]][0], s, table[text[s:end]][1]) for s in range(max(0, end - longest), end) if text[s:end] in table]
        if text[end - 1] not in table:
            options.append((best[end - 1][0] + penalty, end - 1, None))
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    ids, end = [], len(text)
    while end:
        _, start, number = best[end]
        ids += [number] if number is not None else [model.byte_ids[b] for b in reversed(text[start:end].encode())]
        end = start
    return ids[::-1]


TEXTS = ["Hello world", " a  b   c ", "The quick brown fox, jumps! 123", "naïve café Ünïcödé", "日本語テキスト 😀🏳️‍🌈 x͸y", "line\nbreak\t\ttab\r\n",
         "x", " ", "thorthorthor" * 20, "ÀÉ the end\x1c of\x85it", "<s> </s> <unk> <0x41>"]


def test_against_every_segmentation(model, mixed_texts):
    for text in [*TEXTS, *[t[:400] for t in mixed_texts if t]]:
        assert model.encode(text).tolist() == slow(model, text), text


def test_against_the_library(model, library):
    for text in TEXTS[:1] + TEXTS[2:9]:
        if text.strip() == text and text:
            assert model.encode(text).tolist() == library.encode(text), text


def test_round_trip(model, mixed_texts):
    for text in [*TEXTS, *mixed_texts]:
        assert model.decode(model.encode(text).tolist()) == (text or "")
    assert model.decode(model.encode("a▁b").tolist()) == "a b"


def test_unknown_characters_and_pieces_over_words():
    tiny = pc.Pieces(["<unk>", "a", "b", "ab", "▁", "b▁a"], [0, -1, -1, -1.5, -1, -0.5], "unnnnn")
    assert not tiny.by_word and tiny.encode("ab a").tolist() == [4, 1, 5]
    assert tiny.encode("aéb").tolist() == [4, 1, 0, 2] and tiny.decode([4, 1, 0]) == "a ⁇ "
    tie = pc.Pieces(["<unk>", "a", "aa", "▁"], [0, -1, -2, -1], "unnn")
    assert tie.encode("aa").tolist() == [3, 2]  # equal sums: the longest last piece


def test_documents(spark, docs_of, mixed_texts, model, clashing):
    df = clashing(docs_of(mixed_texts))
    rows = pc.encode_documents(df, model).collect()
    want = {i: model.encode(t).tolist() for i, t in enumerate(mixed_texts)}
    assert {r.doc_id: r.ids for r in rows} == want
    assert all(r.n_pieces == len(r.ids) and r.decoded_matches for r in rows)
    back = pc.encode_documents(df, model).select("doc_id", pc.decoded(F.col("ids"), model))
    assert dict(map(tuple, back.collect())) == {i: t or "" for i, t in enumerate(mixed_texts)}
    assert pc.encode_documents(df.limit(0), model).count() == 0


def test_forgetting_words_changes_nothing(model, mixed_texts, monkeypatch):
    want = [model.encode(t).tolist() for t in mixed_texts]
    monkeypatch.setattr(pc, "KEPT_WORDS", 10)
    assert [model.encode(t).tolist() for t in mixed_texts] == want


def test_long_words_are_not_remembered(model, mixed_texts, monkeypatch):
    fresh = pc.Pieces(model.texts, model.scores, model.kinds, model.prefix)
    long = "letters" * 2000
    want = model.best(pc.SPACE + long)
    assert fresh.encode(long).tolist() == want and not any(len(w) > pc.KEPT_LETTERS for w in fresh.known)
    monkeypatch.setattr(pc, "LONG_WORD", 1)
    assert [fresh.best(t) for t in mixed_texts if t] == [model.best(t) for t in mixed_texts if t]
