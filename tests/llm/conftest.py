import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_words(rng, count, kinds=400):
    return ["w%x" % rng.randrange(kinds) for _ in range(count)]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or from (id, text) pairs; other columns are filled in."""

    def build(texts, **more):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return build


@pytest.fixture(scope="session")
def mixed_texts():
    """Random texts with exact and near copies, shared passages, junk, short, empty, long and null ones."""
    rng = random.Random(3)
    passage = make_words(rng, 70, 10_000)
    texts = []
    for _ in range(60):
        words = make_words(rng, rng.randrange(1, 160))
        if rng.random() < 0.3:
            at = rng.randrange(len(words) + 1)
            low = rng.randrange(30)
            words[at:at] = passage[low : rng.randrange(low, 71)]
        texts.append(" ".join(words))
    for source in (3, 3, 3, 5, 8, 9, 11):
        words = texts[source].split(" ")
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "changed%d" % rng.randrange(9)
        texts.append(rng.choice([" ", "\n", "\t  "]).join(words))
    texts += [texts[4], texts[4], "", None, "   \n", "one", "Two words", "x " * 200, "é" * 5000, "ÀÉ the end\x1c of\x85it",
              " ".join(make_words(rng, 4000)), "no.spaces" * 3000]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [texts[i] for i in order]


@pytest.fixture(scope="session")
def clashing(spark):
    """Add columns whose names the operators use inside or return."""
    from pyspark.sql import functions as F

    names = ["kept", "score", "component_id", "rep", "key", "h1", "group", "place", "text_a", "label", "_mix_key", "count",
             "n_words", "ids", "block", "rank", "u", "v", "node", "shard", "kind"]
    return lambda df: df.withColumns({n: F.lit("x") for n in names if n not in df.columns})
