import hashlib

import numpy as np
import pytest

from routestats.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain loops over (vec_id, vector, label)."""
    rows = sorted(rows, key=lambda r: r[0])
    width = -(-max(len(v) for _, v, _ in rows) // parts) * parts
    x = [[int(np.floor(1024 * np.float64(np.float32(c)))) for c in v] + [0] * (width - len(v)) for _, v, _ in rows]
    cut = [[v[p * width // parts : (p + 1) * width // parts] for p in range(parts)] for v in x]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def assigned():
        out = []
        for v in cut:
            best = []
            for p in range(parts):
                apart = [sum((a - b) ** 2 for a, b in zip(v[p], e)) for e in books[p]]
                best.append((apart.index(min(apart)), min(apart)))
            out.append(best)
        return out

    for _ in range(rounds):
        codes = assigned()
        for p in range(parts):
            for i in range(len(books[p])):
                own = [v[p] for v, c in zip(cut, codes) if c[p][0] == i]
                if own:
                    books[p][i] = [sum(c) // len(own) for c in zip(*own)]
    codes = assigned()
    errors = [sum(e for _, e in c) for c in codes]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [
        (r[0], "".join(f"{i:02x}" for i, _ in c), e, sum(f for s, f in zip(rows, errors) if s[2] == r[2]), sha)
        for r, c, e in zip(rows, codes, errors)
    ]


@pytest.mark.parametrize("block_bytes", [vc.BLOCK_BYTES, 2000])
def test_codes_and_codebooks_against_plain_loops(spark, clashing, monkeypatch, block_bytes):
    monkeypatch.setattr(vc, "BLOCK_BYTES", block_bytes)
    random = np.random.default_rng(5)
    x = np.round(random.standard_normal((400, 8)), 2).astype(np.float32)
    x[300:350] = x[3]
    rows = [(i, v.tolist(), None if i % 9 == 0 else i % 3) for i, v in enumerate(x)]
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))
    found = vc.code_report(df)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert [tuple(r) for r in found.orderBy("vec_id").collect()] == brute(rows)


def test_unusable_short_repeated_and_huge_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0], 1), (2, [0.5], 1), (2, [0.5], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf], 2), (6, [None, 1.0], 2),
            (7, [], None), (8, [1e30, -1e30, 0.0, 5.0], 2), (None, [1.0], None)]
    codes, books = vc.compress(spark.createDataFrame(rows, SCHEMA), entries=3, rounds=2)
    kept = {(r.vec_id, r.error) for r in codes.collect()}
    assert {v for v, _ in kept} == {1, 2, 7, 8, None} and all(e >= 0 for _, e in kept)
    assert codes.count() == 6 and books.width == 4
    assert books.entries.min() >= -vc.LARGEST and books.entries.max() <= vc.LARGEST
    assert vc.code_report(spark.createDataFrame(rows[3:5], SCHEMA)).count() == 0
    assert vc.code_report(spark.createDataFrame([], SCHEMA)).count() == 0
    only = vc.code_report(spark.createDataFrame(rows[7:8], SCHEMA)).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in only] == [(7, "00000000", 0, 0)]


def test_ties_go_to_the_lower_entry_and_blocks_unpack_as_packed():
    numbers = np.array([[0, 5], [2, -7], [1, 5]])
    block = vc.Block.of(numbers)
    again = vc.Block.unpacked(3, *block.packed())
    assert all((a == b).all() for a, b in zip(block.values, again.values)) and (block.places == again.places).all()
    books = vc.Codebooks(np.array([[2, 0, 0], [5, 5, 5]]), 2)
    code, apart = again.nearest(books)
    assert code.tolist() == [[1, 0], [0, 0], [0, 0]] and apart.tolist() == [[0, 0], [0, 144], [1, 0]]


def test_partitioning_makes_no_difference(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    one, two = (sorted(tuple(r) for r in vc.code_report(df.repartition(n)).collect()) for n in (1, 7))
    assert one == two and len(one) == df.count()
