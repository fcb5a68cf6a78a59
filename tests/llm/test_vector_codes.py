"""Vector codes against plain rounds of assignment, and the bounds that spare comparisons."""

from __future__ import annotations

import math

import numpy as np
import pytest

from limner.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, entries=V.ENTRIES, rounds=V.ROUNDS):
    """Code and error of each kept row, and the codebooks, by comparing everything in every round."""
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    ints = [[max(-V.LARGEST, min(V.LARGEST, math.floor(1024 * v))) for v in r[1]] for r in kept]
    width = -(-max(map(len, ints), default=0) // 4)
    ints = [x + [0] * (4 * width - len(x)) for x in ints]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, ints[i]))[:entries]
    books = [[ints[i][p * width : (p + 1) * width] for i in order] for p in range(4)]
    for turn in range(rounds + 1):
        codes, errors = [], []
        for x in ints:
            code, error = [], 0
            for p in range(4):
                part = x[p * width : (p + 1) * width]
                d, e = min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), k) for k, entry in enumerate(books[p]))
                code.append(e)
                error += d
            codes.append(bytes(code))
            errors.append(error)
        if turn < rounds:
            for p in range(4):
                for e in range(len(books[p])):
                    own = [x[p * width : (p + 1) * width] for x, c in zip(ints, codes, strict=True) if c[p] == e]
                    if own:
                        books[p][e] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    return kept, codes, errors, books


@pytest.mark.parametrize("entries", [256, 5, 1])
def test_codes_of_a_table(spark, entries):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(120)
    rows = [tuple(r) for r in df.collect()]
    kept, codes, errors, books = plain_codes(rows, entries)
    got, own = V.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(3), entries)
    assert sorted((r.vec_id, bytes(r.code), r.error) for r in got.collect()) == sorted((r[0], c, e) for r, c, e in zip(kept, codes, errors, strict=True))
    assert own.entries.tolist() == books


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [0.1, -0.2, 0.3, 0.4, 0.5, -0.6, 0.7, 0.8], 1),
        (4, [0.1, -0.2, 0.3, 0.4, 0.5, -0.6, 0.7, 0.8], 1),
        (4, [0.1, -0.2, 0.3, 0.4, 0.5, -0.6, 0.7, 0.8], 1),
        (3, None, 2),
        (2, [0.1, None, 0.3, 0.4], 2),
        (1, [0.1, nan, 0.3, 0.4], 2),
        (0, [inf, 0.0, 0.3, 0.4], 2),
        (None, [1e30, -1e30, 3.0], None),
        (None, [], None),
        (7, [-0.0001, 0.0009765625, 0.00097, 1.0, 2.0, 3.0], None),
        (8, [9.0], 3),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS code", "1 AS part", "2 AS key", "3 AS error", "4 AS x", "5 AS state")
    kept, codes, errors, books = plain_codes(rows)
    got = V.vector_code_report(df.repartition(4)).collect()
    total = {}
    for r, e in zip(kept, errors, strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    want = [(r[0], c.hex(), e, total[r[2]]) for r, c, e in zip(kept, codes, errors, strict=True)]
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    flat = [v for book in books for entry in book for v in entry]
    assert {r.codebooks_sha256 for r in got} == {__import__("hashlib").sha256(",".join(map(str, flat)).encode()).hexdigest()}
    assert V.vector_code_report(df.where("vec_id < 4")).count() == 0
    assert V.vector_code_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bounds_stay_below_the_distances():
    rng = np.random.default_rng(2)
    x = rng.integers(-400, 400, (500, 8))
    entries = x[:60].copy()
    bounds, best = V.Bounds.fresh(x, entries, 8)
    looked_at_all = []
    for closest in (8, 8, 5, 12, 12, 4):
        moved = entries + rng.integers(-12, 13, entries.shape)
        moves = np.sqrt(((moved - entries) ** 2).sum(1)) * (1 + V._SLACK)
        entries = moved
        bounds = V.Bounds.unpacked(bounds.packed())
        bounds.after(moves)
        best, looked = bounds.settle(x, entries, closest)
        true = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        assert (bounds.own == true.argmin(1)).all() and (best == true.min(1)).all()
        assert bounds.kept.shape[1] == closest
        real = np.sqrt(true)
        known = bounds.lower < 1e30
        assert (np.where(known, bounds.lower, 0) <= np.take_along_axis(real, bounds.kept, 1)).all()
        for i in range(len(x)):
            rest = np.setdiff1d(np.arange(60), [bounds.own[i], *bounds.kept[i][known[i]]])
            assert bounds.outer[i] <= real[i, rest].min()
        looked_at_all.append((looked > bounds.kept.shape[1]).mean())
    assert looked_at_all[0] < 0.5  # most vectors are settled without all entries


def test_equally_near_entries_go_to_the_lower_index():
    entries = np.array([[4, 0], [0, 0], [2, 2], [2, -2]])
    bounds, best = V.Bounds.fresh(np.array([[2, 0], [1, 1]]), entries, 2)
    assert bounds.own.tolist() == [0, 1] and best.tolist() == [4, 2]
    bounds.own[:], bounds.kept[:], bounds.lower[:] = [[3, 2], [[0, 1], [1, 0]], 0.0]
    best, _ = bounds.settle(np.array([[2, 0], [1, 1]]), entries, 2)
    assert bounds.own.tolist() == [0, 1] and best.tolist() == [4, 2]
