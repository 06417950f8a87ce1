"""Vector codes against plain integers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catchment.llm import vector_codes as vc


@given(st.integers(1, 20), st.integers(1, 40), st.integers(1, 30), st.integers(0, 1000), st.sampled_from([1, 3, 2**26]))
@settings(max_examples=60, deadline=None)
def test_nearest_is_exact(width, rows, entries, seed, high):
    rng = np.random.default_rng(seed)
    parts, books = rng.integers(-high, high + 1, (rows, width)), rng.integers(-high, high + 1, (entries, width))
    number, distance = vc.nearest(parts, books)
    full = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)) for e in books] for p in parts]
    assert number.tolist() == [row.index(min(row)) for row in full] and distance.tolist() == [min(row) for row in full]


def test_transform_counts_changes_of_sign():
    for size in (1, 2, 8, 64):
        basis = vc.transform(np.eye(size, dtype=np.int64), size)
        assert [(np.diff(np.sign(basis[:, k])) != 0).sum() for k in range(size)] == list(range(size))
        assert (basis @ basis.T == size * np.eye(size, dtype=np.int64)).all()


def plain(rows, rounds=4, entries=256):
    """(code, error) of kept rows by id, and the books."""
    kept = sorted(((i, [math.floor(1024 * x) for x in v]) for i, v in rows), key=lambda r: ((r[0] is None, r[0] or 0), r[1]))
    width = max(1, -(-max(len(v) for _, v in kept) // 4))
    parts = [[v + [0] * (4 * width - len(v)) for _, v in kept]][0]
    cut = [[v[p * width : (p + 1) * width] for v in parts] for p in range(4)]
    books = [[list(x) for x in cut[p][:entries]] for p in range(4)]

    def near(x, book):
        all_ = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return all_.index(min(all_)), min(all_)

    for _ in range(rounds):
        for p in range(4):
            members: dict[int, list] = {}
            for x in cut[p]:
                members.setdefault(near(x, books[p])[0], []).append(x)
            for e, xs in members.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for k, (i, _) in enumerate(kept):
        found = [near(cut[p][k], books[p]) for p in range(4)]
        out.append((i, "".join(f"{n:02x}" for n, _ in found), sum(d for _, d in found)))
    return out, books


SCHEMA = "vec_id long, embedding array<float>, label int, code string, part int"


def test_codes_equal_plain_integers(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(0, 0.2, 12).astype(np.float32).tolist()) for i in range(400)]
    vectors += [(7, vectors[7][1]), (None, vectors[3][1]), (500, [0.5] * 12), (501, [-0.25] * 5), (502, [])]
    bad = [(600, None), (601, [0.1, None] * 6), (602, [float("nan")] * 12), (603, [float("inf")] * 12)]
    rows = spark.createDataFrame([(i, v, 1 if (i or 0) % 3 == 0 else None, "c", 9) for i, v in vectors + bad], SCHEMA).repartition(5)
    out, books = vc.compress(rows)
    want, want_books = plain(vectors)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = [(r.vec_id, r.code, r.error) for r in out.collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and books.tolist() == want_books
    assert set(out.columns) == {"vec_id", "label", "code", "error", "part"}


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors_are_their_own_entries(spark, n):
    rows = spark.createDataFrame([(i, [float(i), 1e30, -3.0, 0.0, 2.0], 1, "c", 9) for i in range(n)], SCHEMA)
    out, books = vc.compress(rows)
    got = out.orderBy("vec_id").collect()
    assert [r.error for r in got] == [0] * n and books.shape[:2] == (4, n)
    assert [r.code[:2] for r in got] == [f"{i:02x}" for i in range(n)]
