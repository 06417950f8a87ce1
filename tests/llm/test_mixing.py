"""Targets against plain water-filling, and rounding by what it must keep."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from catchment.llm import mixing

SCHEMA = "doc_id long, text string, source string, idx long, n int, size string, target int, extra double, base int"


def docs_of(seed=1, sources=("a", "b", "c", "d", "é", "z", None, ""), n=900):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        source = sources[0] if i % 3 == 0 else sources[int(rng.integers(len(sources)))]
        rows.append((i, " ".join(["wörd"] * int(rng.integers(0, 30))) + "\t\n ", source))
    rows += [(None, None, "a"), (None, "", "b"), (4, "one two", "b"), (4, "one two", "b"), (5, "long " * 20_000, "c"), (6, " x y\x1fz", "tiny"), (7, "", "empty")]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "s", 3, 0.5, 4) for r in rows], SCHEMA).repartition(parts)


def count(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    fixed: dict = {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mix(spark):
    rows = docs_of()
    got = mixing.mix(frame(spark, rows)).collect()
    sizes: dict = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += count(text)
    want = plain_targets(sizes)
    assert Counter((r.doc_id, r.source, r["size"], r.source_size) for r in got) == Counter((i, s, count(t), sizes[s]) for i, t, s in rows)
    taken: dict = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source], abs=1e-6) and r.taken == r.copies * r["size"] <= 3 * r["size"]
        assert r.copies in ((rate := int(want[r.source] / sizes[r.source] + 1e-9)), rate + 1) if sizes[r.source] else r.taken == 0
        taken[r.source] += r.taken
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        longest = max(count(t) for _, t, x in rows if x == s)
        assert abs(taken[s] - want[s]) <= (20 if s != "c" else longest)


def test_reruns_and_other_partitions_agree(spark):
    rows = docs_of(2)
    results = [Counter((r.doc_id, r["size"], r.taken) for r in mixing.mix(frame(spark, rows, p)).collect()) for p in (1, 4, 4)]
    assert results[0] == results[1] == results[2]


def test_tree_of_blocks_keeps_the_sum(spark):
    rng = np.random.default_rng(5)
    items = [("s" if i % 4 else None, int(rng.integers(0, 50)), float(rng.random())) for i in range(600)]
    place, rows = Counter(), []
    many = Counter(s for s, _, _ in items)
    for s, size, p in items:
        rows.append((s, place[s], many[s], size, p, "own"))
        place[s] += 1
    out = mixing.rounded(spark.createDataFrame(rows, "source string, idx long, n long, size long, chance double, more string"), block=8).collect()
    assert len(out) == 600 and {r.more for r in out} == {"own"} and {r.extra for r in out} <= {0, 1}
    for s in ("s", None):
        want = sum(size * p for x, size, p in items if x == s)
        assert abs(sum(r["size"] * r.extra for r in out if r.source == s) - want) <= 50


def test_pivot_keeps_words_and_means():
    size, chance = np.array([50, 30, 30, 7, 0, 7, 1, 1]), np.array([0.3, 0.6, 0.5, 0.9, 0.4, 0.2, 0.5, 0.5])
    mean, n = np.zeros(len(size)), 4000
    for k in range(n):
        left = chance.copy()
        up, hand = mixing.pivot(size, left, np.random.default_rng(k))
        rest = up.astype(float)
        if hand >= 0:
            rest[hand] = left[hand]
        assert size @ rest == pytest.approx(size @ chance) and up[4] == 0
        mean += rest / n
    assert np.abs(mean - chance)[[0, 1, 2, 3, 5, 6, 7]].max() < 0.03


def test_nothing_to_mix(spark):
    assert mixing.mix(frame(spark, docs_of()).limit(0)).count() == 0
    blank = mixing.mix(frame(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert [(r.taken, r.target) for r in blank] == [(0, 0.0)] * 2
