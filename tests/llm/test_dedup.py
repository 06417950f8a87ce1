from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from catchment.llm import exact_dedup, near_dedup, queries
from catchment.llm.common import documents
from catchment.llm.components import connected_components


def groups_of(docs):
    by = defaultdict(list)
    for r in docs.collect():
        by[hashlib.sha256((r.text or "").encode()).hexdigest()].append(r.doc_id)
    return by


@pytest.mark.parametrize("words", [1, 64, 1 << 20])
def test_exact_groups(spark, mixed, words):
    want = Counter()
    kept = Counter()
    for h, ids in groups_of(mixed).items():
        for d in ids:
            want[d, max(ids), len(ids), h] += 1
        kept[max(ids)] += 1
    got = exact_dedup.exact_groups(mixed, words).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.doc_id for r in got if r.kept) == kept
    rest = exact_dedup.drop_exact_copies(mixed, words)
    assert rest.columns == mixed.columns and Counter(r.doc_id for r in rest.collect()) == kept


def test_exact_dedup_shuffles_only_what_may_repeat(spark):
    rows = [(i, f"text {i}") for i in range(4000)] + [(5000 + i, "same") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "sha2(text, 256) AS sha")
    seen = exact_dedup.maybe_repeated(docs, exact_dedup.repeat_filter(docs))
    maybe = [r.doc_id for r in seen.filter("maybe").collect()]
    assert {5000 + i for i in range(10)} <= set(maybe) and len(maybe) < 40


def test_dedup_of_nothing(spark, nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert exact_dedup.drop_exact_copies(nothing).count() == 0
    assert near_dedup.near_groups(nothing).count() == 0


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 300, size=(200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (900, 900)] + [(2000, 2001 + i) for i in range(50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == brute_components(pairs, {x for p in pairs for x in p})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_simhash(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def check_near(docs, got):
    fps = {r.doc_id: plain_simhash(r.text or "") for r in docs.collect()}
    ids = sorted(fps)
    array = np.array([fps[i] for i in ids], dtype=np.uint64)
    pairs = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 2).tolist() if j > i]
    want = brute_components(pairs, ids)
    assert Counter((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got) == Counter((r.doc_id, f"{fps[r.doc_id]:016x}", want[r.doc_id]) for r in docs.select("doc_id").collect())
    return want


def test_near_groups(spark, mixed, sf):
    check_near(mixed, near_dedup.near_groups(mixed).collect())
    docs = documents(spark, sf)
    check_near(docs, near_dedup.near_groups(docs).collect())


@pytest.mark.parametrize("limit", [1, 2, 5, 512])
def test_links_lose_nothing_at_any_limit(spark, limit):
    rng = np.random.default_rng(limit)
    values = set()
    for _ in range(25):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            values.add(x)
            x ^= 1 << int(rng.integers(0, 64))
            if rng.random() < 0.6:
                x ^= 1 << int(rng.integers(0, 64))
    values |= {int(v) for v in rng.integers(0, 1 << 63, size=100)} | {0, (1 << 64) - 1, 1 << 63}
    nodes = sorted(values)
    array = np.array(nodes, dtype=np.uint64)
    pairs = [(nodes[i], nodes[j]) for i in range(len(nodes)) for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 2).tolist() if j > i]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    found = near_dedup.links(spark.createDataFrame([(signed(v),) for v in nodes], "fp long"), limit).collect()
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in found]
    assert brute_components(found, nodes) == brute_components(pairs, nodes)


def test_anchor_replicas(spark):
    fps = spark.createDataFrame([(v,) for v in (0, 12345678901234567, -5)], "fp long")
    n = {r.fp: r["count"] for r in near_dedup.anchors(fps).groupBy("fp").count().collect()}
    assert n[0] == 2 and all(2 <= c <= 32 for c in n.values())


def test_registered(spark, sf):
    import duckdb

    got = Counter(tuple(r) for r in queries.QUERIES["op6_exact_dedup"](spark, sf).collect())
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == Counter(duckdb.sql(queries.ORACLE_SQL["op6_exact_dedup"]).fetchall())
    assert {len(r.fingerprint) for r in queries.QUERIES["op2_simhash"](spark, sf).collect()} == {16}
