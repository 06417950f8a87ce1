"""The manifest and its proofs against a plain recursive computation."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest

from catchment.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx long, n int, leaf string, presented string, part int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], r[3], text)])


def tree(nodes):
    """[(siblings by level as (before, behind))] of each leaf, and the root."""
    if len(nodes) == 1:
        return [[]], nodes[0]
    runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
    above, root = tree([h(*r) for r in runs])
    return [[("".join(r[:j]), "".join(r[j + 1 :])), *above[i]] for i, r in enumerate(runs) for j in range(len(r))], root


def plain(rows):
    """The contract's columns of each row, by brute force."""
    small = str.maketrans(merkle.UPPER, merkle.LOWER)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {lang: sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for lang in langs}
    trees = {lang: tree([leaf(r, r[4]) for r in own[lang]]) for lang in langs}
    tops, root = tree([trees[lang][1] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for r, steps in zip(own[lang], trees[lang][0], strict=True):
            steps = [*steps, *tops[k]]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r, r[4].translate(small) if bad and r[4] is not None else r[4])
            for a, b in steps:
                node = h(a, node, b)
            out.append((r[0], leaf(r, r[4]), trees[lang][1], root, h(*[a + b for a, b in steps]), node, node == root))
    return out


def rows_of(n, langs):
    rows = [(i, f"s{i % 3}" if i % 11 else None, langs[i * i % len(langs)], i * 7 if i % 13 else None, f"Text {i} Ünïcode" if i % 17 else None) for i in range(n)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (5, "s", "en", 1, "again"), (5, "s", "en", 1, "again"), (5, "s", "en", 2, ""), (9, "x", "zz", 1, "Ab" * 400_000), (-4, "x", "", 0, "NEGATIVE id")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "=en", 3, 4, "f", "p", 6) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def big(spark):
    rows = rows_of(1400, ["en", "en", "en", None, "de", *(f"l{i}" for i in range(8))])
    return rows, merkle.manifest(frame(spark, rows), presented=merkle.tampered())


def test_every_column_equals_brute_force(big):
    rows, m = big
    got = Counter(tuple(r) for r in merkle.proofs(m).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert got == Counter(plain(rows))


def test_proofs_of_some_leaves_hold(big):
    rows, m = big
    asked = m.leaves.filter("idx % 37 = 5 OR doc_id = 9").withColumn("presented", merkle.F.lit(None).cast("binary"))
    got = merkle.proofs(m, asked, siblings=True).collect()
    whole = {(r.tree, r.idx): r for r in merkle.proofs(m).collect()}
    assert len(got) == asked.count() > 10
    for r in got:
        assert r.verified and r.root == m.root and r.proof_sha256 == whole[r.tree, r.idx].proof_sha256 == h(*r.siblings)


def test_fewest_nodes():
    for n in (1, 2, 8, 9, 64, 65, 700):
        for places in ([0], [n - 1], list(range(0, n, 3)), list(range(n))):
            lacked = list(merkle.lacking(places, n))
            assert len(lacked) == len(set(lacked))
            reached, width, level = set(places), n, 0
            while width > 1:
                # A run with a known member needs all its others, and no other run needs any.
                need = {j for i in reached for j in range(i // 8 * 8, min(i // 8 * 8 + 8, width))} - reached
                assert {j for at, j in lacked if at == level} == need
                reached, width, level = {i // 8 for i in reached}, -(-width // 8), level + 1
            assert not [x for x in lacked if x[0] >= level]
    assert not list(merkle.lacking(range(700), 700))


def test_few_rows(spark):
    for rows in ([(1, "s", "en", 1, "One")], [(1, "s", "en", 1, "One"), (2, "s", "de", 1, "TWO")], [(3, None, None, None, None)] * 9):
        m = merkle.manifest(frame(spark, rows), presented=merkle.tampered())
        assert Counter(tuple(r) for r in merkle.proofs(m).drop("tree", "idx", "siblings").collect()) == Counter(plain(rows))
    none = merkle.manifest(frame(spark, [(1, "s", "en", 1, "x")]).limit(0))
    assert none.root is None and merkle.proofs(none).count() == 0
