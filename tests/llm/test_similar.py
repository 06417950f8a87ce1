from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catchment.llm import similar_dedup


def planted():
    """Base texts of invented words with one to thirty edits, chains of edits, and rows of few or no words."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for n in (40, 80, 200, 200, 400):
        base = rng.choices(words, k=n)
        for edits in (0, 1, 1, 2, 3, 4, 5, 6, 8, 12, 20, 30):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(n)] = rng.choice(words)
            texts.append(" ".join(t))
    chain = rng.choices(words, k=150)
    for _ in range(40):
        texts.append(" ".join(chain))
        chain[rng.randrange(150)] = rng.choice(words)
    line = " ".join(rng.choices(words, k=30))
    texts += [line + " " + " ".join(rng.choices(words, k=rng.randrange(5, 90))) for _ in range(60)]
    return [None, "", " ", "one", "One", "two words", *texts]


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                n += a != b
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert n > 100
    return {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("pairwise", [similar_dedup.PAIRWISE, 4])
def test_similar_groups_equal_brute_force(spark, pairwise):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar_dedup.similar_groups(docs, pairwise).collect()}
    assert got == components(texts)


def test_pipeline_stage_takes_five_words_and_four_fifths(spark, sf):
    texts = planted()
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, first long")
    rest = corpus_pipeline.without_near_copies(spark, docs, sf)
    assert rest.columns == docs.columns and {r.doc_id for r in rest.collect()} == set(components(texts).values())


def test_no_rows(spark, nothing):
    assert similar_dedup.drop_similar(nothing).count() == 0


def kinds():
    """400 pairs of each kind of copy that have a similarity of 0.8 or more over five words."""
    rng = random.Random(17)
    words = [f"w{i}" for i in range(30_000)]
    common = [f"c{i}" for i in range(300)]

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)]

    made = {k: [] for k in ("footer", "header", "cut", "replaced", "joined", "few words")}
    for _ in range(400):
        n = rng.randrange(40, 400)
        t = prose(n)
        made["footer"].append((t, t + prose(n // 6)))
        made["header"].append((t, prose(n // 6) + t))
        made["cut"].append((t, t[: int(n * 0.84)]))
        edited = list(t)
        for i in rng.sample(range(n), max(1, n // 60)):
            edited[i] = rng.choice(words)
        made["replaced"].append((t, edited))
        middle = n // 2
        made["joined"].append((t, t[:middle] + prose(n // 8) + t[middle:]))
        few = rng.sample(words, 8) * (n // 8)
        made["few words"].append((few, few + [few[0], *few[1:3]]))
    return made


@pytest.mark.parametrize("kind", ["footer", "header", "cut", "replaced", "joined", "few words"])
def test_candidates_of_each_kind_of_copy(kind):
    """Of the pairs of 0.8 or more, at least 99 % meet at an anchor."""
    met = total = 0
    for a, b in kinds()[kind]:
        x, y = (similar_dedup.shingles([w.encode() for w in t]) for t in (a, b))
        if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)):
            total += 1
            met += bool(set(similar_dedup.anchors(similar_dedup.fingerprint(x))) & set(similar_dedup.anchors(similar_dedup.fingerprint(y))))
    assert total > 300 and met >= 0.99 * total


def test_anchor_is_the_word_of_the_code_within_one_bit():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 31, similar_dedup.PARTS)
    home = similar_dedup.anchors(words)
    assert (home >> 32).tolist() == list(range(similar_dedup.PARTS))
    for k, (w, anchor) in enumerate(zip(words.tolist(), (home & 0xFFFFFFFF).tolist(), strict=True)):
        assert (w ^ anchor).bit_count() <= 1
        for bit in range(31):
            near = similar_dedup.anchors(np.full(similar_dedup.PARTS, anchor ^ (1 << bit)))
            assert near[k] & 0xFFFFFFFF == anchor


def test_fingerprint_of_few_and_many_items():
    assert len(similar_dedup.fingerprint(np.array([], dtype=np.uint64))) == 0
    items = np.random.default_rng(2).integers(0, 1 << 63, 70_000).astype(np.uint64)
    whole = similar_dedup.fingerprint(items)
    assert np.array_equal(whole, similar_dedup.fingerprint(items[::-1])) and len(similar_dedup.fingerprint(items[:1])) == similar_dedup.PARTS + similar_dedup.SMALL_PARTS and len(whole) == similar_dedup.PARTS


def test_no_pair_is_lost_at_a_crowded_anchor(spark, monkeypatch):
    """All texts at one anchor, with more members than are compared pairwise: the pairs are those of brute force though none shares a second anchor."""
    own = similar_dedup.described
    monkeypatch.setattr(similar_dedup, "described", lambda docs: own(docs).withColumn("keys", F.array(F.lit(7).cast("long"))))
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar_dedup.similar_groups(docs, 4).collect()}
    assert got == components(texts)


def test_unlike_copies_of_one_text_are_not_paired(spark, monkeypatch):
    """Copies of one text with up to twelve edits, most too unlike each other to be linked: few of the pairs that share an anchor are judged, and none is lost."""
    rng = random.Random(29)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=150)
    texts = []
    for i in range(400):
        t = list(base)
        for at in rng.sample(range(150), i % 13):
            t[at] = rng.choice(words)
        texts.append(" ".join(t))
    seen, own = [], similar_dedup._judged

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return own(pairs, *rest)

    monkeypatch.setattr(similar_dedup, "_judged", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar_dedup.similar_groups(docs).collect()}
    assert got == components(texts) and sum(seen) < 20 * len(texts)
