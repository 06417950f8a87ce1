from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from catchment.llm import queries, suffix_dedup
from catchment.llm.common import documents


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randrange(0, 60)
        text = bytes(rng.choices(rng.choice([b"a", b"ab", b"abc", bytes(range(256))]), k=n))
        assert suffix_dedup.suffix_array(text) == sorted(range(n), key=lambda i: text[i:])


def brute(rows, length):
    """rows: (doc_id, bytes) in document order."""
    seen = set()
    out = []
    for doc_id, b in rows:
        removed = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                removed[i : i + length] = b"\1" * length
            seen.add(s)
        n = sum(removed[i] and not (i and removed[i - 1]) for i in range(len(b)))
        kept = bytes(c for c, r in zip(b, removed, strict=True) if not r)
        out.append((doc_id, len(b), sum(removed), n, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def ordered(df):
    rows = df.select("doc_id", "text").collect()
    return [(r.doc_id, (r.text or "").encode()) for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))]


def result(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


@pytest.mark.parametrize(("length", "gram", "limit", "words"), [(20, 8, 4096, 1 << 12), (20, 8, 2, 4), (7, 3, 4096, 1 << 12), (100, 32, 4096, 1 << 20)])
def test_against_brute_force(spark, mixed, length, gram, limit, words):
    rng = random.Random(length)
    parts = ["".join(rng.choices("abcd é", k=rng.randrange(5, 160))) for _ in range(12)]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(0, 6))) for _ in range(60)] + ["ab" * 300, "x" * 500, None, ""]
    made = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3, "doc_id").persist()
    for docs in (made, mixed):
        assert result(suffix_dedup.remove_repeats(docs, length, gram, words, limit)) == brute(ordered(docs), length)


def test_nothing(spark, nothing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_op9_on_the_table(spark, sf):
    assert result(queries.QUERIES["op9_suffix_dedup"](spark, sf)) == brute(ordered(documents(spark, sf)), 100)


def test_a_text_longer_than_a_slice(spark):
    """Texts of several slices, with repeats inside, across slices and between documents; the brute force holds all strings."""
    rng = random.Random(3)
    line = lambda: bytes(rng.choices(b"abcdefghijklmnop", k=150)).decode() + "é\n"
    lines = [line() for _ in range(9000)]
    long = "".join(lines[:8000] + lines[100:110] + lines[7990:] + lines[:20])
    assert len(long.encode()) > suffix_dedup.SLICE
    docs = spark.createDataFrame([(1, long), (2, "".join(lines[8500:8520])), (3, "x" + long[5000:7000])], "doc_id long, text string").persist()
    assert result(suffix_dedup.remove_repeats(docs)) == brute(ordered(docs), 100)
