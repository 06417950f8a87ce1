"""Every operator on null ids, repeated rows, very long texts, empty tables and columns with the names that operators use inside."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from catchment.llm import bpe, exact_dedup, fingerprints, near_dedup, packing, pii, quality, similar_dedup, suffix_dedup, token_files, toxicity
from catchment.llm.common import new_dir

SCHEMA = "doc_id long, text string, n long, key string, node long, word long, row long, maybe boolean, size long, fp long, seed string, kind string, share int, start long, x double"
TEXTS = [
    (None, "one two three four five six"), (None, "one two three four five six"), (None, None), (7, None), (7, ""), (7, "seven words that are here for this"), (7, "seven words that are here for this"),
    (1, "a"), (2, "tie one two three four five six"), (3, "tie one two three four five six"), (4, "long " * 300_000), (5, "\u00e9" * 200_000), (6, "w" + " w" * 60_000 + " end"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 1, "k", 2, 3, 4, True, 5, 6, "s", "k", 7, 8, 0.5) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(2).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 8)], "doc_id long, quality int, toxic int")


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


ALL = Counter(i for i, _ in TEXTS)


@pytest.mark.parametrize("run", [
    lambda docs, labels: near_dedup.near_groups(docs),
    lambda docs, labels: similar_dedup.similar_groups(docs),
    lambda docs, labels: exact_dedup.exact_groups(docs),
    lambda docs, labels: fingerprints.edited_pairs(docs),
    lambda docs, labels: pii.replace_entities(docs),
    lambda docs, labels: suffix_dedup.remove_repeats(docs),
    lambda docs, labels: quality.score(docs, labels),
    lambda docs, labels: toxicity.score(docs, labels),
    lambda docs, labels: bpe.round_trip(docs),
    lambda docs, labels: packing.pack_documents(docs).filter("piece = 0"),
], ids=["near", "similar", "exact", "fingerprints", "pii", "suffix", "quality", "toxicity", "bpe", "packing"])
def test_one_row_for_each_row(odd, labels, run):
    assert ids(run(odd, labels)) == ALL
    assert run(odd.limit(0), labels).count() == 0


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_copies, similar_dedup.drop_similar], ids=["exact", "similar"])
def test_copies_go_and_columns_stay(odd, drop):
    left = drop(odd)
    assert left.columns == odd.columns
    texts = Counter(r.text or "" for r in left.collect())
    assert max(texts.values()) == 1 and set(texts) <= {t or "" for _, t in TEXTS}
    assert {t or "" for _, t in TEXTS} - set(texts) <= {"tie one two three four five six"} | ({""} if drop is similar_dedup.drop_similar else set())


def test_classifier_keeps_namesakes_of_rejected_rows(odd, labels):
    """A doc_id with several texts: each row goes or stays by its own score."""
    left = quality.accepted(odd, labels)
    assert left.columns == odd.columns
    scored = quality.score(odd.withColumn("own", odd.text), labels)
    bad = {r.doc_id for r in scored.filter("predicted = 0").collect()}
    assert {i for i, _ in TEXTS} - bad <= set(ids(left)) | {None}


def test_token_files(spark, odd):
    uri = new_dir(spark, "odd")
    manifest = token_files.write_token_files(odd, uri, files=2)
    assert ids(token_files.read_token_files(manifest, uri, with_ids=False)) == ALL
    with pytest.raises(Exception, match="doesn't fit"):
        token_files.write_token_files(odd, new_dir(spark, "narrow"), files=1, width=1)
    empty = token_files.write_token_files(odd.limit(0), new_dir(spark, "none"), files=1)
    assert empty.count() == 0


def test_long_text_is_whole(odd):
    got = {r.doc_id: r for r in exact_dedup.exact_groups(odd).collect() if r.doc_id in (4, 5)}
    for i, t in TEXTS:
        if i in got:
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
