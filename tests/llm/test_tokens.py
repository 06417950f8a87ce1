from __future__ import annotations

import hashlib
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from catchment.llm import bpe, packing, queries, token_files
from catchment.llm.common import documents, new_dir


def library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return t


def encoded(df, end):
    t = library()
    rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    return [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, end]) for r in rows]


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def test_token_files_match_the_library(spark, mixed):
    uri = new_dir(spark, "tokens")
    manifest = token_files.write_token_files(mixed, uri, files=3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, r.ids) for r in token_files.read_token_files(manifest, uri).collect())
    start = 0
    for (s, d, n, c, ids), (doc_id, want) in zip(got, encoded(mixed, 0), strict=True):
        assert (s, d, n, c, ids) == (start, doc_id, len(want), crc(want), want)
        start += n


def test_token_files_read_only_what_is_wanted(spark, mixed):
    uri = new_dir(spark, "tokens")
    manifest = token_files.write_token_files(mixed, uri, files=3)
    wanted = spark.createDataFrame([(9,), (60,), (10_000_000,)], "doc_id long")
    got = {r.doc_id: r.ids for r in token_files.read_token_files(manifest, uri, wanted).collect()}
    want = {d: x for d, x in encoded(mixed, 0) if d in (9, 60)}
    assert got == want


def test_token_file_frames_are_independent_and_checked(tmp_path):
    import zstandard

    path = tmp_path / "x.zst"
    with open(path, "wb") as f:
        w = token_files.FileWriter(f, 2)
        for i in range(5):
            w.add(i if i else None, np.arange(i * 10))
        w.close()
    with open(path, "rb") as f:
        r = token_files.FileReader(f)
        assert r.nulls.tolist() == [1, 0, 0, 0, 0] and r.starts.tolist() == [0, 0, 10, 30, 60, 100]
        assert r.ids(3).tolist() == list(range(30))
    data = bytearray(path.read_bytes())
    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(bytes(data), read_across_frames=True).read() for _ in range(1))
    assert plain == b"".join(np.arange(i * 10).astype("<u2").tobytes() for i in range(5))
    start = int(r.offsets[2])
    data[start + 8] ^= 0xFF
    path.write_bytes(data)
    with open(path, "rb") as f, pytest.raises(Exception):
        token_files.FileReader(f).ids(2)


def test_empty_tables(spark, nothing):
    uri = new_dir(spark, "tokens")
    manifest = token_files.write_token_files(nothing, uri, files=2)
    assert token_files.read_token_files(manifest, uri).count() == 0
    assert packing.pack_documents(nothing).count() == 0
    assert bpe.round_trip(nothing).count() == 0


def test_null_ids_come_first(spark):
    docs = spark.createDataFrame([(None, "a b"), (2, None), (1, "c")], "doc_id long, text string")
    uri = new_dir(spark, "tokens")
    got = token_files.read_token_files(token_files.write_token_files(docs, uri, files=2), uri).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2] and [r.start for r in got] == [0, 3, 5]


def test_op1_on_the_table(spark, sf):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op1_token_files"](spark, sf).collect()}
    start = 0
    for doc_id, ids in encoded(documents(spark, sf), 0):
        assert got[doc_id] == (start, len(ids), crc(ids))
        start += len(ids)


def test_perfect_hash_is_minimal_and_perfect():
    keys = [b"", *(hashlib.md5(bytes([i % 256, i // 256])).digest()[: 1 + i % 9] for i in range(3000))]
    keys = list(dict.fromkeys(keys))
    h = bpe.PerfectHash(keys)
    assert sorted(h.key_at.tolist()) == list(range(len(keys)))
    assert h.find(keys).tolist() == list(range(len(keys)))
    assert all(0 <= k < len(keys) for k in h.find([b"absent", b"\xff" * 50]))


def test_bpe_matches_tiktoken(spark, mixed, sf):
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (mixed, documents(spark, sf)):
        texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
        want = Counter()
        for (d, t), n in texts.items():
            ids = own.encode_ordinary(t)
            want[d, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += n
        assert Counter(tuple(r) for r in bpe.round_trip(docs).collect()) == want
    back = bpe.decode_ids(bpe.encode_texts(mixed))
    assert sorted((r.doc_id, bytes(r.bytes)) for r in back.collect()) == sorted((r.doc_id, (r.text or "").encode()) for r in mixed.collect())


def test_heap_merge_equals_repeated_search():
    tokens = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    rank_of = {t: i for i, t in enumerate(tokens)}

    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            best = min(((rank_of[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank_of), default=None)
            if best is None:
                return [rank_of[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = np.random.default_rng(3)
    for _ in range(400):
        word = bytes(rng.choice(list(b"abcdeationghrs \xc3\xa9"), size=rng.integers(1, 40)).tolist())
        assert bpe.merge(word, rank_of) == plain(word)


def check_packing(rows, want, capacity):
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in at.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(n for _, n in spans) <= capacity
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    expected = Counter()
    for d, ids in want:
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[d, k, a, b - a, crc(ids[a:b])] += 1
    assert pieces == expected
    return len(at)


def test_packing(spark, mixed, sf):
    for docs in (mixed, documents(spark, sf)):
        want = encoded(docs, 2)
        n = check_packing(packing.pack_documents(docs).collect(), want, 1024)
        assert n <= -(-sum(len(x) for _, x in want) // 1024) * 1.01 + 1


def test_plan_uses_each_length_as_often_as_it_occurs():
    rng = np.random.default_rng(5)
    for capacity in (1, 7, 64):
        counts = {n: int(rng.integers(0, 30)) for n in range(1, capacity + 1)}
        used = Counter()
        for combo, times in packing.plan(dict(counts), capacity):
            assert sum(combo) <= capacity and times > 0
            for n in combo:
                used[n] += times
        assert {n: c for n, c in counts.items() if c} == dict(used)
