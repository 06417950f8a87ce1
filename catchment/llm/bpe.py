"""Byte-level BPE from a rank file: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the others."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import documents, text_slices
from .vocabulary import WordMemo, default_path, default_pattern

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank; ranks must be 0, 1, 2 ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks are not consecutive")
    return [tokens[i] for i in range(len(tokens))]


def _slots(hashes: np.ndarray, shift: np.ndarray | int, n: int) -> np.ndarray:
    x = (hashes ^ (np.asarray(shift, dtype=np.uint64) * _GOLDEN)) * _MIX
    return ((x >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of n byte strings to 0 .. n - 1, by hash and displace.

    Keys fall into buckets of about four; buckets, largest first, take the first displacement that
    sends their keys to free slots; buckets of one key take the slots that are left, written as
    -1 - slot. Besides the keys it keeps one integer per bucket.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        hashes = self.hashes(keys)
        self.buckets = max(1, n // 4)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        free = np.ones(n, dtype=bool)
        self.key_at = np.full(n, -1, dtype=np.int64)
        block = np.arange(64)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[ends[b] - sizes[b] : ends[b]]
            if len(own) < 2:
                break
            first = 1
            while True:
                slots = _slots(hashes[own][None, :], (first + block)[:, None], n)
                fits = free[slots].all(axis=1) & (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                if fits.any():
                    k = int(np.argmax(fits))
                    break
                first += len(block)
                if first > 1 << 24:
                    raise ValueError("two keys have the same hash")
            self.shift[b] = first + k
            free[slots[k]] = False
            self.key_at[slots[k]] = own
        single = order[ends[np.flatnonzero(sizes == 1)] - 1]
        left = np.flatnonzero(free)
        self.key_at[left] = single
        self.shift[bucket[single]] = -1 - left

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))

    def find(self, keys: list[bytes]) -> np.ndarray:
        """For each string the number of the only key it can be; the caller compares the two."""
        hashes = self.hashes(keys)
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(shift < 0, -1 - shift, _slots(hashes, np.maximum(shift, 0), self.n))
        return self.key_at[slots]


def merge(word: bytes, rank_of: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent parts whose joint bytes have the lowest rank merge first, of equal ones the leftmost.

    Parts are linked by the position of the next and the previous part; a heap holds candidate merges as
    (rank, start); entries whose parts have changed since are passed over.
    """
    n = len(word)
    after = list(range(1, n + 2))
    before = list(range(-1, n))
    get = rank_of.get
    heap = [(rank, i) for i in range(n - 1) if (rank := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    current = {i: rank for rank, i in heap}
    while heap:
        rank, i = pop(heap)
        if current.get(i) != rank:
            continue
        j = after[i]
        k = after[j]
        after[i] = k
        current.pop(j, None)
        if k < n:
            before[k] = i
            new = get(word[i : after[k]])
        else:
            new = None
        if new is None:
            del current[i]
        else:
            current[i] = new
            push(heap, (new, i))
        h = before[i]
        if h >= 0:
            new = get(word[h:k])
            if new is None:
                current.pop(h, None)
            elif current.get(h) != new:
                current[h] = new
                push(heap, (new, h))
    ids = []
    i = 0
    while i < n:
        ids.append(rank_of[word[i : after[i]]])
        i = after[i]
    return ids


class Codec:
    """Encodes and decodes whole texts by the ranks of one file."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.cut = regex.compile(pattern).findall
        self.hash = PerfectHash(tokens)
        self.rank_of = {t: i for i, t in enumerate(tokens)}
        self.memo = WordMemo(self.solve)

    def solve(self, pieces: list[str]) -> list[bytes]:
        words = [p.encode() for p in pieces]
        out = []
        for word, k in zip(words, self.hash.find(words).tolist(), strict=True):
            ids = [k] if self.tokens[k] == word else merge(word, self.rank_of)
            out.append(np.array(ids, dtype="<u4").tobytes())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        pieces = [self.cut(t) for t in texts]
        known = self.memo.ready(set().union(*pieces))
        return [b"".join(map(known.__getitem__, x)) for x in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec for the file; built once, its size bounded by the vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_texts(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) with the ids of docs(doc_id, text, ...) as an array of integers. Null texts count as empty; no shuffle; each row by itself, so repeats and ties need no rule."""
    path, pattern = path or default_path("byte_bpe_multi_50k.tiktoken"), pattern or default_pattern()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for ids, texts in text_slices(batches):
            encoded = own.encode([t.decode() for t in texts.to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in encoded])]).astype(np.int32)
            values = np.frombuffer(b"".join(encoded), dtype="<i4")
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(values))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, bytes) for encoded(doc_id, ids); null ids give no bytes."""
    path, pattern = path or default_path("byte_bpe_multi_50k.tiktoken"), pattern or default_pattern()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            decoded = [own.decode(np.asarray(x.values)) if x.is_valid else b"" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes those ids, in one pass, and returns digests of both only.

    Null texts count as empty, null ids and repeated rows are rows like others, no rows give no rows. A long text is split and encoded whole by one task.
    """
    path, pattern = path or default_path("byte_bpe_multi_50k.tiktoken"), pattern or default_pattern()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for ids, texts in text_slices(batches):
            encoded = own.encode([t.decode() for t in texts.to_pylist()])
            n = [len(x) // 4 for x in encoded]
            first = [hashlib.sha256(x).hexdigest() for x in encoded]
            second = [hashlib.sha256(own.decode(np.frombuffer(x, dtype="<u4"))).hexdigest() for x in encoded]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
