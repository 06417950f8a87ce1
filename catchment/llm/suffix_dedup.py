"""Repeated byte strings found by suffix arrays, built by linear grouping, over contexts that share a minimizer."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_groups, perhaps, staged

#: Bytes of a repeated string and of a minimizer.
LENGTH, GRAM = 100, 64
#: Bytes of contexts that one suffix array is built over; and contexts of one minimizer that it takes.
BLOCK, GROUP_LIMIT = 1 << 17, 4096
#: Bytes of text hashed at a time; the hashes take some seventy times as much memory.
SLICE = 1 << 20
#: Most 64-bit words of the Bloom filter of minimizers that occur twice (32 MB), and such minimizers to a word below that.
FILTER_WORDS, PER_WORD = 1 << 22, 4
#: Runs that a task gathers before it combines and deals them.
HELD = 400_000
_LOWEST = -(1 << 63)

_RANDOM = np.random.default_rng(20240601)
_VALUE = _RANDOM.integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + _RANDOM.integers(0, 2, size=256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes from each position, by doubling."""
    power = lambda e: np.uint64(pow(_BASE, e, 1 << 64))
    level, size = _VALUE[data], 1
    out, done = None, 0
    while True:
        if gram & size:
            if out is None:
                out = level
            else:
                rest = level[done:]
                n = min(len(out), len(rest))
                out = out[:n] * power(size) + rest[:n]
            done += size
        if size * 2 > gram:
            break
        level = level[:-size] * power(size) + level[size:]
        size *= 2
    return _mixed(out[: max(0, len(data) - gram + 1)])


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]))
        both = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _powers = (both[0], both[1])
    return _powers


def minimizers(data: np.ndarray, doc: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(minimizer, context hash, first start, number of starts, place of the minimizer behind the first start) of the runs of strings that share a minimizer.

    data holds the bytes of several documents, doc the number of each byte's document. Every string
    of `length` bytes within a document has one minimizer: its gram with the least hash, the leftmost of equal ones. It depends
    on the string alone, so all occurrences of a string have it at the same place. Consecutive strings with the same one make a run;
    its context is all their bytes, `length` - 1 more than starts.
    """
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    n = len(data) - length + 1
    if n < 1:
        return empty
    h = _gram_hashes(data, gram)
    low = np.uint64(max(24, len(data).bit_length()))
    key = (h >> low << low) | np.arange(len(h), dtype=np.uint64)
    window, size = length - gram + 1, 1
    best = key
    while size * 2 <= window:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < window:
        best = np.minimum(best[: len(best) - (window - size)], best[window - size :])
    at = (best & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)[:n]
    whole = doc[:n] == doc[length - 1 :]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([starts, [n]]))
    keep = whole[starts]
    starts, sizes = starts[keep], sizes[keep]
    up, down = _power_tables(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * up[: len(data)], dtype=np.uint64)])
    context = _mixed((sums[starts + sizes + length - 1] - sums[starts]) * down[starts] + sizes.astype(np.uint64))
    # The least hashes crowd at the low end; mixed again they spread evenly over parts and filter words.
    return _mixed(~h[at[starts]]), context, starts, sizes, at[starts] - starts


def suffix_array(text: bytes) -> list[int]:
    """The starts of all suffixes of text in ascending order.

    Every suffix starts with a longest Lyndon word, which ends where the next smaller suffix starts.
    From right to left, a suffix takes in the Lyndon words behind it as long as they are greater
    than its own, and becomes their previous smaller suffix. Suffixes of one Lyndon word form a group; groups,
    taken in descending order of their words, get their places from the end of the array. Within a group the suffixes
    behind the words decide: the places are emitted in ascending order, and every suffix emitted
    puts those whose word ends at it, found along previous-smaller pointers, next in their groups. Nothing is
    renamed or sorted recursively.
    """
    n = len(text)
    after = [n] * n
    smaller = [-1] * n
    for i in range(n - 1, -1, -1):
        j = i + 1
        own = text[i]
        while j < n:
            other = text[j]
            if own > other:
                break
            k = after[j]
            if own == other and text[i:j] >= text[j:k]:
                break
            smaller[j] = i
            j = k
        after[i] = j
    words = [text[i:j] for i, j in enumerate(after)]
    sizes = Counter(words)
    number: dict[bytes, int] = {}
    place: list[int] = []
    end = n
    for w in sorted(sizes, reverse=True):
        end -= sizes[w]
        number[w] = len(place)
        place.append(end)
    group = list(map(number.__getitem__, words))
    del words, sizes, number
    out = [n] * n
    q = n - 1
    while q >= 0:
        g = group[q]
        at = place[g]
        out[at] = q
        place[g] = at + 1
        q = smaller[q]
    for p in out:
        q = p - 1
        while q >= 0 and after[q] == p:
            g = group[q]
            at = place[g]
            out[at] = q
            place[g] = at + 1
            q = smaller[q]
    return out


def _same_strings(data: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For each neighbouring pair of sa whether `length` bytes agree, eight at a time, only pairs that agreed so far."""
    step = min(8, length)
    words = np.zeros(len(data) - step + 1, dtype=np.uint64)
    for i in range(step):
        words = (words << np.uint64(8)) | data[i : i + len(words)]
    pairs = np.arange(len(sa) - 1)
    for offset in [*range(0, length - step, step), length - step]:
        left, right = sa[pairs] + offset, sa[pairs + 1] + offset
        pairs = pairs[words[left] == words[right]]
    same = np.zeros(len(sa) - 1, dtype=bool)
    same[pairs] = True
    return same


def repeated_starts(contexts: list[bytes], starts: list[int], behind: list[int], order: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """For each context, which of its first `starts` strings of `length` bytes also starts earlier, in another context.

    order (n, 3) tells what is earlier: document order, row and place of the context's first string.
    Every string holds the whole minimizer, which stands `behind` the context's start; one greatest letter takes its
    place, so contexts and strings are `gram` - 1 shorter, and strings of different minimizers are told apart by a number. One
    suffix array is built over all contexts, each after a zero byte, all other bytes one up (UTF-8 has no 255), the
    greatest context first so that no Lyndon word runs on into the next. Neighbours in the array that agree
    in a whole string are occurrences of one string; all but the earliest of a minimizer are marked.
    """
    numbers: dict[bytes, int] = {}
    own_gram = np.array([numbers.setdefault(c[b : b + gram], len(numbers)) for c, b in zip(contexts, behind, strict=True)], dtype=np.int64)
    contexts = [c[:b].translate(_UP) + b"\xff" + c[b + gram :].translate(_UP) for c, b in zip(contexts, behind, strict=True)]
    short = length - gram + 1
    by = sorted(range(len(contexts)), key=contexts.__getitem__, reverse=True)
    text = b"".join(b"\0" + contexts[i] for i in by) + b"\0" * short
    sa = np.array(suffix_array(text[:-short]), dtype=np.int64)
    sizes = np.array([len(contexts[i]) + 1 for i in by])
    begins = np.cumsum(sizes) - sizes + 1
    owner = np.full(len(text), -1, dtype=np.int64)
    for i, b in zip(by, begins.tolist(), strict=True):
        owner[b : b + starts[i]] = i
    first = np.empty(len(contexts), dtype=np.int64)
    first[by] = begins
    sa = sa[owner[sa] >= 0]
    if not len(sa):
        return [np.zeros(n, dtype=bool) for n in starts]
    same = _same_strings(np.frombuffer(text, dtype=np.uint8), sa, short)
    run = np.concatenate([[0], np.cumsum(~same)])
    own = owner[sa]
    ranked = np.lexsort((order[own, 2] + sa - first[own], order[own, 1], order[own, 0], own_gram[own], run))
    later = np.concatenate([[False], (run[ranked][1:] == run[ranked][:-1]) & (own_gram[own][ranked][1:] == own_gram[own][ranked][:-1])])
    marked = np.zeros(len(text), dtype=bool)
    marked[sa[ranked[later]]] = True
    return [marked[b : b + n] for b, n in zip(first.tolist(), starts, strict=True)]


_UP = bytes(min(255, b + 1) for b in range(256))

#: A run: hash of minimizer and context, minimizer, document order, row, first start, number of starts, place of the minimizer.
_RUN = np.dtype([("c", "<u8"), ("m", "<u8"), ("k", "<i8"), ("row", "<i8"), ("at", "<i4"), ("starts", "<u2"), ("behind", "<u2")])
_SPAN = np.dtype([("row", "<i8"), ("begin", "<i8"), ("end", "<i8")])
_HEAD = "kind int, part int, data binary, m long, k long, row long, at int, starts int, behind int"


def _rows(docs: DataFrame) -> DataFrame:
    """(row, k, text): rows get a number that stays the same each time the table is read; k orders them, null ids first."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce("doc_id", F.lit(_LOWEST)).alias("k"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _slices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(rows, orders, offsets, texts) of about SLICE bytes; a longer text comes in pieces that overlap by length - 1 bytes."""
    for batch in batches:
        rows, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def taken(held=held, rows=rows, keys=keys):
            which = np.array([i for i, _, _ in held], dtype=np.int64)
            return rows[which], keys[which], np.array([o for _, o, _ in held], dtype=np.int64), [t for _, _, t in held]

        for i, text in enumerate(batch.column(2)):
            text = text.as_py()
            for offset in range(0, max(1, len(text) - length + 1), SLICE):
                piece = text if len(text) <= SLICE else text[offset : offset + SLICE + length - 1]
                if held and size + len(piece) > SLICE:
                    yield taken()
                    held.clear()
                    size = 0
                held.append((i, offset, piece))
                size += len(piece)
        if held:
            yield taken()


def _found_runs(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[np.ndarray]:
    """All runs of the documents (row, k, text) as _RUN records, a slice at a time; see minimizers."""
    for rows, keys, offsets, texts in _slices(batches, length):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        m, context, at, starts, behind = minimizers(data, np.repeat(np.arange(len(texts), dtype=np.int64), sizes), length, gram)
        begins = np.cumsum(sizes) - sizes
        own = np.searchsorted(begins, at, "right") - 1
        out = np.empty(len(m), dtype=_RUN)
        out["m"], out["c"] = m, _mixed(context ^ (m << np.uint64(1)))
        out["k"], out["row"], out["at"] = keys[own], rows[own], at - begins[own] + offsets[own]
        out["starts"], out["behind"] = starts, behind
        yield out


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash, in the order of the hashes."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _dealt(records: np.ndarray, part: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, bytes) of the records of each part that has any."""
    by = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")
    edges = np.searchsorted(part[by], np.arange(parts + 1))
    records = records[by]
    for p in np.flatnonzero(np.diff(edges)).tolist():
        yield p, records[edges[p] : edges[p + 1]].tobytes()


def _blobs(kind: int, dealt: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(dealt), pa.int32()), pa.array([p for p, _ in dealt], pa.int32()), pa.array([b for _, b in dealt], pa.binary())], ["kind", "part", "data"])


def _records(table: pa.Table, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(b.as_py() for b in table.column("data")), dtype=dtype)


def merged(spans: np.ndarray) -> np.ndarray:
    """_SPAN records with overlapping and touching ones of a row made one, by row and begin."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["begin"], spans["row"]))]
    new = np.concatenate([[True], spans["row"][1:] != spans["row"][:-1]])
    lift = (np.cumsum(new) - 1) * (int(spans["end"].max()) + 1)
    reach = np.maximum.accumulate(spans["end"] + lift)
    first = np.flatnonzero(new | np.concatenate([[True], spans["begin"][1:] + lift[1:] > reach[:-1]]))
    out = spans[first].copy()
    out["end"] = (reach - lift)[np.concatenate([first[1:], [len(spans)]]) - 1]
    return out


def _spans_blobs(row: np.ndarray, begin: np.ndarray, end: np.ndarray, parts: int) -> pa.RecordBatch:
    """Spans, merged and dealt by row, as blobs of kind 1."""
    spans = np.empty(len(row), dtype=_SPAN)
    spans["row"], spans["begin"], spans["end"] = row, begin, end
    spans = merged(spans)
    return _blobs(1, list(_dealt(spans, _part(_mixed(spans["row"].view(np.uint64)), parts), parts)))


def _classed(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first run of each class, all others); a class has one minimizer and one context."""
    runs = runs[np.lexsort((runs["at"], runs["row"], runs["k"], runs["m"], runs["c"]))]
    first = np.concatenate([[True], (runs["c"][1:] != runs["c"][:-1]) | (runs["m"][1:] != runs["m"][:-1])]) if len(runs) else np.zeros(0, dtype=bool)
    return runs[first], runs[~first]


def _flushed(runs: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """runs joined to arrays of at least HELD records, but for the last."""
    held: list[np.ndarray] = []
    n = 0
    for x in runs:
        held.append(x)
        n += len(x)
        if n >= HELD:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def repeated_minimizers(docs: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """(part, n, data): for each part of the hashes, how many and which minimizers occur twice or more.

    Each task sends a minimizer at most twice for HELD runs, so a frequent one fills no part.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in _flushed(x["m"] for x in _found_runs(batches, length, gram)):
            once, counts = np.unique(m, return_counts=True)
            m = np.concatenate([once, once[counts > 1]])
            yield _blobs(0, list(_dealt(m, _part(m, parts), parts)))

    def twice(table: pa.Table) -> pa.Table:
        m = np.sort(_records(table, "<u8"))
        again = np.unique(m[1:][m[1:] == m[:-1]])
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "n": pa.array([len(again)], pa.int64()), "data": pa.array([again.tobytes()], pa.binary())})

    dealt = _rows(docs).select("row", "k", "text").mapInArrow(sent, "kind int, part int, data binary")
    return staged(dealt.groupBy("part").applyInArrow(twice, "part int, n long, data binary"), "minimizers")


def _masks(m: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduce([np.uint64(1) << (m >> np.uint64(6 * i) & np.uint64(63)) for i in range(3)])


def _filter(repeated: DataFrame, most: int) -> np.ndarray:
    """The Bloom filter of repeated(part, n, data): three bits in one word, one word for PER_WORD minimizers, at most `most` words.

    A part's minimizers lie in words that follow one another, so each part sends its stretch only.
    """
    total = repeated.agg(F.sum("n")).first()[0] or 0
    words = min(most, 1 << max(4, (total // PER_WORD).bit_length()))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                m = np.frombuffer(data.as_py(), dtype="<u8")
                if len(m):
                    at = _part(m, words)
                    bits = np.zeros(int(at.max() - at.min()) + 1, dtype="<u8")
                    np.bitwise_or.at(bits, at - at.min(), _masks(m))
                    yield pa.RecordBatch.from_arrays([pa.array([int(at.min())]), pa.array([bits.tobytes()], pa.binary())], ["begin", "bits"])

    table = np.zeros(words, dtype=np.uint64)
    for r in repeated.select("data").mapInArrow(stretches, "begin long, bits binary").toLocalIterator():
        bits = np.frombuffer(r.bits, dtype="<u8")
        table[r.begin : r.begin + len(bits)] |= bits
    return table


def shared_runs(docs: DataFrame, words: np.ndarray, parts: int, length: int, gram: int) -> DataFrame:
    """Blobs of runs whose minimizer the filter may hold (kind 0, by class), and of spans that are copies within a task (kind 1, by row).

    Of each class a task sends the first run for HELD of them, so a class of any size fills no part.
    """
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value

        def passed() -> Iterator[np.ndarray]:
            for x in _found_runs(batches, length, gram):
                mask = _masks(x["m"])
                yield x[table[_part(x["m"], len(table))] & mask == mask]

        for x in _flushed(passed()):
            first, rest = _classed(x)
            yield _blobs(0, list(_dealt(first, _part(first["c"], parts), parts)))
            yield _spans_blobs(rest["row"], rest["at"], rest["at"].astype(np.int64) + rest["starts"] + length - 1, parts)

    return staged(_rows(docs).select("row", "k", "text").mapInArrow(rows, "kind int, part int, data binary"), "runs")


def classes(shared: DataFrame, parts: int, length: int) -> DataFrame:
    """_HEAD rows: the first run of each class (kind 0), and blobs of the spans of all others (kind 1)."""
    names = [x.split()[0] for x in _HEAD.split(", ")]

    def split(table: pa.Table) -> pa.Table:
        first, rest = _classed(_records(table, _RUN))
        spans = _spans_blobs(rest["row"], rest["at"], rest["at"].astype(np.int64) + rest["starts"] + length - 1, parts)
        n, s = len(first), spans.num_rows
        none = lambda k, t: pa.nulls(k, t)
        columns = [pa.array(np.repeat([0, 1], [n, s]).astype(np.int32)), pa.concat_arrays([none(n, pa.int32()), spans.column(1)]), pa.concat_arrays([none(n, pa.binary()), spans.column(2)])]
        for c, t in (("m", np.int64), ("k", np.int64), ("row", np.int64), ("at", np.int32), ("starts", np.int32), ("behind", np.int32)):
            own = np.ascontiguousarray(first[c])
            own = pa.array(own.view(np.int64) if c == "m" else own.astype(t))
            columns.append(pa.concat_arrays([own, none(s, own.type)]))
        return pa.table(dict(zip(names, columns, strict=True)))

    return staged(shared.filter("kind = 0").groupBy("part").applyInArrow(split, _HEAD), "classes")


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = FILTER_WORDS, limit: int = GROUP_LIMIT) -> DataFrame:
    """(row, spans): the bytes to remove by _rows' row number, as a binary of ascending pairs of longs (begin, end) that don't touch.

    1. Each string of `length` bytes belongs to a run, and equal strings to runs of one minimizer. Minimizers that
       occur twice are put in a Bloom filter of bounded size; a second look at the texts sends only runs that pass it.
    2. Runs with equal minimizers and contexts are a class; all but its first lie at later places than the
       same strings, so they are removed whole.
    3. Where a minimizer has several classes, the first run of each is read, and a suffix array over the contexts of a
       block of minimizers marks the strings that start earlier in another class. Minimizers of over `limit` classes
       are not gathered: their strings are hashed one by one and their earliest places found by an aggregate (_crowded).

    Runs and spans travel as blobs of fixed records, a blob for each task and part.
    """
    if gram > length:
        raise ValueError("a minimizer is no longer than a string")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = _filter(repeated_minimizers(docs, parts, length, gram), words)
    shared = shared_runs(docs, table, parts, length, gram)
    found = classes(shared, parts, length)
    heads = found.filter("kind = 0").select("m", "k", "row", "at", "starts", "behind")
    counts = staged(heads.groupBy("m").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    heads = perhaps(heads, counts, "m").filter("__maybe").drop("__maybe").join(counts, "m")
    wanted = heads.groupBy("row").agg(F.collect_list(F.struct("m", "n", "k", "at", "starts", "behind")).alias("runs"))
    texts = _rows(docs).select("row", "text").join(wanted, "row").select("row", "text", F.explode("runs").alias("r"))
    read = staged(texts.select("row", "r.*", F.expr(f"substring(text, r.at + 1, r.starts + {length - 1})").alias("bytes")), "contexts")
    total = read.filter(F.col("n") <= limit).agg(F.sum(F.length("bytes") - (gram - 1))).first()[0] or 0
    tasks = max(1, parts, total // (64 * BLOCK))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size > BLOCK and r[0] != last:
                    yield _spans_of(held, parts, length, gram)
                    held, size = [], 0
                held.append(r)
                size += len(r[6]) - gram + 1
                last = r[0]
        if held:
            yield _spans_of(held, parts, length, gram)

    few = read.filter(F.col("n") <= limit).select("m", "k", "row", "at", "starts", "behind", "bytes").repartition(tasks, "m").sortWithinPartitions("m")
    spans = shared.filter("kind = 1").select("part", "data").unionByName(found.filter("kind = 1").select("part", "data"))
    spans = spans.unionByName(few.mapInArrow(marked, "kind int, part int, data binary").select("part", "data"))
    many = read.filter(F.col("n") > limit)
    if not many.isEmpty():
        rows = _crowded(many, length)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _spans_blobs(*[c.to_numpy() for c in batch.columns], parts)

        spans = spans.unionByName(rows.select("row", F.col("begin").cast("long"), F.col("end").cast("long")).mapInArrow(dealt, "kind int, part int, data binary").select("part", "data"))

    def by_row(table: pa.Table) -> pa.Table:
        x = merged(_records(table, _SPAN))
        edges = np.concatenate([np.flatnonzero(np.concatenate([[True], x["row"][1:] != x["row"][:-1]])), [len(x)]]) if len(x) else np.zeros(1, dtype=np.int64)
        pairs = np.stack([x["begin"], x["end"]], axis=1)
        blobs = [pairs[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return pa.table({"row": pa.array(x["row"][edges[:-1]]), "spans": pa.array(blobs, pa.binary())})

    return spans.groupBy("part").applyInArrow(by_row, "row long, spans binary")


def _spans_of(held: list[tuple], parts: int, length: int, gram: int) -> pa.RecordBatch:
    order = np.array([(k, row, at) for _, k, row, at, _, _, _ in held], dtype=np.int64)
    marks = repeated_starts([bytes(r[6]) for r in held], [r[4] for r in held], [r[5] for r in held], order, length, gram)
    which = np.repeat(np.arange(len(marks)), [len(x) for x in marks])
    inside = np.arange(len(which)) - np.repeat(np.cumsum([len(x) for x in marks]) - [len(x) for x in marks], [len(x) for x in marks])
    hit = np.concatenate(marks)
    begin = order[which[hit], 2] + inside[hit]
    return _spans_blobs(order[which[hit], 1], begin, begin + length, parts)


def _crowded(read: DataFrame, length: int) -> DataFrame:
    """Spans of strings that start earlier, for contexts too many to gather: by a hash of each string and the least place of each hash."""
    each = read.select("k", "row", "at", F.posexplode(F.expr(f"transform(sequence(0, starts - 1), i -> sha2(substring(bytes, i + 1, {length}), 256))")).alias("i", "string"))
    each = staged(each.select("k", "row", (F.col("at") + F.col("i")).alias("at"), "string"), "strings")
    least = each.groupBy("string").agg(F.min(F.struct("k", "row", "at")).alias("first"), F.count("*").alias("size")).filter("size > 1")
    met = join_groups(each, staged(least, "least"), "string", "size", each.count())
    return met.filter("NOT (row = first.row AND at = first.at)").select("row", F.col("at").alias("begin"), (F.col("at") + length).alias("end"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = FILTER_WORDS, limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs(doc_id, text, ...).

    Removes each byte covered by a string of `length` bytes that also starts earlier: in a row of
    smaller doc_id (null first; rows of one id in the order of the table) or earlier in the same text. Strings are judged
    on the input; matches don't cross documents; kept is the rest as binary. Null texts count as
    empty; texts of any length are hashed in overlapping slices; no rows give no rows; other columns aren't read. docs is read several times and must give its rows in the same order, as tables do.
    """
    spans = removed_spans(docs, length, gram, words, limit)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text, found in zip(*[batch.column(i) for i in range(3)], strict=True):
                text = text.as_py()
                edges = np.frombuffer(found.as_py() or b"", dtype="<i8").tolist()
                rest = b"".join(text[a:b] for a, b in zip([0, *edges[1::2]], [*edges[::2], len(text)], strict=True))
                for column, x in zip(out, (doc_id.as_py(), len(text), len(text) - len(rest), len(edges) // 2, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")
