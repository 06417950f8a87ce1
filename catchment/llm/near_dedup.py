"""SimHash near-duplicates, found by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_groups, staged, text_slices
from .components import connected_components

SHINGLE = 3
SEED = 42
#: Fingerprints that differ in so many bits at most are linked.
THRESHOLD = 2
#: An anchor with more fingerprints than this is compared under narrower anchors; see narrower.
ANCHOR_LIMIT = 512
#: Fingerprints compared with all others of their anchor at a time.
COMPARED = 256


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text.

    A-Z are lower-cased, words are cut at ASCII white space, and the XXH64 (seed 42) of each
    space-joined run of `shingle` words votes, repeats included. Fewer words: the whole sequence
    votes; none: zero. A bit is 1 if it is set in over half of the hashes.
    """
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), SEED)
    hashes = [digest(b" ".join(run), SEED) for run in zip(*[words[i:] for i in range(shingle)], strict=False)]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long. Null texts count as empty. No shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            fps = np.array([simhash(t, shingle) for t in texts.to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, fp long")


def _flips(n: int = 31) -> list[list[int]]:
    """For each syndrome of the Hamming code of n = 2^m - 1 bits, the bit masks that lead from a word to every code word within distance two.

    Bit i of the word has position i + 1; a word's syndrome is the exclusive or of the positions
    of its set bits. Flipping the positions in a set changes the syndrome by their exclusive or.
    """
    bit = lambda position: 1 << (position - 1)
    table = [[0]]
    for s in range(1, n + 1):
        table.append([bit(s)] + [bit(a) | bit(a ^ s) for a in range(1, n + 1) if a < a ^ s and a != s])
    return table


def covered(words: DataFrame, columns: list[str], word: str = "word", part: str = "part") -> DataFrame:
    """(anchor, columns..., home): each row of words(part, word, columns...) with every anchor that covers its word; home is 1 at the nearest, else 0.

    The anchors over the first 31 bits of a word are the words of the perfect [31, 26] Hamming code, whose covering
    radius is one; for a threshold of one bit a word goes to all anchors within 1 + 1 bits: 16 of
    them, or only itself if it is a code word. Of two words of a part that differ in at most one bit, one's nearest anchor covers
    both; so anchors that are nobody's home needn't be compared. Written as built-in functions: syndrome by parities, then one exclusive or per anchor.
    """
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]
    table = "array(" + ", ".join("array(" + ", ".join(f"{m}L" for m in row) + ")" for row in _flips()) + ")"
    syndrome = " + ".join(f"(bit_count({word} & {m}L) % 2) * {1 << j}" for j, m in enumerate(masks))
    coded = words.withColumn("__syndrome", F.expr(f"cast({syndrome} AS int)"))
    flipped = coded.select(*columns, part, word, F.expr(f"explode(element_at({table}, __syndrome + 1))").alias("__flip"))
    return flipped.select(F.expr(f"shiftleft(cast({part} AS long), 32) | ({word} ^ __flip)").alias("anchor"), *columns, F.expr("cast(bit_count(__flip) < 2 AS int)").alias("home"))


def anchors(fps: DataFrame) -> DataFrame:
    """(anchor, fp, home): each fingerprint of fps(fp) with every anchor that covers one of its halves (see covered).

    Two fingerprints within THRESHOLD = 2 bits differ in at most one bit of their low or of their
    high half, so they meet at an anchor of that half.
    """
    halves = "inline(array(struct(0 AS part, fp & 2147483647L AS word), struct(1 AS part, shiftrightunsigned(fp, 32) & 2147483647L AS word)))"
    return covered(fps.select("fp", F.expr(halves)), ["fp"])


def narrower(placed: DataFrame) -> DataFrame:
    """(anchor, fp): the rows of placed(anchor, fp) under 2 * 2^11 anchors each, for anchors that are crowded.

    Fingerprints of an anchor of one half that lie within THRESHOLD = 2 bits differ in at most one bit of a
    quarter in the other half. Over a quarter's first 15 bits the code is the perfect [15, 11] Hamming code, covered as in
    anchors: 8 replicas or one for each quarter. An anchor's members so meet in groups some 270 times smaller.
    """
    other = "shiftrightunsigned(fp, CASE WHEN shiftrightunsigned(anchor, 32) = 0 THEN 32 ELSE 0 END)"
    rows = placed.select("anchor", "fp", F.expr(f"inline(array(struct(0 AS part, {other} & 32767L AS word), struct(1 AS part, shiftrightunsigned({other}, 16) & 32767L AS word)))"))
    masks = [sum(1 << (p - 1) for p in range(1, 16) if p >> j & 1) for j in range(4)]
    table = "array(" + ", ".join("array(" + ", ".join(f"{m}L" for m in row) + ")" for row in _flips(15)) + ")"
    syndrome = " + ".join(f"(bit_count(word & {m}L) % 2) * {1 << j}" for j, m in enumerate(masks))
    coded = rows.select("anchor", "fp", "part", "word", F.expr(f"element_at({table}, cast({syndrome} AS int) + 1)").alias("flips"))
    return coded.select(F.expr("explode(transform(flips, f -> struct(anchor, part, word ^ f AS code)))").alias("anchor"), "fp")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the fingerprints of each anchor, as one star per linked group, so never more rows than members."""
    for batch in batches:
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        for members in batch.column(0):
            fps = np.asarray(members.values.to_numpy(), dtype=np.int64)
            label = np.arange(len(fps))
            while True:
                new = label.copy()
                for i in range(0, len(fps), COMPARED):
                    near = np.bitwise_count(fps[i : i + COMPARED, None].view(np.uint64) ^ fps[None, :].view(np.uint64)) <= THRESHOLD
                    new[i : i + COMPARED] = np.where(near, label[None, :], len(fps)).min(axis=1)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            joined = label != np.arange(len(fps))
            left.append(fps[joined])
            right.append(fps[label[joined]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.array([], dtype=np.int64)) for x in (left, right)], ["a", "b"])


def links(fps: DataFrame, limit: int = ANCHOR_LIMIT) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints of fps(fp), all different, that chains of THRESHOLD bits or fewer connect."""
    placed = anchors(fps)
    sums = [F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.expr("bit_xor(fp)").alias("x"), F.max("home").alias("home")]
    counts = staged(placed.groupBy("anchor").agg(*sums).filter("n > 1 AND home = 1"), "anchors")
    # Two or three members are known from these sums: the third is what the exclusive or leaves.
    few = counts.filter("n < 4").select(F.expr("inline(IF(n = 2, array(struct(a, b)), array(struct(a, b), struct(a, a ^ b ^ x AS b), struct(a ^ b ^ x AS a, b))))"))
    pairs = few.filter(f"bit_count(a ^ b) <= {THRESHOLD}")
    more = counts.filter("n > 3").select("anchor", "n")
    lists = placed.join(more.filter(F.col("n") <= limit), "anchor").groupBy("anchor").agg(F.collect_list("fp").alias("fps"))
    compared = lists.select("fps").mapInArrow(_compared, "a long, b long")
    crowded = narrower(placed.join(more.filter(F.col("n") > limit).select("anchor"), "anchor", "left_semi"))
    crowded = crowded.groupBy("anchor").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1").select("fps").mapInArrow(_compared, "a long, b long")
    return pairs.unionByName(compared).unionByName(crowded).distinct()


def near_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs(doc_id, text, ...); component_id is the smallest doc_id reachable.

    Equal fingerprints form a class, linked as a whole; links between classes are found at their
    anchors and chained into components. Null and empty texts have fingerprint zero and are
    linked like any other. Rows whose doc_id is null get the component of their fingerprint; repeated rows are linked; no rows
    give no rows. A text of any length is hashed whole, by one task, in about 24 bytes of memory a byte.
    """
    fps = staged(fingerprints(docs, shingle), "fps")
    total = fps.count()
    classes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")), "classes")
    chained = staged(connected_components(staged(links(classes.select("fp")), "links")).select(F.col("node").alias("fp"), F.col("component").alias("root")), "chained")
    rooted = staged(classes.join(chained, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    roots = staged(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "roots")
    solved = staged(join_groups(rooted, roots, "root", "n", total).select("fp", "size", "component_id"), "solved")
    return join_groups(fps, solved, "fp", "size", total).select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
