"""Document fingerprints by SimHash and their search by permuted block tables, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, staged, whole_text

#: Bits of a fingerprint: two hashes of 64.
BITS = 128
#: Votes are counted three to a long, in lanes of so many bits.
LANE = 21
#: Terms counted together; their weights, of WEIGHT at most, can't overflow a lane.
CHUNK = 400_000
WEIGHT = 4

_ONES = sum(1 << (LANE * i) for i in range(3))
_PER_HASH = 22
_LOWEST = -(1 << 63)


def _lanes(h: str) -> list[str]:
    """22 longs with bits i, 22 + i and 44 + i of hash h in their lanes (the last lacks its third)."""
    out = []
    for i in range(_PER_HASH):
        bits = [b for b in (i, i + _PER_HASH, i + 2 * _PER_HASH) if b < 64]
        out.append(" | ".join(f"shiftleft(shiftrightunsigned({h}, {b}) & 1L, {LANE * k})" for k, b in enumerate(bits)))
    return out


def _lane(bit: int) -> str:
    """The count of a bit of the fingerprint, out of the summed longs."""
    h, b = divmod(bit, 64)
    return f"(shiftrightunsigned(v{h * _PER_HASH + b % _PER_HASH}, {LANE * (b // _PER_HASH)}) & {(1 << LANE) - 1}L)"


def simhash(texts: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """keys, high and low: the fingerprint of each row of texts(keys..., text) as two longs.

    Terms are pairs of neighbouring words (cut at white space, lower-cased; a single word is a term of its own), repeats included. A
    term's weight grows from 1 to 4 with its length, so pairs of function words count least.
    Each of 128 hash bits of a term votes with its weight, and a bit of the fingerprint is 1 if it has over
    half of all weight; without words it is zero. keys must tell the rows apart. Votes are summed
    before the shuffle, three counters to a long; texts of over `chunk` terms in chunks, so that no counter overflows.
    """
    words = texts.select(*keys, F.split(F.trim(F.regexp_replace(F.lower(whole_text()), r"\s+", " ")), " ").alias("words"))
    terms = words.select(*keys, "words", F.posexplode("words").alias("at", "word")).filter("at + 1 < size(words) OR size(words) = 1")
    hashed = terms.select(
        *keys,
        F.expr(f"at div {chunk}").alias("chunk"),
        F.expr("coalesce(get(words, at + 1), '')").alias("next"),
        "word",
    ).select(
        *keys,
        "chunk",
        F.expr("xxhash64(word, next)").alias("h0"),
        F.expr("xxhash64(next, word, 1)").alias("h1"),
        F.expr(f"cast(CASE WHEN word = '' THEN 0 ELSE least({WEIGHT}, 1 + (length(word) + length(next)) div 5) END AS long)").alias("weight"),
    )
    sums = [F.sum(F.expr(f"({lane}) * weight")).alias(f"v{h * _PER_HASH + i}") for h in (0, 1) for i, lane in enumerate(_lanes(f"h{h}"))]
    counted = hashed.groupBy(*keys, "chunk").agg(*sums, F.sum("weight").alias("total"), F.max("chunk").alias("last"))
    lanes = F.array(*[F.expr(_lane(b)) for b in range(BITS)])
    return counted.select(*keys, "chunk", "total", *[f"v{i}" for i in range(2 * _PER_HASH)]).transform(lambda d: _merged(d, keys, lanes))


def _merged(counted: DataFrame, keys: list[str], lanes: Column) -> DataFrame:
    """Adds up the chunks of a text and takes the majority of each bit."""
    votes = counted.select(*keys, "total", lanes.alias("votes"))
    one = votes.groupBy(*keys).agg(F.sum("total").alias("total"), *[F.sum(F.col("votes")[b]).alias(f"n{b}") for b in range(BITS)])
    half = lambda h: F.expr(" | ".join(f"IF(2 * n{64 * h + b} > total, shiftleft(1L, {b}), 0L)" for b in range(64)))
    return one.select(*keys, half(0).alias("high"), half(1).alias("low"))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """The share of equal bits of two fingerprints (high, low)."""
    return F.expr(f"1 - (bit_count({a[0]} ^ {b[0]}) + bit_count({a[1]} ^ {b[1]})) / {BITS}D")


def as_hex(high: str, low: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def within_radius(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b, distance) for all pairs of rows of fps(id, high, low) with a < b that differ in 1 to radius bits.

    The bits are cut into radius + 1 blocks, and there is one table per block, keyed by it (the
    fingerprint permuted so that this block comes first): two fingerprints within the radius agree
    in a block, so each pair meets in a table. Rows of equal fingerprints are reduced to
    the smallest id before; the caller has them by grouping. Tables are one exploded column, so one join does all.
    """
    if not 0 < radius < 16:
        raise ValueError("radius must be 1 to 15")
    classes = fps.groupBy("high", "low").agg(F.min("id").alias("id"))
    width = -(-BITS // (radius + 1))
    bits = F.concat(F.lpad(F.bin("high"), 64, "0"), F.lpad(F.bin("low"), 64, "0"))
    blocks = F.array(*[F.struct(F.lit(i).alias("table"), F.substring(bits, 1 + i * width, width).alias("block")) for i in range(radius + 1)])
    tables = classes.select("id", "high", "low", F.explode(blocks).alias("t")).select("id", "high", "low", F.xxhash64("t.table", "t.block").alias("key"))
    a, b = tables.alias("a"), tables.alias("b")
    distance = F.expr("bit_count(a.high ^ b.high) + bit_count(a.low ^ b.low)")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (distance <= radius))
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), distance.alias("distance")).distinct()


def _ranges(docs: DataFrame, n: int) -> list[list[int]]:
    """n * n - 1 ordinary splits of doc_id (null as the least), as n lists; approximate quantiles, so the ranges are about even."""
    shares = [i / (n * n) for i in range(1, n * n)]
    found = docs.select(_order_key().alias("k")).agg(F.percentile_approx("k", F.array(*[F.lit(s) for s in shares]), 100_000)).first()[0] or []
    found = sorted(set(found))
    return [found[i : i + n] for i in range(0, len(found), n)] or [[0]]


def _order_key() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(_LOWEST))


def with_next(docs: DataFrame, n: int | None = None) -> DataFrame:
    """(part, seq, ghost, doc_id, text, next_text): each row of docs(doc_id, text, ...) with the next one's text by ascending doc_id, the first after the last.

    Null ids come first, rows of one id are ordered by text, null texts are empty. Rows are dealt
    by ranges of doc_id, about n * n even ones (at least eight to a shuffle partition, up to 16384), and each range's first rows also go to the range
    before it, as ghosts at its end; so the next row is found by a window within a range, the text
    is shuffled once, and no task sees more than a few ranges. (part, seq) tells the rows apart.
    """
    n = n or min(128, max(24, math.isqrt(8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    splits = _ranges(docs, n)
    outer = "array(" + ", ".join(f"{s[0]}L" for s in splits[1:]) + ")" if len(splits) > 1 else "array(9223372036854775807L)"
    inner = "array(" + ", ".join("array(" + ", ".join(f"{x}L" for x in s) + ")" for s in splits) + ")"
    base = docs.select("doc_id", whole_text().alias("text"), _order_key().alias("k")).withColumn("outer", F.expr(f"size(filter({outer}, s -> s <= k))"))
    placed = base.withColumn("part", F.expr(f"outer * {n + 1} + size(filter({inner}[outer], s -> s <= k))")).drop("outer")
    firsts = sorted((r.part, r.k) for r in placed.groupBy("part").agg(F.min("k").alias("k")).collect())
    before = {part: firsts[i - 1][0] for i, (part, _) in enumerate(firsts)}
    ghosts = docs.sparkSession.createDataFrame([(p, k, before[p]) for p, k in firsts] or [(-1, 0, -1)], "part int, k long, before int")
    met = placed.join(F.broadcast(ghosts), ["part", "k"], "left")
    copies = F.when(F.col("before").isNull(), F.array(F.struct(F.col("part"), F.lit(False).alias("ghost")))).otherwise(F.array(F.struct(F.col("part"), F.lit(False).alias("ghost")), F.struct(F.col("before").alias("part"), F.lit(True).alias("ghost"))))
    dealt = met.select("doc_id", "text", "k", F.explode(copies).alias("c")).select("doc_id", "text", "k", "c.part", "c.ghost")
    order = Window.partitionBy("part").orderBy("ghost", "k", "text")
    return dealt.select("part", F.row_number().over(order).alias("seq"), "ghost", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs(doc_id, text, ...).

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones of
    the next row's text, or all of them. See with_next for the order and simhash for the fingerprint.
    """
    rows = with_next(docs).withColumn("n", F.length("text"))
    edited = F.expr("concat(left(text, n - n div 2), left(coalesce(next_text, ''), n div 2))")
    hashed = rows.withColumn("edited", edited).withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256))
    parts = [F.expr(f"cast(conv(substring(sha, {1 + 16 * i}, 16), 16, -10) AS long)").alias(f"s{i}") for i in range(4)]
    keys = ["part", "seq", "ghost", "doc_id", "n", "s0", "s1", "s2", "s3"]
    both = hashed.select("part", "seq", "ghost", "doc_id", "n", *parts, F.posexplode(F.expr("IF(ghost, array(text), array(text, edited))")).alias("kind", "text"))
    prints = staged(simhash(both, [*keys, "kind"]), "fingerprints")
    order = Window.partitionBy("part").orderBy("seq", "kind")
    ahead = prints.select(*keys, "kind", "high", "low", *[F.lead(c, k).over(order).alias(f"{c}{k}") for k in (1, 2) for c in ("high", "low")])
    own = ahead.filter("kind = 0 AND NOT ghost")
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"s{i}"), 16, "0") for i in range(4)]))
    return own.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        sha.alias("edited_sha256"),
        as_hex("high", "low").alias("fingerprint"),
        as_hex("high1", "low1").alias("edited_fingerprint"),
        likeness(("high", "low"), ("high1", "low1")).alias("near_edited"),
        likeness(("high", "low"), ("high2", "low2")).alias("near_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(documents(spark, sf_dir))
