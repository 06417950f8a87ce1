"""Near-duplicates by Jaccard similarity of word shingles: candidates by anchor-point covering of SimHash fingerprints, each judged exactly.

A SimHash in which every shingle votes differs in 15 % of its bits between sets of a Jaccard similarity of 0.8, so that 31 bits of it are within one bit of one another for
4 % of such pairs only. Here each part of the fingerprint hears VOTERS shingles: those of least hash in an order of the part's own. Two sets have the same voters, and so
the same word, with the fifth power of their similarity; otherwise many of the word's bits differ. So the words need no threshold beyond the
covering radius: each goes to the one anchor that covers it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard
from .common import join_groups, perhaps, staged, text_slices, whole_text, without
from .components import connected_components

SHINGLE = 5
SEED = 42
#: Documents of at least so much Jaccard similarity are linked.
SIMILARITY = 0.8
#: Parts of a fingerprint, of BITS bits each, and shingles that vote on one: sets of SIMILARITY miss each other in all parts four times in a thousand.
PARTS, BITS, VOTERS = 14, 31, 5
#: Sets of up to so many shingles have so many more parts with so many voters, as five are most of theirs.
SMALL, SMALL_PARTS, SMALL_VOTERS = 20, 6, 2
#: Up to so many members of an anchor or shingle are compared pairwise; more members of an anchor meet at their rarest shingles, more of a shingle in rounds against about so many leaders.
PAIRWISE, LEADERS = 16, 1024
#: Nodes of one label whose sets are sent to one place, and pairs that are judged there, about.
SPLIT, BATCH = 2000, 1000
#: Shingles whose places in the parts' orders are looked at together.
BLOCK = 1 << 14

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, PARTS + SMALL_PARTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.arange(1, BITS + 1)


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The different XXH64 of the runs of `shingle` words, ascending; fewer words: the whole sequence, none: no hash."""
    if not words:
        return np.array([], dtype=np.uint64)
    runs = zip(*[words[i:] for i in range(min(shingle, len(words)))], strict=False)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(run), SEED) for run in runs], dtype=np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def fingerprint(items: np.ndarray) -> np.ndarray:
    """Words of BITS bits, one a part: a bit is 1 if it is set in over half of the hashes of the part's voters, the least of the items in its order. None: no words."""
    if not len(items):
        return np.array([], dtype=np.int64)
    words = _voted(items, _FACTORS[:PARTS], VOTERS)
    return np.concatenate([words, _voted(items, _FACTORS[PARTS:], SMALL_VOTERS)]) if len(items) <= SMALL else words


def _voted(items: np.ndarray, factors: np.ndarray, voters: int) -> np.ndarray:
    least = np.empty((0, len(factors)), dtype=np.uint64)
    for i in range(0, len(items), BLOCK):
        held = np.concatenate([least, _mixed(items[i : i + BLOCK, None] * factors)])
        least = np.partition(held, min(voters, len(held)) - 1, axis=0)[:voters]
    votes = _mixed(least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    ones = ((votes[:, :, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).sum(axis=0)
    return ((ones * 2 > len(votes)) << np.arange(BITS)).sum(axis=1)


def anchors(words: np.ndarray) -> np.ndarray:
    """Keys of the parts' anchors: the word of the perfect [31, 26] Hamming code within one bit of each fingerprint word, with its part's number above."""
    seen = (words[:, None] >> np.arange(BITS)) & 1
    wrong = np.bitwise_xor.reduce(seen * _PLACES, axis=1)
    return (words ^ np.where(wrong > 0, 1 << np.maximum(wrong - 1, 0), 0)) | (np.arange(len(words)) << 32)


def described(docs: DataFrame) -> DataFrame:
    """(row, doc_id, same, node, items, keys) for each row of docs(row, doc_id, same, text): node is the hash of its words in order, items the size of its shingle set, keys its anchors. No shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for _, texts in text_slices([batch.select([0, 3])]):
                nodes, sizes, keys = [], [], []
                for text in texts.to_pylist():
                    words = text.lower().split()
                    nodes.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
                    items = shingles(words)
                    sizes.append(len(items))
                    keys.append(anchors(fingerprint(items)))
                ids = [batch.column(i).slice(first, len(texts)) for i in range(3)]
                first += len(texts)
                yield pa.RecordBatch.from_arrays([*ids, pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["row", "doc_id", "same", "node", "items", "keys"])

    return docs.select("row", "doc_id", "same", "text").mapInArrow(rows, "row long, doc_id long, same long, node long, items long, keys array<long>")


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, items) for each row of docs(node, text): its shingle set as ascending longs. No shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            items = [shingles(t.lower().split(), shingle).view(np.int64) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(items, pa.list_(pa.int64()))], ["node", "items"])

    return docs.select("node", "text").mapInArrow(rows, "node long, items array<long>")


def _judged(pairs: DataFrame, texts_of: Callable[[DataFrame], DataFrame], labels: DataFrame) -> DataFrame:
    """The pairs(a, b), staged, of SIMILARITY or more by the shingle sets of the texts that texts_of gives; the pairs are discarded.

    Pairs are dealt by their nodes' labels(node, label, parts), so that the pairs of one group of copies meet in a few places and each
    text is sent once to a place, not once a pair; a label of many nodes is cut into `parts`, so a place holds at most
    about 2 * SPLIT texts of it. Pairs without a label in common are dealt by hash, about BATCH to a place. Texts are sent, not sets, which take more room than they.
    """
    total = pairs.count()
    places = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BATCH)
    named = pairs
    for n in ("a", "b"):
        own = labels.select(F.col("node").alias(n), F.col("label").alias(f"label_{n}"), F.expr("pmod(xxhash64(node), parts)").alias(f"part_{n}"))
        named = named.join(own, n, "left").withColumns({f"label_{n}": F.coalesce(f"label_{n}", n), f"part_{n}": F.coalesce(f"part_{n}", F.lit(0).cast("long"))})
    ends = [F.struct(F.col(f"label_{n}").alias("label"), F.col(f"part_{n}").alias("part")) for n in ("a", "b")]
    dealt = staged(named.withColumns({"x": F.least(*ends), "y": F.greatest(*ends)}).select("a", "b", F.expr(f"pmod(xxhash64(x, y), {places})").alias("place")), "dealt")
    sent = texts_of(dealt.select(F.explode(F.array("a", "b")).alias("node"), F.col("place").alias("at")).distinct())

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        items = {n: shingles(x.lower().split()) for n, x in zip(right.column("node").to_pylist(), right.column("text").cast(pa.large_binary()).to_pylist(), strict=True)}
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        near = np.zeros(len(a), dtype=bool)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            one, two = items[x], items[y]
            if min(len(one), len(two)) >= SIMILARITY * max(len(one), len(two)):
                both = len(np.intersect1d(one, two, assume_unique=True))
                near[i] = both >= SIMILARITY * (len(one) + len(two) - both)
        return pa.table({"a": pa.array(a[near]), "b": pa.array(b[near])})

    links = staged(dealt.groupBy("place").cogroup(sent.groupBy("at")).applyInArrow(judge, "a long, b long"), "links")
    discard(dealt, pairs)
    return links


def _fit(a: str, b: str) -> str:
    """Whether sets of these sizes can have SIMILARITY at all."""
    return f"least({a}, {b}) >= {SIMILARITY} * greatest({a}, {b})"


def _may(x: str, y: str) -> str:
    """Whether the members x and y of a key are of two components and can have SIMILARITY if the key's shingle is the first that they share: all others are behind its places in both (positional filter). Place 1 leaves their sizes to tell."""
    return f"{x}.of <> {y}.of AND 1 + least({x}.items - {x}.place, {y}.items - {y}.place) >= {SIMILARITY / (1 + SIMILARITY)} * ({x}.items + {y}.items) - 1e-6"


def narrower(crowded: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, node, items, of, place): the members of crowded(node, items, of) at those of their shingles in sets(node, items) by which any two of SIMILARITY meet; shingles of one component only are left out.

    Shingles are ordered by the number of members that have them, the rarest first; place is the key's in this order. Two sets of SIMILARITY share one of the first items - SIMILARITY * items + 1 of either, whatever the order
    (prefix filter). So no pair is lost, and texts that share a passage seldom meet by it, as their own words come before it.
    """
    members = crowded.select("node", "items", "of").distinct()
    total = members.agg(F.sum("items")).first()[0] or 0
    each = members.join(sets.select("node", F.col("items").alias("set")), "node").withColumn("key", F.explode("set")).drop("set")
    many = staged(each.groupBy("key").agg(F.count("*").alias("n"), F.min("of").alias("x"), F.max("of").alias("y")).filter("x <> y").select("key", "n"), "meeting")
    met = join_groups(perhaps(each, many, "key").filter("__maybe").drop("__maybe"), many, "key", "n", total)
    own = Window.partitionBy("node")
    # Shingles that members of no other component have come first and are not in `met`.
    place = F.col("items") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "key"))
    return met.withColumn("place", place).filter(f"place <= items - ceil({SIMILARITY} * items - 1e-9) + 1").select("key", "node", "items", "of", "place")


def _of(rest: DataFrame, known: DataFrame) -> DataFrame:
    """rest with the component of each node: itself if none is known."""
    return rest.drop("of").join(known, "node", "left").withColumn("of", F.coalesce("component", "node")).drop("component")


def _several(rest: DataFrame) -> DataFrame:
    """(key, n), staged, of the keys at which members of several components meet."""
    return staged(rest.groupBy("key").agg(F.count("*").alias("n"), F.min("of").alias("x"), F.max("of").alias("y")).filter("x <> y").select("key", "n"), "mixed")


def chained(sizes: DataFrame, shared: DataFrame, texts_of: Callable[[DataFrame], DataFrame], pairwise: int = PAIRWISE, leaders: int = LEADERS) -> DataFrame:
    """(node, component): the nodes that chains of pairs with an anchor in common and of SIMILARITY or more connect.

    sizes(key, n, a, b) has the anchors of two nodes or more with two of their nodes (node, items); shared(key, node, items) the members of
    those of more than two; texts_of adds the texts to rows of nodes. First each member meets its
    anchor's leader, the member with the most company over all anchors: in a group of edited copies
    of one text that is the text or one near its middle. Then only members that aren't connected yet are compared:
    pairwise at anchors with at most `pairwise` of them; the members of more crowded ones meet at their rarest shingles (see narrower), where a pair is
    listed only if the shingle's places allow the similarity, which few pairs of unlike copies of one text pass. Where more than `pairwise` meet at a shingle,
    they are compared in rounds against about `leaders` of
    them, chosen by hash, which then leave the shingle, as they have met all others. So a group of copies costs a pair per
    member and anchor, and no pair of connected nodes is listed.
    """
    crowd = shared.groupBy("key").agg(F.count("*").alias("n"))
    company = shared.join(crowd, "key").groupBy("node").agg(F.sum("n").alias("company"))
    rest = staged(shared.join(company, "node"), "ranked")
    heads = rest.groupBy("key").agg(F.max(F.struct("company", "node", "items")).alias("head"), F.count("*").alias("n"))
    heads = staged(heads.select("key", "n", F.col("head.node").alias("lead"), F.col("head.items").alias("lead_items"), F.col("head.company").alias("lead_company")), "heads")
    total = rest.count()
    met = staged(join_groups(rest.select("key", "node", "items"), heads, "key", "n", total).select("node", "items", "lead", "lead_items", "lead_company"), "met")
    # A node's label is the most accompanied leader that it meets: one for all of a group of copies.
    labels = met.groupBy("node").agg(F.max(F.struct("lead_company", "lead")).alias("l")).select("node", F.col("l.lead").alias("label"))
    crowds = labels.groupBy("label").agg(F.count("*").alias("n"))
    labels = staged(join_groups(labels, crowds, "label", "n", total).select("node", "label", F.expr(f"1 + n div {SPLIT}").alias("parts")), "labels")
    stars = met.filter(f"node <> lead AND {_fit('items', 'lead_items')}").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))
    twos = sizes.filter(f"n = 2 AND {_fit('a.items', 'b.items')}").select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))
    pairs = staged(twos.unionByName(stars).distinct(), "pairs")
    discard(met)
    found = _judged(pairs, texts_of, labels)
    known = staged(connected_components(found).select("node", "component"), "components")
    rest = rest.join(heads.select("key", F.col("lead").alias("node")), ["key", "node"], "left_anti").withColumn("place", F.lit(1).cast("long"))
    rest = staged(_of(rest.select("key", "node", "items", "place"), known), "rest")
    mixed = _several(rest)
    crowded = staged(rest.join(mixed.filter(F.col("n") > pairwise), "key", "left_semi").select("node", "items", "of").distinct(), "crowded")
    rest = rest.join(mixed.filter(F.col("n") <= pairwise), "key", "left_semi")
    if not crowded.isEmpty():
        sets = staged(shingle_sets(texts_of(crowded.select("node"))), "sets")
        rest = rest.unionByName(narrower(crowded, sets).select(*rest.columns))
    for turn in count(1):
        rest = staged(rest, "rest")
        if turn == 1 and not crowded.isEmpty():
            discard(sets)
        mixed = _several(rest)
        if mixed.isEmpty():
            return known
        member = F.struct("node", "of", "items", "place")
        few = rest.join(mixed.filter(F.col("n") <= pairwise), "key").groupBy("key").agg(F.array_sort(F.collect_list(member)).alias("m"))
        each = f"transform(filter(slice(m, i + 2, size(m)), y -> {_may('x', 'y')}), y -> struct(x.node AS a, y.node AS b))"
        pairs = few.select(F.expr(f"inline(flatten(transform(m, (x, i) -> {each})))"))
        active = staged(join_groups(rest, mixed.filter(F.col("n") > pairwise), "key", "n", rest.count()).withColumn("picked", F.expr(f"pmod(xxhash64(node, {turn}), greatest(1, n div {leaders})) = 0")), "crowd")
        more = not active.isEmpty()
        if more:
            top = active.groupBy("key").agg(F.array_union(F.array(F.max(member)), F.collect_list(F.when(F.col("picked"), member))).alias("lead"), F.max("n").alias("n"))
            top = staged(top, "heads")
            met = join_groups(active.select("key", "picked", member.alias("x")), top, "key", "n", active.count())
            # Two leaders are listed once.
            near = met.select(F.col("x.node").alias("node"), F.expr(f"explode(filter(lead, y -> (y.node < x.node OR y.node > x.node AND NOT picked) AND {_may('x', 'y')}).node)").alias("lead"))
            pairs = pairs.unionByName(near.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")))
        pairs = staged(pairs.distinct(), "pairs")
        new = _judged(pairs, texts_of, labels)
        if not new.isEmpty():
            found = found.unionByName(new)
            known = staged(connected_components(found).select("node", "component"), "components")
        if not more:
            return known
        left = active.join(top.select("key", F.explode("lead.node").alias("node")), ["key", "node"], "left_anti")
        rest = _of(left.select("key", "node", "items", "place", "of"), known)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with __same, a hash of the text, and __row, one of doc_id and text; so rows are found again however the table is read."""
    return docs.withColumn("__same", F.xxhash64(whole_text())).withColumn("__row", F.xxhash64("doc_id", "__same"))


def similar_groups(docs: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """(row, doc_id, node, component_id, first) for each row of docs(doc_id, text, ...); row is a hash of its doc_id and text.

    component_id is the smallest doc_id reachable over pairs of SIMILARITY or more, first the
    row that has it (the one of least hash, if several have). Rows of equal words form a node (also those without words),
    linked as a whole; null texts count as empty. Texts of any length are read whole. No rows give no rows.
    """
    numbered = _numbered(docs).select(F.col("__row").alias("row"), "doc_id", F.col("__same").alias("same"), "text")
    rows = staged(described(numbered), "described")
    total = rows.count()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row"))
    classes = staged(rows.groupBy("node").agg(least.alias("first"), F.min("same").alias("same"), F.count("*").alias("size"), F.first("items").alias("items"), F.first("keys").alias("keys")), "classes")
    placed = classes.select("node", "items", F.explode("keys").alias("key"))
    member = F.struct("node", "items")
    # Keys alone are counted first: few of them have two nodes, and only those of their rows that a filter passes are shuffled whole.
    twice = staged(placed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "twice")
    sizes = perhaps(placed, twice, "key").filter("__maybe").groupBy("key").agg(F.count("*").alias("n"), F.min(member).alias("a"), F.max(member).alias("b"))
    sizes = staged(sizes.filter("n > 1"), "anchors")
    many = sizes.filter("n > 2").select("key")
    shared = staged(perhaps(placed, many, "key").filter("__maybe").select("key", "node", "items").join(many, "key", "left_semi"), "shared")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """nodes(node, ...) with their texts; a text is shuffled once."""
        used = staged(nodes.join(classes.select("node", "same"), "node"), "used")
        texts = perhaps(numbered.select("same", "text"), used.select("same"), "same").filter("__maybe").groupBy("same").agg(F.first("text").alias("text"))
        return texts.join(used, "same").select("text", *nodes.columns)

    known = chained(sizes, shared, texts_of, pairwise).withColumnRenamed("component", "root")
    rooted = staged(classes.join(known, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    roots = staged(rooted.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n")), "roots")
    solved = staged(join_groups(rooted, roots, "root", "n", total).select("node", "size", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("first")), "solved")
    return join_groups(rows.select("row", "doc_id", "node"), solved, "node", "size", total).select("row", "doc_id", "node", "component_id", "first")


def drop_similar(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id (null ids last, then the least hash of the text); columns unchanged.

    Rows are told apart by doc_id and text, so repeated and null ids do no harm; of rows with
    the same id and text one stays. Only rows that may go, and such repeated ones, are shuffled.
    """
    groups = staged(similar_groups(docs), "groups")
    rest = without(_numbered(docs), staged(groups.filter("row <> first").select(F.col("row").alias("__row")).distinct(), "dropped"), "__row")
    twins = staged(groups.filter("row = first").groupBy("row").count().filter("count > 1").select(F.col("row").alias("__row")), "twins")
    if not twins.isEmpty():
        one = perhaps(rest, twins, "__row").filter("__maybe").drop("__maybe").join(twins, "__row", "left_semi").dropDuplicates(["__row"])
        rest = without(rest, twins, "__row").unionByName(one)
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])
