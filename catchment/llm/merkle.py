"""A Merkle manifest of a table of documents, and proofs of many documents at once by octopus multiproofs.

Leaves are hashed by Spark's own functions. Trees of fan-out 8, one a language, are built in tiers of three levels by the groups of
512 leaves or nodes that share an ancestor; one tree over the languages' roots stands on top. To prove leaves, each leaf partition
(512 consecutive leaves, or those of them that are asked for) works out the least set of nodes that it lacks, all of them are fetched by one join,
and then the partition hashes the interiors that its leaves share once and reads each leaf's own proof off them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from .common import documents, staged

#: Children of a node, and levels that a task builds or proves at once.
FAN, TIER = 8, 3
#: Leaves of a leaf partition.
PART = FAN**TIER
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The tree over the languages' roots; the others are named by tree_name.
TOP = ""


def leaf_hash(**changed: Column) -> Column:
    """The leaf of a row, as bytes: each field as its length in bytes, a colon and its value, or - if null. changed: columns in place of fields."""

    def part(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(part, FIELDS)), 256))


def tree_name(lang: str = "lang") -> Column:
    """A language's tree; in the order of these names the null language comes first."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("-"))


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def up(width: int) -> int:
    """Nodes above `width` nodes."""
    return -(-width // FAN)


@dataclass
class Manifest:
    """leaves: own columns, tree, leaf, idx (place in the tree), n (leaves of the tree); nodes: tree, level, idx, digest (level 1 and up; of the top tree 0 and up);
    trees: tree, n, subroot, top (place in the top tree), tops (leaves of it); root: the whole table's digest, null for no rows."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None


def _built(leaves: DataFrame) -> DataFrame:
    """Nodes (tree, level, idx, n, digest, top) above leaves(tree, idx, n, leaf): tier by tier, until every tree has one node; top marks that one."""
    schema = "tree string, level int, idx long, n long, digest binary, top boolean"
    below, level, out = leaves.select("tree", "idx", "n", F.col("leaf").alias("digest")), 0, None
    widest = leaves.agg(F.max("n")).first()[0] or 0
    while widest > 1:
        base = level

        def fold(table: pa.Table) -> pa.Table:
            """Levels base + 1 .. base + TIER above consecutive nodes."""
            table = table.sort_by("idx")
            tree, n, first = table["tree"][0].as_py(), table["n"][0].as_py(), table["idx"][0].as_py()
            row, width, rows = [x.hex() for x in table["digest"].to_pylist()], n, []
            for _ in range(base):
                width = up(width)
            for depth in range(1, TIER + 1):
                if width == 1:
                    break
                row, width, first = [digest(*row[i : i + FAN]) for i in range(0, len(row), FAN)], up(width), first // FAN
                rows += [(tree, base + depth, first + i, n, bytes.fromhex(d), width == 1) for i, d in enumerate(row)]
            return pa.table(list(zip(*rows, strict=True)), schema=pa.schema([("tree", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("top", pa.bool_())]))

        tier = staged(below.filter(F.col("n") > FAN**level).groupBy("tree", F.floor(F.col("idx") / PART).alias("__part")).applyInArrow(fold, schema), "tier")
        out = tier if out is None else out.unionByName(tier)
        level += TIER
        below = tier.filter((F.col("level") == level) & ~F.col("top")).select("tree", "idx", "n", "digest")
        for _ in range(TIER):
            widest = up(widest)
    return out if out is not None else leaves.sparkSession.createDataFrame([], schema)


def manifest(docs: DataFrame, **more: Column) -> Manifest:
    """The Merkle manifest of docs(doc_id, source, lang, n_chars, text, ...).

    In a language's tree leaves ascend by doc_id (null ids first; rows of one id by leaf and then by more). Each text is read once. more:
    further columns of the leaves, by their names. No rows give no leaves and no root.
    """
    own = staged(docs.select("doc_id", tree_name().alias("tree"), leaf_hash().alias("leaf"), *[c.alias(n) for n, c in more.items()], F.monotonically_increasing_id().alias("__row")), "leaves")
    leaves = ranked(own, ["tree"], ["doc_id", "leaf", *more, "__row"], "idx", "n").drop("__row")
    leaves = staged(leaves, "leaves")
    nodes = _built(leaves)
    single = leaves.filter("n = 1").select("tree", "n", F.col("leaf").alias("subroot"))
    subroots = staged(single.unionByName(nodes.filter("top").select("tree", "n", F.col("digest").alias("subroot"))), "subroots")
    trees = staged(ranked(subroots, [], ["tree"], "top", "tops"), "trees")
    heads = trees.select(F.lit(TOP).alias("tree"), F.col("top").alias("idx"), F.col("tops").alias("n"), F.col("subroot").alias("leaf"))
    above = _built(heads)
    top = above.filter("top").select("digest").union(trees.filter("tops = 1").select("subroot")).head(1)
    every = nodes.select("tree", "level", "idx", "digest").unionByName(heads.select("tree", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest"))).unionByName(above.select("tree", "level", "idx", "digest"))
    return Manifest(leaves, every, trees, bytes(top[0][0]).hex() if top else None)


def lacking(places: Iterable[int], n: int) -> Iterator[tuple[int, int]]:
    """(level, place) of the fewest nodes that, with the leaves at places, give all runs on the way to the root of a tree of n leaves."""
    have, level = set(places), 0
    while n > 1:
        runs = {i // FAN for i in have}
        yield from ((level, j) for r in sorted(runs) for j in range(r * FAN, min(r * FAN + FAN, n)) if j not in have)
        have, n, level = runs, up(n), level + 1


def runs_to_root(leaves: dict[int, str], n: int, fetched: dict[tuple[int, int], str]) -> tuple[list[dict[int, str]], str]:
    """(the digests of each run, joined, by level and place; the root), each interior hashed once."""
    have, level, out = leaves, 0, []
    while n > 1:
        runs = {r: "".join(have[j] if j in have else fetched[level, j] for j in range(r * FAN, min(r * FAN + FAN, n))) for r in {i // FAN for i in have}}
        out.append(runs)
        have, n, level = {r: digest(joined) for r, joined in runs.items()}, up(n), level + 1
    return out, have[0]


def path(place: int, levels: list[dict[int, str]]) -> Iterator[tuple[str, str]]:
    """(what stands before, what stands behind) the node at and above place, in each level's run."""
    for runs in levels:
        joined, at = runs[place // FAN], 64 * (place % FAN)
        yield joined[:at], joined[at + 64 :]
        place //= FAN


PROOF = "tree string, idx long, doc_id long, leaf string, subroot string, root string, siblings array<string>, proof_sha256 string, folded_root string, verified boolean"


def proofs(m: Manifest, asked: DataFrame | None = None, siblings: bool = False) -> DataFrame:
    """PROOF rows for the leaves asked for (rows of m.leaves, all by default), each with its proof and the root that it gives.

    asked may have a column presented: the leaf of what is held against the manifest (null: the leaf itself). folded_root is
    the root that it and the manifest's siblings give, verified whether that is the manifest's. siblings: digests from the leaf's level up, left to right (null unless asked for).
    """
    asked = m.leaves if asked is None else asked
    presented = F.col("presented") if "presented" in asked.columns else F.lit(None).cast("binary")
    part = F.floor(F.col("idx") / PART).alias("part")
    placed = asked.select("tree", "idx", "n", "doc_id", "leaf", presented.alias("presented"), part).join(m.trees.select("tree", "top", "tops"), "tree")
    root = m.root

    def needs(table: pa.Table) -> pa.Table:
        tree, share, n, top, tops = (table[c][0].as_py() for c in ("tree", "part", "n", "top", "tops"))
        rows = [(tree, *x) for x in lacking(table["idx"].to_pylist(), n)] + [(TOP, *x) for x in lacking([top], tops)]
        at, level, idx = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"tree": pa.array([tree] * len(rows), pa.string()), "part": pa.array([share] * len(rows), pa.int64()), "at": pa.array(at, pa.string()), "level": pa.array(level, pa.int32()), "idx": pa.array(idx, pa.int64())})

    wanted = placed.select("tree", "part", "idx", "n", "top", "tops").groupBy("tree", "part").applyInArrow(needs, "tree string, part long, at string, level int, idx long")
    wanted = staged(wanted, "wanted")
    low = wanted.filter(f"level = 0 AND at <> '{TOP}'").join(m.leaves.select(F.col("tree").alias("at"), "idx", F.col("leaf").alias("digest")), ["at", "idx"])
    high = wanted.filter(f"level > 0 OR at = '{TOP}'").join(m.nodes.withColumnRenamed("tree", "at"), ["at", "level", "idx"])
    fetched = high.select("tree", "part", "at", "level", "idx", "digest").unionByName(low.select("tree", "part", "at", "level", "idx", "digest"))

    def expand(key: tuple, leaves: pa.Table, lacked: pa.Table) -> pa.Table:
        known: dict[str, dict] = {"own": {}, TOP: {}}
        for at, level, idx, value in zip(*(lacked[c].to_pylist() for c in ("at", "level", "idx", "digest")), strict=True):
            known[TOP if at == TOP else "own"][level, idx] = value.hex()
        tree, n, top, tops = (leaves[c][0].as_py() for c in ("tree", "n", "top", "tops"))
        places, own = leaves["idx"].to_pylist(), [x.hex() for x in leaves["leaf"].to_pylist()]
        inner, subroot = runs_to_root(dict(zip(places, own, strict=True)), n, known["own"])
        outer, derived = runs_to_root({top: subroot}, tops, known[TOP])
        ahead = list(path(top, outer))
        listed, hashes, folded = [], [], []
        for place, leaf, shown in zip(places, own, leaves["presented"].to_pylist(), strict=True):
            steps = [*path(place, inner), *ahead]
            others = "".join(a + b for a, b in steps)
            node = leaf if shown is None else shown.hex()
            for a, b in steps:
                node = digest(a, node, b)
            listed.append([others[i : i + 64] for i in range(0, len(others), 64)] if siblings else None)
            hashes.append(digest(others))
            folded.append(node)
        size = len(places)
        return pa.table({"tree": pa.array([tree] * size, pa.string()), "idx": pa.array(places, pa.int64()), "doc_id": leaves["doc_id"], "leaf": own, "subroot": [subroot] * size, "root": [derived] * size, "siblings": pa.array(listed, pa.list_(pa.string())), "proof_sha256": hashes, "folded_root": folded, "verified": [x == root for x in folded]})

    return placed.groupBy("tree", "part").cogroup(fetched.groupBy("tree", "part")).applyInArrow(expand, PROOF)


def tampered() -> Column:
    """The leaf with the text's A-Z in lower case, for rows whose crc32 of the decimal doc_id 3 divides; null for others and for rows without an id."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf_hash(text=F.translate("text", UPPER, LOWER)))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(documents(spark, sf_dir), presented=tampered())
    return proofs(m).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_CRC = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT)), lambda crc, b: list_reduce(range(8), lambda x, i: xor(CAST(x AS UBIGINT) >> 1, CASE WHEN CAST(x AS UBIGINT) % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END), xor(crc, b)), 4294967295::UBIGINT), 4294967295::UBIGINT)"
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
_SMALL = f"translate(text, '{UPPER}', '{LOWER}')"
_TAMPERED = _LEAF.replace(_FIELD.format("text"), _FIELD.format(_SMALL))

OP12_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_LEAF} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_TAMPERED} ELSE {_LEAF} END AS shown FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l),
nodes AS (SELECT tree, 0 AS level, place, leaf AS digest FROM leaves
  UNION ALL SELECT tree, level, place, digest FROM (SELECT tree, max(level) + 1 AS level, place // 8 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY tree, place // 8)),
subroots AS (SELECT tree, arg_max(digest, level) AS subroot FROM nodes WHERE place = 0 GROUP BY tree),
heads AS (SELECT tree AS name, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, subroot FROM subroots),
above AS (SELECT tree, 0 AS level, place, subroot AS digest FROM heads
  UNION ALL SELECT tree, level, place, digest FROM (SELECT tree, max(level) + 1 AS level, place // 8 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM above) WHERE n > 1 GROUP BY tree, place // 8)),
tops AS (SELECT arg_max(digest, level) AS root FROM above WHERE place = 0),
runs AS (SELECT tree, level, place // 8 AS place, string_agg(digest, '' ORDER BY place) AS joined, max(level) OVER (PARTITION BY tree) AS height FROM (SELECT * FROM nodes UNION ALL SELECT * FROM above) GROUP BY tree, level, place // 8),
up AS (SELECT doc_id, tree, leaf, 0 AS level, place, shown AS folded, '' AS others FROM leaves
  UNION ALL SELECT u.doc_id, u.tree, u.leaf, u.level + 1, u.place // 8, sha256(substr(r.joined, 1, 64 * (u.place % 8)) || u.folded || substr(r.joined, 64 * (u.place % 8) + 65)), u.others || substr(r.joined, 1, 64 * (u.place % 8)) || substr(r.joined, 64 * (u.place % 8) + 65)
  FROM up u JOIN runs r ON r.tree = u.tree AND r.level = u.level AND r.place = u.place // 8 AND r.level < r.height),
tip AS (SELECT u.doc_id, u.tree AS name, u.leaf, 0 AS level, h.place, u.folded, u.others FROM up u JOIN heads h ON h.name = u.tree JOIN (SELECT tree, max(level) AS height FROM nodes GROUP BY tree) x ON x.tree = u.tree AND x.height = u.level),
ends AS (SELECT * FROM tip
  UNION ALL SELECT u.doc_id, u.name, u.leaf, u.level + 1, u.place // 8, sha256(substr(r.joined, 1, 64 * (u.place % 8)) || u.folded || substr(r.joined, 64 * (u.place % 8) + 65)), u.others || substr(r.joined, 1, 64 * (u.place % 8)) || substr(r.joined, 64 * (u.place % 8) + 65)
  FROM ends u JOIN runs r ON r.tree = '' AND r.level = u.level AND r.place = u.place // 8 AND r.level < r.height)
SELECT e.doc_id, e.leaf, s.subroot, t.root, sha256(e.others) AS proof_sha256, e.folded AS folded_root, e.folded = t.root AS verified
FROM ends e JOIN subroots s ON s.tree = e.name CROSS JOIN tops t WHERE e.level = (SELECT max(level) FROM above)
"""
