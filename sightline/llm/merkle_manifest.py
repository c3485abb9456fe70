"""Operator 13: Merkle dataset manifest with stored parent preimages.

Rows are leaves: SHA-256 of their length-delimited fields. Each group's leaves, in key order, are
hashed pairwise level by level to a subroot, and the subroots, in group order, to the root. What is
stored for a parent is its preimage, the concatenated hashes of its children, in blocks: one row holds
the preimages of ``DEPTH`` levels over ``FAN ** DEPTH`` consecutive nodes, so a level of the loop
climbs six levels and shrinks the table 64 times. A leaf joins the preimages of its ancestors (its own
block's, which carries the path above it): a sibling is what is left of a preimage when the leaf's own
64 characters are cut out, and a changed leaf is folded upwards by putting the new hash into that slot.

Positions come from a range sort (``ordered.positions``), so a group with a third of all rows is dealt
out; texts are read once, and every later step moves hashes only. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import crc_sql, crc_table_sql, stage_table
from sightline.llm.ordered import integral, positions

FAN = 2
DEPTH = 6
_HEX = 64


def field(column: Column) -> Column:
    """``-`` if null, else UTF-8 byte count, ``:`` and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_hash(fields: Sequence[Column]) -> Column:
    return digest(*(field(c) for c in fields))


@dataclass
class Manifest:
    """``leaves``: key, group, the leaf hashes and pos; ``blocks``: stored preimages by level of blocks; ``top``: those over the subroots."""

    leaves: DataFrame
    blocks: list[DataFrame]
    top: list[DataFrame]
    roots: DataFrame

    def parents(self) -> DataFrame:
        """(grp, level from 1, number within the level, preimage) of every stored parent below the subroots."""
        out = None
        for k, blocks in enumerate(self.blocks):
            rows = blocks.select("grp", "block", F.posexplode("preimages").alias("l", "level_preimages"))
            rows = rows.select("grp", "block", "l", F.posexplode("level_preimages").alias("i", "preimage"))
            width = F.pow(F.lit(FAN), F.lit(DEPTH - 1) - F.col("l")).cast("long")
            rows = rows.select("grp", (F.col("l") + 1 + k * DEPTH).cast("int").alias("level"), (F.col("block") * width + F.col("i")).alias("number"), "preimage")
            out = rows if out is None else out.unionByName(rows)
        return out

    def paths(self) -> DataFrame:
        """The leaves with ``path`` (slot and preimage of every ancestor from below), ``subroot`` and ``root``."""
        start = self.top[-1].select("grp", "block", F.array().cast(_PATH).alias("above"), F.col("hash").alias("root"))
        above = _descend(self.top, start, ["root"])
        subroots = _attach(self.roots, self.top[0], above, ["root"]).select("g", F.col("path").alias("above"), "root", F.col("hash").alias("subroot"))
        start = self.blocks[-1].join(subroots, F.col("grp").eqNullSafe(F.col("g"))).select("grp", "block", "above", "root", "subroot")
        return _attach(self.leaves, self.blocks[0], _descend(self.blocks, start, ["root", "subroot"]), ["root", "subroot"])


_PATH = "array<struct<slot: int, preimage: string>>"


def manifest(df: DataFrame, key: str, group: str, leaves: dict[str, Column], label: str = "manifest") -> Manifest:
    """The manifest of a table: one leaf a row, a tree for each value of ``group``, a tree over these.

    ``leaves`` maps names to leaf hashes (see ``leaf_hash``): the first is what the trees are built of,
    others, such as those of changed rows, are kept beside it. Order within a group: key, nulls first,
    rows of one key by their hash (repeated rows are leaves of their own). Groups: nulls first, then
    bytewise. A table without rows has no leaf and no root.
    """
    first = next(iter(leaves))
    rows = stage_table(df.select(F.col(key).alias("key"), F.col(group).alias("grp"), *(c.alias(name) for name, c in leaves.items())), f"{label}-leaves")
    placed = stage_table(positions(rows, "grp", "key", first, label=label), f"{label}-placed")
    blocks = _climb(placed.select("grp", "pos", "n", F.col(first).alias("hash")), label)
    subroots = stage_table(blocks[-1].select(F.lit(0).alias("grp"), F.col("grp").alias("g"), "hash"), f"{label}-subroots")
    roots = stage_table(positions(subroots, "grp", "g", label=f"{label}-top"), f"{label}-roots")
    return Manifest(placed, blocks, _climb(roots.select("grp", "pos", "n", "hash"), f"{label}-top"), roots)


def _climb(nodes: DataFrame, label: str) -> list[DataFrame]:
    """Blocks of preimages, level of blocks by level of blocks, until every group has one node."""
    size, out = FAN**DEPTH, []
    most = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    while True:
        out.append(stage_table(_blocks(nodes), f"{label}-blocks"))
        most = -(-most // size)
        if most <= 1:
            return out
        nodes = out[-1].select("grp", F.col("block").alias("pos"), "n", "hash")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(grp, block, preimages by level, hash of the block's top, n nodes of the next level) of consecutive nodes."""
    size = FAN**DEPTH
    gathered = nodes.groupBy("grp", integral(F.col("pos"), size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("nodes"), F.max("n").alias("n"))
    levels = F.lit(DEPTH)
    for k in reversed(range(DEPTH)):  # a small tree ends below the block's top
        levels = F.when(F.col("n") <= FAN**k, k).otherwise(levels)
    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))

    def parents(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), integral(F.size(hashes) - 1, FAN).cast("int")), lambda i: F.array_join(F.slice(hashes, i * FAN + 1, FAN), ""))

    def up(state: Column, _: Column) -> Column:
        own = parents(state["hashes"])
        return F.struct(F.transform(own, lambda x: digest(x)).alias("hashes"), F.concat(state["preimages"], F.array(own)).alias("preimages"))

    start = F.struct(F.transform("nodes", lambda x: x["hash"]).alias("hashes"), F.array().cast("array<array<string>>").alias("preimages"))
    built = gathered.select("grp", "block", F.aggregate(steps, start, up).alias("t"), integral(F.col("n") + (size - 1), size).alias("n"))
    return built.select("grp", "block", F.col("t.preimages").alias("preimages"), F.col("t.hashes")[0].alias("hash"), "n")


def _path(preimages: str, pos: Column) -> Column:
    """Slot and preimage of a node's ancestors within its block."""
    power = lambda k: F.pow(F.lit(FAN), k).cast("long")
    inside = pos % F.lit(FAN**DEPTH)
    return F.transform(preimages, lambda level, k: F.struct((integral(inside, power(k)) % FAN).cast("int").alias("slot"), F.get(level, integral(inside, power(k + 1)).cast("int")).alias("preimage")))


def _attach(nodes: DataFrame, blocks: DataFrame, above: DataFrame, carried: list[str]) -> DataFrame:
    """Nodes (grp, pos) with their path to the root: from their block, and what stands above it."""
    right = blocks.select("grp", "block", "preimages").join(above.select(F.col("grp").alias("a"), F.col("block").alias("b"), "above", *carried), F.col("grp").eqNullSafe(F.col("a")) & (F.col("block") == F.col("b")))
    right = right.select(F.col("grp").alias("__g"), F.col("block").alias("__b"), "preimages", "above", *carried)
    joined = nodes.join(right, F.col("grp").eqNullSafe(F.col("__g")) & (integral(F.col("pos"), FAN**DEPTH) == F.col("__b")))
    return joined.select(*nodes.columns, F.concat(_path("preimages", F.col("pos")), F.col("above")).alias("path"), *carried)


def _descend(blocks: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """(grp, block, above) of the lowest blocks, given that of the highest: each level joins the one over it."""
    for k in reversed(range(1, len(blocks))):
        nodes = blocks[k - 1].select("grp", F.col("block").alias("pos"))
        above = _attach(nodes, blocks[k], above, carried).select("grp", F.col("pos").alias("block"), F.col("path").alias("above"), *carried)
    return above


def siblings(path: str | Column) -> Column:
    """The other children of all ancestors, from below: preimages without the own slot."""
    return F.array_join(F.transform(path, lambda x: F.concat(*_around(x))), "")


def fold(start: Column, path: str | Column) -> Column:
    """The root that a leaf hash leads to with the given path."""

    def up(state: Column, x: Column) -> Column:
        left, right = _around(x)
        return digest(left, state, right)

    return F.aggregate(path, start, up)


def _around(x: Column) -> tuple[Column, Column]:
    return F.substring(x["preimage"], F.lit(1), x["slot"] * _HEX), F.substring(x["preimage"], x["slot"] * _HEX + _HEX + 1, F.length(x["preimage"]))


def verify(built: Manifest, leaf: str, changed: str | None = None) -> DataFrame:
    """Every leaf with subroot, root, proof_sha256, the root folded from ``changed`` (where not null) and whether it is the root."""
    start = F.coalesce(changed, leaf) if changed else F.col(leaf)
    rows = built.paths().select("key", "grp", F.col(leaf).alias("leaf"), "subroot", "root", digest(siblings("path")).alias("proof_sha256"), fold(start, "path").alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(table: str = "documents") -> str:
    """DuckDB SQL for the rows of the registered query: trees as lists, a recursive step a level."""
    part = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
    leaf = lambda n: f"sha256({' || '.join(part.format(x) for x in ('doc_id', 'source', 'lang', n, 'text'))})"
    up = "list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))"
    beside = "coalesce(CASE WHEN {p} % 2 = 0 THEN nodes[{p} + 2] ELSE nodes[{p}] END, '')"
    side, top = beside.format(p="p"), beside.format(p="g")
    return f"""
WITH RECURSIVE crc AS MATERIALIZED ({crc_table_sql()}),
d AS (SELECT doc_id, lang, {leaf("n_chars")} AS leaf, CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {leaf("(n_chars::HUGEINT + 1)")} END AS changed FROM {table}, crc),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM d),
trees AS (SELECT g, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY g
  UNION ALL SELECT g, level + 1, {up} FROM trees WHERE len(nodes) > 1),
subroots AS MATERIALIZED (SELECT g, nodes[1] AS subroot FROM trees WHERE len(nodes) = 1),
upper AS (SELECT 0 AS level, list(subroot ORDER BY g) AS nodes FROM subroots
  UNION ALL SELECT level + 1, {up} FROM upper WHERE len(nodes) > 1),
tops AS MATERIALIZED (SELECT nodes[1] AS root FROM upper WHERE len(nodes) = 1),
walk AS (SELECT g AS own, pos AS k, doc_id, leaf, 0 AS level, pos AS p, coalesce(changed, leaf) AS h, '' AS beside FROM placed
  UNION ALL SELECT own, k, doc_id, leaf, w.level + 1, p // 2, sha256(CASE WHEN p % 2 = 0 THEN h || {side} ELSE {side} || h END), w.beside || {side}
  FROM walk w JOIN trees t ON t.g = w.own AND t.level = w.level AND len(nodes) > 1),
climbed AS MATERIALIZED (SELECT own, k, arg_max(h, level) AS h, arg_max(beside, level) AS beside FROM walk GROUP BY own, k),
last AS (SELECT own, k, 0 AS level, own AS g, h, beside FROM climbed
  UNION ALL SELECT own, k, l.level + 1, g // 2, sha256(CASE WHEN g % 2 = 0 THEN h || {top} ELSE {top} || h END), l.beside || {top}
  FROM last l JOIN upper u ON u.level = l.level AND len(nodes) > 1),
folded AS (SELECT own, k, arg_max(h, level) AS h, arg_max(beside, level) AS beside FROM last GROUP BY own, k)
SELECT p.doc_id, p.leaf, s.subroot, t.root, sha256(f.beside) AS proof_sha256, f.h AS folded_root, f.h = t.root AS verified
FROM placed p JOIN folded f ON f.own = p.g AND f.k = p.pos JOIN subroots s ON s.g = p.g CROSS JOIN tops t"""
