"""Operator 12: trie of conversation prefixes by rolling fingerprints.

A conversation's turns, in order, are scanned by numpy: the fingerprint of its first d turns is a
polynomial in the hashes of these turns, modulo two primes. Turns are dealt out by a range sort, so a
conversation may span partitions: each partition scans its own part, and as prefix fingerprints compose
(f, B^n) with (g, B^m) to (f B^m + g, B^(n+m)), what precedes a part is added afterwards, from one row a
partition border. Prefixes of equal depth and fingerprint are candidates for one node. Every group is
verified turn by turn: its members' last turns (role and text themselves) and verified parents must be
those of its representative, the smallest conversation; equal ones are combined before the shuffle, so a
node of very many members is a few rows. Members that differ are split off under new labels, and all
groups are verified again, until none differs: then, by induction over depth, a node's members have the
same turns throughout.

Subtree sums need no pass a level: conversation r is the smallest member of the nodes at the end of its
own path only, so a suffix sum along that chain is what it adds to these nodes, and the whole sum what it
adds to each node above. Hashes of member lists stream over sorted chunks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import bound_batches, crc_sql, crc_table_sql, give_back, stage_table
from sightline.llm.ordered import MAX_FRAGMENTS, integral, sorted_ranges

#: (prime, base) of the two fingerprints.
MODULI = ((2147483647, 1103515245), (2147483629, 845106313))
#: Depths in a window of the suffix sums.
CHAIN = 4096
#: Ids in a chunk of a member list.
CHUNK = 4096
ROUNDS = 10_000


def powers(base: int, n: int, prime: int) -> np.ndarray:
    """base ** 0 .. base ** n, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) <= n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[: n + 1]


class Scan:
    """Prefix fingerprints of the runs of one conversation in a stream of batches."""

    def __init__(self, moduli=MODULI):
        self.moduli, self.last, self.steps, self.state = moduli, None, 0, [0] * len(moduli)

    def __call__(self, conv: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Step within the run (from 1), and for each modulus the fingerprint and base ** step."""
        n, rows = len(conv), np.arange(len(conv))
        fresh = np.ones(n, bool)
        fresh[1:] = conv[1:] != conv[:-1]
        fresh[0] = self.last is None or conv[0] != self.last
        begin = np.maximum.accumulate(np.where(fresh, rows, -1))
        carried = begin < 0
        step = np.where(carried, self.steps + rows + 1, rows - begin + 1)
        prints, scales = [], []
        for k, (prime, base) in enumerate(self.moduli):
            p = np.uint64(prime)
            up, down = powers(base, n, prime), powers(pow(base, -1, prime), n, prime)
            values = np.mod(codes, prime).astype(np.uint64) * down[:n] % p
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])  # below 2 ** 31 each
            before = total[np.maximum(begin, 0)]
            found = (total[1:] - before) % p * up[:n] % p
            scale = np.where(carried, np.uint64(pow(base, self.steps, prime)) * up[rows + 1] % p, up[np.minimum(step, n)])
            found = np.where(carried, (found + np.uint64(self.state[k]) * up[rows + 1]) % p, found)
            prints.append(found.astype(np.int64))
            scales.append(scale.astype(np.int64))
        self.last, self.steps, self.state = conv[-1], int(step[-1]), [int(x[-1]) for x in prints]
        return step, prints, scales


def scan_turns(df: DataFrame, *order: str, moduli=MODULI, label: str = "turns") -> DataFrame:
    """(conv, pos, f1, f2, role, text): turns numbered from 1 and prefix fingerprints; ``order`` within a conversation, nulls first."""
    bound_batches(df.sparkSession)
    coded = df.withColumn("__code", F.xxhash64("role", "text"))

    def scan(batches):
        run = Scan(moduli)
        for batch in batches:
            if batch.num_rows:
                step, prints, scales = run(batch.column("conv").to_numpy(zero_copy_only=False), batch.column("__code").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv", "role", "text")] + [pa.array(x) for x in (step, *prints, *scales)], names=["conv", "role", "text", "step", "a1", "a2", "b1", "b2"])

    schema = "conv long, role string, text string, step long, a1 long, a2 long, b1 long, b2 long"
    scanned = sorted_ranges(coded, "conv", *order).select("conv", "role", "text", "__code").mapInArrow(lambda b: give_back(scan(b)), schema)
    rows = stage_table(scanned.withColumn("part", F.spark_partition_id()), label)
    before = _borders(rows, moduli, label)
    rows = rows.join(before, ["conv", "part"], "left")
    (p1, _), (p2, _) = moduli
    whole = lambda g, a, b, p: (F.coalesce(g, F.lit(0)) * F.col(b) + F.col(a)) % p
    return rows.select("conv", (F.col("step") + F.coalesce("n", F.lit(0))).alias("pos"), whole("g1", "a1", "b1", p1).alias("f1"), whole("g2", "a2", "b2", p2).alias("f2"), "role", "text")


def _borders(rows: DataFrame, moduli, label: str) -> DataFrame:
    """(conv, part, n, g1, g2): turns and fingerprint before a part, for conversations in several parts; two rows a partition at most."""
    last = F.max_by(F.struct("a1", "a2", "b1", "b2"), "step")
    parts = rows.groupBy("conv", "part").agg(F.max("step").alias("steps"), last.alias("f"))
    spans = parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "steps", "f"))).alias("parts")).where(F.size("parts") > 1)
    (p1, _), (p2, _) = moduli
    kind = "struct<n: bigint, g1: bigint, g2: bigint, out: array<struct<part: int, n: bigint, g1: bigint, g2: bigint>>>"
    zero = F.lit(0).cast("long")

    def on(state: Column, x: Column) -> Column:
        add = F.array(F.struct(x["part"].alias("part"), state["n"].alias("n"), state["g1"].alias("g1"), state["g2"].alias("g2")))
        return F.struct((state["n"] + x["steps"]).alias("n"), ((state["g1"] * x["f"]["b1"] + x["f"]["a1"]) % p1).alias("g1"), ((state["g2"] * x["f"]["b2"] + x["f"]["a2"]) % p2).alias("g2"), F.concat(state["out"], add).alias("out"))

    start = F.struct(zero.alias("n"), zero.alias("g1"), zero.alias("g2"), F.array().cast(kind[kind.index("array") : -1]).alias("out"))
    out = spans.select("conv", F.explode(F.aggregate("parts", start, on)["out"]).alias("x")).select("conv", "x.*")
    out = stage_table(out, f"{label}-borders")
    return F.broadcast(out) if out.count() <= MAX_FRAGMENTS else out


def ordered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos from 1, role, text) of every conversation, by turn (nulls first), ties by role and text.

    Null role and text become empty. Rows without a conversation id belong to no conversation and are left out.
    """
    turns = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text")))).where("conv IS NOT NULL")
    return scan_turns(turns, "turn", "role", "text", label="original-turns").select("conv", "pos", "role", "text")


def share_heads(turns: DataFrame, family: int = 100, modulus: int = 6) -> DataFrame:
    """(conv, origin, pos, role, text): a conversation's first h turns replaced by those of its family's first one.

    ``turns`` as of ``ordered_turns``. The family's first conversation is c - c % family (remainders have the sign of c);
    h is the crc32 of c as text, modulo ``modulus``. A family has few conversations, and few head turns each.
    """
    h = lambda c: F.crc32(c.cast("string").cast("binary")) % modulus
    conv = F.col("conv")
    own = turns.where((conv % family == 0) | (F.col("pos") > h(conv))).select("conv", F.lit(1).alias("origin"), "pos", "role", "text")
    heads = turns.where((conv % family == 0) & (F.col("pos") < modulus)).withColumnRenamed("conv", "base")
    convs = turns.select("conv").distinct().where(conv % family != 0).withColumn("base", conv - conv % family)
    given = convs.join(heads, "base").where(F.col("pos") <= h(conv)).select("conv", F.lit(0).alias("origin"), "pos", "role", "text")
    return given.unionByName(own)


def prefix_trie(turns: DataFrame, order: tuple[str, ...], members: DataFrame | None = None, moduli=MODULI) -> DataFrame:
    """One row a distinct prefix of conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv (long), the columns ``order``, role and text (strings, not null); ``members``: further
    conversations (conv), without turns. A node is named by its smallest member and depth; ``ends_sha256`` is
    the SHA-256 of the members that end there, ascending and joined by commas. Without any conversation there
    is no node.
    """
    scanned = scan_turns(turns.select("conv", *order, "role", "text"), *order, moduli=moduli)
    (p1, b1), (p2, b2) = moduli
    back = lambda f, p, b: F.pmod((F.col(f) - F.pmod(F.xxhash64("role", "text"), F.lit(p)) + p) * pow(b, -1, p), F.lit(p))
    pack = lambda x, y: F.shiftleft(x, 31).bitwiseOR(y)
    first = F.col("pos") == 1
    rows = scanned.select("conv", F.col("pos").alias("depth"), pack(F.col("f1"), F.col("f2")).alias("label"), F.when(first, F.lit(0).cast("long")).otherwise(pack(back("f1", p1, b1), back("f2", p2, b2))).alias("plabel"), "role", "text")
    rows, found = _verified(rows)

    numbers = rows.select("conv", "depth", "label")
    last = numbers.groupBy("conv").agg(F.max("depth").alias("depth"), F.max_by("label", "depth").alias("label"))
    if members is not None:
        empty = members.select(F.col("conv").cast("long")).where("conv IS NOT NULL").select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("label"))
        last = last.unionByName(empty).groupBy("conv").agg(F.max("depth").alias("depth"), F.max_by("label", "depth").alias("label"))
    last = stage_table(last, "trie-ends")
    root = last.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).where("n > 0").select(*(F.lit(0).cast("long").alias(c) for c in ("depth", "label")), F.lit(None).cast("long").alias("plabel"), F.lit(0).cast("long").alias("size"), "conv", "n")
    nodes = found.unionByName(root)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("plabel").alias("label")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage_table(nodes.join(children, ["depth", "label"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")

    sums = _subtree_sums(nodes, numbers, last)
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("label").alias("plabel"), F.col("conv").alias("parent_conv_id"))
    out = nodes.join(sums, ["depth", "label"]).join(_end_digests(last), ["depth", "label"], "left").join(parent, ["depth", "plabel"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def _verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with labels that only equal prefixes share, and (depth, label, plabel, size, conv, n) of their groups."""
    start, moved = rows, None
    for k in range(ROUNDS):
        rows = start if moved is None else _relabelled(start, moved)
        # A row for each distinct last turn and parent in a group: one, if nothing has collided.
        turns = rows.groupBy("depth", "label", "plabel", "role", "text").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"))
        found = stage_table(turns.select("depth", "label", "plabel", F.length("text").cast("long").alias("size"), "conv", "n"), "trie-groups")
        mixed = found.groupBy("depth", "label").agg(F.count(F.lit(1)).alias("kinds"), F.min("conv").alias("head")).where("kinds > 1").select("depth", "label", "head")
        mixed = stage_table(mixed, "trie-mixed")
        if mixed.isEmpty():
            return rows, found
        # The representative's kind keeps the label; the others get labels of their own.
        there = rows.join(mixed, ["depth", "label"])
        kind = ["depth", "label", "plabel", "role", "text"]
        other = there.groupBy(*kind).agg(F.min("conv").alias("least"), F.min("head").alias("head")).where("least <> head")
        fresh = F.xxhash64(F.lit(k), "label", "plabel", "role", "text").bitwiseAND((1 << 62) - 1)
        new = there.join(other.select(*kind), kind).select("conv", "depth", fresh.alias("moved"))
        moved = stage_table(new if moved is None else new.unionByName(moved.join(new.select("conv", "depth"), ["conv", "depth"], "left_anti")), "trie-moved")
    raise RuntimeError(f"fingerprints still collide after {ROUNDS} rounds")


def _relabelled(rows: DataFrame, moved: DataFrame) -> DataFrame:
    above = moved.select("conv", (F.col("depth") + 1).alias("depth"), F.col("moved").alias("above"))
    joined = rows.join(moved, ["conv", "depth"], "left").join(above, ["conv", "depth"], "left")
    return joined.select("conv", "depth", F.coalesce("moved", "label").alias("label"), F.coalesce("above", "plabel").alias("plabel"), "role", "text")


def _subtree_sums(nodes: DataFrame, numbers: DataFrame, last: DataFrame) -> DataFrame:
    """(depth, label, n_leaves, saved_tokens), summed over each node's subtree."""
    own = nodes.select("conv", "depth", "label", ((F.col("n") - 1) * F.col("size")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"), integral(F.col("depth"), CHAIN).alias("block"))
    down = Window.partitionBy("conv", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    chain = own.withColumns({c: F.sum(c).over(down) for c in ("saved", "leaf")})
    deepest = nodes.agg(F.max("depth").alias("d")).first()["d"] or 0
    if deepest >= CHAIN:  # what the deeper blocks of a long chain add
        deeper = Window.partitionBy("conv").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
        blocks = own.groupBy("conv", "block").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l")).select("conv", "block", *(F.coalesce(F.sum(c).over(deeper), F.lit(0)).alias(c) for c in ("s", "l")))
        chain = chain.join(blocks, ["conv", "block"]).withColumns({"saved": F.col("saved") + F.col("s"), "leaf": F.col("leaf") + F.col("l")})
    whole = own.groupBy("conv").agg(F.min("depth").alias("top"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    above = numbers.join(whole, "conv").where("depth < top").select("depth", "label", "saved", "leaf")
    roots = last.join(whole, "conv").where("top > 0").select(*(F.lit(0).cast("long").alias(c) for c in ("depth", "label")), "saved", "leaf")
    added = chain.select("depth", "label", "saved", "leaf").unionByName(above.select("depth", "label", "saved", "leaf")).unionByName(roots.select("depth", "label", "saved", "leaf"))
    return added.groupBy("depth", "label").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _end_digests(last: DataFrame) -> DataFrame:
    """(depth, label, ends_sha256) of the nodes at which conversations end: chunks of sorted ids, then one stream a node."""

    def chunks(batches):
        for batch in batches:
            depth, label, conv = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("depth", "label", "conv"))
            cut = np.flatnonzero(np.concatenate([[True], (depth[1:] != depth[:-1]) | (label[1:] != label[:-1])])) if batch.num_rows else np.zeros(0, np.int64)
            bounds = [*cut.tolist(), batch.num_rows]
            parts = [(a, min(a + CHUNK, end)) for begin, end in zip(bounds, bounds[1:], strict=False) for a in range(begin, end, CHUNK)]
            begins = np.array([a for a, _ in parts], np.int64)
            ids = [",".join(map(str, conv[a:b].tolist())) for a, b in parts]
            yield pa.RecordBatch.from_arrays([pa.array(depth[begins]), pa.array(label[begins]), pa.array(conv[begins]), pa.array(ids, pa.string())], names=["depth", "label", "conv", "ids"])

    def digests(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for depth, label, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "label", "ids")), strict=True):
                if (depth, label) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (depth, label), hashlib.sha256(ids.encode())
            yield _rows(out)
        if key is not None:
            yield _rows([(*key, state.hexdigest())])

    sorted_ids = sorted_ranges(last.select("depth", "label", "conv"), "depth", "label", "conv")
    listed = sorted_ids.mapInArrow(chunks, "depth long, label long, conv long, ids string")
    dealt = listed.repartition("depth", "label").sortWithinPartitions("depth", "label", "conv")
    return dealt.mapInArrow(digests, "depth long, label long, ends_sha256 string")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["depth", "label", "ends_sha256"])


def oracle_sql(table: str = "conversations") -> str:
    """DuckDB SQL for the rows of the registered query: prefixes as lists of turns."""
    return f"""
WITH crc AS MATERIALIZED ({crc_table_sql()}),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {table} WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 100 AS base, {crc_sql("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM t), crc),
rebuilt AS (
  SELECT v.c, 0 AS origin, pos, role, text FROM convs v JOIN t ON t.c = v.base WHERE pos <= h
  UNION ALL SELECT v.c, 1, pos, role, text FROM convs v JOIN t ON t.c = v.c WHERE pos > h),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY origin, pos) AS depth, strlen(role) || ':' || role || strlen(text) || ':' || text AS turn, length(text) AS size FROM rebuilt),
paths AS MATERIALIZED (SELECT c, depth, size, sha256(string_agg(turn, '') OVER (PARTITION BY c ORDER BY depth)) AS node FROM turns
  UNION ALL SELECT c, 0, 0, 'root' FROM convs),
linked AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY depth) AS above, depth = max(depth) OVER (PARTITION BY c) AS ends FROM paths),
nodes AS MATERIALIZED (SELECT node, depth, min(c) AS conv_id, count(*) AS n, any_value(size) AS size, any_value(above) AS above, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS ends FROM linked GROUP BY node, depth),
kids AS (SELECT above AS node, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
under AS (SELECT a.node, b.node AS below FROM paths a JOIN paths b ON a.c = b.c AND b.depth >= a.depth GROUP BY 1, 2),
sums AS (SELECT u.node, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum((b.n - 1) * b.size) AS saved FROM under u JOIN nodes b ON b.node = u.below LEFT JOIN kids k ON k.node = u.below GROUP BY u.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN kids k USING (node) LEFT JOIN nodes p ON p.node = n.above"""
