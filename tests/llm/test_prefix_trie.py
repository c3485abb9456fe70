"""Operator 12 against a trie in dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sightline.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos int, label int"


def brute(convs):
    """Node rows of {conv: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, m in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, ())))).encode()).hexdigest()
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), kids[node], leaves[node], saved[node], digest))
    return sorted(out, key=str)


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    head = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: head[c]] + v[head[c] :] for c, v in own.items()}


def conversations(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(30), *range(100, 125), *range(201, 230), 10**12 + 5]:
        for turn in range(rnd.randrange(1, 8)):
            rows.append((c, rnd.choice([None, turn, turn]), rnd.choice(["user", "system", None]), rnd.choice(["a", "", None, "ä€𝄞", "b" * 40])))
    rows += rows[:20] + [(None, 1, "user", "lost")]
    return rows


@pytest.fixture()
def cut(spark):
    """Range partitions stay small, so that conversations span several."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_query_equals_brute_force(spark, tmp_path):
    rows = conversations(1)
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((tuple(r) for r in queries.op12_prefix_trie(spark, str(tmp_path)).collect()), key=str) == brute(rebuilt(rows))


def test_colliding_fingerprints_are_split(spark, cut):
    rnd = random.Random(2)
    convs = {c: [(rnd.choice("us"), rnd.choice("abc")) for _ in range(rnd.randrange(4))] for c in range(60)}
    rows = [(c, i, *turn) for c, turns in convs.items() for i, turn in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv long, pos int, role string, text string")
    found = prefix_trie.prefix_trie(turns, ("pos",), spark.createDataFrame([(c,) for c in convs], "conv long"), moduli=((5, 2), (3, 2)))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(convs)


def test_long_conversation_spans_partitions(spark, cut, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHAIN", 16)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    long = [("u", str(i % 7)) for i in range(300)]
    convs = {5: long, 3: long[:120] + [("u", "x")], 9: long, **{c: long[:2] for c in range(20, 40)}, 50: []}
    rows = [(c, i, *turn) for c, turns in convs.items() for i, turn in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv long, pos int, role string, text string").repartition(5)
    found = prefix_trie.prefix_trie(turns, ("pos",), spark.createDataFrame([(c,) for c in convs], "conv long"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(convs)


def test_empty_table_has_no_node(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op12_prefix_trie(spark, str(tmp_path)).count() == 0


def test_scan_equals_horner(spark):
    rnd = np.random.default_rng(3)
    conv, codes = np.sort(rnd.integers(0, 9, 500)), rnd.integers(-(2**63), 2**63 - 1, 500)
    scan, found = prefix_trie.Scan(), []
    for a in range(0, 500, 37):
        step, prints, scales = scan(conv[a : a + 37], codes[a : a + 37])
        found += zip(step.tolist(), *(x.tolist() for x in (*prints, *scales)), strict=True)
    f, last, step = [0, 0], None, 0
    for c, code, row in zip(conv.tolist(), codes.tolist(), found, strict=True):
        f, step = ([0, 0], 0) if c != last else (f, step)
        last, step = c, step + 1
        f = [(x * b + code) % p for x, (p, b) in zip(f, prefix_trie.MODULI, strict=True)]
        assert row == (step, *f, *(pow(b, step, p) for p, b in prefix_trie.MODULI))
