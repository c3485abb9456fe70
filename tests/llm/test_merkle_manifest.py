"""Operator 13 against a plain recursive tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sightline.llm import merkle_manifest, queries
from sightline.llm.ordered import positions

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, n string, hash string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def climb(tree, i, h):
    beside = ""
    for level in tree[:-1]:
        other = level[i ^ 1] if i ^ 1 < len(level) else ""
        h, beside, i = H(*([h, other] if i % 2 == 0 else [other, h])), beside + other, i // 2
    return h, beside


def brute(rows):
    first = lambda x: (x is not None, x if x is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == lang), key=lambda r: (first(r[0]), leaf(*r))) for lang in langs]
    trees = [levels([leaf(*r) for r in g]) for g in groups]
    upper = levels([t[-1][0] for t in trees])
    out = []
    for g, (group, tree) in enumerate(zip(groups, trees, strict=True)):
        for i, r in enumerate(group):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            h, below = climb(tree, i, leaf(*r[:4], r[4] + 1) if tampered else leaf(*r))
            root, above = climb(upper, g, h)
            out.append((r[0], leaf(*r), tree[-1][0], upper[-1][0], H(below + above), root, root == upper[-1][0]))
    return sorted(out, key=str)


def rows_of(n, langs, seed):
    rnd = random.Random(seed)
    texts = [None, "", "ä€𝄞 x", "plain", "a\nb" * 2000]
    return [(i * 3 - 7, rnd.choice(texts), rnd.choice(langs), rnd.choice(["s", None, ""]), rnd.choice([None, 5, -1, 2**63 - 1])) for i in range(n)]


@pytest.mark.parametrize("rows", [
    rows_of(1, ["en"], 1),
    rows_of(2, ["en"], 2),
    rows_of(300, ["en", "de", None, "", "Z", "ä"], 3) + [(5000 + i, "hot", "en", "s", 1) for i in range(130)],
    [(None, "x", None, None, None)] * 3 + [(7, "same", "en", "s", 4)] * 70 + [(7, "other", "en", "s", 4)],
    rows_of(65, [f"l{i}" for i in range(70)], 4),
], ids=["one", "two", "groups", "repeated", "many groups"])
def test_manifest_equals_brute_force(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1, "x", None) for r in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_merkle_manifest(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_merkle_manifest(spark, str(tmp_path)).count() == 0


def test_stored_preimages_hash_to_their_parents(spark):
    rows = rows_of(150, ["en"], 5)
    df = spark.createDataFrame([(*r, 1, "x", None) for r in rows], SCHEMA)
    built = merkle_manifest.manifest(df, "doc_id", "lang", {"leaf": merkle_manifest.leaf_hash([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])})
    tree = levels([leaf(*r) for r in sorted(rows)])
    stored = {(r.level, r.number): r.preimage for r in built.parents().collect()}
    assert len(stored) == sum(len(level) for level in tree[1:])
    for k, level in enumerate(tree[1:], 1):
        assert [H(stored[k, i]) for i in range(len(level))] == level


def test_positions_number_hot_groups_whole(spark):
    rows = [("hot", i % 3) for i in range(400)] + [(None, 9 - i) for i in range(10)] + [("b", None)]
    placed = positions(spark.createDataFrame(rows, "g string, x int").repartition(6), "g", "x").collect()
    for g in {r[0] for r in rows}:
        own = sorted((r.pos, r.x is not None, r.x or 0, r.n) for r in placed if r.g == g)
        assert [r[0] for r in own] == list(range(len(own))) and {r[3] for r in own} == {len(own)}
        assert [r[1:3] for r in own] == sorted(r[1:3] for r in own)
