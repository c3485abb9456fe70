"""Duplicates of hot titles, and events kept batch by batch, against brute force."""

import random
from collections import Counter

from pyspark.sql import functions as F

from sightline.operators import demand, graph
from sightline.operators.incremental import EventStore
from tests.test_operators import observations

BASE = "aa bb cc dd ee ff gg hh ii jj".split()


def random_rows(seed, n):
    rnd = random.Random(seed)
    titles = [" ".join(BASE), " ".join(BASE[:9]), " ".join(BASE[:8] + ["zz"]), " ".join(BASE[:7] + ["xx", "yy", "ww"]), "", "other words here"]
    url = lambda: rnd.choice([None] * 8 + ["u", "w"])
    return [(url(), rnd.choice("pqr"), rnd.choice(titles), rnd.choice([None, *(float(36 * k) for k in range(60))]), rnd.choice(["search_observed", "generated_candidate"]), rnd.choice(["", "g", "h"]), rnd.random() < 0.2) for _ in range(n)]


def brute_groups(rows):
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, (u1, p1, t1, h1, *_) in enumerate(rows):
        for j in range(i):
            u2, p2, t2, h2, *_ = rows[j]
            a, b = set(t1.split()), set(t2.split())
            s = len(a & b) / len(a | b) if a | b else 1.0
            apart = None if h1 is None or h2 is None else abs(h1 - h2)
            same = p1 == p2
            if (u1 and u1 == u2) or (apart is not None and ((not same and s >= 0.78 and apart <= 336) or (same and s >= 0.70 and apart <= 72))):
                root[find(i)] = find(j)
    groups = Counter()
    named = {}
    for i in range(len(rows)):
        named.setdefault(find(i), set()).add(f"o{i}")
    groups.update(frozenset(x) for x in named.values())
    return set(groups)


def groups_of(members):
    named = {}
    for r in members.collect():
        named.setdefault(r["root"], set()).add(r["obs_id"])
    return {frozenset(x) for x in named.values()}


def test_linear_links_connect_what_all_pairs_connect(spark):
    for seed in range(2):
        rows = random_rows(seed, 90)
        obs = observations(spark, rows)
        roots = graph.components(demand.duplicate_edges(obs), few=seed * 10_000)
        members = obs.select("obs_id").join(roots, F.col("obs_id") == F.col("node"), "left").select("obs_id", F.coalesce("root", "obs_id").alias("root"))
        assert groups_of(members) == brute_groups(rows)


def test_hot_titles_give_linear_edges(spark):
    rows = [(None, "pq"[i % 2], " ".join(BASE), float(i % 50), "search_observed", "g", False) for i in range(2000)]
    edges = demand.duplicate_edges(observations(spark, rows))
    assert 1999 <= edges.count() <= 3 * 2000
    assert edges.where("group_size IS NOT NULL").agg(F.max("group_size")).first()[0] == 40


def test_store_equals_one_batch(spark, tmp_path):
    rows = random_rows(7, 120)
    obs = observations(spark, rows)
    number = F.expr("CAST(substr(obs_id, 2) AS INT)")
    store = EventStore(spark, str(tmp_path / "store"))
    store.apply(0, obs.where(number % 3 == 1))
    first = {r["obs_id"]: r["root"] for r in store.members().collect()}
    # A batch that fails after it has written some tables is not seen, and can come again.
    store._write("observations", 1, store._log("observations", "obs_id string").select("obs_id"))
    store.apply(1, obs.where(number % 3 == 0))
    assert store.apply(1, obs) == {}
    second = {r["obs_id"]: r["root"] for r in store.members().collect()}
    written = store.apply(2, obs.where("obs_id = 'o2'").unionByName(obs.where("obs_id = 'o0'")))
    now = {r["obs_id"]: r["root"] for r in store.members().collect()}
    moved = sum(1 for k, v in second.items() if now[k] != v)
    assert written["observations"] == 1 and written["members"] == 1 + moved and len(first) == 40
    store.apply(3, obs)
    assert groups_of(store.members()) == brute_groups(rows)
    whole = demand.evidence_events(obs, demand.duplicate_edges(obs))
    assert {tuple(map(str, r)) for r in store.events().collect()} == {tuple(map(str, r)) for r in whole.select(store.events().columns).collect()}
