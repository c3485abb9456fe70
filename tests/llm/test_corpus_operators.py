"""Operators over the whole corpus (2, 6, 7), the pipeline and the registration, against brute force and SQL."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import line_frequency, multi_index, ngram_join
from sightline.operators.graph import components

SF = "/root/testdata/sf0.001"


# 6


def brute_components(texts, n, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * c >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed, groups):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rnd.randrange(12))
    texts = [None, "", " \n", "one", "one", "One two", "a b c d", "A B C D"]
    for size in groups:
        base = [word() for _ in range(rnd.randrange(5, 60))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rnd.randrange(3)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("heavy, n, num", [(64, 4, 85), (3, 4, 85), (3, 5, 80), (2, 2, 50)])
def test_join_equals_brute_force(spark, monkeypatch, heavy, n, num):
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 400)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 3 + heavy % 4)
    monkeypatch.setattr(ngram_join, "FREQUENT", 1)
    texts = corpus(heavy + n, [1] * 20 + [2, 3, 5, 8, 30])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("class", F.lit("clash")).repartition(3)
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in ngram_join.join_documents(df, n, num, 100).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, n, num, 100)


def test_join_odd_rows(spark):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["id"], r["n_shingles"], r["component"]) for r in ngram_join.join_documents(df).collect())
    assert got == {(None, 2, 7): 1, (7, 2, 7): 2, (None, 0, None): 1, (3, 0, 3): 1}
    kept = ngram_join.keep_one(df).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == {(7, "a b c d e"): 1, (None, None): 1, (3, ""): 1}
    assert ngram_join.join_documents(df.limit(0)).count() == 0 and ngram_join.keep_one(df.limit(0)).count() == 0


def test_block_links_are_a_forest():
    rnd = np.random.default_rng(1)
    base = rnd.choice(10**6, 400, replace=False)
    sets = [np.sort(np.unique(np.where(rnd.random(400) < 0.04, rnd.integers(10**6, 10**7, 400), base))) for _ in range(25)]
    links = {(i, j) for i in range(25) for j in range(25) if i != j and 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - c)}
    found = ngram_join.block_links(np.arange(25), sets, None, 85, 100)
    assert set(found) <= links and len(found) < 25
    parts = lambda edges: {frozenset(x for x in range(25) if x == i or x in reach(i, edges)) for i in range(25)}

    def reach(i, edges):
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for a, b in edges:
                for y in ({a, b} - {x} if x in (a, b) else ()):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
        return seen

    assert parts(found) == parts(links)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 200), (None, 3), (95, 100), (95, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7


def test_lines_equal_sql(spark):
    rnd = random.Random(9)
    lines = ["menu", " menu \t", "terms\r", "", "  ", *(f"text {i}" for i in range(200))]
    weights = [30, 10, 20, 10, 5] + [1] * 200
    rows = [(i, "\n".join(rnd.choices(lines, weights, k=rnd.randrange(8))), rnd.choice(["a", "a", "a", None, "b"])) for i in range(150)]
    rows += [(500, None, "a"), (501, None, None), (502, "", "lonely"), (rows[3][0], *rows[3][1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit("clash"))
    got = line_frequency.drop_boilerplate(df, ratio=0.2, min_pages=3)
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype(object).where(lambda x: x.notna(), None))
    want = con.sql(line_frequency.oracle_sql(ratio=0.2, min_pages=3)).fetchall()
    assert Counter(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect())) == Counter(want)
    assert got.where("n_dropped > 0").count() > 20
    assert line_frequency.drop_boilerplate(df.limit(0)).count() == 0


def test_equal_pages_count_once(spark):
    rows = [(i, "same page\nof text that is long", "a") for i in range(40)] + [(99, "own text", "a"), (98, "other text", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert line_frequency.drop_boilerplate(df).where("n_dropped > 0").count() == 0
    more = df.unionByName(spark.createDataFrame([(97, "same page\nof another kind", "a")], df.schema))
    cut = {r["doc_id"]: r["text"] for r in line_frequency.drop_boilerplate(more).collect()}
    assert cut[0] == "of text that is long" and cut[97] == "of another kind" and cut[99] == "own text"


def test_ratio_decides_on_small_hosts(spark):
    rows = [(i, f"menu\nown {i}" if i % 2 else f"text {i}", f"host {i // 5}") for i in range(40)] + [(50 + i, f"line {i}\nrare" if i < 2 else f"line {i}", "large") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cut = {r["doc_id"]: r["text"] for r in line_frequency.drop_boilerplate(df).collect()}
    assert all(cut[i] == (f"own {i}" if i % 2 else f"text {i}") for i in range(40))
    assert cut[50] == "line 0\nrare"
    whole = line_frequency.drop_boilerplate(spark.read.parquet(f"{SF}/documents.parquet"))
    assert whole.agg(F.sum("n_dropped")).first()[0] > 20


def test_only_verified_copies_are_spared(spark):
    menu = "\n".join(f"menu entry {k} of the site template" for k in range(12))
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(25))
    article = "\n".join(f"copied article line {k} with words k{k}" for k in range(20))
    near = lambda i: f"{menu}\n{article}\nedit {i}"
    rows = [(i, f"{menu}\n{own(i)}", "a") for i in range(40)] + [(100 + i, near(i), "a") for i in range(15)] + [(200 + i, f"{menu}\n{article}\nsame", "a") for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cut = {r["doc_id"]: r["text"] for r in line_frequency.drop_boilerplate(df, near_copies=True).collect()}
    assert all(cut[i] == own(i) for i in range(40))
    assert all(cut[100 + i] == f"{article}\nedit {i}" and cut[200 + i] == f"{article}\nsame" for i in range(15))


# 2


def vectors(spark, rows, seed=0):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))


def test_all_candidates_are_exact(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=6).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(9)] + [(300, None), (350, [0.0] * 6), (400, [1.0, None, 1.0]), (450, [float("nan")] * 6), (500, [1.0]), (None, rows[1][1]), (550, []), (600, [float("inf")] * 6)]
    got = multi_index.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and (i < 300)]
    for q, x in [g for g in good if g[0] % 50 == 0]:
        want = sorted(((-(x @ v) / np.sqrt(x @ x) / np.sqrt(v @ v)).round(12), i) for i, v in good if i != q)[:5]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and [i for _, i, _ in own] == [i for _, i in want]
        assert np.allclose([s for _, _, s in own], [-s for s, _ in want], atol=1e-12)
    assert {r["query_id"] for r in got} == {0, 50, 100, 200}


def test_few_and_no_vectors(spark):
    few = vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])])
    assert [tuple(r)[:3] for r in multi_index.nearest(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1)]
    assert multi_index.nearest(few.limit(0), F.lit(True)).count() == 0
    assert multi_index.nearest(few, F.lit(False)).count() == 0


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    got = multi_index.nearest(rows, F.col("vec_id") % 50 == 0).toPandas()
    table = rows.toPandas()
    x = multi_index.unit(np.stack(table["embedding"]).astype(float))
    ids = table["vec_id"].to_numpy()
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -2
        hits += len(set(ids[np.argsort(-s)[:5]]) & set(got[got["query_id"] == ids[i]]["vec_id"]))
        total += 5
    assert hits >= 0.9 * total


def test_walk_is_ordered_and_complete():
    rnd = np.random.default_rng(5)
    index = multi_index.MultiIndex(np.zeros((7, 1)), np.zeros((5, 1)), 1.0)
    a, b = rnd.random(7), rnd.random(5)
    cells = list(index.walk(a, b))
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(35)) and sums == sorted(sums)


# pipeline and registration


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, steps = docs.count(), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        steps[name] = docs.count()
    assert before > steps["quality"] == steps["line_dedup"] > steps["near_duplicates"] > steps["decontaminate"] > 0
    texts = [r["text"] for r in docs.collect()]
    assert {c for _, c in brute_components(texts, 5, 80, 100)} == set(range(len(texts)))
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == steps["decontaminate"] and out.where("not round_trip").count() == 0


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", None, 0), (5, "", "en", None, 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        assert stage(spark, docs.unionByName(odd), SF).count() >= 3, name


def test_registered_queries():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 11)} and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["op3_url_cascade", "op6_ngram_join", "op7_line_dedup", "op8_decontaminate"])
def test_queries_equal_sql(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("benchmark", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert Counter(map(tuple, got.select(want.columns).collect())) == Counter(want.fetchall())
