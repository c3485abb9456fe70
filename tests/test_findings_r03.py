"""Cases of the third round's findings, with rows of our own."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.operators import demand

AT = dt.datetime(2024, 5, 31)


def similarity(a, b):
    a, b = ({t for t in x.split() if len(t) > 1} for x in (a, b))
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("block", [2, 100])
def test_best_matches_in_blocks(spark, block):
    dice = random.Random(block)
    text = lambda: " ".join(dice.choice(["aa", "bb", "cc", "dd", "ee", "ff", "x", "the"]) for _ in range(dice.randrange(0, 6)))
    families = [(f"f{k}", k % 2, [text() for _ in range(k % 3)] + ["the the"] * (k % 7 == 0)) for k in range(60)]
    assets = [(k % 2, f"u{k:02}", dice.choice(["page", "faq", "tool", "other"]), text(), AT) for k in range(40)]
    want = {}
    for family, project, needles in families:
        kinds = {k: i for i, k in enumerate(demand.KINDS)} | {"other": 99}
        met = [(-(1.0 if n == a[3] else similarity(n, a[3])), n != a[3], kinds[a[2]], a[1]) for n in needles if n for a in assets if a[0] == project and a[3]]
        met = [m for m in met if -m[0] >= demand.MATCH_THRESHOLD or not m[1]]
        if met:
            want[family] = min(met)
    found = demand.best_matches(spark.createDataFrame(families, "family_id string, project_id int, needles array<string>"), spark.createDataFrame(assets, "project_id int, url string, kind string, intent string, updated timestamp"), block)
    got = {r["family_id"]: (-r["strength"], not r["exact"], r["url"], r["updated"]) for r in found.collect()}
    assert got == {f: (s, e, u, AT) for f, (s, e, _, u) in want.items()} and len(got) > 30


def test_nearest_sets_are_bounded_by_cells():
    sets = [["the", f"w{k % 9}", f"v{k % 4}"] for k in range(50)]
    whole = demand.nearest_sets(pa.array(sets), pa.array(sets[::-1]))
    few = demand.nearest_sets(pa.array(sets), pa.array(sets[::-1]), cells=60)
    assert all((x == y).all() for x, y in zip(whole, few, strict=True)) and set(whole[2]) == {1.0}


def test_best_matches_send_a_text_once(spark):
    """A hot title and hot intent were joined row by row: 400 x 400 rows for one text."""
    families = spark.range(400).select(F.concat(F.lit("f"), "id").alias("family_id"), F.lit(1).alias("project_id"), F.array(F.lit("hot title")).alias("needles"))
    assets = spark.range(400).select(F.lit(1).alias("project_id"), F.concat(F.lit("u"), "id").alias("url"), F.lit("page").alias("kind"), F.lit("hot title").alias("intent"), F.lit(AT).alias("updated"))
    found = demand.best_matches(families, assets)
    rows = found.collect()
    assert len(rows) == 400 and {r["url"] for r in rows} == {"u0"}
    widest = []

    def walk(plan):
        metrics = plan.metrics()
        if metrics.contains("numOutputRows"):
            widest.append(metrics.get("numOutputRows").get().value())
        if "AdaptiveSparkPlan" in plan.nodeName():
            walk(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            walk(plan.plan())
        for k in range(plan.children().size()):
            walk(plan.children().apply(k))

    walk(found._jdf.queryExecution().executedPlan())
    assert max(widest) <= 2000


@pytest.mark.parametrize("n", [1, 7, 100, 700, 1001])
def test_runs_are_cut_as_by_the_sql(spark, n):
    """Ranks were rounded up from doubles (0.33 * 700 is above 231), and estimated beyond a million rows."""
    import duckdb

    from sightline.operators.temporal import quantiles
    from sightline.plans.stream_queries import _runs

    micros = sorted(random.Random(n).randrange(10**12) for _ in range(n))
    want = duckdb.sql(f"SELECT quantile_disc(x, [0.33, 0.66]) FROM (SELECT unnest({micros}) AS x)").fetchall()[0][0]
    values = spark.createDataFrame([(x,) for x in micros] + [(None,)], "x long")
    assert quantiles(values, F.col("x"), ["0.33", "0.66"]) == want == quantiles(values, F.col("x"), ["0.33", "0.66"], bins=3)
    assert quantiles(values.where("x IS NULL"), F.col("x"), ["0.5"]) == []

    class Views:
        events = values.where("x IS NOT NULL").select(F.timestamp_micros("x").alias("ts"))

    got = {r["run"]: r["n"] for r in _runs(Views).groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {k: c for k in range(3) if (c := sum((x > want[0]) + (x > want[1]) == k for x in micros))}


def test_late_sessions_below_a_millisecond(spark, tmp_path):
    """A row that is late by less than a millisecond was kept, as Spark's watermarks are whole milliseconds."""
    import duckdb

    from sightline.plans import registry

    second = dt.timedelta(seconds=1)
    at = [AT + k * 3600 * second for k in range(300)]
    rows = [(k * 2 + 1, t, k % 7, "view", 1.0, "{}") for k, t in enumerate(at)]
    first_run = at[98] + dt.timedelta(microseconds=900)
    rows[98] = (*rows[98][:1], first_run, *rows[98][2:])
    late = first_run - dt.timedelta(days=2, hours=6) - dt.timedelta(microseconds=500)
    rows += [(1000, late, 50, "view", 1.0, "{}")]  # comes a run too late, 500 microseconds behind the watermark
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    con.execute("SET TimeZone = 'UTC'")
    want = sorted(con.execute(registry.oracle_sql()["t1_late_sessions"]).fetchall())
    got = registry.queries()["t1_late_sessions"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want and all(r[0] != 50 for r in want)


def test_category_counts_are_combined_before_the_join(spark):
    from sightline.operators import audit

    issues = spark.range(1000).select(F.when(F.col("id") % 4 > 0, "seo").alias("category"), F.when(F.col("id") % 3 == 0, "critical").otherwise("warning").alias("severity"))
    found = audit.category_counts(issues, ["seo", "none"])
    assert {tuple(r) for r in found.collect()} == {("seo", 250, 500, 0), ("none", 0, 0, 0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_pages_are_read_in_parts_of_bounded_bytes():
    from sightline.functions import html

    batch = pa.RecordBatch.from_pydict({"html": ["x" * 400, None, "y" * 700, "z" * 3000, "", "w"], "id": list(range(6))})
    parts = list(html._parts(batch, "html", 1000))
    assert [p.column("id").to_pylist() for p in parts] == [[0, 1], [2], [3], [4, 5]]


def test_definitions_of_the_same_words_are_one(spark):
    """Each copy of a definition was collected, and tried on every title that holds its rarest word."""
    from sightline.operators import definitions

    dice = random.Random(5)
    words = ["ab", "bc", "abc", "ca", "de", None, ""]
    listed = [(k * 3, f"n{k}", [dice.choice(words) for _ in range(dice.randrange(4))]) for k in range(300)]
    titles = [(k, "".join(dice.choice("abcde ") for _ in range(9))) for k in range(200)] + [(900, None)]
    want = {}
    for k, t in titles:
        fit = [(r, n) for r, n, ws in listed if t and any(ws) and all(w in t for w in ws if w)]
        want[k] = min(fit)[1] if fit else None
    table = spark.createDataFrame(listed, "rank long, name string, words array<string>")
    rows = spark.createDataFrame(titles, "id long, title string")
    for most in (definitions.MAX_CHARACTERS, 30):
        assert {r["id"]: r["definition"] for r in definitions.first_match(rows, table, max_characters=most).collect()} == want
    held = []
    definitions._match, whole = (lambda rows, listed, title, found: held.append(len(listed)) or whole(rows, listed, title, found)), definitions._match
    try:
        definitions.first_match(rows, table)
    finally:
        definitions._match = whole
    assert held == [len({frozenset(w for w in ws if w) for _, _, ws in listed} - {frozenset()})]


def observed(spark, rows):
    """(obs_id, title, platform, hour) as observations of one family, records and urls all different."""
    kind = "obs_id string, family_id string, connection_id string, external_id string, url_key string, platform string, tokens array<string>, published timestamp, excerpt string"
    return spark.createDataFrame([(o, "f", "c", o, None, p, t.split(), AT + dt.timedelta(hours=h), "long text") for o, t, p, h in rows], kind)


def test_every_related_pair_of_one_title(spark):
    """Rows of one title were listed with their neighbours in time only: a and c were left out."""
    rows = [("a", "hot title", "p", 0), ("b", "hot title", "p", 30), ("c", "hot title", "p", 60), ("d", "hot title", "p", 110), ("e", "hot title", "q", 340), ("g", "hot title", "p", 30)]
    listed = {(r["a"], r["b"], r["relation"], r["group_size"]) for r in demand.duplicate_edges(observed(spark, rows), every=True).collect()}
    assert listed == {("a", "b", "exact", None), ("a", "c", "exact", None), ("b", "c", "exact", None), ("c", "d", "exact", None), ("b", "e", "syndicated", None), ("c", "e", "syndicated", None), ("d", "e", "syndicated", None), ("b", "g", "exact", 2)}


def test_duplicates_are_joined_without_broadcasts_or_texts(spark):
    """Sides that grow with the rows were broadcast while their files were small, and texts of titles were joined for each token."""
    obs = observed(spark, [("a", "hot title", "p", 0), ("b", "hot title now", "p", 30)])
    plan = demand.duplicate_edges(obs)._jdf.queryExecution()
    assert "Broadcast" not in plan.executedPlan().toString()
    assert "excerpt" not in plan.optimizedPlan().toString().split("Join")[0] and "array_join" not in str([line for line in plan.optimizedPlan().toString().splitlines() if "Join" in line])
