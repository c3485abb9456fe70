"""As-of and interval joins against brute force."""

import datetime as dt
import random

import pytest

from sightline.operators import temporal

AT = dt.datetime(2024, 1, 1)


def minutes(x):
    return None if x is None else AT + dt.timedelta(minutes=x)


@pytest.mark.parametrize("strict, tolerance, bucket_rows", [(False, None, 10**6), (True, None, 40), (False, 600, 40)])
def test_asof_equals_brute_force(spark, strict, tolerance, bucket_rows):
    rnd = random.Random(bucket_rows)
    key = lambda: rnd.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), rnd.choice([None, *range(60)])) for i in range(200)] + [(500, "alone", 5), (7, "a", 7), (7, "a", 7)]
    right = [(i, key(), rnd.choice([None, *range(60)])) for i in range(120)]
    want = []
    for i, k, t in left:
        fit = [(u, j) for j, c, u in right if k is not None and c == k and t is not None and u is not None and (u < t if strict else u <= t)]
        best = max(fit, default=None)
        want.append((i, best[1] if best and (tolerance is None or (t - best[0]) * 60 <= tolerance) else None))
    table = lambda rows, *names: spark.createDataFrame([(i, k, minutes(t)) for i, k, t in rows], f"{names[0]} long, k string, {names[1]} timestamp")
    got = temporal.asof_join(table(left, "id", "t"), table(right, "found", "u"), ["k"], "t", "u", ["found"], strict=strict, tolerance=tolerance, bucket_rows=bucket_rows)
    assert got.columns == ["id", "k", "t", "found"]
    assert sorted(((r["id"], r["found"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_intervals_equal_brute_force_without_nested_loops(spark):
    rnd = random.Random(5)
    span = lambda: (lambda s: (s, None if rnd.random() < 0.05 else s + rnd.choice([-1, 0, 1, 3, 60, 5000, 10**6])))(rnd.randrange(-500, 3000))
    left = [(i, rnd.choice(["a", "a", "b", None]), *span()) for i in range(120)]
    right = [(i, rnd.choice(["a", "a", "b", None]), *span()) for i in range(120)]
    table = lambda rows, side: spark.createDataFrame([(i, k, minutes(s), minutes(e)) for i, k, s, e in rows], f"{side}id long, k string, {side}s timestamp, {side}e timestamp")
    whole = lambda r: r[1] is not None and r[3] is not None and r[3] > r[2]
    want = sorted((x[0], y[0]) for x in left for y in right if whole(x) and whole(y) and x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    joined = temporal.interval_join(table(left, "l"), table(right, "r"), ["k"], ("ls", "le"), ("rs", "re"))
    assert sorted((r["lid"], r["rid"]) for r in joined.collect()) == want and len(want) > 500
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    points = temporal.interval_join(table(left, "l").drop("le"), table(right, "r"), ["k"], ("ls", None), ("rs", "re"))
    assert sorted((r["lid"], r["rid"]) for r in points.collect()) == sorted((x[0], y[0]) for x in left for y in right if x[1] is not None and whole(y) and x[1] == y[1] and y[2] <= x[2] < y[3])


def test_empty_sides(spark):
    empty = spark.createDataFrame([], "id long, k string, t timestamp, e timestamp")
    assert temporal.asof_join(empty, empty.withColumnRenamed("id", "x"), ["k"], "t", "t", ["x"]).count() == 0
    assert temporal.interval_join(empty, empty.selectExpr("id AS y", "k", "t AS s2", "e AS e2"), ["k"], ("t", "e"), ("s2", "e2")).count() == 0
