import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import asof, history, skew


@pytest.mark.parametrize("cut", [False, True])
def test_asof_equals_brute_force(spark, cut):
    rng = random.Random(4)
    keys = ["hot"] * 6 + ["b", "c", None]
    events = [(i, rng.choice(keys), rng.randrange(300), "x") for i in range(600)]
    versions = [(i, rng.choice(keys), rng.randrange(300), f"v{i}") for i in range(60)]
    e = spark.createDataFrame(events, "id long, key string, at long, value string")
    v = spark.createDataFrame(versions, "vid long, key string, at long, value string")
    hint = F.col("at").cast("double")
    plan = skew.plan_order(e, ["key"], hint, tasks=6, min_task_rows=5) if cut else None
    if cut:
        assert any(plan.cuts)
    got = {r.id: r.version and (r.version.vid, r.version.value) for r in asof.asof_join(e, v, ["key"], ["at"], ["vid", "value"], hint, [-F.col("vid")], plan=plan).collect()}

    def want(key, at):
        past = [x for x in versions if x[1] == key and key is not None and x[2] <= at]
        if not past:
            return None
        best = max(past, key=lambda x: (x[2], -x[0]))
        return best[0], best[3]

    assert got == {i: want(k, at) for i, k, at, _ in events}


def test_asof_without_versions_or_events(spark):
    e = spark.createDataFrame([(1, "a", 5)], "id long, key string, at long")
    none = spark.createDataFrame([], "vid long, key string, at long")
    hint = F.col("at").cast("double")
    assert [r.version for r in asof.asof_join(e, none, ["key"], ["at"], ["vid"], hint).collect()] == [None]
    assert asof.asof_join(none.withColumnRenamed("vid", "id"), none, ["key"], ["at"], ["vid"], hint).count() == 0


@pytest.mark.parametrize("cut", [False, True])
def test_previous_row(spark, cut):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 5 + ["b", None]), n) for i, n in enumerate(rng.sample(range(1000), 300))]
    df = spark.createDataFrame(rows, "id long, key string, at long")
    hint = F.col("at").cast("double")
    plan = skew.plan_order(df, ["key"], hint, tasks=6, min_task_rows=5) if cut else None
    got = {r.id: r.previous and r.previous.id for r in asof.previous_row(df, ["key"], ["at"], ["id"], hint, plan=plan).collect()}
    want = {}
    for key in {r[1] for r in rows}:
        before = None
        for r in sorted((r for r in rows if r[1] == key), key=lambda r: r[2]):
            want[r[0]], before = before, r[0]
    assert got == want


@pytest.mark.parametrize("cut", [False, True])
def test_validity_equals_brute_force(spark, cut):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), rng.randrange(900), i, rng.random() > 0.15, rng.choice(["p", "p", "p", "q", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "key string, ts long, seq long, live boolean, v string")
    states = history.snapshots(df, ["key"], "ts", ["seq"], F.col("live"), {"v": F.col("v")})
    plan = skew.plan_order(states, ["key"], F.col("ts").cast("double"), tasks=6, min_task_rows=5) if cut else None
    if cut:
        assert any(plan.cuts)
    got = sorted(((r.key, r._attrs.v, r.valid_from, r.valid_to) for r in history.validity(states, ["key"], "ts", plan).collect()), key=repr)
    want = []
    for key in {r[0] for r in rows}:
        last = {}
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[2]):
            last[r[1]] = (r[3], r[4])
        open_since = None
        for ts in sorted(last):
            live, v = last[ts]
            if open_since and (not live or open_since[1] != v):
                want.append((key, open_since[1], open_since[0], ts))
                open_since = None
            if live and not open_since:
                open_since = (ts, v)
        if open_since:
            want.append((key, open_since[1], open_since[0], None))
    assert got == sorted(want, key=repr)


def test_validity_of_long_runs_and_nothing(spark):
    rows = [("a", i, True, "p") for i in range(200)] + [("a", 200, False, "p"), ("a", 201, True, "p")]
    states = spark.createDataFrame(rows, "key string, ts long, live boolean, v string").select("key", "ts", F.col("live").alias("_exists"), F.struct("v").alias("_attrs"))
    assert sorted((r.valid_from, r.valid_to or -1) for r in history.validity(states, ["key"], "ts").collect()) == [(0, 200), (201, -1)]
    assert history.validity(states.limit(0), ["key"], "ts").count() == 0
