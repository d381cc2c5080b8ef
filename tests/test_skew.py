from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelog.operators import skew

HOT = 3000


@pytest.fixture(scope="module")
def uneven(spark):
    """One key with a third of the rows, many small ones, a null key."""
    rows = [("hot", i) for i in range(HOT)] + [(f"k{i % 700}", i) for i in range(2 * HOT)] + [(None, i) for i in range(5)]
    return spark.createDataFrame(rows, "key string, n long")


def test_large_key_is_split_and_small_keys_are_packed(uneven):
    plan = skew.plan_fragments(uneven, ["key"], tasks=6, min_task_rows=100)
    assert max(plan.count) >= 2
    loads = {r._task: r["count"] for r in uneven.groupBy(plan.task(F.col("n")).alias("_task")).count().collect()}
    assert len(loads) == 6
    assert max(loads.values()) < 1.3 * sum(loads.values()) / 6


def test_aggregate_equals_plain_group_by(uneven):
    parts = skew.partial_rows(uneven, ["key"], {"c": F.count("*"), "s": F.sum("n"), "m": F.max("n")})
    assert parts.filter("key = 'hot'").count() <= uneven.rdd.getNumPartitions()
    want = uneven.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.max("n").alias("m"))
    for least in (1, 20_000):  # with split keys, and without
        plan = skew.plan_fragments(parts, ["key"], tasks=6, min_task_rows=least)
        got = skew.fragment_aggregate(parts, ["key"], {"c": F.sum("c"), "s": F.sum("s"), "m": F.max("m")}, plan=plan)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_plan_moves_the_partial_rows_of_an_aggregate(uneven):
    parts = skew.partial_rows(uneven, ["key"], {"c": F.count("*")})
    plan = skew.fragment_aggregate(parts, ["key"], {"c": F.sum("c")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange shufflepartitionidpassthrough") == 1
    with pytest.raises(ValueError, match="avg"):
        skew.fragment_aggregate(parts, ["key"], {"c": F.avg("c")}, plan=skew.plan_fragments(uneven, ["key"], tasks=6, min_task_rows=100))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_equals_plain_join(spark, uneven, how):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4), (None, 5)], "key string, n int")
    plan = skew.plan_fragments(uneven, ["key"], tasks=6, min_task_rows=100)
    got = skew.fragment_join(uneven, right, ["key"], F.col("n"), how, plan)
    want = uneven.join(right.withColumnRenamed("n", "n_right"), "key", how)
    assert Counter(map(tuple, got.select(want.columns).collect())) == Counter(map(tuple, want.collect()))


def test_join_rejects_kinds_that_need_unmatched_right_rows(uneven):
    with pytest.raises(ValueError, match="full"):
        skew.fragment_join(uneven, uneven, ["key"], F.col("n"), "full")


def test_join_needs_no_exchange_beyond_the_planned_ones(spark, uneven):
    right = spark.createDataFrame([("hot", 1)], "key string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = skew.fragment_join(uneven, right, ["key"], F.col("n"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == plan.count("Exchange shufflepartitionidpassthrough") == 2


def test_empty_table(spark):
    none = spark.createDataFrame([], "key string, n long")
    plan = skew.plan_fragments(none, ["key"], tasks=3)
    assert skew.fragment_aggregate(skew.partial_rows(none, ["key"], {"c": F.count("*")}), ["key"], {"c": F.sum("c")}, plan=plan).count() == 0
    assert not any(skew.plan_order(none, ["key"], F.col("n").cast("double")).cuts)


def test_order_ranges_follow_the_order(uneven):
    hint = F.col("n").cast("double")
    plan = skew.plan_order(uneven, ["key"], hint, tasks=6, min_task_rows=100)
    assert any(plan.cuts)
    rows = uneven.filter("key = 'hot'").select("n", plan.shard(hint).alias("s")).orderBy("n").collect()
    shards = [r.s for r in rows]
    assert shards == sorted(shards)
    assert len(set(shards)) >= 2
