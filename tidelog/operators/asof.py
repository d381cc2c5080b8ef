"""Joins and neighbours in an order, for entities of any size.

Entities with too many rows are cut into ranges of the order (OrderPlan). What a range needs from before itself is one
row, the last of the ranges before it; that row is carried into the range, after which every range is worked on alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.skew import OrderPlan, plan_order


def carry_in(rows: DataFrame, keys: list[str], order: list[Column], value: Column, plan: OrderPlan) -> DataFrame:
    """Last value before each range of cut entities: (keys, _shard, _value).

    rows has _shard. One value a range is kept by a map-side aggregate; then each entity has one row a range here.
    """
    last = rows.filter(plan.is_split()).groupBy(*keys, "_shard").agg(F.max_by(value, F.struct(*order)).alias("_value"))
    spine = last.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.size(plan._cuts()))).alias("_shard"))
    ranges = last.unionByName(spine, allowMissingColumns=True).groupBy(*keys, "_shard").agg(F.first("_value", ignorenulls=True).alias("_value"))
    before = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("_value", F.last("_value", ignorenulls=True).over(before)).filter(F.col("_value").isNotNull())


def asof_join(events: DataFrame, versions: DataFrame, keys: list[str], order: list[str], payload: list[str], hint: Column, latest: list[Column] | None = None, into: str = "version", plan: OrderPlan | None = None) -> DataFrame:
    """Each event with the version of its entity that was in force at its place: the last one at or before it.

    Both sides have keys and order columns of the same names; hint is a double that never decreases in order. Versions
    of the same entity and place: the one that `latest` sorts last wins. Method: ranges of heavy entities with the last
    preceding version carried in, then per range one sort of events and versions together and a running last value;
    no event meets a version beyond it, and pairs are never formed.

    Result: the events' columns and `into`, a struct of payload (null if no version was in force). Null keys match
    nothing, null orders come first; no versions or no events give null structs or no rows; repeated rows stay. The
    events may have any other columns, but not `into` or ones starting with _.
    """
    plan = plan or plan_order(events, keys, hint)
    latest = latest or []
    ties = [f"_t{i}" for i in range(len(latest))]
    value = F.struct(*payload)
    known = versions.dropna(subset=keys).select(*keys, *order, *[c.alias(t) for c, t in zip(latest, ties)], value.alias("_value"), plan.shard(hint).alias("_shard"))
    sides = [events.withColumns({"_shard": plan.shard(hint), "_kind": F.lit(2)}), known.withColumn("_kind", F.lit(1))]
    if any(plan.cuts):
        carried = carry_in(known, keys, [F.col(c) for c in [*order, *ties]], F.col("_value"), plan)
        sides.append(carried.withColumn("_kind", F.lit(0)))
    both = sides[0]
    for side in sides[1:]:
        both = both.unionByName(side, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_shard").orderBy(F.col("_kind") != 0, *order, "_kind", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(into, F.last("_value", ignorenulls=True).over(w)).filter("_kind = 2").select(*events.columns, into)


def previous_row(rows: DataFrame, keys: list[str], order: list[str], value: list[str], hint: Column, into: str = "previous", plan: OrderPlan | None = None) -> DataFrame:
    """Each row with a struct of the row before it in its entity's order (null for the first).

    order must be total within an entity for a defined result. Null keys make an entity of their own. Ranges of heavy
    entities get the last row before them carried in. The rows may not have `into` or columns starting with _.
    """
    plan = plan or plan_order(rows, keys, hint)
    here = rows.withColumns({"_shard": plan.shard(hint), "_value": F.struct(*value), "_kind": F.lit(1)})
    both = here
    if any(plan.cuts):
        both = here.unionByName(carry_in(here, keys, [F.col(c) for c in order], F.col("_value"), plan).withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_shard").orderBy("_kind", *order)
    return both.withColumn(into, F.lag("_value").over(w)).filter("_kind = 1").select(*rows.columns, into)
