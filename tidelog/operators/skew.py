"""Balanced work for keys of very uneven size.

Two plans, both made from one histogram of hash slots, SLOTS or four a task (so what reaches the driver has a bound that
does not depend on the data):

* FragmentPlan (order does not matter): slots are packed onto tasks, largest first; a slot with more rows than a task
  should have is split into proportionate fragments, and the matching side of a join is replicated to just those
  fragments.
* OrderPlan (order matters): a heavy slot is cut into ranges of its order at quantiles, so that each range can be
  replayed on its own and the pieces be composed in order.

A slot holds whole keys; keys that share a slot with a heavy key are split with it, which costs a little merging and
never changes a result.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.session import parallelism, shared_folder

SLOTS = 4096
#: A task is not made smaller than this many rows.
MIN_TASK_ROWS = 20_000
#: Slots that need more ranges than this get quantiles of their own fineness.
RANGES = 64


def slot_of(keys: list[str], slots: int = SLOTS) -> Column:
    """Hash slot of a key; nulls are a value like any other."""
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]), F.lit(slots)).cast("int")


def _literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


@dataclass(frozen=True)
class FragmentPlan:
    """tasks: number of tasks; first, count: by slot, where its fragments begin in owners and how many it has; owners: task of each fragment."""

    keys: tuple[str, ...]
    tasks: int
    first: list[int]
    count: list[int]
    owners: list[int]

    def _at(self, values: list[int], slot: Column) -> Column:
        return _literal(values, "array<int>")[slot]

    def fragments(self) -> Column:
        """How many fragments the row's slot has."""
        return self._at(self.count, slot_of([*self.keys], len(self.count)))

    def task(self, spread: Column) -> Column:
        """Task of a row of the large side; spread picks among a split slot's fragments."""
        slot = slot_of([*self.keys], len(self.count))
        at = self._at(self.first, slot) + F.pmod(F.xxhash64(spread), self._at(self.count, slot).cast("long")).cast("int")
        return _literal(self.owners, "array<int>")[at]

    def owning_tasks(self) -> Column:
        """All tasks that may hold rows of the row's key (for the matching side), without repeats."""
        slot = slot_of([*self.keys], len(self.count))
        return F.array_distinct(F.slice(_literal(self.owners, "array<int>"), self._at(self.first, slot) + 1, self._at(self.count, slot)))


def plan_fragments(df: DataFrame, keys: list[str], tasks: int | None = None, slots: int | None = None, min_task_rows: int = MIN_TASK_ROWS) -> FragmentPlan:
    """Count rows by slot, split heavy slots in proportion, then pack fragments onto tasks (longest first).

    An empty df gives one fragment a slot, spread over the tasks.
    """
    tasks = tasks or parallelism(df.sparkSession)
    slots = slots or max(SLOTS, 4 * tasks)
    loads = [0] * slots
    for slot, n in df.groupBy(slot_of(keys, slots).alias("slot")).count().collect():  # at most `slots` rows
        loads[slot] = n
    target = max(sum(loads) // tasks, min_task_rows, 1)
    count = [min(tasks, max(1, -(-n // target))) for n in loads]
    first, at = [], 0
    for c in count:
        first.append(at)
        at += c
    owners, heap = [0] * at, [(0, t) for t in range(tasks)]
    heapq.heapify(heap)
    for slot in sorted(range(slots), key=lambda s: -loads[s] / count[s]):
        taken = []
        for i in range(count[slot]):  # fragments of one slot go to different tasks
            load, t = heapq.heappop(heap)
            owners[first[slot] + i] = t
            taken.append((load + max(1, loads[slot] // count[slot]), t))
        for x in taken:
            heapq.heappush(heap, x)
    return FragmentPlan(tuple(keys), tasks, first, count, owners)


def partial_rows(df: DataFrame, keys: list[str], partial: dict[str, Column]) -> DataFrame:
    """Partial aggregates of keys, one row a key and input partition, in a working table in the shared folder.

    However many rows a key has, at most one of them a partition is left to be moved, and its partitions' rows go to different tasks. The
    table is what plans are made of (it holds just what they place) and what they are applied to, so df is read once.
    """
    path = shared_folder(df.sparkSession, "partial")
    parts = df.groupBy(*keys, F.spark_partition_id().alias("_part")).agg(*[c.alias(n) for n, c in partial.items()]).drop("_part")
    parts.write.parquet(path)
    return df.sparkSession.read.schema(parts.schema).parquet(path)


def fragment_aggregate(parts: DataFrame, keys: list[str], merge: dict[str, Column], spread: Column | None = None, plan: FragmentPlan | None = None) -> DataFrame:
    """Aggregate partial rows by keys: each fragment of a key by the task that the plan gives it, then the fragments of split keys.

    parts: what partial_rows() gives, by these keys or finer ones. merge: aggregates over its columns, which can be applied to their own
    results under the same names (sum, max and the like; a column that another merge makes must have its name). spread: picks among a split
    key's fragments; default: all columns. Null keys form groups of their own. Extra columns are ignored. No rows give no rows.
    """
    plan = plan or plan_fragments(parts, keys)
    spread = spread if spread is not None else F.xxhash64(*parts.columns)
    placed = parts.withColumn("_task", plan.task(spread)).repartitionById(plan.tasks, F.col("_task"))
    merged = placed.groupBy(*keys, "_task").agg(*[c.alias(n) for n, c in merge.items()])  # as the rows lie: no exchange
    if max(plan.count) == 1:
        return merged.drop("_task")
    return merged.groupBy(*keys).agg(*[_again(c, n).alias(n) for n, c in merge.items()])


def _again(merge: Column, name: str) -> Column:
    """The same kind of aggregate (sum, min, max) over its own result."""
    kind = merge._jc.toString().split("(")[0].lower()
    if kind not in ("sum", "min", "max", "bool_or", "bool_and", "bit_or", "bit_and"):
        raise ValueError(f"{kind} cannot be applied to its own results")
    return F.call_function(kind, F.col(name))


def fragment_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "inner", plan: FragmentPlan | None = None) -> DataFrame:
    """Join a large, uneven left side to a right side with keys of the same names.

    Left rows go to their planned task; right rows are replicated to the tasks that own a fragment of their key, and
    only to those. how: inner, left or left_semi, left_anti (anything that never emits unmatched right rows).
    Null keys match nothing, as in SQL. Columns of the right side that clash with the left's get the suffix _right.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"fragment_join cannot do {how}")
    plan = plan or plan_fragments(left, keys)
    clash = {c: f"{c}_right" for c in right.columns if c in left.columns and c not in keys}
    here = left.withColumn("_task", plan.task(spread)).repartitionById(plan.tasks, F.col("_task"))
    there = right.withColumnsRenamed(clash).withColumn("_task", F.explode(plan.owning_tasks())).repartitionById(plan.tasks, F.col("_task"))
    return here.join(there, [*keys, "_task"], how).drop("_task")  # both sides lie as planned: no further exchange


@dataclass(frozen=True)
class OrderPlan:
    """cuts: by slot, the values of the order at which a heavy slot is cut (empty for all others)."""

    keys: tuple[str, ...]
    cuts: list[list[float]]

    def _cuts(self) -> Column:
        return _literal(self.cuts, "array<array<double>>")[slot_of([*self.keys], len(self.cuts))]

    def shard(self, hint: Column) -> Column:
        """Range of a row: how many cuts lie at or below its place. Rows of equal place are never parted."""
        if not any(self.cuts):
            return F.lit(0)
        return F.when(hint.isNull(), 0).otherwise(F.size(F.filter(self._cuts(), lambda c: c <= hint)))

    def is_split(self) -> Column:
        return F.size(self._cuts()) > 0 if any(self.cuts) else F.lit(False)


def plan_order(df: DataFrame, keys: list[str], hint: Column, tasks: int | None = None, slots: int | None = None, min_task_rows: int = MIN_TASK_ROWS) -> OrderPlan:
    """Cut slots with more rows than a task should have at quantiles of hint, a double that never decreases in the order.

    A slot gets as many ranges as it has tasks' worth of rows. Quantiles are approximate; they decide the balance only.
    An empty df or one of even keys gives no cuts.
    """
    tasks = tasks or parallelism(df.sparkSession)
    slots = slots or max(SLOTS, 4 * tasks)
    loads = {s: n for s, n in df.groupBy(slot_of(keys, slots).alias("slot")).count().collect()}  # at most `slots` rows
    target = max(sum(loads.values()) // tasks, min_task_rows, 1)
    ranges = {s: -(-n // target) for s, n in loads.items() if n > target}  # they add up to twice `tasks` at most
    cuts: list[list[float]] = [[] for _ in range(slots)]
    for some in ({s: n for s, n in ranges.items() if n <= RANGES}, {s: n for s, n in ranges.items() if n > RANGES}):
        if not some:
            continue
        fine = max(some.values())
        slot = slot_of(keys, slots)
        wanted = F.array_contains(_literal(sorted(some), "array<int>"), slot)
        found = df.filter(wanted).groupBy(slot.alias("slot")).agg(F.percentile_approx(hint, [i / fine for i in range(1, fine)], max(1000, 10 * fine)).alias("q"))
        for s, q in found.collect():  # one row a heavy slot
            cuts[s] = sorted({q[max(1, round(i * fine / some[s])) - 1] for i in range(1, some[s])}) if q else []
    return OrderPlan(tuple(keys), cuts)
