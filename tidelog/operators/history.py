"""Validity periods of changing attributes, by presence bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.skew import OrderPlan, plan_order

BITS = 64


def snapshots(changes: DataFrame, keys: list[str], time: str, order: list[str], exists: Column, attributes: dict[str, Column]) -> DataFrame:
    """State of each entity at each time at which it changed: that after its last change with that time.

    Columns keys, time, _exists, _attrs. The group is (entity, time), so a heavy entity spreads over its times. Copies
    of a change do no harm. Rows without time are dropped.
    """
    state = F.struct(exists.alias("_exists"), F.struct(*[c.alias(n) for n, c in attributes.items()]).alias("_attrs"))
    last = changes.filter(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.max_by(state, F.struct(*order)).alias("_s"))
    return last.select(*keys, time, "_s._exists", "_s._attrs")


def _runs(bits: Column) -> Column:
    """Runs of set bits in a word as array of (first, last)."""
    at = lambda i: F.call_function("bit_get", bits, i) == 1
    every = F.sequence(F.lit(0), F.lit(BITS - 1))
    firsts = F.filter(every, lambda i: at(i) & ((i == 0) | ~at(F.greatest(i - 1, F.lit(0)))))
    lasts = F.filter(every, lambda i: at(i) & ((i == BITS - 1) | ~at(F.least(i + 1, F.lit(BITS - 1)))))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def validity(states: DataFrame, keys: list[str], time: str, plan: OrderPlan | None = None) -> DataFrame:
    """Longest periods in which an entity exists with unchanged attributes: keys, _attrs, valid_from, valid_to.

    states: rows from snapshots() or from periodic snapshots (one row an entity and time). Method: an entity's times
    are numbered; for each entity and attribute value (found by its hash, told apart by the value itself) a bit is set
    per number at which it held, 64 to a word, by a bitwise or that combines on the map side; runs of consecutive bits
    are read off each word and joined where one word's last bit meets the next word's first. A time at which the entity
    had gone, or had another value, leaves the bit unset, which ends the run. Entities with too many rows are numbered
    by ranges of time, whose outermost runs (at most two a range) are joined afterwards.

    valid_to is the entity's next time after the run, null if there is none. Null attributes equal each other, null keys
    are a key, empty input gives no rows.
    """
    hint = F.col(time).cast("double")
    plan = plan or plan_order(states, keys, hint)
    by = [*keys, "_shard"]
    w = Window.partitionBy(*by).orderBy(time)
    numbered = states.withColumn("_shard", plan.shard(hint)).withColumns({"_no": F.row_number().over(w) - 1, "_next": F.lead(time).over(w)})
    held = numbered.filter("_exists").withColumns({"_hash": F.xxhash64("_attrs"), "_word": F.floor(F.col("_no") / BITS), "_bit": F.pmod("_no", F.lit(BITS)).cast("int")})
    run_key = [*by, "_hash", "_attrs"]
    words = held.groupBy(*run_key, "_word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))).alias("_bits"), F.map_from_entries(F.collect_list(F.struct("_bit", F.struct(F.col(time).alias("t"), F.col("_next").alias("n"))))).alias("_times"))
    runs = words.withColumn("_r", F.explode(_runs(F.col("_bits")))).select(
        *run_key, (F.col("_word") * BITS + F.col("_r.a")).alias("_a"), (F.col("_word") * BITS + F.col("_r.b")).alias("_b"),
        F.element_at("_times", F.col("_r.a"))["t"].alias("valid_from"), F.element_at("_times", F.col("_r.b"))["n"].alias("valid_to"),
    )
    pieces = _joined(runs, run_key, "_a", F.col("_a") == F.lag("_b").over(Window.partitionBy(*run_key).orderBy("_a")) + 1)
    if any(plan.cuts):
        pieces = _across_ranges(pieces, numbered, keys, time, plan)
    return pieces.select(*keys, "_attrs", "valid_from", "valid_to")


def _joined(runs: DataFrame, key: list[str], order: str, follows: Column) -> DataFrame:
    """Join runs that follow each other: first start, last end."""
    w = Window.partitionBy(*key).orderBy(order)
    marked = runs.withColumn("_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    extra = [F.max_by(c, order).alias(c) for c in runs.columns if c not in (*key, order, "_a", "_b", "valid_from", "valid_to")]
    return marked.groupBy(*key, "_island").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.min("valid_from").alias("valid_from"), F.max_by("valid_to", order).alias("valid_to"), *extra).drop("_island")


def _across_ranges(pieces: DataFrame, numbered: DataFrame, keys: list[str], time: str, plan: OrderPlan) -> DataFrame:
    """Fill in the ends of runs that reach a range's end, and join those that go on in the next range."""
    ranges = numbered.filter(plan.is_split()).groupBy(*keys, "_shard").agg(F.count("*").alias("_len"), F.min(time).alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_shard")  # one row a range
    ranges = ranges.withColumns({"_index": F.row_number().over(w), "_following": F.lead("_first").over(w)})
    same = [pieces[k].eqNullSafe(ranges[k]) for k in [*keys, "_shard"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    cut = pieces.filter(plan.is_split()).join(ranges, cond, "inner").select(*[pieces[c] for c in pieces.columns], "_len", "_index", "_following")
    cut = cut.withColumns({"_left": F.col("_a") == 0, "_right": F.col("_b") == F.col("_len") - 1})
    cut = cut.withColumn("valid_to", F.when(F.col("_right"), F.col("_following")).otherwise(F.col("valid_to")))
    outer, inner = cut.filter("_left OR _right"), cut.filter("NOT (_left OR _right)")
    key = [*keys, "_hash", "_attrs"]
    w2 = Window.partitionBy(*key).orderBy("valid_from")
    goes_on = F.col("_left") & F.lag("_right").over(w2) & (F.col("_index") == F.lag("_index").over(w2) + 1)
    columns = [*key, "_a", "_b", "valid_from", "valid_to"]
    stitched = _joined(outer.select(*columns, "_left", "_right", "_index"), key, "valid_from", goes_on)
    return pieces.filter(~plan.is_split()).select(*columns).unionByName(inner.select(*columns)).unionByName(stitched.select(*columns))
