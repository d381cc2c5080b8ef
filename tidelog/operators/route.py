"""Routing of mutations to a pool of destinations, and the pool's checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.keys import pool_member


def with_member(mutations: DataFrame, key: str, size: int) -> DataFrame:
    """Add member, by the key's hash; null keys go to member 0."""
    return mutations.withColumn("member", F.coalesce(pool_member(key, size), F.lit(0)))


def to_pool(mutations: DataFrame, key: str, size: int, order: list[str], source: str = "source_id", segment: Column | None = None) -> DataFrame:
    """Add member, and lay the rows out by source, member and order.

    A member's rows of a source follow each other in order. segment: a number that never decreases in the order, and of which one
    holds a bounded piece of a source (some log files, say): then a partition holds whole segments of a member, and a member with many
    rows spreads over partitions by ranges of the order. Rows of equal order keep no order among themselves.
    """
    by = [source, "member"] if segment is None else [source, "member", "_segment"]
    rows = with_member(mutations, key, size)
    rows = rows if segment is None else rows.withColumn("_segment", segment)
    return rows.repartition(*by).sortWithinPartitions(*by, *order).drop("_segment")


def pool_checkpoint(published: DataFrame, members: DataFrame, member: str = "member", offset: str = "offset") -> DataFrame:
    """(last_published): the least of the active members' last published offsets.

    Null if an active member has published nothing, or none is active; what inactive members published does not count.
    members: (member, active). An idle active member holds the checkpoint at its own last offset.
    """
    last = published.groupBy(member).agg(F.max(offset).alias("_last"))
    active = members.filter("active").join(last, member, "left")
    return active.agg(F.when(~F.coalesce(F.bool_or(F.col("_last").isNull()), F.lit(True)), F.min("_last")).alias("last_published"))


def delayed(mutations: DataFrame, now_ms: Column | int, delay_ms: int, timestamp: str = "ts_ms") -> DataFrame:
    """Mutations that are at least delay_ms old; null timestamps are held back."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return mutations.filter(F.col(timestamp) <= now - F.lit(delay_ms))
