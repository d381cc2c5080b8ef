"""Which log events go on."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import gtid
from tidelog.functions.keys import canonical_name
from tidelog.model import EVENT_TYPES, ROW_EVENTS

Filter = Callable[[DataFrame], DataFrame]


def all_of(*predicates: Column) -> Column:
    """Conjunction in order; of none: true."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def known_type(event_type: str = "event_type") -> Column:
    return F.coalesce(F.col(event_type).isin(*EVENT_TYPES), F.lit(False))


def is_row_event(event_type: str = "event_type") -> Column:
    return F.coalesce(F.col(event_type).isin(*ROW_EVENTS), F.lit(False))


def subscribed(tables: list[str], resolved: str = "resolved_table") -> Column:
    """TABLE_MAP events of the subscribed tables (database:table), row events whose table id leads to one of them, all other events.

    resolved: canonical name that table_maps() found for a row event, null if none is in force.
    """
    own = canonical_name("database", "table_name").isin(*tables) if tables else F.lit(False)
    row = F.col(resolved).isin(*tables) if tables else F.lit(False)
    return F.coalesce(F.when(F.col("event_type") == "TABLE_MAP", own).when(is_row_event(), row).otherwise(True), F.lit(False))


def not_published(last_offset: int, last_gtid_set: str | None = None, last_uuid: str | None = None, strict_subset: bool = False) -> Column:
    """Row events beyond the saved state, and all other events.

    Same server, or a side without GTID set: by offset. Else an event goes on unless its GTID set lies within the saved
    one; with strict_subset an equal set goes on too (the last transaction may have been cut short by a failover).
    """
    saved, event = gtid.parse(F.lit(last_gtid_set)), gtid.parse("gtid_set")
    by_offset = F.col("offset") > F.lit(last_offset)
    if last_gtid_set is None:
        return ~is_row_event() | by_offset
    inside = gtid.contained(event, saved)
    if strict_subset:
        inside = inside & ~gtid.equal(event, saved)
    same = gtid.same_server(F.col("server_uuid"), F.col("gtid_set"), F.lit(last_uuid), F.lit(last_gtid_set))
    return ~is_row_event() | F.when(same, by_offset).otherwise(~inside)


def event_filter(tables: list[str], last_offset: int, last_gtid_set: str | None = None, last_uuid: str | None = None) -> Filter:
    """Type, then table, then duplicates, on events with resolved_table."""
    return lambda events: events.filter(all_of(known_type(), subscribed(tables), not_published(last_offset, last_gtid_set, last_uuid)))


def beyond_mark(events: DataFrame, states: DataFrame) -> DataFrame:
    """Duplicate filter by offset against each source's own state (source_id, last_offset); sources without state keep all."""
    marked = events.join(states.select("source_id", F.col("last_offset").alias("_mark")), "source_id", "left")
    return marked.filter(~is_row_event() | F.col("_mark").isNull() | (F.col("offset") > F.col("_mark"))).drop("_mark")
