"""Checks that report, and never drop, what is out of order or does not fit its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_violations(rows: DataFrame, offset: str, arrival: str, keys: list[str], ignore_special: bool, piece: int = 1_000_000) -> DataFrame:
    """Rows whose offset is below that of the row that arrived just before (not below the highest so far).

    ignore_special: offsets of 0 and less, which mark special positions, are not reported (as for events; mutations are
    all looked at). The first row is never reported, nor equal or null offsets. Adds previous_offset. A long stream is
    looked at in pieces of `piece` arrivals (arrival: numbers without order of magnitude jumps), each with the last row
    of the piece before it.
    """
    cut = rows.withColumn("_piece", F.floor(F.col(arrival) / piece))
    w = Window.partitionBy(*keys, "_piece").orderBy(arrival)
    lagged = cut.withColumn("previous_offset", F.lag(offset).over(w))
    ends = cut.groupBy(*keys, "_piece").agg(F.max_by(offset, arrival).alias("_last"))
    before = ends.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_piece"))).drop("_last")  # one row a piece
    same = [lagged[k].eqNullSafe(before[k]) for k in [*keys, "_piece"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = lagged.join(before, cond, "left").select(*[lagged[c] for c in rows.columns], F.coalesce(lagged["previous_offset"], before["_carry"]).alias("previous_offset"))
    late = F.col(offset) < F.col("previous_offset")
    return joined.filter(late & (F.col(offset) > 0) if ignore_special else late)


def event_order_violations(events: DataFrame, arrival: str, keys: list[str]) -> DataFrame:
    return order_violations(events, "offset", arrival, keys, ignore_special=True)


def mutation_order_violations(mutations: DataFrame, arrival: str, keys: list[str], offset: str = "mutation_id") -> DataFrame:
    return order_violations(mutations, offset, arrival, keys, ignore_special=False)


def fits_table(row_columns: Column, table_columns: Column) -> Column:
    """Whether a row's columns equal the table's: the same entries (arrays of structs), whatever their order. Null equals null."""
    return F.array_sort(row_columns).eqNullSafe(F.array_sort(table_columns))


def schema_violations(mutations: DataFrame, row_columns: Column, table_columns: Column) -> DataFrame:
    """Mutations whose (new) row does not fit its table."""
    return mutations.filter(~fits_table(row_columns, table_columns))
