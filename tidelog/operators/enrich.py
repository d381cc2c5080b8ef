"""Context of row events: their table, transaction and schema version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.keys import canonical_name
from tidelog.functions.statements import is_begin

#: A log file is what one server writes before it opens the next: the unit that is read in order by one task.
SEGMENT = ["source_id", "file_no"]


def _marker() -> Column:
    return F.struct(F.col("timestamp_ms"), F.col("offset"), F.concat_ws(":", "file_name", "position", "next_position").alias("position"), F.col("_gtid").alias("gtid"))


def transaction_context(events: DataFrame) -> DataFrame:
    """Add begin_txn, last_txn (timestamp_ms, offset, position, gtid) and current_gtid as in force at each event.

    BEGIN statements open a transaction; every other statement and XID end one; a GTID event names the next ones.
    Segmented carry: a running last value within each log file, the last values of each file carried over the files of
    the source (one row a file; the join finds the events partitioned by file already), then put together. An event's own marker counts for itself.
    Events are read in the order of (file_no, position); repeated events do no harm; null file numbers form a file.
    """
    begin = (F.col("event_type") == "QUERY") & is_begin("sql")
    end = (F.col("event_type") == "XID") | ((F.col("event_type") == "QUERY") & ~is_begin("sql"))
    w = Window.partitionBy(*SEGMENT).orderBy("position", F.col("event_type") == "XID")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = events.withColumn("_gtid_here", F.when(F.col("event_type") == "GTID", F.col("gtid")))
    local = named.withColumn("_g", F.last("_gtid_here", ignorenulls=True).over(running))
    # Gtids come first: a marker holds the gtid in force at its place, which may have been named in an earlier file.
    gtid_carry = _carry(named.groupBy(*SEGMENT).agg(F.max_by("_gtid_here", F.when(F.col("_gtid_here").isNotNull(), F.col("position"))).alias("_last_g")), {"_last_g": "_carry_g"})
    local = local.join(gtid_carry, SEGMENT, "left").withColumn("_gtid", F.coalesce("_g", "_carry_g"))
    local = local.withColumns({"_b": F.when(begin, _marker()), "_e": F.when(end, _marker())})
    local = local.withColumns({"_lb": F.last("_b", ignorenulls=True).over(running), "_le": F.last("_e", ignorenulls=True).over(running)})
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("position")))
    marks = _carry(local.groupBy(*SEGMENT).agg(latest("_b").alias("_last_b"), latest("_e").alias("_last_e")), {"_last_b": "_carry_b", "_last_e": "_carry_e"})
    out = local.join(marks, SEGMENT, "left")
    return out.select(*events.columns, F.coalesce("_lb", "_carry_b").alias("begin_txn"), F.coalesce("_le", "_carry_e").alias("last_txn"), F.col("_gtid").alias("current_gtid"))


def _carry(per_file: DataFrame, names: dict[str, str]) -> DataFrame:
    """Last non-null values of all earlier files of the source."""
    w = Window.partitionBy("source_id").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return per_file.select(*SEGMENT, *[F.last(c, ignorenulls=True).over(w).alias(to) for c, to in names.items()])


def table_maps(events: DataFrame) -> DataFrame:
    """Add resolved_table (database:table), map_database, map_table and map_types: the latest TABLE_MAP of the event's table id in its file.

    Table ids mean nothing across files, so nothing is carried; a row event without map keeps nulls.
    """
    w = Window.partitionBy(*SEGMENT, "table_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.when(F.col("event_type") == "TABLE_MAP", F.struct("database", "table_name", "column_types"))
    found = events.withColumn("_map", F.last(here, ignorenulls=True).over(w))
    return found.select(*events.columns, F.when(F.col("_map").isNotNull(), canonical_name("_map.database", "_map.table_name")).alias("resolved_table"), F.col("_map.database").alias("map_database"), F.col("_map.table_name").alias("map_table"), F.col("_map.column_types").alias("map_types"))


def map_refetches(events: DataFrame) -> DataFrame:
    """TABLE_MAP events that differ from the one before for their id and file (database, table or types), or are the first: what a cache must fetch anew."""
    maps = events.filter(F.col("event_type") == "TABLE_MAP")
    now = F.struct("database", "table_name", "column_types")
    w = Window.partitionBy(*SEGMENT, "table_id").orderBy("position")
    return maps.withColumn("_before", F.lag(now).over(w)).filter(~F.col("_before").eqNullSafe(now)).drop("_before")


def table_columns(names: Column, pk_flags: Column, types: Column) -> Column:
    """Columns of a table: schema columns zipped with the log's type codes, cut to the shorter list. Null lists: null."""
    n = F.least(F.size(names), F.size(types))
    cut = lambda c: F.slice(c, F.lit(1), n)
    zipped = F.arrays_zip(cut(names).alias("name"), cut(types).alias("type_code"), cut(pk_flags).alias("is_pk"))
    return F.when(names.isNotNull() & types.isNotNull(), F.transform(zipped, lambda c, i: F.struct(c["name"].alias("name"), c["type_code"].alias("type_code"), c["is_pk"].alias("is_pk"), (i + 1).alias("position"))))
