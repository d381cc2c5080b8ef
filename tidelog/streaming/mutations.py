"""From a stream of log events to a stream of mutations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.keys import database_of, image_values, pk_text, routing_key
from tidelog.operators.filters import all_of, is_row_event, not_published
from tidelog.operators.mutate import explode_mutations
from tidelog.model import TRANSACTION
from tidelog.operators.state import SourceState
from tidelog.streaming.context import stream_context

_ROWS = "array<struct<before:array<string>,after:array<string>>>"


@dataclass(frozen=True)
class TableColumns:
    """Columns of a subscribed table, in the log's order, and those of its primary key."""

    names: tuple[str, ...]
    pk: tuple[str, ...]


def _by_table(tables: dict[str, tuple[str, ...]]) -> Column:
    """Lookup by resolved_table; the tables are those of the configuration."""
    if not tables:
        return F.lit(None).cast("array<string>")
    entries = [x for t, names in tables.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in names]).cast("array<string>"))]
    return F.try_element_at(F.create_map(*entries), F.col("resolved_table"))


_COLUMNS = "array<struct<name:string,type_code:int,is_pk:boolean>>"


def mutations_of(context: DataFrame, tables: dict[str, TableColumns] | list[str], state: SourceState | None = None, leader_epoch: int = 0) -> DataFrame:
    """Mutations of the subscribed tables (database:table) beyond the saved state, with their header; works on batches and streams.

    context: what stream_context() gives. tables: with their columns, or names only: then columns are those that the schema history had in
    force where the event's table map stands. Row events without table or columns in force, and of other tables, give nothing.
    """
    state = state or SourceState(last_offset=-1)
    wanted = all_of(is_row_event(), F.coalesce(F.col("resolved_table").isin(*tables), F.lit(False)), not_published(state.last_offset, state.gtid_set, state.server_uuid))
    if isinstance(tables, dict):
        named = {"column_names": _by_table({t: c.names for t, c in tables.items()}), "pk_names": _by_table({t: c.pk for t, c in tables.items()}), "column_codes": F.lit(None).cast("array<int>")}
    else:
        columns = F.from_json("columns_json", _COLUMNS)
        named = {"column_names": F.transform(columns, lambda c: c["name"]), "pk_names": F.transform(F.filter(columns, lambda c: c["is_pk"]), lambda c: c["name"]), "column_codes": F.transform(columns, lambda c: c["type_code"])}
    rows = context.filter(wanted).withColumns({"rows": F.from_json("rows_json", _ROWS), **named}).filter(F.col("column_names").isNotNull())
    made = explode_mutations(rows)
    pk = pk_text(image_values("entity", "pk_names"))
    database, table = database_of("resolved_table"), F.substring_index("resolved_table", ":", -1)
    return made.select(
        "source_id", "offset", "event_row_position", "op_seq", "op", F.col("timestamp_ms").alias("ts_ms"), F.concat_ws(":", "file_name", "position", "next_position").alias("binlog_pos"), "server_id", "server_uuid", "gtid_set",
        F.lit(leader_epoch).cast("long").alias("leader_epoch"), database.alias("database_name"), table.alias("table_name"), "table_id", "column_names", "pk_names", "column_codes", routing_key(database, table, pk).alias("routing_key"), "begin_txn", "last_txn", "current_gtid", "entity", "previous_entity",
    )


def mutation_stream(events: DataFrame, tables: dict[str, TableColumns] | list[str], state: SourceState | None = None, leader_epoch: int = 0, history: dict[str, list[dict]] | None = None) -> DataFrame:
    """history: see stream_context(); needed if tables are names only."""
    return mutations_of(stream_context(events, history), tables, state, leader_epoch)


def as_wire(mutations: DataFrame, overriding_database: str | None = None) -> DataFrame:
    """Mutations of a stream with the columns that wire records are made of."""
    begin, last = (F.from_json(c, TRANSACTION) for c in ("begin_txn", "last_txn"))
    columns = F.transform("column_names", lambda c, i: F.struct(c.alias("col_name"), F.get("column_codes", i).cast("bigint").alias("col_type"), F.array_contains("pk_names", c).alias("is_primary_key"), i.alias("col_position")))
    return mutations.withColumns({
        "mutation_id": F.col("offset"), "mutation_type": F.col("op"), "primary_key": F.col("pk_names"), "table_columns": columns, "overriding_database": F.lit(overriding_database).cast("string"),
        "last_transaction_pos": last["position"], "last_transaction_ts_ms": last["timestamp_ms"], "last_transaction_gtid_set": F.col("gtid_set"), "begin_transaction_pos": begin["position"], "begin_transaction_gtid": begin["gtid"],
    })
