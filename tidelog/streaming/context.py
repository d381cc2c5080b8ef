"""Transaction, table and schema context of a stream of log events, kept in state per source."""

from __future__ import annotations

import json
from json.encoder import encode_basestring_ascii as _quoted
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelog.schema.store import SchemaTracker, Statement
from tidelog.session import parallelism
from tidelog.streaming.pieces import PIECES, Spool, into_pieces, of_bytes, piece_row

#: State of one source: JSON texts of the last BEGIN, the last end of a transaction, the gtid, the file's table maps, and the schema history.
_STATE = "begin string, last string, gtid string, file_no bigint, maps string, history string"
OUTPUT = """source_id string, event_type string, table_id bigint, timestamp_ms bigint, file_name string, position bigint, next_position bigint, file_no bigint, offset bigint,
server_id bigint, server_uuid string, gtid_set string, sql string, rows_json string, resolved_table string, columns_json string, begin_txn string, last_txn string, current_gtid string, schema_json string"""
_PASSED = ["source_id", "event_type", "table_id", "timestamp_ms", "file_name", "position", "next_position", "file_no", "offset", "server_id", "server_uuid", "gtid_set", "sql", "rows_json"]
_ROWS = ("WRITE", "UPDATE", "DELETE")
_MARKS = ("GTID", "TABLE_MAP", "QUERY", "XID")
_OF_MARKS = ["event_type", "table_id", "timestamp_ms", "file_name", "position", "next_position", "offset", "server_uuid", "gtid_set", "sql", "database", "table_name", "gtid", "column_types"]


def table_columns(tracker: SchemaTracker | None, database: str, table: str, types: list[int] | None) -> str | None:
    """Columns of a table as they are in force, as JSON of (name, type_code, is_pk): schema columns zipped with the log's type codes, cut to the shorter."""
    found = tracker.current.table(database, table) if tracker is not None else None
    return None if found is None else json.dumps([{"name": c.name, "type_code": t, "is_pk": c.primary_key} for c, t in zip(found, types or [])])


def _marker(e, gtid: str | None) -> str:
    """Place of an event as JSON, as json.dumps() writes it."""
    return f'{{"timestamp_ms": {int(e.timestamp_ms)}, "offset": {int(e.offset)}, "position": {_quoted(f"{e.file_name}:{e.position}:{e.next_position}")}, "gtid": {"null" if gtid is None else _quoted(gtid)}}}'


class _Texts:
    """Texts by number; each is kept once. No text is -1."""

    def __init__(self):
        self.numbers: dict[str, int] = {}

    def number(self, text: str | None) -> int:
        return -1 if text is None else self.numbers.setdefault(text, len(self.numbers))

    def column(self, numbers: np.ndarray) -> pa.Array:
        return pa.DictionaryArray.from_arrays(pa.array(numbers, pa.int32(), mask=numbers < 0), pa.array([*self.numbers], pa.string()))


class _Walk:
    """What a source's events say up to some place, and the way over further events. A new file clears the table maps, not the transactions."""

    def __init__(self, was: tuple | None, tracker: SchemaTracker | None):
        self.begin, self.last, self.gtid, self.file_no, maps = was[:5] if was else (None, None, None, None, "{}")
        self.maps: dict[int, tuple] = {int(t): tuple(v) for t, v in json.loads(maps or "{}").items()}
        self.tracker = tracker
        self.columns: dict[tuple, str | None] = {}  # of tables, as they are in force

    def state(self) -> tuple:
        return self.begin, self.last, self.gtid, self.file_no, json.dumps(self.maps), None if self.tracker is None else json.dumps(self.tracker.rows)

    def _columns(self, database: str, table: str, types: list[int] | None) -> str | None:
        key = (database, table, None if types is None else tuple(types))
        if key not in self.columns:
            self.columns[key] = table_columns(self.tracker, database, table, types)
        return self.columns[key]

    def over(self, events: pa.Table) -> pa.Table:
        """The next events, in order, with their context."""
        kinds = events["event_type"].combine_chunks()
        is_of = lambda names: pc.is_in(kinds, value_set=pa.array(names, pa.string())).to_numpy(zero_copy_only=False)
        file = pc.fill_null(events["file_no"].combine_chunks(), -1).to_numpy(zero_copy_only=False)
        # Table maps hold within a stretch: up to the next file or start.
        fresh = np.concatenate([[self.file_no is None or file[0] != self.file_no], file[1:] != file[:-1]]) | is_of(["START"])
        stretch = np.cumsum(fresh)
        marked = is_of(_MARKS)
        marks = np.flatnonzero(marked)
        begins, lasts, gtids, tables, columns, schemas = (_Texts() for _ in range(6))
        begin, last, gtid = begins.number(self.begin), lasts.number(self.last), gtids.number(self.gtid)
        after = [(begin, last, gtid)]
        said_at = np.full(len(events), -1, np.int32)
        # Table maps: stretch, table, place, what they say. Those of before are at -1.
        placed = [(0, t, -1, tables.number(r), columns.number(c)) for t, (r, c) in self.maps.items()] if not stretch[0] else []
        for at, e in zip(marks.tolist(), events.select(_OF_MARKS).take(marks).to_pandas().itertuples(index=False)):
            if e.event_type == "GTID":
                self.gtid = e.gtid
                gtid = gtids.number(self.gtid)
            elif e.event_type == "TABLE_MAP":
                types = None if e.column_types is None else [int(t) for t in e.column_types]
                made = (f"{e.database}:{e.table_name}", self._columns(e.database, e.table_name, types))
                placed.append((int(stretch[at]), int(e.table_id), at, tables.number(made[0]), columns.number(made[1])))
            else:
                marker = _marker(e, self.gtid)
                if e.event_type == "QUERY" and e.sql == "BEGIN":
                    self.begin, begin = marker, begins.number(marker)
                else:
                    self.last, last = marker, lasts.number(marker)
                    if self.tracker is not None and e.event_type == "QUERY" and e.sql != "COMMIT":
                        said = self.tracker.process(Statement(e.sql or "", e.database, f"{e.file_name}:{e.position}:{e.next_position}", int(e.timestamp_ms), e.server_uuid, e.gtid_set, self.gtid))
                        if said:
                            said_at[at] = schemas.number(json.dumps(said))
                            self.columns = {}
            after.append((begin, last, gtid))
        own = np.flatnonzero(is_of(_ROWS))
        found = _last_before(np.array(placed, np.int64).reshape(-1, 5), stretch[own], pc.fill_null(events["table_id"].combine_chunks(), -1).to_numpy(zero_copy_only=False)[own], own)
        resolved, in_force = np.full((2, len(events)), -1, np.int32)
        resolved[own], in_force[own] = found.T
        begun, ended, known = np.array(after, np.int32)[np.cumsum(marked)].T  # an event's own marker counts for itself
        end = int(stretch[-1])
        names, texts = [*tables.numbers], [*columns.numbers]
        self.maps = {t: (names[r], texts[c] if c >= 0 else None) for s, t, _, r, c in placed if s == end}
        self.file_no = int(file[-1])
        made = {"resolved_table": tables.column(resolved), "columns_json": columns.column(in_force), "begin_txn": begins.column(begun), "last_txn": lasts.column(ended), "current_gtid": gtids.column(known), "schema_json": schemas.column(said_at)}
        return pa.table({c: events[c] for c in _PASSED} | made)


def _last_before(placed: np.ndarray, stretch: np.ndarray, table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For rows by (stretch, table, place) what the last of `placed` before them says, its two last columns; -1 where there is none."""
    n = len(placed)
    keys = [np.concatenate([placed[:, k], x]) for k, x in enumerate((stretch, table, at))]
    order = np.lexsort(keys[::-1])
    last = np.maximum.accumulate(np.where(order < n, np.arange(len(order)), -1))
    found = np.full((len(order), 2), -1, np.int64)
    if n:
        source = order[np.maximum(last, 0)]
        same = (last >= 0) & (keys[0][source] == keys[0][order]) & (keys[1][source] == keys[1][order])
        found[order[same]] = placed[source[same], 3:]
    return found[n:]


class ContextProcessor(StatefulProcessor):
    """Walks a source's events, which come in pieces, in the order of their offsets, and gives them out in pieces with their context.

    Only markers are walked: statements, table maps, ids, ends of transactions. Row events stay in columns and get what the last markers
    before them say. With history (rows of a schema history by source), statements are folded into it, every table map takes the columns
    in force at its place, and each row that the history gains comes out as schema_json of the statement's event. In memory are about
    pieces.TOGETHER bytes of events at a time; pieces wait on the executor's disk until their turn.
    """

    def __init__(self, history: dict[str, list[dict]] | None = None):
        self.history = history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("context", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = self.state.get() if self.state.exists() else None
        tracker = None
        if self.history is not None:
            tracker = SchemaTracker(json.loads(was[5]) if was and was[5] else self.history.get(key[0], []))
        walk, spool = _Walk(was, tracker), Spool()
        try:
            pieces = [spool.put(int(r.first), int(r.last), int(r.size), bytes(r.data)) for some in rows for r in some.itertuples(index=False)]
            for events in spool.ordered(pieces):
                yield pd.DataFrame([piece_row(key[0], walk.over(events))])
        finally:
            spool.close()
        self.state.update(walk.state())

    def close(self) -> None:
        pass


def _out_of_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch["data"]:
            events = of_bytes(data.as_py())
            texts = pa.schema([pa.field(f.name, pa.string() if pa.types.is_dictionary(f.type) else f.type) for f in events.schema])
            yield from events.cast(texts).to_batches(max_chunksize=10_000)


def packed_context(events: DataFrame, history: dict[str, list[dict]] | None = None) -> DataFrame:
    """Context for a streaming DataFrame of log events, in pieces (see unpacked()). One source is one ordered key, as it has one log.

    history: rows of a schema history (see schema.store) by source, from which statements in the stream go on; empty lists for new
    sources. Without it tables have no columns here. Needs the RocksDB state store provider. Across micro-batches the events must
    come in log order; within one they may come in any.
    """
    lean = events.select(*[c for c in _PASSED if c != "rows_json"], F.to_json("rows").alias("rows_json"), "database", "table_name", "gtid", "column_types")
    return lean.mapInArrow(into_pieces, PIECES).groupBy("source_id").transformWithStateInPandas(ContextProcessor(history), PIECES, "Append", "None")


def unpacked(pieces: DataFrame, spread: bool = False) -> DataFrame:
    """The events of packed_context(). A source's events stay in one task and in their order, unless they are spread over tasks, piece by piece."""
    rows = pieces.repartition(parallelism(pieces.sparkSession), "source_id", "first") if spread else pieces
    return rows.mapInArrow(_out_of_pieces, OUTPUT.replace("\n", " "))


def stream_context(events: DataFrame, history: dict[str, list[dict]] | None = None, spread: bool = False) -> DataFrame:
    """packed_context(), unpacked: each event with its context."""
    return unpacked(packed_context(events, history), spread)


def schema_rows(context: DataFrame) -> DataFrame:
    """Rows that statements in the stream have added to the schema history, as they are kept by a SchemaStore."""
    from tidelog.schema.store import SCHEMA

    return context.filter(F.col("schema_json").isNotNull()).select("source_id", F.explode(F.from_json("schema_json", f"array<struct<{_struct_fields(SCHEMA)}>>")).alias("r")).select("source_id", "r.*")


def _struct_fields(schema: str) -> str:
    from pyspark.sql.types import _parse_datatype_string

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in _parse_datatype_string(schema.replace("\n", " ")))
