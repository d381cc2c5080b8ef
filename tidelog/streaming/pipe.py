"""Pipes: a source's stream, its transformation and its destination, kept alive; and a manager of pipes."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.config import Config, SourceConfig
from tidelog.errors import INVALID_POSITION, InvalidPositionError, source_error
from tidelog.functions.keys import TOPIC_PREFIX
from tidelog.functions.positions import position_offset
from tidelog.operators.state import Checkpointer, Repository, SourceState
from tidelog.operators.validate import schema_violations
from tidelog.schema import ddl
from tidelog.schema.store import SchemaStore, SchemaTracker
from tidelog.streaming.context import packed_context, schema_rows, unpacked
from tidelog.streaming.mutations import TableColumns, as_wire, mutations_of
from tidelog.streaming.sink import BufferedDestination, Check, Destination, DestinationPool, OrderCheck, Publish, build_destination, file_sink, kafka_sink, wire_records

# Seconds between looks at a pipe's life, between checkpoints, and that stopping may take.
KEEP_ALIVE_S, CHECKPOINT_S, STOP_S = 5.0, 60.0, 30.0


def _cause(message: str) -> str:
    """What a reader said, out of the query's error: from the number of a lost position on, if it is there."""
    at = message.find(f"{INVALID_POSITION};")
    return message[at:] if at >= 0 else message


@dataclass
class Pipe:
    """One streaming query. Opening twice does nothing; a query that failed is opened again by keep_alive().

    build: returns the stream of mutations for a session and the state to start from. checkpoint_path: Spark's checkpoints of the query, in
    shared storage, one for each generation of states: after a roll-back the stream starts anew from the state that was gone back to, and
    what lies before it does not come again from Spark's own memory of offsets. states: saved at what was published, and gone back on when the
    server has lost the position. transform: what is done to each batch of the stream before it is sent. commit: called with the offset up to which all is published. on_open, on_close: listeners.
    """

    name: str
    build: Callable[[SparkSession, SourceState], DataFrame]
    destination: Destination | BufferedDestination | DestinationPool
    checkpoint_path: str
    trigger: dict = field(default_factory=lambda: {"processingTime": "1 second"})
    commit: Callable[[int], None] | None = None
    states: Checkpointer | None = None
    query: StreamingQuery | None = None
    restarts: int = 0
    transform: Callable[[DataFrame, int], DataFrame] | None = None
    on_open: list[Callable[[SourceState], None]] = field(default_factory=list)
    on_close: list[Callable[[], None]] = field(default_factory=list)

    def state(self) -> SourceState:
        return self.states.state() if self.states is not None else SourceState(last_offset=-1)

    def open(self, spark: SparkSession) -> None:
        if self.is_running():
            return
        self.destination.open()
        state = self.state()
        place = f"{self.checkpoint_path}/{self.states.generation if self.states is not None else 0}"
        self.query = self.build(spark, state).writeStream.queryName(self.name).option("checkpointLocation", place).trigger(**self.trigger).foreachBatch(self._send).start()
        for listener in self.on_open:
            listener(state)

    def _send(self, batch: DataFrame, batch_id: int) -> None:
        if self.transform is None:
            return self.destination.send(batch, batch_id)
        batch.persist(StorageLevel.MEMORY_AND_DISK)  # the transformation may look at it more than once; the state function runs once
        try:
            self.destination.send(self.transform(batch, batch_id), batch_id)
        finally:
            batch.unpersist()

    def is_running(self) -> bool:
        return self.query is not None and self.query.isActive

    def failed(self) -> bool:
        return self.query is not None and self.query.exception() is not None

    def keep_alive(self, spark: SparkSession) -> bool:
        """Open again what has failed; whether it was. A lost position goes back to an earlier state first."""
        if not self.failed():
            return False
        self.destination.close()
        if self.states is not None and isinstance(source_error(_cause(str(self.query.exception()))), InvalidPositionError):
            self.states.reset()
        else:
            self.checkpoint()
        self.restarts += 1
        self.open(spark)
        return True

    def checkpoint(self) -> None:
        """Save how far all is published."""
        offset = self.destination.checkpoint_offset()
        if self.commit is not None and offset is not None:
            self.commit(offset)
        m = self.destination.last_mutation
        if self.states is not None and m is not None and {"offset", "ts_ms"} <= set(m):
            txn = json.loads(m["last_txn"]) if m.get("last_txn") else {}
            self.states.commit({"ts_ms": m["ts_ms"], "offset": m["offset"], "last_position": txn.get("position") or m.get("binlog_pos") or ":4:4", "server_uuid": m.get("server_uuid"), "gtid_set": m.get("gtid_set")})

    def close(self) -> None:
        """Stop, send what a buffer holds, then checkpoint."""
        if self.query is not None:
            self.query.stop()
        self.destination.close()
        self.checkpoint()
        for listener in self.on_close:
            listener()


class PipeManager:
    """Pipes by (source, partition); a supervisor thread keeps them alive and checkpoints them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.pipes: dict[tuple[str, str], list[Pipe]] = {}
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def add(self, source: str, partition: str, pipes: list[Pipe]) -> None:
        if (source, partition) in self.pipes:
            raise ValueError(f"{source} {partition} has pipes already")
        for p in pipes:
            p.open(self.spark)
        self.pipes[source, partition] = pipes

    def contains(self, source: str, partition: str | None = None) -> bool:
        return any(s == source and partition in (None, p) for s, p in self.pipes)

    def partitions(self, source: str) -> set[str]:
        return {p for s, p in self.pipes if s == source}

    def remove(self, source: str, partition: str) -> None:
        for p in self.pipes.pop((source, partition), []):
            p.close()

    def is_stopped(self) -> bool:
        return not any(p.is_running() for pipes in self.pipes.values() for p in pipes)

    def start(self) -> None:
        def watch() -> None:
            last = time.monotonic()
            while not self._stop.wait(KEEP_ALIVE_S):
                due = time.monotonic() - last >= CHECKPOINT_S
                for p in [p for pipes in [*self.pipes.values()] for p in pipes]:
                    p.keep_alive(self.spark)
                    if due:
                        p.checkpoint()
                last = time.monotonic() if due else last

        self._thread = threading.Thread(target=watch, daemon=True)
        self._thread.start()

    def stop(self) -> bool:
        """Close everything; whether it stopped in time."""
        self._stop.set()
        for pipes in self.pipes.values():
            for p in pipes:
                p.close()
        end = time.monotonic() + STOP_S
        while not self.is_stopped() and time.monotonic() < end:
            time.sleep(0.1)
        return self.is_stopped()


def _kafka(source: SourceConfig, config: Config) -> Publish:
    servers = (source.destination.producer_config or config.kafka_config).get("bootstrap_servers", "")
    return kafka_sink({"kafka.bootstrap.servers": ",".join(servers) if isinstance(servers, list) else str(servers)})


#: Publishers by the type of a destination; others are added here.
DESTINATIONS: dict[str, Callable[[SourceConfig, Config], Publish]] = {
    "kafka": _kafka,
    "file": lambda source, config: file_sink(source.destination.producer_config["path"]),
}


def schema_store(spark: SparkSession, config: Config, source: SourceConfig, root: str) -> SchemaStore:
    """A source's store, below the configured store's name."""
    place = config.mysql_schema_store.database if config.mysql_schema_store else "schemas"
    return SchemaStore(spark, f"{root}/{place}/{source.name}")


def schema_history(spark: SparkSession, config: Config, source: SourceConfig, root: str, state: SourceState, live: ddl.Catalog | None = None) -> dict[str, list[dict]] | None:
    """Schema history that a source's stream goes on from, by source; None if its configuration does not ask for one.

    A new store gets the live tables at the earliest position. What lies
    beyond the state is left out: the stream makes it again.
    """
    if not source.schema_version_enabled:
        return None
    store = schema_store(spark, config, source, root)
    if not store.exists():
        tracker = SchemaTracker()
        tracker.bootstrap(live or ddl.Catalog(), SourceState().last_position)
        store.append(tracker.to_df(spark))
        return {source.name: tracker.rows}
    at = position_offset(F.col("position"))
    beyond = F.coalesce(at > F.lit(state.last_offset), F.lit(False)) if state.last_offset > 0 else F.lit(False)
    return {source.name: SchemaTracker.initialize(store.read(), beyond, ddl.Catalog(), "").rows}


def pipe_of(spark: SparkSession, config: Config, source: SourceConfig, events: Callable[[SparkSession, SourceConfig, str], DataFrame], root: str, leader_epoch: int = 0, live: ddl.Catalog | None = None, columns: dict[str, TableColumns] | None = None, commit: Callable[[int], None] | None = None) -> Pipe:
    """A source's pipe from its configuration: saved state, log, schema history, context, mutations, checks, buffer, pool, destination.

    events: the stream of a source's log from a starting position on (earliest, latest or file:position). root: a shared folder for
    states, checkpoints, buffers and schema history. columns: of the subscribed tables, if no schema history is kept.
    """
    kind = source.destination.type
    if kind not in DESTINATIONS:
        raise ValueError(f"unknown destination type {kind}")
    name = f"{source.name}_0"
    states = Checkpointer(Repository(spark, f"{root}/pipe/{source.name}/state"), leader_epoch, SourceState(last_offset=-1, leader_epoch=leader_epoch))
    prefix, service = topic_prefix(source), F.col("source_id")
    checks = {
        "event.out.of.order": OrderCheck(ignore_special=True),
        "mutation.out.of.order": OrderCheck(order=("offset", "event_row_position", "op_seq")),
        "schema.mismatch": Check(lambda b: schema_violations(b, F.map_keys("entity"), F.col("column_names"))),
    }
    destination = build_destination(
        DESTINATIONS[kind](source, config), lambda b: wire_records(as_wire(b, source.overriding_database), prefix, service), checks, source.delay_send_ms,
        source.destination.buffer_size, source.destination.pool_size, spark, f"{root}/pipe/{source.name}/buffer",
    )

    versioned = source.schema_version_enabled
    tables = source.tables if versioned else (columns or {})

    def build(session: SparkSession, state: SourceState) -> DataFrame:
        return packed_context(events(session, source, starting_position(state, source)), schema_history(session, config, source, root, state, live))

    def transform(pieces: DataFrame, batch_id: int) -> DataFrame:
        context = unpacked(pieces)
        if versioned:
            schema_store(spark, config, source, root).append_new(schema_rows(context).drop("source_id"))
        return mutations_of(context, tables, states.state(), leader_epoch)

    return Pipe(name, build, destination, f"{root}/pipe/{source.name}/checkpoints", commit=commit, states=states, transform=transform)


def starting_position(state: SourceState, source: SourceConfig) -> str:
    """Where a log is read from: behind the saved state's last transaction; without one, where the configuration says; after a roll-back to
    nothing, at the earliest position."""
    file, position, following = state.last_position.rsplit(":", 2)
    if file:
        return f"{file}:{following}"
    return source.initial_binlog_position if state.last_offset < 0 else "earliest"


def topic_prefix(source: SourceConfig) -> str:
    return TOPIC_PREFIX[source.host_role]
